"""Every query with an oracle matches DuckDB on the smallest scale (the driver
repeats this at sf0.01); queries without one must run and return rows."""

import pytest

from revlens.plans.registry import ORACLES, QUERIES, load_all
from tests.conftest import SF_SMALL

load_all()
SLOW = {"behavior_model", "platt_calibration"}


@pytest.fixture(scope="module")
def con():
    from revlens.plans.check import duck
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    from revlens.plans.check import compare
    r = compare(spark, name, QUERIES[name], ORACLES[name], SF_SMALL, con)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
