"""Plans and hand-worked cases: texts out of shuffle keys, p-values, Shapley values."""

import math

import pytest
from pyspark.sql import functions as F

from revlens.operators import explain as X
from revlens.operators import metrics as M
from revlens.operators import stats as S
from revlens.plans.q_metrics import scored_reviews
from revlens.sources.tables import spread
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_text_in_keys_of_scored_reviews(spark):
    for line in plan(scored_reviews(spark, SF_SMALL)).splitlines():
        if "hashpartitioning" in line or "Aggregate(keys" in line:
            keys = line.split("keys=[")[-1].split("]")[0] if "keys=[" in line else line.split("hashpartitioning(")[1].split("), ")[0]
            assert "review_text" not in keys.replace("sha2", ""), line


@pytest.mark.parametrize("x,dof,want", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
                                        (0.0, 1, 1.0), (2000.0, 2, 0.0), (1300.0, 1, 0.0)])
def test_chi2_tail(spark, x, dof, want):
    got = spark.range(1).select(S.chi2_tail(F.lit(x), F.lit(dof)).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=1e-9) and abs(got - S.chi2_sf(x, dof)) < 1e-9


def test_chi2_tail_of_nothing(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    assert [r["p"] for r in df.select(S.chi2_tail(F.col("x"), F.lit(1)).alias("p")).collect()] == [None, None]


def test_shapley_values_of_a_product(spark):
    """f = a * b against the background (0, 0): each feature gets half in the mean over orders,
    and the values of a row always add up to f(x) - f(background)."""
    df = spark.createDataFrame([(i, 2.0, 3.0) for i in range(20)], "id long, a double, b double")
    bg = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    got = X.shapley_values(df, "id", ["a", "b"], lambda p: p["a"] * p["b"], bg, n_perm=64).collect()
    sums = {}
    for r in got:
        sums[r["id"]] = sums.get(r["id"], 0.0) + r["shapley"]
    assert all(v == pytest.approx(6.0) for v in sums.values()) and len(sums) == 20
    assert sum(r["shapley"] for r in got if r["feature"] == "a") / 20 == pytest.approx(3.0, abs=0.5)


def test_misclassified_needs_no_text(spark):
    df = spark.createDataFrame([(1, 0, 1, 5), (2, 1, 1, 9), (3, None, None, 7), (4, 1, None, 7)], "id long, y int, p int, n int")
    got = M.misclassified_examples(df, "y", "p", "id", k=2, len_col="n").collect()
    assert [r["id"] for r in got] == [3, 4]


def test_spread_leaves_many_splits(spark):
    many = spark.range(100).repartition(64)
    assert spread(many) is many and spread(spark.range(100).coalesce(1)).count() == 100


def test_csv_is_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    from revlens.sources import readers as RD
    rows = [(str(k), f'line {k}\n"quoted", second {k}', "5") for k in range(40)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, rating string").repartition(4)
    monkeypatch.setattr(RD, "ROWS_PER_FILE", 6)
    for sep, one in ((",", False), ("\t", False), (",", True)):
        path = tmp_path / f"{len(sep.strip())}{one}"
        RD.write_csv(df, str(path), sep, **({"one_file": True} if one else {}))
        files = list(path.glob("part-*"))
        assert len(files) == 1 if one else len(files) >= 7
        back = RD.read_reviews(spark, str(path), sep=sep)
        assert one or back.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, back.select("review_id", "review_text", "rating").collect())) == sorted(rows)
