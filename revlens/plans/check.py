"""Compare a Spark query with its DuckDB oracle (row count, column names, values).

Used by the pytest oracle suite and by ``python -m revlens.plans.check``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from revlens.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    con = con or duck(sf_dir)
    opdf = con.execute(sql).df()
    res = {"query": name, "spark_rows": len(spdf), "oracle_rows": len(opdf), "spark_sec": round(t1 - t0, 2)}
    if sorted(spdf.columns) != sorted(opdf.columns):
        res.update(ok=False, why=f"columns {sorted(spdf.columns)} vs {sorted(opdf.columns)}")
        return res
    def kind(dt):
        k = dt.kind
        return "int" if k in "iu" else "float" if k == "f" else "bool" if k == "b" else "other"

    dmis = [c for c in spdf.columns if len(spdf) and len(opdf) and kind(spdf[c].dtype) != kind(opdf[c].dtype)]
    if dmis:
        res.update(ok=False, why=f"dtypes differ: {[(c, str(spdf[c].dtype), str(opdf[c].dtype)) for c in dmis]}")
        return res
    a, b = _rows(spdf), _rows(opdf)
    if len(a) != len(b):
        res.update(ok=False, why="row count")
        return res
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    res.update(ok=not diff, why=f"{len(diff)} rows differ; first: {diff[0] if diff else None}" if diff else "")
    return res


def main(argv: list[str]) -> int:
    from revlens.plans.registry import ORACLES, QUERIES, load_all
    from revlens.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    load_all()
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name in sorted(QUERIES):
        if names and name not in names:
            continue
        if name not in ORACLES:
            t0 = time.time()
            try:
                n = QUERIES[name](spark, sf_dir).count()
                print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s)", flush=True)
            except Exception as e:
                bad += 1
                print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        try:
            r = compare(spark, name, QUERIES[name], ORACLES[name], sf_dir, con)
        except Exception as e:  # report and continue
            r = {"query": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += not r["ok"]
        print(("OK    " if r["ok"] else "FAIL  ") + f"{name}: {r}", flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
