"""Exact neighbours in blocks of matrices (against brute force on ties, copies, odd rows), row
bootstrap."""

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from revlens.operators import lsh
from revlens.operators import models as ML
from revlens.operators import neighbors as N
from revlens.operators import stats as S


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def brute(rows, k, unlike=False):
    """(id, neighbour, rank) over all pairs of rows, repeated ids included."""
    near = {}
    for i, y, v in rows:
        for j, z, w in rows:
            if None not in (i, j, v, w) and i != j and len(v) == len(w) and None not in v + w and not (unlike and (None in (y, z) or y == z)):
                near.setdefault(i, []).append((math.dist(v, w), j))
    return sorted((i, j, n) for i, found in near.items() for n, (_, j) in enumerate(sorted(found)[:k], 1))


def test_exact_neighbours_meet_in_blocks(spark, monkeypatch):
    """Grid vectors (many ties), hot copies and offsets that cancel; blocks cut on both sides."""
    monkeypatch.setattr(lsh, "MOST_ROWS", 40)
    monkeypatch.setattr(lsh, "LARGE_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [1e6 + float(v) for v in rng.integers(0, 4, 6)] if i % 4 else [1e6] * 6) for i in range(300)]
    df = frame(spark, rows)
    for k in (1, 5):
        got = sorted((r["vec_id"], r["nbr_id"], r["rank"]) for r in N.knn(df, df, k, n_pivots=7).collect())
        assert got == brute(rows, k)
    got = sorted((r["vec_id"], r["nbr_id"], r["rank"]) for r in N.nearest_unlike_neighbor(df, "label", method="exact").collect())
    assert got == brute(rows, 1, True)


def test_exact_neighbours_of_odd_rows(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, None), (6, 1, [1.0, 2.0, 3.0]), (9, 0, [1.0, 2.0, 4.0]),
            (None, 1, [0.0, 0.1]), (7, 1, [0.0, None]), (8, 1, [5.0, 5.0]), (10, None, [0.0, 0.5])]
    df = frame(spark, rows)
    got = sorted((r["vec_id"], r["nbr_id"], r["rank"]) for r in N.knn(df, df, 2, n_pivots=3).collect())
    assert got == brute(rows, 2)
    got = sorted((r["vec_id"], r["nbr_id"], r["rank"]) for r in N.nearest_unlike_neighbor(df, "label", method="exact").collect())
    assert got == brute(rows, 1, True)
    assert N.knn(df.limit(0), df, 2).count() == N.knn(df, df.limit(0), 2).count() == 0
    odd = frame(spark, rows + [(11, 1, [math.nan, 0.0]), (12, 1, [math.inf, 0.0])])
    got = {(r["vec_id"], r["nbr_id"], r["rank"]) for r in N.knn(odd, odd, 1, n_pivots=3).collect()}
    assert {(1, 10, 1), (8, 2, 1)} <= got and {i for i, _, _ in got} == {1, 2, 6, 8, 9, 10, 11, 12}


def test_a_block_sends_on_few_rows_and_holds_few_distances():
    """Each query of a block pair keeps k rows; the distances of 20,000 by 4,000 rows (640 MB) are never held at once."""
    import tracemalloc
    rng = np.random.default_rng(5)
    l = pd.DataFrame({"id": np.arange(4_000), "cls": None, "vec": list(rng.normal(size=(4_000, 8)))})
    r = pd.DataFrame({"id": np.arange(20_000), "cls": None, "vec": list(rng.normal(size=(20_000, 8)))})
    tracemalloc.start()
    got = lsh.nearest_of_block(l, r, 3, True, False)
    assert len(got) == 12_000 and tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()
    x, y = np.stack(l["vec"]), np.stack(r["vec"])
    for i in (0, 17, 3_999):
        d = np.sqrt(((x[i] - y) ** 2).sum(-1))
        d[i] = np.inf
        assert list(got[got["lid"] == i]["rid"]) == list(np.lexsort((np.arange(20_000), d))[:3])


def test_a_replicate_draws_one_number_a_row(spark):
    """The uniform number is worked out in the filter and once more for the rows that stay, not
    for every step of the Poisson distribution."""
    df = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3 == 0).cast("int").alias("pred"))
    values = S.replicate_values(df, F.col("id").cast("string"), {"accuracy": S.weighted_accuracy("y", "pred")}, n=30)
    assert values._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") <= 2
    u = [r["u"] for r in df.select(S.hash_uniform(F.col("id").cast("string"), F.lit(4), 42).alias("u")).collect()]
    w = [sum(x >= p for p in S._POISSON) for x in u]
    want = sum(k for i, k in enumerate(w) if (i % 2) == (i % 3 == 0)) / sum(w)
    assert abs(values.where("replicate = 4").first()["value"] - want) < 1e-12


def test_a_forest_keeps_the_nodes_of_its_rows(spark):
    """Else the trees grown so far are sent with every task of every level."""
    rows = [(i, i % 2, [float(i % 2), float(i % 5)]) for i in range(80)]
    train = frame(spark, rows).select("label", array_to_vector("embedding").alias("features"))
    forest = ML.random_forest(train, "features", "label", num_trees=3)
    assert forest.getCacheNodeIds() and forest.transform(train).where("prediction = label").count() == 80
