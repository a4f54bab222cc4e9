"""Approximate nearest neighbours with an inverted multi-index.

A vector's two halves are quantised separately against k centroids each, which gives
k*k cells.  A query walks the cells in the order of summed half distances with a heap
until it has met its budget of candidates, which are then ranked by exact distance.

Codebooks and budget come from a bounded sample (``SAMPLE`` vectors, taken by a hash of
their id); every vector is indexed.  The budget is the smallest share of all vectors with
which ``RECALL`` of the sample's true neighbours are met, so clustered data needs little
and structureless data much.

The codebooks grow with the counted vectors.  Both sides of a row of cells are dealt by a
hash of the id into blocks of bounded size, and every block of its queries meets every
block of its vectors in a group of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import cut

SAMPLE = 8_000
PROBES = 200
RECALL = 0.97
CELLS_PER_HALF = 32           # at least
MOST_PER_HALF = 256           # bounds the driver's table of cells and the sample
ROWS_PER_CELL = 1_000
SAMPLE_PER_CENTROID = 64
BLOCK_ROWS = 4_096
QUERY_ROWS = 4_096


@dataclass
class Index:
    left: np.ndarray       # k x half
    right: np.ndarray
    share: float           # of all vectors, that a query meets


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` of rows that take part: id and vector not null, at least one component
    not zero, none null or non-finite."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine).where(F.exists(v, lambda x: x != 0)))


def _lloyd(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def walk(d_left: np.ndarray, d_right: np.ndarray, counts: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Cells in the order of summed distance until ``budget`` vectors are met: a heap holds
    the frontier of the two sorted centroid lists."""
    a, b = np.argsort(d_left, kind="stable"), np.argsort(d_right, kind="stable")
    heap, seen, out, met = [(d_left[a[0]] + d_right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and met < budget:
        _, i, j = heapq.heappop(heap)
        if n := counts[a[i], b[j]]:
            out.append((int(a[i]), int(b[j])))
            met += int(n)
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (d_left[a[p]] + d_right[b[q]], p, q))
    return out


def cells_for(n: int) -> int:
    """Centroids of a half for ``n`` vectors."""
    return max(CELLS_PER_HALF, min(MOST_PER_HALF, int(np.sqrt(n / ROWS_PER_CELL))))


def common_length(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent length (ties: the smaller) and the number of vectors that have it."""
    row = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return (row["n"], row["c"]) if row else (0, 0)


def fit(vectors: DataFrame, neighbours: int = 10, cells: int = CELLS_PER_HALF) -> Index | None:
    """Codebooks and budget from the sample; None without vectors.  All have one length."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, cells * SAMPLE_PER_CENTROID)).collect()
    if not rows:
        return None
    x = np.array([r["v"] for r in rows])
    half = x.shape[1] // 2
    index = Index(_lloyd(x[:, :half], cells), _lloyd(x[:, half:], cells), 1.0)
    if len(x) <= 4 * neighbours:
        return index
    i, j = _distances(x[:, :half], index.left).argmin(axis=1), _distances(x[:, half:], index.right).argmin(axis=1)
    counts = np.zeros((len(index.left), len(index.right)), np.int64)
    np.add.at(counts, (i, j), 1)
    shares = np.linspace(0.02, 1.0, 50)
    hit, total = np.zeros(len(shares)), 0
    for q in range(0, len(x), max(1, len(x) // PROBES)):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        true = np.argsort(d, kind="stable")[:neighbours]
        order = walk(((index.left - x[q, :half]) ** 2).sum(axis=1), ((index.right - x[q, half:]) ** 2).sum(axis=1), counts, len(x))
        met_at, met = {}, 0
        for c in order:
            met_at[c] = met          # the cell is opened while fewer than the budget are met
            met += int(counts[c])
        need = np.array([met_at[(int(i[t]), int(j[t]))] for t in true]) / len(x)
        hit += (need[:, None] < shares[None, :]).sum(axis=0)
        total += len(true)
    enough = np.flatnonzero(hit / total >= RECALL)
    index.share = float(shares[enough[0]]) if len(enough) else 1.0
    return index


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's nearest vectors among ``df``,
    itself excluded, by Euclidean distance in double precision on the original vectors,
    nearest first, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor
    do vectors of another length than the most frequent one.  Rows with one id and one
    vector count once.  An empty side gives no row.
    """
    spark = df.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    # rows of one id and vector are one candidate
    base = usable(df, id_col, vec_col)
    length, n = common_length(base)
    base = base.where(F.size("v") == length)
    index = fit(base, neighbours, cells_for(n)) if n else None
    if index is None:
        return spark.createDataFrame([], out_schema)
    half = index.left.shape[1]

    @F.pandas_udf("struct<i:int,j:int>")
    def cell(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, length))
        return pd.DataFrame({"i": _distances(x[:, :half], index.left).argmin(axis=1).astype(np.int32),
                             "j": _distances(x[:, half:], index.right).argmin(axis=1).astype(np.int32)})

    placed = cut(base.withColumn("cell", cell("v")).select("cell.i", "cell.j", "id", "v"), "index")
    sizes = placed.groupBy("i", "j").agg(F.count("*").alias("n")).collect()        # k*k rows at most
    counts = np.zeros((len(index.left), len(index.right)), np.int64)
    for r in sizes:
        counts[r["i"], r["j"]] = r["n"]
    budget = int(np.ceil(index.share * counts.sum()))
    blocks = np.maximum(1, -(-counts.sum(axis=1) // BLOCK_ROWS)).astype(np.int32)   # a crowded row of cells is split

    def dealt(df: DataFrame, own: np.ndarray, seed: int, name: str, other: np.ndarray, each: str) -> DataFrame:
        """A row goes to one block of its own side, and to every block of the other side."""
        at = [F.element_at(F.lit(k.tolist()).cast("array<int>"), F.col("i") + 1) for k in (own, other)]
        return (df.withColumn(name, F.pmod(F.xxhash64("id", F.lit(seed)), at[0]).cast("int"))
                .withColumn(each, F.explode(F.sequence(F.lit(0), at[1] - 1))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query goes to every row of cells that it visits, with the columns it wants there."""
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = []
                for q, v in zip(batch["id"].iloc[at:at + 64], batch["v"].iloc[at:at + 64]):
                    v = np.asarray(v)
                    wanted: dict[int, list[int]] = {}
                    for a, b in walk(((index.left - v[:half]) ** 2).sum(axis=1), ((index.right - v[half:]) ** 2).sum(axis=1), counts, budget):
                        wanted.setdefault(a, []).append(b)
                    rows += [(a, q, v, js) for a, js in wanted.items()]
                yield pd.DataFrame(rows, columns=["i", "id", "v", "js"])

    asked = cut(usable(queries, id_col, vec_col).where(F.size("v") == length).dropDuplicates(["id", "v"])
                .mapInPandas(route, "i int, id long, v array<double>, js array<int>"), "asked")
    visits = np.zeros(len(index.left), np.int64)
    for r in asked.groupBy("i").agg(F.count("*").alias("n")).collect():            # k rows at most
        visits[r["i"]] = r["n"]
    parts = np.maximum(1, -(-visits // QUERY_ROWS)).astype(np.int32)                # so are the queries that visit it
    asked = dealt(asked, parts, 5, "part", blocks, "block")
    data = dealt(placed.where(F.element_at(F.lit((visits > 0).tolist()), F.col("i") + 1)), blocks, 3, "block", parts, "part")

    def rank(key, q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(rows):
            x, ids, js = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy(), rows["j"].to_numpy()
            order = np.argsort(js, kind="stable")
            x, ids, js = x[order], ids[order], js[order]
            starts = np.searchsorted(js, np.arange(len(index.right) + 1))
            for qid, v, want in zip(q["id"], q["v"], q["js"]):
                picked = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in want])
                picked = picked[ids[picked] != qid]
                if len(picked):
                    d = x[picked] - np.asarray(v)
                    score = np.sqrt((d * d).sum(axis=1))
                    # rows of one id and vector count once: a few more than asked, then distinct
                    best = np.lexsort((ids[picked], score))
                    pairs = list(dict.fromkeys(zip(ids[picked][best].tolist(), score[best].tolist())))[:neighbours] \
                        if len(np.unique(ids[picked])) < len(picked) else list(zip(ids[picked][best[:neighbours]].tolist(), score[best[:neighbours]].tolist()))
                    found += [(qid, i, s) for i, s in pairs]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = asked.groupBy("i", "block", "part").cogroup(data.groupBy("i", "block", "part")).applyInPandas(rank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= neighbours)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
