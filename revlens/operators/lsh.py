"""Approximate nearest neighbours by Euclidean locality-sensitive hashing (J5, J6, X4, ML6).

A vector is projected on random directions and each projection is cut into cells of one
width; the cells of ``per_table`` projections make the key of a bucket, and every vector
stands in one bucket of each table.  Rows that share a bucket are compared exactly; each row
keeps its nearest over all tables.

Cell width, projections a table and number of tables are planned: a few probe rows are
compared with the whole table for the distance of true neighbours, a bounded sample gives
the distances of any two rows.  Of all choices that find a neighbour at such a distance with
the wanted probability, the one with the fewest expected comparisons is taken.  On vectors
without structure no choice saves much, and all rows are compared: one table, one bucket.

Buckets are cut on both sides into blocks of about ``MOST_ROWS`` rows (more where all rows
meet), every left block meets every right block of its bucket: a hot bucket costs more tasks, not a larger one.
Rows that meet too few others are compared with all rows, in the same blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from revlens.session import materialize

SAMPLE_ROWS = 2_000       # rows whose distances stand for any two rows'
MOST_ROWS = 2_048         # rows of a block
LARGE_ROWS = 16_384       # of a block where all rows meet
TILE = 1 << 20            # distances that are held at once
PROBES = 64               # rows whose true neighbours are looked up for the plan
LEAST_TABLES, MOST_TABLES = 4, 48
ROW_COST = 40.0           # of a row in a table, in comparisons


@dataclass
class Tables:
    per_table: int            # projections in a key; 0: one bucket for all rows
    count: int
    width: float
    directions: np.ndarray    # (count * per_table, dimensions)
    offsets: np.ndarray

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket of every vector in every table."""
        if not self.per_table:
            return np.zeros((len(vectors), self.count), np.int64)
        cells = np.floor((vectors @ self.directions.T + self.offsets) / self.width).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(vectors), self.count, self.per_table)
        with np.errstate(over="ignore"):
            key = np.zeros(cells.shape[:2], np.uint64)
            for k in range(self.per_table):
                key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)


EVERYTHING = Tables(0, 1, 1.0, np.empty((0, 0)), np.empty(0))


def same_cell(distance: np.ndarray, width: float) -> np.ndarray:
    """Probability that two vectors at ``distance`` share a cell of a random projection."""
    c = width / np.maximum(np.asarray(distance, float), 1e-12)
    erf = np.vectorize(math.erf)
    return erf(c / math.sqrt(2)) - np.sqrt(2 / math.pi) / c * (1 - np.exp(-c * c / 2))


def plan_tables(near: np.ndarray, far: np.ndarray, dim: int, n: int, recall: float, seed: int) -> Tables:
    """Tables for ``n`` rows: ``near`` are distances of wanted neighbours, ``far`` those of any
    two rows.  At least ``LEAST_TABLES`` of them, as one table's borders may run through many
    clusters at once; a plan that saves less than three quarters of all comparisons is none."""
    if not len(near) or not len(far):
        return EVERYTHING
    r = max(float(np.quantile(near, 0.9)), 1e-9)
    best, cheapest = None, (n + ROW_COST) / 4
    for width in r * np.geomspace(0.5, 16, 21):
        hit, miss = float(same_cell(np.array([r]), width)[0]), same_cell(far, width)
        for m in range(1, 25):
            p = min(hit ** m, 1 - 1e-9)
            tables = max(LEAST_TABLES, math.ceil(math.log(1 - recall) / math.log1p(-p))) if p > 1e-9 else MOST_TABLES + 1
            if tables > MOST_TABLES:
                break
            cost = tables * (float((miss ** m).mean()) * n + ROW_COST)
            if cost < cheapest:
                best, cheapest = (m, tables, width), cost
    if best is None:
        return EVERYTHING
    m, tables, width = best
    rng = np.random.default_rng(seed)
    return Tables(m, tables, float(width), rng.standard_normal((tables * m, dim)), rng.random(tables * m) * width)


def near_distances(left: DataFrame, right: DataFrame, k: int, dim: int, exclude_self: bool, unlike: bool, seed: int) -> np.ndarray:
    """Distances of ``PROBES`` left rows to their ``k``-th nearest right row, in one pass over the
    right side: each task keeps the ``k`` nearest it has seen of each probe."""
    probes = left.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(PROBES).collect()
    if not probes:
        return np.empty(0)
    x, ids, cls = np.array([p["vec"] for p in probes], float), [p["id"] for p in probes], [p["cls"] for p in probes]

    def work(batches):
        best = np.full((len(ids), k), np.inf)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at:at + 512]
                d = np.sqrt(((x[:, None, :] - np.stack(some["vec"].to_numpy())[None]) ** 2).sum(-1))
                for p in range(len(ids)):
                    if exclude_self:
                        d[p, (some["id"] == ids[p]).to_numpy()] = np.inf
                    if unlike:
                        d[p, (some["cls"] == cls[p]).to_numpy()] = np.inf
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
        p, j = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"p": p.astype(np.int32), "d": best[p, j]})

    seen = right.mapInPandas(work, "p int, d double")
    kth = seen.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("d"))).where(F.col("r") == k)
    return np.array([r["d"] for r in kth.collect()])


def _usable(df: DataFrame, id_col: str, vec_col: str, class_col: str | None) -> DataFrame:
    cls = F.col(class_col) if class_col else F.lit(None).cast("int")
    d = df.select(F.col(id_col).alias("id"), cls.alias("cls"), F.col(vec_col).cast("array<double>").alias("vec"))
    return d.where(F.col("id").isNotNull() & (F.size("vec") > 0)
                   & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _dealt(rows: DataFrame, tables: Tables, first: int = 0) -> DataFrame:
    """One row for each table, numbered from ``first``."""
    schema = StructType([StructField("tab", IntegerType()), StructField("bucket", LongType()), *rows.schema.fields])
    names = schema.names

    def work(batches):
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            b = tables.buckets(x)
            take = pa.array(np.repeat(np.arange(batch.num_rows), tables.count))
            cols = [pa.array(np.tile(np.arange(first, first + tables.count, dtype=np.int32), batch.num_rows)), pa.array(b.reshape(-1))]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(k).take(take) for k in range(batch.num_columns))], names=names)

    return rows.mapInArrow(work, schema)


def _blocks(left: DataFrame, right: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block pair ``(i, j)`` of their bucket in which they meet."""
    sizes = (left.select("tab", "bucket", F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionAll(right.select("tab", "bucket", F.lit(0).alias("l"), F.lit(1).alias("r")))
             .groupBy("tab", "bucket").agg(F.sum("l").alias("l"), F.sum("r").alias("r")))
    hot = materialize(sizes.where((F.col("l") > most) | (F.col("r") > most)).select(
        "tab", "bucket", F.ceil(F.col("l") / most).cast("int").alias("nl"), F.ceil(F.col("r") / most).cast("int").alias("nr")))

    def placed(side: DataFrame, own: str, other: str, mine: str, its: str) -> DataFrame:
        j = side.join(hot, ["tab", "bucket"], "left")
        n, m = F.greatest(F.coalesce(own, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1))
        j = j.withColumn(mine, F.pmod(F.xxhash64("id", "tab"), n).cast("int")).withColumn(its, F.explode(F.sequence(F.lit(0), m - 1)))
        return j.select("tab", "bucket", "i", "j", "id", "cls", "vec")

    return placed(left, "nl", "nr", "i", "j"), placed(right, "nr", "nl", "j", "i")


def _few_copies(y: np.ndarray, rid: np.ndarray, rc: np.ndarray, k: int) -> np.ndarray:
    """Places of the right rows (ids ascending) that can be among anyone's ``k`` nearest: of equal
    vectors of one class, those of the ``k + 1`` smallest ids (one may be the left row's own)."""
    if len(y) <= k + 1 or not y.shape[1]:
        return np.arange(len(y))
    bits = np.ascontiguousarray(y + 0.0).view(np.dtype((np.void, y.shape[1] * 8))).ravel()
    group = np.unique(bits, return_inverse=True)[1].astype(np.int64)
    group = group * (int(rc.max()) + 1) + rc
    order = np.argsort(group, kind="stable")
    g, i = group[order], rid[order]
    first = np.r_[True, g[1:] != g[:-1]]
    ids = np.cumsum(first | np.r_[True, i[1:] != i[:-1]])          # different (group, id) so far
    nth = ids - np.maximum.accumulate(np.where(first, ids, 0))     # of them in the group
    return np.sort(order[nth <= k])


def nearest_of_block(l: pd.DataFrame, r: pd.DataFrame, k: int, exclude_self: bool, unlike: bool) -> pd.DataFrame:
    """The ``k`` nearest right rows of every left row of one block pair.

    A matrix product gives all squared distances within a known error; those that may be among
    the ``k`` smallest are computed again from the differences, and these decide."""
    x, y = np.stack(l["vec"].to_numpy()).astype(float), np.stack(r["vec"].to_numpy()).astype(float)
    lid, rid = l["id"].to_numpy(), r["id"].to_numpy()
    lc, rc = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    if unlike:
        both = pd.concat([l["cls"], r["cls"]], ignore_index=True)
        codes = pd.factorize(both)[0].astype(np.int64)
        codes[codes < 0] = codes.max(initial=0) + 1 + np.arange((codes < 0).sum())     # no class is like no other
        lc, rc = codes[:len(x)], codes[len(x):]
    order = np.argsort(rid, kind="stable")
    y, rid, rc = y[order], rid[order], rc[order]
    few = _few_copies(y, rid, rc, k)
    y, rid, rc = y[few], rid[few], rc[few]
    low, high = np.searchsorted(rid, lid, "left"), np.searchsorted(rid, lid, "right")
    exact = not (np.isfinite(x).all() and np.isfinite(y).all())      # sums of infinities have no error bound
    if not exact:
        middle = y.mean(axis=0)
        u, v = x - middle, y - middle
        uu, vv = (u * u).sum(1), (v * v).sum(1)
        exact = not (np.isfinite(uu).all() and np.isfinite(vv).all())
        if not exact:      # not too large to be squared
            # roundings of the shift and of the sums, several times over
            slack = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (uu + vv.max())
            product = np.ascontiguousarray(np.c_[-2 * v, vv].T)          # with (u, 1): the squared distance less uu
            u = np.c_[u, np.ones(len(u))]
    step = max(1, TILE // max(1, y.size if exact else len(y)))
    out = ([], [], [])
    for at in range(0, len(x), step):
        to = min(at + step, len(x))
        if exact:
            with np.errstate(invalid="ignore", over="ignore"):
                d = ((x[at:to, None, :] - y[None, :, :]) ** 2).sum(-1)
            d[np.isnan(d)] = np.inf
        else:
            d = u[at:to] @ product
        barred = lc[at:to, None] == rc[None, :] if unlike else np.zeros(d.shape, bool)
        if exclude_self:
            for row in np.flatnonzero(high[at:to] > low[at:to]):
                barred[row, low[at + row]:high[at + row]] = True
        if unlike or exclude_self:
            np.copyto(d, np.inf, where=barred)
        if d.shape[1] > k:
            kth = d.min(axis=1) if k == 1 else np.partition(d, k - 1, axis=1)[:, k - 1]
            rows, places = np.nonzero(d <= (kth * (1 + 1e-14) if exact else kth + 2 * slack[at:to])[:, None])
            ok = ~barred[rows, places]
            rows, places = rows[ok], places[ok]
        else:
            rows, places = np.nonzero(~barred)
        dist = np.empty(len(rows))
        for part in range(0, len(rows), 1 << 15):
            a, b = rows[part:part + (1 << 15)], places[part:part + (1 << 15)]
            with np.errstate(invalid="ignore", over="ignore"):
                dist[part:part + (1 << 15)] = np.sqrt(((x[at + a] - y[b]) ** 2).sum(-1))
        best = np.lexsort((places, dist, rows))                      # ids ascend: ties go to the smaller; NaN comes last
        rows, places, dist = rows[best], places[best], dist[best]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        keep = nth < k
        out[0].append(lid[at + rows[keep]])
        out[1].append(rid[places[keep]])
        out[2].append(dist[keep])
    return pd.DataFrame({"lid": np.concatenate(out[0]), "rid": np.concatenate(out[1]), "dist": np.concatenate(out[2])})


def block_rows(n: int) -> int:
    """Rows of a block when all of ``n`` rows meet: larger blocks for larger tables, as every row
    is sent to each block of the other side."""
    return max(MOST_ROWS, min(n // 8, LARGE_ROWS))


def meet(left: DataFrame, right: DataFrame, k: int, exclude_self: bool, unlike: bool, most: int) -> DataFrame:
    """(lid, rid, dist): the ``k`` nearest of every left row in each block pair of its buckets."""
    a, b = _blocks(left, right, most)
    schema = StructType([StructField("lid", left.schema["id"].dataType), StructField("rid", right.schema["id"].dataType), StructField("dist", DoubleType())])

    def work(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"lid": [], "rid": [], "dist": []}).astype({"dist": float})
        return nearest_of_block(l, r, k, exclude_self, unlike)

    keys = ["tab", "bucket", "i", "j"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(work, schema)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    once = pairs.groupBy("lid", "rid").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("lid").orderBy("dist", "rid")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prepare(left: DataFrame, right: DataFrame, k: int, id_col: str, vec_col: str, class_col: str | None, recall: float, seed: int,
            exclude_self: bool = True) -> tuple[DataFrame, DataFrame, Tables]:
    """Usable rows of both sides, and the tables planned for them.  Vectors of another length
    than most of a sample take no part."""
    l, r = _usable(left, id_col, vec_col, class_col), _usable(right, id_col, vec_col, class_col)
    some = [x["vec"] for x in r.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).select("vec").collect()]
    lengths = [len(v) for v in some]
    dim = max(sorted(set(lengths)), key=lengths.count) if lengths else 1
    l, r = l.where(F.size("vec") == dim), r.where(F.size("vec") == dim)
    x = np.array([v for v in some if len(v) == dim], float).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, max(1, len(x)), 4_000) for _ in range(2))
    far = np.sqrt(((x[a] - x[b]) ** 2).sum(-1))[a != b] if len(x) > 1 else np.empty(0)
    near = near_distances(l, r, k, dim, exclude_self, class_col is not None, seed) if len(far) else np.empty(0)
    return l, r, plan_tables(near, far, dim, r.count() if len(near) else 0, recall, seed)


def lsh_knn(left: DataFrame, right: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = True,
            class_col: str | None = None, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """(id, nbr_id, dist, rank): for every left row its ``k`` nearest right rows found, nearest
    first, ties to the smaller id.  Each of the true neighbours is found with a probability of
    about ``recall``; distances are exact.  ``class_col``: only rows of different classes pair.

    Null ids, and vectors that are null, empty, not finite or of another length than most,
    take no part.  Fewer than ``k`` admissible rows give fewer neighbours; empty sides none."""
    l, r, tables = prepare(left, right, k, id_col, vec_col, class_col, recall, seed, exclude_self)
    unlike = class_col is not None
    all_rows = block_rows(r.count())
    found = _top(meet(_dealt(l, tables), _dealt(r, tables), k, exclude_self, unlike, MOST_ROWS if tables.per_table else all_rows), k)
    if tables.per_table:
        found = materialize(found)
        enough = found.groupBy("lid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("lid").alias("id"))
        short = materialize(l.join(enough, "id", "left_anti"))
        if not short.isEmpty():
            found = _top(found.select("lid", "rid", "dist").unionAll(meet(_dealt(short, EVERYTHING), _dealt(r, EVERYTHING), k, exclude_self, unlike, all_rows)), k)
    return found.select(F.col("lid").alias(id_col), F.col("rid").alias("nbr_id"), "dist", "rank")


def pairs_compared(left: DataFrame, right: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", class_col: str | None = None,
                   recall: float = 0.95, seed: int = 7) -> int:
    """How many row pairs the buckets of ``lsh_knn`` hold."""
    l, r, tables = prepare(left, right, k, id_col, vec_col, class_col, recall, seed)
    a = _dealt(l, tables).groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("a"))
    b = _dealt(r, tables).groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, ["tab", "bucket"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]
