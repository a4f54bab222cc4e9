"""Random forest (ML7) whose trees are grown inside tasks and kept in a written table.

Spark's own forest collects every node on the driver and makes a job of each level of a few
trees.  Here the rows, one byte a feature after binning, are dealt to groups of trees; a task
grows its trees level by level in numpy and writes them, a row a tree.  Scoring deals the
binned rows to the same groups and sums up in whole numbers, so neither the driver nor a task
ever holds the forest.

The trees are those of the usual algorithm: up to 32 bins a feature by quantiles of all rows,
Poisson(1) bootstrap, square root of the features drawn for every node, Gini gain of class-weighted
rows, at least one row a leaf.  What is drawn depends on the seed, the tree and the rows, not
on how the rows are laid out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import U64, mix
from revlens.session import materialize, scratch_path

MAX_BINS = 32                # as in pyspark.ml
TASK_BYTES = 256 << 20       # binned rows that a task holds; larger tables are fitted by pyspark.ml
MOST_NODES = 500_000         # bound of a forest that the driver may hold: those stay pyspark.ml's
GROW_ROWS = 500_000          # rows of all trees grown at once in a task
SCORE_ROWS = 500_000         # rows scored by a task
SUMMARY = 200                # quantiles of a feature that a task hands on
UNIT = float(1 << 40)        # shares are summed in whole numbers, in any order the same
_TREE = "tree int, feature binary, code binary, left binary, counts binary"


def _matrix(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a feature vector is null")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: rows, rows of each label, and for each feature its values (if few) or quantiles."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _matrix(batch.column(0)), batch.column(1)
        if y.null_count:
            raise ValueError("a label is null")
        y = y.to_numpy()
        if (y < 0).any() or (y != np.floor(y)).any() or (y > 254).any():
            raise ValueError("labels must be whole numbers from 0 to 254")
        points = []
        for f in range(x.shape[1]):
            v = np.sort(x[:, f][~np.isnan(x[:, f])])
            own = v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v
            few = len(own) <= SUMMARY
            points.append((few, (own if few else v[np.linspace(0, len(v) - 1, SUMMARY).astype(int)]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([len(y)]), pa.array([np.bincount(y.astype(np.int64), minlength=255).tobytes()], pa.binary()),
                                          pa.array([[p for _, p in points]], pa.list_(pa.binary())), pa.array([[k for k, _ in points]], pa.list_(pa.bool_()))],
                                         names=["n", "labels", "points", "few"])


def _thresholds(parts: list) -> list[np.ndarray]:
    """Split candidates of every feature: midpoints of its values if few, else of quantiles."""
    out = []
    for f in range(len(parts[0]["points"])):
        values = [np.frombuffer(p["points"][f]) for p in parts]
        own = np.unique(np.concatenate(values))
        if len(own) > MAX_BINS or not all(p["few"][f] for p in parts):
            weight = np.concatenate([np.full(len(v), p["n"] / max(len(v), 1)) for v, p in zip(values, parts)])
            every = np.concatenate(values)
            order = np.argsort(every, kind="stable")
            total = np.cumsum(weight[order])
            own = np.unique(every[order][np.minimum(np.searchsorted(total, total[-1] * np.linspace(0, 1, MAX_BINS)), len(every) - 1)])
        out.append((own[1:] + own[:-1]) / 2 if len(own) > 1 else np.empty(0))
    return out


def _codes(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """Number of thresholds below each value: ``x <= thresholds[c]`` is ``code <= c``."""
    return np.stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds)], axis=1).astype(np.uint8)


def _ordered(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order of the rows by what they hold."""
    h = y.astype(U64)
    with np.errstate(over="ignore"):
        for f in range(codes.shape[1]):
            h = mix(h * U64(31) + codes[:, f].astype(U64) + U64(1))
    return np.argsort(h, kind="stable")


def grow(codes: np.ndarray, y: np.ndarray, weights: np.ndarray, trees: list[int], max_depth: int, drawn: int, seed: int) -> list[tuple]:
    """Trees as ``(tree, feature, code, left, counts)``: a node with feature -1 is a leaf; else rows
    with a code up to the node's go to node ``left``, others to ``left + 1``."""
    n, k, width = len(codes), len(weights), codes.shape[1]
    times = [np.minimum(np.random.default_rng([seed, t]).poisson(1.0, n), 255).astype(np.uint8) for t in trees]
    row = np.concatenate([np.flatnonzero(c) for c in times])
    node = np.repeat(np.arange(len(trees)), [np.count_nonzero(c) for c in times])
    cnt = np.concatenate([c[c > 0] for c in times]).astype(U64)
    low = (y[row].astype(U64) << U64(8)) | cnt
    with np.errstate(over="ignore"):
        name = mix(mix(np.full(len(trees), seed & (2 ** 64 - 1), U64)) + np.array(trees, U64) * U64(0x9E3779B97F4A7C15))
    tree, levels, base = np.arange(len(trees)), [], 0
    lane = mix(np.arange(1, width + 1, dtype=U64))
    for depth in range(max_depth + 1):
        active = len(tree)
        counts = np.bincount(node * k + (low >> U64(8)).astype(np.int64), weights=(low & U64(255)).astype(float), minlength=active * k).reshape(active, k).astype(np.int64)
        feature, code, left = np.full(active, -1, np.int16), np.zeros(active, np.uint8), np.full(active, -1, np.int64)
        levels.append((tree, feature, code, left, counts))
        mixed = np.flatnonzero((counts > 0).sum(axis=1) > 1) if depth < max_depth else []
        if not len(mixed):
            break
        small = np.full(active, -1)
        small[mixed] = np.arange(len(mixed))
        stay = small[node] >= 0
        row, node, low = row[stay], small[node[stay]], low[stay]
        c = counts[mixed]
        before = np.concatenate([np.zeros((1, k), np.int64), np.cumsum(c, axis=0)[:-1]])
        wc = c * weights
        parent = (wc ** 2).sum(axis=1) / wc.sum(axis=1)
        with np.errstate(over="ignore"):
            draw = mix(name[mixed][:, None] ^ lane[None])
        feats = np.argpartition(draw, drawn - 1, axis=1)[:, :drawn] if drawn < width else np.tile(np.arange(width), (len(mixed), 1))
        feats.sort(axis=1)
        best, best_f, best_c = np.full(len(mixed), -np.inf), np.zeros(len(mixed), np.int16), np.zeros(len(mixed), np.uint8)
        fixed = (node.astype(U64) << U64(24)) | low
        for j in range(drawn):
            packed = fixed | (codes[row, feats[node, j]].astype(U64) << U64(16))
            packed.sort()
            key = packed >> U64(16)
            p = np.flatnonzero((key[1:] != key[:-1]) & ((key[1:] >> U64(8)) == (key[:-1] >> U64(8))))
            if not len(p):
                continue
            at = (key[p] >> U64(8)).astype(np.int64)
            label, times = (packed >> U64(8)) & U64(255), (packed & U64(255)).astype(np.int64)
            sl = sr = ql = qr = 0.0
            for cls in range(k):
                less = np.cumsum(np.where(label == U64(cls), times, 0))[p] - before[at, cls]
                a, b = less * weights[cls], (c[at, cls] - less) * weights[cls]
                sl, sr, ql, qr = sl + a, sr + b, ql + a * a, qr + b * b
            score = ql / sl + qr / sr
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            top = np.maximum.reduceat(score, first)
            hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(at)))))
            hit = hit[np.concatenate([[True], at[hit][1:] != at[hit][:-1]])]
            own = at[hit]
            better = top > best[own]
            own, hit = own[better], hit[better]
            best[own], best_f[own], best_c[own] = score[hit], feats[own, j], (key[p[hit]] & U64(255)).astype(np.uint8)
        cut = np.flatnonzero(best > parent * (1 + 1e-12))
        if not len(cut):
            break
        base += active
        feature[mixed[cut]], code[mixed[cut]], left[mixed[cut]] = best_f[cut], best_c[cut], base + 2 * np.arange(len(cut))
        rank = np.full(len(mixed), -1)
        rank[cut] = np.arange(len(cut))
        stay = rank[node] >= 0
        row, node, low = row[stay], node[stay], low[stay]
        node = 2 * rank[node] + (codes[row, best_f[node]] > best_c[node])
        tree = np.repeat(tree[mixed[cut]], 2)
        with np.errstate(over="ignore"):
            name = mix(np.repeat(name[mixed[cut]], 2) * U64(2) + np.tile(np.array([1, 2], U64), len(cut)))
    tree, feature, code, left, counts = (np.concatenate([lv[i] for lv in levels]) for i in range(5))
    out = []
    for t, number in enumerate(trees):
        own = np.flatnonzero(tree == t)
        out.append((number, feature[own], code[own], np.where(left[own] >= 0, np.searchsorted(own, left[own]), -1).astype(np.int32), counts[own].astype(np.int32)))
    return out


def leaf_shares(codes: np.ndarray, feature: np.ndarray, code: np.ndarray, left: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Class shares of the leaf of every row."""
    at, todo = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while True:
        todo = todo[feature[at[todo]] >= 0]
        if not len(todo):
            return share[at]
        k = at[todo]
        at[todo] = left[k] + (codes[todo, feature[k]] > code[k])


def _tree_arrays(tree: dict, weights: np.ndarray) -> tuple:
    counts = np.frombuffer(tree["counts"], np.int32).reshape(-1, len(weights))
    return np.frombuffer(tree["feature"], np.int16), np.frombuffer(tree["code"], np.uint8), np.frombuffer(tree["left"], np.int32), counts * weights


class Forest:
    """A fitted forest: ``trees`` is the written table of its trees, ``groups`` deals them to tasks."""

    def __init__(self, trees: DataFrame, thresholds: list[np.ndarray], weights: np.ndarray, num_trees: int, groups: int, features_col: str):
        self.trees, self.thresholds, self.weights = trees, thresholds, weights
        self.num_trees, self.groups, self.features_col = num_trees, groups, features_col

    def getCacheNodeIds(self) -> bool:
        """Every row's node is kept while a tree grows."""
        return True

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction``, ``probability`` and ``prediction``, as a pyspark.ml forest gives them."""
        from revlens.llm.common import free_name
        row, k, groups, thresholds, weights = free_name(df, "_row"), len(self.weights), self.groups, self.thresholds, self.weights
        rows = materialize(df.withColumn(row, F.monotonically_increasing_id()))
        x = rows.select(F.col(row).alias("id"), vector_to_array(self.features_col).alias("x"))
        parts = max(1, -(-rows.count() // SCORE_ROWS))

        def deal(batches):
            first = TaskContext.get().partitionId()
            for at, batch in enumerate(batches):
                if batch.num_rows:
                    own = np.ascontiguousarray(batch.column(0).to_numpy()).tobytes()
                    codes = _codes(_matrix(batch.column(1)), thresholds).tobytes()
                    part = (first + at) % parts
                    yield pa.RecordBatch.from_arrays([pa.array(list(range(groups)), pa.int32()), pa.array([part] * groups, pa.int32()), pa.array([own] * groups, pa.binary()),
                                                      pa.array([codes] * groups, pa.binary())], names=["g", "part", "ids", "codes"])

        def score(trees: pa.Table, blocks: pa.Table) -> pa.Table:
            ids = np.frombuffer(b"".join(b.as_py() for b in blocks.column("ids")), np.int64)
            codes = np.frombuffer(b"".join(b.as_py() for b in blocks.column("codes")), np.uint8).reshape(len(ids), -1)
            total = np.zeros((len(ids), k), np.int64)
            for at in range(trees.num_rows if len(ids) else 0):
                *tree, counts = _tree_arrays({c: trees.column(c)[at].as_py() for c in ("feature", "code", "left", "counts")}, weights)
                total += leaf_shares(codes, *tree, np.rint(counts / counts.sum(axis=1, keepdims=True) * UNIT).astype(np.int64))
            return pa.table({"id": pa.array(ids), **{f"c{c}": pa.array(total[:, c]) for c in range(k)}})

        dealt = x.mapInArrow(deal, "g int, part int, ids binary, codes binary")
        trees = self.trees.withColumn("g", F.pmod("tree", F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = trees.groupBy("g", "part").cogroup(dealt.groupBy("g", "part")).applyInArrow(score, "id long, " + ", ".join(f"c{c} long" for c in range(k)))
        found = found.groupBy("id").agg(*[(F.sum(f"c{c}") / F.lit(UNIT)).alias(f"c{c}") for c in range(k)])
        raw = F.array(*[F.col(f"c{c}") for c in range(k)])
        found = found.select(F.col("id").alias(row), array_to_vector(raw).alias("rawPrediction"), array_to_vector(F.transform(raw, lambda v: v / self.num_trees)).alias("probability"),
                             (F.array_position(raw, F.array_max(raw)) - 1).cast("double").alias("prediction"))
        return rows.join(found, row, "left").drop(row)

    def nodes(self) -> DataFrame:
        """(tree, id, stats, left, right, feature, threshold), a row a node."""
        thresholds, weights = self.thresholds, self.weights

        def table(batches):
            for batch in batches:
                for tree in batch.to_pylist():
                    feature, code, left, stats = _tree_arrays(tree, weights)
                    limit = [float(thresholds[f][c]) if f >= 0 else None for f, c in zip(feature, code)]
                    yield pa.RecordBatch.from_arrays([pa.array([tree["tree"]] * len(feature), pa.int32()), pa.array(range(len(feature)), pa.int32()), pa.array(list(stats), pa.list_(pa.float64())),
                                                      pa.array(left), pa.array(np.where(left >= 0, left + 1, -1).astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(limit, pa.float64())],
                                                     names=["tree", "id", "stats", "left", "right", "feature", "threshold"])

        return self.trees.mapInArrow(table, "tree int, id int, stats array<double>, left int, right int, feature int, threshold double")


def fit_forest(train: DataFrame, features_col: str, label_col: str, num_trees: int, max_depth: int, seed: int) -> Forest | None:
    """A forest with balanced class weights; None if pyspark.ml is to fit it: where depth or rows
    bound its nodes to ``MOST_NODES``, or the binned rows are more than a task holds."""
    if num_trees * 2 ** (max_depth + 1) <= MOST_NODES:
        return None
    spark = train.sparkSession
    rows = materialize(train.select(vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y")))
    parts = rows.mapInArrow(_summaries, "n long, labels binary, points array<binary>, few array<boolean>").collect()
    if not parts:
        raise ValueError("no rows to fit a forest on")
    n, width = sum(p["n"] for p in parts), len(parts[0]["points"])
    if num_trees * 2 * n <= MOST_NODES or n * (width + 1) > TASK_BYTES:
        return None
    labels = sum(np.frombuffer(p["labels"], np.int64) for p in parts)
    k, seen = max(2, int(np.flatnonzero(labels)[-1]) + 1), np.count_nonzero(labels)
    weights = np.array([n / (seen * c) if c else 0.0 for c in labels[:k]])
    thresholds = _thresholds(parts)
    groups = min(num_trees, max(24, 2 * spark.sparkContext.defaultParallelism))
    drawn = max(1, math.ceil(math.sqrt(width)))

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                codes, y = _codes(_matrix(batch.column(0)), thresholds).tobytes(), batch.column(1).to_numpy().astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(range(groups)), pa.int32()), pa.array([codes] * groups, pa.binary()), pa.array([y] * groups, pa.binary())], names=["g", "codes", "y"])

    def fit(table: pa.Table) -> pa.Table:
        y = np.frombuffer(b"".join(b.as_py() for b in table.column("y")), np.uint8)
        codes = np.frombuffer(b"".join(b.as_py() for b in table.column("codes")), np.uint8).reshape(len(y), width)
        order = _ordered(codes, y)
        codes, y = codes[order], y[order]
        own = list(range(table.column("g")[0].as_py(), num_trees, groups))
        step, out = max(1, GROW_ROWS // len(y)), []
        for at in range(0, len(own), step):
            out += [(t, *(a.tobytes() for a in arrays)) for t, *arrays in grow(codes, y, weights, own[at:at + step], max_depth, drawn, seed)]
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], names=["tree", "feature", "code", "left", "counts"])

    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    dealt = rows.mapInArrow(deal, "g int, codes binary, y binary").repartition(groups, "g")
    dealt.groupBy("g").applyInArrow(fit, _TREE).write.parquet(path)
    return Forest(spark.read.schema(_TREE).parquet(path), thresholds, weights, num_trees, groups, features_col)
