"""Path-dependent Shapley values of fitted forests (X3, Lundberg et al. 2018).

A tree is the sum of its leaves: a leaf gives its value when every feature on its path
decides for it.  With some features unknown, a split on an unknown feature is followed on
both sides in the shares of the training rows.  For one leaf and one row, with ``o`` 1 where
the row's feature stays on the path (else 0) and ``z`` the share that would, the game is

    v(S) = value * product over S of o * product over the others of z,

and the Shapley value of feature j is ``value * (o_j - z_j)`` times the integral over t in
[0, 1] of the product over i != j of ``z_i (1 - t) + o_i t``.  The integrand is a polynomial
of at most the path's length, so a short Gauss-Legendre rule integrates it exactly: the work
is polynomial in depth, without an enumeration of feature sets.

Node table -> one row per leaf (``leaf_paths``, each tree in a task of its own) -> rows against
blocks of leaves, in numpy inside tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.forest import Forest
from revlens.session import materialize, scratch_path

BLOCK_SPLITS = 2_000_000     # features on the paths of a block of leaves (32 bytes each)
_LEAVES = "tree int, leaf int, value double, weight double, feature array<int>, share array<double>, low array<double>, high array<double>"


def node_table(model, spark) -> DataFrame:
    """(tree, id, stats, left, right, feature, threshold) of a fitted forest or tree."""
    if isinstance(model, Forest):
        return model.nodes()
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "treeID" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.select(F.lit(0).alias("tree"), "*")
    nodes = saved.select("tree", "id", F.col("impurityStats").alias("stats"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                         F.col("split.featureIndex").alias("feature"), F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
                         F.col("split.numCategories").alias("categories"))
    if nodes.where(F.col("categories") >= 0).count():
        raise ValueError("splits on categorical features are not supported")
    return nodes


def leaf_paths(nodes: DataFrame, class_index: int = 1) -> DataFrame:
    """One row per leaf: the class share as value, and for each feature on its path the
    interval ``(low, high]`` that stays on it and the share of training rows that did."""

    def paths(tree: pd.DataFrame) -> pd.DataFrame:
        rows = {r.id: r for r in tree.itertuples()}
        cover = {k: float(np.sum(r.stats)) for k, r in rows.items()}
        out, todo = [], [(0, {}, 1.0)]
        while todo:
            k, path, weight = todo.pop()
            r = rows[k]
            if r.left < 0:
                total = cover[k]
                out.append((int(r.tree), k, float(r.stats[class_index]) / total if total else 0.0, weight, list(path),
                            [v[0] for v in path.values()], [v[1] for v in path.values()], [v[2] for v in path.values()]))
                continue
            for child, goes_left in ((r.left, True), (r.right, False)):
                share = cover[child] / cover[k]
                z, low, high = path.get(r.feature, (1.0, -np.inf, np.inf))
                bounds = (z * share, low, min(high, r.threshold)) if goes_left else (z * share, max(low, r.threshold), high)
                todo.append((child, path | {int(r.feature): bounds}, weight * share))
        return pd.DataFrame(out, columns=["tree", "leaf", "value", "weight", "feature", "share", "low", "high"])

    return nodes.groupBy("tree").applyInPandas(paths, _LEAVES)


class Leaves:
    """Leaves grouped by the number of features on their paths."""

    def __init__(self, rows: list):
        self.groups = {}
        by = {}
        for r in rows:
            by.setdefault(len(r["feature"]), []).append(r)
        for d, own in by.items():
            if d:
                self.groups[d] = (np.array([r["value"] for r in own]), *(np.array([r[c] for r in own]) for c in ("feature", "share", "low", "high")))

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): sums over the leaves."""
        out = np.zeros(x.shape)
        for d, (value, feature, share, low, high) in self.groups.items():
            t, w = np.polynomial.legendre.leggauss(d // 2 + 1)
            t, w = (t + 1) / 2, w / 2
            step = max(1, 500_000 // (d * max(1, len(x))))
            for at in range(0, len(value), step):
                s = slice(at, at + step)
                own = x[:, feature[s]]                                        # rows, leaves, path
                o = ((own > low[s]) & (own <= high[s])).astype(float)
                z = share[s][None]
                total = np.zeros(o.shape)
                for tq, wq in zip(t, w):
                    term = z * (1 - tq) + o * tq
                    total += wq * term.prod(-1, keepdims=True) / term
                total *= value[s][None, :, None] * (o - z)
                for j in range(d):
                    hot = np.zeros((total.shape[1], x.shape[1]))
                    hot[np.arange(len(hot)), feature[s][:, j]] = 1
                    out += total[:, :, j] @ hot
        return out


def forest_shap(model, df: DataFrame, id_col: str, features_col: str = "features", class_index: int = 1, names: list[str] | None = None) -> tuple[DataFrame, float]:
    """X3 for a fitted forest (``models.random_forest``, or a ``pyspark.ml`` forest or tree classifier): ``(id, feature, shapley)`` and
    the base value, so that base + the values of a row is the probability of class
    ``class_index``.  Features are named by ``names``, else by their index.

    One row per id is expected; a row with a null vector gives no values."""
    spark = df.sparkSession
    leaves = materialize(leaf_paths(node_table(model, spark), class_index))
    trees = [(r["tree"], r["n"]) for r in leaves.groupBy("tree").agg(F.sum(F.size("feature")).alias("n")).orderBy("tree").collect()]
    base = leaves.agg(F.sum(F.col("value") * F.col("weight"))).first()[0] / len(trees)
    blocks, size = [[]], 0
    for tree, n in trees:
        if blocks[-1] and size + n > BLOCK_SPLITS:
            blocks.append([])
            size = 0
        blocks[-1].append(tree)
        size += n
    rows = df.select(F.col(id_col), vector_to_array(features_col).alias("x")).where(F.col("x").isNotNull())
    id_type = rows.schema[id_col].dataType.simpleString()
    found = None
    for block in blocks:
        held = spark.sparkContext.broadcast(Leaves(leaves.where(F.col("tree").isin(block)).collect()))

        def work(batches, held=held):
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    some = pdf.iloc[at:at + 256]
                    got = held.value.values(np.stack(some["x"].to_numpy())) / len(trees)
                    yield pd.DataFrame({id_col: some[id_col].to_numpy(), "v": list(got)})

        part = rows.mapInPandas(work, f"`{id_col}` {id_type}, v array<double>").select(id_col, F.posexplode("v").alias("j", "shapley"))
        found = part if found is None else found.unionAll(part)
    if len(blocks) > 1:
        found = found.groupBy(id_col, "j").agg(F.sum("shapley").alias("shapley"))
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1) if names else F.col("j").cast("string")
    return found.select(id_col, feature.alias("feature"), "shapley"), float(base)
