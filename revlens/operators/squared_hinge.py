"""ML4: linear support vector machine with squared hinge loss.

Minimises ``|w|^2 / 2 + C sum max(0, 1 - y (w x + b))^2`` in the primal; the intercept is
one more weight, of a constant feature, and is regularised with the others.  Newton steps
are solved by conjugate gradients from Hessian-vector products; the step length is found
among halvings whose objectives come out of one pass.

Every pass is one Spark job over kept blocks of sparse rows, numbers as bytes that go to the
task as they are: a task adds up its blocks into one vector of the number of features, and the
vectors are added in a tree.  A pass has as many tasks as there are cores, more only for more
than ``TASK_BYTES`` a task, so that the vectors sent do not grow with the splits of the input.
The driver holds a few vectors of that size (bounded by ``max_features``), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALVINGS = 20
BLOCKS = "counts binary, places binary, vals binary, y binary"     # int32, int32, double, double
BLOCK_ENTRIES = 200_000     # entries of a block, unless one row has more
TASK_BYTES = 64 << 20       # bytes of blocks that a task reads in a pass


def sparse_rows(df: DataFrame, features_col: str, label_col: str) -> DataFrame:
    """Blocks of rows (``BLOCKS``): the entries of each row, their places and values one after
    the other, and y = 1 for label 1, else -1; rows without a label or without features take no
    part.  Not-a-number and zero entries count as zero."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            places, vals, counts = _entries(b.column(0))
            y = b.column(1).to_numpy()
            ends = np.cumsum(counts)
            cuts = np.flatnonzero(np.diff(np.maximum(ends - 1, 0) // BLOCK_ENTRIES)) + 1
            out: list[list[bytes]] = [[], [], [], []]
            for lo, hi in zip([0, *cuts], [*cuts, len(counts)]):
                at = slice(ends[lo] - counts[lo], ends[hi - 1])
                for held, x in zip(out, (counts[lo:hi].astype(np.int32), places[at].astype(np.int32), vals[at], y[lo:hi])):
                    held.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["counts", "places", "vals", "y"])
    y = F.when(F.col(label_col) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    kept = df.where(F.col(label_col).isNotNull() & F.col(features_col).isNotNull()).select(F.col(features_col).alias("x"), y.alias("y"))
    return kept.mapInArrow(pack, BLOCKS)


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of the non-zero entries of dense (type 1) and sparse vectors, one after
    the other, and their number in each vector."""
    values = vectors.field("values")
    n = values.value_lengths().to_numpy()
    vals = np.nan_to_num(values.flatten().to_numpy())
    dense = np.repeat(vectors.field("type").to_numpy() == 1, n)
    places = np.arange(len(vals)) - np.repeat(np.cumsum(n) - n, n)
    places[~dense] = vectors.field("indices").flatten().to_numpy()
    row, keep = np.repeat(np.arange(len(n)), n), vals != 0
    return places[keep], vals[keep], np.bincount(row[keep], minlength=len(n))


class _Passes:
    """Sums over the rows as Spark jobs; ``rows`` must be cheap to read again and again."""

    def __init__(self, rows: RDD, n_features: int, c: float):
        self.rows, self.d, self.c, self.jobs = rows, n_features, c, 0

    def _sum(self, add, n_losses: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """``add(x, y, total, losses)`` per batch; ``x(w)`` gives the scores of a weight vector and
        ``x.back(coef, total)`` adds the rows times ``coef``."""
        d = self.d

        class Batch:
            def __init__(self, counts: np.ndarray, places: np.ndarray, vals: np.ndarray):
                self.counts, self.val, self.at = counts, vals, places.astype(np.intp)
                self.some = np.flatnonzero(counts)
                self.starts = (np.cumsum(counts, dtype=np.intp) - counts)[self.some]

            def __call__(self, w: np.ndarray) -> np.ndarray:
                scores = np.zeros(len(self.counts))
                if len(self.some):
                    scores[self.some] = np.add.reduceat(self.val * w[self.at], self.starts)
                return scores + w[d]

            def back(self, coef: np.ndarray, total: np.ndarray) -> None:
                total[:d] += np.bincount(self.at, self.val * np.repeat(coef, self.counts), d)
                total[d] += coef.sum()

        def task(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            total, losses = np.zeros(d + 1), np.zeros(n_losses)
            for block in blocks:
                counts, places, vals, y = (np.frombuffer(x, t) for x, t in zip(block, (np.int32, np.int32, float, float)))
                add(Batch(counts, places, vals), y, total, losses)
            yield np.concatenate([total, losses])

        self.jobs += 1
        got = self.rows.mapPartitions(task).treeAggregate(np.zeros(d + 1 + n_losses), np.add, np.add)
        return got[:d + 1], got[d + 1:]

    def gradient(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        c = self.c

        def add(x, y, total, losses):
            short = np.maximum(0.0, 1.0 - y * x(w))
            losses[0] += c * (short * short).sum()
            x.back(-2.0 * c * y * short, total)
        total, losses = self._sum(add, 1)
        return 0.5 * float(w @ w) + float(losses[0]), w + total

    def curvature(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        c = self.c

        def add(x, y, total, losses):
            x.back(2.0 * c * np.where(y * x(w) < 1.0, x(v), 0.0), total)
        return v + self._sum(add)[0]

    def along(self, w: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        c = self.c

        def add(x, y, total, losses):
            at, by = y * x(w), y * x(step)
            for k, t in enumerate(lengths):
                losses[k] += c * (np.maximum(0.0, 1.0 - at - t * by) ** 2).sum()
        points = w[None, :] + lengths[:, None] * step[None, :]
        return 0.5 * (points * points).sum(axis=1) + self._sum(add, len(lengths))[1]


def minimise(rows: DataFrame, n_features: int, c: float = 1.0, tol: float = 1e-4, most_steps: int = 50, most_products: int = 30) -> tuple[np.ndarray, float]:
    """Weights (the intercept last) and the objective reached; ``rows`` are blocks.  Ends when the gradient has
    shrunk to ``tol`` of that at zero, or when no halving of a step lowers the objective.
    Without rows all weights are zero."""
    held = rows.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        return _newton(_Passes(held, n_features, c), n_features, tol, most_steps, most_products)
    finally:
        held.unpersist()


def _newton(p: _Passes, n_features: int, tol: float, most_steps: int, most_products: int) -> tuple[np.ndarray, float]:
    w = np.zeros(n_features + 1)
    value, g = p.gradient(w)
    first = np.linalg.norm(g)
    lengths = 0.5 ** np.arange(HALVINGS)
    for _ in range(most_steps):
        size = np.linalg.norm(g)
        if size <= tol * first:
            break
        step, r = np.zeros_like(w), -g
        q, rr = r.copy(), float(r @ r)
        for _ in range(most_products):
            hq = p.curvature(w, q)
            a = rr / float(q @ hq)           # the curvature is 1 at least
            step, r = step + a * q, r - a * hq
            new = float(r @ r)
            if np.sqrt(new) <= min(0.1, np.sqrt(size / first)) * size:
                break
            q, rr = r + new / rr * q, new
        values = p.along(w, step, lengths)
        slope = float(g @ step)
        good = np.flatnonzero(values <= value + 1e-4 * lengths * slope)
        if not len(good):
            break
        w = w + lengths[good[0]] * step
        value, g = p.gradient(w)
    return w, value


def squared_hinge_svm(train: DataFrame, features_col: str, label_col: str, c: float = 1.0, tol: float = 1e-4) -> LinearSVCModel:
    """A fitted ``LinearSVCModel`` for labels 0 and 1 (any other label counts as 0).

    Empty input gives weights of no features and an intercept of zero."""
    from revlens.session import materialize
    first = train.where(F.col(features_col).isNotNull()).select(features_col).first()
    d = first[0].size if first else 0
    sc = train.sparkSession.sparkContext
    blocks = materialize(sparse_rows(train, features_col, label_col))
    size = blocks.agg(F.sum(F.length("places") + F.length("vals"))).first()[0] or 0
    w, _ = minimise(blocks.coalesce(max(sc.defaultParallelism, -(-size // TASK_BYTES))), d, c, tol)
    model = LinearSVCModel(sc._jvm.org.apache.spark.ml.classification.LinearSVCModel("squaredHinge", _py2java(sc, Vectors.dense(w[:d])), float(w[d])))
    return model.setFeaturesCol(features_col)
