"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < 2 < 3 are predicted from sparse word features:
``P(grade > k) = sigmoid(w.x - b_k)`` with one weight vector for all ordered thresholds
``b_0 <= b_1 <= b_2``.  The answer is the expected severity, the sum of those three
probabilities.

The labels tell only toxic or not, so the grades of toxic training texts are the thirds of
how densely words typical of toxic texts occur in them; grade 0 is "not toxic".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import cut, released, text_batches

TRAIN_ROWS = 12_000      # documented bound: labelled texts sampled for fitting
FEATURES = 768           # words and word beginnings kept as features
BEGINNINGS = (4, 5)      # letters of a beginning; inflected and compound forms share it
CLEAN_WEIGHT = 5.0       # a clean document lost weighs as much as so many shares of toxic ones kept
GRADES = 4
KEPT_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    reject: float = 0.5       # P(grade > 0) from which a document is rejected
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def look_up(self, word: str) -> tuple[int, ...]:
        """Features of a word: itself and its beginnings; kept for the words met so far."""
        if len(self.seen) >= KEPT_WORDS:
            self.seen.clear()
        found = tuple(k for t in (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)) if (k := self.words.get(t)) is not None)
        self.seen[word] = found
        return found

    def more(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))

    def features(self, text: str | None) -> dict[int, int]:
        """Feature -> how often it occurs in the whole text."""
        out: dict[int, int] = {}
        get = self.seen.get
        for w in _WORD.findall(text.lower()) if text else ():
            if (ks := get(w)) is None:
                ks = self.look_up(w)
            for k in ks:
                out[k] = out.get(k, 0) + 1
        return out

    def score(self, text: str | None) -> float:
        return sum(self.weights[k] * np.log1p(n) for k, n in self.features(text).items())


def _longer(n: int):
    return lambda w: F.length(w) > n


def _beginning(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def _word_rows(rows: DataFrame) -> DataFrame:
    """``(doc_id, toxic, w, n)``: the words of each text with their counts, by SQL."""
    words = F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}]+"), lambda w: w != "")
    begin = [F.transform(F.filter(words, _longer(n)), _beginning(n)) for n in BEGINNINGS]
    words = F.concat(words, *begin)
    return rows.select("doc_id", "toxic", F.explode(words).alias("w")).groupBy("doc_id", "toxic", "w").agg(F.count("*").alias("n"))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most ``train_rows`` labelled texts, picked by a hash of their id.

    Words are counted in Spark; only the chosen features of the sampled texts reach the
    driver.  Rows without id, text or label are left out.  Without both classes the model
    rejects nothing.
    """
    picked = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(int(train_rows)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("doc_id IS NOT NULL AND text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    return _fit(cut(_word_rows(rows), "toxic-words"), features)


def _fit(counted: DataFrame, features: int) -> Model:
    none = Model({}, np.zeros(0), np.full(GRADES - 1, 40.0))
    totals = {r["toxic"]: r["n"] for r in counted.select("doc_id", "toxic").distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), sum(v for k, v in totals.items() if k != 1)
    if not pos or not neg:
        return none
    # words whose document share differs most between the classes, by chi-squared
    by_word = counted.groupBy("w").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("a"), F.count("*").alias("d"))
    by_word = cut(by_word.where("d >= 3"), "toxic-by-word")
    # a tie to the label counts if it is not to be expected by chance among so many words
    least = 2 * np.log(max(2, by_word.count()))
    a, b = F.col("a").cast("double"), (F.col("d") - F.col("a")).cast("double")
    n = float(pos + neg)
    chi = n * F.pow(a * (neg - b) - b * (pos - a), 2) / ((a + b) * (n - a - b + 1e-9) * pos * neg)
    chosen = (by_word.withColumn("chi", chi).where(F.col("chi") >= float(least)).orderBy(F.desc("chi"), "w").limit(features)
              .select("w", "a", "d").collect())
    words = {r["w"]: k for k, r in enumerate(chosen)}
    if not words:
        return none
    lift = np.array([np.log((r["a"] + 0.5) / (pos + 1)) - np.log((r["d"] - r["a"] + 0.5) / (neg + 1)) for r in chosen])
    table = counted.sparkSession.createDataFrame(list(words.items()), "w string, k int")
    cells = counted.join(F.broadcast(table), "w").select("doc_id", "toxic", "k", "n").collect()
    index: dict[int, int] = {}
    y: list[int] = []
    r, c, v = [], [], []
    for x in cells:
        if x["doc_id"] not in index:
            index[x["doc_id"]] = len(y)
            y.append(int(x["toxic"] == 1))
        r.append(index[x["doc_id"]])
        c.append(x["k"])
        v.append(x["n"])
    toxic = np.array(y + [0] * (neg - y.count(0)) + [1] * (pos - y.count(1)))    # texts without a feature too
    r, c, v = np.array(r), np.array(c), np.log1p(np.array(v, float))
    # grades of toxic texts: thirds of the typical words they hold
    typical = np.bincount(r, weights=np.where(lift[c] > 1, v * lift[c], 0), minlength=len(toxic))
    grade = np.zeros(len(toxic), int)
    held = typical[toxic == 1]
    grade[toxic == 1] = 1 + np.digitize(held, np.quantile(held, [1 / 3, 2 / 3]))
    model = Model(words, *_descend(r, c, v, np.minimum(grade, GRADES - 1), len(words)))
    p = model.more(np.bincount(r, weights=v * model.weights[c], minlength=len(toxic)))[:, 0]
    model.reject = _threshold(p[toxic == 1], p[toxic != 1])
    return model


def _threshold(toxic: np.ndarray, clean: np.ndarray) -> float:
    """Where the share of toxic training texts caught, less the weighted share of clean ones
    lost, is largest; in the middle of the gap there."""
    at = np.unique(np.concatenate([toxic, clean, [1.0]]))
    caught = 1 - np.searchsorted(np.sort(toxic), at, side="left") / len(toxic)
    lost = 1 - np.searchsorted(np.sort(clean), at, side="left") / len(clean)
    best = int(np.argmax(caught - CLEAN_WEIGHT * lost))
    return float((at[best] + at[best - 1]) / 2) if best else float(at[0])


def _descend(r, c, v, grade, k, rounds: int = 400, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by full-batch Adam on the cumulative-link likelihood; cuts
    are a first value plus exponentials, so they stay ordered."""
    n = len(grade)
    levels = GRADES - 1
    start = [np.log(((grade <= j).sum() + 1) / ((grade > j).sum() + 1)) for j in range(levels)]
    p = np.concatenate([np.zeros(k), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        w, steps = p[:k], np.exp(p[k + 1:])
        cuts = p[k] + np.concatenate([[0.0], np.cumsum(steps)])
        s = np.bincount(r, weights=v * w[c], minlength=n)
        more = sig(s[:, None] - cuts[None, :])                               # P(grade > j)
        upper = np.concatenate([np.ones((n, 1)), more, np.zeros((n, 1))], axis=1)
        prob = np.maximum(upper[rows, grade] - upper[rows, grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), more * (1 - more), np.zeros((n, 1))], axis=1)
        g_s = -(slope[rows, grade] - slope[rows, grade + 1]) / prob / n
        g_cut = np.zeros(levels)
        for j in range(levels):
            at = slope[:, j + 1] / prob / n
            g_cut[j] = at[grade == j + 1].sum() - at[grade == j].sum()
        grad = np.concatenate([np.bincount(c, weights=g_s[r] * v, minlength=k) + penalty * w / 10, [g_cut.sum()],
                               [g_cut[j + 1:].sum() * steps[j] for j in range(levels - 1)]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        p = p - 0.1 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-9)
    return p[:k], p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1:]))])


def predict(df: DataFrame, model: Model, text_col: str = "text", reject: float | None = None) -> Column:
    """Column ``struct(severity, p_toxic, grade, rejected)`` for the whole text.

    severity is the expected grade (0..3), p_toxic = P(grade > 0), grade the most probable
    one (ties to the lower), rejected: p_toxic >= ``reject`` (the
    model's own threshold unless given).  A null, empty or wordless text has
    the features of none and is judged by the cuts alone.
    """
    text_batches(df)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    bar = model.reject if reject is None else reject

    @F.arrow_udf("severity double, p_toxic double, grade int, rejected boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        for texts in released(batches):
            more = m.more(np.array([m.score(t.as_py()) for t in texts], float))
            prob = -np.diff(np.concatenate([np.ones((len(more), 1)), more, np.zeros((len(more), 1))], axis=1), axis=1)
            columns = {"severity": more.sum(axis=1), "p_toxic": more[:, 0], "grade": prob.argmax(axis=1).astype(np.int32), "rejected": more[:, 0] >= bar}
            yield pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
        m.seen.clear()

    return run(F.col(text_col).cast("string"))
