"""Explanations.

X3 re-aims tree/deep SHAP as model-agnostic sampled Shapley values
(Strumbelj & Kononenko 2014): every row is expanded into permutations x
background rows x d steps inside its own task (the background is a bounded sample
entering as a scalar array).  A step holds the point before and after its feature
joins, so the marginal contribution is a difference on one row; only partial
averages per (row, feature) are shuffled.

X5(a) re-aims LIME for tables of texts as leave-one-word-out: for every
distinct word of a text the text is rescored without that word (all
occurrences, as LIME's bag-of-words masking does); the top words by |change|
are reported.  X5(b) is LIME proper: random word masks, one scoring pass,
a weighted ridge per text.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from revlens.functions import text as T
from revlens.operators.lexicon import MAX_BROADCAST_LEXICON_ROWS
from revlens.sources.lexicons import BOOSTER_DAMPING, COMPOUND_ALPHA, NEGATION_SCALAR


def shapley_values(df: DataFrame, id_col: str, feature_cols: Sequence[str], score: Callable[[dict], Column],
                   background: DataFrame, n_perm: int = 8, seed: int = 42) -> DataFrame:
    """(id, feature, shapley).  ``score`` maps {feature: Column} to the model
    output Column (e.g. a linear scorer, or the probability of a fitted model
    expressed as columns); ``background`` must be a bounded sample."""
    d = len(feature_cols)
    bg = background.agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in feature_cols]))
                        .alias("b")).select("b").scalar()
    base = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in feature_cols], bg.alias("_bg"))
    ex = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("_perm"))
    ex = ex.select("*", F.posexplode("_bg").alias("_bi", "_b")).drop("_bg")
    # random order of features per (row, permutation): rank of a hash key
    keys = [F.xxhash64(F.col(id_col), F.col("_perm"), F.lit(j), F.lit(seed)) for j in range(d)]
    ranks = [sum((F.when(keys[i] < keys[j], 1).when((keys[i] == keys[j]) & (F.lit(i) < F.lit(j)), 1).otherwise(0)
                  for i in range(d)), F.lit(0)) for j in range(d)]
    ex = ex.select("*", *[r.alias(f"_r{j}") for j, r in enumerate(ranks)])
    ex = ex.select("*", F.explode(F.sequence(F.lit(1), F.lit(d))).alias("_k"))

    def point(joined: Column) -> dict:
        return {c: F.when(F.col(f"_r{j}") < joined, F.col(c)).otherwise(F.col("_b")[c]) for j, c in enumerate(feature_cols)}

    # the feature added at step k is the one with rank k - 1
    added = sum((F.when(F.col(f"_r{j}") == F.col("_k") - 1, F.lit(j)).otherwise(0) for j in range(d)), F.lit(0))
    contrib = ex.select(id_col, added.alias("_j"), (score(point(F.col("_k"))) - score(point(F.col("_k") - 1))).alias("_c"))
    names = F.array(*[F.lit(c) for c in feature_cols])
    return contrib.groupBy(id_col, "_j").agg(F.avg("_c").alias("shapley")).select(
        id_col, F.element_at(names, F.col("_j") + 1).alias("feature"), "shapley")


def global_importance(values: DataFrame) -> DataFrame:
    """Mean |Shapley value| per feature."""
    return values.groupBy("feature").agg(F.avg(F.abs("shapley")).alias("importance"))


def compound_changes(tokens: list[str], valence: dict[str, float], negation: frozenset, booster: dict[str, float]) -> dict[str, float]:
    """How the compound changes when all occurrences of a word are taken out.

    Only hits of the lexicon add to the sum, each with the three words before it: taking out a
    word drops its own hits and gives the hits just after it other words before them.  So the
    sum is worked out once and every word changes it by what it touches."""
    def value(v: float, before: list[str]) -> float:
        v += math.copysign(1.0, v) * sum(booster.get(w, 0.0) * d for w, d in zip(before, BOOSTER_DAMPING)) if v else 0.0
        return v * NEGATION_SCALAR if any(w in negation for w in before) else v

    def compound(s: float) -> float:
        return s / math.sqrt(s * s + COMPOUND_ALPHA)

    total, change = 0.0, dict.fromkeys(tokens, 0.0)
    for i, word in enumerate(tokens):
        v = valence.get(word)
        if v is None:
            continue
        before = tokens[max(0, i - 3):i][::-1]
        own = value(v, before)
        total += own
        change[word] -= own
        for gone in set(before) - {word}:
            left, k = [], i - 1
            while k >= 0 and len(left) < 3:
                if tokens[k] != gone:
                    left.append(tokens[k])
                k -= 1
            change[gone] += value(v, left) - own
    base = compound(total)
    return {w: compound(total + c) - base if c else 0.0 for w, c in change.items()}


def leave_one_word_out(df: DataFrame, id_col: str, text_col: str, scorer, top: int = 10) -> DataFrame:
    """X5(a): (id, word, delta, rank): compound(text without word) - compound(text),
    top ``top`` words per text by |delta| (rounded to 12 digits; ties by word).  Words are the
    scorer's lower-cased word tokens.

    With a lexicon that may be broadcast, each text is worked out in its own task, in a time
    that grows with its length (``compound_changes``); only the top words leave it.  With a
    larger one the perturbed texts are scored by ``scorer`` in one distributed pass."""
    lexicon = getattr(scorer, "lexicon", None)
    if lexicon is None or (scorer.lexicon_rows or lexicon.limit(MAX_BROADCAST_LEXICON_ROWS + 1).count()) > MAX_BROADCAST_LEXICON_ROWS:
        return _rescored(df, id_col, text_col, scorer, top)
    known = {r[0]: float(r[1]) for r in lexicon.select("token", "valence").collect() if r[1] is not None}
    held = df.sparkSession.sparkContext.broadcast((known, frozenset(scorer.negation), dict(scorer.booster)))
    rows = df.select(F.col(id_col), T.word_tokens(text_col).alias("_t"))
    schema = StructType([rows.schema[id_col], StructField("word", StringType()), StructField("delta", DoubleType()), StructField("rank", IntegerType())])

    def work(batches):
        for batch in batches:
            take, out = [], ([], [], [])
            for k, tokens in enumerate(batch.column(1).to_pylist()):
                changes = compound_changes(tokens or [], *held.value)
                best = heapq.nsmallest(top, changes.items(), key=lambda x: (-abs(round(x[1], 12)), x[0]))
                take.extend([k] * len(best))
                for rank, (word, delta) in enumerate(best, 1):
                    for held_in, x in zip(out, (word, delta, rank)):
                        held_in.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32())],
                                             names=[id_col, "word", "delta", "rank"])

    return rows.mapInArrow(work, schema)


def _rescored(df: DataFrame, id_col: str, text_col: str, scorer, top: int) -> DataFrame:
    toks = df.select(id_col, T.word_tokens(text_col).alias("_t"))
    words = toks.select(id_col, "_t", F.explode(F.array_distinct("_t")).alias("word"))
    pert = words.select(id_col, "word", F.array_join(F.filter("_t", lambda x: x != F.col("word")), " ").alias("_txt"))
    base = toks.select(id_col, F.lit("").alias("word"), F.array_join("_t", " ").alias("_txt"))
    allt = pert.unionByName(base)
    s = scorer.intensity(allt, [id_col, "word"], "_txt").select(id_col, "word", "vader_compound")
    b = s.where(F.col("word") == "").select(id_col, F.col("vader_compound").alias("_base"))
    dl = s.where(F.col("word") != "").join(b, id_col).select(
        id_col, "word", (F.col("vader_compound") - F.col("_base")).alias("delta"))
    w = Window.partitionBy(id_col).orderBy(F.desc(F.round(F.abs("delta"), 12)), "word")
    return dl.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)


def lime_text(df: DataFrame, id_cols: Sequence[str], text_col: str, scorer, num_samples: int = 50, top: int = 10,
              seed: int = 42, kernel_width: float = 25.0, alpha: float = 1.0) -> DataFrame:
    """X5(b) (Ribeiro et al. 2016): per text, ``num_samples`` hash-seeded word masks
    (sample 0 keeps everything), the compound of every masked text, then a weighted ridge fit
    per text; the system solved has num_samples rows.  Output (ids..., word, weight, rank).

    With a lexicon that may be broadcast a text is masked, scored and fitted in its own task
    (num_samples x its tokens), so that only the texts and the top words cross a task.  With a
    larger one the masked texts are scored by ``scorer`` in one distributed pass and meet again
    in ``applyInPandas``.  Rows of the same ids and tokens are one text, their hits add up."""
    ids = list(id_cols)

    def keep(sample, w):
        h = F.xxhash64(*[F.col(c) for c in ids], sample, w, F.lit(seed))
        return (sample == 0) | (F.pmod(h, F.lit(2)) == 1)

    def explained(vocab, X, y):
        return _ridge_top(vocab, X, y, kernel_width, alpha, top)

    lexicon = getattr(scorer, "lexicon", None)
    if lexicon is None or (scorer.lexicon_rows or lexicon.limit(MAX_BROADCAST_LEXICON_ROWS + 1).count()) > MAX_BROADCAST_LEXICON_ROWS:
        return _lime_rescored(df, ids, text_col, scorer, num_samples, keep, explained)
    known: dict = {}
    for token, v in lexicon.select("token", "valence").collect():
        if v is not None:
            known.setdefault(token, []).append(float(v))
    held = df.sparkSession.sparkContext.broadcast((known, frozenset(scorer.negation), dict(scorer.booster)))
    texts = df.select(*ids, F.array_join(T.word_tokens(text_col), " ").alias("_txt")).groupBy(*ids, "_txt").agg(F.count(F.lit(1)).alias("_n"))
    rows = texts.select(*ids, "_n", F.when(F.col("_txt") == "", F.array().cast("array<string>")).otherwise(F.split("_txt", " ")).alias("_t"))
    rows = rows.select("*", F.array_distinct("_t").alias("_v"))
    samples = F.sequence(F.lit(0), F.lit(num_samples - 1))
    rows = rows.select("*", F.flatten(F.transform(samples, lambda s: F.transform("_v", lambda w: keep(s, w).cast("tinyint")))).alias("_m"))
    schema = StructType([*[rows.schema[c] for c in ids], StructField("word", StringType()), StructField("weight", DoubleType()), StructField("rank", IntegerType())])
    at = len(ids)

    def work(batches):
        import numpy as np
        for batch in batches:
            take, out = [], ([], [], [])
            masks = batch.column(at + 3)
            for k, (n, tokens, vocab) in enumerate(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist())):
                if not vocab:
                    continue
                X = np.asarray(masks[k].values, dtype=bool).reshape(num_samples, len(vocab))
                y = masked_compounds(tokens, vocab, X, n, *held.value)
                for rank, (word, weight) in enumerate(explained(vocab, X.astype(float), y), 1):
                    take.append(k)
                    for column, x in zip(out, (word, weight, rank)):
                        column.append(x)
            at_rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at_rows) for c in range(at)], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32())],
                                             names=schema.names)

    return rows.mapInArrow(work, schema)


def masked_compounds(tokens: list[str], vocab: list[str], masks, times: int, valence: dict, negation: frozenset, booster: dict):
    """The compound of the text under every mask (a row of ``masks``: the words of ``vocab`` that
    stay), each hit counted ``times`` times.  Only hits and the three words kept before them count."""
    import numpy as np
    place = {w: i for i, w in enumerate(vocab)}
    at = np.array([place[t] for t in tokens])
    hit = np.array([w in valence for w in vocab])
    y = np.zeros(len(masks))
    for s, mask in enumerate(masks):
        kept = at[mask[at]]
        total = 0.0
        for i in np.flatnonzero(hit[kept]).tolist():
            before = [vocab[j] for j in kept[max(0, i - 3):i][::-1]]
            boost = sum(booster.get(w, 0.0) * d for w, d in zip(before, BOOSTER_DAMPING))
            negated = any(w in negation for w in before)
            for v in valence[vocab[kept[i]]]:
                v += math.copysign(1.0, v) * boost if v else 0.0
                total += times * (v * NEGATION_SCALAR if negated else v)
        y[s] = total / math.sqrt(total * total + COMPOUND_ALPHA)
    return y


def _ridge_top(vocab: list[str], X, y, kernel_width: float, alpha: float, top: int) -> list[tuple]:
    """The ``top`` (word, weight) of the ridge, samples weighted by their nearness to the text."""
    import numpy as np
    frac = X.mean(axis=1)
    dist = (1.0 - np.sqrt(np.clip(frac, 0.0, 1.0))) * 100.0       # cosine distance to the full text, x100
    w = np.sqrt(np.exp(-(dist ** 2) / kernel_width ** 2))
    # weighted ridge with a free intercept, solved in the dual: samples x samples
    r = np.sqrt(w)[:, None]
    A, t = r * (X - (w @ X) / w.sum()), r[:, 0] * (y - (w @ y) / w.sum())
    coef = A.T @ np.linalg.solve(A @ A.T + alpha * np.eye(len(A)), t)
    order = sorted(range(len(vocab)), key=lambda i: (-abs(coef[i]), vocab[i]))[:top]
    return [(vocab[i], float(coef[i])) for i in order]


def _lime_rescored(df: DataFrame, ids: list[str], text_col: str, scorer, num_samples: int, keep, explained) -> DataFrame:
    import numpy as np
    import pandas as pd
    toks = df.select(*ids, T.word_tokens(text_col).alias("_t"))
    samples = toks.select(*ids, "_t", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))).alias("_s"))
    pert = samples.select(*ids, "_s", F.array_join(F.filter("_t", lambda w: keep(F.col("_s"), w)), " ").alias("_txt"),
                          F.array_distinct("_t").alias("_v"))
    vocab_masks = F.transform("_v", lambda w: keep(F.col("_s"), w).cast("int"))
    scored = scorer.intensity(pert.select(*ids, "_s", "_txt", "_v", vocab_masks.alias("_m")), [*ids, "_s"],
                              "_txt", carry_cols=["_v", "_m"])
    rows = scored.where(F.size("_v") > 0).select(*ids, "_s", "_v", "_m", F.col("vader_compound").alias("_y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab = list(pdf["_v"].iloc[0])
        best = explained(vocab, np.array([list(m) for m in pdf["_m"]], dtype=float), pdf["_y"].to_numpy(dtype=float))
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in ids}, "word": [w for w, _ in best],
                             "weight": [x for _, x in best], "rank": list(range(1, len(best) + 1))})

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ids) + ", word string, weight double, rank int"
    return rows.groupBy(*ids).applyInPandas(fit, schema)
