"""Lexicon-based intensity and polarity (F5, F6) and the lexicon sentiment scorer.

Plan (one narrow stage per input partition, one small shuffle):
    tokens(text) -> one row a token + one sentinel row
      -> broadcast LEFT JOIN lexicon(token)      (size-checked table)
      -> keep lexicon hits and the sentinel      (the aggregate sees hits only)
      -> partial aggregate by row key            (map-side combine)
      -> shuffle of one small row per key -> final aggregate.
The text itself never crosses a shuffle; a 20,000-word review becomes 20,000
short rows inside one task and collapses again before the exchange.

Semantics (after Hutto & Gilbert 2014, simplified):
  v' = (v + sign(v) * sum_d booster(prev_d) * damping_d) * (-0.74 if any of the
  three previous tokens is a negation); compound = s / sqrt(s^2 + 15), s = sum v';
  pos/neg/neu = shares of sum(v'+1 | v'>0), |sum(v'-1 | v'<0)| and the count of
  tokens with v' = 0.  Polarity = mean(polarity * (-0.5 if the previous token is a
  negation)), subjectivity = mean(subjectivity), over lexicon tokens; 0 if none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import text as T

from revlens.functions.text import word_tokens
from revlens.sources.lexicons import (
    BOOSTER_DAMPING, COMPOUND_ALPHA, NEGATION_SCALAR, POLARITY_NEGATION,
    POSITIVE_THRESHOLD, sentiment_df,
)

MAX_BROADCAST_LEXICON_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only if it is proven small; otherwise leave the join to the planner
    (shuffle join).  Lexicons built from Python literals pass ``known_rows``."""
    n = known_rows if known_rows is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def _lit_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _booster_shift(tok: Column, booster: dict[str, float]) -> Column:
    if not booster:
        return F.lit(0.0)
    m = F.create_map(*[x for k, v in booster.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(m, F.coalesce(tok, F.lit(""))), F.lit(0.0))


@dataclass
class LexiconScorer:
    """U1 scorer backed by a sentiment lexicon table (token, valence, polarity, subjectivity).

    Negation and booster words are closed word classes (tens of entries) and are
    passed as Python sequences; the open lexicon is a DataFrame joined by a
    size-checked broadcast.
    """

    lexicon: DataFrame
    negation: Sequence[str] = ()
    booster: dict[str, float] = field(default_factory=dict)
    lexicon_rows: int | None = None

    @classmethod
    def fixture(cls, spark: SparkSession) -> "LexiconScorer":
        """The lexicon, negations and boosters made for the invented words of the test corpus."""
        from revlens.sources.lexicons import FX_BOOSTER, FX_NEGATION, FX_SENTIMENT
        return cls(sentiment_df(spark), list(FX_NEGATION), dict(FX_BOOSTER), lexicon_rows=len(FX_SENTIMENT))

    # -- F5 + F6 -------------------------------------------------------------
    def intensity(self, df: DataFrame, key_cols: Sequence[str], text_col: str,
                  carry_cols: Sequence[str] = ()) -> DataFrame:
        """Per key: vader_neg, vader_neu, vader_pos, vader_compound, tb_polarity,
        tb_subjectivity, n_tokens (+ ``carry_cols`` passed through unchanged)."""
        keys = list(key_cols)
        toks = df.select(*keys, *carry_cols, word_tokens(text_col).alias("_t"))
        lexicon = self.lexicon.select(F.col("token").alias("tok"), "valence", "polarity", "subjectivity")
        known = self.lexicon_rows if self.lexicon_rows is not None else lexicon.limit(MAX_BROADCAST_LEXICON_ROWS + 1).count()
        lex = bounded_broadcast(lexicon, MAX_BROADCAST_LEXICON_ROWS, known)
        # one sentinel row per text keeps texts without any lexicon hit (and carries the
        # token count), so only lexicon hits + one row per text reach the aggregate
        if known <= MAX_BROADCAST_LEXICON_ROWS:
            # tokens stay within their task, so the words before a hit are looked up in the text's array
            rows = toks.select(*keys, *carry_cols, "_t", F.posexplode(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("_pos", "tok"))
            j = rows.join(lex, "tok", "left").where(F.col("valence").isNotNull() | F.col("tok").isNull())
            before = lambda k: F.when(F.col("tok").isNotNull() & (F.col("_pos") >= k), F.get(F.col("_t"), F.col("_pos") - k)).alias(f"p{k}")
            j = j.select(*keys, *carry_cols, F.size("_t").alias("_ntok"), "valence", "polarity", "subjectivity", *[before(k) for k in (1, 2, 3)])
        else:
            spread = F.transform("_t", lambda x, i: F.struct(
                x.alias("tok"), *[F.get(F.col("_t"), i - k).alias(f"p{k}") for k in (1, 2, 3)], F.lit(False).alias("_sentinel")))
            sentinel = F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in ("tok", "p1", "p2", "p3")], F.lit(True).alias("_sentinel")))
            rows = toks.select(*keys, *carry_cols, F.size("_t").alias("_ntok"), F.inline(F.concat(spread, sentinel)))
            j = rows.join(lex, "tok", "left").where(F.col("valence").isNotNull() | F.col("_sentinel"))

        neg = _lit_array(list(self.negation))
        is_neg = lambda c: F.coalesce(F.array_contains(neg, c), F.lit(False))
        v = F.col("valence")
        boost = sum((_booster_shift(F.col(p), self.booster) * d for p, d in zip(("p1", "p2", "p3"), BOOSTER_DAMPING)),
                    F.lit(0.0))
        v1 = v + F.signum(v) * boost
        v2 = F.when(is_neg(F.col("p1")) | is_neg(F.col("p2")) | is_neg(F.col("p3")), v1 * NEGATION_SCALAR).otherwise(v1)
        pol = F.when(is_neg(F.col("p1")), F.col("polarity") * POLARITY_NEGATION).otherwise(F.col("polarity"))
        scored = j.select(*keys, *carry_cols, "_ntok", F.col("valence"), F.coalesce(v2, F.lit(0.0)).alias("v"),
                          pol.alias("pol"), F.col("subjectivity").alias("subj"))

        # carried columns depend on the key, so they join the grouping key: the
        # aggregate stays a (codegen) hash aggregate whatever their types are
        agg = scored.groupBy(*keys, *carry_cols).agg(
            F.max("_ntok").alias("n_tokens"),
            F.sum("v").alias("s"),
            F.sum(F.when(F.col("v") > 0, F.col("v") + 1.0).otherwise(0.0)).alias("pos_sum"),
            F.sum(F.when(F.col("v") < 0, F.col("v") - 1.0).otherwise(0.0)).alias("neg_sum"),
            F.count_if(F.col("valence").isNotNull() & (F.col("v") != 0)).alias("n_nonzero"),
            F.avg("pol").alias("tb_polarity"),
            F.avg("subj").alias("tb_subjectivity"),
        )
        neu = (F.col("n_tokens") - F.col("n_nonzero")).cast("double")
        total = F.col("pos_sum") + F.abs(F.col("neg_sum")) + neu
        share = lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))
        s = F.col("s")
        return agg.select(
            *keys, *carry_cols,
            share(F.abs(F.col("neg_sum"))).alias("vader_neg"),
            share(neu).alias("vader_neu"),
            share(F.col("pos_sum")).alias("vader_pos"),
            (s / F.sqrt(s * s + COMPOUND_ALPHA)).alias("vader_compound"),
            F.coalesce(F.col("tb_polarity"), F.lit(0.0)).alias("tb_polarity"),
            F.coalesce(F.col("tb_subjectivity"), F.lit(0.0)).alias("tb_subjectivity"),
            F.col("n_tokens"),
        )

    # -- U1 / A1 ---------------------------------------------------------------
    def score(self, df: DataFrame, key_cols: Sequence[str], text_col: str,
              carry_cols: Sequence[str] = ()) -> DataFrame:
        """(keys..., carry..., label, score): POSITIVE if compound >= 0.05, NEGATIVE if
        <= -0.05, else NEUTRAL; score = |compound| (1 - |compound| for NEUTRAL)."""
        it = self.intensity(df, key_cols, text_col, carry_cols)
        c = F.col("vader_compound")
        label = (F.when(c >= POSITIVE_THRESHOLD, F.lit("POSITIVE"))
                 .when(c <= -POSITIVE_THRESHOLD, F.lit("NEGATIVE")).otherwise(F.lit("NEUTRAL")))
        conf = F.when(label == "NEUTRAL", 1.0 - F.abs(c)).otherwise(F.abs(c))
        return it.select(*key_cols, *carry_cols, label.alias("label"), conf.alias("score"))


def predict_sentiment(df: DataFrame, scorer, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """A1: (id, sentiment_label, sentiment_confidence) for every row; null text -> ''."""
    s = scorer.score(df, [id_col], text_col)
    return s.select(id_col, F.col("label").alias("sentiment_label"), F.col("score").alias("sentiment_confidence"))


@dataclass
class ModelScorer:
    """U1 adapter for a fitted ``pyspark.ml`` model (e.g. TF-IDF + logistic regression,
    A1(b)): label = ``labels[prediction]``, score = probability of that class."""

    model: object
    labels: Sequence[str] = ("POSITIVE", "NEGATIVE")
    text_input: str = "review_text"

    def score(self, df: DataFrame, key_cols: Sequence[str], text_col: str,
              carry_cols: Sequence[str] = ()) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        x = df.select(*key_cols, *carry_cols, T.as_text(text_col).alias(self.text_input))
        p = self.model.transform(x)
        lab = F.element_at(F.array(*[F.lit(v) for v in self.labels]), F.col("prediction").cast("int") + 1)
        prob = F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1)
        return p.select(*key_cols, *carry_cols, lab.alias("label"), prob.alias("score"))


@dataclass
class PandasScorer:
    """U1 adapter for any Python scorer ``fn(list[str]) -> (labels, scores)``: Arrow
    batches through ``mapInPandas``; ``load`` builds the model once per Python worker."""

    load: object

    def score(self, df: DataFrame, key_cols: Sequence[str], text_col: str,
              carry_cols: Sequence[str] = ()) -> DataFrame:
        import pandas as pd
        load = self.load
        cols = [*key_cols, *carry_cols]
        out_schema = df.select(*cols).schema.simpleString()[len("struct<"):-1] + ",label:string,score:double"
        out_schema = out_schema.replace(":", " ")

        def run(batches):
            fn = load()
            for pdf in batches:
                texts = pdf[text_col].fillna("").astype(str).tolist()
                labels, scores = fn(texts)
                out = pdf[cols].copy()
                out["label"] = list(labels)
                out["score"] = [float(s) for s in scores]
                yield out

        return df.select(*cols, text_col).mapInPandas(run, out_schema)
