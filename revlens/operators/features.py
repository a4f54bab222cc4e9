"""Engineered review features (F2-F12) and frame merging.

``feature_table`` is one scan and one small shuffle: the row-local features are
column expressions, carried through the lexicon aggregate (keyed by review id) as
pass-through values, so no join back to the base table is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as T

ROW_FEATURES = ("char_count", "word_count", "sentence_count", "type_token_ratio", "flesch_kincaid_grade",
                "gunning_fog", "ner_count", "num_token_count")
LEXICON_FEATURES = ("vader_neg", "vader_neu", "vader_pos", "vader_compound", "tb_polarity", "tb_subjectivity")
META_FEATURES = ("helpful_ratio", "verified_purchase", "rating", "rating_sentiment_discordance",
                 "sentiment_confidence")
FEATURE_COLUMNS = ROW_FEATURES[:4] + ROW_FEATURES[4:6] + LEXICON_FEATURES + ROW_FEATURES[6:] + META_FEATURES


def row_features(text_col: str) -> list[Column]:
    """F2, F3, F4, F7, F8 as double columns."""
    rd = T.readability(text_col)
    return [
        T.char_count(text_col).cast("double").alias("char_count"),
        T.word_count(text_col).cast("double").alias("word_count"),
        T.sentence_count(text_col).cast("double").alias("sentence_count"),
        T.type_token_ratio(text_col).cast("double").alias("type_token_ratio"),
        rd["flesch_kincaid_grade"].alias("flesch_kincaid_grade"),
        rd["gunning_fog"].alias("gunning_fog"),
        T.entity_count(text_col).cast("double").alias("ner_count"),
        T.number_tokens(text_col).cast("double").alias("num_token_count"),
    ]


def verified_flag(col: str = "verified_purchase") -> Column:
    """parsed flag as 0.0/1.0 (the string 'False' is false)."""
    return T.to_flag(col).cast("double")


def sentiment_sign(label_col) -> Column:
    lab = F.upper(F.coalesce(F.col(label_col).cast("string") if isinstance(label_col, str) else label_col, F.lit("")))
    return F.when(lab.contains("NEG"), F.lit(-1.0)).when(lab.contains("POS"), F.lit(1.0)).otherwise(F.lit(0.0))


def discordance(rating_col: str, label_col) -> Column:
    """|(rating - 3)/2 - sign(label)|, 0 when the rating is missing or not numeric."""
    r = T.to_number(rating_col)
    return F.when(r.isNull(), F.lit(0.0)).otherwise(F.abs((r - 3.0) / 2.0 - sentiment_sign(label_col)))


def meta_features(df: DataFrame, rating_col="rating", verified_col="verified_purchase", helpful_col="helpful_votes",
                  total_col="total_votes", label_col="sentiment_label", conf_col="sentiment_confidence") -> list[Column]:
    cols = set(df.columns)
    lab = F.col(label_col) if label_col in cols else F.lit("")
    return [
        (T.helpful_ratio(helpful_col, total_col) if {helpful_col, total_col} <= cols else F.lit(0.0)).alias("helpful_ratio"),
        (verified_flag(verified_col) if verified_col in cols else F.lit(0.0)).alias("verified_purchase"),
        (F.coalesce(T.to_number(rating_col), F.lit(0.0)) if rating_col in cols else F.lit(0.0)).alias("rating"),
        (discordance(rating_col, lab) if rating_col in cols else F.lit(0.0)).alias("rating_sentiment_discordance"),
        (F.coalesce(F.col(conf_col).cast("double"), F.lit(0.0)) if conf_col in cols else F.lit(0.0))
        .alias("sentiment_confidence"),
    ]


def feature_table(df: DataFrame, scorer, id_col: str = "review_id", text_col: str = "review_text",
                  rating_col="rating", verified_col="verified_purchase", helpful_col="helpful_votes",
                  total_col="total_votes", label_col="sentiment_label", conf_col="sentiment_confidence",
                  keep_label: bool = False) -> DataFrame:
    """all features per row, nulls -> 0.0.  When the frame has no sentiment
    columns, the label/confidence come from ``scorer`` in the same aggregate
    (``keep_label`` also returns the label, for the A4 pipeline)."""
    has_sent = label_col in df.columns
    carry_src = df.select(
        id_col, text_col, *row_features(text_col),
        *( [F.col(label_col), F.col(conf_col)] if has_sent else []),
        *[F.col(c) for c in {rating_col, verified_col, helpful_col, total_col} if c in df.columns],
    )
    carried = [c for c in carry_src.columns if c not in (id_col, text_col)]
    it = scorer.intensity(carry_src, [id_col], text_col, carry_cols=carried)
    if not has_sent:
        c = F.col("vader_compound")
        from revlens.sources.lexicons import POSITIVE_THRESHOLD as th
        label = F.when(c >= th, F.lit("POSITIVE")).when(c <= -th, F.lit("NEGATIVE")).otherwise(F.lit("NEUTRAL"))
        it = it.withColumn(label_col, label).withColumn(
            conf_col, F.when(label == "NEUTRAL", 1.0 - F.abs(c)).otherwise(F.abs(c)))
    meta = meta_features(it, rating_col, verified_col, helpful_col, total_col, label_col, conf_col)
    lab = [F.col(label_col)] if keep_label else []
    out = it.select(id_col, *lab, *[F.col(c) for c in ROW_FEATURES], *[F.col(c) for c in LEXICON_FEATURES], *meta)
    return out.select(id_col, *lab, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS])


def merge_features(base: DataFrame, feats: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Base columns plus feature columns not already in base (base wins).
    Equi-join on the id; both sides are partitioned by it."""
    extra = [c for c in dict.fromkeys(feats.columns) if c not in base.columns]
    return base.join(feats.select(id_col, *extra), id_col, "left")


def nonzero_aspects(long_aspects: DataFrame, id_col: str = "review_id", eps: float = 1e-9) -> DataFrame:
    """Per review, the aspects whose score is non-zero (long form)."""
    return long_aspects.where(F.abs(F.col("aspect_sentiment")) > eps).select(id_col, "aspect", "aspect_sentiment")


def valid_text_filter(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Keep non-blank strings."""
    return df.where(F.length(T.strip_ws(F.col(text_col))) > 0)


def require_text(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Fail if the text column is missing; drop null text; strip."""
    if text_col not in df.columns:
        raise ValueError(f"Missing required column '{text_col}'. Found: {df.columns}")
    return df.where(F.col(text_col).isNotNull()).withColumn(text_col, T.strip_ws(F.col(text_col)))
