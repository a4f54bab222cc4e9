"""Queries for per-row text functions, predicates and the feature table
(F2-F16, P1-P4, P9, S4, A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import features as FE
from revlens.operators.lexicon import LexiconScorer, predict_sentiment
from revlens.plans import duck as D
from revlens.plans.oracle_views import duck_clean
from revlens.plans.registry import query, r6
from revlens.sources import tables


@query("length_features", views=("reviews",), oracle=f"""
SELECT review_id, {D.char_count('review_text')} AS char_count, {D.word_count('review_text')} AS word_count,
       {D.sentence_count('review_text')} AS sentence_count FROM reviews
""")
def q_length_features(spark, sf):
    r = tables.reviews(spark, sf)
    return r.select("review_id", T.char_count("review_text").alias("char_count"),
                    T.word_count("review_text").alias("word_count"),
                    T.sentence_count("review_text").alias("sentence_count"))


@query("type_token_ratio", views=("reviews",), oracle=f"""
SELECT review_id, round({D.ttr('review_text')}, 6) AS type_token_ratio FROM reviews
""")
def q_type_token_ratio(spark, sf):
    return tables.reviews(spark, sf).select("review_id", r6(T.type_token_ratio("review_text")).alias("type_token_ratio"))


_FK, _FOG = D.readability("review_text")


@query("readability", views=("reviews",), oracle=f"""
SELECT review_id, round({_FK}, 6) AS flesch_kincaid_grade, round({_FOG}, 6) AS gunning_fog FROM reviews
""")
def q_readability(spark, sf):
    rd = T.readability("review_text")
    return tables.reviews(spark, sf).select("review_id", r6(rd["flesch_kincaid_grade"]).alias("flesch_kincaid_grade"),
                                            r6(rd["gunning_fog"]).alias("gunning_fog"))


@query("entity_count", views=("reviews",), oracle=f"""
SELECT review_id, {D.entity_count('review_text')} AS ner_count FROM reviews
""")
def q_entity_count(spark, sf):
    return tables.reviews(spark, sf).select("review_id", T.entity_count("review_text").alias("ner_count"))


@query("number_token_count", views=("reviews",), oracle=f"""
SELECT review_id, {D.number_tokens('review_text')} AS num_token_count FROM reviews
""")
def q_number_token_count(spark, sf):
    return tables.reviews(spark, sf).select("review_id", T.number_tokens("review_text").alias("num_token_count"))


@query("helpful_ratio", views=("reviews",), oracle="""
SELECT review_id, round(CASE WHEN coalesce(total_votes, 0) <> 0 THEN coalesce(helpful_votes, 0) / total_votes
                        ELSE 0.0 END, 6) AS helpful_ratio FROM reviews
""")
def q_helpful_ratio(spark, sf):
    return tables.reviews(spark, sf).select("review_id", r6(T.helpful_ratio()).alias("helpful_ratio"))


@query("verified_flag", views=("reviews",), oracle="""
SELECT review_id, CASE WHEN lower(trim(verified_purchase)) IN ('true', 'yes', '1') THEN 1.0 ELSE 0.0 END::DOUBLE
       AS verified_purchase FROM reviews
""")
def q_verified_flag(spark, sf):
    return tables.reviews(spark, sf).select("review_id", FE.verified_flag().alias("verified_purchase"))


@query("normalize_bool", views=("reviews",), oracle="""
SELECT review_id, CASE WHEN lower(trim(verified_purchase)) IN ('true', 'yes', '1') THEN 1 ELSE 0 END AS flag
FROM reviews
""")
def q_normalize_bool(spark, sf):
    return tables.reviews(spark, sf).select("review_id", T.to_flag("verified_purchase").alias("flag"))


@query("proxy_label", views=("reviews",), oracle="""
SELECT review_id, coalesce(CAST(TRY_CAST(trim(rating) AS DOUBLE) >= 4 AS INTEGER), 0) AS doRecommend FROM reviews
""")
def q_proxy_label(spark, sf):
    return tables.reviews(spark, sf).select("review_id", T.proxy_label("rating").alias("doRecommend"))


@query("coerce_numeric", views=("reviews",), oracle="""
SELECT review_id, TRY_CAST(trim(rating) AS DOUBLE) AS rating_num FROM reviews
""")
def q_coerce_numeric(spark, sf):
    return tables.reviews(spark, sf).select("review_id", T.to_number("rating").alias("rating_num"))


@query("valid_text_filter", views=("reviews",), oracle=f"""
SELECT review_id FROM reviews WHERE length({D.strip('review_text')}) > 0
""")
def q_valid_text_filter(spark, sf):
    return FE.valid_text_filter(tables.reviews(spark, sf)).select("review_id")


@query("require_text", views=("reviews",), oracle=f"""
SELECT review_id, {D.strip('review_text')} AS review_text FROM reviews WHERE review_text IS NOT NULL
""")
def q_require_text(spark, sf):
    return FE.require_text(tables.reviews(spark, sf)).select("review_id", "review_text")


@query("clean_text", views=("reviews",), oracle=f"""
SELECT review_id, {duck_clean('review_text')} AS review_text, rating, verified_purchase, helpful_votes, total_votes,
       ts_epoch, reviewer_id, product_id, lang FROM reviews
""")
def q_clean_text(spark, sf):
    """The cleaner applied to a frame column (checked through basic_clean's oracle)."""
    r = tables.reviews(spark, sf)
    return r.withColumn("review_text", T.basic_clean("review_text"))


@query("normalize_label", oracle="""
SELECT conv_id, turn, coalesce(upper(trim(role)), 'NEUTRAL') AS label FROM conversations
""")
def q_normalize_label(spark, sf):
    c = tables.conversations(spark, sf)
    return c.select("conv_id", "turn", T.normalize_label("role").alias("label"))


_SENT = D.lexicon_ctes("sc", "src", ["review_id"], D.txt("review_text"))


@query("lexicon_intensity", views=("reviews", "fx_sentiment", "fx_booster"), oracle=f"""
WITH src AS (SELECT review_id, review_text FROM reviews), {_SENT}
SELECT review_id, round(vader_neg, 6) AS vader_neg, round(vader_neu, 6) AS vader_neu, round(vader_pos, 6) AS vader_pos,
       round(vader_compound, 6) AS vader_compound FROM sc
""")
def q_lexicon_intensity(spark, sf):
    it = LexiconScorer.fixture(spark).intensity(tables.reviews(spark, sf), ["review_id"], "review_text")
    return it.select("review_id", *[r6(c).alias(c) for c in ("vader_neg", "vader_neu", "vader_pos", "vader_compound")])


@query("lexicon_polarity", views=("reviews", "fx_sentiment", "fx_booster"), oracle=f"""
WITH src AS (SELECT review_id, review_text FROM reviews), {_SENT}
SELECT review_id, round(tb_polarity, 6) AS tb_polarity, round(tb_subjectivity, 6) AS tb_subjectivity FROM sc
""")
def q_lexicon_polarity(spark, sf):
    it = LexiconScorer.fixture(spark).intensity(tables.reviews(spark, sf), ["review_id"], "review_text")
    return it.select("review_id", r6("tb_polarity").alias("tb_polarity"), r6("tb_subjectivity").alias("tb_subjectivity"))


@query("predict_sentiment", views=("reviews", "fx_sentiment", "fx_booster"), oracle=f"""
WITH src AS (SELECT review_id, review_text FROM reviews), {_SENT}
SELECT review_id, label AS sentiment_label, round(score, 6) AS sentiment_confidence FROM sc
""")
def q_predict_sentiment(spark, sf):
    p = predict_sentiment(tables.reviews(spark, sf), LexiconScorer.fixture(spark))
    return p.select("review_id", "sentiment_label", r6("sentiment_confidence").alias("sentiment_confidence"))


@query("rating_sentiment_discordance", views=("reviews", "fx_sentiment", "fx_booster"), oracle=f"""
WITH src AS (SELECT review_id, review_text FROM reviews), {_SENT}
SELECT r.review_id, coalesce(TRY_CAST(trim(r.rating) AS DOUBLE), 0.0) AS rating,
  round(CASE WHEN TRY_CAST(trim(r.rating) AS DOUBLE) IS NULL THEN 0.0
       ELSE abs((TRY_CAST(trim(r.rating) AS DOUBLE) - 3.0) / 2.0
                - CASE WHEN sc.label LIKE '%NEG%' THEN -1.0 WHEN sc.label LIKE '%POS%' THEN 1.0 ELSE 0.0 END) END, 6)
       AS rating_sentiment_discordance,
  round(sc.score, 6) AS sentiment_confidence
FROM reviews r JOIN sc ON r.review_id = sc.review_id
""")
def q_rating_sentiment_discordance(spark, sf):
    r = tables.reviews(spark, sf)
    s = LexiconScorer.fixture(spark).score(r, ["review_id"], "review_text", carry_cols=["rating"])
    return s.select("review_id", F.coalesce(T.to_number("rating"), F.lit(0.0)).alias("rating"),
                    r6(FE.discordance("rating", "label")).alias("rating_sentiment_discordance"),
                    r6("score").alias("sentiment_confidence"))


_FEAT_SQL_FK, _FEAT_SQL_FOG = D.readability("r.review_text")


@query("feature_table", views=("reviews", "fx_sentiment", "fx_booster"), oracle=f"""
WITH src AS (SELECT review_id, review_text FROM reviews), {_SENT}
SELECT r.review_id,
  {D.char_count('r.review_text')}::DOUBLE AS char_count, {D.word_count('r.review_text')}::DOUBLE AS word_count,
  {D.sentence_count('r.review_text')}::DOUBLE AS sentence_count,
  round({D.ttr('r.review_text')}, 6) AS type_token_ratio,
  round({_FEAT_SQL_FK}, 6) AS flesch_kincaid_grade, round({_FEAT_SQL_FOG}, 6) AS gunning_fog,
  round(sc.vader_neg, 6) AS vader_neg, round(sc.vader_neu, 6) AS vader_neu, round(sc.vader_pos, 6) AS vader_pos,
  round(sc.vader_compound, 6) AS vader_compound, round(sc.tb_polarity, 6) AS tb_polarity,
  round(sc.tb_subjectivity, 6) AS tb_subjectivity,
  {D.entity_count('r.review_text')}::DOUBLE AS ner_count, {D.number_tokens('r.review_text')}::DOUBLE AS num_token_count,
  round(CASE WHEN coalesce(r.total_votes, 0) <> 0 THEN coalesce(r.helpful_votes, 0) / r.total_votes ELSE 0.0 END, 6)
    AS helpful_ratio,
  CASE WHEN lower(trim(r.verified_purchase)) IN ('true', 'yes', '1') THEN 1.0 ELSE 0.0 END::DOUBLE AS verified_purchase,
  coalesce(TRY_CAST(trim(r.rating) AS DOUBLE), 0.0) AS rating,
  round(CASE WHEN TRY_CAST(trim(r.rating) AS DOUBLE) IS NULL THEN 0.0
       ELSE abs((TRY_CAST(trim(r.rating) AS DOUBLE) - 3.0) / 2.0
                - CASE WHEN sc.label LIKE '%NEG%' THEN -1.0 WHEN sc.label LIKE '%POS%' THEN 1.0 ELSE 0.0 END) END, 6)
       AS rating_sentiment_discordance,
  round(sc.score, 6) AS sentiment_confidence
FROM reviews r JOIN sc ON r.review_id = sc.review_id
""")
def q_feature_table(spark, sf):
    ft = FE.feature_table(tables.reviews(spark, sf), LexiconScorer.fixture(spark))
    return ft.select("review_id", *[r6(c).alias(c) for c in FE.FEATURE_COLUMNS])


@query("signed_score", views=("reviews", "fx_sentiment", "fx_booster"), oracle=f"""
WITH src AS (SELECT review_id, review_text FROM reviews), {_SENT}
SELECT review_id, round(CASE WHEN upper(label) LIKE '%NEG%' OR upper(label) = '0' THEN -score
                             WHEN upper(label) LIKE '%POS%' OR upper(label) = '1' THEN score ELSE 0.0 END, 6)
       AS signed_score FROM sc
""")
def q_signed_score(spark, sf):
    s = LexiconScorer.fixture(spark).score(tables.reviews(spark, sf), ["review_id"], "review_text")
    return s.select("review_id", r6(T.signed_score("label", "score")).alias("signed_score"))
