"""Queries for sources/sinks, augmentation, language detection, explanations and
streaming (S1-S3, S5, S6, X1-X3, X5, F17, L1, L2).

Queries that exercise a reader or a sink first write the driver table in the
needed format to a fresh folder under the shared checkpoint dir, then read it
back through the operator; the oracle is the same table read directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import augment as AU
from revlens.operators import explain as X
from revlens.operators import metrics as M
from revlens.operators.lexicon import LexiconScorer
from revlens.plans import duck as D
from revlens.plans.oracle_views import WS_CLASS as WS, duck_clean
from revlens.plans.registry import query, r6
from revlens.sources import readers as RD
from revlens.sources import tables
from revlens.sources.lexicons import FX_ASPECTS, FX_STOP

_NA = "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in RD.NA_TOKENS) + ")"


def _na(c: str) -> str:
    return f"CASE WHEN {c} IN {_NA} THEN NULL ELSE {c} END"


def _source_style(spark, sf):
    """The review view with the headers of a raw review export."""
    r = tables.reviews(spark, sf)
    return r.select(
        F.col("review_id").cast("string").alias("review_id"), F.col("review_text").alias("Reviews.Text"),
        F.col("rating").alias(" Stars "), F.col("verified_purchase").alias("Verified"),
        F.col("helpful_votes").cast("string").alias("helpful_vote"), F.col("total_votes").cast("string").alias("total_votes"),
        F.when(F.pmod("review_id", F.lit(2)) == 0, F.concat(F.lit("P"), F.col("product_id").cast("string")))
        .alias("parent_asin"),
        F.col("product_id").cast("string").alias("ASIN"))


def _typed(df):
    return df.select(F.col("review_id").cast("bigint").alias("review_id"), "review_text", "rating", "verified_purchase",
                     F.col("helpful_votes").cast("double").alias("helpful_votes"),
                     F.col("total_votes").cast("double").alias("total_votes"), "product_id")


_S1_ORACLE = f"""
SELECT review_id, {D.strip('review_text')} AS review_text, {_na('rating')} AS rating,
       {_na('verified_purchase')} AS verified_purchase, helpful_votes, total_votes,
       coalesce(CASE WHEN review_id % 2 = 0 THEN 'P' || CAST(product_id AS VARCHAR) END, CAST(product_id AS VARCHAR))
         AS product_id
FROM reviews WHERE review_text IS NOT NULL AND review_text NOT IN {_NA}
"""


@query("read_reviews", views=("reviews",), oracle=_S1_ORACLE)
def q_read_reviews(spark, sf):
    """S1 (+S3, S4): export the review view as quoted CSV, read it back with sep=','."""
    path = RD.scratch(spark, "reviews-csv")
    RD.write_csv(_source_style(spark, sf), path, ",")
    return _typed(RD.read_reviews(spark, path, sep=","))


@query("normalize_columns", views=("reviews",), oracle=f"""
SELECT review_id, review_text, rating, verified_purchase, helpful_votes, total_votes,
       coalesce(CASE WHEN review_id % 2 = 0 THEN 'P' || CAST(product_id AS VARCHAR) END, CAST(product_id AS VARCHAR))
         AS product_id
FROM reviews
""")
def q_normalize_columns(spark, sf):
    """S3 on a frame with raw export headers (case, padding, two product-id sources)."""
    return _typed(RD.normalize_columns(_source_style(spark, sf)))


@query("read_upload", views=("reviews",), oracle=f"""
WITH r AS (SELECT review_id, CASE WHEN review_text IN {_NA} THEN NULL ELSE review_text END AS review_text,
                  {_na('rating')} AS rating FROM reviews),
d AS (SELECT *, row_number() OVER (PARTITION BY {D.strip(D.txt('review_text'))} ORDER BY review_id) AS rn FROM r)
SELECT review_id, {duck_clean(D.strip(D.txt('review_text')))} AS review_text, rating FROM d WHERE rn = 1
""")
def q_read_upload(spark, sf):
    """A .tsv upload read with tab + standard quoting, then dedup and clean."""
    path = RD.scratch(spark, "upload") + ".tsv"
    src = tables.reviews(spark, sf).select(F.col("review_id").cast("string").alias("review_id"), "review_text",
                                           "rating")
    RD.write_csv(src, path, "\t")
    return RD.read_upload(spark, path).select("review_id", "review_text", "rating")


@query("metrics_sink", views=("predictions",), oracle="""
WITH p AS (SELECT y_true, pred_a AS y_pred FROM predictions),
l AS (SELECT y_true AS v FROM p UNION SELECT y_pred FROM p),
c AS (SELECT l.v, (SELECT count(*) FROM p WHERE y_true = l.v AND y_pred = l.v)::DOUBLE AS tp,
             (SELECT count(*) FROM p WHERE y_true = l.v)::DOUBLE AS sup FROM l)
SELECT 'exp1' AS experiment, 'run1' AS run, 'accuracy' AS metric, round(sum(tp) / sum(sup), 6) AS value FROM c
UNION ALL
SELECT 'exp1', 'run1', 'n_rows', sum(sup) FROM c
""")
def q_metrics_sink(spark, sf):
    """Log two experiments' metrics to a partitioned Parquet table; read one back
    (partition pruning on ``experiment``)."""
    path = RD.scratch(spark, "metrics")
    acc = M.prf_weighted(tables.predictions(spark, sf).select("y_true", F.col("pred_a").alias("y_pred")))
    n = tables.predictions(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("value"))
    long = acc.select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")).unionByName(
        n.select(F.lit("n_rows").alias("metric"), "value"))
    RD.log_metrics(long, path, "exp1", "run1")
    RD.log_metrics(long.withColumn("value", F.col("value") * 0), path, "exp2", "run1")
    return RD.read_metrics(spark, path, "exp1").select("experiment", "run", "metric", r6("value").alias("value"))


_CONV_SC = D.lexicon_ctes("sc", "src", ["conv_id", "turn"], D.txt("text"))


@query("batch_score_table", views=("fx_sentiment", "fx_booster"), oracle=f"""
WITH src AS (SELECT conv_id, turn, text FROM conversations), {_CONV_SC}
SELECT conv_id, turn, label, round(score, 6) AS score FROM sc
""")
def q_batch_score_table(spark, sf):
    """Parquet in -> lexicon scorer -> Parquet out, read back."""
    out = RD.scratch(spark, "scored")
    s = RD.batch_score_table(spark, f"{sf.rstrip('/')}/conversations.parquet", out, LexiconScorer.fixture(spark),
                             ["conv_id", "turn"], "text")
    return s.select("conv_id", "turn", "label", r6("score").alias("score"))


_TOKS = f"list_filter(string_split_regex(coalesce(text, ''), '[{WS}]+'), lambda x: length(x) > 0)"


@query("context_substitution", oracle=f"""
WITH t AS (SELECT doc_id, {_TOKS} AS t FROM documents),
u AS (SELECT doc_id, len(t) AS n, unnest(t) AS word, unnest(generate_series(0, len(t) - 1)) AS pos FROM t),
c AS (SELECT doc_id, n, pos, word, coalesce(lag(word) OVER w, '<s>') AS prev, coalesce(lead(word) OVER w, '</s>') AS nxt
      FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cnt AS (SELECT prev, nxt, word, count(*) AS c FROM c GROUP BY prev, nxt, word),
best AS (SELECT prev, nxt, word AS filler FROM
         (SELECT *, row_number() OVER (PARTITION BY prev, nxt ORDER BY c DESC, word) AS rn FROM cnt) x WHERE rn = 1),
rep AS (SELECT c.doc_id, c.pos, c.word, b.filler FROM c JOIN best b ON b.prev = c.prev AND b.nxt = c.nxt
        WHERE c.n >= 5 AND c.pos < greatest(1, floor(c.n * CAST(0.15 AS DOUBLE)))),
o AS (SELECT u.doc_id, string_agg(coalesce(r.filler, u.word), ' ' ORDER BY u.pos) AS txt
      FROM u LEFT JOIN rep r ON r.doc_id = u.doc_id AND r.pos = u.pos GROUP BY u.doc_id)
SELECT d.doc_id, md5(coalesce(o.txt, '')) AS augmented_md5,
       (SELECT count(*) FROM rep WHERE rep.doc_id = d.doc_id) AS n_replaced,
       (SELECT count(*) FROM rep WHERE rep.doc_id = d.doc_id AND rep.filler <> rep.word) AS n_changed
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
""")
def q_context_substitution(spark, sf):
    a = AU.context_substitution(tables.documents(spark, sf), "doc_id", "text", p=0.15)
    return a.select("doc_id", F.md5("augmented_text").alias("augmented_md5"), "n_replaced", "n_changed")


def replace_a(text: str) -> str:
    """Test text function for X2 (stands in for a translator)."""
    return text.replace("a", "4")


@query("apply_text_fn", oracle="""
SELECT doc_id, md5(CASE WHEN lang <> 'en' THEN replace(coalesce(text, ''), 'a', '4') ELSE text END) AS out_md5
FROM documents
""")
def q_apply_text_fn(spark, sf):
    d = tables.documents(spark, sf)
    o = AU.apply_text_fn(d, "doc_id", "text", replace_a, route=F.col("lang") != "en")
    return o.select("doc_id", F.md5("text_out").alias("out_md5"))


_TRI = """(SELECT {id}, {lang} unnest(generate_series(1, length(w) - 2)) AS i, w FROM
  (SELECT {id}, {lang} '_' || unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) || '_' AS w
   FROM documents) a)"""


@query("language_detect", oracle=f"""
WITH tri AS (SELECT doc_id, lang, substring(w, i, 3) AS tri FROM {_TRI.format(id='doc_id', lang='lang,')} t),
prof AS (SELECT lang, tri FROM (SELECT lang, tri, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, tri) AS rk
                                FROM tri GROUP BY lang, tri) x WHERE rk <= 300),
sc AS (SELECT t.doc_id, p.lang, count(*) AS score FROM tri t JOIN prof p ON p.tri = t.tri GROUP BY t.doc_id, p.lang),
best AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rn
                                   FROM sc) x WHERE rn = 1)
SELECT d.doc_id, b.lang AS detected FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id
""")
def q_language_detect(spark, sf):
    """trigram profiles learnt from the labelled corpus, argmax coverage per text."""
    d = tables.documents(spark, sf)
    prof = AU.language_profiles(d, "text", "lang", 300)
    return AU.detect_language(d, "doc_id", "text", prof, "lang")


@query("english_gate", oracle=None)
def q_english_gate(spark, sf):
    """F17 + T3: the translation gate -- all of 5 repeatably sampled documents English?"""
    d = tables.documents(spark, sf)
    profiles = AU.language_profiles(d, "text", "lang", 300)
    some = M.sample_rows(d.where(F.trim("text") != "").select("doc_id", "text"), "doc_id", k=5)
    return AU.english_gate_df(AU.detect_language(some, "doc_id", "text", profiles, "lang"), 5, "doc_id")


_W = {"value": 0.5, "hour": -0.2, "props_len": 0.01}


def _events_num(spark, sf):
    e = tables.events(spark, sf)
    return e.select("event_id", F.coalesce("value", F.lit(0.0)).alias("value"),
                    F.coalesce(F.hour("ts").cast("double"), F.lit(0.0)).alias("hour"),
                    F.coalesce(F.length("props").cast("double"), F.lit(0.0)).alias("props_len"))


@query("shapley_importance", oracle="""
WITH e AS (SELECT event_id, coalesce(value, 0.0) AS value, coalesce(hour(ts)::DOUBLE, 0.0) AS hour,
                  coalesce(length(props)::DOUBLE, 0.0) AS props_len FROM events),
b AS (SELECT avg(value) AS mv, avg(hour) AS mh, avg(props_len) AS mp FROM
      (SELECT * FROM e ORDER BY md5(CAST(event_id AS VARCHAR) || '-7') LIMIT 20) s)
SELECT event_id, 'value' AS feature, round(0.5 * (value - mv), 6) AS shapley FROM e, b
UNION ALL SELECT event_id, 'hour', round(-0.2 * (hour - mh), 6) FROM e, b
UNION ALL SELECT event_id, 'props_len', round(0.01 * (props_len - mp), 6) FROM e, b
""")
def q_shapley_importance(spark, sf):
    """X3 with a linear scorer, whose exact Shapley values are w * (x - mean of background)."""
    e = _events_num(spark, sf)
    bg = M.sample_rows(e, "event_id", k=20, seed=7)
    cols = list(_W)
    v = X.shapley_values(e, "event_id", cols, lambda p: sum((p[c] * w for c, w in _W.items()), F.lit(0.0)), bg,
                         n_perm=4)
    return v.select("event_id", "feature", r6("shapley").alias("shapley"))


_X5_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


@query("text_explanation", views=("fx_sentiment", "fx_booster"), oracle=f"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, {_X5_TOK} AS t FROM conversations),
w AS (SELECT DISTINCT id, unnest(t) AS word FROM t),
src AS (SELECT w.id, w.word, array_to_string(list_filter(t.t, lambda x: x <> w.word), ' ') AS txt
        FROM w JOIN t ON t.id = w.id
        UNION ALL SELECT id, '' AS word, array_to_string(t, ' ') FROM t),
{D.lexicon_ctes('sc', 'src', ['id', 'word'], D.txt('txt'))},
dl AS (SELECT a.id, a.word, a.vader_compound - b.vader_compound AS delta FROM sc a JOIN sc b ON b.id = a.id AND b.word = ''
       WHERE a.word <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(delta) DESC, word) AS rank FROM dl)
SELECT id // 1000 AS conv_id, id % 1000 AS turn, word, round(delta, 6) AS delta, rank FROM r WHERE rank <= 10
""")
def q_text_explanation(spark, sf):
    """X5(a): leave-one-word-out attribution of the lexicon scorer, top 10 words per turn."""
    c = tables.conversations(spark, sf).select(F.struct("conv_id", "turn").alias("id"), "text")
    e = X.leave_one_word_out(c, "id", "text", LexiconScorer.fixture(spark), top=10)
    return e.select(F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn"), "word",
                    r6("delta").alias("delta"), F.col("rank").cast("bigint").alias("rank"))


@query("lime_explanation", oracle=None)
def q_lime_explanation(spark, sf):
    """X5(b): LIME word weights per conversation turn (rows check)."""
    c = tables.conversations(spark, sf).select("conv_id", "turn", "text")
    return X.lime_text(c, ["conv_id", "turn"], "text", LexiconScorer.fixture(spark), num_samples=50, top=10)


_CONV_BASE = f"""base AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, {duck_clean('text')} AS text
  FROM conversations)"""


@query("score_stream", views=("fx_aspects", "fx_sentiment", "fx_booster"), oracle=f"""
WITH {_CONV_BASE}, {D.absa_ctes()}, {D.lexicon_ctes('sc', 'base', ['id'], D.txt('text'))}
SELECT b.conv_id, b.turn, sc.label AS sentiment_label, round(sc.score, 6) AS sentiment_confidence, a.aspect,
       round(a.aspect_sentiment, 6) AS aspect_sentiment, round(a.aspect_confidence, 6) AS aspect_confidence
FROM base b JOIN sc ON sc.id = b.id LEFT JOIN absa_long a ON a.id = b.id
""")
def q_score_stream(spark, sf):
    """L1: conversation turns arrive as Parquet files; every micro-batch is scored
    (sentiment + aspects) by ``foreachBatch`` into a Parquet sink; equals the batch result."""
    from revlens.streaming.scoring import score_stream
    src = RD.scratch(spark, "stream-in")
    conv = tables.conversations(spark, sf)
    conv.repartition(4).write.parquet(src)
    out, ck = RD.scratch(spark, "stream-out"), RD.scratch(spark, "stream-ck")
    score_stream(spark, src, conv.schema, out, ck, LexiconScorer.fixture(spark), FX_ASPECTS, FX_STOP,
                 F.struct("conv_id", "turn"), "text", keep_cols=("conv_id", "turn"))
    r = spark.read.parquet(out)
    return r.select("conv_id", "turn", "sentiment_label", r6("sentiment_confidence").alias("sentiment_confidence"),
                    "aspect", r6("aspect_sentiment").alias("aspect_sentiment"),
                    r6("aspect_confidence").alias("aspect_confidence"))


@query("dedup_stream", views=("reviews",), oracle=f"""
SELECT DISTINCT sha256({D.strip(D.txt('review_text'))}) AS text_key FROM reviews
""")
def q_dedup_stream(spark, sf):
    """L2: watermark-bounded streaming dedup of review texts (distinct keys equal the batch D1)."""
    from revlens.streaming.scoring import dedup_stream
    src = RD.scratch(spark, "dedup-in")
    rv = tables.reviews(spark, sf)
    rv.repartition(4).write.parquet(src)
    out, ck = RD.scratch(spark, "dedup-out"), RD.scratch(spark, "dedup-ck")
    dedup_stream(spark, src, rv.schema, out, ck, "review_text", F.timestamp_seconds("ts_epoch"),
                 watermark="3650 days")       # longer than the table, so that it equals the batch D1
    return spark.read.parquet(out).select("text_key")
