"""Queries for models and vector operators (ML1-ML13, J3-J6, X4).

Text models read ``documents`` joined to ``labels`` (toxic = target); vector
operators read ``embeddings`` (the minority class is label 0).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from revlens.operators import metrics as M
from revlens.operators import models as ML
from revlens.operators import neighbors as N
from revlens.plans import duck as D
from revlens.plans.registry import query, r6
from revlens.sources import tables

KEY5 = list(tables.KEY5)


def labelled_docs(spark, sf):
    d = tables.documents(spark, sf).select("doc_id", F.col("text").alias("review_text"))
    lab = tables.read_table(spark, sf, "labels").select("doc_id", "toxic")
    return d.join(lab, "doc_id")


@query("majority_baseline", oracle="""
SELECT doc_id, toxic AS y_true,
       (SELECT toxic FROM labels GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1) AS y_pred FROM labels
""")
def q_majority_baseline(spark, sf):
    return ML.majority_baseline(tables.read_table(spark, sf, "labels"), "toxic", ["doc_id"])


_TOK = r"[\p{L}\p{N}_]{2,}"


@query("tfidf", oracle=f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOK}') AS t FROM documents),
u AS (SELECT doc_id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS i FROM t),
g AS (SELECT doc_id, tok AS term FROM u
      UNION ALL
      SELECT doc_id, tok || ' ' || nxt FROM (SELECT doc_id, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
                                             FROM u) x WHERE nxt IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2
      ORDER BY total DESC, term LIMIT 50000),
w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((1 + n.n) / (1 + v.df)) + 1) AS w FROM tf JOIN v USING (term), n)
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
""")
def q_tfidf(spark, sf):
    t = ML.tfidf(tables.documents(spark, sf), "doc_id", "text")
    return t.select("doc_id", "term", "tf", r6("weight").alias("weight"))


@query("stratified_split", oracle="""
WITH c AS (SELECT toxic, floor(count(*) * 0.2 + 0.5) AS k FROM labels GROUP BY toxic),
r AS (SELECT doc_id, quality, toxic,
             row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS rn
      FROM labels)
SELECT r.doc_id, r.quality, r.toxic, r.rn <= c.k AS is_test FROM r JOIN c USING (toxic)
""")
def q_stratified_split(spark, sf):
    return ML.stratified_split(tables.read_table(spark, sf, "labels"), "doc_id", "toxic", 0.2, 42)


def _model_probs(spark, sf):
    p = tables.predictions(spark, sf)
    return p.select(*KEY5, "y_true",
                    F.array(1 - F.col("p_a"), F.col("p_a")).alias("prob_a"),
                    F.array((1 - F.col("pred_b")).cast("double"), F.col("pred_b").cast("double")).alias("prob_b"),
                    F.array((1 - F.col("pred_c")).cast("double"), F.col("pred_c").cast("double")).alias("prob_c"))


@query("align_predictions", views=("predictions",), oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       round(1 - p_a, 6) AS s0, round(p_a, 6) AS s1, (1 - pred_b)::DOUBLE AS s2, pred_b::DOUBLE AS s3,
       (1 - pred_c)::DOUBLE AS s4, pred_c::DOUBLE AS s5
FROM predictions
""")
def q_align_predictions(spark, sf):
    """Three models' outputs, each its own frame, aligned by the row key (equi-join)
    and stacked (concat of the probability arrays)."""
    m = _model_probs(spark, sf)
    a = m.select(*KEY5, "prob_a")
    b = m.select(*KEY5, "prob_b")
    c = m.select(*KEY5, "prob_c")
    j = a.join(b, KEY5).join(c, KEY5)
    st = F.concat("prob_a", "prob_b", "prob_c")
    return j.select(*KEY5, *[r6(st[i]).alias(f"s{i}") for i in range(6)])


@query("weighted_voting", views=("predictions",), oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       round(0.45 * (1 - p_a) + 0.30 * (1 - pred_b) + 0.25 * (1 - pred_c), 6) AS p0,
       round(0.45 * p_a + 0.30 * pred_b + 0.25 * pred_c, 6) AS p1
FROM predictions
""")
def q_weighted_voting(spark, sf):
    m = _model_probs(spark, sf)
    v = ML.weighted_voting(m, ["prob_a", "prob_b", "prob_c"], [0.45, 0.30, 0.25])
    return m.select(*KEY5, r6(v[0]).alias("p0"), r6(v[1]).alias("p1"))


_EVT_COLS = ["value", "hour", "props_len"]


def _event_features(spark, sf):
    e = tables.events(spark, sf)
    return e.select("event_id", "value", F.hour("ts").cast("double").alias("hour"),
                    F.length("props").cast("double").alias("props_len"))


@query("standardize_features", oracle="""
WITH e AS (SELECT event_id, coalesce(value, 0.0) AS value, coalesce(hour(ts)::DOUBLE, 0.0) AS hour,
                  coalesce(length(props)::DOUBLE, 0.0) AS props_len FROM events),
s AS (SELECT avg(value) mv, stddev_pop(value) sv, avg(hour) mh, stddev_pop(hour) sh, avg(props_len) mp,
             stddev_pop(props_len) sp FROM e)
SELECT event_id, round(CASE WHEN sv > 0 THEN (value - mv) / sv ELSE 0.0 END, 6) AS value,
       round(CASE WHEN sh > 0 THEN (hour - mh) / sh ELSE 0.0 END, 6) AS hour,
       round(CASE WHEN sp > 0 THEN (props_len - mp) / sp ELSE 0.0 END, 6) AS props_len FROM e, s
""")
def q_standardize_features(spark, sf):
    z = ML.standardize(_event_features(spark, sf), _EVT_COLS, keep=["event_id"])
    return z.select("event_id", *[r6(c).alias(c) for c in _EVT_COLS])


@query("segment_customers", oracle=None)
def q_segment_customers(spark, sf):
    """ML13: KMeans(4, seed 42) segments of standardised event features (rows check)."""
    return ML.segment_customers(_event_features(spark, sf), _EVT_COLS, ["event_id"], 4, 42)


@query("embedding_assign", views=("prototypes",), oracle="""
WITH s AS (SELECT e.vec_id, p.aspect, p.aspect_ord, list_inner_product(CAST(e.embedding AS DOUBLE[]), p.embedding) AS sim
           FROM embeddings e, prototypes p),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, aspect_ord) AS rn FROM s)
SELECT vec_id, aspect, round(sim, 6) AS similarity FROM b WHERE rn = 1 AND sim >= 0.3
""")
def q_embedding_assign(spark, sf):
    a = N.embedding_assign(tables.embeddings(spark, sf), tables.prototypes(spark, sf), threshold=0.3)
    return a.select("vec_id", "aspect", r6("similarity").alias("similarity"))


_KNN_SQL = """
WITH m AS (SELECT vec_id, embedding FROM minority WHERE y = 1),
d AS (SELECT a.vec_id, b.vec_id AS nbr_id, list_distance(a.embedding, b.embedding) AS dist
      FROM m a JOIN m b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr_id) AS rank FROM d)
SELECT vec_id, nbr_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5
"""


@query("smote_neighbors", views=("minority",), oracle=_KNN_SQL)
def q_smote_neighbors(spark, sf):
    """Exact 5 nearest minority neighbours (pivot blocks + triangle-inequality pruning)."""
    m = tables.minority(spark, sf).where(F.col("y") == 1).select("vec_id", "embedding")
    k = N.knn(m, m, 5, n_pivots=8)
    return k.select("vec_id", "nbr_id", r6("dist").alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query("nearest_unlike_neighbor", views=("emb",), oracle="""
WITH d AS (SELECT a.vec_id, b.vec_id AS nbr_id, list_distance(a.embedding, b.embedding) AS dist
           FROM emb a JOIN emb b ON a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr_id) AS rn FROM d)
SELECT vec_id, nbr_id, round(dist, 6) AS dist FROM r WHERE rn = 1
""")
def q_nearest_unlike_neighbor(spark, sf):
    n = N.nearest_unlike_neighbor(tables.embeddings(spark, sf), "label", method="exact")
    return n.select("vec_id", "nbr_id", r6("dist").alias("dist"))


@query("smote_neighbors_lsh", oracle=None)
def q_smote_neighbors_lsh(spark, sf):
    """J5 by hashing: the neighbours found (pytest measures the recall against the exact query)."""
    m = tables.minority(spark, sf).where(F.col("y") == 1).select("vec_id", "embedding")
    return N.lsh_knn(m, m, 5).select("vec_id", "nbr_id", r6("dist").alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query("nearest_unlike_neighbor_lsh", oracle=None)
def q_nearest_unlike_neighbor_lsh(spark, sf):
    """J6 by hashing (pytest measures the recall against the exact query)."""
    n = N.nearest_unlike_neighbor(tables.embeddings(spark, sf), "label")
    return n.select("vec_id", "nbr_id", r6("dist").alias("dist"))


def _scored_embeddings(spark, sf):
    e = tables.embeddings(spark, sf)
    return e.select("vec_id", "embedding", (1 / (1 + F.exp(-5 * F.col("embedding")[1]))).alias("p_target"))


@query("counterfactual", views=("emb",), oracle="""
WITH s AS (SELECT vec_id, embedding, 1 / (1 + exp(-5 * embedding[2])) AS p FROM emb),
q AS (SELECT * FROM s WHERE p < 0.51), c AS (SELECT * FROM s WHERE p >= 0.51),
d AS (SELECT q.vec_id, c.vec_id AS cid, list_distance(q.embedding, c.embedding) AS dist,
             len(list_filter(list_zip(q.embedding, c.embedding), lambda z: abs(z[1] - z[2]) > 1e-12)) AS n_changed
      FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cid) AS rn FROM d)
SELECT vec_id, cid AS counterfactual_id, round(dist, 6) AS dist, n_changed FROM r WHERE rn = 1
""")
def q_counterfactual(spark, sf):
    c = N.counterfactual(_scored_embeddings(spark, sf), "p_target", method="exact")
    return c.select("vec_id", "counterfactual_id", r6("dist").alias("dist"),
                    F.col("n_changed").cast("bigint").alias("n_changed"))


@query("smote_class_counts", views=("minority",), oracle="""
WITH c AS (SELECT count(*) FILTER (WHERE y = 1) AS m, count(*) FILTER (WHERE y <> 1) AS mj FROM minority)
SELECT 0 AS y, mj AS n FROM c UNION ALL SELECT 1, greatest(m, mj) FROM c
""")
def q_smote_class_counts(spark, sf):
    s = N.smote(tables.minority(spark, sf), "y")
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("smote", oracle=None)
def q_smote(spark, sf):
    """ML6: original + synthetic minority rows (rows check; pytest checks that every
    synthetic point lies on a segment between two minority rows)."""
    s = N.smote(tables.minority(spark, sf), "y")
    return s.select("vec_id", "y", "synthetic", F.col("embedding")[0].alias("e0"))


def _text_model(spark, sf, kind):
    d = labelled_docs(spark, sf)
    sp = ML.stratified_split(d, "doc_id", "toxic", 0.2, 42)
    model = ML.tfidf_classifier(sp.where(~F.col("is_test")), "toxic", "review_text", kind=kind)
    pred = model.transform(sp.where("is_test"))
    return pred.select("doc_id", F.col("toxic").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                       ML.positive_score(pred).alias("score"))


@query("tfidf_logreg", oracle=None)
def q_tfidf_logreg(spark, sf):
    """ML3: held-out predictions of TF-IDF + logistic regression (rows check)."""
    return _text_model(spark, sf, "logreg")


@query("tfidf_svm", oracle=None)
def q_tfidf_svm(spark, sf):
    """ML4: held-out predictions of TF-IDF + linear SVM (rows check)."""
    return _text_model(spark, sf, "svm")


def _vec_data(spark, sf):
    m = tables.minority(spark, sf)
    return m.select("vec_id", "embedding", "y", array_to_vector("embedding").alias("features"))


@query("random_forest", oracle=None)
def q_random_forest(spark, sf):
    """ML7: class-balanced forest of 400 trees (the library's default)."""
    sp = ML.stratified_split(_vec_data(spark, sf), "vec_id", "y", 0.2, 42)
    rf = ML.random_forest(sp.where(~F.col("is_test")), "features", "y")
    p = rf.transform(sp.where("is_test"))
    return p.select("vec_id", F.col("y").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                    vector_to_array("probability")[1].alias("p1"))


def _oversample(df):
    s = N.smote(df.select("vec_id", "embedding", "y"), "y")
    return s.select("vec_id", "embedding", "y", array_to_vector("embedding").alias("features"))


@query("platt_calibration", oracle=None)
def q_platt_calibration(spark, sf):
    """ML8: 3-fold sigmoid calibration with SMOTE inside each fold (400 trees)."""
    sp = ML.stratified_split(_vec_data(spark, sf), "vec_id", "y", 0.2, 42)
    p = ML.platt_calibrated_proba(sp.where(~F.col("is_test")).drop("is_test"), sp.where("is_test"), "features", "y",
                                  "vec_id", oversample=_oversample, num_trees=400)
    return p.join(sp.where("is_test").select("vec_id", F.col("y").alias("y_true")), "vec_id")


def behavior_features(spark, sf):
    """F12 features and aspect scores per review, with the proxy label (P2) as target; the two
    features made from the rating, as the label is, are left out."""
    from revlens.functions import text as T
    from revlens.operators import absa as A
    from revlens.operators import features as FE
    from revlens.operators.lexicon import LexiconScorer
    from revlens.plans.q_absa import ASPECT_NAMES, prepared_once
    from revlens.sources.lexicons import FX_ASPECTS, FX_STOP
    p = prepared_once(spark, sf).where(T.to_number("rating").isNotNull())
    scorer = LexiconScorer.fixture(spark)
    wide = A.aspect_wide(p, A.absa_extract(p, FX_ASPECTS, FX_STOP, scorer), ASPECT_NAMES)
    x = FE.feature_table(p, scorer).drop("rating", "rating_sentiment_discordance").join(wide, "review_id")
    return x.join(p.select("review_id", T.proxy_label("rating").alias("recommends")), "review_id")


@query("behavior_model", oracle=None)
def q_behavior_model(spark, sf):
    """ML9 on the engineered features: split -> (SMOTE -> forest -> sigmoid) x 3 folds -> report
    on held-out rows."""
    x = behavior_features(spark, sf)
    report, _ = ML.behavior_model(x, [c for c in x.columns if c not in ("review_id", "recommends")], "recommends", "review_id")
    return report


@query("forest_shapley", oracle=None)
def q_forest_shapley(spark, sf):
    """X3 for a fitted forest: Shapley values of every row (pytest: they add up to the
    probability and equal brute force)."""
    from revlens.operators.tree_shap import forest_shap
    d = _vec_data(spark, sf)
    forest = ML.random_forest(d, "features", "y", num_trees=20, max_depth=6)
    values, _ = forest_shap(forest, d, "vec_id")
    return values.select("vec_id", "feature", r6("shapley").alias("shapley"))


@query("temporal_split", views=("reviews",), oracle="""
WITH r AS (SELECT review_id, floor(ts_epoch / 86400) AS day FROM reviews),
o AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM r),
c AS (SELECT min(day) AS cut FROM o WHERE k > n - floor(0.2 * n + 0.5))
SELECT review_id, CAST(day AS BIGINT) AS day, day >= cut AS is_test FROM r, c
""")
def q_temporal_split(spark, sf):
    """Split by day: the newest fifth of the reviews, days kept whole."""
    r = tables.reviews(spark, sf).select("review_id", F.floor(F.col("ts_epoch") / 86400).alias("day"))
    return ML.temporal_split(r, "day", 0.2)


@query("stacking", oracle=None)
def q_stacking(spark, sf):
    """ML11: logistic regression on the stacked probabilities of three models, fitted on the
    training rows of ML5 and applied to its held-out rows."""
    m = _model_probs(spark, sf).withColumn("row", F.concat_ws("-", *KEY5))
    sp = ML.stratified_split(m, "row", "y_true", 0.2, 42)
    model = ML.stacking_fit(sp.where(~F.col("is_test")), ["prob_a", "prob_b", "prob_c"], "y_true")
    out = model.transform(sp.where("is_test"))
    return out.select(*KEY5, "y_true", F.col("prediction").cast("int").alias("y_pred"),
                      vector_to_array("probability")[1].alias("p1"))


@query("predict_sentiment_model", oracle=None)
def q_predict_sentiment_model(spark, sf):
    """A1(b): TF-IDF + logistic regression as the sentiment scorer (through the U1 interface),
    trained on the proxy label (P2) of the training part of the rated reviews and applied to
    all other reviews."""
    from revlens.functions import text as T
    from revlens.operators.lexicon import ModelScorer, predict_sentiment
    r = tables.reviews(spark, sf).select("review_id", "review_text", "rating")
    rated = r.where(T.to_number("rating").isNotNull()).select("review_id", "review_text", T.proxy_label("rating").alias("recommends"))
    train = ML.stratified_split(rated, "review_id", "recommends", 0.2, 42).where(~F.col("is_test"))
    model = ML.tfidf_classifier(train, "recommends", "review_text", kind="logreg")
    rest = r.join(train.select("review_id"), "review_id", "left_anti")
    return predict_sentiment(rest, ModelScorer(model, labels=("NEGATIVE", "POSITIVE")))
