"""Queries for evaluation metrics, statistical tests and report views
(M1-M12, M14, G6-G9, G14, T1-T3).

Binary inputs come from ``predictions`` (y_true, pred_a/b/c, p_a), multiclass
inputs from ``multiclass`` (y, p0, p1, p2), both over the whole lineitem table.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import business as B
from revlens.operators import metrics as M
from revlens.operators import stats as S
from revlens.operators.lexicon import LexiconScorer
from revlens.plans import duck as D
from revlens.plans.registry import query, r6
from revlens.sources import tables

P3 = ["p0", "p1", "p2"]


def _pred(spark, sf, col="pred_a"):
    return tables.predictions(spark, sf).select("y_true", F.col(col).alias("y_pred"), "p_a", "pred_a", "pred_b",
                                                "pred_c", *tables.KEY5)


@query("confusion_matrix", views=("predictions",), oracle="""
WITH p AS (SELECT y_true, pred_a AS y_pred FROM predictions),
l AS (SELECT y_true AS v FROM p UNION SELECT y_pred FROM p)
SELECT a.v AS y_true, b.v AS y_pred,
       (SELECT count(*) FROM p WHERE p.y_true = a.v AND p.y_pred = b.v) AS n
FROM l a, l b
""")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_pred(spark, sf))


_PC_SQL = """
WITH p AS (SELECT y_true, {pred} AS y_pred FROM {src}),
l AS (SELECT y_true AS v FROM p UNION SELECT y_pred FROM p),
c AS (SELECT l.v,
        (SELECT count(*) FROM p WHERE y_true = l.v AND y_pred = l.v)::DOUBLE AS tp,
        (SELECT count(*) FROM p WHERE y_true = l.v)::DOUBLE AS sup,
        (SELECT count(*) FROM p WHERE y_pred = l.v)::DOUBLE AS prd FROM l),
m AS (SELECT v, tp, sup, prd, CASE WHEN prd > 0 THEN tp / prd ELSE 0.0 END AS pr,
             CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS rc FROM c),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
"""


@query("prf_weighted", views=("predictions",), oracle=_PC_SQL.format(pred="pred_a", src="predictions") + """
SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(pr * sup) / sum(sup), 6) AS precision,
       round(sum(rc * sup) / sum(sup), 6) AS recall, round(sum(f1 * sup) / sum(sup), 6) AS f1 FROM f
""")
def q_prf_weighted(spark, sf):
    r = M.prf_weighted(_pred(spark, sf))
    return r.select(*[r6(c).alias(c) for c in r.columns])


_ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


@query("prf_macro", views=("multiclass",), oracle=_PC_SQL.format(
    pred=_ARGMAX, src="multiclass").replace("SELECT y_true,", "SELECT y AS y_true,") + """
SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall,
       round(avg(f1), 6) AS f1 FROM f
""")
def q_prf_macro(spark, sf):
    r = M.prf_macro(tables.multiclass(spark, sf), "y", P3)
    return r.select(*[r6(c).alias(c) for c in r.columns])


@query("mcc", views=("predictions",), oracle=_PC_SQL.format(pred="pred_a", src="predictions") + """
, g AS (SELECT sum(tp) AS c, sum(sup) AS s, sum(prd * sup) AS pt, sum(prd * prd) AS pp, sum(sup * sup) AS tt FROM f)
SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt))
             ELSE 0.0 END, 6) AS mcc FROM g
""")
def q_mcc(spark, sf):
    return M.mcc(_pred(spark, sf)).select(r6("mcc").alias("mcc"))


@query("cost_metrics", views=("predictions",), oracle="""
SELECT count(*) FILTER (WHERE y_true = 1 AND pred_a = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND pred_a = 0) AS tn,
       count(*) FILTER (WHERE y_true = 0 AND pred_a = 1) AS fp, count(*) FILTER (WHERE y_true = 1 AND pred_a = 0) AS fn,
       (2.0 * count(*) FILTER (WHERE y_true = 1 AND pred_a = 0) + count(*) FILTER (WHERE y_true = 0 AND pred_a = 1))::DOUBLE
         AS cost,
       round(count(*) FILTER (WHERE y_true = pred_a)::DOUBLE / greatest(1, count(*)), 6) AS cost_sensitive_accuracy
FROM predictions
""")
def q_cost_metrics(spark, sf):
    r = M.cost_metrics(_pred(spark, sf))
    return r.select("tp", "tn", "fp", "fn", "cost", r6("cost_sensitive_accuracy").alias("cost_sensitive_accuracy"))


_MW = """
WITH r AS (SELECT {y} AS y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS rk FROM {src}),
c AS (SELECT count(*) FILTER (WHERE y = 1)::DOUBLE AS P, count(*) FILTER (WHERE y <> 1)::DOUBLE AS N,
             sum(rk) FILTER (WHERE y = 1) AS srk FROM r)
"""


@query("roc_auc", views=("predictions",), oracle=_MW.format(y="y_true", s="p_a", src="predictions") + """
SELECT round((srk - P * (P + 1) / 2) / (P * N), 6) AS roc_auc FROM c
""")
def q_roc_auc(spark, sf):
    return M.roc_auc(_pred(spark, sf), "y_true", "p_a").select(r6("roc_auc").alias("roc_auc"))


@query("roc_auc_ovr", views=("multiclass",), oracle="""
WITH e AS (SELECT y, 0 AS cls, p0 AS p FROM multiclass UNION ALL SELECT y, 1, p1 FROM multiclass
           UNION ALL SELECT y, 2, p2 FROM multiclass),
r AS (SELECT cls, CASE WHEN y = cls THEN 1 ELSE 0 END AS pos,
             rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS rk FROM e),
c AS (SELECT cls, sum(pos)::DOUBLE AS P, sum(1 - pos)::DOUBLE AS N, sum(rk * pos) AS srk FROM r GROUP BY cls)
SELECT round(avg((srk - P * (P + 1) / 2) / (P * N)), 6) AS roc_auc_ovr FROM c
""")
def q_roc_auc_ovr(spark, sf):
    return M.roc_auc_ovr(tables.multiclass(spark, sf), "y", P3).select(r6("roc_auc_ovr").alias("roc_auc_ovr"))


@query("average_precision", views=("predictions",), oracle="""
WITH s AS (SELECT p_a AS score, count(*) FILTER (WHERE y_true = 1)::DOUBLE AS pos,
                  count(*) FILTER (WHERE y_true <> 1)::DOUBLE AS neg FROM predictions GROUP BY p_a),
c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM s)
SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM c
""")
def q_average_precision(spark, sf):
    return M.average_precision(_pred(spark, sf), "y_true", "p_a").select(
        r6("average_precision").alias("average_precision"))


@query("brier", views=("predictions",), oracle="""
SELECT round(avg((p_a - y_true) * (p_a - y_true)), 6) AS brier FROM predictions
""")
def q_brier(spark, sf):
    return M.brier(_pred(spark, sf)).select(r6("brier").alias("brier"))


_ECE = """
WITH b AS (SELECT i, i * CAST(0.1 AS DOUBLE) AS lo, (i + 1) * CAST(0.1 AS DOUBLE) AS hi FROM range(10) t(i)),
d AS ({rows}),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
g AS (SELECT b.i, count(*) AS nb, avg(d.correct) AS acc, avg(d.conf) AS c FROM d JOIN b ON d.conf >= b.lo AND d.conf < b.hi
      GROUP BY b.i)
SELECT round(coalesce(sum(nb / n.n * abs(acc - c)), 0.0), 6) AS ece FROM g, n
"""


@query("ece", views=("predictions",), oracle=_ECE.format(rows="""
SELECT p_a AS conf, CASE WHEN (CASE WHEN p_a >= 0.5 THEN 1 ELSE 0 END) = y_true THEN 1.0 ELSE 0.0 END AS correct
FROM predictions"""))
def q_ece(spark, sf):
    return M.ece_binary(_pred(spark, sf), "y_true", "p_a").select(r6("ece").alias("ece"))


@query("ece_multiclass", views=("multiclass",), oracle=_ECE.format(rows=f"""
SELECT greatest(p0, p1, p2) AS conf, CASE WHEN ({_ARGMAX}) = y THEN 1.0 ELSE 0.0 END AS correct FROM multiclass"""))
def q_ece_multiclass(spark, sf):
    return M.ece_multiclass(tables.multiclass(spark, sf), "y", P3).select(r6("ece").alias("ece"))


@query("top_k_accuracy", views=("multiclass",), oracle="""
WITH t AS (SELECT *, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS pt FROM multiclass),
r AS (SELECT 1 + (CASE WHEN p0 > pt OR (p0 = pt AND 0 < y) THEN 1 ELSE 0 END)
               + (CASE WHEN p1 > pt OR (p1 = pt AND 1 < y) THEN 1 ELSE 0 END)
               + (CASE WHEN p2 > pt OR (p2 = pt AND 2 < y) THEN 1 ELSE 0 END) AS rk FROM t)
SELECT round(avg(CASE WHEN rk <= 2 THEN 1.0 ELSE 0.0 END), 6) AS top_k_accuracy FROM r
""")
def q_top_k_accuracy(spark, sf):
    return M.top_k_accuracy(tables.multiclass(spark, sf), "y", P3, k=2).select(
        r6("top_k_accuracy").alias("top_k_accuracy"))


@query("classification_report", views=("predictions",), oracle=_PC_SQL.format(pred="pred_a", src="predictions") + """
SELECT CAST(v AS VARCHAR) AS label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1,
       CAST(sup AS BIGINT) AS support FROM f
UNION ALL
SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), CAST(sum(sup) AS BIGINT) FROM f
UNION ALL
SELECT 'weighted avg', round(sum(pr * sup) / sum(sup), 6), round(sum(rc * sup) / sum(sup), 6),
       round(sum(f1 * sup) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM f
""")
def q_classification_report(spark, sf):
    r = M.classification_report(_pred(spark, sf))
    return r.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
                    "support")


@query("mcnemar", views=("predictions",), oracle="""
WITH g AS (SELECT count(*) FILTER (WHERE pred_a = y_true AND pred_b <> y_true) AS n01,
                  count(*) FILTER (WHERE pred_a <> y_true AND pred_b = y_true) AS n10 FROM predictions)
SELECT n01, n10, round(((abs(n01 - n10) - 1) * (abs(n01 - n10) - 1))::DOUBLE / greatest(1, n01 + n10), 6) AS chi2 FROM g
""")
def q_mcnemar(spark, sf):
    return S.mcnemar(_pred(spark, sf)).select("n01", "n10", r6("chi2").alias("chi2"))


# upper tail of chi-square: 1 minus the power series of the lower incomplete gamma function
_TAIL = """CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 1400 THEN 0.0 ELSE round(1 - (SELECT sum(exp(({a} + n) * ln({x} / 2) - {x} / 2 - lgamma({a} + n + 1)))
                     FROM range(0, 1500) t(n)), 6) END"""


@query("mcnemar_p_value", views=("predictions",), oracle=f"""
WITH g AS (SELECT count(*) FILTER (WHERE pred_b = y_true AND pred_c <> y_true) AS n01,
                  count(*) FILTER (WHERE pred_b <> y_true AND pred_c = y_true) AS n10 FROM predictions),
c AS (SELECT ((abs(n01 - n10) - 1) * (abs(n01 - n10) - 1))::DOUBLE / greatest(1, n01 + n10) AS chi2 FROM g)
SELECT round(chi2, 6) AS chi2, {_TAIL.format(x="chi2", a="0.5")} AS p_value FROM c
""")
def q_mcnemar_p_value(spark, sf):
    m = S.mcnemar(_pred(spark, sf), pred_a="pred_b", pred_b="pred_c")
    return S.with_p_value(m, "chi2", F.lit(1)).select(r6("chi2").alias("chi2"), r6("p_value").alias("p_value"))


@query("friedman", views=("fold_scores",), oracle="""
WITH r AS (SELECT fold, model, rank() OVER (PARTITION BY fold ORDER BY score)
                  + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk,
                  count(*) OVER (PARTITION BY fold, score) AS t FROM fold_scores),
k AS (SELECT count(DISTINCT fold)::DOUBLE AS n, count(DISTINCT model)::DOUBLE AS k,
             sum(t * t - 1)::DOUBLE AS ties FROM r),
s AS (SELECT sum(R * R) AS ssbn FROM (SELECT model, sum(rk) AS R FROM r GROUP BY model) x)
SELECT round((12.0 / (k * n * (k + 1)) * ssbn - 3 * n * (k + 1)) / (1 - ties / (k * (k * k - 1) * n)), 6) AS statistic,
       k - 1 AS df, n AS n_blocks, k AS k_models FROM s, k
""")
def q_friedman(spark, sf):
    f = S.friedman(tables.fold_scores(spark, sf))
    return f.select(r6("statistic").alias("statistic"), "df", "n_blocks", "k_models")


@query("friedman_p_value", views=("fold_scores",), oracle=f"""
WITH r AS (SELECT fold, model, rank() OVER (PARTITION BY fold ORDER BY score)
                  + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk,
                  count(*) OVER (PARTITION BY fold, score) AS t FROM fold_scores),
k AS (SELECT count(DISTINCT fold)::DOUBLE AS n, count(DISTINCT model)::DOUBLE AS k,
             sum(t * t - 1)::DOUBLE AS ties FROM r),
s AS (SELECT sum(R * R) AS ssbn FROM (SELECT model, sum(rk) AS R FROM r GROUP BY model) x),
f AS (SELECT (12.0 / (k * n * (k + 1)) * ssbn - 3 * n * (k + 1)) / (1 - ties / (k * (k * k - 1) * n)) AS statistic, k - 1 AS dof FROM s, k)
SELECT round(statistic, 6) AS statistic, {_TAIL.format(x="statistic", a="dof / 2")} AS p_value FROM f
""")
def q_friedman_p_value(spark, sf):
    f = S.with_p_value(S.friedman(tables.fold_scores(spark, sf)), "statistic", F.col("df"))
    return f.select(r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


@query("bootstrap_ci", oracle=None)
def q_bootstrap_ci(spark, sf):
    """M13 (rows check; pytest compares with the analytic interval)."""
    r = S.bootstrap_ci(_pred(spark, sf), n=2000)
    return r.select(r6("low").alias("low"), r6("high").alias("high"), r6("mean").alias("mean"))


BOOTSTRAP_REPLICATES = 40
_CDF = "[" + ", ".join(repr(p) for p in S._POISSON) + "]"


def md5_uniform(key, replicate, seed):
    """Uniform draw that SQL can repeat, as hexadecimal digits: their order is that of the numbers.
    The library's default hash is cheaper."""
    return F.md5(F.concat_ws("-", key, replicate.cast("string"), F.lit(str(seed))))


# the first eight digits against p; "g" comes after all of them
md5_uniform.steps = [f"{math.ceil(p * 2 ** 32):08x}" if p * 2 ** 32 <= 2 ** 32 - 1 else "g" for p in S._POISSON]


@query("bootstrap_rows", views=("predictions",), oracle=f"""
WITH u AS (SELECT b, y_true, p_a, pred_a, ('0x' || substr(md5(concat_ws('-', id, b, 42)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
           FROM predictions, (SELECT range AS b FROM range({BOOTSTRAP_REPLICATES})) r),
w AS (SELECT *, len(list_filter({_CDF}, lambda p: p <= u))::DOUBLE AS w FROM u),
t AS (SELECT b, sum(w) AS t, sum(w * (y_true = pred_a)::INT) / sum(w) AS accuracy, sum(w * (p_a - y_true) * (p_a - y_true)) / sum(w) AS brier FROM w GROUP BY b),
e AS (SELECT b, sum(abs(g)) AS g FROM (SELECT b, floor(p_a * 10) AS bin, sum(w * (((p_a >= 0.5)::INT = y_true)::INT - p_a)) AS g FROM w
      WHERE floor(p_a * 10) BETWEEN 0 AND 9 GROUP BY ALL) x GROUP BY b),
c AS (SELECT b, p_a AS s, sum(w * y_true) AS pos, sum(w * (1 - y_true)) AS neg FROM w GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER (PARTITION BY b) AS pp, sum(neg) OVER (PARTITION BY b) AS nn,
             coalesce(sum(pos) OVER x, 0) AS pb, coalesce(sum(neg) OVER x, 0) AS nb FROM c
      WINDOW x AS (PARTITION BY b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT 'accuracy' AS metric, accuracy AS value FROM t UNION ALL SELECT 'brier', brier FROM t
      UNION ALL SELECT 'ece', g / t FROM e JOIN t USING (b)
      UNION ALL SELECT 'roc_auc', sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM k GROUP BY b
      UNION ALL SELECT 'average_precision', sum(CASE WHEN pos > 0 THEN pos * (pp - pb) / (pp - pb + nn - nb) ELSE 0 END) / sum(pos) FROM k GROUP BY b)
SELECT metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg(value), 6) AS mean FROM v GROUP BY metric
""")
def q_bootstrap_rows(spark, sf):
    """M13 on rows: intervals of accuracy, Brier score, ECE, AUC and average precision."""
    p = tables.spread(tables.predictions(spark, sf).select("id", "y_true", "p_a", "pred_a"))
    r = S.bootstrap_rows(p, ["id"], {"accuracy": S.weighted_accuracy("y_true", "pred_a"), "brier": S.weighted_brier("y_true", "p_a"), "ece": S.weighted_ece("y_true", "p_a")},
                         n=BOOTSTRAP_REPLICATES, ranked=("y_true", "p_a"), block=20, uniform=md5_uniform)
    return r.select("metric", *[r6(c).alias(c) for c in ("low", "high", "mean")])


@query("nemenyi", oracle=None)
def q_nemenyi(spark, sf):
    """Post-hoc pairs after M14 (pytest checks the quantiles against the published table)."""
    n = S.nemenyi(tables.fold_scores(spark, sf))
    return n.select("model_a", "model_b", *[r6(c).alias(c) for c in ("rank_diff", "critical", "p_value")], "significant")


# --- report views over the scored reviews --------------------------------------
_SC = D.lexicon_ctes("sc", "base", ["id"], D.txt("text"))
_REV_VIEWS = ("reviews", "fx_sentiment", "fx_booster")


def scored_reviews(spark, sf):
    """Prepared reviews + lexicon sentiment + proxy label and a prediction from the sentiment."""
    from revlens.plans.q_absa import prepared
    p = prepared(spark, sf)
    p = p.withColumn("text_len", F.length("review_text"))      # texts stay out of the aggregate; reports need the length
    s = LexiconScorer.fixture(spark).score(p, ["review_id"], "review_text", carry_cols=["text_len", "rating"])
    return s.select("review_id", "text_len", "rating", F.col("label").alias("sentiment_label"),
                    F.col("score").alias("sentiment_confidence"),
                    T.proxy_label("rating").alias("y_true"),
                    (F.col("label") == "POSITIVE").cast("int").alias("y_pred"))


_SCORED = f"""WITH {D.prepared_base()}, {_SC},
sr AS (SELECT b.id AS review_id, b.text AS review_text, b.rating, sc.label AS sentiment_label,
              sc.score AS sentiment_confidence,
              coalesce(CAST(TRY_CAST(trim(b.rating) AS DOUBLE) >= 4 AS INTEGER), 0) AS y_true,
              CAST(sc.label = 'POSITIVE' AS INTEGER) AS y_pred
       FROM base b JOIN sc ON sc.id = b.id)"""


@query("label_distribution", views=("reviews",), oracle="""
SELECT CASE WHEN lower(trim(verified_purchase)) IN ('true', 'yes', '1') THEN 1 ELSE 0 END AS label, count(*) AS n
FROM reviews GROUP BY 1
""")
def q_label_distribution(spark, sf):
    return B.label_distribution(tables.reviews(spark, sf), "verified_purchase")


@query("sentiment_distribution", views=_REV_VIEWS, oracle=f"""{_SCORED}
SELECT sentiment_label, count(*) AS n FROM sr GROUP BY sentiment_label
""")
def q_sentiment_distribution(spark, sf):
    return B.sentiment_distribution(scored_reviews(spark, sf))


@query("confidence_describe", views=_REV_VIEWS, oracle=f"""{_SCORED}
SELECT count(sentiment_confidence) AS count, round(avg(sentiment_confidence), 6) AS mean,
       round(stddev_samp(sentiment_confidence), 6) AS std, round(min(sentiment_confidence), 6) AS min,
       round(quantile_cont(sentiment_confidence, 0.25), 6) AS p25, round(quantile_cont(sentiment_confidence, 0.5), 6) AS p50,
       round(quantile_cont(sentiment_confidence, 0.75), 6) AS p75, round(max(sentiment_confidence), 6) AS max FROM sr
""")
def q_confidence_describe(spark, sf):
    d = B.confidence_describe(scored_reviews(spark, sf))
    return d.select("count", *[r6(c).alias(c) for c in d.columns if c != "count"])


@query("confidence_histogram", views=_REV_VIEWS, oracle=f"""{_SCORED},
mm AS (SELECT min(sentiment_confidence) AS mn, max(sentiment_confidence) AS mx FROM sr),
e AS (SELECT i + 1 AS bin,
        CASE WHEN i = 0 THEN (CASE WHEN mx > mn THEN mn - (mx - mn) * 0.001 ELSE mn - 0.001 * abs(mn) END)
             ELSE (CASE WHEN mx > mn THEN mn ELSE mn - 0.001 * abs(mn) END) + i * ((CASE WHEN mx > mn THEN mx - mn ELSE 0.002 * abs(mn) END) / 10) END AS lft,
        CASE WHEN i = 9 THEN (CASE WHEN mx > mn THEN mx ELSE mx + 0.001 * abs(mx) END)
             ELSE (CASE WHEN mx > mn THEN mn ELSE mn - 0.001 * abs(mn) END) + (i + 1) * ((CASE WHEN mx > mn THEN mx - mn ELSE 0.002 * abs(mn) END) / 10) END AS rgt
      FROM range(10) t(i), mm)
SELECT e.bin, round(e.lft, 6) AS "left", round(e.rgt, 6) AS "right",
       (SELECT count(*) FROM sr WHERE sentiment_confidence > e.lft AND sentiment_confidence <= e.rgt) AS n
FROM e
""")
def q_confidence_histogram(spark, sf):
    h = B.confidence_histogram(scored_reviews(spark, sf))
    return h.select("bin", r6("left").alias("left"), r6("right").alias("right"), "n")


@query("accuracy_by_length", views=_REV_VIEWS, oracle=f"""{_SCORED},
d AS (SELECT length(review_text) AS len, CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END AS ok FROM sr),
e AS (SELECT list_sort(list_distinct(quantile_cont(len, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM d),
b AS (SELECT greatest(1, len(list_filter(e, lambda x: x < d.len))) AS bin, ok, e FROM d, e WHERE len(e) >= 2)
SELECT bin, e[bin] AS bin_lo, e[bin + 1] AS bin_hi, round(avg(ok), 6) AS accuracy, count(*) AS n FROM b GROUP BY bin, e
""")
def q_accuracy_by_length(spark, sf):
    a = M.accuracy_by_length(scored_reviews(spark, sf), "y_true", "y_pred", len_col="text_len")
    return a.select("bin", "bin_lo", "bin_hi", r6("accuracy").alias("accuracy"), "n")


@query("misclassified_examples", views=_REV_VIEWS, oracle=f"""{_SCORED}
SELECT review_id, y_true, y_pred, CAST(length(review_text) AS BIGINT) AS text_len FROM sr
WHERE y_true IS DISTINCT FROM y_pred OR (y_true IS NULL AND y_pred IS NULL)
ORDER BY text_len DESC, review_id LIMIT 25
""")
def q_misclassified_examples(spark, sf):
    m = M.misclassified_examples(scored_reviews(spark, sf), "y_true", "y_pred", "review_id", k=25,
                                 len_col="text_len")
    return m.select("review_id", "y_true", "y_pred", "text_len")


@query("lowest_confidence", views=_REV_VIEWS, oracle=f"""{_SCORED}
SELECT review_id, sentiment_label, round(sentiment_confidence, 6) AS sentiment_confidence FROM sr
ORDER BY sentiment_confidence, review_id LIMIT 5
""")
def q_lowest_confidence(spark, sf):
    lc = M.lowest_confidence(scored_reviews(spark, sf), "sentiment_confidence", "review_id", k=5)
    return lc.select("review_id", "sentiment_label", r6("sentiment_confidence").alias("sentiment_confidence"))


@query("sample_rows", views=("reviews",), oracle="""
SELECT review_id, rating, lang FROM reviews ORDER BY md5(CAST(review_id AS VARCHAR) || '-42') LIMIT 5
""")
def q_sample_rows(spark, sf):
    return M.sample_rows(tables.reviews(spark, sf), "review_id", k=5, seed=42).select("review_id", "rating", "lang")


@query("rating_only_baseline", views=("reviews",), oracle=_PC_SQL.format(
    pred="coalesce(CAST(TRY_CAST(trim(rating) AS DOUBLE) >= 4 AS INTEGER), 0)",
    src="reviews").replace("SELECT y_true,", "SELECT CASE WHEN lower(trim(verified_purchase)) IN ('true', 'yes', '1') "
                           "THEN 1 ELSE 0 END AS y_true,") + """
SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(pr * sup) / sum(sup), 6) AS precision,
       round(sum(rc * sup) / sum(sup), 6) AS recall, round(sum(f1 * sup) / sum(sup), 6) AS f1 FROM f
""")
def q_rating_only_baseline(spark, sf):
    """ML14: recommend iff rating >= 4 (P2) as the predictor, scored with M2 against the
    normalised flag column (P1)."""
    r = tables.reviews(spark, sf).select(T.to_flag("verified_purchase").alias("y_true"),
                                         T.proxy_label("rating").alias("y_pred"))
    m = M.prf_weighted(r)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("misclassified_filter", views=_REV_VIEWS, oracle=f"""{_SCORED}
SELECT review_id, y_true, y_pred FROM sr
WHERE y_true IS DISTINCT FROM y_pred OR (y_true IS NULL AND y_pred IS NULL)
""")
def q_misclassified_filter(spark, sf):
    """P5: every row whose prediction differs from the label (both null counts as an error)."""
    return M.misclassified(scored_reviews(spark, sf)).select("review_id", "y_true", "y_pred")


@query("row_cap", views=("reviews",), oracle="""
SELECT review_id, rating, lang FROM reviews ORDER BY review_id LIMIT 200
""")
def q_row_cap(spark, sf):
    """The 200-row preview (TakeOrderedAndProject; a cap is only ever a preview)."""
    return tables.reviews(spark, sf).select("review_id", "rating", "lang").orderBy("review_id").limit(200)
