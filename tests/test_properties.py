"""Properties of the operators on the driver tables, and plan shape checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import metrics as M
from revlens.operators import models as ML
from revlens.operators import neighbors as N
from revlens.operators import quality as Q
from revlens.operators import stats as S
from revlens.plans.registry import QUERIES, load_all
from revlens.sources import tables
from tests.conftest import SF_ORACLE, SF_SMALL

load_all()


def test_dedup_idempotent(spark):
    once = Q.remove_duplicates(tables.reviews(spark, SF_SMALL))
    twice = Q.remove_duplicates(once)
    assert once.count() == twice.count()
    assert once.exceptAll(twice).count() == 0


def test_confusion_sums_to_n_and_recall_is_accuracy(spark):
    p = tables.predictions(spark, SF_SMALL).select("y_true", F.col("pred_a").alias("y_pred"))
    n = p.count()
    assert M.confusion_matrix(p).agg(F.sum("n")).first()[0] == n
    r = M.prf_weighted(p).first()
    assert r["recall"] == pytest.approx(r["accuracy"])


def test_auc_of_complement(spark):
    p = tables.predictions(spark, SF_SMALL)
    a = M.roc_auc(p, "y_true", "p_a").first()[0]
    b = M.roc_auc(p.withColumn("q", 1 - F.col("p_a")), "y_true", "q").first()[0]
    assert a + b == pytest.approx(1.0)


def test_results_do_not_depend_on_partitioning(spark):
    p = tables.predictions(spark, SF_SMALL)
    a = M.roc_auc(p.repartition(1), "y_true", "p_a").first()[0]
    b = M.roc_auc(p.repartition(17), "y_true", "p_a").first()[0]
    assert a == pytest.approx(b)
    s1 = ML.stratified_split(p.repartition(1), "id", "y_true").where("is_test").count()
    s2 = ML.stratified_split(p.repartition(17), "id", "y_true").where("is_test").count()
    assert s1 == s2


def test_split_preserves_class_shares(spark):
    lab = tables.read_table(spark, SF_ORACLE, "labels")
    sp = ML.stratified_split(lab, "doc_id", "toxic")
    for r in sp.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == int(np.floor(r["n"] * 0.2 + 0.5))


def test_smote_points_lie_on_segments(spark):
    m = tables.minority(spark, SF_SMALL)
    s = N.smote(m, "y").where("synthetic")
    mino = np.array([r[0] for r in m.where("y = 1").select("embedding").collect()])
    pts = np.array([r[0] for r in s.select("embedding").limit(30).collect()])
    assert len(pts) > 0
    for x in pts:
        # some pair (a, b) of minority rows with x = a + u (b - a), 0 <= u < 1
        d = mino[:, None, :] - mino[None, :, :]
        ok = False
        for i in range(len(mino)):
            diff = x - mino[i]
            for j in range(len(mino)):
                seg = mino[j] - mino[i]
                nn = seg @ seg
                if nn == 0:
                    continue
                u = (diff @ seg) / nn
                if -1e-9 <= u <= 1 + 1e-9 and np.allclose(mino[i] + u * seg, x, atol=1e-6):
                    ok = True
                    break
            if ok:
                break
        assert ok
    counts = dict(N.smote(m, "y").groupBy("y").count().collect())
    assert counts[1] == counts[0]


def test_knn_matches_brute_force(spark):
    e = tables.embeddings(spark, SF_SMALL).limit(200)
    got = {(r[0], r[1]) for r in N.knn(e, e, 3, n_pivots=6).select("vec_id", "nbr_id").collect()}
    rows = e.select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in rows])
    X = np.array([r[1] for r in rows])
    d = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = set()
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[:3]
        want |= {(ids[i], ids[j]) for j in order}
    assert got == want


def test_bootstrap_interval_contains_accuracy(spark):
    p = tables.predictions(spark, SF_SMALL).select("y_true", F.col("pred_a").alias("y_pred"))
    acc = M.prf_weighted(p).first()["accuracy"]
    r = S.bootstrap_ci(p, n=300).first()
    assert r["low"] <= acc <= r["high"]
    n = p.count()
    half = 1.96 * np.sqrt(acc * (1 - acc) / n)
    assert r["high"] - r["low"] == pytest.approx(2 * half, rel=0.25)


def test_text_models_beat_majority(spark):
    """Held-out: accuracy no worse than the majority class, and the model score ranks
    toxic texts above the rest (AUC > 0.5, the majority baseline's AUC)."""
    for kind in ("tfidf_logreg", "tfidf_svm"):
        pr = QUERIES[kind](spark, SF_ORACLE)
        acc = pr.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]
        base = pr.groupBy("y_true").count().agg(F.max("count") / F.sum("count")).first()[0]
        auc = M.roc_auc(pr, "y_true", "score").first()[0]
        assert acc >= base and auc > 0.6, (kind, acc, base, auc)


def test_calibrated_brier_not_worse(spark):
    p = QUERIES["platt_calibration"](spark, SF_SMALL)
    r = p.agg(F.avg((F.col("p_calibrated") - F.col("y_true")) ** 2).alias("c"),
              F.avg((F.col("p_uncalibrated") - F.col("y_true")) ** 2).alias("u")).first()
    assert r["c"] <= r["u"] + 0.02


@pytest.mark.parametrize("name", ["revenue_impact", "absa_extract", "feature_table", "remove_duplicates", "roc_auc",
                                  "average_precision", "tfidf", "stratified_split", "smote_neighbors"])
def test_plans_have_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in ("aspect_lexicon_join",)
