"""Hashed neighbours, exact quantiles, tree Shapley values, row bootstrap, post-hoc test,
indexed aspect mapping, linear explanations, kept results, time split, behaviour model."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from revlens.operators import absa as A
from revlens.operators import augment as AU
from revlens.operators import explain as X
from revlens.operators import lsh
from revlens.operators import models as ML
from revlens.operators import neighbors as N
from revlens.operators import stats as S
from revlens.operators.lexicon import LexiconScorer
from revlens.operators.quantiles import exact_quantiles, order_statistics
from revlens.operators.tree_shap import forest_shap, node_table
from revlens.plans.registry import QUERIES, load_all
from revlens.sources import tables
from tests.conftest import SF_SMALL

load_all()


# ---------------------------------------------------------------- neighbours

def clustered(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 20), dim)) * 4
    return [(int(i), int(i % 3), [float(v) for v in centres[i % len(centres)] + rng.normal(size=dim) * 0.2]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def recall(got, want):
    return len(set(got) & set(want)) / len(want)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("vec_id", "nbr_id").collect()]


def brute(rows, k, unlike=False):
    x, ids, y = np.array([r[2] for r in rows]), [r[0] for r in rows], [r[1] for r in rows]
    out = []
    for i in range(len(rows)):
        d = np.sqrt(((x - x[i]) ** 2).sum(-1))
        ok = [j for j in range(len(rows)) if ids[j] != ids[i] and (not unlike or y[j] != y[i])]
        out += [(ids[i], ids[j]) for j in sorted(ok, key=lambda j: (d[j], ids[j]))[:k]]
    return out


def test_lsh_finds_neighbours_in_clusters(spark):
    rows = clustered(1_500)
    df = frame(spark, rows)
    assert recall(pairs(N.lsh_knn(df, df, 5)), brute(rows, 5)) >= 0.9
    assert recall(pairs(N.nearest_unlike_neighbor(df, "label")), brute(rows, 1, True)) >= 0.9
    tables_ = lsh.prepare(df, df, 5, "vec_id", "embedding", None, 0.95, 7)[2]
    assert tables_.per_table > 0


def test_lsh_compares_about_in_proportion(spark):
    small, large = (frame(spark, clustered(n)) for n in (1_500, 6_000))
    a, b = lsh.pairs_compared(small, small, 5), lsh.pairs_compared(large, large, 5)
    assert b < 0.1 * 6_000 ** 2 and b < 8 * a          # four times the rows; all pairs would be 16 times


def test_lsh_recall_on_the_test_vectors(spark):
    exact, found = pairs(QUERIES["nearest_unlike_neighbor"](spark, SF_SMALL)), pairs(QUERIES["nearest_unlike_neighbor_lsh"](spark, SF_SMALL))
    assert recall(found, exact) >= 0.9
    assert recall(pairs(QUERIES["smote_neighbors_lsh"](spark, SF_SMALL)), pairs(QUERIES["smote_neighbors"](spark, SF_SMALL))) >= 0.9
    s = tables.embeddings(spark, SF_SMALL).select("vec_id", "embedding", F.col("embedding")[1].alias("p"))
    a, b = (N.counterfactual(s, "p", target_threshold=0.05, method=m) for m in ("exact", "lsh"))
    key = lambda d: {(r["vec_id"], r["counterfactual_id"]) for r in d.collect()}
    assert recall(key(b), key(a)) >= 0.9


def test_lsh_splits_hot_buckets_and_loses_nothing(spark, monkeypatch):
    """A third of all rows is one point: its bucket is cut into blocks, ties go to small ids."""
    monkeypatch.setattr(lsh, "MOST_ROWS", 50)
    rows = clustered(600)
    rows = [(i, y, rows[0][2] if i % 3 == 0 else v) for i, y, v in rows]
    df = frame(spark, rows)
    got = pairs(N.lsh_knn(df, df, 4))
    assert recall(got, brute(rows, 4)) >= 0.9 and {b for a, b in got if a == 597} == {0, 3, 6, 9}


def test_lsh_odd_rows(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, None), (4, 1, []), (5, 1, [math.nan, 0.0]), (6, 1, [1.0, 2.0, 3.0]), (None, 1, [0.0, 0.1]), (7, 1, [0.0, None]), (8, 1, [5.0, 5.0])]
    df = frame(spark, rows)
    got = {(r["vec_id"], r["nbr_id"], r["rank"]) for r in N.lsh_knn(df, df, 2).collect()}
    assert got == {(1, 2, 1), (1, 8, 2), (2, 1, 1), (2, 8, 2), (8, 2, 1), (8, 1, 2)}
    assert N.lsh_knn(df.limit(0), df, 2).count() == N.lsh_knn(df, df.limit(0), 2).count() == 0


# ---------------------------------------------------------------- quantiles, time split

def test_exact_quantiles(spark, monkeypatch):
    from revlens.operators import quantiles
    rng = random.Random(2)
    probs = [0, 0.01, 0.25, 0.5, 0.77, 0.99, 1]
    for values in ([rng.gauss(0, 1) for _ in range(30_000)], [rng.choice([1.0, 2.0, 7.5]) for _ in range(9_000)], [1e300, -1e300, 0.0, 5e-324, 1e-300] * 900 + [3.0] * 4_000,
                   [4.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,), (math.inf,)], "x double")
        assert exact_quantiles(df, "x", probs) == pytest.approx([float(np.quantile(values, p)) for p in probs], rel=1e-12)
    monkeypatch.setattr(quantiles, "FETCHED", 1)
    ints = spark.range(5_000).select((F.col("id") % 777).alias("x"))
    assert order_statistics(ints, "x", [0, 2_500, 4_999]) == {0: 0.0, 2_500: float(sorted(k % 777 for k in range(5_000))[2_500]), 4_999: 776.0}
    assert exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_no_test_row_is_older(spark):
    df = spark.createDataFrame([(k, None if k % 50 == 0 else float(k * 7919 % 97)) for k in range(1_000)], "id long, t double")
    sp = ML.temporal_split(df, "t", 0.3)
    newest, oldest = sp.where("NOT is_test").agg(F.max("t")).first()[0], sp.where("is_test").agg(F.min("t")).first()[0]
    assert sp.count() == 1_000 and newest < oldest
    assert abs(sp.where("is_test").count() - 0.3 * 980) <= 11 and sp.where("t IS NULL AND is_test").count() == 0
    assert ML.temporal_split(df.limit(0), "t").count() == 0


# ---------------------------------------------------------------- Shapley values of forests

def test_tree_shapley_adds_up_and_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype(int)
    df = spark.createDataFrame([(int(i), [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    df = df.withColumn("features", array_to_vector("v")).cache()
    for est in (RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=4, maxDepth=6, seed=5), DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=5)):
        model = est.fit(df)
        values, base = forest_shap(model, df, "id", names=list("abcde"))
        got = {}
        for r in values.collect():
            got.setdefault(r["id"], {})[r["feature"]] = r["shapley"]
        p = {r["id"]: r["p"] for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
        assert all(base + sum(got[i].values()) == pytest.approx(p[i], abs=1e-6) for i in p) and len(got) == 400
        trees = {}
        for r in node_table(model, spark).collect():
            trees.setdefault(r["tree"], {})[r["id"]] = r

        def value(tree, row, known, k=0):
            n = tree[k]
            if n["left"] < 0:
                return n["stats"][1] / sum(n["stats"])
            if n["feature"] in known:
                return value(tree, row, known, n["left"] if row[n["feature"]] <= n["threshold"] else n["right"])
            return sum(value(tree, row, known, c) * sum(tree[c]["stats"]) for c in (n["left"], n["right"])) / sum(n["stats"])

        for i in (0, 7, 123):
            v = {s: np.mean([value(t, x[i], s) for t in trees.values()]) for k in range(6) for s in itertools.combinations(range(5), k)}
            for j, name in enumerate("abcde"):
                want = sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / 120 * (v[tuple(sorted((*s, j)))] - v[s]) for s in v if j not in s)
                assert got[i][name] == pytest.approx(want, abs=1e-9)


# ---------------------------------------------------------------- statistics

def test_row_bootstrap_interval(spark):
    """Accuracy: the analytic interval and the one from cells; AUC: Hanley and McNeil."""
    n = 4_000
    df = spark.range(n).select("id", F.when(F.col("id") % 5 < 3, 1).otherwise(0).alias("y"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("h"))
    df = df.select("id", "y", F.when(F.col("h") < 800, F.col("y")).otherwise(1 - F.col("y")).alias("pred"), ((F.col("h") + 300 * F.col("y")) / 1300).alias("p"))
    r = {x["metric"]: x for x in S.bootstrap_rows(df, ["id"], {"accuracy": S.weighted_accuracy("y", "pred")}, n=200, ranked=("y", "p"), block=100).collect()}
    acc = df.agg(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0]
    half = 1.96 * math.sqrt(acc * (1 - acc) / n)
    assert r["accuracy"]["mean"] == pytest.approx(acc, abs=half / 3)
    assert r["accuracy"]["high"] - r["accuracy"]["low"] == pytest.approx(2 * half, rel=0.25)
    cells = S.bootstrap_ci(df.select(F.col("y").alias("y_true"), F.col("pred").alias("y_pred")), n=300).first()
    assert r["accuracy"]["high"] - r["accuracy"]["low"] == pytest.approx(cells["high"] - cells["low"], rel=0.35)
    from revlens.operators.metrics import average_precision, roc_auc
    auc, ap = roc_auc(df, "y", "p").first()[0], average_precision(df, "y", "p").first()[0]
    assert r["roc_auc"]["low"] < auc < r["roc_auc"]["high"] and r["average_precision"]["low"] < ap < r["average_precision"]["high"]
    q1, q2, pos, neg = auc / (2 - auc), 2 * auc * auc / (1 + auc), 0.6 * n, 0.4 * n
    se = math.sqrt((auc * (1 - auc) + (pos - 1) * (q1 - auc ** 2) + (neg - 1) * (q2 - auc ** 2)) / (pos * neg))
    assert r["roc_auc"]["high"] - r["roc_auc"]["low"] == pytest.approx(2 * 1.96 * se, rel=0.3)


# Published critical values of the two-tailed test at 0.05, times the root of 2.
@pytest.mark.parametrize("k,q", [(2, 1.960), (3, 2.343), (4, 2.569), (5, 2.728), (6, 2.850), (7, 2.949), (8, 3.031), (9, 3.102), (10, 3.164)])
def test_studentized_range(k, q):
    assert S.studentized_range_quantile(0.05, k) / math.sqrt(2) == pytest.approx(q, abs=1e-3)


def test_nemenyi_pairs(spark):
    rows = [(f, m, s + 0.001 * f) for f in range(12) for m, s in (("a", 0.9), ("b", 0.8), ("c", 0.8))]
    got = {(r["model_a"], r["model_b"]): r for r in S.nemenyi(spark.createDataFrame(rows, "fold int, model string, score double")).collect()}
    assert got["a", "b"]["rank_diff"] == pytest.approx(1.5) and got["a", "b"]["significant"] and got["b", "c"]["p_value"] == pytest.approx(1.0)
    assert got["a", "b"]["critical"] == pytest.approx(2.343 * math.sqrt(12 / 72), abs=1e-3)
    with pytest.raises(ValueError):
        S.nemenyi(spark.createDataFrame(rows[:-1], "fold int, model string, score double"))


# ---------------------------------------------------------------- aspects

def test_indexed_mapping_equals_all_pairs(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choices("abcdé", k=n))
    terms = [word(rnd.randint(1, 40)) for _ in range(400)] + [None, "", "a"]
    seeds = [(f"x{k % 7}", k % 7, word(rnd.randint(1, 6))) for k in range(300)] + [("x0", 0, ""), ("x1", 1, None)]
    lex = spark.createDataFrame(seeds, "aspect string, aspect_ord int, seed string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "id long, candidate string")
    for some in (lex, lex.where("length(seed) > 2"), lex.limit(0)):
        held = [tuple(r) for r in some.collect()]
        want = sorted({(i, a) for i, t in enumerate(terms) if t is not None for a, _, s in held if s is not None and s in t})
        df = A.map_to_aspects(rows, some)
        assert sorted((r["id"], r["aspect"]) for r in df.collect()) == want
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["id"] for r in A.unmapped_candidates(rows, some).collect()) == sorted(set(range(len(terms))) - {i for i, _ in want})


def test_vectors_only_for_unmapped_strings(spark):
    terms = spark.createDataFrame([("cheap price",), ("odd thing",), ("far thing",), ("no vector",)], "candidate string")
    lex = spark.createDataFrame([("cost", 0, "price")], "aspect string, aspect_ord int, seed string")
    vec = spark.createDataFrame([("cheap price", [0.0, 1.0]), ("odd thing", [0.1, 0.9]), ("far thing", [-1.0, 0.0])], "candidate string, embedding array<double>")
    protos = spark.createDataFrame([("cost", 0, [1.0, 0.0]), ("look", 1, [0.0, 1.0])], "aspect string, aspect_ord int, embedding array<double>")
    got = {(r["candidate"], r["aspect"]) for r in A.terms_with_vectors(terms, lex, vec, protos, 0.55).collect()}
    assert got == {("cheap price", "cost"), ("odd thing", "look")}


def test_token_labels_equal_brute_force(spark):
    texts = [(1, "The great big box of the Great big box boxes"), (2, None), (3, "big"), (4, "x " * 5_000 + "great big box")]
    mapped = [(1, "great big box", "size", 1), (1, "box", "pack", 0), (3, "great", "size", 1), (4, "great big box", "size", 1), (2, "box", "pack", 0)]
    got = {(r[0], r[1]): (r["token"], r["label"]) for r in A.token_labels(spark.createDataFrame(texts, "review_id long, review_text string"),
           spark.createDataFrame(mapped, "review_id long, candidate string, aspect string, aspect_ord int")).collect()}
    want = {}
    for i, t in texts:
        at, low = 0, (t or "").lower()
        spans = [(-len(c), o, m, m + len(c), a) for j, c, a, o in mapped if j == i for m in range(len(low)) if low.startswith(c, m)]
        for k, w in enumerate(low.split()):
            at = low.index(w, at)
            own = min(((s[0], s[1], s[2], s[4]) for s in spans if s[2] <= at and at + len(w) <= s[3]), default=None)
            want[i, k] = (w, "O" if own is None else ("B-" if at == own[2] else "I-") + own[3])
            at += len(w)
    assert got == want and got[1, 1][1] == "B-size" and got[1, 9][1] == "O"


# ---------------------------------------------------------------- explanations

def test_linear_explanation_equals_rescoring(spark):
    rnd = random.Random(6)
    words = ["was", "from", "that", "this", "idiot", "hable", "anth", "ention", "clown", "x", "y", "z"]
    texts = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 25)))) for k in range(60)] + [(99, None), (100, "was was was was hable"), (101, "hable that that that that hable")]
    df = spark.createDataFrame(texts, "id long, text string")
    scorer = LexiconScorer.fixture(spark)
    a = {(r["id"], r["word"]): (round(r["delta"], 9), r["rank"]) for r in X.leave_one_word_out(df, "id", "text", scorer, 5).collect()}
    b = {(r["id"], r["word"]): (round(r["delta"], 9), r["rank"]) for r in X._rescored(df, "id", "text", scorer, 5).collect()}
    assert a == b and len(a) > 200


def test_explanations_of_a_very_long_text(spark):
    rnd = random.Random(7)
    text = " ".join(rnd.choices([f"w{k}" for k in range(9_000)] + ["idiot", "was", "hable"] * 300, k=50_000))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    top = X.leave_one_word_out(df, "id", "text", LexiconScorer.fixture(spark), 3).collect()
    assert len(top) == 3 and {r["word"] for r in top} <= {"idiot", "was", "hable"}
    got = X.lime_text(df, ["id"], "text", LexiconScorer.fixture(spark), num_samples=20, top=3).collect()
    assert len(got) == 3 and all(math.isfinite(r["weight"]) for r in got)


def test_lexicon_scorer_has_no_words_of_its_own(spark):
    lex = spark.createDataFrame([("good", 2.0, 0.5, 0.5)], "token string, valence double, polarity double, subjectivity double")
    df = spark.createDataFrame([(1, "was good"), (2, "good")], "id long, t string")
    got = {r["id"]: r["vader_compound"] for r in LexiconScorer(lex).intensity(df, ["id"], "t").collect()}
    assert got[1] == got[2] > 0


# ---------------------------------------------------------------- kept results, behaviour model

def test_kept_results_are_not_made_again(spark, tmp_path):
    log, kept = str(tmp_path / "calls"), str(tmp_path / "kept")
    open(log, "w").close()

    def shout(t):
        with open(log, "a") as f:
            f.write(t + "\n")
        if t == "bad":
            raise ValueError(t)
        return t.upper()

    def run(rows, **kw):
        open(log, "w").close()
        out = AU.apply_text_fn(spark.createDataFrame(rows, "id long, t string"), "id", "t", shout, kept=kept, failed_col="failed", **kw).collect()
        return {r["id"]: (r["text_out"], r["failed"]) for r in out}, sorted(open(log).read().split("\n")[:-1])

    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)]
    want = {1: ("A", False), 2: ("B", False), 3: ("A", False), 4: ("bad", True), 5: ("", False)}
    assert run(rows) == (want, ["", "a", "b", "bad"])
    assert run(rows) == (want, ["bad"])                                   # only the failure is tried again
    assert run([*rows, (6, "c")])[1] == ["bad", "c"]
    assert run(rows, version="2")[1] == ["", "a", "b", "bad"]
    held = spark.read.parquet(f"{kept}/version=1/part=*")
    assert held.count() == held.select("text_key").distinct().count() == 4


def test_behaviour_model_learns_from_features(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), float(a), float(b), None if i % 40 == 0 else float(c), int(a + b > 0.8)) for i, (a, b, c) in enumerate(rng.normal(size=(500, 3)))]
    df = spark.createDataFrame(rows + [(900, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y int")
    report, pred = ML.behavior_model(df, ["a", "b", "c"], "y", "id", num_trees=15)
    p = pred.collect()
    accuracy = sum(r["y_true"] == r["y_pred"] for r in p) / len(p)
    majority = max(sum(r["y_true"] == k for r in p) for k in (0, 1)) / len(p)
    assert len(p) == pytest.approx(100, abs=2) and accuracy > majority + 0.05
    assert {r["label"] for r in report.collect()} == {"0", "1", "macro avg", "weighted avg"}
