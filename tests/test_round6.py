"""Findings of the fourth round."""

import pickle
import random
import re

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.llm import licenses, ngram_join
from revlens.operators import forest as forest_module
from revlens.operators import models as ML
from revlens.operators import stats as S
from revlens.operators.lexicon import LexiconScorer
from revlens.operators.tree_shap import forest_shap
from revlens.plans import q_metrics as Q


# --- F1 ---------------------------------------------------------------------
def test_near_copy_tiles_get_only_rows_that_can_link(spark, monkeypatch):
    """Unlike rows that a block ties together are not sent to its tiles, and rows whose sizes are
    too far apart do not meet; the links are those of the whole block."""
    rnd, kept = random.Random(3), {}
    was = ngram_join.cut
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    monkeypatch.setattr(ngram_join, "SLICE_ENTRIES", 700)
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: kept.setdefault(name, was(df, name)))
    words = {i: [f"r{i}-{k}" for k in range(30 + i % 50)] for i in range(120)}                       # unlike
    copies = {}
    for c, size in enumerate((20, 60, 200)):                                                         # near copies of three sizes
        text = [f"c{c}-{k}" for k in range(size)]
        for k in range(14):
            own = list(text)
            own[rnd.randrange(size)] = f"x{k}"
            words[1000 + 20 * c + k] = own
            copies.setdefault(c, []).append(1000 + 20 * c + k)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    heads = spark.createDataFrame([(i, i, len(w)) for i, w in words.items()], "doc_id long, head long, n long")
    group = spark.createDataFrame([(i, 0) for i in words], "node long, component long")
    links = [(r["src"], r["dst"]) for r in ngram_join._multiply(rows, heads, group, 1, ngram_join.Bound(80, 100)).collect()]
    parent = {i: i for i in words}
    for a, b in links:
        parent = {k: parent[a] if v == parent[b] else v for k, v in parent.items()}
    assert {i: len({parent[i] for i in own}) for i, own in copies.items()} == {0: 1, 1: 1, 2: 1}
    assert len({parent[i] for i in words}) == 120 + 3
    tiles = kept["jaccard-tiles"].select("doc_id", F.size("tiles").alias("k")).collect()
    assert {r["doc_id"] for r in tiles} == {i for own in copies.values() for i in own}
    assert max(r["k"] for r in tiles) <= 4      # 14 rows of one size: four parts; the whole block of 162 rows would be 41


# --- F3, F4, F5 ---------------------------------------------------------------
def _blobs(spark, n=600, parts=3):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.6) ^ (rng.random(n) < 0.03)).astype(int)
    rows = [(int(i), [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, v array<double>, y int").withColumn("features", array_to_vector("v")).repartition(parts)


def test_forest_is_written_not_collected(spark, monkeypatch):
    """Trees are rows of a table; the model object holds thresholds and weights only."""
    monkeypatch.setattr(forest_module, "MOST_NODES", 0)
    df = _blobs(spark)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    forest = ML.random_forest(train, "features", "y", num_trees=40)
    assert len(pickle.dumps([forest.thresholds, forest.weights])) < 10_000 and forest.trees.count() == 40
    p = forest.transform(test).select("id", "y", "prediction", vector_to_array("probability").alias("p")).collect()
    theirs = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=40, maxDepth=30, seed=1).fit(train).transform(test)
    accuracy, other = sum(r["y"] == r["prediction"] for r in p) / len(p), theirs.where("prediction = y").count() / len(p)
    assert len(p) == 150 and accuracy > 0.8 and accuracy > other - 0.05
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and r["prediction"] == float(r["p"][1] > r["p"][0]) for r in p)
    # grown to pure leaves: a tree's own rows are told apart, and the layout of the rows does not matter
    again = ML.random_forest(train.repartition(7), "features", "y", num_trees=40)
    assert {r["tree"]: bytes(r["feature"]) for r in again.trees.collect()} == {r["tree"]: bytes(r["feature"]) for r in forest.trees.collect()}
    assert forest.transform(train).where("prediction = y").count() > 0.97 * 450


def test_forest_best_split_by_brute_force():
    rng = np.random.default_rng(2)
    codes, y = rng.integers(0, 6, size=(200, 3)).astype(np.uint8), rng.integers(0, 3, 200).astype(np.uint8)
    weights = np.array([1.0, 0.5, 2.0])
    (_, feature, code, left, counts), = forest_module.grow(codes, y, weights, [5], 3, 3, 11)
    times = np.random.default_rng([11, 5]).poisson(1.0, 200)

    def score(rows):
        w = np.array([times[rows & (y == c)].sum() * weights[c] for c in range(3)])
        return (w ** 2).sum() / w.sum() if w.sum() else 0.0

    at = {0: np.ones(200, bool)}
    for k in range(len(feature)):
        rows = at[k]
        assert [times[rows & (y == c)].sum() for c in range(3)] == list(counts[k])
        if feature[k] >= 0:
            best = max(score(rows & (codes[:, f] <= c)) + score(rows & (codes[:, f] > c)) for f in range(3) for c in range(6) if 0 < (times[rows] * (codes[rows, f] <= c)).sum() < times[rows].sum())
            side = codes[:, feature[k]] <= code[k]
            assert abs(score(rows & side) + score(rows & ~side) - best) < 1e-9
            at[left[k]], at[left[k] + 1] = rows & side, rows & ~side
    assert (feature >= 0).sum() > 3


def test_shapley_values_of_the_written_forest_add_up(spark, monkeypatch):
    monkeypatch.setattr(forest_module, "MOST_NODES", 0)
    df = _blobs(spark, 200).cache()
    forest = ML.random_forest(df, "features", "y", num_trees=5, max_depth=4)
    values, base = forest_shap(forest, df, "id")
    got = {r["id"]: r["s"] for r in values.groupBy("id").agg(F.sum("shapley").alias("s")).collect()}
    p = {r["id"]: r["p"] for r in forest.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert len(got) == 200 and all(abs(base + got[i] - p[i]) < 1e-6 for i in p)


def test_small_forests_and_rows_beyond_a_task_go_to_the_distributed_forest(spark, monkeypatch):
    df = _blobs(spark, 100)
    assert ML.random_forest(df, "features", "y", num_trees=3, max_depth=3).getNumTrees == 3
    assert ML.random_forest(df, "features", "y", num_trees=3).getNumTrees == 3
    monkeypatch.setattr(forest_module, "MOST_NODES", 0)
    assert isinstance(ML.random_forest(df, "features", "y", num_trees=3), forest_module.Forest)
    monkeypatch.setattr(forest_module, "TASK_BYTES", 100)
    assert ML.random_forest(df, "features", "y", num_trees=3).getNumTrees == 3


# --- F8, F9, F10 ----------------------------------------------------------------
def test_long_runs_do_not_overflow_the_stack(spark):
    """One run of 30,000 capitalised words, one number of 30,000 parts."""
    d = spark.createDataFrame([("Aa " * 30_000,), ("x Bb Cc. Dd ee Ff Gg",), ("1" + ".1" * 30_000 + " two 3,5 a1.5b 7/8x 9٣",)], "t string")
    got = [(r["e"], r["n"]) for r in d.select(T.entity_count("t").alias("e"), T.number_tokens("t").alias("n")).collect()]
    assert got == [(1, 0), (2, 0), (0, 4)]


def test_lexicon_rows_stay_within_generated_code(spark):
    """The tokens' generator holds no lambda, and a large lexicon's join gives the same scores."""
    rows = [(1, "not very good bad"), (2, None), (3, "good"), (4, "plain words"), (None, "very bad not good"), (3, "good")]
    lex = spark.createDataFrame([("good", 2.0, 0.5, 0.4), ("bad", -1.5, -0.7, 0.6)], "token string, valence double, polarity double, subjectivity double")
    df, booster = spark.createDataFrame(rows, "id long, t string"), {"very": 0.3}
    small = LexiconScorer(lex, ["not"], booster, lexicon_rows=2).intensity(df, ["id"], "t")
    large = LexiconScorer(lex, ["not"], booster, lexicon_rows=10 ** 9).intensity(df, ["id"], "t")
    assert "lambda" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.count() == 5


def test_syllables_and_complex_words_by_hand(spark):
    words = ["banana", "bcd", "aerial", "x", "yearly", "umbrella", "été", "Übung", "beautifully", "aaa", "ia-io", "queue", "a", "ñandú"]
    rng = random.Random(1)
    texts = [rng.choice(["", " ", "1"]) + rng.choice([" ", ", ", "4", ". "]).join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)]
    groups = lambda word: len(re.findall("[aeiouy]+", word))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.readability("t").alias("r")).collect():
        own = re.findall(r"[^\W\d_]+", r["t"].lower())
        s = max(1, len(re.findall("[.!?]", r["t"])))
        syllables, hard = sum(max(1, groups(x)) for x in own), sum(groups(x) > 2 for x in own)
        assert abs(r["r"]["flesch_kincaid_grade"] - (0.39 * len(own) / s + 11.8 * syllables / len(own) - 15.59)) < 1e-9
        assert abs(r["r"]["gunning_fog"] - 0.4 * (len(own) / s + 100 * hard / len(own))) < 1e-9


# --- F7 ---------------------------------------------------------------------
def test_bootstrap_draws_once_for_metrics_and_ranks(spark):
    df = spark.range(700).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3 == 0).cast("int").alias("pred"), ((F.col("id") * 7 % 11 + F.col("id") % 2) / 12).alias("p"))
    df, drawn = df.unionAll(df.limit(50)), []

    def uniform(key, replicate, seed):
        drawn.append(1)
        return S.hash_uniform(key, replicate, seed)

    metrics = {"accuracy": S.weighted_accuracy("y", "pred"), "ece": S.weighted_ece("y", "p")}
    got = {r["metric"]: r for r in S.bootstrap_rows(df, ["id"], metrics, n=12, ranked=("y", "p"), block=6, uniform=uniform).collect()}
    assert len(drawn) == 2      # once a block
    key = F.concat_ws("-", "id")
    apart = S.intervals(S.replicate_values(df, key, metrics, 12).unionByName(S.ranked_replicate_values(df, key, "y", "p", 12)))
    for r in apart.collect():
        assert all(abs(got[r["metric"]][c] - r[c]) < 1e-12 for c in ("low", "high", "mean"))
    with_key = S.bootstrap_rows(df, ["id"], {"ids": lambda w: F.sum(w * F.col("id")) / F.sum(w)}, n=3, ranked=("y", "p"), block=3)
    assert {r["metric"] for r in with_key.collect()} == {"ids", "roc_auc", "average_precision"}


def test_md5_digits_draw_the_numbers_of_the_sql(spark):
    d = spark.range(3000).select(Q.md5_uniform(F.col("id").cast("string"), F.lit(3), 42).alias("u"))
    for r in d.select("u", S.poisson_weight(F.col("u"), Q.md5_uniform.steps).alias("w")).collect():
        assert r["w"] == sum(int(r["u"][:8], 16) / 2 ** 32 >= p for p in S._POISSON)


def test_a_draw_is_made_once(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3 == 0).cast("int").alias("pred"))
    values = S.replicate_values(df, F.col("id").cast("string"), {"accuracy": S.weighted_accuracy("y", "pred")}, n=30, uniform=Q.md5_uniform)
    assert values._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


# --- F11 --------------------------------------------------------------------
def test_stacking_reads_the_widths_in_one_pass(spark, monkeypatch):
    rows = [(k, k % 2, [0.3 + 0.4 * (k % 2), 0.5], [float(k % 3), 0.1, float(k % 5)]) for k in range(60)]
    df, jobs = spark.createDataFrame(rows, "id long, y int, a array<double>, b array<double>"), []
    was = type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: jobs.append(1) or was(self))
    model = ML.stacking_fit(df, ["a", "b"], "y")
    assert len(jobs) == 1 and model.stages[-1].numFeatures == 5
    assert model.transform(df).where("prediction = y").count() == 60


# --- F2 ---------------------------------------------------------------------
def test_licence_words_are_cut_once_a_unit(spark):
    """The filter on the word pairs goes below the projections; it must not take the cutting of
    a unit into the lambda over its pairs."""
    d = spark.createDataFrame([(1, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), (2, "none")], "doc_id long, text string")
    found = licenses.scan(d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"concat_ws\( , element_at\(split\(", plan)
    assert [(r["doc_id"], r["license"], r["dice"]) for r in found.collect()] == [(1, "BSD-3-Clause", 1.0)]
