"""Models (ML1-ML5, ML10-ML14): baselines, TF-IDF, splits, ensembles, scaling, segments.

Learning uses ``pyspark.ml`` estimators (distributed fitting); everything that
is a closed-form statistic (TF-IDF weights, majority class, z-scores, voting) is
plain relational code so it can be checked against SQL.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRestModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer,
                                SQLTransformer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from revlens.functions import text as T
from revlens.operators.lexicon import bounded_broadcast
from revlens.operators.squared_hinge import squared_hinge_svm

MAX_BROADCAST_BUCKETS = 1_000_000
FLUSH_TERMS = 200_000     # terms held by a task before they are handed on
TASK_CHARS = 32 << 20     # characters of the texts whose features a task reads in a pass
TOKEN = r"[\p{L}\p{N}_]{2,}"   # fixed value: tokens of two or more word characters


# --- ML1 --------------------------------------------------------------------
def majority_label(df: DataFrame, y: str) -> Column:
    """Most frequent label (ties -> smallest) as a scalar-subquery column."""
    top = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return top.select("label").scalar()


def majority_baseline(df: DataFrame, y: str, id_cols: Sequence[str]) -> DataFrame:
    """ML1: predict the majority class for every row."""
    return df.select(*id_cols, F.col(y).alias("y_true"), majority_label(df, y).alias("y_pred"))


# --- ML2 --------------------------------------------------------------------
def tfidf(df: DataFrame, id_col: str, text_col: str, max_features: int = 50_000, min_df: int = 2) -> DataFrame:
    """ML2, relational form of the smoothed, L2-normalised TF-IDF:
    idf = ln((1 + n) / (1 + df)) + 1; vocabulary = terms with df >= min_df, the
    ``max_features`` most frequent in the corpus (ties by term).  Long output
    (id, term, tf, weight).

    Plan: the texts of an id meet in one row (one shuffle of texts); the terms of a row are
    counted in its task (``_term_counts``), so that no (id, term) row is ever sorted or
    spilled.  Only per-term df / totals, summed up before, are shuffled -> top-k vocabulary
    (bounded by max_features, broadcast) -> weights and norm, again within the row."""
    n_docs = df.select(F.count(F.lit(1)).cast("double")).scalar()
    tokens = F.transform("_texts", lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit(TOKEN), 0), " "))
    rows = df.select(id_col, T.as_text(text_col).alias("_text")).groupBy(id_col).agg(F.collect_list("_text").alias("_texts"))
    rows = rows.select(id_col, tokens.alias("_tokens"))
    stats = rows.select("_tokens").mapInArrow(_corpus_counts, "term string, df long, total long")
    stats = stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= min_df)
    vocab = stats.orderBy(F.desc("total"), "term").limit(max_features)
    idf = dict(vocab.select("term", F.log((1 + n_docs) / (1 + F.col("df"))) + 1).toPandas().itertuples(index=False))
    held = df.sparkSession.sparkContext.broadcast(idf)
    schema = StructType([rows.schema[id_col], StructField("term", StringType()), StructField("tf", LongType()), StructField("weight", DoubleType())])

    def weigh(batches):
        known = held.value
        for batch in batches:
            take, terms, tfs, weights = [], [], [], []
            for k, texts in enumerate(batch.column(1).to_pylist()):
                found = [(t, n, n * known[t]) for t, n in _term_counts(texts).items() if t in known]
                norm = math.sqrt(math.fsum(w * w for _, _, w in found))
                take += [k] * len(found)
                terms += [t for t, _, _ in found]
                tfs += [n for _, n, _ in found]
                weights += [w / norm for _, _, w in found]
                if len(take) >= FLUSH_TERMS:
                    yield _weighted(batch, take, terms, tfs, weights, schema)
                    take, terms, tfs, weights = [], [], [], []
            yield _weighted(batch, take, terms, tfs, weights, schema)

    return rows.mapInArrow(weigh, schema)


def _term_counts(texts: list[str]) -> Counter:
    """Occurrences of the tokens and token pairs in the texts of one id (tokens apart by a space)."""
    counts: Counter = Counter()
    for text in texts:
        tokens = text.split(" ") if text else []
        counts.update(tokens)
        counts.update(map("{} {}".format, tokens, tokens[1:]))
    return counts


def _corpus_counts(batches):
    """(term, df, total) of the rows read, in parts of about ``FLUSH_TERMS`` terms."""
    total: Counter = Counter()
    held: Counter = Counter()

    def part():
        terms = list(total)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[t] for t in terms], pa.int64()), pa.array(list(total.values()), pa.int64())],
                                          names=["term", "df", "total"])

    for batch in batches:
        for texts in batch.column(0).to_pylist():
            counts = _term_counts(texts)
            total.update(counts)
            held.update(counts.keys())
            if len(total) >= FLUSH_TERMS:
                yield part()
                total.clear()
                held.clear()
    yield part()


def _weighted(batch, take, terms, tfs, weights, schema) -> pa.RecordBatch:
    ids = batch.column(0).take(pa.array(take, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(weights, pa.float64())], names=schema.names)


def token_stages(text_col: str = "review_text") -> list:
    """Stages from a text to its tokens and token pairs, ``_terms``."""
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_tok", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__"),
    ]


def fit_tfidf(train: DataFrame, text_col: str = "review_text", max_features: int = 50_000,
              min_df: int = 2) -> PipelineModel:
    """ML form of ML2: tokens and pairs -> counts -> tf * idf with the smoothed '+1' idf ->
    L2-normalised, column ``features``.

    Terms are counted in the tasks (``_corpus_counts``), only per-task sums are shuffled, and
    the vocabulary comes with its idf from one pass over the texts (ties by term)."""
    stages = token_stages(text_col)
    tokens = stages[0].transform(train).select(F.array(F.array_join("_tok", " ")).alias("_tokens"))
    n_docs = train.count()
    stats = tokens.mapInArrow(_corpus_counts, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    # term "" stands for texts without tokens
    vocab = stats.where((F.col("df") >= min_df) & (F.col("term") != "")).orderBy(F.desc("total"), "term").limit(max_features).select("term", "df").toPandas()
    if vocab.empty:
        raise ValueError(f"no term stands in {min_df} texts or more")
    sc = train.sparkSession.sparkContext
    terms = sc._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(vocab["term"]))    # one call, not one a term
    counts = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", terms)
    idf = DenseVector([math.log((1 + n_docs) / (1 + x)) + 1 for x in vocab["df"]])
    return PipelineModel(stages=stages + [
        counts.setInputCol("_terms").setOutputCol("_tf"),
        ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_w"),
        Normalizer(p=2.0, inputCol="_w", outputCol="features"),
    ])


# --- ML3 / ML4 --------------------------------------------------------------------
def tfidf_classifier(train: DataFrame, label_col: str, text_col: str = "review_text", kind: str = "logreg",
                     max_features: int = 50_000) -> PipelineModel:
    """ML3 (kind='logreg': C = 1 -> regParam = 1/n, no standardisation, 300 iterations) or
    ML4 (kind='svm': linear SVM with squared hinge loss, C = 1; with more than two classes
    one model a class against the rest, labels 0 to k - 1)."""
    from revlens.session import materialize
    train = materialize(train.select(label_col, T.as_text(text_col).alias(text_col)))
    feat = fit_tfidf(train, text_col, max_features)
    x = materialize(feat.transform(train).select(label_col, "features"))     # no text, tokens or counts
    n, k, chars = train.select(F.count(F.lit(1)), F.count_distinct(label_col), F.sum(F.length(text_col))).first()
    # every task of a pass sends a vector of max_features: as many as cores, more only for large tasks
    x = x.coalesce(max(train.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // TASK_CHARS)))
    if kind == "logreg":
        est = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=300, regParam=1.0 / max(n, 1),
                                 elasticNetParam=0.0, standardization=False)
    else:
        models = [squared_hinge_svm(x.withColumn("_is", (F.col(label_col) == c).cast("int")), "features", "_is") for c in ([1] if k <= 2 else range(k))]
        clf = models[0] if k <= 2 else OneVsRestModel(models).setFeaturesCol("features")
        return PipelineModel(stages=feat.stages + [clf])
    return PipelineModel(stages=feat.stages + [est.fit(x)])


def positive_score(pred: DataFrame) -> Column:
    """Score for class 1: the probability when the model has one, else the raw margin (SVM)."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


# --- ML5 --------------------------------------------------------------------
def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2, seed: int = 42,
                     buckets_hex: int = 4) -> DataFrame:
    """ML5: exact stratified split.  Within each class, rows ordered by
    md5(id-seed) and the first round(test_size * n_class) go to test.

    No window over a whole class: the hash prefix (16^4 buckets) gives per-class
    bucket counts (bounded table), prefix sums over buckets locate the one
    boundary bucket per class, and only rows of that bucket are ranked
    (a window partitioned by class over ~1/65536 of the class)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    d = df.select("*", h.alias("_h"), F.conv(F.substring(h, 1, buckets_hex), 16, 10).cast("int").alias("_b"))
    cnt = d.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label_col).orderBy("_b")
    cum = cnt.select(label_col, "_b", "_n",
                     F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                     F.sum("_n").over(Window.partitionBy(label_col)).alias("_nc"))
    cum = cum.select(label_col, "_b", F.coalesce("_before", F.lit(0)).alias("_before"),
                     F.floor(F.col("_nc") * test_size + 0.5).alias("_k"), "_n")
    # bucket decision: all test / all train / boundary; table size <= classes x 65536
    decided = cum.select(label_col, "_b", "_before", "_k",
                         F.when(F.col("_before") + F.col("_n") <= F.col("_k"), F.lit("test"))
                         .when(F.col("_before") >= F.col("_k"), F.lit("train")).otherwise(F.lit("edge")).alias("_d"))
    decided = decided.withColumnsRenamed({label_col: "_label", "_b": "_bucket"})
    j = d.join(bounded_broadcast(decided, MAX_BROADCAST_BUCKETS), d[label_col].eqNullSafe(decided["_label"]) & (d["_b"] == decided["_bucket"]))   # a null label is a class
    plain = j.where(F.col("_d") != "edge").select(*df.columns, (F.col("_d") == "test").alias("is_test"))
    edge = j.where(F.col("_d") == "edge")
    rn = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", id_col))
    edge = edge.select(*df.columns, (rn <= F.col("_k") - F.col("_before")).alias("is_test"))
    return plain.unionByName(edge)


def temporal_split(df: DataFrame, time_col: str, test_size: float = 0.2) -> DataFrame:
    """Split by time: ``is_test`` marks the rows of the newest ``test_size`` of the table.  The
    cut-off is an exact quantile of the times (counting passes, no sort); rows of one time are on
    one side, the test's, so no test row is older than a training row.  Rows without a time
    train."""
    from revlens.operators.quantiles import finite, order_statistics
    n = finite(df, time_col).count()
    first = n - int(test_size * n + 0.5)
    cut = order_statistics(df, time_col, [first]).get(first) if n else None
    test = F.lit(False) if cut is None else F.coalesce(F.col(time_col).cast("double") >= cut, F.lit(False))
    return df.withColumn("is_test", test)


# --- ML10 / ML11 -------------------------------------------------------------------
def weighted_voting(df: DataFrame, prob_cols: Sequence[str], weights: Sequence[float]) -> Column:
    """ML10: weighted average of aligned probability arrays (weights normalised)."""
    tot = float(sum(weights))

    def scaled(c: str, w: float) -> Column:
        factor = F.lit(w / tot)
        return F.transform(F.col(c), lambda x: x * factor)

    acc = None
    for c, w in zip(prob_cols, weights):
        term = scaled(c, w)
        acc = term if acc is None else F.zip_with(acc, term, lambda a, b: a + b)
    return acc


def stacking_fit(df: DataFrame, prob_cols: Sequence[str], label_col: str) -> PipelineModel:
    """ML11: logistic regression (500 iterations) on the stacked probabilities."""
    # one pass for all widths: every pass works out the caller's frame again
    widths = df.select(*[F.max(F.size(c)) for c in prob_cols]).first()
    parts = [(c, i) for c, n in zip(prob_cols, widths) for i in range(n)]
    flat = SQLTransformer(statement="SELECT *, " + ", ".join(f"{c}[{i}] AS _{c}_{i}" for c, i in parts) + " FROM __THIS__")
    return Pipeline(stages=[flat, VectorAssembler(inputCols=[f"_{c}_{i}" for c, i in parts], outputCol="_stack"),
                            LogisticRegression(featuresCol="_stack", labelCol=label_col, maxIter=500)]).fit(df)


# --- ML12 / ML13 -------------------------------------------------------------------
def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """ML12: nulls -> 0, z-score with population std, constant column -> 0.
    Means and stds are one aggregate row."""
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    # one aggregated row (2 numbers per column), fetched once and used as literals
    row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    st = {k: F.lit(float(v) if v is not None else 0.0) for k, v in row.asDict().items()}
    return filled.select(*keep, *[
        F.when(st[f"s_{c}"] > 0, (F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"]).otherwise(F.lit(0.0)).alias(c)
        for c in cols])


def segment_customers(df: DataFrame, feature_cols: Sequence[str], id_cols: Sequence[str], n_clusters: int = 4,
                      seed: int = 42) -> DataFrame:
    """ML13: standardise, KMeans(k, seed); segment ids relabelled by centroid order
    (lexicographic on the centre coordinates) so they are stable across runs."""
    z = standardize(df, feature_cols, keep=id_cols)
    x = VectorAssembler(inputCols=list(feature_cols), outputCol="_x").transform(z)
    km = KMeans(k=n_clusters, seed=seed, featuresCol="_x", predictionCol="_seg", maxIter=50).fit(x)
    order = sorted(range(len(km.clusterCenters())), key=lambda i: tuple(km.clusterCenters()[i]))
    relabel = F.create_map(*[x for new, old in enumerate(order) for x in (F.lit(old), F.lit(new))])
    return km.transform(x).select(*id_cols, *feature_cols, F.element_at(relabel, F.col("_seg")).alias("segment"))


# --- ML7-ML9 -----------------------------------------------------------------------
def balanced_weight(df: DataFrame, label_col: str) -> Column:
    """n / (k * n_class) per row ('balanced' class weights), from one aggregate row."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    m = counts.agg(F.map_from_entries(F.collect_list(F.struct(label_col, "n"))).alias("m"),
                   F.sum("n").alias("tot"), F.count(F.lit(1)).alias("k"))
    s = m.select(F.struct("m", "tot", "k")).scalar()
    return (s["tot"] / (s["k"] * F.element_at(s["m"], F.col(label_col)))).cast("double")


def random_forest(train: DataFrame, features_col: str, label_col: str, num_trees: int = 400, max_depth: int = 30,
                  seed: int = 42):
    """ML7: distributed random forest; class-balanced weights, min leaf 1, depth capped at 30.
    Trees are grown in tasks and never collected (``forest``); a forest of few nodes, and a table
    whose binned rows are more than a task holds, go to pyspark.ml's forest, with the node of
    every row in every tree kept."""
    from pyspark.ml.classification import RandomForestClassifier
    from revlens.operators.forest import fit_forest
    from revlens.session import materialize
    forest = fit_forest(train, features_col, label_col, num_trees, max_depth, seed)
    if forest is not None:
        return forest
    w = materialize(train.withColumn("_w", balanced_weight(train, label_col)))
    rf = RandomForestClassifier(featuresCol=features_col, labelCol=label_col, weightCol="_w", numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=1, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=True)
    return rf.fit(w)


def platt_calibrated_proba(train: DataFrame, test: DataFrame, features_col: str, label_col: str, id_col: str,
                           oversample=None, num_trees: int = 400, folds: int = 3, seed: int = 42) -> DataFrame:
    """ML8: sigmoid calibration with ``folds``-fold cross-fitting.  For each fold f:
    oversample (optional) and fit the forest on the other folds, score fold f's
    original rows, fit a one-feature logistic regression (Platt) on them; test
    probability = mean of the fold calibrators applied to their forests.
    Returns (id, p_calibrated, p_uncalibrated)."""
    from revlens.session import materialize
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds))
    tr = materialize(train.withColumn("_fold", fold))
    test = materialize(test)
    parts = []
    for f in range(folds):
        fit_part = tr.where(F.col("_fold") != f).drop("_fold")
        if oversample is not None:
            fit_part = materialize(oversample(fit_part))
        forest = random_forest(fit_part, features_col, label_col, num_trees=num_trees, seed=seed + f)
        held = forest.transform(tr.where(F.col("_fold") == f)).select(
            label_col, vector_to_array("probability")[1].alias("_p"))
        cal = LogisticRegression(featuresCol="_pv", labelCol=label_col, maxIter=100).fit(
            VectorAssembler(inputCols=["_p"], outputCol="_pv").transform(held))
        scored = forest.transform(test).select(id_col, vector_to_array("probability")[1].alias("_p"))
        scored = cal.transform(VectorAssembler(inputCols=["_p"], outputCol="_pv").transform(scored))
        parts.append(scored.select(id_col, F.col("_p").alias("p_raw"),
                                   vector_to_array("probability")[1].alias("p_cal")))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return allp.groupBy(id_col).agg(F.avg("p_cal").alias("p_calibrated"), F.avg("p_raw").alias("p_uncalibrated"))


def behavior_model(features: DataFrame, feature_cols: Sequence[str], label_col: str, id_col: str, test_size: float = 0.2, num_trees: int = 400,
                   folds: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """ML9: stratified split, then (SMOTE -> forest -> sigmoid) by ``folds`` on the training part:
    ``(report, predictions)`` of the held-out part.

    ``features`` has one row per id with numeric columns (the engineered features, aspect
    scores); missing values count as 0.  Rows without a label are left out."""
    from revlens.operators.metrics import classification_report
    from revlens.operators.neighbors import smote
    from revlens.session import materialize
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols])
    rows = features.where(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("y"), vec.alias("embedding"))
    rows = materialize(rows.withColumn("features", array_to_vector("embedding")))
    sp = stratified_split(rows, id_col, "y", test_size, seed)

    def oversample(part: DataFrame) -> DataFrame:
        # the rarer class is filled up
        counts = {r["y"]: r["n"] for r in part.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        s = smote(part.select(id_col, "embedding", "y"), "y", id_col, minority=min(counts, key=counts.get)) if len(counts) > 1 else part
        return s.select(id_col, "embedding", "y", array_to_vector("embedding").alias("features"))

    test = sp.where("is_test").drop("is_test")
    p = platt_calibrated_proba(sp.where(~F.col("is_test")).drop("is_test"), test, "features", "y", id_col, oversample=oversample, num_trees=num_trees, folds=folds, seed=seed)
    pred = p.join(test.select(id_col, F.col("y").alias("y_true")), id_col).withColumn("y_pred", (F.col("p_calibrated") >= 0.5).cast("int"))
    pred = materialize(pred.select(id_col, "y_true", "y_pred", "p_calibrated"))
    return classification_report(pred), pred
