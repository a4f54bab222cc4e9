"""Driver tables and the derived views every query reads.

The views re-shape the driver's parquet tables into the inputs the review
operators expect (a review table, prediction tables, fold scores, aspect
prototypes).  They are plain projections / joins, so Catalyst prunes and pushes
filters through them into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


FEW_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of few splits (a small file is one row group, thus one task) over the
    cores.  A table of ``FEW_SPLITS`` splits or more, as any large one, is left as it is."""
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df if splits >= min(cores, FEW_SPLITS) else df.repartition(min(cores, FEW_SPLITS))


def _mod(c: Column, m: int) -> Column:
    return F.pmod(c, F.lit(m))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document, with nulls, blanks, HTML/URL/emoji text,
    out-of-range and non-numeric ratings mixed in (FIXTURES.md §3)."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    i = F.col("doc_id")
    text = (
        F.when(_mod(i, 211) == 7, F.lit(None).cast("string"))
        .when(_mod(i, 211) == 8, F.lit("   "))
        .when(_mod(i, 17) == 0, F.concat(F.lit("<p>"), F.col("text"), F.lit("</p> http://x.example/a \U0001F600\U0001F600 !!")))
        .otherwise(F.col("text"))
    )
    rating = (
        F.when(_mod(i, 97) == 0, F.lit("9"))
        .when(_mod(i, 89) == 1, F.lit("n/a"))
        .when(F.col("toxic") == 1, (1 + _mod(i, 2)).cast("string"))
        .when(F.col("quality") == 1, (4 + _mod(i, 2)).cast("string"))
        .when(F.col("quality") == 0, F.lit("3"))
    )
    verified = (
        F.when(_mod(i, 5) == 0, F.lit("True"))
        .when(_mod(i, 5) == 1, F.lit("False"))
        .when(_mod(i, 5) == 2, F.lit("yes"))
        .when(_mod(i, 5) == 3, F.lit("0"))
    )
    return j.select(
        i.alias("review_id"),
        text.alias("review_text"),
        rating.alias("rating"),
        verified.alias("verified_purchase"),
        F.when(_mod(i, 13) == 0, F.lit(None).cast("double")).otherwise(_mod(i, 7).cast("double")).alias("helpful_votes"),
        (_mod(i, 7) + _mod(i, 3)).cast("double").alias("total_votes"),
        (F.lit(1704067200) + i * 600).cast("bigint").alias("ts_epoch"),
        _mod(i, 150).alias("reviewer_id"),
        _mod(i, 200).alias("product_id"),
        F.col("lang"),
    )


KEY5 = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels, a score with 1,001 distinct values and three hard predictions."""
    li = read_table(spark, sf_dir, "lineitem")
    h = _mod(F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31 + F.col("l_linenumber"), 1001)
    is_r = F.col("l_returnflag") == "R"
    raw = F.when(is_r, F.least(F.lit(1000), 200 + h)).otherwise(h)
    return li.select(
        *KEY5,
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        _mod(F.col("l_orderkey"), 10).cast("int").alias("fold"),
        F.when(is_r, 1).otherwise(0).alias("y_true"),
        (raw.cast("double") / 1000).alias("p_a"),
        F.when(raw >= 500, 1).otherwise(0).alias("pred_a"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("pred_b"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("pred_c"),
    )


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class labels with per-class probabilities p0, p1, p2."""
    li = read_table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    a = (1 + _mod(F.col("l_partkey") * 31 + F.col("l_linenumber"), 97)
         + F.when(F.col("l_returnflag") == "A", 40).otherwise(0)).cast("double")
    b = (1 + _mod(F.col("l_suppkey") * 17 + F.col("l_orderkey"), 89)
         + F.when(F.col("l_returnflag") == "N", 40).otherwise(0)).cast("double")
    c = (1 + _mod(F.col("l_orderkey") * 13 + F.col("l_partkey"), 83)).cast("double")
    t = li.select(*KEY5, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                  y.alias("y"), a.alias("a"), b.alias("b"), c.alias("c"))
    s = F.col("a") + F.col("b") + F.col("c")
    return t.select(*KEY5, "id", "y", (F.col("a") / s).alias("p0"), (F.col("b") / s).alias("p1"),
                    (F.col("c") / s).alias("p2"))


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, model, score): accuracy of pred_a/b/c per fold of ``predictions``."""
    p = predictions(spark, sf_dir)
    acc = p.groupBy("fold").agg(
        F.avg((F.col("pred_a") == F.col("y_true")).cast("double")).alias("a"),
        F.avg((F.col("pred_b") == F.col("y_true")).cast("double")).alias("b"),
        F.avg((F.col("pred_c") == F.col("y_true")).cast("double")).alias("c"),
    )
    return acc.unpivot("fold", ["a", "b", "c"], "model", "score")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest vec_id per label: (aspect, aspect_ord, embedding).  One row per class,
    so the table is bounded by the number of classes, not by the data."""
    e = embeddings(spark, sf_dir)
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("p"))
    return first.select(
        F.concat(F.lit("aspect_"), F.col("label").cast("string")).alias("aspect"),
        F.col("label").alias("aspect_ord"),
        F.col("p.embedding").alias("embedding"),
    )


def candidate_vectors(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stand-in for an embedder's output: (candidate, embedding), a vector of the table for
    every string."""
    n = vectors.count()
    key = F.pmod(F.conv(F.substring(F.md5("candidate"), 1, 6), 16, 10).cast("bigint"), F.lit(n))
    v = vectors.select(F.col("vec_id").alias("_v"), "embedding")
    return terms.select("candidate", key.alias("_v")).join(v, "_v").select("candidate", "embedding")


def minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a binary target: y = 1 where label = 0."""
    return embeddings(spark, sf_dir).select(
        "vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "SparkSession", "F", "Window")]
