"""Structured Streaming (L1, L2): the request/response scoring services re-aimed
as streams that reuse the batch operators.

L1 scores arriving reviews: file source -> ``foreachBatch`` (sentiment + aspect
long table are per-micro-batch aggregations, legal there) -> Parquet sink, with
a checkpoint in the shared checkpoint folder.  L2 drops duplicate texts with a
watermark so the dedup state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.functions import text as T
from revlens.operators.quality import normalized_text


def _stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def score_stream(spark: SparkSession, src: str, schema: StructType, out: str, checkpoint: str, scorer,
                 aspects: dict, stop_words, id_expr, text_col: str, keep_cols=()) -> None:
    """L1: run until all available input is processed (``availableNow``)."""
    from revlens.operators.absa import absa_extract

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.select(id_expr.alias("review_id"), *keep_cols, T.basic_clean(text_col).alias("review_text"))
        s = scorer.score(rows, ["review_id"], "review_text", carry_cols=list(keep_cols))
        a = absa_extract(rows.select("review_id", "review_text"), aspects, stop_words, scorer)
        res = s.join(a, "review_id", "left").select(
            "review_id", *keep_cols, F.col("label").alias("sentiment_label"),
            F.col("score").alias("sentiment_confidence"), "aspect", "aspect_sentiment", "aspect_confidence")
        # a batch that is replayed after a failure replaces its own partition
        res.write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={epoch}")

    q = (_stream(spark, src, schema).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def dedup_stream(spark: SparkSession, src: str, schema: StructType, out: str, checkpoint: str, text_col: str,
                 ts_expr, watermark: str = "7 days") -> None:
    """L2: first occurrence per normalised text within the watermark
    (``dropDuplicatesWithinWatermark`` on the text hash); append to Parquet.  State holds the
    keys of the watermark only: a text that comes again later counts as new."""
    s = _stream(spark, src, schema).select("*", ts_expr.alias("_ts"),
                                           F.sha2(normalized_text(text_col), 256).alias("text_key"))
    d = s.withWatermark("_ts", watermark).dropDuplicatesWithinWatermark(["text_key"])
    q = (d.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
