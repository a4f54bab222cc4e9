"""Deduplication and data-quality profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from revlens.functions.text import as_text, strip_ws, to_number


def normalized_text(col: str) -> F.Column:
    """D1's comparison key: string, null -> '', stripped."""
    return strip_ws(as_text(col))


def remove_duplicates(df: DataFrame, text_col: str = "review_text", id_col: str = "review_id") -> DataFrame:
    """Keep the first row (lowest ``id_col``) per normalised text; the output
    carries the normalised text.  Missing column -> unchanged.

    Plan: one hash aggregate keyed by sha2(text).  ``min_by(struct(row), id)`` is
    combined map-side, so a hot text (a third of all rows, e.g. the empty
    review) is collapsed before the shuffle and never lands whole on one task.
    """
    if text_col not in df.columns:
        return df
    keyed = df.withColumn(text_col, normalized_text(text_col))
    first = keyed.groupBy(F.sha2(F.col(text_col), 256).alias("_k")).agg(
        F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(id_col)).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def profile_counts(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """G1: n_rows and n_duplicates on the text column (null is one value);
    whole-row duplicates when the column is absent.  Texts are told apart by their MD5, so
    that the shuffle carries digests."""
    if text_col in df.columns:
        distinct = F.count_distinct(F.md5(F.col(text_col))) + F.max(F.col(text_col).isNull().cast("bigint"))
        return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - distinct).alias("n_duplicates"))
    n_distinct = df.distinct().select(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - n_distinct).alias("n_duplicates"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, n_missing) -- null, or NaN for floating columns -- in one pass."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        miss = c.isNull() | F.isnan(c) if isinstance(f.dataType, (DoubleType, FloatType)) else c.isNull()
        aggs.append(F.count_if(miss).alias(f.name))
    wide = df.agg(*aggs)
    return wide.unpivot([], [f.name for f in df.schema.fields], "column", "n_missing")


def rating_outliers(df: DataFrame, rating_col: str = "rating") -> DataFrame:
    """Ratings outside [1, 5] after numeric coercion; nulls not counted."""
    if rating_col not in df.columns:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("rating_outliers"))
    r = to_number(rating_col)
    return df.agg(F.count_if((r < 1) | (r > 5)).alias("rating_outliers"))


def text_length_outliers(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Texts shorter than the 1st percentile of non-empty lengths or longer than
    the 99th percentile of all lengths (linear interpolation).

    Exact ``percentile`` keeps one counter per distinct length, so its state is
    bounded by the length range, not by the row count; the two cut-offs enter the
    counting pass as scalar subqueries (no join).
    """
    lengths = df.select(F.length(as_text(text_col)).cast("bigint").alias("len"))
    lo = lengths.select(F.coalesce(F.expr("percentile(len, 0.01) FILTER (WHERE len > 0)"), F.lit(0.0))).scalar()
    hi = lengths.select(F.coalesce(F.percentile(F.col("len"), 0.99), F.lit(0.0))).scalar()
    return lengths.agg(F.count_if((F.col("len") < lo) | (F.col("len") > hi)).alias("text_length_outliers"))
