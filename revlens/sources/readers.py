"""Review file readers and sinks.

Files are read with an explicit all-string schema (never ``inferSchema``), so
nothing scans the data twice.  The header line is the only thing read on the
driver.
"""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revlens.functions import text as T

# Header synonyms (lower-cased, stripped) -> canonical column.
DEFAULT_RENAME_MAP: dict[str, str] = {
    "reviews.text": "review_text",
    "review": "review_text",
    "text": "review_text",
    "content": "review_text",
    "body": "review_text",
    "summary": "summary",
    "rating": "rating",
    "stars": "rating",
    "verified_purchase": "verified_purchase",
    "verified": "verified_purchase",
    "helpful_vote": "helpful_votes",
    "helpful_votes": "helpful_votes",
    "total_votes": "total_votes",
    "date": "timestamp",
    "time": "timestamp",
    "parent_asin": "product_id",
    "asin": "product_id",
    "reviewerid": "reviewer_id",
}

# Cell strings read as missing (the pandas reader's defaults).
NA_TOKENS: list[str] = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


def na_to_null(c: Column) -> Column:
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


# --- S3 ---------------------------------------------------------------------
def normalize_columns(df: DataFrame, rename_map: dict[str, str] = DEFAULT_RENAME_MAP) -> DataFrame:
    """Strip header names and rename synonyms case-insensitively in one projection.
    Several sources for one target (asin + parent_asin) are coalesced in file order."""
    targets: dict[str, list[str]] = {}
    order: list[str] = []
    for c in df.columns:
        t = rename_map.get(c.strip().lower(), c.strip())
        if t not in targets:
            targets[t] = []
            order.append(t)
        targets[t].append(c)
    cols = []
    for t in order:
        src = [F.col(f"`{c}`") for c in targets[t]]
        cols.append((src[0] if len(src) == 1 else F.coalesce(*src)).alias(t))
    return df.select(*cols)


# --- S1 ---------------------------------------------------------------------
def _header(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).limit(1).first()[0]


def _split_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Quoting off: split every line on ``sep``; lines with more fields than the
    header are skipped, shorter ones padded with nulls; NA tokens -> null."""
    header = _header(spark, path)
    names = [h.strip() for h in header.split(sep)]
    lines = spark.read.text(path).where(F.col("value") != header)
    parts = F.split(F.col("value"), "\\t" if sep == "\t" else sep.replace("|", "\\|"), -1)
    rows = lines.select(parts.alias("_p")).where(F.size("_p") <= len(names))
    return rows.select(*[na_to_null(F.get(F.col("_p"), i)).alias(n) for i, n in enumerate(names)])


_EXTRA = "_past_the_last"


def _quoted(spark: SparkSession, path: str, sep: str, multi_line: bool = True) -> DataFrame:
    header = _header(spark, path)
    names = [h.strip() for h in next(csv.reader([header], delimiter=sep))]
    schema = StructType([StructField(n, StringType()) for n in [*names, _EXTRA]])
    df = (spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"')
          .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    # a field past the header's last one marks a row that is too long; short rows are padded
    return df.where(F.col(_EXTRA).isNull()).select(*[na_to_null(F.col(f"`{n}`")).alias(n) for n in names])


def read_reviews(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = True) -> DataFrame:
    """S1 + S3 + S4: given ``sep`` -> quoted parse; none -> comma with quoting off,
    and tab when the text column cannot be resolved that way.  Then columns are
    normalised, null text dropped and text stripped.  ``multi_line=False`` lets large files
    be split; it is right only where no quoted field holds a line feed."""
    if sep is not None:
        df = normalize_columns(_quoted(spark, path, sep, multi_line))
    else:
        df = normalize_columns(_split_lines(spark, path, ","))
        if "review_text" not in df.columns:
            df = normalize_columns(_quoted(spark, path, "\t", multi_line))
    from revlens.operators.features import require_text
    return require_text(df)


# --- S2 ---------------------------------------------------------------------
def read_upload(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Separator from the extension (.tsv -> tab), standard quoting, column
    normalisation, then dedup (D1) and cleaning (P4)."""
    from revlens.operators.absa import prepare_reviews
    sep = "\t" if path.lower().rstrip("/").endswith(".tsv") else ","
    df = normalize_columns(_quoted(spark, path, sep, multi_line))
    id_col = "review_id" if "review_id" in df.columns else None
    if id_col is None:
        df = df.withColumn("review_id", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    else:
        df = df.withColumn("review_id", F.col("review_id").try_cast("bigint"))
    return prepare_reviews(df)


ROWS_PER_FILE = 20_000        # a quoted file with line feeds is read by one task
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def write_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    """CSV/TSV files (quoted where needed; whitespace kept) of at most ``ROWS_PER_FILE`` rows,
    each with the header; ``one_file`` writes a single one, in one task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("maxRecordsPerFile", 0 if one_file else ROWS_PER_FILE) \
        .options(**_CSV).option("sep", sep).csv(path)


# --- S5 ---------------------------------------------------------------------
def log_metrics(metrics: DataFrame, path: str, experiment: str, run: str) -> None:
    """Append (experiment, run, metric, value, ts) rows to a Parquet table
    partitioned by experiment.  ``metrics`` is (metric, value)."""
    out = metrics.select(F.lit(experiment).alias("experiment"), F.lit(run).alias("run"),
                         F.col("metric").cast("string").alias("metric"), F.col("value").cast("double").alias("value"),
                         F.current_timestamp().alias("ts"))
    out.write.mode("append").partitionBy("experiment").parquet(path)


def read_metrics(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """Partition-pruned read of one experiment's metrics."""
    return spark.read.parquet(path).where(F.col("experiment") == experiment)


# --- S6 ---------------------------------------------------------------------
def batch_score_table(spark: SparkSession, src: str, dst: str, scorer, id_cols: list[str], text_col: str) -> DataFrame:
    """Read a Parquet table, score every text, write (ids, label, score) as Parquet."""
    df = spark.read.parquet(src).select(*id_cols, text_col)
    scorer.score(df, id_cols, text_col).select(*id_cols, "label", "score").write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    from revlens.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
