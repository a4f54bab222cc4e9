"""Business roll-ups over the long aspect table (G10-G13) and report views.

The long table has one row per (review, detected aspect); a review without an
aspect contributes an implicit 0.0.  Means "including zeros" therefore divide by
the number of reviews ``n``, counted once and used as a literal, never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as T


def n_rows(df: DataFrame) -> Column:
    """Row count of ``df`` as a literal: one counting job, instead of one scalar
    subquery (a full re-scan of the input) per place the count is used."""
    return F.lit(float(df.count()))


def aspect_summary(long_aspects: DataFrame, reviews: DataFrame) -> DataFrame:
    """Prevalence % (share != 0, 2 dp), mean sentiment (zeros included, 4 dp),
    mean confidence (4 dp); ordered by prevalence desc, mean asc."""
    n = n_rows(reviews)
    g = long_aspects.groupBy("aspect").agg(
        F.count_if(F.col("aspect_sentiment") != 0).alias("nz"),
        F.sum("aspect_sentiment").alias("s"),
        F.sum("aspect_confidence").alias("c"),
    )
    return g.select(
        "aspect",
        F.round(F.col("nz") / n * 100, 2).alias("prevalence_pct"),
        F.round(F.col("s") / n, 4).alias("mean_sentiment"),
        F.round(F.col("c") / n, 4).alias("mean_confidence"),
    ).orderBy(F.desc("prevalence_pct"), "mean_sentiment")


def aspect_value_counts(long_aspects: DataFrame, reviews: DataFrame, aspect: str, id_col: str = "review_id") -> DataFrame:
    """Counts of one aspect's score values over all reviews (absent -> 0.0)."""
    present = long_aspects.where(F.col("aspect") == aspect).groupBy(F.round("aspect_sentiment", 6).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # each present row is taken off the zeros that every review brings, so that the aspect rows are worked out once
    moved = present.select(F.inline(F.array(F.struct("value", "n"), F.struct(F.lit(0.0).alias("value"), (-F.col("n")).alias("n")))))
    zeros = reviews.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0.0).alias("value"), "n")
    both = moved.unionByName(zeros).groupBy("value").agg(F.sum("n").alias("n"))
    return both.where(F.col("n") > 0).orderBy("value")


def top_negative_aspects(long_aspects: DataFrame, reviews: DataFrame, k: int = 5) -> DataFrame:
    """K aspects with the lowest mean score (zeros included)."""
    n = n_rows(reviews)
    g = long_aspects.groupBy("aspect").agg((F.sum("aspect_sentiment") / n).alias("mean_sentiment"))
    return g.orderBy("mean_sentiment", "aspect").limit(k)


def revenue_impact(long_aspects: DataFrame, reviews: DataFrame, revenue_per_recommend: float = 20.0) -> DataFrame:
    """prevalence = share != 0; avg over non-zero; loss = max(0, -avg) * prevalence * n * revenue.
    No aspect rows -> empty frame."""
    n = n_rows(reviews)
    nz = F.col("aspect_sentiment") != 0
    g = long_aspects.groupBy("aspect").agg(
        F.count_if(nz).alias("nz"),
        F.avg(F.when(nz, F.col("aspect_sentiment"))).alias("avg_nz"),
    )
    prevalence = F.col("nz") / n
    avg = F.coalesce(F.col("avg_nz"), F.lit(0.0))
    loss = F.greatest(F.lit(0.0), -avg) * prevalence * n * F.lit(float(revenue_per_recommend))
    return g.select("aspect", avg.alias("avg_sentiment"), prevalence.alias("prevalence"),
                    loss.alias("estimated_revenue_loss")).orderBy(F.desc("estimated_revenue_loss"))


# --- report views -------------------------------------------------------------
def label_distribution(df: DataFrame, label_col: str = "doRecommend") -> DataFrame:
    """Normalised label (P1) and its count."""
    return df.groupBy(T.to_flag(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def sentiment_distribution(scored: DataFrame, label_col: str = "sentiment_label") -> DataFrame:
    """Count per sentiment label, most frequent first."""
    return scored.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label_col)


def confidence_describe(scored: DataFrame, col: str = "sentiment_confidence", exact: bool = True,
                        accuracy: int = 100_000) -> DataFrame:
    """Count, mean, std (ddof 1), min, quartiles, max.

    ``exact=True`` matches pandas (linear interpolation): the quartiles are selected by
    counting passes over the scores (``quantiles.py``), so no task holds the distinct values.
    ``exact=False``: ``percentile_approx`` with a fixed-size sketch per partition."""
    c, probs = F.col(col), (0.25, 0.5, 0.75)
    stats = [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
    if exact:
        from revlens.operators.quantiles import exact_quantiles
        from revlens.session import materialize
        values = materialize(scored.select(c))
        q = exact_quantiles(values, col, probs)
        return values.agg(*stats).select("count", "mean", "std", "min", *(F.lit(v).cast("double").alias(n) for n, v in zip(("p25", "p50", "p75"), q)), "max")
    return scored.agg(*stats, F.percentile_approx(c, F.array(*[F.lit(p) for p in probs]), accuracy).alias("_q")).select(
        "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def confidence_histogram(scored: DataFrame, col: str = "sentiment_confidence", bins: int = 10) -> DataFrame:
    """Pandas ``cut(bins=10)``: equal width on [min, max], right-closed, the first
    edge lowered by 0.1 % of the range (or +-0.1 % of |min| when all values are
    equal); empty bins listed with 0.  (bin, left, right, n)."""
    c = F.col(col)
    # one aggregated row, fetched once: its values are used in many expressions below,
    # and a scalar subquery per reference would re-run the whole input each time
    r = scored.agg(F.min(c).alias("mn"), F.max(c).alias("mx")).first()
    if r["mn"] is None:
        return scored.sparkSession.createDataFrame([], "bin int, left double, right double, n bigint")
    mn, mx = F.lit(float(r["mn"])), F.lit(float(r["mx"]))
    rng = mx - mn
    # equal values: pandas widens both ends by 0.1 % of |value| (or 0.001 when 0)
    adj = F.when(mn == 0, F.lit(0.001)).otherwise(F.abs(mn) * 0.001)
    lo = F.when(rng == 0, mn - adj).otherwise(mn)
    hi = F.when(rng == 0, mx + adj).otherwise(mx)
    width = (hi - lo) / bins
    edge = lambda i: lo + width * i
    b0 = F.least(F.greatest(F.ceil((c - lo) / width).cast("int"), F.lit(1)), F.lit(bins))
    # settle values that float rounding put on the wrong side of an edge: bins are (left, right]
    b = (F.when((b0 > 1) & (c <= edge(b0 - 1)), b0 - 1)
         .when((b0 < bins) & (c > edge(b0)), b0 + 1).otherwise(b0))
    counts = scored.where(c.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    left = F.when(F.col("bin") == 1, F.when(rng == 0, lo).otherwise(lo - rng * 0.001)).otherwise(edge(F.col("bin") - 1))
    return grid.join(counts, "bin", "left").select(
        "bin", left.alias("left"), edge(F.col("bin")).alias("right"), F.coalesce(F.col("n"), F.lit(0)).alias("n"))
