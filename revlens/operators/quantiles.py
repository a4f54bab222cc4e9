"""Exact quantiles of a column by counting passes (G8, temporal split).

The wanted order statistics are narrowed down together: each pass counts, for every interval
that still holds one, the rows in ``BINS`` equal parts and their smallest and largest value,
and goes on with the part that holds the rank.  An interval ends when its values are all equal
or so few that their counts are fetched.  What a pass returns is bounded by bins and ranks,
whatever the number of rows or of distinct values; nothing is sorted or merged in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1_024
FETCHED = 2_000        # rows of an interval that are fetched as counted values


def finite(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int]) -> dict[int, float]:
    """Values at the given ranks (0 is the smallest) of a numeric column; nulls and values
    that are not finite are left out."""
    values = finite(df, col)
    total = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    out: dict[int, float] = {}
    open_ = {}          # interval (lo, hi) -> (rows below it, rows in it, ranks in it)
    wanted = sorted({r for r in ranks if 0 <= r < total["n"]})
    if wanted:
        open_[total["lo"], total["hi"]] = (0, total["n"], wanted)
    while open_:
        for (lo, hi), (_, _, own) in list(open_.items()):
            if lo == hi:
                out |= {r: lo for r in own}
                del open_[lo, hi]
        few = {k: v for k, v in open_.items() if v[1] <= FETCHED}
        for (lo, hi), (below, _, own) in few.items():
            at = below
            for r in values.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").collect():
                out |= {k: r["x"] for k in own if at <= k < at + r["n"]}
                at += r["n"]
            del open_[lo, hi]
        if not open_:
            break
        part = None
        for k, (lo, hi) in enumerate(open_):
            inside = (F.col("x") >= lo) & (F.col("x") <= hi)
            # halves keep the width finite for values at both ends of the range of doubles
            width = hi / 2 - lo / 2
            place = F.least(F.floor((F.col("x") / 2 - lo / 2) / width * BINS), F.lit(BINS - 1)).cast("int") if width else F.when(F.col("x") <= lo, 0).otherwise(1)
            place = place + k * BINS
            part = F.when(inside, place) if part is None else part.when(inside, place)
        counted: dict[int, list] = {}
        for r in (values.select("x", part.alias("b")).where(F.col("b").isNotNull()).groupBy("b")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()):
            counted.setdefault(r["b"] // BINS, []).append(r)
        narrowed = {}
        for k, (below, _, own) in enumerate(open_.values()):
            at = below
            for r in counted[k]:
                if some := [w for w in own if at <= w < at + r["n"]]:
                    narrowed[r["lo"], r["hi"]] = (at, r["n"], some)
                at += r["n"]
        open_ = narrowed
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values (as ``percentile``);
    None for a column without values."""
    n = finite(df, col).count()
    places = [p * (n - 1) for p in probs]
    got = order_statistics(df, col, [r for x in places for r in (math.floor(x), math.ceil(x))]) if n else {}
    return [None if not n else got[math.floor(x)] + (x - math.floor(x)) * (got[math.ceil(x)] - got[math.floor(x)]) for x in places]
