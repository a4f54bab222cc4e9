"""Mixing sources to target weights by Pfair scheduling, in SQL expressions.

Every source is cut into blocks of ``block_rows`` documents.  With ``slots`` of a period of
N, its i-th block (from 0) may start at slot ``floor(i N / slots)`` and is due by
``ceil((i + 1) N / slots)``; among released blocks the earliest deadline goes first.  As the
weights sum to one, every block meets its window, so at any slot a source is less than one
block away from its share.

The schedule of one period is worked out on a single row whose size is bounded by the mix
itself (N slots, as many counters as sources), and repeats.  Documents find their slot by
arithmetic: place in the source -> block -> period and slot.  A source that runs out leaves
its later slots empty, so the others go on in proportion, and every document comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import cut

BLOCK_ROWS = 16
RESOLUTION = 1_000          # slots of a period, besides one for each source
MOST_SOURCES = 2_000
ROWS_PER_BUCKET = 5_000


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _slots(sizes: DataFrame, weights: dict[str | None, float] | None, resolution: int) -> DataFrame:
    """``(src, n, slots)``: whole slots of a period.  Without given weights a source weighs
    the root of its size; sources missing from given weights weigh nothing but one slot."""
    if weights is None:
        w = F.sqrt(F.col("n").cast("double"))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("src") == ("null" if name is None else "=" + name), F.lit(float(value))).otherwise(w)
    weighed = sizes.withColumn("w", w)
    total = weighed.agg(F.sum("w")).scalar()
    share = F.when(total > 0, F.col("w") / total).otherwise(F.lit(0.0))
    return weighed.select("src", "n", F.greatest(F.lit(1), F.round(share * resolution)).cast("bigint").alias("slots"))


def schedule(slots: DataFrame) -> DataFrame:
    """``(src, nth, slot, period)`` of one period, from ``(src, slots)``.

    Earliest deadline first, one slot at a time, as an aggregate over the slots of the one
    row that holds all sources; equal deadlines go in the order of the names.
    """
    one = slots.agg(F.sort_array(F.collect_list(F.struct("src", "slots"))).alias("s")).where(F.size("s") > 0)
    one = one.withColumn("period", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["slots"]))

    def step(state: Column, t: Column) -> Column:
        due = F.zip_with(state["done"], F.col("s"), lambda d, x: F.when(
            (d < x["slots"]) & (F.floor(d * F.col("period") / x["slots"]) <= t),
            F.ceil((d + 1) * F.col("period") / x["slots"])))
        pick = F.array_position(due, F.array_min(due)).cast("int")
        done = F.transform(state["done"], lambda d, k: F.when(k + 1 == pick, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.array_append(state["order"], pick).alias("order"))

    start = F.struct(F.transform("s", lambda _: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<int>").alias("order"))
    ran = one.withColumn("order", F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("period") - 1), start, step, lambda a: a["order"]))
    placed = ran.select("period", "s", F.posexplode("order").alias("slot", "pick")) \
        .select("period", F.col("slot").cast("bigint").alias("slot"), F.element_at("s", F.col("pick"))["src"].alias("src"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("slot")).cast("bigint") - 1
    return placed.select("src", nth.alias("nth"), "slot", "period")


def _planned(docs: DataFrame, weights: dict[str | None, float] | None, resolution: int, source_col: str) -> tuple[DataFrame, DataFrame]:
    """``(src, n, slots)`` and ``(src, nth, slot, period)``, at most resolution + 2 x sources rows."""
    sizes = cut(docs.select(_key(F.col(source_col)).alias("src")).groupBy("src").agg(F.count("*").alias("n")), "mix-sizes")
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: a mix names its sources")
    slots = cut(_slots(sizes, weights, resolution), "mix-slots")
    return slots, cut(schedule(slots.select("src", "slots")), "mix-plan")


def mix_plan(docs: DataFrame, weights: dict[str | None, float] | None = None, resolution: int = RESOLUTION, source_col: str = "source") -> dict:
    """The mix of a table, bounded by its sources and the resolution: ``sources``, the key, rows
    and slots of each, and ``order``, the number of the source of every slot of a period."""
    slots, plan = _planned(docs, weights, resolution, source_col)
    sources = [[r["src"], r["n"], r["slots"]] for r in slots.orderBy("src").collect()]
    number = {src: k for k, (src, _, _) in enumerate(sources)}
    return {"sources": sources, "order": [number[r["src"]] for r in plan.orderBy("slot").collect()]}


def _tables(spark: SparkSession, plan: dict) -> tuple[DataFrame, DataFrame]:
    """``(src, n, slots)`` and ``(src, nth, slot, period)`` of a plan made before."""
    done, rows = [0] * len(plan["sources"]), []
    for slot, k in enumerate(plan["order"]):
        rows.append((plan["sources"][k][0], done[k], slot, len(plan["order"])))
        done[k] += 1
    return (spark.createDataFrame([tuple(x) for x in plan["sources"]], "src string, n long, slots long"),
            spark.createDataFrame(rows, "src string, nth long, slot long, period long"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION,
        id_col: str = "doc_id", source_col: str = "source", plan: dict | None = None) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_slot``, ``mix_place`` (in the block) and
    ``mix_on_target`` (no source has run out before this slot).  Sorting by slot and place
    gives the mixed stream.

    Order within a source: MD5 of the id, then the id (null ids last).  Rows of one id are
    interchangeable.  A null source is a source of its own.  Columns of these names are
    replaced; all rows stay.  Empty input gives an empty result.  ``plan``: a mix made before
    by ``mix_plan``, for the same rows; weights and resolution are then those of the plan.
    """
    new = ["mix_block", "mix_slot", "mix_place", "mix_on_target"]
    rows = docs.drop(*new)
    keep = [F.col(f"`{c}`") for c in rows.columns]
    src, digest = _key(F.col(source_col)), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("~")))
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    narrow = docs.select(src.alias("src"), head.alias("h"))
    slots, plan = _planned(docs, weights, resolution, source_col) if plan is None else _tables(docs.sparkSession, plan)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_BUCKET)).cast("bigint")
    spread = F.broadcast(slots.select(F.col("src").alias("mix_src"), buckets.alias("mix_buckets"), F.col("slots").alias("mix_slots")))
    bucket = F.floor(F.col("h") * F.col("mix_buckets") / F.lit(1 << 32)).cast("bigint")
    counted = (narrow.join(spread, F.col("src") == F.col("mix_src")).groupBy("src", bucket.alias("b")).agg(F.count("*").alias("c")))
    before = F.sum("c").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select(F.col("src").alias("mix_o_src"), F.col("b").alias("mix_o_b"), F.coalesce(before, F.lit(0)).alias("mix_before"))
    # first slot that lacks its block: after it the mix is off target
    empty = (slots.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("bigint"))
             .select("src", F.floor(F.col("blocks") / F.col("slots")).cast("bigint").alias("round"), (F.col("blocks") % F.col("slots")).alias("nth"))
             .join(plan, ["src", "nth"]).agg(F.min(F.col("round") * F.col("period") + F.col("slot"))).scalar())
    dealt = rows.select(*keep, src.alias("mix_src"), digest.alias("mix_digest"), head.alias("mix_h")).join(spread, "mix_src")
    dealt = dealt.withColumn("mix_b", F.floor(F.col("mix_h") * F.col("mix_buckets") / F.lit(1 << 32)).cast("bigint"))
    dealt = dealt.join(offsets, (F.col("mix_src") == F.col("mix_o_src")) & (F.col("mix_b") == F.col("mix_o_b")))
    w = Window.partitionBy("mix_src", "mix_b").orderBy("mix_digest", F.col(id_col).asc_nulls_last())
    dealt = dealt.withColumn("mix_at", F.col("mix_before") + F.row_number().over(w) - 1)
    dealt = dealt.withColumn("mix_block", F.floor(F.col("mix_at") / block_rows).cast("bigint"))
    dealt = dealt.join(F.broadcast(plan.select(F.col("src").alias("mix_p_src"), F.col("nth").alias("mix_nth"), F.col("slot").alias("mix_t"), F.col("period").alias("mix_period"))),
                       (F.col("mix_src") == F.col("mix_p_src")) & (F.col("mix_block") % F.col("mix_slots") == F.col("mix_nth")))
    slot = F.floor(F.col("mix_block") / F.col("mix_slots")).cast("bigint") * F.col("mix_period") + F.col("mix_t")
    return dealt.select(*keep, F.col("mix_block"), slot.alias("mix_slot"), (F.col("mix_at") % block_rows).cast("bigint").alias("mix_place"),
                        (slot < empty).alias("mix_on_target"))


def oracle(table: str = "documents", block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION) -> str:
    """The same for DuckDB: the schedule slot by slot in a recursive query."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM {table} GROUP BY source),
slots AS (SELECT source, n, CAST(greatest(1, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * {resolution})) AS BIGINT) AS slots FROM sizes),
one AS (SELECT list(source ORDER BY source) AS src, list(slots ORDER BY source) AS s, CAST(sum(slots) AS BIGINT) AS p FROM slots),
edf(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(s, lambda x: CAST(0 AS BIGINT)), 0 FROM one
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(s) + 1), lambda k: done[k] + CASE WHEN k = best THEN 1 ELSE 0 END), CAST(best AS INTEGER)
  FROM (SELECT e.t, e.done, one.s, one.p, list_min(list_transform(list_filter(range(1, len(s) + 1),
          lambda k: done[k] < s[k] AND done[k] * p // s[k] <= t + 1),
          lambda k: -(-(done[k] + 1) * p // s[k]) * 100000 + k)) % 100000 AS best
        FROM edf e, one WHERE e.t + 1 < one.p)),
plan AS (SELECT one.src[pick] AS source, t AS slot, p, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf, one WHERE t >= 0),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS at FROM {table}),
final AS (SELECT d.doc_id, d.source, d.at // {block_rows} AS mix_block, d.at // {block_rows} // s.slots * p.p + p.slot AS mix_slot, d.at % {block_rows} AS mix_place
  FROM placed d JOIN slots s USING (source) JOIN plan p ON p.source = d.source AND p.nth = (d.at // {block_rows}) % s.slots),
ends AS (SELECT min(e.blocks // e.slots * p.p + p.slot) AS t
  FROM (SELECT source, slots, (n + {block_rows - 1}) // {block_rows} AS blocks FROM slots) e JOIN plan p ON p.source = e.source AND p.nth = e.blocks % e.slots)
SELECT doc_id, source, mix_block, mix_slot, mix_place, mix_slot < (SELECT t FROM ends) AS mix_on_target FROM final"""
