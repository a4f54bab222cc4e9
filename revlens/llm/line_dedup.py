"""Cross-site line deduplication by distinct-site spread, in SQL expressions.

Distinct sites of every line hash are estimated with HyperLogLog sketches, built in the
tasks and merged by the aggregation; lines whose estimate lies near the threshold are
counted exactly.  A line of at least ``min_sites`` sites is boilerplate: it stays in its
first document (smallest id) and in exact copies of that text, and goes from all others.
Equal texts are thus treated alike: a page that is copied as a whole to many sites keeps its
lines, and is left to the removal of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import cut, free_name

MOST_SITES = 10               # this many sites are enough in any corpus;
LEAST_SITES = 2               # below that, half of the sites, but never a single one
LG_K = 12                     # sketch of 2^12 registers: standard error 1.6 %
NEAR = 0.15                   # estimates this close to the threshold are checked exactly
HOT_SHARE = 10_000            # a line that holds this part of all rows is joined by broadcast


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(" \t\r")))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r")) == ""


def _with_lines(seen: DataFrame, lines: DataFrame, total: int) -> DataFrame:
    """``seen`` joined with ``lines`` (which carry their count ``n`` in it).  A line with one
    of ``HOT_SHARE`` parts of all rows or more, of which there are ``HOT_SHARE`` at most, is
    broadcast; the shuffle joins the others, none of which holds more than that part."""
    hot = lines.where(F.col("n") * HOT_SHARE >= total)
    rest = seen.join(F.broadcast(hot.select("line")), "line", "left_anti").join(lines.where(F.col("n") * HOT_SHARE < total), "line")
    return seen.join(F.broadcast(hot), "line").select(*rest.columns).unionAll(rest)


def spread_lines(docs: DataFrame, min_sites: int | None = None, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(line, first_id, n)`` of the boilerplate lines with their number of occurrences, and
    the occurrences ``(line, site, body, id)`` they come from (hashes; one row for each
    document and line).  Without ``min_sites`` it is half of the sites that have lines,
    between ``LEAST_SITES`` and ``MOST_SITES``."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: ~_blank(x)), _key))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(site_col).cast("string").alias("s"), F.col(text_col).cast("string").alias("t"))
    seen = cut(rows.where("t IS NOT NULL").select(
        F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("site"), F.xxhash64("t").alias("body"), "id", F.explode(keys).alias("line")), "lines")
    total = seen.count()
    if min_sites is None:
        half = (seen.where("site IS NOT NULL").select("site").distinct().count() + 1) // 2
        min_sites = min(MOST_SITES, max(LEAST_SITES, half))
    # a line of one site cannot spread: most lines end here, in a plain hash aggregate
    some = cut(seen.groupBy("line").agg(F.min("site").alias("s0"), F.max("site").alias("s1"), F.count("*").alias("n"), F.min("id").alias("first_id"))
               .where((F.lit(min_sites <= 1) | (F.col("s0") != F.col("s1"))) & (F.col("n") >= min_sites)).select("line", "first_id", "n"), "lines-some")
    held = cut(_with_lines(seen.select("line", "site"), some, total).where("site IS NOT NULL"), "lines-held")
    keep = ["line", "first_id", "n"]
    sketched = cut(held.groupBy(*keep).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")), "lines-sketched")
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    sure = sketched.where(F.col("sites") > high).select(*keep)
    near = sketched.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("line")
    exact = (held.join(near, "line", "left_semi").distinct().groupBy(*keep).agg(F.count("*").alias("k"))
             .where(F.col("k") >= min_sites).select(*keep))
    return cut(sure.unionAll(exact), "lines-spread"), seen


def remove_lines(docs: DataFrame, min_sites: int | None = None, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                 removed_col: str | None = "n_removed") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text`` and, if ``removed_col`` is
    given, their number.

    Lines are cut at line feeds and compared without blanks, tabs and carriage returns
    around them; blank lines stay.  Null sites do not count as a site, null texts stay
    null, null ids are never the first of a line (with null ids alone a line has no first and
    goes).  All rows stay, a text may become empty; rows of one text are treated alike.  Other
    columns pass unchanged (a column named like ``removed_col`` is replaced).
    """
    lines, seen = spread_lines(docs, min_sites, id_col, text_col, site_col)
    found = cut(_with_lines(seen.select("line", "id", "body"), lines, seen.count()).select("line", "id", "body", "first_id"), "lines-found")
    first = found.where(F.col("id") == F.col("first_id")).select("line", "body").distinct()
    gone, hit_id, hit_body = (free_name(docs, c) for c in ("llm_gone", "llm_id", "llm_body"))
    hits = (found.join(first, ["line", "body"], "left_anti")
            .groupBy("id", "body").agg(F.collect_set("line").alias(gone))
            .select(F.col("id").alias(hit_id), F.col("body").alias(hit_body), gone))
    text = F.col(text_col).cast("string")
    joined = docs.join(hits, F.col(id_col).cast("bigint").eqNullSafe(F.col(hit_id)) & (F.xxhash64(text) == F.col(hit_body)), "left")
    kept = F.filter(_lines(text), lambda x: _blank(x) | ~F.array_contains(gone, _key(x)))
    hit = F.col(gone).isNotNull()
    new = {c: F.col(f"`{c}`") for c in docs.columns}
    new[text_col] = F.when(hit, F.array_join(kept, "\n")).otherwise(text)
    if removed_col:
        new[removed_col] = F.when(hit, F.size(_lines(text)) - F.size(kept)).otherwise(F.lit(0)).cast("bigint")
    return joined.select(*(v.alias(k) for k, v in new.items()))


def oracle(table: str = "documents") -> str:
    return f"""
WITH lines AS (SELECT doc_id, source, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM {table}),
bound AS (SELECT least({MOST_SITES}, greatest({LEAST_SITES}, (count(DISTINCT source) + 1) // 2)) AS k FROM lines WHERE line <> ''),
spread AS (SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> '' GROUP BY line
           HAVING count(DISTINCT source) >= (SELECT k FROM bound)),
firsts AS (SELECT DISTINCT l.line, l.text FROM lines l JOIN spread s ON s.line = l.line AND s.first_id = l.doc_id),
parts AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM {table}),
marked AS (SELECT p.doc_id, p.pos, p.raw, s.line IS NOT NULL AND f.line IS NULL AS gone
           FROM parts p LEFT JOIN spread s ON s.line = trim(p.raw, ' ' || chr(9) || chr(13))
           LEFT JOIN firsts f ON f.line = s.line AND f.text = p.text)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY doc_id"""
