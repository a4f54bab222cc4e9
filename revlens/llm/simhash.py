"""SimHash document fingerprints.

Weighted hashes of a text's terms (word shingles) vote on signed bits.  Fingerprints
within a Hamming radius are found with permuted block tables: the bits are cut into
``radius + spare`` blocks, every choice of ``spare`` blocks is one table keyed by those
blocks, and two fingerprints within the radius agree on the key of at least one table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import U64, components, cut, mix, released, shingle_hashes, small_side, word_hashes

BITS = 128
WIDTH = 5
RADIUS = 3               # of 128 bits: a cosine of 0.997, far above a Jaccard of 0.8
TILE = 1024              # entries of one side of a comparison
MOST_SHARED_KEYS = 2_000_000
HOT_SHARE = 20_000       # a fingerprint of more than this share of the rows is a hot one
LEAST = -(1 << 63)       # stands for a null id when rows are put in order
MOST_RANGES = 20_000    # bounds what the driver sees: one id a range


def fingerprint(text: str | None, width: int = WIDTH, bits: int = BITS) -> bytes:
    """Fingerprint of a whole text.  A term weighs the root of its count, so that a
    repeated line does not outvote the rest.  Without words all bits are 0; bits whose
    votes tie are 0."""
    terms, counts = np.unique(shingle_hashes(word_hashes(text), width), return_counts=True)
    if not len(terms):
        return bytes(bits // 8)
    votes = np.zeros(bits)
    for at in range(0, len(terms), 4096):
        t, w = terms[at:at + 4096], np.sqrt(counts[at:at + 4096]).astype(np.float32)
        with np.errstate(over="ignore"):
            words = np.stack([mix(t + U64(0x9E3779B97F4A7C15) * U64(k + 1)) for k in range(bits // 64)], axis=1)
        signs = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(t), bits // 8), axis=1)
        votes += 2.0 * (w @ signs.astype(np.float32)).astype(float) - float(w.sum())
    return np.packbits(votes > 0).tobytes()


def fingerprint_column(text: Column, width: int = WIDTH, bits: int = BITS) -> Column:
    """Hex string of the fingerprint; null texts count as empty."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            yield pa.array([fingerprint(t.as_py(), width, bits).hex() for t in texts], pa.string())

    return run(text)


def hamming(a: Column, b: Column, bits: int = BITS) -> Column:
    """Differing bits of two hex fingerprints."""
    total = F.lit(0)
    for k in range(bits // 32):
        at = [F.conv(F.substring(c, k * 8 + 1, 8), 16, 10).cast("bigint") for c in (a, b)]
        total = total + F.bit_count(at[0].bitwiseXOR(at[1]))
    return total.cast("int")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Cosine of the angle that the differing bits estimate, not below 0: 1 for equal
    fingerprints, about 0 for unrelated texts."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(np.pi / bits) * hamming(a, b, bits)))


def with_groups(fingerprints: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", radius: int = RADIUS,
                spare: int = 2, bits: int = BITS, group_col: str = "group_id") -> DataFrame:
    """``fingerprints`` with ``group_id``: documents whose fingerprints are linked by steps
    of at most ``radius`` bits share a group, named by its smallest id.

    Every row and column stays; a column named like the group is replaced.  Rows of a null
    fingerprint have no group; rows of a null id take that of their fingerprint, null if no
    row with an id has it.  Texts without words have equal fingerprints, so they are one group.
    The input is read more than once: cut it first if it is costly.

    Equal fingerprints are one entry before anything is joined.  Within a table, entries of
    one key are compared with each other, all pairs of them, in hash-dealt tiles of about
    ``TILE`` entries, so no bucket is held by one task and no link is lost.
    """
    rows = fingerprints.drop(group_col)
    known = rows.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp")).where("id IS NOT NULL AND fp IS NOT NULL")
    heads = cut(known.groupBy("fp").agg(F.min("id").alias("head"), F.count("*").alias("n_rows")), "simhash-heads")
    blocks = radius + spare
    edges = [round(bits * k / blocks) for k in range(blocks + 1)]
    binary = F.concat(*[F.lpad(F.conv(F.substring("fp", k + 1, 8), 16, 2), 32, "0") for k in range(0, bits // 4, 8)])
    keys = [F.xxhash64(F.lit(t), *[F.substring("b", edges[i] + 1, edges[i + 1] - edges[i]) for i in chosen])
            for t, chosen in enumerate(combinations(range(blocks), spare))]
    entries = heads.withColumn("b", binary).select("head", F.unhex("fp").alias("mark"), F.explode(F.array(*keys)).alias("k"))
    shared = cut(entries.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    held = (entries.join(small_side(shared, shared.count(), MOST_SHARED_KEYS), "k").withColumn("tiles", tiles)
            .withColumn("c", F.pmod(F.xxhash64("mark"), F.col("tiles")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "head", "mark"))

    def link(tile: pd.DataFrame) -> pd.DataFrame:
        ids = tile["head"].to_numpy()
        raw = np.frombuffer(b"".join(tile["mark"]), np.uint64).reshape(len(tile), bits // 64)
        src, dst, root = [], [], np.arange(len(ids))
        for a in range(len(ids) - 1):
            near = np.flatnonzero((np.bitwise_count(raw[a + 1:] ^ raw[a]).sum(axis=1) <= radius)) + a + 1
            for b in near[root[near] != root[a]]:
                if root[b] != root[a]:
                    root[root == root[b]] = root[a]
                    src.append(ids[a])
                    dst.append(ids[b])
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    found = components(held.groupBy("k", "i", "j").applyInPandas(link, "src long, dst long"), "simhash-cc")
    named = cut(heads.join(found, F.col("head") == F.col("node"), "left")
                .select(F.col("fp").alias("simhash_fp"), "n_rows", F.coalesce("component", "head").alias(group_col)), "simhash-groups")
    # fingerprints of many rows meet them by broadcast: there are fewer than HOT_SHARE of them
    hot = F.col("n_rows") * HOT_SHARE > named.agg(F.sum("n_rows")).scalar()
    often, rest = F.broadcast(named.where(hot).drop("n_rows")), named.where(~hot).drop("n_rows")
    met = F.col(f"`{fp_col}`") == F.col("simhash_fp")
    return rows.join(often, met).drop("simhash_fp").unionByName(rows.join(often, met, "left_anti").join(rest, met, "left").drop("simhash_fp"))


def near_groups(fingerprints: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", radius: int = RADIUS,
                spare: int = 2, bits: int = BITS) -> DataFrame:
    """``(doc_id, fingerprint, group_id)`` of ``with_groups``; null ids or fingerprints are left out."""
    rows = fingerprints.select(id_col, fp_col).where(F.col(id_col).isNotNull() & F.col(fp_col).isNotNull())
    return with_groups(rows, id_col, fp_col, radius, spare, bits)


# ---------------------------------------------------------------- edited neighbours

def with_next(docs: DataFrame, work, schema, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4000) -> DataFrame:
    """Apply ``work(ids, texts, next_texts) -> dict of columns`` where a row's next text
    is that of the next row by id (after the last: the first).

    One range exchange on the id: the cut points come from the ids alone, and the first
    row of each range is also sent to the range before it, so neighbours across a cut
    meet without a second exchange or a window over all rows.  Equal ids follow each
    other by text; null ids come first.  A single row is its own next one.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("lead"), F.col(id_col).isNull().alias("none"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count = rows.count()
    ranges = max(1, min(MOST_RANGES, count // rows_per_range))
    cuts = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = rows.agg(F.percentile_approx("lead", shares, 10 * ranges + 100)).first()[0]
    edges = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def place(lead: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, lead.to_numpy(), side="right").astype(np.int32))

    # one row a range reaches the driver: the smallest id in it
    first = sorted((r["p"], r["lead"]) for r in rows.select("lead", place("lead").alias("p")).groupBy("p").agg(F.min("lead").alias("lead")).collect())
    back = docs.sparkSession.createDataFrame([(lead, first[k - 1][0]) for k, (_, lead) in enumerate(first)] or [(0, 0)], "lead long, before int")
    placed = rows.withColumn("p", place("lead")).join(F.broadcast(back), "lead", "left")
    own = F.struct(F.col("p").alias("p"), F.lit(0).alias("own"))
    dealt = (placed.withColumn("to", F.explode(F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("p"), F.lit(1).alias("own"))))
                                               .otherwise(F.array(own))))
             .select("to.p", "to.own", "lead", "none", "text")
             .repartition(max(1, len(first)), "p").sortWithinPartitions("p", "own", "lead", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None        # the row that waits for its next one: (range, id, text)
        done = None        # range whose own rows are all matched
        for batch in released(batches):
            ids, texts, nexts = [], [], []
            for p, own, lead, none, t in zip(*(batch[c].tolist() for c in ("p", "own", "lead", "none", "text"))):
                if held is not None and held[0] == p and done != p:
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(t)
                    if own:
                        done, held = p, None
                if not own:
                    held = (p, None if none else lead, t)
                if len(ids) >= 256:
                    yield pd.DataFrame(work(ids, texts, nexts))
                    ids, texts, nexts = [], [], []
            if ids:
                yield pd.DataFrame(work(ids, texts, nexts))

    return dealt.mapInPandas(run, schema)
