"""Helpers shared by the operators: written intermediate tables, word and shingle
hashes, connected components."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import scratch_path

U64 = np.uint64


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table under the cluster's shared checkpoint folder and read
    it back: the lineage ends at files that outlive any executor."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` (of fixed width) are within
    ``most_rows``; otherwise unmarked, so that the join shuffles."""
    return F.broadcast(df) if rows <= most_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(df: DataFrame, rows: int = 1_000) -> None:
    """Arrow batches of at most ``rows`` rows for this session: batches of whole texts are
    large, and both the JVM and the Python worker hold several of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(key, str(rows))


def released(batches):
    """Pass Arrow batches on and give the pool's free memory back as they are done with: an
    idle worker would keep it."""
    import pyarrow as pa
    for k, batch in enumerate(batches):
        yield batch
        if k % 8 == 7:
            pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- word hashes

def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n, base, U64)
        down = np.full(n, inverse, U64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


BLOCK = 1 << 18        # bytes hashed at once
LONG_WORD = 2048       # longer words are hashed one by one with BLAKE2
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: list = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over an array of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _hash_block(a: np.ndarray) -> np.ndarray:
    inside = np.empty(len(a) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SEPARATOR[a], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U64)
    if not _tables or len(_tables[0]) < len(a):
        _tables[:] = _powers(max(len(a), BLOCK))
    up, down = _tables
    with np.errstate(over="ignore"):
        total = np.cumsum((_LOWER[a].astype(U64) + U64(1)) * up[: len(a)], dtype=U64)
        before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], U64(0))
        out = mix((total[ends - 1] - before) * down[starts] + (ends - starts).astype(U64))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        word = _LOWER[a[starts[k]:ends[k]]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, in
    order.  Long texts are hashed block by block, cut at separators."""
    if not text:
        return np.empty(0, U64)
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(a) <= BLOCK:
        return _hash_block(a)
    parts, at = [], 0
    while at < len(a):
        end = min(at + BLOCK, len(a))
        while end < len(a):
            gaps = np.flatnonzero(_SEPARATOR[a[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + BLOCK, len(a))
        parts.append(_hash_block(a[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the word ``width``-grams in order; fewer words give one shingle of the
    whole sequence, no word gives none."""
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - w + 1, U64(0xA0761D6478BD642F) * U64(w), U64)
        for k in range(w):
            out = mix(out ^ words[k: n - w + 1 + k]) + U64(k + 1)
    return out


# ---------------------------------------------------------------- components

def components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of the undirected ``edges (src, dst)``: component is the
    smallest node reachable.  Only nodes with an edge appear.

    Alternating large-star and small-star rounds (logarithmic in practice); each round
    is two aggregates and joins on node ids, written to the shared folder.
    """
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    e = cut(e.where(F.col("a") < F.col("b")).distinct(), name)
    state = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u hangs under the smallest of u's neighbourhood
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = (both.where(F.col("v") > F.col("u")).join(low, "u")
             .select(F.col("m").alias("a"), F.col("v").alias("b")).where(F.col("a") < F.col("b")).distinct())
        # small star: u and its smaller neighbours hang under the smallest of them
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        joined = e.join(low, "b")
        e = cut(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
                .unionAll(low.select(F.col("m").alias("a"), F.col("b")))
                .where(F.col("a") < F.col("b")).distinct(), name)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots)
        state = now
    raise RuntimeError("components did not settle")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
