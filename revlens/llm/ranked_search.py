"""Ranked lexical search by pipelined term partitioning.

The index is cut into *blocks* of documents and its terms into *owners*.  A bundle of items
carries sparse accumulators (document, score) of one block through the owners one after the
other: each stage is a cogroup of the bundles with the postings of that stage's owner, which
adds its terms' integer contributions and hands the bundle on.  The last owner selects the
best of the block, an ordinary rank over all blocks the best of all.

Owners are ordered by term weight, rare terms first.  Before a bundle is handed on, a
document leaves its accumulators when even the highest contributions of all later owners
could not lift it to the ``top``-th score that the block already has: that many documents
stay above it, so the result is whole.

Terms are maximal runs of ASCII letters and digits and of all other code points from U+0080
on, with A-Z lower-cased.  Only terms of the items are indexed; document lengths and counts
are taken over all terms of all documents.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import cut, released, text_batches

OWNERS = 4
BUNDLE_ITEMS = 256           # items of a bundle
BLOCK_DOCS = 4_096           # documents of a block
BLOCK_POSTINGS = 1_000_000   # postings of a block (one document may have more)
MOST_PAIRS = 400_000         # (item, term) pairs looked up at once; more items go in several searches
SCALE = 1_000_000_000

_LETTER = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTER else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Plan:
    """What every stage knows of one search: bounded by ``MOST_PAIRS``."""
    weights: np.ndarray              # by term number, heaviest first
    owner: np.ndarray                # first term number of every owner, and the end
    bundles: list[list[np.ndarray]]  # per bundle, per item: its term numbers, ascending
    n_docs: int
    n_words: int

    def needed(self, bundle: int, stage: int) -> np.ndarray:
        low, high = self.owner[stage], self.owner[stage + 1]
        own = [t[np.searchsorted(t, low):np.searchsorted(t, high)] for t in self.bundles[bundle]]
        return np.unique(np.concatenate(own)) if own else np.empty(0, np.int32)

    def rest(self, own: np.ndarray, stage: int) -> int:
        """More than what the owners after ``stage`` can add to a document."""
        return int(self.weights[own[np.searchsorted(own, self.owner[stage + 1]):]].sum()) * (SCALE // 1000)


# ---------------------------------------------------------------- items and index

_TERMS = "item long, term binary"


def item_terms(items: DataFrame, item_id_col: str, text_col: str) -> DataFrame:
    """Distinct ``(item, term)``."""
    rows = items.select(F.col(f"`{item_id_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                found = list(dict.fromkeys(terms(text.as_py() or b"")))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item", "term"])

    return rows.mapInArrow(work, _TERMS).distinct()


_INDEX = "block long, ids binary, known binary, lengths binary, terms binary, docs binary, tf binary, stat int, n long"
_N_DOCS, _N_WORDS = -1, -2


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Blocks of postings (sorted by term) and, in rows of their own, the counts of every
    task: documents and occurrences, and for each term the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t"))
    names = [f.split()[0] for f in _INDEX.split(", ")]
    types = [pa.int64(), *[pa.binary()] * 6, pa.int32(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        df = np.zeros(len(shared.value), np.int64)
        n_docs = n_words = at = 0
        start = (TaskContext.get().partitionId()) << 32
        ids, lengths, found, places, counts = [], [], [], [], []

        def block() -> pa.RecordBatch:
            nonlocal at
            t, tf = np.array(found, np.int32), np.array(counts, np.int32)
            d = np.repeat(np.arange(len(places), dtype=np.int32), places)
            order = np.argsort(t, kind="stable")
            t, d, tf = t[order], d[order], tf[order]
            df[:] += np.bincount(t, minlength=len(df))
            row = [start + at, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids]).tobytes(),
                   np.array(lengths, "<i8").tobytes(), t.tobytes(), d.tobytes(), tf.tobytes(), None, None]
            at += 1
            for held in (ids, lengths, found, places, counts):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, types)], names=names)

        for batch in released(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py() or b"")
                if not words:
                    continue
                n_docs += 1
                n_words += len(words)
                own = [(k, c) for w, c in Counter(words).items() if (k := number(w)) is not None]
                if not own:
                    continue
                ids.append(i)
                lengths.append(len(words))
                places.append(len(own))
                for k, c in own:
                    found.append(k)
                    counts.append(c)
                if len(ids) >= BLOCK_DOCS or len(found) >= BLOCK_POSTINGS:
                    yield block()
        if ids:
            yield block()
        some = np.flatnonzero(df)
        stat, n = [_N_DOCS, _N_WORDS, *some.tolist()], [n_docs, n_words, *df[some].tolist()]
        empty = [pa.nulls(len(stat), t) for t in types[:-2]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(stat, pa.int32()), pa.array(n, pa.int64())], names=names)

    return rows.mapInArrow(work, _INDEX)


# ---------------------------------------------------------------- stages

_BUNDLE = "block long, bundle int, ids binary, known binary, lengths binary, sums binary"
_POSTED = "block long, bundle int, terms binary, docs binary, tf binary"


def pack(sums: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Sparse accumulators of the items of a bundle: (places in the block, scores) each."""
    return b"".join([struct.pack("<I", len(sums)), *(struct.pack("<I", len(d)) for d, _ in sums),
                     *(x for d, s in sums for x in (d.astype("<i4").tobytes(), s.astype("<i8").tobytes()))])


def unpack(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    items = struct.unpack_from("<I", data)[0]
    at, out = 4 + 4 * items, []
    for n in struct.unpack_from(f"<{items}I", data, 4):
        out.append((np.frombuffer(data, "<i4", n, at), np.frombuffer(data, "<i8", n, at + 4 * n)))
        at += 12 * n
    return out


def _select(ids, known, places, scores, top: int):
    """The best ``top`` of a block: highest score, then smallest id, ids that are null last."""
    if len(places) > top:
        order = np.lexsort((ids[places], ~known[places], -scores))[:top]
        places, scores = places[order], scores[order]
    return places, scores


def _stage(bundles: DataFrame, posted: DataFrame, plan, stage: int, top: int, last: bool) -> DataFrame:
    """Bundles with the contributions of one owner; after the last one, the best of the block
    as rows ``item_no, doc_id, score``."""

    def add(left: pa.Table, right: pa.Table) -> tuple[dict, list, np.ndarray, np.ndarray]:
        p: Plan = plan.value
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        ids, known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool)
        items = p.bundles[row["bundle"]]
        before = unpack(row["sums"]) if row["sums"] is not None else [(np.empty(0, np.int32), np.empty(0, np.int64))] * len(items)
        if right.num_rows:
            t, d, tf = (np.frombuffer(right.column(c)[0].as_py(), np.int32) for c in ("terms", "docs", "tf"))
        else:
            t = d = tf = np.empty(0, np.int32)
        m = 50 + 50 * np.frombuffer(row["lengths"], "<i8") * p.n_docs // max(p.n_words, 1)
        tf = tf.astype(np.int64)
        value = SCALE * tf // (1000 * tf + 20 * m[d]) * p.weights[t]
        here, starts = np.unique(t, return_index=True)
        ends = np.append(starts[1:], len(t))
        after = []
        for own, (places, scores) in zip(items, before):
            total = np.zeros(len(ids), np.int64)
            total[places] = scores
            mine = own[np.searchsorted(own, p.owner[stage]):np.searchsorted(own, p.owner[stage + 1])]
            for k in np.searchsorted(here, np.intersect1d(mine, here, assume_unique=True)):
                total[d[starts[k]:ends[k]]] += value[starts[k]:ends[k]]
            places = np.flatnonzero(total)
            scores = total[places]
            if not last and len(places) > top:
                kth = np.partition(scores, len(scores) - top)[len(scores) - top]
                held = scores + p.rest(own, stage) >= kth
                places, scores = places[held], scores[held]
            after.append((places, scores) if not last else _select(ids, known, places, scores, top))
        return row, after, ids, known

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        row, after, _, _ = add(left, right)
        return left.set_column(left.column_names.index("sums"), "sums", pa.array([pack(after)], pa.binary()))

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        row, after, ids, known = add(left, right)
        numbers = np.concatenate([np.full(len(d), row["bundle"] * BUNDLE_ITEMS + k, np.int64) for k, (d, _) in enumerate(after)])
        places = np.concatenate([d for d, _ in after]).astype(np.int64)
        return pa.table({"item_no": numbers, "doc_id": pa.array(ids[places], pa.int64(), mask=~known[places]), "score": np.concatenate([s for _, s in after])})

    met = bundles.groupBy("block", "bundle").cogroup(posted.groupBy("block", "bundle"))
    return met.applyInArrow(select, "item_no long, doc_id long, score long") if last else met.applyInArrow(hand_on, _BUNDLE)


def _posted(blocks: DataFrame, plan, stage: int) -> DataFrame:
    """The owner's postings of every block, for every bundle those of its terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        needed = [p.needed(b, stage) for b in range(len(p.bundles))]
        for batch in released(batches):
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                t, d, tf = (np.frombuffer(row[c], np.int32) for c in ("terms", "docs", "tf"))
                low, high = np.searchsorted(t, p.owner[stage]), np.searchsorted(t, p.owner[stage + 1])
                t, d, tf = t[low:high], d[low:high], tf[low:high]
                for b, own in enumerate(needed):
                    hit = np.isin(t, own) if len(p.bundles) > 1 else slice(None)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]], pa.int64()), pa.array([b], pa.int32()), *(pa.array([x[hit].tobytes()], pa.binary()) for x in (t, d, tf))],
                        names=["block", "bundle", "terms", "docs", "tf"])

    return blocks.select("block", "terms", "docs", "tf").mapInArrow(work, _POSTED)


def _ordered(df: dict[int, int], vocabulary: dict[bytes, int], wanted: dict[int | None, list[bytes]], n_docs: int, n_words: int, owners: int):
    """The plan, and the new number of every term: by falling weight, cut into owners of
    about equal postings."""
    names = list(vocabulary)
    count = np.array([df.get(k, 0) for k in range(len(names))], np.int64)
    order = np.argsort(count, kind="stable")
    new = np.empty(len(names), np.int32)
    new[order] = np.arange(len(names), dtype=np.int32)
    mass = np.cumsum(count[order])
    cuts = [int(np.searchsorted(mass, mass[-1] * s / owners)) for s in range(1, owners)] if len(mass) else [0] * (owners - 1)
    owner = np.maximum.accumulate(np.array([0, *cuts, len(names)], np.int64))
    weights = np.array([weight(n_docs, int(c)) for c in count[order]], np.int64)
    lists = [np.sort(new[[vocabulary[t] for t in own]]) for own in wanted.values()]
    bundles = [lists[k:k + BUNDLE_ITEMS] for k in range(0, len(lists), BUNDLE_ITEMS)]
    return Plan(weights, owner, bundles, n_docs, n_words), new


def _renumbered(blocks: DataFrame, new) -> DataFrame:
    """Postings with the plan's term numbers, sorted by them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                t, d, tf = (np.frombuffer(row[c], np.int32) for c in ("terms", "docs", "tf"))
                t = new.value[t]
                order = np.argsort(t, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([x[order].tobytes()], pa.binary()) for x in (t, d, tf))],
                                                 names=["block", "terms", "docs", "tf"])

    return blocks.select("block", "terms", "docs", "tf").mapInArrow(work, "block long, terms binary, docs binary, tf binary")


def _search(docs: DataFrame, wanted: dict[int | None, list[bytes]], top: int, owners: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for own in wanted.values() for t in own}))}
    built = cut(index(docs, vocabulary, id_col, text_col), "search-index")
    stats = {r["stat"]: r["n"] for r in built.where("stat IS NOT NULL").groupBy("stat").agg(F.sum("n").alias("n")).collect()}
    plan, new = _ordered(stats, vocabulary, wanted, stats.get(_N_DOCS, 0), stats.get(_N_WORDS, 0), owners)
    shared, renamed = spark.sparkContext.broadcast(plan), spark.sparkContext.broadcast(new)
    blocks = built.where("block IS NOT NULL")
    postings = _renumbered(blocks, renamed)
    bundles = (blocks.select("block", "ids", "known", "lengths")
               .withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(len(plan.bundles) - 1))))
               .select("block", "bundle", "ids", "known", "lengths", F.lit(None).cast("binary").alias("sums")))
    for stage in range(owners):
        bundles = _stage(bundles, _posted(postings, shared, stage), shared, stage, top, stage == owners - 1)
    best = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = bundles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(wanted)], "no long, item_id long")
    return ranked.join(names, F.col("item_no") == F.col("no")).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", owners: int = OWNERS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents with a score above 0,
    highest first, equal scores by ascending id (null ids last, equal ids in any order).

    N is the number of documents with a term, L their terms with repeats, n a document's,
    df the documents that hold a term.  ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``,
    ``m = 50 + (50 n N) div L``; a term adds ``w ((10^9 tf) div (1000 tf + 20 m))``.

    Every row of ``docs`` is a document of its own, rows of one id and equal texts too; null
    and empty texts have no term and are not found.  Rows of one item id, null included, are
    one item with the terms of all its rows; an item without terms has no result.  Other
    columns are not read.  Empty tables give an empty result.
    """
    text_batches(docs)
    pairs = cut(item_terms(items, item_id_col, item_text_col), "search-items")
    parts = max(1, math.ceil(pairs.count() / most_pairs))
    found = None
    for k in range(parts):
        wanted: dict[int | None, list[bytes]] = {}
        for r in pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).orderBy("item", "term").collect():
            wanted.setdefault(r["item"], []).append(bytes(r["term"]))
        if wanted:
            some = _search(docs, wanted, top, owners, id_col, text_col)
            some = cut(some, "search-part") if parts > 1 else some
            found = some if found is None else found.unionAll(some)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def oracle(top: int = 50, docs: str = "documents", items: str = "benchmark") -> str:
    """The same for DuckDB: every item against all postings."""
    found = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH words AS (SELECT doc_id, unnest({found}) AS term FROM {docs}),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM {items}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, nn),
gain AS (SELECT tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))) AS g
         FROM tf JOIN df USING (term) JOIN lengths ON lengths.doc_id = tf.doc_id, totals),
scores AS (SELECT item_id, doc_id, CAST(sum(g) AS BIGINT) AS score FROM wanted JOIN gain USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {top}"""
