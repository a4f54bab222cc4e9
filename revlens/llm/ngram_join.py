"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word n-grams columns of an incidence matrix A; the entries of
A A^T are overlap counts, and J >= t follows from overlap and row sums alone.

Which entries can count at all: two rows of sizes n1 <= n2 with J >= t differ in at most
``D = (n1 + n2)(1 - t)/(1 + t)`` columns.  For each range of sizes the columns are cut by
their hash into more than D blocks, so of any D + 1 blocks such a pair has one in which
both rows are equal.  Equal block rows (compared by digest) are joined by stars, never by
pairs; their connected groups are the diagonal blocks of the product outside which no
entry reaches the bound.

Digests that many rows share, say those of a passage that runs through the corpus, would
tie unlike rows into one huge block.  They are counted over all rows, and a row gives its
rarest ones first and no more than the bound asks for (see ``signatures``).

Every diagonal block is multiplied exactly, in square tiles of rows and slices of columns
(a block of several tiles first loses the columns that one row has alone and the rows that
share too few, see ``_multiply``):
overlaps accumulate slice by slice, and pairs whose count plus what is left cannot reach
the size-derived bound are dropped on the way.  A tile gives out a spanning forest of the
links it found, never all pairs, so no link between components is lost and the output
stays linear.  The links' components are the result.

Cost: signatures are linear in the text.  A diagonal block of m distinct sets costs m^2/2
count entries inside tasks, dealt over tiles; equal sets collapse before that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import U64, components, cut, mix, released, shingle_hashes, small_side, text_batches, word_hashes

ENTRIES_HELD = 400_000      # signature entries a task gathers before it deals them out
TILE_ROWS = 256
TILE_COLUMNS = 2048
TILE_ENTRIES = 200_000
SLICE_ENTRIES = 500_000     # entries of a block whose columns are counted at once
MOST_PARTS = 1 << 20        # bound of the parts of a band
MOST_BROADCAST_TILES = 200_000
MOST_BROADCAST_IDS = 2_000_000
ROWS_PER_BUCKET = 20_000      # about a million signature entries
MOST_COMMON = 500_000       # bound of the common signatures shipped; fewer cost time, not links
SET_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())


class Bound:
    """The threshold t = num/den and what follows from it."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("threshold must be in (0, 1]")
        self.num, self.den = num, den
        self.ratio = 1.25
        self.starts = [1]

    def differ(self, n1: int, n2: int) -> int:
        """Most columns in which two linked rows differ."""
        return (n1 + n2) * (self.den - self.num) // (self.den + self.num)

    def overlap(self, n1, n2):
        """Least overlap of two linked rows: den * o >= num * (n1 + n2 - o)."""
        return -((n1 + n2) * self.num // -(self.num + self.den))

    def start(self, g: int) -> int:
        """Smallest size in size range g."""
        while len(self.starts) <= g:
            self.starts.append(int(self.starts[-1] * self.ratio) + 1)
        return self.starts[g]

    def ranges(self, n: int) -> list[int]:
        """Size ranges in which a row of size n can meet a partner that is not smaller."""
        g = max(0, int(math.log(max(n, 1)) / math.log(self.ratio)) - 8)
        while self.start(g + 1) <= n:
            g += 1
        while self.start(g) > n:
            g -= 1
        out = [g]
        while self.num * self.start(out[-1] + 1) <= self.den * n:
            out.append(out[-1] + 1)
        return out

    def blocks(self, g: int) -> tuple[int, int]:
        """(D, number of column blocks) for pairs whose larger row lies in range g."""
        most = self.start(g + 1) - 1
        d = self.differ(most, most)
        if not d:
            return 0, 1
        least = max(1, -(-self.start(g) * self.num // self.den))
        spare = 2 + d * 3 // 10
        k = d + 1
        for _ in range(3):
            k = d + 1 + spare + math.ceil(k * math.exp(-least / k))
        return d, k


def signatures(found: np.ndarray, bound: Bound, common: tuple[np.ndarray, np.ndarray] | None = None, every: bool = False) -> np.ndarray:
    """Digests of block rows of one document (sorted distinct column hashes).

    All digests have one global order: rare before common, full blocks before thin ones,
    empty blocks last, then by value.  A row gives its first D + 1 (``every``: all that are
    not empty).  Of two linked rows take the one whose last digest comes earlier: one of its
    D + 1 blocks is the same in the other row, where it also comes early enough to be given.
    So the pair meets whatever the order is, and ``common`` - sorted digests that many rows
    have, with a level by how many - only decides how many unlike rows meet as well.
    """
    out = []
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(found + U64(0x632BE59BD9B4E019)), dtype=U64)])
        for g in bound.ranges(len(found)):
            d, k = bound.blocks(g)
            part = ((found >> U64(32)) * U64(k)) >> U64(32)
            edges = np.searchsorted(part, np.arange(k + 1, dtype=U64))
            tag = U64(0x2545F4914F6CDD1D) * (U64(g + 1) * U64(1 << 20) + np.arange(k, dtype=U64) + U64(1))
            own = mix((total[edges[1:]] - total[edges[:-1]]) ^ mix(tag))
            size = edges[1:] - edges[:-1]
            if every:
                out.append(own[size > 0])
                continue
            level = 100 + np.minimum(size, 3)
            if common is not None and len(common[0]):
                at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
                level = np.where(common[0][at] == own, 100 - common[1][at].astype(np.int64), level)
            level = np.where(size == 0, 0, level)
            out.append(own[np.lexsort((own, -level))[:d + 1]])
    return np.concatenate(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), width))


def _star(sig: np.ndarray, node: np.ndarray):
    """Of entries (signature, node): one entry a signature, with its smallest node, and
    the edges from that node to the signature's other nodes."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.empty(len(sig), bool)
    head[:1] = True
    np.not_equal(sig[1:], sig[:-1], out=head[1:])
    lead = node[head][np.cumsum(head) - 1]
    other = ~head & (lead != node)
    edges = np.unique(np.stack([lead[other], node[other]], axis=1), axis=0) if other.any() else np.empty((0, 2), np.int64)
    return sig[head], node[head], edges


def _base(docs: DataFrame, width: int, bound: Bound) -> DataFrame:
    """Rows ``(doc_id, n_shingles, key, seen)``: with ``seen`` null one for each document,
    whose key is a digest of its set; else a signature (in doc_id) that came ``seen`` times
    among the documents that a task held at once."""
    names = ["doc_id", "n_shingles", "key", "seen"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, held = [], 0

        def often():
            own, times = np.unique(np.concatenate(sigs), return_counts=True)
            many = times > 1
            sigs.clear()
            none = pa.nulls(int(many.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(own[many].view(np.int64)), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(times[many])], names=names)

        for batch in released(batches):
            n, key = [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), width)
                n.append(len(found))
                key.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                if len(found):
                    sigs.append(signatures(found, bound, every=True))
                    held += len(sigs[-1])
                if held >= ENTRIES_HELD:
                    yield from often()
                    held = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.nulls(len(n)).cast(pa.int64())], names=names)
        if held:
            yield from often()

    return docs.mapInArrow(work, "doc_id long, n_shingles long, key binary, seen long")


def _common(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that came often, with their level (the binary logarithm of how often):
    the highest levels that hold at most ``MOST_COMMON`` together."""
    counted = cut(seen.groupBy("doc_id").agg(F.sum("seen").alias("n")).select("doc_id", F.floor(F.log2("n")).cast("int").alias("level")), "jaccard-seen")
    least, held = 99, 0
    for r in sorted(counted.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        if held + r["n"] > MOST_COMMON:
            break
        least, held = r["level"], held + r["n"]
    rows = counted.where(F.col("level") >= least).toArrow()
    sig, level = rows.column("doc_id").to_numpy().view(U64), rows.column("level").to_numpy()
    order = np.argsort(sig)
    return sig[order], level[order].astype(np.uint8)


def _deal(docs: DataFrame, width: int, bound: Bound, buckets: int, common) -> DataFrame:
    """Signature entries dealt to buckets, and the edges already found in the task: a
    signature leaves a task once however many rows there have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, held = [], [], 0

        def flush():
            sig, node, edges = _star(np.concatenate(sigs), np.concatenate(nodes))
            which = (sig >> U64(16)) % U64(buckets)
            order = np.argsort(which, kind="stable")
            sig, node, which = sig[order], node[order], which[order].astype(np.int32)
            starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            ends = np.append(starts[1:], len(which))
            rows = [(int(which[a]), sig[a:b].tobytes(), node[a:b].tobytes(), b"") for a, b in zip(starts, ends)]
            for at in range(0, len(edges), 4096):
                rows.append((int(edges[at, 0]) % buckets, b"", b"", edges[at:at + 4096].tobytes()))
            sigs.clear(), nodes.clear()
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at:at + 512]], t) for k, t in enumerate(
                    (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "sig", "node", "edges"])

        for batch in released(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingle_set(text.as_py(), width)
                if i is None or not len(found):
                    continue
                own = signatures(found, bound, common.value)
                sigs.append(own)
                nodes.append(np.full(len(own), i, np.int64))
                held += len(own)
                if held >= ENTRIES_HELD:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    return docs.mapInArrow(work, "bucket int, sig binary, node binary, edges binary")


def _meet(bucket: pd.DataFrame) -> pd.DataFrame:
    sig = np.frombuffer(b"".join(bucket["sig"]), U64)
    node = np.frombuffer(b"".join(bucket["node"]), np.int64)
    known = np.frombuffer(b"".join(bucket["edges"]), np.int64).reshape(-1, 2)
    edges = np.concatenate([known, _star(sig, node)[2]])
    return pd.DataFrame({"src": edges[:, 0], "dst": edges[:, 1]})


def tile_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, bound: Bound, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the linked pairs of one tile.  ``side`` is 0 or 1; with both
    present only pairs across count (the pairs within are another tile's).  ``sizes`` are those
    of the whole sets, where ``sets`` lack columns that no other row has."""
    sizes = np.array([len(s) for s in sets]) if sizes is None else sizes
    m = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]).astype(np.int64)]))
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    left = np.bincount(row, minlength=m)          # entries of each row not yet counted
    need = bound.overlap(sizes[:, None], sizes[None, :])
    live = np.triu(np.ones((m, m), bool), 1)
    if side.any() and not side.all():
        cross = side[:, None] != side[None, :]
        live = np.triu(cross, 1)
    count = np.zeros((m, m), np.float32)
    live &= (np.minimum(left[:, None], left[None, :]) >= need) & (need > 0)      # empty sets need nothing and share nothing
    at = 0
    while at < len(row) and live.any():
        first = column[at]
        end = int(np.searchsorted(column, first + TILE_COLUMNS, side="left"))
        _, dense = np.unique(column[at:end], return_inverse=True)
        a = np.zeros((m, int(dense.max()) + 1), np.float32)
        a[row[at:end], dense] = 1
        alive = np.flatnonzero(live.any(axis=0) | live.any(axis=1))
        a = a[alive]
        count[np.ix_(alive, alive)] += a @ a.T
        left -= np.bincount(row[at:end], minlength=m)
        live &= count + np.minimum(left[:, None], left[None, :]) >= need
        at = end
    root, out = np.arange(m), []
    for i, j in zip(*np.nonzero(live & (count >= need))):
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            out.append((int(ids[i]), int(ids[j])))
    return out


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the set of a document holds its
    distinct ``width``-word shingles (fewer words: the whole sequence).  Two documents are
    linked when ``den * |A & B| >= num * |A | B|``; component_id is the smallest id that
    links reach.  A text that is null, empty or without words has no shingle, and its row
    is alone.  Rows of one id count as one document with several texts; rows with a null
    id are alone, with a null component.
    """
    text_batches(docs)
    bound = Bound(num, den)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = cut(_base(rows, width, bound), "jaccard-base")
    base = both.where("seen IS NULL").drop("seen")
    common = docs.sparkSession.sparkContext.broadcast(_common(both.where("seen IS NOT NULL")))
    full = base.where("key IS NOT NULL AND doc_id IS NOT NULL")
    heads = full.groupBy("key", "n_shingles").agg(F.min("doc_id").alias("head"))
    head_of = cut(full.select("doc_id", "key").join(heads, "key").select("doc_id", "head", F.col("n_shingles").alias("n")).distinct(), "jaccard-heads")
    buckets = max(24, min(1 << 20, base.count() // ROWS_PER_BUCKET))
    # of equal sets only the representative is looked at; the others share its fate
    copies = cut(head_of.groupBy("doc_id").agg(F.bool_or(F.expr("doc_id = head")).alias("own")).where("NOT own").select("doc_id"), "jaccard-copies")
    alone = rows.join(small_side(copies, copies.count(), MOST_BROADCAST_IDS), "doc_id", "left_anti")
    # an edge comes from every bucket in which both its ends meet: once is enough
    star = _deal(alone, width, bound, buckets, common).groupBy("bucket").applyInPandas(_meet, "src long, dst long").distinct()
    star = cut(star, "jaccard-stars")
    near = (star.join(head_of.select(F.col("doc_id").alias("src"), F.col("head").alias("a")), "src")
            .join(head_of.select(F.col("doc_id").alias("dst"), F.col("head").alias("b")), "dst")
            .where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    group = components(near, "jaccard-blocks")
    links = _multiply(rows, head_of, group, width, bound)
    # documents with several texts tie their sets together
    several = head_of.where("doc_id <> head").select(F.col("doc_id").alias("src"), F.col("head").alias("dst"))
    tied = several.join(head_of.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("src")), "src", "left_semi")
    found = cut(components(links.unionAll(tied.select("src", "dst")), "jaccard-links"), "jaccard-found")
    one = head_of.groupBy("doc_id").agg(F.min("head").alias("head"))
    named = (one.join(found, F.col("head") == F.col("node"), "left")
             .select(F.col("doc_id").alias("id"), F.coalesce("component", "head").alias("component_id")))
    return (base.join(named, F.col("doc_id") == F.col("id"), "left")
            .select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def _tiles(sized: DataFrame, bound: Bound) -> DataFrame:
    """Tiles of the rows ``sized (block, doc_id, key, n, held)``: ``(block, doc_id, key, tiles)``
    with ``tiles`` an array of (i, j, side).

    A block that does not fit one tile is cut by size into bands, each as wide as the sizes of
    two linked rows can differ, so rows meet those of their own and the next bands only; a
    band of many rows is cut into parts."""
    block = sized.groupBy("block").agg(F.count("*").alias("m"), F.sum("held").alias("entries")).where("m > 1")
    one = (F.col("m") <= 2 * TILE_ROWS) & (F.col("entries") <= 2 * TILE_ENTRIES)
    # a little wider than den / num, so that rounding never puts linked rows two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(bound.den / bound.num * (1 + 1e-9))).cast("bigint")
    rows = sized.join(block.select("block", one.alias("one")), "block").withColumn("band", F.when(F.col("one"), F.lit(0)).otherwise(band).cast("bigint"))
    parts = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("held") / TILE_ENTRIES), F.lit(1))
    bands = rows.groupBy("block", "band").agg(F.when(F.bool_or("one"), 1).otherwise(parts).cast("int").alias("parts"))
    by = Window.partitionBy("block").orderBy("band")
    beside = lambda step: F.when(F.lag("band", step).over(by) == F.col("band") - step, F.lag("parts", step).over(by)).otherwise(0)
    bands = bands.select("block", "band", "parts", beside(1).alias("below"), beside(-1).alias("above"))
    c = F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")).cast("bigint")
    dealt = rows.join(bands, ["block", "band"]).select("block", "doc_id", "key", "band", "parts", "below", "above", c.alias("c"))
    at = lambda band, part: band * MOST_PARTS + part
    own = lambda o: F.struct(at(F.col("band"), F.least("c", o)).alias("i"), at(F.col("band"), F.greatest("c", o)).alias("j"), (F.col("c") > o).cast("int").alias("side"))
    up = lambda o: F.struct(at(F.col("band"), F.col("c")).alias("i"), at(F.col("band") + 1, o).alias("j"), F.lit(0).alias("side"))
    down = lambda o: F.struct(at(F.col("band") - 1, o).alias("i"), at(F.col("band"), F.col("c")).alias("j"), F.lit(1).alias("side"))
    each = lambda n, tile: F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint")), lambda o: o < F.col(n)), tile)
    return dealt.select("block", "doc_id", "key", F.concat(each("parts", own), each("above", up), each("below", down)).alias("tiles"))


def _shared(piece: pa.Table) -> pa.Table:
    """Of one slice of the columns of a block: what each row has of the columns of two rows or more."""
    found = [np.frombuffer(x.as_py(), U64) for x in piece.column("found")]
    sizes = np.array([len(f) for f in found])
    flat = np.concatenate(found)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times[column] > 1
    ends = np.cumsum(sizes)
    left = [flat[a:b][many[a:b]] for a, b in zip(ends - sizes, ends)]
    some = pa.array([k for k, f in enumerate(left) if len(f)], pa.int64())
    out = piece.select(["block", "doc_id", "key", "n"]).take(some)
    return out.append_column("found", pa.array([f.tobytes() for f in left if len(f)], pa.binary()))


def _multiply(rows: DataFrame, head_of: DataFrame, group: DataFrame, width: int, bound: Bound) -> DataFrame:
    """Links ``(src, dst)`` within the diagonal blocks ``group (node, component)``.

    A block of one tile is multiplied as it is.  Of a larger one the columns that a single row
    has count in no overlap, and a linked row shares at least t of its own columns: the rest
    goes, slice of columns by slice, before rows are sent once for every tile."""
    sized = head_of.where("doc_id = head").select("head", "n")
    member = cut(sized.join(group, F.col("head") == F.col("node")).select("head", "n", F.col("component").alias("block")), "jaccard-members")
    blocks = member.groupBy("block").agg(F.count("*").alias("m"), F.sum("n").alias("entries")).where("m > 1")
    slices = F.when((F.col("m") <= 2 * TILE_ROWS) & (F.col("entries") <= 2 * TILE_ENTRIES), 0).otherwise(F.ceil(F.col("entries") / SLICE_ENTRIES)).cast("int")
    ids = cut(member.join(blocks.withColumn("slices", slices), "block").select(F.col("head").alias("doc_id"), "block", "slices").distinct(), "jaccard-dealt")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            block, ids, cuts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "doc_id", "slices"))
            out, held = [], 0
            for k, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                # another text of a document that is here may be empty: it is linked with nothing
                found = shingle_set(text.as_py(), width)
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                part = ((found >> U64(32)) * U64(max(cuts[k], 1))) >> U64(32)
                edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(found) else []
                for a, b in zip(edges[:-1], edges[1:]):
                    out.append((block[k], int(part[a]), ids[k], key, len(found), found[a:b].tobytes()))
                held += len(found)
                if held > ENTRIES_HELD or len(out) and k == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), SET_TYPES)], names=["block", "slice", "doc_id", "key", "n", "found"])
                    out, held = [], 0

    def whole(some: DataFrame) -> DataFrame:
        own = rows.join(small_side(some, some.count(), MOST_BROADCAST_IDS), "doc_id").select("doc_id", "block", "slices", "text")
        return own.mapInArrow(sets, "block long, slice int, doc_id long, key binary, n long, found binary")

    small = whole(ids.where("slices = 0")).select("block", F.array(F.struct(
        F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(0).alias("side"))).alias("tiles"), "doc_id", "key", "n", "found")
    tiled = small
    if ids.where("slices > 0").limit(1).count():
        shared = cut(whole(ids.where("slices > 0")).groupBy("block", "slice").applyInArrow(_shared, "block long, doc_id long, key binary, n long, found binary"), "jaccard-shared")
        held = shared.groupBy("block", "doc_id", "key", "n").agg((F.sum(F.octet_length("found")) / 8).cast("bigint").alias("held"))
        tiles = cut(_tiles(held.where(F.col("held") * bound.den >= F.col("n") * bound.num), bound), "jaccard-tiles")
        tiled = tiled.unionByName(shared.join(small_side(tiles, tiles.count(), MOST_BROADCAST_TILES), ["block", "doc_id", "key"]))
    tiled = tiled.select("block", "doc_id", "key", "n", "found", F.inline("tiles"))

    def work(tile: pa.Table) -> pa.Table:
        ids, key, n, side = (tile.column(c).to_pylist() for c in ("doc_id", "key", "n", "side"))
        found: dict = {}
        for k, piece in enumerate(tile.column("found")):
            found.setdefault((ids[k], key[k], n[k], side[k]), []).append(np.frombuffer(piece.as_py(), U64))
        own = [np.array([r[c] for r in found]) for c in (0, 2, 3)]
        sets = [np.unique(np.concatenate(f)) if len(f) > 1 else f[0] for f in found.values()]
        out = tile_links(own[0], sets, own[2], bound, own[1]) if len(sets) > 1 else []
        return pa.table({"src": pa.array([a for a, _ in out], pa.int64()), "dst": pa.array([b for _, b in out], pa.int64())})

    return cut(tiled.groupBy("block", "i", "j").applyInArrow(work, "src long, dst long"), "jaccard-product")
