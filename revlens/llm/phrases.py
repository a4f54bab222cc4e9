"""Phrase collocation mining by SON partitioning.

The documents are cut into shards.  Every shard is mined completely, level by level, for the
phrases that reach the proportionally lowered support ``ceil(least * share)`` in it, its share
being its part of all bytes of text: as the shares sum to one, a phrase with ``least``
occurrences reaches it in some shard, so the union of the locally frequent phrases misses
none.  A second pass counts every phrase of the union in all shards, exactly.

This is done twice: for words and pairs, and for longer phrases, which may only be built of
pairs that are frequent in the whole table.  Where shards are so many that the local support
falls to one, that bound still holds the candidates down.

To the counting pass the union goes as a bitmap of hashed phrases of bounded size: a phrase
that shares a bit with a candidate is counted in vain and falls out in the join.  Phrases are
told apart by 64-bit hashes of language and words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import U64, cut, mix, released, text_batches
from revlens.sources.tables import spread

LEAST = 100                  # occurrences of a candidate
LONGEST = 5                  # words of a phrase
SHARD_BYTES = 64 << 20       # text of a shard (a single longer text is a shard of its own)
SHARDS = 12                  # shards at least, as far as the table has splits
SLICE = 1 << 20              # bytes split into words, or places looked at, at once
CLASS_KEYS = 2 << 20         # keys sorted at once
MOST_BITS = 29               # the bitmap has at most 2^29 bits (64 MiB)
_BUCKET_BITS = 15            # bits of a row of the bitmap aggregate

_BREAK = 0xFF                # never a byte of UTF-8
_FOLD = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Numbers(dict):
    """Word -> number in order of first sight; 0 is the break between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Word numbers of the texts of a shard, language by language."""

    def __init__(self):
        self.numbers, self.parts, self.words, self.size = _Numbers({bytes([_BREAK]): 0}), {}, {}, 0

    def add(self, lang: str, text: bytes) -> None:
        self.size += len(text)
        held, count, at = self.parts.setdefault(lang, []), 0, 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):          # cut at a space, so that no word is cut
                found = text.find(b" ", end)
                end = len(text) if found < 0 else found
            words = text[at:end].translate(_FOLD).replace(b"\xff", b" \xff ").split()
            ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            count += int(np.count_nonzero(ids))
            held.append(ids)
            at = end
        held.append(np.zeros(1, np.int32))
        self.words[lang] = self.words.get(lang, 0) + count

    def languages(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Language, word numbers of its texts, and the 64-bit hash of every number.  The texts
        are given up one by one: a shard is read once."""
        import xxhash
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), U64, len(self.numbers))
        while self.parts:
            lang, parts = self.parts.popitem()
            ids = np.concatenate(parts)
            del parts
            yield lang, ids, mix(hashes ^ U64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1)))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * U64(0x9E3779B97F4A7C15) + word)


def _has(bitmap: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    bits, held = bitmap
    place = h >> U64(64 - bits)
    return (held[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1


def _chain(ids: np.ndarray, at: np.ndarray, words: int, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the phrases at ``at``."""
    h = hashes[ids[at]]
    for k in range(1, words):
        h = _longer(h, hashes[ids[at + k]])
    return h


def _grow(kept: np.ndarray, low: int, high: int, words: int) -> np.ndarray:
    """Places from ``low`` to ``high`` at which both phrases shorter by one word were kept."""
    high = min(high, len(kept) - words + 1)
    return np.flatnonzero((kept[low:high] > 0) & (kept[low + 1:high + 1] > 0)) + low if high > low else np.empty(0, np.int64)


def _allowed(ids: np.ndarray, hashes: np.ndarray, pairs) -> np.ndarray:
    """Where a pair of words begins that has its bit in ``pairs``."""
    kept = np.zeros(len(ids), bool)
    for low in range(0, len(ids), SLICE):
        at = _grow(ids, low, low + SLICE, 2)
        kept[at] = _has(pairs, _chain(ids, at, 2, hashes))
    return kept


def _frequent(ids: np.ndarray, shorter: np.ndarray, places_in, words: int, vocabulary: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every phrase of ``words`` words that comes ``least`` times a place, and the code of
    the frequent phrase at every place (0: none).  ``shorter`` tells the phrases of the first
    words apart, ``places_in(low, high)`` are the places to look at.  Keys are worked out slice
    by slice and sorted class by class, so that about ``CLASS_KEYS`` of them are held at once."""
    classes = max(1, -(-sum(len(places_in(low, low + SLICE)) for low in range(0, len(ids), SLICE)) // CLASS_KEYS))
    code, owners, known = np.zeros(len(ids), np.int32), [], 0
    for c in range(classes):
        keys, places = [], []
        for low in range(0, len(ids), SLICE):
            at = places_in(low, low + SLICE)
            key = shorter[at].astype(np.int64) * vocabulary + ids[at + (words - 1)]
            if classes > 1:
                hit = mix(key.view(U64)) % U64(classes) == c
                at, key = at[hit], key[hit]
            keys.append(key)
            places.append(at.astype(np.int32))
        key, place = np.concatenate(keys), np.concatenate(places)
        del keys, places
        ranked = np.sort(key)
        edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])) if len(ranked) else np.zeros(1, np.int64)
        good = ranked[edges[:-1][np.diff(edges) >= least]]
        del ranked, edges
        own = np.zeros(len(good), np.int32)
        for k in range(0, len(key) if len(good) else 0, SLICE):
            some = key[k:k + SLICE]
            found = np.minimum(np.searchsorted(good, some), len(good) - 1)
            hit = good[found] == some
            found, where = found[hit], place[k:k + SLICE][hit]
            code[where] = found + (known + 1)
            own[found] = where
        known += len(good)
        owners.append(own)
    return np.concatenate(owners), code


_MINED = "lang string, h long, words int, phrase string, n long"


def mine(shard: Shard, least: int, low: int, high: int, pairs=None) -> Iterator[tuple[str, np.ndarray, int, list[str]]]:
    """``(lang, hashes, words, phrases)`` of all phrases of ``low`` to ``high`` words that
    come ``least`` times or more in the shard; longer than two words only those all of whose
    pairs are in ``pairs``."""
    spelt = list(shard.numbers)
    for lang, ids, hashes in shard.languages():
        times = np.bincount(ids, minlength=len(spelt))
        times[0] = 0
        some = np.flatnonzero(times >= least)
        if low == 1:
            yield lang, hashes[some], 1, [spelt[k].decode("utf-8", "replace") for k in some.tolist()]
            kept = (times >= least)[ids]
        else:
            kept = _allowed(ids, hashes, pairs)
        shorter = ids
        for words in range(2, high + 1):
            if words == 2 and low > 2:       # every allowed pair has a code, however rare it is here
                own, shorter = _frequent(ids, ids, lambda low, high: np.flatnonzero(kept[low:high]) + low, 2, len(spelt), 1)
            else:
                own, shorter = _frequent(ids, shorter, lambda low, high: _grow(kept, low, high, words), words, len(spelt), least)
            kept = shorter
            if not len(own):
                break
            if words >= low:
                yield lang, _chain(ids, own, words, hashes), words, [b" ".join([spelt[k] for k in ids[p:p + words].tolist()]).decode("utf-8", "replace") for p in own.tolist()]


def _merged(h: np.ndarray, c: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts ``c`` of the hashes ``h`` with those of ``more`` added."""
    new, times = np.unique(np.concatenate(more), return_counts=True)
    both, where = np.unique(np.concatenate([h, new]), return_inverse=True)
    out = np.zeros(len(both), np.int64)
    np.add.at(out, where[:len(h)], c)
    np.add.at(out, where[len(h):], times)
    return both, out


def count(shard: Shard, wanted, low: int, high: int, pairs=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hashes, occurrences)`` of the phrases whose bits are set in ``wanted``."""
    for _, ids, hashes in shard.languages():
        times = np.bincount(ids, minlength=len(hashes))
        times[0] = 0
        if low == 1:
            some = np.flatnonzero((times > 0) & _has(wanted, hashes))
            yield hashes[some], times[some]
            may = np.zeros(len(hashes), bool)
            may[some] = True
            kept = may[ids]
        else:
            kept = _allowed(ids, hashes, pairs)
        for words in range(max(low, 2), high + 1):
            new, held, n = np.zeros(len(ids), bool), [], 0
            h, c = np.empty(0, U64), np.empty(0, np.int64)
            for start in range(0, len(ids), SLICE):
                at = _grow(kept, start, start + SLICE, words)
                own = _chain(ids, at, words, hashes)
                hit = _has(wanted, own)
                new[at[hit]] = True
                held.append(own[hit])
                n += len(held[-1])
                if n >= CLASS_KEYS or (held and start + SLICE >= len(ids)):
                    h, c = _merged(h, c, held)
                    held, n = [], 0
            yield h, c
            kept = new
            if not kept.any():
                break


# ---------------------------------------------------------------- Spark

def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[Shard]:
    shard = Shard()
    for batch in released(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard.add(lang, text.as_py())
            if shard.size >= shard_bytes:
                full, shard = [shard], Shard()
                yield full.pop()         # nothing here holds it any longer
    if shard.size:
        yield shard


def _bitmap(hashes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bitmap over the leading bits of ``h``: 16 bits for each of about ``n`` hashes as far as
    the bound allows.  At most ``2^MOST_BITS`` bits reach the driver."""
    bits = min(MOST_BITS, max(_BUCKET_BITS + 1, math.ceil(math.log2(16 * max(n, 1)))))
    place = F.shiftrightunsigned(F.col("h"), 64 - bits)
    rows = (hashes.groupBy(F.shiftright(place, _BUCKET_BITS).alias("b"))
            .agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))).alias("m")))
    held = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (_BUCKET_BITS - 3)
    for r in rows.toLocalIterator():
        held[r["b"] * step:(r["b"] + 1) * step] = np.frombuffer(r["m"], np.uint8, step)
    return bits, held


def _son(rows: DataFrame, total: int, least: int, low: int, high: int, pairs, shard_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Exact ``(lang, h, words, phrase, f)`` of the phrases of ``low`` to ``high`` words with
    ``f >= least``, and the words counted per language (with ``low`` 1)."""
    sc = rows.sparkSession.sparkContext
    known = sc.broadcast(pairs)

    names = ["lang", "h", "words", "phrase", "n"]

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            local = max(1, -(-least * shard.size // total))
            langs = list(shard.words)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(langs), pa.int64()), pa.nulls(len(langs), pa.int32()),
                                              pa.nulls(len(langs), pa.string()), pa.array(list(shard.words.values()), pa.int64())], names=names)
            for lang, h, words, phrases in mine(shard, local, low, high, known.value):
                for k in range(0, len(phrases), 10_000):
                    own = phrases[k:k + 10_000]
                    m = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(h[k:k + m].view(np.int64)), pa.array(np.full(m, words, np.int32)),
                                                      pa.array(own, pa.string()), pa.nulls(m, pa.int64())], names=names)
            del shard        # before the next one is read

    local = cut(rows.mapInArrow(mined, _MINED), "phrases-local")
    union = local.where("phrase IS NOT NULL").select("lang", "h", "words", "phrase")
    wanted = sc.broadcast(_bitmap(union, union.agg(F.approx_count_distinct("h")).first()[0]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            for h, c in count(shard, wanted.value, low, high, known.value):
                for k in range(0, len(h), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(h[k:k + 65_536].view(np.int64)), pa.array(c[k:k + 65_536])], names=["h", "c"])
            del shard

    total_of = cut(rows.mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("f")).where(F.col("f") >= least), "phrases-counts")
    # most candidates end here: only the frequent ones need their words, once
    exact = cut(union.join(total_of, "h", "left_semi").distinct().join(total_of, "h"), "phrases-exact")
    return exact, local.where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, h, words, phrase, f)`` of all phrases of up to ``longest`` words with at least
    ``least`` occurrences, and ``(lang, n)``, the occurrences of all words."""
    if least < 1 or longest < 2:
        raise ValueError("least >= 1 and longest >= 2 are required")
    text_batches(docs)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t"))
    rows = rows.where("octet_length(t) > 0")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(SHARDS, math.ceil(total / shard_bytes))
    rows = spread(rows).coalesce(shards)
    short, n = _son(rows, max(total, 1), least, 1, min(longest, 2), None, shard_bytes)
    if longest == 2:
        return short, n
    two = short.where("words = 2")
    long, _ = _son(rows, max(total, 1), least, 3, longest, _bitmap(two, two.count()), shard_bytes)
    return short.unionByName(long), n


def _id(lang: Column, words: Column, start, length) -> Column:
    return F.xxhash64(lang, F.array_join(F.slice(words, start, length), " "))


def collocations(docs: DataFrame, top: int = 2_000, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang",
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` collocations.

    Texts are lower-cased in A-Z, split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
    words ``[^\\x20\\x09]+``; phrases of 2 to ``longest`` words lie within a piece.  ``a`` is the
    number of occurrences, overlaps included, ``l`` and ``r`` those of the two parts at the cut
    with the lowest score ``floor(1000 a n / (l r))`` (ties: the shortest first part), ``n``
    the occurrences of all words.  A phrase goes if a longer candidate around it comes as often.
    Order: score, then ``a``, both falling, then the phrase by its bytes.

    A null language is ``und``; null and empty texts hold no words; every row counts, also
    repeated ones.  Other columns are not read.  Scores are exact (decimal products of up to
    38 digits).  An empty table gives an empty result.
    """
    found, n = frequent(docs, least, longest, text_col, lang_col, shard_bytes)
    known = found.select(F.xxhash64("lang", "phrase").alias("id"), "lang", "phrase", "words", F.col("f").alias("a"))
    lang, size, own = F.col("lang"), F.col("words"), F.split("phrase", " ")
    cuts = known.where("words > 1").select("id", "lang", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), _id(lang, own, F.lit(1), k).alias("first"), _id(lang, own, k + 1, size - k).alias("rest")))).alias("c")).select("id", "lang", "a", "c.*")
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select(F.col("id").alias(side), F.col("a").alias(name)), side).drop(side)
    a, m, l, r = (F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r"))
    cuts = cuts.join(n, "lang").withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a * m, l * r))
    lowest = cuts.groupBy("id").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("x"))
    # the phrase without its first and without its last word lies inside it; if a much longer
    # phrase comes as often, so does the one that is longer by one word
    inside = (known.where("words > 2").select(F.explode(F.array(_id(lang, own, F.lit(1), size - 1), _id(lang, own, F.lit(2), size - 1))).alias("id"), F.col("a").alias("most"))
              .groupBy("id").agg(F.max("most").alias("most")))
    kept = known.where("words > 1").join(inside, "id", "left").where("most IS NULL OR a > most").join(lowest, "id")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return (kept.select("lang", "phrase", "a", "x.l", "x.r", "x.n", "x.score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def oracle(top: int = 2_000, least: int = LEAST, longest: int = LONGEST, docs: str = "documents") -> str:
    """The same for DuckDB: every phrase of every piece is counted."""
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {docs}),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
          FROM words, range(1, {longest + 1}) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, x.i, string_split(c.phrase, ' ') AS w FROM f c, range(1, {longest}) AS x(i) WHERE x.i < c.k),
scored AS (SELECT c.lang, c.phrase, c.a, c.i, p.a AS l, q.a AS r, n, CAST(1000::HUGEINT * c.a * n // (p.a::HUGEINT * q.a) AS BIGINT) AS score
  FROM cuts c JOIN total USING (lang) JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(list_slice(w, 1, i), ' ')
  JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(list_slice(w, i + 1, c.k), ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = s.lang AND g.a >= s.a AND len(string_split(g.phrase, ' ')) > len(string_split(s.phrase, ' '))
         AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= {top}"""
