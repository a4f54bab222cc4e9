"""Aspect-based sentiment.

The fused pipeline (``absa_extract``) keeps every per-review step row-local:
candidates, aspect mapping against the (small, literal) seed lexicon and the
sentences that hold a candidate are array expressions on the review row.  Only
those sentences leave the row, each once: they are scored by the scorer (token
explode + broadcast lexicon join + partial aggregate) and folded back per
(review, aspect) with the number of candidates that they count for.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from revlens.functions import text as T
from revlens.operators.lexicon import bounded_broadcast
from revlens.operators.neighbors import embedding_assign
from revlens.session import materialize

# optional limit of the scored candidates per aspect; None: all
MAX_CANDIDATES: int | None = None
GRAM = 3      # characters of a seed's key
MAX_PATTERN_KEYS = 2_000        # keys of a pattern
MAX_BROADCAST_TERMS = 200_000   # strings of a broadcast
UNIT_REVIEWS = 500              # reviews whose sentences are handed on at once
LABEL_ROWS = 100_000            # labelled tokens held by a task before they are handed on


def _first(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


# --- F13 ---------------------------------------------------------------------
def candidates_long(df: DataFrame, stop_words: Sequence[str], id_col: str = "review_id",
                    text_col: str = "review_text") -> DataFrame:
    """F13 in long form: (id, cand_pos, candidate); cand_pos is 0-based text order."""
    return df.select(id_col, F.posexplode(T.mine_candidates(text_col, list(stop_words))).alias("cand_pos", "candidate"))


def phrase_scores(cands: DataFrame) -> DataFrame:
    """F13 scores (Rose et al. 2010): (candidate, n, score) per distinct candidate of a long
    table.  A word scores its degree (words of all candidates it stands in, itself included)
    over its frequency; a candidate scores the sum over its words.

    Words are counted by an aggregate that is combined before the shuffle; their scores are
    joined back to the words of the distinct candidates only.  Null candidates do not count."""
    rows = cands.where(F.col("candidate").isNotNull()).select("candidate", F.split("candidate", " ").alias("w"))
    words = rows.select(F.explode("w").alias("word"), F.size("w").alias("n")).groupBy("word").agg((F.sum("n") / F.count(F.lit(1))).alias("ws"))
    distinct = rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    spread = distinct.select("candidate", "n", F.explode(F.split("candidate", " ")).alias("word"))
    return spread.join(words, "word").groupBy("candidate", "n").agg(F.sum("ws").alias("score"))


# --- J1 / J2 -----------------------------------------------------------------
def _grams(c: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    if n == 0:
        return F.array(F.lit(""))
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))) \
        .otherwise(F.array().cast("array<string>"))


def keyed_seeds(lexicon: DataFrame) -> DataFrame:
    """Seeds with the substring of at most ``GRAM`` characters that fewest seeds share: a
    candidate that holds the seed holds its key."""
    seeds = lexicon.where(F.col("seed").isNotNull()).select("aspect", "aspect_ord", "seed").distinct()
    by_length = F.when(F.length("seed") >= GRAM, _grams(F.col("seed"), GRAM)).otherwise(F.array("seed"))
    grams = seeds.select("aspect", "aspect_ord", "seed", F.explode(F.array_distinct(by_length)).alias("key"))
    shared = grams.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return grams.join(shared, "key").groupBy("aspect", "aspect_ord", "seed").agg(F.min_by("key", F.struct("n", "key")).alias("key"))


def _holding(cands: DataFrame, keyed: DataFrame) -> DataFrame:
    """The rows whose candidate holds the key of some seed, in one scan; all rows when the keys
    are too many for a pattern."""
    keys = [r[0] for r in keyed.select("key").distinct().limit(MAX_PATTERN_KEYS + 1).collect()]
    return cands.where(F.col("candidate").rlike(T.one_of(keys))) if len(keys) <= MAX_PATTERN_KEYS else cands.where(F.col("candidate").isNotNull())


def _mapped_terms(terms: DataFrame, keyed: DataFrame) -> DataFrame:
    lengths = [r[0] for r in keyed.select(F.length("key")).distinct().collect()]        # 0 to GRAM
    grams = F.array_distinct(F.concat(*[_grams(F.col("candidate"), n) for n in sorted(lengths)])) if lengths else F.array().cast("array<string>")
    parts = terms.where(F.col("candidate").isNotNull()).select("candidate", F.explode(grams).alias("key"))
    return parts.join(keyed, "key").where(F.col("candidate").contains(F.col("seed"))).select("candidate", "aspect", "aspect_ord").distinct()


def map_terms(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """J1 on distinct candidates: (candidate, aspect, aspect_ord) when a seed of the aspect is a
    substring.  Inverted index: the candidate's short substrings meet the seeds' keys in an
    equi-join, then the whole seed is verified; no candidate is held against every seed."""
    keyed = materialize(keyed_seeds(lexicon))
    return _mapped_terms(_holding(terms, keyed), keyed)


def map_to_aspects(cands: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every candidate row with each aspect of which a seed is a substring, once.  Rows that
    hold no seed's key are left out at once; the distinct candidates of the others are mapped
    and joined back to them, so that ``cands`` is worked out once and only they are shuffled."""
    keyed = materialize(keyed_seeds(lexicon))
    rows = materialize(_holding(cands, keyed))
    pairs = _mapped_terms(rows.select("candidate").distinct(), keyed)
    return rows.join(pairs, "candidate").select(*cands.columns, "aspect", "aspect_ord")


def unmapped_candidates(cands: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidate rows that match no aspect, nulls among them.  The strings that match are
    sent to the rows when they are few."""
    keyed = materialize(keyed_seeds(lexicon))
    pairs = materialize(_mapped_terms(_holding(cands, keyed).select("candidate").distinct(), keyed).select("candidate").distinct())
    return cands.join(bounded_broadcast(pairs, MAX_BROADCAST_TERMS), "candidate", "left_anti").select(*cands.columns)


def terms_with_vectors(terms: DataFrame, lexicon: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], prototypes: DataFrame, threshold: float = 0.55) -> DataFrame:
    """J1, then J2 -> J3: distinct candidates that no seed maps go to the aspect whose prototype
    is nearest (cosine of normalised vectors) when it reaches ``threshold``.

    ``vectors`` is a table (candidate, embedding), joined once and to unmapped strings only, or
    an embedder that makes it from a table of the unmapped strings; a candidate without a vector
    stays unmapped.  ``prototypes (aspect, aspect_ord, embedding)`` has one row per aspect and
    enters as a scalar."""
    terms = materialize(terms)
    seeded = materialize(map_terms(terms, lexicon))
    rest = terms.join(bounded_broadcast(seeded.select("candidate").distinct(), MAX_BROADCAST_TERMS), "candidate", "left_anti")
    rest = vectors(rest).select("candidate", "embedding") if callable(vectors) else rest.join(vectors.select("candidate", "embedding"), "candidate")
    near = embedding_assign(rest, prototypes, "candidate", "embedding", threshold)
    near = near.join(prototypes.select("aspect", "aspect_ord"), "aspect").select("candidate", "aspect", "aspect_ord")
    return seeded.unionByName(near)


# --- F14 -----------------------------------------------------------------------
def sentence_hits(mapped: DataFrame, texts: DataFrame, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """F14 per candidate row (id, cand_pos, candidate): (id, cand_pos, n_sentences, first_idx,
    total_chars) of the sentences that hold it, else of the whole text with first_idx 0.

    The candidates of an id are folded into one row and meet its text there, so that a text is
    split once and not once a candidate."""
    per_review = mapped.groupBy(id_col).agg(F.collect_list(F.struct("cand_pos", "candidate")).alias("_m"))
    sents = F.transform(T.sentences(text_col), lambda x, i: F.struct((i + 1).alias("idx"), F.length(x).alias("len"), F.lower(x).alias("low")))

    def hit(r: Column, c: Column) -> Column:
        return T.let(F.filter(r["s"], lambda x: x["low"].contains(c["candidate"])), lambda h: F.struct(
            c["cand_pos"].alias("cand_pos"), F.greatest(F.size(h), F.lit(1)).cast("bigint").alias("n_sentences"),
            F.coalesce(F.get(h, F.lit(0))["idx"], F.lit(0)).cast("int").alias("first_idx"),
            F.when(F.size(h) > 0, F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: acc + x["len"]))
            .otherwise(r["len"]).alias("total_chars")))

    v = F.struct(sents.alias("s"), T.char_count(text_col).alias("len"), F.col("_m").alias("m"))
    return texts.select(id_col, text_col).join(per_review, id_col).select(
        id_col, F.inline(T.let(v, lambda r: F.transform(r["m"], lambda c: hit(r, c)))))


# --- sentence units + scoring (shared by A2 and A3) ---------------------------
def _with_units(df: DataFrame, id_col: str, text_col: str, aspect_cands: Column) -> DataFrame:
    """One row per (id, s_idx) that some candidate needs, with the text to score and, per
    aspect, how many of its candidates that text counts for (``n``): s_idx 1.. are the
    sentences, 0 is the whole text for candidates that no sentence holds.  Row -1 has no
    text and carries the aspect's mapped candidates once, so that they are not repeated
    for every sentence and token.

    Everything is evaluated on the review row; ``let`` binds the sentence split once."""
    def unit(a: Column, n: Column, mapped: Column) -> Column:
        return F.struct(a["aspect"].alias("aspect"), a["aspect_ord"].alias("aspect_ord"), n.alias("n"), mapped.alias("mapped"))

    def counted(ac: Column, wanted) -> Column:
        """Per aspect the candidates that ``wanted`` accepts, aspects with none left out."""
        return F.filter(F.transform(ac, lambda a: unit(a, F.size(F.filter(a["cands"], wanted)), F.lit(None).cast("string"))),
                        lambda u: u["n"] > 0)

    def row(s_idx: Column, text: Column, units: Column) -> Column:
        return F.struct(s_idx.cast("int").alias("s_idx"), text.alias("stext"), units.alias("units"))

    def per_review(r: Column) -> Column:
        names = row(F.lit(-1), F.lit(""), F.transform(r["ac"], lambda a: unit(a, F.lit(0), a["mapped"])))
        whole = row(F.lit(0), r["txt"], counted(r["ac"], lambda c: ~F.exists(r["s"], lambda x: x["low"].contains(c))))
        held = F.transform(r["s"], lambda x, i: row(i + 1, x["raw"], counted(r["ac"], lambda c: x["low"].contains(c))))
        return F.filter(F.concat(F.array(names, whole), held), lambda x: F.size(x["units"]) > 0)

    sents = F.transform(T.sentences(text_col), lambda x: F.struct(x.alias("raw"), F.lower(x).alias("low")))
    v = F.struct(T.as_text(text_col).alias("txt"), sents.alias("s"), aspect_cands.alias("ac"))
    return df.select(id_col, F.inline(T.let(v, per_review)))


def _score_units(grouped: DataFrame, scorer, id_col: str) -> DataFrame:
    scored = scorer.score(grouped, [id_col, "s_idx"], "stext", carry_cols=["units"])
    signed = T.signed_score("label", "score")
    per_unit = scored.select(id_col, F.inline("units"), signed.alias("_sg"), F.col("score").alias("_cf"))
    n = F.sum("n")
    return per_unit.groupBy(id_col, "aspect", "aspect_ord").agg(
        F.collect_list("mapped")[0].alias("candidates"),     # one per aspect: the others are null
        (F.sum(F.col("n") * F.col("_sg")) / n).alias("aspect_sentiment"),
        (F.sum(F.col("n") * F.col("_cf")) / n).alias("aspect_confidence"),
        n.alias("n_units"),
    ).select(id_col, "aspect", "aspect_ord", "candidates", "aspect_sentiment", "aspect_confidence", "n_units")


# --- A2 ----------------------------------------------------------------------
def aspect_sentiment(mapped: DataFrame, texts: DataFrame, scorer, id_col: str = "review_id",
                     text_col: str = "review_text", max_cands: int | None = MAX_CANDIDATES) -> DataFrame:
    """A2: given mapped candidates (id, cand_pos, candidate, aspect, aspect_ord) and the
    texts, score every candidate in every sentence that holds it (``max_cands`` limits the
    candidates of an aspect).

    The mapping is folded to one array per review (bounded by the review's
    candidates) and joined to the text on the id; the row's task finds the sentences of each
    candidate in one search of the text (``_found_units``), not sentence by sentence."""
    per_review = mapped.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("aspect_ord", "aspect", "cand_pos", "candidate"))).alias("_m"))
    j = texts.select(id_col, text_col).join(per_review, id_col)
    j = j.select(id_col, T.as_text(text_col).alias("txt"), T.sentences(text_col).alias("raw"), "_m")
    j = j.select(id_col, "txt", "raw", F.transform("raw", F.lower).alias("low"), *[F.col(f"_m.{c}").alias(c) for c in ("aspect_ord", "aspect", "candidate")])
    unit = StructType([StructField("aspect", StringType()), StructField("aspect_ord", mapped.schema["aspect_ord"].dataType),
                       StructField("n", IntegerType()), StructField("mapped", StringType())])
    schema = StructType([j.schema[id_col], StructField("s_idx", IntegerType()), StructField("stext", StringType()), StructField("units", ArrayType(unit))])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, UNIT_REVIEWS):
                yield _unit_rows(batch.slice(at, UNIT_REVIEWS), max_cands, schema.names)

    return _score_units(j.mapInArrow(work, schema), scorer, id_col)


def _unit_rows(batch: pa.RecordBatch, max_cands: int | None, names: list[str]) -> pa.RecordBatch:
    """The rows of ``_with_units`` for reviews with their text, sentences and mapped candidates."""
    ids, txt, raw, low, ords, aspects, cands = batch.columns
    texts = pa.concat_arrays([pa.array([""], pa.string()), txt, raw.flatten()])
    first = 1 + len(txt)      # place of the review's first sentence in ``texts``
    take, s_idx, place, ends, units = [], [], [], [0], ([], [], [], [])
    for k, (lows, *m) in enumerate(zip(low.to_pylist(), ords.to_pylist(), aspects.to_pylist(), cands.to_pylist())):
        for s, found in _found_units(lows, *m, max_cands):
            take.append(k)
            s_idx.append(s)
            place.append(0 if s < 0 else 1 + k if s == 0 else first + s - 1)
            ends.append(ends[-1] + len(found))
            for u in found:
                for held, x in zip(units, u):
                    held.append(x)
        first += len(lows)
    types = (pa.string(), ords.type.value_type, pa.int32(), pa.string())
    flat = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(units, types)], names=["aspect", "aspect_ord", "n", "mapped"])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), pa.array(s_idx, pa.int32()), texts.take(pa.array(place, pa.int64())),
                                       pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=names)


def _found_units(lows: list[str], ords: list, aspects: list, cands: list, most: int | None):
    """``(s_idx, units)`` of one review, as in ``_with_units``; a unit is (aspect, aspect_ord, n,
    mapped).  A candidate is searched for in the joined sentences, on to the next one after a hit."""
    joined = "\n".join(lows)
    starts = list(accumulate((len(x) + 1 for x in lows), initial=0))
    known: dict = {None: None}

    def holders(c: str) -> list[int]:
        if "\n" in c:
            return [i for i, x in enumerate(lows) if c in x]
        found, at = [], joined.find(c) if lows else -1
        while at >= 0:
            found.append(bisect_right(starts, at) - 1)
            at = joined.find(c, starts[found[-1] + 1])
        return found

    of: dict = {}
    for o, c in zip(ords, cands):
        of.setdefault(o, []).append(c)
    names, rows = [], {}      # rows: sentence (0: the whole text) -> units
    for o, aspect in dict.fromkeys(zip(ords, aspects)):
        mine = of[o] if o is not None else []
        names.append((aspect, o, 0, "|".join(c for c in mine if c is not None)))
        counts: Counter = Counter()
        for c in mine if most is None else mine[:most]:
            if c not in known:
                known[c] = holders(c)
            if c is None:
                counts.update([0] if not lows else [])
            else:
                counts.update([i + 1 for i in known[c]] or [0])
        for s, n in counts.items():
            rows.setdefault(s, []).append((aspect, o, n, None))
    if names:
        yield -1, names
    yield from sorted(rows.items(), key=lambda r: r[0])


# --- A3 ----------------------------------------------------------------------
def _lexicon_literal(aspects: dict[str, list[str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(a).alias("aspect"), F.lit(i).alias("aspect_ord"), F.array(*[F.lit(s) for s in seeds]).alias("seeds"))
        for i, (a, seeds) in enumerate(aspects.items())
    ])


def _seed_match(c: Column, s: Column, whole_word: bool) -> Column:
    """Seed ``s`` in candidate ``c``: substring (the reference: "last" matches "plastic"),
    or, with ``whole_word``, only as a space-delimited word of the candidate."""
    if not whole_word:
        return c.contains(s)
    return F.concat(F.lit(" "), c, F.lit(" ")).contains(F.concat(F.lit(" "), s, F.lit(" ")))


def aspect_candidates(cands: Column, aspects: dict[str, list[str]], max_cands: int | None = MAX_CANDIDATES,
                      whole_word: bool = False) -> Column:
    """Row-local J1: array<struct<aspect, aspect_ord, cands (first n), mapped (all, '|'-joined)>>,
    aspects without candidates pruned.  ``cands`` is bound once (``let``)."""
    def per(cs: Column) -> Column:
        hits = F.transform(_lexicon_literal(aspects), lambda a: F.struct(
            a["aspect"].alias("aspect"), a["aspect_ord"].alias("aspect_ord"),
            F.filter(cs, lambda c: F.exists(a["seeds"], lambda s: _seed_match(c, s, whole_word))).alias("all")))
        hits = F.filter(hits, lambda x: F.size(x["all"]) > 0)
        return F.transform(hits, lambda x: F.struct(
            x["aspect"].alias("aspect"), x["aspect_ord"].alias("aspect_ord"),
            _first(x["all"], max_cands).alias("cands"), F.array_join(x["all"], "|").alias("mapped")))
    return T.let(cands, per)


def absa_extract(df: DataFrame, aspects: dict[str, list[str]], stop_words: Sequence[str], scorer,
                 id_col: str = "review_id", text_col: str = "review_text", whole_word: bool = False) -> DataFrame:
    """A3: mine -> map -> prune -> score, long result
    (id, aspect, aspect_ord, candidates, aspect_sentiment, aspect_confidence, n_units)."""
    ac = aspect_candidates(T.mine_candidates(text_col, list(stop_words)), aspects, whole_word=whole_word)
    return _score_units(_with_units(df, id_col, text_col, ac), scorer, id_col)


def absa_extract_with_vectors(df: DataFrame, lexicon: DataFrame, stop_words: Sequence[str], scorer,
                              vectors: DataFrame | Callable[[DataFrame], DataFrame], prototypes: DataFrame,
                              threshold: float = 0.55, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """A3 with the embedding fallback: mine -> distinct strings -> seeds, else nearest prototype
    -> back to the reviews -> score.  ``lexicon`` is the table (aspect, aspect_ord, seed) and may
    be large.  Same columns as ``absa_extract``; the candidates of an aspect are in text order."""
    long = materialize(candidates_long(df, stop_words, id_col, text_col))
    terms = terms_with_vectors(long.select("candidate").distinct(), lexicon, vectors, prototypes, threshold)
    mapped = long.join(terms, "candidate").select(id_col, "cand_pos", "candidate", "aspect", "aspect_ord")
    return aspect_sentiment(mapped, df, scorer, id_col, text_col)


# --- weak token labels ----------------------------------------------------------
def token_labels(df: DataFrame, mapped: DataFrame, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """Weak begin/inside labels for aspect tagging: (id, token_pos, token, start, label) for every
    token (maximal runs of characters other than space), label ``B-<aspect>``, ``I-<aspect>`` or ``O``.

    A token belongs to a candidate when it lies within an occurrence of it, case aside; a
    token in several spans takes the longest, then the smallest ``aspect_ord``.
    ``start`` counts from 1; occurrences of one candidate do not overlap.

    The candidates of an id are folded into one row and meet its texts there; the texts cross
    one shuffle and are labelled in the same task, tokens and spans never leave it."""
    id_type = df.schema[id_col].dataType
    low = df.select(id_col, F.lower(T.as_text(text_col)).alias("low"))
    texts = low.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list("low").alias("texts"))
    cands = mapped.groupBy(id_col).agg(F.collect_set(F.struct(F.col("aspect_ord").cast("int").alias("aspect_ord"), "aspect", "candidate")).alias("cands"))
    rows = texts.join(cands, id_col, "left")
    alone = low.where(F.col(id_col).isNull()).select(id_col, F.array("low").alias("texts"), F.lit(None).cast(rows.schema["cands"].dataType).alias("cands"))
    schema = StructType([StructField(id_col, id_type), StructField("token_pos", IntegerType()), StructField("token", StringType()), StructField("start", IntegerType()), StructField("label", StringType())])

    def work(batches):
        for batch in batches:
            take, out = [], ([], [], [], [])
            for k, (texts, cands) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for row in _labelled(texts, [(c["aspect_ord"], c["aspect"], c["candidate"]) for c in cands or []]):
                    take.append(k)
                    for held, x in zip(out, row):
                        held.append(x)
                if len(take) >= LABEL_ROWS:
                    yield _label_batch(batch, take, out, schema)
                    take, out = [], ([], [], [], [])
            yield _label_batch(batch, take, out, schema)

    return rows.unionByName(alone).mapInArrow(work, schema)


def _label_batch(batch, take, out, schema) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.string(), pa.int32(), pa.string()))]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *columns], names=schema.names)


def _labelled(texts: list[str], cands: list[tuple]):
    """(token_pos, token, start, label) of the texts of one id; the spans of all its texts count."""
    tokens = [[(m.group(), m.start() + 1) for m in re.finditer("[^ ]+", t)] for t in texts]
    spans = set()
    for t in texts:
        for aspect_ord, aspect, c in cands:
            at = t.find(c) if c else -1
            while at >= 0:
                spans.add((-len(c), aspect_ord, at + 1, aspect))
                at = t.find(c, at + len(c))
    best: dict = {}     # position -> (-length, aspect_ord, span, start, aspect), the least
    for some in tokens if spans else []:
        starts = [start for _, start in some]
        for minus, aspect_ord, span, aspect in spans:
            k = bisect_left(starts, span)
            while k < len(some) and some[k][1] + len(some[k][0]) <= span - minus:
                found = (minus, aspect_ord, span, starts[k], aspect)
                best[k] = min(best.get(k, found), found)
                k += 1
    for some in tokens:
        for k, (token, start) in enumerate(some):
            b = best.get(k)
            yield k, token, start, "O" if b is None else ("B-" if b[3] == b[2] else "I-") + b[4]


# --- G15 / G16 -----------------------------------------------------------------
def observed_aspects(long_aspects: DataFrame) -> DataFrame:
    """Sorted distinct aspects seen in any review."""
    return long_aspects.select("aspect").distinct().orderBy("aspect")


def aspect_wide(ids: DataFrame, long_aspects: DataFrame, aspects: Sequence[str], id_col: str = "review_id") -> DataFrame:
    """aspect_sent_<a>, aspect_conf_<a> per review, 0.0 when absent.

    ``aspects`` is the known list (pivot without a distinct pass); the pivot is a
    hash aggregate keyed by review id, then a left join from all ids."""
    piv = long_aspects.groupBy(id_col).pivot("aspect", list(aspects)).agg(
        F.first("aspect_sentiment").alias("sent"), F.first("aspect_confidence").alias("conf"))
    cols = []
    for a in aspects:
        cols += [F.coalesce(F.col(f"{a}_sent"), F.lit(0.0)).alias(f"aspect_sent_{a}"),
                 F.coalesce(F.col(f"{a}_conf"), F.lit(0.0)).alias(f"aspect_conf_{a}")]
    return ids.select(id_col).join(piv, id_col, "left").select(id_col, *cols)


def prepare_reviews(reviews: DataFrame, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """D1 then F1: the load_and_clean step of the dashboard path."""
    from revlens.operators.quality import remove_duplicates
    d = remove_duplicates(reviews, text_col, id_col)
    return d.withColumn(text_col, T.basic_clean(text_col))
