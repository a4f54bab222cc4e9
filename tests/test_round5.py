"""Findings of the third round: plans whose shuffles and spills grow no faster than the input."""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import absa as A
from revlens.operators import augment as AU
from revlens.operators import business as B
from revlens.operators import explain as X
from revlens.operators import models as ML
from revlens.operators.lexicon import LexiconScorer


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- F9 ---------------------------------------------------------------------
def test_tfidf_counts_terms_within_the_row(spark):
    """The result reads no sorted or aggregated (id, term) rows: no window, one exchange of texts.
    An id that comes twice is one document; a null id is one too."""
    rows = [(1, "ab cd ab"), (1, "cd ef"), (2, "Ab cd"), (3, None), (4, ""), (None, "ab ab"), (None, "cd")]
    t = ML.tfidf(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    plan = _plan(t)
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange") <= 1, plan
    got = {(r["id"], r["term"]): (r["tf"], round(r["weight"], 9)) for r in t.collect()}
    n, df = 7.0, {"ab": 3, "cd": 3, "ab cd": 2}       # "cd ab", "cd ef", "ef", "ab ab": one document each
    idf = {k: math.log((1 + n) / (1 + v)) + 1 for k, v in df.items()}
    want = {}
    for i, tf in {1: {"ab": 2, "cd": 2, "ab cd": 1}, 2: {"ab": 1, "cd": 1, "ab cd": 1}, None: {"ab": 2, "cd": 1}}.items():
        norm = math.sqrt(sum((c * idf[k]) ** 2 for k, c in tf.items()))
        want |= {(i, k): (c, round(c * idf[k] / norm, 9)) for k, c in tf.items()}
    assert got == want


def test_tfidf_term_parts_are_summed(monkeypatch):
    """Terms handed on in small parts add up to the same counts."""
    monkeypatch.setattr(ML, "FLUSH_TERMS", 3)
    batch = pa.RecordBatch.from_pydict({"_tokens": [["aa bb", "aa"], ["bb aa bb"], [""], []]})
    parts = [r for b in ML._corpus_counts([batch]) for r in b.to_pylist()]
    df, total = Counter(), Counter()
    for r in parts:
        df[r["term"]] += r["df"]
        total[r["term"]] += r["total"]
    assert df == {"aa": 2, "bb": 2, "aa bb": 2, "bb aa": 1}
    assert total == {"aa": 3, "bb": 3, "aa bb": 2, "bb aa": 1}


# --- F12 to F15, F19 to F22, F24 to F26: patterns of the text functions ------------
def test_space_class_is_the_spelled_out_one(spark):
    """Java's property class holds the same characters as the spelled-out set of the oracles."""
    chars = [(i, chr(i)) for i in range(0x11000) if not 0xD800 <= i < 0xE000]
    d = spark.createDataFrame(chars, "i int, c string")
    assert d.where(F.col("c").rlike(f"^[{T.WS}]$") != F.col("c").rlike(f"^[{T.SPACE}]$")).count() == 0
    assert d.where(F.col("c").rlike(f"^[{T.SPACE}]$")).count() == 29


def test_candidates_of_shared_beginnings(spark):
    """Stop words that begin alike, come in a row, stand at the ends or are part of a word."""
    texts = ["the of  the cat, it is the best--box of all", "is", "", None, "thecat the\ncats' isle (of) in", "a b|c 'tis the"]
    want = [["cat", "best--box", "all"], [], [], [], ["thecat", "cats' isle"], ["c 'tis"]]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in d.select("i", T.mine_candidates("t", ["the", "of", "it", "is", "in", "i", "a", "that", "th"]).alias("c")).orderBy("i").select("c").collect()]
    assert got == want, got
    assert re.fullmatch(T.one_of(["a.b", "a", "c"]), "a.b") and not re.fullmatch(T.one_of(["a.b", "a", "c"]), "axb")


# --- F12 ----------------------------------------------------------------------
def test_value_counts_read_the_aspects_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(1, "x", 0.5), (2, "x", 0.5), (3, "x", 0.0), (3, "y", 0.25), (4, "y", 1.0)]
    schema = "review_id long, aspect string, aspect_sentiment double"
    long = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    out = B.aspect_value_counts(long, spark.range(6).withColumnRenamed("id", "review_id"), "x")
    assert [tuple(r) for r in out.collect()] == [(0.0, 4), (0.5, 2)]
    assert seen.value == len(rows)


# --- F10 ----------------------------------------------------------------------
def test_token_labels_shuffle_no_tokens(spark):
    texts = [(1, "big Last box"), (1, "a last"), (2, "none"), (None, "last"), (3, None)]
    mapped = [(1, "last", "dur", 1), (1, "big last", "size", 2), (2, "last", "dur", 1), (None, "last", "dur", 1)]
    d = spark.createDataFrame(texts, "review_id long, review_text string")
    m = spark.createDataFrame(mapped, "review_id long, candidate string, aspect string, aspect_ord int")
    out = A.token_labels(d, m)
    assert "MapInPandas" not in _plan(out) and _plan(out).count("Exchange") <= 4
    got = sorted((r["review_id"] or 0, r["token"], r["token_pos"], r["start"], r["label"]) for r in out.collect())
    assert got == [(0, "last", 0, 1, "O"), (1, "a", 0, 1, "B-size"), (1, "big", 0, 1, "B-size"), (1, "box", 2, 10, "O"),
                   (1, "last", 1, 3, "I-size"), (1, "last", 1, 5, "I-size"), (2, "none", 0, 1, "O")]


# --- F14, F19, F21, F22 -------------------------------------------------------
def test_mapping_works_out_the_candidates_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(1, 0, "last box"), (1, 1, "cable"), (2, 0, "plastic"), (3, 0, None)]
    schema = "review_id long, cand_pos int, candidate string"
    cands = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    lex = spark.createDataFrame([("dur", "last", 0), ("dur", "box", 0), ("price", "c.st", 1)], "aspect string, seed string, aspect_ord int")
    got = sorted(tuple(r) for r in A.map_to_aspects(cands, lex).collect())
    assert got == [(1, 0, "last box", "dur", 0), (2, 0, "plastic", "dur", 0)] and seen.value == len(rows)
    assert sorted(r["review_id"] for r in A.unmapped_candidates(cands, lex).collect()) == [1, 3]


def test_sentence_hits(spark):
    t = spark.createDataFrame([(1, "A last one. Two. Last!"), (1, "x"), (2, None)], "review_id long, review_text string")
    m = spark.createDataFrame([(1, 0, "last"), (1, 3, "zz"), (2, 0, "q")], "review_id long, cand_pos int, candidate string")
    out = A.sentence_hits(m, t)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 0, 1, 0, 1), (1, 0, 2, 1, 16), (1, 3, 1, 0, 1), (1, 3, 1, 0, 22), (2, 0, 1, 0, 0)], got


# --- F18 ----------------------------------------------------------------------
def test_language_of_repeated_ids(spark, monkeypatch):
    rows = [(1, "abab abab", "x"), (1, "zz", "y"), (2, "zz zz", "y"), (3, "1 2", "x"), (4, None, None), (None, "abab", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prof = AU.language_profiles(d, "text", "lang", 2)
    assert {(r["lang"], r["tri"]) for r in prof.collect()} == {("x", "ab_"), ("x", "_ab"), ("y", "_zz"), ("y", "zz_")}
    out = AU.detect_language(d, "doc_id", "text", prof, "lang")
    got = sorted((r["doc_id"] or 0, r["detected"]) for r in out.collect())
    assert "MapInArrow" in _plan(out) and got == [(0, None), (1, "x"), (1, "x"), (2, "y"), (3, None), (4, None)]
    monkeypatch.setattr(AU, "MAX_BROADCAST_LEXICON_ROWS", 0)     # the shuffle form for large profiles
    assert got == sorted((r["doc_id"] or 0, r["detected"]) for r in AU.detect_language(d, "doc_id", "text", prof, "lang").collect())


# --- F16 ----------------------------------------------------------------------
def test_lime_in_the_task_equals_the_distributed_pass(spark, monkeypatch):
    rows = [(1, 0, "that hable idiot was from ention hable xx"), (1, 1, ""), (2, 0, None), (2, 1, "was hable, this anth"),
            (3, 0, "clown that this hable"), (3, 0, "clown that this hable")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    scorer = LexiconScorer.fixture(spark)
    near = X.lime_text(d, ["conv_id", "turn"], "text", scorer, num_samples=20, top=4)
    assert "FlatMapGroupsInPandas" not in _plan(near)
    monkeypatch.setattr(X, "MAX_BROADCAST_LEXICON_ROWS", 0)
    far = X.lime_text(d, ["conv_id", "turn"], "text", scorer, num_samples=20, top=4)
    show = lambda df: sorted((r["conv_id"], r["turn"], r["rank"], r["word"], round(r["weight"], 9)) for r in df.collect())
    assert show(near) == show(far) and len(show(near)) == 12


# --- F13 ----------------------------------------------------------------------
def test_vector_fallback_mines_once_and_embeds_unmapped_strings(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    texts = spark.createDataFrame([(1, "a last box. was red? last"), (2, "red car"), (3, None)], "review_id long, review_text string")
    asked = []

    def embed(strings):
        asked.extend(r[0] for r in strings.collect())
        return strings.select("candidate", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))

    lex = spark.createDataFrame([("dur", "last", 0)], "aspect string, seed string, aspect_ord int")
    protos = spark.createDataFrame([("size", 1, [1.0, 0.0])], "aspect string, aspect_ord int, embedding array<double>")
    out = A.absa_extract_with_vectors(texts.mapInArrow(count, texts.schema), lex, ["a", "was"], LexiconScorer.fixture(spark), embed, protos)
    got = sorted((r["review_id"], r["aspect"], r["candidates"], r["n_units"]) for r in out.collect())
    assert got == [(1, "dur", "last box|last", 3), (1, "size", "red", 1), (2, "size", "red car", 1)], got
    assert sorted(asked) == ["red", "red car"] and seen.value == 2 * texts.count()      # mined, then joined as texts


def test_found_units_are_those_of_the_arrays(spark):
    """Units found in the joined sentences equal those of the array expressions."""
    texts = ["A last one. Two last! LAST red", "", None, "red. red red? Blue-red", "one\ntwo. Ä is ä", " . ! "]
    words = ["last", "red", "one", "ä", "e", "d r", "none", ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id long, review_text string")
    m = [(i, p, w, ("x", "y")[p % 2], p % 2) for i in range(len(texts)) for p, w in enumerate(words)]
    mapped = spark.createDataFrame(m, "review_id long, cand_pos int, candidate string, aspect string, aspect_ord int")

    class Seen:
        def score(self, df, keys, text, carry_cols=()):
            self.rows = df
            return df.select(*keys, *carry_cols, F.lit("POS").alias("label"), F.lit(1.0).alias("score"))

    seen = Seen()
    for most in (None, 2):
        A.aspect_sentiment(mapped, d, seen, max_cands=most)
        lists = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(o).alias("aspect_ord"), F.array(*[F.lit(w) for w in words[o::2][:most]]).alias("cands"),
                                   F.lit("|".join(words[o::2])).alias("mapped")) for o, a in enumerate("xy")])
        want = A._with_units(d, "review_id", "review_text", lists)
        show = lambda df: sorted((r["review_id"], r["s_idx"], r["stext"], [tuple(u) for u in r["units"]]) for r in df.collect())
        assert show(seen.rows) == show(want)


# --- F23, F27 -----------------------------------------------------------------
def test_fitted_tfidf_equals_the_estimators(spark):
    from pyspark.ml.feature import CountVectorizer, IDF
    rows = [(k, t) for k, t in enumerate(["ab cd ab", "Ab cd ef", "", "--", "cd ef gh ab cd", "zz ab"])]
    d = spark.createDataFrame(rows, "doc_id long, review_text string")
    model = ML.fit_tfidf(d, max_features=5)
    terms = model.stages[3].vocabulary
    assert terms == ["ab", "cd", "ab cd", "ef", "cd ef"][:3] + sorted(["ef", "cd ef"])[:2]
    tokens = ML.Pipeline(stages=ML.token_stages()).fit(d).transform(d)
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=5, minDF=2.0).fit(tokens)
    idf = dict(zip(counts.vocabulary, IDF(inputCol="_tf").fit(counts.transform(tokens)).idf.toArray() + 1))
    assert set(terms) == set(idf)
    assert [round(float(x), 12) for x in model.stages[4].getScalingVec().toArray()] == [round(float(idf[t]), 12) for t in terms]


def test_text_classifier_writes_no_tokens(spark, monkeypatch):
    from revlens import session
    written = []
    plain = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df: (written.append(set(df.columns)), plain(df))[1])
    rows = [(k, f"{'red apple' if k % 2 else 'blue river'} word {k % 3}", k % 2) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, review_text string, label int")
    for kind in ("logreg", "svm"):
        assert ML.tfidf_classifier(d, "label", kind=kind).transform(d).where("prediction = label").count() == 20
    assert not [w for w in written if w & {"_tok", "_bi", "_terms", "_tf", "_w"}], written


def test_solver_reads_blocks(spark, monkeypatch):
    """Rows go to the passes in blocks, a long row alone in its own."""
    from pyspark.ml.linalg import Vectors
    from revlens.operators import squared_hinge as SH
    vectors = [Vectors.sparse(9, [1, 4], [2.0, 0.0]), Vectors.dense([1.0] * 9), Vectors.sparse(9, [], []), Vectors.sparse(9, [0, 8], [float("nan"), 3.0])]
    d = spark.createDataFrame([(v, k % 2) for k, v in enumerate(vectors * 25)], ["features", "label"]).coalesce(1)
    assert SH.sparse_rows(d, "features", "label").count() == 1
    whole = SH.squared_hinge_svm(d, "features", "label")
    monkeypatch.setattr(SH, "BLOCK_ENTRIES", 7)
    blocks = SH.sparse_rows(d, "features", "label").collect()
    assert len(blocks) > 25 and sum(len(b["y"]) for b in blocks) == 8 * 100 and sum(len(b["vals"]) for b in blocks) == 8 * 25 * 11
    cut = SH.squared_hinge_svm(d, "features", "label")
    assert max(abs(whole.coefficients.toArray() - cut.coefficients.toArray())) < 1e-9
