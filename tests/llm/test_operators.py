"""Operators against brute force, exact round trips and edge cases: nulls, empty and long
texts, ties, repeated rows, empty tables, clashing column names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from revlens.llm import bpe, html_extract, language, licenses, line_dedup, mixing, multi_index, ngram_join, queries, simhash, toxicity
from revlens.llm.common import components, word_hashes
from revlens.plans.check import compare, duck
from revlens.sources.tables import read_table
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, source string, n_shingles int, h long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, a very long text, repeated rows, clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, "alpha beta gamma delta", "a", 1, 1), (2, None, None, None, None), (3, "", "a", 0, 0), (4, " \n\t ", "b", 0, 0),
            (None, "alpha beta gamma delta", "b", 2, 2), (5, "alpha beta gamma delta", "c", 3, 3), (5, "alpha beta gamma delta", "c", 3, 3),
            (6, long, "c", 4, 4), (7, "one", "d", 5, 5), (7, "two words", "d", 5, 5)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    r = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF_SMALL, duck(SF_SMALL))
    assert r["ok"], r


# ---------------------------------------------------------------- 1 BPE

def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_query_equals_library(spark):
    t = reference()
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, SF_SMALL).collect()}
    for r in read_table(spark, SF_SMALL, "documents").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_streams_like_the_library_at_any_chunk(monkeypatch):
    t, rnd = reference(), random.Random(3)
    e = bpe.Encoder(bpe.Vocabulary(open(queries.tokenizer_path()).read()))
    assert 1 < e.v.lookahead < 10_000
    pool = ["a", "b", "'s", "'re", " ", "\n", "é", "漢", "1", "٣", "!", "<|endoftext|>", "<|endo", "😀", "\x1c", "the", "́", "\x00"]
    for chunk, piece in ((1 << 16, 1 << 15), (7, 5), (40, 20)):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(bpe, "LONG_PIECE", piece)
        for _ in range(300):
            s = "".join(rnd.choice(pool) * rnd.choice([1, 1, 2, 9, 60]) for _ in range(rnd.randint(0, 25)))
            assert [i for p in e.stream(s) for i in p] == t.encode(s, add_special_tokens=False).ids
    for s in ("ab" * 60_000, " " * 70_000 + "x"):
        assert [i for p in e.stream(s) for i in p] == t.encode(s, add_special_tokens=False).ids


def test_lookahead_needs_a_proper_list():
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"c", b"ab")]) == 2
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([(b"ab", b"c")])


def test_bpe_edges(odd, none):
    path = queries.tokenizer_path()
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert len(got) == 10 and all(r["decoded"] == (r["text"] or "") for r in got)
    assert [r["n_tokens"] for r in got if not r["text"]] == [0, 0]
    assert bpe.encode_and_decode(none, path).count() == 0
    v = bpe.Vocabulary(open(path).read())
    d = bpe.Decoder(v)
    face = v.bytes_of and [v.first[b] for b in "😀".encode()]
    assert [d.feed([i]) for i in face] == ["", "", "", "😀"] and d.feed(face[:2]) + d.close() == "�"


# ---------------------------------------------------------------- 2 mixing

def test_mix_stays_within_a_block(spark):
    slots = spark.createDataFrame([("a", 50), ("b", 30), ("c", 13), ("d", 7)], "src string, slots long")
    plan = sorted(mixing.schedule(slots).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in plan] == list(range(100))
    seen = collections.Counter()
    for r in plan:
        seen[r["src"]] += 1
        for s, n in (("a", 50), ("b", 30), ("c", 13), ("d", 7)):
            assert abs(seen[s] - (r["slot"] + 1) * n / 100) < 1


def test_mix_edges(odd, none):
    got = mixing.mix(odd, block_rows=2).collect()
    assert len(got) == 10 and len({(r["mix_slot"], r["mix_place"]) for r in got}) == 10
    assert mixing.mix(none).count() == 0
    weighed = mixing.mix(odd, weights={"a": 3.0, None: 1.0}, block_rows=1, resolution=8).collect()
    assert len(weighed) == 10


# ---------------------------------------------------------------- 3 HTML

def test_html_main_text():
    page = html_extract.Page("""<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="cookie-notice">We use</div>
      <header>Site</header><nav><a>Home</a></nav><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>word<br>next<p>Two&nbsp;x
      <aside>side</aside><div class="ad">buy</div><form>f<input></form><section id="comments"><article class="comment">me too</article></section>
      <script>var t="</p>";</script></article><footer>&copy;</footer>""")
    assert page.main_text() == "Head & line\n\nOne boldword next\n\nTwo x"
    assert html_extract.Page("plain  text").main_text() == "plain text"
    assert html_extract.Page("<div><p>a<div class='sidebar'>s</div><p>b</div>").main_text() == "a\n\nb"
    assert html_extract.Page("<ul class=menu><li>m</ul><main><p>x</main>").main_text() == "x"
    assert html_extract.Page(None).main_text() == html_extract.Page("<!-- a").main_text() == html_extract.Page("<script>x").main_text() == ""
    assert html_extract.Page("<div>" * 3000 + "deep").main_text() == "deep"


def test_html_class_names_do_not_take_the_article():
    """Names that merely contain a word of the list keep their text; outright ones go."""
    page = html_extract.Page("""<article><h1>Title</h1><div class="legal-history"><p>One.</p></div><section id="search-algorithms">Two.</section>
        <p class="hidden-gem">Three.</p><div class="comment-list">No.</div><div class="related">No.</div><div id="sidebarLeft">No.</div><p class="lead share-price">Four.</p></article>""")
    assert page.main_text() == "Title\n\nOne.\n\nTwo.\n\nThree.\n\nFour."


def test_html_template_is_deduced(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div>Same words everywhere</div><div><p>Own text {k}</p></div></body>") for k in range(20)]
    rows += [(99, None, None), (100, "http://other.example/", "<div>Same words everywhere</div>"), (100, "http://other.example/", "<div>Same words everywhere</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_extract.extract(pages).collect())
    assert got == sorted([(k, f"Own text {k}") for k in range(20)] + [(99, "")] + 2 * [(100, "Same words everywhere")])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_copies_and_articles_are_no_template(spark):
    page = "<body><div>Menu words</div><div><p>The one story</p></div></body>"
    rows = [(k, f"http://copies.example/{k}", page) for k in range(20)] + [(100 + k, None, page) for k in range(20)]
    # the same paragraphs in every article, a menu around it that is template
    rows += [(200 + k, f"http://art.example/{k}", f"<body><div class=top>Top words</div><article><p>Shared story</p></article><div>Line {k}</div></body>") for k in range(20)]
    rows += [(300 + k, f"http://main.example/{k}", f"<body><div>Top words</div><main><p>Shared story</p></main><i>{k}</i></body>") for k in range(20)]
    # a text that recurs by itself, without structure of its own, is content; with an element of its own it is template
    rows += [(400 + k, f"http://plain.example/{k}", "<body>" + ("<p>A saying</p>" if k % 10 else "<p>No saying</p>")
              + ("<div class=box>Boxed</div>" if k % 10 != 1 else "") + f"<p>Own {k}</p></body>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == got[100 + k] == "Menu words\n\nThe one story" for k in range(20))
    assert all(got[200 + k] == got[300 + k] == "Shared story" for k in range(20))
    assert all(got[400 + k] == ("A saying" if k % 10 else "No saying") + f"\n\nOwn {k}" for k in range(20))


def test_html_query(spark):
    import html
    got = {r["page_id"]: r["text"] for r in queries.op3_html_text(spark, SF_SMALL).collect()}
    for r in read_table(spark, SF_SMALL, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


# ---------------------------------------------------------------- 4 vectors

def test_vectors_recall_and_edges(spark):
    e = read_table(spark, SF_SMALL, "embeddings").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = queries.op4_nearest_vectors(spark, SF_SMALL).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        rest = ids != q
        true = set(ids[rest][np.lexsort((ids[rest], d[rest]))[:10]])
        own = got[got.query_id == q]
        hit, total = hit + len(true & set(own.vec_id)), total + len(true)
        assert sorted(own["rank"]) == list(range(1, len(own) + 1))
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=1e-15, atol=0)
    assert hit / total >= 0.9
    nan = float("nan")
    odd = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1),
                                 (7, [2.0, 0.0], 1), (7, [2.0, 0.0], 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, score int")
    found = multi_index.search(odd, odd.where("vec_id in (0, 4, 5)"), neighbours=3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 0.0), (0, 2, 0.0), (0, 7, 1.0)]
    assert multi_index.search(odd.limit(0), odd).count() == 0 and multi_index.search(odd, odd.limit(0)).count() == 0


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(k, [float(k), 1.0, 2.0, 3.0]) for k in range(30)] + [(100 + k, [float(k), 1.0]) for k in range(9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = multi_index.search(docs, docs.where("vec_id in (3, 100)"), neighbours=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(3, 1, 2), (3, 2, 4)]


def test_vectors_groups_are_bounded_on_both_sides(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 4))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(multi_index, "CELLS_PER_HALF", 2)
    want = {(r["query_id"], r["rank"], r["vec_id"]) for r in multi_index.search(table, table, neighbours=4).collect()}
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 40)
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 25)
    sizes = spark.sparkContext.accumulator(0)
    plain = PandasCogroupedOps.applyInPandas

    def apply(self, func, schema):
        def sized(key, q, rows):
            sizes.add(1 if len(q) > 60 or len(rows) > 90 else 0)
            return func(key, q, rows)
        return plain(self, sized, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", apply)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in multi_index.search(table, table, neighbours=4).collect()}
    assert got == want and len(got) == 1200 and sizes.value == 0
    assert multi_index.cells_for(1_000) == 2 and multi_index.cells_for(40_000_000) == 200


# ---------------------------------------------------------------- 5 n-grams

def brute_groups(rows, width, num, den):
    sets, parent, inverted = {}, {}, collections.defaultdict(list)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        parent[i] = i
    for i in sorted(sets):
        shared = collections.Counter()
        for s in sets[i]:
            shared.update(inverted[s])
            inverted[s].append(i)
        for j, o in shared.items():
            if den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (2, 60), (3, 100)])
def test_jaccard_against_brute_force(spark, width, num):
    rnd = random.Random(width * num)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(240):
        if i % 4 and rows:
            words = rows[rnd.randrange(len(rows))][1].split()
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 5, 20, 60, 150]))] + (passage if i % 8 == 0 else [])
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(
        spark.createDataFrame(rows, "doc_id long, text string"), width, num, 100).collect()}
    assert got == brute_groups(rows, width, num, 100)


def test_jaccard_tiles_agree_with_one_tile(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(
        spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute_groups(rows, 3, 90, 100)


def test_jaccard_empty_texts_of_repeated_ids_link_nothing(spark):
    """Jaccard 0.859 apart, each with a null or empty row of the same id."""
    one = [f"a{k}" for k in range(160)]
    two = one[:148] + [f"b{k}" for k in range(12)]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (1, None), (2, None), (1, ""), (2, " \n")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {(1, 158, 1), (2, 158, 2), (1, 0, 1), (2, 0, 2)}
    sets = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.arange(5, dtype=np.uint64)]
    assert ngram_join.tile_links(np.array([1, 2, 3]), sets, np.zeros(3, int), ngram_join.Bound(80, 100)) == []


def test_jaccard_edges(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(odd, 3, 90, 100).collect()), key=str)
    assert len(got) == 10
    assert got.count((5, 2, 1)) == 2 and (1, 2, 1) in got and (None, 2, None) in got
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4), (7, 1, 7)} <= set(got)
    assert ngram_join.jaccard_groups(none).count() == 0


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from revlens.llm import common
    text = " ".join(f"Wörd{k % 50}" for k in range(3000)) + " " + "z" * 5000 + "\x0bend"
    whole = word_hashes(text)
    monkeypatch.setattr(common, "BLOCK", 64)
    assert (word_hashes(text) == whole).all() and len(whole) == 3002


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(k, k + 1) for k in range(100, 140)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {3: 3, 7: 3, 8: 3, 9: 3, 20: 20, 21: 20} | {k: 100 for k in range(100, 141)}


# ---------------------------------------------------------------- 6 language, 7 toxicity

def test_language(spark, odd, none):
    sf = SF_SMALL.replace("0.001", "0.01")
    got = queries.op6_language(spark, sf).join(read_table(spark, sf, "documents"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.95 and got.score.between(0, 1).all()
    known = {"en": b"the of and to in that was " * 40, "de": "der die und das ist nicht ü ".encode() * 40}
    out = {r["doc_id"]: r["x"] for r in odd.select("doc_id", language.identify(odd, known).alias("x")).collect()}
    assert out[2]["lang"] == out[3]["lang"] == out[4]["lang"] == "und" and out[2]["rejected"] and out[1]["lang"] in known
    assert none.select(language.identify(none, known)).count() == 0
    assert language.train(none.withColumnRenamed("source", "lang")) == {}


def test_toxicity_held_out(spark, odd, none):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "labels")
    test = labels.where("doc_id % 5 = 0")
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    assert (np.diff(model.cuts) > 0).all()
    got = docs.join(test, "doc_id").select("toxic", toxicity.predict(docs, model).alias("x")).select("toxic", "x.*").toPandas()
    assert got.rejected[got.toxic == 1].mean() >= 0.95 and got.rejected[got.toxic == 0].mean() <= 0.01
    out = odd.select(toxicity.predict(odd, model).alias("x")).select("x.*").toPandas()
    assert len(out) == 10 and not out.rejected.any() and out.severity.between(0, 3).all()
    empty = toxicity.train(none, labels)
    assert not odd.select(toxicity.predict(odd, empty)["rejected"].alias("r")).where("r").count()


# ---------------------------------------------------------------- 8 SimHash

def test_simhash_query(spark):
    docs = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op8_simhash(spark, SF_SMALL).collect()}
    for k, r in enumerate(docs):
        text, after = r["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        own = got[r["doc_id"]]
        assert own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and own["n_chars"] == len(text)
        assert own["fingerprint"] == simhash.fingerprint(text).hex() and own["edited_fingerprint"] == simhash.fingerprint(edited).hex()
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in got.values()])


@pytest.mark.parametrize("per_range", [1, 3, 4000])
def test_next_row_crosses_ranges(odd, none, per_range):
    def work(ids, texts, nexts):
        return {"id": ids, "t": texts, "n": nexts}

    got = simhash.with_next(odd, work, "id long, t string, n string", rows_per_range=per_range).collect()
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect()))
    want = sorted((rows[k] + (rows[(k + 1) % 10][1],) for k in range(10)))
    assert sorted((-1 if r["id"] is None else r["id"], r["t"], r["n"]) for r in got) == want
    assert simhash.with_next(none, work, "id long, t string, n string").count() == 0


def test_simhash_groups(spark):
    rnd = random.Random(2)
    marks = [rnd.getrandbits(128) for _ in range(30)]
    marks += [m ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(1, 6))) for m in marks for _ in range(3)] + marks[:5]
    rows = [(k, f"{m:032x}") for k, m in enumerate(marks)] + [(None, "0" * 32), (999, None)]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fingerprint string"), radius=3).collect()}
    group = list(range(len(marks)))
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert got == dict(enumerate(group))


def test_simhash_groups_keep_both_texts_of_an_id(spark):
    # both pairs agree on the first two of five blocks alone, so they meet in one bucket only
    a, b, three = (1 << 77) - 1, 0, (1 << 70) | (1 << 40) | (1 << 10)
    rows = [(5, a), (5, b), (7, a ^ three), (9, b ^ three), (11, ((1 << 51) - 1) << 77)]
    marks = spark.createDataFrame([(i, f"{m:032x}") for i, m in rows], "doc_id long, fingerprint string")
    got = {(r["doc_id"], r["group_id"]) for r in simhash.near_groups(marks, radius=3).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11)}


def test_simhash_query_groups_equal_brute_force(spark):
    """All pairs of the table's fingerprints, without block tables: recall is whole."""
    got = [(r["doc_id"], r["fingerprint"], r["group_id"]) for r in queries.op8_simhash(spark, SF_SMALL).collect()]
    ids, marks = [g[0] for g in got], [int(g[1], 16) for g in got]
    group = dict(zip(ids, ids))
    for a in range(len(marks)):
        for b in range(a):
            x, y = group[ids[a]], group[ids[b]]
            if x != y and (marks[a] ^ marks[b]).bit_count() <= simhash.RADIUS:
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    assert {g[0]: g[2] for g in got} == group and len(set(group.values())) < len(got)


def test_simhash_groups_keep_rows_and_columns(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 4)       # fingerprints of more than a quarter of the rows are hot
    monkeypatch.setattr(simhash, "TILE", 2)
    rows = [(k, f"{k % 2:032x}", "x") for k in range(4, 12)] + [(k, f"{1 << k:032x}", "y") for k in range(90, 95)]
    rows += [(None, f"{1:032x}", "n"), (None, "f" * 32, "n"), (50, None, None), (60, "e" * 32, "z"), (60, "e" * 32, "z")]
    made = spark.createDataFrame([(i, f, x, "old", 7) for i, f, x in rows], "doc_id long, fingerprint string, head string, group_id string, n_rows int")
    got = simhash.with_groups(made)
    assert got.columns == ["doc_id", "fingerprint", "head", "n_rows", "group_id"]
    want = {None: None, 50: None, 60: 60}
    out = [(r["doc_id"], r["fingerprint"], r["head"], r["n_rows"], r["group_id"]) for r in got.collect()]
    near_zero = 4                                      # 0, 1 and the single bits are linked
    assert sorted(out, key=str) == sorted(((i, f, x, 7, near_zero if f and f not in ("f" * 32, "e" * 32) else want[i]) for i, f, x in rows), key=str)
    assert simhash.with_groups(made.where("doc_id < 0")).count() == 0


# ---------------------------------------------------------------- 9 licences, 10 lines

def test_wrapped_notices_and_whole_files(spark):
    import textwrap
    wrap = lambda t, head="": "\n".join(head + x for x in textwrap.wrap(t, 60))
    prose = "The river ran past seven mills that stood on its banks. Few of them still turn. Nobody counts the years. "
    names = ["GPL-3.0", "MIT", "ISC", "Apache-2.0", "MPL-2.0"]
    notice = {n: max((t for t in licenses.TEMPLATES[n]), key=len) for n in names} | {"MIT": licenses.TEMPLATES["MIT"][-2], "MPL-2.0": licenses.TEMPLATES["MPL-2.0"][0]}
    rows = [(k, wrap(prose + notice[n] + " " + prose)) for k, n in enumerate(names)]
    rows += [(10 + k, wrap(notice[n], " * ").replace("\n", "\r\n")) for k, n in enumerate(names)]
    bsd = licenses.TEMPLATES["BSD-3-Clause"][-1].replace("met: ", "met:\n\n1. ").replace("disclaimer. ", "disclaimer.\n\n2. ", 1).replace("Neither", "\n\n3. Neither")
    rows += [(20, "BSD 3-Clause License\n\nCopyright (c) 2020, Some Body\n\n" + bsd), (30, wrap(prose * 400)), (31, None), (32, ".\n.\n\n. .")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["dice"]
    for k, n in enumerate(names):
        assert got[k][n] >= 0.95 and got[10 + k][n] >= 0.95
    assert got[20]["BSD-3-Clause"] >= 0.9 and not {30, 31, 32} & set(got)


def test_license_edges(spark, odd, none):
    text = "Some words.\nReleased under the MIT  License. More of it\n\n" + licenses.TEMPLATES["ISC"][0].upper().replace(",", " ,\n")
    docs = spark.createDataFrame([(1, text, "x"), (1, None, "x"), (2, "", "x"), (3, "Licensed under CC BY-NC 4.0.", "x")], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scan(docs).collect()}
    assert got[1, "MIT"] == 1.0 and got[1, "ISC"] == 1.0 and got[3, "CC-BY-NC-4.0"] == 1.0 and not any(k[0] == 2 for k in got)
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_line_dedup_edges(spark, odd, none):
    rows = [(k, f"own {k}\n Accept all cookies \n\ntail {k}", f"s{k}", 1) for k in range(12)]
    rows += [(100 + k, "copied text\nof one page", f"s{k}", 1) for k in range(12)] + [(None, "Accept all cookies", "s1", 1), (50, None, "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_lines(docs).collect()}
    assert got[0] == (rows[0][1], 0) and got[3] == ("own 3\n\ntail 3", 1) and got[None] == ("", 1) and got[50] == (None, 0)
    assert all(got[100 + k] == ("copied text\nof one page", 0) for k in range(12)) and len(got) == 26
    assert line_dedup.remove_lines(odd).count() == 10 and line_dedup.remove_lines(none).count() == 0


def test_line_spread_near_threshold_is_exact(spark):
    rows = [(k, f"nine\nten\nline {k}" if k < 9 else f"ten\nline {k}", f"s{k}") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(docs, min_sites=10).collect()}
    assert got[0].startswith("nine\nten") and got[4] == "nine\nline 4" and got[9] == "line 9"


def brute_lines(rows, most=10, least=2):
    def keys(t):
        return {x.strip(" \t\r") for x in t.split("\n")} - {""}
    have = [r for r in rows if r[1] is not None]
    bound = min(most, max(least, (len({s for _, t, s in have if s and keys(t)}) + 1) // 2))
    sites, ids = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, s in have:
        for x in keys(t):
            sites[x] |= {s} - {None}
            ids[x] |= {i} - {None}
    gone = {x for x in sites if len(sites[x]) >= bound}
    first = {(x, t) for i, t, _ in have for x in keys(t) & gone if ids[x] and i == min(ids[x])}
    return sorted([(str(i), t and "\n".join(x for x in t.split("\n") if (y := x.strip(" \t\r")) not in gone or (y, t) in first)) for i, t, _ in rows], key=str)


@pytest.mark.parametrize("sites", [1, 2, 3, 5, 30])
def test_line_dedup_against_brute_force(spark, monkeypatch, sites):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 20)            # both ways of the join
    rnd = random.Random(sites)
    pool = ["menu"] * 40 + [f"line {k}" for k in range(60)] + [" \t", ""]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6))) for _ in range(80)] + [None]
    rows = [(rnd.choice([None, k, k, k, k // 2]), rnd.choice(texts), rnd.choice([None] + [f"s{j}" for j in range(sites)] * 3)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted([(str(r["doc_id"]), r["text"]) for r in line_dedup.remove_lines(docs).collect()], key=str)
    assert got == brute_lines(rows)


# ---------------------------------------------------------------- 6 language, more cases

def test_language_needs_letters_and_whole_texts(spark):
    de, fr = "der hund und die katze gehen nach hause weil es regnet ", "le chien et le chat rentrent car il pleut dehors "
    known = language.train(spark.createDataFrame([(k, de * 40 if k % 2 else fr * 40, "de" if k % 2 else "fr") for k in range(20)], "doc_id long, text string, lang string"))
    assert all(len(d) == 10 * 40 * len(s.encode()) - 1 for d, s in ((known["de"], de), (known["fr"], fr)))       # nothing is cut off
    texts = ["\u00bd \u00b2 \u2460 12", "___", "", None, de, fr]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "k long, text string").orderBy("k").select(language.identify(spark.createDataFrame([], "k long, text string"), known).alias("x")).collect()]
    assert [g["lang"] for g in got] == ["und"] * 4 + ["de", "fr"] and [g["rejected"] for g in got[:4]] == [True] * 4
    alone = language.train(spark.createDataFrame([(1, de * 400, "de")], "doc_id long, text string, lang string"))
    assert language.Model(alone).predict("xyz")[0] == "de"           # one language only; its one text is long
