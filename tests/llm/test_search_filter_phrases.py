"""Ranked search, url filters and phrases: brute force, edge cases, equal results at any
number of owners, tries and shards."""

import collections
import math
import random
import re
from fractions import Fraction

import pytest

from revlens.llm import phrases, ranked_search, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, score long, block int, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, a very long text, repeated rows, ties, clashing names."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["É", "Été", "x1", "A"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 60))) + rnd.choice(["", ".", ", W1 w2"]), rnd.choice(["en", "fr", None]), k, 1, "r") for k in range(300)]
    rows += [(None, "w1 w2 w3 w4", "en", 1, 1, "x"), (400, None, "fr", 1, 1, "x"), (401, "", None, 1, 1, "x"), (402, " .\n\t;", "en", 1, 1, "x")]
    rows += [(403, "w1 w2 w3 w4", "en", 1, 1, "x")] * 3 + [(404 + k, "w5 w6 w7 w8", "en", 1, 1, "x") for k in range(80)]
    rows += [(500, " ".join(rnd.choices(words, k=200_000)), "en", 1, 1, "x")]
    return rows


# ---------------------------------------------------------------- 11 ranked search

def ranked(docs, items, top):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    held = [(i, collections.Counter(cut((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(cut((t or "").translate(LOWER)))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in own if w in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


ITEMS = [(1, "w1 w2 É"), (2, "w5 W6 w7, w8"), (3, "nothing here"), (4, None), (5, ""), (None, "x1 été"), (6, "w3 w3"), (6, "a w9")]
ITEM = "item_id long, text string"


@pytest.mark.parametrize("owners", [1, 3, 40])
def test_search_equals_brute_force(spark, odd, monkeypatch, owners):
    monkeypatch.setattr(ranked_search, "BUNDLE_ITEMS", 3)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 70)
    docs, items = spark.createDataFrame(odd, DOCS), spark.createDataFrame(ITEMS, ITEM)
    got = [tuple(r) for r in ranked_search.search(docs, items, top=50, owners=owners).collect()]
    want = ranked([(r[0], r[1]) for r in odd], ITEMS, 50)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_search_in_several_parts_and_short_lists(spark, odd):
    docs, items = spark.createDataFrame(odd, DOCS), spark.createDataFrame(ITEMS, ITEM)
    got = [tuple(r) for r in ranked_search.search(docs, items, top=7, most_pairs=4).collect()]
    assert sorted(got, key=str) == sorted(ranked([(r[0], r[1]) for r in odd], ITEMS, 7), key=str)


def test_search_drops_accumulators_only_below_the_top(spark):
    """Rare terms first: many documents leave, none that belongs to the result."""
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choices([f"c{j}" for j in range(5)], k=30) + rnd.choices([f"r{j}" for j in range(400)], k=rnd.randint(0, 9))), "en", 0, 0, "") for k in range(2_000)]
    items = [(k, " ".join([f"r{j}" for j in range(k, k + 40)] + ["c1", "c2"])) for k in range(0, 200, 40)]
    got = [tuple(r) for r in ranked_search.search(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEM), top=10).collect()]
    assert sorted(got) == sorted(ranked([(r[0], r[1]) for r in rows], items, 10))


def test_search_empty_tables(spark, odd):
    docs, items = spark.createDataFrame(odd[:5], DOCS), spark.createDataFrame(ITEMS, ITEM)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        found = ranked_search.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


# ---------------------------------------------------------------- 12 url filter

RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/", "allow a.example.org/es/x", "block b.com", "allow b.com",
         "block /private/", "allow org/es/deep/er/path"]


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(LOWER), slash + path
    fits = [r for r in rules if (not r[1] or host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1].split(".")) if r[1] else 0, len(r[2]), r[0]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else default


URLS = ["http://example.org", "http://example.org/", "https://A.Example.org/es/x?y#z", "http://example.org/es", "http://example.org/es/", "http://x.example.org/en/12",
        "http://notexample.org/es/1", "http://b.com", "ftp://q.b.com/z", "http://u@b.com/", "http://com/fr/a", "com/fr/", "", None, "://", "http:///private/x", "http://x/private/",
        "http://a.b?c/d", "http://org:80/", "http://x.org/es/deep/er/path/s", "http://x.org/es/deep/er", "http://É.com/de/", "a://b://c.org/", "http://.org/", "http://x.\norg/\n"]


@pytest.mark.parametrize("most_bytes", [1, 200, 1 << 20])
def test_url_filter_equals_brute_force(spark, most_bytes):
    rules = url_filter.parse(RULES)
    urls = URLS + ["http://" + "a." * 30_000 + "org/" + "s/" * 30_000]
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)] + [(0, URLS[0], "x", 1)], "page_id long, url string, host string, rule int")
    got = url_filter.judge(df, rules, most_bytes=most_bytes)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and got.count() == len(urls) + 1
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_url_filter_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(df, [], default="block").collect()] == [(1, "http://a.org/x", "a.org", "/x", None, "block")]
    assert url_filter.judge(df.limit(0), url_filter.parse(RULES)).count() == 0
    with pytest.raises(ValueError):
        url_filter.parse(["deny org/"])


# ---------------------------------------------------------------- 13 phrases

def mined(rows, top, least, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    inside = set()
    for (lang, w), a in f.items():
        for k in range(2, len(w)):
            inside.update((lang, w[i:i + k]) for i in range(len(w) - k + 1) if a >= f[lang, w[i:i + k]])
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in inside:
            cuts = [(math.floor(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]])), k) for k in range(1, len(w))]
            s, k = min(cuts)
            out[lang].append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(8)
    vocabulary = [f"v{k}" for k in range(40)] + ["É", "ß", "\x01"]
    rows = []
    for k in range(400):
        words = rnd.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rnd.randint(0, 80))
        if k % 3 == 0:
            words[5:5] = ["New", "york", "city", "hall", "steps", "again"]
        text = "".join(w + rnd.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b"]) for w in words)
        rows.append((text, rnd.choice(["en", "en", "fr", None])))
    return rows + [(None, "en"), ("", "fr"), (" ,.", None)] + [("a a a a a a", "de")] * 9 + [("un deux " * 60_000, "fr")]


@pytest.mark.parametrize("shard_bytes", [1_500, 64 << 20])
def test_phrases_equal_brute_force(spark, prose, shard_bytes):
    df = spark.createDataFrame([(t, x, 1, 2, "h") for t, x in prose], "text string, lang string, n int, h int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, top=60, least=12, shard_bytes=shard_bytes).collect())
    want = mined(prose, 60, 12)
    assert len(want) > 60 and got == want


def test_pairs_only_and_empty_table(spark, prose):
    df = spark.createDataFrame(prose, "text string, lang string")
    got = sorted(tuple(r) for r in phrases.collocations(df, top=5, least=12, longest=2).collect())
    assert got == mined(prose, 5, 12, 2)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_keys_are_sorted_in_classes(monkeypatch, prose):
    """The same phrases however few keys are held at once."""
    def all_of():
        shard = phrases.Shard()
        for t, lang in prose:
            shard.add(lang or "und", (t or "").encode())
        return sorted((lang, k, int(h), p) for lang, hs, k, ps in phrases.mine(shard, 5, 1, 5) for h, p in zip(hs, ps))
    want = all_of()
    monkeypatch.setattr(phrases, "SLICE", 777)
    monkeypatch.setattr(phrases, "CLASS_KEYS", 5_000)
    assert len(want) > 500 and all_of() == want


def test_a_word_may_pass_a_slice(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 16)
    rows = [("one two three four five six seven " * 6 + "x" * 90, "en")] * 4
    shard = phrases.Shard()
    for t, lang in rows:
        shard.add(lang, t.encode())
    found = {p for _, _, k, ps in phrases.mine(shard, 4, 1, 5) for p in ps}
    assert "one two three four five" in found and "x" * 90 in found
