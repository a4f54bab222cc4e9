"""DuckDB text of the derived views, prepended as CTEs to every oracle query.

The oracles are written from the semantics in plain SQL (window functions,
correlated logic, list functions) -- deliberately not from the Spark code.
"""

from __future__ import annotations

from revlens.functions.text import WS
from revlens.sources.lexicons import FX_ASPECTS, FX_BOOSTER, FX_NEGATION, FX_SENTIMENT, FX_STOP, NUMBER_WORDS

VIEWS: dict[str, str] = {}

VIEWS["reviews"] = """
SELECT d.doc_id AS review_id,
  CASE WHEN d.doc_id % 211 = 7 THEN NULL
       WHEN d.doc_id % 211 = 8 THEN '   '
       WHEN d.doc_id % 17 = 0 THEN concat('<p>', d.text, '</p> http://x.example/a \U0001F600\U0001F600 !!')
       ELSE d.text END AS review_text,
  CASE WHEN d.doc_id % 97 = 0 THEN '9' WHEN d.doc_id % 89 = 1 THEN 'n/a'
       WHEN l.toxic = 1 THEN CAST(1 + d.doc_id % 2 AS VARCHAR)
       WHEN l.quality = 1 THEN CAST(4 + d.doc_id % 2 AS VARCHAR)
       WHEN l.quality = 0 THEN '3' END AS rating,
  CASE d.doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'yes' WHEN 3 THEN '0' END AS verified_purchase,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(d.doc_id % 7 AS DOUBLE) END AS helpful_votes,
  CAST(d.doc_id % 7 + d.doc_id % 3 AS DOUBLE) AS total_votes,
  CAST(1704067200 + d.doc_id * 600 AS BIGINT) AS ts_epoch,
  d.doc_id % 150 AS reviewer_id, d.doc_id % 200 AS product_id, d.lang AS lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["predictions"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey % 10 AS INT) AS fold,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  CAST(CASE WHEN l_returnflag = 'R' THEN least(1000, 200 + h) ELSE h END AS DOUBLE) / 1000 AS p_a,
  CASE WHEN (CASE WHEN l_returnflag = 'R' THEN least(1000, 200 + h) ELSE h END) >= 500 THEN 1 ELSE 0 END AS pred_a,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred_b,
  CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS pred_c
FROM (SELECT *, (l_partkey * 7919 + l_orderkey * 31 + l_linenumber) % 1001 AS h FROM lineitem) t
"""

VIEWS["multiclass"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, id, y,
  a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
    CAST(1 + (l_partkey * 31 + l_linenumber) % 97 + CASE WHEN l_returnflag = 'A' THEN 40 ELSE 0 END AS DOUBLE) AS a,
    CAST(1 + (l_suppkey * 17 + l_orderkey) % 89 + CASE WHEN l_returnflag = 'N' THEN 40 ELSE 0 END AS DOUBLE) AS b,
    CAST(1 + (l_orderkey * 13 + l_partkey) % 83 AS DOUBLE) AS c FROM lineitem) t
"""

VIEWS["fold_scores"] = """
SELECT fold, model, score FROM (
  SELECT fold, avg(CASE WHEN pred_a = y_true THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a,
         avg(CASE WHEN pred_b = y_true THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS b,
         avg(CASE WHEN pred_c = y_true THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c
  FROM predictions GROUP BY fold) t
UNPIVOT (score FOR model IN (a, b, c))
"""

VIEWS["emb"] = """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings
"""

VIEWS["prototypes"] = """
SELECT 'aspect_' || CAST(label AS VARCHAR) AS aspect, label AS aspect_ord, embedding
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM emb) t WHERE rn = 1
"""

VIEWS["minority"] = """
SELECT vec_id, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM emb
"""


def _aspects_sql() -> str:
    vals = ", ".join(f"('{a}', '{s}', {ai}, {si})" for ai, (a, ss) in enumerate(FX_ASPECTS.items())
                     for si, s in enumerate(ss))
    return f"SELECT * FROM (VALUES {vals}) t(aspect, seed, aspect_ord, seed_ord)"


def _sentiment_sql() -> str:
    vals = ", ".join(f"('{t}', {v!r}::DOUBLE, {p!r}::DOUBLE, {s!r}::DOUBLE)" for t, (v, p, s) in FX_SENTIMENT.items())
    return f"SELECT * FROM (VALUES {vals}) t(token, valence, polarity, subjectivity)"


def _list_sql(name: str, words) -> str:
    vals = ", ".join(f"('{w}')" for w in words)
    return f"SELECT * FROM (VALUES {vals}) t({name})"


def _booster_sql() -> str:
    vals = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in FX_BOOSTER.items())
    return f"SELECT * FROM (VALUES {vals}) t(token, shift)"


VIEWS["fx_aspects"] = _aspects_sql()
VIEWS["fx_sentiment"] = _sentiment_sql()
VIEWS["fx_negation"] = _list_sql("token", FX_NEGATION)
VIEWS["fx_booster"] = _booster_sql()

DEPENDS = {
    "fold_scores": ["predictions"],
    "prototypes": ["emb"],
    "minority": ["emb"],
}

# SQL snippets shared by several oracles (DuckDB dialect)
WS_CLASS = WS
STOP_ALT = "|".join(sorted(set(FX_STOP), key=lambda w: (-len(w), w)))
NUMBER_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in NUMBER_WORDS) + "]"
NEGATION_SQL = "[" + ", ".join(f"'{w}'" for w in FX_NEGATION) + "]"


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def duck_text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def duck_clean(x: str) -> str:
    """DuckDB spelling of the text cleaner (F1)."""
    from revlens.functions.text import CONTROL, EMOJI, HTML_TAG, URL
    t = duck_text(x)
    t = f"regexp_replace({t}, '{HTML_TAG}', ' ', 'g')"
    t = f"regexp_replace({t}, '{CONTROL}', ' ', 'g')"
    t = f"regexp_replace({t}, '{URL}', ' [URL] ', 'g')"
    t = f"regexp_replace({t}, '{EMOJI}', ' \\0 ', 'g')"
    t = f"regexp_replace({t}, '[{WS}]+', ' ', 'g')"
    return f"trim({t})"


def duck_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"
