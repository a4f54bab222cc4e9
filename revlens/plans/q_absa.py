"""Queries for candidate mining, aspect mapping, aspect sentiment and the
business roll-ups built on them (F13, F14, J1, J2, A2-A5, G10-G13, G15, G16, P6, P7).

All of them run over the prepared review table (dedup + clean) of the whole
``documents`` table with the fixture lexicons.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import absa as A
from revlens.operators import business as B
from revlens.operators import features as FE
from revlens.operators.lexicon import LexiconScorer
from revlens.plans import duck as D
from revlens.plans.oracle_views import duck_clean
from revlens.plans.registry import query, r6
from revlens.session import materialize
from revlens.sources import tables
from revlens.sources.lexicons import FX_ASPECTS, FX_STOP, aspects_df

ABSA_VIEWS = ("reviews", "fx_aspects", "fx_sentiment", "fx_booster")
BASE = D.prepared_base()
ABSA = D.absa_ctes()
ASPECT_NAMES = list(FX_ASPECTS)


def prepared(spark, sf):
    return A.prepare_reviews(tables.reviews(spark, sf))


def prepared_once(spark, sf):
    """``prepared``, written once for plans that use it more than once."""
    return materialize(prepared(spark, sf))


def absa_long(spark, sf):
    """A3 over the prepared reviews: the flagship intermediate."""
    return A.absa_extract(prepared(spark, sf), FX_ASPECTS, FX_STOP, LexiconScorer.fixture(spark))


def _cands(spark, sf):
    return A.candidates_long(prepared(spark, sf), FX_STOP)


@query("mine_candidates", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}
SELECT id AS review_id, cand_pos, candidate FROM cands
""")
def q_mine_candidates(spark, sf):
    return _cands(spark, sf)


@query("aspect_lexicon_join", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}
SELECT id AS review_id, cand_pos, candidate, aspect FROM mapped
""")
def q_aspect_lexicon_join(spark, sf):
    m = A.map_to_aspects(_cands(spark, sf), aspects_df(spark))
    return m.select("review_id", "cand_pos", "candidate", "aspect")


@query("unmapped_candidates", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}
SELECT c.id AS review_id, c.cand_pos, c.candidate FROM cands c
WHERE NOT EXISTS (SELECT 1 FROM fx_aspects a WHERE contains(c.candidate, a.seed))
""")
def q_unmapped_candidates(spark, sf):
    u = A.unmapped_candidates(materialize(_cands(spark, sf)), aspects_df(spark))
    return u.select("review_id", "cand_pos", "candidate")


@query("sentences_with_candidate", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA},
m AS (SELECT DISTINCT id, cand_pos, candidate FROM mapped),
hit AS (SELECT m.id, m.cand_pos, s.s_idx, s.s FROM m JOIN sents s ON s.id = m.id AND contains(lower(s.s), m.candidate))
SELECT id AS review_id, cand_pos, CAST(count(*) AS BIGINT) AS n_sentences, min(s_idx) AS first_idx,
       CAST(sum(length(s)) AS BIGINT) AS total_chars FROM hit GROUP BY id, cand_pos
UNION ALL
SELECT m.id, m.cand_pos, CAST(1 AS BIGINT), 0, CAST(length(b.text) AS BIGINT) FROM m JOIN base b ON b.id = m.id
WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.id = m.id AND h.cand_pos = m.cand_pos)
""")
def q_sentences_with_candidate(spark, sf):
    """F14 for every mapped candidate: how many sentences contain it, the first one's
    index (0 = fell back to the whole text) and their total length."""
    p = prepared_once(spark, sf)
    m = A.map_to_aspects(A.candidates_long(p, FX_STOP), aspects_df(spark)).select(
        "review_id", "cand_pos", "candidate").distinct()
    return A.sentence_hits(m, p)


_LONG_OUT = """SELECT id AS review_id, aspect, candidates, round(aspect_sentiment, 6) AS aspect_sentiment,
       round(aspect_confidence, 6) AS aspect_confidence, n_units FROM absa_long"""


def _long_out(df):
    return df.select("review_id", "aspect", "candidates", r6("aspect_sentiment").alias("aspect_sentiment"),
                     r6("aspect_confidence").alias("aspect_confidence"), "n_units")


@query("absa_extract", views=ABSA_VIEWS, oracle=f"WITH {BASE}, {ABSA}\n{_LONG_OUT}")
def q_absa_extract(spark, sf):
    return _long_out(absa_long(spark, sf))


@query("aspect_sentiment", views=ABSA_VIEWS, oracle=f"WITH {BASE}, {ABSA}\n{_LONG_OUT}")
def q_aspect_sentiment(spark, sf):
    """A2 through the relational route: J1 output + texts -> scores."""
    p = prepared_once(spark, sf)
    m = A.map_to_aspects(A.candidates_long(p, FX_STOP), aspects_df(spark))
    return _long_out(A.aspect_sentiment(m, p, LexiconScorer.fixture(spark)))


@query("observed_aspects", views=ABSA_VIEWS, oracle=f"WITH {BASE}, {ABSA}\nSELECT DISTINCT aspect FROM absa_long")
def q_observed_aspects(spark, sf):
    return A.observed_aspects(absa_long(spark, sf))


_WIDE_SQL = ", ".join(
    f"round(coalesce(max(CASE WHEN a.aspect = '{a}' THEN a.aspect_sentiment END), 0.0), 6) AS aspect_sent_{a}, "
    f"round(coalesce(max(CASE WHEN a.aspect = '{a}' THEN a.aspect_confidence END), 0.0), 6) AS aspect_conf_{a}"
    for a in ASPECT_NAMES)


@query("aspect_wide", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}
SELECT b.id AS review_id, {_WIDE_SQL} FROM base b LEFT JOIN absa_long a ON a.id = b.id GROUP BY b.id
""")
def q_aspect_wide(spark, sf):
    p = prepared_once(spark, sf)
    w = A.aspect_wide(p, A.absa_extract(p, FX_ASPECTS, FX_STOP, LexiconScorer.fixture(spark)), ASPECT_NAMES)
    return w.select("review_id", *[r6(c).alias(c) for c in w.columns if c != "review_id"])


@query("nonzero_aspects", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}
SELECT id AS review_id, aspect, round(aspect_sentiment, 6) AS aspect_sentiment FROM absa_long
WHERE abs(aspect_sentiment) > 1e-9
""")
def q_nonzero_aspects(spark, sf):
    nz = FE.nonzero_aspects(absa_long(spark, sf))
    return nz.select("review_id", "aspect", r6("aspect_sentiment").alias("aspect_sentiment"))


@query("aspect_summary", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}, n AS (SELECT count(*)::DOUBLE AS n FROM base)
SELECT aspect, round(count(*) FILTER (WHERE aspect_sentiment <> 0) / n.n * 100, 2) AS prevalence_pct,
       round(sum(aspect_sentiment) / n.n, 4) AS mean_sentiment, round(sum(aspect_confidence) / n.n, 4) AS mean_confidence
FROM absa_long, n GROUP BY aspect, n.n
""")
def q_aspect_summary(spark, sf):
    p = prepared_once(spark, sf)
    return B.aspect_summary(A.absa_extract(p, FX_ASPECTS, FX_STOP, LexiconScorer.fixture(spark)), p)


@query("aspect_value_counts", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA},
v AS (SELECT round(coalesce(a.aspect_sentiment, 0.0), 6) AS value FROM base b
      LEFT JOIN absa_long a ON a.id = b.id AND a.aspect = 'shipping')
SELECT value, count(*) AS n FROM v GROUP BY value
""")
def q_aspect_value_counts(spark, sf):
    p = prepared_once(spark, sf)
    return B.aspect_value_counts(A.absa_extract(p, FX_ASPECTS, FX_STOP, LexiconScorer.fixture(spark)), p, "shipping")


@query("top_negative_aspects", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}, n AS (SELECT count(*)::DOUBLE AS n FROM base)
SELECT aspect, round(sum(aspect_sentiment) / n.n, 6) AS mean_sentiment FROM absa_long, n
GROUP BY aspect, n.n ORDER BY mean_sentiment, aspect LIMIT 5
""")
def q_top_negative_aspects(spark, sf):
    p = prepared_once(spark, sf)
    t = B.top_negative_aspects(A.absa_extract(p, FX_ASPECTS, FX_STOP, LexiconScorer.fixture(spark)), p, k=5)
    return t.select("aspect", r6("mean_sentiment").alias("mean_sentiment"))


REVENUE_SQL = f"""
WITH {BASE}, {ABSA}, n AS (SELECT count(*)::DOUBLE AS n FROM base),
g AS (SELECT aspect, count(*) FILTER (WHERE aspect_sentiment <> 0) AS nz,
             coalesce(avg(aspect_sentiment) FILTER (WHERE aspect_sentiment <> 0), 0.0) AS av FROM absa_long GROUP BY aspect)
SELECT aspect, round(av, 6) AS avg_sentiment, round(nz / n.n, 6) AS prevalence,
       round(greatest(0.0, -av) * (nz / n.n) * n.n * 20.0, 6) AS estimated_revenue_loss
FROM g, n
"""


def revenue_impact_query(spark, sf):
    p = prepared_once(spark, sf)
    r = B.revenue_impact(A.absa_extract(p, FX_ASPECTS, FX_STOP, LexiconScorer.fixture(spark)), p, 20.0)
    return r.select("aspect", *[r6(c).alias(c) for c in ("avg_sentiment", "prevalence", "estimated_revenue_loss")])


query("revenue_impact", views=ABSA_VIEWS, oracle=REVENUE_SQL)(revenue_impact_query)


_A4_SELECT = D.feature_select("b", "sc")


@query("absa_enriched", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA}, {D.lexicon_ctes('sc', 'base', ['id'], D.txt('text'))},
wide AS (SELECT b.id, {_WIDE_SQL} FROM base b LEFT JOIN absa_long a ON a.id = b.id GROUP BY b.id)
SELECT b.id AS review_id, sc.label AS sentiment_label, {_A4_SELECT},
  {", ".join(f"w.aspect_sent_{a}, w.aspect_conf_{a}" for a in ASPECT_NAMES)}
FROM base b JOIN sc ON sc.id = b.id JOIN wide w ON w.id = b.id
""")
def q_absa_enriched(spark, sf):
    """A4: sentiment + features (one aggregate) and wide aspect columns (one pivot), merged on the id."""
    p = prepared_once(spark, sf)
    scorer = LexiconScorer.fixture(spark)
    feats = FE.feature_table(p, scorer, keep_label=True)
    wide = A.aspect_wide(p, A.absa_extract(p, FX_ASPECTS, FX_STOP, scorer), ASPECT_NAMES)
    out = feats.join(wide, "review_id")
    return out.select("review_id", "sentiment_label",
                      *[r6(c).alias(c) for c in out.columns if c not in ("review_id", "sentiment_label")])


@query("merge_features", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {D.lexicon_ctes('sc', 'base', ['id'], D.txt('text'))}
SELECT b.id AS review_id, b.text AS review_text, b.rating, b.verified_purchase AS verified_raw,
  {_A4_SELECT.replace("coalesce(TRY_CAST(trim(b.rating) AS DOUBLE), 0.0) AS rating,", "")}
FROM base b JOIN sc ON sc.id = b.id
""")
def q_merge_features(spark, sf):
    """Base columns + features not already present (base wins): ``verified_purchase``
    and ``rating`` stay as in the base, the parsed versions are not added twice."""
    p = materialize(prepared(spark, sf).select("review_id", "review_text", "rating", "verified_purchase",
                                               "helpful_votes", "total_votes"))
    feats = FE.feature_table(p, LexiconScorer.fixture(spark))
    merged = FE.merge_features(p.withColumnRenamed("verified_purchase", "verified_raw")
                               .drop("helpful_votes", "total_votes"), feats)
    keep = ["review_id", "review_text", "rating", "verified_raw"]
    return merged.select(*keep, *[r6(c).alias(c) for c in merged.columns if c not in keep])


_CONV_BASE = f"""base AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, {duck_clean('text')} AS text
  FROM conversations)"""


@query("score_one", views=("fx_aspects", "fx_sentiment", "fx_booster"), oracle=f"""
WITH {_CONV_BASE}, {ABSA}, {D.lexicon_ctes('sc', 'base', ['id'], D.txt('text'))}
SELECT b.conv_id, b.turn, sc.label AS sentiment_label, round(sc.score, 6) AS sentiment_confidence, a.aspect,
       round(a.aspect_sentiment, 6) AS aspect_sentiment, round(a.aspect_confidence, 6) AS aspect_confidence
FROM base b JOIN sc ON sc.id = b.id LEFT JOIN absa_long a ON a.id = b.id
""")
def q_score_one(spark, sf):
    """A5: per conversation turn, label + confidence + aspect rows (no separate code path)."""
    c = tables.conversations(spark, sf).select(
        F.struct("conv_id", "turn").alias("review_id"), "conv_id", "turn",
        T.basic_clean("text").alias("review_text"))
    scorer = LexiconScorer.fixture(spark)
    s = scorer.score(c, ["review_id"], "review_text", carry_cols=["conv_id", "turn"])
    asp = A.absa_extract(c, FX_ASPECTS, FX_STOP, scorer)
    return s.join(asp, "review_id", "left").select(
        "conv_id", "turn", F.col("label").alias("sentiment_label"), r6("score").alias("sentiment_confidence"),
        "aspect", r6("aspect_sentiment").alias("aspect_sentiment"), r6("aspect_confidence").alias("aspect_confidence"))


@query("phrase_scores", views=ABSA_VIEWS, oracle=f"""
WITH {BASE}, {ABSA},
w AS (SELECT unnest(string_split(candidate, ' ')) AS word, len(string_split(candidate, ' ')) AS n FROM cands),
s AS (SELECT word, sum(n)::DOUBLE / count(*) AS ws FROM w GROUP BY word),
p AS (SELECT candidate, n, unnest(string_split(candidate, ' ')) AS word FROM (SELECT candidate, count(*) AS n FROM cands GROUP BY candidate) x)
SELECT candidate, n, round(sum(ws), 6) AS score FROM p JOIN s USING (word) GROUP BY candidate, n
""")
def q_phrase_scores(spark, sf):
    """F13 scores: word degree over frequency, summed over the candidate's words."""
    return A.phrase_scores(materialize(_cands(spark, sf))).select("candidate", "n", r6("score").alias("score"))


_VECTOR_THRESHOLD = 0.25
_FALLBACK = f"""
protos AS (SELECT a.aspect, a.aspect_ord, p.embedding FROM (SELECT DISTINCT aspect, aspect_ord FROM fx_aspects) a
           JOIN prototypes p ON p.aspect_ord = a.aspect_ord),
rest AS (SELECT DISTINCT candidate FROM cands c WHERE NOT EXISTS (SELECT 1 FROM fx_aspects a WHERE contains(c.candidate, a.seed))),
vecs AS (SELECT r.candidate, e.embedding FROM rest r
         JOIN emb e ON e.vec_id = ('0x' || substr(md5(r.candidate), 1, 6))::BIGINT % (SELECT count(*) FROM emb)),
sims AS (SELECT v.candidate, p.aspect, p.aspect_ord, list_inner_product(v.embedding, p.embedding) AS sim FROM vecs v, protos p),
fb AS (SELECT candidate, aspect, aspect_ord FROM sims WHERE sim >= {_VECTOR_THRESHOLD}
       QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY sim DESC, aspect_ord) = 1),
"""


@query("absa_extract_vectors", views=(*ABSA_VIEWS, "emb", "prototypes"), oracle=f"WITH {BASE}, {D.absa_ctes(_FALLBACK)}\n{_LONG_OUT}")
def q_absa_extract_vectors(spark, sf):
    """A3 with the embedding fallback (J1 -> J2 -> J3) for strings without a seed."""
    p = prepared_once(spark, sf)
    lexicon = aspects_df(spark)
    protos = tables.prototypes(spark, sf).select("aspect_ord", "embedding").join(lexicon.select("aspect", "aspect_ord").distinct(), "aspect_ord")

    def vectors(strings):
        return tables.candidate_vectors(strings, tables.embeddings(spark, sf))

    return _long_out(A.absa_extract_with_vectors(p, lexicon, FX_STOP, LexiconScorer.fixture(spark), vectors, materialize(protos), _VECTOR_THRESHOLD))


@query("token_labels", oracle=None)
def q_token_labels(spark, sf):
    """Weak begin/inside labels of the mapped candidates (rows check; pytest holds them against
    a brute-force labelling)."""
    p = prepared_once(spark, sf).select("review_id", "review_text")
    m = A.map_to_aspects(A.candidates_long(p, FX_STOP), aspects_df(spark))
    return A.token_labels(p, m)
