"""DuckDB spellings of the text functions and of the lexicon scorer, for oracles.

These are written from the documented semantics (window ``lag`` for previous
tokens, joins for lexicons), not by translating the Spark expressions.
"""

from __future__ import annotations

from revlens.functions.text import SENTENCE, WS
from revlens.sources.lexicons import BOOSTER_DAMPING, COMPOUND_ALPHA, NEGATION_SCALAR, POLARITY_NEGATION, POSITIVE_THRESHOLD
from revlens.plans.oracle_views import NEGATION_SQL, NUMBER_WORDS_SQL, STOP_ALT


def txt(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def char_count(x: str) -> str:
    return f"CAST(length({txt(x)}) AS BIGINT)"


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({txt(x)}, '[^{WS}]+')) AS BIGINT)"


def sentence_count(x: str) -> str:
    return f"CAST(greatest(1, len(regexp_extract_all({txt(x)}, '[.!?]'))) AS BIGINT)"


def ttr(x: str) -> str:
    toks = f"list_filter(string_split_regex(lower({txt(x)}), '[{WS}]+'), lambda w: regexp_full_match(w, '\\p{{L}}+'))"
    return (f"(CASE WHEN len({toks}) > 0 THEN len(list_distinct({toks}))::DOUBLE / len({toks}) "
            f"ELSE 0.0::DOUBLE END)")


def readability(x: str) -> tuple[str, str]:
    t = txt(x)
    words = f"regexp_extract_all(lower({t}), '\\p{{L}}+')"
    w = f"len({words})::DOUBLE"
    s = f"greatest(1, len(regexp_extract_all({t}, '[.!?]')))::DOUBLE"
    groups = f"len(regexp_extract_all(lower({t}), '[aeiouy]+'))"
    novowel = f"len(list_filter({words}, lambda w: NOT regexp_matches(w, '[aeiouy]')))"
    cplx = f"len(list_filter({words}, lambda w: regexp_matches(w, '[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]+[aeiouy]')))"
    fk = f"(CASE WHEN {w} > 0 THEN 0.39 * ({w} / {s}) + 11.8 * (({groups} + {novowel}) / {w}) - 15.59 ELSE 0.0 END)::DOUBLE"
    fog = f"(CASE WHEN {w} > 0 THEN 0.4 * (({w} / {s}) + 100.0 * ({cplx} / {w})) ELSE 0.0 END)::DOUBLE"
    return fk, fog


def entity_count(x: str) -> str:
    t = f"regexp_replace({txt(x)}, '(^|[.!?][{WS}]*)\\p{{Lu}}\\p{{L}}*', '\\1', 'g')"
    return f"CAST(len(regexp_extract_all({t}, '(^|[^\\p{{L}}])\\p{{Lu}}\\p{{L}}*([{WS}]+\\p{{Lu}}\\p{{L}}*)*')) AS BIGINT)"


def number_tokens(x: str) -> str:
    toks = f"regexp_extract_all(lower({txt(x)}), '[\\p{{L}}\\p{{N}}]+([.,/][0-9]+)*')"
    return (f"CAST(len(list_filter({toks}, lambda w: regexp_full_match(w, '[0-9]+([.,/][0-9]+)*') "
            f"OR list_contains({NUMBER_WORDS_SQL}, w))) AS BIGINT)")


def candidates_list(x: str) -> str:
    """Stop-word delimited phrases, in text order (duplicates kept; dedup is done relationally)."""
    t = f"regexp_replace(lower({txt(x)}), '[^\\p{{L}}\\p{{N}} ''-]', ' | ', 'g')"
    t = f"(' ' || replace({t}, ' ', '  ') || ' ')"
    t = f"regexp_replace({t}, ' (?:{STOP_ALT}) ', ' | ', 'g')"
    parts = f"list_transform(string_split({t}, '|'), lambda p: trim(regexp_replace(p, ' +', ' ', 'g')))"
    return f"list_filter({parts}, lambda p: length(p) >= 2 AND length(p) <= 40)"


def sentences_list(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({txt(x)}, '{SENTENCE}'), lambda s: {strip('s')}), "
            f"lambda s: length(s) > 0)")


def lexicon_ctes(prefix: str, src: str, keys: list[str], text_expr: str) -> str:
    """CTEs ``{prefix}_tok ... {prefix}`` scoring ``src`` (one row per key) with the
    fixture lexicons; the final CTE ``{prefix}`` has keys + vader_* + tb_* + label + score."""
    k = ", ".join(keys)
    kq = ", ".join(f"q.{c}" for c in keys)
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM q.{c}" for c in keys)
    d1, d2, d3 = BOOSTER_DAMPING
    th = POSITIVE_THRESHOLD
    return f"""
{prefix}_t AS (SELECT {k}, regexp_extract_all(lower({text_expr}), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {src}),
{prefix}_u AS (SELECT {k}, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS i FROM {prefix}_t),
{prefix}_tok AS (SELECT {k}, tok, i, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3
  FROM {prefix}_u WINDOW w AS (PARTITION BY {k} ORDER BY i)),
{prefix}_v AS (
  SELECT x.*, s.valence, s.polarity, s.subjectivity,
    coalesce(list_contains({NEGATION_SQL}, p1), false) OR coalesce(list_contains({NEGATION_SQL}, p2), false)
      OR coalesce(list_contains({NEGATION_SQL}, p3), false) AS negd,
    coalesce(list_contains({NEGATION_SQL}, p1), false) AS neg1,
    coalesce(b1.shift, 0.0) * {d1} + coalesce(b2.shift, 0.0) * {d2} + coalesce(b3.shift, 0.0) * {d3} AS boost
  FROM {prefix}_tok x LEFT JOIN fx_sentiment s ON s.token = x.tok
    LEFT JOIN fx_booster b1 ON b1.token = x.p1 LEFT JOIN fx_booster b2 ON b2.token = x.p2
    LEFT JOIN fx_booster b3 ON b3.token = x.p3),
{prefix}_w AS (
  SELECT {k}, tok,
    CASE WHEN valence IS NULL THEN 0.0::DOUBLE
         ELSE (valence + sign(valence) * boost) * (CASE WHEN negd THEN {NEGATION_SCALAR}::DOUBLE ELSE 1.0::DOUBLE END) END AS v,
    CASE WHEN neg1 THEN polarity * {POLARITY_NEGATION}::DOUBLE ELSE polarity END AS pol, subjectivity AS subj
  FROM {prefix}_v),
{prefix}_a AS (
  SELECT {k}, count(*) AS n_tokens, sum(v) AS s,
    sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pos_sum, sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) AS neg_sum,
    count(*) FILTER (WHERE v <> 0) AS n_nonzero, avg(pol) AS tb_polarity, avg(subj) AS tb_subjectivity
  FROM {prefix}_w GROUP BY {k}),
{prefix}_f AS (
  SELECT {kq}, coalesce(a.n_tokens, 0) AS n_tokens, coalesce(a.s, 0.0) AS s, coalesce(a.pos_sum, 0.0) AS pos_sum,
    abs(coalesce(a.neg_sum, 0.0)) AS neg_abs, (coalesce(a.n_tokens, 0) - coalesce(a.n_nonzero, 0))::DOUBLE AS neu,
    coalesce(a.tb_polarity, 0.0) AS tb_polarity, coalesce(a.tb_subjectivity, 0.0) AS tb_subjectivity
  FROM {src} q LEFT JOIN {prefix}_a a ON {on}),
{prefix} AS (
  SELECT {k}, n_tokens,
    CASE WHEN pos_sum + neg_abs + neu > 0 THEN neg_abs / (pos_sum + neg_abs + neu) ELSE 0.0 END AS vader_neg,
    CASE WHEN pos_sum + neg_abs + neu > 0 THEN neu / (pos_sum + neg_abs + neu) ELSE 0.0 END AS vader_neu,
    CASE WHEN pos_sum + neg_abs + neu > 0 THEN pos_sum / (pos_sum + neg_abs + neu) ELSE 0.0 END AS vader_pos,
    s / sqrt(s * s + {COMPOUND_ALPHA}) AS vader_compound, tb_polarity, tb_subjectivity,
    CASE WHEN s / sqrt(s * s + {COMPOUND_ALPHA}) >= {th} THEN 'POSITIVE'
         WHEN s / sqrt(s * s + {COMPOUND_ALPHA}) <= -{th} THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
    CASE WHEN abs(s / sqrt(s * s + {COMPOUND_ALPHA})) < {th} THEN 1.0 - abs(s / sqrt(s * s + {COMPOUND_ALPHA}))
         ELSE abs(s / sqrt(s * s + {COMPOUND_ALPHA})) END AS score
  FROM {prefix}_f)"""


def prepared_base(name: str = "base") -> str:
    """CTE ``base(id, text)``: reviews deduplicated on the stripped text (first id), then cleaned."""
    from revlens.plans.oracle_views import duck_clean
    st = strip(txt("review_text"))
    return f"""{name} AS (
  SELECT review_id AS id, {duck_clean('txt')} AS text, rating, verified_purchase, helpful_votes, total_votes
  FROM (SELECT *, {st} AS txt, row_number() OVER (PARTITION BY {st} ORDER BY review_id) AS rn FROM reviews) d
  WHERE rn = 1)"""


def absa_ctes(fallback: str = "") -> str:
    """``fallback``: CTEs that end in ``fb(candidate, aspect, aspect_ord)`` for strings without a seed.

    CTEs from ``base(id, text)`` to ``absa_long(id, aspect, aspect_ord, candidates,
    aspect_sentiment, aspect_confidence, n_units)``, plus ``cands`` and ``mapped``."""
    return f"""
cand_raw AS (SELECT id, unnest(cl) AS cand, unnest(generate_series(1, len(cl))) AS pos
             FROM (SELECT id, {candidates_list('text')} AS cl FROM base) t),
cand_first AS (SELECT id, cand, min(pos) AS p FROM cand_raw GROUP BY id, cand),
cands AS (SELECT id, cand AS candidate, CAST(row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS INTEGER) AS cand_pos
          FROM cand_first),
{fallback}
mapped AS (SELECT DISTINCT c.id, c.cand_pos, c.candidate, a.aspect, a.aspect_ord
           FROM cands c JOIN fx_aspects a ON contains(c.candidate, a.seed)
           {"UNION ALL SELECT c.id, c.cand_pos, c.candidate, f.aspect, f.aspect_ord FROM cands c JOIN fb f ON f.candidate = c.candidate" if fallback else ""}),
mapped_all AS (SELECT id, aspect, string_agg(candidate, '|' ORDER BY cand_pos) AS candidates FROM mapped GROUP BY id, aspect),
sents AS (SELECT id, unnest(sl) AS s, unnest(generate_series(1, len(sl))) AS s_idx
          FROM (SELECT id, {sentences_list('text')} AS sl FROM base) t),
hits AS (SELECT t.id, t.aspect, t.aspect_ord, t.cand_pos, s.s_idx
         FROM mapped t JOIN sents s ON t.id = s.id AND contains(lower(s.s), t.candidate)),
units AS (SELECT id, aspect, aspect_ord, cand_pos, s_idx FROM hits
          UNION ALL
          SELECT t.id, t.aspect, t.aspect_ord, t.cand_pos, 0 AS s_idx FROM mapped t
          WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.id = t.id AND h.aspect = t.aspect AND h.cand_pos = t.cand_pos)),
utext AS (SELECT u.id, u.s_idx, CASE WHEN u.s_idx = 0 THEN b.text ELSE s.s END AS stext
          FROM (SELECT DISTINCT id, s_idx FROM units) u JOIN base b ON b.id = u.id
          LEFT JOIN sents s ON s.id = u.id AND s.s_idx = u.s_idx),
{lexicon_ctes('us', 'utext', ['id', 's_idx'], txt('stext'))},
absa_long AS (
  SELECT u.id, u.aspect, u.aspect_ord, m.candidates,
    avg(CASE WHEN us.label LIKE '%NEG%' THEN -us.score WHEN us.label LIKE '%POS%' THEN us.score ELSE 0.0 END)
      AS aspect_sentiment,
    avg(us.score) AS aspect_confidence, count(*) AS n_units
  FROM units u JOIN us ON us.id = u.id AND us.s_idx = u.s_idx
  JOIN mapped_all m ON m.id = u.id AND m.aspect = u.aspect
  GROUP BY u.id, u.aspect, u.aspect_ord, m.candidates)"""


def feature_select(b: str = "b", sc: str = "sc") -> str:
    """SELECT list of the F12 feature table over base alias ``b`` and scores alias ``sc``."""
    t = f"{b}.text"
    fk, fog = readability(t)
    num = f"TRY_CAST(trim({b}.rating) AS DOUBLE)"
    sign = (f"CASE WHEN {sc}.label LIKE '%NEG%' THEN -1.0 WHEN {sc}.label LIKE '%POS%' THEN 1.0 ELSE 0.0 END")
    return f"""
  {char_count(t)}::DOUBLE AS char_count, {word_count(t)}::DOUBLE AS word_count,
  {sentence_count(t)}::DOUBLE AS sentence_count, round({ttr(t)}, 6) AS type_token_ratio,
  round({fk}, 6) AS flesch_kincaid_grade, round({fog}, 6) AS gunning_fog,
  round({sc}.vader_neg, 6) AS vader_neg, round({sc}.vader_neu, 6) AS vader_neu, round({sc}.vader_pos, 6) AS vader_pos,
  round({sc}.vader_compound, 6) AS vader_compound, round({sc}.tb_polarity, 6) AS tb_polarity,
  round({sc}.tb_subjectivity, 6) AS tb_subjectivity,
  {entity_count(t)}::DOUBLE AS ner_count, {number_tokens(t)}::DOUBLE AS num_token_count,
  round(CASE WHEN coalesce({b}.total_votes, 0) <> 0 THEN coalesce({b}.helpful_votes, 0) / {b}.total_votes ELSE 0.0 END, 6)
    AS helpful_ratio,
  CASE WHEN lower(trim({b}.verified_purchase)) IN ('true', 'yes', '1') THEN 1.0 ELSE 0.0 END::DOUBLE AS verified_purchase,
  coalesce({num}, 0.0) AS rating,
  round(CASE WHEN {num} IS NULL THEN 0.0 ELSE abs(({num} - 3.0) / 2.0 - {sign}) END, 6) AS rating_sentiment_discordance,
  round({sc}.score, 6) AS sentiment_confidence"""
