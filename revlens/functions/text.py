"""Per-row text functions as Catalyst column expressions.

Everything here stays inside whole-stage codegen: regexes, array higher-order
functions, no Python.  Regex classes are written out explicitly so that they mean
the same in Java (Spark) and RE2 (the DuckDB oracle): ``WS`` is Python's
``str.isspace`` set.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.sources.lexicons import NUMBER_WORDS

# Python's str.isspace() characters, spelled out so Java and RE2 agree.
WS = r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same characters for Spark's own patterns: a property and one range, which Java tests at
# a twentieth of the cost of the spelled-out set.
SPACE = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
# Patterns of the text cleaner.
HTML_TAG = r"<[^>]+>"
CONTROL = r"[\x{00}-\x{1F}\x{7F}]"
URL = r"https?://[^" + WS + r"]+|www\.[^" + WS + r"]+"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
WORD_CHARS = r"\p{L}\p{N}_"
SENTENCE = r"[^.!?]+[.!?]*"
VOWELS = "aeiouy"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``).

    Catalyst may inline a projected column back into a lambda that references it,
    re-evaluating it per element; binding it as a lambda variable prevents that."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_text(col) -> Column:
    """Non-string / null -> empty string."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"^[{SPACE}]+|[{SPACE}]+$", "")


def basic_clean(col) -> Column:
    """tags -> space, control chars -> space, URLs -> ' [URL] ', emoji runs
    padded, whitespace collapsed, stripped; null -> ''."""
    t = as_text(col)
    t = F.regexp_replace(t, HTML_TAG, " ")
    t = F.regexp_replace(t, CONTROL, " ")
    t = F.regexp_replace(t, URL.replace(WS, SPACE), " [URL] ")
    t = F.regexp_replace(t, EMOJI, " $0 ")
    t = F.regexp_replace(t, f"[{SPACE}]+", " ")
    return F.trim(t)


def char_count(col) -> Column:
    return F.length(as_text(col)).cast("bigint")


def word_count(col) -> Column:
    """Python ``len(text.split())``."""
    return F.regexp_count(as_text(col), F.lit(f"[^{SPACE}]+")).cast("bigint")


def sentence_count(col) -> Column:
    """max(1, number of '.', '!', '?')."""
    return F.greatest(F.lit(1), F.regexp_count(as_text(col), F.lit("[.!?]"))).cast("bigint")


def ws_tokens(col) -> Column:
    """Whitespace tokens (may contain empty strings at the edges; callers filter)."""
    return F.split(as_text(col), f"[{SPACE}]+", -1)


def type_token_ratio(col) -> Column:
    """distinct / total of lower-cased alphabetic whitespace tokens; 0 if none.
    The alphabetic tokens are extracted by one regex over the text (no per-token lambda)."""
    toks = F.regexp_extract_all(F.lower(as_text(col)), F.lit(f"(?<![^{SPACE}])" + r"\p{L}++" + f"(?![^{SPACE}])"), 0)
    return let(toks, lambda t: F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(F.lit(0.0)))


def letter_words(col) -> Column:
    return F.regexp_extract_all(F.lower(as_text(col)), F.lit(r"\p{L}+"), 0)


def readability(col) -> Column:
    """F4 (published formulas, vowel-group syllables): struct(flesch_kincaid_grade, gunning_fog).

    words = runs of letters; sentences = max(1, count of [.!?]); syllables of a
    word = max(1, vowel groups); complex word = at least three vowel groups.
    """
    t = F.lower(as_text(col))
    cons = f"[\\p{{L}}&&[^{VOWELS}]]"
    w = F.regexp_count(t, F.lit(r"\p{L}+")).cast("double")
    s = F.greatest(F.lit(1), F.regexp_count(t, F.lit("[.!?]"))).cast("double")
    groups = F.regexp_count(t, F.lit(f"[{VOWELS}]+")).cast("double")
    # one match a word, begun at its first vowel: words with a vowel, and words with at least
    # three vowel groups (possessive quantifiers keep a vowel run in one group)
    no_vowel = w - F.regexp_count(t, F.lit(f"[{VOWELS}]" + r"\p{L}*+")).cast("double")
    syl = groups + no_vowel
    complex_w = F.regexp_count(t, F.lit(f"(?:[{VOWELS}]++{cons}++){{2}}[{VOWELS}]" + r"\p{L}*+")).cast("double")
    fk = F.when(w > 0, 0.39 * (w / s) + 11.8 * (syl / w) - 15.59).otherwise(F.lit(0.0))
    fog = F.when(w > 0, 0.4 * ((w / s) + 100.0 * (complex_w / w))).otherwise(F.lit(0.0))
    return F.struct(fk.alias("flesch_kincaid_grade"), fog.alias("gunning_fog"))


def entity_count(col) -> Column:
    """runs of capitalised words that do not start a sentence.  Repeated groups are possessive:
    Java walks them in a loop, where others take a stack frame for each word of a run."""
    t = as_text(col)
    no_initial = F.regexp_replace(t, f"(^|[.!?][{SPACE}]*)" + r"\p{Lu}\p{L}*", "$1")
    return F.regexp_count(no_initial, F.lit(r"(^|[^\p{L}])\p{Lu}\p{L}*([" + SPACE + r"]+\p{Lu}\p{L}*)*+")).cast("bigint")


def number_tokens(col) -> Column:
    """F8: tokens that are numerals (1, 3.5, 1,000, 1/2) or cardinal number words."""
    toks = F.regexp_extract_all(F.lower(as_text(col)), F.lit(r"[\p{L}\p{N}]+([.,/][0-9]+)*+"), 0)
    # only tokens that begin with a digit are held against the pattern
    numeral = lambda x: (x >= "0") & (x < ":") & x.rlike(r"^[0-9]+([.,/][0-9]+)*+$")
    return F.size(F.filter(toks, lambda x: numeral(x) | x.isin(*NUMBER_WORDS))).cast("bigint")


def to_flag(col) -> Column:
    """true/yes/1 -> 1; false/no/0 and anything else -> 0."""
    s = F.lower(F.trim(_c(col).cast("string")))
    return F.when(s.isin("true", "yes", "1"), F.lit(1)).otherwise(F.lit(0))


def to_number(col) -> Column:
    """Pandas to_numeric(errors='coerce') -> double or null."""
    return _c(col).try_cast("double")


def proxy_label(rating_col: str = "rating") -> Column:
    """1 if rating >= 4; missing / non-numeric -> 0."""
    return F.coalesce((to_number(rating_col) >= 4).cast("int"), F.lit(0))


def helpful_ratio(helpful_col: str = "helpful_votes", total_col: str = "total_votes") -> Column:
    """helpful / total, 0 when total is 0 or missing."""
    h = F.coalesce(to_number(helpful_col), F.lit(0.0))
    t = F.coalesce(to_number(total_col), F.lit(0.0))
    return F.when(t != 0, h / t).otherwise(F.lit(0.0))


def normalize_label(col) -> Column:
    """trim + upper; null -> NEUTRAL."""
    return F.coalesce(F.upper(F.trim(_c(col).cast("string"))), F.lit("NEUTRAL"))


def signed_score(label_col, prob_col) -> Column:
    """F16: NEG or '0' -> -p; POS or '1' -> +p; else 0."""
    lab = F.upper(F.coalesce(_c(label_col).cast("string"), F.lit("")))
    p = F.coalesce(_c(prob_col).cast("double"), F.lit(0.5))
    return (F.when(lab.contains("NEG") | (lab == "0"), -p)
            .when(lab.contains("POS") | (lab == "1"), p)
            .otherwise(F.lit(0.0)))


def sentences(col) -> Column:
    """F14 helper: stripped sentences of a text (may be empty strings removed)."""
    parts = F.regexp_extract_all(as_text(col), F.lit(SENTENCE), 0)
    return F.filter(F.transform(parts, lambda s: strip_ws(s)), lambda s: F.length(s) > 0)


def sentences_with(text_col, cand_col) -> Column:
    """sentences containing the candidate (case-insensitive); [text] if none."""
    hit = F.filter(sentences(text_col), lambda s: F.lower(s).contains(_c(cand_col)))
    return let(hit, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(as_text(text_col))))


def one_of(words) -> str:
    """Pattern of any of the words; words that begin alike share that part, longest first."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(t: dict) -> str:
        more = [re.escape(c) + pattern(x) for c, x in sorted(t.items()) if c]
        return "" if not more else "(?:" + "|".join(more) + ")" + ("?" if "" in t else "")
    return pattern(tree)


def stop_delimited(col, stop_words: list[str]) -> Column:
    """Lower-cased text with punctuation and stop words replaced by '|', single spaces."""
    t = F.regexp_replace(F.lower(as_text(col)), r"[^\p{L}\p{N} '-]+", " | ")
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, f"(?<= ){one_of(stop_words)}(?= )", "|") if stop_words else t
    return F.regexp_replace(t, " {2,}", " ")


def mine_candidates(col, stop_words: list[str], min_len: int = 2, max_len: int = 40) -> Column:
    """F13 (stop-word delimited phrases, RAKE-style): array of candidates in text order,
    2-40 characters, first occurrence kept."""
    parts = F.transform(F.split(stop_delimited(col, stop_words), r"\|", -1), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= min_len) & (F.length(p) <= max_len)))


def word_tokens(col) -> Column:
    """Lower-cased word tokens for lexicon lookups."""
    return F.regexp_extract_all(F.lower(as_text(col)), F.lit(f"[{WORD_CHARS}]+"), 0)
