"""Lexicon tables: aspect seeds, sentiment lexicon, negation/booster/stop lists.

Lexicons are arguments of every operator that uses them.  The defaults below are
fixed values; the fixture lexicons match the invented words of the test corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values (must stay as given for matching results).
# Default aspect inventory: aspect -> seed substrings.
DEFAULT_ASPECTS: dict[str, list[str]] = {
    "quality": ["quality", "build", "material", "defect", "broken", "damage", "craftsmanship"],
    "price": ["price", "cost", "value", "worth", "expensive", "cheap", "deal"],
    "shipping": ["shipping", "delivery", "arrived", "packaging", "box", "late", "carrier"],
    "durability": ["durable", "durability", "last", "sturdy", "wear", "tear"],
    "design": ["design", "look", "style", "color", "size", "fit", "appearance"],
    "customer_service": ["service", "support", "customer", "refund", "return", "replacement"],
}

# Fixture lexicons for the test corpus (FIXTURES.md §4).
FX_ASPECTS: dict[str, list[str]] = {
    "quality": ["worth", "hable"],
    "price": ["deal"],
    "shipping": ["anth"],
    "durability": ["tear", "last"],
    "design": ["ention"],
    "customer_service": ["seser"],
}
# token -> (valence, polarity, subjectivity)
FX_SENTIMENT: dict[str, tuple[float, float, float]] = {
    "idiot": (-3.0, -0.8, 1.0),
    "worthless": (-2.5, -0.9, 0.9),
    "moron": (-3.0, -0.8, 1.0),
    "clown": (-1.5, -0.4, 0.7),
    "stupid": (-2.4, -0.8, 1.0),
    "ention": (1.6, 0.5, 0.6),
    "hable": (2.0, 0.6, 0.5),
    "anth": (0.9, 0.3, 0.4),
}
FX_NEGATION: list[str] = ["was", "from"]
FX_BOOSTER: dict[str, float] = {"that": 0.293, "this": -0.293}
FX_STOP: list[str] = [
    "the", "of", "de", "and", "to", "in", "la", "a", "der", "is", "that", "en", "it", "for", "was",
    "on", "die", "with", "que", "le", "be", "as", "des", "und", "by", "this", "et", "are", "at", "from",
]

# English cardinal number words counted as number tokens.
NUMBER_WORDS: list[str] = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion", "trillion",
]
# Lexicon-scorer constants (Hutto & Gilbert 2014).
NEGATION_SCALAR = -0.74
BOOSTER_DAMPING = (1.0, 0.95, 0.9)   # booster one, two, three tokens before the word
COMPOUND_ALPHA = 15.0
POSITIVE_THRESHOLD = 0.05
POLARITY_NEGATION = -0.5
# ---------------------------------------------------------------------------


def aspects_df(spark: SparkSession, aspects: dict[str, list[str]] = FX_ASPECTS) -> DataFrame:
    """Long lexicon table (aspect, seed, aspect_ord, seed_ord)."""
    rows = [(a, s, ai, si) for ai, (a, seeds) in enumerate(aspects.items()) for si, s in enumerate(seeds)]
    return spark.createDataFrame(rows, "aspect string, seed string, aspect_ord int, seed_ord int")


def sentiment_df(spark: SparkSession, lexicon: dict[str, tuple[float, float, float]] = FX_SENTIMENT) -> DataFrame:
    rows = [(t, float(v), float(p), float(s)) for t, (v, p, s) in lexicon.items()]
    return spark.createDataFrame(rows, "token string, valence double, polarity double, subjectivity double")


def lexicon_sql(name: str) -> str:
    """DuckDB VALUES text of a fixture lexicon (used by the SQL oracles)."""
    if name == "fx_aspects":
        vals = ", ".join(f"('{a}', '{s}', {ai}, {si})" for ai, (a, ss) in enumerate(FX_ASPECTS.items())
                         for si, s in enumerate(ss))
        return f"SELECT * FROM (VALUES {vals}) t(aspect, seed, aspect_ord, seed_ord)"
    if name == "fx_sentiment":
        vals = ", ".join(f"('{t}', CAST({v} AS DOUBLE), CAST({p} AS DOUBLE), CAST({s} AS DOUBLE))"
                         for t, (v, p, s) in FX_SENTIMENT.items())
        return f"SELECT * FROM (VALUES {vals}) t(token, valence, polarity, subjectivity)"
    raise KeyError(name)
