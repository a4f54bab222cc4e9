"""The ``opN_*`` queries: each applies one operator with its production parameters to the
whole table it is made for.  ``QUERIES`` and ``ORACLES`` are read by the entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import bpe, html_extract, language, licenses, line_dedup, mixing, multi_index, ngram_join, phrases, ranked_search, simhash, toxicity, url_filter
from revlens.llm.common import cut
from revlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(mixing.oracle())
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query()
def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query()
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(read_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


@query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    known = language.train(docs.where(~F.col("held_out")))
    found = docs.select("doc_id", "held_out", language.identify(docs, known).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), F.col("x.rejected").alias("rejected"))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.select("doc_id", toxicity.predict(docs, model).alias("x")).select("doc_id", "x.*")


def _edited(ids, texts, nexts) -> dict[str, list]:
    import hashlib
    known: dict[str, str] = {}

    def mark(t: str) -> str:
        if t not in known:
            known[t] = simhash.fingerprint(t).hex()
        return known[t]

    out = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")}
    for i, text, after in zip(ids, texts, nexts):
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        for k, v in zip(out, (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark(text), simhash.fingerprint(edited).hex(), mark(after))):
            out[k].append(v)
    return out


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = simhash.with_next(docs, _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    marked = simhash.with_groups(cut(marked, "simhash-marks"))
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "group_id",
                         simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                         simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


@query(licenses.oracle())
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(line_dedup.oracle())
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_removed")


@query(ranked_search.oracle())
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# The entries of the contract.
URL_RULES = url_filter.parse(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])


@query(url_filter.oracle(URL_RULES))
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query(phrases.oracle())
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))
