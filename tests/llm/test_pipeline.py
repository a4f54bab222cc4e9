"""The pipeline's stages on documents with odd rows, each against its own input."""

import corpus_pipeline as P
from revlens.llm import mixing
from revlens.llm.common import cut
from revlens.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm.test_operators import brute_groups


def test_stages(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_000, "", "en", None, 0), (10_001, "x " * 20_000, "en", "src1", 40_000)], docs.schema)
    kept = docs.unionAll(odd)
    for name, stage in P.STAGES[:4]:
        before = kept.collect()
        kept = spark.createDataFrame(stage(spark, kept, SF_SMALL).collect(), docs.schema)
        assert kept.columns == docs.columns
        after = {r["doc_id"] for r in kept.collect()}
        if name in ("line_dedup", "mix_sources"):
            assert kept.count() == len(before)
        if name == "near_copies":
            groups = brute_groups([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], 5, 80, 100)
            assert after - {None} == {i for i, (_, c) in groups.items() if c == i}
        assert {None, 10_000, 10_001} <= after
    last = P.to_tokens(spark, kept, SF_SMALL).collect()
    assert len(last) == kept.count() and all(r["round_trip"] for r in last)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    kept = {r["doc_id"] for r in P.drop_toxic(spark, read_table(spark, sf, "documents"), sf).collect()}
    labels = read_table(spark, sf, "labels").collect()
    toxic, clean = [r["doc_id"] for r in labels if r["toxic"]], [r["doc_id"] for r in labels if not r["toxic"]]
    assert sum(i in kept for i in toxic) <= 0.05 * len(toxic) and sum(i in kept for i in clean) >= 0.99 * len(clean)


def test_mix_outlives_the_reread(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_000, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionAll(odd).repartition(7)
    mixed = cut(P.mix_sources(spark, docs, SF_SMALL).repartition(5), "test-mix")
    last = cut(P.to_tokens(spark, mixed, SF_SMALL), "test-tokens").repartition(3)
    stream = [r["doc_id"] for r in last.orderBy("mix_slot", "mix_place").collect()]
    assert stream == [r["doc_id"] for r in mixing.mix(docs).orderBy("mix_slot", "mix_place").collect()]
    assert last.select("mix_slot", "mix_place").distinct().count() == docs.count() == len(stream)


def test_stages_on_empty_tables(spark, tmp_path):
    docs, labels = read_table(spark, SF_SMALL, "documents"), read_table(spark, SF_SMALL, "labels")
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    few = docs.where("doc_id < 30")
    assert P.drop_toxic(spark, few, str(tmp_path)).count() == few.count()            # nothing is known to be toxic
    none = docs.limit(0)
    for _, stage in P.STAGES[:4]:
        left = stage(spark, none, SF_SMALL)
        assert left.columns == docs.columns and left.count() == 0
    assert P.to_tokens(spark, none, SF_SMALL).count() == 0


CLASHES = ["n_removed", "llm_removed", "llm_gone", "line", "site", "rejected", "score", "component_id", "n_shingles", "mix_slot", "mix_place", "src", "h", "n", "ids"]


def test_columns_of_clashing_names_pass_unchanged(spark):
    docs = read_table(spark, SF_SMALL, "documents").where("doc_id < 60")
    more = docs.select("*", *((docs.doc_id * 100 + k).alias(c) for k, c in enumerate(CLASHES)))
    for name, stage in P.STAGES[:4]:
        kept = stage(spark, more, SF_SMALL)
        assert kept.columns == more.columns, name
        plain = {r["doc_id"]: r["text"] for r in stage(spark, docs, SF_SMALL).collect()}
        for r in kept.collect():
            assert plain.pop(r["doc_id"]) == r["text"] and [r[c] for c in CLASHES] == [r["doc_id"] * 100 + k for k in range(len(CLASHES))], name
        assert not plain
    assert P.to_tokens(spark, more, SF_SMALL).count() == docs.count()
