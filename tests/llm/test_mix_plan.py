"""The pipeline's mix reaches the tokens: they follow the plan of the stage before."""

import corpus_pipeline as P
from revlens.llm import mixing
from revlens.llm.common import cut
from revlens.sources.tables import read_table
from tests.conftest import SF_SMALL


def stream(tokens):
    return {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in tokens.collect()}


def test_tokens_follow_the_plan_of_the_mix(spark):
    docs = read_table(spark, SF_SMALL, "documents").where("doc_id < 120")
    unmixed = stream(P.to_tokens(spark, docs, SF_SMALL))
    assert len(unmixed) == docs.count() and set(unmixed.values()) == {(None, None)}
    plan = mixing.mix_plan(docs, weights={docs.orderBy("doc_id").first()["source"]: 1.0})
    for made, want in ((P.mix_sources(spark, docs, SF_SMALL), mixing.mix(docs)), (P.with_plan(docs, plan), mixing.mix(docs, plan=plan))):
        assert made.columns == docs.columns
        assert stream(P.to_tokens(spark, cut(made, "test-plan"), SF_SMALL)) == stream(want)
    assert stream(mixing.mix(docs, plan=plan)) != stream(mixing.mix(docs))


def test_a_plan_places_as_the_mix_itself(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"s{i % 3}", "x") for i in range(400)], "doc_id long, source string, text string")
    own, planned = mixing.mix(docs), mixing.mix(docs, plan=mixing.mix_plan(docs))
    assert sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, planned.collect()), key=str)
