"""Cases for nulls, ragged files and the uncapped aspect scoring."""

import pytest

from revlens.functions import text as T
from revlens.operators import absa as A
from revlens.operators import metrics as M
from revlens.operators import models as ML
from revlens.operators.lexicon import ModelScorer
from revlens.sources.readers import read_reviews


def test_confusion_matrix_counts_null_cells(spark):
    df = spark.createDataFrame([(0, None), (0, None), (None, 1), (1, 1)], "y_true int, y_pred int")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert got[0, None] == 2 and got[None, 1] == 1 and got[1, 1] == 1 and sum(got.values()) == 4


def test_stratified_split_keeps_null_labels(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else k % 2) for k in range(40)], "id long, y int")
    got = ML.stratified_split(df, "id", "y", 0.25).collect()
    assert len(got) == 40 and sum(r["is_test"] for r in got if r["y"] is None) == 2 + (10 * 0.25 + 0.5 >= 3)


def test_model_scorer_takes_null_text(spark):
    df = spark.createDataFrame([(k, "good fine" if k % 2 else "bad poor", k % 2) for k in range(20)], "id long, review_text string, y int")
    model = ML.tfidf_classifier(df, "y", "review_text", kind="logreg")
    odd = spark.createDataFrame([(1, None), (2, "good"), (3, "")], "id long, review_text string")
    assert ModelScorer(model).score(odd, ["id"], "review_text").count() == 3


def test_every_candidate_and_sentence_is_scored(spark):
    class Ones:
        def score(self, df, keys, text, carry_cols=()):
            from pyspark.sql import functions as F
            return df.select(*keys, *carry_cols, F.lit("POSITIVE").alias("label"), F.lit(1.0).alias("score"))

    texts = spark.createDataFrame([(1, "Price one here. Price two here. Price three here.")], "review_id long, review_text string")
    mapped = spark.createDataFrame([(1, k, c, "cost", 0) for k, c in enumerate(["price one", "price two", "price three", "price"])],
                                   "review_id long, cand_pos int, candidate string, aspect string, aspect_ord int")
    assert A.aspect_sentiment(mapped, texts, Ones()).first()["n_units"] == 6
    assert A.aspect_sentiment(mapped, texts, Ones(), max_cands=3).first()["n_units"] == 3


@pytest.mark.parametrize("sep", [",", "\t"])
def test_ragged_and_quoted_rows(spark, tmp_path, sep):
    lines = [sep.join(r) for r in (["review_id", "review_text", "rating"], ["1", f'"hello{sep}world"', "5"], ["2", "short row"], ["3", "long", "1", "x", "y"], ["4", "plain", "3"])]
    path = tmp_path / "reviews.csv"
    path.write_text("\n".join(lines) + "\n")
    got = {r["review_id"]: (r["review_text"], r["rating"]) for r in read_reviews(spark, str(path), sep).collect()}
    assert {int(k) for k in got} == {1, 2, 4}
    assert {str(k): v[0] for k, v in got.items()} == {"1": f"hello{sep}world", "2": "short row", "4": "plain"}
