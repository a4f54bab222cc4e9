"""Hand-worked cases (FIXTURES.md section 5) on tiny literal frames."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import absa as A
from revlens.operators import business as B
from revlens.operators import metrics as M
from revlens.operators import stats as S
from revlens.operators.lexicon import LexiconScorer
from revlens.sources import readers as RD
from revlens.sources.lexicons import DEFAULT_ASPECTS, FX_STOP


def one(df):
    return df.collect()[0]


def test_clean_docstring_example(spark):
    df = spark.createDataFrame([("Great!! <br> http://x.com",), (None,)], "t string")
    out = [r[0] for r in df.select(T.basic_clean("t")).collect()]
    assert out == ["Great!! [URL]", ""]


def test_clean_emoji_and_controls(spark):
    df = spark.createDataFrame([("ok\u0001\U0001F600\U0001F600done  \n x",)], "t string")
    assert one(df.select(T.basic_clean("t")))[0] == "ok \U0001F600\U0001F600 done x"


def test_aspects_docstring_example(spark):
    df = spark.createDataFrame([(1, "The price is great but shipping was slow.")], "review_id long, review_text string")
    scorer = LexiconScorer.fixture(spark)
    long = A.absa_extract(df, DEFAULT_ASPECTS, FX_STOP + ["but"], scorer)
    assert sorted(r["aspect"] for r in long.collect()) == ["price", "shipping"]


def test_substring_seed_quirk(spark):
    df = spark.createDataFrame([(1, "A plastic handle.")], "review_id long, review_text string")
    long = A.absa_extract(df, DEFAULT_ASPECTS, FX_STOP, LexiconScorer.fixture(spark))
    assert [r["aspect"] for r in long.collect()] == ["durability"]   # "last" is inside "plastic"


def test_csv_quoting_off_pads_and_drops(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    p = os.path.join(d, "r.csv")
    with open(p, "w") as f:
        f.write("text,stars,asin\nshort,5\nfull,4,B1\ntoo,many,fields,here\n")
    rows = sorted(RD.read_reviews(spark, p).collect(), key=lambda r: r["review_text"])
    assert [(r["review_text"], r["rating"], r["product_id"]) for r in rows] == [("full", "4", "B1"), ("short", "5", None)]


def test_na_tokens_and_blank_text(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    p = os.path.join(d, "r.csv")
    with open(p, "w") as f:
        f.write('review,rating\nNA,1\nNone,2\n,3\n"  ",4\nok,5\n')
    rows = sorted((r["review_text"], r["rating"]) for r in RD.read_reviews(spark, p, sep=",").collect())
    assert rows == [("", "4"), ("ok", "5")]


def test_two_sources_for_one_target(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("c", "d")], "`Parent_ASIN` string, asin string")
    assert [r[0] for r in RD.normalize_columns(df).collect()] == ["a", "b", "c"]


def test_ece_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.3)], "y_true int, p_a double")
    # p = 1.0 falls in no bin; p = 0.3 sits in [0.2, 0.30000000000000004): weight 1/2 * |0 - 0.3|
    assert one(M.ece_binary(df))[0] == pytest.approx(0.15)


def test_mcnemar_equal_counts(spark):
    rows = [(1, 1, 0)] * 4 + [(1, 0, 1)] * 4
    df = spark.createDataFrame(rows, "y_true int, pred_a int, pred_b int")
    assert one(S.mcnemar(df))["chi2"] == pytest.approx(1 / 8)
    same = spark.createDataFrame([(1, 1, 1)], "y_true int, pred_a int, pred_b int")
    assert one(S.mcnemar(same))["chi2"] == 1.0
    assert S.mcnemar_test(df)["p_value"] == pytest.approx(math.erfc(math.sqrt(1 / 16)))


def test_length_bins_all_equal_is_empty(spark):
    df = spark.createDataFrame([("aaa", 1, 1)] * 5, "review_text string, y_true int, y_pred int")
    assert M.accuracy_by_length(df, "y_true", "y_pred").count() == 0


def test_histogram_all_equal(spark):
    df = spark.createDataFrame([(0.5,)] * 4, "sentiment_confidence double")
    h = B.confidence_histogram(df).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["n"] for r in h) == 4
    assert h[0]["left"] == pytest.approx(0.4995)


def test_revenue_impact_no_aspects(spark):
    empty = spark.createDataFrame([], "review_id long, aspect string, aspect_sentiment double, aspect_confidence double")
    reviews = spark.createDataFrame([(1,)], "review_id long")
    assert B.revenue_impact(empty, reviews).count() == 0


def test_auc_all_tied(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y_true int, p_a double")
    assert one(M.roc_auc(df))[0] == pytest.approx(0.5)


def test_average_precision_ties_grouped(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.1)], "y_true int, p_a double")
    # thresholds 0.9 (P = 1/2, R = 1/2) and 0.1 (P = 2/3, R = 1): 0.5*0.5 + 0.5*2/3
    assert one(M.average_precision(df))[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_friedman_p_value_df2(spark):
    rows = [(f, m, float(s)) for f, vals in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3), (2, 1, 3)])
            for m, s in zip("abc", vals)]
    df = spark.createDataFrame(rows, "fold int, model string, score double")
    r = S.friedman_test(df)
    assert r["p_value"] == pytest.approx(math.exp(-r["statistic"] / 2), rel=1e-9)


def test_string_false_is_not_verified(spark):
    df = spark.createDataFrame([("False",), ("True",), ("yes",), ("0",), (None,)], "v string")
    assert [r[0] for r in df.select(T.to_flag("v")).collect()] == [0, 1, 1, 0, 0]


def test_non_numeric_rating(spark):
    df = spark.createDataFrame([("n/a",), ("4",), (None,)], "rating string")
    assert [r[0] for r in df.select(T.proxy_label("rating")).collect()] == [0, 1, 0]


def test_whole_word_seed_option(spark):
    df = spark.createDataFrame([(1, "A plastic handle.")], "review_id long, review_text string")
    long = A.absa_extract(df, DEFAULT_ASPECTS, FX_STOP, LexiconScorer.fixture(spark), whole_word=True)
    assert long.count() == 0


def test_ece_include_right(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.3)], "y_true int, p_a double")
    # with the last bin closed, p = 1.0 counts (|1 - 1| = 0) and p = 0.3 still adds 1/2 * 0.3
    assert one(M.ece_binary(df, include_right=True))[0] == pytest.approx(0.15)


def test_describe_approximate_mode(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "sentiment_confidence double")
    ex, ap = one(B.confidence_describe(df)), one(B.confidence_describe(df, exact=False))
    assert ex["p50"] == 50.0 and ap["p50"] == pytest.approx(50.0, abs=1.0)


def test_pandas_scorer_adapter(spark):
    from revlens.operators.lexicon import PandasScorer, predict_sentiment

    def load():
        return lambda texts: (["POSITIVE" if "good" in t else "NEGATIVE" for t in texts], [0.9] * len(texts))

    df = spark.createDataFrame([(1, "good stuff"), (2, "bad"), (3, None)], "review_id long, review_text string")
    out = sorted(predict_sentiment(df, PandasScorer(load)).collect())
    assert [(r[0], r[1]) for r in out] == [(1, "POSITIVE"), (2, "NEGATIVE"), (3, "NEGATIVE")]
