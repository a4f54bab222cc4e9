"""Squared-hinge machine against a dense solver, and its place in the text classifier."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from revlens.operators import models as ML
from revlens.operators.squared_hinge import minimise, sparse_rows, squared_hinge_svm


def dense_optimum(x, y, c):
    """Newton's method on the full matrix with exact solves."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def value(u):
        return 0.5 * u @ u + c * (np.maximum(0, 1 - y * (x @ u)) ** 2).sum()
    for _ in range(200):
        z = 1 - y * (x @ w)
        act = z > 0
        g = w - 2 * c * x[act].T @ (y[act] * z[act])
        if np.linalg.norm(g) < 1e-10:
            break
        step, t = -np.linalg.solve(np.eye(len(w)) + 2 * c * x[act].T @ x[act], g), 1.0
        while value(w + t * step) > value(w) + 1e-4 * t * g @ step and t > 1e-12:
            t /= 2
        w = w + t * step
    return w, value(w)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20)) * (rng.random((300, 20)) < 0.3)
    y = np.where(x @ rng.normal(size=20) + rng.normal(size=300) * 0.7 + 0.3 > 0, 1.0, -1.0)
    return x, y


def frame(spark, x, y):
    rows = [(int(t > 0), Vectors.dense(r) if k % 3 else Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)])) for k, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["label", "features"]).repartition(7)


@pytest.mark.parametrize("c", [0.05, 1.0, 20.0])
def test_objective_of_a_dense_solver(spark, table, c):
    x, y = table
    best, lowest = dense_optimum(x, y, c)
    w, value = minimise(sparse_rows(frame(spark, x, y), "features", "label").cache(), 20, c)
    assert lowest - 1e-9 <= value <= lowest * (1 + 1e-4)
    assert np.abs(w - best).max() < 0.02 * max(1.0, np.abs(best).max())


def test_model_scores_and_odd_rows(spark, table):
    x, y = table
    df = frame(spark, x, y)
    odd = df.unionAll(spark.createDataFrame([(None, Vectors.dense([9.0] * 20))], df.schema))
    model = squared_hinge_svm(odd, "features", "label")
    best, _ = dense_optimum(x, y, 1.0)
    assert np.abs(model.coefficients.toArray() - best[:20]).max() < 0.02 and abs(model.intercept - best[20]) < 0.02
    right = model.transform(df).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.8
    one = squared_hinge_svm(df.where("label = 1"), "features", "label")
    assert one.transform(df).where("prediction = 0").count() < df.count() and one.intercept > 0
    none = squared_hinge_svm(df.limit(0), "features", "label")
    assert none.coefficients.size == 0 and none.intercept == 0.0


def test_text_classifier_of_three_classes(spark):
    words = {0: "red apple sweet", 1: "blue river cold", 2: "green field wide"}
    rows = [(k, f"{words[k % 3]} common word {k % 5}", k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, review_text string, label int")
    model = ML.tfidf_classifier(df, "label", kind="svm")
    assert model.transform(df).where("prediction = label").count() == 60
