"""The model against a direct solution, and its helpers."""

import random

import numpy as np

from rollbook.plans import model


def sample(spark, n=300):
    rng = random.Random(1)
    data = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i, a, b, int(a - 0.5 * b + rng.gauss(0, 1) > 0)))
    return data, spark.createDataFrame(data, "id int, a double, b double, y int")


def newton(data, steps=25):
    """Ridge logistic regression, unit strength, free intercept."""
    x = np.array([[1.0, r[1], r[2]] for r in data])
    y, w, ridge = np.array([r[3] for r in data]), np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def test_coefficients_match_direct_solution(spark):
    data, df = sample(spark)
    fitted = model.fit_logistic(df, ["a", "b"], "y")
    got = [fitted.intercept, *fitted.coefficients]
    assert np.allclose(got, newton(data), atol=1e-8)


def test_split_does_not_depend_on_partitioning(spark):
    _, df = sample(spark)
    ids = lambda frame: sorted(r["id"] for r in model.split(frame, "id")[1].collect())
    assert ids(df) == ids(df.repartition(7)) and 30 < len(ids(df)) < 90
    train, test = model.split(df, "id")
    assert train.count() + test.count() == 300


def test_predictions_keep_their_rows(spark):
    _, df = sample(spark)
    out = model.predict(model.fit_logistic(df, ["a", "b"], "y"), df, ["a", "b"])
    assert out.columns == ["id", "a", "b", "y", "prediction"] and out.count() == 300
    assert float(model.accuracy(out, "y", "prediction").first()[0]) > 0.7


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (2, 1)], "y int, p int")
    got = {r["class"]: tuple(float(x) for x in tuple(r)[1:]) for r in model.classification_report(df, "y", "p").collect()}
    assert got == {1: (0.5, 1.0, 0.6667, 2.0), 0: (0.0, 0.0, 0.0, 1.0), 2: (0.0, 0.0, 0.0, 1.0)}


def test_summary_of_a_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (2, 1), (0, 3)], "y int, p int")
    got = {r["row"]: tuple(r)[1:] for r in model.report_summary(df, "y", "p").collect()}
    assert got == {"accuracy": (None, None, 0.4, 5), "macro avg": (0.125, 0.25, 0.1667, 5), "weighted avg": (0.2, 0.4, 0.2667, 5)}
    assert {tuple(r)[1:] for r in model.report_summary(df.limit(0), "y", "p").collect()} == {(None, None, 0.0, None), (None, None, None, None), (0.0, 0.0, 0.0, None)}


def test_cross_validation_scores_every_fold(spark):
    _, df = sample(spark)
    scores = model.cross_validate(df, "id", ["a", "b"], "y", folds=3).collect()
    assert sorted(r["fold"] for r in scores) == [0, 1, 2] and all(0.5 < float(r["accuracy"]) <= 1 for r in scores)


def test_folds_are_fitted_without_their_own_rows(spark):
    data, df = sample(spark)
    bucket = {r["id"]: r["b"] for r in df.select("id", model.bucket_of("id", 3).alias("b")).collect()}
    right = {f: [] for f in range(3)}
    for fold in range(3):
        w = newton([r for r in data if bucket[r[0]] != fold])
        right[fold] = [int(w[0] + w[1] * r[1] + w[2] * r[2] > 0) == r[3] for r in data if bucket[r[0]] == fold]
    got = {r["fold"]: float(r["accuracy"]) for r in model.cross_validate(df, "id", ["a", "b"], "y", folds=3).collect()}
    assert got == {f: round(sum(hits) / len(hits), 4) for f, hits in right.items()}
