"""Churn model: split, fit by Newton steps, predict, report, cross-validate.

A step's gradient and Hessian are sums over the rows of a few features, so a step is one aggregation, whatever the number of
rows and models; only these sums come to the driver, which solves for the next weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..session import materialise


def bucket_of(key: str, buckets: int = 100, seed: int = 42) -> Column:
    """Repeatable bucket of a row from its key alone, whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    bucket = bucket_of(key, seed=seed)
    cut = round(test_share * 100)
    return df.filter(bucket >= cut), df.filter(bucket < cut)


STEPS = 8  # Newton steps; from zero weights and with a penalty, the last ones change nothing that matters


@dataclass(frozen=True)
class Logistic:
    """Weights of a fitted model."""

    intercept: float
    coefficients: list[float]

    def margin(self, features: list[str]) -> Column:
        """The linear score, positive for class 1."""
        terms = [F.lit(w) * F.col(c).cast("double") for w, c in zip(self.coefficients, features)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))


def newton_weights(rows: DataFrame, features: list[str], label: str, model: str, models: int, steps: int = STEPS) -> list[np.ndarray]:
    """Weights (intercept first) of ridge-penalised logistic models with unit strength and a free intercept.

    ``model`` numbers the model from 0 that a row belongs to. All models take their steps together.
    """
    inputs = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    size, ridge = len(inputs), np.diag([0.0] + [1.0] * len(features))
    weights = [np.zeros(size) for _ in range(models)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(steps):
        known = F.array(*[F.array(*[F.lit(float(w)) for w in one]) for one in weights])
        own = rows.withColumn("__w", F.get(known, F.col(model)))
        score = reduce(lambda a, b: a + b, [F.get("__w", F.lit(i)) * x for i, x in enumerate(inputs)])
        own = own.withColumn("__p", 1 / (1 + F.exp(-score)))
        p = F.col("__p")
        sums = [F.sum(x * (p - F.col(label).cast("double"))).alias(f"g{i}") for i, x in enumerate(inputs)]
        sums += [F.sum(inputs[i] * inputs[j] * p * (1 - p)).alias(f"h{i}_{j}") for i, j in pairs]
        for row in own.groupBy(model).agg(*sums).collect():
            w, hessian = weights[row[model]], np.zeros((size, size))
            for i, j in pairs:
                hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
            gradient = np.array([row[f"g{i}"] for i in range(size)])
            weights[row[model]] = w - np.linalg.solve(hessian + ridge, gradient + ridge @ w)
    return weights


def fit_logistic(train: DataFrame, features: list[str], label: str) -> Logistic:
    """One model of all rows. ``train`` is read once per step; pass a materialised frame when it is costly."""
    (weights,) = newton_weights(train.withColumn("__model", F.lit(0)), features, label, "__model", 1)
    return Logistic(float(weights[0]), [float(w) for w in weights[1:]])


def predict(model: Logistic, df: DataFrame, features: list[str]) -> DataFrame:
    """All columns of ``df`` with the predicted class beside them."""
    return df.withColumn("prediction", F.when(model.margin(features) > 0, 1).otherwise(0))


def classification_report(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    counts = predicted.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("y") == F.col("p")
    by_label = counts.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hits"))
    by_guess = counts.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("guessed"))
    rows = by_label.join(by_guess, "class", "left")
    guessed = F.coalesce("guessed", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(20,4)"))
    return rows.select(
        "class", zero(ratio(F.col("hits"), guessed, 4)).alias("precision"), zero(ratio(F.col("hits"), F.col("support"), 4)).alias("recall"),
        zero(ratio(F.col("hits") * 2, guessed + F.col("support"), 4)).alias("f1"), "support",
    )


def report_summary(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """The last rows of a printed report: accuracy, and precision, recall and F1 averaged plainly and by support.

    Classes that occur only as predictions count with support 0.
    """
    counts = predicted.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).alias("guessed"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits"))
    sides = sides.unionByName(counts.select(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("guessed"), F.lit(0).alias("hits")))
    classes = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hits")])
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    hits, support, guessed = F.col("hits"), F.col("support"), F.col("guessed")
    rates = classes.select(
        "support", "hits", share(hits, guessed).alias("precision"), share(hits, support).alias("recall"), share(2 * hits, guessed + support).alias("f1")
    )
    names, total = ["precision", "recall", "f1"], F.sum("support")
    plain = F.struct(F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("row"), *[share(F.sum(F.col(c) * support), total).alias(c) for c in names], total.alias("support"))
    none = F.lit(None).cast("double")
    right = F.struct(F.lit("accuracy").alias("row"), none.alias("precision"), none.alias("recall"), share(F.sum("hits"), total).alias("f1"), total.alias("support"))
    rows = rates.agg(right.alias("a"), plain.alias("m"), weighted.alias("w"))
    out = rows.select(F.explode(F.array("a", "m", "w")).alias("r")).select("r.*")
    return out.withColumns({c: F.round(c, 4) for c in names})


def accuracy(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = F.count_if(F.col(label) == F.col(prediction))
    return predicted.agg(ratio(hit, F.count(F.lit(1)), 4).alias("accuracy"))


def cross_validate(df: DataFrame, key: str, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """Accuracy per fold; the fold of a row follows from its key. The models of all folds are fitted together."""
    rows = materialise(df.withColumn("__fold", bucket_of(key, folds)))
    others = F.array_remove(F.array(*map(F.lit, range(folds))), F.col("__fold"))
    weights = newton_weights(rows.withColumn("__model", F.explode(others)), features, label, "__model", folds)
    fitted = [Logistic(float(w[0]), [float(x) for x in w[1:]]) for w in weights]
    margin = F.lit(None).cast("double")
    for fold, model in enumerate(fitted):
        margin = F.when(F.col("__fold") == fold, model.margin(features)).otherwise(margin)
    hit = F.count_if(F.col(label) == F.when(margin > 0, 1).otherwise(0))
    scores = rows.groupBy("__fold").agg(ratio(hit, F.count(F.lit(1)), 4).alias("accuracy"))
    return scores.select(F.col("__fold").alias("fold"), "accuracy")
