"""Learning list kinds and favourites: linear support vectors, a grid over their parameters, and naive Bayes with a prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows)


def squared(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns with their squares and products: a linear separator over them is a quadratic one, in place of a radial kernel."""
    names = list(columns)
    for i, a in enumerate(columns):
        for b in columns[i:]:
            rows = rows.withColumn(f"{a}_{b}", F.col(a) * F.col(b))
            names.append(f"{a}_{b}")
    return rows, names


def train_kinds(rows: DataFrame, columns: list[str], label: str = "label", *, reg: float = 0.01):
    """A one-against-rest linear separator of numbered list kinds over quadratic features (an approximation of a radial kernel)."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    wide, names = squared(rows, columns)
    return OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=50), labelCol=label, featuresCol="features").fit(_vectors(wide, names))


def predict_kinds(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    wide, names = squared(rows, columns)
    return model.transform(_vectors(wide, names)).drop("features", "rawPrediction", *[n for n in names if n not in columns])


def best_regularisation(rows: DataFrame, columns: list[str], label: str = "label", *, grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0), folds: int = 3) -> float:
    """The regularisation of greatest mean accuracy over folds, dealt by hash so that a run can be repeated."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    wide = rows.withColumn("_fold", F.pmod(F.xxhash64(*columns), F.lit(folds)))
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    score = {}
    for reg in grid:
        total = 0.0
        for k in range(folds):
            model = train_kinds(wide.where(F.col("_fold") != k).drop("_fold"), columns, label, reg=reg)
            total += ev.evaluate(predict_kinds(model, wide.where(F.col("_fold") == k).drop("_fold"), columns))
        score[reg] = total / folds
    return min(score, key=lambda r: (-score[r], r))


def priors(labels: DataFrame, key: str = "doc_id", label: str = "favourite") -> DataFrame:
    """All favourites and as many of the others, by hash order."""
    n = labels.where(label).count()
    return labels.where(label).unionByName(labels.where(~F.col(label)).orderBy(F.xxhash64(key), key).limit(n))
