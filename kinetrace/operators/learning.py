"""Classifiers on window features."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.operators.evaluation import class_weights


def random_forest(train: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Forest with balanced class weights; labels are indexed alphabetically."""
    rows = train.join(class_weights(train, label).select(label, "weight"), label)
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
    ]).fit(rows)


def kernel_features(df: DataFrame, features: list[str], gamma: float, size: int = 200, seed: int = 42) -> DataFrame:
    """Random Fourier features (Rahimi and Recht, 2007): their dot products approximate a Gaussian kernel, which
    makes a linear machine stand in for one with that kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((size, len(features))) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, size)
    x = F.array(*[F.col(c).cast("double") for c in features])
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])
    turned = F.zip_with(weights, F.array(*[F.lit(float(v)) for v in b]), lambda row, shift: F.cos(F.aggregate(F.zip_with(row, x, lambda p, q: p * q), shift, lambda s, v: s + v)) * float(np.sqrt(2 / size)))
    return df.withColumn("rff", turned)


def linear_machine(train: DataFrame, features: list[str], label: str) -> PipelineModel:
    """One linear machine for each class against the others, on features scaled by their population's deviation: the
    scaler takes the sample's, and the product puts that right."""
    n = train.count()
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="by_sample", withMean=True),
        ElementwiseProduct(inputCol="by_sample", outputCol="features", scalingVec=Vectors.dense([(n / max(1, n - 1)) ** 0.5] * len(features))),
        OneVsRest(classifier=LinearSVC(maxIter=30), featuresCol="features", labelCol="label_index"),
    ]).fit(train)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def uncorrelated(df: DataFrame, ranked: list[str], most: float = 0.95, wanted: int = 50) -> list[str]:
    """Walks features from the best; takes one unless it correlates too much with one taken. The matrix is one
    distributed pass; the walk over it is in order by nature."""
    rows = VectorAssembler(inputCols=ranked, outputCol="v").transform(df).select("v")
    r = np.abs(np.nan_to_num(Correlation.corr(rows, "v").first()[0].toArray()))
    taken: list[int] = []
    for i in range(len(ranked)):
        if len(taken) < wanted and all(r[i, j] < most for j in taken):
            taken.append(i)
    return [ranked[i] for i in taken]


def mean_rank(*rankings: list[str]) -> list[str]:
    """Names by the mean of their places in several rankings."""
    names = rankings[0]
    return sorted(names, key=lambda n: (sum(r.index(n) for r in rankings) / len(rankings), n))


def excluded(features: list[str], keywords: tuple[str, ...]) -> list[str]:
    return [f for f in features if not any(k in f for k in keywords)]


def hold_out(df: DataFrame, recording: str, name) -> tuple[DataFrame, DataFrame]:
    """All rows but those of one recording, and the rows of that recording. Rows of no recording are in neither."""
    return df.where(F.col(recording) != name), df.where(F.col(recording) == name)


def checked_apart(train: DataFrame, test: DataFrame, recording: str) -> DataFrame:
    """``train``, failing when it is computed if it has a row of a recording of ``test``."""
    names = test.select(F.col(recording).alias("__name")).distinct().withColumn("__held", F.lit(True))
    seen = train.join(names, F.col(recording) == F.col("__name"), "left")
    return seen.where(F.when(F.col("__held"), F.raise_error(F.lit("a held-out recording is among the training rows"))).otherwise(F.lit(True)).cast("boolean")).drop("__name", "__held")


def aligned(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """The features in training order, by name; what a table lacks, and what is not finite, is 0."""
    def clean(c: str):
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    return df.select(*keys, *[(clean(c) if c in df.columns else F.lit(0.0)).alias(c) for c in features])
