"""Open-set rejection by Mahalanobis distance to the predicted class."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ClassModel(NamedTuple):
    n: int
    mean: np.ndarray
    covariance: np.ndarray
    share: float  # of shrinkage


def _sums(df: DataFrame, features: str, label: str, means: dict | None) -> dict:
    """By class the sum of a few small arrays over its rows: each batch adds up its own, one row for each cell
    travels, and what reaches the driver has the size of the features squared and not of the table."""
    kind = df.schema[label].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, part in pdf.groupby(label):
                x = np.stack(part[features].to_numpy()).astype(float)
                if means is None:
                    got = np.concatenate([[len(x)], x.sum(0)])
                else:
                    x = x - means[c]
                    got = np.concatenate([(x.T @ x).ravel(), ((x**2).T @ (x**2)).ravel()])
                yield pd.DataFrame({"label": c, "cell": np.arange(len(got)), "s": got})

    cells = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(label, features).mapInPandas(run, f"label {kind}, cell int, s double")
    rows = cells.groupBy("label", "cell").agg(F.sum("s").alias("s")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("cell", "s"))).alias("all"))
    return {r["label"]: np.array([c["s"] for c in r["all"]]) for r in rows.collect()}


def class_models(df: DataFrame, features: str, label: str, least: int = 5) -> dict:
    """Mean and covariance of each class (a bounded number of them), shrunk towards a multiple of the identity as
    Ledoit and Wolf (2004) do; a class of fewer rows than ``least`` gets the identity. ``features`` is an array
    column of one length; rows without a label or features are left out."""
    first = _sums(df, features, label, None)
    counts, means = {c: int(s[0]) for c, s in first.items()}, {c: s[1:] / s[0] for c, s in first.items()}
    second, out = _sums(df, features, label, means), {}
    for c, n in counts.items():
        p = len(means[c])
        if n < least:
            out[c] = ClassModel(n, means[c], np.eye(p), 1.0)
            continue
        products, squares = second[c].reshape(2, p, p)
        s = products / n
        mu = np.trace(s) / p
        d = ((s - mu * np.eye(p)) ** 2).sum() / p
        b = min((squares.sum() / n - (s**2).sum()) / (n * p), d)
        share = 0.0 if d == 0 else max(0.0, min(1.0, b / d))
        out[c] = ClassModel(n, means[c], share * mu * np.eye(p) + (1 - share) * s, share)
    return out


def mahalanobis(df: DataFrame, features: str, predicted: str, models: dict, name: str = "distance") -> DataFrame:
    """Adds the distance of each row to its predicted class, 0 where that class has no model or the distance is
    not finite, so that such rows are judged by their probability alone."""
    inverse = {c: (m.mean, np.linalg.pinv(m.covariance)) for c, m in models.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf))
            classes = pdf[predicted].to_numpy()
            for c, (mean, inv) in inverse.items():
                at = np.flatnonzero((classes == c) & pdf[features].notna().to_numpy())
                if len(at):
                    x = np.stack(pdf[features].iloc[at].to_numpy()).astype(float) - mean
                    out[at] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, inv, x), 0))
            yield pdf.assign(**{name: np.nan_to_num(out, nan=0.0, posinf=0.0)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, {name} double")


def distance_matrix(models: dict) -> list[tuple]:
    """(class_a, class_b, mahalanobis, bhattacharyya) for each pair of classes: the distance between means under the
    mean of both covariances, and an eighth of its square with half the logarithm of that covariance's determinant
    over the geometric mean of both. Where a determinant is not positive, the second has its first part only."""
    names, out = sorted(models), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d, both = models[a].mean - models[b].mean, (models[a].covariance + models[b].covariance) / 2
            square = max(0.0, float(d @ np.linalg.pinv(both) @ d))
            (sign, whole), *each = (np.linalg.slogdet(m) for m in (both, models[a].covariance, models[b].covariance))
            spread = 0.5 * (whole - sum(v for _, v in each) / 2) if min(sign, *(s for s, _ in each)) > 0 else 0.0
            out.append((a, b, square**0.5, square / 8 + float(spread)))
    return out


def class_thresholds(df: DataFrame, label: str, distance: str = "distance", share: float = 0.95, accuracy: int = 10_000, times: float = 1.0) -> DataFrame:
    """(label, threshold): ``times`` the distance that a share of a class's rows keep to, from a sketch that tasks merge; its
    place errs by one in ``accuracy`` rows. Learn it on the rows that the models were learned on."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg((F.percentile_approx(distance, share, accuracy) * times).alias("threshold"))


def rejected_by_class(df: DataFrame, label: str, max_p: Column, thresholds: DataFrame, least_p: float, distance: str = "distance") -> DataFrame:
    """Adds threshold, final (the label, or unknown) and confidence: rows are rejected that are less sure than ``least_p`` or
    farther than their class's threshold; a class without one rejects by probability alone."""
    known = thresholds.select(F.col("label").alias("__label"), "threshold")
    rows = df.join(known, F.col(label) == F.col("__label"), "left").drop("__label")
    out = (max_p < least_p) | F.coalesce(F.col(distance) > F.col("threshold"), F.lit(False))
    return rows.withColumns({"final": F.when(out, "unknown").otherwise(F.col(label).cast("string")), "confidence": F.when(out, 1 - max_p).otherwise(max_p)})
