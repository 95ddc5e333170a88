"""Many models over many folds at once: a fit for each model and fold is a row of a table, so tasks fit side by side
and two jobs serve any number of them, where a loop on the driver would start one for each.

Fits see a bounded sample of the rows, which travels to the tasks once; predictions cover every row, each by the
models that have not seen its fold. Features are scaled by what a fit sees.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Model(NamedTuple):
    """fit(x, y, classes, rng) gives arrays; predict(arrays, x) gives places in the list of classes."""

    fit: Callable[[np.ndarray, np.ndarray, int, np.random.Generator], dict]
    predict: Callable[[dict, np.ndarray], np.ndarray]


def _scaled(x: np.ndarray) -> dict:
    sd = x.std(0)
    return {"mean": x.mean(0), "sd": np.where(sd > 0, sd, 1.0)}


def _z(m: dict, x: np.ndarray) -> np.ndarray:
    return (x - m["mean"]) / m["sd"]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _votes(found: np.ndarray, classes: int) -> np.ndarray:
    return np.stack([(found == c).sum(1) for c in range(classes)], 1).argmax(1)


def centroids() -> Model:
    """The class of the nearest mean."""
    def fit(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator) -> dict:
        m = _scaled(x)
        return m | {"at": np.stack([_z(m, x[y == c]).mean(0) if (y == c).any() else np.full(x.shape[1], np.inf) for c in range(classes)])}

    return Model(fit, lambda m, x: np.where(np.isfinite(m["at"]).all(1), _squares(_z(m, x), np.nan_to_num(m["at"], posinf=0.0)), np.inf).argmin(1))


def neighbours(k: int = 5) -> Model:
    """The most frequent class of the k nearest rows, of equals the first class."""
    def fit(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator) -> dict:
        m = _scaled(x)
        return m | {"rows": _z(m, x), "y": y, "classes": classes}

    return Model(fit, lambda m, x: _votes(m["y"][np.argsort(_squares(_z(m, x), m["rows"]), 1, kind="stable")[:, :k]], m["classes"]))


def machine(cost: float = 1.0) -> Model:
    """Least-squares machine with balanced classes; for a kernel one give it kernel features."""
    def fit(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator) -> dict:
        m = _scaled(x)
        z = np.column_stack([_z(m, x), np.ones(len(x))])
        n = np.bincount(y, minlength=classes)
        w = (len(y) / (np.count_nonzero(n) * np.maximum(n, 1)))[y][:, None]
        sides = np.where(y[:, None] == np.arange(classes)[None], 1.0, -1.0)
        return m | {"w": np.linalg.solve((z * w).T @ z + np.diag([1 / cost] * x.shape[1] + [1e-9]), (z * w).T @ sides)}

    return Model(fit, lambda m, x: (np.column_stack([_z(m, x), np.ones(len(x))]) @ m["w"]).argmax(1))


def forest(trees: int = 100, depth: int = 10) -> Model:
    """Extremely randomised trees (Geurts and others, 2006) with balanced classes; ``importance`` is each feature's mean
    decrease of impurity, of sum 1."""
    def grown(x: np.ndarray, side: np.ndarray, rng: np.random.Generator, importance: np.ndarray) -> list[np.ndarray]:
        feature, cut, below, value = [], [], [], []
        todo = [(np.arange(len(x)), 0, -1)]
        while todo:
            rows, level, above = todo.pop()
            here, total = len(feature), side[rows].sum(0)
            if above >= 0:
                below[above // 2][above % 2] = here
            feature.append(-1), cut.append(0.0), below.append([0, 0]), value.append(total / total.sum())
            lo, hi = x[rows].min(0), x[rows].max(0)
            open_ = np.flatnonzero(hi > lo)
            if level >= depth or len(rows) < 2 or np.count_nonzero(total) < 2 or not len(open_):
                continue
            tried = rng.choice(open_, min(len(open_), max(1, round(x.shape[1] ** 0.5))), replace=False)
            at = rng.uniform(lo[tried], hi[tried])
            left = x[np.ix_(rows, tried)] <= at
            a = left.T.astype(float) @ side[rows]
            b = total - a
            kept = (a**2).sum(1) / np.maximum(a.sum(1), 1e-12) + (b**2).sum(1) / np.maximum(b.sum(1), 1e-12)
            best = int(kept.argmax())
            importance[tried[best]] += kept[best] - (total**2).sum() / total.sum()
            feature[here], cut[here] = int(tried[best]), float(at[best])
            todo += [(rows[~left[:, best]], level + 1, 2 * here + 1), (rows[left[:, best]], level + 1, 2 * here)]
        return [np.array(feature), np.array(cut), np.array(below), np.array(value)]

    def fit(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator) -> dict:
        n = np.bincount(y, minlength=classes)
        side = np.eye(classes)[y] * (len(y) / (np.count_nonzero(n) * np.maximum(n, 1)))[y][:, None]
        importance = np.zeros(x.shape[1])
        grove = [grown(x, side, rng, importance) for _ in range(trees)]
        return {"trees": grove, "depth": depth, "importance": importance / max(importance.sum(), 1e-12)}

    def predict(m: dict, x: np.ndarray) -> np.ndarray:
        sums = 0.0
        for feature, cut, below, value in m["trees"]:
            at = np.zeros(len(x), int)
            for _ in range(m["depth"]):
                f = feature[at]
                at = np.where(f < 0, at, below[at, (x[np.arange(len(x)), f] > cut[at]).astype(int)])
            sums = sums + value[at]
        return sums.argmax(1)

    return Model(fit, predict)


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(ids, features, places of labels, folds, labels) of at most ``most`` rows, chosen by a hash of the id."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "x", "label", "fold").collect()
    classes = sorted({r["label"] for r in some})
    place = {c: i for i, c in enumerate(classes)}
    x = np.nan_to_num(np.array([r["x"] for r in some], float)) if some else np.zeros((0, 0))
    return np.array([r["id"] for r in some], object), x, np.array([place[r["label"]] for r in some], int), np.array([r["fold"] for r in some], int), classes


def _seed(*parts: object) -> np.random.Generator:
    return np.random.default_rng(list("/".join(map(str, parts)).encode()))


def fitted(rows: DataFrame, models: dict[str, Model], most: int = 5000) -> tuple[dict, list]:
    """({(model, fold left out): arrays}, classes): every model without every fold of ``rows`` (id, x, label, fold). Fits see
    at most ``most`` rows; folds and models are few."""
    spark = rows.sparkSession
    _, x, y, fold, classes = _sample(rows, most)
    cells = [(name, int(f)) for name in models for f in sorted(set(fold.tolist()))]
    if not cells:
        return {}, classes
    grid = spark.createDataFrame(cells, "model string, fold int").repartition(len(cells))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, f in zip(pdf["model"], pdf["fold"]):
                at = fold != f
                got = models[name].fit(x[at], y[at], len(classes), _seed(name, f)) if at.any() else None
                yield pd.DataFrame({"model": [name], "fold": [f], "arrays": [pickle.dumps(got)]})

    return {(r["model"], r["fold"]): pickle.loads(r["arrays"]) for r in grid.mapInPandas(run, "model string, fold int, arrays binary").collect()}, classes


def swept(rows: DataFrame, models: dict[str, Model], most: int = 5000) -> DataFrame:
    """(id, label, fold, model, predicted) of every row and model, by the fit without the row's fold; null where that fit had
    no rows to learn from."""
    held, classes = fitted(rows, models, most)
    kind = lambda c: rows.schema[c].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, part in pdf.groupby("fold"):
                x = np.nan_to_num(np.stack(part["x"].to_numpy()).astype(float))
                for name, model in models.items():
                    arrays = held.get((name, int(f)))
                    found = [None] * len(part) if arrays is None else [classes[i] for i in model.predict(arrays, x)]
                    yield part[["id", "label", "fold"]].assign(model=name, predicted=found)

    return rows.select("id", "x", "label", "fold").mapInPandas(run, f"id {kind('id')}, label {kind('label')}, fold int, model string, predicted {kind('label')}")


def left_out(rows: DataFrame, models: dict[str, Model], most: int = 2000) -> DataFrame:
    """(id, label, model, predicted) with each row a fold of its own: as many fits as rows, dealt over the tasks. Meant for
    a table of segments; of more than ``most`` rows those with the smallest hashes are judged."""
    ids, x, y, _, classes = _sample(rows, most)
    spark: SparkSession = rows.sparkSession
    kind = lambda c: rows.schema[c].dataType.simpleString()
    tasks = max(1, min(len(ids), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                at = np.arange(len(y)) != i
                for name, model in models.items():
                    found = classes[int(model.predict(model.fit(x[at], y[at], len(classes), _seed(name, i)), x[i : i + 1])[0])] if at.any() else None
                    yield pd.DataFrame({"id": [ids[i]], "label": [classes[y[i]]], "model": [name], "predicted": [found]})

    return spark.range(0, len(ids), 1, tasks).mapInPandas(run, f"id {kind('id')}, label {kind('label')}, model string, predicted {kind('label')}")


def forest_importances(rows: DataFrame, names: list[str], trees: int = 100, depth: int = 10, most: int = 5000) -> DataFrame:
    """(feature, importance): the mean over the folds of what each feature is worth to a forest without that fold."""
    held, _ = fitted(rows, {"forest": forest(trees, depth)}, most)
    worth = np.mean([a["importance"] for a in held.values() if a], 0)
    return rows.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, worth, strict=True)], "feature string, importance double")
