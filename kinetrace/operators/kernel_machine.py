"""Kernel machines over a grid of costs and kernel widths, with probabilities from held-out margins.

A machine with a Gaussian kernel is fitted on random Fourier features, in which it is linear. Its loss is the
squared one (a least-squares kernel machine, Suykens and Vandewalle, 1999), with classes weighted to balance. So
everything that a cell of the grid needs from the rows are sums of products of features: one pass over the table
gives them for every width and fold, and every cost and fold is solved from them. A second pass gives the margins
of every row by the machines that have not seen its fold; a logistic curve over them makes probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.operators.evaluation import fold


class Basis(NamedTuple):
    """Random Fourier features (Rahimi and Recht, 2007) for several widths, and the scale of the raw features."""

    mean: np.ndarray
    sd: np.ndarray
    turns: np.ndarray  # [size, features], for width 1
    shifts: np.ndarray
    gammas: tuple[float, ...]

    def of(self, x: np.ndarray, gamma: float) -> np.ndarray:
        """Features of rows, with a constant for the offset."""
        z = (np.nan_to_num(x) - self.mean) / self.sd
        return np.column_stack([np.cos(z @ (self.turns.T * np.sqrt(2 * gamma)) + self.shifts) * np.sqrt(2 / len(self.shifts)), np.ones(len(x))])


def basis(mean: np.ndarray, sd: np.ndarray, gammas: list[float], size: int = 200, seed: int = 42) -> Basis:
    rng = np.random.default_rng(seed)
    return Basis(mean, np.where(sd > 0, sd, 1.0), rng.standard_normal((size, len(mean))), rng.uniform(0, 2 * np.pi, size), tuple(gammas))


class Sums(NamedTuple):
    gram: np.ndarray  # [size + 1, size + 1]
    total: np.ndarray  # [size + 1]
    n: int


def _summed(rows: DataFrame, run, kinds: str, keys: list[str]) -> dict:
    """Adds arrays up by key: tasks send one binary row for each key, a second round of tasks adds them, and what
    reaches the driver has the size of a key's array times the number of keys."""
    parts = rows.mapInArrow(run, f"{kinds}, sums binary")

    def add(key: tuple, table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(b.as_py()) for b in table.column("sums"))
        return pa.table({**{k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip(keys, key)}, "sums": pa.array([whole.tobytes()], pa.binary())})

    spread = parts.withColumn("__part", F.spark_partition_id() % 16)
    once = spread.groupBy(*keys, "__part").applyInArrow(lambda key, t: add(key[:-1], t), f"{kinds}, sums binary")
    return {tuple(r[k] for k in keys): np.frombuffer(r["sums"]) for r in once.groupBy(*keys).applyInArrow(add, f"{kinds}, sums binary").collect()}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(features, labels, folds, batch) of batches of (x, label, fold, …), 1024 rows at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            yield np.array(batch.column("x").to_pylist(), float), np.array(batch.column("label").to_pylist(), object), batch.column("fold").to_numpy(), batch


def sums_by_fold(rows: DataFrame, b: Basis) -> dict:
    """{(gamma's place, fold, label): Sums} of rows (x, label, fold); classes and folds are few."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kept = None
        for x, label, folds, batch in _batches(batches):
            kept = batch.schema.field("label").type
            for g, gamma in enumerate(b.gammas):
                phi = b.of(x, gamma)
                for key in set(zip(folds.tolist(), label.tolist())):
                    some = phi[(folds == key[0]) & (label == key[1])]
                    got = np.concatenate([(some.T @ some).ravel(), some.sum(0), [len(some)]])
                    held[g, *key] = held[g, *key] + got if (g, *key) in held else got
        if held:
            g, f, c = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(f, pa.int32()), pa.array(c, kept), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["gamma", "fold", "label", "sums"])

    found = _summed(rows, run, f"gamma int, fold int, label {kind}", ["gamma", "fold", "label"])
    m = len(b.shifts) + 1
    return {k: Sums(v[: m * m].reshape(m, m), v[m * m : -1], int(v[-1])) for k, v in found.items()}


class Machine(NamedTuple):
    weights: np.ndarray  # [classes, size + 1]
    slope: np.ndarray  # of the probability of each class over its margin
    offset: np.ndarray


def solved(sums: dict[object, Sums], classes: list, cost: float) -> np.ndarray:
    """One machine for each class against the others, from the sums of each class; a class without rows weighs nothing.
    Each class counts as if all had as many rows. The offset is not held down."""
    m = len(next(iter(sums.values())).total)
    there = [c for c in classes if c in sums and sums[c].n]
    n = sum(sums[c].n for c in there)
    share = {c: n / (len(there) * sums[c].n) for c in there}
    gram = sum(share[c] * sums[c].gram for c in there) + np.diag([1 / cost] * (m - 1) + [1e-9])
    total = sum(share[c] * sums[c].total for c in there)
    sides = np.stack([2 * share[c] * sums[c].total - total if c in share else -total for c in classes], 1)
    return np.linalg.solve(gram, sides).T


def probability_curve(edges: np.ndarray, yes: np.ndarray, no: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, offset) of a logistic curve through counts of margins by their middles (Platt, 1999), by Newton steps;
    one more row on each side keeps the curve finite."""
    target_yes, target_no = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2)
    n, hit = yes + no, yes * target_yes + no * target_no
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[0] * edges + w[1], -50, 50)))
        d = hit - n * p
        h = n * p * (1 - p)
        step = np.linalg.solve([[(h * edges**2).sum() + 1e-9, (h * edges).sum()], [(h * edges).sum(), h.sum() + 1e-9]], [(d * edges).sum(), d.sum()])
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


#: Margins are counted in bins of this width up to ±4 for the probability curve.
BIN, MOST = 0.05, 80


def prepared(df: DataFrame, features: str, label: str, key: str, folds: int) -> DataFrame:
    """(id, x, label, fold) of the rows with features and a label; the fold is a hash of the key."""
    return df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("x"), F.col(label).alias("label"), fold(F.col(key), folds).alias("fold"))


def scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each feature, in one aggregation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, *_ in _batches(batches):
            x = np.nan_to_num(x)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]).tobytes()], pa.binary())], names=["one", "sums"])

    found = _summed(rows, run, "one int", ["one"])
    if not found:
        raise ValueError("no row has features and a label")
    n, *v = found[0,]
    mean, square = np.split(np.array(v) / n, 2)
    return mean, np.sqrt(np.maximum(square - mean**2, 0))


class Grid(NamedTuple):
    basis: Basis
    classes: list
    costs: tuple[float, ...]
    weights: dict  # {(gamma's place, cost's place, fold left out): [classes, size + 1]}
    whole: dict  # the same without fold


def fit_grid(rows: DataFrame, costs: list[float], gammas: list[float], size: int = 200) -> Grid:
    """Machines of all cells of the grid and all folds left out, from one pass over ``rows`` (id, x, label, fold) for their scale
    and one for their sums."""
    b = basis(*scale(rows), gammas, size)
    found = sums_by_fold(rows, b)
    folds, classes = sorted({k[1] for k in found}), sorted({k[2] for k in found})
    weights, whole = {}, {}
    for g in range(len(gammas)):
        for left in [None, *folds]:
            of = {}
            for c in classes:
                parts = [s for (i, f, label), s in found.items() if i == g and label == c and f != left]
                if parts:
                    of[c] = Sums(sum(p.gram for p in parts), sum(p.total for p in parts), sum(p.n for p in parts))
            for k, cost in enumerate(costs):
                (whole if left is None else weights)[(g, k) if left is None else (g, k, left)] = solved(of, classes, cost) if of else np.zeros((len(classes), len(b.shifts) + 1))
    return Grid(b, classes, tuple(costs), weights, whole)


def scored_grid(rows: DataFrame, grid: Grid) -> DataFrame:
    """(gamma, cost, fold, n, right) for each cell and fold: its rows and how many the machine that has not seen the fold
    gets right. Margins that tie give the first class."""
    b, classes = grid.basis, np.array(grid.classes, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for x, label, folds, _ in _batches(batches):
            for g, gamma in enumerate(b.gammas):
                phi = b.of(x, gamma)
                for f in np.unique(folds):
                    at = folds == f
                    for k in range(len(grid.costs)):
                        right = int((classes[(phi[at] @ grid.weights[g, k, int(f)].T).argmax(1)] == label[at]).sum())
                        n, r = held.get((g, k, int(f)), (0, 0))
                        held[g, k, int(f)] = n + int(at.sum()), r + right
        if held:
            g, k, f = zip(*held)
            n, r = zip(*held.values())
            yield pa.RecordBatch.from_arrays([pa.array([b.gammas[i] for i in g]), pa.array([grid.costs[i] for i in k]), pa.array(f, pa.int32()), pa.array(n, pa.int64()), pa.array(r, pa.int64())], names=["gamma", "cost", "fold", "n", "right"])

    return rows.mapInArrow(run, "gamma double, cost double, fold int, n long, right long").groupBy("gamma", "cost", "fold").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))


def machine(rows: DataFrame, grid: Grid, gamma: float, cost: float) -> Machine:
    """The machine of one cell on all rows, with probability curves over the margins that rows have from machines that have
    not seen them; margins are counted in bins, so the counts are all that leaves the tasks."""
    g, k, b, classes = grid.basis.gammas.index(gamma), grid.costs.index(cost), grid.basis, np.array(grid.classes, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(classes), 2, 2 * MOST + 1))
        for x, label, folds, _ in _batches(batches):
            phi = b.of(x, gamma)
            for f in np.unique(folds):
                at = folds == f
                place = np.clip(np.rint((phi[at] @ grid.weights[g, k, int(f)].T) / BIN), -MOST, MOST).astype(int) + MOST
                for c, name in enumerate(classes):
                    np.add.at(counts[c], ((label[at] == name).astype(int), place[:, c]), 1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["one", "sums"])

    counts = _summed(rows, run, "one int", ["one"])[0,].reshape(len(classes), 2, -1)
    middles = np.arange(-MOST, MOST + 1) * BIN
    curves = [probability_curve(middles, counts[c, 1], counts[c, 0]) for c in range(len(classes))]
    return Machine(grid.whole[g, k], *map(np.array, zip(*curves)))


def classified(rows: DataFrame, grid: Grid, m: Machine, gamma: float) -> DataFrame:
    """(id, label, predicted, probability, probabilities by class in their order) of every row (id, x, label, fold)."""
    b, classes = grid.basis, grid.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, batch in _batches(batches):
            margin = b.of(x, gamma) @ m.weights.T
            p = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -50, 50)))
            p = p / p.sum(1, keepdims=True)
            best = p.argmax(1)
            kind = batch.schema.field("label").type
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([classes[i] for i in best], kind), pa.array(p[np.arange(len(p)), best]), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["id", "label", "predicted", "probability", "probabilities"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind('id')}, label {kind('label')}, predicted {kind('label')}, probability double, probabilities array<double>")
