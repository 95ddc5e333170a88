"""Kernels over the partitions of a table: one group is one node of one recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import kernels
from kinetrace.functions.columns import norm
from kinetrace.operators.recursion import System, scanned
from kinetrace.operators.windows import over


#: Groups go through a kernel together once they have so many rows.
_ROWS = 50_000


def per_group(df: DataFrame, by: list[str], order: list[str], inputs: list[str], outputs: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Applies ``kernel`` ([n, inputs] to [n, outputs]) to each group in order and adds the outputs. A group is
    one node's recording, whose length the collection protocol bounds."""
    return per_groups(df, by, order, inputs, outputs, lambda groups: [kernel(g) for g in groups])


def per_groups(df: DataFrame, by: list[str], order: list[str], inputs: list[str], outputs: list[str], kernel: Callable[..., list[np.ndarray]], carried: bool = False) -> DataFrame:
    """As ``per_group`` with a kernel of many groups, for recursions that take a sample of each group at a time. A task
    has its groups one after the other and holds some thousand rows, or one group that is longer. A ``carried`` kernel
    needs no more of a group's past than the last outputs, and has them, or None, as its second argument: then long
    groups come in parts."""
    keep = list(dict.fromkeys([*by, *order, *inputs]))
    kinds = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} double" for c in outputs)])
    rows = df.select(*keep).withColumn("__k", F.row_number().over(over(by, order))).sortWithinPartitions(*by, "__k")

    def whole(held: list[pa.RecordBatch], before: tuple[int, np.ndarray] | None) -> tuple[pa.Table, tuple[int, np.ndarray] | None]:
        table = pa.Table.from_batches(held).combine_chunks()
        k = table["__k"].to_numpy()
        goes_on = before is not None and k[0] == before[0] + 1
        if not (k[0] == 1 or goes_on) or not ((k[1:] == 1) | (np.diff(k) == 1)).all():
            raise ValueError("rows of a group are not together")
        x = np.column_stack([table[c].cast(pa.float64()).to_numpy() for c in inputs])
        groups = np.split(x, np.flatnonzero(k[1:] == 1) + 1)
        got = kernel(groups, before[1] if goes_on else None) if carried else kernel(groups)
        got = np.concatenate([np.asarray(y, float).reshape(-1, len(outputs)) for y in got])
        columns = [*(table[c] for c in keep), *(pa.array(got[:, i], from_pandas=True) for i in range(len(outputs)))]
        return pa.Table.from_arrays(columns, names=[*keep, *outputs]), (int(k[-1]), got[-1]) if carried else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before = None
        for batch in batches:
            starts = np.flatnonzero(batch.column("__k").to_numpy() == 1)
            end = batch.num_rows if carried else int(starts[-1]) if len(starts) else -1
            if end >= 0 and sum(b.num_rows for b in held) + end >= _ROWS:
                table, before = whole([*held, batch.slice(0, end)], before)
                yield from table.to_batches(10_000)
                held, batch = [], batch.slice(end)
            held.append(batch)
        if sum(b.num_rows for b in held):
            yield from whole(held, before)[0].to_batches(10_000)

    return rows.mapInArrow(run, kinds)


def smoothed(df: DataFrame, by: list[str], order: list[str], x: str, cutoff: float, rate: float, degree: int = 4, high: bool = False, span: float | None = None) -> DataFrame:
    """Zero-phase low- or high-pass; never across groups, and a group too short for it stays as it is. With ``span`` a
    group is cut into chunks of so much of the first order column, so that it may be longer than a task holds."""
    return _both_ways(df, by, order, x, *kernels.butterworth(degree, cutoff, rate, high), span)


def _both_ways(df: DataFrame, by: list[str], order: list[str], x: str, b: np.ndarray, a: np.ndarray, span: float | None) -> DataFrame:
    if span is None:
        return per_group(df, by, order, [x], [f"{x}_filtered"], lambda v: kernels.zero_phase(b, a, v[:, 0]))
    return scanned(df, by, order, x, f"{x}_filtered", System.of_filter(b, a), span, 3 * max(len(a), len(b)))


def peaks(df: DataFrame, by: list[str], order: list[str], x: str, distance: int | None = None, prominence: float | None = None) -> DataFrame:
    """Adds is_peak."""
    def kernel(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v))
        out[kernels.find_peaks(v[:, 0], distance, prominence)] = 1
        return out

    return per_group(df, by, order, [x], ["is_peak"], kernel).withColumn("is_peak", F.col("is_peak") > 0)


def peak_shapes(df: DataFrame, by: list[str], order: list[str], x: str, distance: int | None = None, prominence: float | None = None) -> DataFrame:
    """The peaks alone, with their prominence and their width in samples at half of it."""
    def kernel(v: np.ndarray) -> np.ndarray:
        out, x = np.full((len(v), 2), np.nan), v[:, 0]
        tops = kernels.find_peaks(x, distance, prominence)
        out[tops] = np.column_stack([kernels.prominences(x, tops), kernels.widths(x, tops)])
        return out

    return per_group(df, by, order, [x], ["prominence", "width"], kernel).where(F.col("prominence").isNotNull() & ~F.isnan("prominence"))


def oriented(df: DataFrame, by: list[str], order: list[str], acc: list[str], gyr: list[str], dt: float, method: str = "madgwick") -> DataFrame:
    """Adds the quaternion q_w, q_x, q_y, q_z of each sample."""
    f = {"madgwick": kernels.madgwick_each, "complementary": kernels.attitude_each}[method]
    return per_groups(df, by, order, [*acc, *gyr], ["q_w", "q_x", "q_y", "q_z"], lambda groups, before: f(groups, dt, before), carried=True)


def window_features(df: DataFrame, keys: list[str], samples: str, rate: float) -> DataFrame:
    """Features of windows held as arrays of four samples or more: 11 of time, 4 of frequency and 3 of bands. Rows go
    through in batches, those of one length together, so no group is gathered."""
    names = list(time_and_frequency(np.zeros((1, 8)), rate))
    kinds = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} double" for c in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf[samples].str.len()):
                got = time_and_frequency(np.stack(part[samples].to_numpy()).astype(float), rate)
                yield part[keys].assign(**{k: np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0) for k, v in got.items()})

    return df.select(*keys, samples).mapInPandas(run, kinds)


def time_and_frequency(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """The 18 features of each row of ``x``."""
    c = x - x.mean(1, keepdims=True)
    sd = x.std(1)
    safe = np.where(sd > 0, sd, 1)
    moment = lambda k: np.where(sd > 0, (c**k).mean(1) / safe**k, 0)
    return {
        "mean": x.mean(1), "std": sd, "min": x.min(1), "max": x.max(1), "ptp": np.ptp(x, 1), "rms": np.sqrt((x**2).mean(1)),
        "skew": moment(3), "kurt": np.where(sd > 0, moment(4) - 3, 0), "zero_cross": (x[:, 1:] * x[:, :-1] < 0).sum(1).astype(float),
        "peaks": kernels.count_peaks(x, 0.5 * sd).astype(float),
        "jerk_peak": np.abs(np.gradient(x, 1 / rate, axis=1)).max(1), **kernels.spectral(x, rate),
    }


def gravity_frame(df: DataFrame, by: list[str], order: list[str], acc: list[str], rate: float) -> DataFrame:
    """Adds a_vert and a_horiz: the high-passed acceleration along gravity and across it, gravity being the
    median direction of the slow part of each group."""
    slow, fast = kernels.butterworth(4, 0.2, rate), kernels.butterworth(4, 0.5, rate, high=True)

    def kernel(groups: list[np.ndarray]) -> list[np.ndarray]:
        out, channels = [], [v.T for v in groups]
        for still, quick in zip(kernels.zero_phase_each(*slow, channels), kernels.zero_phase_each(*fast, channels)):
            g = np.median(still, 1)
            g = g / (np.linalg.norm(g) + 1e-12)
            up = quick.T @ g
            out.append(np.column_stack([up, np.linalg.norm(quick.T - up[:, None] * g, axis=1)]))
        return out

    return per_groups(df, by, order, acc, ["a_vert", "a_horiz"], kernel)


def banded(df: DataFrame, by: list[str], order: list[str], x: str, lo: float, hi: float, rate: float, degree: int = 4, span: float | None = None) -> DataFrame:
    """Zero-phase band-pass of each group; ``span`` as for ``smoothed``."""
    return _both_ways(df, by, order, x, *kernels.bandpass(degree, lo, hi, rate), span)


def counted_peaks(df: DataFrame, by: list[str], order: list[str], x: str, wanted: int, distance: int, steps: int = 30, start: float = 0.9, floor: float = 0.45) -> DataFrame:
    """Adds is_peak: about ``wanted`` peaks in each group, by a sweep of the least prominence over quantiles of the signal."""
    def kernel(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v))
        out[kernels.peaks_for_count(v[:, 0], wanted, distance, steps, start, floor)] = 1
        return out

    return per_group(df, by, order, [x], ["is_peak"], kernel).withColumn("is_peak", F.col("is_peak") > 0)


def tilted(df: DataFrame, by: list[str], order: list[str], acc: list[str], gyr: list[str], dt: float, alpha: float = 0.98, span: float | None = None) -> DataFrame:
    """Adds roll and pitch of each sample by a complementary filter that starts level; ``span`` as for ``smoothed``."""
    if span is None:
        return per_group(df, by, order, [*acc, *gyr], ["roll", "pitch"], lambda v: kernels.tilt(v[:, :3], v[:, 3:], dt, alpha))
    x, y, z = (F.col(c) for c in acc)
    seen = {"roll": F.atan2(y, z), "pitch": F.atan2(-x, norm(y, z))}
    keep = list(dict.fromkeys([*by, *order, *acc, *gyr]))
    rows = df.select(*keep, *[(alpha * F.col(g) * dt + (1 - alpha) * seen[c]).alias(f"__{c}") for c, g in zip(seen, gyr)])
    leaky = System(np.array([[alpha]]), np.array([1.0]), np.array([alpha]), 1.0)
    rows = scanned(rows, by, order, "__roll", "roll", leaky, span, carry=(*keep[len(by) :], "__pitch"))
    return scanned(rows, by, order, "__pitch", "pitch", leaky, span, carry=(*keep[len(by) :], "roll")).select(*keep, "roll", "pitch")


def synchrony(df: DataFrame, keys: list[str], x: str, y: str, rate: float) -> DataFrame:
    """(keys, sync_max, sync_lag, period_height, period_lag) of windows held as two arrays of equal length: how well
    and at which shift they agree best, and the first peak of the first one's autocorrelation."""
    names = ["sync_max", "sync_lag", "period_height", "period_lag"]
    kinds = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} double" for c in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for a, b in zip(pdf[x], pdf[y]):
                a, b = np.asarray(a, float), np.asarray(b, float)
                (high, lag), (height, period) = kernels.cross_correlation(a, b), kernels.autocorrelation_peak(a)
                got.append((high, lag / rate, height, period / rate))
            yield pdf[keys].assign(**{n: [g[k] for g in got] for k, n in enumerate(names)})

    return df.select(*keys, x, y).mapInPandas(run, kinds)
