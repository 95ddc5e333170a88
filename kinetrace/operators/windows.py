"""Ordered operators of a recording: differences, smoothing, runs, sliding and anchored windows.

Every operator takes the partition columns and a total order, since a table has none of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinetrace.functions import kernels


def over(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def indexed(df: DataFrame, by: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Adds the place from 0 of each row in its partition."""
    return df.withColumn(name, (F.row_number().over(over(by, order)) - 1).cast("long"))


def difference(x: str, w: WindowSpec) -> Column:
    """To the row before; 0 in the first row."""
    return F.col(x) - F.coalesce(F.lag(x).over(w), F.col(x))


def rolling_mean(x: str, w: WindowSpec, size: int) -> Column:
    """Centred mean of the rows there are: fewer at the ends."""
    return F.avg(x).over(w.rowsBetween(-(size // 2), (size - 1) // 2))


def moving_average(x: str, w: WindowSpec, size: int) -> Column:
    """Centred sum over ``size`` rows, those beyond the ends being zero, divided by ``size`` throughout."""
    return F.sum(x).over(w.rowsBetween(-(size // 2), (size - 1) // 2)) / size


def gradient(x: str, w: WindowSpec, rate: float = 1.0) -> Column:
    """Central differences on an even grid, one-sided at the ends."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), after - F.col(x)).when(after.isNull(), F.col(x) - before).otherwise((after - before) / 2) * rate


def gradient_uneven(x: str, t: str, w: WindowSpec) -> Column:
    """Second-order differences on an uneven grid, one-sided at the ends."""
    xb, xa, tb, ta = F.lag(x).over(w), F.lead(x).over(w), F.lag(t).over(w), F.lead(t).over(w)
    hs, hd = F.col(t) - tb, ta - F.col(t)
    inner = (hs * hs * xa + (hd * hd - hs * hs) * F.col(x) - hd * hd * xb) / (hs * hd * (hs + hd))
    return F.when(xb.isNull(), (xa - F.col(x)) / hd).when(xa.isNull(), (F.col(x) - xb) / hs).otherwise(inner)


def forward_jerk(x: str, w: WindowSpec, rate: float) -> Column:
    return (F.lead(x).over(w) - F.col(x)) * rate


def majority(label: str, w: WindowSpec, size: int = 5, unknown: str = "unknown") -> Column:
    """Most frequent label around a row, the alphabetically first of equals; unknown only where nothing else is."""
    around = w.rowsBetween(-(size // 2), size // 2)
    return F.coalesce(F.mode(F.when(F.col(label) != unknown, F.col(label)), True).over(around), F.lit(unknown))


def runs(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Numbers the maximal runs of equal labels (null equals null) in column ``run`` from 1."""
    w = over(by, order)
    starts = F.when(F.row_number().over(w) == 1, 1).when(~F.col(label).eqNullSafe(F.lag(label).over(w)), 1).otherwise(0)
    return df.withColumn("run", starts).withColumn("run", F.sum("run").over(w))


def run_lengths(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    at = order[0]
    return runs(df, by, order, label).groupBy(*by, "run").agg(F.first(label).alias("label"), F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def longest_run(df: DataFrame, by: list[str], order: list[str], condition: Column, rate: float = 1.0) -> DataFrame:
    """Length of the longest run of rows that meet the condition; 0 where none does."""
    flagged = runs(df.withColumn("hit", F.coalesce(condition, F.lit(False))), by, order, "hit")
    sizes = flagged.groupBy(*by, "run").agg(F.sum(F.col("hit").cast("int")).alias("n"))
    return sizes.groupBy(*by).agg((F.max("n") / rate).alias("longest"))


def sliding(df: DataFrame, by: list[str], order: list[str], size: int, step: int, partial: bool = False) -> DataFrame:
    """One row for each row and window that holds it, with window_id and ``i``; whole windows only.

    A partition of n rows has (n - size) // step + 1 windows, or none. Project before this: it multiplies
    rows by size / step.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = indexed(df, by, order).withColumn("__n", n).where(F.col("__n") >= size)
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - (size - 1)) / step)).cast("long")
    hi = F.least(F.floor(F.col("i") / step), F.floor((F.col("__n") - size) / step)).cast("long")
    rows = rows.withColumns({"__lo": lo, "__hi": hi}).where("__lo <= __hi")
    return rows.withColumn("window_id", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi", "__n")


def window_labels(df: DataFrame, by: list[str], label: str, size: int) -> DataFrame:
    """(…, window_id, label, purity): the most frequent label, the alphabetically first of equals."""
    counts = df.groupBy(*by, "window_id", label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label")))
    return counts.groupBy(*by, "window_id").agg(best.alias("b")).select(*by, "window_id", F.col("b.label").alias("label"), (-F.col("b.n") / size).alias("purity"))


def window_stats(df: DataFrame, by: list[str], x: str, t: str) -> DataFrame:
    """Moments of a channel in each window; skewness and kurtosis are those of the population, 0 if constant."""
    zero = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
    return df.groupBy(*by, "window_id").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("ptp"),
        F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), zero(F.skewness(x)).alias("skew"), zero(F.kurtosis(x)).alias("kurt"),
        F.min(t).alias("t_first"), F.max(t).alias("t_last"), ((F.min(t) + F.max(t)) / 2).alias("t_center"),
    )


def null_ratio(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Share of empty cells in each window."""
    empty = sum((F.sum(F.col(c).isNull().cast("int")) for c in columns[1:]), F.sum(F.col(columns[0]).isNull().cast("int")))
    return df.groupBy(*by, "window_id").agg((empty / (F.count(F.lit(1)) * len(columns))).alias("null_ratio"))


def energy_envelope(df: DataFrame, by: list[str], order: list[str], x: str, size: int, step: int) -> DataFrame:
    """Root mean square in sliding windows, at the place of each window's middle."""
    rows = sliding(df, by, order, size, step)
    return rows.groupBy(*by, "window_id").agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms")).withColumn("center", F.col("window_id") * step + size // 2)


def anchored(df: DataFrame, anchors: DataFrame, by: list[str], t: str, before: float, after: float, least: int = 1) -> DataFrame:
    """Rows in [anchor - before, anchor + after] of each anchor (with anchor_id and anchor); windows with fewer
    rows than ``least`` are left out."""
    a = anchors.select(*[F.col(c).alias(f"__{c}") for c in by], "anchor_id", "anchor")
    near = [F.col(c) == F.col(f"__{c}") for c in by]
    joined = df.join(a, [*near, F.col(t).between(F.col("anchor") - before, F.col("anchor") + after)]).drop(*[f"__{c}" for c in by])
    return joined.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by, "anchor_id"))).where(F.col("__n") >= least).drop("__n")


def padded(df: DataFrame, by: list[str], i: str, x: str, size: int) -> DataFrame:
    """(…, samples): the first ``size`` values in order, zeros after the last."""
    got = df.where(F.col(i) < size).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(i, x))).alias("s"))
    values = F.transform("s", lambda s: s[x].cast("double"))
    return got.select(*by, F.concat(values, F.array_repeat(F.lit(0.0), size - F.size("s"))).alias("samples"))


def sliding_samples(df: DataFrame, by: list[str], order: list[str], x: str, size: int, step: int) -> DataFrame:
    """(…, window_id, samples): the values in order of every whole window of each recording."""
    rows = sliding(df, by, order, size, step).groupBy(*by, "window_id").agg(F.array_sort(F.collect_list(F.struct(*order, x))).alias("s"))
    return rows.select(*by, "window_id", F.transform("s", lambda s: s[x].cast("double")).alias("samples"))


def alternate(df: DataFrame, by: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Gives the k-th row the name k modulo their number, and the number of its cycle from 1; rows of a last
    cycle that is not whole are left out."""
    k, n = F.row_number().over(over(by, order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*by))
    whole = (F.floor(n / len(names)) * len(names))
    named = df.withColumns({"__k": k, "__w": whole}).where("__k < __w")
    return named.withColumns({"name": F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("__k") % len(names) + 1).cast("int")), "cycle": (F.floor(F.col("__k") / len(names)) + 1).cast("int")}).drop("__k", "__w")


def tallest(df: DataFrame, by: list[str], score: str, order: list[str], keep: int) -> DataFrame:
    """The ``keep`` rows of highest score in each partition, ties in order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *order)).cast("long")).where(F.col("rank") <= keep)


def event_segments(df: DataFrame, by: list[str], order: list[str], label: str, none: str = "null") -> DataFrame:
    """Rows of the maximal runs of one label, with segment, their number in the recording; runs of ``none`` are no events,
    nor is one whose label the event before it had."""
    w = over(by, order)
    last = F.last(F.when(F.col(label) != none, F.col(label)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ~F.col("run").eqNullSafe(F.lag("run").over(w))
    rows = runs(df.withColumn(label, F.coalesce(label, F.lit(none))), by, order, label).withColumn("__new", F.when(starts, ~F.col(label).eqNullSafe(last)))
    rows = rows.withColumn("__new", F.last("__new", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col(label) != none) & F.col("__new")).drop("__new").withColumnRenamed("run", "segment")


def event_anchors(segments: DataFrame, by: list[str], i: str, x: str, label: str, apart: int = 5, spread: float = 1.5) -> DataFrame:
    """(…, segment, label, anchor, kind) of each event: the place of its tallest peak that is prominent by ``spread``
    standard deviations, else of its centre of energy, else, without energy, of its middle. A segment is one event
    and short; they go through in batches."""
    rows = segments.groupBy(*by, "segment").agg(F.first(label).alias(label), F.array_sort(F.collect_list(F.struct(i, x))).alias("__s"))
    rows = rows.select(*by, "segment", label, F.transform("__s", lambda s: s[i]).alias("__i"), F.transform("__s", lambda s: s[x].cast("double")).alias("__x"))

    def place(x: np.ndarray) -> tuple[int, str]:
        tops = kernels.find_peaks(x, apart, spread * kernels.running_std(x))
        if len(tops):
            return int(tops[np.argmax(x[tops])]), "peak"
        energy, moment = (x * x).cumsum()[-1], (np.arange(len(x)) * x * x).cumsum()[-1]  # in order, as aggregates sum
        if energy < 1e-12:
            return len(x) // 2, "middle"
        return min(int(moment / energy), len(x) - 1), "centroid"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [place(np.asarray(x, float)) for x in pdf["__x"]]
            yield pdf[[*by, "segment", label]].assign(anchor=[int(places[k]) for places, (k, _) in zip(pdf["__i"], got)], kind=[k for _, k in got])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*by, "segment", label))
    return rows.mapInPandas(run, f"{kinds}, anchor long, kind string")


def cut_samples(df: DataFrame, centres: DataFrame, by: list[str], order: list[str], columns: list[str], before: int, after: int, size: int, borders: str = "clip", least: int = 1, shifts: list[int] | None = None) -> DataFrame:
    """The columns of ``centres`` (…, center, a place in the recording counted from 0) with an array for each of ``columns``:
    the samples of the window [center - before, center + after) in order, the first ``size`` of them, 0 where one is null.
    With ``shifts`` a window for each of them, round center + shift, with column shift.

    Borders ``clip`` cuts the window at the ends of the recording, ``shift`` moves it inside as far as it fits,
    ``drop`` leaves it out. Windows of fewer samples than ``least``, or of none, are left out too. A recording is cut into
    blocks as long as the windows of a centre reach, each with the samples of the next one as well, so these windows lie in
    the block where the first begins: a centre travels as one row and meets one row, and samples are taken out after that.
    """
    moves, length = shifts or [0], before + after
    span = max(length + max(moves) - min(moves), 1)
    keys, xs = [f"__by_{c}" for c in by], [f"__x_{c}" for c in columns]
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    rows = indexed(df, by, order, "__i").select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.floor(F.col("__i") / span).alias("__block"), "__i", *[F.coalesce(c, F.lit(0.0)).alias(x) for c, x in zip(columns, xs)])
    blocks = rows.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list(F.struct("__i", *xs))).alias("__s")).select(*keys, "__block", *[F.col(f"__s.{x}").cast("array<double>").alias(x) for x in xs])
    following = lambda x: F.coalesce(F.lead(x).over(over(keys, ["__block"])), F.array().cast("array<double>"))
    blocks = blocks.select(*keys, "__block", *[F.concat(x, following(x)).alias(x) for x in xs])

    def ends(shift):
        """Of the window with this shift, inside the recording for ``shift``; else what lies beyond its end has no samples."""
        a, b = F.greatest(F.lit(0), F.col("center") + shift - before), F.col("center") + shift + after
        if borders == "shift":
            a, b = F.greatest(F.lit(0), F.least(a, F.col("__n") - length)), F.least(F.col("__n"), F.greatest(b, F.lit(length)))
        return a.cast("long"), F.least(b, a + size).cast("long")

    placed = centres
    if borders == "shift":
        sizes = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.count(F.lit(1)).alias("__n"))
        placed = centres.join(sizes, same).drop(*keys)
    joined = placed.join(blocks, [*same, F.floor(ends(F.lit(min(moves)))[0] / span) == F.col("__block")])
    a, b = ends(F.col("__shift"))
    windows = joined.withColumn("__shift", F.explode(F.array(*[F.lit(m) for m in moves]))).withColumns({"__skip": a - F.col("__block") * span, "__most": F.greatest(F.lit(0), b - a)}).where(F.col("__most") >= max(least, 1))
    if borders == "drop":
        windows = windows.where((F.col("center") + F.col("__shift") >= before) & (F.size(xs[0]) - F.col("__skip") >= length))
    taken = lambda x: F.slice(x, (F.col("__skip") + 1).cast("int"), F.col("__most").cast("int"))
    got = windows.select(*centres.columns, *([F.col("__shift").alias("shift")] if shifts else []), *[taken(x).alias(c) for x, c in zip(xs, columns)])
    return got.where(F.size(columns[0]) >= max(least, 1))


def cut(df: DataFrame, centres: DataFrame, by: list[str], order: list[str], columns: list[str], before: int, after: int, size: int, borders: str = "clip", least: int = 1) -> DataFrame:
    """The windows of ``cut_samples`` a row for each sample: the columns of ``centres`` with k, from 0 to size - 1, and the
    ``columns`` of the k-th sample; what lies beyond the window is 0."""
    windows = cut_samples(df, centres, by, order, columns, before, after, size, borders, least).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return windows.select(*centres.columns, "k", *[F.coalesce(F.get(c, F.col("k")), F.lit(0.0)).alias(c) for c in columns])
