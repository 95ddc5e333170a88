"""Common clocks: uniform grids, outer alignment, warping and gap filling by linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from kinetrace.operators.windows import moving_average, over


def first_of_each(df: DataFrame, by: list[str], t: str, order: list[str]) -> DataFrame:
    """One row for each time: the first in order."""
    w = Window.partitionBy(*by, t).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _between(x0: Column, x1: Column, t0: Column, t1: Column, t: Column) -> Column:
    return F.when(t1.isNull() | (t1 == t0), x0).when(t0.isNull(), x1).otherwise(x0 + (x1 - x0) * (t - t0) / (t1 - t0))


def both_ways(by: list[str], order: list[Column]) -> tuple[WindowSpec, WindowSpec]:
    """Frames of all rows up to each one, and of all from it on. The second is the first in falling order, so that
    ``last`` is carried along in both: a frame that ends at the end of a partition is gone through again for every
    row."""
    w = Window.partitionBy(*by)
    return tuple(w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, [c.desc_nulls_last() for c in order]))


def uniform_grid(df: DataFrame, by: list[str], t: str, values: list[str], period: float, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Values at every ``period`` from each partition's first time to its last, interpolated between the
    samples around; before the first sample and after the last the value at the end holds.

    Grid points join the samples' partitions as a union, so this is one shuffle; times are longs.
    """
    ends = df.groupBy(*by).agg((lo if lo is not None else F.min(t)).alias("lo"), (hi if hi is not None else F.max(t)).alias("hi")).where("lo <= hi")
    grid = ends.select(*by, F.posexplode(F.sequence("lo", "hi", F.lit(int(period)))).alias("k", t))
    samples = df.select(*by, F.lit(None).cast("int").alias("k"), F.col(t), *values)
    rows = samples.unionByName(grid, allowMissingColumns=True)
    back, ahead = both_ways(by, [F.col(t), F.col("k").isNotNull()])
    is_sample = F.col("k").isNull()
    t0, t1 = (F.last(F.when(is_sample, F.col(t)), True).over(w) for w in (back, ahead))
    out = {v: _between(*(F.last(F.when(is_sample, F.col(v)), True).over(w) for w in (back, ahead)), t0, t1, F.col(t)) for v in values}
    return rows.withColumns(out).where("k IS NOT NULL")


def common_bounds(df: DataFrame, by: list[str], node: str, t: str) -> DataFrame:
    """Where all nodes of a recording overlap: the latest first time to the earliest last time."""
    return df.groupBy(*by, node).agg(F.min(t).alias("a"), F.max(t).alias("b")).groupBy(*by).agg(F.max("a").alias("lo"), F.min("b").alias("hi"), F.count(F.lit(1)).alias("nodes"))


def common_grid(df: DataFrame, by: list[str], node: str, t: str, values: list[str], period: int, nodes: list[int]) -> DataFrame:
    """All nodes of a recording on one grid over the time that they share: (…, us of the grid, ``<value>_n<node>``).
    Times are longs; of rows of a node with one time the one with the smallest values counts. A node that a
    recording lacks has nulls; a recording whose nodes never overlap has no rows."""
    known = df.where(F.col(node).isin(nodes))
    known = known.groupBy(*by, node, t).agg(F.min(F.struct(*values)).alias("__v")).select(*by, node, t, "__v.*")
    bounds = common_bounds(known, by, node, t).where("lo <= hi").select(*[F.col(c).alias(f"__{c}") for c in by], "lo", "hi")
    inside = known.join(bounds, [F.col(c) == F.col(f"__{c}") for c in by]).drop(*[f"__{c}" for c in by])
    grid = uniform_grid(inside, [*by, node], t, values, period, F.max("lo"), F.max("hi"))
    return pivot_nodes(grid, [*by, "k", t], node, nodes, values, whole=False)


def pivot_nodes(df: DataFrame, key: list[str], node: str, nodes: list[int], values: list[str], whole: bool = True) -> DataFrame:
    """One row for each tick with columns ``<value>_n<node>``: an N-way join by one shuffle. ``whole`` keeps
    only ticks that every node has; of several rows of a node the smallest value counts."""
    aggs = [F.min(F.when(F.col(node) == n, F.col(v))).alias(f"{v}_n{n}") for n in nodes for v in values]
    wide = df.where(F.col(node).isin(nodes)).groupBy(*key).agg(*aggs, F.countDistinct(node).alias("__n"))
    return (wide.where(F.col("__n") == len(nodes)) if whole else wide).drop("__n")


def fill_by_row(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Fills empty values between others by place in the order, not by time; after the last one it holds, and
    rows before the first one of any value are left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(w))
    back, ahead = both_ways(by, [F.col("__i")])
    out = {}
    for v in values:
        at = F.when(F.col(v).isNotNull(), F.col("__i"))
        x0, i0, x1, i1 = F.last(v, True).over(back), F.last(at, True).over(back), F.last(v, True).over(ahead), F.last(at, True).over(ahead)
        out[v] = F.when(i0.isNull(), F.lit(None)).when(i1.isNull() | (i1 == i0), x0).otherwise(x0 + (x1 - x0) * (F.col("__i") - i0) / (i1 - i0))
    return rows.withColumns(out).drop("__i").na.drop(subset=values)


def at_place(samples: Column, place: Column) -> Column:
    """Value of an array at a fractional place from 0; beyond its ends the first or last step goes on."""
    n = F.size(samples)
    k = F.greatest(F.lit(0), F.least(F.floor(place).cast("int"), n - 2))
    a, b = F.element_at(samples, k + 1), F.element_at(samples, k + 2)
    return F.when(n == 1, F.element_at(samples, 1)).otherwise(a + (b - a) * (place - k))


def stretched(samples: Column, n: int) -> Column:
    """An array in ``n`` even steps from its first value to its last."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at_place(samples, i * (F.size(samples) - 1) / F.lit(float(n - 1))))


def warped(samples: Column, n: int, pivot: Column, to: float) -> Column:
    """An array in ``n`` steps such that place ``pivot`` of it lands at the share ``to`` of the result."""
    last, cut = F.size(samples) - 1, F.lit(to * (n - 1))

    def source(i: Column) -> Column:
        return F.when(i <= cut, i / cut * pivot).otherwise(pivot + (i - cut) / (n - 1 - cut) * (last - pivot))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at_place(samples, source(i)))


def gated(df: DataFrame, by: list[str], order: list[str], values: list[str], visibility: str, least: float = 0.35, smooth: int | None = None) -> DataFrame:
    """Values of low visibility count as empty and are filled by place; then, with ``smooth``, each is the mean over so many
    rows, those beyond the ends being zero."""
    filled = fill_by_row(df.withColumns({v: F.when(F.col(visibility) >= least, F.col(v)) for v in values}), by, order, values)
    return filled if smooth is None else filled.withColumns({v: moving_average(v, over(by, order), smooth) for v in values})


def repaired(df: DataFrame, by: list[str], t: str, values: list[str], tolerance: float = 0.2) -> DataFrame:
    """Puts a group whose steps differ from their median by more than the tolerance on an even grid of as many
    samples between its ends; other groups stay as they are."""
    w = Window.partitionBy(*by)
    dt = F.col(t) - F.lag(t).over(w.orderBy(t))
    rows = df.withColumn("__d", dt).withColumn("__m", F.percentile("__d", 0.5).over(w))
    rows = rows.withColumn("__bad", F.max(F.coalesce(F.abs(F.col("__d") - F.col("__m")) > tolerance * F.col("__m"), F.lit(False))).over(w))
    fine = rows.where(~F.col("__bad")).select(*by, F.col(t).cast("double").alias(t), *values)
    worse = rows.where("__bad").select(*by, F.lit(None).cast("long").alias("__k"), F.col(t).cast("double").alias(t), *values)
    ends = worse.groupBy(*by).agg(F.min(t).alias("__a"), F.max(t).alias("__b"), F.count(F.lit(1)).alias("__n"))
    grid = ends.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    grid = grid.withColumn(t, F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__k") / F.greatest(F.col("__n") - 1, F.lit(1))).select(*by, "__k", t)
    both = worse.unionByName(grid, allowMissingColumns=True)
    back, ahead = both_ways(by, [F.col(t), F.col("__k").isNotNull(), *[F.col(v) for v in values]])
    sample = F.col("__k").isNull()
    t0, t1 = (F.last(F.when(sample, F.col(t)), True).over(w) for w in (back, ahead))
    lerp = {v: _between(*(F.last(F.when(sample, F.col(v)), True).over(w) for w in (back, ahead)), t0, t1, F.col(t)) for v in values}
    return fine.unionByName(both.withColumns(lerp).where("__k IS NOT NULL").select(*by, t, *values))
