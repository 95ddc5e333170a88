"""Stream quality and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import correlation


def exact_quantile(df: DataFrame, by: list[str], x: str, p: float, name: str = "quantile") -> DataFrame:
    """(by, name): the quantile of each group, between two values by a straight line; nulls are left out.

    No task gathers a group: equal values count as one row, a group's values are cut into some hundred ranges at
    approximate quantiles, counts of ranges tell which hold the two places, and only those ranges are sorted.
    """
    by = by or ["__all"]
    rows = df.withColumn("__all", F.lit(0)) if by == ["__all"] else df
    one = rows.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__x")).agg(F.count(F.lit(1)).alias("__m"))
    edges = one.groupBy(*by).agg(F.percentile_approx("__x", [k / 100 for k in range(1, 100)], 1000).alias("__edges")).select(*[F.col(c).alias(f"__by_{c}") for c in by], "__edges")
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    cut = one.join(edges, same).select(*by, "__x", "__m", F.size(F.filter("__edges", lambda e: e <= F.col("__x"))).alias("__range"))
    counts = cut.groupBy(*by, "__range").agg(F.sum("__m").alias("__n"))
    group = Window.partitionBy(*by)
    place = F.lit(float(p)) * (F.sum("__n").over(group) - 1)
    placed = counts.withColumns({"__before": F.sum("__n").over(group.orderBy("__range")) - F.col("__n"), "__lo": F.floor(place), "__hi": F.ceil(place), "__part": place - F.floor(place)})
    holds = lambda k: (F.col("__before") <= F.col(k)) & (F.col(k) < F.col("__before") + F.col("__n"))
    wanted = placed.where(holds("__lo") | holds("__hi")).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__at"), "__before", "__lo", "__hi", "__part")
    found = cut.join(wanted, [*same, F.col("__range") == F.col("__at")])
    after = F.col("__before") + F.sum("__m").over(Window.partitionBy(*by, "__range").orderBy("__x"))
    found = found.withColumn("__after", after)
    value = lambda k: F.min(F.when(F.col("__after") > F.col(k), F.col("__x")))
    out = found.groupBy(*by).agg(value("__lo").alias("__a"), value("__hi").alias("__b"), F.first("__part").alias("__part"))
    out = out.withColumn(name, F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part"))
    return out.select(*[c for c in by if c != "__all"], name)


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max) of each column; std is the sample's, quartiles are exact."""
    g = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    g = g.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns]))).select("column", "s.*")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        g = g.join(exact_quantile(long, ["column"], "x", p, name), "column", "left")
    return g.select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def packet_loss(df: DataFrame, by: list[str], seq: str, t: str, saturated: Column | None = None) -> DataFrame:
    """Rows, duration, median period and rate, share of sequence numbers that never came, saturated rows."""
    dt = F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(t, seq))
    full = F.sum((saturated if saturated is not None else F.lit(False)).cast("int"))
    return df.withColumn("__dt", dt).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), (F.max(t) - F.min(t)).alias("duration"), F.percentile("__dt", 0.5).alias("median_dt"),
        (1 - F.countDistinct(seq) / (F.max(seq) - F.min(seq) + 1)).alias("loss"), full.alias("saturated"),
    ).withColumn("hz", F.when(F.col("median_dt") > 0, 1 / F.col("median_dt")))


def dropouts(df: DataFrame, by: list[str], t: str, period: float, factor: float = 1.5) -> DataFrame:
    """Gaps longer than ``factor`` periods, their share of steps, the longest, and how many samples should be there."""
    dt = F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(t))
    gap = F.col("__dt") > factor * period
    return df.withColumn("__dt", dt).groupBy(*by).agg(
        F.sum(F.coalesce(gap, F.lit(False)).cast("int")).alias("gaps"), F.avg(gap.cast("double")).alias("gap_ratio"), F.max("__dt").alias("max_gap"),
        (F.floor((F.max(t) - F.min(t)) / period) + 1).alias("expected"),
    )


def jitter(df: DataFrame, by: list[str], t: str, tolerance: float = 0.2, warn: float = 0.05) -> DataFrame:
    """Share of steps that differ from the median step by more than the tolerance."""
    w = Window.partitionBy(*by)
    dt = F.col(t) - F.lag(t).over(w.orderBy(t))
    steps = df.withColumn("__dt", dt).where("__dt IS NOT NULL")
    steps = steps.withColumn("__m", F.percentile("__dt", 0.5).over(w))
    return steps.groupBy(*by).agg(F.avg((F.abs(F.col("__dt") - F.col("__m")) > tolerance * F.col("__m")).cast("double")).alias("jitter")).withColumn("warn", F.col("jitter") > warn)


def baseline(df: DataFrame, by: list[str], t: str, acc: Column, seconds: float, gravity: float, tolerance: float) -> DataFrame:
    """Whether a recording starts at rest: mean norm of its first seconds near gravity, and little spread."""
    head = df.withColumn("__t0", F.min(t).over(Window.partitionBy(*by))).where(F.col(t) - F.col("__t0") <= seconds)
    out = head.groupBy(*by).agg(F.avg(acc).alias("mean_norm"), F.stddev_pop(acc).alias("std_norm"))
    return out.withColumn("status", F.when(F.abs(F.col("mean_norm") - gravity) <= tolerance, "static").when(F.col("std_norm") <= tolerance, "offset").otherwise("moving"))


def static_check(df: DataFrame, by: list[str], acc: str, vertical: str, gyr: str, gravity: float = 9.80665, near: float = 1.0, turning: float = 0.5) -> DataFrame:
    """Mean and sample deviation of the norms of acceleration and rotation and of the vertical acceleration of rows at rest,
    and passed: acceleration near gravity, nothing vertical beside it, no rotation, little spread."""
    named = {"acc": acc, "vertical": vertical, "gyr": gyr}
    out = df.groupBy(*by).agg(*[f(F.col(c)).alias(f"{k}_{n}") for k, c in named.items() for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    rest = (F.abs(F.col("acc_mean") - gravity) < near) & (F.col("acc_std") < near) & (F.abs("vertical_mean") < near) & (F.col("vertical_std") < near) & (F.col("gyr_mean") < turning)
    return out.withColumn("passed", F.coalesce(rest, F.lit(False)))


def crosstab(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Share of each value in each row's total."""
    total = F.count(F.lit(1))
    return df.groupBy(rows).agg(*[F.round(F.sum((F.col(column) == v).cast("int")) / total, 2).alias(v) for v in values])


def size_table(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    return df.groupBy(*rows).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def joined_in_order(df: DataFrame, by: list[str], order: list[str], text: str, glue: str = " → ") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x[text]), glue).alias("sequence"))


def marginals(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Mean and spread for each pair, for each of both, and over all, in one pass."""
    return df.cube(a, b).agg(F.grouping_id().alias("level"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def share_summary(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value)
    middle = exact_quantile(df, [], value, 0.5, "median")
    out = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), (F.max(x) - F.min(x)).alias("range"),
        F.avg((F.abs(x) > 0.3).cast("double")).alias("over_03"), F.avg((F.abs(x) > 0.5).cast("double")).alias("over_05"), F.avg((x > 0).cast("double")).alias("positive"),
    )
    return out.join(middle, F.lit(True), "left").select("n", "mean", "median", *out.columns[2:])  # one row each


def pearson(df: DataFrame, by: list[str], x: str, y: str, flat: float | None = 0.0, least: int = 2) -> DataFrame:
    """Correlation in each group. Where a side is constant it is ``flat``, or the group is left out if that is None."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col(x), F.col(y)).alias("r"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy")).where(F.col("n") >= least)
    bad = (F.col("sx") < 1e-12) | (F.col("sy") < 1e-12) | F.col("r").isNull() | F.isnan("r")
    out = out.where(~bad) if flat is None else out.withColumn("r", F.when(bad, flat).otherwise(F.col("r")))
    return out.select(*by, "n", "r")
