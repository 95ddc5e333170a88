"""Similarity of recordings: segments and samples matched by place, correlated by channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import correlation
from kinetrace.operators.quality import marginals, pearson, share_summary
from kinetrace.operators.windows import indexed, runs


def labelled_segments(df: DataFrame, by: list[str], order: list[str], label: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted labels with ``ordinal``, the number of their segment among those of that label, and
    ``pos``, their place in it."""
    rows = runs(df, by, order, label).where(F.col(label).isin(wanted))
    ordinal = rows.select(*by, label, "run").distinct()
    ordinal = indexed(ordinal, [*by, label], ["run"], "ordinal")
    return indexed(rows.join(ordinal, [*by, label, "run"]), [*by, "run"], order, "pos")


def segment_correlations(a: DataFrame, b: DataFrame, keys: list[str], x: str, flat: float | None = 0.0, least: int = 2) -> DataFrame:
    """Correlation of the k-th segment of one with the k-th of the other, over the length of the shorter."""
    both = a.select(*keys, "ordinal", "pos", F.col(x).alias("xa")).join(b.select(*keys, "ordinal", "pos", F.col(x).alias("xb")), [*keys, "ordinal", "pos"])
    return pearson(both, [*keys, "ordinal"], "xa", "xb", flat, least)


def similarity_table(correlations: DataFrame, a: str, b: str) -> DataFrame:
    return marginals(correlations, a, b, "r")


def similarity_summary(correlations: DataFrame) -> DataFrame:
    return share_summary(correlations, "r")


def most_similar(correlations: DataFrame, by: str) -> DataFrame:
    """The value of ``by`` with the highest mean correlation, the smallest of equals."""
    means = correlations.groupBy(by).agg(F.round(F.avg("r"), 9).alias("mean"))
    return means.agg(F.min(F.struct(-F.col("mean"), F.col(by))).alias("b")).select(F.col(f"b.{by}").alias(by), (-F.col("b.col1")).alias("mean"))


def lagged_correlation(df: DataFrame, by: list[str], order: list[str], x: str, y: str, most: int) -> DataFrame:
    """(…, lag, r): the shift of y within ``most`` rows that correlates best with x, the smallest of equals. All shifts are
    columns over one sort, so no row is copied."""
    w, lags = Window.partitionBy(*by).orderBy(*order), range(-most, most + 1)
    rows = df.select(*by, F.col(x).alias("__x"), *[F.lead(y, k).over(w).alias(f"__y{n}") for n, k in enumerate(lags)])
    found = rows.groupBy(*by).agg(*[correlation(F.col("__x"), F.col(f"__y{n}")).alias(f"__r{n}") for n in range(len(lags))])
    each = F.array(*[F.struct((-F.round(F.col(f"__r{n}"), 9)).alias("minus"), F.lit(abs(k)).alias("far"), F.lit(k).alias("lag")) for n, k in enumerate(lags)])
    best = found.select(*by, F.array_min(F.filter(each, lambda e: e["minus"].isNotNull() & ~F.isnan(e["minus"]))).alias("b")).where("b IS NOT NULL")
    return best.select(*by, F.col("b.lag").alias("lag"), (-F.col("b.minus")).alias("r"))


def mean_template(df: DataFrame, channel: list[str], i: str, x: str) -> DataFrame:
    """Mean, spread, median and number of samples at each place of each channel."""
    return df.groupBy(*channel, i).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, 0.5).alias("median"), F.count(x).alias("n"))


def cosine_to_template(df: DataFrame, template: DataFrame, by: list[str], i: str, x: str) -> DataFrame:
    """Cosine of each window with the template (i, mean)."""
    both = df.join(template.select(i, F.col("mean").alias("__m")), i)
    xy, xx, yy = F.sum(F.col(x) * F.col("__m")), F.sum(F.col(x) * F.col(x)), F.sum(F.col("__m") * F.col("__m"))
    return both.groupBy(*by).agg((xy / (F.sqrt(xx) * F.sqrt(yy) + 1e-12)).alias("cosine"))
