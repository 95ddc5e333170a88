"""Activity segments and event timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import clip, share_of
from kinetrace.operators.joins import interval_join, lookup
from kinetrace.operators.robust import quantiled, robust_z
from kinetrace.operators.windows import indexed, moving_average, over, runs, sliding


def active_runs(df: DataFrame, by: list[str], order: list[str], active: Column) -> DataFrame:
    """(…, start, end, n): maximal runs of active rows by the first order column."""
    flagged = runs(df.withColumn("__on", F.coalesce(active, F.lit(False))), by, order, "__on").where("__on")
    return flagged.groupBy(*by, "run").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def merge_close(segments: DataFrame, by: list[str], gap: float) -> DataFrame:
    """Joins segments whose gap to all before them is at most ``gap``."""
    w = over(by, ["start"])
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumn("__new", F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0))
    rows = rows.withColumn("segment", F.sum("__new").over(w))
    return rows.groupBy(*by, "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def latch(df: DataFrame, by: list[str], order: list[str], x: str, hi: Column, lo: Column) -> Column:
    """On from a value over ``hi`` until one under ``lo``."""
    signal = F.when(F.col(x) > hi, True).when(F.col(x) < lo, False)
    return F.coalesce(F.last(signal, True).over(over(by, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))


def hysteresis(df: DataFrame, by: list[str], order: list[str], x: str, hi: float = 5.0, lo: float = 2.0, gap: float = 0.0, least: int = 1) -> DataFrame:
    """Segments between two thresholds, multiples of the 10th percentile; near ones joined, short ones left out."""
    rows = quantiled(df, by, x, {"__q": 0.1})
    rows = rows.withColumn("__state", latch(rows, by, order, x, F.col("__q") * hi, F.col("__q") * lo))
    return merge_close(active_runs(rows, by, order, F.col("__state")), by, gap).where(F.col("n") >= least)


def adaptive(df: DataFrame, by: list[str], order: list[str], x: str, least: int, gap: float) -> DataFrame:
    """Segments over a threshold from the recording's own percentiles: the median and a quarter of the spread
    between the 10th and the 90th, and one and a half times the 10th at least."""
    rows = quantiled(df, by, x, {"__p10": 0.1, "__p50": 0.5, "__p90": 0.9})
    p10, p50, p90 = (F.col(c) for c in ("__p10", "__p50", "__p90"))
    level = F.greatest(p50 + 0.25 * (p90 - p10), 1.5 * p10)
    found = active_runs(rows, by, order, F.col(x) > level).where(F.col("n") >= least)
    return merge_close(found, by, gap)


def continuous_labels(df: DataFrame, by: list[str], order: list[str], energy: str, t: str, label: str, trim: float, none: str = "null") -> DataFrame:
    """A recording of one action: its label, but none where energy dips under 1.5 times the 10th percentile or
    within ``trim`` of an end."""
    w = Window.partitionBy(*by)
    rows = quantiled(df, by, energy, {"__q": 0.1}).withColumns({"__a": F.min(t).over(w), "__b": F.max(t).over(w)})
    rest = (F.col(energy) < 1.5 * F.col("__q")) | (F.col(t) < F.col("__a") + trim) | (F.col(t) > F.col("__b") - trim)
    return rows.withColumn("assigned", F.when(rest, none).otherwise(F.col(label))).drop("__q", "__a", "__b")


def between_peaks(df: DataFrame, by: list[str], order: list[str], x: str, least: float) -> DataFrame:
    """(…, peak, left, right): local maxima over ``least`` and the lowest places towards their neighbours."""
    w = over(by, order)
    at = order[0]
    is_peak = (F.col(x) > F.lag(x).over(w)) & (F.col(x) > F.lead(x).over(w)) & (F.col(x) > least)
    rows = df.withColumn("__p", F.coalesce(is_peak, F.lit(False)))
    rows = rows.withColumn("k", F.sum(F.col("__p").cast("int")).over(w))
    valley = rows.where(~F.col("__p")).groupBy(*by, "k").agg(F.min_by(at, F.struct(x, at)).alias("valley"))
    peaks = rows.where("__p").select(*by, "k", F.col(at).alias("peak"))
    left = valley.select(*by, (F.col("k") + 1).alias("k"), F.col("valley").alias("left"))
    return peaks.join(left, [*by, "k"], "left").join(valley.withColumnRenamed("valley", "right"), [*by, "k"], "left").select(*by, "k", "peak", "left", "right")


def phases(events: DataFrame, start: str, release: str, end: str, lengths: dict[str, tuple[float, float]]) -> DataFrame:
    """Splits each event into named phases, given as offsets from the release and cut at the event's ends;
    phases that vanish are left out."""
    parts = F.array(*[F.struct(F.lit(i).alias("phase_no"), F.lit(n).alias("phase"), F.greatest(F.col(start), F.col(release) + a).alias("phase_start"), F.least(F.col(end), F.col(release) + b).alias("phase_end")) for i, (n, (a, b)) in enumerate(lengths.items())])
    return events.withColumn("p", F.explode(parts)).select("*", "p.*").drop("p").where("phase_start < phase_end")


def best_in_share(df: DataFrame, by: list[str], i: str, score: str, lo: float, hi: float) -> DataFrame:
    """Place of the highest score, the first of equals, inside a share of each window."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    inner = df.withColumn("__n", n).where((F.col(i) >= share_of(lo, F.col("__n"))) & (F.col(i) < share_of(hi, F.col("__n"))))
    return inner.groupBy(*by).agg(F.min_by(i, F.struct(-F.col(score), F.col(i))).alias("place"), F.max(score).alias("score"))


def timeline(df: DataFrame, by: list[str], order: list[str], label: str, start: str, end: str, confidence: str, least: dict[str, int], usual: int, unknown: str = "unknown") -> DataFrame:
    """Events from runs of equal window labels: bounds, number of windows and mean confidence. A run shorter
    than its label's least number of windows becomes unknown; neighbours that are then unknown stay apart."""
    events = runs(df, by, order, label).groupBy(*by, "run").agg(
        F.first(label).alias("raw"), F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("windows"), F.avg(confidence).alias("confidence"))
    need = F.lit(usual)
    for name, n in least.items():
        need = F.when(F.col("raw") == name, n).otherwise(need)
    return events.withColumn("label", F.when(F.col("windows") >= need, F.col("raw")).otherwise(unknown)).drop("raw").withColumnRenamed("run", "event")


def conformance(df: DataFrame, by: list[str], order: list[str], label: str, expected: list[str]) -> DataFrame:
    """Each row of a cycle against the label that its place calls for."""
    k = (F.row_number().over(over(by, order)) - 1) % len(expected)
    want = F.element_at(F.array(*[F.lit(x) for x in expected]), (k + 1).cast("int"))
    return df.withColumn("expected", want).withColumn("conforms", F.col("expected") == F.col(label))


def review(df: DataFrame, z: str, confidence: str, far: float = 3.5, weak: float = 0.5) -> DataFrame:
    """Quality flags of predictions and the order in which people should see them."""
    out, low = F.abs(F.col(z)) > far, F.col(confidence) < weak
    return df.withColumns({
        "outlier": F.coalesce(out, F.lit(False)), "weak": F.coalesce(low, F.lit(False)),
        "status": F.when(out & low, "reject").when(out, "check").when(low, "weak").otherwise("ok"),
        "priority": F.when(out & low, 1).when(out, 2).when(low, 3).otherwise(4),
    })


def smeared_labels(df: DataFrame, by: list[str], order: list[str], x: str, label: str, size: int, step: int, trim: int, none: str = "null") -> DataFrame:
    """A recording of one action labelled by its energy envelope: each row has the greatest root mean square of the
    windows that hold it, 0 where none does, and no label where that is under 1.5 times the envelope's 10th
    percentile or within ``trim`` rows of an end."""
    part = [*by, "window_id"]
    windows = sliding(df.select(*by, *order, x), by, order, size, step).withColumn("__e", F.sqrt(F.avg(F.col(x) * F.col(x)).over(Window.partitionBy(*part))))
    best = windows.groupBy(*by, "i").agg(F.max("__e").alias("__most"))
    rest = windows.groupBy(*part).agg(F.first("__e").alias("__e"))
    rest = quantiled(rest, by, "__e", {"__rest": 0.1}).groupBy(*by).agg(F.first("__rest").alias("__rest"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = indexed(df, by, order).withColumn("__n", n).join(best, [*by, "i"], "left").join(rest, by, "left")
    quiet = F.coalesce(F.coalesce("__most", F.lit(0.0)) < 1.5 * F.col("__rest"), F.lit(True)) | (F.col("i") < trim) | (F.col("i") >= F.col("__n") - trim)
    return rows.withColumn("assigned", F.when(quiet, none).otherwise(F.col(label))).drop("__n", "__most", "__rest")


def rectified_score(df: DataFrame, by: list[str], order: list[str], weights: dict[str, float], size: int = 5, visibility: str | None = None) -> DataFrame:
    """Adds i and score: the weighted sum of rectified robust scores, times the visibility cut to 0 and 1 where one
    is given, smoothed over ``size`` rows that count as 0 beyond the ends. A null visibility counts as 0."""
    rows, parts = indexed(df, by, order), []
    for k, (c, weight) in enumerate(weights.items()):
        rows = robust_z(rows, by, c).withColumnRenamed("z", f"__z{k}")
        parts.append(weight * F.greatest(F.col(f"__z{k}"), F.lit(0.0)))
    seen = clip(F.coalesce(F.col(visibility), F.lit(0.0)), 0.0, 1.0) if visibility else F.lit(1.0)
    rows = rows.withColumn("__raw", sum(parts[1:], parts[0]) * seen).withColumn("score", moving_average("__raw", over(by, ["i"]), size))
    return rows.drop("__raw", *[f"__z{k}" for k in range(len(weights))])


def release_score(df: DataFrame, by: list[str], order: list[str], weights: dict[str, float], size: int = 5, lo: float = 0.35, hi: float = 0.70) -> DataFrame:
    """(…, place, score, n): where the rectified score is highest inside a share of each window; the first of equals.
    Shares are rounded half to even."""
    rows = rectified_score(df.select(*by, *order, *weights), by, order, weights, size)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    inner = rows.where((F.col("i") >= F.bround(F.col("n") * F.lit(lo), 0)) & (F.col("i") < F.bround(F.col("n") * F.lit(hi), 0)))
    best = F.min(F.struct((-F.round("score", 9)).alias("minus"), F.col("i")))
    return inner.groupBy(*by).agg(best.alias("b"), F.first("n").alias("n")).select(*by, F.col("b.i").alias("place"), (-F.col("b.minus")).alias("score"), "n")


def last_impact(df: DataFrame, releases: DataFrame, by: list[str], i: str, energy: str, gather: int, search: int, share: float = 0.7) -> DataFrame:
    """(…, release, n, impact): the last row at or over a quantile of the energy among the ``search`` rows before the
    gather, which starts ``gather`` rows before the release; the first of these rows where fewer than three are
    there. ``releases`` has one row (…, release, n) for each recording."""
    start = F.greatest(F.lit(0), F.col("release") - gather)
    first = F.greatest(F.lit(0), start - search)
    rows = df.select(*by, i, energy).join(releases, by).where((F.col(i) >= first) & (F.col(i) < F.greatest(first + 1, start)))
    rows = quantiled(rows, by, energy, {"__q": share})
    found = rows.groupBy(*by).agg(F.max(F.when(F.col(energy) >= F.col("__q"), F.col(i))).alias("last"), F.min(i).alias("first"), F.count(energy).alias("c"))
    place = F.when(F.col("c") < 3, F.col("first")).otherwise(F.coalesce("last", "first"))
    return releases.join(found, by).select(*releases.columns, place.alias("impact"))


def shot_phases(impacts: DataFrame, half: int, gather: int, follow: int) -> DataFrame:
    """The six phases of a shot, in rows with both ends included: what comes before the last impact, from there to the
    gather, the gather, the release of ``half`` rows to each side, the follow-through up to ``follow`` rows after it,
    and the rest. A phase that would end before it starts is left out."""
    release, impact, last = F.col("release"), F.col("impact"), F.col("n") - 1
    at_least = lambda c, least: F.greatest(c, least)
    start, stop = at_least(release - half, F.lit(0)), F.least(last, release + half)
    gathered, followed = at_least(release - gather, F.lit(0)), F.least(last, release + follow)
    bounds = {
        "preparation": (F.lit(0), at_least(impact - 1, F.lit(0))), "last_dribble": (impact, at_least(gathered - 1, impact)),
        "gather": (gathered, at_least(start - 1, gathered)), "release": (start, stop), "follow_through": (stop + 1, followed), "recovery": (followed + 1, last),
    }
    parts = F.array(*[F.struct(F.lit(k).alias("phase"), a.cast("long").alias("phase_start"), b.cast("long").alias("phase_end")) for k, (a, b) in bounds.items()])
    return impacts.withColumn("__p", F.explode(parts)).select("*", "__p.*").drop("__p").where("phase_start <= phase_end")


def discrete_labels(df: DataFrame, by: list[str], order: list[str], x: str, names: str, least: int, gap: float, none: str = "null") -> DataFrame:
    """Adds assigned and cycle for recordings of separate actions in a fixed cycle, whose names each row has as an
    array: rows of the k-th active segment get the k-th name, over and over, and the cycle's number from 0. Other
    rows, and segments of a last cycle that is not whole, get ``none`` and -1; a recording with fewer segments than
    one cycle keeps them all."""
    found, per = adaptive(df, by, order, x, least, gap), Window.partitionBy(*by)
    found = found.withColumns({"k": F.row_number().over(per.orderBy("start")) - 1, "c": F.count(F.lit(1)).over(per)})
    rows = interval_join(df, found.select(*by, "start", "end", F.struct("k", "c").alias("at")), by, order[0], "start", "end", "at", none=None)
    k, c, size = F.col("interval_label.k"), F.col("interval_label.c"), F.size(names)
    counts = k < F.when(c < size, c).otherwise(c - c % size)
    name = F.element_at(names, (k % size + 1).cast("int"))
    return rows.withColumns({"assigned": F.coalesce(F.when(counts, name), F.lit(none)), "cycle": F.coalesce(F.when(counts, F.floor(k / size)), F.lit(-1)).cast("long")}).drop("interval_label")


def routed_labels(df: DataFrame, recordings: DataFrame, by: list[str], order: list[str], x: str, size: int, step: int, trim: int, least: int, gap: float, none: str = "null") -> DataFrame:
    """Adds assigned and cycle by the kind of each recording (…, kind, names): one action from end to end
    (continuous, the first name) or separate actions in a cycle (discrete). Rows of recordings of no known kind get
    ``none`` and -1; a recording that is listed twice is an error."""
    rows = lookup(df, recordings.select(*by, F.col("kind").alias("__kind"), F.col("names").alias("__names")), by)
    keep = [*df.columns, "assigned", "cycle"]
    whole = smeared_labels(rows.where("__kind = 'continuous'").withColumn("__name", F.col("__names")[0]), by, order, x, "__name", size, step, trim, none)
    parts = discrete_labels(rows.where("__kind = 'discrete'"), by, order, x, "__names", least, gap, none)
    rest = rows.where("coalesce(__kind NOT IN ('continuous', 'discrete'), true)").withColumns({"assigned": F.lit(none), "cycle": F.lit(-1).cast("long")})
    return whole.withColumn("cycle", F.lit(0).cast("long")).select(keep).unionByName(parts.select(keep)).unionByName(rest.select(keep))


def event_table(events: DataFrame, by: list[str], translations: dict[str, str], unit: float = 1e6) -> DataFrame:
    """The timeline as people read it: numbers from 1, seconds to two places, mean confidence to three, and the
    label in a second language, or as it is where there is no word for it."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy("start", "event"))
    second = lambda c: F.round(c / F.lit(unit), 2)
    shown = F.lit(None).cast("string")
    for a, b in translations.items():
        shown = F.when(F.col("label") == a, b).otherwise(shown)
    return events.select(
        *by, number.alias("event_id"), second(F.col("start")).alias("start_s"), second(F.col("end")).alias("end_s"), second(F.col("end") - F.col("start")).alias("duration_s"),
        "label", F.coalesce(shown, F.col("label")).alias("label_shown"), F.round("confidence", 3).alias("avg_confidence"), F.col("windows").alias("n_windows"),
    )
