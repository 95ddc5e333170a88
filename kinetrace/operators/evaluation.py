"""Model evaluation, feature ranking and class statistics in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import share_of


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """A count for every pair of classes, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"truth {df.schema[truth].dataType.simpleString()}, predicted {df.schema[predicted].dataType.simpleString()}")
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where a class has no row on a side."""
    side = lambda c: F.col(c).cast("string")
    each = df.select(F.explode(F.array(
        F.struct(side(truth).alias("label"), (side(truth) == side(predicted)).cast("int").alias("tp"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(side(predicted).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e")).select("e.*")
    sums = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("found"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, t, p = F.col("tp"), F.col("support"), F.col("found")
    return sums.select("label", "tp", "support", "found", ratio(tp, p).alias("precision"), ratio(tp, t).alias("recall"), ratio(2 * tp, t + p).alias("f1"))


def overall_scores(df: DataFrame, truth: str, predicted: str, none: str | None = None) -> DataFrame:
    """Accuracy, macro-F1, and macro-F1 without the class ``none``."""
    s = class_scores(df, truth, predicted)
    action = F.avg(F.when(F.col("label") != none, F.col("f1"))) if none is not None else F.avg("f1")
    return s.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), action.alias("action_f1"))


def threshold_scan(df: DataFrame, truth: str, predicted: str, p: str, thresholds: list[float], most_rejected: float = 0.3) -> DataFrame:
    """Accuracy of what each threshold leaves, and its share rejected; ``chosen`` is the most accurate that
    rejects no more than allowed, the lowest of equals. All thresholds in one pass."""
    cut = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    keep = F.col(p) >= F.col("threshold")
    rows = df.select(truth, predicted, p, cut).groupBy("threshold").agg(
        F.avg((~keep).cast("double")).alias("rejected"), F.sum((keep & (F.col(truth) == F.col(predicted))).cast("int")).alias("right"), F.sum(keep.cast("int")).alias("kept"))
    rows = rows.withColumn("accuracy", F.when(F.col("kept") > 0, F.col("right") / F.col("kept")).otherwise(0.0))
    fits = F.col("rejected") <= most_rejected
    order = Window.orderBy(F.when(fits, 0).otherwise(1), F.desc("accuracy"), "threshold")  # one row for each threshold
    return rows.withColumn("chosen", fits & (F.row_number().over(order) == 1)).drop("right", "kept")


def working_point(df: DataFrame, truth: str, predicted: str, p: str, thresholds: list[float], none: str, most_rejected: float = 0.3) -> DataFrame:
    """Share rejected and macro-F1 over rows and classes of action at each threshold; ``chosen`` is the best F1 that
    rejects no more than allowed, or the best of all where none does, the lowest threshold of equals. Classes that
    neither side has count as 0. All thresholds and classes in one pass."""
    side = lambda c: F.col(c).cast("string")
    cuts, keep = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), F.col(p) >= F.col("threshold")
    rows = df.select(side(truth).alias("t"), side(predicted).alias("q"), p, cuts).withColumn("keep", F.coalesce(keep, F.lit(False)))
    cells = rows.groupBy("threshold", "t", "q").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("keep").cast("int")).alias("kept"))
    shares = cells.groupBy("threshold").agg((1 - F.sum("kept") / F.sum("n")).alias("rejected"))
    inner = F.when(F.col("t") != none, F.col("kept")).otherwise(0)
    each = cells.select("threshold", F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("q"), inner).otherwise(0).alias("tp"), inner.alias("all")),
        F.struct(F.col("q").alias("label"), F.lit(0).cast("long").alias("tp"), inner.alias("all")))).alias("e")).select("threshold", "e.*").where(F.col("label") != none)
    f1 = each.groupBy("threshold", "label").agg(F.sum("tp").alias("tp"), F.sum("all").alias("all"))
    f1 = f1.groupBy("threshold").agg(F.avg(F.when(F.col("all") > 0, 2 * F.col("tp") / F.col("all")).otherwise(0.0)).alias("action_f1"))
    out = shares.join(f1, "threshold", "left").na.fill(0.0, ["action_f1"])
    order = Window.orderBy(F.when(F.col("rejected") <= most_rejected, 0).otherwise(1), F.desc(F.round("action_f1", 12)), "threshold")  # one row for each threshold
    return out.withColumn("chosen", F.row_number().over(order) == 1)


def long_form(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("feature", "x")).withColumn("x", F.col("x").cast("double"))


def anova_f(long: DataFrame, label: str) -> DataFrame:
    """F statistic of each feature between classes, from sums of squares."""
    g = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return s.select("feature", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def t_statistic(long: DataFrame, label: str, a, b) -> DataFrame:
    """Equal-variance t of each feature between two classes."""
    g = long.where(F.col(label).isin(a, b)).groupBy("feature")
    one = lambda c, f: f(F.when(F.col(label) == c, F.col("x")))
    s = g.agg(one(a, F.count).alias("na"), one(b, F.count).alias("nb"), one(a, F.avg).alias("ma"), one(b, F.avg).alias("mb"), one(a, F.var_samp).alias("va"), one(b, F.var_samp).alias("vb"))
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2)
    return s.select("feature", ((F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"))


def cohens_d(long: DataFrame, label: str) -> DataFrame:
    """Standardised difference of each feature for each pair of classes; the pairs are of classes, not rows."""
    g = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    a, b = g.alias("a"), g.alias("b")
    pooled = F.sqrt(((F.col("a.n") - 1) * F.col("a.v") + (F.col("b.n") - 1) * F.col("b.v")) / (F.col("a.n") + F.col("b.n") - 2))
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col(f"a.{label}") < F.col(f"b.{label}")))
    return pairs.select(F.col("a.feature").alias("feature"), F.col(f"a.{label}").alias("class_a"), F.col(f"b.{label}").alias("class_b"), ((F.col("a.m") - F.col("b.m")) / pooled).alias("d"))


def rank_by(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """Places from 1 by falling score; the table is one of features, so one task orders it."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), tie)))


def bhattacharyya(long: DataFrame, label: str) -> DataFrame:
    """Distance of each pair of classes, features taken as independent normals and added."""
    g = long.groupBy("feature", label).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    a, b = g.alias("a"), g.alias("b")
    va, vb = F.col("a.v") + 1e-9, F.col("b.v") + 1e-9
    one = 0.25 * F.pow(F.col("a.m") - F.col("b.m"), 2) / (va + vb) + 0.5 * F.log((va + vb) / (2 * F.sqrt(va * vb)))
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col(f"a.{label}") < F.col(f"b.{label}")))
    return pairs.groupBy(F.col(f"a.{label}").alias("class_a"), F.col(f"b.{label}").alias("class_b")).agg(F.sum(one).alias("distance"))


def silhouette(sample: DataFrame, others: DataFrame) -> DataFrame:
    """(qid, label, s) of each row of a stated sample (qid, v, label) against all ``others`` (id, v, label).

    Distances of a query to a class are summed in the blocks in which they are made.
    """
    from kinetrace.operators.joins import _matrix, by_blocks, squared_distances

    kind = lambda c: sample.schema[c].dataType.simpleString()

    def use(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = {"qid": [], "own": [], "label": [], "far": [], "n": []}
        if not len(q) or not len(r):
            return pd.DataFrame(names)
        x, out = _matrix(r["v"]), []
        for i in range(0, len(q), 256):
            part = q.iloc[i : i + 256]
            d = np.sqrt(squared_distances(_matrix(part["qv"]), x))
            other = r["id"].to_numpy()[None] != part["qid"].to_numpy()[:, None]
            for label, at in r.reset_index(drop=True).groupby("label").groups.items():
                k = np.asarray(at)
                out.append(pd.DataFrame({"qid": part["qid"].to_numpy(), "own": part["own"].to_numpy(), "label": label, "far": (d[:, k] * other[:, k]).sum(1), "n": other[:, k].sum(1)}))
        return pd.concat(out)

    parts = by_blocks(sample.select("qid", F.col("v").alias("qv"), F.col("label").alias("own")), others.select("id", "v", "label"), use, f"qid {kind('qid')}, own {kind('label')}, label {kind('label')}, far double, n long")
    to = parts.groupBy("qid", "own", "label").agg((F.sum("far") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    best = to.groupBy("qid", "own").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("own"), F.col("d"))).alias("b"))
    return best.select("qid", F.col("own").alias("label"), F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def fold(key: Column, folds: int) -> Column:
    """A split that is the same in every run."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int")


def hashed_share(key: Column, share: float) -> Column:
    """True for about a share of all keys, the same in every run; drawn without regard to the label, so that each
    class is split alike."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32 < share


def split_recordings(df: DataFrame, recording: str, share: float = 0.7) -> DataFrame:
    """Adds train: whole recordings, the given share of their number rounded down, in an order that a hash of the
    name decides. Rows of no recording are in neither part (null). Recordings are few beside their rows."""
    names = df.where(F.col(recording).isNotNull()).groupBy(recording).agg(F.md5(F.col(recording).cast("string").cast("binary")).alias("h"))
    w = Window.partitionBy(F.lit(0))
    placed = names.select(F.col(recording).alias("__rec"), (F.row_number().over(w.orderBy("h")) <= share_of(share, F.count(F.lit(1)).over(w))).alias("train"))
    return df.join(placed, F.col(recording) == F.col("__rec"), "left").drop("__rec")


def repetition_fold(discrete: Column, repetition: Column, key: Column) -> Column:
    """Two folds: by odd and even repetitions where actions are separate, by a hash of the recording elsewhere."""
    return F.when(discrete, F.pmod(F.coalesce(repetition, F.lit(0)), F.lit(2)).cast("int")).otherwise(fold(key, 2))


def _smallest(df: DataFrame, h: str, wanted: int) -> tuple[int, int]:
    """(value, rest) of a column of longs: all rows below the value and ``rest`` of those at it are the ``wanted`` smallest.
    Four passes, each over the counts of at most 65,536 ranges."""
    at, rest = 0, wanted
    for bits in (48, 32, 16, 0):
        rows = df if bits == 48 else df.where(F.shiftright(h, bits + 16) == at)
        for r in rows.groupBy(F.shiftright(h, bits).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():
            if r["n"] >= rest:
                at = r["range"]
                break
            rest -= r["n"]
    return at, rest


def undersampled(df: DataFrame, label: str, none: str, key: str, ratio: float = 1.5) -> DataFrame:
    """Keeps exactly ``ratio`` times the largest other class of the class ``none``, rounded down, or all of it if it has no more:
    the rows with the smallest hashes of the key and all columns. All other rows stay, null labels among them.

    Rows that repeat have one hash. Where the last of those kept repeats, one copy is multiplied to the number that
    stays, so neither their sort nor their rows go through one task.
    """
    one = F.col(label).eqNullSafe(F.lit(none))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.when(~one & F.col(label).isNotNull(), F.col("n"))).alias("most"), F.max(F.when(one, F.col("n"))).alias("of")).first()
    cut, there = int((sizes["most"] or 0) * ratio), sizes["of"] or 0
    rest, mine = df.where(~one), df.where(one)
    if there <= cut:
        return df
    if not cut:
        return rest
    hashed = mine.withColumn("__h", F.xxhash64(F.col(key).cast("string"), *df.columns))
    last, left = _smallest(hashed, "__h", cut)
    same = hashed.where(F.col("__h") == last).groupBy(F.to_json(F.struct(*df.columns)).alias("__row")).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*df.columns)).alias("__one"))
    so_far = F.sum("__n").over(Window.orderBy("__row"))  # rows that differ and share a hash of 64 bits: one, as good as always
    taken = same.withColumn("__take", F.least(F.col("__n"), F.lit(left) - so_far + F.col("__n"))).where("__take > 0")
    blocks = taken.select("__one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__take") - 1, F.lit(10_000).cast("long"))).alias("__from"), "__take").repartition("__from")
    copies = blocks.select("__one.*", F.explode(F.sequence("__from", F.least(F.col("__take"), F.col("__from") + 10_000) - 1)).alias("__k")).drop("__k")
    return rest.unionByName(hashed.where(F.col("__h") < last).drop("__h")).unionByName(copies)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k · n_c) of each class."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return g.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
