"""Sharding by minimax contiguous partition.

Equal texts share one atomic group: a bucket of the text's hash. The bucket sizes, a vector whose length
is a parameter and not a function of the corpus, are kept in hash order; a binary search finds the
smallest capacity with which a greedy pass over them needs no more than the wanted number of shards. The
cuts keep to that capacity: a shard closes when the next group would pass it, or at an even share if the
rest then fits into the other shards. A group that outweighs a shard takes a shard, and the others are
spread evenly over the rest. Everything is built-in functions: the searches are folds inside one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinetrace.llm.common import table, text_of, written

#: Atomic groups of texts. Sizes are near equal up to one group, so 16 shards of 65,536 groups differ by
#: well under one per cent unless one group of equal texts outweighs a shard.
GROUPS = 65536
#: The rows of a group are numbered in so many parts by a hash of their id, so that a group of very many copies
#: does not go to one task. The parts of all groups are counted in a table of GROUPS * PARTS rows at most.
PARTS = 256


def _greedy(sizes: Column, capacity: Column) -> Column:
    """Number of shards that a greedy pass with this capacity opens."""
    zero = F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("filled"))

    def step(acc: Column, size: Column) -> Column:
        fits = acc["filled"] + size <= capacity
        return F.struct(F.when(fits, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(fits, acc["filled"] + size).otherwise(size).alias("filled"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["n"])


def smallest_capacity(sizes: Column, shards: int) -> Column:
    """Binary search between the largest group and the total; 62 halvings settle any long."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(F.coalesce(F.array_max(sizes), F.lit(0).cast("long")).alias("lo"), F.coalesce(total, F.lit(0).cast("long")).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = acc["lo"] + F.shiftright(acc["hi"] - acc["lo"], 1)
        fits = _greedy(sizes, mid) <= shards
        done = acc["lo"] >= acc["hi"]
        return F.when(done, acc).otherwise(F.struct(F.when(fits, acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(fits, mid).otherwise(acc["hi"]).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, halve, lambda acc: acc["hi"])


def last_starts(sizes: Column, capacity: Column) -> Column:
    """For k = 1, 2, ... the first group, from 0, from which on all groups fit into k shards: where a greedy pass
    from the end cuts."""
    n = F.size(sizes)
    zero = F.struct(n.alias("at"), F.lit(0).cast("long").alias("filled"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, size: Column) -> Column:
        fits = acc["filled"] + size <= capacity
        return F.struct(
            (acc["at"] - 1).alias("at"), F.when(fits, acc["filled"] + size).otherwise(size).alias("filled"),
            F.when(fits, acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(acc["at"]))).alias("cuts"),
        )

    return F.aggregate(F.reverse(sizes), zero, step, lambda acc: F.concat(acc["cuts"], F.array(F.lit(0))))


def even_share(sizes: Column, shards: int) -> Column:
    """The share of a shard once groups that outweigh it have shards of their own."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)

    def again(share: Column, _: Column) -> Column:
        small = F.filter(sizes, lambda x: x <= share)
        rest = F.aggregate(small, F.lit(0).cast("double"), lambda a, x: a + x)
        return F.when(F.size(small) == F.size(sizes), share).otherwise(F.least(share, rest / F.greatest(F.lit(shards) - F.size(sizes) + F.size(small), F.lit(1))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), total / F.lit(float(shards)), again)


def _run_sizes(all_groups: Column) -> Column:
    """Sizes of the runs of groups between the large ones; a run without groups counts nothing."""
    zero = F.struct(F.lit(True).alias("after"), F.array().cast("array<long>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["runs"])
        grown = F.concat(F.slice(acc["runs"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.coalesce(F.try_element_at(acc["runs"], F.greatest(n, F.lit(1))), F.lit(0)) + x["size"]))
        runs = F.when(x["large"], acc["runs"]).when(acc["after"], F.concat(acc["runs"], F.array(x["size"]))).otherwise(grown)
        return F.struct(x["large"].alias("after"), runs.alias("runs"))

    return F.aggregate(all_groups, zero, step, lambda acc: acc["runs"])


def shard_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First group of each shard after the first. ``groups`` has (g, size), one row per group: at most
    ``GROUPS`` rows, so one row of arrays is bounded; the result has fewer than ``shards`` numbers.

    Every shard keeps to the smallest capacity. Groups over the even share get shards of their own; each run of
    others between them is cut into its share of the shards that are left, as evenly as groups allow.
    """
    one = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct("g", "size"))).alias("all"))
    one = one.withColumn("sizes", F.transform("all", lambda x: x["size"]))
    one = one.withColumn("capacity", smallest_capacity(F.col("sizes"), shards)).withColumn("share", even_share(F.col("sizes"), shards))
    one = one.withColumn("starts", last_starts(F.col("sizes"), F.col("capacity")))
    one = one.withColumn("all", F.transform("all", lambda x: F.struct(x["g"].alias("g"), x["size"].alias("size"), (x["size"] > F.col("share")).alias("large"))))
    one = one.withColumn("runs", _run_sizes(F.col("all")))
    long, add = F.lit(0).cast("long"), lambda a, x: a + x
    zero = F.struct(
        F.lit(0).alias("at"), long.alias("filled"), F.lit(True).alias("large"), F.lit(0).alias("run"), long.alias("run_left"), long.alias("run_shards"),
        F.aggregate("runs", long, add).alias("small_left"), F.size(F.filter("all", lambda x: x["large"])).alias("large_left"), F.array().cast("array<long>").alias("cuts"),
        *[F.col(c).alias(c) for c in ("capacity", "starts", "runs")],  # in the state, so that no step computes them again
    )

    def step(acc: Column, x: Column) -> Column:
        others = F.lit(shards - 1) - F.size(acc["cuts"])  # shards after the open one
        rest_fits = (others > 0) & (acc["at"] >= F.coalesce(F.try_element_at(acc["starts"], F.greatest(others, F.lit(1))), F.lit(0)))
        even = (acc["run_shards"] > 1) & ((2 * acc["filled"] + x["size"]) * acc["run_shards"] >= 2 * acc["run_left"])
        close = (acc["filled"] > 0) & ((acc["filled"] + x["size"] > acc["capacity"]) | (rest_fits & (x["large"] | acc["large"] | even)))
        enters = acc["large"] & ~x["large"]
        run = F.coalesce(F.try_element_at(acc["runs"], acc["run"] + 1), long)
        free = others + F.when(close, 0).otherwise(1) - acc["large_left"]  # shards for all groups from here on that are not large
        wanted = F.greatest(F.lit(1).cast("long"), F.round(run * free / F.greatest(acc["small_left"], F.lit(1))).cast("long"))
        inside = close & ~acc["large"]
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(close, x["size"]).otherwise(acc["filled"] + x["size"]).alias("filled"), x["large"].alias("large"),
            F.when(enters, acc["run"] + 1).otherwise(acc["run"]).alias("run"),
            F.when(enters, run).when(inside, acc["run_left"] - acc["filled"]).otherwise(acc["run_left"]).alias("run_left"),
            F.when(enters, wanted).when(inside, acc["run_shards"] - 1).otherwise(acc["run_shards"]).alias("run_shards"),
            F.when(enters, acc["small_left"] - run).otherwise(acc["small_left"]).alias("small_left"),
            F.when(x["large"], acc["large_left"] - 1).otherwise(acc["large_left"]).alias("large_left"),
            F.when(close, F.concat(acc["cuts"], F.array(x["g"].cast("long")))).otherwise(acc["cuts"]).alias("cuts"),
            *[acc[c].alias(c) for c in ("capacity", "starts", "runs")],
        )

    return one.select(F.aggregate("all", zero, step, lambda acc: acc["cuts"]).alias("cuts")).first()["cuts"]


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``bytes``.

    size is the text's UTF-8 bytes plus one; a null text has none and CRC 0, and is equal to an empty one.
    Equal texts share a shard. slot numbers the rows of a shard from 0 without gaps, by group, then by a hash
    of the id and the id itself; repeated rows get slots of their own. With fewer groups than shards some
    shards stay empty; an empty table gives no rows. Other columns play no part, whatever their names.
    """
    text = text_of(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(GROUPS)).cast("int").alias("g"), F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(PARTS)).cast("int").alias("part"),
    )
    parts = written(rows.groupBy("g", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "parts")
    cuts = shard_cuts(parts.groupBy("g").agg(F.sum("size").alias("size")), shards)
    of = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("g"))) if cuts else F.lit(0)
    before = Window.partitionBy("shard").orderBy("g", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("shard", of.cast("int")).select("g", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("g", "part").orderBy("doc_id", "text_crc32"))
    return (
        rows.withColumn("i", number).join(starts, ["g", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("i") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
