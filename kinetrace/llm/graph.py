"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.common import joined_evenly, written

#: A pass over few links is cut into few tasks, whatever the session's number of shuffle partitions.
LINKS_PER_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), the root being the smallest node that it reaches.

    Large-star and small-star passes in turn until nothing changes; every pass pre-aggregates each node's
    smallest neighbour and joins it back from a table of its own; the edges of a node with very many neighbours
    are dealt over many tasks. Loops are left out; repeated links count once; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    few = max(1, -(-edges.count() // LINKS_PER_TASK))  # tasks that these links are worth

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df.coalesce(few), name)

    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")).select("a", F.least("m", "a").alias("m"), "size"), "star")
        large = joined_evenly(both, least, "a", "size", ["b"]).where((b > a) & (b != F.col("m"))).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = kept(large, "star")
        least = kept(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")), "star")
        joined = joined_evenly(large, least, "a", "size", ["b"])
        small = joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        edges = kept(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return nodes.join(edges.select("a", F.col("b").alias("root")), F.col("node") == a, "left").select("node", F.coalesce("root", "node").alias("root"))
