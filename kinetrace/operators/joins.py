"""Joins on intervals, nearest times, places and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.operators.resample import both_ways


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, label: str, none: str = "unknown") -> DataFrame:
    """Adds the label of the first interval, ends included, that holds each point; ``none`` where none does. First
    is the earliest start, and of equal starts the smallest label.

    What an interval has before the earlier ones end is theirs, so each keeps the part after the farthest end
    before it. These parts become change points in the points' own partitions: the work is two sorts and not a
    product of points and intervals.
    """
    s = intervals.select(*by, F.col(start).cast("double").alias("__s"), F.col(end).cast("double").alias("__e"), F.col(label).alias("__l"))
    before = F.max("__e").over(Window.partitionBy(*by).orderBy("__s", "__l", "__e").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__e") > F.col("__b")))
    after = F.coalesce(F.col("__b") >= F.col("__s"), F.lit(False))  # the part starts just after an earlier end
    s = s.select(*by, F.when(after, F.col("__b")).otherwise(F.col("__s")).alias("__at"), F.when(after, 2).otherwise(0).alias("__kind"), F.struct(F.col("__e").alias("end"), F.col("__l").alias("label")).alias("__open"))
    p = points.withColumns({"__at": F.col(at).cast("double"), "__kind": F.lit(1)})
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = p.unionByName(s, allowMissingColumns=True).withColumn("__open", F.last("__open", True).over(w)).where("__kind = 1")
    inside = F.col("__at") <= F.col("__open.end")
    return rows.withColumn("interval_label", F.coalesce(F.when(inside, F.col("__open.label")), F.lit(none))).drop("__at", "__kind", "__open")


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Adds the value of the right row nearest in time, the earlier of equals, and its distance.

    Both sides share one sort; the last row before and the first row after are the only candidates.
    """
    rows = left.withColumn("__r", F.lit(None).cast("struct<t:double,v:double>")).withColumn("__left", F.lit(True)).unionByName(
        right.select(*by, F.col(t), F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("__r"), F.lit(False).alias("__left")), allowMissingColumns=True)
    now = F.col(t).cast("double")
    back, ahead = both_ways(by, [now, F.col("__left")])
    rows = rows.withColumns({"__b": F.last("__r", True).over(back), "__a": F.last("__r", True).over(ahead)}).where("__left")
    db, da = now - F.col("__b.t"), F.col("__a.t") - now
    first = F.when(da.isNull() | (db <= da), F.col("__b")).otherwise(F.col("__a"))
    best = F.coalesce(first, F.col("__a"), F.col("__b"))
    return rows.withColumns({"nearest": best["v"], "distance": F.abs(best["t"] - now)}).drop("__r", "__left", "__b", "__a")


def not_overlapping(windows: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """Windows (start, end) that touch no region (rs, re) of their partition: of the regions that start by a window's
    end, the farthest end lies before its start. One sort of both, not a product."""
    r = regions.select(*by, F.col("rs").cast("double").alias("__at"), F.lit(0).alias("__kind"), F.col("re").cast("double").alias("__re"))
    rows = windows.withColumns({"__at": F.col("end").cast("double"), "__kind": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__re", F.max("__re").over(w)).where("__kind = 1")
    return rows.where(F.col("__re").isNull() | (F.col("__re") < F.col("start"))).drop("__at", "__kind", "__re")


def nearest_event(left: DataFrame, events: DataFrame, by: list[str], t: str, label: str, most: float) -> DataFrame:
    """Adds the label of the nearest event of the partition, the earlier of equals, or null where none is within
    ``most``, and its distance."""
    names = events.groupBy(*by, t).agg(F.min(label).alias("__label"))
    both = nearest_join(left, names.withColumn("__at", F.col(t)), by, t, "__at")
    near = both.withColumn("__at", F.when(F.col("distance") <= most, F.col("nearest")).cast("long")).drop("nearest")
    named = names.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(t).alias("__t"), F.col("__label").alias("event"))
    return near.join(named, [*[F.col(c) == F.col(f"__{c}") for c in by], F.col("__at") == F.col("__t")], "left").drop("__at", "__t", *[f"__{c}" for c in by])


def zip_join(a: DataFrame, b: DataFrame, by: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """The k-th row of one with the k-th of the other, up to the shorter."""
    k = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return a.withColumn("k", k(order_a)).join(b.withColumn("k", k(order_b)), [*by, "k"])


def lookup(facts: DataFrame, table: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Equi-join with a table that must have each key once: a repeated key is an error when the result is computed.
    Spark broadcasts the table if its size allows."""
    rest = [c for c in table.columns if c not in key]
    once = table.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__v"))
    checked = F.when(F.col("__n") == 1, F.col("__v")).otherwise(F.raise_error(F.lit(f"keys {key} repeat in the lookup table")))
    return facts.join(once.withColumn("__v", checked).select(*key, *[F.col("__v")[c].alias(c) for c in rest]), key, how)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: Vectors of a block: a task compares one block of queries with one of rows.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 4096, 20_000


def by_blocks(queries: DataFrame, rows: DataFrame, use: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], kinds: str) -> DataFrame:
    """``use`` on each block of ``queries`` (qid, qv, …) with each of ``rows`` (id, v, label). Blocks are dealt by a
    hash of the id; a query travels once for each block of rows and a row once for each block of queries, so
    memory is bounded and the plan has one shape at every size."""
    many = lambda df, most: max(1, -(-df.count() // most))
    nq, nr = many(queries, QUERIES_AT_ONCE), many(rows, ROWS_AT_ONCE)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumns({"__q": F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int"), "__r": every(nr)})
    r = rows.withColumn("__r", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("__q", every(nq))
    return q.groupBy("__q", "__r").cogroup(r.groupBy("__q", "__r")).applyInPandas(use, kinds)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """[queries, rows] by one matrix product."""
    return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0)


def _closest(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k rows of a block nearest to each query of it."""
    def use(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame()
        x, ids, label, names = _matrix(r["v"]), r["id"].to_numpy(), r["label"].to_numpy(), q["qid"].to_numpy()
        out = []
        for i in range(0, len(q), 256):
            v, mine = _matrix(q["qv"].iloc[i : i + 256]), names[i : i + 256]
            rough = squared_distances(v, x)
            last = min(len(x) - 1, k)  # one more, as a query may be a row itself
            kth = np.partition(rough, last, 1)[:, last]
            to, at = np.nonzero(rough <= (kth + 1e-6 * (1 + kth))[:, None])  # all that tie with the last are in
            other = ids[at] != mine[to]
            to, at = to[other], at[other]
            d = np.round(((x[at] - v[to]) ** 2).sum(1), 9)
            order = np.lexsort((ids[at], d, to))
            to, at, d = to[order], at[order], d[order]
            first = np.arange(len(to)) - np.searchsorted(to, to) < k
            out.append((mine[to[first]], at[first], d[first]))
        qid, at, d = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"qid": qid, "id": ids[at], "label": label[at], "d": d})

    return use


def nearest_neighbours(queries: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(qid, label, votes): majority label of the k nearest rows of ``train`` (id, v, label) to each of ``queries``
    (qid, v), the smallest label of equals; a query never counts itself. Of equal distances (to nine decimals)
    the smaller id is nearer. A block leaves k rows for each query."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = by_blocks(queries.select("qid", F.col("v").alias("qv")), train.select("id", "v", "label"), _closest(k), f"qid {kind(queries, 'qid')}, id {kind(train, 'id')}, label {kind(train, 'label')}, d double")
    return _voted(found, k)


def _voted(found: DataFrame, k: int) -> DataFrame:
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "id"))).where(F.col("r") <= k)
    votes = near.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("qid").agg(F.min(F.struct((-F.col("votes")).alias("n"), F.col("label").alias("label"))).alias("b")).select("qid", F.col("b.label").alias("label"), (-F.col("b.n")).alias("votes"))


class Ring(NamedTuple):
    """Rows that have one pivot nearest, at distances from lo to hi of it."""

    cell: int
    lo: float
    hi: float
    n: int


#: Rings of a cell, and the most pivots; a task holds a part of a ring of ROWS_AT_ONCE rows.
RINGS, MOST_PIVOTS, SLACK = 8, 1024, 1e-6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(squared_distances(a, b))


def ringed(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell, the nearest pivot, and far, the distance to it."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("v").to_pylist(), float)
                cell = squared_distances(x, pivots).argmin(1)
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return train.mapInArrow(run, f"{kinds}, cell int, far double")


def pruned_neighbours(queries: DataFrame, train: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(the result of ``nearest_neighbours``, (rows, computed)): exact neighbours where most distances are never computed, and
    of each query how many rows there are and how many were compared.

    Pivots are rows chosen by a hash, one for each block of rows. A row is in the cell of its nearest pivot, in a ring
    of distances to it. By the triangle inequality a ring has a least and a most distance to a query; rings that
    surely hold k rows bound the k-th distance, and rings beyond it are left out. What reaches the driver is a
    few numbers for each ring.
    """
    rows = train.select("id", "v", "label").where(F.col("v").isNotNull())
    n = rows.count()
    wanted = min(MOST_PIVOTS, max(1, round(n**0.5 / 4)))
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
    if not pivots:
        none = nearest_neighbours(queries, train, k)
        return none, queries.select("qid", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("computed"))
    at = np.array([r["v"] for r in pivots], float)
    placed = ringed(rows, at)
    spread = placed.groupBy("cell").agg(F.max("far").alias("most")).collect()
    width = np.zeros(len(at))
    for r in spread:
        width[r["cell"]] = r["most"] / RINGS
    widths = F.array(*[F.lit(float(w)) for w in width])
    step = F.element_at(widths, F.col("cell") + 1)
    placed = placed.withColumn("ring", F.when(step > 0, F.least(F.floor(F.col("far") / step), F.lit(RINGS - 1))).otherwise(0).cast("int"))
    found = placed.groupBy("cell", "ring").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell", "ring").collect()
    rings = [Ring(r["cell"], r["lo"], r["hi"], r["n"]) for r in found]
    number = {(r["cell"], r["ring"]): i for i, r in enumerate(found)}
    cell, lo, hi, size = (np.array([getattr(r, f) for r in rings]) for f in ("cell", "lo", "hi", "n"))
    parts = np.maximum(1, -(-size // ROWS_AT_ONCE))
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                d = _distances(_matrix(part["qv"]), at)[:, cell]
                least, most = np.maximum(np.maximum(d - hi, lo - d), 0), d + hi
                order = most.argsort(1)
                enough = (np.cumsum(size[order], 1) >= k + 1).argmax(1)  # one more, as a query may be a row itself
                bound = np.take_along_axis(most, order, 1)[np.arange(len(part)), np.where(size.sum() >= k + 1, enough, len(size) - 1)]
                q, r = np.nonzero(least <= bound[:, None] + SLACK)
                yield pd.DataFrame({"qid": part["qid"].to_numpy()[q], "qv": part["qv"].to_numpy()[q], "block": r.astype("int32"), "n": size[r]})

    asked = queries.select("qid", F.col("v").alias("qv")).where("qv IS NOT NULL").mapInPandas(visits, f"qid {kind(queries, 'qid')}, qv {kind(queries, 'v')}, block int, n long")
    every = F.array(*[F.lit(int(p)) for p in parts])
    blocks = F.create_map(*[F.lit(x) for (c, g), i in number.items() for x in (c * RINGS + g, i)])
    dealt = placed.withColumn("block", blocks[F.col("cell") * RINGS + F.col("ring")])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(every, F.col("block") + 1)).cast("int")).select("id", "v", "label", "block", "part")
    sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(every, F.col("block") + 1) - 1)))
    near = sent.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(_closest(k), f"qid {kind(queries, 'qid')}, id {kind(train, 'id')}, label {kind(train, 'label')}, d double")
    return _voted(near, k), asked.groupBy("qid").agg(F.lit(n).cast("long").alias("rows"), F.sum("n").alias("computed"))
