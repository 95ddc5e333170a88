"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every text into a Bloom filter with two positions per text and keeps the positions
that at least two rows set. Pass two tests each row against that bitmap: a row of which one position
was set once cannot have a copy and passes straight through; only the others shuffle, by the SHA-256
of their text, so false positives cost work and never change a result. A large group of copies is
dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import is_set, joined_evenly, table, text_of, without_white_space, written

#: Filter positions for each row and hash function; more lower the share of rows that shuffle in vain.
POSITIONS_PER_ROW = 16
#: Most positions of one hash function. Both bitmaps together are then 128 MB at most, so the broadcast
#: has a fixed bound; beyond some 500 million rows more rows shuffle, with the same result.
MOST_POSITIONS = 1 << 29

_PER_BITMAP = 32768


def _positions(h: Column, m: int) -> list[Column]:
    """Two positions from the halves of a 64-bit hash, the second in a range of its own."""
    return [F.pmod(h, F.lit(m)) + 1, F.pmod(F.shiftrightunsigned(h, 32), F.lit(m)) + m + 1]


def repeated_positions(hashes: DataFrame, m: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the positions that two rows or more set. ``hashes`` has column h."""
    return (
        hashes.select(F.explode(F.array(*_positions(F.col("h"), m))).alias("at"))
        .groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    )


def _filter(df: DataFrame, text_col: str) -> tuple[int, DataFrame]:
    """Pass one: positions of one hash function, and the bitmaps as a table."""
    rows = max(1, df.count())
    m = min(MOST_POSITIONS, max(_PER_BITMAP, 1 << (POSITIONS_PER_ROW * rows - 1).bit_length()))
    hashes = df.select(F.xxhash64(without_white_space(text_of(text_col))).alias("h"))
    return m, F.broadcast(written(repeated_positions(hashes, m), "bitmaps"))


def _tested(df: DataFrame, m: int, bitmaps: DataFrame) -> DataFrame:
    """Pass two: ``df`` with __norm replaced by __sha and __maybe, whether the filter has both of its positions."""
    first, second = _positions(F.xxhash64("__norm"), m)
    rows, keep = df.withColumns({"__a": first, "__b": second, "__sha": F.sha2("__norm", 256)}), [c for c in df.columns if c != "__norm"]
    for at in ("__a", "__b"):
        bits = bitmaps.select(F.col("bucket").alias(f"{at}_bucket"), F.col("bits").alias(f"{at}_bits"))
        rows = rows.join(bits, F.bitmap_bucket_number(at) == F.col(f"{at}_bucket"), "left")
    return rows.select(*keep, "__sha", (is_set(F.col("__a_bits"), F.col("__a")) & is_set(F.col("__b_bits"), F.col("__b"))).alias("__maybe"))


def _rank(row: str) -> Column:
    """What stays of a group is the least of this: the longest, then the smallest id, a null id last."""
    return F.struct((-F.col("__len")).alias("len"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col(row).alias("row"))


def one_of_equal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with all their columns, whose names must not start with two
    underscores. No table of texts is written: rows that the filter rules out pass through, and of the others
    those that stay are found by their rank. Rows that repeat one row in every column give one."""
    m, bitmaps = _filter(df, text_col)
    text = text_of(text_col)
    other = F.xxhash64(F.to_json(F.struct(*[c for c in df.columns if c not in (id_col, text_col)], F.lit(1).alias("__one"))), text)
    mine = df.withColumns({"__id": F.col(id_col), "__len": F.char_length(text), "__norm": without_white_space(text), "__row": other})
    tested = _tested(mine, m, bitmaps)
    maybe, own = tested.where("__maybe"), [F.col(c) for c in df.columns]
    best = written(maybe.groupBy("__sha").agg(F.count(F.lit(1)).alias("__size"), F.min(_rank("__row")).alias("__best")), "best")
    stay = joined_evenly(maybe, best, "__sha", "__size", ["__id", "__row"]).where(_rank("__row") == F.col("__best")).dropDuplicates(["__sha"])
    return tested.where("NOT __maybe").select(*own).unionByName(stay.select(*own))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``carry`` columns, then doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts the
    row with the most code points in its original text stays, then the smallest id, a null id last.
    Rows that tie in all of this are repeats of one row: exactly one of them is kept. An empty table
    gives an empty result; other columns play no part, whatever their names.
    """
    m, bitmaps = _filter(df, text_col)
    text, carried = text_of(text_col), [f"__c{i}" for i in range(len(carry))]
    mine = df.select(
        *[F.col(c).alias(n) for c, n in zip(carry, carried)], F.col(id_col).alias("__id"),
        F.char_length(text).alias("__len"), without_white_space(text).alias("__norm"),
    )
    tested = written(_tested(mine, m, bitmaps).withColumn("__row", F.monotonically_increasing_id()), "bloom")
    maybe, alone = tested.where("__maybe"), tested.where("NOT __maybe")
    best = written(maybe.groupBy("__sha").agg(
        F.count(F.lit(1)).alias("group_size"), F.count(F.lit(1)).alias("__size"),
        F.min(_rank("__row")).alias("__best"),
    ), "best")
    out = ["__id", "keep_id", "group_size", "kept", "__sha"]
    grouped = joined_evenly(maybe, best, "__sha", "__size", ["__row"]).select(
        *carried, "__id", F.col("__best")["id"].alias("keep_id"), "group_size",
        (F.col("__best")["row"] == F.col("__row")).alias("kept"), "__sha",
    )
    whole = grouped.unionByName(alone.select(*carried, "__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__sha"))
    return whole.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias({"__id": "doc_id", "__sha": "text_sha256"}.get(c, c)) for c in out])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
