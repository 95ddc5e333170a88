"""Reading tables, shared-folder tables and text normalisation used by the corpus operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) is one made under the temp folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "kinetrace-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


_recorded: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Gives the paths of the tables that ``written`` makes meanwhile."""
    _recorded.append([])
    try:
        yield _recorded[-1]
    finally:
        _recorded.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that no result needs any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage and survives lost
    executors. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinetrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # texts stay on the shared disk until the run ends
    for paths in _recorded:
        paths.append(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table of what ``build`` returns. Tables that ``build`` wrote meanwhile go as soon as it is written."""
    with recorded() as tables:
        df = build()
    out = written(df, name)
    removed(df.sparkSession, tables)
    return out


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_white_space(text: Column) -> Column:
    """Deletes every ASCII white-space character; six byte searches cost less than one translate."""
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does just that where a text has nothing but ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: A group of more rows than HEAVY is dealt over PARTS tasks where it is joined.
HEAVY, PARTS = 1000, 256
#: Bits of a bitmap for each of its keys, and the most in all (128 MB).
BITS_EACH, MOST_BITS = 16, 1 << 30


def is_set(bits: Column, at: Column) -> Column:
    """Whether the bit at a position is set in its 4 KB piece of a bitmap; not where there is no such piece."""
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) != 0, F.lit(False))


def key_bitmap(keys: DataFrame, column: str) -> tuple[int, DataFrame]:
    """Number of bits, and (bucket, bits) with a bit set for each key; 128 MB at most, however many keys."""
    bits = min(MOST_BITS, 1 << max(20, (BITS_EACH * max(1, keys.count())).bit_length()))
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    return bits, keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def joined_evenly(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: list[str], how: str = "inner", heavy: int = HEAVY, parts: int = PARTS) -> DataFrame:
    """``rows`` joined with ``groups``, a table in which each key comes once with its number of rows.

    The rows of a key with more than ``heavy`` are dealt over ``parts`` tasks by a hash of the columns
    ``spread``, and its group is copied to each. Both sides read which keys those are from one bitmap: a key
    that it holds by chance is dealt on both sides alike. ``size`` is not in the result.
    """
    large = groups.where(F.col(size) > heavy).select(F.xxhash64(key).alias("__k"))
    if large.isEmpty():
        return rows.join(groups.drop(size), key, how)
    bits, bitmaps = key_bitmap(large, "__k")
    bitmaps = F.broadcast(bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    at = F.pmod(F.xxhash64(key), F.lit(bits)) + 1

    def dealt(df: DataFrame, of: Column) -> DataFrame:
        marked = df.join(bitmaps, F.bitmap_bucket_number(at) == F.col("__bucket"), "left").withColumn("__large", is_set(F.col("__bits"), at))
        return marked.withColumn("__part", of).drop("__bucket", "__bits", "__large")

    mine = dealt(rows, F.when(F.col("__large"), F.pmod(F.xxhash64(*spread), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
    copied = dealt(groups.drop(size), F.explode(F.when(F.col("__large"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return mine.join(copied, [key, "__part"], how).drop("__part")


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named so that they clash with no operator's own, and the new name of each."""
    names = {c: f"__column{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unmasked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])
