"""Readers and writers of recordings."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.sources.schema import STANDARD_IMU, TABLES, nan_to_null, require


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = STANDARD_IMU, null_value: str = "") -> DataFrame:
    """CSV with a header, read by name with an explicit schema; a class named ``null`` stays a string."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", null_value).csv(path))


def read_standard(spark: SparkSession, path: str | list[str], ordered: bool = False) -> DataFrame:
    """Standard tables of one file or a folder: all required columns. Operators take their order as columns; only
    where rows are shown or written in order does it pay to sort them all."""
    df = require(read_csv(spark, path), STANDARD_IMU.names, "recording")
    return df.orderBy("session_id", "player_id", "side", "timestamp_us") if ordered else df


def read_by_name(spark: SparkSession, path: str, schema: T.StructType, pattern: str = r"([^/]+?)_(eu|na)\.csv$", names: tuple[str, ...] = ("subject", "region")) -> DataFrame:
    """Files whose name matches, with the pattern's groups as columns; other files are skipped."""
    df = spark.read.schema(schema).option("header", True).csv(path).withColumn("source_file", F.col("_metadata.file_name"))
    df = df.where(F.regexp_extract("source_file", pattern, 0) != "")
    return df.withColumns({n: F.regexp_extract("source_file", pattern, i + 1) for i, n in enumerate(names)})


def read_nodes(spark: SparkSession, path: str, schema: T.StructType, pattern: str = r"node(\d+)") -> DataFrame:
    """One file for each node; the node's number comes from the file's name."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn("node", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("int")).where("node IS NOT NULL")


def flatten_metadata(df: DataFrame, column: str = "json") -> DataFrame:
    """Region to subject to attributes, one row for each subject; text that is no such JSON gives one row with the text in
    ``_corrupt_record`` and nothing else. Null text gives none."""
    attrs = "STRUCT<age:INT,dom_hand:STRING,height:DOUBLE,weight:DOUBLE,skill:STRING,gender:STRING>"
    parsed = df.where(F.col(column).isNotNull()).select(F.from_json(column, f"MAP<STRING,MAP<STRING,{attrs}>>", {"mode": "PERMISSIVE"}).alias("m"), F.col(column).alias("__text"))
    each = parsed.select(F.explode_outer("m").alias("region", "s"), "__text", F.col("m").isNull().alias("__bad")).where("__bad OR region IS NOT NULL")
    each = each.select("region", F.explode_outer("s").alias("subject", "a"), "__text", "__bad").where("__bad OR subject IS NOT NULL")
    return each.select("region", "subject", "a.*", F.when(F.col("__bad"), F.col("__text")).alias("_corrupt_record"))


#: Words of a recording's name that mean the same.
SAME_RECORDING = (("跳投", "投球"),)


def resolve_recordings(wanted: DataFrame, files: DataFrame, nodes: int = 4, prefix: int = 8) -> DataFrame:
    """(recording, matched, n_nodes, complete): exact name or a synonym, else a shared prefix."""
    name = F.col("recording")
    for a, b in SAME_RECORDING:
        name = F.replace(name, F.lit(a), F.lit(b))
    known = files.groupBy(F.col("recording").alias("matched")).agg(F.countDistinct("node").alias("n_nodes"))
    other = F.col("matched")
    for a, b in SAME_RECORDING:
        other = F.replace(other, F.lit(a), F.lit(b))
    rank = F.when(F.col("recording") == F.col("matched"), 0).when(F.col("w") == F.col("k"), 1).otherwise(2)
    exact = wanted.withColumn("w", name).join(known.withColumn("k", other), F.substring("w", 1, prefix) == F.substring("k", 1, prefix), "left")
    best = exact.groupBy("recording").agg(F.min_by(F.struct("matched", "n_nodes"), F.struct(rank, F.col("matched"))).alias("m"))
    return best.select("recording", "m.*", (F.coalesce(F.col("m.n_nodes"), F.lit(0)) == nodes).alias("complete"))


def missing_nodes(wanted: DataFrame, files: DataFrame, nodes: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(recording, node) of every node of a wanted recording that has no file, of all its nodes if nothing matches it."""
    named = resolve_recordings(wanted, files, len(nodes)).select("recording", "matched", F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node"))
    there = files.select(F.col("recording").alias("__rec"), F.col("node").cast("int").alias("__node")).distinct()
    return named.join(there, (F.col("matched") == F.col("__rec")) & (F.col("node") == F.col("__node")), "left_anti").select("recording", "node")


def read_config(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    return json.loads(text) if path.endswith(".json") else yaml.safe_load(text)


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Every declared table without rows, to be written where a new collection starts."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def synthetic_recording(spark: SparkSession, players: int = 3, repetitions: int = 20, seconds: int = 2, hz: int = 50, seed: int = 42) -> DataFrame:
    """Two sides and six actions of each player: a sine of the action's own frequency and size, and noise."""
    actions = F.array(*[F.lit(x) for x in ("idle", "dribble", "pass", "shot", "jump", "sprint")])
    n = seconds * hz
    rows = spark.range(players * 2 * 6 * repetitions * n)
    i, k = F.col("id") % n, F.floor(F.col("id") / n)
    action = (F.floor(k / repetitions) % 6).cast("int")
    wave = F.sin(2 * F.pi() * (action + 1) * i / hz) * (action + 0.1)
    noise = [F.randn(seed + j) * 0.05 for j in range(9)]
    side = F.when(F.floor(k / (repetitions * 6)) % 2 == 0, "left").otherwise("right")
    player = F.format_string("P%02d", (F.floor(k / (repetitions * 12)) + 1).cast("int"))
    values = {c: (wave * (0.5 + 0.25 * j) + x) for (j, x), c in zip(enumerate(noise), ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz"), strict=True)}
    return rows.select(
        F.lit("S001").alias("session_id"), player.alias("player_id"), F.concat(player, F.lit("-"), side).alias("sensor_id"), side.alias("side"), F.col("id").alias("seq"),
        (F.col("id") * (1_000_000 // hz)).alias("timestamp_us"), *[c.alias(name) for name, c in values.items()], F.element_at(actions, action + 1).alias("label"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """One folder for each value of ``by``; rows are dealt out first, so a value has few files."""
    (df.repartition(*[F.col(c) for c in by]).write.partitionBy(*by) if by else df.write).mode(mode).parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON document for each row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def timeline_markdown(events: DataFrame, limit: int = 1000) -> str:
    """A table of the first events, for people to read."""
    rows = events.orderBy("start").limit(limit).select("label", "start", "end", "confidence").collect()
    return "\n".join(["| label | start | end | confidence |", "|-|-|-|-|", *(f"| {r[0]} | {r[1]:.2f} | {r[2]:.2f} | {r[3]:.3f} |" for r in rows)])
