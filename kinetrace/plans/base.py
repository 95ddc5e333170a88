"""The driver's tables seen as sensor tables, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators.windows import indexed


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(c: str = "ts"):
    """Microseconds of a time without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Events as samples: a user is a recording, with node, sequence number, time, two channels and a label."""
    e = table(spark, d, "events")
    e = e.select(
        "user_id", (F.col("user_id") % 4 + 1).alias("node"), F.col("event_id").alias("seq"), micros().alias("us"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"), F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type")).alias("label"),
    )
    return indexed(e, ["user_id"], ["us", "seq"])


#: The same in SQL, for the start of a WITH clause.
SAMPLES = """ev AS (
  SELECT user_id, user_id % 4 + 1 AS node, event_id AS seq, epoch_us(ts) AS us, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
         CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS label,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
  FROM events)"""


def windows_sql(size: int, step: int, source: str = "ev") -> str:
    """Sliding windows of ``source`` as view w (window_id and the sample's columns)."""
    return f"""nn AS (SELECT user_id, count(*) AS n FROM {source} GROUP BY user_id),
w AS (SELECT {source}.*, window_id FROM {source} JOIN nn USING (user_id), LATERAL (SELECT unnest(range(0, greatest(0, (n - {size}) // {step} + 1))) AS window_id)
      WHERE n >= {size} AND i >= window_id * {step} AND i < window_id * {step} + {size})"""


#: lineitem as a feature table: supplier is the recording, three channels.
ITEMS = """li AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity AS ax, l_extendedprice / 1000 AS ay, l_discount * 100 AS az, l_returnflag AS label FROM lineitem)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("ax"), (F.col("l_extendedprice") / 1000).alias("ay"), (F.col("l_discount") * 100).alias("az"), F.col("l_returnflag").alias("label"))
