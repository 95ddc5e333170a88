import pytest
from pyspark.sql import functions as F

from kinetrace.sources import io, schema


def test_csv_round_trip(spark, tmp_path):
    df = io.synthetic_recording(spark, players=1, repetitions=1, seconds=1)
    assert df.count() == 1 * 2 * 6 * 1 * 50
    io.write_csv(df.select(*schema.STANDARD_IMU.names), str(tmp_path / "r.csv"))
    back = io.read_standard(spark, str(tmp_path / "r.csv"), ordered=True)
    assert back.schema.names == schema.STANDARD_IMU.names and back.count() == 600


def test_missing_columns(spark):
    with pytest.raises(schema.MissingColumns, match="label"):
        schema.require(spark.range(1), ["id", "label"])
    assert schema.column_difference(spark.range(1), spark.range(1).withColumn("x", F.lit(1))) == (set(), {"x"}, {"id"})


def test_null_label_stays_a_class(spark, tmp_path):
    spark.createDataFrame([("null", 1.0), ("shot", 2.0)], "label string, x double").coalesce(1).write.option("header", True).csv(str(tmp_path / "a"))
    got = io.read_csv(spark, str(tmp_path / "a"), "label string, x double")
    assert sorted(r.label for r in got.collect()) == ["null", "shot"]


def test_files_by_name(spark, tmp_path):
    for name in ("ann_eu.csv", "bob_na.csv", "notes.csv", "node3.csv"):
        (tmp_path / name).write_text("x\n1\n2\n")
    kind = "x double"
    got = io.read_by_name(spark, f"{tmp_path}/*.csv", kind).groupBy("subject", "region").count().collect()
    assert sorted(tuple(r) for r in got) == [("ann", "eu", 2), ("bob", "na", 2)]
    assert io.read_nodes(spark, f"{tmp_path}/*.csv", kind).select("node").distinct().collect()[0].node == 3


def test_metadata(spark):
    good = '{"eu": {"s1": {"age": 20, "height": 1.8}}, "na": {"s2": {"skill": "pro"}}}'
    got = io.flatten_metadata(spark.createDataFrame([(good,), ("{broken",)], "json string"))
    assert sorted((r.region, r.subject, r.age) for r in got.where("_corrupt_record IS NULL").collect()) == [("eu", "s1", 20), ("na", "s2", None)]
    assert [(r.region, r.subject, r._corrupt_record) for r in got.where("_corrupt_record IS NOT NULL").collect()] == [(None, None, "{broken")]


def test_recordings(spark):
    files = spark.createDataFrame([("投球0001abc", n) for n in range(4)] + [("dribble1", 1)], "recording string, node int")
    wanted = spark.createDataFrame([("跳投0001abc",), ("dribble1",), ("nothing",)], "recording string")
    got = {r.recording: (r.matched, r.complete) for r in io.resolve_recordings(wanted, files).collect()}
    assert got == {"跳投0001abc": ("投球0001abc", True), "dribble1": ("dribble1", False), "nothing": (None, False)}


def test_partitioned_output_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "node int, x string")
    io.write_parquet(df, str(tmp_path / "p"), ("node",))
    assert (tmp_path / "p" / "node=1").is_dir() and spark.read.parquet(str(tmp_path / "p")).count() == 2
    io.write_documents(df, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2


def test_clocks_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 5), (3, 5)], "t_node_us long, host_received_us long")
    assert [r.time_us for r in schema.best_clock(df).collect()] == [5, 3]
    assert all(t.count() == 0 for t in io.empty_tables(spark).values())


def test_an_empty_table_is_read_back_as_declared(spark, tmp_path):
    for name in ("pose_keypoints_2d", "sessions", "uwb_raw"):
        kind = schema.TABLES[name]
        io.write_csv(io.empty_tables(spark)[name].coalesce(1), str(tmp_path / name))
        back = io.read_csv(spark, str(tmp_path / name), kind)
        assert back.schema.names == kind.names and len(set(kind.names)) == len(kind) and back.count() == 0
    assert len(schema.TABLES) == 18


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("windows: {size: 50}\n")
    (tmp_path / "a.json").write_text('{"size": 50}')
    assert io.read_config(str(tmp_path / "a.yaml")) == {"windows": {"size": 50}} and io.read_config(str(tmp_path / "a.json")) == {"size": 50}


def test_markdown(spark):
    df = spark.createDataFrame([("shot", 0.0, 1.5, 0.9)], "label string, start double, end double, confidence double")
    assert io.timeline_markdown(df).endswith("| shot | 0.00 | 1.50 | 0.900 |")
