import socket
import time

import pytest
from pyspark.sql import functions as F

from kinetrace.operators import windows
from kinetrace.sources.udp import UdpSource
from kinetrace.streaming import streams


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def samples(spark, tmp_path):
    rows = [(i % 3, i, float(i * i % 17), "ab"[(i // 9) % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "g long, t long, x double, label string")
    for k in range(3):
        df.where(f"t >= {30 * k} AND t < {30 * k + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_sample_windows_equal_batch(spark, samples, tmp_path):
    batch, stream = samples
    got = run(spark, streams.sample_windows(stream, "g", "t", "x", 10, 5), "windows", tmp_path)
    want = windows.sliding(batch, ["g"], ["t"], 10, 5).groupBy("g", "window_id").agg(F.min("t").alias("first"), F.avg("x").alias("mean"), (F.max("x") - F.min("x")).alias("ptp"))
    key = lambda rows: sorted((r.g, r.window_id, r.first, round(r.mean, 9), r.ptp) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_timeline_equals_batch_but_for_the_open_run(spark, samples, tmp_path):
    batch, stream = samples
    got = run(spark, streams.open_timeline(stream, "g", "t", "label"), "timeline", tmp_path)
    want = windows.run_lengths(batch, ["g"], ["t"], "label")
    last = want.groupBy("g").agg(F.max("run").alias("run"))
    want = want.join(last, ["g", "run"], "left_anti")
    key = lambda rows: sorted((r.g, r.label, r["first"], r["last"], r.n) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_loss_and_time_windows(spark, samples, tmp_path):
    batch, stream = samples
    at = stream.withColumn("ts", F.timestamp_seconds("t")).where("t % 9 <> 4")
    loss = run(spark, streams.loss_by_interval(at.withColumn("seq", F.floor(F.col("t") / 3)), ["g"], "seq", "ts", "30 seconds", "1 second"), "loss", tmp_path)
    assert loss.count() > 0 and all(0 <= r.loss < 0.5 for r in loss.collect())
    t = run(spark, streams.time_windows(at, ["g"], "x", "ts", "20 seconds", "10 seconds", "1 second"), "timed", tmp_path)
    assert t.count() > 0
    s = run(spark, streams.sessions(at, ["g"], "ts", "5 seconds", "1 second"), "sessions", tmp_path)
    assert s.columns == ["g", "start", "end", "n"]


def test_sessions_by_reset_equal_batch(spark, tmp_path):
    """Numbers that begin anew, are late, come twice or never, over several batches; state ends with silence."""
    rows, seconds = [], 0
    for g in range(3):
        for start, numbers in ((0, [0, 1, 2, 4, 3, 3, 5, 9]), (40, [200, 201, 205]), (60, [100, 101]), (70, [0, 1, 2] + list(range(3, 90)) + [5, 88]), (400, [7, 8])):
            rows += [(g, q, float(start * 10 + k) / 10) for k, q in enumerate(numbers)]
    rows.append((9, 0, 5000.0))
    df = spark.createDataFrame(rows, "g long, seq long, s double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    for lo, hi in ((0, 45), (45, 75), (75, 350), (350, 4000), (4000, 9000)):
        df.where(f"s >= {lo} AND s < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, streams.sessions_by_reset(stream, ["g"], "seq", "ts", 20.0, "0 seconds"), "reset_sessions", tmp_path)
    want = streams.session_table(df.where("g < 9"), ["g"], "seq", "ts", 20.0)
    key = lambda rows: sorted((r.g, r["first"], r["last"], r.n, r.lowest, r.highest, r.lost, r.duplicates) for r in rows)
    found = got.where("g < 9").collect()
    assert key(found) == key(want.collect()) and {r.ended for r in found} == {"numbers begin anew", "silence"}
    assert any(r.lost for r in found) and any(r.duplicates for r in found) and len(found) == 18


def test_pairs_equal_batch(spark, tmp_path):
    """Partners within 20 ms after both clocks are brought together; those without one come when the watermark passes."""
    a = [(1, k, 1_000_000 + 50_000 * k, 9_000_000 + 50_000 * k + 300) for k in range(60)]
    b = [(2, k, 70_000_000 + 50_000 * k + 5_000 * (k % 2), 9_000_000 + 50_000 * k + 5_000 * (k % 2) + 100) for k in range(60) if k % 7]
    rows = spark.createDataFrame([(1, *r) for r in a + b] + [(1, 1, 999, 10**9, 10**9 + 8_000_300), (1, 2, 999, 10**9, 940_000_100)], "rec long, node long, k long, us long, host long")
    offsets = streams.clock_offsets(rows, "node", "us", "host")
    assert {r.node: r.offset for r in offsets.collect()} == {1: 8_000_300, 2: -60_999_900}
    offsets.write.parquet(str(tmp_path / "offsets"))
    offsets = spark.read.parquet(str(tmp_path / "offsets"))
    for n in (1, 2):
        for lo, hi in ((0, 20), (20, 60), (60, 10**6)):
            rows.where(f"node = {n} AND k >= {lo} AND k < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"n{n}"))
    read = lambda n: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"n{n}"))
    made = lambda x, y: streams.paired(*(streams.on_host_clock(z, offsets, "node", "us") for z in (x, y)), ["rec"], "ts", "20 milliseconds", "0 seconds").where("a_k < 999")
    got = run(spark, made(read(1), read(2)), "pairs", tmp_path).select("a_k", "b_k").collect()
    want = made(rows.where("node = 1"), rows.where("node = 2")).select("a_k", "b_k").collect()
    key = lambda rows: sorted((r.a_k, -1 if r.b_k is None else r.b_k) for r in rows)
    assert key(got) == key(want) and sum(r.b_k is None for r in want) == 9 and len(want) == 60


def test_wire_rows(spark):
    good = "1,2,3,4,5,6,7,8,9,10,11"
    full = "1,2,3,4,5,32767,32767,32767,32767,32767,32767"
    lines = spark.createDataFrame([(good,), (full,), ("1,2,3",), ("1,2,,4,5,6,7,8,9,10,11",)], "value string")
    assert streams.wire_rows(lines).count() == 2 and streams.broken_rows(lines).count() == 2
    kept = streams.valid_packets(streams.wire_rows(lines), group=1, own_node=9)
    assert tuple(kept.first()) == tuple(range(1, 12))


def test_udp_source(spark, tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    spark.dataSource.register(UdpSource)
    q = spark.readStream.format("udp").option("port", str(port)).load().writeStream.format("memory").queryName("datagrams").option("checkpointLocation", str(tmp_path / "udp")).start()
    try:
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        end = time.time() + 60
        while time.time() < end and spark.table("datagrams").where("value = 'a,1'").count() == 0:
            out.sendto(b"a,1", ("127.0.0.1", port))
            time.sleep(0.5)
        assert spark.table("datagrams").where("value = 'a,1'").count() > 0
    finally:
        q.stop()


def test_packets_of_one_kind_and_state(spark):
    names = "group node seq node_timestamp_us master_timestamp_us acc_x acc_y acc_z gyr_x gyr_y gyr_z".split()
    rows = spark.range(8).select(*[F.lit(1).alias(c) for c in names], (F.col("id") % 2).alias("msg_type"), F.col("id").alias("status"))
    assert {r.status for r in streams.valid_packets(rows, kind=1, status=2).collect()} == {3, 7}
    assert streams.valid_packets(rows).count() == 8
