"""Ties at thresholds, shares and places, which the last bit of a float decides as in the queries' SQL."""

from collections import Counter

import duckdb
import numpy as np

from kinetrace.functions import columns, kernels
from kinetrace.operators import evaluation, features, segment, windows


def test_label_at_the_threshold(spark):
    """F1: 11.1 is 1.5 times the first decile of these, as quantile_cont has it: not under it."""
    rows = [(1, k, x) for k, x in enumerate([7.14, 7.79, 50.0, 51.0, 11.1])]
    want = duckdb.execute(f"WITH v AS (SELECT unnest({[r[2] for r in rows]}::DOUBLE[]) AS x) SELECT x, x < 1.5 * (SELECT quantile_cont(x, 0.1) FROM v) AS rest FROM v").fetchall()
    df = spark.createDataFrame(rows, "g int, t long, x double").selectExpr("*", "'a' AS label")
    got = {r.x: r.assigned for r in segment.continuous_labels(df, ["g"], ["t"], "x", "t", "label", 0).collect()}
    assert got == {x: "null" if rest else "a" for x, rest in want} and got[11.1] == "a"


def test_segment_at_the_threshold(spark):
    """10.44 against twice the first decile of these, as quantile_cont has it."""
    x = [90.0, 10.44, 4.89, 5.44, 91.0, 92.0, 93.0]
    ends = duckdb.execute(f"WITH v AS (SELECT unnest({x}::DOUBLE[]) AS x) SELECT 10.44 < 2 * quantile_cont(x, 0.1) FROM v").fetchone()[0]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "g int, t long, x double")
    got = segment.hysteresis(df, ["g"], ["t"], "x").orderBy("start").collect()
    assert got[0].n == (1 if ends else 2) == 2


def test_share_of_90_rows(spark):
    """row 62 of 90 lies before seven tenths of them."""
    df = spark.createDataFrame([(1, i, float(i == 62)) for i in range(90)], "g int, i long, x double")
    r = segment.best_in_share(df, ["g"], "i", "x", 0.35, 0.7).first()
    assert (r.place, r.score) == (62, 1.0)


def test_share_of_90_recordings(spark):
    """F8: 63 of 90 recordings are for training."""
    rows = evaluation.split_recordings(spark.range(90).selectExpr("id AS rec"), "rec", 0.7)
    assert rows.where("train").count() == 63


def test_codes_have_one_length(spark):
    """as lpad in the SQL."""
    df = spark.createDataFrame([(7,), (999,), (1209,)], "n long")
    want = [r[0] for r in duckdb.execute("SELECT 'C' || lpad(CAST(n AS VARCHAR), 3, '0') FROM (SELECT unnest([7, 999, 1209]) AS n)").fetchall()]
    assert [r.c for r in df.select(columns.lettered("C", df.n, 3).alias("c")).collect()] == want


def test_impact_at_the_level(spark):
    """a peak lies just at one and a half times the mean, which SQL sums in order."""
    v = [15.5, 55.1, 60.7, 7.5, 6.5, 10.5, 7.5, 16.0, 11.0, 11.0, 12.5, 40.3, 7.0, 20.0, 19.0, 55.1]
    df = spark.createDataFrame([(1, i, x, 0.0, 0.0, 9.0) for i, x in enumerate(v)], "g int, i int, v double, h double, p double, u double").selectExpr("*", "'dribble' AS label")
    r = features.validated(df, ["g"], ["i"], "label", "v", "h", "p", "u", 50.0, 0.05, 1.5, 80.0, 2.0).first()
    assert (r.peaks, r.narrow) == (1, False)


def test_centre_of_energy_between_places(spark):
    """a centre just at a place, by sums in order."""
    x = [93.6, 61.81, 28.89, 25.53, 28.89, 61.81, 93.6]
    want = duckdb.execute(f"SELECT CAST(floor(sum(i * x * x) / sum(x * x)) AS INT) FROM (SELECT unnest({x}::DOUBLE[]) AS x, unnest(range(7)) AS i)").fetchone()[0]
    df = spark.createDataFrame([(1, 1, i, v, "a") for i, v in enumerate(x)], "g int, segment int, i int, x double, label string")
    r = windows.event_anchors(df, ["g"], "i", "x", "label").first()
    assert (r.kind, r.anchor) == ("centroid", want)


def test_deviation_as_an_aggregate():
    """to the last bit."""
    for seed in range(20):
        x = np.random.default_rng(seed).integers(0, 56000, 50) / 100
        assert kernels.running_std(x) == duckdb.execute(f"SELECT stddev_pop(x) FROM (SELECT unnest({x.tolist()}::DOUBLE[]) AS x)").fetchone()[0]


def test_mean_at_a_tie(spark):
    """scaled as in the SQL, 49.5071875 * 1e6 is just under the half, 0.4440625 * 1e6 is not."""
    from kinetrace.plans.queries import r6_scaled

    x = [49.5071875, 0.4440625, 0.44406249999999997, -0.4440625]
    want = [duckdb.execute(f"SELECT round({v!r}::DOUBLE, 6)").fetchone()[0] for v in x]
    assert [r.r for r in spark.createDataFrame([(v,) for v in x], "v double").select(r6_scaled("v").alias("r")).collect()] == want


def test_segments_of_rows_without_a_recording(spark, tmp_path):
    """the SQL joins quantiles by user, so rows without one have no segments."""
    from kinetrace.plans import queries

    c = duckdb.connect()
    c.execute("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, CASE WHEN i % 3 > 0 THEN i % 3 END AS user_id, 'view' AS event_type,
        CASE WHEN i % 40 < 20 THEN 1.0 ELSE 90.0 END::DOUBLE AS value, '{"k": 1}' AS props FROM range(200) t(i)""")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("hysteresis_segments", "adaptive_segments", "continuous_labels"):
        want = c.execute(queries.ORACLES[name]).fetchall()
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
        assert want and Counter(got) == Counter(want)
