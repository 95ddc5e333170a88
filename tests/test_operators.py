import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrace.functions import columns as C
from kinetrace.functions import kernels
from kinetrace.operators import evaluation, features, joins, learning, quality, rejection, resample, rules, segment, signal, similarity, windows


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 60), st.integers(1, 20), st.integers(1, 9))
def test_number_of_windows(spark, n, size, step):
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("t"))
    got = windows.sliding(df, ["g"], ["t"], size, step)
    want = [(w, w * step + k) for w in range((n - size) // step + 1 if n >= size else 0) for k in range(size)]
    assert sorted((r.window_id, r.i) for r in got.collect()) == want


def test_resampling_a_signal_on_the_grid_changes_nothing(spark):
    df = spark.createDataFrame([(1, t * 10, float(v)) for t, v in enumerate([3, 1, 4, 1, 5])], "g int, t long, x double")
    got = resample.uniform_grid(df, ["g"], "t", ["x"], 10)
    assert [r.x for r in got.orderBy("t").collect()] == [3, 1, 4, 1, 5]
    half = resample.uniform_grid(df, ["g"], "t", ["x"], 5)
    assert [r.x for r in half.orderBy("t").collect()] == np.interp(np.arange(0, 45, 5), np.arange(5) * 10, [3, 1, 4, 1, 5]).tolist()


def test_runs_survive_a_round_trip(spark):
    labels = ["a", "a", None, None, "b", "a"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "g int, i int, label string")
    got = windows.run_lengths(df, ["g"], ["i"], "label").orderBy("run").collect()
    assert [x for r in got for x in [r.label] * r.n] == labels


def test_smoothing_at_ends(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(5)], "g int, i int, x double")
    w = windows.over(["g"], ["i"])
    got = df.select(windows.rolling_mean("x", w, 3).alias("a"), windows.moving_average("x", w, 3).alias("b")).collect()
    assert [r.a for r in got] == [1] * 5 and [r.b for r in got] == pytest.approx([2 / 3, 1, 1, 1, 2 / 3])


def test_gradient_is_numpys(spark):
    t = np.array([0, 1, 3, 4, 8.0])
    x = t**2
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, x)], "g int, t double, x double")
    w = windows.over(["g"], ["t"])
    got = df.select(windows.gradient_uneven("x", "t", w).alias("a"), windows.gradient("x", w).alias("b")).collect()
    assert [r.a for r in got] == pytest.approx(np.gradient(x, t)) and [r.b for r in got] == pytest.approx(np.gradient(x))


def test_majority_leaves_unknown_only_alone(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["unknown", "unknown", "unknown", "b", "a"])], "g int, i int, l string")
    assert [r[0] for r in df.select(windows.majority("l", windows.over(["g"], ["i"]))).collect()] == ["unknown", "b", "a", "a", "a"]


def test_intervals_and_nearest(spark):
    p = spark.createDataFrame([(1, x) for x in (0, 5, 10, 11, 20)], "g int, t int")
    i = spark.createDataFrame([(1, 5, 10, "a"), (1, 20, 30, "b")], "g int, s int, e int, l string")
    got = joins.interval_join(p, i, ["g"], "t", "s", "e", "l").orderBy("t").collect()
    assert [r.interval_label for r in got] == ["unknown", "a", "a", "unknown", "b"]
    r = spark.createDataFrame([(1, 4, 1.0), (1, 8, 2.0)], "g int, t int, v double")
    got = joins.nearest_join(p, r, ["g"], "t", "v").orderBy("t").collect()
    assert [(x.nearest, x.distance) for x in got] == [(1, 4), (1, 1), (2, 2), (2, 3), (2, 12)]


def test_lookup_needs_unique_keys(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeat"):
        joins.lookup(t, t, ["k"]).collect()
    once = t.limit(1)
    assert [tuple(r) for r in joins.lookup(t.select("k"), once, ["k"]).collect()] == [(1, "a"), (1, "a")]


def test_hysteresis_and_merge(spark):
    x = [1, 9, 3, 1, 1, 9, 1, 1, 1, 9, 9, 1.0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, i int, x double")
    got = segment.hysteresis(df, ["g"], ["i"], "x", 5, 2).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(1, 2), (5, 5), (9, 10)]
    got = segment.hysteresis(df, ["g"], ["i"], "x", 5, 2, gap=3).collect()
    assert [(r.start, r.end, r.n) for r in got] == [(1, 5, 3), (9, 10, 2)]


def test_angle_and_quaternion(spark):
    one, zero = F.lit(1.0), F.lit(0.0)
    half = F.lit(0.5**0.5)
    r = spark.range(1).select(
        C.joint_angle((one, zero, zero), (zero, zero, zero), (zero, one, zero)).alias("angle"),
        F.array(*C.rotated((half, zero, zero, half), (one, zero, zero))).alias("turned"), F.degrees(C.euler((half, zero, zero, half))[2]).alias("yaw")).first()
    assert r.angle == pytest.approx(90) and r.turned == pytest.approx([0, 1, 0]) and r.yaw == pytest.approx(90)


def test_rules_take_the_first(spark):
    df = spark.createDataFrame([(5.0, 1.0), (1.0, 1.0), (None, None)], "a double, b double")
    label, sure = rules.by_priority({"x": {"a_min": 4.0}, "y": {"b_max": 2.0}}, ["x", "y"])
    assert [tuple(r) for r in df.select(label, sure).collect()] == [("x", 1.0), ("y", 1.0), ("unknown", 0.0)]


def test_quality_of_a_perfect_stream(spark):
    df = spark.range(100).select(F.lit(1).alias("g"), F.col("id").alias("seq"), (F.col("id") * 20).alias("t")).where("seq % 10 <> 5")
    r = quality.packet_loss(df, ["g"], "seq", "t").first()
    assert r.loss == pytest.approx(0.1) and r.median_dt == 20
    d = quality.dropouts(df, ["g"], "t", 20).first()
    assert (d.gaps, d.expected) == (10, 100)


def test_smoothing_stays_in_its_group(spark):
    df = spark.createDataFrame([(g, i, float(g)) for g in (1, 100) for i in range(60)], "g int, i int, x double")
    got = signal.smoothed(df, ["g"], ["i"], "x", 8.0, 50.0)
    assert all(abs(r.x_filtered - r.g) < 1e-6 for r in got.collect())


def test_features_of_constant_windows_are_finite(spark):
    df = spark.createDataFrame([(1, [2.0] * 60), (2, [float(np.sin(i)) for i in range(60)])], "id int, samples array<double>")
    got = {r.id: r.asDict() for r in signal.window_features(df, ["id"], "samples", 50.0).collect()}
    assert all(np.isfinite(v) for r in got.values() for v in r.values()) and len(got[1]) == 1 + 18
    assert got[1]["std"] == 0 and got[1]["skew"] == 0


def test_forest_and_selection(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(x), float(x * 2), float(rng.standard_normal()), "a" if x > 0 else "b") for i, x in enumerate(rng.standard_normal(200))]
    df = spark.createDataFrame(rows, "id int, f double, g double, h double, label string")
    model = learning.random_forest(df, ["f", "g", "h"], "label", trees=10, depth=3)
    right = model.transform(df).where("prediction = label_index").count()
    assert right >= 190
    assert learning.uncorrelated(df, ["f", "g", "h"]) == ["f", "h"]
    assert learning.importances(model, ["f", "g", "h"])[-1][0] == "h"
    assert learning.excluded(["posture_1_pitch_mean", "pitch_node1_mean"], ("posture",)) == ["pitch_node1_mean"]


def test_alignment_by_name(spark):
    df = spark.createDataFrame([(1, float("nan"), 3.0)], "id int, a double, b double")
    assert tuple(learning.aligned(df, ["id"], ["b", "a", "c"]).first()) == (1, 3.0, 0.0, 0.0)


def test_padding(spark):
    df = spark.createDataFrame([(1, i, float(i + 1)) for i in range(3)], "g int, i int, x double")
    assert windows.padded(df, ["g"], "i", "x", 5).first().samples == [1, 2, 3, 0, 0]
    assert windows.padded(df, ["g"], "i", "x", 2).first().samples == [1, 2]


def test_all_features_of_72_channels(spark):
    rng = np.random.default_rng(0)
    kinds = ["ax", "ay", "az", "gx", "gy", "gz", "a_mag", "g_mag", "roll", "pitch", "yaw", "a_vert", "a_horiz", "jerk", "u", "v", "w", "q"]
    window = {f"{k}_node{n}": rng.standard_normal(60).tolist() for k in kinds for n in range(1, 5)}
    df = spark.createDataFrame([(1, window), (2, {k: [0.0] * 60 for k in window})], "id int, channels map<string,array<double>>")
    got = features.full_features(df, ["id"], "channels", 50.0)
    assert {r.id: r.n for r in got.groupBy("id").agg(F.countDistinct("feature").alias("n")).collect()} == {1: 1350, 2: 1350}
    assert got.where("value IS NULL OR isnan(value)").count() == 0
    wide = features.selected(got, ["id"], ["ax_node1_std", "falling_all", "missing"]).orderBy("id").collect()
    assert wide[0]["ax_node1_std"] == pytest.approx(np.std(window["ax_node1"])) and wide[1]["falling_all"] == 1.2 and wide[0]["missing"] == 0


def test_gravity_is_up(spark):
    t = np.arange(400) / 50
    rows = [(1, i, float(np.sin(2 * np.pi * 2 * x)), 0.0, float(9.8 + 0.5 * np.cos(2 * np.pi * 3 * x))) for i, x in enumerate(t)]
    got = signal.gravity_frame(spark.createDataFrame(rows, "g int, i int, x double, y double, z double"), ["g"], ["i"], ["x", "y", "z"], 50.0).orderBy("i").collect()
    up, flat = np.array([r.a_vert for r in got])[100:-100], np.array([r.a_horiz for r in got])[100:-100]
    assert np.abs(up - 0.5 * np.cos(2 * np.pi * 3 * t[100:-100])).max() < 0.1 and np.abs(flat - np.abs(np.sin(2 * np.pi * 2 * t[100:-100]))).max() < 0.1


def test_uneven_recordings_are_repaired(spark):
    rows = [(1, t, float(t)) for t in (0, 10, 20, 30)] + [(2, t, float(t)) for t in (0, 10, 35, 40)]
    got = resample.repaired(spark.createDataFrame(rows, "g int, t long, x double"), ["g"], "t", ["x"]).orderBy("g", "t").collect()
    assert [r.t for r in got if r.g == 1] == [0, 10, 20, 30] and all(r.x == pytest.approx(r.t) for r in got)
    assert [r.t for r in got if r.g == 2] == pytest.approx([0, 40 / 3, 80 / 3, 40])


def test_peak_confidence(spark):
    df = spark.createDataFrame([(1, i, 5.0 if i == 4 else float(i % 2)) for i in range(9)], "g int, i int, x double")
    r = features.peak_confidence(df, spark.createDataFrame([(1, 4)], "g int, place int"), ["g"], "i", "x", 3).first()
    assert r.confidence == pytest.approx((5 - 1) / np.std([1, 0, 1, 5, 1, 0, 1]))


def test_first_of_overlapping_intervals(spark):
    rng = np.random.default_rng(3)
    intervals = [(int(rng.integers(3)), int(a := rng.integers(60)), int(a + rng.integers(25)), f"n{k}") for k in range(25)]
    points = [(g, t) for g in range(3) for t in range(90)]
    got = joins.interval_join(spark.createDataFrame(points, "g int, t int"), spark.createDataFrame(intervals, "g int, a int, b int, name string"), ["g"], "t", "a", "b", "name")
    first = lambda g, t: min(((a, n) for h, a, b, n in intervals if h == g and a <= t <= b), default=(0, "unknown"))[1]
    assert {(r.g, r.t): r.interval_label for r in got.collect()} == {p: first(*p) for p in points}


def test_windows_without_a_region(spark):
    rng = np.random.default_rng(4)
    w = [(int(rng.integers(2)), k, int(a := rng.integers(200)), int(a + rng.integers(10))) for k in range(80)]
    r = [(int(rng.integers(2)), int(a := rng.integers(200)), int(a + rng.integers(12))) for _ in range(15)]
    got = joins.not_overlapping(spark.createDataFrame(w, "g int, k int, start int, end int"), spark.createDataFrame(r, "g int, rs int, re int"), ["g"])
    assert {x.k for x in got.collect()} == {k for g, k, a, b in w if not any(h == g and a <= d and c <= b for h, c, d in r)}
    assert got.columns == ["g", "k", "start", "end"]


@pytest.mark.parametrize("queries,rows", [(4096, 20_000), (3, 7)])
def test_neighbours_and_silhouette_by_blocks(spark, queries, rows, monkeypatch):
    monkeypatch.setattr(joins, "QUERIES_AT_ONCE", queries)
    monkeypatch.setattr(joins, "ROWS_AT_ONCE", rows)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(60, 3)), 1)
    v[10:20] = v[:10]  # ties
    label = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label))], "id long, v array<double>, label int")
    some = df.where("id % 5 = 0").withColumnRenamed("id", "qid")
    d = np.round(((v[:, None] - v[None]) ** 2).sum(2), 9)
    want = {}
    for i in range(0, 60, 5):
        near = sorted((d[i, j], j) for j in range(60) if j != i)[:5]
        votes = pd.Series([label[j] for _, j in near]).value_counts()
        want[i] = min((-n, int(c)) for c, n in votes.items())[::-1]
    got = joins.nearest_neighbours(some.select("qid", "v"), df)
    assert {r.qid: (r.label, -r.votes) for r in got.collect()} == want
    s = {r.qid: r.s for r in evaluation.silhouette(some, df).collect()}
    for i in range(0, 60, 5):
        far = {c: np.mean([d[i, j] ** 0.5 for j in range(60) if label[j] == c and j != i]) for c in range(3)}
        a, b = far[label[i]], min(far[c] for c in range(3) if c != label[i])
        assert s[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)


def test_undersampling_keeps_exactly_its_share(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "a").when(F.col("id") % 75 == 1, "b").when(F.col("id") == 7, None).otherwise("null").alias("label"))
    got = {r.label: r["count"] for r in evaluation.undersampled(df, "label", "null", "id").groupBy("label").count().collect()}
    assert got == {"a": 100, "b": 67, None: 1, "null": 150}
    few = df.where("id < 60")
    assert evaluation.undersampled(few, "label", "a", "id", 100).count() == few.count()


def test_lagged_correlation_of_a_shifted_signal(spark):
    x = np.random.default_rng(6).normal(size=40)
    rows = [(1, i, float(x[i]), float(x[i - 3]) if i >= 3 else 0.0) for i in range(40)] + [(2, i, 1.0, float(i)) for i in range(9)]
    got = similarity.lagged_correlation(spark.createDataFrame(rows, "g int, i int, x double, y double"), ["g"], "i", "x", "y", 5).collect()
    assert [(r.g, r.lag, r.r) for r in got] == [(1, 3, 1.0)]


def test_correlation_with_a_constant_side(spark):
    df = spark.createDataFrame([(1, float(i), 2.0) for i in range(4)] + [(2, float(i), 3.0 * i) for i in range(4)] + [(2, 1.0, None)], "g int, x double, y double")
    assert {r.g: r.r for r in quality.pearson(df, ["g"], "x", "y").collect()} == {1: 0.0, 2: pytest.approx(1)}
    assert [r.g for r in quality.pearson(df, ["g"], "x", "y", flat=None).collect()] == [2]


def test_filling_a_long_recording_takes_linear_time(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), "id", F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("x"))
    start = time.time()
    got = resample.fill_by_row(df, ["g"], ["id"], ["x"]).agg(F.max(F.abs(F.col("x") - F.least(F.col("id"), F.lit(199_000)))), F.count("x")).first()
    assert got[0] < 1e-6 and got[1] == 200_000 and time.time() - start < 20


def test_nodes_on_one_clock(spark):
    rows = [(1, n, t, float(t * n)) for n, (a, b) in {1: (0, 100), 2: (7, 93), 3: (20, 120)}.items() for t in range(a, b, 3)] + [(2, 1, 0, 1.0), (2, 2, 50, 1.0)]
    got = resample.common_grid(spark.createDataFrame(rows, "rec int, node int, t long, x double"), ["rec"], "node", "t", ["x"], 10, [1, 2, 3, 4]).orderBy("t").collect()
    assert [r.t for r in got] == list(range(20, 92, 10)) and {r.rec for r in got} == {1}
    for r in got:
        assert (r.x_n1, r.x_n2, r.x_n3, r.x_n4) == (pytest.approx(r.t), pytest.approx(2 * r.t), pytest.approx(3 * r.t), None)


def test_class_models_against_the_kernel(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)), rng.normal(3, 1, (40, 4)), rng.normal(size=(3, 4))])
    label = ["a"] * 80 + ["b"] * 40 + ["few"] * 3
    rows = [(i, y, v.tolist()) for i, (v, y) in enumerate(zip(x, label))] + [(200, None, [0.0] * 4), (201, "none", None), (202, "new", [1.0] * 4)]
    df = spark.createDataFrame(rows, "id int, label string, v array<double>").repartition(5)
    models = rejection.class_models(df.where("label <> 'new' OR label IS NULL"), "v", "label")
    for c, a, b in (("a", 0, 80), ("b", 80, 120)):
        mean, covariance, share = kernels.ledoit_wolf(x[a:b])
        assert np.allclose(models[c].mean, mean) and np.allclose(models[c].covariance, covariance) and models[c].share == pytest.approx(share)
    assert np.array_equal(models["few"].covariance, np.eye(4)) and set(models) == {"a", "b", "few"}
    far = {r.id: r.distance for r in rejection.mahalanobis(df, "v", "label", models).collect()}
    d = x[5] - models["a"].mean
    assert far[5] == pytest.approx((d @ np.linalg.inv(models["a"].covariance) @ d) ** 0.5) and far[200] == far[201] == far[202] == 0
    pairs = rejection.distance_matrix(models)
    assert [p[:2] for p in pairs] == [("a", "b"), ("a", "few"), ("b", "few")]
    ca, cb, d = models["a"].covariance, models["b"].covariance, models["a"].mean - models["b"].mean
    far = d @ np.linalg.inv((ca + cb) / 2) @ d
    assert pairs[0][2:] == pytest.approx((far**0.5, far / 8 + 0.5 * np.log(np.linalg.det((ca + cb) / 2) / np.sqrt(np.linalg.det(ca) * np.linalg.det(cb)))))
    flat = {"p": rejection.ClassModel(9, np.zeros(2), np.zeros((2, 2)), 0.0), "q": rejection.ClassModel(9, np.ones(2), np.eye(2), 0.0)}
    assert rejection.distance_matrix(flat)[0][2:] == pytest.approx((2.0, 0.5))


def test_held_out_rows_among_the_others_are_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, rec string")
    rest, held = learning.hold_out(df, "rec", "b")
    assert [r.id for r in learning.checked_apart(rest, held, "rec").collect()] == [1] and [r.id for r in held.collect()] == [2]
    with pytest.raises(Exception, match="held-out"):
        learning.checked_apart(df, held, "rec").collect()


def test_kernels_run_by_group(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(150, 6))
    rows = [(i % 2, i, *map(float, x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, t int, a double, b double, c double, p double, q double, r double")
    take = lambda out, names: np.array([[r[n] for n in names] for r in out.where("g = 1").orderBy("t").collect()], float)
    x = v[1::2]
    one = (["g"], ["t"])
    assert np.allclose(take(signal.banded(df, *one, "a", 1, 8, 50), ["a_filtered"])[:, 0], kernels.zero_phase(*kernels.bandpass(4, 1, 8, 50), x[:, 0]))
    assert np.allclose(take(signal.smoothed(df, *one, "a", 0.5, 50, 4, True), ["a_filtered"])[:, 0], kernels.zero_phase(*kernels.butterworth(4, 0.5, 50, True), x[:, 0]))
    assert np.allclose(take(signal.tilted(df, *one, ["a", "b", "c"], ["p", "q", "r"], 0.02), ["roll", "pitch"]), kernels.tilt(x[:, :3], x[:, 3:], 0.02))
    assert np.flatnonzero(take(signal.counted_peaks(df, *one, "a", 4, 2), ["is_peak"])[:, 0]).tolist() == kernels.peaks_for_count(x[:, 0], 4, 2).tolist()
    assert np.flatnonzero(take(signal.peaks(df, *one, "a", 3, 0.8), ["is_peak"])[:, 0]).tolist() == kernels.find_peaks(x[:, 0], 3, 0.8).tolist()
    both = spark.createDataFrame([(1, x[:, 0].tolist(), x[:, 1].tolist())], "k int, x array<double>, y array<double>")
    (high, lag), (height, period) = kernels.cross_correlation(x[:, 0], x[:, 1]), kernels.autocorrelation_peak(x[:, 0])
    assert tuple(signal.synchrony(both, ["k"], "x", "y", 50).first()) == pytest.approx((1, high, lag / 50, height, period / 50))


def test_windows_of_different_lengths_go_together(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=n).tolist()) for k, n in enumerate([8, 20, 8, 33, 20])]
    got = {r.k: r for r in signal.window_features(spark.createDataFrame(rows, "k int, s array<double>").coalesce(1), ["k"], "s", 50.0).collect()}
    for k, s in rows:
        assert got[k].dom_freq == pytest.approx(signal.time_and_frequency(np.array([s]), 50.0)["dom_freq"][0]) and got[k]["mean"] == pytest.approx(np.mean(s))


def test_channel_features_and_lags_of_windows(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(3, 40)), rng.normal(size=(3, 40))
    y[1, 4:] = x[1, :-4]
    x[2] = 5.0
    rows = [(k, x[k].tolist(), y[k].tolist(), (-y[k]).tolist()) for k in range(3)] + [(3, x[0][:20].tolist(), y[0][:20].tolist(), y[0][:20].tolist())]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>, z array<double>").withColumn("m", features.magnitudes("x", "y", "z"))
    assert np.allclose(df.where("k = 0").first().m, np.sqrt(x[0] ** 2 + 2 * y[0] ** 2))
    got = {r.k: r for r in features.channel_features(df, ["k"], ["x", "y"], 50.0, 0.12, absolute=True).collect()}
    assert got[0].x_peaks == len(kernels.find_peaks(np.abs(x[0]), 6)) and got[0].y_rms == pytest.approx(np.sqrt((y[0] ** 2).mean())) and len(got) == 4
    assert got[0].x_dom_freq == pytest.approx(kernels.dominant_frequency(x[0] - x[0].mean(), 50.0)) and got[2].x_dom_freq == 0 and got[2].x_ptp == 0
    z = lambda v: (v - v.mean()) / (v.std() + 1e-9)
    lags = {r.k: r for r in features.best_lag(df, ["k"], "x", "y", 25, "g").collect()}
    for k in range(2):
        c = np.correlate(z(x[k]), z(y[k]), "full")[39 - 25 : 39 + 26]
        assert lags[k].g_lag == int(c.argmax()) - 25 and lags[k].g_corr == pytest.approx(c.max() / 40)
    assert lags[1].g_lag == -4 and len(lags) == 4 and lags[2].g_corr == pytest.approx(0, abs=1e-6) and -20 < lags[3].g_lag < 20
    none = spark.createDataFrame([(1, [], [])], "k int, x array<double>, y array<double>")
    assert features.best_lag(none, ["k"], "x", "y", 3, "g").count() == 0


def test_releases_of_a_pose_table(spark):
    rng = np.random.default_rng(12)
    joints = ("right_shoulder", "right_elbow", "right_wrist", "left_wrist")
    p = {j: rng.normal(size=(120, 3)).cumsum(0) * 0.01 for j in joints}
    p["right_wrist"][60:] += [0.5, -1.0, 0]
    names = [f"{j}_{a}" for j in joints for a in "xyz"]
    rows = [(1, t, *(float(p[j][t, k]) for j in joints for k in range(3)), 0.9, 1.4 if t != 3 else None) for t in range(120)]
    df = spark.createDataFrame(rows, f"r int, t int, {', '.join(f'{n} double' for n in names)}, visibility_right_wrist double, visibility_right_elbow double")
    got = features.pose_motion(df, ["r"], ["t"], 30.0).orderBy("t").collect()
    speed = {j: np.linalg.norm(np.gradient(p[j], axis=0), axis=1) * 30 for j in joints}
    u, v = p["right_shoulder"] - p["right_elbow"], p["right_wrist"] - p["right_elbow"]
    angle = np.degrees(np.arccos(np.clip((u * v).sum(1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)), -1, 1)))
    assert np.allclose([r.wrist_speed for r in got], speed["right_wrist"]) and np.allclose([r.wrists_apart for r in got], abs(speed["right_wrist"] - speed["left_wrist"]))
    assert np.allclose([r.elbow_angle for r in got], angle, atol=1e-4) and np.allclose([r.extension for r in got], np.gradient(angle) * 30, atol=1e-2) and np.allclose([r.rise for r in got], -np.gradient(p["right_wrist"][:, 1]) * 30)
    top = features.release_candidates(features.pose_motion(df, ["r"], ["t"], 30.0), ["r"], ["t"], 30.0, 1, 0.5).orderBy("place").collect()
    assert [r.event for r in top] == [f"V{k:02d}" for k in range(1, len(top) + 1)] and max(top, key=lambda r: r.score).place in range(57, 63)


def test_labels_by_kind_of_recording(spark):
    x = [0.0, 9.0, 9.0, 0.0] * 3
    df = spark.createDataFrame([(r, t, v) for r in "abc" for t, v in enumerate(x)], "r string, t int, x double")
    kinds = spark.createDataFrame([("a", "discrete", ["up", "down"]), ("b", "discrete", ["1", "2", "3", "4"])], "r string, kind string, names array<string>")
    got = {(q.r, q.t): (q.assigned, q.cycle) for q in segment.routed_labels(df, kinds, ["r"], ["t"], "x", 4, 2, 1, 2, 1.0).collect()}
    assert [got["a", t] for t in (0, 1, 2, 3, 5, 6, 9, 10)] == [("null", -1), ("up", 0), ("up", 0), ("null", -1), ("down", 0), ("down", 0), ("null", -1), ("null", -1)]
    assert [got["b", t][0] for t in (1, 5, 9)] == ["1", "2", "3"] and {got["c", t] for t in range(12)} == {("null", -1)} and len(got) == 36
    assert segment.routed_labels(df.where("false"), kinds, ["r"], ["t"], "x", 4, 2, 1, 2, 1.0).count() == 0


def test_phases_at_the_ends_of_a_window(spark):
    df = spark.createDataFrame([(w, i, float(i % 5)) for w in (1, 2) for i in range(12)], "w int, i long, e double")
    releases = spark.createDataFrame([(1, 1, 12), (2, 11, 12)], "w int, release long, n long")
    got = {}
    for r in segment.shot_phases(segment.last_impact(df, releases, ["w"], "i", "e", 4, 5), 1, 4, 3).collect():
        got.setdefault(r.w, {})[r.phase] = (r.phase_start, r.phase_end)
    assert got[1] == {"preparation": (0, 0), "last_dribble": (0, 0), "gather": (0, 0), "release": (0, 2), "follow_through": (3, 4), "recovery": (5, 11)}
    assert got[2] == {"preparation": (0, 3), "last_dribble": (4, 6), "gather": (7, 9), "release": (10, 11)}


def test_working_point_without_a_fit(spark):
    rows = [("a", "a", 0.2), ("a", "b", 0.3), ("null", "a", 0.1), ("b", "b", None)]
    df = spark.createDataFrame(rows, "t string, q string, p double")
    got = {r.threshold: r for r in evaluation.working_point(df, "t", "q", "p", [0.15, 0.25, 0.9], "null").collect()}
    assert got[0.15].rejected == 0.5 and got[0.15].action_f1 == pytest.approx((2 / 3 + 0) / 2) and got[0.9].action_f1 == 0
    assert [t for t, r in got.items() if r.chosen] == [0.15]


def test_splits_keep_recordings_whole(spark):
    df = spark.createDataFrame([(f"r{i % 10}", i) for i in range(200)] + [(None, 200)], "rec string, id int")
    s = evaluation.split_recordings(df, "rec", 0.7).collect()
    by = {}
    for r in s:
        by.setdefault(r.rec, set()).add(r.train)
    assert len(s) == 201 and by.pop(None) == {None} and all(len(v) == 1 for v in by.values()) and sum(v == {True} for v in by.values()) == 7
    part = df.select(evaluation.hashed_share(F.col("id"), 0.8).alias("t")).where("t").count()
    assert 140 <= part <= 180
    f = spark.createDataFrame([(True, 3, "a"), (True, 2, "a"), (True, None, "a"), (False, 3, "b")], "d boolean, rep int, k string")
    got = [r.f for r in f.select(evaluation.repetition_fold(F.col("d"), F.col("rep"), F.col("k")).alias("f")).collect()]
    assert got[:3] == [1, 0, 0] and got[3] in (0, 1)


def test_a_saved_model_predicts_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(13)
    rows = [(int(i), float(a), float(b), "p" if a + b > 0 else "q") for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "id int, f double, g double, label string")
    for k, model in enumerate((learning.random_forest(df, ["f", "g"], "label", 5, 3), learning.linear_machine(df, ["f", "g"], "label"))):
        model.write().overwrite().save(str(tmp_path / f"m{k}"))
        again = PipelineModel.load(str(tmp_path / f"m{k}"))
        take = lambda m: [(r.id, r.prediction) for r in m.transform(df).orderBy("id").collect()]
        assert take(model) == take(again)
        assert model.transform(df).where("prediction = label_index").count() >= 108
