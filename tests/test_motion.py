"""Peaks and their shapes, filters in chunks, event windows, physical checks, kernel machines, rejection and rules,
each against a plain version."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinetrace.functions import kernels as k
from kinetrace.operators import evaluation, features, folds, joins, kernel_machine, learning, quality, rejection, resample, rules, signal, skeleton, windows
from kinetrace.sources import io


def plain_prominences(x, peaks):
    out = np.empty(len(peaks))
    for n, p in enumerate(peaks):
        higher = np.flatnonzero(x > x[p])
        j = np.searchsorted(higher, p)
        a, b = (higher[j - 1] + 1 if j else 0), (higher[j] if j < len(higher) else len(x))
        out[n] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    return out


def plain_width(x, p, level):
    i, j = p, p
    while i > 0 and x[i] > level:
        i -= 1
    while j < len(x) - 1 and x[j] > level:
        j += 1
    left = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else i
    return (j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else j) - left


def test_peak_shapes_against_definition():
    rng = np.random.default_rng(0)
    for t in range(800):
        x = rng.integers(-4, 5, rng.integers(3, 40)).astype(float) if t % 2 else rng.standard_normal(rng.integers(3, 60))
        p = k.local_maxima(x)
        high = plain_prominences(x, p)
        assert np.array_equal(high, k.prominences(x, p))
        assert np.allclose([plain_width(x, a, x[a] - 0.5 * h) for a, h in zip(p, high)], k.widths(x, p))
        far, left = [], list(np.argsort(x[p], kind="stable")[::-1])
        for n in left:
            if all(abs(p[n] - f) >= 4 for f in far):
                far.append(p[n])
        assert sorted(far) == k.find_peaks(x, 4).tolist()


def test_peaks_of_a_long_recording_take_seconds():
    x, start = np.cumsum(np.random.default_rng(0).standard_normal(10**6)), time.perf_counter()
    p = k.find_peaks(x, 20, 1.0)
    assert len(p) > 10_000 and len(k.widths(x, p)) == len(p) and time.perf_counter() - start < 30


def test_peaks_near_a_count():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, wanted = rng.standard_normal(60), int(rng.integers(1, 12))
        tries = []
        for q in np.linspace(0.9, 0.45, 30):
            p = k.find_peaks(x, 3, max(np.quantile(x, q) - np.quantile(x, 0.25), 1e-9))
            tries.append((abs(len(p) - wanted), p))
        best = min(tries, key=lambda t: t[0])[1]
        high = k.prominences(x, best)
        want = sorted(best[np.argsort(high, kind="stable")[::-1][:wanted]].tolist())
        assert k.peaks_for_count(x, wanted, 3).tolist() == want


@pytest.mark.parametrize("span", [64, 10, 5000])
def test_filters_in_chunks_equal_whole_ones(spark, span):
    rng, rows = np.random.default_rng(0), []
    for u, n in ((1, 600), (2, 64), (3, 13), (4, 16), (5, 70), (None, 200)):
        rows += [(u, i, float(v), float(v / 3), 9.8, float(0.1 * v), 0.2, 0.3, "kept") for i, v in enumerate(np.cumsum(rng.standard_normal(n)))]
    df = spark.createDataFrame(rows, "u long, i long, x double, y double, z double, g double, g2 double, g3 double, other string").repartition(5)
    made = {
        "x_filtered": [lambda s: signal.smoothed(df, ["u"], ["i"], "x", 8.0, 50.0, 3, span=s), lambda s: signal.smoothed(df, ["u"], ["i"], "x", 0.5, 50.0, 4, True, span=s), lambda s: signal.banded(df, ["u"], ["i"], "x", 1.0, 8.0, 50.0, span=s)],
        "roll": [lambda s: signal.tilted(df, ["u"], ["i"], ["x", "y", "z"], ["g", "g2", "g3"], 0.02, span=s)],
    }
    for c, fs in made.items():
        for f in fs:
            a, b = ({(r.u, r.i): r[c] for r in f(s).select("u", "i", c).collect()} for s in (None, span))
            assert a.keys() == b.keys() and len(a) == len(rows) and max(abs(a[key] - b[key]) for key in a) < 1e-8


def test_chunks_spread_one_recording(spark):
    df = spark.range(1000).select(F.lit(1).alias("u"), F.col("id").alias("i"), F.sin("id").alias("x"))
    plan = signal.smoothed(df, ["u"], ["i"], "x", 8.0, 50.0, span=64)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "hashpartitioning(u" in plan and "__chunk" in plan


def test_event_anchors_fall_back(spark):
    shapes = {"peak": [0.0, 1.0, 9.0, 1.0, 2.0, 1.0, 0.0, 1.0], "centroid": [float(v) for v in range(8)], "middle": [0.0] * 8}
    rows = [(1, i + 10 * n, v, name if i % 10 < 8 else "null") for n, (name, xs) in enumerate(shapes.items()) for i, v in enumerate(xs)]
    rows += [(1, 40 + i, 1.0, "null") for i in range(2)] + [(1, 50 + i, 5.0, "middle") for i in range(3)] + [(None, i, 1.0, "null") for i in range(3)]
    df = windows.indexed(spark.createDataFrame(rows, "u long, t long, x double, label string"), ["u"], ["t"])
    got = windows.event_anchors(windows.event_segments(df, ["u"], ["t"], "label"), ["u"], "i", "x", "label").collect()
    assert {r.label: (r.kind, r.anchor) for r in got} == {"peak": ("peak", 2), "centroid": ("centroid", 8 + 5), "middle": ("middle", 16 + 4)} and len(got) == 3


@pytest.mark.parametrize("borders", ["clip", "shift", "drop"])
def test_cuts_at_borders(spark, borders):
    df = spark.createDataFrame([(u, i, float(i + 1)) for u, n in ((1, 20), (2, 6), (None, 20)) for i in range(n)], "u long, i long, x double")
    centres = spark.createDataFrame([(u, c) for u in (1, 2, None) for c in range(7)] + [(1, 19), (1, 18), (1, 12)], "u long, center long")
    got = {}
    for r in windows.cut(df, centres, ["u"], ["i"], ["x"], 3, 5, 8, borders, least=2).collect():
        got.setdefault((r.u, r.center), {})[r.k] = r.x
    want = {}
    for u, c in [tuple(r) for r in centres.collect()]:
        n = 6 if u == 2 else 20
        a, b = c - 3, c + 5
        if borders == "drop" and (a < 0 or b > n):
            continue
        if borders == "shift":
            a = max(0, min(max(0, a), n - 8))
            b = min(n, max(min(n, c + 5), 8))
        a, b = max(0, a), min(n, b)
        if b - a >= 2:
            xs = [float(i + 1) for i in range(a, b)][:8]
            want[u, c] = dict(enumerate(xs + [0.0] * (8 - len(xs))))
    assert got == want


@pytest.mark.parametrize("borders", ["clip", "shift", "drop"])
def test_shifts_are_centres_of_their_own(spark, borders):
    df = spark.createDataFrame([(u, i, None if i % 7 == 3 else float(i + 1)) for u, n in ((1, 45), (2, 6), (None, 20)) for i in range(n)], "u long, i long, x double")
    centres = spark.createDataFrame([(u, c) for u in (1, 2, None, 3) for c in (-90, -4, 0, 3, 5, 17, 19, 30, 44, 49, 90)], "u long, center long")
    got = [(r.u, r.center, r["shift"], r.x) for r in windows.cut_samples(df, centres, ["u"], ["i"], ["x"], 3, 5, 8, borders, 2, [4, 0, -11]).collect()]
    each = [(r.u, r.center - k, k, r.x) for k in (4, 0, -11) for r in windows.cut_samples(df, centres.withColumn("center", F.col("center") + k), ["u"], ["i"], ["x"], 3, 5, 8, borders, 2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, each)) and len(got) > 20
    assert [x for u, c, k, x in got if (u, c, k) == (1, 19, 4)] == [[float(i + 1) if i % 7 != 3 else 0.0 for i in range(20, 28)]]


def test_reasons_of_doubtful_segments(spark):
    narrow, wide = [0.0] * 8 + [30.0] + [0.0] * 7, [0.0] * 4 + [30.0] * 8 + [0.0] * 4
    cases = {
        "sound": ("dribble", narrow, 1.0, 0, 0), "no narrow impact": ("dribble", wide, 1.0, 0, 0), "not vertical": ("dribble", narrow, 50.0, 0, 0),
        "good": ("shot", narrow, 1.0, 40, 3.0), "no pitch": ("shot", narrow, 1.0, 0, 3.0), "little pitch": ("shot", narrow, 1.0, 20, 3.0), "weak peak": ("shot", narrow, 1.0, 40, 1.0), "other": ("pass", wide, 1.0, 0, 0),
    }
    rows = [(name, i, label, v, across, float(pitch if i == 3 else 0), float(up)) for name, (label, vs, across, pitch, up) in cases.items() for i, v in enumerate(vs)] + [("empty", 0, "dribble", None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, i long, label string, v double, h double, pitch double, up double")
    got = {r.name: (r.reason, r.suspicious) for r in features.validated(df, ["name"], ["i"], "label", "v", "h", "pitch", "up", 50.0).collect()}
    reasons = {"no narrow impact", "not vertical", "little pitch", "weak peak", "empty"}
    assert got == {n: (n, True) if n in reasons else ("no pitch" if n == "no pitch" else "", False) for n in [*cases, "empty"]}


def test_peak_confidence(spark):
    rng = np.random.default_rng(5)
    rows = [(u, i, float(v)) for u in (1, 2) for i, v in enumerate(rng.standard_normal(50))]
    df, peaks = spark.createDataFrame(rows, "u long, i long, x double"), spark.createDataFrame([(1, 0), (1, 25), (2, 49)], "u long, place long")
    for r in features.peak_confidence(df, peaks, ["u"], "i", "x", 6).collect():
        near = np.array([x for u, i, x in rows if u == r.u and abs(i - r.place) <= 6])
        x = next(x for u, i, x in rows if (u, i) == (r.u, r.place))
        assert r.confidence == pytest.approx(max(0, (x - np.median(near)) / near.std()))


def test_undersampling_is_exact(spark):
    kinds = "label string, key long, x long"
    few = spark.range(9000).select(F.lit("null").alias("label"), (F.col("id") % 4).alias("key"), F.lit(1).cast("long").alias("x"))
    other = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), "id", F.col("id").alias("x"))
    df = few.union(other).union(spark.createDataFrame([(None, 1, 1)], kinds))
    got = {r.label: r["count"] for r in evaluation.undersampled(df, "label", "null", "key").groupBy("label").count().collect()}
    assert got == {"null": 750, "a": 500, "b": 500, None: 1}
    unlike = spark.range(5000).select(F.lit("null").alias("label"), F.col("id").alias("key"), F.col("id").alias("x")).union(other)
    kept = evaluation.undersampled(unlike, "label", "null", "key").where("label = 'null'").collect()
    assert len(kept) == 750 == len({r.x for r in kept})
    assert evaluation.undersampled(few, "label", "null", "key").count() == 0 and evaluation.undersampled(other, "label", "null", "key").count() == 1000


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    groups = {1: rng.standard_normal(3000), 2: np.full(500, 7.0), None: np.array([1.0, 2.0]), 3: np.concatenate([np.zeros(2000), rng.random(900)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, None)]
    df = spark.createDataFrame(rows, "g long, x double")
    for p in (0.0, 0.5, 0.93, 1.0):
        got = {r.g: r.quantile for r in quality.exact_quantile(df, ["g"], "x", p).collect()}
        assert got == pytest.approx({g: np.quantile(v, p) for g, v in groups.items()})
    assert quality.exact_quantile(df, [], "x", 0.5).first()[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert quality.exact_quantile(df.where("false"), ["g"], "x", 0.5).count() == 0


def plain_repaired(t, x):
    grid = np.linspace(t[0], t[-1], len(t))
    return list(zip(grid, np.interp(grid, t, x)))


def test_repaired_recordings(spark):
    rng = np.random.default_rng(2)
    uneven = np.cumsum(rng.integers(1, 9, 40)).astype(float)
    rows = [(1, float(i), float(i * i)) for i in range(20)] + [(2, float(t), float(v)) for t, v in zip(uneven, rng.standard_normal(40))]
    got = resample.repaired(spark.createDataFrame(rows, "u long, t double, x double"), ["u"], "t", ["x"]).orderBy("u", "t").collect()
    want = [(1, t, x) for _, t, x in rows[:20]] + [(2, t, x) for t, x in plain_repaired(uneven, np.array([r[2] for r in rows[20:]]))]
    assert np.allclose([tuple(r) for r in got], want)


def vectors(spark, n=240, p=4):
    rng = np.random.default_rng(7)
    label = rng.integers(0, 3, n)
    x = rng.standard_normal((n, p)) + np.array([[0.0, 0, 0, 0], [3, 0, 0, 0], [0, 0, -3, 0]])[label]
    df = spark.createDataFrame([(int(i), [float(v) for v in row], f"c{c}") for i, (row, c) in enumerate(zip(x, label))], "id long, v array<double>, label string").repartition(5)
    return x, np.array([f"c{c}" for c in label]), df


def test_kernel_features_approximate_the_kernel(spark):
    x, _, df = vectors(spark, 40)
    wide = df.select("id", *[F.col("v")[i].alias(f"f{i}") for i in range(4)])
    phi = np.array([r.rff for r in learning.kernel_features(wide, [f"f{i}" for i in range(4)], 0.1, 2000).orderBy("id").collect()])
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(phi @ phi.T - want).max() < 0.15


def test_kernel_machines_against_numpy(spark):
    x, y, df = vectors(spark)
    rows = kernel_machine.prepared(df, "v", "label", "id", 3)
    costs, gammas = [0.1, 10.0], [0.02, 0.3]
    grid = kernel_machine.fit_grid(rows, costs, gammas, 50)
    got = {(r.gamma, r.cost, r.fold): (r.n, r.right) for r in kernel_machine.scored_grid(rows, grid).collect()}
    folds = {r.id: r.fold for r in rows.collect()}
    fold = np.array([folds[i] for i in range(len(x))])
    classes, b = sorted(set(y)), kernel_machine.basis(x.mean(0), x.std(0), gammas, 50)
    assert np.allclose(b.mean, grid.basis.mean) and np.allclose(b.sd, grid.basis.sd)
    for g in gammas:
        phi = b.of(x, g)
        for c in costs:
            for f in range(3):
                at, test = fold != f, fold == f
                weight = np.array([at.sum() / (3 * (y[at] == name).sum()) for name in y[at]])
                sides = np.where(y[at][:, None] == np.array(classes)[None], 1.0, -1.0)
                w = np.linalg.solve((phi[at] * weight[:, None]).T @ phi[at] + np.diag([1 / c] * 50 + [1e-9]), (phi[at] * weight[:, None]).T @ sides)
                right = int((np.array(classes)[(phi[test] @ w).argmax(1)] == y[test]).sum())
                assert got[g, c, f] == (int(test.sum()), right)
    assert max(r for _, r in got.values()) / max(n for n, _ in got.values()) > 0.7
    m = kernel_machine.machine(rows, grid, 0.02, 10.0)
    out = kernel_machine.classified(rows, grid, m, 0.02).collect()
    assert len(out) == len(x) and all(abs(sum(r.probabilities) - 1) < 1e-9 and r.probability == max(r.probabilities) for r in out)
    sure = np.mean([r.probability for r in out])
    assert abs(sure - np.mean([r.predicted == r.label for r in out])) < 0.12 and (m.slope > 0).all()


def test_sweep_over_folds(spark):
    """Each model without each fold, against a loop."""
    x, y, df = vectors(spark)
    rows = kernel_machine.prepared(df, "v", "label", "id", 3)
    models = {"centroids": folds.centroids(), "neighbours": folds.neighbours(3), "machine": folds.machine(), "forest": folds.forest(15, 5)}
    got = folds.swept(rows, models).collect()
    assert len(got) == 4 * len(x) == len({(r.id, r.model) for r in got})
    held, classes = folds.fitted(rows, models)
    assert len(held) == 12 and classes == ["c0", "c1", "c2"]
    fold = np.array([{r.id: r.fold for r in rows.collect()}[i] for i in range(len(x))])
    place = np.array([classes.index(c) for c in y])
    order = np.array([r.id for r in rows.orderBy(F.xxhash64("id"), "id").collect()])
    for name, model in models.items():
        want = np.empty(len(x), object)
        for f in range(3):
            at, test = order[fold[order] != f], np.flatnonzero(fold == f)
            arrays = model.fit(x[at], place[at], 3, folds._seed(name, f))
            want[test] = [classes[i] for i in model.predict(arrays, x[test])]
        assert {r.id: r.predicted for r in got if r.model == name} == dict(enumerate(want))
        assert np.mean(want == y) > 0.7, name
    worth = {r.feature: r.importance for r in folds.forest_importances(rows, list("abcd"), 15, 5).collect()}
    assert sum(worth.values()) == pytest.approx(1) and max(worth, key=worth.get) in "ac" and min(worth, key=worth.get) in "bd"


def test_leave_one_out(spark):
    x, y, df = vectors(spark, 60)
    rows = kernel_machine.prepared(df, "v", "label", "id", 3)
    models = {"neighbours": folds.neighbours(1), "centroids": folds.centroids()}
    got = folds.left_out(rows, models).collect()
    assert len(got) == 120
    d = lambda i: ((x - np.delete(x, i, 0).mean(0)) / np.delete(x, i, 0).std(0))
    for i in range(60):
        z = d(i)
        far = ((z - z[i]) ** 2).sum(1)
        far[i] = np.inf
        assert next(r.predicted for r in got if r.id == i and r.model == "neighbours") == y[far.argmin()]
    assert folds.left_out(rows.where("false"), models).count() == 0 and folds.swept(rows.where("false"), models).count() == 0


def test_probability_curve():
    rng = np.random.default_rng(1)
    margin = rng.normal(0, 1, 20_000)
    yes = rng.random(20_000) < 1 / (1 + np.exp(-(2 * margin - 0.5)))
    place = np.clip(np.rint(margin / 0.05), -80, 80).astype(int) + 80
    slope, offset = kernel_machine.probability_curve(np.arange(-80, 81) * 0.05, np.bincount(place[yes], minlength=161), np.bincount(place[~yes], minlength=161))
    assert slope == pytest.approx(2, abs=0.1) and offset == pytest.approx(-0.5, abs=0.1)


def test_thresholds_by_class(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"c{i % 2}", float(d)) for i, d in enumerate(rng.exponential(1, 4000) * (1 + np.arange(4000) % 2 * 4))] + [(-1, "new", 100.0), (-2, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, label string, distance double")
    t = {r.label: r.threshold for r in rejection.class_thresholds(df.where("id >= 0"), "label").collect()}
    exact = {r.label: r.quantile for r in quality.exact_quantile(df.where("id >= 0"), ["label"], "distance", 0.95).collect()}
    assert t == pytest.approx(exact, rel=0.02) and t["c1"] > 3 * t["c0"]
    out = rejection.rejected_by_class(df, "label", F.lit(0.9), rejection.class_thresholds(df.where("id >= 0"), "label"), 0.5).collect()
    assert len(out) == len(rows) and all((r.final == "unknown") == (r.label in t and r.distance > t[r.label]) for r in out if r.label) and next(r.final for r in out if r.id == -1) == "new"


def test_rules(spark):
    df = spark.createDataFrame([(1, 30.0, 2, None), (2, 30.0, 1, 1.0), (3, 10.0, 9, 5.0), (4, 1.0, 0, 5.0)], "id long, acc_mag_std double, peak_count long, speed double")
    bounds, priority = rules.from_config({"thresholds": {"run": {"acc_std_min": 10, "uwb_vel_min": 3}, "hop": {"peak_count_min": 1}}, "priority": ["run", "hop"]}, {"acc_std": "acc_mag_std", "uwb_vel": "speed"})
    got = lambda c, d=df: [r[0] for r in d.orderBy("id").select(c).collect()]
    assert got(rules.by_priority(bounds, priority, optional=("speed",), columns=df.columns)[0]) == ["run", "hop", "run", "unknown"]
    assert got(rules.by_priority(bounds, priority, optional=("speed",), columns=["acc_mag_std", "peak_count"])[0], df.drop("speed")) == ["run", "run", "run", "unknown"]
    assert got(rules.best_scored({"hop": {"peak_count_min": 2}, "run": {"acc_mag_std_min": 10}})[0]) == ["hop", "run", "hop", "unknown"]
    with pytest.raises(ValueError):
        rules.from_config({"thresholds": {"a": {"speed": 1}}, "priority": []}, {})


def test_static_check(spark):
    rest = [(1, 9.8 + 0.01 * (i % 3), 0.02 * (i % 2), 0.01) for i in range(20)]
    rows = rest + [(2, a + 2, v, g) for _, a, v, g in rest] + [(3, a, v + 3, g) for _, a, v, g in rest] + [(4, a, v, g + 1) for _, a, v, g in rest] + [(5, 9.8, 0.0, 0.0)]
    got = {r.u: r.passed for r in quality.static_check(spark.createDataFrame(rows, "u long, a double, v double, g double"), ["u"], "a", "v", "g").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_metadata_and_missing_nodes(spark):
    rows = [('{"eu": {"P1": {"age": 20, "skill": "high"}}}',), ("{broken",), ("[1]",), (None,), ("{}",)]
    got = io.flatten_metadata(spark.createDataFrame(rows, "json string")).collect()
    assert sorted((r.region or "", r.subject or "", r.age or 0, r._corrupt_record or "") for r in got) == [("", "", 0, "[1]"), ("", "", 0, "{broken"), ("eu", "P1", 20, "")]
    wanted = spark.createDataFrame([("run one long",), ("nothing like",)], "recording string")
    files = spark.createDataFrame([("run one long", n) for n in (1, 2, 4)], "recording string, node int")
    assert sorted(tuple(r) for r in io.missing_nodes(wanted, files).collect()) == [("nothing like", n) for n in (1, 2, 3, 4)] + [("run one long", 3)]


def test_features_of_four_nodes(spark):
    rng = np.random.default_rng(9)
    names = [f"{c}_{n}" for n in features.NODES for c in ("ax", "ay", "az", "gx", "gy", "gz", "a_mag", "a_vert", "a_horiz", "pitch")]
    rows = [(i, {c: [float(v) for v in (np.zeros(n) if c == "az_node3" else rng.standard_normal(n))] for c in names}) for i, n in enumerate((60, 60, 40, 60))] + [(9, {"x": [1.0, 2.0, 3.0, 5.0]}), (10, {})]
    df = spark.createDataFrame(rows, "id long, channels map<string,array<double>>")
    got = {}
    for r in features.full_features(df, ["id"], "channels", 50.0, pairs=True).collect():
        got.setdefault(r.id, {})[r.feature] = r.value
    assert set(got) == {0, 1, 2, 3, 9} and len(got[0]) == 40 * 18 + 4 * 5 + 34 + 40 * 39 // 2 + 10 * 6
    for i, m in rows[:4]:
        x = {c: np.array(v) for c, v in m.items()}
        one = {f"{c}_{f}": float(v[0]) for c in names for f, v in signal.time_and_frequency(x[c][None], 50.0).items()} | features.between_nodes(x, 50.0)
        for n in features.NODES:
            one |= {f"rotation_{f}_{n}": v for f, v in features.rotation_shares(*(x[f"{g}_{n}"] for g in ("gx", "gy", "gz"))).items()}
        for a in names:
            for b in names:
                if a < b:
                    one[f"corr_{a}_{b}"] = float(np.corrcoef(x[a], x[b])[0, 1]) if x[a].std() > 0 and x[b].std() > 0 else 0.0
        for f, v in one.items():
            assert got[i][f] == pytest.approx(v if np.isfinite(v) else 0.0, abs=1e-9, rel=1e-6), f
        assert got[i]["ratio_ax_node1_ax_node2"] == pytest.approx(np.sqrt((x["ax_node1"] ** 2).mean() / (x["ax_node2"] ** 2).mean()))


def test_ranks(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 9.0)], "feature string, score double")
    assert [(r["feature"], r["rank"]) for r in evaluation.rank_by(df, "score", "feature").orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert learning.mean_rank(["a", "b", "c"], ["b", "a", "c"], ["b", "c", "a"]) == ["b", "a", "c"]


def test_recentred(spark):
    row = spark.range(1).select(*features.recentred(F.lit(3.0), F.lit(4.0), F.lit(5.0), (F.lit(1.0), F.lit(1.0), F.lit(1.0)), F.lit(0.5), 2.0)).first()
    assert tuple(row) == pytest.approx((2 * 1.16, -4 * 1.16, -3 * 1.16))


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], StructType()).select(F.lit(1).cast("long").alias("u"), F.lit(1).cast("long").alias("i"), F.lit(1.0).alias("x"), F.lit("a").alias("label"))
    assert signal.smoothed(empty, ["u"], ["i"], "x", 8.0, 50.0, span=64).count() == 0
    assert windows.event_anchors(windows.event_segments(empty, ["u"], ["i"], "label"), ["u"], "i", "x", "label").count() == 0
    with pytest.raises(ValueError):
        kernel_machine.fit_grid(kernel_machine.prepared(empty.select("u", F.array("x").alias("v"), "label"), "v", "label", "u", 3), [1.0], [0.1])


@pytest.mark.parametrize("size", [20_000, 7])
def test_pruned_neighbours_are_exact(spark, size, monkeypatch):
    """Clusters far apart, ties, repeated vectors and queries that are no rows; most pairs are never computed."""
    monkeypatch.setattr(joins, "ROWS_AT_ONCE", size)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((60, 3)) * 0.2 + 5 * c for c in range(10)] + [np.ones((30, 3))])
    rows = [(i, [float(v) for v in row], f"c{i % 4}") for i, row in enumerate(x)]
    train = spark.createDataFrame(rows, "id long, v array<double>, label string")
    queries = train.where("id % 9 = 0").select(F.col("id").alias("qid"), "v").union(spark.createDataFrame([(9001, [100.0, 0.0, 0.0]), (9002, [1.0, 1.0, 1.0])], "qid long, v array<double>"))
    got, told = joins.pruned_neighbours(queries, train, 5)
    want = joins.nearest_neighbours(queries, train, 5)
    plain = {}
    for q in queries.collect():
        near = sorted((round(float(((x[i] - np.array(q.v)) ** 2).sum()), 9), i) for i in range(len(x)) if i != q.qid)[:5]
        votes = [rows[i][2] for _, i in near]
        plain[q.qid] = min((-votes.count(c), c) for c in set(votes))
    assert {r.qid: (-r.votes, r.label) for r in want.collect()} == plain
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == queries.count()
    shares = [r.computed / r.rows for r in told.collect()]
    assert len(shares) == queries.count() and np.mean(shares) < 0.5
    assert joins.pruned_neighbours(queries, train.where("false"))[0].count() == 0
    few = joins.pruned_neighbours(queries, train.limit(3), 5)[0].collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, joins.nearest_neighbours(queries, train.limit(3), 5).collect()))


def test_animation_documents(spark):
    names = ["left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip"]
    rows = [(s, f, j, float(k + f), float(k % 3), float(f * s)) for s in (1, 2, 3) for f in range(10) for k, j in enumerate(names)]
    template = skeleton.skeleton_template(spark.createDataFrame(rows, "seg long, frame long, joint string, x double, y double, z double"), ["seg"], "frame", "joint")
    assert template.count() == 80 and {r.n for r in template.collect()} == {3}
    hips = template.where("joint LIKE '%hip'").groupBy("frame").agg(*[F.abs(F.sum(a)).alias(a) for a in "xyz"]).collect()
    assert all(max(r.x, r.y, r.z) < 1e-9 for r in hips)
    windows_ = spark.createDataFrame([(1, 7, 3, 1.0, 1.0, 1.0), (2, 1, 0, 2.0, 1.0, 1.0), (3, 0, 0, 1.0, 1.0, 1.0)], "w long, n long, release long, s1 double, s2 double, s3 double")
    frames = skeleton.fused_frames(windows_, skeleton.framed(template, "frame", "joint"), ["w"], 10, names).withColumn("phase", F.lit("rise"))
    docs = {r.w: (r.n_frames, __import__("json").loads(r.document)) for r in skeleton.animations(frames, ["w"], ["phase"]).collect()}
    assert {w: n for w, (n, _) in docs.items()} == {1: 7, 2: 1} and [f["frame"] for f in docs[1][1]["frames"]] == list(range(7))
    plain = {(r.frame, r.joint): (r.x, r.y, r.z) for r in template.collect()}
    last, middle = docs[1][1]["frames"][6], docs[1][1]["frames"][3]
    assert last["joints"]["right_wrist"] == pytest.approx(plain[9, "right_wrist"], abs=1e-5) and middle["joints"]["left_hip"] == pytest.approx(plain[4, "left_hip"], abs=1e-5)


def test_quantile_scaling_of_a_missing_column(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 5.0)], "u long, x double")
    from kinetrace.operators import robust

    assert [r.scaled for r in robust.quantile_scaled(df, ["u"], "nothing", 0.8, 1.2).collect()] == [1.0] * 3
    assert sorted(r.scaled for r in robust.quantile_scaled(df, ["u"], "x", 0.8, 1.2).collect()) == pytest.approx([0.8, 0.8, 1.2])


def test_linear_machine_scales_by_the_population(spark):
    _, y, df = vectors(spark, 60)
    wide = df.select("label", *[F.col("v")[i].alias(f"f{i}") for i in range(4)])
    out = learning.linear_machine(wide, [f"f{i}" for i in range(4)], "label").transform(wide).select("features").collect()
    assert np.array([r[0].toArray() for r in out]).std(0) == pytest.approx(np.ones(4))
