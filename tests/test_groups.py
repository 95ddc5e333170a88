"""Kernels of many groups side by side against the same kernels group by group."""

import numpy as np
import pytest

from kinetrace.functions import kernels
from kinetrace.operators import features, signal

RNG = np.random.default_rng(5)
GROUPS = [RNG.normal(0, 3, (n, 6)) + [0, 0, 9.8, 0, 0, 0] for n in (1, 70, 5, 64, 300, 66, 2, 16, 15)]


def test_filters_side_by_side():
    """lengths differ, some are too short for the filter."""
    b, a = kernels.butterworth(4, 0.5, 50.0, high=True)
    got = kernels.zero_phase_each(b, a, [g[:, :3].T for g in GROUPS])
    assert all(np.array_equal(y, kernels.zero_phase(b, a, g[:, :3].T)) for y, g in zip(got, GROUPS))


@pytest.mark.parametrize("each, one", [(kernels.madgwick_each, kernels.madgwick), (kernels.attitude_each, kernels.attitude)])
def test_attitudes_side_by_side(each, one):
    """F11"""
    got = each(GROUPS, 0.02)
    assert all(np.array_equal(q, one(g[:, :3], g[:, 3:], 0.02)) for q, g in zip(got, GROUPS))


def test_groups_stay_whole_over_batches(spark):
    """groups end inside a batch, span batches, and one has no name; null samples give null."""
    sizes = {1: 7, 2: 25_000, 3: 1, None: 11_000, 2**60 + 1: 20_000, 4: 3}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "g long, n long").selectExpr("g", "explode(sequence(n, 1, -1)) AS i", "n").selectExpr("g", "i", "n", "IF(i = 5, NULL, 1.0D) AS x")
    calls = signal.per_groups(df, ["g"], ["i"], ["x"], ["y", "m"], lambda groups: [np.column_stack([np.nancumsum(v) + 0 * v[:, 0:1].ravel(), np.full(len(v), len(groups))]) for v in groups])
    rows = calls.selectExpr("*", "IF(i = 5, y IS NULL, y = i - IF(i > 5, 1, 0)) AS good").groupBy("g").agg({"good": "min", "i": "count", "m": "max"}).collect()
    assert {r.g: r["count(i)"] for r in rows} == sizes and all(r["min(good)"] for r in rows) and max(r["max(m)"] for r in rows) > 1


def test_peaks_counted_side_by_side():
    """as one by one, with flat tops, ties of prominence, constant, rising and empty rows."""
    for n in (0, 1, 2, 3, 8, 32, 200):
        x = np.vstack([RNG.integers(0, k, (300, n)).astype(float) for k in (2, 4, 1000)] + [np.zeros((1, n)), np.arange(n)[None]])
        for least in (np.zeros(len(x)), np.ones(len(x)), 0.5 * (x.std(1) if n else np.zeros(len(x)))):
            assert kernels.count_peaks(x, least).tolist() == [len(kernels.find_peaks(v, prominence=p)) for v, p in zip(x, least)]


def test_means_of_features(spark):
    """no value of a window leaves its task, and the means are those of all values."""
    rows = [(i, {c: RNG.normal(0, 5, 32 if i % 3 else 20).tolist() for c in (("ax_node1", "ax_node2", "gx_node1") if i % 2 else ("ax_node1",))}) for i in range(40)]
    df = spark.createDataFrame([*rows, (40, {})], "id int, channels map<string,array<double>>").repartition(3)
    want = features.full_features(df, ["id"], "channels", 50.0, pairs=True).groupBy("feature").agg({"value": "avg", "*": "count"}).collect()
    got = {r.feature: (r.windows, r.mean) for r in features.mean_features(df, "channels", 50.0, pairs=True).collect()}
    assert len(got) == len(want) and all(got[r.feature] == (r["count(1)"], pytest.approx(r["avg(value)"], rel=1e-9, abs=1e-12)) for r in want)


@pytest.mark.parametrize("f", [kernels.madgwick_each, kernels.attitude_each])
def test_attitudes_of_many_few_and_parts(f):
    """many groups in arrays, few in plain floats and groups in parts give the same to the last bit, with samples
    that are lacking, lie still or overflow."""
    groups = [RNG.normal(0, 3, (n, 6)) + [0, 0, 9.8, 0, 0, 0] for n in [*range(20, 60), 200, 150]]
    groups[3][5], groups[-1][7, :3], groups[-2][9, 4] = 0, 1e200, np.nan
    with np.errstate(all="ignore"):
        got = f(groups, 0.02)
        assert all(np.array_equal(q, f([g], 0.02)[0], equal_nan=True) for q, g in zip(got, groups))
        for q, g in zip(got, groups):
            first = f([g[:13]], 0.02)[0]
            assert np.array_equal(np.concatenate([first, f([g[13:], groups[0]], 0.02, first[-1])[0]]), q, equal_nan=True)


@pytest.mark.parametrize("f", [kernels.madgwick_each, kernels.attitude_each])
def test_long_recordings_take_no_array_steps(f, monkeypatch):
    """a step of arrays costs as much as some twenty samples, so two recordings do not go by such steps."""
    steps, where = [], np.where
    monkeypatch.setattr(np, "where", lambda *a: steps.append(1) or where(*a))
    f([np.ones((500, 6)), np.ones((400, 6))], 0.02)
    assert len(steps) < 500


def test_long_groups_in_parts(spark):
    """of a recording that is longer than what a task holds, it holds a part."""
    sizes = {1: 130_000, 2: 3, 3: 75_000, 4: 1}
    df = spark.createDataFrame(list(sizes.items()), "g int, n int").selectExpr("g", "explode(sequence(1, n)) AS i", "1.0D AS x").coalesce(1)

    def running(groups, before):
        start = [before[0] if before is not None else 0.0] + [0.0] * (len(groups) - 1)
        return [np.column_stack([s + np.cumsum(v), np.full(len(v), sum(len(u) for u in groups))]) for s, v in zip(start, groups)]

    rows = signal.per_groups(df, ["g"], ["i"], ["x"], ["y", "held"], running, carried=True)
    assert {r.g: r.n for r in rows.where("y = i").groupBy("g").count().withColumnRenamed("count", "n").collect()} == sizes
    assert rows.agg({"held": "max"}).first()[0] <= 60_000
