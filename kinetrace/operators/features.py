"""The full feature set of a window of several nodes, in long form: 18 for each channel, rotation shares of each
node, and 34 that compare nodes. Channels are bound by name, ``<channel>_<node>``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import kernels
from kinetrace.functions.columns import joint_angle, norm, numbered
from kinetrace.operators.segment import rectified_score
from kinetrace.operators.signal import counted_peaks, time_and_frequency
from kinetrace.operators.windows import gradient, over

#: Which node is worn where, and the norm, in metres a second squared, under which a node falls.
RIGHT_ARM, RIGHT_HAND, LEFT_HAND, LEFT_ARM = "node1", "node2", "node3", "node4"
NODES = (RIGHT_ARM, RIGHT_HAND, LEFT_HAND, LEFT_ARM)
FALLING = 2.0
#: Weights of the score by which a release is found in pose tables.
RELEASE_WEIGHTS = {"wrist_speed": 0.45, "elbow_speed": 0.20, "extension": 0.20, "rise": 0.10, "wrists_apart": 0.05}
TINY = 1e-12
CHANNEL = ("mean", "std", "min", "max", "ptp", "rms", "dom_freq", "peaks")


def rotation_shares(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> dict[str, float]:
    """Share of each axis in a node's rotation energy, the strongest axis, and its lead over the second."""
    energy = np.array([(a**2).sum() for a in (x, y, z)])
    order = np.sort(energy)[::-1]
    shares = energy / (energy.sum() + TINY)
    return {"share_x": shares[0], "share_y": shares[1], "share_z": shares[2], "strongest": float(energy.argmax()), "lead": order[0] / (order[1] + TINY)}


def longest_true(mask: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def between_nodes(c: dict[str, np.ndarray], rate: float) -> dict[str, float]:
    """Synchrony, push, period, one-sidedness, falling, posture, correlation and energy ratios."""
    mag = {n: c[f"a_mag_{n}"] for n in NODES}
    power = {n: float((m**2).mean()) for n, m in mag.items()}
    smooth = {n: np.convolve(np.abs(mag[n]), np.full(5, 0.2), "same") for n in (RIGHT_HAND, LEFT_HAND)}
    together, lag = kernels.cross_correlation(smooth[RIGHT_HAND], smooth[LEFT_HAND])
    first = [p[0] / rate for m in mag.values() if len(p := kernels.find_peaks(m, prominence=0.5 * m.std()))]
    height, period = kernels.autocorrelation_peak(smooth[RIGHT_HAND])
    out = {
        "sync_max": together, "sync_lag": lag / rate, "sync_spread": max(first) - min(first) if len(first) > 1 else 0.0, "period_height": height, "period_lag": period / rate,
        "period_impacts": float(len(kernels.find_peaks(np.abs(mag[RIGHT_HAND]), prominence=0.3 * mag[RIGHT_HAND].std()))),
        "left_to_right": (power[LEFT_HAND] + power[LEFT_ARM]) / (power[RIGHT_HAND] + power[RIGHT_ARM] + TINY), "falling_all": longest_true(np.all([m < FALLING for m in mag.values()], 0)) / rate,
        "hands_ratio": power[RIGHT_HAND] / (power[LEFT_HAND] + TINY), "arms_ratio": power[RIGHT_ARM] / (power[LEFT_ARM] + TINY),
    }
    for n in (RIGHT_HAND, LEFT_HAND):
        flat, up = c[f"a_horiz_{n}"], c[f"a_vert_{n}"]
        out |= {f"push_peak_{n}": flat.max(), f"push_ratio_{n}": (up**2).mean() / ((flat**2).mean() + TINY), f"push_sign_{n}": float(np.sign(up.mean()))}
    for n in (LEFT_HAND, LEFT_ARM):
        out[f"left_rms_{n}"] = power[n] ** 0.5
    for n in NODES:
        out[f"falling_{n}"] = longest_true(mag[n] < FALLING) / rate
    for n in (RIGHT_ARM, LEFT_ARM):
        pitch = c[f"pitch_{n}"]
        out |= {f"posture_mean_{n}": pitch.mean(), f"posture_max_{n}": pitch.max(), f"posture_range_{n}": np.ptp(pitch)}
    for a, b in ((RIGHT_HAND, RIGHT_ARM), (LEFT_HAND, LEFT_ARM)):
        for axis in ("ax", "ay", "az"):
            x, y = c[f"{axis}_{a}"], c[f"{axis}_{b}"]
            out[f"corr_{axis}_{a}_{b}"] = float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0
    return out


def correlations(x: np.ndarray) -> np.ndarray:
    """[windows, channels, channels] of windows [windows, channels, samples]; 0 with a constant channel."""
    c = x - x.mean(2, keepdims=True)
    size = np.sqrt((c**2).sum(2, keepdims=True))
    z = np.divide(c, size, out=np.zeros_like(c), where=size > 1e-9)
    return np.einsum("wcn,wdn->wcd", z, z)


def _batch_features(x: np.ndarray, names: tuple[str, ...], rate: float, pairs: bool) -> dict[str, np.ndarray]:
    """All features of windows [windows, channels, samples], each over all windows."""
    w, k, n = x.shape
    at = {c: i for i, c in enumerate(names)}
    out = {f"{c}_{f}": v.reshape(w, k)[:, i] for f, v in time_and_frequency(x.reshape(-1, n), rate).items() for i, c in enumerate(names)}
    for node in NODES:
        if all(f"{g}_{node}" in at for g in ("gx", "gy", "gz")):
            turning = x[:, [at[f"{g}_{node}"] for g in ("gx", "gy", "gz")]]
            each = [rotation_shares(*t) for t in turning]
            out |= {f"rotation_{f}_{node}": np.array([e[f] for e in each]) for f in each[0]}
    if all(f"a_mag_{node}" in at for node in NODES):
        each = [between_nodes(dict(zip(names, one)), rate) for one in x]
        out |= {f: np.array([e[f] for e in each]) for f in each[0]}
    if pairs:
        r, rms = correlations(x), np.sqrt((x**2).mean(2))
        for i in range(k):
            for j in range(i + 1, k):
                out[f"corr_{names[i]}_{names[j]}"] = r[:, i, j]
                channel, other = names[i].rpartition("_"), names[j].rpartition("_")
                if channel[0] == other[0]:
                    out[f"ratio_{names[i]}_{names[j]}"] = rms[:, i] / (rms[:, j] + TINY)
    return out


def full_features(df: DataFrame, keys: list[str], channels: str, rate: float, pairs: bool = False) -> DataFrame:
    """(keys, feature, value): all features of windows whose channels are a map of name to samples, with ``pairs`` the
    correlation of any two channels too, and the ratio of the same channel at two nodes. Values that are not finite
    become 0. Long form keeps thousands of columns out of the plan; pivot what is selected. Windows with the same
    channels and length go through together."""
    kinds = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "feature string, value double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some, names, value in _all_features(pdf[channels], rate, pairs):
                yield pdf[keys].iloc[np.repeat(some, len(names))].reset_index(drop=True).assign(feature=names * len(some), value=value.ravel())

    return df.select(*keys, channels).mapInPandas(run, kinds)


def mean_features(df: DataFrame, channels: str, rate: float, pairs: bool = False) -> DataFrame:
    """(feature, windows, mean) of what ``full_features`` has, over all windows: each batch of windows hands on the sums of
    its features, so that no value of a window leaves its task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[str, np.ndarray] = {}
            for some, names, value in _all_features(pdf[channels], rate, pairs):
                for name, total in zip(names, value.sum(0)):
                    sums[name] = sums.get(name, 0.0) + np.array([len(some), total])
            if sums:
                n, total = np.stack(list(sums.values()), 1)
                yield pd.DataFrame({"feature": list(sums), "n": n.astype(int), "total": total})

    parts = df.select(channels).mapInPandas(run, "feature string, n long, total double").groupBy("feature")
    return parts.agg(F.sum("n").alias("windows"), (F.sum("total") / F.sum("n")).alias("mean"))


def _all_features(windows: pd.Series, rate: float, pairs: bool) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """Places of windows, names of their features and values [windows, features], those with the same channels and length
    together."""
    maps = [{k: np.asarray(v, float) for k, v in m.items()} for m in windows]
    alike: dict[tuple, list[int]] = {}
    for i, m in enumerate(maps):
        names = tuple(sorted(m))
        if names:
            alike.setdefault((names, *{len(v) for v in m.values()}), []).append(i)
    for (names, *length), rows in alike.items():
        if len(length) != 1:
            raise ValueError(f"channels of one window differ in length: {sorted(length)}")
        for some in (rows[k : k + 256] for k in range(0, len(rows), 256)):
            got = _batch_features(np.stack([[maps[i][c] for c in names] for i in some]), names, rate, pairs)
            yield some, list(got), np.nan_to_num(np.stack(list(got.values()), 1).astype(float), nan=0.0, posinf=0.0, neginf=0.0)


def channel_features(df: DataFrame, keys: list[str], channels: list[str], rate: float, apart: float, absolute: bool = False, variant: str = "centred") -> DataFrame:
    """(keys, <channel>_mean, _std, _min, _max, _ptp, _rms, _dom_freq, _peaks) of windows that hold each channel as an
    array: four samples or more, none of them null. Peaks, of absolute values if asked, are at least ``apart`` seconds
    from each other; a constant channel has frequency 0. Rows go through in batches, those of one length together."""
    kinds = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{c}_{f} double" for c in channels for f in CHANNEL)])
    distance = max(1, int(apart * rate))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf[channels[0]].str.len()):
                out = part[keys].copy()
                for c in channels:
                    x = np.stack(part[c].to_numpy()).astype(float)
                    tops = [float(len(kernels.find_peaks(np.abs(v) if absolute else v, distance))) for v in x]
                    got = (x.mean(1), x.std(1), x.min(1), x.max(1), np.ptp(x, 1), np.sqrt((x**2).mean(1)), np.where(np.isclose(x, x[:, :1]).all(1), 0.0, kernels.dominant_frequency(x, rate, variant)), tops)
                    out = out.assign(**{f"{c}_{f}": v for f, v in zip(CHANNEL, got, strict=True)})
                yield out

    return df.select(*keys, *channels).mapInPandas(run, kinds)


def magnitudes(x: str, y: str, z: str) -> Column:
    """Norms of three arrays of one length."""
    return F.zip_with(F.zip_with(x, y, lambda a, b: a * a + b * b), z, lambda s, c: F.sqrt(s + c * c))


def best_lag(df: DataFrame, keys: list[str], x: str, y: str, most: int, name: str) -> DataFrame:
    """(keys, ``<name>_lag``, ``<name>_corr``) of windows held as two arrays of one length without nulls: the shift of
    at most ``most`` samples at which their standard scores agree best, products summed over what overlaps and divided
    by the whole length; the lowest of equals. A positive lag means that ``x`` comes later. Empty windows are left
    out. Rows go through in batches, those of one length together."""
    kinds = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{name}_lag int, {name}_corr double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf[x].str.len()):
                a, b = (np.stack(part[c].to_numpy()).astype(float) for c in (x, y))
                a, b = ((v - v.mean(1, keepdims=True)) / (v.std(1, keepdims=True) + 1e-9) for v in (a, b))
                lags = np.arange(-min(most, n - 1), min(most, n - 1) + 1)
                c = np.stack([(a[:, max(0, k) : n + min(0, k)] * b[:, max(0, -k) : n - max(0, k)]).sum(1) / n for k in lags], 1)
                best = c.round(9).argmax(1)  # sums in another order differ in their last bits
                yield part[keys].assign(**{f"{name}_lag": lags[best].astype("int32"), f"{name}_corr": c[np.arange(len(c)), best]})

    return df.where(F.size(x) > 0).select(*keys, x, y).mapInPandas(run, kinds)


def selected(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row for each window with the named features, 0 where a window lacks one."""
    return long.where(F.col("feature").isin(names)).groupBy(*keys).pivot("feature", names).agg(F.first("value")).na.fill(0.0, names)


def peak_confidence(df: DataFrame, peaks: DataFrame, by: list[str], i: str, x: str, margin: int) -> DataFrame:
    """Height of each peak (…, place) over the median around it, in standard deviations, 0 at least. What is around a
    sample is a window frame, so samples and peaks meet by place alone."""
    around = over(by, [i]).rangeBetween(-margin, margin)
    rows = df.select(*by, F.col(i).alias("place"), F.col(x).alias("__x"), F.collect_list(x).over(around).alias("__near"), F.stddev_pop(x).over(around).alias("__s"))
    near = rows.join(peaks.select(*by, "place"), [*by, "place"])
    n, sorted_ = F.size("__near"), F.array_sort("__near")
    middle = (F.element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_, F.floor((n + 2) / 2).cast("int"))) / 2
    return near.select(*by, "place", F.when(F.col("__s") > TINY, F.greatest(F.lit(0.0), (F.col("__x") - middle) / F.col("__s"))).otherwise(0.0).alias("confidence"))


def pose_motion(df: DataFrame, by: list[str], order: list[str], rate: float, shoulder: str = "right_shoulder", elbow: str = "right_elbow", wrist: str = "right_wrist", other: str = "left_wrist") -> DataFrame:
    """Adds what a release is seen by: speeds of wrist and elbow, elbow_angle and its extension, the wrist's rise, the
    difference between both wrists' speeds, and the lower visibility of wrist and elbow. A joint has columns
    ``<joint>_x``, ``_y`` (downwards), ``_z`` and ``visibility_<joint>``."""
    w = over(by, order)
    place = lambda j: tuple(F.col(f"{j}_{a}") for a in "xyz")
    speed = lambda j: norm(*[gradient(f"{j}_{a}", w, rate) for a in "xyz"])
    rows = df.withColumns({"wrist_speed": speed(wrist), "elbow_speed": speed(elbow), "__other": speed(other), "elbow_angle": joint_angle(place(shoulder), place(elbow), place(wrist))})
    return rows.withColumns({
        "extension": gradient("elbow_angle", w, rate), "rise": -gradient(f"{wrist}_y", w, rate), "wrists_apart": F.abs(F.col("wrist_speed") - F.col("__other")),
        "visibility": F.least(f"visibility_{wrist}", f"visibility_{elbow}"),
    }).drop("__other")


def release_candidates(df: DataFrame, by: list[str], order: list[str], rate: float, wanted: int, apart: float, around: float = 0.25) -> DataFrame:
    """(…, event, place, order columns, score, confidence) of the likely releases of ``pose_motion`` rows: about as many peaks
    of the weighted score as wanted, at least ``apart`` seconds from each other, numbered V01, V02, … in time."""
    rows = rectified_score(df, by, order, RELEASE_WEIGHTS, 5, "visibility").select(*by, *order, "i", "score")
    tops = counted_peaks(rows, by, ["i"], "score", wanted, max(1, round(apart * rate)), 50, 0.95, 0.35).where("is_peak").select(*by, F.col("i").alias("place"))
    sure = peak_confidence(rows, tops, by, "i", "score", round(around * rate))
    named = numbered("V", F.row_number().over(over(by, ["place"])), 2)
    return sure.join(rows.withColumnRenamed("i", "place"), [*by, "place"]).withColumn("event", named).select(*by, "event", "place", *order, "score", "confidence")


def validated(df: DataFrame, keys: list[str], order: list[str], label: str, impact: str, across: str, pitch: str, upward: str, rate: float,
              narrow: float = 0.1, factor: float = 3.0, least_pitch: float = 30.0, least_peak: float = 2.0) -> DataFrame:
    """(keys, label, peaks, narrow, upright, pitch_range, vertical_peak, suspicious, reason) of each segment, given by its rows.

    A dribble must have an impact: a peak of the high-passed vertical acceleration, prominent by ``factor`` times
    its mean, that is down to that level within ``narrow`` seconds, and one where it passes the acceleration across.
    A shot must change its pitch by ``least_pitch`` degrees and reach ``least_peak`` upwards; where there is no pitch
    the reason says so without suspicion. Other labels pass. Null samples are left out; without any a segment is
    empty. A segment is one action and short; they go through in batches.
    """
    rows = df.groupBy(*keys).agg(F.first(label).alias(label), F.array_sort(F.collect_list(F.when(F.col(impact).isNotNull(), F.struct(*order, impact, across)))).alias("__s"), (F.max(pitch) - F.min(pitch)).alias("pitch_range"), F.max(upward).alias("vertical_peak"))
    rows = rows.select(*keys, label, "pitch_range", "vertical_peak", F.transform("__s", lambda s: F.abs(s[impact].cast("double"))).alias("__v"), F.transform("__s", lambda s: s[across].cast("double")).alias("__h"))

    def shape(v: np.ndarray, h: np.ndarray) -> tuple[int, bool, bool]:
        if not len(v):
            return 0, False, False
        level = max(factor * (v.cumsum()[-1] / len(v)), 1e-6)  # summed in order, as an aggregate sums
        tops = kernels.find_peaks(v, max(1, int(rate * 0.05)), level)
        left, right = kernels.reaches(v, tops, np.full(len(tops), level))
        return len(tops), bool(((right - left) / rate < narrow).any()), bool((v[tops] > h[tops]).any())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [shape(np.asarray(v, float), np.asarray(h, float)) for v, h in zip(pdf["__v"], pdf["__h"])]
            yield pdf[[*keys, label, "pitch_range", "vertical_peak"]].assign(peaks=[g[0] for g in got], narrow=[g[1] for g in got], upright=[g[2] for g in got], empty=[not len(v) for v in pdf["__v"]])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, label, "pitch_range", "vertical_peak"))
    out = rows.mapInPandas(run, f"{kinds}, peaks int, narrow boolean, upright boolean, empty boolean")
    dribble, shot = F.col(label) == "dribble", F.col(label) == "shot"
    reason = (
        F.when((dribble & F.col("empty")) | (shot & F.col("pitch_range").isNull()), "empty").when(dribble & ~F.col("narrow"), "no narrow impact").when(dribble & ~F.col("upright"), "not vertical")
        .when(shot & (F.col("pitch_range") < 0.01), "no pitch").when(shot & (F.col("pitch_range") < least_pitch), "little pitch").when(shot & (F.coalesce("vertical_peak", F.lit(0.0)) < least_peak), "weak peak").otherwise("")
    )
    return out.withColumn("reason", reason).withColumn("suspicious", ~F.col("reason").isin("", "no pitch")).drop("empty")


def recentred(x: Column, y: Column, z: Column, root: tuple[Column, Column, Column], torso: Column, height: float = 1.75) -> tuple[Column, Column, Column]:
    """A joint about the skeleton's root, z upwards, scaled so that the torso has its share of a body's height."""
    scale = F.lit(height * 0.29) / torso
    dx, dy, dz = x - root[0], y - root[1], z - root[2]
    return dx * scale, -dz * scale, -dy * scale
