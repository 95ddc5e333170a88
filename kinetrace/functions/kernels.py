"""Signal kernels on NumPy arrays, for operations without a relational form. No Spark in here."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np


def butterworth(order: int, cutoff: float, rate: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter by the bilinear transform with a pre-warped cutoff."""
    warp = 2 * rate * np.tan(np.pi * cutoff / rate)
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    unit = np.exp(1j * angles)
    poles = warp / unit if high else warp * unit
    digital = (2 * rate + poles) / (2 * rate - poles)
    zeros = np.full(order, 1.0 if high else -1.0)
    b, a = np.poly(zeros), np.real(np.poly(digital))
    at = -1.0 if high else 1.0  # the gain is 1 where the filter passes
    return np.real(b * np.polyval(a, at) / np.polyval(b, at)), a


def bandpass(order: int, lo: float, hi: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth band-pass; ``order`` is that of the low-pass it comes from."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (lo, hi))
    unit = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(unit**2 - w1 * w2 + 0j)
    digital = [(2 * rate + p) / (2 * rate - p) for p in np.concatenate([unit + root, unit - root])]
    b, a = np.poly([1.0] * order + [-1.0] * order), np.real(np.poly(digital))
    middle = np.exp(2j * np.pi * np.arctan(np.sqrt(w1 * w2) / (2 * rate)) / np.pi)
    return np.real(b / np.abs(np.polyval(b, middle) / np.polyval(a, middle))), a


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the transposed direct form in which a constant input of 1 passes without a transient."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[np.arange(n - 1), np.arange(1, n)] = 1.0
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One pass of the filter over the last axis; all other axes go through at once."""
    z = [state[k] * np.ones(x.shape[:-1]) if np.ndim(state[k]) == 0 else state[k].copy() for k in range(len(state))]
    y = np.empty_like(x)
    for i in range(x.shape[-1]):
        v = x[..., i]
        out = b[0] * v + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * v + z[k + 1] - a[k + 1] * out
        z[-1] = b[-1] * v - a[-1] * out
        y[..., i] = out
    return y


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward pass over a signal extended oddly at both ends; a signal no longer than the
    extension comes back as it is."""
    pad = 3 * max(len(a), len(b))
    if x.shape[-1] <= pad:
        return x.copy()
    left, right = 2 * x[..., :1] - x[..., pad:0:-1], 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    wide = np.concatenate([left, x, right], -1)
    zi = steady_state(b, a)
    once = filtered(b, a, wide, np.array([z * wide[..., 0] for z in zi]))
    back = once[..., ::-1]
    twice = filtered(b, a, back, np.array([z * back[..., 0] for z in zi]))
    return twice[..., ::-1][..., pad:-pad]


def alike(lengths: list[int]) -> list[list[int]]:
    """Places by falling length, in parts whose longest has at most twice the length of the shortest, and 16 more: padded
    to one length, a part takes no more than a few times its room."""
    parts: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if not parts or lengths[parts[-1][0]] > 2 * lengths[k] + 16:
            parts.append([])
        parts[-1].append(k)
    return parts


def zero_phase_each(b: np.ndarray, a: np.ndarray, xs: list[np.ndarray]) -> list[np.ndarray]:
    """``zero_phase`` of many signals [channels, samples] of any lengths, side by side: what pads the shorter ones comes
    after their last sample, which a pass has left by then."""
    pad, zi = 3 * max(len(a), len(b)), steady_state(b, a)
    out = [x.copy() for x in xs]

    def passed(rows: list[np.ndarray]) -> list[np.ndarray]:
        stack = np.zeros((rows[0].shape[0], len(rows), max(r.shape[-1] for r in rows)))
        for k, r in enumerate(rows):
            stack[:, k, : r.shape[-1]] = r
        got = filtered(b, a, stack, np.array([z * stack[..., 0] for z in zi]))
        return [got[:, k, : r.shape[-1]] for k, r in enumerate(rows)]

    for part in alike([x.shape[-1] for x in xs]):
        some = [k for k in part if xs[k].shape[-1] > pad]
        if some:
            wide = [np.concatenate([2 * xs[k][:, :1] - xs[k][:, pad:0:-1], xs[k], 2 * xs[k][:, -1:] - xs[k][:, -2 : -pad - 2 : -1]], -1) for k in some]
            for k, y in zip(some, passed([w[:, ::-1] for w in passed(wide)])):
                out[k] = y[:, ::-1][:, pad:-pad]
    return out


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places higher than both sides; a flat top counts once, at its middle."""
    if len(x) < 3:
        return np.zeros(0, int)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]])
    level = x[edges[:-1]]
    k = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (edges[k] + edges[k + 1] - 1) // 2


def _lowest_before(tops: list[float], valleys: list[float]) -> list[float]:
    """For each top the lowest valley between it and the nearest higher top before it, or all before it. valleys[j] is
    the lowest point just before top j. A stack holds the tops that nothing later has covered, so each is taken off
    once."""
    out, stack = [], []
    for top, low in zip(tops, valleys):
        while stack and stack[-1][0] <= top:
            low = min(low, stack.pop()[1])
        stack.append((top, low))
        out.append(low)
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak (a local maximum) over the higher of the lowest points towards higher ground on its two sides,
    in one pass over the extremes from each side."""
    if not len(peaks):
        return np.zeros(0)
    tops = local_maxima(x)
    ends = [np.array([e]) for e, inner in ((0, np.argmax(np.append(x != x[0], True))), (len(x) - 1, len(x) - 1 - np.argmax(np.append((x != x[-1])[::-1], True)))) if 0 <= inner < len(x) and x[e] > x[inner]]
    places = np.unique(np.concatenate([tops, *ends]))  # an end that falls away inwards is higher ground for others
    between = np.minimum.reduceat(x, np.concatenate([[0], places]))[: len(places)] if places[0] else np.concatenate([[np.inf], np.minimum.reduceat(x, places)[:-1]])
    after = np.minimum.reduceat(x, places)
    level = x[places].tolist()
    low = np.maximum(_lowest_before(level, between.tolist()), np.array(_lowest_before(level[::-1], after[::-1].tolist())[::-1]))
    return x[peaks] - low[np.searchsorted(places, peaks)]


def _first_at_most(x: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """From each start the nearest place to the left with a value of at most its level, or -1; by doubling steps over
    a table of lowest values, the largest first."""
    lows = [x]
    while 2 << len(lows) <= 2 * len(x):
        step = 1 << (len(lows) - 1)
        low = lows[-1].copy()
        low[step:] = np.minimum(lows[-1][step:], lows[-1][:-step])
        lows.append(low)  # lows[k][i] is the least of the 2 ** k values up to i
    at = start.copy()
    for k in range(len(lows) - 1, -1, -1):
        fits = (at >= 0) & (at + 1 >= 1 << k)
        fits[fits] = lows[k][at[fits]] > level[fits]
        at[fits] -= 1 << k
    return at


def _sides(x: np.ndarray, peaks: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _first_at_most(x, peaks, level), len(x) - 1 - _first_at_most(x[::-1], len(x) - 1 - peaks, level)


def reaches(x: np.ndarray, peaks: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest samples on both sides of each peak that are at most its level; the ends of the signal where none is."""
    left, right = _sides(x, peaks, level)
    return np.maximum(left, 0), np.minimum(right, len(x) - 1)


def crossings(x: np.ndarray, peaks: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places on both sides of each peak where the signal has come down to its level, between samples by a straight
    line; the ends of the signal where it never does."""
    left, right = _sides(x, peaks, level)

    def between(low: np.ndarray, inner: np.ndarray, none: np.ndarray) -> np.ndarray:
        some = (low >= 0) & (low < len(x))
        a, b = x[np.where(some, low, 0)], x[np.where(some, inner, 0)]
        with np.errstate(invalid="ignore", divide="ignore"):
            part = np.where(a < level, (level - a) / (b - a), 0.0)
        return np.where(some, low + (inner - low) * part, none)

    return between(left, left + 1, np.zeros(len(peaks))), between(right, right - 1, np.full(len(peaks), len(x) - 1.0))


def widths(x: np.ndarray, peaks: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Width of each peak, in samples, at a share of its prominence below its top."""
    left, right = crossings(x, peaks, x[peaks] - share * prominences(x, peaks))
    return right - left


def running_std(x: np.ndarray) -> float:
    """Deviation of the population by Welford's steps, one sample at a time: to the last bit what an aggregate gives."""
    mean = squares = 0.0
    for n, v in enumerate(x.tolist(), 1):
        before = v - mean
        mean += before / n
        squares += (v - mean) * before
    return float(np.sqrt(squares / len(x)))


def find_peaks(x: np.ndarray, distance: int | None = None, prominence: float | None = None) -> np.ndarray:
    """Local maxima at least ``distance`` apart, higher ones first, of equals the later; and then of enough prominence."""
    peaks = local_maxima(x)
    if distance and len(peaks):
        keep = np.ones(len(peaks), bool)
        lo, hi = np.searchsorted(peaks, peaks - distance, "right"), np.searchsorted(peaks, peaks + distance)
        for n in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[n]:
                keep[lo[n] : hi[n]] = False
                keep[n] = True
        peaks = peaks[keep]
    return peaks if prominence is None else peaks[prominences(x, peaks) >= prominence]


def count_peaks(x: np.ndarray, prominence: np.ndarray) -> np.ndarray:
    """How many peaks of each row of ``x`` are prominent by so much, as ``find_peaks`` has them. Short rows are compared with
    all their shifts, all rows at once: a peak's base is the lowest value up to higher ground or the end."""
    n = x.shape[1]
    if n > 128:
        return np.array([len(find_peaks(v, prominence=p)) for v, p in zip(x, prominence)], int)
    falls = np.zeros(x.shape, bool)  # the next other value is lower
    for i in range(n - 2, -1, -1):
        falls[:, i] = (x[:, i + 1] < x[:, i]) | ((x[:, i + 1] == x[:, i]) & falls[:, i + 1])
    top = falls.copy()
    top[:, :1] = False
    top[:, 1:] &= x[:, 1:] > x[:, :-1]
    row, place = np.nonzero(top)
    high, low = x[row, place], []
    for side in (-1, 1):
        base, at, left = high.copy(), place.copy(), np.arange(len(row))
        while len(left):
            at = at + side
            inside = (at >= 0) & (at < n)
            left, at = left[inside], at[inside]
            value = x[row[left], at]
            lower = value <= high[left]
            left, at, value = left[lower], at[lower], value[lower]
            base[left] = np.minimum(base[left], value)
        low.append(base)
    return np.bincount(row[high - np.maximum(*low) >= prominence[row]], minlength=len(x))


def peaks_for_count(x: np.ndarray, wanted: int, distance: int, steps: int = 30, start: float = 0.9, floor: float = 0.45) -> np.ndarray:
    """About ``wanted`` peaks: the least prominence goes through the quantiles of the signal from ``start`` to ``floor``, each
    over its lower quartile, to the first that leaves nearest to that number; of more the most prominent stay, of
    equals the later."""
    finite = x[np.isfinite(x)]
    peaks = find_peaks(x, distance)
    if not len(peaks):
        return peaks
    high = prominences(x, peaks)
    least = np.maximum(np.quantile(finite, np.linspace(start, floor, steps)) - np.quantile(finite, 0.25), 1e-9)
    counts = len(high) - np.searchsorted(np.sort(high), least)
    fits = high >= least[int(np.argmin(np.abs(counts - wanted)))]
    peaks, high = peaks[fits], high[fits]
    return np.sort(peaks[np.argsort(high, kind="stable")[::-1][:wanted]])


def spectrum(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    return np.abs(np.fft.rfft(x)), np.fft.rfftfreq(x.shape[-1], 1 / rate)


def dominant_frequency(x: np.ndarray, rate: float, variant: str = "plain") -> np.ndarray:
    """Strongest frequency but zero: of the signal as it is (plain), less its mean (centred), under a Hann
    window (hann), or of averaged overlapping segments (welch)."""
    if variant == "welch":
        power, f = welch(x, rate)
    else:
        y = x - x.mean(-1, keepdims=True) if variant in ("centred", "hann") else x
        if variant == "hann":
            y = y * np.hanning(x.shape[-1])
        power, f = spectrum(y, rate)
    return f[power[..., 1:].argmax(-1) + 1]


def welch(x: np.ndarray, rate: float, segment: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Power spectrum averaged over half-overlapping segments, each less its mean under a periodic Hann window."""
    n = min(segment, x.shape[-1])
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[-1] - n + 1, max(1, n - n // 2))
    parts = np.stack([x[..., s : s + n] for s in starts], -2)
    p = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * hann)) ** 2 / (rate * (hann**2).sum())
    p[..., 1 : (-1 if n % 2 == 0 else None)] *= 2
    return p.mean(-2), np.fft.rfftfreq(n, 1 / rate)


def spectral(x: np.ndarray, rate: float, bands: tuple[tuple[float, float], ...] = ((0, 3), (3, 8), (8, 25))) -> dict[str, np.ndarray]:
    """Frequency features over the last axis from one transform. Totals leave the mean out, but a band that
    starts at zero holds it, so its share may pass 1."""
    a, f = spectrum(x, rate)
    power = a**2
    total = power[..., 1:].sum(-1) + 1e-12
    top = power[..., 1:].argmax(-1) + 1
    share = power[..., 1:] / total[..., None]
    out = {
        "dom_freq": f[top], "dom_power": np.take_along_axis(power, top[..., None], -1)[..., 0] / total,
        "centroid": (f[1:] * a[..., 1:]).sum(-1) / (a[..., 1:].sum(-1) + 1e-12), "entropy": -(share * np.log2(share + 1e-12)).sum(-1),
    }
    for lo, hi in bands:
        out[f"band_{lo:g}_{hi:g}"] = power[..., (f >= lo) & (f < hi)].sum(-1) / total
    return out


def cross_correlation(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """(largest normalised value, its lag) over all lags."""
    c = np.correlate(x - x.mean(), y - y.mean(), "full")
    k = int(c.argmax())
    return float(c[k] / (x.std() * y.std() * (len(x) - 1) + 1e-12)), k - len(y) + 1


def autocorrelation_peak(x: np.ndarray, after: int = 3, distance: int = 3) -> tuple[float, int]:
    """(height as a share of lag 0, lag) of the first peak after some lags; zeros if there is none."""
    c = np.correlate(x - x.mean(), x - x.mean(), "full")[len(x) - 1 :]
    peaks = find_peaks(c[after:], distance) if len(c) > after + 2 else np.zeros(0, int)
    return (float(c[after + peaks[0]] / (c[0] + 1e-12)), int(after + peaks[0])) if len(peaks) else (0.0, 0)


def tilt(acc: np.ndarray, gyr: np.ndarray, dt: float, alpha: float = 0.98) -> np.ndarray:
    """Roll and pitch [n, 2] by a complementary filter that starts level."""
    roll_a = np.arctan2(acc[:, 1], acc[:, 2])
    pitch_a = np.arctan2(-acc[:, 0], np.hypot(acc[:, 1], acc[:, 2]))
    out = np.zeros((len(acc), 2))
    now = np.zeros(2)
    for i in range(len(acc)):
        now = alpha * (now + gyr[i, :2] * dt) + (1 - alpha) * np.array([roll_a[i], pitch_a[i]])
        out[i] = now
    return out


#: With no more groups than this left, plain floats are faster than arrays.
_FEW = 24

#: Quaternions and vectors by component, each a number or an array with one number for each group.
Parts = Sequence[Any]


def _turn(q: Parts, rate: Parts) -> Parts:
    """Half the product of a quaternion and a rotation rate."""
    w, x, y, z = q
    p, r, s = rate
    return 0.5 * (-x * p - y * r - z * s), 0.5 * (w * p + y * s - z * r), 0.5 * (w * r - x * s + z * p), 0.5 * (w * s + x * r - y * p)


def _down(q: Parts) -> Parts:
    """Direction of gravity in the sensor's frame."""
    w, x, y, z = q
    return 2 * (x * z - w * y), 2 * (w * x + y * z), w * w - x * x - y * y + z * z


def _either(c: bool, a: float, b: float) -> float:
    return a if c else b


def _in_step(groups: list[np.ndarray], rate: Callable[[Parts, Parts, Parts, Callable, Callable], Parts], dt: float, before: np.ndarray | None) -> list[np.ndarray]:
    """Quaternions [n, 4] of each group [n, 6] (acceleration, rotation) by integration of ``rate``, the first group from
    ``before``: all groups go from sample to sample together, the shorter ones leave first, and the last few go one by
    one, so that a sample of a long group costs no more than one of many. ``rate`` has a quaternion, an acceleration, a
    rotation, and the square root and the choice that suit them."""
    def moved(q: Parts, a: Parts, g: Parts, root: Callable, pick: Callable) -> Parts:
        (w, x, y, z), (dw, dx, dy, dz) = q, rate(q, a, g, root, pick)
        w, x, y, z = w + dw * dt, x + dx * dt, y + dy * dt, z + dz * dt
        n = root(w * w + x * x + y * y + z * z)
        n = pick(n == 0, math.nan, n)
        return w / n, x / n, y / n, z / n

    out: list[np.ndarray] = [np.empty((0, 4))] * len(groups)
    for part in alike([len(g) for g in groups]):
        lengths = np.array([len(groups[k]) for k in part])
        wide, got = np.zeros((lengths[0], 6, len(part))), np.empty((lengths[0], 4, len(part)))
        q = np.zeros((4, len(part)))
        q[0] = 1.0
        for j, k in enumerate(part):
            wide[: lengths[j], :, j] = groups[k]
            if k == 0 and before is not None:
                q[:, j] = before
        left = np.searchsorted(-lengths, -np.arange(lengths[0]))
        many = int((left > _FEW).sum())
        for i in range(many):
            q = moved([c[: left[i]] for c in q], wide[i, :3, : left[i]], wide[i, 3:, : left[i]], np.sqrt, np.where)
            got[i, :, : left[i]] = q
        for j in range(left[many] if many < lengths[0] else 0):
            now, path = [float(c[j]) for c in q], []
            for a, b, c, d, e, f in wide[many : lengths[j], :, j].tolist():
                now = moved(now, (a, b, c), (d, e, f), math.sqrt, _either)
                path.append(now)
            got[many : lengths[j], :, j] = path
        for j, k in enumerate(part):
            out[k] = got[: lengths[j], :, j]
    return out


def attitude_each(groups: list[np.ndarray], dt: float, before: np.ndarray | None = None, gain: float = 2.0, most: float = 2.5 * 9.80665) -> list[np.ndarray]:
    """Quaternions [n, 4] by integration of rotation, pulled towards measured gravity where the norm of the
    acceleration is believable, of each group [n, 6]; the first goes on from ``before``."""
    def rate(q: Parts, a: Parts, g: Parts, root: Callable, pick: Callable) -> Parts:
        (x, y, z), (p, r, s), (u, v, w) = a, g, _down(q)
        n = root(x * x + y * y + z * z)
        sure = (n > 1e-6) & (n < most)
        n = pick(sure, n, 1.0)
        x, y, z = x / n, y / n, z / n
        return _turn(q, (pick(sure, p + gain * (y * w - z * v), p), pick(sure, r + gain * (z * u - x * w), r), pick(sure, s + gain * (x * v - y * u), s)))

    return _in_step(groups, rate, dt, before)


def attitude(acc: np.ndarray, gyr: np.ndarray, dt: float, gain: float = 2.0, most: float = 2.5 * 9.80665) -> np.ndarray:
    return attitude_each([np.column_stack([acc, gyr])], dt, None, gain, most)[0]


def madgwick_each(groups: list[np.ndarray], dt: float, before: np.ndarray | None = None, beta: float = 0.1) -> list[np.ndarray]:
    """Quaternions [n, 4] by the gradient-descent orientation filter (Madgwick, 2010) of each group [n, 6]; the first
    goes on from ``before``."""
    def rate(q: Parts, a: Parts, g: Parts, root: Callable, pick: Callable) -> Parts:
        (w, x, y, z), (ax, ay, az), (o, p, r) = q, a, _down(q)
        n = root(ax * ax + ay * ay + az * az)
        still = pick(n > 0, n, 1.0)
        o, p, r = o - ax / still, p - ay / still, r - az / still
        sw, sx, sy, sz = -2 * y * o + 2 * x * p, 2 * z * o + 2 * w * p - 4 * x * r, -2 * w * o + 2 * z * p - 4 * y * r, 2 * x * o + 2 * y * p
        size = root(sw * sw + sx * sx + sy * sy + sz * sz)
        pulled = (n > 0) & (size > 0)
        size = pick(pulled, size, 1.0)
        dw, dx, dy, dz = _turn(q, g)
        return pick(pulled, dw - beta * sw / size, dw), pick(pulled, dx - beta * sx / size, dx), pick(pulled, dy - beta * sy / size, dy), pick(pulled, dz - beta * sz / size, dz)

    return _in_step(groups, rate, dt, before)


def madgwick(acc: np.ndarray, gyr: np.ndarray, dt: float, beta: float = 0.1) -> np.ndarray:
    return madgwick_each([np.column_stack([acc, gyr])], dt, None, beta)[0]


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance shrunk towards a multiple of the identity, share of shrinkage) (Ledoit and Wolf, 2004)."""
    n, p = x.shape
    mean = x.mean(0)
    c = x - mean
    s = c.T @ c / n
    mu = np.trace(s) / p
    d = ((s - mu * np.eye(p)) ** 2).sum() / p
    b = min(((c**2).T @ (c**2)).sum() / n - (s**2).sum(), d * p * n) / (n * p)
    share = 0.0 if d == 0 else max(0.0, min(1.0, b / d))
    return mean, share * mu * np.eye(p) + (1 - share) * s, share
