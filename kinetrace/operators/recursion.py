"""Linear recursions over recordings that are longer than a task should hold, as a scan over chunks.

A chunk is a stretch of time of one recording, one row with its samples in order. From a chunk alone follows its
end state if it had started from zero; these are few numbers, and put in order they give the state in which every
chunk starts, since a start state passes through a chunk by a power of the transition. Then each chunk runs for
itself. A zero-phase filter runs forwards and backwards; the end states of both directions are linear in the
samples and the forward start state, so one exchange of states serves both. Inside a chunk the recursion goes by
blocks of 64 samples, each two matrix products for all chunks of a batch that are as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import kernels

BLOCK = 64


class System:
    """z' = A z + b x, y = c z + d x, for one input and one output."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float, steady: np.ndarray | None = None):
        self.a, self.b, self.c, self.d, self.steady = a, b, c, d, steady

    @classmethod
    def of_filter(cls, b: np.ndarray, a: np.ndarray) -> System:
        """The transposed direct form of a digital filter, turned into its modes: powers of the direct form's transition
        grow before they decay, and lose digits on the way."""
        n = len(a) - 1
        step = np.zeros((n, n))
        step[:, 0] = -a[1:]
        step[np.arange(n - 1), np.arange(1, n)] = 1.0
        value, vector = np.linalg.eig(step)
        modes, turn, k = np.zeros((n, n)), np.zeros((n, n)), 0
        for v, w in zip(value, vector.T):
            if v.imag > 0:
                modes[k : k + 2, k : k + 2] = [[v.real, v.imag], [-v.imag, v.real]]
                turn[:, k], turn[:, k + 1] = w.real, w.imag
                k += 2
            elif v.imag == 0:
                modes[k, k], turn[:, k] = v.real, w.real
                k += 1
        return cls(modes, np.linalg.solve(turn, b[1:] - a[1:] * b[0]), turn[0], float(b[0]), np.linalg.solve(turn, kernels.steady_state(b, a)))

    @lru_cache(maxsize=None)  # noqa: B019
    def block(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of ``size`` samples: output from input and from the state, end state from input and from the state."""
        n = len(self.b)
        powers = [np.eye(n)]
        for _ in range(size):
            powers.append(self.a @ powers[-1])
        seen = np.stack([self.c @ p for p in powers[:size]])
        reply = np.concatenate([[self.d], seen[:-1] @ self.b]) if size > 1 else np.array([self.d])
        i, j = np.indices((size, size))
        return np.where(i >= j, reply[np.abs(i - j)], 0.0), seen, np.stack([powers[size - 1 - k] @ self.b for k in range(size)], 1), powers[size]

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, end states) of rows ``x`` from states ``z``, a row each."""
        y = np.empty_like(x, dtype=float)
        for at in range(0, x.shape[1], BLOCK):
            part = x[:, at : at + BLOCK]
            from_x, from_z, end_x, end_z = self.block(part.shape[1])
            y[:, at : at + BLOCK] = part @ from_x.T + z @ from_z.T
            z = part @ end_x.T + z @ end_z.T
        return y, z

    @lru_cache(maxsize=4096)  # noqa: B019
    def passing(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``size`` samples make of a start state: their end state, and that of the pass back over their output."""
        n = len(self.b)
        y, end = self.run(np.zeros((n, size)), np.eye(n))
        return end.T, self.run(y[:, ::-1], np.zeros((n, n)))[1].T


def _rows_by_length(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(values, offsets, [(rows, places of their values)]) of lists, those of one length together."""
    offsets = column.offsets.to_numpy()
    first, lengths = offsets[:-1], np.diff(offsets)
    values = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    return values, offsets, [(rows := np.flatnonzero(lengths == n), first[rows][:, None] + np.arange(n)) for n in np.unique(lengths) if n]


def _lists(values: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * size + 1, size), pa.int32()), pa.array(values.ravel(), pa.float64()))


def _starts(system: System, chunks: list, pad: int | None) -> tuple[list, list]:
    """Start states of the chunks of a recording, forwards and backwards; none if it is too short to be filtered.
    Chunks have n, forth, back (end states from zero), head and tail."""
    n = [c["n"] for c in chunks]
    z, forth = np.zeros(len(system.b)), []
    if pad is not None:
        if sum(n) <= pad:
            return [None] * len(chunks), [None] * len(chunks)
        head, tail = np.zeros(0), np.zeros(0)
        for c in chunks:
            head = np.concatenate([head, c["head"]])[: pad + 1]
        for c in reversed(chunks):
            tail = np.concatenate([c["tail"], tail])[-pad - 1 :]
        left, right = 2 * head[0] - head[pad:0:-1], 2 * tail[-1] - tail[-2::-1]
        z = system.run(left[None], system.steady[None] * left[0])[1][0]
    for c in chunks:
        forth.append(z)
        z = system.passing(c["n"])[0] @ z + c["forth"]
    if pad is None:
        return forth, [None] * len(chunks)
    y = system.run(right[None], z[None])[0]
    z, back = system.run(y[:, ::-1], system.steady[None] * y[0, -1])[1][0], []
    for c, start in zip(reversed(chunks), reversed(forth)):
        back.append(z)
        ahead, turned = system.passing(c["n"])
        z = ahead @ z + turned @ start + c["back"]
    return forth, back[::-1]


def scanned(df: DataFrame, by: list[str], order: list[str], x: str, out: str, system: System, span: float, pad: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``order``, ``x`` and ``carry`` of every row with ``out``, the output of the recursion over each recording from the zero
    state; with ``pad`` of a pass forwards and one backwards over the recording extended oddly by so many samples.
    A recording of no more samples than that comes back as it is.

    A chunk holds what falls into one span of the first order column, so a recording is spread over many tasks.
    Null samples make what follows null, as they do to any recursion.
    """
    held = list(dict.fromkeys([*order, x, *carry]))
    samples = F.transform("__s", lambda s: s[x].cast("double"))
    chunks = df.groupBy(*by, F.floor(F.col(order[0]) / F.lit(span)).alias("__chunk")).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("__s")).withColumn("__v", samples)
    wide = 0 if pad is None else pad + 1
    of = f"{', '.join(f'{c} {df.schema[c].dataType.simpleString()}' for c in by)}, __chunk long"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets, groups = _rows_by_length(batch.column("__v"))
            forth, back = (np.zeros((batch.num_rows, len(system.b))) for _ in range(2))
            for rows, places in groups:
                y, forth[rows] = system.run(values[places], np.zeros((len(rows), len(system.b))))
                if wide:
                    back[rows] = system.run(y[:, ::-1], np.zeros((len(rows), len(system.b))))[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(forth, len(system.b)), _lists(back, len(system.b)), pa.array(np.diff(offsets), pa.int64())], names=[*batch.schema.names[:-1], "forth", "back", "n"])

    edge = chunks.select(*by, "__chunk", F.slice("__v", 1, max(1, wide)).alias("head"), F.reverse(F.slice(F.reverse("__v"), 1, max(1, wide))).alias("tail"), "__v")
    told = edge.mapInArrow(ends, f"{of}, head array<double>, tail array<double>, forth array<double>, back array<double>, n long")
    in_order = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__chunk", "n", "forth", "back", "head", "tail"))).alias("__chunks"))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_starts(system, list(c), pad) for c in pdf["__chunks"]]
            rows = pdf[by].assign(__chunk=[[c["__chunk"] for c in cs] for cs in pdf["__chunks"]], forth=[[None if z is None else z.tolist() for z in f] for f, _ in got], back=[[None if z is None else z.tolist() for z in b] for _, b in got])
            yield rows

    begun = in_order.mapInPandas(starts, f"{', '.join(f'{c} {df.schema[c].dataType.simpleString()}' for c in by)}, __chunk array<long>, forth array<array<double>>, back array<array<double>>")
    begun = begun.select(*by, F.inline(F.arrays_zip("__chunk", "forth", "back")))
    begun = begun.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__chunk").alias("__at"), "forth", "back")
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    whole = chunks.join(begun, [*same, F.col("__chunk") == F.col("__at")]).select(*by, "__s", "forth", "back", "__v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets, groups = _rows_by_length(batch.column("__v"))
            got = values.copy()
            sides = [batch.column(c).to_pylist() for c in ("forth", "back")]
            for rows, places in groups:
                some = np.array([sides[0][r] is not None for r in rows], bool)
                if some.any():
                    rows, places = rows[some], places[some]
                    y, _ = system.run(values[places], np.array([sides[0][r] for r in rows]))
                    if wide:
                        y = system.run(y[:, ::-1], np.array([sides[1][r] for r in rows]))[0][:, ::-1]
                    got[places] = y
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got))], names=[*batch.schema.names[:-3], "__y"])

    kinds = f"{', '.join(f'{c} {df.schema[c].dataType.simpleString()}' for c in by)}, __s {whole.schema['__s'].dataType.simpleString()}, __y array<double>"
    zipped = F.zip_with("__s", "__y", lambda s, y: F.struct(*[s[c].alias(c) for c in held], y.alias(out)))
    return whole.mapInArrow(run, kinds).select(*by, F.inline(zipped))
