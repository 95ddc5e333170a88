"""Streaming counterparts: wire rows, loss by interval, sliding windows and an event timeline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinetrace.sources.schema import RAW_STREAM


def wire_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Packets from CSV lines: exactly eleven fields, none empty; other lines are left out."""
    fields = F.split(column, ",")
    whole = lines.where((F.size(fields) == len(RAW_STREAM)) & ~F.exists(fields, lambda x: F.trim(x) == ""))
    parts = F.split(column, ",")
    return whole.select(*[F.try_element_at(parts, F.lit(i + 1)).cast(f.dataType).alias(f.name) for i, f in enumerate(RAW_STREAM)])


def broken_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    fields = F.split(column, ",")
    return lines.where((F.size(fields) != len(RAW_STREAM)) | F.exists(fields, lambda x: F.trim(x) == ""))


def valid_packets(rows: DataFrame, group: int | None = None, own_node: int | None = None, kind: int | None = None, status: int | None = None) -> DataFrame:
    """Without samples in which every axis is at its limit, other groups, a node's own echo, messages of another kind
    (``msg_type``), and packets that lack one of the bits of ``status``."""
    axes = [f.name for f in RAW_STREAM if f.name[:3] in ("acc", "gyr")]
    full = F.lit(True)
    for a in axes:
        full = full & (F.col(a) == 32767)
    rows = rows.where(~full)
    rows = rows if group is None else rows.where(F.col("group") == group)
    rows = rows if own_node is None else rows.where(F.col("node") != own_node)
    rows = rows if kind is None else rows.where(F.col("msg_type") == kind)
    return rows if status is None else rows.where(F.col("status").bitwiseAND(status) == status)


def loss_by_interval(rows: DataFrame, by: list[str], seq: str, t: str, interval: str, late: str) -> DataFrame:
    """Rows and lost numbers of each interval. A sequence number comes once, so a count stands for a count of
    different ones and no state holds the numbers."""
    g = rows.withWatermark(t, late).groupBy(F.window(t, interval), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("lo"), F.max(seq).alias("hi")).select(
        *by, F.col("window.start").alias("start"), "n", (1 - F.col("n") / (F.col("hi") - F.col("lo") + 1)).alias("loss"))


def time_windows(rows: DataFrame, by: list[str], x: str, t: str, size: str, step: str, late: str) -> DataFrame:
    g = rows.withWatermark(t, late).groupBy(F.window(t, size, step), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")).select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "min", "max")


def sessions(rows: DataFrame, by: list[str], t: str, gap: str, late: str) -> DataFrame:
    g = rows.withWatermark(t, late).groupBy(F.session_window(t, gap), *by)
    return g.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sample_windows(rows: DataFrame, by: str, order: str, x: str, size: int, step: int) -> DataFrame:
    """(by, window_id, first, mean, ptp) by number of samples: state is a partition's last samples and its count.

    Samples of a partition have to come in order from batch to batch, as a node sends them.
    """
    kind = rows.schema[by].dataType.simpleString()

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held_t, held_x = state.get if state.exists else (0, [], [])
        held_t, held_x = list(held_t), list(held_x)
        new = pd.concat(list(pdfs)).sort_values(order)
        held_t += new[order].astype("int64").tolist()
        held_x += new[x].astype(float).tolist()
        start = count  # place of the first held sample
        out = []
        while len(held_x) >= size:
            part = held_x[:size]
            out.append((key[0], start // step, held_t[0], sum(part) / size, max(part) - min(part)))
            held_t, held_x, start = held_t[step:], held_x[step:], start + step
        state.update((start, held_t, held_x))
        yield pd.DataFrame(out, columns=[by, "window_id", "first", "mean", "ptp"])

    return rows.select(by, order, x).groupBy(by).applyInPandasWithState(
        run, f"{by} {kind}, window_id long, first long, mean double, ptp double", "start long, t array<bigint>, x array<double>", "append", GroupStateTimeout.NoTimeout)


def open_timeline(rows: DataFrame, by: str, order: str, label: str) -> DataFrame:
    """(by, label, first, last, n): a run is given out when the next label comes; the open run is the state."""
    kind = rows.schema[by].dataType.simpleString()

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        out = []
        new = pd.concat(list(pdfs)).sort_values(order)
        for at, name in zip(new[order].astype("int64").tolist(), new[label].tolist()):
            if now and now[0] == name:
                now[2], now[3] = at, now[3] + 1
                continue
            if now:
                out.append((key[0], *now))
            now = [name, at, at, 1]
        if now:
            state.update(tuple(now))
        yield pd.DataFrame(out, columns=[by, "label", "first", "last", "n"])

    return rows.select(by, order, label).groupBy(by).applyInPandasWithState(
        run, f"{by} {kind}, label string, first long, last long, n long", "label string, first long, last long, n long", "append", GroupStateTimeout.NoTimeout)


#: A number lower than the one before by this much or more begins a session anew; by less it is late or comes again.
BACK = 64
_SESSION = "session long, first timestamp, last timestamp, n long, lowest long, highest long, lost long, duplicates long, ended string"


def session_table(rows: DataFrame, by: list[str], seq: str, t: str, gap_seconds: float) -> DataFrame:
    """(by, session, first, last, n, lowest, highest, lost, duplicates) of each session of a finished recording: a session
    ends where its numbers begin anew, or after a gap in time. lost are numbers that never came, duplicates rows
    whose number had come before."""
    w = Window.partitionBy(*by).orderBy(t, seq)
    before, last = F.lag(seq).over(w), F.lag(t).over(w)
    anew = (F.col(seq) <= before - BACK) | (F.col(t).cast("double") - last.cast("double") >= gap_seconds)
    numbered = rows.withColumn("session", F.sum(F.coalesce(anew, F.lit(False)).cast("long")).over(w))
    g = numbered.groupBy(*by, "session").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"), F.min(seq).cast("long").alias("lowest"), F.max(seq).cast("long").alias("highest"), F.countDistinct(seq).alias("__d"))
    return g.withColumns({"lost": F.col("highest") - F.col("lowest") + 1 - F.col("__d"), "duplicates": F.col("n") - F.col("__d")}).drop("__d")


class _Sessions(StatefulProcessor):
    """State of a key: its open session, with the highest number and the bits of the 64 numbers up to it. A timer at the
    end of the gap gives the session out and clears the key, so keys that fall silent leave the state."""

    def __init__(self, by: list[str], seq: str, t: str, gap_seconds: float):
        self.by, self.seq, self.t, self.gap = by, seq, t, int(gap_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "session long, first long, last long, n long, low long, high long, before long, bits long, distinct long")

    def _row(self, key: tuple, s: tuple, ended: str) -> tuple:
        session, first, last, n, low, high, _, _, distinct = s
        return (*key, session, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n, low, high, high - low + 1 - distinct, n - distinct, ended)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.by, "session", "first", "last", "n", "lowest", "highest", "lost", "duplicates", "ended"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values([self.t, self.seq])
        now, out = (tuple(self.open.get()) if self.open.exists() else None), []
        at = 0 if now is None else now[0]
        for us, q in zip((new[self.t].astype("datetime64[us]").astype("int64")).tolist(), new[self.seq].astype("int64").tolist()):
            if now is not None and (q <= now[6] - BACK or us - now[2] >= self.gap * 1000):
                out.append(self._row(key, now, "numbers begin anew" if q <= now[6] - BACK else "silence"))
                now, at = None, at + 1
            if now is None:
                now = (at, us, us, 1, q, q, q, 1, 1)
                continue
            session, first, last, n, low, high, _, bits, distinct = now
            if q > high:
                bits, high, fresh = (bits << (q - high) | 1) & (2**BACK - 1) if q - high < BACK else 1, q, True
            else:
                fresh = high - q >= BACK or not (bits & (2**BACK - 1)) >> (high - q) & 1
                bits |= 1 << (high - q) if high - q < BACK else 0
            now = (session, first, max(last, us), n + 1, min(low, q), high, q, bits, distinct + fresh)
            now = (*now[:7], now[7] - 2**BACK if now[7] >= 2 ** (BACK - 1) else now[7], now[8])
        self.open.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now[2] // 1000 + self.gap)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [self._row(key, tuple(self.open.get()), "silence")] if self.open.exists() else []
        self.open.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


#: Fixed value: the state store that stateful processors need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions_by_reset(rows: DataFrame, by: list[str], seq: str, t: str, gap_seconds: float, late: str) -> DataFrame:
    """The rows of ``session_table`` as they end, with ended, and why: the numbers of a key begin anew, or it is silent for the
    gap. A key's state ends with its session, so its next session is number 0 again. Rows of a key have to come in
    order from batch to batch; a number over 63 below the highest counts as one that had not come."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    marked = rows.select(*by, seq, t).withWatermark(t, late)
    return marked.groupBy(*by).transformWithStateInPandas(statefulProcessor=_Sessions(by, seq, t, gap_seconds), outputStructType=f"{kinds}, {_SESSION}", outputMode="Append", timeMode="EventTime")


def clock_offsets(rows: DataFrame, node: str, own: str, host: str) -> DataFrame:
    """(node, offset): how far a node's clock, in microseconds, is behind the host's; the least delay seen, as no packet
    arrives before it is sent."""
    return rows.groupBy(node).agg(F.min(F.col(host) - F.col(own)).cast("long").alias("offset"))


def on_host_clock(rows: DataFrame, offsets: DataFrame, node: str, own: str, name: str = "ts") -> DataFrame:
    """Adds the time of each row on the host's clock; rows of nodes without an offset are left out. ``offsets`` is a small
    static table with a row for each node."""
    known = offsets.select(F.col(node).alias("__node"), "offset")
    return rows.join(known, F.col(node) == F.col("__node")).withColumn(name, F.timestamp_micros(F.col(own) + F.col("offset"))).drop("__node", "offset")


def paired(left: DataFrame, right: DataFrame, by: list[str], t: str, within: str, late: str) -> DataFrame:
    """Rows of one node with those of another within a time of them, each side's columns prefixed by ``a_`` and ``b_``; a row
    without a partner comes alone. On streams it comes when the watermark has passed, and state goes with it."""
    a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]).withWatermark(f"{p}_{t}", late) for p, df in (("a", left), ("b", right)))
    near = F.expr(f"b_{t} BETWEEN a_{t} - INTERVAL {within} AND a_{t} + INTERVAL {within}")
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by]
    return a.join(b, [*same, near], "left_outer")
