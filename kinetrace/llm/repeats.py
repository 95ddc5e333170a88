"""Removal of repeated passages by a family of suffix arrays of geometric sizes.

A passage repeats if a string of 200 bytes starts at two places. Every such string owns an anchor: the
50-byte string inside it with the smallest hash, so equal strings own equal anchors at equal offsets and
only suffixes that start at anchors need sorting. Anchors seen once anywhere are dropped by a bitmap of
bounded size. The others go, with the bytes around them, to the task of their anchor, where an index family
takes them in batches: a batch is sorted into a suffix array, scanned side by side with each level, and
merged with the last level while that is no larger. The scan gives each suffix its longest common extension
with a neighbour in another array, and only strings that end inside that extension can repeat; these are
grouped by hashes and compared byte by byte.

An anchor with very many places would need one task; its strings are spread by their hashes of 128 bits
instead and counted by an aggregation. What repeats within one task's documents is settled before the index:
only the first of equal surroundings of an anchor travels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import joined_evenly, table, text_of, written

LENGTH, ANCHOR = 200, 50
#: Suffixes in a batch, about how many a family indexes, and the most tasks; more suffixes make more families,
#: one after the other in a task.
BATCH, PER_FAMILY, MOST_TASKS = 1 << 15, 60_000, 20_000
#: Bits of the bitmaps of repeated and of hot anchors for each of them, and the most in all (128 MB).
BITS_EACH, MOST_BITS = 16, 1 << 30
#: An anchor with more places, a third of what a family takes, is counted by an aggregation.
HOT_PLACES = 20_000

_SEED = np.random.default_rng(19880501)
_STEP = 1 << 16


class _Polynomial:
    """Weights of bytes, and powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.byte = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(_STEP + 1023, b, np.uint64)])) for b in (base, pow(base, -1, 2**64)))


_FIRST, _SECOND = _Polynomial(0x9E3779B97F4A7C15), _Polynomial(0xC2B2AE3D27D4EB4F)


def grams(data: np.ndarray, width: int, by: _Polynomial = _FIRST) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes; the same string has the same hash at every place."""
    out = []
    for i in range(0, len(data) - width + 1, _STEP):
        part = data[i : i + _STEP + width - 1]
        total = np.concatenate([[np.uint64(0)], np.cumsum(by.byte[part] * by.up[: len(part)])])
        h = (total[width:] - total[:-width]) * by.down[: len(part) - width + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in each window, from running minima of blocks to the right and to the left."""
    n = len(h)
    blocks = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    blocks[:n] = h
    grid = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hashes): for each string of LENGTH bytes the place of its anchor, the leftmost of equals, and
    the hash at every place."""
    h = grams(data, ANCHOR)
    width, owner = LENGTH - ANCHOR + 1, []
    low = np.uint64((1 << 20) - 1)
    for i in range(0, len(h) - width + 1, 1 << 19):
        part = h[i : i + (1 << 19) + width - 1]
        keyed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        owner.append((_window_least(keyed, width) & low).astype(np.int64) + i)
    return (np.concatenate(owner) if owner else np.zeros(0, np.int64)), h


def _ranges(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place of each run of strings with one anchor, and the anchor."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return first, np.concatenate([first[1:], [len(owner)]]) - 1, owner[first]


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class Family:
    """Suffix arrays of geometric sizes over anchored suffixes."""

    def __init__(self):
        self.text: list[bytes] = []
        self.offset: list[int] = []
        self.reach: list[int] = []  # longest extension from the anchor that a suffix shares with another
        self.repeated: list[np.ndarray] = []
        self.levels: list[list[tuple[bytes, int]]] = []

    def add(self, batch: list[tuple[bytes, int, int, bool]]) -> None:
        """Takes (bytes, offset of the anchor, number of strings, known to repeat)."""
        fresh = []
        for text, offset, strings, known in batch:
            fresh.append((text[offset:], len(self.text)))
            self.text.append(text)
            self.offset.append(offset)
            self.reach.append(0)
            self.repeated.append(np.full(strings, known))
        fresh.sort()
        met: set[int] = set()
        for a, b in zip(fresh, fresh[1:]):
            self._meet(a, b, met)
        for level in self.levels:
            self._scan(fresh, level, met)
        self._compare(sorted(met))
        while self.levels and len(self.levels[-1]) <= len(fresh):
            fresh = self.levels.pop() + fresh
            fresh.sort()  # two sorted runs, which the sort merges in one pass
        self.levels.append(fresh)

    def _meet(self, a: tuple[bytes, int], b: tuple[bytes, int], met: set[int]) -> None:
        if a[0][:ANCHOR] == b[0][:ANCHOR]:
            n = common(a[0], b[0])
            for i in (a[1], b[1]):
                self.reach[i] = max(self.reach[i], n)
                met.add(i)

    def _scan(self, fresh: list[tuple[bytes, int]], level: list[tuple[bytes, int]], met: set[int]) -> None:
        """Each suffix of one array meets the nearest ones before and after it in the other: no other shares more."""
        i = j = 0
        waiting: list[tuple[bytes, int]] = []  # suffixes of one array since the last of the other
        last: list[tuple[bytes, int] | None] = [None, None]
        side = 0
        while i < len(fresh) or j < len(level):
            now = 0 if j == len(level) or i < len(fresh) and fresh[i][0] <= level[j][0] else 1
            x = level[j] if now else fresh[i]
            i, j = i + 1 - now, j + now
            if now != side:
                for w in waiting:
                    self._meet(w, x, met)
                waiting, side = [], now
            if last[1 - now]:
                self._meet(last[1 - now], x, met)
            last[now] = x
            waiting.append(x)
            if waiting[0][0][:ANCHOR] != x[0][:ANCHOR]:
                waiting = [x]  # those before cannot meet what comes after

    def _compare(self, ids: list[int]) -> None:
        """Marks the strings that occur twice among these suffixes, of those that their reach allows."""
        parts = []
        for i in ids:
            some = min(len(self.repeated[i]), self.reach[i] + self.offset[i] - LENGTH + 1)
            if some > 0:
                parts.append((i, some, self.text[i][: some + LENGTH - 1]))
        if not parts:
            return
        data = b"".join(p[2] for p in parts)
        starts = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
        some = np.array([p[1] for p in parts])
        place = np.arange(some.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(some)[:-1]]), some)
        twice = equal_strings(data, place)
        at = 0
        for i, n, _ in parts:
            self.repeated[i][:n] |= twice[at : at + n]
            at += n


def equal_strings(data: bytes, place: np.ndarray) -> np.ndarray:
    """Which of the strings of LENGTH bytes at these places of ``data`` occur at two of them. Hashes bring
    candidates together, runs of them are compared byte by byte, and what differs is grouped by its bytes."""
    hashes = grams(np.frombuffer(data, np.uint8), LENGTH)[place]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    out = np.zeros(len(place), bool)
    if not len(a):
        return out
    k = np.argsort(a)  # an index stands in a only once
    a, b = a[k], b[k]
    p, q = place[a], place[b]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(q) != 1), [True]]))
    doubtful: set[int] = set()
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        x, y, n = int(p[s]), int(q[s]), e - s + LENGTH - 1
        if data[x : x + n] == data[y : y + n]:
            out[a[s:e]] = True
            out[b[s:e]] = True
        else:
            doubtful.update(hashes[a[s:e]].tolist())
    if doubtful:
        groups: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(np.isin(hashes, np.array(list(doubtful), np.uint64))):
            groups.setdefault(data[place[i] : place[i] + LENGTH], []).append(int(i))
        for group in groups.values():
            if len(group) > 1:
                out[group] = True
    return out


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))


def _anchor_counts(docs: DataFrame) -> DataFrame:
    """(anchor, n): anchors with two places or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for x in batch.column(0):
                data = np.frombuffer(x.as_py().encode(), np.uint8)
                if len(data) < LENGTH:
                    continue
                owner, h = anchors(data)
                held.append(h[_ranges(owner)[2]])
                size += len(held[-1])
                if size >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["anchor"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _bitmap(repeated: DataFrame, bits: int) -> np.ndarray:
    """One bit for each repeated anchor, by the low bits of its hash (the high ones are small, as anchors are
    minima): the only thing that comes to the driver, at most MOST_BITS / 8 bytes however many there are."""
    at = F.col("anchor").bitwiseAND(F.lit(bits - 1)) + 1
    rows = repeated.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows.toLocalIterator():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _candidates(docs: DataFrame, bitmap, bits: int, hot, hot_bits: int) -> DataFrame:
    """Rows for the index, for the aggregation of hot anchors, and for what repeats within one task:
    (doc_id, h, first, last, anchor, text, offset, known, strings). first and last are the places where the
    strings start; ``known`` ones are settled; text is null in rows that carry a settled range, and strings
    has two hashes for each string of a hot anchor."""
    low = np.uint64(bits - 1)
    names = ["doc_id", "h", "first", "last", "anchor", "text", "offset", "known", "strings"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, hot_flags, id_kind = bitmap.value, hot.value, None
        seen: dict[tuple[bytes, int], list] = {}
        rows: list[tuple] = []

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_kind) for c, k in zip(zip(*out), kinds)], names=names)

        def is_hot(anchor: int) -> bool:
            at = anchor & (hot_bits - 1)
            return bool(hot_flags[at >> 3] >> (at & 7) & 1)

        def flushed() -> Iterator[pa.RecordBatch]:
            out = []
            for (text, offset), (known, doc, h, a, b, anchor) in seen.items():
                if is_hot(anchor):
                    data = np.frombuffer(text, np.uint8)
                    both = np.stack([grams(data, LENGTH, by).view(np.int64) for by in (_FIRST, _SECOND)], 1).ravel()
                    out.append((doc, h, a, b, anchor, None, 0, known, both))
                else:
                    out.append((doc, h, a, b, anchor, text, offset, known, None))
                if len(out) >= 8192:
                    yield told(out)
                    out = []
            if out:
                yield told(out)
            seen.clear()

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc, h, x in zip(*batch.columns, strict=True):
                raw = x.as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                if len(data) < LENGTH:
                    continue
                owner, hashes = anchors(data)
                first, last, at = _ranges(owner)
                place = hashes[at] & low
                maybe = (flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                if not maybe.any():
                    continue
                doc, h = doc.as_py(), h.as_py()
                for i in np.flatnonzero(maybe):
                    a, b, anchor = int(first[i]), int(last[i]), int(hashes[at[i]].view(np.int64))
                    key = (raw[a : b + LENGTH], int(at[i]) - a)
                    before = seen.get(key)
                    if before is None:
                        seen[key] = [False, doc, h, a, b, anchor]
                        continue
                    if not before[0]:
                        before[0] = True
                        rows.append((*before[1:5], before[2], None, 0, True, None))
                    rows.append((doc, h, a, b, h, None, 0, True, None))
                if len(rows) >= 8192:
                    yield told(rows)
                    rows = []
                if len(seen) >= 100_000:
                    yield from flushed()
        if rows:
            yield told(rows)
        yield from flushed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, h long, first long, last long, anchor long, text binary, offset int, known boolean, strings array<long>")


def _indexed(rows: DataFrame, tasks: int, families: int) -> DataFrame:
    """(doc_id, h, first, last): ranges of strings found to repeat by the index families of each task, and the
    settled ranges, which pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, owners, held, kind, now = Family(), [], [], None, 0

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (kind, pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "h", "first", "last"])

        def finished() -> Iterator[pa.RecordBatch]:
            if held:
                family.add(held)
            out: list[tuple] = []
            for (doc, h, a), marks in zip(owners, family.repeated, strict=True):
                if marks.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
                    out += [(doc, h, a + int(s), a + int(e) - 1) for s, e in zip(edges[::2], edges[1::2])]
                if len(out) >= 8192:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

        for batch in batches:
            kind = batch.schema.field(0).type
            settled = batch.column("text").is_null()
            yield pa.RecordBatch.from_arrays(batch.filter(settled).columns[:4], names=["doc_id", "h", "first", "last"])
            for doc, h, a, b, text, offset, known, cell in zip(*[c.to_pylist() for c in batch.filter(batch.column("text").is_valid()).columns], strict=True):
                if cell != now:
                    yield from finished()
                    family, owners, held, now = Family(), [], [], cell
                owners.append((doc, h, a))
                held.append((text, offset, b - a + 1, known))
                if len(held) >= BATCH:
                    family.add(held)
                    held = []
        yield from finished()

    kind = rows.schema["doc_id"].dataType.simpleString()
    cell = F.pmod(F.xxhash64("anchor", F.lit(11)), F.lit(families)).cast("int").alias("cell") if families > 1 else F.lit(0).alias("cell")
    sent = rows.where("strings IS NULL").select("doc_id", "h", "first", "last", "text", "offset", "known", cell, "anchor").repartition(tasks, "anchor").drop("anchor")
    if families > 1:
        sent = sent.sortWithinPartitions("cell")
    return sent.mapInArrow(run, f"doc_id {kind}, h long, first long, last long")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, first, last): ranges of places, in bytes, where a string of LENGTH bytes starts that also
    starts elsewhere. h is the hash of the whole text. Ranges may touch or come twice."""
    docs = _documents(docs, id_col, text_col)
    repeated = written(_anchor_counts(docs), "anchors")
    hot = repeated.where(F.col("n") > HOT_PLACES)
    some, places, hot_ones = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > HOT_PLACES)).first()
    bits, hot_bits = (min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * n).bit_length())) for n in (some, hot_ones))
    context = docs.sparkSession.sparkContext
    rows = _candidates(docs, context.broadcast(_bitmap(repeated, bits)), bits, context.broadcast(_bitmap(hot, hot_bits)), hot_bits)
    if hot_ones:
        rows = written(rows, "candidates")
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-places // PER_FAMILY))
    tasks = min(MOST_TASKS, wanted)
    found = _indexed(rows, tasks, -(-wanted // tasks))
    if hot_ones:
        held = rows.where("strings IS NOT NULL")
        each = held.select("doc_id", "h", "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("strings"), F.lit(2)), lambda i: F.struct(F.element_at("strings", i).alias("a"), F.element_at("strings", i + 1).alias("b")))).alias("i", "string"))
        twice = written(each.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "strings")
        place = F.col("first") + F.col("i")
        again = joined_evenly(each, twice, "string", "n", ["doc_id", "h", "first", "i"])
        found = found.unionByName(again.select("doc_id", "h", place.alias("first"), place.alias("last")))
    return found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with ``kept_bytes`` kept: the bytes
    that stay.

    Null texts count as empty; texts shorter than LENGTH lose nothing; rows that repeat a text of LENGTH
    bytes or more lose all of it, as each is the other's elsewhere. Matches never cross rows. An empty table gives
    no rows.
    """
    found = repeated_ranges(docs, id_col, text_col).groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))  # rows that repeat have the same ranges
    found = found.withColumnsRenamed({"doc_id": "id_", "h": "h_"})
    rows = _documents(docs, id_col, text_col)
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left").select("doc_id", "text", F.transform("ranges", lambda r: r["first"]).alias("first"), F.transform("ranges", lambda r: r["last"]).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, sha, kept = [], [], [], [], []
            for x, first, last in zip(*batch.columns[1:], strict=True):
                raw = x.as_py().encode()
                n.append(len(raw))
                if first.is_valid:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, first.values.to_numpy(), 1)
                    np.add.at(edge, last.values.to_numpy() + LENGTH, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(np.concatenate([[False], gone]).view(np.int8)) == 1).sum()))
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] * kept_bytes)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] * kept_bytes)])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' * kept_bytes}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
