"""Near-duplicate detection by HyperMinHash.

A document is the set of its five-word shingles. Each of 128 hash functions is one bucket, which keeps the
smallest value that it gave as a register of 16 bits: a leading-zero count and the mantissa bits after it.
Bands of four registers bring candidates together; their Jaccard similarity is estimated from equal
registers, corrected for registers that are equal by chance; pairs that could reach the threshold are
verified on their full shingle sets. A pair of exactly 0.75 misses all 32 bands with a chance of 5e-6.

Documents with one set are one class from the start, represented by a digest of the set. Candidate buckets
are worked through twice. The first pass takes two bands and cuts large buckets into blocks; the links it
confirms join most classes into components. The second pass takes every band and those buckets alone whose
members are in different components. A large one is cut into blocks, the members of its largest component
apart from the others, and each pair of blocks that may hold a link is a tile: every candidate pair between
components is compared once, no task holds more than two blocks, and blocks of one component never meet.

A word is known by its 64-bit XXH3 hash, and a shingle by a weighted sum of its words' bits, weights by place. Sets
of one shingle are told apart by 128 bits of a digest of the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kinetrace.llm.common import is_set, joined_evenly, key_bitmap, masked, recorded, removed, settled, table, text_of, unmasked, written
from kinetrace.llm.graph import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: A register: leading zeros (up to 63) and so many mantissa bits.
MANTISSA = 10
FIRST_BANDS = 2
#: Members of a bucket in a block, and shingles of all of them, some 16 MB; a task holds two blocks at once.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Standard errors that an estimate may lie under the threshold before its pair is passed over.
SLACK = 4.5

_SEED = np.random.default_rng(20240229)
_MUL = _SEED.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, REGISTERS, dtype=np.uint64)
#: Weights of a shingle's words by their place.
_WEIGHT = _SEED.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words cut into shingles at a time.
_WORDS = 1 << 16


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words part at ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; of all words as one if they are fewer."""
    if len(words) < width:
        width = max(1, len(words))
    blocks = [_shingles(words[i : i + _WORDS + width - 1], width) for i in range(0, len(words) - width + 1, _WORDS)]
    return np.unique(blocks[0] if len(blocks) == 1 else np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = known[:n] * _WEIGHT[0]
    for k in range(1, width):
        h += known[k : k + n] * _WEIGHT[k]
    return _mixed(h + np.uint64(width))


def set_digest(words: list[bytes], hashes: np.ndarray) -> bytes | None:
    """128 bits that stand for the set: of its hashes, or of the words where it is one shingle."""
    if not len(hashes):
        return None
    return hashlib.blake2b(b" ".join(words[:SHINGLE]) if len(hashes) == 1 else hashes.tobytes(), digest_size=16, person=b"one" if len(hashes) == 1 else b"set").digest()


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set that is not empty."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096]
        for at in range(0, REGISTERS, 32):
            least[at : at + 32] = np.minimum(least[at : at + 32], (_mixed_fast(h[None, :] * _MUL[at : at + 32, None] + _ADD[at : at + 32, None])).min(1))
    return packed(least)


def _mixed_fast(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def packed(least: np.ndarray) -> np.ndarray:
    """Leading zeros in the high 6 bits, then the MANTISSA bits after the first one bit."""
    low = least.astype(np.float64)
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(low, 1))), 0, 63).astype(np.uint64)
    shifted = (least << zeros) << np.uint64(1)
    return ((zeros << np.uint64(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def chance_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the minima of disjoint sets of n and m hashes fall into one register cell all the same. A
    cell that starts at x is x / 2**MANTISSA wide up to the rounding of x to a power of two, and the minima
    have densities n exp(-n x) and m exp(-m x); summed over the cells this is n m / (n + m)**2 times the mean
    width of a cell in parts of x, 1 / (2 ln 2), over 2**MANTISSA."""
    return n * m / np.square(n + m) / (2 * np.log(2)) / 2**MANTISSA


def similarity(mine: np.ndarray, n: float, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of one document against several."""
    equal = (other == mine).mean(1)
    chance = chance_equal(n, m)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame, id_col: str, text_col: str, sets: bool = False) -> DataFrame:
    """(doc_id, h, n, digest, registers) of each row, or with ``sets`` (digest, hashes); a text without words
    has n 0 and a null digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, out = [], [], []
            for x in batch.column(2):
                words = words_of(x.as_py())
                s = shingle_set(words)
                n.append(len(s))
                digest.append(set_digest(words, s))
                out.append((s if sets else registers(s)).tobytes() if len(s) else None)
            head = [] if sets else [batch.column(0), batch.column(1), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*head, pa.array(digest, pa.binary()), pa.array(out, pa.binary())], names=["digest", "hashes"] if sets else ["doc_id", "h", "n", "digest", "registers"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash(id_col, text_col).alias("h"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "digest binary, hashes binary" if sets else f"doc_id {kind}, h long, n long, digest binary, registers binary")


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), text_of(text_col))


def _buckets(classes: DataFrame, first: int) -> DataFrame:
    """(digest, root, n, band, key) for the leading bands, of buckets with two members or more. A bitmap of keys
    that come twice, of bounded size, keeps the others from travelling; the few it lets through do no harm."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(first)])
    rows = classes.select("digest", "root", "n", F.posexplode(keys).alias("band", "key"))
    repeated = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    bits, bitmaps = key_bitmap(repeated, "key")
    at = F.pmod(F.col("key"), F.lit(bits)) + 1
    rows = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(at) == F.col("bucket")).where(is_set(F.col("bits"), at))
    return written(rows.select("digest", "root", "n", "band", "key"), "buckets")


class _Tile:
    """Members of a tile of a bucket and the candidate pairs among them. Members are (digest, n, registers, root,
    block). A pair is left to the first band that it shares; in a tile of two blocks the pairs inside one block
    are left out, as the tile of that block alone has them."""

    def __init__(self, group: list[tuple], band: int, tile: int):
        self.band, self.one = band, _lower(tile) == _upper(tile)
        self.n = np.array([g[1] for g in group], np.float64)
        self.registers = np.stack([np.frombuffer(g[2], np.uint16) for g in group])
        names: dict[bytes, int] = {}
        self.component = np.array([names.setdefault(g[3], len(names)) for g in group])
        self.block = np.array([g[4] for g in group])
        self.bands = self.registers.view(np.uint64).reshape(len(group), BANDS)
        need = PERCENT / 100
        self.least = need - SLACK * (need * (1 - need) / REGISTERS) ** 0.5

    def before(self, i: int) -> np.ndarray:
        """Members before the i-th that could be its near duplicates, are in other components, and are to be
        compared here; the most similar first. Classes of one shingle each are different, whatever their hashes."""
        fits = (self.component[:i] != self.component[i]) & (self.n[:i] + self.n[i] > 2)
        if not self.one:
            fits &= self.block[:i] != self.block[i]
        other = np.flatnonzero(fits)
        other = other[np.minimum(self.n[other], self.n[i]) * 100 >= PERCENT * np.maximum(self.n[other], self.n[i])]
        if self.band and len(other):
            other = other[~(self.bands[other, : self.band] == self.bands[i, : self.band]).any(1)]
        if not len(other):
            return other
        guess = similarity(self.registers[i], self.n[i], self.registers[other], self.n[other])
        order = np.argsort(-guess, kind="stable")
        return other[order[: int((guess >= self.least).sum())]]


#: Blocks of one bucket are numbered below this; a tile is the lower of its two blocks times this and the upper.
_MOST_BLOCKS = 1 << 31


def _lower(tile: int) -> int:
    return tile // _MOST_BLOCKS


def _upper(tile: int) -> int:
    return tile % _MOST_BLOCKS


def _promising(group: list[tuple], band: int, tile: int) -> np.ndarray:
    """Which members have a candidate."""
    held, out = _Tile(group, band, tile), np.zeros(len(group), bool)
    for i in range(1, len(group)):
        other = held.before(i)
        if len(other):
            out[i] = True
            out[other] = True
    return out


def _linked(group: list[tuple], band: int, tile: int) -> Iterator[tuple[bytes, bytes]]:
    """Links between members of different components, verified on their full sets (a last field of members).
    Components join as links are found, so there is at most one link fewer than members."""
    held = _Tile(group, band, tile)
    component, hashes = held.component, [np.frombuffer(g[5], np.uint64) for g in group]
    for i in range(1, len(group)):
        other = held.before(i)
        at, step = 0, 4
        while at < len(other):
            some = other[at : at + step]
            at, step = at + step, min(256, step * 4)
            some = some[component[some] != component[i]]
            if not len(some):
                continue
            sizes = np.array([len(hashes[j]) for j in some])
            every = np.concatenate([hashes[j] for j in some])
            place = np.searchsorted(hashes[i], every)
            place[place == len(hashes[i])] = 0
            shared = np.add.reduceat((hashes[i][place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for j in some[100 * shared >= PERCENT * (sizes + len(hashes[i]) - shared)]:
                if component[j] != component[i]:
                    yield group[i][0], group[j][0]
                    component[component == component[i]] = component[j]


def _by_tile(rows: DataFrame, fields: list[str], use: Callable[[tuple, list[tuple]], list[tuple]], kinds: str) -> DataFrame:
    """Gives each tile (band, key, tile) of ``rows`` to ``use`` as tuples of its other fields."""
    schema = _parse_datatype_string(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), types)], schema=types)
        now, held = None, []
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != now:
                    if len(held) > 1:
                        out += use(now, held)
                    now, held = row[:3], []
                held.append(row[3:])
            if out:
                yield told(out)
        if len(held) > 1 and (out := use(now, held)):
            yield told(out)

    dealt = rows.select("band", "key", "tile", *fields).repartition("band", "key", "tile")
    return dealt.sortWithinPartitions("band", "key", "tile", "digest").mapInArrow(run, kinds)


def _with_candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members that have a candidate in their tile, so that only their sets travel."""
    def use(at: tuple, group: list[tuple]) -> list[tuple]:
        return [(*at, g[0], g[3], g[4]) for g, yes in zip(group, _promising(group, at[0], at[2])) if yes]

    full = members.join(classes.select("digest", "n", "registers"), "digest")
    return _by_tile(full, ["digest", "n", "registers", "root", "block"], use, "band int, key long, tile long, digest binary, root binary, block long")


def _confirmed(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """(a, b): confirmed links among ``members`` (band, key, tile, digest, root, block); ``hashes`` has the
    sets and registers of their classes."""
    full = members.join(hashes, "digest")
    return _by_tile(full, ["digest", "n", "registers", "root", "block", "hashes"], lambda at, group: list(_linked(group, at[0], at[2])), "a binary, b binary")


def _hashes_of(docs: DataFrame, id_col: str, text_col: str, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, hashes, n, registers) of the classes in ``members``, from their representatives' texts. A bitmap
    of row hashes keeps the other texts from being cut into shingles; the join that follows is exact."""
    wanted = written(members.select("digest").distinct().join(classes.select("digest", "h", "n", "registers"), "digest"), "wanted")
    bits, bitmaps = key_bitmap(wanted, "h")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("__at", F.pmod(row_hash("doc_id", "text"), F.lit(bits)) + 1)
    rows = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number("__at") == F.col("bucket")).where(is_set(F.col("bits"), F.col("__at"))).drop("__at", "bucket", "bits")
    return sketches(rows, "doc_id", "text", sets=True).where("digest IS NOT NULL").dropDuplicates(["digest"]).join(wanted.select("digest", "n", "registers"), "digest")


def _tile(a: Column, b: Column) -> Column:
    return F.least(a, b) * _MOST_BLOCKS + F.greatest(a, b)


def _blocks(size: Column, shingles: Column) -> Column:
    """How many blocks so many members with so many shingles are cut into."""
    return F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")


def _first_pass(classes: DataFrame) -> DataFrame:
    """Members of buckets for the first bands, each in a tile of one block."""
    rows = _buckets(classes, FIRST_BANDS)
    size = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 1"), "sizes")
    rows = joined_evenly(rows, size.select("key", "size", _blocks(F.col("size"), F.col("shingles")).alias("blocks")), "key", "size", ["digest"])
    block = F.pmod(F.xxhash64("digest"), F.col("blocks"))
    return rows.select("band", "key", _tile(block, block).alias("tile"), "digest", "root", block.alias("block"))


def _second_pass(classes: DataFrame) -> DataFrame:
    """Members of buckets with two components or more, for every tile that may hold a link between components.
    Blocks of the largest component come first and meet only blocks of others; a bucket of one block is a tile."""
    rows = _buckets(classes, BANDS)
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    mixed = by_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("members").alias("size"), F.sum("shingles").alias("shingles"), F.max(F.struct("members", "root", "shingles")).alias("most")).where("roots > 1")
    most, small = F.col("most"), _blocks(F.col("size"), F.col("shingles")) <= 1
    common_blocks, other_blocks = _blocks(most["members"], most["shingles"]), _blocks(F.col("size") - most["members"], F.col("shingles") - most["shingles"])
    mixed = mixed.select("key", "size", most["root"].alias("common_root"), F.when(small, 0).otherwise(common_blocks).cast("long").alias("common_blocks"), F.when(small, 1).otherwise(other_blocks).cast("long").alias("other_blocks"))
    rows = joined_evenly(rows, written(mixed, "mixed"), "key", "size", ["digest"])
    c, o, h = F.col("common_blocks"), F.col("other_blocks"), F.xxhash64("digest")
    common = (c > 0) & (F.col("root") == F.col("common_root"))
    rows = rows.withColumn("block", F.when(common, F.pmod(h, F.greatest(c, F.lit(1)))).otherwise(c + F.pmod(h, o)))
    meets = F.sequence(F.when(common, c).otherwise(F.lit(0)), c + o - 1)  # others meet every block, their own included
    return rows.withColumn("with", F.explode(meets)).select("band", "key", _tile(F.col("block"), F.col("with")).alias("tile"), "digest", "root", "block")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and h, the ``row_hash``.

    A null or empty text, or one of white space alone, has no shingles and is linked with nothing: its
    component is its own id. Equal sets are linked, whatever their texts. component_id is the smallest id
    of the component, null ids aside; kept says that the row has that id, so rows that repeat an id share it.
    An empty table gives no rows; other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    with recorded() as first:
        sketched = written(sketches(docs, id_col, text_col), "sketches")
    classes = written(sketched.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("size")), "classes")
    seen = written(sketched.select("doc_id", "h", "n", "digest"), "seen")
    removed(spark, first)  # the registers of classes are enough

    def links_among(members: DataFrame) -> DataFrame:
        members = written(members, "members")
        return _confirmed(members, _hashes_of(docs, id_col, text_col, members, classes))

    alone = classes.withColumn("root", F.col("digest"))
    links = settled(lambda: links_among(_first_pass(alone)), "confirmed")
    roots = settled(lambda: components(links), "roots")
    joined = classes.join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest")).drop("node")
    more = settled(lambda: links_among(_with_candidates(_second_pass(joined), classes)), "confirmed")
    roots = settled(lambda: components(links.union(more)), "roots")
    least = roots.join(classes.select("digest", "least"), F.col("node") == F.col("digest")).groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("nodes"))
    known = written(joined_evenly(roots, written(least, "least"), "root", "nodes", ["node"]).select(F.col("node").alias("digest"), "component"), "known")
    named = written(classes.select("digest", "least", "size").join(known, "digest", "left").select("digest", "size", F.coalesce("component", "least").alias("component")), "named")
    out = joined_evenly(seen.where("digest IS NOT NULL"), named, "digest", "size", ["doc_id", "h"]).select("doc_id", "h", "n", "component")
    out = out.unionByName(seen.where("digest IS NULL").select("doc_id", "h", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"), "h")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component: the one with the smallest id, and if rows share that
    id the one with the smallest row hash. Rows whose component has no id but null all stay."""
    found = written(near_duplicates(docs, id_col, text_col).where("kept").select("component_id", "h"), "kept")
    named = found.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("h").alias("h_")).select("h_")
    stay = written(named.union(found.where("component_id IS NULL").select("h")).distinct(), "stay")
    plain, names = masked(docs)
    return unmasked(plain.withColumn("__h", row_hash(names[id_col], names[text_col])).join(stay, F.col("__h") == F.col("h_"), "left_semi"), names)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("h")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, CAST(i AS INT), CAST(i + least(5, len(w)) - 1 AS INT)), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
