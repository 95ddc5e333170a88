"""Divergence of sources within a language, by a heavy-light split of the vocabulary.

Every group (language and source) gives every kept term of the language a scaled probability. A pair of groups
is compared by a sum over all terms, most of which most groups lack. Terms that many groups have are heavy: they
fill dense NumPy tiles of groups by terms; all others are light. A pair of groups starts from the value as if both
lacked every term. Tiles correct it for the heavy terms, a histogram of each group's light probabilities for the
light terms that one of them has, and the postings of a term, taken in pairs, for those that both have. All
parts are whole numbers and are added exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinetrace.llm.common import joined_evenly, table, text_of, written

SCALE = 1_000_000_000
#: Documents of its language that a term must be in, and ranks of the part ``term``.
LEAST_DOCUMENTS, RANKS = 3, 200
#: A term is heavy if one in HEAVY_SHARE groups of its language has it, or more than MOST_SPARSE groups do: so the
#: pairs of a light term's postings are bounded, and fewer than the cells that it would fill in a dense tile.
HEAVY_SHARE, MOST_SPARSE = 4, 1024
#: Groups on a side of a tile and terms in one: two sides of 8 MB each.
TILE_GROUPS, TILE_TERMS = 256, 4096
#: Entries that a task counts before it passes them on, which bounds its memory.
_HELD = 200_000
#: Letters A-Z in lower case, other letters and all bytes of other scripts as they are, the rest as spaces.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_BASE, _HISTOGRAM, _DENSE = 0, 1, 2


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, d): how often a term occurs in the texts of a group and in how many of them.
    Tasks count first, so what shuffles is counts and not words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                if n:
                    terms = pa.array(list(n), pa.binary()).cast(pa.string())
                    names = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "d"])
            held.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                terms = text.as_py().translate(_TERM_BYTES).split()
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > _HELD:
                yield from passed_on()
        yield from passed_on()

    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def scaled(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in decimals so that no product overflows."""
    wide = lambda c: c.cast("decimal(18,0)")
    above, below = wide(F.lit(SCALE)) * wide(n + 1), F.nullif(wide(total + terms), wide(F.lit(0)))
    return F.call_function("div", above, below) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ^ 2 / q); at most some 10 ^ 18, so longs hold it."""
    return F.call_function("div", (p - q) * (p - q), q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def postings_and_groups(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Kept terms of the groups: (g, lang, source, term, p, q, i, heavy, groups), and the groups: (g, lang, source,
    i, p0, terms, tiles, blocks). i numbers the groups of a language from 0, q is the language's probability,
    p0 that of a term the group lacks."""
    counts = term_counts(docs, lang_col, source_col, text_col)
    of = Window.partitionBy("lang", "term")  # a row for each group at most
    kept = written(
        counts.withColumns({"ln": F.sum("n").over(of), "ld": F.sum("d").over(of), "k": F.count(F.lit(1)).over(of), "first": F.min("source").over(of)})
        .where(F.col("ld") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n", "ln", "k", (F.col("first") == F.col("source")).cast("long").alias("one")),
        "kept",
    )
    occurring = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    places = written(occurring.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "places")
    sizes = places.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    by_k = kept.groupBy("lang", "k").agg(F.sum("one").alias("terms"), F.sum("n").alias("n")).join(sizes, "lang")
    heavy = (F.col("k") * HEAVY_SHARE >= F.col("groups")) | (F.col("k") > MOST_SPARSE)
    langs = by_k.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("n").alias("all_n"), F.sum(F.when(heavy, F.col("terms")).otherwise(0)).alias("heavies"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    groups = places.join(own, ["lang", "source"], "left").join(sizes, "lang").join(langs, "lang", "left").select(
        F.struct("lang", "source").alias("g"), "lang", "source", "i", "groups", *[zero(c).alias(c) for c in ("group_n", "size", "terms", "all_n", "heavies")],
    )
    groups = written(groups.withColumns({
        "p0": F.coalesce(scaled(F.lit(0), F.col("group_n"), F.col("terms")), F.lit(1)),
        "tiles": F.ceil(F.col("groups") / TILE_GROUPS).cast("int"), "blocks": F.ceil(F.col("heavies") / TILE_TERMS).cast("int"),
    }), "groups")
    facts = groups.select("g", "i", "p0", "groups", "tiles", "blocks", "group_n", "terms", "all_n", "size")
    rows = joined_evenly(kept.select(F.struct("lang", "source").alias("g"), "term", "n", "ln", "k"), facts, "g", "size", ["term"])
    postings = rows.select(
        "g", "term", scaled(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), scaled(F.col("ln"), F.col("all_n"), F.col("terms")).alias("q"), "i", "p0", "tiles", "blocks", heavy.alias("heavy"),
    )
    return written(postings, "postings"), groups


def _tile(key: tuple, rows: pa.Table, size: int) -> pa.Table:
    """Both directions of all pairs of a group on one side of a tile with one on the other. Block -1 gives what a pair
    would have if it lacked all terms, and the corrections for light terms as if no two groups had one in common;
    any other block the corrections for its heavy terms."""
    lang, a, b, block = (k.as_py() for k in key)
    part, i, p, m = (rows.column(c).to_numpy() for c in ("part", "i", "p", "m"))
    base, rest = np.flatnonzero(part == _BASE), np.flatnonzero(part != _BASE)
    base = base[np.argsort(i[base])]
    names, p0, terms = i[base], p[base], m[base]
    at = np.searchsorted(names, i[rest])
    mine, theirs = (np.flatnonzero(names // size == side) for side in (a, b))
    sums = np.zeros((len(names), len(names)), np.int64)
    sides = [(mine, theirs)] if a == b else [(mine, theirs), (theirs, mine)]
    if block < 0:
        for left, right in sides:
            sums[np.ix_(left, right)] = terms[left][:, None] * gaps(p0[left][:, None], p0[right][None])
        other = {x: np.setdiff1d(theirs if x in mine else mine, [x]) for x in range(len(names))}
        for x, value, times in zip(at, p[rest], m[rest]):
            to = other[x]
            sums[x, to] += times * (gaps(value, p0[to]) - gaps(p0[x], p0[to]))
            sums[to, x] += times * (gaps(p0[to], value) - gaps(p0[to], p0[x]))
    else:
        found = rows.column("term").combine_chunks().take(pa.array(rest)).dictionary_encode()
        dense = np.repeat(p0[:, None], len(found.dictionary), axis=1)  # terms of the block that no group here has are not in it
        dense[at, found.indices.to_numpy(zero_copy_only=False)] = p[rest]
        for left, right in sides:
            for x in left:
                sums[x, right] = gaps(dense[x][None], dense[right]).sum(axis=1) - dense.shape[1] * gaps(p0[x], p0[right])
    x, y = (np.concatenate(z) for z in zip(*[(np.repeat(left, len(right)), np.tile(right, len(left))) for left, right in sides]))
    x, y = x[x != y], y[x != y]
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "i": names[x].astype(np.int32), "j": names[y].astype(np.int32), "value": sums[x, y]})


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value): the divergence of group i from group j, for all pairs of groups of a language."""
    size = TILE_GROUPS
    light, side = postings.where("NOT heavy"), F.floor(F.col("i") / size).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    term = F.xxhash64("term")

    def dealt(rows: DataFrame, part: int, p: Column, m: Column, blocks: Column, name: Column) -> DataFrame:
        """To each tile that the group's side is in, and each of ``blocks``."""
        rows = rows.select(F.col("g.lang").alias("lang"), "i", p.alias("p"), m.alias("m"), name.alias("term"), blocks.alias("blocks"), F.explode(every).alias("t"), side.alias("side"))
        return rows.select("lang", F.least("side", "t").alias("a"), F.greatest("side", "t").alias("b"), F.explode("blocks").alias("block"), F.lit(part).alias("part"), "i", "p", "m", "term")

    none, nothing = F.lit(0).cast("long"), F.lit(None).cast("string")
    base = dealt(groups, _BASE, F.col("p0"), F.col("terms"), F.sequence(F.lit(-1), F.col("blocks") - 1), nothing)
    histogram = light.groupBy("g", "i", "p", "tiles").agg(F.count(F.lit(1)).alias("m"))
    lone = dealt(histogram, _HISTOGRAM, F.col("p"), F.col("m"), F.array(F.lit(-1)), nothing)
    dense = dealt(postings.where("heavy"), _DENSE, F.col("p"), none, F.array(F.pmod(term, F.col("blocks")).cast("int")), F.col("term"))
    tiles = base.unionByName(lone).unionByName(dense).groupBy("lang", "a", "b", "block").applyInArrow(lambda key, rows: _tile(key, rows, size), "lang string, i int, j int, value long")
    shared = light.groupBy(F.col("g.lang").alias("lang"), "term").agg(F.collect_list(F.struct("i", "p", "p0")).alias("has")).where(F.size("has") > 1)  # MOST_SPARSE at most
    x, y = F.col("x"), F.col("y")
    both = shared.select("lang", "has", F.explode("has").alias("x")).select("lang", "x", F.explode("has").alias("y")).where(x["i"] != y["i"])
    joint = gap(x["p"], y["p"]) - gap(x["p"], y["p0"]) - gap(x["p0"], y["p"]) + gap(x["p0"], y["p0"])
    joint = both.groupBy("lang", x["i"].alias("i"), y["i"].alias("j")).agg(F.sum(joint).alias("value"))
    exact = F.sum(F.col("value").cast("decimal(38,0)")).cast("long")
    return tiles.unionByName(joint).groupBy("lang", "i", "j").agg(exact.alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). ``pair``: the divergence of a source from each other source of its
    language; ``term``: the 200 terms that a source has most beyond its language.

    Null texts, languages and sources count as empty ones. A group whose texts have no kept term takes part in
    pairs; a language without kept terms gives pairs of value 0. A language with one source has no pairs. Equal
    values rank by the item's bytes, so ranks have no ties. Repeated rows count as often as they come, whatever
    their ids. An empty table gives no rows; other columns play no part, whatever their names.
    """
    postings, groups = postings_and_groups(docs, lang_col, source_col, text_col)
    named = groups.select("lang", "i", "source")
    pairs = (
        pair_sums(postings, groups).join(named, ["lang", "i"]).join(named.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    terms = postings.where("p > q").select("g.lang", "g.source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= RANKS))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cell AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cell c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(g.total + v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // CAST(langs.total + v AS HUGEINT) AS q
  FROM g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN cell c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms) WHERE rank <= 200
"""
