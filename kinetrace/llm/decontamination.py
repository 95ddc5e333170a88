"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, an item of fewer words being one window. For an
exact containment the necessary prefix of a window's words, ordered by how rare they are in the corpus, is
its rarest word. Document words meet windows on that word; the word's place in the window gives the only
possible start, which must leave room for the whole window (length and position bounds), and there the
words are compared. Windows are taken in blocks of bounded size, each broadcast to one pass over the
documents, so the join never shuffles the corpus and a frequent word needs no special care.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import lower_ascii, table, text_of, written

WINDOW = 10
#: Most windows, and most different words, that are broadcast at once: some 50 MB. More windows take more
#: passes; more words are counted by a shuffle.
WINDOWS_AT_ONCE, WORDS_AT_ONCE = 100_000, 500_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), _GAP), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _GAP_ANY_CASE), lambda w: w != "")).cast("long")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, items): the different windows and the ids, as text, of the items that have them. A null id
    shows as an empty text; a null text has no words and so no window."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_of(text_col)).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.lit(1), F.size("all") - window + 1)
    cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(F.col("all"), i, F.lit(window)))
    return items.select("item", F.explode(cut).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def rarity(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often each word of the vocabulary occurs in all documents. ``docs`` has words."""
    said = docs.select(F.explode("words").alias("word"))
    if vocabulary.count() <= WORDS_AT_ONCE:
        said = said.join(F.broadcast(vocabulary), "word", "left_semi")
    counted = said.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def _prefixed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds each window's necessary prefix: its rarest word and the first place that word has in it."""
    each = windows.select("id", F.posexplode("words").alias("at", "word")).join(counts, "word")
    first = each.groupBy("id").agg(F.min(F.struct("n", "word", "at")).alias("rarest"))
    return windows.join(first, "id").select("id", "words", "items", F.col("rarest")["word"].alias("prefix"), F.col("rarest")["at"].alias("place"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """(doc_id, h, starts, items): for each text that a window occurs in, where windows start (from 0), how
    long they are, and the items. h is a hash of the text, so rows that share an id stay apart."""
    windows = benchmark_windows(benchmark, item_col, item_text_col, window).withColumn("id", F.xxhash64("words"))
    windows = written(windows, "windows")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"), words_of(text_of(text_col)).alias("words"))
    counts = rarity(texts, windows.select(F.explode("words").alias("word")).distinct())
    prefixed = written(_prefixed(windows, counts), "prefixes")
    blocks = max(1, -(-prefixed.count() // WINDOWS_AT_ONCE))
    found = []
    for b in range(blocks):
        block = prefixed.where(F.pmod("id", F.lit(blocks)) == b) if blocks > 1 else prefixed
        block = block.select(F.col("words").alias("wanted"), "items", "prefix", "place")
        start = F.col("pos") - F.col("place")
        found.append(
            texts.select("doc_id", "h", "words", F.posexplode("words").alias("pos", "word"))
            .join(F.broadcast(block), F.col("word") == F.col("prefix"))
            .where((start >= 0) & (start + F.size("wanted") <= F.size("words")))
            .where(F.slice("words", start + 1, F.size("wanted")) == F.col("wanted"))
            .select("doc_id", "h", F.struct(start.alias("start"), F.size("wanted").alias("n")).alias("span"), "items")
        )
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the columns ``carry``, then doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and the hit words as ranges (start, end) from 0, ends exclusive and merged by union.

    Null and empty texts have no words and are never contaminated; an empty benchmark hits nothing. Rows
    that repeat get the same values.
    """
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    found = found.select(
        F.col("doc_id").alias("id_"), F.col("h").alias("h_"), F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), F.array_sort("spans").alias("hit_spans"),
    )
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"), count_words(text_of(text_col)).alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    none = F.lit(0).cast("long")
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"), "hit_spans",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


ORACLE = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(w, CAST(i AS INT), CAST(i + least(10, len(w)) - 1 AS INT)) AS g, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM win),
sh AS (
  SELECT r, i, n, array_to_string(list_slice(w, CAST(i AS INT), CAST(i + n - 1 AS INT)), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, sh.n, item FROM sh JOIN win ON sh.n = win.n AND sh.g = array_to_string(win.g, ' ')),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
