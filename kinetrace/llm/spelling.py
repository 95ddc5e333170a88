"""Grouping of spelling variants by merging the subtrees of a trie of words with errors.

Words stand in a trie, whose nodes are rows keyed by a digest of their prefix, so that no task holds the trie.
The heavy child of a node is the one with most words below; a word leaves heavy paths at most log2(words) times,
and only there it is changed, small side into large:

* the light character replaced by the heavy one, or the heavy one put before it, or it skipped: the changed word
  is looked up among all words, which is where it coincides with a terminal of the larger subtree;
* the light subtrees of a node merged under a wildcard: words with the same node and the same rest coincide;
* a word that ends at a node is continued with its heavy child.

Every two words that are one edit apart coincide in exactly one of these ways: a replaced character is at one
place, and of an inserted or deleted character in a run of equal ones the last place counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import joined_evenly, table, text_of, written

#: Code points of a word, occurrences of a word, and how often a form must occur for each occurrence of its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: A run with a hash that this divides loses one code point.
ODD = 97
#: Entries that a task counts before it passes them on, and characters of words that it takes apart at once.
_HELD, _CHARACTERS = 200_000, 1 << 20
#: In Latin-1: A-Z in lower case, a-z and À-ÿ as they are, all else as spaces.
_RUN_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """The runs of letters of a text, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_RUN_BYTES).split()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of all texts. A run whose CRC with the document's id is a multiple of 97 has lost the
    code point at the CRC modulo its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(runs_of(text.as_py())).items():
                    if len(word) >= LEAST_LENGTH:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % ODD == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
                if len(held) > _HELD:
                    yield from passed_on()
        yield from passed_on()

    rows = docs.select(text_of(F.col(id_col).cast("string")).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))


def _digest(state: "hashlib._Hash") -> bytes:
    return state.digest()[:16]


def key_of(word: Column) -> Column:
    """The digest of a word, and of the node where it ends."""
    return F.unhex(F.substring(F.sha2(word, 256), 1, 32))


def steps(words: DataFrame) -> DataFrame:
    """(key, at, node, c): the way of each word through the trie; node is the digest of the characters before ``at``,
    which is carried on from character to character, so that long words take time in proportion to their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, at, node, c = [], [], [], []
            for name, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state = hashlib.sha256()
                for i, x in enumerate(word):
                    node.append(_digest(state))
                    state.update(x.encode())
                    key.append(name)
                    at.append(i)
                    c.append(x)
                    if len(key) >= _CHARACTERS:
                        yield _way(key, at, node, c)
                        key, at, node, c = [], [], [], []
            yield _way(key, at, node, c)

    return words.select("key", "word").mapInArrow(run, "key binary, at int, node binary, c string")


def _way(key: list[bytes], at: list[int], node: list[bytes], c: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(at, pa.int32()), pa.array(node, pa.binary()), pa.array(c, pa.string())], names=["key", "at", "node", "c"])


def coincidences(words: DataFrame) -> DataFrame:
    """(word, times, best): near words found in one way, how many, and the first of them as struct(less, word), less
    being minus its n. ``words`` has (word, n), each word once; a word may come in several rows."""
    words = written(words.withColumn("key", key_of(F.col("word"))), "words")
    ways = written(steps(words), "steps")
    children = ways.groupBy("node", "c").agg(F.count(F.lit(1)).alias("m"))
    heavy = written(children.groupBy("node").agg(F.max(F.struct("m", "c"))["c"].alias("h"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("m")), "heavy")
    light = joined_evenly(ways, heavy.where("k > 1").drop("k"), "node", "m", ["key"]).where("c <> h").select("key", "at", "node", "h", "c")
    light = written(light.join(words, "key").select("word", "n", "at", "node", "h", "c"), "light")
    word, before, after = F.col("word"), F.left("word", F.col("at")), F.substring("word", F.col("at") + 2, F.char_length("word"))
    changed = light.select("word", "n", F.explode(F.array(
        F.concat(before, "h", after), F.concat(before, "h", "c", after),
        F.when(F.substring("word", F.col("at") + 2, F.lit(1)) != F.col("c"), F.concat(before, after)),  # the last of a run of equal ones
    )).alias("other"))
    ends = words.join(heavy.select(F.col("node").alias("key"), "h"), "key").select("word", "n", F.concat("word", "h").alias("other"))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = changed.where("other IS NOT NULL").unionByName(ends).join(known, "other")
    one = F.lit(1).cast("long").alias("times")
    ranked = lambda n, w: F.struct((-n).alias("less"), w.alias("word"))
    there = met.select("word", one, ranked(F.col("other_n"), F.col("other")).alias("best"))
    back = met.select(F.col("other").alias("word"), one, ranked(F.col("n"), word).alias("best"))
    # words of one node and one rest differ in one character of the alphabet, so a group is no larger than that
    siblings = light.groupBy("node", after.alias("rest")).agg(F.array_sort(F.collect_list(ranked(F.col("n"), word))).alias("all")).where(F.size("all") > 1)
    merged = siblings.select(F.posexplode("all").alias("i", "own"), "all").select(
        F.col("own.word").alias("word"), (F.size("all") - 1).cast("long").alias("times"), F.when(F.col("i") == 0, F.element_at("all", 2)).otherwise(F.element_at("all", 1)).alias("best"),
    )
    return there.unionByName(back).unionByName(merged)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form). Forms grow in n, so there are no cycles; every pass doubles
    the way that a word has gone."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        sizes = now.groupBy("root").agg(F.count(F.lit(1)).alias("uses"))
        further = written(now.select(F.col("word").alias("root"), F.col("root").alias("next")).join(sizes, "root"), "further")
        if further.isEmpty():
            return now
        now = written(joined_evenly(now, further, "root", "uses", ["word"], "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least 5 code points that occurs three times.

    Null and empty texts have no words; a null id counts as an empty one. Of near words that occur equally often
    the first in code-point order is the form. Repeated rows count as often as they come. An empty table gives no
    rows; other columns play no part, whatever their names. Words of any length are compared whole.
    """
    words = written(word_counts(docs, id_col, text_col).where(F.col("n") >= LEAST_COUNT), "counts")
    near = coincidences(words).groupBy("word").agg(F.sum("times").alias("n_near"), F.min("best").alias("best"))
    rows = words.join(near, "word", "left")
    best_n = -F.col("best.less")
    fits = best_n >= RATIO * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, best_n).alias("form_n")), "forms")
    found = roots(rows.where("form IS NOT NULL"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY doc_id, w),
bits AS (
  SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(0, 256) t(i)),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)),
                                           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) AS h
  FROM (SELECT w, n, hex(encode(doc_id || ':' || w)) AS x FROM each), crcs),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 : length(w)] ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gone AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 : length(word)] AS rest FROM places),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
way AS (
  SELECT word, coalesce(form, word) AS reached, 1 AS k FROM forms
  UNION ALL SELECT way.word, forms.form, k + 1 FROM way JOIN forms ON forms.word = way.reached WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, k) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
