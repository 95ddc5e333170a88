"""Toxicity by stems that toxic text has beyond chance.

The method asked for, compression distance with one zstandard dictionary for each class, does not find the
toxic documents of these tables: single toxic words stand in ordinary running text, and what they save a
window is less than windows differ by anyway (figures in the README). So this is another method, and says so:
stems are beginnings of words, chosen by a likelihood ratio on labelled training rows; a document is scored by
how many of its words begin with one. What a number of such words says is learned on training rows that the
stems were not chosen on.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import table

#: Bounds of the training sample: labelled rows, and code points of each of their texts. Scoring has none.
TRAIN_ROWS, TRAIN_CHARS = 4000, 50_000
THRESHOLD = 0.3
#: A word longer than this is taken in pieces. Words whose answer a task keeps.
WORD_BYTES, WORDS_KEPT = 64, 400_000
#: Parts of the training rows; each is scored by stems of the others to learn what their number says.
PARTS = 3
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Words that begin with a stem are counted up to the last of these.
_BINS = (0, 1, 2, 3, 5)
#: Minima that agree in one band of eight make near copies: 0.96 likely at a similarity of 0.8, 4e-6 at 0.15.
_BANDS, _BAND = 16, 8


class Model(NamedTuple):
    stems: frozenset[bytes]
    share: tuple[float, ...]  # toxic share by bin


def words_of(text: str) -> list[bytes]:
    found = _WORD.findall(text.encode().lower())
    if any(len(w) > WORD_BYTES for w in found):
        found = [w[i : i + WORD_BYTES] for w in found for i in range(0, len(w), WORD_BYTES)]
    return found


class Scorer:
    def __init__(self, stems: frozenset[bytes], share: tuple[float, ...] = ()):
        self.stems, self.share = stems, share
        self.lengths = sorted({len(s) for s in stems})
        self.kept: dict[bytes, bool] = {}

    def begins(self, word: bytes) -> bool:
        """Whether a word begins with a stem."""
        if (found := self.kept.get(word)) is None:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            found = self.kept[word] = any(word[:n] in self.stems for n in self.lengths)
        return found

    def hits(self, words: list[bytes]) -> int:
        return sum(map(self.begins, words))

    def score(self, text: str) -> float:
        return self.share[_bin(self.hits(words_of(text)))]


def _bin(n: int) -> int:
    return max(i for i, least in enumerate(_BINS) if n >= least)


def _shares(counts: list[list[int]]) -> tuple[float, ...]:
    """Smoothed toxic share by bin; more windows never lower it."""
    out: list[float] = []
    for k, n in counts:
        out.append(max([(k + 1) / (n + 2) if n else 0.0, *out[-1:]]))
    return tuple(out)


def _stems(word: bytes) -> list[bytes]:
    """Every beginning of a word of three characters or more, the word itself last."""
    ends = [i for i in range(1, len(word)) if word[i] & 0xC0 != 0x80]
    return [word[:i] for i in (*ends[2:], len(word))]


def without_copies(texts: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """One of near copies with the same label, by bands of minima of hashes of their words: copies of one text are
    no further evidence for its words."""
    factor = np.random.default_rng(0).integers(1, 2**63, (_BANDS * _BAND, 1), np.uint64) * 2 + 1
    seen, out = set(), []
    for ws, y in texts:
        words = np.array([crc32(w) + 1 for w in set(ws)] or [0], np.uint64)
        least = np.array([(words * f >> 32).min() for f in factor]).reshape(_BANDS, _BAND)
        keys = {(y, i, band.tobytes()) for i, band in enumerate(least)}
        if seen.isdisjoint(keys):
            out.append((ws, y))
        seen |= keys
    return out


def _gain(a: int, b: int, toxic: int, ordinary: int) -> float:
    """Log-likelihood ratio of two rates, a of ``toxic`` and b of ``ordinary``, over one; 0 unless the first is higher."""
    if a * ordinary <= b * toxic:
        return 0.0
    held = lambda k, n: (k * log(k / n) if k else 0.0) + ((n - k) * log(1 - k / n) if k < n else 0.0)
    return held(a, toxic) + held(b, ordinary) - held(a + b, toxic + ordinary)


def own_stems(texts: list[tuple[list[bytes], int]]) -> list[bytes]:
    """Stems that toxic documents have more often than the best of as many stems would by chance, best first. A stem
    counts only words that no better one has, so the beginning of one toxic word does not pass as a stem of its own.
    If no stem is beyond chance, the best ones."""
    total, toxic, ordinary, held = Counter(y for _, y in texts), Counter(), Counter(), {}
    for ws, y in texts:
        if y:
            for w in set(ws):
                if w not in held:
                    held[w] = _stems(w)
            toxic.update({s for w in set(ws) for s in held[w]})
    for ws, y in texts:
        if not y:
            for w in set(ws):
                if w not in held:
                    held[w] = [s for s in _stems(w) if s in toxic]
            ordinary.update({s for w in set(ws) for s in held[w]})
    gains = {s: _gain(n, ordinary[s], total[1], total[0]) for s, n in toxic.items()}
    least = min(log(max(2, len(gains))), max(gains.values(), default=0.0))
    found = sorted((s for s, g in gains.items() if g >= least > 0), key=lambda s: (-gains[s], -len(s), s))
    some, words, places = set(found), defaultdict(list), defaultdict(list)
    for w, ss in held.items():
        for s in some.intersection(ss):
            words[s].append(w)
    near = {w for ws in words.values() for w in ws}
    for i, (ws, _) in enumerate(texts):
        for w in near.intersection(ws):
            places[w].append(i)
    own, taken = [], set()
    for s in found:
        rest = [w for w in words[s] if w not in taken]
        at = {i for w in rest for i in places[w]}
        n = sum(texts[i][1] for i in at)
        if _gain(n, len(at) - n, total[1], total[0]) >= least:
            own.append(s)
            taken.update(rest)
    return own


def train(rows: list[tuple[str, int]]) -> Model | None:
    """From (text, label 0 or 1); None unless both labels occur. Which part a row is in depends on its text."""
    texts = without_copies([(words_of(t), y) for t, y in rows])
    if len({y for _, y in texts}) < 2:
        return None
    parts: list[list[tuple[list[bytes], int]]] = [[] for _ in range(PARTS)]
    for ws, y in texts:
        parts[crc32(b" ".join(ws)) % PARTS].append((ws, y))
    counts = [[0, 0] for _ in _BINS]
    for k, part in enumerate(parts):
        scorer = Scorer(frozenset(own_stems([t for j, other in enumerate(parts) if j != k for t in other])))
        for ws, y in part:
            at = counts[_bin(scorer.hits(ws))]
            at[0] += y
            at[1] += 1
    return Model(frozenset(own_stems(texts)), _shares(counts))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled rows outside the held-out fold, chosen by a hash of the id; of rows that share an id
    and a text one."""
    some = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", 4) != 2))
        .groupBy(F.col("doc_id").alias("id_")).agg(F.max("toxic").alias("toxic_"))
        .orderBy(F.xxhash64("id_"), "id_").limit(rows)
    )
    found = docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, chars).alias("text")).join(F.broadcast(some), F.col("id") == F.col("id_")).where("text IS NOT NULL")
    return sorted((r["text"], int(r["toxic_"])) for r in found.select("id", "text", "toxic_").distinct().orderBy(F.xxhash64("id"), "id", "text").limit(2 * rows).collect())


_SCORERS: dict[Model, Scorer] = {}


def scored(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, and score. Null and empty texts score as texts without a hit;
    without a model every score is 0. Rows that repeat, whatever their ids, get the same score; an empty table gives
    no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None and model not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model] = Scorer(*model)
        for batch in batches:
            score = [_SCORERS[model].score(x.as_py() or "") if model else 0.0 for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64())], names=[*(f"c{i}" for i in range(len(keep))), "score"])

    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``. A null id is in the fold of the empty text;
    repeated rows come as often as in ``docs``, and an empty table gives no rows. Only doc_id and toxic of ``labels``,
    and doc_id and text of ``docs``, play a part, whatever else they have."""
    model = train(training_rows(docs, labels))
    return scored(docs, model, ["doc_id"]).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
