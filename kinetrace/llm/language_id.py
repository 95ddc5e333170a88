"""Language identification by a byte convolutional network.

A window of bytes goes through filters of several widths over one-hot bytes, each filter keeps its maximum
over the window, and a softmax reads the maxima. The network is trained in NumPy on labelled text and
applied to every fixed-length window of every text; a text's language is the one with the highest mean
probability over its windows, each weighted by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.common import table
from kinetrace.llm.toxicity import fold

#: Bounds of the training sample: labelled documents, and windows of each. Prediction has none.
TRAIN_DOCS, TRAIN_WINDOWS = 3000, 6
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.02, 7
#: Windows that go through the network at once.
_AT_ONCE = 64


class Model(NamedTuple):
    langs: tuple[str, ...]
    taps: tuple[np.ndarray, ...]  # by offset: [byte, filter]; filters ordered so that the widest come first
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray


def has_letter(text: str) -> bool:
    """Whether a character of the text is of one of Unicode's letter categories; fractions, superscripts and
    circled numbers are not."""
    return any(map(str.isalpha, text))


def _filters() -> list[int]:
    """The filters' widths, the widest first: those that reach an offset are then a leading slice."""
    return [w for w in sorted(WIDTHS, reverse=True) for _ in range(FILTERS)]


def maxima(x: np.ndarray, taps: tuple[np.ndarray, ...], bias: np.ndarray, where: bool = False):
    """Largest response of each filter in each window of ``x`` [n, WINDOW]; byte 0 pads. ``where``: and its place."""
    n, length = x.shape
    out = taps[0][x] + bias
    for j in range(1, len(taps)):
        out[:, : length - j, : taps[j].shape[1]] += taps[j][x[:, j:]]
    if not where:
        return out.max(1)
    at = out.argmax(1)
    return np.take_along_axis(out, at[:, None, :], 1)[:, 0], at


def probabilities(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.maximum(maxima(x, m.taps, m.bias), 0) @ m.weight + m.offset
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zeros, and the bytes that each holds."""
    n = -(-len(data) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    held = np.full(n, WINDOW)
    held[-1] = len(data) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), held


def train(rows: list[tuple[bytes, str]], epochs: int = EPOCHS) -> Model | None:
    """From (window, language) by stochastic gradient descent with Adagrad steps; None without rows."""
    langs = tuple(sorted({lang for _, lang in rows}))
    if not rows:
        return None
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (data, _) in enumerate(rows):
        data = data[:WINDOW]
        x[i, : len(data)] = np.frombuffer(data, np.uint8)
    y = np.array([langs.index(lang) for _, lang in rows])
    rng, widths = np.random.default_rng(SEED), np.array(_filters())
    taps = tuple((rng.standard_normal((256, int((widths > j).sum()))) * 0.3).astype(np.float32) for j in range(max(WIDTHS)))
    m = Model(langs, taps, np.zeros(len(widths), np.float32), (rng.standard_normal((len(widths), len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*m.taps, m.bias, m.weight, m.offset]
    past = [np.full_like(p, 1e-2) for p in params]
    f = np.arange(len(widths))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), BATCH):
            rows_ = order[s : s + BATCH]
            xb, yb = x[rows_], y[rows_]
            top, at = maxima(xb, m.taps, m.bias, where=True)
            act = np.maximum(top, 0)
            z = act @ m.weight + m.offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            back = (p @ m.weight.T) * (top > 0)
            grads = []
            for j, tap in enumerate(m.taps):
                k = tap.shape[1]
                place = at[:, :k] + j
                inside = place < WINDOW
                g = np.zeros_like(tap)
                byte = np.take_along_axis(xb, np.minimum(place, WINDOW - 1), 1)
                np.add.at(g, (byte, np.broadcast_to(f[:k], byte.shape)), back[:, :k] * inside)
                grads.append(g)
            grads += [back.sum(0), act.T @ p, p.sum(0)]
            for q, g, h in zip(params, grads, past):
                h += g * g
                q -= RATE * 3 * g / np.sqrt(h)
    return m


def predict(text: str | None, m: Model | None) -> tuple[str, float]:
    if m is None or text is None or not has_letter(text):
        return "und", 0.0
    x, held = cut(text.encode())
    total = np.zeros(len(m.langs))
    for i in range(0, len(x), _AT_ONCE):
        total += held[i : i + _AT_ONCE] @ probabilities(x[i : i + _AT_ONCE], m)
    total /= held.sum()
    best = int(total.argmax())
    return m.langs[best], float(min(1.0, max(0.0, total[best])))


def training_rows(docs: DataFrame, rows: int = TRAIN_DOCS, each: int = TRAIN_WINDOWS) -> list[tuple[bytes, str]]:
    """Evenly spaced windows of at most ``rows`` labelled documents outside the held-out fold, an equal number
    of each language as far as it has them, chosen by a hash of the id.

    Ids are chosen first: a language's documents are thinned by the hash to about twice its share before they
    are numbered, so no task sees all ids of a frequent language. With more than ``rows`` languages the most
    frequent ones are learned, one document each.
    """
    learn = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 5) != 0))
    sizes = learn.groupBy(F.col("lang").alias("lang_")).agg(F.count(F.lit(1)).alias("n_")).orderBy(F.desc("n_"), "lang_").limit(rows).collect()
    if not sizes:
        return []
    share = -(-rows // len(sizes))
    counts = docs.sparkSession.createDataFrame([(r["lang_"], 2.0 * (share + 20) / r["n_"]) for r in sizes], "lang_ string, part double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thinned = learn.select("doc_id", "lang").join(F.broadcast(counts), F.col("lang") == F.col("lang_")).where(place <= F.col("part"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = thinned.withColumn("k", number).where(F.col("k") <= share).select(F.col("doc_id").alias("id_"), F.col("lang").alias("lang_")).distinct()
    step = F.greatest(F.lit(1), F.floor(F.char_length("text") / each)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.substring(F.col("text"), (i * step + 1).cast("int"), F.lit(WINDOW)))
    found = learn.join(F.broadcast(some), (F.col("doc_id") == F.col("id_")) & (F.col("lang") == F.col("lang_"))).select("doc_id", "lang", "text", cuts.alias("cuts")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("lang", "cuts").limit(2 * rows)
    return sorted({(w.encode()[:WINDOW], r["lang"]) for r in found.collect() for w in r["cuts"] if has_letter(w)})


def identify(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, lang_pred and score: ``und`` with score 0 for a null text or one
    without a letter, and for all texts if there was nothing to learn from. Ids play no part, so null and repeated
    ones are as any other; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(x.as_py(), model) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*(f"c{i}" for i in range(len(keep))), "lang_pred", "score"])

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(training_rows(docs)), ["doc_id"]).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
