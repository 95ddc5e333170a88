"""Encoding and decoding with a SentencePiece BPE vocabulary by a merge-type prefix table.

For every prefix of a word BPE leaves one last token. An automaton over all pieces reports the pieces that
end at each place; the one that is compatible with the last token of the prefix before it is that prefix's
last token, and the ids follow backwards from the end. Two tokens are compatible when BPE leaves the pair
as it is. A merge never joins a letter to a later white-space mark, so words are independent and their ids
are kept in a bounded table; runs of white-space marks merge last, from the left.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import table

MARK = "▁"
#: Words kept by each worker; when full the table starts anew.
WORDS_KEPT, LONGEST_KEPT = 300_000, 40


class Vocabulary(NamedTuple):
    pieces: tuple[tuple[int, str, float], ...]  # id, piece, score
    byte_ids: tuple[int, ...]
    end_id: int
    digest: str


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a model on the driver; its pieces travel with the tasks (a vocabulary's size bounds them)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.decode(sp.encode("ﬁ  x ")) != "ﬁ  x " or sp.encode("x", out_type=str)[0][0] != MARK:
        raise ValueError("only identity normalisation with a leading white-space mark is supported")
    ids = range(sp.get_piece_size())
    normal = tuple((i, sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    with open(path, "rb") as f:
        return Vocabulary(normal, byte_ids, sp.eos_id(), hashlib.sha256(f.read()).hexdigest())


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.piece = {i: p for i, p, _ in vocabulary.pieces}
        self.id = {p: i for i, p, _ in vocabulary.pieces}
        self.score = {p: s for _, p, s in vocabulary.pieces}
        self.byte_ids = vocabulary.byte_ids
        self.byte_of = {i: b for b, i in enumerate(vocabulary.byte_ids)}
        self.end_id = vocabulary.end_id
        words = [p for p in self.id if p.strip(MARK)]
        if len({self.score[p] for p in words if len(p) > 1}) != sum(len(p) > 1 for p in words) or any(MARK in p[1:] for p in words) or min(self.score[p] for p in words if len(p) > 1) <= max(self.score[p] for p in self.id if len(p) > 1 and not p.strip(MARK)):
            raise ValueError("the prefix table needs distinct scores, white-space marks only at a piece's start and runs of them ranked last")
        self.automaton = ahocorasick.Automaton()
        for p in [*words, MARK]:
            self.automaton.add_word(p, (len(p), self.id[p], {-1: True}))
        self.automaton.make_automaton()
        self.single = {p for p in self.id if len(p) == 1}
        self.rank = {p: i for i, p in enumerate(sorted((p for p in self.id if len(p) > 1), key=lambda p: -self.score[p]))}
        self.shown = {i: p.encode() for i, p in self.piece.items()} | {i: bytes([b]) for i, b in self.byte_of.items()}
        self.mark_id, self.decimal = self.id[MARK], {i: str(i) for i in self.shown}
        self.split: dict[str, tuple[str, str]] = {}
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.run_table: dict[int, list[int]] = {}
        self.words: dict[str, tuple[bool, str, str]] = {}

    def merged(self, s: str) -> list[str]:
        """BPE as defined: the adjacent pair of the best score merges, from the left where scores tie."""
        at, left, right = list(s), list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        waiting: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (score := self.score.get(both := at[i] + at[right[i]])) is not None:
                heapq.heappush(waiting, (-score, i, both, right[i]))

        for i in range(len(s)):
            offer(i)
        while waiting:
            _, i, both, j = heapq.heappop(waiting)
            if right[i] != j or not at[i] or at[i] + at[j] != both:
                continue
            at[i], at[j], right[i] = both, "", right[j]
            if right[i] >= 0:
                left[right[i]] = i
            right[j] = -1
            offer(left[i])
            offer(i)
        return [x for x in at if x]

    def halves(self, p: str) -> tuple[str, str]:
        """The two pieces of a piece's last merge."""
        if (found := self.split.get(p)) is None:
            at = list(p)
            score, last = self.score, ("", "")
            while len(at) > 1:
                i = min(range(len(at) - 1), key=lambda i: (-score.get(at[i] + at[i + 1], float("-inf")), i))
                last = (at[i], at[i + 1])
                at[i : i + 2] = [at[i] + at[i + 1]]
            found = self.split[p] = last
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the pair: takes back the merges at the seam, latest first, and looks whether
        the pieces that then touch would have merged with each other before that."""
        x, y = self.piece[a], self.piece[b]
        rank, until, left_wins = self.rank, float("inf"), True
        while True:
            r = rank.get(x + y)
            if r is not None and (r < until or r == until and left_wins):
                return False
            rx, ry = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                until, left_wins, x = rx, False, self.halves(x)[1]
            else:
                until, left_wins, y = ry, True, self.halves(y)[0]

    def word_ids(self, w: str) -> list[int]:
        """Ids of a word with its leading mark; characters without a piece become bytes."""
        n = len(w)
        last = [0] * (n + 1)
        last[0] = -1
        if not self.single.issuperset(w):
            for i, c in enumerate(w):
                if c not in self.single:
                    last[i + 1] = -1
        for end, (length, token, after) in self.automaton.iter(w):
            end += 1
            if not last[end]:
                before = last[end - length]
                ok = after.get(before)
                if ok is None:
                    ok = after[before] = self.compatible(before, token)
                if ok:
                    last[end] = token
        out: list[int] = []
        lengths = self.length
        while n:
            token = last[n]
            if token == -1:
                out += [self.byte_ids[b] for b in reversed(w[n - 1].encode())]
                n -= 1
            else:
                out.append(token)
                n -= lengths[token]
        out.reverse()
        return out

    def run_ids(self, n: int) -> list[int]:
        """A run has no rank to order its merges, so it is merged as defined; lengths recur and are kept."""
        if (found := self.run_table.get(n)) is None:
            found = [self.id[p] for p in self.merged(MARK * n)]
            if n <= 1000:
                self.run_table[n] = found
        return found

    def word(self, w: str) -> tuple[bool, str, str]:
        """Of a word without its mark: whether the mark stays alone; its ids; what they decode to."""
        if (found := self.words.get(w)) is None:
            ids = self.word_ids(MARK + w)
            found = (ids[0] == self.mark_id, " ".join([self.decimal[i] for i in ids]), self.decode(ids))
            if len(w) <= LONGEST_KEPT:
                if len(self.words) >= WORDS_KEPT:
                    self.words.clear()
                self.words[w] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encoded(text)[0].split()]

    def encoded(self, text: str) -> tuple[str, str]:
        """The decimal ids joined by a space, the end id last; and the text that they decode to."""
        if not text:
            return str(self.end_id), ""
        parts = text.replace(MARK, " ").split(" ")
        get, word = self.words.get, self.word
        if "" not in parts:
            found = [get(p) or word(p) for p in parts]
            return " ".join([*[x[1] for x in found], str(self.end_id)]), " ".join([x[2] for x in found])
        ids, decoded, run = [], [], 0
        for p in parts:
            if not p:
                run += 1
                continue
            alone, own, shown = word(p)
            if run:
                ids += map(str, self.run_ids(run + alone))
                if alone:
                    own = own.partition(" ")[2]
                decoded.append(" " * run)
                run = 0
            ids.append(own)
            decoded.append(f" {shown}")
        if run:
            ids += map(str, self.run_ids(run))
            decoded.append(" " * run)
        return " ".join([*ids, str(self.end_id)]), "".join(decoded)[1:]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes as UTF-8, marks as spaces, without the leading one; control ids show nothing."""
        out = b"".join([self.shown.get(i, b"") for i in ids])
        text = out.decode(errors="replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_CODERS: dict[str, Coder] = {}


def coder(vocabulary: Vocabulary) -> Coder:
    if vocabulary.digest not in _CODERS:
        _CODERS[vocabulary.digest] = Coder(vocabulary)
    return _CODERS[vocabulary.digest]


def encode_decode(df: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """The columns of ``df`` and ``__ids`` (array of int, the end id last) and ``__decoded``.

    A null text counts as empty: the end id alone, decoded to an empty text. Any UTF-8 text encodes.
    """
    vocabulary = load_vocabulary(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            found = [c.encoded(x.as_py() or "") for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[int(i) for i in ids.split()] for ids, _ in found], pa.list_(pa.int32())), pa.array([d for _, d in found], pa.string())],
                names=[*batch.schema.names, "__ids", "__decoded"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, __ids array<int>, __decoded string")


def token_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; nulls as in ``encode_decode``. Rows that repeat, and
    rows of a null id, get what their text gets; an empty table gives no rows; other columns play no part."""
    vocabulary = load_vocabulary(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for x in batch.column(1):
                ids, decoded = c.encoded(x.as_py() or "")
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
