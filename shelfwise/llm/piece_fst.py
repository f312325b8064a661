"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file. The normaliser rewrites blanks and puts the
word mark in front. The piece transducer is the Aho-Corasick automaton of all pieces; run over an
input it gives the arcs of the composed lattice. The byte fallback gives an arc of up to four
byte pieces to a character that is no piece. The encoding is the shortest path in the
tropical semiring (min, +).

* Unigram models weigh an arc by its piece's negative score.
* BPE models have no such weights: the merge order decides. It is a finite-state condition, though:
  a segmentation is what merging gives exactly if every two neighbouring pieces are what merging
  gives for the two alone. So the lattice is composed with that acceptor of pairs; a forbidden pair
  weighs infinity, an allowed one 0, and exactly one path of weight 0 remains. Pairs are judged by
  merging once and remembered.

How it scales: one narrow pass over whole texts. Where no piece crosses the start of a word, words
are composed one by one and remembered in a bounded cache.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches
from shelfwise.llm.tokens import UnitCache

MARK = "▁"
#: Piece types and model types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + n]
        at += n


class PieceTransducer:
    """Normaliser, pieces and byte fallback of one model file."""

    def __init__(self, model: bytes, cache_units: int = 350_000):
        self.pieces: list[tuple[str, float, int]] = []
        kind, fallback, spec = UNIGRAM, False, {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        for no, value in _fields(model):
            if no == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif no == 2:
                f = dict(_fields(value))
                kind, fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif no == 3:
                spec.update(dict(_fields(value)))
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} has no piece lattice")
        if spec[2]:
            raise ValueError("the model's character map is not supported, only the identity normaliser")
        self.kind, self.fallback = kind, fallback
        self.prefix, self.squeeze, self.escape = bool(spec[3]), bool(spec[4]), bool(spec[5])
        self.score = {p: s for p, s, t in self.pieces if t in (NORMAL, USER)}
        self.id = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.low = min(self.score.values(), default=0.0) - 10.0
        import ahocorasick

        self.arcs = ahocorasick.Automaton()
        for p in self.score:
            self.arcs.add_word(p, p)
        if self.score:
            self.arcs.make_automaton()
        self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.by_word = not any(pair[1] == MARK and pair[0] != MARK for pair in self.inner)
        self.allowed: dict[str, dict[str, bool]] = {}
        self.n_allowed = 0
        special = (BYTE, CONTROL, UNKNOWN)
        self.plain = [None if t in special else p.replace(MARK, " ") if self.escape else p for p, _, t in self.pieces]
        self.cache = UnitCache(self._unit, cache_units)

    def _parts(self, unit: str) -> list[str]:
        """The unit cut between characters that no piece holds side by side: no piece crosses there."""
        inner = self.inner
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in inner]
        return [unit[a:z] for a, z in zip([0, *cuts], [*cuts, len(unit)])] if cuts else [unit]

    # normaliser

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        return text.replace(" ", MARK) if self.escape else text

    # encoder

    def merge(self, text: str) -> list[str]:
        """Best-scoring neighbours merged first, the leftmost of equals, until none is a piece."""
        n = len(text)
        end = list(range(1, n + 1))  # end of the symbol that begins here; 0: no symbol begins here
        before = list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                s = self.score.get(text[i : end[j]])
                if s is not None:
                    heapq.heappush(heap, (-s, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, z = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != z:  # one of the two was merged meanwhile
                continue
            end[i], end[j] = z, 0
            if z < n:
                before[z] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [text[i : end[i]] for i in range(n) if end[i]]

    def _fits(self, a: str, b: str) -> bool:
        """Does merging ``a + b`` give the two pieces again?"""
        known = self.allowed.get(a)
        if known is None:
            known = self.allowed[a] = {}
        ok = known.get(b)
        if ok is None:
            self.n_allowed += 1
            if self.n_allowed > 500_000:
                self.allowed, self.n_allowed = {a: known}, 0
            ok = known[b] = self.merge(a + b) == [a, b]
        return ok

    def _bpe_path(self, unit: str) -> list[str] | None:
        """The one path of allowed pairs, if every character of ``unit`` is within pieces."""
        last: list[str | None] = [None] * (len(unit) + 1)
        last[0] = ""
        allowed = self.allowed
        for end, piece in self.arcs.iter(unit):
            if last[end + 1] is None:
                i = end + 1 - len(piece)
                before = last[i]
                if before is not None:
                    ok = i == 0
                    if not ok:
                        try:
                            ok = allowed[before][piece]
                        except KeyError:
                            ok = self._fits(before, piece)
                            allowed = self.allowed
                    if ok:
                        last[end + 1] = piece
        out, j = [], len(unit)
        while j:
            piece = last[j]
            if piece is None:
                return None
            out.append(piece)
            j -= len(piece)
        return out[::-1]

    def path(self, unit: str) -> list[str]:
        """Pieces (and single characters that are none) of the lattice's shortest path."""
        if self.kind == BPE and self.score and (short := self._bpe_path(unit)) is not None:
            return short
        n = len(unit)
        cost = [0.0] + [math.inf] * n
        last: list[str] = [""] * (n + 1)
        at = 0

        def unknown_until(end: int) -> None:
            """Arcs of the byte fallback for characters that are no piece."""
            nonlocal at
            while at < end:
                c = unit[at]
                if c not in self.score and cost[at] < math.inf:
                    w = cost[at] + (0.0 if self.kind == BPE else -self.low)
                    if w < cost[at + 1] and (self.kind != BPE or not at or self._fits(last[at], c)):
                        cost[at + 1], last[at + 1] = w, c
                at += 1

        for end, piece in self.arcs.iter(unit) if self.score else ():
            unknown_until(end)
            i = end + 1 - len(piece)
            if cost[i] == math.inf:
                continue
            if self.kind == BPE:
                if cost[end + 1] == math.inf and (i == 0 or self._fits(last[i], piece)):
                    cost[end + 1], last[end + 1] = 0.0, piece
            else:
                w = cost[i] - self.score[piece]
                if w < cost[end + 1]:
                    cost[end + 1], last[end + 1] = w, piece
        unknown_until(n)
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def _unit(self, unit: str) -> list[int]:
        parts = self._parts(unit) if self.kind == BPE else [unit]
        if len(parts) > 1:
            return np.frombuffer(b"".join(map(self.cache.__getitem__, parts)), np.int32).tolist()
        ids: list[int] = []
        for piece in self.path(unit):
            no = self.id.get(piece)
            if no is not None:
                ids.append(no)
            elif self.fallback:
                ids.extend(self.byte[b] for b in piece.encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        s = self.normalise(text) if text else ""
        if not s:
            return np.empty(0, np.int32)
        units = _WORD.findall(s) if self.by_word else [s]
        return np.frombuffer(b"".join(map(self.cache.__getitem__, units)), np.int32)

    # decoder

    def decode(self, ids) -> str:
        """Text of a sequence of ids; byte pieces are joined (bad ones become U+FFFD), control pieces vanish."""
        try:  # no special piece: the texts side by side
            text = "".join(map(self.plain.__getitem__, ids))
            return text[1:] if self.prefix and text.startswith(" ") else text
        except TypeError:
            pass
        out, held = [], bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                first = not out and self.prefix and piece.startswith(MARK)
                out.append(piece[1:] if first else piece)
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text.replace(MARK, " ") if self.escape else text


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """One transducer for each worker process and model file."""
    with open(path, "rb") as f:
        return PieceTransducer(f.read())


def encode_of(text: Column, model_path: str, spark: SparkSession) -> Column:
    """Piece ids (array of int) of a whole text; a null or empty text has none."""
    small_batches(spark, rows=1000)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(model_path)
        for texts in batches:
            yield pd.Series([t.encode(x) for x in texts], dtype=object)

    return run(text.cast("string"))


def decode_of(ids: Column, model_path: str, spark: SparkSession) -> Column:
    """Text of piece ids; null for null."""
    small_batches(spark, rows=1000)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(model_path)
        for rows in batches:
            yield pd.Series([None if x is None else t.decode(x.tolist()) for x in rows], dtype=object)

    return run(ids.cast("array<int>"))


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col``; all rows and columns stay, an empty table gives none, an ``out_col`` that ``df`` has already is an error.
    ``model_path`` must be readable on the executors."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is a column already; choose another out_col")
    return df.withColumn(out_col, encode_of(F.col(text_col), model_path, df.sparkSession))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded text in ``out_col``; the inverse of :func:`encode` up to the normaliser."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is a column already; choose another out_col")
    return df.withColumn(out_col, decode_of(F.col(ids_col), model_path, df.sparkSession))


def encode_and_decode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """:func:`encode`, and :func:`decode` of its ids, in one pass over the texts."""
    clash = {ids_col, out_col, "both_"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already: {sorted(clash)}; choose other names")
    small_batches(df.sparkSession, rows=1000)

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = transducer(model_path)
        for texts in batches:
            ids = [t.encode(x) for x in texts]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": [t.decode(x.tolist()) for x in ids]})

    both = df.withColumn("both_", run(F.col(text_col).cast("string")))
    return both.select("*", F.col("both_.ids").alias(ids_col), F.col("both_.decoded").alias(out_col)).drop("both_")
