"""Byte-level BPE ids of whole texts, equal to the ``tokenizers`` library's, word by word from a cache.

A blank before a non-blank always starts a new pre-token and nothing before it matters to
what follows, so the units between such blanks are encoded one by one. Running text repeats
its words: for one text, units come from a bounded cache and only new ones are encoded; for a column of
texts, Arrow finds its different units, and these are encoded in one call.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pre-token pattern of byte-level BPE (also in the tokenizer files' package).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEFORE_BLANK = re.compile(r" (?:\s|$)")
_UNIT = re.compile(r" (?=\S)")
#: Stands between units that are encoded in one call: white space before a blank is a pre-token of its own.
_APART = "\r"


def _byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the
    others in order for the characters from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitCache(dict):
    """Unit to its ids as bytes. When ``limit`` units are held they become the old generation, from
    which used ones come back; long units are not held."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = array("i", self.encode(unit)).tobytes()
        if len(unit) <= 48:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class Encoder:
    """Ids of a ``tokenizers`` byte-level BPE file; the string of an added token in a text is that token."""

    def __init__(self, path: str, cache_units: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        # ids must rise with merge order for the ranks to be the ids
        if all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs)):
            import tiktoken

            byte = _byte_alphabet()
            ranks = {bytes(byte[c] for c in tok): no for tok, no in vocab.items() if tok not in special}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._plain = own.encode_ordinary
            apart = self._plain(_APART)
            self._apart = apart[0] if len(apart) == 1 else None
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            self._plain = lambda s: t.encode(s, add_special_tokens=False).ids
            self._apart = None
        added = {t["content"]: array("i", [t["id"]]).tobytes() for t in spec.get("added_tokens", [])}
        self._added = added
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._cache = UnitCache(lambda unit: self._plain(" " + unit), cache_units)

    def _packed(self, text: str) -> bytes:
        if not text:
            return b""
        units = _UNIT.split(text) if _BEFORE_BLANK.search(text) else text.split(" ")
        first = array("i", self._plain(units[0])).tobytes()
        return first + b"".join(map(self._cache.__getitem__, units[1:]))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self._special is None or not self._special.search(text):
            return np.frombuffer(self._packed(text), np.int32)
        parts = self._special.split(text)  # added tokens at odd places
        return np.frombuffer(b"".join(self._added[p] if i % 2 else self._packed(p) for i, p in enumerate(parts)), np.int32)

    def _units(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of units, each after a blank: all ids, and where each unit's begin and how many they are.

        Units are joined by Arrow and encoded in one call; only those whose last byte is no printable ASCII become
        Python's strings, to see whether they end in white space."""
        start, length = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        together = np.zeros(len(units), bool)
        if self._apart is not None and len(units):
            ends = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
            data = np.frombuffer(units.buffers()[2] or b"", np.uint8)
            held = np.flatnonzero(np.diff(ends))
            last = data[ends[held + 1] - 1]
            together[held] = (last > 0x20) & (last < 0x7F)
            apart = np.flatnonzero(data[ends[0] : ends[-1]] == ord(_APART)) + ends[0]
            together[np.searchsorted(ends, apart, side="right") - 1] = False
            others = np.flatnonzero(~together)
            found = units.take(pa.array(others)).to_pylist()
            together[others] = [u != "" and _APART not in u and not u[-1].isspace() for u in found]
        parts = []
        if together.any():
            joined = units.filter(pa.array(together))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined), f"{_APART} ")[0].as_py()
            ids = np.array(self._plain(" " + joined), np.int32)
            at = np.append(np.flatnonzero(ids == self._apart), len(ids))
            length[together] = np.diff(at, prepend=-1) - 1
            start[together] = at - length[together]
            parts.append(ids)
        alone = np.flatnonzero(~together)
        filled = sum(map(len, parts))
        for i, unit in zip(alone.tolist(), units.take(pa.array(alone)).to_pylist()):
            parts.append(np.array(self._plain(" " + unit), np.int32))
            start[i], length[i] = filled, len(parts[-1])
            filled += len(parts[-1])
        return np.concatenate([np.empty(0, np.int32), *parts]), start, length

    def lists(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text and ``end_id`` (null text: only that id)."""
        texts = texts.cast(pa.string()).fill_null("")
        whole = [(self._special is not None and self._special.search(t) is not None) or _BEFORE_BLANK.search(t) is not None for t in texts.to_pylist()]
        split = pc.split_pattern(pc.if_else(pa.array(whole, pa.bool_()), "", texts), " ")
        row = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        ids, start, length = self._units(coded.dictionary)
        unit = coded.indices.to_numpy()
        start, length = start[unit], length[unit]
        # what has no blank before it (a text's first unit), texts that are not cut, and the end have ids of their own
        firsts = []
        for text, w in zip(texts.to_pylist(), whole):
            firsts.append(self(text) if w else np.array(self._plain(text.partition(" ")[0]), np.int32))
        begin = len(ids) + np.append(0, np.cumsum([len(f) for f in firsts], dtype=np.int64))
        start[row[:-1]], length[row[:-1]] = begin[:-1], np.diff(begin)
        ids = np.concatenate([ids, *firsts, np.array([end_id], np.int32)])
        start, length = np.insert(start, row[1:], len(ids) - 1), np.insert(length, row[1:], 1)
        ends = np.append(0, np.cumsum(length))
        at = np.repeat((start - ends[:-1]).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends[row + np.arange(len(row))], pa.int32()), pa.array(ids[at]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
