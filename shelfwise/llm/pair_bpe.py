"""BPE encoding and decoding with a pair occurrence index.

The words of a block of texts lie side by side in one symbol array. An index maps every pair
that a merge rule names to all its positions there. The active ranks are taken in ascending order
from a heap; a rank's positions are merged from left to right, and the positions of the pairs
that a merge makes are added to the lists of their ranks (a position whose pair is gone is passed
over when its list is read). A word only meets its own pairs, in the order in which it would meet
them alone, so the ids are those of word-by-word BPE; a word of any length costs about
``n log n``.

Normaliser and pre-tokeniser are those of the tokenizer file. Where they drop white space (the
code asks them), a text is the row of its blank-separated units, and a partition indexes
each new word once: bounded stores hold what earlier blocks found.

How it scales: one narrow pass, no shuffle; memory is bounded by a block of texts (or the longest
text) and by the stores.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches

_GONE = -1
_ODD_BLANK = re.compile(r"[\x1c-\x1f]")  # blanks to str.split(), not to the tokenizer files' patterns
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class PairIndex:
    """All positions of every active pair in one symbol array; words are parted by a symbol that no rule names."""

    def __init__(self, words: list[list[int]], follow: list[dict[int, int]], rules: list[tuple[int, int, int]]):
        """``follow[a][b]``: the rank of the pair ``(a, b)``; ``rules[rank]``: ``(a, b, merged)``."""
        self.follow, self.rules = follow, rules
        sym = self.sym = [_GONE]
        self.ends = [0]
        for w in words:
            sym += w
            self.ends.append(len(sym))
            sym.append(_GONE)
        n = len(sym)
        self.next, self.prev = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = np.fromiter((follow[a].get(b, -1) for a, b in zip(sym, sym[1:])), np.int64, n - 1)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        known, first = np.unique(rank[at], return_index=True)
        #: rank of an active pair to its positions
        self.where = {r: places.tolist() for r, places in zip(known.tolist(), np.split(at, first[1:]))}

    def merge_all(self) -> None:
        sym, nxt, prev, follow, where = self.sym, self.next, self.prev, self.follow, self.where
        active = list(where)
        heapify(active)
        while active:
            rank = heappop(active)
            places = where.pop(rank)
            a, b, new = self.rules[rank]
            after = follow[new]
            places.sort()
            for at, i in enumerate(places):
                j = nxt[i]
                if sym[i] != a or sym[j] != b:
                    continue  # an earlier merge took one of the two
                k, before = nxt[j], prev[i]
                sym[i], sym[j] = new, _GONE
                nxt[i], prev[k] = k, i
                sooner = False
                for made, place in ((follow[sym[before]].get(new), before), (after.get(sym[k]), i)):
                    if made is None:
                        continue
                    if made in where:
                        where[made].append(place)
                    else:
                        where[made] = [place]
                        heappush(active, made)
                        sooner = sooner or made < rank
                if sooner:  # a rule of a lower rank became active: the rest of this list waits
                    left = places[at + 1 :]
                    if left:
                        where[rank] = left
                        heappush(active, rank)
                    break

    def words(self) -> Iterator[bytes]:
        """The symbols left of each word, packed."""
        left = np.array(self.sym, np.int32)
        live = left != _GONE
        packed = left[live].astype("<i4").tobytes()
        bounds = (4 * np.cumsum(live))[self.ends].tolist()
        for a, z in zip(bounds, bounds[1:]):
            yield packed[a:z]


class Held:
    """What was found for a string, for the last ``limit`` strings or more: a full generation becomes the
    old one, from which strings that are asked for come back."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, wanted: set[str]) -> set[str]:
        """Those of ``wanted`` that must be found anew; all others are in ``now``."""
        lost = wanted.difference(self.now)
        if len(self.now) + len(lost) > self.limit:
            self.old, self.now = self.now, {}
            lost = wanted
        back = lost.intersection(self.old)
        self.now.update(zip(back, map(self.old.__getitem__, back)))
        return lost.difference(back)


class BpeFile:
    """A ``tokenizers`` BPE file: ids of texts as packed little-endian 32-bit integers, and texts of ids."""

    def __init__(self, path: str, held: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("single_word", "lstrip", "rstrip", "normalized") if any(t[k] for t in added)]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"not a plain BPE file: {odd or model['type']}")
        vocab = self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        own = Tokenizer.from_file(path)
        self.normaliser, self.splitter, self.joiner = own.normalizer, own.pre_tokenizer, own.decoder
        self.rules: list[tuple[int, int, int]] = []
        self.follow: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 2)]  # the last one is _GONE's
        for rule in model["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            self.follow[vocab[a]][vocab[b]] = len(self.rules)
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
        self.added = {t["content"]: np.int32(t["id"]).tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.token = {no: t for t, no in vocab.items()} | {t["id"]: t["content"] for t in added}
        blanks = [c for c in map(chr, range(0x3001)) if _BLANKS.fullmatch(c)]
        apart = [self.pieces(f"{c}{c}") == [] and self.pieces(f"a{c}b") == ["a", "b"] for c in blanks]
        self.drops_blanks = all(apart)
        self.ascii_pattern = self._ascii_pattern(spec) if self.drops_blanks else None
        self.units_held, self.words_held = Held(held), Held(held)

    @staticmethod
    def _ascii_pattern(spec: dict) -> regex.Pattern | None:
        """The file's splitting pattern if its steps do no more to visible ASCII than lower-casing and keeping its matches."""
        steps = spec.get("normalizer") or {}
        steps = steps.get("normalizers", [steps] if steps else [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
            return None
        kinds = [s["type"] for s in steps if not (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ")]
        plain = splits[0]["behavior"] == "Removed" and splits[0]["invert"] and "Regex" in splits[0]["pattern"]
        return regex.compile(splits[0]["pattern"]["Regex"]) if plain and kinds in (["NFC", "Lowercase"], ["Lowercase"]) else None

    def pieces(self, text: str) -> list[str]:
        """The file's own normalising and splitting."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        if not text:
            return []
        return [p for p, _ in self.splitter.pre_tokenize_str(text)] if self.splitter is not None else [text]

    def units(self, text: str) -> list[str]:
        """What can be encoded alone: the runs between blanks if the file drops blanks, else the text."""
        if not self.drops_blanks:
            return [text] if text else []
        return [u for u in _BLANKS.split(text) if u] if _ODD_BLANK.search(text) else text.split()

    def _symbols(self, word: str) -> list[int]:
        found = [*map(self.vocab.get, word[:-1]), self.vocab.get(word[-1] + self.suffix)]
        return found if None not in found else [s for s in found if s is not None]

    def pieces_of_units(self, units: list[str]) -> list[list[str]]:
        """:meth:`pieces` of each unit; units between blanks go through the file's steps together."""
        if not self.drops_blanks or not units:
            return [self.pieces(u) for u in units]
        text = " ".join(units)
        text = self.normaliser.normalize_str(text) if self.normaliser is not None else text
        ends = np.cumsum([len(u) + 1 for u in text.split(" ")])
        found = self.splitter.pre_tokenize_str(text)
        cuts = np.searchsorted([a for _, (a, _) in found], ends).tolist()
        return [[p for p, _ in found[a:z]] for a, z in zip([0, *cuts], cuts)]

    def split(self, units: set[str]) -> Iterator[tuple[str, list[str]]]:
        """Each unit and its pieces; visible ASCII does not need the library."""
        rest = list(units)
        if self.ascii_pattern is not None:
            quick = [u for u in rest if u.isascii() and u.isprintable()]
            yield from zip(quick, map(self.ascii_pattern.findall, map(str.lower, quick)))
            rest = list(units.difference(quick))
        yield from zip(rest, self.pieces_of_units(rest))

    def learn(self, units: set[str]) -> None:
        """Puts the ids of all ``units`` into the store, by one pair index over their new words."""
        split = dict(self.split(units))
        new = list(self.words_held.missing({w for ws in split.values() for w in ws}))
        index = PairIndex([self._symbols(w) for w in new], self.follow, self.rules)
        index.merge_all()
        self.words_held.now.update(zip(new, index.words()))
        ids = self.words_held.now.__getitem__
        self.units_held.now.update((u, ids(ws[0]) if len(ws) == 1 else b"".join(map(ids, ws))) for u, ws in split.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text (null: none)."""
        rows: list[list] = []
        for t in texts:
            parts = self.special.split(t) if t and self.special and self.special.search(t) else [t or ""]
            rows.append([(p, None) if i % 2 else (None, self.units(p)) for i, p in enumerate(parts)])
        seen = set().union(*(units for row in rows for _, units in row if units))
        self.learn(self.units_held.missing(seen))
        held = self.units_held.now.__getitem__
        return [b"".join([self.added[s] if s is not None else b"".join(map(held, units)) for s, units in row]) for row in rows]

    def decode(self, packed: bytes | None) -> str:
        """The tokens of all ids, special ones too, joined as the file's decoder does (by blanks if it has none)."""
        tokens = [t for t in map(self.token.get, np.frombuffer(packed or b"", "<i4").tolist()) if t is not None]
        return " ".join(tokens) if self.joiner is None else self.joiner.decode(tokens)


@lru_cache(maxsize=2)
def bpe_file(path: str) -> BpeFile:
    """One for each worker process and file."""
    return BpeFile(path)


def _with(df: DataFrame, source: str, kind: str, made: list[tuple[str, str]], run) -> DataFrame:
    """``df`` and the columns ``made`` (name, type) that ``run`` computes of the batches of ``source``."""
    clash = [name for name, _ in made if name in df.columns]
    if clash:
        raise ValueError(f"columns already: {clash}; choose other names")
    small_batches(df.sparkSession, rows=1000, size="4194304")
    last = "_" + "_".join(df.columns)  # longer than any of their names
    types = {"binary": pa.binary(), "string": pa.string()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array(c, types[t]) for c, (_, t) in zip(run(b.column(b.num_columns - 1).to_pylist()), made)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], *[name for name, _ in made]])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{name}` {t}" for name, t in made])
    return df.select("*", F.col(source).cast(kind).alias(last)).mapInArrow(apply, fields)


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col``: the ids of the whole text as packed little-endian 32-bit integers.

    They are the ids of the ``tokenizers`` library with ``add_special_tokens=False``: the string of an
    added token in a text is that token. A null text has no ids; all rows and other columns stay;
    an ``out_col`` that ``df`` has already is an error. ``path`` must be readable on the executors.
    """
    return _with(df, text_col, "string", [(out_col, "binary")], lambda texts: [bpe_file(path).encode(texts)])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the text of packed ids, special tokens kept (null: empty); ids without a token are passed over."""
    return _with(df, ids_col, "binary", [(out_col, "string")], lambda ids: [[bpe_file(path).decode(i) for i in ids]])


def encode_and_decode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """:func:`encode`, and :func:`decode` of its ids, in one pass over the texts."""

    def run(texts):
        ids = bpe_file(path).encode(texts)
        return ids, [bpe_file(path).decode(i) for i in ids]

    return _with(df, text_col, "string", [(ids_col, "binary"), (out_col, "string")], run)
