"""Licence scan: exact phrases, and short notices within a bounded number of edits.

A notice of ``n`` characters may differ by ``k = n // 10`` edits (at most 3). It is cut into
``k + 1`` pieces: by the pigeonhole principle a text within ``k`` edits holds one piece
unchanged, so one pass with an Aho-Corasick automaton over all pieces finds every place worth a
look. There, and only there, the ``regex`` library's bounded-error matching verifies the notice and
reports its span and edits; of matches of one notice that overlap, the one with fewer edits counts.

How it scales: one narrow pass over whole texts, linear in their length; no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Short notices that are searched with edits, and the labels that they add.
NOTICES = [
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license version 2 0", "apache"),
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
RESULT = (
    "n_words long, base array<struct<label string, word long>>, "
    "notices array<struct<label string, notice string, start int, end int, word long, edits int>>"
)


def edits_allowed(notice: str) -> int:
    return min(3, len(notice) // 10)


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into ``k + 1`` pieces of nearly equal length, with their places."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Phrases and notices compiled once for each worker."""

    def __init__(self, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]):
        import ahocorasick

        self.phrases = [(f" {p} ", label) for p, label in phrases]
        self.notices, where = [], {}
        for no, (notice, label) in enumerate(notices):
            k = edits_allowed(notice)
            body = regex.escape(notice, special_only=True)
            # whole words only; best match: the fewest edits in the window
            self.notices.append((notice, label, k, regex.compile(rf"(?b)(?<= )(?:{body}){{e<={k}}}(?= )")))
            for at, piece in seeds(notice, k):
                where.setdefault(piece, []).append((no, at))
        self.seeds = ahocorasick.Automaton() if where else None
        for piece, owners in where.items():
            self.seeds.add_word(piece, (len(piece), owners))
        if where:
            self.seeds.make_automaton()

    def windows(self, words: str) -> dict[int, set[tuple[int, int]]]:
        """For each notice the stretches around its seeds that a match can fill, each little longer than the notice."""
        out: dict[int, set[tuple[int, int]]] = {}
        for last, (n, owners) in self.seeds.iter(words) if self.seeds else ():
            for no, at in owners:
                notice, _, k, _ = self.notices[no]
                begin = last - n + 1 - at
                out.setdefault(no, set()).add((max(0, begin - k - 1), min(len(words), begin + len(notice) + k + 1)))
        return out

    @staticmethod
    def matches(pattern, words: str, stretches: set[tuple[int, int]]) -> list:
        """Matches that do not overlap, those of the fewest edits first, then the first in the text.

        Every stretch is searched by itself; one whose match meets a better one is searched again in what
        that leaves of it. A stretch is short and loses a part each time, so the work grows with
        the number of seeds.
        """
        waiting: list[tuple] = []

        def look(lo: int, hi: int) -> None:
            m = pattern.search(words, lo, hi) if lo < hi else None
            if m and m.end() > m.start():
                heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi, len(waiting), m))

        for lo, hi in sorted(stretches):
            look(lo, hi)
        starts: list[int] = []
        taken: list = []  # by start
        while waiting:
            _, start, end, lo, hi, _, m = heappop(waiting)
            at = bisect_right(starts, start)
            # the neighbours in the text: the blank on either side bounds both words
            before, after = taken[at - 1] if at else None, taken[at] if at < len(taken) else None
            if before and (before.start(), before.end()) == (start, end):
                continue
            if before and before.end() > start:
                look(max(lo, before.end()), hi)
                look(lo, min(hi, before.start()))
            elif after and after.start() < end:
                look(lo, min(hi, after.start()))
                look(max(lo, after.end()), hi)
            else:
                starts.insert(at, start)
                taken.insert(at, m)
        return taken

    def __call__(self, text: str | None):
        """``(n_words, [(label, word)], [(label, notice, start, end, word, edits)])`` of a whole text."""
        folded = (text or "").translate(_FOLD)
        found = _WORD.findall(folded)
        words = f" {' '.join(found)} "
        base = []
        for phrase, label in self.phrases:
            at = words.find(phrase)
            before, counted = 0, 0
            while at >= 0:
                counted += words.count(" ", before, at)  # blanks before the phrase: its first word's number
                before = at
                base.append((label, counted))
                at = words.find(phrase, at + 1)
        hits = []
        spans = None
        for no, stretches in self.windows(words).items():
            notice, label, k, pattern = self.notices[no]
            place, counted = 0, 0
            for m in self.matches(pattern, words, stretches):
                if spans is None:  # places in the text, needed only where a notice is found
                    spans = [w.span() for w in _WORD.finditer(folded)]
                counted += words.count(" ", place, m.start())
                place, first = m.start(), counted - 1
                last = first + words.count(" ", m.start(), m.end())
                hits.append((label, notice, spans[first][0], spans[last][1], first, sum(m.fuzzy_counts)))
        return len(found), sorted(base, key=lambda b: (b[1], b[0])), sorted(set(hits), key=lambda h: (h[2], h[3], h[1]))


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(list(phrases), list(notices))


def licences_of(text: Column, spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> Column:
    """Struct ``(n_words, base, notices)`` of a whole text (null: empty).

    ``base``: label and first word's number of every place of a phrase. ``notices``: label,
    notice, span in the text (code points, end exclusive), first word and edits of every notice found.
    """
    small_batches(spark)
    key = tuple(map(tuple, phrases)), tuple(map(tuple, notices))

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scan = _scanner(*key)
        for texts in batches:
            rows = [scan(t) for t in texts]
            yield pd.DataFrame(
                {
                    "n_words": [n for n, _, _ in rows],
                    "base": [[{"label": a, "word": w} for a, w in b] for _, b, _ in rows],
                    "notices": [[dict(zip(("label", "notice", "start", "end", "word", "edits"), h)) for h in hs] for _, _, hs in rows],
                }
            )

    return run(text.cast("string"))


def scan_licences(df: DataFrame, text_col: str = "text", out_col: str = "licences", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``df`` with a struct column ``out_col``; all rows and columns stay, an empty table gives none,
    an ``out_col`` that ``df`` has already is an error."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is a column already; choose another out_col")
    return df.withColumn(out_col, licences_of(F.col(text_col), df.sparkSession, phrases, notices))


def score(found: Column) -> Column:
    """1 with a phrase; else the best notice's share of unchanged characters; else 0."""
    best = F.array_max(F.transform(found["notices"], lambda n: 1.0 - n["edits"] / F.length(n["notice"])))
    return F.when(F.size(found["base"]) > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))
