"""Periodic runs of words by a dictionary of basic factors.

A run is a longest stretch whose words repeat with a smallest period ``q``, at least ``least``
words and ``powers`` periods long. For every length ``m = 1, 2, 4, ...`` the dictionary names the
factors of that length: equal stretches of one text have one name, made by doubling from the names
of the halves. Three successive occurrences of a name with one distance ``d <= 2 m`` are an
arithmetic progression and propose the period ``d``. The proposal is extended to either
side by comparing names, longest length first, and kept if it is long enough; runs that several
lengths or places propose count once.

Why none is missed: take a run of period ``q`` and the least ``m >= q``. The factor of length ``m`` at
its start recurs after ``q`` words and not sooner (two distances below ``m + 1`` would give a shorter
period), and again after ``2 q``, which ``2 q + m < 4 q`` words hold. Why none is false: an extended
proposal of four periods or more has no shorter one, or its name would have recurred sooner.

How it scales: one narrow pass. The texts of an Arrow batch share one array, so short texts cost no
numpy calls of their own; a factor that occurs once in its text is dropped from all greater
lengths, so plain text leaves the dictionary after a few of them. A text of ``n`` words needs
``O(n log n)`` time and memory, whatever its repetitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RESULT = "n_words long, runs array<struct<start long, length long, period long>>, collapsed string"


class Factors:
    """Names of the basic factors of several word sequences that lie side by side; -1: occurs once."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``codes``: equal words of one sequence have one code, other sequences have others; ``ends``: of the sequence of each place."""
        self.n, self.ends = len(codes), ends
        at, name = self._named(np.arange(self.n), codes)
        self.lengths: list[int] = []
        self.names: list[np.ndarray] = []
        self.places: list[tuple[np.ndarray, np.ndarray]] = []  # sorted by name, then place
        m = 1
        while len(at):
            full = np.full(self.n, -1, np.int32)
            full[at] = name
            self.lengths.append(m)
            self.names.append(full)
            self.places.append((at, name))
            left = np.sort(at)
            left = left[left + 2 * m <= ends[left]]
            right = full[left + m]
            left, right = left[right >= 0], right[right >= 0]
            at, name = self._named(left, full[left].astype(np.int64) * self.n + right)
            m *= 2

    @staticmethod
    def _named(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and new names of the keys that occur twice or more."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        alone = fresh & np.append(fresh[1:], True)
        name = np.cumsum(fresh) - 1
        return at[order[~alone]], name[~alone]

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """``(place, period)`` of the progressions of all lengths, one for those that stand side by side."""
        starts, periods = [], []
        for m, (at, name) in zip(self.lengths, self.places):
            step = at[1:] - at[:-1]
            same = (name[1:] == name[:-1]) & (step <= 2 * m)
            three = same[:-1] & same[1:] & (step[:-1] == step[1:])
            i, d = at[:-2][three], step[:-1][three]
            order = np.argsort(i)
            i, d = i[order], d[order]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])
            starts.append(i[first])
            periods.append(d[first])
        return np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(periods or [np.empty(0, np.int64)])

    def _reach(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``a`` and ``b`` on (or up to them, backward) are equal, for ``a < b`` of one sequence."""
        total = np.zeros(len(a), np.int64)
        for m, names in zip(reversed(self.lengths), reversed(self.names)):
            todo = np.arange(len(a))
            while len(todo):
                x = a[todo] + total[todo] if forward else a[todo] - total[todo] - m + 1
                y = x + (b[todo] - a[todo])
                inside = (x >= 0) & (y + m <= self.n)
                todo, x, y = todo[inside], x[inside], y[inside]
                # names differ between sequences, and a name of -1 occurs once
                equal = (names[x] >= 0) & (names[x] == names[y])
                todo = todo[equal]
                total[todo] += m
        return total

    def runs(self, least: int, powers: int) -> np.ndarray:
        """Rows ``(start, length, period)``, by start, then period."""
        i, d = self.proposals()
        start = i - self._reach(i - 1, i - 1 + d, forward=False) if len(i) else i
        length = i + d + self._reach(i, i + d, forward=True) - start
        long = length >= np.maximum(least, powers * d)
        found = np.stack([start[long], d[long], length[long]], axis=1)
        return np.unique(found, axis=0)[:, [0, 2, 1]].astype(np.int64)


def _codes(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and sequence ends of :class:`Factors`, and where each sequence starts."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    return code + doc * max(len(known), 1), np.repeat(starts + sizes, sizes), starts


def runs_of_words(words: list[list[str]], least: int = 6, powers: int = 4) -> list[np.ndarray]:
    """The runs of each word list, as rows ``(start, length, period)`` by start, then period."""
    if powers < 4:
        raise ValueError("powers must be 4 at least: shorter runs are not all proposed")
    codes, ends, starts = _codes(words)
    found = Factors(codes, ends).runs(least, powers)
    which = np.searchsorted(starts, found[:, 0], side="right") - 1
    # an empty list starts where its successor does: the last of them holds the words
    found[:, 0] -= starts[which] if len(found) else 0
    cuts = np.searchsorted(which, np.arange(len(words) + 1))
    return [found[a:z] for a, z in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by one blank."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def runs_of(text: Column, spark: SparkSession, least: int = 6, powers: int = 4) -> Column:
    """Struct ``(n_words, runs, collapsed)`` of a whole text (null: empty); words are parted by blanks, tabs and line ends."""
    small_batches(spark, rows=1000, size="4194304")

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            words = [_WORD.findall(t) if t else [] for t in texts]
            found = runs_of_words(words, least, powers)
            yield pd.DataFrame(
                {
                    "n_words": [len(w) for w in words],
                    "runs": [[dict(zip(("start", "length", "period"), r)) for r in rows.tolist()] for rows in found],
                    "collapsed": [collapsed(w, rows) for w, rows in zip(words, found)],
                }
            )

    return find(text.cast("string"))


def periodic_runs(df: DataFrame, text_col: str = "text", out_col: str = "periodic", least: int = 6, powers: int = 4) -> DataFrame:
    """``df`` with a struct column ``out_col`` of :func:`runs_of`; all rows and columns stay, an empty
    table gives none, an ``out_col`` that ``df`` has already is an error."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is a column already; choose another out_col")
    return df.withColumn(out_col, runs_of(F.col(text_col), df.sparkSession, least, powers))
