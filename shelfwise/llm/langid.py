"""Language identification with string kernels.

Kernel: the blended spectrum of character n-grams (1 to ``n_max``), as presence: two texts
score the number of different n-grams they share, normalised by the geometric mean of
their own counts. N-grams that no landmark holds add nothing to a comparison with
landmarks, so the feature space is the landmarks' n-grams.

Nystroem: a bounded, hash-drawn sample of labelled rows is compared with landmarks; the
kernel matrix among landmarks is inverted through its eigenvectors, and one ridge
regression for each language (one against the rest, targets +1 and -1) is solved in that
basis. A batch of texts is scored as presence rows x (landmark rows x coefficients): the
kernel is linear in the presence vector, so the second product is formed once.

How it scales: training reads a sample whose bound is ``per_class`` rows of at most
``max_sample_chars`` characters for each language; the model (a sorted table of n-gram codes
and one weight column for each language) is bounded by it and sent to the tasks once.
Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches

UNDETERMINED = "und"
#: Least known share of a text in a learned language, calibrated on the labelled tables (README, figures).
MIN_KNOWN = 0.4
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier: keeps the codes of one length apart
_CHUNK = 1 << 18


def _chunk_rows(text: str, n_max: int) -> Iterator[list[np.ndarray]]:
    """64-bit codes of the n-grams of each length 1 to ``n_max`` of the lower-cased text, repeats included.

    A run of blanks, digits and signs counts as one blank. Long texts are taken in chunks that
    overlap by ``n_max - 1`` characters, so no n-gram is lost and memory stays bounded.
    """
    for at in range(0, max(len(text), 1), _CHUNK):
        part = text[at : at + _CHUNK + n_max - 1].lower()
        cp = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        other = (cp < 97) | ((cp > 122) & (cp < 170))  # ASCII and Latin-1 signs and digits
        cp = np.where(other, np.uint64(32), cp.astype(np.uint64))
        if len(cp) > 1:
            cp = cp[np.concatenate(([True], ~(other[1:] & other[:-1])))]
        codes, rows = cp + np.uint64(1), [cp + np.uint64(1)]
        for n in range(1, n_max):
            if len(cp) <= n:
                break
            codes = codes[:-1] * _MIX + rows[0][n:]
            rows.append(codes)
        yield rows


def _chunk_codes(text: str, n_max: int) -> Iterator[np.ndarray]:
    """The codes of each chunk, all lengths together."""
    yield from map(np.concatenate, _chunk_rows(text, n_max))


def gram_codes(text: str, n_max: int = 4) -> np.ndarray:
    """Sorted distinct n-gram codes of a text."""
    return np.unique(np.concatenate([np.unique(c) for c in _chunk_codes(text, n_max)]))


class _Lookup:
    """Positions of codes in a sorted table by a few direct-addressed levels (a code's slot
    collides in one level, then it goes to the next, smaller one)."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.levels = codes, []
        rest, mult = np.arange(len(codes)), 0xD6E8FEB86659FD93
        while len(rest):
            bits = max(4, int(len(rest) * 8).bit_length())
            slot = (codes[rest] * np.uint64(mult)) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            table = np.zeros(1 << bits, np.int32)
            table[slot[first]] = rest[first]
            self.levels.append((np.uint64(mult), np.uint64(64 - bits), table))
            rest, mult = np.delete(rest, first), (mult * 0xCA5A826395121157 + 2) % (1 << 64) | 1

    def __call__(self, g: np.ndarray) -> np.ndarray:
        hits = []
        for mult, shift, table in self.levels:
            at = table[(g * mult) >> shift]
            hits.append(at[self.codes[at] == g])
        return np.concatenate(hits)


@dataclass
class Model:
    """Sorted n-gram codes, a weight column for each language, and the languages."""

    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    languages: list[str]
    n_max: int

    def mark(self, text: str, row: np.ndarray) -> float:
        """Set ``row`` to the text's normalised presence vector; the share of the text's longest
        n-grams, repeats included, that a landmark holds: 0 if none, the same for all lengths of text."""
        if not hasattr(self, "_lookup"):
            self._lookup = _Lookup(self.codes)
        held, total = 0, 0
        for *short, longest in _chunk_rows(text, self.n_max):
            at = self._lookup(longest)
            # an empty slot points at code 0 too, so that one may be found in several levels
            held += np.count_nonzero(at) + np.count_nonzero(longest == self.codes[0])
            total += len(longest)
            row[at] = 1.0
            if short:
                row[self._lookup(np.concatenate(short))] = 1.0
        row /= np.sqrt(max(np.count_nonzero(row), 1))
        return held / max(total, 1)

    def scores(self, texts: list[str], block: int = 64) -> np.ndarray:
        """One row of regression outputs for each text, by blocks of presence rows."""
        return self.scores_and_known(texts, block)[0]

    def scores_and_known(self, texts: list[str], block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`scores`, and for each text the share that :meth:`mark` gives."""
        out, known = np.empty((len(texts), len(self.languages))), np.zeros(len(texts))
        for lo in range(0, len(texts), block):
            part = texts[lo : lo + block]
            rows = np.zeros((len(part), len(self.codes)), np.float32)
            for i, t in enumerate(part):
                known[lo + i] = self.mark(t, rows[i])
            out[lo : lo + block] = rows @ self.weights + self.bias
        return out, known


def fit(rows: list[tuple[str, str]], n_max: int = 4, landmarks: int = 64, ridge: float = 0.05) -> Model:
    """Fit on ``(text, language)`` rows; the first ``landmarks`` rows of each language are landmarks."""
    rows = sorted(set(rows), key=lambda r: r[1])  # copies add nothing; grouped by language
    languages = sorted({lang for _, lang in rows})
    grams = [gram_codes(t, n_max) for t, _ in rows]
    y = np.array([languages.index(lang) for _, lang in rows])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))]) if rows else np.empty(0, int)
    codes = np.unique(np.concatenate([grams[i] for i in chosen])) if len(chosen) else np.zeros(1, np.uint64)

    def presence(i: int) -> np.ndarray:
        at = np.searchsorted(codes, grams[i])
        at[at == len(codes)] = 0
        row = np.zeros(len(codes), np.float32)
        at = at[codes[at] == grams[i]]
        row[at] = 1.0 / np.sqrt(max(len(at), 1))
        return row

    if len(languages) == 0:
        return Model(codes, np.zeros((len(codes), 0), np.float32), np.zeros(0), [], n_max)
    marks = np.stack([presence(i) for i in chosen])
    among = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(among)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # K_mm^(-1/2)
    phi = np.concatenate([np.stack([presence(i) for i in range(lo, min(lo + 256, len(rows)))]) @ marks.T for lo in range(0, len(rows), 256)]) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]  # each language weighs the same
    mean_phi, mean_t = share @ phi / share.sum(), share @ target / share.sum()
    a = (phi - mean_phi) * np.sqrt(share)[:, None]
    b = (target - mean_t) * np.sqrt(share)[:, None]
    beta = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]) / len(languages), a.T @ b)
    weights = (marks.T @ (root @ beta).astype(np.float32)).astype(np.float32)
    return Model(codes, weights, mean_t - mean_phi @ beta, languages, n_max)


def draw_sample(
    df: DataFrame, text_col: str, lang_col: str, draw: str, per_class: int = 200, max_sample_chars: int = 20000
) -> list[tuple[str, str]]:
    """About ``per_class`` labelled rows of each language, drawn by the hash of column ``draw``.

    The rate of each language is ``per_class`` over its count, so the sample is bounded, the
    same on every run and not led by one source. Texts of 1 to ``max_sample_chars`` characters are
    drawn whole; a language with fewer than ``per_class`` of them is filled up with passages of that
    length, each at a place the hash chooses in a longer text, so no language is left out. The
    sample is the only thing collected.
    """
    most = int(max_sample_chars)
    rows = df.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.col(draw).cast("string").alias("k"))
    rows = rows.filter("l IS NOT NULL AND length(t) > 0").withColumn("long", F.length("t") > most)
    counts: dict[str, list[int]] = {}
    for r in rows.groupBy("l", "long").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.l, [0, 0])[r.long] = r.n
    if not counts:
        return []
    span = 1 << 31

    def limit(n: int, wanted: int) -> int:
        return min(span, -(-span * max(wanted, 0) // max(n, 1)))

    limits = F.create_map(
        *[F.lit(x) for lang, (n, n_long) in counts.items() for x in (lang, F.array(F.lit(limit(n, per_class)), F.lit(limit(n_long, per_class - n))))]
    )
    mine = limits[F.col("l")]
    drawn = rows.filter(F.pmod(F.xxhash64("k"), F.lit(span)) < F.when(F.col("long"), mine[1]).otherwise(mine[0]))
    place = F.pmod(F.xxhash64("k", F.lit("place")), F.greatest(F.length("t") - most + 1, F.lit(1))).cast("int") + 1
    drawn = drawn.select(F.when(F.col("long"), F.substring("t", place, F.lit(most))).otherwise(F.col("t")).alias("t"), "l")
    return sorted((r.t, r.l) for r in drawn.collect())


def language_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """Struct ``(lang_pred, score, known)`` of a whole text; only the text is sent to Python.

    ``und`` with score 0 where the text is null or holds no letter (or the model knows no
    language); else the language with the largest output (ties: the first by name) and a
    score of 0 to 1. The outputs of every text have the same sum, so the score ranks languages
    and is at least 1 over their number; how far a text resembles any of them is ``known``, the
    share of its longest n-grams that a landmark holds (0 for ``und``).
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m: Model = sent.value
        for texts in batches:
            texts = texts.tolist()
            lettered = [i for i, t in enumerate(texts) if t and m.languages and any(map(str.isalpha, t))]
            lang = np.full(len(texts), UNDETERMINED, object)
            score, known = np.zeros(len(texts)), np.zeros(len(texts))
            if lettered:
                out, known[lettered] = m.scores_and_known([texts[i] for i in lettered])
                best = out.argmax(axis=1)
                lang[lettered] = np.array(m.languages, object)[best]
                score[lettered] = np.clip((out[np.arange(len(lettered)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score, "known": known})

    return run(text.cast("string"))


def predict(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``(id_col, held_out, lang_pred, score)``, one row for each row; repeats stay, an empty table gives none."""
    found = df.select(F.col(id_col), held_out(id_col).alias("held_out"), language_of(F.col(text_col), model, df.sparkSession).alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score")


def keep_known(df: DataFrame, text_col: str, model: Model, min_score: float = 0.1, min_known: float = MIN_KNOWN) -> DataFrame:
    """``df`` without the rows whose text is ``und``, scores under ``min_score`` or has a known share
    under ``min_known``; columns stay.

    ``min_known`` is what rejects texts that resemble no learned language, short or long. With
    ``1 / min_score`` languages or fewer ``min_score`` rejects nothing (see :func:`language_of`).
    """
    found = df.select(F.struct(*df.columns).alias("row"), language_of(F.col(text_col), model, df.sparkSession).alias("found"))
    sure = (F.col("found.score") >= min_score) & (F.col("found.known") >= min_known)
    return found.filter((F.col("found.lang_pred") != UNDETERMINED) & sure).select("row.*")


def held_out(id_col: str):
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out; rows without id are not learned from."""
    rows = df.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    return fit(draw_sample(rows, text_col, lang_col, id_col, **bounds))
