"""Runs against every period at every place, and the whole query with its planted texts."""

import hashlib
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest

from shelfwise.llm import periodic_runs as R
from shelfwise.llm import queries
from tests.conftest import SF_SMALL


def plain_runs(w, least=6, powers=4):
    out, n = [], len(w)
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, powers * q):
                # a shorter period would make this a run of that period
                if not any(all(w[t] == w[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n=150):
    r = random.Random(seed)
    for _ in range(n):
        out = []
        for _ in range(r.randint(0, 5)):
            block = [r.choice("abc") for _ in range(r.randint(1, 7))]
            out += block * r.randint(1, 7) + block[: r.randint(0, len(block))]
            out += [r.choice("abcde") for _ in range(r.randint(0, 6))]
        yield out


@pytest.mark.parametrize("seed", range(6))
def test_against_every_period(seed):
    words = list(texts(seed))
    for w, rows in zip(words, R.runs_of_words(words)):
        expected = plain_runs(w)
        assert [tuple(r) for r in rows.tolist()] == expected, w
        assert R.collapsed(w, rows) == plain_collapsed(w, expected)


def test_other_bounds():
    words = list(texts(9))
    for w, rows in zip(words, R.runs_of_words(words, least=12, powers=5)):
        assert [tuple(r) for r in rows.tolist()] == plain_runs(w, 12, 5)
    with pytest.raises(ValueError):
        R.runs_of_words(words, powers=3)


def test_edges():
    assert [r.tolist() for r in R.runs_of_words([])] == []
    assert [r.tolist() for r in R.runs_of_words([[], ["a"] * 6, [], ["a"] * 5, []])] == [[], [[0, 6, 1]], [], [], []]
    # equal ends of two texts do not make a run
    assert [r.tolist() for r in R.runs_of_words([["a"] * 5, ["a"] * 5])] == [[], []]


def test_long_texts_in_time():
    r = random.Random(5)
    plain = [str(r.randint(0, 50_000)) for _ in range(300_000)]
    block = [str(r.randint(0, 9)) for _ in range(70_001)]
    fib = ["a", "b"], ["a"]
    while len(fib[0]) < 200_000:
        fib = fib[0] + fib[1], fib[0]
    t = time.time()
    one, two, three, four = R.runs_of_words([plain, ["x"] * 300_000, block * 4 + block[:7], fib[0]])
    assert len(one) == 0 and two.tolist() == [[0, 300_000, 1]]
    assert [0, 4 * 70_001 + 7, 70_001] in three.tolist()
    assert len(four) == 0  # no fourth power in a Fibonacci word
    assert time.time() - t < 30


def test_tables(spark):
    rows = [(1, None, 2), (1, "a a a a a a a", 2), (1, "a a a a a a a", 2), (None, "  ", 3), (4, "b c " * 6, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, periodic_ int")
    out = R.periodic_runs(df).collect()
    got = sorted((r.doc_id or 0, r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed) for r in out)
    assert got == [(0, 0, [], ""), (1, 0, [], ""), (1, 7, [(0, 7, 1)], "a"), (1, 7, [(0, 7, 1)], "a"), (4, 6, [(0, 6, 1)], "b c")]
    assert R.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(df.withColumnRenamed("periodic_", "periodic"))


def test_the_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        if n > 4000:
            continue  # the plain version is quadratic
        codes = np.unique(w, return_inverse=True)[1] if n else np.empty(0, int)
        found = []
        for q in range(1, n // 4 + 1):
            e = np.concatenate(([0], codes[:-q] == codes[q:], [0])).astype(np.int8)
            for s, t in zip(np.flatnonzero(np.diff(e) == 1), np.flatnonzero(np.diff(e) == -1)):
                if t - s + q >= max(6, 4 * q) and not any((codes[s : t + q - x] == codes[s + x : t + q]).all() for x in range(1, q) if q % x == 0):
                    found.append((int(s), int(t - s + q), q))
        found.sort(key=lambda x: (x[0], x[2]))
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, found).encode()).hexdigest()
    assert planted
