"""Weights, draws and ranks against plain Python; the radix sort against sorting."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from shelfwise.llm import queries, resampling
from shelfwise.llm.radix_sort import ranked
from tests.conftest import SF_SMALL


def plain_features(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, buckets=10_000, least=20, percent=25, seed=7):
    def count(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in plain_features(t)[1])

    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        n, f = plain_features(text)
        weight = sum(gain[crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_the_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert rows_of(queries.op12_importance_resampling(spark, SF_SMALL)) == plain(docs, target)


DOCS = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 45))) for i in range(400)] + [
    (1000, None), (1001, ""), (None, "é Ünï " * 15), (-5, "A b " * 30), (2**62, "x y " * 12), (-(2**62), "x y " * 12), (7, "w1 w2 " * 12),
]


def test_odd_rows_small_blocks(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    out = resampling.resample(df, target, buckets=50, digit_bits=3, block_rows=11)
    assert rows_of(out) == plain(DOCS, ["w1 w2 w3", None], buckets=50)


def test_repeated_rows_and_other_columns(spark):
    docs = [(3, "a b c " * 10)] * 50 + [(4, "c d e " * 10)] * 30
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int")
    out = resampling.resample(df, spark.createDataFrame([("c d",)], "text string"), block_rows=7)
    got = rows_of(out)
    assert sorted((r[0], r[4] or 0) for r in got) == sorted((r[0], r[4] or 0) for r in plain(docs, ["c d"]))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21))


def test_empty_tables(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(df.limit(0), none).count() == 0
    assert rows_of(resampling.resample(df, none, buckets=50)) == plain(DOCS, [], buckets=50)


@pytest.mark.parametrize("digit_bits,block_rows", [(1, 13), (4, 1), (12, 1000)])
def test_radix_sort(spark, digit_bits, block_rows):
    r = random.Random(2)
    rows = [(r.choice([None, -3, 0, 5, 5, 5, 9]), r.randint(-40, 40), i) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, b long, i int").repartition(5)
    out = ranked(df, [("a", False), ("b", True)], "no", digit_bits, block_rows).collect()
    out.sort(key=lambda x: x["no"])
    assert [x["no"] for x in out] == list(range(1, 121))
    assert [(x.a, x.b) for x in out] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert {x.i for x in out} == set(range(120))


def test_radix_sort_of_wide_keys(spark):
    values = [None, -(2**63), 2**63 - 1, 0, -1, 1, 2**40, -(2**40), 0]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for ascending in (True, False):
        out = sorted(ranked(df, [("v", ascending)], "no").collect(), key=lambda r: r["no"])
        numbers = sorted((v for v in values if v is not None), reverse=not ascending)
        assert [r.v for r in out] == [*numbers, None]
    same = ranked(spark.createDataFrame([(1,)] * 9, "v int"), [("v", True)], "no")
    assert sorted(r["no"] for r in same.collect()) == list(range(1, 10))
    with pytest.raises(ValueError):
        ranked(df.withColumnRenamed("v", "at_"), [("at_", True)])
