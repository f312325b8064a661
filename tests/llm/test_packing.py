"""Ids against the tokenizers library, BM25 against plain sums, pieces against the documents."""

import random
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest

from shelfwise.llm import packing as P
from shelfwise.llm.queries import tokenizer_path
from shelfwise.llm.tokens import Encoder
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(plain):
    rng = random.Random(5)
    bits = ["a", "The", "'s", "'ll", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "ß", "日本", "12", "3.5", "$$$", "<|endoftext|>", "x" * 60, "𝒳", "́"]
    texts = ["", " ", "a\t \nb", "a ", "\n a", "x <|endoftext|> y", "<|endoftext|><|endoftext|> ", "<|endoftext| >"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    e = Encoder(tokenizer_path(), cache_units=50)
    for t in texts + texts[:200]:
        assert e(t).tolist() == plain(t), repr(t)


def test_a_column_of_texts_is_encoded_unit_by_unit(plain, monkeypatch):
    import pyarrow as pa

    e = Encoder(tokenizer_path())
    texts = [None, "", " ", "a", "one two one two", "two one", "a <|endoftext|> b", "a  b", "x\r y\t z", "q\n r", "\r a \rb", "'s 's a'd", "日本 a", "a \x1c b", "one"]
    calls, own = [], e._plain
    monkeypatch.setattr(e, "_plain", lambda s: calls.append(s) or own(s))
    assert e.lists(pa.array(texts), 1).to_pylist() == [[*plain(t), 1] for t in texts]
    assert sum(c.split().count("two") for c in calls) <= 2  # as a first unit and as a later one
    assert e.lists(pa.array([], pa.string()), 1).to_pylist() == []


def test_units_of_a_column_stay_in_arrow(plain):
    import pyarrow as pa

    units = ["ab", "", "a\rb", "c\x1c", "é", "d\u3000", "x\n", "1.", "\r"]
    column = pa.array(["left out", *units, "left out"])[1:-1]
    ids, start, length = Encoder(tokenizer_path())._units(column)
    assert [ids[a : a + n].tolist() for a, n in zip(start, length)] == [plain(" " + u) for u in units]


def test_ids_are_stored_as_bytes_of_two_or_four():
    import pyarrow as pa

    for wide in (65535, 65536):
        rows = [[1, 2, wide], [], [7]]
        stored = P._as_bytes(pa.array(rows, pa.list_(pa.int32())))
        assert [len(v) for v in stored.to_pylist()] == ([6, 0, 2] if wide < 1 << 16 else [13, 1, 5])
        assert [ids.tolist() for ids in P._arrays(stored.slice(1))] == rows[1:]
        assert [ids.tolist() for ids in P._arrays(stored)] == rows


def test_bm25_scores():
    rng = random.Random(6)
    docs = [[rng.randint(0, 30) for _ in range(rng.randint(1, 40))] for _ in range(25)]
    index = P.Bm25([np.array(d, np.int32) for d in docs])
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))

    def impact(t, d):
        tf = docs[d].count(t)
        idf = log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(docs[d]) / avg))

    for q in range(n):
        terms = [t for t in set(docs[q]) if df[t] > 1]
        want = [sum(impact(t, d) for t in terms if t in docs[d]) for d in range(n)]
        assert np.allclose(index.scores(q, terms=10**6), want)
        ranked = list(P._ranked(index, q, np.arange(n) != q, head=4))
        full = sorted((d for d in range(n) if d != q), key=lambda d: (-index.scores(q)[d], d))
        assert ranked == full


def _checked(rows, texts, plain, window, end_id=1):
    """Every id of every document in one piece; sequences gapless and without padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for k, t in texts.items():
        ids = np.array([*plain(t), end_id], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place == window or (place < window and place & (place - 1) == 0)


def test_pieces_of_a_table(spark, plain):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    _checked(P.pack(docs, tokenizer_path()).collect(), texts, plain, 2048)
    small = P.pack(docs.repartition(3), tokenizer_path(), window=512, shard_docs=17, shard_tokens=20000)
    _checked(small.collect(), texts, plain, 512)


def test_odd_rows(spark, plain):
    long = "long words and more of them " * 20000
    rows = [(1, None, 9), (2, "", 9), (3, "ab cd", 9), (None, "null id", 9), (4, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(1)
    out = P.pack(df, tokenizer_path(), keep_ids=True).collect()
    _checked(out, {r[0]: r[1] for r in rows}, plain, 2048)
    assert all(list(r.ids) == [*plain(dict((x[0], x[1]) for x in rows)[r.doc_id]), 1][r.start : r.start + r.length] for r in out)
    twice = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    assert sum(r.length for r in P.pack(twice, tokenizer_path()).collect()) == 2 * (len(plain("same text")) + 1)
    assert P.pack(df.limit(0), tokenizer_path()).count() == 0


def test_neighbours_share_a_window():
    rng = random.Random(7)
    topics = [[rng.randint(100 * k, 100 * k + 90) for _ in range(60)] for k in range(4)]
    docs = [(np.array(rng.sample(topics[i % 4], 30), np.int32), 0) for i in range(64)]
    full, rest = P.pack_shard(docs, 240)
    same = sum(len({d % 4 for d, _, _ in s}) == 1 for s in full)
    assert same >= len(full) * 0.6


def test_neighbours_are_ranked_by_every_term_of_the_seed():
    rng = random.Random(8)
    docs = [np.array([rng.randint(0, 400) for _ in range(150)], np.int32) for _ in range(60)]
    index = P.Bm25(docs)
    assert all(np.allclose(index.scores(d), index.scores(d, terms=10**6)) for d in range(60))
    sets, df = [set(d.tolist()) for d in docs], Counter(t for d in docs for t in set(d.tolist()))
    for q in range(60):
        own = [t for t in sets[q] if df[t] > 1]
        assert len(own) > 16 and all((s > 0) == any(t in sets[d] for t in own) for d, s in enumerate(index.scores(q)))
        weight = {t: log(1 + (60 - df[t] + 0.5) / (df[t] + 0.5)) for t in own}
        tf = [Counter(d.tolist()) for d in docs]
        want = [sum(weight[t] * tf[d][t] * (P.K1 + 1) / (tf[d][t] + P.K1) for t in own if t in tf[d]) for d in range(60)]
        assert np.allclose(index.scores(q), want)  # equal lengths: the length norm is 1


def test_statistics_are_those_of_the_whole_table(spark):
    rng = random.Random(9)
    docs = [[rng.randint(0, 50) for _ in range(rng.randint(1, 30))] for _ in range(90)]
    table = spark.createDataFrame([(d,) for d in docs], "ids_ array<int>").repartition(7)
    stats = P.corpus_stats(table)
    df = Counter(t for d in docs for t in set(d))
    assert stats.n == 90 and np.isclose(stats.mean, sum(map(len, docs)) / 90)
    assert {t: n for t, n in enumerate(stats.df.tolist()) if n} == dict(df)
    part = P.Bm25([np.array(d, np.int32) for d in docs[:10]], stats)
    whole = P.Bm25([np.array(d, np.int32) for d in docs], stats)
    plain = P.Bm25([np.array(d, np.int32) for d in docs])
    assert np.allclose(whole.impact, plain.impact) and set(part.impact.round(9)) <= set(plain.impact.round(9))


def test_neighbours_far_apart_in_the_table_share_a_window(spark):
    rng = random.Random(10)
    words = [[f"{chr(97 + k)}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{i}" for i in range(40)] for k in range(8)]
    rows = [(i, " ".join(rng.sample(words[i % 8], 30))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = P.pack(df, tokenizer_path(), window=1024, shard_docs=100).collect()
    topics = {}
    for r in out:
        topics.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert sum(len(t) == 1 for t in topics.values()) > 0.7 * len(topics)
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
