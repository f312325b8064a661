"""The transducer against the sentencepiece library, brute-force shortest paths and round trips."""

import hashlib
import math
import random
import struct

import pytest

from shelfwise.llm import piece_fst as T
from shelfwise.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def machine():
    return T.transducer(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _texts(n, seed):
    rng = random.Random(seed)
    bits = ["a", "The", " ", "  ", "   ", "\n", "\t", "é", "ß", "日本", "12", "3.5", "▁", "𝒳", "\x00", "<s>", "<0x41>", "ing", "tion", "e", "x" * 20, " " * 37, "aaaa", "́", "ﬁ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(machine, library):
    for t in ["", " ", "<unk>", "x" * 3000, " " * 100, *_texts(2500, 1)]:
        ids = machine.encode(t).tolist()
        assert ids == library.encode(t), repr(t)
        assert machine.decode(ids) == library.decode(ids) == t.replace("▁", " ")


def test_decoding_any_ids(machine, library):
    rng = random.Random(2)
    for _ in range(300):
        ids = [3 + rng.randrange(300) if rng.random() < 0.2 else rng.randrange(259, 32000) for _ in range(rng.randint(0, 12))]
        text = machine.decode([1, *ids, 2])
        assert "�" in text or text == library.decode(ids)


def test_words_alone_equal_the_whole(machine):
    for t in _texts(200, 3):
        s = machine.normalise(t)
        assert s == "" or machine.encode(t).tolist() == machine._unit(s)


def _unigram_model(scores):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(no, data):
        return varint(no << 3 | 2) + varint(len(data)) + data

    body = field(1, field(1, b"<unk>") + varint(3 << 3) + varint(2))
    for p, s in scores.items():
        body += field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s))
    return body + field(2, varint(3 << 3) + varint(1)) + field(3, varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1))


def test_unigram_shortest_path_by_enumeration():
    rng = random.Random(4)
    letters = "ab▁"
    for _ in range(40):
        scores = {c: -rng.uniform(1, 6) for c in letters}
        scores |= {"".join(rng.choice(letters) for _ in range(rng.randint(2, 4))): -rng.uniform(1, 6) for _ in range(8)}
        m = T.PieceTransducer(_unigram_model(scores))

        def best(s):
            if not s:
                return 0.0
            return min((best(s[n:]) - m.score[s[:n]] for n in range(1, len(s) + 1) if s[:n] in m.score), default=math.inf)

        for _ in range(10):
            s = m.normalise("".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))))
            pieces = m.path(s)
            assert "".join(pieces) == s and math.isclose(-sum(m.score[p] for p in pieces), best(s), abs_tol=1e-5)
        assert m.encode("a?b") is not None and m.unknown in m.encode("a?b").tolist()


def test_query(spark, library):
    from shelfwise.llm.queries import op7_sentencepiece

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = op7_sentencepiece(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_sha256, r.round_trip) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "x y", 0), (3, "x y", 0), (3, "x y", 0), (4, "long word " * 40000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    out = T.decode(T.encode(df, MODEL), MODEL, out_col="back").collect()
    assert [r.back for r in out] == [r[1] or "" for r in rows]
    assert T.encode(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        T.decode(T.encode(df, MODEL), MODEL)
