"""Ids and decoded texts of the pair index against the library, over odd texts and the whole query."""

import hashlib
import json
import random

import numpy as np
import pytest

from shelfwise.llm import pair_bpe, queries
from tests.conftest import SF_SMALL

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(request.param)
    return pair_bpe.BpeFile(path), Tokenizer.from_file(path)


def check(both, texts):
    own, library = both
    for text, packed in zip(texts, own.encode(texts)):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(packed, "<i4").tolist() == expected, text[:60]
        assert own.decode(packed) == library.decode(expected, skip_special_tokens=False)


ODD = [
    "", "hello world", "x <|endoftext|> y<|startoftext|>z", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "é é áb", "a\x1cb \x1f c", "a\x85\x1cb", "it's don't I'LL",
    "123 4５６", "aaaa" * 50, "日本語 テキスト", " x y", "<|endoftext|", "<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "😀😀 e‍b", "ﬁ ǅ ß ẞ",
    "ab" * 5000, "a ́b", "한 각", " ", "\n\n", "x" * 3000 + "y " * 3000, "\x00\x07 \x7f",
]


def test_odd_texts(both):
    check(both, ODD)


def test_random_texts(both):
    r = random.Random(1)
    alphabet = "abcdeé ÉΣİ'sltr<|>end oftext\x1c\x85́ͅµK1２ \t\nßñ日本"
    check(both, ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)])


def test_a_small_store_changes_nothing(both):
    own, library = both
    small = pair_bpe.BpeFile(queries.tokenizer_path(FILES[0] if own.drops_blanks else FILES[1]), held=3)
    texts = ["one two three four", "two one five", "six one two three four", "one"]
    for _ in range(2):
        for t, p in zip(texts, small.encode(texts)):
            assert np.frombuffer(p, "<i4").tolist() == library.encode(t, add_special_tokens=False).ids


def plain_bpe(symbols, rules):
    """The rule of the least rank, leftmost first, again and again."""
    out = list(symbols)
    while True:
        best = min(((rules[p], i) for i, p in enumerate(zip(out, out[1:])) if p in rules), default=None)
        if best is None:
            return out
        i = best[1]
        out[i : i + 2] = [out[i] + out[i + 1]]


def test_rules_that_wake_lower_ranks(tmp_path):
    """A file whose merged symbols stand in rules of lower rank than the one that made them."""
    chars = list("abcd")
    for seed in range(30):
        r = random.Random(seed)
        made, rules = list(chars), []
        for _ in range(14):
            pair = r.choice(made), r.choice(made)
            if pair not in rules and len("".join(pair)) < 9:
                rules.append(pair)
                made.append("".join(pair)) if "".join(pair) not in made else None
        r.shuffle(rules)
        spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "decoder": None,
                "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(made)}, "merges": [list(p) for p in rules]}}
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(spec))
        own = pair_bpe.BpeFile(str(path))
        words = ["".join(r.choice(chars) for _ in range(r.randint(1, 30))) for _ in range(60)]
        rank = {p: i for i, p in enumerate(rules)}
        expected = [t for w in words for t in plain_bpe(w, rank)]
        ids = np.frombuffer(own.encode([" ".join(words)])[0], "<i4")
        assert [own.token[i] for i in ids.tolist()] == expected


def test_a_long_word_in_time(both):
    r = random.Random(3)
    check(both, ["".join(r.choice("aeinrst") for _ in range(200_000))])


def test_odd_files_are_refused(tmp_path):
    spec = json.load(open(queries.tokenizer_path(FILES[0]), encoding="utf-8"))
    spec["model"]["dropout"] = 0.1
    (tmp_path / "f.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        pair_bpe.BpeFile(str(tmp_path / "f.json"))


def test_tables(spark):
    path = queries.tokenizer_path(FILES[0])
    rows = [(1, None, "a"), (1, "Hello hello", None), (1, "Hello hello", None), (None, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source_ string")
    out = pair_bpe.decode(pair_bpe.encode(df, path), path).collect()
    assert sorted((r.doc_id or 0, len(r.ids) // 4, r.decoded) for r in out) == [(0, 0, ""), (1, 0, ""), (1, 2, "hello</w> hello</w>"), (1, 2, "hello</w> hello</w>")]
    assert pair_bpe.encode_and_decode(df.limit(0), path).columns == ["doc_id", "text", "source_", "ids", "decoded"]
    assert pair_bpe.encode_and_decode(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        pair_bpe.encode(df.withColumnRenamed("source_", "ids"), path)


def test_the_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path(FILES[0]))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_bpe(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
