"""Kernel against a plain set computation, held-out accuracy, odd texts."""

import base64
import random
import zlib

import numpy as np

from shelfwise.llm import langid as L
from tests.conftest import SF_CHECK


def _grams(text, n_max):
    t = "".join(" " if c < "a" or "z" < c < "\xaa" else c for c in text.lower())
    out = []
    for c in t:
        if not (c == " " and out and out[-1] == " "):
            out.append(c)
    t = "".join(out)
    return {t[i : i + n] for n in range(1, n_max + 1) for i in range(len(t) - n + 1)}


def test_distinct_codes_count_as_distinct_grams():
    rng = random.Random(0)
    for text in ["", "a", "Ab  1 c", "été äß ..!", "日本語 テキスト", "".join(rng.choice("abcdé 9.") for _ in range(3000))]:
        assert len(L.gram_codes(text)) == len(_grams(text, 4))


def test_chunks_lose_no_gram(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    whole = L.gram_codes(text)
    monkeypatch.setattr(L, "_CHUNK", 700)
    assert (L.gram_codes(text) == whole).all()


def test_scores_are_the_kernel_expansion():
    """Batch products give what the kernel k(x, l) = |shared| / sqrt(|x||l|) gives landmark by landmark."""
    rows = [("the cat and the dog " * 3, "en"), ("of and this that there", "en"), ("der hund und die katze", "de"), ("ein haus mit einem garten", "de")]
    m = L.fit(rows, landmarks=2)
    marks = [_grams(t, 4) for t, _ in sorted(rows, key=lambda r: r[1])]
    space = set().union(*marks)
    x = _grams("the katze in the haus", 4) & space
    k = np.array([len(x & g) / np.sqrt(len(x) * len(g)) for g in marks])
    got = m.scores(["the katze in the haus"])[0] - m.bias
    among = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    basis = np.stack([m.scores([t])[0] - m.bias for t, _ in sorted(rows, key=lambda r: r[1])])
    assert np.allclose(got, k @ np.linalg.solve(among, basis), atol=1e-4)


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    model = L.train(docs, per_class=150)
    got = L.predict(docs, "doc_id", "text", model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 100 and sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.keep_known(docs, "text", model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_odd_rows(spark):
    rows = [(1, "the thing and the other", "en", "x"), (2, "der die das und", "de", "x"), (3, None, "en", "x"), (4, "12 34 !!", None, "x"), (None, "the and", None, "x"), (4, "12 34 !!", None, "x"), (6, "", "de", "x"), (7, "wort und wort " * 30000, "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = L.train(df)
    got = L.predict(df, "doc_id", "text", model).collect()
    assert len(got) == len(rows)
    und = [r.doc_id for r in got if r.lang_pred == "und"]
    assert sorted(und) == [3, 4, 4, 6] and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert L.keep_known(df, "text", model).columns == df.columns
    empty = L.train(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, "doc_id", "text", empty).collect()} == {"und"}
    assert L.predict(df.limit(0), "doc_id", "text", model).count() == 0


def test_texts_of_no_learned_language_go_at_every_length(spark):
    rng = random.Random(4)
    b64 = base64.b64encode(bytes(rng.randrange(256) for _ in range(60000))).decode()
    alien = ["Это русский текст о погоде и книгах. ", "これは学習していない言語の文章です。", b64, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60000))]
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "lang")
    model = L.train(docs)
    assert len(model.languages) == 4
    rows = [(-1 - i, (a * 2000)[:n], None) for i, (a, n) in enumerate((a, n) for a in alien for n in (40, 400, 50000))]
    strange = spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id for r in L.keep_known(docs.unionByName(strange), "text", model).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_a_language_of_long_texts_alone_is_learned(spark):
    rng = random.Random(8)
    words = {"en": "the and of that with this from have".split(), "sv": "och att det som inte med för jag".split()}

    def text(lang, n):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    rows = [(i, text("en", 60), "en") for i in range(40)] + [(100 + i, text("sv", 400), "sv") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.draw_sample(df, "text", "lang", "doc_id", per_class=5, max_sample_chars=500)
    assert all(len(t) <= 500 for t, _ in sample) and 0 < sum(lang == "sv" for _, lang in sample) < 12
    model = L.train(df, max_sample_chars=500)
    assert model.languages == ["en", "sv"]
    assert all(r.lang_pred == r.lang for r in L.predict(df, "doc_id", "text", model).join(df, "doc_id").collect())
