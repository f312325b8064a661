"""The pipeline's stages against brute force on the smallest table."""

import corpus_pipeline as C
from shelfwise.llm import langid, simhash
from shelfwise.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    step1 = C.language_id(spark, docs, SF_SMALL)
    assert step1.columns == docs.columns
    assert {r.doc_id for r in step1.collect()} == {k for k, r in rows.items() if any(map(str.isalpha, r.text or ""))}
    step2 = C.near_dedup(spark, step1, SF_SMALL)
    assert step2.columns == docs.columns
    ids = sorted(rows)
    fp = {i: simhash.fingerprint(rows[i].text) for i in ids}
    group = {i: i for i in ids}
    for _ in ids:
        new = {i: min(group[j] for j in ids if (fp[i] ^ fp[j]).bit_count() <= 4) for i in ids}
        if new == group:
            break
        group = new
    assert sorted(r.doc_id for r in step2.collect()) == sorted(set(group.values()))
    step3 = C.secret_scans(spark, step2, SF_SMALL)
    assert step3.columns == docs.columns and step3.dtypes == docs.dtypes
    masked = 0
    for r in step3.collect():
        assert r.n_chars == len(r.text)
        masked += r.text != rows[r.doc_id].text
        assert "[secret]" in r.text or r.text == rows[r.doc_id].text
    final = C.run(spark, SF_SMALL).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in step3.collect()}
    got = {}
    for r in final:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_a_document_without_letters_goes(spark):
    rows = [(1, "the and of that this", "en", "s", 20), (2, "11 22 ..", "en", "s", 8), (3, None, "en", "s", 0), (4, "der die das", "de", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.language_id(spark, docs, "").collect()) == [1, 4]


def test_the_model_knows_the_languages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert langid.train(docs).languages == sorted({r.lang for r in docs.select("lang").distinct().collect()})


def test_an_empty_table(spark, tmpdir_fresh):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmpdir_fresh}/documents.parquet")
    assert C.run(spark, tmpdir_fresh).count() == 0


def test_repeated_rows_and_other_columns(spark, tmpdir_fresh):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect()]
    rows = [(*r, "kept", i, None) for i, r in enumerate([*rows, *rows[:20]])]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept_id_ string, ids int, spans string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmpdir_fresh}/documents.parquet")
    docs = spark.read.parquet(f"{tmpdir_fresh}/documents.parquet")
    for stage in (C.language_id, C.near_dedup, C.secret_scans):
        docs = stage(spark, docs, tmpdir_fresh)
        assert docs.columns == [k.split()[0] for k in kinds.split(", ")]
    left = [r.doc_id for r in docs.collect()]
    assert len(left) == len(set(left)) > 10  # copies of a row go with the near-duplicates
    got = C.run(spark, tmpdir_fresh)
    assert {r.doc_id for r in got.collect()} == set(left)
