"""Phrases by plain word lists, notices by edit distance at every word span."""

import random

import pytest

from shelfwise.llm import licenses as L
from tests.conftest import SF_SMALL


def plain_words(t):
    out, w = [], ""
    for c in t or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            w += c
        else:
            out, w = out + [w] * bool(w), ""
    return out + [w] * bool(w)


def plain_base(words):
    out = []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        out += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out, key=lambda b: (b[1], b[0]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def plain_has(words, notice):
    k, n = L.edits_allowed(notice), len(notice.split())
    return any(
        distance(" ".join(words[i:j]), notice) <= k
        for i in range(len(words))
        for j in range(max(i + 1, i + n - k), min(len(words), i + n + k) + 1)
    )


@pytest.fixture(scope="module")
def scan():
    return L.Scanner(L.PHRASES, L.NOTICES)


TEXTS = [
    None, "", "MIT License", "mit  LICENSE\tmit license.", "cc by cc by-nc CC-BY", "mit licensed mitlicense", "Apache\nLicense, Version 2.0",
    "Released undr the MTI Licence.", "GNU Genral Publik License v3", "x" * 50000 + " gnu general public license " * 2000, "é apache licénse apache license",
    "licensed under the apache licens", "redistribution and use in source and binry form", "a" + " mit" * 300 + " license",
]


def test_phrases_match_plain_words(scan):
    rng = random.Random(8)
    bits = ["mit", "license", "cc", "by", "gnu", "general", "public", "apache", "x9", "é"]
    texts = TEXTS + [rng.choice([" ", "-", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for t in texts:
        n, base, _ = scan(t)
        words = plain_words(t)
        assert n == len(words) and base == plain_base(words), t


def test_notices_match_edit_distance(scan):
    rng = random.Random(9)
    seen = 0
    for notice, label in L.NOTICES:
        k = L.edits_allowed(notice)
        for _ in range(12):
            s = list(notice)
            for _ in range(rng.randint(0, k + 2)):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice([[], [rng.choice("abcxyz")], [s[at], rng.choice("abc")]])
            words = ["one", "two", *plain_words("".join(s)), "three"]
            _, _, hits = scan(" ".join(words))
            got = {h[1] for h in hits}
            want = {x for x, _ in L.NOTICES if plain_has(words, x)}
            assert got == want, words
            seen += notice in want
    assert seen > len(L.NOTICES) * 5


def test_spans_point_into_the_text(scan):
    t = "é! Released  undr the MTI License, ok"
    (hit,) = [h for h in scan(t)[2] if h[0] == "mit"]
    assert t[hit[2] : hit[3]] == "Released  undr the MTI License" and hit[4] == 1 and hit[5] == 3


def test_query_against_plain_version(spark):
    from shelfwise.llm.queries import op4_license_scans

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in op4_license_scans(spark, SF_SMALL).collect():
        words = plain_words(texts[r.doc_id])
        base = plain_base(words)
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((base[0][1], max(w for _, w in base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({x for x, _ in base}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1 if base else r.score < 1 or r.n_notices


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "mit license", 0), (2, "mit license", 0), (2, "mit license", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    out = L.scan_licences(df).collect()
    assert sorted(r.licences.n_words for r in out) == [0, 0, 2, 2, 2] and out[0].n_words == 0
    assert L.scan_licences(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.scan_licences(df, out_col="n_words")


def test_damaged_notices_side_by_side_are_all_found(scan):
    good, bad = "gnu general public license", "gnu general publik license"
    for order in ([bad, good], [good, bad], [bad, good, bad], [good, good, bad, bad]):
        words = " ".join(["x", *order, "y"])
        spans, at = set(), 2
        for one in order:
            spans.add((at, at + len(one)))
            at += len(one) + 1
        hits = [h for h in scan(words)[2] if h[1] == good]
        assert {(h[2], h[3]) for h in hits} == spans
        assert all(h[5] == distance(words[h[2] : h[3]], good) for h in hits)


def test_many_damaged_notices_in_time(scan):
    import time

    one = "gnu general publik license"
    n = 4_000_000 // (len(one) + 1)
    t = time.time()
    hits = [h for h in scan(" ".join([one] * n))[2] if h[1] == "gnu general public license"]
    assert [(h[2], h[3], h[5]) for h in hits] == [(i * (len(one) + 1), i * (len(one) + 1) + len(one), 1) for i in range(n)]
    assert time.time() - t < 120
