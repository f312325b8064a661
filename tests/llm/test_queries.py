"""The registered queries against brute-force versions over the whole small tables."""

import re
import zlib

import numpy as np
import xxhash

from shelfwise.llm import queries as Q
from tests.conftest import SF_SMALL


def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()


def classes(n, links):
    """The smallest position reachable from each."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_op1(spark):
    rows = sorted(docs(spark), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = classes(len(rows), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op1_simhash_near_dedup(spark, SF_SMALL).collect()}
    assert got == {r.doc_id: (f"{f:016x}", rows[root[i]].doc_id) for i, (r, f) in enumerate(zip(rows, fps))}


def test_op3(spark):
    rows = docs(spark)
    got = {r.doc_id: r for r in Q.op3_language_id(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    right = []
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1
        assert (g.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        if g.held_out and r.lang and g.lang_pred != "und":
            right.append(g.lang_pred == r.lang)
    assert sum(right) >= 0.95 * len(right) > 0


def test_op5(spark):
    import html

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in Q.op5_html_extraction(spark, SF_SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


def test_op8(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.tokenizer_path())
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs(spark)}
    pieces, sequences = {}, {}
    for r in Q.op8_packing(spark, SF_SMALL).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for of in pieces.values(), sequences.values():
        for spans in of:
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
    assert all(sum(n for _, n in pieces[d]) == len(ids[d]) for d in ids)
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in sizes)


def test_op9(spark):
    rows = sorted(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    v = [np.array(r.embedding, float) if r.embedding is not None else np.zeros(1) for r in rows]
    able = [np.isfinite(x).all() and (x != 0).any() for x in v]
    links = [(i, j) for i in range(len(v)) for j in range(i) if able[i] and able[j] and len(v[i]) == len(v[j])
             and v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= 0.95]
    count = np.bincount([i for link in links for i in link], minlength=len(v))
    root = classes(len(v), links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in Q.op9_embedding_near_dedup(spark, SF_SMALL).collect()}
    assert got == {r.vec_id: (count[i], rows[root[i]].vec_id, root[i] == i) for i, r in enumerate(rows)}
