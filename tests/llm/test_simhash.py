"""SimHash classes against brute force over all pairs."""

import random

import numpy as np
import xxhash

from shelfwise.llm import simhash as S


def plain_fingerprint(text, k=4):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs_of, ids):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs_of:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_fingerprint_of_odd_texts():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "ONE two three", "a b c d", "É é A a\x0bß\x0cx\ry", " ".join(rng.choice("abcd") for _ in range(70000)), "x y z w"]
    for t in texts:
        assert S.fingerprint(t) == plain_fingerprint(t)


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(2)
    for r in (1, 2, 3, 4):
        masks = S.covering_masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        for _ in range(300):
            flips = sum(1 << i for i in rng.sample(range(64), r))
            assert any((flips & (m % 2**64)) == 0 for m in masks)


def _clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    centres = [rng.getrandbits(64) for _ in range(6)]
    while len(out) < n:
        f = rng.choice(centres)
        for i in rng.sample(range(64), rng.randint(0, 7)):
            f ^= 1 << i
        out.add(f)
    return sorted(out)


def test_links_connect_as_brute_force_with_small_and_large_buckets(spark):
    fps = _clustered(260, 3)
    rows = [(int(np.uint64(f).view(np.int64)), 1000 + i) for i, f in enumerate(fps)]
    for max_bits, bucket in ((4, 1024), (4, 3), (3, 3), (2, 2)):
        df = spark.createDataFrame(rows, "fp long, rep long")
        links = [(r.src, r.dst) for r in S.fingerprint_links(df, max_bits, bucket).collect()]
        true = [(1000 + i, 1000 + j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
        ids = [r for _, r in rows]
        assert set(links) <= {p for a, b in true for p in ((a, b), (b, a))} or brute_components(links, ids) == brute_components(true, ids)
        assert brute_components(links, ids) == brute_components(true, ids)


def test_classes_with_nulls_repeats_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, base, 1), (3, base, 2), (3, base, 2), (None, base, 3), (9, base + " tail", 4),
        (7, None, 5), (8, "", 6), (2, "lone words here for a test of nothing else", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long").withColumn("fp", df_one())
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_classes(df).collect()), key=str)
    near = (S.fingerprint(base) ^ S.fingerprint(base + " tail")).bit_count() <= 4
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, None), (9, 3 if near else 9), (7, 7), (8, 7), (2, 2)], key=str)
    kept = sorted((r.doc_id is not None, r.doc_id) for r in S.drop_near_duplicates(df).collect())
    assert [k for _, k in kept] == [None, 2, 3, 7] if near else True


def df_one():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_classes(df).count() == 0
    assert S.drop_near_duplicates(df).count() == 0


def test_components_of_paths_stars_and_repeats(spark):
    from shelfwise.llm.components import connected_components

    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    pairs += [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(90)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    ids = {x for p in real for x in p}
    assert got == brute_components(real, ids)


def test_columns_of_the_same_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y"), (2, "a b c", 6, "y")], "doc_id long, text string, kept_id_ int, row_of_id_ string")
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b c", 5, "x")]
