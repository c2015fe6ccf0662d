import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from test_dedup import brute_components

from loomgrain.llm.simhash import covering_masks, drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates, several_fingerprints, spanning_links


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t", "one", "one two three", "One  two\x0bthree four", "a b c d e", "é É b c d", "x " * 70_000, "a\xa0b c d e f", "\u2028 a b c d e"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_several_fingerprints():
    text = b"a b c d e f g h " * 40
    own = several_fingerprints(text, 2, 42, 4)
    assert own[0] == fingerprint(text, 2, 42) and len(set(own)) == 4 and several_fingerprints(b"", 2, 42, 4) == [0] * 4
    assert all(16 < (a ^ b).bit_count() < 48 for a, b in itertools.combinations(own, 2))


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize(("n", "radius"), [(64, 4), (64, 2), (20, 4), (9, 3)])
def test_masks_cover(n, radius):
    masks = covering_masks(list(range(n)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    patterns = itertools.combinations(range(n), radius) if n < 30 else (rng.sample(range(n), radius) for _ in range(20_000))
    for p in patterns:
        diff = sum(1 << k for k in p)
        assert any(not m & diff for m in masks)
    assert all(m for m in masks)


def clustered(rng, clusters, size):
    fps = set()
    for _ in range(clusters):
        at = rng.getrandbits(64)
        for _ in range(size):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                at ^= 1 << b
    return sorted(fps)


def components_of(links, fps):
    found = brute_components(links)
    return {f: found.get(f, f) for f in fps}


def near_pairs(fps, radius):
    return [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= radius]


def same_partition(a, b):
    groups = lambda x: sorted(sorted(k for k in x if x[k] == g) for g in set(x.values()))
    return groups(a) == groups(b)


@pytest.mark.parametrize("bucket_rows", [32, 1024])
def test_links_equal_brute_force(spark, bucket_rows):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    dense = {base ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 6))) for _ in range(300)}  # buckets that must be split
    fps = sorted(set(clustered(rng, 12, 14)) | dense)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    got = fingerprint_links(spark.createDataFrame([(0, f) for f in signed], "space int, fp long"), 4, bucket_rows).collect()
    links = [(r.a % 2**64, r.b % 2**64) for r in got]
    assert same_partition(components_of(links, fps), components_of(near_pairs(fps, 4), fps))


def test_spanning_links():
    fps = np.array([0, 1, 3, 1 << 40, (1 << 40) | 1, -1], np.int64)
    assert sorted(spanning_links(fps, 1)) == [(1, 0), (3, 0), ((1 << 40) | 1, 1 << 40)] or len(spanning_links(fps, 1)) == 4


def test_labels_spare_links(spark):
    """What labels connect gets no link; together they connect the same as all near pairs."""
    rng = random.Random(9)
    fps = clustered(rng, 10, 20)
    label = {f: k // 3 for k, f in enumerate(fps)}
    signed = {f: f - 2**64 if f >> 63 else f for f in fps}
    labels = spark.createDataFrame([(0, signed[f], label[f]) for f in fps], "space int, fp long, label long")
    got = [(r.a % 2**64, r.b % 2**64) for r in fingerprint_links(labels.select("space", "fp"), 4, 1024, labels).collect()]
    assert all(label[a] != label[b] for a, b in got)
    same = [(a, b) for a, b in itertools.combinations(fps, 2) if label[a] == label[b]]
    assert same_partition(components_of(got + same, fps), components_of(near_pairs(fps, 4) + same, fps))


def test_table(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(30):
        text = rng.choices(words, k=200)
        rows.append((10 * k, " ".join(text)))
        text[5] = "edited"
        rows.append((10 * k + 1, " ".join(text).upper()))
    rows += [(999, None), (998, ""), (None, " "), (5, rows[0][1]), (5, rows[0][1]), (1000, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, "z", i) for i, t in rows], "doc_id long, text string, fingerprint string, component_id long")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {t: plain_fingerprint(t) for _, t in rows}
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{fp[t]:016x}") for i, t in rows)
    comp = components_of(near_pairs(sorted(set(fp.values())), 4), set(fp.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            least[comp[fp[t]]] = min(i, least.get(comp[fp[t]], i))
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == sorted((i or -1, least[comp[fp[t]]]) for i, t in rows)
    assert near_duplicates(df.limit(0)).count() == 0


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def texts_with_copies(rng, groups=40):
    """Texts and edited copies of them on both sides of the similarity of 0.8, null and repeated identifiers among them."""
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(groups):
        text = rng.choices(words, k=rng.choice([3, 8, 60, 200, 400]))
        rows.append((10 * k, " ".join(text)))
        for j in range(rng.randint(0, 5)):
            copy = list(text)
            for at in rng.sample(range(len(copy)), round(rng.choice([0, 0.005, 0.01, 0.02, 0.05]) * len(copy))):
                copy[at] = "edited"
            rows.append((10 * k + 1 + j, " ".join(copy).upper() + " "))
    return rows


def plain_stays(rows, radius=5, how_many=4):
    """Rows that stay, by loops: connected rows of a similarity of 0.8 are linked, and the first of each group stays."""
    fps = np.array([several_fingerprints((t or "").encode(), 2, 42, how_many) for _, t in rows], np.uint64)
    near = [(a, b) for a in range(len(rows)) for b in np.flatnonzero((np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= radius).any(axis=1)) + a + 1]
    found = brute_components(near)
    own = [shingles(t) for _, t in rows]
    by = {}
    for k, c in found.items():
        by.setdefault(c, []).append(k)
    linked = [(a, b) for x in by.values() for a, b in itertools.combinations(x, 2) if jaccard(own[a], own[b]) >= 0.8]
    groups = brute_components(linked)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).hexdigest(), k))
    first = {}
    for k in order:
        first.setdefault(groups.get(k, k), k)
    return sorted(first.values())


@pytest.mark.parametrize(("block_rows", "pivots"), [(3, 2), (512, 256)])
def test_drop_near_duplicates(spark, block_rows, pivots):
    rng = random.Random(5)
    rows = texts_with_copies(rng)
    rows += [(None, rows[0][1]), (None, "alone without a number"), (None, "alone without a number"), (1, "an unlike text of number one"), (None, None), (7000, ""), (7000, " "), (9, "x " * 30_000)]
    df = spark.createDataFrame([(i, t, "z", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row string, k int")
    left = drop_near_duplicates(df, block_rows=block_rows, pivots=pivots)
    assert left.columns == df.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    want = [rows[k] for k in plain_stays(rows)]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert (1, "an unlike text of number one") in kept and kept.count((None, "alone without a number")) == 1
    own = [shingles(t) for _, t in kept]
    whole = [shingles(t) for _, t in rows]
    linked = brute_components([(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(whole[a], whole[b]) >= 0.8])
    have = {linked.get(k, k) for k in range(len(rows)) if str(rows[k]) in set(map(str, kept))}
    assert have == {linked.get(k, k) for k in range(len(rows))}  # no text is lost
    alike = [(a, b) for a, b in itertools.combinations(range(len(kept)), 2) if jaccard(own[a], own[b]) >= 0.8]
    pairs = sum(jaccard(shingles(a[1]), shingles(b[1])) >= 0.8 for a, b in itertools.combinations(rows, 2))
    assert len(alike) <= 0.05 * pairs
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_hot_group_takes_several_rounds(spark):
    """One candidate group of many unlike texts, copies of each, and edits of one text that are linked through it alone."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(300)]
    texts = []
    for k in range(20):
        own = list(common)
        for at in rng.sample(range(300), 12):
            own[at] = f"own{k}"
        texts += [" ".join(own)] + [" ".join([*own, f"tail{j}"]) for j in range(6)]
    for k in range(80):
        own = list(common)
        for at in rng.sample(range(300), 5):
            own[at] = f"edit{k}"
        texts.append(" ".join(own))
    texts.append(" ".join(common))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = sorted(r.doc_id for r in drop_near_duplicates(df, block_rows=20, radius=8, pivots=10).collect())
    assert left == plain_stays(list(enumerate(texts)), radius=8) and 5 < len(left) <= 21


def test_clashing_column_names(spark):
    """Columns of any names, also those that the operator might use itself, with repeated rows and near copies."""
    names = ["_again", "_lead", "_key_of_text", "digest", "_hit", "key", "stays", "lead", "copies", "uid", "component", "id"]
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(1, body), (1, body), (2, body), (3, body + " more"), (4, "another text"), (None, "another text"), (5, None)]
    df = spark.createDataFrame([(*r, *[k] * len(names)) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted(["", "another text", body])
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5]


def test_components_double_no_links(spark, monkeypatch):
    """As the buckets of a group of near copies give them: each of many nodes is linked to each of some smaller ones."""
    from loomgrain.llm import components as own

    plans, true = [], own.materialise
    monkeypatch.setattr(own, "materialise", lambda df, name, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or true(df, name, *more))
    links = [(100 + n, c) for n in range(200) for c in range(20)] + [(5001, 5000), (5002, 5001), (5003, 5001), (100, 5004)]
    found = {r.node: r.component for r in own.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert plans and not any("Generate" in p for p in plans)
    assert found == {**dict.fromkeys([*range(20), *range(100, 300), 5004], 0), **dict.fromkeys(range(5000, 5004), 5000)}
