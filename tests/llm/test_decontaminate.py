import random

import pytest

from loomgrain.llm.decontaminate import Matcher, best_passage, budget_of, drop_leaks, find_leaks, pieces, words_of


def table_distance(item, text):
    """Smallest edit distance of the item to a passage, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(40))
def test_bit_parallel_equals_table(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
    item = rng.choices(letters, k=rng.choice([1, 2, 7, 63, 64, 65, 130]))
    text = rng.choices(letters, k=rng.randint(0, 200))
    distance, end = best_passage(item, text)
    assert distance == min(len(item), table_distance(item, text))
    assert end == 0 or table_distance(item, text[:end]) == distance


def test_pieces():
    words = [b"%d" % k for k in range(17)]
    for k in range(8):
        parts = pieces(words, k)
        assert len(parts) == k + 1 and sum((p for _, p in parts), []) == words and all(words[a : a + len(p)] == p for a, p in parts)
    assert [budget_of(m, 0.8) for m in (5, 9, 10, 15)] == [1, 1, 2, 3]
    assert words_of("Ab-c, É d!".encode()) == [b"ab", b"c", "É".encode(), b"d"]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = b"changed%d" % rng.randrange(99)
        elif kind < 0.7:
            del out[k]
        else:
            out.insert(k, b"added%d" % rng.randrange(99))
    return out


def test_matches_equal_brute_force():
    rng = random.Random(11)
    vocabulary = [b"w%d" % k for k in range(60)]
    items = [(k, b" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, *range(5, 41)])))) for k in range(40)]
    matcher = Matcher(items, 0.8)
    hits = 0
    for _ in range(150):
        text = rng.choices(vocabulary, k=rng.randint(0, 120))
        for _, body in rng.sample(items, 2):
            words = body.split()
            at = rng.randint(0, len(text))
            text[at:at] = edited(rng, words, rng.randint(0, 2 * budget_of(len(words), 0.8)))
        got = {i: (d, a, b) for i, d, _, a, b in matcher.matches(b" ".join(text))}
        want = {i: d for i, body in items if (d := table_distance(body.split(), text)) <= budget_of(len(body.split()), 0.8)}
        assert {i: d for i, (d, _, _) in got.items()} == want
        for i, (d, a, b) in got.items():
            assert table_distance(dict(items)[i].split(), text[a:b]) == d
        hits += len(want)
    assert hits > 150


def test_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = [(1, item), (2, item.upper() + "!"), (3, None), (4, "..."), (5, "too short"), (None, "one two three four five six")]
    docs = [(10, f"before {item} after"), (11, item.replace("zeta", "other") + " rest"), (12, "clean text of its own that has nothing"), (13, None), (14, ""), (15, "Too, short"), (16, "this is too short"), (None, item), (17, "one two three four five six"), (17, "x " * 50_000 + item), (18, "alpha beta gamma delta")]
    d = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, item_id string, distance int")
    b = spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, doc_id string")
    want = {(10, 1, 0), (10, 2, 0), (11, 1, 1), (11, 2, 1), (15, 5, 0), (None, 1, 0), (None, 2, 0), (17, None, 0), (17, 1, 0), (17, 2, 0), (16, 5, 0)}
    for block in (60, 4 << 20):
        assert {(r.doc_id, r.item_id, r.distance) for r in find_leaks(d, b, block_bytes=block).collect()} == want
    assert sorted(r.doc_id for r in drop_leaks(d, b).collect()) == [12, 13, 14, 18]
    assert find_leaks(d.limit(0), b).count() == 0 and find_leaks(d, b.limit(0)).count() == 0


HAN = "\u6625\u7720\u4e0d\u89c9\u6653\u5904\u5904\u95fb\u557c\u9e1f\u591c\u6765\u98ce\u96e8\u58f0\u82b1\u843d\u77e5\u591a\u5c11"


def test_unspaced_scripts():
    assert words_of("ab\u6625c \u7720\u3002D".encode()) == [b"ab", "\u6625".encode(), b"c", "\u7720".encode(), b"d"]
    assert words_of("\ud55c\uad6d \u00e9\u20ac".encode()) == ["\ud55c\uad6d".encode(), "\u00e9\u20ac".encode()]  # scripts with spaces stay words
    rng = random.Random(3)
    items = [(0, HAN), (1, HAN[:3]), (2, "\u0e01\u0e02\u0e03\u0e04\u0e05\u0e06")]
    matcher = Matcher([(i, t.encode()) for i, t in items], 0.8)
    hits = 0
    for _ in range(60):
        text = [chr(0x4E00 + rng.randrange(500)) for _ in range(rng.randint(0, 60))]
        for _, body in items:
            words = [w.decode() for w in edited(rng, [c.encode() for c in body], rng.randint(0, min(6, len(body) - 1)))]
            at = rng.randint(0, len(text))
            text[at:at] = words
        flat = "".join(text).encode()
        got = {i: d for i, d, *_ in matcher.matches(flat)}
        want = {i: d for i, t in items if (d := table_distance([c.encode() for c in t], words_of(flat))) <= len(t) // 5}
        assert got == want
        hits += len(want)
    assert hits > 60


def test_short_items_are_passages(spark):
    docs = spark.createDataFrame([(1, "well the lazy dog runs home"), (None, f"xx{HAN}yy"), (None, "clean"), (3, "the lazy dogs run")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the lazy dog runs"), (2, HAN), (3, HAN), (3, HAN), (None, "Dog!")], "item_id long, text string")
    got = sorted(str((r.doc_id, r.item_id)) for r in find_leaks(docs, bench, block_bytes=20).collect())
    assert got == sorted(map(str, [(1, 1), (1, None), (None, 2), (None, 3), (None, 3)]))
    assert sorted(str(r.doc_id) for r in drop_leaks(docs, bench).collect()) == ["3", "None"]
