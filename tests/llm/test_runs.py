"""Runs of words against a search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loomgrain.llm.queries import QUERIES
from loomgrain.llm.runs import WaveletTree, block_ranks, find_runs, runs_of, strongest

SF = "/root/testdata/sf0.001"


def brute_runs(s, shortest=24):
    s, found = np.asarray(s, np.int64), {}
    for q in range(1, len(s) // 3 + 1):
        same = np.concatenate([[False], s[:-q] == s[q:], [False]])
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(shortest, 3 * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def made(rnd):
    n, letters = rnd.choice([0, 5, 30, 60, 120, 300]), rnd.choice([1, 2, 2, 3, 5, 50])
    s = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randrange(3)):
        if n > 10:
            a, p = rnd.randrange(n), 1 + rnd.randrange(n // 3 + 1)
            for i in range(a, rnd.randrange(a, n)):
                s[i] = s[a + (i - a) % p]
            if rnd.random() < 0.3:
                s[rnd.randrange(n)] = 99
    if rnd.random() < 0.2 and n:
        s = (([0] * rnd.randrange(1, 9) + [1]) * n)[:n]
    return s


@pytest.mark.parametrize("seed", range(8))
def test_all_runs_are_found(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        s, shortest = made(rnd), rnd.choice([24, 24, 1, 3, 7, 12])
        assert [tuple(map(int, r)) for r in runs_of(np.array(s, np.int64), shortest)] == brute_runs(s, shortest), (s, shortest)


def test_long_periodic_words_take_little_time():
    assert runs_of(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    assert [tuple(map(int, r)) for r in runs_of(np.array(fib[-1]), 24)] == brute_runs(fib[-1])


def test_ranks_and_range_successors():
    rnd = np.random.default_rng(5)
    s = rnd.integers(0, 2, 70)
    levels, sa = block_ranks(s)
    assert sa.tolist() == sorted(range(70), key=lambda i: s[i:].tolist())
    for k, rank in enumerate(levels):
        blocks = [s[i : i + (1 << k)].tolist() for i in range(70)]
        assert all((blocks[i] == blocks[j]) == (rank[i] == rank[j]) for i in range(70) for j in range(70))
    tree = WaveletTree(sa)
    for _ in range(200):
        lo, hi = sorted(rnd.integers(0, 71, 2).tolist())
        x = int(rnd.integers(0, 200))
        own = sorted(sa[lo:hi].tolist())
        below = int(tree.below(np.array([lo]), np.array([hi]), np.array([x]))[0])
        assert below == sum(v < x for v in own)
        if below < len(own):
            assert int(tree.nth(np.array([lo]), np.array([hi]), np.array([below]))[0]) == own[below]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {}
    runs = brute_runs([number.setdefault(w, len(number)) for w in words])
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or [None] * 3), best and 1000 * best[1] // best[2], sha(lines), sha(left))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op11_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(expected(d, t) for d, t in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    """Nulls, empties, repeated rows, other columns, a long text; an empty table."""
    phrase = "a b c d e f "
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, phrase * 4, None), (3, " \t" + phrase * 30_000 + "end", "z"), (4, "w " * 23, "z"), (5, "w\x0b" * 24, "z")]
    df = spark.createDataFrame(rows, "id long, body string, `odd name` string")
    got = find_runs(df, "body").collect()
    assert [(r["id"], r["_words"], [tuple(x) for x in r["_runs"]]) for r in got] == [
        (1, 0, []), (2, 0, []), (2, 0, []), (None, 24, [(0, 24, 6)]), (3, 180_001, [(0, 180_000, 6)]), (4, 23, []), (5, 24, [(0, 24, 1)]),
    ]
    assert [r["_collapsed"] for r in got] == ["", "", "", "a b c d e f", "a b c d e f end", " ".join("w" * 23), "w"]
    assert "odd name" in got[0].asDict()
    assert find_runs(df.limit(0), "body").collect() == []


def test_strongest_compares_fractions(spark):
    from pyspark.sql import functions as F

    rows = [([(9, 30, 10), (0, 24, 8), (3, 24, 8)],), ([(5, 100, 33), (0, 97, 32)],), ([],)]
    got = spark.createDataFrame(rows, "r array<struct<start:bigint,length:bigint,period:bigint>>").select(strongest(F.col("r")).alias("b")).collect()
    assert [tuple(r["b"]) if r["b"] else None for r in got] == [(9, 30, 10), (0, 97, 32), None]
