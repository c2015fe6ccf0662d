import math
import random

import pytest
from pyspark.sql import functions as F

from loomgrain.llm.mixing import _each_copy, mix_sources, ranked, sainte_lague


def highest_quotients(votes, total):
    seats = [0] * len(votes)
    for _ in range(total):
        best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    return seats


def water(sizes, weights, total, most=2.0):
    capped = set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        level = (total - sum(most * sizes[k] for k in capped)) / sum(weights[k] for k in free) if free else math.inf
        over = {k for k in free if most * sizes[k] < level * weights[k]}
        if not over:
            return [most * s if k in capped else level * weights[k] for k, s in enumerate(sizes)]
        capped |= over


@pytest.mark.parametrize("seed", range(6))
def test_apportionment_equals_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for g in range(4):
        votes = [float(rng.choice([0, 1, 5, rng.randint(1, 50), rng.randint(1, 5000)])) for _ in range(rng.randint(1, 12))]
        total = rng.choice([0, 1, 7, 100, 333])
        rows += [(g, k, v, total) for k, v in enumerate(votes)]
        if sum(votes):
            want |= {(g, k): s for k, s in enumerate(highest_quotients(votes, total))}
        else:
            want |= {(g, k): 0 for k in range(len(votes))}
    got = sainte_lague(spark.createDataFrame(rows, "g int, idx long, votes double, total long"), ["g"]).collect()
    assert {(r.g, r.idx): r.seats for r in got} == want


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string, target string")


def test_mix(spark):
    rng = random.Random(3)
    names = ["b", "a", "Z", "é", "", None]
    rows = [(k, names[min(5, int(rng.expovariate(0.6)))], " ".join(["w"] * rng.choice([0, 1, 3, 40, 900])), "x", "y") for k in range(400)]
    rows += [(None, "a", "one two", "x", "y"), (None, "a", None, "x", "y"), (7, "a", "one two", "x", "y"), (7, "a", "one two", "x", "y"), (9, None, "w " * 5000, "x", "y")]
    docs = docs_of(spark, rows)
    got = mix_sources(docs, shard_rows=50).collect()
    assert len(got) == len(rows)
    order = sorted({r[1] for r in rows if r[1] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((r[2] or "").split()) for r in rows if r[1] == s) for s in order]
    targets = water(sizes, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes))
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size + r.extra_words
        by_target.setdefault((r.source_size, r.target), []).append(r)
    for mine, wanted in zip(sorted(by_target), sorted(zip(sizes, targets, strict=True)), strict=True):
        assert mine == pytest.approx(wanted)
    for (_, target), own in by_target.items():
        assert abs(sum(r.taken for r in own) - target) <= 16 * 4
    again = mix_sources(docs.repartition(7), shard_rows=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_tables(spark):
    docs = docs_of(spark, [(1, "a", "", "x", "y"), (2, None, None, "x", "y")])
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mix_sources(docs).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mix_sources(docs.limit(0)).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", None, "é", "Z")], "s string")
    rows = ranked(df, [F.col("s").isNull(), F.col("s")], "t").orderBy("idx").collect()
    assert [(r.s, r.idx) for r in rows] == [("Z", 0), ("a", 1), ("b", 2), ("é", 3), (None, 4)]


def test_repeated_rows_are_dealt_in_blocks(spark):
    rows = spark.createDataFrame([("a", 1, 7), ("b", 2, 3), ("c", 3, 1), (None, 4, 4)], "key string, size int, copies long")
    got = _each_copy(rows, block=3).groupBy("key", "size", "copies").agg(F.collect_set("copy").alias("own"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and all(sorted(r.own) == list(range(r.copies)) and r.n == r.copies for r in got)
    docs = docs_of(spark, [(7, "a", "one two three", "x", "y")]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("n")
    got = mix_sources(docs.unionByName(docs_of(spark, [(8, "b", "four", "x", "y")])), shard_rows=100).collect()
    assert len(got) == 2001 and abs(sum(r.taken for r in got if r.doc_id == 7) - next(r.target for r in got if r.doc_id == 7)) <= 16
    assert all(r.taken <= 2 * r.size for r in got)
