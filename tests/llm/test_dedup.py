import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from loomgrain.llm.components import components
from loomgrain.llm.exact_dedup import MergeIndex, drop_copies, exact_dedup, sha256

SCHEMA = "doc_id long, text string, keep_id string, _row int, source string"


def norm(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def rows_with_copies():
    rng = random.Random(5)
    rows = [(k, rng.choice(["Aa", "aa", "b", "É", "é", "", None, "x" * 5000, "İ", "\U0001f600"]), "k", 1, "s") for k in range(300)]
    return rows + [(None, "only null", "k", 1, "s"), (None, "b", "k", 1, "s"), (7, "dup", "k", 1, "s"), (7, "dup", "k", 1, "s"), (8, "DUP", None, None, None)]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_equals_brute_force(spark, keep, weak):
    rows = rows_with_copies()
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))) if weak else sha256
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), keep=keep, digest=digest).collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for r in rows:
        own = groups[norm(r[1])]
        ids = [x for x in own if x is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        want.append((r[0], best, len(own), r[0] == best, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_colliding_digests_are_told_apart(spark):
    rows = [(k, t, "k", 1, "s") for k, t in enumerate("abcabcd")]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), digest=lambda t: F.unhex(F.lit("00"))).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (5, 2), (6, 6)}


def test_drop_copies(spark):
    df = spark.createDataFrame(rows_with_copies(), SCHEMA)
    left = drop_copies(df).collect()
    assert sorted(norm(r.text) for r in left) == sorted({norm(r[1]) for r in rows_with_copies()})
    assert drop_copies(df).columns == df.columns
    assert drop_copies(df.limit(0)).count() == 0 and exact_dedup(df.limit(0)).count() == 0


def test_index_runs(spark):
    index = MergeIndex.create(spark, expected=300)
    batch = lambda lo, n=100: spark.range(lo, lo + n).select("id", sha256((F.col("id") % 60 + F.floor(F.col("id") / 10_000) * 60).cast("string")).alias("digest"))
    index.insert(batch(0))
    index.insert(batch(1000))
    index.insert(batch(10_000, 50))
    merged = index.compact()
    assert merged.count() == 110 and merged.where("n = 4").count() + merged.where("n = 3").count() + merged.where("n = 2").count() == 60
    assert merged.where("n > 1").agg(F.max("keep_id")).first()[0] < 60
    wanted = bytes(merged.where("n > 1").first().digest)
    assert [(bytes(r.digest), r.run) for r in index.lookup([wanted]).orderBy("run").collect()] == [(wanted, 0), (wanted, 1)]
    with pytest.raises(ValueError):
        index.lookup([b""] * 10_001)


def test_filters_spare_what_one_run_has(spark):
    """Probed before a flush, the filters mark what earlier runs may have; compaction shuffles little else."""
    index = MergeIndex.create(spark, expected=4000)
    digests = lambda lo, hi: spark.range(lo, hi).select("id", sha256(F.col("id").cast("string")).alias("digest"))
    index.insert(digests(0, 2000))
    index.insert(digests(1900, 3900))
    second = index.runs().where("run = 1")
    assert second.where("met AND keep_id < 2000").count() == 100 and second.where("met").count() < 300
    assert index.parted().where("shared AND keep_id BETWEEN 1900 AND 1999").count() == 200 and index.parted().where("shared").count() < 600
    plan = index.parted()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert index.compact().count() == 3900 and index.compact().where("n = 2").count() == 100
    files = [f.replace("file://", "") for f in index.runs().inputFiles()]
    import pyarrow.parquet as pq

    for f in files:
        group = pq.ParquetFile(f).read().column("digest").to_pylist()
        assert group == sorted(group)


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "odd"])
def test_components(spark, kind):
    rng = random.Random(2)
    links = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(k, k + 1) for k in range(120)],
        "star": [(0, k) for k in range(1, 200)] + [(500, k) for k in range(501, 600)] + [(199, 599)],
        "odd": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (-7, 3)],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
