"""Growing buckets: their number follows the size, a change rewrites few of them, and nothing is lost."""

import random

from pyspark.sql import functions as F

from loomgrain.operators.index import MOST_SPLITS, IndexStore

FILES = "workspaceId string, filePath string"


def chunks(spark, names):
    return spark.createDataFrame([(f"{n}:{k}", "w", n, f"text {n} {k}", [float(k), 1.0]) for n in names for k in range(5)], "id string, workspaceId string, filePath string, document string, vector array<float>")


def edges(spark, names):
    return spark.createDataFrame([("w", n, f"{n}:0", "A", n, "reference") for n in names], "workspaceId string, filePath string, id string, fromName string, toName string, kind string")


def doomed(spark, names):
    return spark.createDataFrame([("w", n) for n in names], FILES)


def check(spark, store, names):
    assert sorted((r.filePath, r.id) for r in store.chunks().collect()) == sorted((n, f"{n}:{k}") for n in names for k in range(5))
    assert sorted(r.filePath for r in store.edges().collect()) == sorted(names)
    state = store.state()
    assert sum(state["rows"].values()) == 5 * len(names)
    placed = store._read("chunks", state, keep_bucket=True).withColumn("want", store._bucket("workspaceId", "filePath", state["buckets"]))
    assert placed.where(F.col("want") != F.col("_bucket")).count() == 0


def test_buckets_grow_with_the_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "idx"), buckets=2, bucket_rows=20)
    names = [f"f{k}" for k in range(8)]
    store.replace_files(doomed(spark, ["none"]), chunks(spark, names), edges(spark, names))
    assert store.state()["buckets"] == 2
    check(spark, store, names)
    rng = random.Random(1)
    while store.state()["buckets"] < 20:  # ten times the files, some at a time
        before = store.state()
        new = [f"f{len(names) + k}" for k in range(rng.randrange(4, 12))]
        store.replace_files(doomed(spark, ["none"]), chunks(spark, new), edges(spark, new))
        names += new
        after = store.state()
        moved = [b for b, v in before["tables"]["chunks"]["parts"].items() if after["tables"]["chunks"]["parts"].get(b) != v]
        assert len(moved) <= 2 * max(MOST_SPLITS, len(new) + 1)
        assert before["buckets"] <= after["buckets"] <= -(-5 * len(names) // 20)
    assert len(names) >= 70
    check(spark, store, names)
    # one small change, without edges, that splits and leaves the rest
    for k in range(6):
        before = store.state()
        store.replace_files(doomed(spark, [f"g{k}"]), chunks(spark, [f"g{k}"]))
        moved = [b for b, v in before["tables"]["chunks"]["parts"].items() if store.state()["tables"]["chunks"]["parts"].get(b) != v]
        assert len(moved) <= 2 + MOST_SPLITS
    store.replace_files(doomed(spark, [f"g{k}" for k in range(6)]), chunks(spark, ["x"]).limit(0), edges(spark, ["x"]).limit(0))
    check(spark, store, names)


def test_a_large_first_load_begins_with_its_buckets(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "idx"), buckets=2, bucket_rows=20)
    names = [f"f{k}" for k in range(80)]
    store.replace_files(doomed(spark, ["none"]), chunks(spark, names), edges(spark, names))
    assert store.state()["buckets"] == 20
    check(spark, store, names)
    store.reset()
    assert store.count() == 0
    store.replace_files(doomed(spark, ["none"]), chunks(spark, names[:3]), edges(spark, names[:3]))
    check(spark, store, names[:3])


def test_a_change_cuts_its_chunks_twice(spark, tmp_path):
    """Once to count them by file, once to write them; keys and numbers are asked of the counts."""
    cut = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(text):
        cut.add(1)
        return True

    store = IndexStore(spark, str(tmp_path / "store"), buckets=2, bucket_rows=10)
    rows = spark.createDataFrame([("w", f"f{i % 30}", i, f"t{i}") for i in range(90)], "workspaceId string, filePath string, chunkIndex int, document string")
    chunks = rows.where(seen("document")).withColumn("vector", F.array(F.lit(1.0)).cast("array<float>"))
    store.replace_files(rows.select("workspaceId", "filePath").distinct(), chunks)
    assert cut.value <= 180 and store.count() == 90
    assert store._names(f"{store.root}/counts") == []
