"""The folder source and the debounce by timers, on real folders."""

import os
import time

import pytest
from pyspark.sql import functions as F

from loomgrain.streaming.folder import FolderReader, Subtree, folder_changes
from loomgrain.streaming.watch import bursts, watch_folder


def wait_for(condition, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.1)
    return False


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def polled(spark, folder, base, **options):
    """Changes since the last poll, by a query that ends by itself and goes on from its checkpoint."""
    out = base / "out"
    before = spark.read.parquet(str(out)).count() if out.exists() else 0
    stream = folder_changes(spark, str(folder), str(base / "listings"), **options).withColumn("n", F.lit(before))
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(base / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted((r.path, r.kind) for r in spark.read.parquet(str(out)).where(F.col("n") == before).collect()) if out.exists() and list(out.glob("part*")) else []


def test_changes_and_restart(spark, tmp_path):
    folder, base = tmp_path / "w", tmp_path / "s"
    write(folder / "a.py", "1")
    write(folder / "sub" / "deep" / "b.py", "1")
    write(folder / "node_modules" / "x.js", "1")
    assert polled(spark, folder, base) == []  # what is there is no change
    write(folder / "a.py", "22")
    write(folder / "sub" / "deep" / "c.py", "1")
    write(folder / "new" / "d.py", "1")
    write(folder / "node_modules" / "y.js", "1")
    write(folder / ".git" / "z", "1")
    assert polled(spark, folder, base) == [("a.py", "modified"), ("new/d.py", "created"), ("sub/deep/c.py", "created")]
    (folder / "sub" / "deep" / "b.py").unlink()
    os.remove(folder / "new" / "d.py")
    os.rmdir(folder / "new")
    assert polled(spark, folder, base) == [("new/d.py", "deleted"), ("sub/deep/b.py", "deleted")]
    assert polled(spark, folder, base) == []


def test_a_batch_again_gives_the_same_rows(tmp_path):
    """After a failure the same offsets are read again: later changes belong to the next version."""
    folder, state = tmp_path / "w", tmp_path / "s"
    write(folder / "a.py", "1")
    make = lambda: FolderReader({"path": str(folder), "state": str(state)})
    reader = make()
    assert reader.latestOffset() == {"version": 1}
    assert [list(reader.read(p)) for p in reader.partitions({"version": 0}, {"version": 1})] == [[]]
    write(folder / "b.py", "1")
    assert reader.latestOffset() == {"version": 2}
    first = list(reader.read(Subtree("", 1, 2)))
    write(folder / "c.py", "1")
    again = make()
    assert [list(again.read(p)) for p in again.partitions({"version": 1}, {"version": 2})] == [first] and [r[1] for r in first] == ["b.py"]
    again.commit({"version": 2})
    assert [r[1] for r in again.read(Subtree("", 2, again.latestOffset()["version"]))] == ["c.py"]
    assert again._versions() == [2, 3]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_burst_comes_without_newer_events(rocks, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "workspaceId string, path string, ts timestamp"
    seen = []
    stream = rocks.readStream.schema(schema).json(str(src))
    q = bursts(stream, 1500).writeStream.foreachBatch(lambda b, n: seen.extend((r.workspaceId, r.events, time.time()) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        lines = ['{"workspaceId":"w","path":"a","ts":"2024-01-01T00:00:00"}', '{"workspaceId":"w","path":"b","ts":"2024-01-01T00:00:05"}', '{"workspaceId":"v","path":".git/x","ts":"2024-01-01T00:00:00"}', '{"workspaceId":"u","path":"c","ts":"2024-01-01T00:00:00"}']
        write(tmp_path / "t1.json", "\n".join(lines))
        os.rename(tmp_path / "t1.json", src / "1.json")
        assert wait_for(lambda: len(seen) >= 2)
        assert sorted(x[:2] for x in seen) == [("u", 1), ("w", 2)]
        write(tmp_path / "t2.json", lines[0])
        os.rename(tmp_path / "t2.json", src / "2.json")
        assert wait_for(lambda: len(seen) >= 3) and seen[2][:2] == ("w", 1)
    finally:
        q.stop()


def test_watch_folder_fires_by_itself_and_restarts(rocks, tmp_path):
    folder = tmp_path / "w"
    write(folder / "a.py", "1")
    seen = []
    start = lambda: watch_folder(rocks, str(folder), lambda ws, n: seen.append([r.workspaceId for r in ws.collect()]), str(tmp_path / "cp"), gap_ms=1000, poll="200 milliseconds")
    q = start()
    try:
        assert wait_for(lambda: (q.lastProgress or {}).get("batchId", -1) >= 1)
        assert seen == []
        write(folder / "b.py", "1")
        assert wait_for(lambda: len(seen) == 1) and seen == [[str(folder)]]
    finally:
        q.stop()
    write(folder / "sub" / "c.py", "1")  # while nobody watches
    q = start()
    try:
        assert wait_for(lambda: len(seen) == 2)
    finally:
        q.stop()
