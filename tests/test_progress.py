"""Query progress as rows: running, completed and failed, in order; and the indexer's job told of by it."""

import pytest

from loomgrain.operators.embedding import HashEmbedder
from loomgrain.plans.indexing import Indexer
from loomgrain.streaming.progress import ProgressListener, listening


def run(spark, tmp_path, name, fail):
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def sink(batch, number):
        if fail and number == 1:
            raise ValueError("the sink is full")
        batch.count()

    q = source.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        q.awaitTermination(100)
    except Exception:  # noqa: BLE001
        pass
    return q


def test_states_in_order(spark, tmp_path):
    for n in (3, 4, 5):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    with listening(spark, ProgressListener(told.append, ("good", "bad"))) as listener:
        good = run(spark, tmp_path, "good", False)
        assert listener.wait_for(good)
        bad = run(spark, tmp_path, "bad", True)
        assert listener.wait_for(bad)
        run(spark, tmp_path, "other", False)
    events = [(e.name, e.status, e.batch, e.total) for e in told]
    own = [e[1:] for e in events if e[0] == "good"]
    assert [x[0] for x in own] == ["running"] * 4 + ["completed"] and [x[1] for x in own] == [-1, 0, 1, 2, -1] and own[-1][2] == 12
    own = [e[1:] for e in events if e[0] == "bad"]
    assert [x[0] for x in own] == ["running", "running", "failed"] and "the sink is full" in told[-1].error
    assert {e[0] for e in events} == {"good", "bad"}
    rows = listener.rows(spark).collect()
    assert [(r.name, r.status, r.batch, r.total) for r in rows] == events and rows[0].job == str(good.runId)


def test_indexer_tells_of_its_job(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    for k in range(6):
        (folder / f"f{k}.py").write_text(f"def name_{k}():\n    return {k}\n")
    told = []
    indexer = Indexer(spark, str(folder), str(tmp_path / "index"), HashEmbedder(8), "m", calls=1)
    assert indexer.run(told.append)["indexed"] == 6
    assert [t["status"] for t in told][-1] == "completed" and {t["status"] for t in told} == {"running", "completed"}
    done = [t["processedFiles"] for t in told]
    assert done == sorted(done) and done[-1] == 6 and len({t.job for t in told}) == 1 and told[0].workspace == str(folder)

    class Broken(HashEmbedder):
        def embed(self, texts):
            raise OSError("no server")

    told.clear()
    with pytest.raises(Exception, match="no server"):
        Indexer(spark, str(folder), str(tmp_path / "other"), Broken(8), "m").run(told.append)
    assert told[-1]["status"] == "failed"
    assert Indexer(spark, str(folder), str(tmp_path / "other"), HashEmbedder(8), "m").run()["indexed"] == 6
