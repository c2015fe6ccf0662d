"""Small user tables."""

from pyspark.sql import functions as F

from loomgrain.operators import workspaces as ws


def test_edits(spark):
    rows = spark.createDataFrame([("a", "A", 3), ("b", "B", 1)], "id string, name string, lastOpened long")
    changes = spark.createDataFrame([("b", None, 9), ("c", "C", 2)], "id string, name string, lastOpened long")
    after = ws.upserted(rows, changes)
    assert {tuple(r) for r in after.collect()} == {("a", "A", 3), ("b", "B", 9), ("c", "C", 2)}
    assert [r.id for r in ws.recent(after, 2).collect()] == ["b", "a"]
    assert [r.id for r in ws.removed(after, ["a", "b"]).collect()] == ["c"] and ws.removed(after, []).count() == 3
    assert ws.active_of(after, spark.createDataFrame([("c",), ("z",)], "id string")).count() == 1
    got = spark.range(1).select(ws.toggled(F.array(F.lit("x")), F.lit("x")).alias("out"), ws.toggled(F.array(F.lit("x")), F.lit("y")).alias("both")).first()
    assert (got.out, got.both) == ([], ["x", "y"])


def test_lists(spark):
    models = spark.createDataFrame([(f"m/{k}", "Big Model" if k % 2 else "small") for k in range(80)], "id string, name string")
    assert ws.find_models(models, "BIG").count() == 30 and ws.find_models(models, "m/7").count() == 11
    files = spark.createDataFrame([("w", "a"), ("w", "b"), ("v", "c")], "workspaceId string, file_path string")
    got = ws.coverage(files, files.where("file_path = 'a'").union(files.where("file_path = 'a'")))
    assert {tuple(r) for r in got.collect()} == {("w", 2, 1, 50.0), ("v", 1, 0, 0.0)}
    turns = spark.createDataFrame([(1, k) for k in range(11)] + [(2, k) for k in range(10)], "conv_id long, turn long")
    parts = ws.split_for_summary(turns)
    assert parts.where("part = 'summary'").count() == 5 and parts.where("part = 'summary' AND turn > 4").count() == 0
