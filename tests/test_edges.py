"""Reference edges: both ways give the same, equal to a loop, and the shuffle stays below the input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgrain.operators.relations import reference_edges

NAMES = ["alpha", "Beta", "gamma_2", "a::b", "c$d", "été", "x-y", "世", "b"]


def brute(rows):
    named = [r for r in rows if r[3]]
    out = []
    for ws, file, ident, name, text in named:
        for other in {r[3] for r in named if r[0] == ws and r[1] == file and ws is not None and file is not None} - {name}:
            if text and re.search(r"\w", other) and (re.search(rf"\b{re.escape(other)}\b", text) if re.fullmatch(r"\w+", other) is None else other in re.findall(r"\w+", text)):
                out.append((ws, file, ident, name, other))
    return sorted(map(str, out))


@pytest.mark.parametrize("names_a_row", [1, 3, 2048])
def test_equals_a_loop(spark, names_a_row):
    rng = random.Random(7)
    rows = []
    for k in range(150):
        text = " ".join(rng.choice([*NAMES, "other", "a::bc", "gamma", "--"]) for _ in range(rng.randrange(12)))
        rows.append((rng.choice(["w", "v", None]), rng.choice(["f", "g", "h"]), str(k % 140), rng.choice([*NAMES, "", None, "::"]), rng.choice([text, text, None])))
    df = spark.createDataFrame(rows, "workspaceId string, filePath string, id string, name string, document string")
    got = reference_edges(df, names_a_row).select("workspaceId", "filePath", "id", "fromName", "toName").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert reference_edges(df.limit(0), names_a_row).count() == 0


def test_shuffle_stays_below_the_text(spark):
    """Chunks of many words: what is shuffled is the text once, not its words one by one."""
    rows = spark.range(4000).select(
        F.lit("w").alias("workspaceId"), (F.col("id") / 40).cast("int").cast("string").alias("filePath"), F.col("id").cast("string").alias("id"), F.concat(F.lit("name_"), F.col("id") % 97).alias("name"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.concat(F.lit("word_"), F.pmod(F.xxhash64("id", k), F.lit(100_000)))), " ").alias("document"),
    )
    size = rows.agg(F.sum(F.octet_length("document"))).first()[0]
    edges = reference_edges(rows)
    edges.write.format("noop").mode("overwrite").save()
    plan = edges._jdf.queryExecution()
    edges.collect()
    nodes, written = [plan.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            written += node.metrics().get("shuffleBytesWritten").get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < written < size
