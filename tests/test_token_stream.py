"""Streams of pieces give the tokens of whole bodies."""

import json
import random

import pytest

from loomgrain.sources import services
from loomgrain.streaming.tokens import ndjson_token_stream, sse_token_stream

WORDS = ["Hal", "lo", "", "é", "世界", "😀", 'a "q"', "\\n", "x"]


def ndjson(rng):
    lines = [json.dumps({"message": {"content": w}}, ensure_ascii=False) for w in rng.choices(WORDS, k=6)]
    lines.insert(2, "{broken")
    lines.insert(4, "")
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n", "\r\n"])


def sse(rng):
    lines = ["data: " + json.dumps({"choices": [{"delta": {"content": w}}]}, ensure_ascii=False) for w in rng.choices(WORDS, k=6)]
    lines.insert(1, ": keep-alive")
    lines.insert(3, "data: {}")
    end = rng.choice([["data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}'], []])
    return rng.choice(["\n", "\r\n"]).join(lines + end) + rng.choice(["", "\n"])


@pytest.mark.parametrize(("make", "stream", "whole"), [(ndjson, ndjson_token_stream, services.ndjson_tokens), (sse, sse_token_stream, services.sse_tokens)])
def test_bodies_cut_at_every_byte(spark, tmp_path, make, stream, whole):
    """Body k is cut in two at its byte k; others are cut into single bytes, shuffled over batches and sent twice."""
    rng = random.Random(11)
    bodies, pieces = [], []
    sample = make(rng)
    for k in range(len(sample.encode()) + 1):
        bodies.append((f"two{k}", sample))
        data = sample.encode()
        pieces += [(f"two{k}", 0, data[:k], False), (f"two{k}", 1, data[k:], True)]
    for k in range(12):
        body = make(rng)
        bodies.append((f"all{k}", body))
        data = body.encode()
        own = [(f"all{k}", n, data[n : n + 1], n == len(data) - 1) for n in range(len(data))]
        pieces += own + rng.sample(own, 9)
    order = sorted(range(len(pieces)), key=lambda i: (pieces[i][0].startswith("all") and rng.random(), i))
    schema = "id string, n long, piece binary, last boolean"
    size = -(-len(order) // 4)
    for b in range(4):
        spark.createDataFrame([pieces[i] for i in order[b * size : (b + 1) * size]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
    finally:
        spark.conf.unset(name)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "seq", "token").collect())
    want = whole(spark.createDataFrame(bodies, "id string, body string"))
    assert got == sorted(tuple(r) for r in want.select("id", "seq", "token").collect()) and len(got) > 100
