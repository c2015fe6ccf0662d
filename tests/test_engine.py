"""Search, index, sessions and the watch stream."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from loomgrain.operators import chat, index, relations, search
from loomgrain.operators import timeline as tl
from loomgrain.operators.embedding import HashEmbedder, embedded, hypothetical_vector, query_vector
from loomgrain.sources import files as fs
from loomgrain.streaming import watch


def chunk_rows(spark, n=40, dim=8, seed=1):
    rng = random.Random(seed)
    rows = [(k, f"text {'alpha' if k % 7 == 0 else 'beta'} {k}", f"/f{k % 5}", "w1" if k % 2 else "w2", [rng.random() for _ in range(dim)]) for k in range(n)]
    rows.append((n, "other length", "/g", "w1", [0.0] * (dim + 1)))
    return spark.createDataFrame(rows, "id long, document string, filePath string, workspaceId string, vector array<float>")


def test_topk_equals_brute_force(spark):
    df = chunk_rows(spark)
    rows = [r for r in df.collect() if len(r.vector) == 8]
    q = [0.5] * 8
    want = sorted((round(sum((a - b) ** 2 for a, b in zip(r.vector, q)), 6), r.id) for r in rows)[:5]
    assert [(r.distance, r.id) for r in search.vector_topk(df, q, 5).collect()] == want
    assert search.vector_topk(df, q, 5, []).count() == 5
    assert {r.workspaceId for r in search.vector_topk(df, q, 5, ["w1"]).collect()} == {"w1"}
    assert search.vector_topk(df, [0.1] * 3, 5).count() == 0


def test_batch_equals_single(spark):
    df = chunk_rows(spark, 300)
    queries = df.where("id < 7").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = {}
    for r in search.vector_topk_batch(df, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    for q in queries.collect():
        assert got[q.query_id] == [(r.distance, r.id) for r in search.vector_topk(df, list(map(float, q["query"])), 4).collect()]


def test_hybrid(spark):
    df = chunk_rows(spark)
    got = search.hybrid_search(df, [0.5] * 8, ["ALPHA"], 10).orderBy("rank").collect()
    assert [r.id for r in got][:6] == [0, 7, 14, 21, 28, 35]
    assert len(got) == 10 and len({r.id for r in got}) == 10 and [r.rank for r in got] == list(range(1, 11))
    assert [r.id for r in search.hybrid_search(df, [0.5] * 8, ["alpha"], 3).orderBy("rank").collect()] == [0, 7, 14]
    near = [r.id for r in search.vector_topk(df, [0.5] * 8, 5).collect()]
    assert [r.id for r in search.hybrid_search(df, [0.5] * 8, [], 5).orderBy("rank").collect()] == near
    assert [r.id for r in search.hybrid_search(df, [0.5] * 8, ["alpha"], 5, keyword_branch=False).orderBy("rank").collect()] == near


def test_manifest(spark, tmp_path):
    files = spark.createDataFrame([("w", p, 10.0) for p in ("new", "older", "equal", "newer", "model")], "workspace_id string, file_path string, mtime double")
    old = [("w", "older", 9.0, 1, "m"), ("w", "equal", 10.0, 1, "m"), ("w", "newer", 11.0, 1, "m"), ("w", "model", 10.0, 1, "x"), ("w", "gone", 1.0, 1, "m")]
    manifest = spark.createDataFrame(old, fs.MANIFEST)
    assert {(r.file_path, r.reason) for r in index.needs_indexing(files, manifest, "m").collect()} == {("new", "new"), ("older", "modified"), ("model", "model")}
    assert [r.file_path for r in index.stale(manifest, files).collect()] == ["gone"]
    entries = spark.createDataFrame([("w", "new", 10.0, 3, "m")], fs.MANIFEST)
    after = index.upserted(manifest, entries, index.stale(manifest, files))
    assert {r.file_path for r in after.collect()} == {"new", "older", "equal", "newer", "model"}
    assert fs.load_manifest(spark, str(tmp_path / "none")).count() == 0
    after.write.parquet(str(tmp_path / "m"))
    assert fs.load_manifest(spark, str(tmp_path / "m")).count() == 5


def test_store_replaces_files(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "idx"))
    assert store.count() == 0 and store.chunks() is None
    doomed = lambda *p: spark.createDataFrame([("w1", x) for x in p] + [("w2", x) for x in p], "workspaceId string, filePath string")
    rows = chunk_rows(spark)
    store.replace_files(doomed("/none"), rows)
    assert store.count() == 41
    again = rows.where("filePath = '/f0'")
    store.replace_files(doomed("/f0"), again)
    assert store.count() == 41
    store.replace_files(doomed("/f0"), again.limit(0))
    assert store.count() == 33
    plan = search.vector_topk(store.chunks().where("dim = 8"), [0.5] * 8, 3, ["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "workspaceId" in plan.split("PartitionFilters")[1].split("]")[0]


def test_progress(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "file_path string, n long")
    rows = index.progress(counts).orderBy("file_path").collect()
    assert [(r.chunks_done, r.files_done, r.processed_files) for r in rows] == [(3, 1, 2), (4, 2, 3), (4, 3, 3)]


def test_relations(spark):
    rows = [("w", "f", 0, "1", "Alpha", "class", "Alpha uses Beta and Gammas"), ("w", "f", 1, "2", "Beta", "function_item", "Beta"), ("w", "f", 2, "3", "Gamma", "x", "Gamma Alpha"), ("w", "g", 0, "4", "Beta", "y", "Alpha"), ("w", "g", 1, "5", "", "y", "Beta")]
    df = spark.createDataFrame(rows, "workspaceId string, filePath string, chunkIndex int, id string, name string, kind string, document string")
    edges = relations.reference_edges(df)
    assert {(r.fromName, r.toName) for r in edges.collect()} == {("Alpha", "Beta"), ("Gamma", "Alpha")}
    nodes = relations.graph_nodes(df, "w")
    assert {(r.name, r.filePath) for r in nodes.collect()} == {("Alpha", "f"), ("Beta", "g"), ("Gamma", "f")}
    assert [(r.x, r.y) for r in relations.graph_layout(nodes, 2).orderBy("name").collect()] == [(0, 0), (200, 0), (0, 150)]


def test_sessions(spark):
    sessions = spark.createDataFrame([(k, "New Chat", k) for k in range(51)], "id long, title string, updatedAt long")
    messages = spark.createDataFrame([(k, 0, "user", "x" * (31 if k else 30), []) for k in range(51)], "session_id long, idx long, role string, content string, citations array<string>")
    titled = chat.titled(sessions, messages)
    assert {r.id: r.title for r in titled.collect()}[1] == "x" * 30 + "..."
    assert {r.id: r.title for r in titled.collect()}[0] == "x" * 30
    kept = chat.retained(titled).collect()
    assert len(kept) == 50 and min(r.id for r in kept) == 1
    assert chat.worth_keeping(sessions, messages.where("session_id = 3")).count() == 1
    last = chat.secondary_context(spark.createDataFrame([(1, 0, "assistant", ["a", "b", "c"])], "session_id long, idx long, role string, citations array<string>"), ["b"])
    assert last.first().files == ["a", "c"]
    pinned = chat.pinned_block(spark.createDataFrame([(1, "one"), (2, None), (3, "three")], "position int, content string")).first().context
    assert pinned == "--- Pinned Context 1 ---\none\n\n--- Pinned Context 3 ---\nthree\n\n"
    text = spark.range(1).select(chat.system_message(F.lit(""), F.lit("P\n"), F.lit("be brief"), "B").alias("m")).first().m
    assert text == "B\n\nUSER INSTRUCTION:\nbe brief\n\n\nPINNED CONTEXT:\nP\n\nCONTEXT:\nNone"


def test_timeline(spark):
    now = 10 * 86_400_000.0
    files = spark.createDataFrame([(f"f{k}", now - k * 1000) for k in range(41)] + [("edge", now - 86_400_000)], "file_path string, mtime double")
    got = tl.timeline(files, now).collect()
    assert len(got) == 40 and got[0].file_path == "f0" and "edge" not in {r.file_path for r in got}
    assert tl.timeline(files.where("file_path = 'edge'"), now).count() == 0
    row = spark.createDataFrame([("x" * 2000, 499_999), ("y", 500_000)], "c string, s long").select(tl.snippet(F.col("c"), F.col("s")).alias("t")).collect()
    assert [r.t for r in row] == ["x" * 1000, None]


def test_embedding(spark):
    df = chunk_rows(spark).drop("vector")
    vectors = embedded(df, HashEmbedder(16)).select("vector").collect()
    assert all(len(r.vector) == 16 and abs(np.linalg.norm(r.vector) - 1) < 1e-5 for r in vectors)
    assert query_vector(HashEmbedder(16), "a b") is query_vector(HashEmbedder(16), "a b")


def test_hash_embedder_equals_counts(spark):
    """Signed counts of hashed words by a loop."""
    import hashlib

    texts = ["a b a", "", "one Two two", "x " * 500]
    rows = embedded(spark.createDataFrame([(t,) for t in texts], "document string"), HashEmbedder(8)).collect()
    for r in rows:
        want = [0.0] * 8
        for w in r.document.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            want[h % 8] += 1 if h >> 63 else -1
        length = sum(x * x for x in want) ** 0.5 or 1
        assert np.allclose(r.vector, [x / length for x in want], atol=1e-6)


def test_hypothetical_vector():
    own = HashEmbedder(16)
    assert hypothetical_vector(own, "question", lambda q: f"answer to {q}") == query_vector(own, "answer to question")

    def broken(q):
        raise OSError

    assert hypothetical_vector(own, "question", broken) == hypothetical_vector(own, "question") == hypothetical_vector(own, "question", lambda q: " ") == query_vector(own, "question")


def test_store_lifecycle(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "idx"), buckets=4)
    rows = chunk_rows(spark)
    doomed = lambda *p: spark.createDataFrame([(w, x) for w in ("w1", "w2") for x in p], "workspaceId string, filePath string")
    edges = spark.createDataFrame([("w1", "/f1", "1", "A", "B", "reference"), ("w1", "/f3", "3", "C", "D", "reference")], "workspaceId string, filePath string, id string, fromName string, toName string, kind string")
    manifest = spark.createDataFrame([("w1", "/f1", 1.0, 1, "m")], fs.MANIFEST)
    store.replace_files(doomed("/f1"), rows, edges, manifest)
    before = store.state()
    store.replace_files(spark.createDataFrame([("w1", "/f1")], "workspaceId string, filePath string"), rows.limit(0), edges.limit(0))
    after = store.state()
    kept = [b for b, v in before["tables"]["chunks"]["parts"].items() if after["tables"]["chunks"]["parts"].get(b) == v]
    assert len(kept) >= len(before["tables"]["chunks"]["parts"]) - 1  # one bucket is rewritten
    assert {r.filePath for r in store.edges().collect()} == {"/f3"} and store.manifest(fs.MANIFEST).count() == 1
    assert store.chunks().where("workspaceId = 'w1' AND filePath = '/f1'").count() == 0 and store.count() == 41 - rows.where("workspaceId = 'w1' AND filePath = '/f1'").count()
    n = store.count()
    assert store.vacuum() > 0 and store.count() == n and len(store._pointers()) == 1
    store.reset()
    assert store.count() == 0 and store.edges().count() == 0 and store.manifest(fs.MANIFEST).count() == 0
    store.replace_files(doomed("/f0"), rows)
    assert store.count() == 41
    stale_state = store.state()
    store.replace_files(doomed("/f0"), rows)
    try:
        store._point(stale_state)
        raise AssertionError("a second writer must fail")
    except RuntimeError:
        pass


def test_numbering_by_starts(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abB\u00e9_", k=rng.randint(1, 6))) for _ in range(300)}, key=lambda s: s.encode())
    df = spark.createDataFrame([(n,) for n in rng.sample(names, len(names))], "name string")
    assert {r.name: r.i for r in relations.numbered(df, "name", "i", lead=2).collect()} == {n: k for k, n in enumerate(names)}


def test_references_of_a_large_file(spark):
    """As many symbols as words: the work grows with the text, not with their product."""
    n = 60_000
    df = spark.range(n).select(F.lit("w").alias("workspaceId"), F.lit("f").alias("filePath"), F.col("id").cast("string").alias("id"), F.concat(F.lit("name_"), F.col("id")).alias("name"),
                               F.concat(F.lit("calls name_"), (F.col("id") + 1) % n, F.lit(" and name_"), (F.col("id") + 7) % n).alias("document"))
    assert relations.reference_edges(df).count() == 2 * n
    rows = [("1", "a::b", "uses c$d, c$dx"), ("2", "c$d", "xa::b a::b"), ("3", "\u00e9t\u00e9", "un \u00e9t\u00e9s"), ("4", "z", "\u00e9t\u00e9 a::bc")]
    odd = spark.createDataFrame([("w", "f", *r) for r in rows], "workspaceId string, filePath string, id string, name string, document string")
    assert {(r.fromName, r.toName) for r in relations.reference_edges(odd).collect()} == {("a::b", "c$d"), ("c$d", "a::b"), ("z", "\u00e9t\u00e9")}


def test_percent():
    assert [index.percent_done(*x) for x in ((None, 3), (0, 3), (1, 3), (1, 200), (3, 3), (2, 0))] == [5, 5, 33, 5, 100, 5]


def test_watch_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("w", "/a.py", t), ("w", "/b.py", t + timedelta(seconds=1)), ("w", "/c.py", t + timedelta(seconds=10)), ("w", "/.git/x", t + timedelta(seconds=11)), ("v", "/a.py", t), ("z", "/late.py", t + timedelta(hours=2))]
    df = spark.createDataFrame(rows, "workspaceId string, path string, ts timestamp")
    assert sorted((r.workspaceId, r.events) for r in watch.debounced(df).collect()) == [("v", 1), ("w", 1), ("w", 2), ("z", 1)]
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = watch.watch(stream, lambda ws, n: seen.extend(r.workspaceId for r in ws.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert set(seen) == {"v", "w"}  # the burst of z is still open
