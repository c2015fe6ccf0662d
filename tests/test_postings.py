"""The inverted index against BM25 by a loop, and what its plans read."""

import math
import random
import re
from collections import Counter

import pytest

from loomgrain.operators import postings
from loomgrain.operators.postings import PostingIndex

WORDS = [f"w{k}" for k in range(60)] + ["Été", "x_y", "don't", "ß"]


def texts(rng, n):
    out = [" ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randrange(1, 60))) for _ in range(n)]
    return [*out, "", None, "...", "  w1\tw1 ", "w59 " * 200]


def brute(rows, queries, k):
    toks = {i: re.findall(r"[^ \t\n\x0b\f\r!-/:-@\[-`{-~]+", (t or "").lower()) for i, t in rows}
    mean = sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    out = []
    for q, words in queries:
        scores = {}
        for w in {x.lower() for x in words or []}:
            idf = math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5))
            for i, t in toks.items():
                if n := t.count(w):
                    scores[i] = scores.get(i, 0) + idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out += [(q, r + 1, i, round(s, 6)) for r, (i, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 128])
def test_equals_a_loop(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "LEADS", 1)
    rng = random.Random(block)
    rows = list(enumerate(texts(rng, 400)))
    df = spark.createDataFrame(rows, "id long, document string")
    index = PostingIndex.build(df, str(tmp_path / "index"), buckets=8)
    queries = [(q, rng.sample(WORDS, rng.randrange(0, 6)) + (["absent", ""] if q % 3 == 0 else [])) for q in range(25)] + [(99, None), (100, ["W1", "w1"])]
    found = index.search_batch(spark.createDataFrame(queries, "query_id long, words array<string>"), 7)
    got = sorted(tuple(r) for r in found.collect())
    want = brute(rows, queries, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    one = PostingIndex(spark, str(tmp_path / "index")).search(["w1", "W40", "été"], 5).collect()
    assert [(0, *r[:2]) for r in one] == [w[:3] for w in brute(rows, [(0, ["w1", "w40", "été"])], 5)]
    assert not (tmp_path / "index" / "counted").exists()


def test_identifiers_of_text_and_empty_corpus(spark, tmp_path):
    df = spark.createDataFrame([("a", "one two"), ("b", "two"), (None, "two")], "id string, document string")
    got = PostingIndex.build(df, str(tmp_path / "a")).search(["two"], 5).collect()
    assert [r.id for r in got] == ["b", "a"]
    assert PostingIndex.build(df.limit(0), str(tmp_path / "b")).search(["two"], 5).collect() == []


def test_search_reads_its_terms_alone(spark, tmp_path):
    rows = list(enumerate(texts(random.Random(3), 200)))
    index = PostingIndex.build(spark.createDataFrame(rows, "id long, document string"), str(tmp_path / "index"))
    plan = index.search(["w1", "w7"], 5)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert scans and all("PushedFilters: [IsNotNull(term), In(term" in s or "In(term" in s for s in scans)
    assert all("_bucket" in s.split("PartitionFilters: [")[1].split("PushedFilters")[0] for s in scans)


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """A rare word decides the result, so most blocks of the common one are never opened."""
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = [(k, "common " * (1 + k % 3) + ("filler " * (k % 50)) + ("rare rare rare" if k % 200 == 0 else "")) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, document string")
    index = PostingIndex.build(df, str(tmp_path / "index"), buckets=4)
    found = index.search(["common", "rare"], 5)
    assert sorted(tuple(r)[:2] for r in found.collect()) == sorted(w[1:3] for w in brute(rows, [(0, ["common", "rare"])], 5))
    plan, opened = [found._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if node.nodeName() == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        else:
            if node.nodeName() == "Generate" and node.metrics().contains("numOutputRows"):
                opened.append(node.metrics().get("numOutputRows").get().value())
            plan += [node.children().apply(i) for i in range(node.children().size())]
    assert max(opened) < 2000  # of 4020 postings


def test_a_batch_writes_no_postings_by_query(spark, tmp_path, monkeypatch):
    """Many queries ask for common words: parts of the index meet them in memory, and what is shuffled on is k rows a query and part."""
    monkeypatch.setattr(postings, "PART_POSTINGS", 1500)
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 400)))
    index = PostingIndex.build(spark.createDataFrame(rows, "id long, document string"), str(tmp_path / "index"))
    queries = [(q, rng.sample(WORDS[:20], 6)) for q in range(60)]
    found = index.search_batch(spark.createDataFrame(queries, "query_id long, words array<string>"), 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(postings" not in plan
    want = brute(rows, queries, 5)
    got = sorted(tuple(r) for r in found.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
