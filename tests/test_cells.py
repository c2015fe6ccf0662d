"""Nearest neighbours by cells: recall against the exact path, exactness with all cells, and what is read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrain.operators import search
from loomgrain.operators.cells import OTHER, CellIndex, fitted_cells


def recall(got, want):
    near = {}
    for r in got.collect():
        near.setdefault(r["query_id"], set()).add(r["id"])
    rows = want.collect()
    return sum(r["id"] in near.get(r["query_id"], ()) for r in rows) / len(rows)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_tables(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    index = CellIndex.build(rows, str(tmp_path / "cells"))
    assert index.vectors().count() == rows.count()
    assert recall(index.search_batch(queries, 10), search.vector_topk_batch(rows, queries, 10)) >= 0.9


def clustered(rng, n, dim=6, centres=12):
    at = [[rng.uniform(-10, 10) for _ in range(dim)] for _ in range(centres)]
    rows = [(k, [x + rng.gauss(0, 0.3) for x in at[0 if k % 3 else rng.randrange(centres)]]) for k in range(n)]
    return rows + [(n, None), (n + 1, [1.0] * 3), (n + 2, [float("nan")] * dim), (n + 3, rows[0][1]), (n + 4, [2.0] * 3), (n + 5, [])]


def test_all_cells_are_exact(spark, tmp_path, monkeypatch):
    """A hot cell, ties, null and NaN vectors, other lengths; groups of few rows and queries."""
    from loomgrain.operators import cells

    monkeypatch.setattr(cells, "PART_ROWS", 50)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 4)
    rows = clustered(random.Random(1), 600)
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = df.where("id % 40 = 0 OR id > 598").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    index = CellIndex.build(df, str(tmp_path / "c"), cells=9)
    want = search.vector_topk_batch(df, queries, 5)
    assert sorted(map(tuple, index.search_batch(queries, 5, probes=9).collect())) == sorted(map(tuple, want.collect()))
    assert recall(index.search_batch(queries, 5, probes=2), want) >= 0.9
    cells_of = {r["id"]: r["cell"] for r in index.vectors().collect()}
    assert set(cells_of) == set(range(600)) | {601, 603, 604, 605} and cells_of[601] == OTHER and cells_of[603] == cells_of[0]


def test_only_probed_cells_are_read(spark, tmp_path):
    rows = clustered(random.Random(2), 400)
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    index = CellIndex.build(df, str(tmp_path / "c"), cells=16)
    one = df.where("id = 7").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    plan = index.search_batch(one, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
    assert CellIndex.build(df.limit(0), str(tmp_path / "e")).search_batch(one, 5).collect() == []


def test_cells_of_few_vectors():
    assert len(fitted_cells(np.array([[0.0, 1.0], [0.0, 1.0], [2.0, 2.0]]), 8)) == 2


@pytest.mark.parametrize("query_block", [3, 1024])
def test_many_blocks_of_queries_stay_a_table(spark, query_block):
    """Batch searches with several blocks: same rows as with one, whatever the part sizes."""
    rows = clustered(random.Random(3), 200)
    df = spark.createDataFrame([(k, v, f"text w{k % 7} Word{k % 11}") for k, v in rows], "id long, vector array<float>, document string")
    queries = df.where("id % 20 = 0 OR id > 200").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.array(F.concat(F.lit("WORD"), F.col("id") % 11), F.lit("none"), F.lit("")).alias("words"))
    near = search.vector_topk_batch(df, queries, 4, query_block=query_block, part_rows=30)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, search.vector_topk_batch(df, queries, 4).collect()))
    hits = search.keyword_search_batch(df, queries, 4, query_block=query_block, part_rows=30)
    want = []
    for r in queries.collect():
        own = sorted(k for k, _ in rows if any(w and w.lower() in f"text w{k % 7} word{k % 11}" for w in r["words"]))[:4]
        want += [(r["query_id"], n + 1, k) for n, k in enumerate(own)]
    assert sorted(map(tuple, hits.collect())) == sorted(want)
