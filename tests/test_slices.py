"""What a task makes of its rows at once is bounded, whatever batches come."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomgrain.operators import cells, search


def test_text_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, "", "é" * 3, "b" * 40, "c", ""])], names=["id", "low"])
    parts = list(search.text_slices(batch, 1, 10))
    assert [p.num_rows for p in parts] == [2, 1, 1, 2]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(search.text_slices(batch.slice(0, 0), 1)) == []


@pytest.mark.parametrize("cells_at_once", [16, 1 << 20])
def test_nearest_in_small_slices(monkeypatch, cells_at_once):
    monkeypatch.setattr(search, "SLICE_CELLS", cells_at_once)
    rng = np.random.default_rng(1)
    own = rng.integers(0, 4, (300, 3)).astype(np.float64)
    asked = own[:9] + 0.25
    one = search.Nearest(list(range(9)), asked, 7)
    one.add(pa.array(range(150)), pa.array(own[:150].tolist()))
    one.add(pa.array(range(150, 300)), pa.array(own[150:].tolist()))
    want = [[(float(d), i) for d, i in sorted(((((v - q) ** 2).sum()).round(6), i) for i, v in enumerate(own))[:7]] for q in asked]
    assert one.best == want


def test_distances_to_cells_are_bounded(monkeypatch):
    monkeypatch.setattr(cells, "SLICE_CELLS", 64)
    sizes, true = [], cells._distances
    monkeypatch.setattr(cells, "_distances", lambda a, b: sizes.append(len(a) * len(b)) or true(a, b))
    rng = np.random.default_rng(2)
    rows = [*rng.random((50, 4)).tolist(), [1.0], *rng.random((50, 4)).tolist()]
    found = cells.nearest_cells(pa.array(rows), rng.random((8, 4)), 3)
    assert len(found) == 101 and (found[50] == cells.OTHER).all() and max(sizes) <= 64


def test_keyword_scan_shuffles_no_texts(spark):
    """Many queries ask for the same words: the words go to the texts, and the results are those of a loop."""
    rng = random.Random(4)
    words = [f"w{k}x" for k in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=5))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, document string")
    queries = [(q, rng.sample(words, 3)) for q in range(1500)]
    found = search.keyword_search_batch(df, spark.createDataFrame(queries, "query_id long, words array<string>"), 4)
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(q, n + 1, i) for q, own in queries for n, i in enumerate([i for i, t in rows if any(w in t for w in own)][:4])]
    assert sorted(map(tuple, found.collect())) == want
