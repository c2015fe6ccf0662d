"""Approximate nearest neighbours: k-means cells, every vector in the partition of its cell, several cells probed a query."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.operators.search import QUERY_BLOCK, SLICE_CELLS, nearest_blocks

#: Vectors that the cells are fitted on, at most, and the most bytes of these; most cells.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CELLS = 16_384, 64 << 20, 4096
#: Rows of a cell that meet a block of queries in one group.
PART_ROWS = 32_768
#: The cell of vectors of another length than the index's; queries of another length search it.
OTHER = -1


def fitted_cells(vectors: np.ndarray, cells: int, seed: int = 42, rounds: int = 15) -> np.ndarray:
    """Centres of ``cells`` clusters by Lloyd's iteration from seeded rows; a cluster that loses all rows takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    vectors = np.unique(vectors, axis=0)
    cells = min(cells, len(vectors))
    centres = vectors[rng.choice(len(vectors), cells, replace=False)].astype(np.float64)
    for _ in range(rounds):
        far = _distances(vectors, centres)
        own = far.argmin(axis=1)
        counts = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        worst = np.argsort(-far[np.arange(len(vectors)), own], kind="stable")
        for n, empty in enumerate(np.flatnonzero(counts == 0)):
            new[empty] = vectors[worst[n]]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def probes_for(vectors: np.ndarray, centres: np.ndarray, recall: float, k: int = 10, queries: int = 256) -> int:
    """How many cells a search probes to find the share ``recall`` of the k nearest, as some of ``vectors`` tell when searched among all of them."""
    some = vectors[:queries]
    near = np.argsort(_distances(some, vectors), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(_distances(some, centres), axis=1, kind="stable"), axis=1)  # of each cell for each query
    own = _distances(vectors, centres).argmin(axis=1)
    return 1 + int(np.quantile(np.take_along_axis(place, own[near], axis=1), recall, method="higher"))


class CellIndex:
    """Vectors below a folder by cell, written once by ``build`` and opened by its path.

    The cells are fitted on a bounded sample (``SAMPLE_ROWS`` rows of the least hashes); every row is put in the cell of the
    nearest centre and written to its partition, large cells as several files. A search reads only the cells that it probes.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.centres, self.kinds, self.probes = np.array(about["centres"], np.float64), about["kinds"], about["probes"]

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None, id_col: str = "id", vector_col: str = "vector", seed: int = 42, recall: float = 0.96) -> CellIndex:
        """Index (id, vector) of ``chunks`` below ``path``. The commonest length of vectors in the sample is the index's; rows without a vector are left out.

        ``cells``: as many as the root of the number of rows, if not given, and at most ``MOST_CELLS``.
        A search probes as many cells as find the share ``recall`` of the neighbours within the sample.
        """
        spark = chunks.sparkSession
        rows = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x))")
        lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()  # one row a length
        size, total = (lengths["n"], lengths["count"]) if lengths else (0, 0)
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * max(1, size))))
        sample = rows.where(F.size("vector") == size).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("vector").collect()
        wanted = min(MOST_CELLS, cells or math.ceil(math.sqrt(total)) or 1)
        matrix = np.array([r[0] for r in sample], np.float64).reshape(len(sample), size)
        centres = fitted_cells(matrix, wanted, seed) if sample and size else np.zeros((0, 0))
        probes = probes_for(matrix, centres, recall) if len(centres) else 1

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("cell", pa.array(nearest_cells(batch.column(1), centres, 1)[:, 0].astype(np.int32)))

        placed = rows.mapInArrow(assign, f"id {dict(rows.dtypes)['id']}, vector array<float>, cell int")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        about = json.dumps({"centres": centres.tolist(), "probes": probes, "kinds": {"id": dict(rows.dtypes)["id"]}})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")
        return cls(spark, path)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.kinds['id']}, vector array<float>, cell int").parquet(f"{self.path}/vectors")

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, distance): for each row of ``queries`` (query_id, query) the k nearest of the vectors in its ``probes`` nearest cells (as fitted, if not given).

        Queries and rows of a cell meet in groups of a bounded number of both, so a
        hot cell is many groups. With as many probes as cells the result is exact.
        """
        centres, kind = self.centres, dict(queries.dtypes)["query_id"]
        probes = min(probes or self.probes, max(1, len(centres)))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = nearest_cells(batch.column(1), centres, probes)
                row = np.repeat(np.arange(batch.num_rows), probes)
                kept = np.ones((batch.num_rows, probes), bool)
                kept[:, 1:] = cells[:, 1:] != OTHER  # that one is searched once
                row, cells = row[kept.ravel()], cells[kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cells.astype(np.int32))], names=["query_id", "query", "cell"])

        whole = "query IS NOT NULL AND NOT exists(query, x -> x IS NULL OR isnan(x))"
        asked = queries.select("query_id", F.col("query").cast("array<float>").alias("query")).where(whole).mapInArrow(ask, f"query_id {kind}, query array<float>, cell int")
        busy = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # at most one row a cell
        vectors = self.vectors().where(F.col("cell").isin(list(busy)))
        held = {r["cell"]: r["count"] for r in vectors.groupBy("cell").count().collect()}
        sides = [(c, -(-busy[c] // QUERY_BLOCK), -(-held[c] // PART_ROWS)) for c in held]
        plan = F.broadcast(self.spark.createDataFrame(sides, "cell int, blocks int, parts int"))  # at most one row a cell
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = asked.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", numbers("parts"))
        some = vectors.join(plan, "cell").withColumn("part", F.pmod(F.monotonically_increasing_id(), "parts").cast("int")).withColumn("block", numbers("blocks"))

        def near(key: tuple, own: pa.Table, rows: pa.Table) -> pa.Table:
            found = nearest_blocks(own.column("query_id").to_pylist(), own.column("query").to_pylist(), k)
            for batch in rows.select(["id", "vector"]).to_batches(max_chunksize=10_000):
                for one in found:
                    one.add(batch.column(0), batch.column(1))
            parts = [one.rows() for one in found]
            types = [own.schema.field("query_id").type, rows.schema.field("id").type, pa.float64()]
            return pa.table([pa.array([x for p in parts for x in p[c]], t) for c, t in enumerate(types)], ["query_id", "id", "distance"])

        keys = ["cell", "block", "part"]
        found = own.select(*keys, "query_id", "query").groupBy(*keys).cogroup(some.select(*keys, "id", "vector").groupBy(*keys))
        found = found.applyInArrow(near, f"query_id {kind}, id {self.kinds['id']}, distance double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest_cells(vectors: pa.Array, centres: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centres of each vector, nearest first; ``OTHER`` for vectors of another length."""
    out = np.full((len(vectors), probes), OTHER, np.int64)
    if not len(centres) or not len(vectors):
        return out
    most = max(1, SLICE_CELLS // len(centres))  # distances to all centres, so many at once
    if len(vectors) > most:
        return np.concatenate([nearest_cells(vectors.slice(at, most), centres, probes) for at in range(0, len(vectors), most)])
    fits = np.flatnonzero(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False) == centres.shape[1])
    if len(fits):
        own = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
        far = _distances(own, centres)
        out[fits] = np.argsort(far, axis=1, kind="stable")[:, :probes]
    return out
