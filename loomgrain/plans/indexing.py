"""Incremental indexing: list, compare with the manifest, read what changed, chunk, embed, and store it with the manifest."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import chunking, index, relations
from loomgrain.operators.embedding import Embedder, embedded
from loomgrain.sources import connectors
from loomgrain.sources import files as fs
from loomgrain.streaming.progress import Progress, ProgressListener, listening


class JobProgress(dict):
    """status, processedFiles and totalChunks of an indexing job, and whose they are."""

    def __init__(self, job: str, workspace: str, **state: object) -> None:
        super().__init__(state)
        self.job, self.workspace = job, workspace


@dataclass
class Indexer:
    """Keeps an index of one folder, the workspace. Running it twice changes nothing the second time.

    The folder's ignore file holds, and then ``patterns``. Packed files are read
    through ``extractors``. ``calls`` bounds the embedder's calls in flight.
    """

    spark: SparkSession
    folder: str
    root: str
    embedder: Embedder
    model: str
    patterns: tuple[str, ...] = ()
    extractors: dict[str, Callable[[bytes], str | None]] = field(default_factory=lambda: dict(connectors.EXTRACTORS))
    calls: int = 4

    @property
    def store(self) -> index.IndexStore:
        return index.IndexStore(self.spark, self.root)

    def manifest(self) -> DataFrame:
        return self.store.manifest(fs.MANIFEST)

    def _embed(self, staged: str, heard: Callable[[Progress], None], tell: Callable[[str, int], None]) -> None:
        """Embed the staged chunks once, whatever reads them, as a stream whose batches are the chunks' files; its progress is that of the job."""
        name = f"embed-{uuid.uuid4().hex}"
        chunks = self.spark.readStream.schema(self.spark.read.parquet(f"{staged}/chunks").schema).option("maxFilesPerTrigger", 8 * self.calls).parquet(f"{staged}/chunks")
        sink = embedded(chunks.coalesce(self.calls), self.embedder).writeStream.queryName(name).format("parquet").option("path", f"{staged}/vectors")
        with listening(self.spark, ProgressListener(heard, (name,))) as listener:
            query = sink.option("checkpointLocation", f"{staged}/embedding").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:
                tell("failed", 0)
                raise
            listener.wait_for(query)

    def run(self, on_progress: Callable[[dict], None] | None = None, every: float = 0.0) -> dict[str, int]:
        """Index what is new, changed or embedded by another model; forget what is gone. Returns counts.

        Paths alone are compared with the manifest; content is read of the files to
        be indexed only. ``on_progress`` is told (``JobProgress``) of status (running, completed or failed), processedFiles
        and totalChunks after each batch of chunks that is embedded, but not more
        often than ``every`` so many seconds, and at the end.
        """
        patterns = (*fs.root_patterns(self.folder), *self.patterns)
        listed = fs.crawl_metadata(self.spark, self.folder, patterns, self.extractors).withColumn("workspace_id", F.lit(self.folder))
        job = uuid.uuid4().hex
        staged = f"{self.root}/staged/{job}"
        listed.write.parquet(f"{staged}/paths")  # listed once, so that one state of the folder is indexed
        listed = self.spark.read.schema(listed.schema).parquet(f"{staged}/paths")
        old = self.manifest()
        wanted = index.needs_indexing(listed.select("workspace_id", "file_path", "mtime"), old, self.model)
        gone = index.stale(old, listed)
        n_files, n_wanted, n_gone = listed.count(), wanted.count(), gone.count()
        if n_wanted or n_gone:
            todo = listed.join(wanted.select("workspace_id", "file_path"), ["workspace_id", "file_path"], "left_semi").withColumnRenamed("workspace_id", "workspaceId")
            todo = fs.with_content(todo.repartition(max(1, min(10_000, n_wanted))), self.extractors)
            chunking.chunks(todo).write.parquet(f"{staged}/chunks")  # parsed once; the total is known before embedding
            cut = self.spark.read.parquet(f"{staged}/chunks")
            total = cut.count()

            def tell(status: str, processed: int) -> None:
                if on_progress:
                    on_progress(JobProgress(job, self.folder, status=status, processedFiles=processed, totalChunks=total))

            told = [0.0]

            def heard(event: Progress) -> None:
                if event.status == "running" and time.monotonic() - told[0] >= every:
                    told[0] = time.monotonic()
                    tell("running", min(event.total, total) * n_files // total if total else n_files)

            self._embed(staged, heard, tell)
            new = self.spark.read.parquet(f"{staged}/vectors")
            keys = lambda df: df.select(F.col("workspace_id").alias("workspaceId"), F.col("file_path").alias("filePath"))
            counts = new.groupBy(F.col("workspaceId").alias("workspace_id"), F.col("filePath").alias("file_path")).agg(F.count("*").cast("int").alias("chunk_count"))
            entries = wanted.join(counts, ["workspace_id", "file_path"], "left").select(
                "workspace_id", "file_path", "mtime", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(self.model).alias("model")
            )
            self.store.replace_files(keys(wanted).unionByName(keys(gone)), new, relations.reference_edges(new), index.upserted(old, entries, gone))
            tell("running", n_files)
            tell("completed", n_files)
        self.store.discard(staged)
        return {"indexed": n_wanted, "removed": n_gone}
