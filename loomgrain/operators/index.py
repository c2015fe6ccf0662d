"""Index lifecycle: manifest differences, upserts, deletes, counts and a Parquet store."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_KEYS = ["workspace_id", "file_path"]
#: Buckets that a change of few files splits at most.
MOST_SPLITS = 4


def needs_indexing(files: DataFrame, manifest: DataFrame, model: str) -> DataFrame:
    """(workspace_id, file_path, mtime, reason): files that are new, newer than their entry or embedded by another model."""
    old = manifest.select(*_KEYS, F.col("mtime").alias("seen"), F.col("model").alias("used"))
    reason = F.when(F.col("seen").isNull(), "new").when(F.col("used") != model, "model").when(F.col("mtime") > F.col("seen"), "modified")
    return files.join(old, _KEYS, "left").withColumn("reason", reason).where("reason IS NOT NULL").select(*_KEYS, "mtime", "reason")


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries whose file is gone."""
    return manifest.join(files.select(*_KEYS), _KEYS, "left_anti").select(*_KEYS)


def upserted(manifest: DataFrame, entries: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The manifest with ``entries`` in place of those of the same file, without ``removed`` ones."""
    kept = manifest.join(entries.select(*_KEYS), _KEYS, "left_anti")
    out = kept.unionByName(entries.select(*manifest.columns))
    return out.join(removed.select(*_KEYS), _KEYS, "left_anti") if removed is not None else out


def without_files(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    """Chunks or edges but those of the ``doomed`` files (workspaceId, filePath)."""
    return rows.join(doomed, ["workspaceId", "filePath"], "left_anti")


@dataclass
class IndexStore:
    """Chunks, edges and the manifest under one folder.

    Rows lie in buckets by a hash of their file, and in those chunks are
    partitioned by vector length and workspace, so a search reads one length and
    the wanted workspaces. There are ``buckets`` of them at least and one for each ``bucket_rows`` chunks: by
    linear hashing, a change that finds more splits a few buckets (``MOST_SPLITS``, or as many as it touches) in two and leaves the others,
    and a store that is empty begins with as many as it needs. A change rewrites the buckets of the files that it
    touches and those that it splits, beside the old ones, a large one as several files, and one pointer for all three tables moves last:
    a run that fails leaves the old state readable. ``vacuum`` deletes what no
    recent pointer names. One writer at a time; a second one fails at the pointer.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    bucket_rows: int = 50_000

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def _pointers(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names(f"{self.root}/pointers") if n.endswith(".json"))

    def state(self, number: int | None = None) -> dict:
        """What the newest pointer, or that of the number, says: for each table its schema and the version that each bucket is in."""
        known = self._pointers()
        if not known:
            return {"number": 0, "buckets": self.buckets, "tables": {}}
        fs, path = self._fs(f"{self.root}/pointers/{(number or known[-1]):012}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _point(self, state: dict) -> None:
        state = state | {"number": state["number"] + 1}
        fs, new = self._fs(f"{self.root}/pointers/{uuid.uuid4().hex}.new")
        out = fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, place = self._fs(f"{self.root}/pointers/{state['number']:012}.json")
        if fs.exists(place) or not fs.rename(new, place):
            fs.delete(new, False)
            raise RuntimeError("another writer has changed the index")

    def _read(self, name: str, state: dict, only: list[int] | None = None, keep_bucket: bool = False) -> DataFrame | None:
        known = state["tables"].get(name)
        if known is None:
            return None
        schema = StructType.fromJson(known["schema"])
        parts: dict[str, list[str]] = {}
        for bucket, version in known["parts"].items():
            if only is None or int(bucket) in only:
                parts.setdefault(version, []).append(f"{self.root}/{name}/{version}/_bucket={bucket}")
        out = None
        for version, paths in sorted(parts.items()):
            some = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}/{version}").parquet(*paths)
            out = some if out is None else out.unionByName(some)
        out = out if out is not None else self.spark.createDataFrame([], schema)
        return out if keep_bucket else out.drop("_bucket")

    def _bucket(self, workspace: str, path: str, buckets: int) -> Column:
        """Linear hashing: the buckets from the largest power of two on are halves of those so many places before."""
        level = 1 << (buckets.bit_length() - 1)
        fine, coarse = (F.pmod(F.xxhash64(workspace, path), F.lit(n)) for n in (2 * level, level))
        return F.when(fine < buckets, fine).otherwise(coarse).cast("int").alias("_bucket")

    def _grown(self, state: dict, rows: int, touched: int) -> tuple[int, list[int]]:
        """How many buckets there are for so many chunks, and which of the old ones are split for it."""
        now, wanted = state["buckets"], -(-rows // self.bucket_rows)
        if not any(t["parts"] for t in state["tables"].values()):
            return max(now, self.buckets, wanted), []
        most = now + max(MOST_SPLITS, touched)
        split = [n - (1 << (n.bit_length() - 1)) for n in range(now, max(now, min(wanted, most)))]
        return now + len(split), sorted({b for b in split if b < now})

    def _replaced(self, name: str, state: dict, doomed: DataFrame, touched: list[int], new: DataFrame, by: list[str]) -> dict:
        """The table's entry in the pointer after a rewrite of the touched buckets."""
        old = self._read(name, state, touched)
        rows = without_files(old, doomed).unionByName(new.select(*old.columns)) if old is not None else new
        rows = rows.withColumn("_bucket", self._bucket("workspaceId", "filePath", state["buckets"]))
        version = uuid.uuid4().hex
        rows.hint("rebalance", "_bucket", *by).write.partitionBy("_bucket", *by).parquet(f"{self.root}/{name}/{version}")
        parts = {b: v for b, v in state["tables"].get(name, {"parts": {}})["parts"].items() if int(b) not in touched}
        parts |= {n.split("=")[1]: version for n in self._names(f"{self.root}/{name}/{version}") if n.startswith("_bucket=")}
        return {"schema": rows.schema.jsonValue(), "parts": parts}

    def chunks(self) -> DataFrame | None:
        return self._read("chunks", self.state())

    def edges(self) -> DataFrame | None:
        return self._read("edges", self.state())

    def manifest(self, schema: StructType) -> DataFrame:
        version = self.state().get("manifest")
        return self.spark.read.schema(schema).parquet(version) if version else self.spark.createDataFrame([], schema)

    def replace_files(self, doomed: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, manifest: DataFrame | None = None) -> None:
        """Delete the rows of ``doomed`` files, append the new ones and take over the manifest, all at once."""
        state = self.state()
        new = chunks.withColumn("dim", F.size("vector"))
        # the new chunks are cut here only to be counted by file, and once more to be written; what is asked below is asked of these few columns
        path = f"{self.root}/counts/{uuid.uuid4().hex}"
        new.groupBy("workspaceId", "filePath").count().unionByName(doomed.select("workspaceId", "filePath", F.lit(0).cast("long").alias("count"))).write.parquet(path)
        keys = self.spark.read.schema(StructType([*new.select("workspaceId", "filePath").schema.fields, StructField("count", LongType())])).parquet(path)
        places = lambda n: [r[0] for r in keys.select(self._bucket("workspaceId", "filePath", n)).distinct().collect()]  # noqa: E731  at most as many as there are buckets
        touched, counts = places(state["buckets"]), state.get("rows", {})
        buckets, split = self._grown(state, sum(counts.values()) + (keys.agg(F.sum("count")).first()[0] or 0), len(touched))
        if buckets != state["buckets"]:
            touched = sorted({*places(buckets), *split})
            state = state | {"buckets": buckets}
        tables = dict(state["tables"])
        if touched:
            tables["chunks"] = self._replaced("chunks", state, doomed, touched, new, ["dim", "workspaceId"])
            if edges is not None:
                tables["edges"] = self._replaced("edges", state, doomed, touched, edges, ["workspaceId"])
            elif split and "edges" in tables:  # buckets of both tables are split together
                old = self._read("edges", state, split)
                tables["edges"] = self._replaced("edges", state, doomed.limit(0), split, old.limit(0), ["workspaceId"])
            state = state | {"tables": tables}
            rows = self._read("chunks", state, [*touched, *range(state["buckets"] - len(split), state["buckets"])], keep_bucket=True)
            found = {str(r["_bucket"]): r["count"] for r in rows.groupBy("_bucket").count().collect()} if rows is not None else {}
            state["rows"] = {b: n for b, n in counts.items() if int(b) not in touched} | found
        if manifest is not None:
            state["manifest"] = f"{self.root}/manifest/{uuid.uuid4().hex}"
            manifest.write.parquet(state["manifest"])
        self._point(state)
        self.discard(path)

    def reset(self) -> None:
        """Forget all chunks, edges and manifest entries; the schemas stay. Files stay until ``vacuum``."""
        state = self.state()
        tables = {name: t | {"parts": {}} for name, t in state["tables"].items()}
        self._point({k: v for k, v in state.items() if k not in ("manifest", "rows")} | {"tables": tables})

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions and pointers that none of the newest ``keep`` pointers need; returns how many versions went."""
        known = self._pointers()
        kept = known[-max(1, keep):]
        used = set()
        for number in kept:
            state = self.state(number)
            used |= {v for t in state["tables"].values() for v in t["parts"].values()} | {state.get("manifest", "").rsplit("/", 1)[-1]}
        gone = 0
        for name in ("chunks", "edges", "manifest"):
            for version in self._names(f"{self.root}/{name}"):
                if version not in used:
                    fs, path = self._fs(f"{self.root}/{name}/{version}")
                    gone += bool(fs.delete(path, True))
        for number in known[: -len(kept)] if kept else []:
            fs, path = self._fs(f"{self.root}/pointers/{number:012}.json")
            fs.delete(path, False)
        return gone

    def discard(self, path: str) -> None:
        """Delete a folder of intermediate tables."""
        fs, where = self._fs(path)
        fs.delete(where, True)

    def count(self) -> int:
        chunks = self.chunks()
        return 0 if chunks is None else chunks.count()


def progress(chunk_counts: DataFrame) -> DataFrame:
    """``chunk_counts`` (file_path, n) with the chunks and files done after each file, in the order of paths, and the files' share by chunks.

    Sums run within a folder, and those of the folders before it are added.
    """
    folder = F.regexp_extract("file_path", r"(?s)\A(.*/)?", 0)
    rows = chunk_counts.withColumn("_folder", folder)
    sums = rows.groupBy("_folder").agg(F.sum("n").alias("_chunks"), F.count("*").alias("_files"))
    before = Window.orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)  # one row a folder
    sums = sums.select(F.col("_folder").alias("_of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_chunks", "_files")])
    w = Window.partitionBy("_folder").orderBy("file_path")
    done = rows.withColumns({"_c": F.sum("n").over(w), "_f": F.row_number().over(w)}).join(sums, F.col("_folder") == F.col("_of"))
    totals = chunk_counts.agg(F.sum("n").alias("all_chunks"), F.count("*").alias("all_files"))
    done = done.select("file_path", "n", (F.col("_chunks_before") + F.col("_c")).alias("chunks_done"), (F.col("_files_before") + F.col("_f")).alias("files_done"))
    share = F.expr("CASE WHEN all_chunks > 0 THEN chunks_done * all_files DIV all_chunks ELSE all_files END")
    return done.crossJoin(F.broadcast(totals)).withColumn("processed_files", share)  # one row of totals


def percent_done(done: int | None, total: int | None, least: int = 5) -> int:
    """What a progress bar shows: a rounded percentage, at least ``least`` so that something moves."""
    return max(least, math.floor(100 * done / total + 0.5) if done and total else 0)
