"""Operator 8: exact deduplication through a log-structured merge index. DataFrame functions only.

* *Memtable*: what the map side of a flush combines, one entry a digest and task
  with the identifier that stays and the number of rows, before anything is shuffled.
* *Flush*: each batch becomes a run, Parquet files sorted by digest, with Bloom
  filters and min/max statistics for point lookups, and a bitmap filter of its own.
  Before a batch is flushed its digests are probed against the filters of all runs
  so far, and those that may be there are marked.
* *Compaction*: an entry that no later batch may have met is in one run only and is
  taken over as it is. The others, found by a filter of the marked digests, are
  merged: the smallest (or largest) identifier and the sum of the rows are kept.
* A digest with more than one row is a *hit*. Every hit is verified byte by byte:
  rows of hits are grouped by digest *and text*, which compares the texts
  themselves. If one digest ever stands for several texts, these rows are
  grouped by text instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, freeing_shuffles, lower_ascii, materialise, scratch, without

def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class MergeIndex:
    """Sorted digest runs in a shared folder.

    ``insert`` flushes a batch as a run, ``compact`` merges the runs, ``lookup``
    finds a bounded list of digests through the runs' own filters.
    """

    spark: SparkSession
    path: str
    keep: str = "min"
    filter_rows: int = 1
    n_runs: int = 0
    known: Filter | None = None  # of all runs so far
    met: Filter | None = None  # of the digests of later runs that earlier ones may have

    @classmethod
    def create(cls, spark: SparkSession, keep: str = "min", expected: int = 1_000_000) -> MergeIndex:
        """``expected`` digests size the filters; more make them less selective, not wrong."""
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        return cls(spark, scratch(spark, "digest-runs"), keep, Filter.rows_for(expected))

    def best(self, column: str) -> Column:
        """The identifier that stays. Nulls lose to any other."""
        return F.min(column) if self.keep == "min" else F.max(column)

    def insert(self, entries: DataFrame) -> None:
        """Flush ``entries`` (id, digest) as one more run: digest, keep_id, n and whether an earlier run may have the digest."""
        batch = entries.groupBy("digest").agg(self.best("id").alias("keep_id"), F.count("*").alias("n"))
        batch = self.known.probed(batch, "met") if self.known else batch.withColumn("met", F.lit(False))
        with freeing_shuffles(self.spark):
            (
                batch.sortWithinPartitions("digest")
                .write.option("parquet.bloom.filter.enabled#digest", "true")
                .option("parquet.bloom.filter.expected.ndv#digest", "50000")
                .parquet(f"{self.path}/run={self.n_runs}")
            )
        own = self.spark.read.schema(batch.schema).parquet(f"{self.path}/run={self.n_runs}")
        filled = Filter.of(own, self.filter_rows, "digest-filter")
        met = Filter.of(own.where("met"), self.filter_rows, "digest-met")
        self.known = self.known.also(filled) if self.known else filled
        self.met = self.met.also(met) if self.met else met
        self.n_runs += 1

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def parted(self) -> DataFrame:
        """All runs with ``shared``: false for entries whose digest surely is in one run only."""
        return self.met.probed(self.runs(), "shared")

    def compact(self) -> DataFrame:
        """One row a digest: digest, keep_id, n. Only entries that several runs may share are shuffled."""
        every = self.parted()
        merged = every.where("shared").groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        alone = every.where("NOT shared").select("digest", "keep_id", "n")
        return materialise(merged.unionByName(alone).sortWithinPartitions("digest"), "digest-level1")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Entries of up to 10,000 digests; the literals reach the files' statistics and Bloom filters."""
        if len(digests) > 10_000:
            raise ValueError("more than 10,000 digests: join with runs() instead")
        return self.runs().where(F.col("digest").isin([bytearray(d) for d in digests]))


def _maybe_hit(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose digest may be a hit: all hits and a few others."""
    found = Filter.of(hits, Filter.rows_for(hits.count()), "digest-hits")
    return found.probed(docs, "_hit").where("_hit").drop("_hit")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = sha256,
    memtables: int = 4,
) -> DataFrame:
    """Find rows with equal texts after lower-casing A-Z.

    Returns one row for each row of ``docs``: id_col, keep_id, group_size, kept,
    text_sha256 (hex of the normalised text). Other columns of ``docs`` are not
    read, so their names may clash with these.

    Nulls: a null text counts as empty. A null identifier loses to any other; if
    a group has no other, its rows have a null keep_id and stay.
    Ties and repeated rows: rows that repeat the staying identifier with the same
    text are that document and are all marked kept; they count in group_size.
    Very long texts are hashed and compared whole. Empty tables give no rows. ``digest`` may be replaced in tests by a weak
    function; colliding texts are told apart by their bytes.
    """
    spark = docs.sparkSession
    norm = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))

    # the digests are computed once; batches are dealt by identifier, so that copies are in several runs
    batch = F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int").alias("batch")
    given = scratch(spark, "digests")
    columns = ["id", "digest"] if digest is sha256 else ["id", "digest", sha256(F.col("norm")).alias("sha")]
    rows.select(*columns, batch).write.partitionBy("batch").parquet(given)
    schema = rows.select(*columns).schema.add("batch", "integer")
    entries = spark.read.schema(schema).parquet(given)
    index = MergeIndex.create(spark, keep, docs.count())
    for k in range(memtables):
        index.insert(entries.where(F.col("batch") == k))
    level1 = index.compact()

    # byte verification of the hits: the text itself is a grouping key, combined before the shuffle
    best = index.best("id")
    suspects = _maybe_hit(rows, level1.where("n > 1"))
    texts = suspects.groupBy("digest", "norm").agg(best.alias("keep_id"), F.count("*").alias("n"))
    broken = materialise(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "digest-collisions")

    out = [F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
           F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
           F.lower(F.hex("digest" if digest is sha256 else "sha")).alias("text_sha256")]
    if broken.isEmpty():
        return entries.join(level1, "digest").select(*out)
    clear = entries.join(broken, "digest", "left_anti").join(level1, "digest").select(*out)
    apart = rows.join(broken, "digest", "left_semi")
    groups = apart.groupBy("digest", "norm").agg(best.alias("keep_id"), F.count("*").alias("n"))
    unclear = apart.join(groups, ["digest", "norm"]).withColumn("sha", sha256(F.col("norm"))).select(*out)
    return clear.unionByName(unclear)


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """``docs`` without the copies: one row of each group of equal texts stays, with all its columns.

    A row with a null identifier stays only if its group has no other. Rows that
    repeat the staying identifier with the same text are reduced to one, in a
    further step that runs only if there are such rows.
    """
    found = materialise(exact_dedup(docs, keep=keep), "exact-copies")
    row = lambda ident, sha: F.concat(F.coalesce(ident.cast("string"), F.lit("-")), F.lit(":"), sha)
    sha = F.sha2(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)
    dropped = materialise(found.where("NOT kept").select(row(F.col("doc_id"), F.col("text_sha256"))).distinct(), "exact-dropped")
    stays = without(docs, row(F.col("doc_id"), sha), dropped, "exact")
    again = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if again.isEmpty():
        return stays
    name = f"_sha_{uuid.uuid4().hex[:8]}"
    return stays.withColumn(name, sha).dropDuplicates(["doc_id", name]).drop(name)
