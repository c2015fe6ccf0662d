"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_CHECKPOINT = "spark.checkpoint.dir"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; ``sf_dir`` may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the faster ``lower``, which is the same there."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder that every executor and the driver share: ``spark.checkpoint.dir``.

    It is read from the session. Only where it is unset and driver and executors
    are one machine, as in local tests, a folder under the warehouse is used.
    """
    root = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT} to a folder that the driver and all executors share")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    return f"{root.rstrip('/')}/loomgrain-{spark.sparkContext.applicationId}"


#: Applications whose folder is already marked for deletion, and the folders of the scopes that are open.
_marked: set[str] = set()
_scopes: list[str] = []


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder. The application's part of that folder goes when the driver ends."""
    root = scratch_root(spark)
    if root not in _marked:
        fs, path = _filesystem(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(root)
    return "/".join([root, *_scopes, f"{tag}-{uuid.uuid4().hex[:12]}"])


@contextmanager
def discarding(spark: SparkSession, tag: str):
    """Delete the intermediate tables that the block writes when it ends; what is to last is written elsewhere by then."""
    scratch(spark, tag)  # marks the application's folder
    _scopes.append(f"{tag}-{uuid.uuid4().hex[:12]}")
    path = "/".join([scratch_root(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        fs, where = _filesystem(spark, path)
        fs.delete(where, True)


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """Drop the shuffle files of each inner job when it ends.

    Jobs whose result is a written table never read their shuffles again; without
    this they would lie on the executors' disks until the driver collects garbage.
    """
    before = spark.conf.get(_FREE_SHUFFLES, None)
    try:
        spark.conf.set(_FREE_SHUFFLES, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage: a later stage re-reads the table when an executor is
    lost, and the rows cannot change between two uses of the result.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    with freeing_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits in one row of a filter, fixed by ``bitmap_construct_agg``.
_ROW_BITS = 32768


@dataclass
class Filter:
    """Bitmap over hashes of digests, at most 64 MiB, the bound of what is broadcast; a fuller one only lets more through."""

    bits: DataFrame  # _row, _bits
    rows: int

    @staticmethod
    def rows_for(digests: int) -> int:
        """Rows of a filter with 16 bits a digest, within the bound."""
        return min(16_384, 1 << (digests * 16 // _ROW_BITS + 1).bit_length())

    def _slot(self, digest: Column) -> tuple[Column, Column]:
        h = F.xxhash64(digest)
        return F.pmod(h, F.lit(self.rows)), F.pmod(F.shiftrightunsigned(h, 20), F.lit(_ROW_BITS))

    @classmethod
    def of(cls, digests: DataFrame, rows: int, tag: str) -> Filter:
        """The filter of column ``digest``."""
        row, bit = cls(digests, rows)._slot(F.col("digest"))
        marked = digests.select(row.alias("_row"), bit.alias("_bit"))
        return cls(materialise(marked.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits")), tag), rows)

    def also(self, other: Filter) -> Filter:
        """What either filter lets through."""
        return Filter(self.bits.unionByName(other.bits).groupBy("_row").agg(F.bitmap_or_agg("_bits").alias("_bits")), self.rows)

    def probed(self, rows: DataFrame, name: str, digest: str = "digest") -> DataFrame:
        """``rows`` with the boolean ``name``: false where the column ``digest`` surely isn't in the filter."""
        own = f"{name}_{uuid.uuid4().hex[:8]}"
        row, bit = self._slot(F.col(digest))
        bits = self.bits.select(F.col("_row").alias(f"{own}_row"), F.col("_bits").alias(f"{own}_bits"))
        byte = F.conv(F.hex(F.substring(f"{own}_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
        is_set = F.get(F.array(*(byte.cast("int").bitwiseAND(1 << k) != 0 for k in range(8))), F.pmod(bit, F.lit(8)).cast("int"))
        joined = rows.withColumn(f"{own}_at", row).join(F.broadcast(bits), F.col(f"{own}_at") == F.col(f"{own}_row"), "left")
        return joined.withColumn(name, F.coalesce(is_set, F.lit(False))).drop(f"{own}_at", f"{own}_row", f"{own}_bits")


def text_key(*texts: Column) -> Column:
    """MD5 (hex) of texts, nulls and where one ends told apart: rows are decided by what they say, so their identifiers don't matter."""
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in (x.cast("string") for x in texts)]
    return F.md5(F.concat(*parts))


def without(df: DataFrame, key: Column, dropped: DataFrame, tag: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in the one column of ``dropped``, which is a written table.

    Only rows that a filter of the dropped keys lets through are joined with them, so the others aren't shuffled.
    """
    gone = dropped.toDF("digest")
    found = Filter.of(gone, Filter.rows_for(gone.count()), f"{tag}-filter")
    name = f"_key_{uuid.uuid4().hex[:8]}"
    marked = found.probed(df.withColumn(name, key), f"{name}_hit", name)
    maybe = marked.where(F.col(f"{name}_hit"))
    kept = maybe.join(gone, maybe[name] == gone["digest"], "left_anti").unionByName(marked.where(~F.col(f"{name}_hit")))
    return kept.drop(name, f"{name}_hit")


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder so far."""
    fs, path = _filesystem(spark, scratch_root(spark))
    fs.delete(path, True)
