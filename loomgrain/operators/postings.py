"""An inverted index for BM25: posting blocks by term with block maxima, and exact top-k that skips blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.functions.vectors import DIGITS
from loomgrain.operators.search import BETWEEN, text_slices
from loomgrain.sources.shared import shared_folder

#: Texts of a shard, and so postings of a block at most, about; and postings of a term that each task marks as its best.
BLOCK, LEADS = 128, 64
#: Postings that one task sorts, about; postings of a bucket of terms, about; and most buckets.
SLICE_POSTINGS, BUCKET_POSTINGS, MOST_BUCKETS = 4 << 20, 1 << 20, 1024
#: Postings that a task of a batch search holds, about.
PART_POSTINGS = 4 << 20
#: Most terms of one search that are given to the scan as a list.
MOST_LISTED = 1000


def _terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each once, of ``queries`` (query_id, words)."""
    return queries.select("query_id", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term")).where("term <> ''")


def _blocks(kind: str) -> str:
    return f"_bucket int, term string, shard long, most double, lead boolean, postings array<struct<id:{kind},tf:int,n:int>>"


class _Part:
    """Postings of some texts by term, which queries are scored against; made from blocks (term, id, tf, n), whose last three are lists."""

    def __init__(self, blocks: list[pa.RecordBatch], k1: float, b: float, mean: float) -> None:
        if not blocks:
            self.terms, self.ids = {}, pa.array([], pa.int64())
            return
        own = pa.Table.from_batches(blocks).sort_by("term").combine_chunks().to_batches()[0]
        terms, ends = own.column("term").dictionary_encode(), np.cumsum(pc.list_value_length(own.column("id")).to_numpy().astype(np.int64))
        ids, tf, n = (own.column(c).flatten() for c in ("id", "tf", "n"))
        last = np.append(np.flatnonzero(np.diff(terms.indices.to_numpy())), len(terms) - 1)
        stops = ends[last].tolist()
        self.terms = dict(zip(terms.dictionary.to_pylist(), zip([0, *stops[:-1]], stops, strict=True), strict=True))
        tf, n = tf.to_numpy(), n.to_numpy()
        self.weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
        every = ids.unique()
        self.ids = every.take(pc.sort_indices(every))  # places are in the order of identifiers
        self.place = pc.index_in(ids, value_set=self.ids).to_numpy()

    def best(self, queries: list[list[dict]], k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """The numbers of queries, and places and scores of the k best texts of each."""
        rows, places, scores = [], [], []
        for row, own in enumerate(queries):
            total = np.zeros(len(self.ids))
            for lo, hi, idf in ((*self.terms[t["term"]], t["idf"]) for t in own if t["term"] in self.terms):
                total[self.place[lo:hi]] += idf * self.weight[lo:hi]  # a term has a text once
            least = np.partition(total, len(total) - k)[len(total) - k] if len(total) > k else 0.0
            near = np.flatnonzero((total > 0) & (total >= least - 1e-5))
            value = total[near].round(DIGITS)
            first = np.lexsort((near, -value))[:k]
            rows.append(np.full(len(first), row))
            places.append(near[first])
            scores.append(value[first])
        return tuple(pa.array(np.concatenate([np.empty(0, t), *x]), kind) for x, t, kind in ((rows, np.int64, pa.int64()), (places, np.int64, pa.int64()), (scores, float, pa.float64())))


class PostingIndex:
    """Postings of a corpus below a folder, written once by ``build`` and opened by its path.

    Identifiers are hashed to shards of about ``BLOCK`` texts. blocks (_bucket, term, shard, most, lead, postings): the
    postings (id, tf, n) of a term in a shard and the largest weight of one of them; terms (_bucket, term, df).
    Files are sorted by term inside buckets of terms, so a search reads the
    buckets, files and row groups of its terms. A hot term is spread over several tasks and files.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.docs, self.mean, self.k1, self.b, self.buckets = (about[x] for x in ("docs", "mean", "k1", "b", "buckets"))
        self.kind = about["id"]
        self.schemas = {"blocks": _blocks(self.kind), "terms": "_bucket int, term string, df long"}

    @classmethod
    def build(cls, chunks: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, id_col: str = "id", text_col: str = "document", buckets: int | None = None) -> PostingIndex:
        """Index ``chunks`` below ``path``: terms are counted where the text is, and only (term, id, count, length) is shuffled, once.

        ``buckets``: by the number of postings, if not given. A null text has no terms but counts as a text; rows with a null identifier are left out; an identifier should be there once.
        """
        spark, kind = chunks.sparkSession, dict(chunks.dtypes)[id_col]
        rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.lower(text_col), F.lit("")).alias("low"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in text_slices(whole, 1)):
                lists = pc.split_pattern_regex(batch.column(1), BETWEEN)
                words = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                which = words.indices.to_numpy().astype(np.int64)
                real = (pc.binary_length(words.dictionary).to_numpy() > 0)[which]  # a text may begin or end with marks
                row, which = row[real], which[real]
                n = np.bincount(row, minlength=batch.num_rows)
                pairs, tf = np.unique(row * max(1, len(words.dictionary)) + which, return_counts=True)
                row, which = pairs // max(1, len(words.dictionary)), pairs % max(1, len(words.dictionary))
                columns = [words.dictionary.take(pa.array(which)), batch.column(0).take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(n[row], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, batch.column(0).type), pa.array([batch.num_rows], pa.int32()), pa.array([int(n.sum())], pa.int32())], names=names)

        names = ["term", "id", "tf", "n"]
        rows.mapInArrow(count, f"term string, id {kind}, tf int, n int").write.parquet(f"{path}/counted")
        counted = spark.read.parquet(f"{path}/counted")
        docs, words, postings = counted.agg(F.sum(F.when(F.col("term").isNull(), F.col("tf"))), F.sum(F.when(F.col("term").isNull(), F.col("n"))), F.count("term")).first()
        buckets = buckets or max(1, min(MOST_BUCKETS, -(-postings // BUCKET_POSTINGS)))
        docs, mean = docs or 0, (words or 0) / docs if docs else 0.0
        about = json.dumps({"docs": docs, "mean": mean, "k1": k1, "b": b, "buckets": buckets, "id": kind})
        slices = -(-postings // (SLICE_POSTINGS * buckets)) or 1
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("_bucket")
        shard = F.pmod(F.xxhash64("id"), F.lit(docs // BLOCK or 1)).alias("shard")
        placed = counted.where("term IS NOT NULL").select(bucket, shard, *names).withColumn("_slice", F.pmod(F.xxhash64("term", "shard"), F.lit(slices)))
        placed = placed.repartition(max(1, min(buckets * slices, -(-postings // 100_000))), "_bucket", "_slice").sortWithinPartitions("_bucket", "term", "shard", "id")

        def packed(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
            """Blocks of whole terms, which stand together and are sorted by shard."""
            own = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            term = own.column("term").dictionary_encode().indices.to_numpy()
            shard, tf, n = (own.column(c).to_numpy() for c in ("shard", "tf", "n"))
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
            first = np.concatenate([[0], np.flatnonzero((np.diff(term) != 0) | (np.diff(shard) != 0)) + 1])
            sizes, most, of = np.diff(first, append=len(tf)), np.maximum.reduceat(weight, first), term[first]
            order = np.lexsort((-most, of))
            before = np.cumsum(sizes[order]) - sizes[order]
            begins = np.concatenate([[True], np.diff(of[order]) != 0])
            lead = np.zeros(len(first), bool)
            lead[order] = before - np.maximum.accumulate(np.where(begins, before, 0)) < LEADS
            items = pa.StructArray.from_arrays([own.column(c) for c in ("id", "tf", "n")], ["id", "tf", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(tf)), pa.int32()), items)
            at = pa.array(first)
            return pa.RecordBatch.from_arrays([own.column("_bucket").take(at), own.column("term").take(at), pa.array(shard[first]), pa.array(most), pa.array(lead), lists], names=["_bucket", "term", "shard", "most", "lead", "postings"])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[pa.RecordBatch] = []  # whole terms before, and the open one
            for batch in batches:
                if not batch.num_rows:
                    continue
                term = batch.column("term")
                codes = term.dictionary_encode().indices.to_numpy()
                last = int(np.flatnonzero(np.diff(codes, prepend=-1))[-1])  # where the last term begins
                if last or (waiting and waiting[-1].column("term")[0].as_py() != term[0].as_py()):
                    done = [*waiting, batch.slice(0, last)] if last else waiting
                    yield packed(done)
                    waiting = [batch.slice(last)]
                else:
                    waiting.append(batch)
            if waiting:
                yield packed(waiting)

        blocks = placed.select("_bucket", "term", "shard", "id", "tf", "n").mapInArrow(block, _blocks(kind))
        blocks.write.partitionBy("_bucket").parquet(f"{path}/blocks")
        written = spark.read.schema(_blocks(kind)).parquet(f"{path}/blocks")
        terms = written.groupBy("_bucket", "term").agg(F.sum(F.size("postings")).alias("df"))
        terms.repartition("_bucket").sortWithinPartitions("_bucket", "term").write.partitionBy("_bucket").parquet(f"{path}/terms")
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/counted")
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        return cls(spark, path)

    def _read(self, name: str, terms: DataFrame | Sequence[str]) -> DataFrame:
        """Rows of ``name`` for the given terms: a short list is a filter of the scan, a table is joined by bucket and term."""
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        if isinstance(terms, DataFrame):
            return rows
        at = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket()).distinct().collect()] if terms else []
        return rows.where(F.col("_bucket").isin(at) & F.col("term").isin(list(terms)))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("_bucket")

    def search(self, words: Sequence[str], k: int) -> DataFrame:
        """(rank, id, score): the k best texts for the words of one query."""
        own = list(dict.fromkeys(w.lower() for w in words if w))
        queries = self.spark.createDataFrame([(0, own)], "query_id long, words array<string>")
        return self._best(_terms(queries), own if len(own) <= MOST_LISTED else queries, k).drop("query_id")

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, score): for each row of ``queries`` (query_id, words) the k texts of the highest BM25 score, ties by identifier.

        Texts without any of the words are none. Shards are put together to parts of a bounded number of postings of
        words that are asked for, and each part meets every query: a task holds the postings of one part, queries
        stream past them, and only the k best of a query and part are shuffled on. So postings that a query meets
        are added up in memory and never written, and no more than the index is shuffled.
        """
        idf = F.log(1 + (F.lit(self.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        own = _terms(queries).withColumn("_bucket", self._bucket()).join(self._read("terms", queries), ["_bucket", "term"])
        path = shared_folder(self.spark, "asked")
        own.select("query_id", "_bucket", "term", "df", idf.alias("idf")).write.parquet(path)
        kind = dict(queries.dtypes)["query_id"]
        own = self.spark.read.schema(f"query_id {kind}, _bucket int, term string, df long, idf double").parquet(path)
        asked = own.select("_bucket", "term", "df").distinct()
        total = asked.agg(F.sum("df")).first()[0] or 0
        parts = max(1, -(-total // PART_POSTINGS), min(16, -(-4 * total // PART_POSTINGS)))  # some tasks for a small index too
        met = self._read("blocks", queries).join(asked.select("_bucket", "term"), ["_bucket", "term"])
        part = F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part")
        columns = {"id": f"array<{self.kind}>", "tf": "array<int>", "n": "array<int>"}
        met = met.select(part, F.lit(None).cast(kind).alias("query_id"), F.lit(None).cast("array<struct<term:string,idf:double>>").alias("terms"), "term", *(F.col(f"postings.{c}").alias(c) for c in columns))
        every = own.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
        every = every.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", "terms", F.lit(None).cast("string").alias("term"), *(F.lit(None).cast(t).alias(c) for c, t in columns.items()))
        dealt = met.unionByName(every).repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("terms").isNotNull())
        k1, b, mean = self.k1, self.b, self.mean

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, held = [], None
            for batch in batches:
                question = pc.is_valid(batch.column("terms")).to_numpy(zero_copy_only=False)
                first = int(question.argmax()) if question.any() else batch.num_rows
                if first:
                    waiting.append(batch.select(["term", *columns]).slice(0, first))
                if first == batch.num_rows:
                    continue
                if held is None:
                    held, waiting = _Part(waiting, k1, b, mean), []
                asks = batch.select(["query_id", "terms"]).slice(first)
                for at in range(0, asks.num_rows, 1000):
                    some = asks.slice(at, 1000)
                    row, places, scores = held.best(some.column(1).to_pylist(), k)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(row), held.ids.take(places) if len(places) else pa.nulls(0, ident), scores], names=["query_id", "id", "score"])

        ident = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[self.kind]
        found = dealt.select("query_id", "terms", "term", *columns).mapInArrow(score, f"query_id {kind}, id {self.kind}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def _best(self, wanted: DataFrame, listed: DataFrame | Sequence[str], k: int) -> DataFrame:
        idf = F.log(1 + (F.lit(self.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        keyed = wanted.withColumn("_bucket", self._bucket())
        own = keyed.join(self._read("terms", listed), ["_bucket", "term"]).select("query_id", "_bucket", "term", idf.alias("idf"))

        def summed(blocks: DataFrame) -> DataFrame:
            p = blocks.select("query_id", "idf", F.explode("postings").alias("p")).select("query_id", "idf", "p.*")
            weight = F.col("idf") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("n") / self.mean))
            return p.groupBy("query_id", "id").agg(F.round(F.sum(weight), DIGITS).alias("score"))

        def first(scored: DataFrame) -> DataFrame:
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
            return scored.withColumn("rank", rank).where(F.col("rank") <= k)

        blocks = self._read("blocks", listed)
        least = first(summed(own.join(blocks.where("lead"), ["_bucket", "term"]))).where(F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("least"))
        met = own.join(blocks, ["_bucket", "term"])
        shards = met.groupBy("query_id", "shard").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        shards = shards.join(least, F.col("query_id") == F.col("_query"), "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-5)
        return first(summed(met.join(shards.select("query_id", "shard"), ["query_id", "shard"]))).select("query_id", "rank", "id", "score")
