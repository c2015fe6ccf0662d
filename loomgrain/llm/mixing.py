"""Operator 2: mixing sources to target weights by Sainte-Lague apportionment.

A source's target is met by whole passes over its documents and equal-token
blocks for the rest. The blocks are apportioned to the sources by highest
quotients, then each source's blocks to its shards, which gives an integer quota
for each shard. A shard's documents lie in a seeded order, and its first blocks
up to the quota are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Source tables up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


def sainte_lague(cells: DataFrame, group: list[str]) -> DataFrame:
    """``cells`` with integer ``seats``: in each group, ``total`` seats shared among ``votes`` >= 0.

    ``cells`` has the group columns, ``idx`` (breaks ties, lowest first), votes and
    total (the same in a group). Seats go to the highest quotients
    votes / (2 * seats + 1). Instead of all quotients, only those around the
    common divisor are made: each cell starts with its rounded share, which is
    off by at most half a seat a cell, and the few quotients that the correction
    can reach decide. Sums are combined before they are shuffled, and quotients are
    ranked by ranges, so that a group of very many cells is in no single task.
    """
    names = cells.columns
    cells = materialise(cells if group else cells.withColumn("_all", F.lit(0)), "mix-cells")
    by = group or ["_all"]
    v, n = F.col("votes"), F.col("total")
    sums = materialise(cells.groupBy(*by).agg(F.sum("votes").alias("_v"), F.count("*").alias("_s")), "mix-votes")
    base = F.when((F.col("_v") > 0) & (n > 0), F.floor(v * n / F.col("_v") + 0.5)).otherwise(0).cast("long")
    start = materialise(cells.join(sums, by).withColumn("_base", base), "mix-bases")
    dealt = materialise(start.groupBy(*by).agg(F.sum("_base").alias("_dealt")), "mix-dealt")
    start = start.join(dealt, by).withColumn("_diff", F.when(F.col("_v") > 0, n - F.col("_dealt")).otherwise(0))
    # a cell of share x can gain or lose at most 1.5 * x * cells + 1 seats in the correction
    reach = (F.floor(1.5 * F.col("_s") * v / F.col("_v")) + 2).cast("long")
    more = F.sequence(F.col("_base"), F.col("_base") + reach - 1)
    fewer = F.when(F.col("_base") > 0, F.sequence(F.greatest(F.col("_base") - reach, F.lit(0)), F.col("_base") - 1))
    moves = start.where("_diff <> 0 AND votes > 0").withColumn("_k", F.explode(F.when(F.col("_diff") > 0, more).otherwise(fewer)))
    quotient = v / (2 * F.col("_k") + 1)
    order = [F.when(F.col("_diff") > 0, -quotient).otherwise(quotient), F.when(F.col("_diff") > 0, F.col("idx")).otherwise(-F.col("idx")), F.col("_k")]
    lined = materialise(ranked(moves.select(*by, "idx", "votes", "_diff", "_k"), [*map(F.col, by), *order], "mix-quotients", "_place"), "mix-lined")
    firsts = lined.groupBy(*by).agg(F.min("_place").alias("_first"))
    chosen = lined.join(firsts, by).where(F.col("_place") - F.col("_first") < F.abs("_diff"))
    change = chosen.groupBy(*by, "idx").agg(F.sum(F.signum("_diff")).cast("long").alias("_change"))
    out = start.join(change, [*by, "idx"], "left")
    return out.select(*names, (F.col("_base") + F.coalesce("_change", F.lit(0))).alias("seats"))


def ranked(df: DataFrame, order: list, tag: str, name: str = "idx") -> DataFrame:
    """``df`` with ``name``, its 0-based rank in the given order, without one task that sorts all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), tag)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are partitions
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_nth", nth).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_n", "_before", "_nth")


def target_level(sources: DataFrame, total: float, most: float) -> float:
    """The level l at which sum(min(most * size, l * weight)) is ``total``: excess above a cap is reshared by weight."""
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("source_size") * most < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size") * most)), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if not row["free"]:
            return math.inf if level is None else level
        new = (total - row["caps"]) / row["free"]
        if new == level:
            return level
        level = new


def _each_copy(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """``rows`` as often as ``copies`` says, numbered from 0 by ``copy``; very many copies are dealt to the tasks in blocks."""
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = rows.where(F.col("copies") <= block).withColumn("copy", F.explode(span(F.col("copies"))))
    many = rows.where(F.col("copies") > block).withColumn("_at", F.explode(span(F.ceil(F.col("copies") / block)))).repartition(F.col("key"), F.col("_at"))
    many = many.withColumn("copy", F.explode(F.sequence(F.col("_at") * block, F.least((F.col("_at") + 1) * block, "copies") - 1))).drop("_at")
    return few.unionByName(many)


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    block_tokens: int = 16,
    shard_rows: int = 5000,
    seed: int = 42,
) -> DataFrame:
    """What a mix of ``share`` times all words takes from each document.

    Returns one row for each row of ``docs`` (doc_id, source, text): doc_id, size
    (words), source_size, target (of the source), taken (words, repeats counted),
    repeats (whole passes) and extra_words (taken from the start in a further pass).

    Sources in code-point order, null last, get ``weights`` in turn; no target
    exceeds ``most`` times its source's size and no document is taken more often
    than that. Nulls: a null text has no words, null sources form one source,
    null doc_ids are ordered by text. Ties and repeated rows: rows equal in all
    of doc_id, source and text are interchangeable, so reruns give the same rows.
    Very long texts are counted whole; one larger than a quota is taken in part. Empty tables give no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), text)
    rows = materialise(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(name).alias("key")), "mix-sizes")

    # rows that are equal in all columns are one row with a count, so that they need not share a task
    rows = rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    rows = materialise(rows, "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("copies").alias("n"))
    sources = ranked(sums, [F.col("source").isNull(), F.col("source")], "mix-sources")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialise(sources.withColumn("weight", F.get(turn, F.pmod("idx", F.lit(len(weights))).cast("int"))), "mix-weights")
    count, words, n_rows = sources.agg(F.count("*"), F.sum("source_size"), F.sum("n")).first()
    level = target_level(sources, share * (words or 0), most)
    cap = F.col("source_size") * F.lit(most)
    target = F.when(cap < F.lit(level) * F.col("weight"), cap).otherwise(F.lit(level) * F.col("weight"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("target", target).withColumn("passes", passes).withColumn("votes", F.col("target") - F.col("passes") * F.col("source_size"))
    left = sources.agg(F.sum("votes")).first()[0] or 0.0
    quotas = sainte_lague(sources.withColumn("total", F.lit(math.floor(left / block_tokens + 0.5)).cast("long")), [])
    quotas = materialise(quotas.select("source", F.col("idx").alias("sid"), "source_size", "target", "passes", F.col("seats").alias("quota")), "mix-quotas")

    shards = max(1, math.ceil((n_rows or 0) / shard_rows))
    shard = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(shards))
    small = F.broadcast(quotas) if count <= BROADCAST_ROWS else quotas
    placed = rows.withColumn("shard", shard).join(small, rows["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    cells = placed.groupBy("sid", "shard").agg(F.sum("words").cast("double").alias("votes"), F.first("quota").alias("total"))
    dealt = sainte_lague(cells.withColumn("idx", F.col("shard")), ["sid"])
    dealt = materialise(dealt.select("sid", "shard", F.col("votes").cast("long").alias("length"), F.col("seats").alias("blocks")), "mix-shards")

    order = Window.partitionBy("sid", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("start", F.sum("words").over(order) - F.col("words")).join(dealt, ["sid", "shard"])
    lined = _each_copy(materialise(lined, "mix-lined")).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    quota = F.col("blocks") * block_tokens
    again = F.when(F.col("length") > 0, F.floor(quota / F.col("length"))).otherwise(0).cast("long")
    repeats = F.col("passes") + again
    extra = F.least(F.greatest(quota - again * F.col("length") - F.col("start"), F.lit(0)), F.col("size"))
    limit = F.floor(F.col("size") * F.lit(most)).cast("long")
    taken = F.least(limit, repeats * F.col("size") + extra).cast("long")
    whole = F.when(F.col("size") > 0, F.floor(taken / F.col("size"))).otherwise(0).cast("long")
    return lined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), whole.alias("repeats"), (taken - whole * F.col("size")).alias("extra_words"))
