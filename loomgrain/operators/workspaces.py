"""Workspaces and model lists: small tables that a user edits, as merges and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``changes`` laid over them: given fields win, null ones keep the old value, new keys are added."""
    new = changes.select(F.col(key), F.struct(*[c for c in changes.columns if c != key]).alias("_new"))
    both = rows.join(new, key, "full_outer")
    changed = set(changes.columns)
    merged = [F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in changed and c != key else F.col(c) for c in rows.columns]
    return both.select(*merged)


def removed(rows: DataFrame, keys: list, key: str = "id") -> DataFrame:
    return rows.where(~F.col(key).isin(keys)) if keys else rows


def toggled(active: Column, value: Column) -> Column:
    """The array of active identifiers with ``value`` taken out if it is in, else added."""
    return F.when(F.array_contains(active, value), F.array_remove(active, value)).otherwise(F.array_append(active, value))


def active_of(rows: DataFrame, active: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among those of ``active``."""
    return rows.join(active.select(key), key, "left_semi")


def recent(rows: DataFrame, most: int = 5) -> DataFrame:
    """The workspaces opened last."""
    return rows.orderBy(F.desc_nulls_last("lastOpened"), "id").limit(most)


def find_models(models: DataFrame, query: str, most: int = 30) -> DataFrame:
    """The first models (id, name) whose name or identifier contains the query, whatever the case."""
    low = F.lower(F.lit(query))
    hit = F.contains(F.lower("name"), low) | F.contains(F.lower("id"), low)
    return models.where(hit).orderBy("id").limit(most)


def coverage(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(workspaceId, files, indexed, percent): how many files of each workspace have chunks."""
    done = indexed.select("workspaceId", "file_path").distinct().withColumn("_done", F.lit(1))
    both = files.select("workspaceId", "file_path").join(done, ["workspaceId", "file_path"], "left")
    sums = both.groupBy("workspaceId").agg(F.count("*").alias("files"), F.count("_done").alias("indexed"))
    return sums.withColumn("percent", F.round(100.0 * F.col("indexed") / F.col("files"), 2))


def split_for_summary(messages: DataFrame, verbatim: int = 6, threshold: int = 10) -> DataFrame:
    """``messages`` with ``part``: of conversations over ``threshold`` turns all but the last few are to be summarised."""
    w = Window.partitionBy("conv_id")
    back = F.row_number().over(w.orderBy(F.desc("turn")))
    many = F.count("*").over(w) > threshold
    return messages.withColumn("part", F.when(many & (back > verbatim), "summary").otherwise("verbatim"))
