"""Recent changes of files, and the palette of things to open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions.text import fuzzy
from loomgrain.operators.chat import joined_in_order

MOST, CHARS, READ_LIMIT = 40, 1000, 500_000


def timeline(files: DataFrame, now: float, hours: int = 24) -> DataFrame:
    """Files (file_path, mtime in ms) changed within ``hours`` before ``now``, the newest 40."""
    return files.where(F.col("mtime") > now - hours * 3_600_000).orderBy(F.desc("mtime"), "file_path").limit(MOST)


def snippet(content: Column, size: Column) -> Column:
    """Start of a file's text; null for files of half a megabyte or more."""
    return F.when(size < READ_LIMIT, F.substring(content, 1, CHARS))


def timeline_prompt(events: DataFrame) -> DataFrame:
    """(text): one item an event (relative_path, mtime, current_content), newest first."""
    when = F.date_format(F.timestamp_millis(F.col("mtime").cast("long")), "yyyy-MM-dd HH:mm:ss")
    body = F.concat(F.lit("\n  Content snippet:\n```\n"), "current_content", F.lit("\n```"))
    text = F.concat(F.lit("- "), "relative_path", F.lit(" (modified "), when, F.lit(")"), F.coalesce(body, F.lit("")))
    keyed = events.withColumns({"_all": F.lit(1), "_order": F.struct(-F.col("mtime"), F.col("relative_path"))})
    return joined_in_order(keyed, ["_all"], "_order", text, "\n\n").select("text")


def palette(actions: DataFrame, chats: DataFrame, files: DataFrame, query: str, files_most: int = 200, most: int = 50) -> DataFrame:
    """(category, label, detail, position): the first 50 of actions, chats and 200 files that match, then actions before chats before files.

    Each input has label, detail and position.
    """
    rows = lambda df, name, n: df.select(F.lit(name).alias("category"), F.lit(n).alias("kind"), "label", "detail", "position")
    some = files.orderBy("position").limit(files_most)
    every = rows(actions, "action", 0).unionByName(rows(chats, "chat", 1)).unionByName(rows(some, "file", 2))
    kept = every.where(fuzzy(F.col("label"), query) | fuzzy(F.coalesce("detail", F.lit("")), query))
    return kept.orderBy("kind", "position").limit(most).select("category", "label", "detail", "position")


def language_split(files: DataFrame, by: str = "ext") -> DataFrame:
    """(by, files, percent) over all files."""
    counts = files.groupBy(by).agg(F.count("*").alias("files"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("files").alias("all")))).select(by, "files", F.round(100.0 * F.col("files") / F.col("all"), 4).alias("percent"))
