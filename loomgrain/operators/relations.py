"""Symbol graph: reference edges, nodes, edges and a grid layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.sources.shared import shared_folder


#: Runs of word characters, of any script.
_RUNS = r"(?U)(\w+)"
#: Most names of a file that meet its chunks as one array; files of more names are joined word by word.
NAMES_A_ROW = 2048


def _words(document: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(document, F.lit(_RUNS), 1))


def _is_whole(document: Column, name: Column) -> Column:
    return F.contains(document, name) & F.regexp_like(document, F.concat(F.lit(r"(?U)\b\Q"), name, F.lit(r"\E\b")))


def reference_edges(chunks: DataFrame, names_a_row: int = NAMES_A_ROW) -> DataFrame:
    """(workspaceId, filePath, id, fromName, toName, kind): a named chunk refers to another name of its file as a whole word.

    The names of a file meet its chunks as one array, so that each chunk is shuffled
    once, by its file, and its words are taken and compared where it arrives. A name that is not one word
    is searched for in the text; a name has a word character. Files of more than
    ``names_a_row`` names, if there are any, take an equi-join of the chunks' distinct words with the names instead,
    so that no group grows without bound. Edges are distinct for each chunk.
    """
    named = chunks.where("name IS NOT NULL AND name <> ''")
    names = named.select(F.col("workspaceId").alias("_ws"), F.col("filePath").alias("_file"), F.col("name").alias("toName")).distinct()
    names = names.withColumn("_word", F.regexp_extract("toName", _RUNS, 1)).where("_word <> ''")
    path = shared_folder(chunks.sparkSession, "names")
    names.write.parquet(path)  # a few words a chunk; what follows reads them more than once
    names = chunks.sparkSession.read.schema(names.schema).parquet(path)
    large = names.groupBy("_ws", "_file").count().where(F.col("count") > names_a_row).select("_ws", "_file")
    some_large = not large.isEmpty()
    few = names.join(large, ["_ws", "_file"], "left_anti") if some_large else names
    plain, odd = F.col("_word") == F.col("toName"), F.col("_word") != F.col("toName")
    of_file = few.groupBy("_ws", "_file").agg(F.collect_list(F.when(plain, F.col("toName"))).alias("_plain"), F.collect_list(F.when(odd, F.col("toName"))).alias("_odd"))
    own = named.select("workspaceId", "filePath", "id", F.col("name").alias("fromName"), "document")
    # names have no bound, so they are not broadcast; and the words are then taken by as many tasks as there are partitions
    met = own.join(of_file.hint("merge"), (F.col("workspaceId") == F.col("_ws")) & (F.col("filePath") == F.col("_file")))
    searched = F.when(F.size("_odd") > 0, F.filter("_odd", lambda n: _is_whole(F.col("document"), n))).otherwise(F.array().cast("array<string>"))
    columns = ["workspaceId", "filePath", "id", "fromName", "toName"]
    # of explode the optimiser infers a filter that finds all words once more; the comparison below drops the rows that explode_outer adds
    hits = F.explode_outer(F.concat(F.array_intersect(_words("document"), "_plain"), searched)).alias("toName")
    out = met.select("workspaceId", "filePath", "id", "fromName", hits).where("fromName <> toName")
    if some_large:
        out = out.unionByName(_edges_by_word(own.join(large, (F.col("workspaceId") == F.col("_ws")) & (F.col("filePath") == F.col("_file")), "left_semi"), names))
    return out.select(*columns).withColumn("kind", F.lit("reference"))


def _edges_by_word(own: DataFrame, names: DataFrame) -> DataFrame:
    """The edges of ``own`` by an equi-join of words; only identifiers and words are shuffled for it.

    A name that is not one word is looked up by its first word, and the few pairs
    of chunk and name that this gives are joined back to the texts.
    """
    pair = ["workspaceId", "filePath", "id", "fromName"]
    words = own.select(*pair, F.explode_outer(_words("document")).alias("word"))
    found = words.join(names, (F.col("workspaceId") == F.col("_ws")) & (F.col("filePath") == F.col("_file")) & (F.col("word") == F.col("_word")) & (F.col("fromName") != F.col("toName")))
    plain = found.where("word = toName").select(*pair, "toName")
    maybe = found.where("word <> toName").select(*pair, "toName").distinct()
    other = own.join(maybe, pair).where(_is_whole(F.col("document"), F.col("toName")))
    return plain.unionByName(other.select(*pair, "toName"))


def graph_nodes(chunks: DataFrame, workspace: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, kind, filePath): named chunks, one a name, that of the largest (filePath, chunkIndex, id); for each value of ``by`` apart."""
    rows = chunks.where("name <> ''")
    if workspace is not None:
        rows = rows.where(F.col("workspaceId") == workspace)
    last = F.max(F.struct("filePath", "chunkIndex", "id", "kind")).alias("last")
    return rows.groupBy(*by, "name").agg(last).select(*by, "name", "last.kind", "last.filePath")


def graph_edges(edges: DataFrame, workspace: str | None = None) -> DataFrame:
    """(workspaceId, fromName, toName, kind), repeated ones of different chunks included."""
    rows = edges if workspace is None else edges.where(F.col("workspaceId") == workspace)
    return rows.select("workspaceId", "fromName", "toName", "kind")


def numbered(rows: DataFrame, order: str, name: str, by: tuple[str, ...] = (), lead: int = 3) -> DataFrame:
    """``rows`` with ``name``, the place of each by the string ``order`` from 0, within each value of ``by``.

    Rows are numbered among those whose ``order`` starts alike, and the numbers of
    earlier starts are added, so that no task sorts all rows.
    """
    start = F.substring(order, 1, lead)
    starts = rows.groupBy(*by, start.alias("_start")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(f"_of_{c}").eqNullSafe(F.col(c)) for c in by] + [F.col("_of_start").eqNullSafe(F.col("_start"))]
    starts = starts.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_start").alias("_of_start"), "_before")
    nth = F.row_number().over(Window.partitionBy(*by, "_start").orderBy(order)) - 1
    placed = rows.withColumn("_start", start).withColumn("_nth", nth).join(starts, same)
    return placed.select(*[F.col(c) for c in rows.columns], (F.col("_before") + F.col("_nth")).alias(name))


def graph_layout(nodes: DataFrame, columns: int = 5, dx: int = 200, dy: int = 150, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, x, y, is_function): nodes on a grid in the order of their names, a grid for each value of ``by``."""
    i = F.col("i")
    return numbered(nodes, "name", "i", by).select(
        *by, "name", ((i % columns) * dx).cast("int").alias("x"), (F.floor(i / columns) * dy).alias("y"), F.contains("kind", F.lit("function")).alias("is_function")
    )
