"""Chunking: line windows, parents and children by characters, and symbols of source code."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions.text import bound, extension, is_blank, lines
from loomgrain.operators.braces import declarations

WINDOW, STEP = 50, 40
#: Fewest lines of a symbol beyond its first.
MIN_SPAN = 3


def chunk_id(*parts: str) -> Column:
    """Identifier that only depends on what is given, so indexing again gives the same."""
    return F.sha2(F.concat_ws("\x1f", *(F.col(p).cast("string") for p in parts)), 256)


def line_windows(text: Column, window: int = WINDOW, step: int = STEP) -> Column:
    """Array of (chunkIndex, lineRangeStart, lineRangeEnd, document): windows with blank ones left out and then numbered.

    Starts are counted from 0, ends are exclusive. No shuffle: the windows of a
    text are numbered where the text is.
    """

    def windows(own: Column) -> Column:
        n = F.size(own)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

        def one(start: Column) -> Column:
            return F.struct(start.alias("start"), F.least(start + window, n).alias("end"), F.array_join(F.slice(own, start + 1, F.lit(window)), "\n").alias("document"))

        return F.filter(F.transform(starts, one), lambda w: ~is_blank(w["document"]))

    kept = bound(lines(text), windows)
    return F.transform(kept, lambda w, i: F.struct(i.alias("chunkIndex"), w["start"].alias("lineRangeStart"), w["end"].alias("lineRangeEnd"), w["document"].alias("document")))


def line_chunks(files: DataFrame) -> DataFrame:
    """Chunk rows of ``files`` (workspaceId, file_path, content) by line windows."""
    rows = files.select("workspaceId", F.col("file_path").alias("filePath"), F.explode(line_windows(F.col("content"))).alias("c")).select("workspaceId", "filePath", "c.*")
    return rows.withColumn("id", chunk_id("workspaceId", "filePath", "chunkIndex"))


def parent_child(files: DataFrame, child: int = 512, step: int = 256, parent: int = 2000) -> DataFrame:
    """(workspaceId, filePath, chunkIndex, document, parentStart, parentText): children with half overlap and the block around each.

    A child's parent is the block of ``parent`` characters in which the child starts.
    """
    n = F.char_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = files.select("workspaceId", F.col("file_path").alias("filePath"), "content", F.posexplode(starts).alias("chunkIndex", "start"))
    top = (F.floor(F.col("start") / parent) * parent).cast("int")
    return rows.select(
        "workspaceId", "filePath", "chunkIndex",
        F.substring("content", F.col("start") + 1, F.lit(child)).alias("document"),
        top.alias("parentStart"),
        F.substring("content", top + 1, F.lit(parent)).alias("parentText"),
    )


@dataclass(frozen=True)
class Symbol:
    """A piece of source code: kind, name if it has one, and its first and last line, counted from 0."""

    kind: str
    name: str | None
    start: int
    end: int


def python_symbols(source: str) -> list[Symbol]:
    """Functions and classes; decorators don't belong to them. A file that does not parse is read by its indentation."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return indented_symbols(source)
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}
    found = [Symbol(kinds[type(n)], n.name, n.lineno - 1, n.end_lineno - 1) for n in ast.walk(tree) if type(n) in kinds]
    return sorted(found, key=lambda s: (s.start, -s.end))


_DEFINITION = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def indented_symbols(source: str) -> list[Symbol]:
    """Functions and classes of a Python file with errors: each goes on while lines are blank or indented more than its first."""
    depth = lambda s: len(s.expandtabs(8)) - len(s.expandtabs(8).lstrip(" "))
    own = source.split("\n")
    found: list[Symbol] = []
    open_symbols: list[tuple[int, int, str, str]] = []  # indentation, first line, kind and name
    last = -1  # the last line that is not blank

    def close(upto: int) -> None:
        while open_symbols and open_symbols[-1][0] >= upto:
            _, start, kind, name = open_symbols.pop()
            found.append(Symbol(kind, name, start, last))

    for k, text in enumerate(own):
        if not text.strip():
            continue
        m = _DEFINITION.match(text)
        # what closes brackets of a definition that goes on over several lines doesn't end it
        if m or not text.lstrip().startswith((")", "]", "}")):
            close(depth(text))
        if m:
            open_symbols.append((depth(text), k, "class_definition" if m[2] == "class" else "function_definition", m[3]))
        last = k
    close(-1)
    return sorted(found, key=lambda s: (s.start, -s.end))


def brace_symbols(source: str, rust: bool) -> list[Symbol]:
    """Declarations of a Rust file, or of a JavaScript or TypeScript file."""
    return [Symbol(*d) for d in declarations(source, rust)]


#: Chunkers by extension; more can be registered.
CHUNKERS: dict[str, Callable[[str], list[Symbol]]] = {
    "py": python_symbols,
    "rs": lambda s: brace_symbols(s, rust=True),
    **dict.fromkeys(("ts", "tsx", "js", "jsx"), lambda s: brace_symbols(s, rust=False)),
}

_SYMBOL = "array<struct<chunkIndex: int, lineRangeStart: int, lineRangeEnd: int, document: string, kind: string, name: string>>"


def symbols_of(path: Column, content: Column) -> Column:
    """Array of the symbols of at least four lines in a source file, outer ones first; empty for other files. Line ranges are inclusive."""
    chunkers = dict(CHUNKERS)

    @F.pandas_udf(_SYMBOL)
    def parse(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for path, text in zip(paths, contents, strict=True):
            chunker = chunkers.get(path.rsplit(".", 1)[-1]) if text else None
            own = text.split("\n") if chunker else []
            kept = [s for s in chunker(text) if s.end - s.start >= MIN_SPAN] if chunker else []
            out.append([(k, s.start, s.end, "\n".join(own[s.start : s.end + 1]), s.kind, s.name) for k, s in enumerate(kept)])
        return pd.Series([[dict(zip(("chunkIndex", "lineRangeStart", "lineRangeEnd", "document", "kind", "name"), r, strict=True)) for r in rows] for rows in out], dtype=object)

    code = extension(path).isin(list(chunkers))
    return parse(F.when(code, path).otherwise(""), F.when(code, content))  # other files' texts stay out of Python


_CHUNK = ["chunkIndex", "lineRangeStart", "lineRangeEnd", "document", "kind", "name"]


def semantic_chunks(files: DataFrame) -> DataFrame:
    """Symbols of source files; both a symbol and those inside it are chunks."""
    rows = files.where(extension(F.col("file_path")).isin(list(CHUNKERS)))
    rows = rows.select("workspaceId", F.col("file_path").alias("filePath"), F.explode(symbols_of(F.col("file_path"), F.col("content"))).alias("c"))
    return rows.select("workspaceId", "filePath", *[f"c.{c}" for c in _CHUNK])


def chunks(files: DataFrame) -> DataFrame:
    """Semantic chunks where a file has any, line windows elsewhere. Each file is parsed once, where it is."""
    rows = files.select("workspaceId", F.col("file_path").alias("filePath"), "content", symbols_of(F.col("file_path"), F.col("content")).alias("symbols"))
    none = F.lit(None).cast("string")
    windows = F.transform(line_windows(F.col("content")), lambda w: F.struct(*[w[c].alias(c) for c in _CHUNK[:4]], none.alias("kind"), none.alias("name")))
    each = F.explode(F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(windows))
    both = rows.select("workspaceId", "filePath", each.alias("c")).select("workspaceId", "filePath", *[f"c.{c}" for c in _CHUNK])
    return both.withColumn("id", chunk_id("workspaceId", "filePath", "chunkIndex"))
