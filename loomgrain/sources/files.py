"""File sources: crawling, ignore rules, the file tree and the manifest."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrain.functions.text import extension, is_blank

MAX_FILE_BYTES = 10 * 1024 * 1024
#: Extensions of files that are indexed.
EXTENSIONS = (
    "txt md py js ts jsx tsx java c cpp h cs go rs rb php swift kt scala json yaml yml toml env pdf csv log sql html css xml".split()
)
#: Ignore patterns that always hold.
DEFAULT_IGNORES = (
    "node_modules/ .git/ dist/ build/ coverage/ .next/ out/ target/ vendor/ tmp/ .venv/ venv/ __pycache__/ "
    ".mypy_cache/ .pytest_cache/ .turbo/ .cache/ storybook-static/ *.min.js *.min.css"
).split()

MANIFEST = (
    T.StructType().add("workspace_id", "string").add("file_path", "string").add("mtime", "double").add("chunk_count", "integer").add("model", "string")
)


def _glob(body: str) -> str:
    """A glob as a regular expression; ``*`` and ``?`` stay within a path part, ``**`` crosses them."""
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and (end := body.find("]", k + 2)) > 0:
            inner = body[k + 1 : end].replace("\\", "\\\\")
            out, k = out + ("[^" + inner[1:] if inner[0] == "!" else "[" + inner) + "]", end + 1
        else:
            if body[k] == "\\" and k + 1 < len(body):
                k += 1
            out, k = out + re.escape(body[k]), k + 1
    return out


def ignore_rule(line: str) -> tuple[bool, str] | None:
    """(ignored, regular expression over the relative path) of one ignore line; None for blanks and comments.

    A pattern with a slash before its end is anchored at the root; a trailing slash
    matches folders only; whatever lies in a matched folder is matched too.
    """
    line = line.rstrip("\n\r")
    body = line.rstrip(" ") if not line.endswith("\\ ") else line
    if not body or body.startswith("#"):
        return None
    ignored = not body.startswith("!")
    body = body.removeprefix("!").removeprefix("\\") if body.startswith(("!", "\\#", "\\!")) else body
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    if not body:
        return None
    return ignored, ("\\A" if anchored else "(?:\\A|/)") + _glob(body) + ("/" if folder else "(?:/|\\z)")


def is_ignored(relative: Column, patterns: Iterable[str] = ()) -> Column:
    """Whether the default rules and then ``patterns`` ignore a path; the last rule that matches decides."""
    out: Column = F.lit(False)
    for ignored, pattern in filter(None, map(ignore_rule, [*DEFAULT_IGNORES, *patterns])):
        out = F.when(relative.rlike(pattern), F.lit(ignored)).otherwise(out)
    return out


def is_hidden(relative: Column) -> Column:
    return relative.rlike(r"(?:\A|/)\.[^/]")


def wanted_paths(files: DataFrame, patterns: Iterable[str] = (), path: str = "file_path", also: Iterable[str] = ()) -> DataFrame:
    """Rows whose path is neither hidden nor ignored and has an indexed extension or one of ``also``. Reads no content."""
    p = F.col(path)
    return files.where(~is_hidden(p) & ~is_ignored(p, patterns) & extension(p).isin([*EXTENSIONS, *also]))


def wanted_files(files: DataFrame, patterns: Iterable[str] = ()) -> DataFrame:
    """``wanted_paths`` (file_path, content, size) without files over 10 MiB and blank ones."""
    return wanted_paths(files, patterns).where((F.col("size") <= MAX_FILE_BYTES) & F.col("content").isNotNull() & ~is_blank(F.col("content")))


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme = re.match(r"\A[a-z0-9+.-]+:", uri)
    return pafs.FileSystem.from_uri(quote(uri, safe="/:@") if scheme else f"file://{quote(os.path.abspath(uri))}")


def root_patterns(folder: str) -> list[str]:
    """Lines of the ignore file at the root of a folder, local or not; none if there is none."""
    try:
        fs, path = _located(f"{folder.rstrip('/')}/.gitignore")
        with fs.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace").splitlines()
    except OSError:
        return []


def listing(spark: SparkSession, root: str, patterns: Iterable[str] = ()) -> DataFrame:
    """(file_path, uri, mtime, size) of all files below ``root`` but those in hidden and ignored folders, which are not entered.

    Tasks list the folders: the root, then its folders, and then each of theirs
    with all that is below, so one such subtree is listed by one task. No content
    is read. Unlike Spark's own listing this finds files whose names start with an underscore.
    """
    base = root.rstrip("/")
    rules = [(ignored, re.compile(p.replace("\\z", r"\Z"))) for ignored, p in filter(None, map(ignore_rule, [*DEFAULT_IGNORES, *patterns]))]
    prune = all(ignored for ignored, _ in rules)  # a rule that takes something back may do so inside an ignored folder
    schema = "file_path string, folder boolean, mtime double, size long"

    def entered(relative: str) -> bool:
        return not relative.rsplit("/", 1)[-1].startswith(".") and not (prune and any(r.search(f"{relative}/") for _, r in rules))

    def children(relative: str) -> list[tuple[str, bool, float, int]]:
        fs, top = _located(base)
        found = fs.get_file_info(pafs.FileSelector(f"{top.rstrip('/')}/{relative}".rstrip("/") or "/", allow_not_found=True))
        rows = []
        for f in found:
            path, folder = f"{relative}/{f.base_name}".lstrip("/"), f.type == pafs.FileType.Directory
            if not folder or entered(path):
                rows.append((path, folder, (f.mtime_ns or 0) / 1e6, f.size or 0))
        return rows

    def expand(deep: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["file_path", "folder", "mtime", "size"]
            for batch in batches:
                yield batch[~batch.folder.astype(bool)]
                waiting = batch[batch.folder.astype(bool)].file_path.tolist()
                rows: list[tuple] = []
                while waiting:
                    for row in children(waiting.pop()):
                        if deep and row[1]:
                            waiting.append(row[0])
                        else:
                            rows.append(row)
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"folder": bool, "mtime": float, "size": "int64"})

        return run

    start = spark.createDataFrame([("", True, 0.0, 0)], schema).coalesce(1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = start.mapInPandas(expand(False), schema).repartition(parts, "file_path").mapInPandas(expand(False), schema)
    files = top.repartition(parts, "file_path").mapInPandas(expand(True), schema)
    return files.select("file_path", F.concat(F.lit(f"{base}/"), "file_path").alias("uri"), "mtime", "size")


def with_content(files: DataFrame, extractors: dict[str, Callable[[bytes], str | None]] | None = None) -> DataFrame:
    """``files`` (with uri) and ``content``: only these files are read, by the tasks.

    Packed formats go through their extractor, others must be UTF-8; files that
    give no text, that are blank or gone are left out.
    """
    own = dict(extractors or {})
    columns = [c for c in files.columns if c != "content"]

    def text_of(uri: str) -> str | None:
        try:
            fs, path = _located(uri)
            with fs.open_input_stream(path) as f:
                data = f.read()
            name = uri.rsplit("/", 1)[-1]
            packed = own.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
            return packed(data) if packed else data.decode("utf-8")
        except (OSError, UnicodeDecodeError):
            return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            while at < len(batch):  # at most some ten files of the largest size at once
                part = batch.iloc[at : at + 16]
                yield part.assign(content=[text_of(u) for u in part.uri])
                at += 16

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*columns).schema)
    out = files.select(*columns).mapInPandas(read, f"{schema}, content string")
    return out.where(F.col("content").isNotNull() & ~is_blank(F.col("content")))


def crawl(spark: SparkSession, root: str, patterns: Iterable[str] = (), extractors: dict[str, Callable[[bytes], str | None]] | None = None) -> DataFrame:
    """(file_path, content, mtime, size) of the indexed text files below ``root``, undecodable ones left out.

    Folders, paths and sizes are filtered before any content is read.
    """
    return with_content(crawl_metadata(spark, root, patterns, extractors or ()), extractors).select("file_path", "content", "mtime", "size")


def crawl_metadata(spark: SparkSession, root: str, patterns: Iterable[str] = (), also: Iterable[str] = ()) -> DataFrame:
    """(file_path, uri, mtime, size) of the files that ``crawl`` would read, by listing alone."""
    return wanted_paths(listing(spark, root, patterns), patterns, also=also).where(F.col("size") <= MAX_FILE_BYTES)


def file_tree(files: DataFrame, patterns: Iterable[str] = (), depth: int | None = None) -> DataFrame:
    """(path, parent, name, type, depth, position) of files and the folders that hold them, siblings folders first, then by name.

    Hidden and ignored paths are pruned, and so folders without other files. A
    folder with very many entries is ordered by one task; the tree has one row a
    file, without content.
    """
    p = F.regexp_replace("file_path", r"\A/+", "")
    kept = files.select(p.alias("path")).where(~is_hidden(F.col("path")) & ~is_ignored(F.col("path"), patterns))
    parts = F.split("path", "/")
    nodes = kept.select(F.posexplode(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))).alias("depth", "node"), F.size(parts).alias("n"))
    nodes = nodes.select(
        F.col("node").alias("path"), F.when(F.col("depth") == F.col("n") - 1, "file").otherwise("directory").alias("type"), "depth"
    ).distinct()
    if depth is not None:
        nodes = nodes.where(F.col("depth") < depth)
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.regexp_replace("path", r"/?[^/]+\z", "")
    nodes = nodes.withColumns({"name": name, "parent": parent})
    place = F.expr("row_number() OVER (PARTITION BY parent ORDER BY type, lower(name), name)")
    return nodes.select("path", "parent", "name", "type", "depth", place.alias("position"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest written at ``path``; an empty one if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
