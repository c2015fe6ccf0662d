"""Connectors: documents in packed formats, git, model servers and web search.

Whatever needs a network or a program is fetched by the driver, is small, and
becomes a DataFrame; its parsers are in ``services`` and need no network.
"""

from __future__ import annotations

import io
import json
import subprocess
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions.text import extension, is_blank
from loomgrain.sources.pdf import pdf_text

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str | None:
    """Paragraphs of a word-processor file; None if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


#: Extractors by extension; more can be registered.
EXTRACTORS: dict[str, Callable[[bytes], str | None]] = {"docx": docx_text, "pdf": pdf_text}


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str | None]] | None = None) -> DataFrame:
    """(file_path, content, mtime, size) of packed files (content as bytes) that have an extractor; those without text are left out."""
    own = dict(EXTRACTORS if extractors is None else extractors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [own[p.rsplit(".", 1)[-1].lower()](bytes(c)) for p, c in zip(b.file_path, b.content, strict=True)]
            yield b.assign(content=text)

    packed = files.where(extension(F.col("file_path")).isin(list(own)) & F.col("content").isNotNull())
    rows = packed.select("file_path", F.col("content").cast("binary"), "mtime", "size")
    out = rows.mapInPandas(run, "file_path string, content string, mtime double, size long")
    return out.where(F.col("content").isNotNull() & ~is_blank(F.col("content")))


def git_context(spark: SparkSession, folder: str, commits: int = 5) -> DataFrame:
    """One row (branch, uncommitted_files, recent_commits, diff_summary) of a working copy; no row where there is none."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
        return done.stdout if done.returncode == 0 else None

    schema = "branch string, uncommitted_files array<string>, recent_commits array<string>, diff_summary string"
    branch = git("rev-parse", "--abbrev-ref", "HEAD")
    if branch is None:
        return spark.createDataFrame([], schema)
    changed = [x[3:] for x in (git("status", "--porcelain", "--untracked-files=all") or "").splitlines()]
    recent = (git("log", f"-{commits}", "--format=%an - %s") or "").splitlines()
    return spark.createDataFrame([(branch.strip(), changed, recent, (git("diff", "--stat") or "").strip())], schema)


def fetch(url: str, body: dict | None = None, headers: dict[str, str] | None = None, timeout: float = 10.0) -> str:
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


def is_online(host: str, timeout: float = 3.0) -> bool:
    """Whether a model server answers."""
    try:
        fetch(host, timeout=timeout)
    except (urllib.error.URLError, OSError, ValueError):
        return False
    return True


#: Address and form of each web-search service.
SEARCHERS: dict[str, tuple[str, Callable[[str, str], tuple[dict, dict]]]] = {
    "tavily": ("https://api.tavily.com/search", lambda q, key: ({"api_key": key, "query": q, "max_results": 5}, {})),
    "serper": ("https://google.serper.dev/search", lambda q, key: ({"q": q, "num": 5}, {"X-API-KEY": key})),
}


def web_search(spark: SparkSession, provider: str, query: str, key: str) -> DataFrame:
    """(provider, body): the answer of a search service, for ``services.web_results``. Unknown services are an error."""
    if provider not in SEARCHERS:
        raise ValueError(f"unknown web search: {provider}")
    url, form = SEARCHERS[provider]
    body, headers = form(query, key)
    return spark.createDataFrame([(provider, fetch(url, body, headers))], "provider string, body string")


def model_catalogue(spark: SparkSession, url: str, headers: dict[str, str] | None = None) -> DataFrame:
    """(body): a catalogue of models, for ``services.model_groups`` or ``services.local_models``."""
    return spark.createDataFrame([(fetch(url, headers=headers),)], "body string")
