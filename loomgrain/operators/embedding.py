"""Embedding of chunks through a pluggable embedder."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame

BATCH = 8


class Embedder(Protocol):
    """Turns texts into vectors; it is sent to the tasks."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Signed counts of hashed words, scaled to length one. Needs no model and always gives the same."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float64)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


@dataclass(frozen=True)
class HttpEmbedder:
    """A model server: a batch endpoint, or where that is missing one call a text."""

    model: str
    host: str = "http://127.0.0.1:11434"
    timeout: float = 60.0

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.host.rstrip('/')}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def embed(self, texts: list[str]) -> list[list[float]]:
        try:
            return self._post("/api/embed", {"model": self.model, "input": texts})["embeddings"]
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
        return [self._post("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts]


def embedded(chunks: DataFrame, embedder: Embedder, text_col: str = "document", batch: int = BATCH, counter: Accumulator | None = None) -> DataFrame:
    """``chunks`` with ``vector``. A task sends ``batch`` texts a call; ``coalesce`` the input to bound the calls in flight.

    ``counter`` counts the chunks embedded, those of repeated tasks again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            vectors = []
            for k in range(0, len(texts), batch):
                vectors += embedder.embed(texts[k : k + batch])
            if counter is not None:
                counter.add(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, vector array<float>")


@lru_cache(maxsize=100)
def query_vector(embedder: Embedder, query: str) -> tuple[float, ...]:
    """Vector of a query text; the last hundred are kept."""
    return tuple(embedder.embed([query])[0])


def hypothetical_vector(embedder: Embedder, query: str, answer: Callable[[str], str] | None = None) -> tuple[float, ...]:
    """Vector of a made-up answer to the query, which is nearer to texts that hold the real one; of the query itself if there is none.

    ``answer`` is any model that writes a short answer; it may fail or be missing.
    """
    text = ""
    if answer is not None:
        try:
            text = answer(query) or ""
        except (OSError, ValueError, RuntimeError):
            text = ""
    return query_vector(embedder, text if text.strip() else query)
