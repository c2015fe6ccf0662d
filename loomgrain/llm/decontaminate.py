"""Operator 6: benchmark decontamination by pigeonhole edit matching.

A test item of m words may differ from a passage by up to k word edits. Split
into k + 1 pieces, at least one piece is in the passage unchanged. One automaton
finds all pieces of all items in a document; around each hit, Myers' bit-parallel
algorithm gives the smallest edit distance between the item and any passage.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import materialise, text_key, without

#: Letters A-Z to lower case; letters, digits and all bytes beyond ASCII stay; the rest parts words.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Scripts that put no spaces between words (Thai, Lao, Myanmar, Khmer, kana, bopomofo, Han), and the marks between their sentences.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3040-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_WIDE_MARKS = re.compile("[\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
#: First bytes of characters that may be of such a script.
_MAYBE_UNSPACED = re.compile(rb"[\xe0-\xf0]")

MATCHES = "doc_id long, item_id long, distance int, budget int, start_word long, end_word long"


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased; each character of a script without spaces is a word."""
    text = text or b""
    if _MAYBE_UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", _WIDE_MARKS.sub(" ", text.decode("utf-8", "replace"))).encode()
    return text.translate(_KEPT).split()


def budget_of(m: int, similarity: float) -> int:
    """Edits that an item of m words may have."""
    return math.floor((1 - similarity) * m + 1e-9)


def pieces(words: list[bytes], k: int) -> list[tuple[int, list[bytes]]]:
    """k + 1 runs of nearly equal length that make up ``words``, each with its place."""
    cuts = [len(words) * i // (k + 1) for i in range(k + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_passage(item: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Smallest number of word edits between ``item`` and a passage of ``text``, and the earliest place where one ends."""
    m = len(item)
    at: dict[bytes, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        same = at.get(w, 0)
        across = (((same & plus) + plus) ^ plus) | same
        down = same | minus
        up_h = minus | ~(across | plus) & full
        down_h = plus & across
        if up_h & top:
            score += 1
        elif down_h & top:
            score -= 1
        up_h, down_h = (up_h << 1) & full, (down_h << 1) & full
        plus = down_h | ~(down | up_h) & full
        minus = up_h & down
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds a block of items in documents."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], similarity: float) -> None:
        self.items: list[tuple[list[int | None], list[bytes], int]] = []
        number: dict[bytes, int] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            key = b" ".join(words)
            if not words:
                continue
            if key in number:
                self.items[number[key]][0].append(item_id)
            else:
                k = budget_of(len(words), similarity)
                number[key] = len(self.items)
                for place, part in pieces(words, k):
                    found.setdefault(f" {b' '.join(part).decode('latin-1')} ", []).append((number[key], place))
                self.items.append(([item_id], words, k))
        self.automaton = ahocorasick.Automaton()
        for part, where in found.items():
            self.automaton.add_word(part, (len(part), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: bytes | None) -> Iterator[tuple[int | None, int, int, int, int]]:
        """(item_id, distance, budget, start_word, end_word): the best passage for each item within its budget."""
        words = words_of(text)
        flat = b" ".join(words)
        if not self.any or not words:
            return
        ends = None
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(f" {flat.decode('latin-1')} "):
            if ends is None:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first = int(np.searchsorted(ends, last - size + 1, side="right"))  # the word at which the piece starts
            for n, place in where:
                _, item, k = self.items[n]
                spans.setdefault(n, []).append((max(0, first - place - k), min(len(words), first - place + len(item) + k)))
        for n, own in spans.items():
            ids, item, k = self.items[n]
            own.sort()
            best, lo, hi = (k + 1, 0, 0), own[0][0], own[0][1]
            for a, b in [*own[1:], (math.inf, 0)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                distance, end = best_passage(item, words[lo:hi])
                if distance < best[0]:
                    # the passage read backwards from its end gives its start
                    _, back = best_passage(item[::-1], words[max(lo, lo + end - len(item) - k) : lo + end][::-1])
                    best = (distance, lo + end - back, lo + end)
                lo, hi = a, b
            if best[0] <= k:
                for item_id in ids:
                    yield item_id, best[0], k, best[1], best[2]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each document row and benchmark item that it holds: doc_id, item_id, distance, budget, start_word, end_word.

    A doc_id may be a string or a number. Words are runs of letters and digits, A-Z lower-cased, and single characters of
    scripts without spaces; distances are word edits, at most (1 - similarity) of
    the item's words, so that items of fewer than five words are found unchanged;
    the place is that of the best passage, the earliest of equally good ones.
    Nulls: a null text counts as empty, a null doc_id or item_id is returned as
    null. Items with equal words all match; repeated documents match each. Items
    without words match nothing. Empty tables give no rows; other columns are not
    read.

    Distinct item texts reach the tasks in blocks of about ``block_bytes``, one
    scan of the documents for each block; texts are read whole. Their identifiers,
    however many share a text, are joined to the matches.
    """
    body = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias("body")
    given = benchmark.select(F.col("item_id").cast("long"), body("text"))
    items = materialise(given.select("body").distinct().withColumn("number", F.monotonically_increasing_id()), "leak-items")
    ids = materialise(given.join(items, "body").select(F.col("number").alias("_number"), F.col("item_id").alias("_item")), "leak-ids")
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("body"), F.lit(blocks)))
    named = isinstance(docs.schema["doc_id"].dataType, StringType)
    texts = docs.select(F.col("doc_id").cast("string" if named else "long"), body("text"))
    schema = MATCHES.replace("doc_id long", "doc_id string") if named else MATCHES
    names = [x.split()[0] for x in MATCHES.split(", ")]

    def scan(own: list[tuple[int | None, bytes]]) -> DataFrame:
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(own, similarity)
            types = [pa.string() if named else pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matcher.matches(t.as_py())]
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        return texts.mapInArrow(match, schema)

    out = None
    for n in range(blocks):
        own = [(r["number"], bytes(r["body"])) for r in items.where(F.col("block") == n).collect()]  # one block of items
        found = scan(own)
        out = found if out is None else out.unionByName(found)
    found = out.join(ids, out["item_id"] == ids["_number"])
    return found.select("doc_id", F.col("_item").alias("item_id"), *names[2:])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; texts decide, so null and repeated doc_ids don't matter."""
    key = text_key(F.col("text"))
    found = find_leaks(docs.select(key.alias("doc_id"), "text"), benchmark, similarity)
    return without(docs, key, materialise(found.select("doc_id").distinct(), "leaks"), "leaks")
