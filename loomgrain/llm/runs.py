"""Operator 11: runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q that no neighbour
extends and that is at least ``min_length`` and three periods long. Dyadic blocks
(2^k words from every 2^k-th word) ask where they occur again in a neighbouring
window: the suffix array gives the interval of the block's suffixes and a wavelet
tree over it the first occurrences at or after a place. Occurrences in a window
shorter than two blocks form one arithmetic progression, so each block gives at
most three candidate periods; common extensions to both sides decide them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are searched together until they have so many words.
GROUP_WORDS = 1 << 18

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def block_ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all blocks of 1, 2, 4, ... symbols and the suffix array, by prefix doubling.

    A rank is where the suffixes that start with the block begin in the suffix
    array, so equal blocks have equal ranks. Levels end where all ranks differ. A
    block that runs over the end equals no other. Only suffixes that still share
    a rank are sorted again.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.diff(symbols[sa], prepend=symbols[sa[0]] - 1))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, np.diff(first, append=n))
    levels, half = [rank], 1
    while half < n:
        slots = np.flatnonzero(np.bincount(rank, minlength=n)[rank[sa]] > 1)
        if not len(slots):
            break
        at = sa[slots]
        after = np.where(at + half < n, rank[np.minimum(at + half, n - 1)], -1)
        key = rank[at] * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[slots] = at
        new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        rank = rank.copy()
        rank[at] = np.repeat(slots[new], np.diff(new, append=len(key)))
        levels.append(rank)
        half *= 2
    return levels, sa


class WaveletTree:
    """Counts and order statistics of values in ranges of an array; all queries of a call go down together."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.bits, self.zeros = len(values), max(1, int(values.max(initial=0)).bit_length()), []
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))  # zeros before each place
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places lo to hi are less than x."""
        out = np.zeros(len(lo), np.int64)
        over = x >> self.bits > 0
        total = hi - lo
        for k, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - k)) & 1 == 1
            a, b = zeros[lo], zeros[hi]
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return np.where(over, total, out)

    def nth(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The value at ``place``, from 0, of the sorted values in places lo to hi."""
        out = np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            a, b = zeros[lo], zeros[hi]
            one = place >= b - a
            place = np.where(one, place - (b - a), place)
            out = out * 2 + one
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common extension to the right of places i < j."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    began = i.copy()
    for k in reversed(range(len(levels))):
        inside = j < n
        same = inside & (levels[k][i] == levels[k][np.where(inside, j, 0)])
        i, j = i + (same << k), j + (same << k)
    return i - began


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common extension to the left of places i < j, these not included."""
    i, j = i.copy(), j.copy()
    began = i.copy()
    for k in reversed(range(len(levels))):
        inside = i >= 1 << k
        same = inside & (levels[k][np.where(inside, i - (1 << k), 0)] == levels[k][np.where(inside, j - (1 << k), 0)])
        i, j = i - (same << k), j - (same << k)
    return began - i


def runs_of(symbols: np.ndarray, min_length: int = 24) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``symbols``, by start, then period.

    Why none is missed: let a run have period q and length of at least 3 q and
    ``min_length``, and let m be the largest power of two up to q (for small q the
    base block). Some block of m symbols at a multiple of m lies in the run with
    its copy q further on. If the window holds one or two occurrences, q is one of
    their distances. If it holds more, they are d apart, d the period of the block;
    then the stretches of period d around block and copy end q apart on one side,
    or q is d.
    """
    n = len(symbols)
    none = np.empty((0, 3), np.int64)
    if n < min_length:
        return none
    levels, sa = block_ranks(symbols)
    base = max(1, (min_length + 1) // 3).bit_length() - 1
    if len(levels) <= base:
        return none
    # only blocks of the base length that occur again can lie in a run
    shared = np.bincount(levels[base], minlength=n)[levels[base][sa]] > 1
    if not shared.any():
        return none
    place = np.concatenate([[0], np.cumsum(shared)])
    tree = WaveletTree(sa[shared])
    found: list[tuple[np.ndarray, np.ndarray]] = []  # places and candidate periods
    for k in range(base, len(levels)):
        m = 1 << k
        b = np.arange(0, n, m)
        size = np.bincount(levels[k], minlength=n)[levels[k][b]]
        b, size = b[size > 1], size[size > 1]
        lo = place[levels[k][b]]
        hi = lo + size
        windows = [(m, 2 * m)] if k > base else [(1, m), (m, 2 * m)]
        for w0, w1 in windows:
            if w1 <= w0 or not len(b):
                continue
            c = tree.below(lo, hi, b + w0)
            count = tree.below(lo, hi, b + w1) - c
            has = count > 0
            at, some, c, own_lo, own_hi = b[has], count[has], c[has], lo[has], hi[has]
            if not len(at):
                continue
            one = tree.nth(own_lo, own_hi, c)
            two = np.where(some > 1, tree.nth(own_lo, own_hi, np.where(some > 1, c + 1, c)), one)
            few = some <= 2
            found += [(at[few], (one - at)[few]), (at[few], (two - at)[few])]
            at, one, d = at[~few], one[~few], (two - one)[~few]
            if len(at):
                ends = _forward(levels, one, one + d) + one - _forward(levels, at, at + d) - at
                starts = one - _backward(levels, one, one + d) - at + _backward(levels, at, at + d)
                found += [(at, d), (at, ends), (at, starts)]
    at, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none[:, 0], none[:, 0])
    real = (p > 0) & (at + p < n)
    at, p = at[real], p[real]
    start = at - _backward(levels, at, at + p)
    length = at + p + _forward(levels, at, at + p) - start
    real = length >= np.maximum(min_length, 3 * p)
    rows = np.unique(np.stack([start[real], length[real], p[real]], 1), axis=0)
    # of periods of one stretch the smallest counts; equal stretches are neighbours now
    rows = rows[np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])] if len(rows) else none
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(docs: DataFrame, text: str = "text", min_length: int = 24) -> DataFrame:
    """``docs`` with _words (long), _runs (array of start, length, period in words, by start, then period) and _collapsed.

    Words are separated by spaces and ASCII controls from tab to carriage return.
    _collapsed has the words that no run repeats: in each run all after its first
    period go; the others are joined by one space. A null text counts as empty; a
    text without runs has an empty array and all its words. Rows are worked on one
    by one, so repeated rows and ties give repeated results; columns of the same
    three names are replaced, others stay. Texts are searched in groups of
    ``GROUP_WORDS``, a longer text on its own: a task holds some 500 bytes a word
    of one group.
    """
    kept = [c for c in docs.columns if c not in ("_words", "_runs", "_collapsed")]
    rows = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_collapsed"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(batch: pa.RecordBatch, texts: list[list[bytes]], symbols: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([len(s) for s in symbols])
            runs = runs_of(np.concatenate(symbols), min_length) if ends[-1] else np.empty((0, 3), np.int64)
            owner = np.searchsorted(ends, runs[:, 0], "right")
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            left = []
            for k, words in enumerate(texts):
                own = runs[cut[k] : cut[k + 1]]
                if len(own):
                    own[:, 0] -= ends[k] - len(words)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, own[:, 0] + own[:, 2], 1)
                    np.add.at(change, own[:, 0] + own[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]  # noqa: PLW2901
                left.append(b" ".join(words))
            items = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items).cast(run_type)
            counts = pa.array([len(t) for t in texts], pa.int64())
            collapsed = pa.array(left, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], counts, lists, collapsed], names=[*kept, "_words", "_runs", "_collapsed"])

        for batch in batches:
            began, total, base = 0, 0, 0
            texts: list[list[bytes]] = []
            symbols: list[np.ndarray] = []
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                words = x.as_buffer().to_pybytes().split()
                number: dict[bytes, int] = {}
                own = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                texts.append(words)
                symbols.append(own + base)  # words of different texts differ, so no run crosses from one to the next
                base, total = base + len(number), total + len(words)
                if total >= GROUP_WORDS:
                    yield results(batch.slice(began, i + 1 - began), texts, symbols)
                    began, total, base, texts, symbols = i + 1, 0, 0, [], []
            if texts:
                yield results(batch.slice(began), texts, symbols)

    added = rows.select(F.lit(0).cast("bigint").alias("_words"), F.array().cast(f"array<{RUN}>").alias("_runs"), F.lit("").alias("_collapsed")).schema
    return rows.mapInArrow(search, T.StructType([*rows.schema.fields[:-1], *added.fields]))


def strongest(runs: Column) -> Column:
    """The run of the largest length / period, compared as fractions, ties by start, then period; null if there is none."""
    start = F.lit(None).cast(RUN)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, start, lambda best, r: F.when(better(best, r), r).otherwise(best))


def plant_period(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where about a tenth of the texts is made periodic, as crc32 of the identifier says.

    With h the crc32 of the decimal identifier, g = floor(h / 10) and n words: if h
    % 10 = 0 and n > 0, every word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + floor((n - a) / (3 + g % 8)). Texts of null identifiers stay.
    """
    h = F.crc32(F.col(identifier).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(w, lambda _, i: F.get(w, place(i.cast("long")).cast("int"))), " ")

    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    # a lambda's variable, so that the text is split once and not for every word
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise("")), F.lit(0))
    return docs.withColumn(text, F.when(h % 10 == 0, made).otherwise(F.col(text)))
