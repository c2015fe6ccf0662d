"""Operator 5: language-model scores by deleted interpolation.

Bigram and unigram maximum-likelihood estimates and a uniform floor are mixed with
weights that depend on how often the context was seen. The weights are learned by
expectation-maximisation on held-out counts: each block of documents in turn is
deleted from the counts and predicted from the rest.

Counts of a corpus don't fit one machine, and joining every token with them would
shuffle far more than the corpus. So documents are dealt into blocks of bounded
size, and a block asks for the counts of its *distinct* words and pairs: it sends
each shard of the count table the sorted hashes that fall there with its own
counts, and the shard adds up all blocks' counts and answers in the same order, so
that answers carry no keys. The block finds the order again from its texts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Context-frequency buckets: powers of two.
BUCKETS = 40
#: Steps of one octave into which the held-out estimates are binned for the weights.
STEPS = 2
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_REQUESTS = "kind int, shard long, block long, keys binary, counts binary"
_ANSWERS = "block long, kind int, shard long, totals binary, n_distinct long, n_tokens long"
_BINS = "bucket int, q2 int, q1 int, weight double, log2 double, log1 double"


#: Bytes of input from which on blocks grow with its square root: at 100 times this size they are ten times as large.
GROWING = 1 << 40
#: Bytes of a hash that are sent; the shard tells apart what they don't.
KEY_BYTES = 7


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8")


@dataclass
class Block:
    """The tokens of some documents as numbers of their distinct words and pairs."""

    ends: np.ndarray  # end of each document in the tokens
    word: np.ndarray  # word number of each token
    pair: np.ndarray  # pair number of each token with the one before it; the end of a text stands before its start
    pair_before: np.ndarray  # word number of each pair's first
    pair_word: np.ndarray  # word number of each pair's second
    train: np.ndarray  # whether each token is learned from
    keys: tuple[np.ndarray, np.ndarray]  # hashes of the words and of the pairs

    @classmethod
    def of(cls, texts: list[bytes], train: np.ndarray) -> Block:
        number: dict[bytes, int] = defaultdict(count().__next__)  # words get numbers as they come; only distinct ones are kept
        end = number[b""]  # the end of a text; no word is empty
        parts = []
        for text in texts:
            words = text.lower().split()  # on bytes: A-Z and ASCII white space only
            words.append(b"")
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        word = np.concatenate(parts) if parts else np.empty(0, np.int32)
        del parts
        before = np.concatenate((np.array([end], np.int32), word[:-1]))[: len(word)]
        n = len(number)
        both, pair = np.unique(before.astype(np.int64) * n + word, return_inverse=True)
        del before
        first, second = np.divmod(both, n)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, n)
        pairs = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second]
        pairs ^= pairs >> np.uint64(32)
        pairs *= np.uint64(0xD6E8FEB86659FD93)
        pairs ^= pairs >> np.uint64(32)
        return cls(ends, word, pair.reshape(-1).astype(np.int32), first, second, np.repeat(train, sizes), (hashes, pairs))

    def own(self, kind: int) -> np.ndarray:
        """Counts of the words (0) or pairs (1) in this block's training texts."""
        return np.bincount((self.word, self.pair)[kind][self.train], minlength=len(self.keys[kind]))

    def order(self, kind: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Word or pair numbers by shard and hash, and where each shard starts."""
        keys = self.keys[kind]
        shard = (keys % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((keys, shard))
        return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _block_of(table: pa.Table) -> Block:
    return Block.of([t.as_py() for t in table.column("body")], ~table.column("held").to_numpy())


def _totals(own: Block, answers: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's words and pairs in all training texts."""
    out = []
    rows = sorted(zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("totals"), strict=True), key=lambda r: r[:2])
    for kind in (0, 1):
        order, _ = own.order(kind, shards)
        got = [np.frombuffer(r[2].as_py(), np.int64) for r in rows if r[0] == kind]
        totals = np.zeros(len(order), np.int64)
        totals[order] = np.concatenate(got) if got else []
        out.append(totals)
    return out[0], out[1]


def bucket_of(context_counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two."""
    return np.minimum(np.frexp(context_counts.astype(np.float64))[1], BUCKETS - 1)


def learn_weights(bins: np.ndarray, floor: float, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket by expectation-maximisation.

    ``bins`` has rows (bucket, weight, bigram estimate, unigram estimate). A bucket
    without held-out tokens takes the weights of all.
    """

    def fit(rows: np.ndarray) -> np.ndarray:
        p = np.column_stack((rows[:, 2], rows[:, 3], np.full(len(rows), floor)))
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = p * w
            part /= part.sum(axis=1, keepdims=True)
            w = rows[:, 1] @ part / rows[:, 1].sum()
        w = np.maximum(w, 1e-7)  # no token may get probability zero
        return w / w.sum()

    overall = fit(bins) if len(bins) else np.array([0.5, 0.4, 0.1])
    out = np.tile(overall, (BUCKETS, 1))
    for b in range(BUCKETS):
        if (rows := bins[bins[:, 0] == b]).size:
            out[b] = fit(rows)
    out[0] = [0.0, *(out[0][1:] / out[0][1:].sum())]  # an unseen context has no bigram estimate
    return out


def score_documents(docs: DataFrame, held_out: Column, block_bytes: int = 8 << 20, min_blocks: int = 8) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): SCORES.

    Learns from rows where ``held_out`` (over doc_id) is not true; null counts as
    not held out. Tokens are the words of the text, A-Z lower-cased, and one end.
    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))), score the log10 of the
    mixed bigram model, both over all tokens of the whole text.

    Nulls: a null text counts as empty and has its end only. Repeated rows are
    counted and scored each; rows equal in doc_id and text share a block. Without
    training rows both scores are 0. Empty tables give no rows; other columns are
    not read. Very long texts are scored whole, by one task each. A block is about
    ``block_bytes`` (and grows with the root of the input beyond ``GROWING``) or its
    longest text, or what rows equal in doc_id and text take together: nothing but
    their place tells these apart. ``min_blocks`` is for small inputs, where
    deleting a block must leave something.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), body.alias("body"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    # blocks times shards would grow with the square of the input; blocks that grow with its root keep the requests in proportion
    n_blocks = max(min_blocks, math.ceil(size / (block_bytes * max(1.0, math.sqrt(size / GROWING)))))
    shards = n_blocks
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "body"), F.lit(n_blocks)))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        own = _block_of(table)
        out = []
        for kind in (0, 1):
            order, starts = own.order(kind, shards)
            keys, counts = own.keys[kind][order], own.own(kind)[order].astype(np.int32)
            out += [(kind, s, key[0].as_py(), _packed(keys[a:b]), counts[a:b].tobytes()) for s, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if b > a]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _REQUESTS.split(", ")])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        keys = [_unpacked(k.as_py()) for k in table.column("keys")]
        counts = np.concatenate([np.frombuffer(c.as_py(), np.int32) for c in table.column("counts")])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place.reshape(-1), weights=counts, minlength=len(distinct)).astype(np.int64)
        of = np.split(totals[place.reshape(-1)], np.cumsum([len(k) for k in keys])[:-1])
        n, kind, shard = len(keys), key[0].as_py(), key[1].as_py()
        return pa.Table.from_arrays(
            [
                pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
                pa.array([kind] * (n + 1), pa.int32()),
                pa.array([shard] * (n + 1), pa.int64()),
                pa.array([*(t.tobytes() for t in of), b""], pa.binary()),
                pa.array([*[None] * n, int((totals > 0).sum())], pa.int64()),
                pa.array([*[None] * n, int(totals.sum())], pa.int64()),
            ],
            [x.split()[0] for x in _ANSWERS.split(", ")],
        )

    requests = rows.groupBy("block").applyInArrow(ask, _REQUESTS)
    answers = materialise(requests.groupBy("kind", "shard").applyInArrow(answer, _ANSWERS), "lm-counts")
    known = answers.where("block = -1 AND kind = 0").agg(F.sum("n_distinct"), F.sum("n_tokens")).first()
    v, n = int(known[0] or 0), int(known[1] or 0)
    floor = 1 / (v + 1)
    answers = answers.where("block >= 0").select("block", "kind", "shard", "totals")

    def held_out_bins(texts: pa.Table, got: pa.Table) -> pa.Table:
        own = _block_of(texts)
        words, pairs = _totals(own, got, shards)
        own_words, own_pairs = own.own(0), own.own(1)
        here = np.flatnonzero(own_pairs)
        rest = n - int(own_words.sum())
        context = (words - own_words)[own.pair_before[here]]
        p2 = (pairs - own_pairs)[here] / np.maximum(context, 1)
        p1 = (words - own_words)[own.pair_word[here]] / max(rest, 1)
        with np.errstate(divide="ignore"):
            l2, l1 = np.log2(p2), np.log2(p1)
        q2 = np.where(p2 > 0, np.floor(l2 * STEPS), 1).astype(np.int64)
        q1 = np.where(p1 > 0, np.floor(l1 * STEPS), 1).astype(np.int64)
        l2, l1 = np.where(p2 > 0, l2, 0), np.where(p1 > 0, l1, 0)
        # one number a cell: estimates are above 2 ** -200, so the binned ones have a width of 512
        code = (bucket_of(context).astype(np.int64) * 512 + (q2 + 500)) * 512 + (q1 + 500)
        cell, place = np.unique(code, return_inverse=True)
        sums = [np.bincount(place, weights=own_pairs[here] * x, minlength=len(cell)).astype(np.float64) for x in (1, l2, l1)]
        parts = (cell // 512**2, cell // 512 % 512 - 500, cell % 512 - 500)
        return pa.Table.from_arrays([*(pa.array(x.astype(np.int32)) for x in parts), *map(pa.array, sums)], [x.split()[0] for x in _BINS.split(", ")])

    def with_answers(fn, schema: str) -> DataFrame:
        return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fn, schema)

    bins = with_answers(held_out_bins, _BINS).groupBy("bucket", "q2", "q1").agg(F.sum("weight").alias("weight"), F.sum("log2").alias("log2"), F.sum("log1").alias("log1"))
    cells = [  # a bounded number: buckets times binned estimates
        (r["bucket"], r["weight"], 2 ** (r["log2"] / r["weight"]) if r["q2"] < 1 else 0.0, 2 ** (r["log1"] / r["weight"]) if r["q1"] < 1 else 0.0)
        for r in materialise(bins, "lm-held-out").orderBy("bucket", "q2", "q1").collect()
    ]
    weights = learn_weights(np.array(cells, np.float64).reshape(-1, 4), floor) if n else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def score(texts: pa.Table, got: pa.Table) -> pa.Table:
        own = _block_of(texts)
        words, pairs = _totals(own, got, shards)
        context = words[own.pair_before]
        mix = weights[bucket_of(context)]
        p = mix[:, 0] * pairs / np.maximum(context, 1) + mix[:, 1] * words[own.pair_word] / max(n, 1) + mix[:, 2] * floor
        starts = np.concatenate(([0], own.ends[:-1]))
        each = lambda x: np.add.reduceat(x, starts)
        base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))[own.word]
        return pa.Table.from_arrays(
            [
                texts.column("doc_id"),
                texts.column("held"),
                pa.array(own.ends - starts),
                pa.array(each((words > 0).astype(np.int64)[own.word])),
                pa.array(np.full(len(starts), n)),
                pa.array(each(base)),
                pa.array(each(np.log10(p)[own.pair])),
            ],
            [x.split()[0] for x in SCORES.split(", ")],
        )

    return with_answers(score, SCORES)
