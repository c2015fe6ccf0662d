"""Operator 12: alignment of the tokens of two tokenizers.

The ends of both token sequences of a text are byte offsets. Divide and conquer
finds the ends that they share: from the middle of an interval outward, ends of
the first are bisected among those of the second; the first shared end cuts the
interval, both halves go on, and an interval without one is a leaf group. The
intervals of all texts of a batch go down together.

Links join tokens whose bytes overlap. How often a pair of ids is linked in the
corpus is summed by Spark; blocks of texts then ask for the counts of the pairs
that they hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import MOST_PIECES, before_words, byte_bpe, gathered

#: Bytes of text that are tokenised together, and links after which a block of texts ends.
GROUP_BYTES, BLOCK_LINKS = 1 << 19, 1 << 21


def byte_level_table(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Printable characters of Latin-1 stand for their own byte, the other bytes in
    order for the characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = sorted(set(range(256)) - set(own))
    of = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(other)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def piece_table(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    n = model.get_piece_size()
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(n) for p in [model.id_to_piece(i)]]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each of the ascending ``a_ends`` is one of ``b_ends``, inside the intervals of tokens first to last.

    The last end of each interval is known to be shared.
    """
    cut = np.zeros(len(a_ends), bool)
    cut[last] = True
    while True:
        wide = last > first  # one token has no end inside
        first, last = first[wide], last[wide]
        if not len(first):
            return cut
        middle = (first + last - 1) // 2
        found = np.full(len(first), -1)
        open_, step = np.arange(len(first)), 0
        while len(open_):
            for side in ((0,) if step == 0 else (step, -step)):
                at = middle[open_] + side
                inside = (at >= first[open_]) & (at < last[open_])
                want = a_ends[np.where(inside, at, 0)]
                place = np.searchsorted(b_ends, want)
                hit = inside & (b_ends[np.minimum(place, len(b_ends) - 1)] == want)
                found[open_[hit]] = at[hit]
                open_ = open_[~hit]
            step += 1
            left = (middle[open_] - step >= first[open_]) | (middle[open_] + step < last[open_])
            open_ = open_[left]
        cut[found[found >= 0]] = True
        split = found >= 0  # the others are leaf groups
        first, last = np.concatenate([first[split], found[split] + 1]), np.concatenate([found[split], last[split]])


def _sections(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Aligner:
    """Tokens, groups and links of batches of texts; made once in a task.

    Texts are cut before words, where the tokens of both tokenizers end (for the second this is
    so if none of its pieces has a space after another character), and each distinct
    piece is tokenised once. Divide and conquer goes on from these cuts.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = byte_bpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_table(self.a.tokenizer.get_vocab()), piece_table(self.b)
        self.local = all("▁" not in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
        self._forget()
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        number = lambda n, mark: np.array([b"%d%s" % (i, mark) for i in range(n)], object)
        self.a_more, self.a_last = number(len(self.bytes_a), b","), number(len(self.bytes_a), b"|")
        self.b_more, self.b_last = number(len(self.bytes_b), b","), number(len(self.bytes_b), b";")

    def _forget(self) -> None:
        self.known, self.good = pa.array([], pa.string()), np.empty(0, bool)
        self.flat, self.ends = [np.empty(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def _pieces(self, pieces: pa.Array) -> np.ndarray:
        """The places of the pieces among the known ones; new ones are tokenised."""
        if len(self.known) > MOST_PIECES:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        ids_a, n_a = self.a.made(new)
        texts = new.to_pylist()
        lists = self.b.encode([t[1:] for t in texts], num_threads=1)  # it adds the space that each piece begins with
        ids_b, n_b = np.fromiter(chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists], np.int64)
        a, b = (b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        ends_a, ends_b = (np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist() for sizes, ids, n in ((self.sizes_a, ids_a, n_a), (self.sizes_b, ids_b, n_b)))
        same = [a[x0:x1] == t.encode() == b[y0:y1] for t, x0, x1, y0, y1 in zip(texts, ends_a, ends_a[1:], ends_b, ends_b[1:], strict=False)]
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        self.known, self.good = pa.concat_arrays([self.known, new]), np.concatenate([self.good, np.array(same, bool)])
        self.flat = [np.concatenate([f, i.astype(np.int32)]) for f, i in zip(self.flat, (ids_a, ids_b), strict=True)]
        self.ends = [np.concatenate([e, e[-1] + np.cumsum(n)]) for e, n in zip(self.ends, (n_a, n_b), strict=True)]
        return place

    def align(self, texts: pa.Array) -> dict:
        """Columns for texts (no nulls): n_a, n_b, n_groups, n_links, groups (bytes) and, for links, text, id pair and how often."""
        lead = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
        lists = before_words(lead) if self.local else pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1), pa.int32()), lead)
        words = lists.flatten().dictionary_encode()
        at = lists.offsets.to_numpy()
        which = self._pieces(words.dictionary)[words.indices.to_numpy()]
        good = (pc.binary_length(lead).to_numpy() > 1) & (np.diff(np.concatenate([[0], np.cumsum(~self.good[which])])[at]) == 0)
        kept = np.flatnonzero(good)
        which = which[np.repeat(good, np.diff(at))]
        text_of = np.repeat(np.arange(len(texts)), np.where(good, np.diff(at), 0))
        starts, sizes = ([e[which] for e in self.ends], [e[which + 1] - e[which] for e in self.ends])
        n_a, n_b = (np.bincount(text_of, n, len(texts)).astype(np.int64) for n in sizes)
        ids_a, ids_b = (gathered(f, x, n) for f, x, n in zip(self.flat, starts, sizes, strict=True))
        zero = np.zeros(len(texts), np.int64)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": zero, "n_links": zero.copy(), "groups": [b""] * len(texts)}
        if not len(kept):
            return out | {"pairs": np.empty(0, np.int64), "times": np.empty(0, np.int64), "at": np.zeros(len(texts) + 1, np.int64)}
        a_ends, b_ends = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        a_stop, b_stop = np.cumsum(n_a[kept]), np.cumsum(n_b[kept])  # where each text's tokens stop
        stops = np.cumsum(sizes[0])
        cut = shared_cuts(a_ends, b_ends, stops - sizes[0], stops - 1)
        cut_a = np.flatnonzero(cut)
        cut_b = np.searchsorted(b_ends, a_ends[cut_a])
        out["n_groups"] = zero.copy()
        out["n_groups"][kept] = np.diff(np.searchsorted(cut_a, np.concatenate([[0], a_stop])))
        # in a leaf group the tokens of one sequence come before those of the other
        group_a = np.searchsorted(cut_a, np.arange(len(ids_a)))
        group_b = np.searchsorted(cut_b, np.arange(len(ids_b)))
        b_before = np.concatenate([[0], cut_b + 1])
        line = np.empty(len(ids_a) + len(ids_b), object)
        place = np.arange(len(ids_a)) + b_before[group_a]
        line[place] = self.a_more[ids_a]
        line[place[cut_a]] = self.a_last[ids_a[cut_a]]
        place = np.arange(len(ids_b)) + cut_a[group_b] + 1
        line[place] = self.b_more[ids_b]
        line[place[cut_b]] = self.b_last[ids_b[cut_b]]
        ends = a_stop + b_stop
        for k, lo, hi in zip(kept.tolist(), (ends - n_a[kept] - n_b[kept]).tolist(), ends.tolist(), strict=True):
            out["groups"][k] = b"".join(line[lo:hi].tolist())[:-1]
        # inside a group each end of either sequence ends one overlap; shared ends end only one
        inner = np.ones(len(ids_b), bool)
        inner[cut_b] = False
        own_b = b_ends[inner]
        in_a = np.arange(len(a_ends)) + np.searchsorted(own_b, a_ends)  # where the ends of the first stand among all
        is_a = np.zeros(len(a_ends) + len(own_b), bool)
        is_a[in_a] = True
        is_b = ~is_a
        is_b[in_a[cut_a]] = True
        link_a, link_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        pair = ids_a[link_a].astype(np.int64) * len(self.bytes_b) + ids_b[link_b]
        text = np.searchsorted(a_stop, link_a, "right")
        out["n_links"][kept] = np.bincount(text, minlength=len(kept))
        span = len(self.bytes_a) * len(self.bytes_b)
        keyed, times = np.unique(text * span + pair, return_counts=True)
        at = np.zeros(len(texts), np.int64)
        at[kept] = np.bincount(keyed // span, minlength=len(kept))
        return out | {"pairs": keyed % span, "times": times, "at": np.concatenate([[0], np.cumsum(at)])}


def aligned(docs: DataFrame, path_a: str, path_b: str, identifier: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row a row of ``docs``: the identifier, n_a, n_b, n_groups, n_links, groups, and its links by pair for ``with_counts``.

    groups is ``a1,a2|b1;a3|b2,b3``: ids of both tokenizers by group; with
    ``digest`` its SHA-256. Null and empty texts, and those that one of the
    tokenizers changes, have no tokens: zeros and an empty string.
    """
    kind = dict(docs.dtypes)[identifier]
    rows = docs.select(F.col(identifier).alias("identifier"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        block, links = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                base = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, base + GROUP_BYTES, "right")))
                own = batch.slice(begin, end - begin)
                found = aligner.align(own.column(1))
                total = links + np.cumsum(found["n_links"])
                blocks = block + total // BLOCK_LINKS
                block, links = int(blocks[-1]), int(total[-1]) % BLOCK_LINKS
                groups = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in found["groups"]]
                pairs, times = found["pairs"].astype("<u4"), found["times"].astype("<u4")
                columns = [own.column(0), *(pa.array(found[n]) for n in ("n_a", "n_b", "n_groups", "n_links")), pa.array(groups, pa.string()), pa.array(blocks),
                           pa.array(_sections(pairs, found["at"]), pa.binary()), pa.array(_sections(times, found["at"]), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                begin = end

    names = ["identifier", "n_a", "n_b", "n_groups", "n_links", "groups", "_block", "_pairs", "_times"]
    return rows.mapInArrow(run, f"identifier {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, _block bigint, _pairs binary, _times binary")


def pair_counts(tokenised: DataFrame, pieces: int) -> DataFrame:
    """(pair, n, best): how many links each pair of ids has in all texts, and whether that is the most of its second id (``pair % pieces``)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").astype(np.int64) for k in (0, 1))
            own, which = np.unique(pairs, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(which, times, len(own)).astype(np.int64))], names=["pair", "n"])

    counted = tokenised.select("_pairs", "_times").mapInArrow(sums, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # an id has at most as many pairs as the other vocabulary has ids
    most = F.max("n").over(Window.partitionBy(F.col("pair") % pieces))
    return counted.withColumn("best", F.col("n") == most)


def with_counts(tokenised: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tokenised`` (a written table) with n_best and count_sum, sums over its links. ``pairs`` is a written table.

    Each block of texts asks once for every pair that it holds; its answers and
    its rows meet in one group, whose size the block bounds.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    own = np.unique(np.frombuffer(b"".join(batch.column(1).slice(lo, hi - lo).to_pylist()), "<u4"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), blocks[lo])), pa.array(own.astype(np.int64))], names=["_block", "pair"])

    def answered(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        known, first = np.unique(answers.column("pair").to_numpy(), return_index=True)
        n, best = answers.column("n").to_numpy()[first], answers.column("best").to_numpy()[first]
        sums, bests = [], []
        for pairs_, times_ in zip(rows.column("_pairs"), rows.column("_times"), strict=True):
            at = np.searchsorted(known, np.frombuffer(pairs_.as_buffer(), "<u4").astype(np.int64))
            times = np.frombuffer(times_.as_buffer(), "<u4").astype(np.int64)
            sums.append(int((times * n[at]).sum()))
            bests.append(int(times[best[at]].sum()))
        return rows.select(shown).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    shown = [c for c in tokenised.columns if not c.startswith("_")]
    ask = tokenised.select("_block", "_pairs").mapInArrow(asked, "_block bigint, pair bigint")
    answers = ask.join(pairs, "pair").select("_block", "pair", "n", "best")
    schema = ", ".join(f"{c} {t}" for c, t in tokenised.dtypes if c in shown) + ", n_best bigint, count_sum bigint"
    return tokenised.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(answered, schema)


def align_corpus(docs: DataFrame, path_a: str, path_b: str, identifier: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """identifier, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of each row of ``docs``.

    ``path_a`` is a byte-level file of the tokenizers library, which gets a space
    and the text, ``path_b`` a model of sentencepiece, which adds the space; special
    tokens aren't known in texts. n_best counts links whose pair has the most
    links of all pairs with its second id, ties included; count_sum adds the
    links of each link's pair in the corpus. Repeated rows count as often as they
    are there; nulls and ties have no other effect; an empty table gives none;
    other columns are not read.
    """
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    tokenised = materialise(aligned(docs, path_a, path_b, identifier, text, digest), "aligned", compression="zstd")
    pairs = materialise(pair_counts(tokenised, pieces), "pairs")
    return with_counts(tokenised, pairs)
