"""Operator 13: token ids in files, coded by a range asymmetric numeral system.

One frequency table, made from all ids and scaled to a power of two, is shared by
all files of a folder. Ids are written in blocks of whole documents. A block deals
its ids to interleaved lanes, each a coder with its own state, which are worked on
together. Blocks are independent, have checksums, and hold checkpoints (lane
states and places), from which a reader can start in the middle.

A block is its header (``HEADER``), the packed list of its documents (which are
null, identifiers, lengths), the checkpoints and the words, and a checksum of all this.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch
from .tokens import word_bpe

#: Ids after which a block ends, lanes, and ids between checkpoints (a multiple of the lanes).
BLOCK_IDS, LANES, EVERY = 1 << 19, 2048, 1 << 18
#: Ids a task writes, about; a file ends after so many bytes.
TASK_IDS, ROLL_BYTES = 1 << 23, 64 << 20
#: States lie between 2^31 and 2^63; 32 bits at a time leave or enter them.
_LOW, _OUT = np.uint64(31), np.uint64(32)
MAGIC, TABLE_MAGIC = b"LGR1", b"LGRT"
#: Magic, documents, ids, words, lanes, checkpoints, bytes of the packed list, CRC-32 of the ids.
HEADER = "<4sIQQIIQI"
HEADER_BYTES = struct.calcsize(HEADER)
TABLE_NAME = "frequencies.bin"


@dataclass
class Frequencies:
    """Scaled frequencies of the ids that occur; they add up to 2^bits and none is 0."""

    ids: np.ndarray
    scaled: np.ndarray
    bits: int

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        """Scale counts (ids ascending, counts above 0), largest remainders first, ties by id."""
        bits = max(16, int(len(ids)).bit_length() + 2)
        if not len(ids):
            return cls(ids.astype(np.int64), counts.astype(np.int64), bits)
        room = (1 << bits) - len(ids)  # each id has one place
        share = counts.astype(np.float64) * (room / counts.sum(dtype=np.float64))
        scaled = np.floor(share).astype(np.int64)
        rest = room - int(scaled.sum())
        scaled[np.argsort(scaled - share, kind="stable")[:rest]] += 1
        return cls(ids.astype(np.int64), scaled + 1, bits)

    def packed(self) -> bytes:
        body = TABLE_MAGIC + struct.pack("<II", self.bits, len(self.ids)) + self.ids.astype("<u4").tobytes() + self.scaled.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def unpacked(cls, data: bytes) -> Frequencies:
        if data[:4] != TABLE_MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("frequency table: checksum does not fit")
        bits, n = struct.unpack_from("<II", data, 4)
        ids, scaled = np.frombuffer(data, "<u4", 2 * n, 12).astype(np.int64).reshape(2, n)
        return cls(ids, scaled, bits)


class Coder:
    """Codes arrays of ids by one table of frequencies."""

    def __init__(self, table: Frequencies) -> None:
        self.bits = np.uint64(table.bits)
        self.ids, self.freq = table.ids, table.scaled.astype(np.uint64)
        self.start = (np.cumsum(table.scaled) - table.scaled).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(table.ids), dtype=np.int32), table.scaled)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, places, states): the stream, and for each checkpoint where its words begin and the state of each lane.

        Id i belongs to lane i % lanes. Coding goes backwards, so that reading goes forwards.
        """
        place = np.searchsorted(self.ids, ids)
        freq, start = self.freq[place], self.start[place]
        limit = freq << (np.uint64(63) - self.bits)
        state = np.full(lanes, 1 << 31, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for lo in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            hi = min(lo + lanes, len(ids))
            x = state[: hi - lo]
            over = x >= limit[lo:hi]
            words = x[over]
            if len(words):
                out.append(words.astype(np.uint32))
                written += len(words)
                x[over] = words >> _OUT
            f = freq[lo:hi]
            q = x // f
            state[: hi - lo] = (q << self.bits) + (x - q * f) + start[lo:hi]
            if lo % every == 0:
                marks.append((written, state.copy()))
        marks.reverse()
        stream = np.concatenate([np.empty(0, np.uint32), *reversed(out)])
        return stream, np.array([written - w for w, _ in marks], np.int64), np.array([s for _, s in marks], np.uint64).reshape(len(marks), lanes)

    def decode(self, words: np.ndarray, at: int, state: np.ndarray, count: int) -> np.ndarray:
        """``count`` ids from a checkpoint on, whose words begin at ``at``; the state is changed."""
        lanes, out = len(state), np.empty(count, np.int32)
        mask, low = np.uint64((1 << int(self.bits)) - 1), np.uint64(1 << 31)
        for lo in range(0, count, lanes):
            hi = min(lo + lanes, count)
            x = state[: hi - lo]
            slot = x & mask
            own = self.slots[slot]
            out[lo:hi] = own
            x = self.freq[own] * (x >> self.bits) + slot - self.start[own]
            less = x < low
            n = int(np.count_nonzero(less))
            if n:
                x[less] = (x[less] << _OUT) | words[at : at + n].astype(np.uint64)
                at += n
            state[: hi - lo] = x
        return self.ids[out]


def pack_block(coder: Coder, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
    """A block of whole documents."""
    lanes = max(1, min(lanes, len(ids)))
    every = max(1, every // lanes) * lanes
    words, places, states = coder.encode(ids, lanes, every) if len(ids) else (np.empty(0, np.uint32), np.empty(0, np.int64), np.empty((0, lanes), np.uint64))
    null = np.array([d is None for d in doc_ids], np.uint8)
    listed = zlib.compress(null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<u8").tobytes(), 1)
    head = struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), len(words), lanes, len(places), len(listed), zlib.crc32(ids.astype("<u4").tobytes()))
    body = head + struct.pack("<I", every) + listed + places.astype("<u8").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Block:
    """A checked block: its documents, and ids from any place on."""

    doc_ids: list[int | None]
    lengths: np.ndarray
    n_ids: int
    every: int
    places: np.ndarray
    states: np.ndarray
    words: np.ndarray
    crc: int

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        """ValueError says which check failed."""
        if len(data) < HEADER_BYTES + 8 or data[:4] != MAGIC:
            raise ValueError("no block")
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("block checksum does not fit")
        _, docs, n_ids, n_words, lanes, marks, packed, crc = struct.unpack_from(HEADER, data)
        (every,) = struct.unpack_from("<I", data, HEADER_BYTES)
        at = HEADER_BYTES + 4
        listed = zlib.decompress(data[at : at + packed])
        at += packed
        null, own = np.frombuffer(listed, np.uint8, docs), np.frombuffer(listed, "<i8", docs, docs)
        places = np.frombuffer(data, "<u8", marks, at).astype(np.int64)
        states = np.frombuffer(data, "<u8", marks * lanes, at + 8 * marks).reshape(marks, lanes)
        words = np.frombuffer(data, "<u4", n_words, at + 8 * marks * (1 + lanes))
        return cls([None if x else d for x, d in zip(null.tolist(), own.tolist(), strict=True)], np.frombuffer(listed, "<u8", docs, 9 * docs).astype(np.int64), n_ids, every, places, states, words, crc)

    def span(self, coder: Coder, begin: int, end: int) -> np.ndarray:
        """Ids begin to end, read from the last checkpoint before them."""
        mark = begin // self.every
        if begin >= end:
            return np.empty(0, np.int64)
        first = mark * self.every
        return coder.decode(self.words, int(self.places[mark]), self.states[mark].astype(np.uint64), end - first)[begin - first :]

    def ids(self, coder: Coder) -> np.ndarray:
        """All ids; ValueError if their checksum or the last states don't fit."""
        if not self.n_ids:
            return np.empty(0, np.int64)
        state = self.states[0].astype(np.uint64)
        out = coder.decode(self.words, 0, state, self.n_ids)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc or (state != np.uint64(1 << 31)).any():
            raise ValueError("ids don't fit their checksum")
        return out


def tokenised(docs: DataFrame, path: str, end_id: int, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, row, n_tokens, ids): the ids of each text and ``end_id`` as little-endian numbers of 16 bits (32, if the vocabulary needs it).

    key is a hash of the ids, and row a number for each row: they order rows of one identifier.
    """
    rows = docs.select(F.col(identifier).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread of the library would hold memory of its own
        encoder = word_bpe(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ends = np.cumsum([0, *(len(x.as_buffer()) for x in batch.column(1))])
            begin = 0
            while begin < batch.num_rows:
                stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + GROUP_BYTES, "right")) - 1)
                own = batch.slice(begin, stop - begin)
                ids, at = encoder.encode(own.column(1))
                found = [ids[a:b].tobytes() + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.diff(at) + 1), pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])
                begin = stop

    made = rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")
    return made.select("doc_id", F.xxhash64("ids").alias("key"), F.monotonically_increasing_id().alias("row"), "n_tokens", "ids")


#: Bytes of text that are tokenised together.
GROUP_BYTES = 4 << 20


def frequencies(rows: DataFrame) -> Frequencies:
    """Frequencies of all ids of ``rows``. One row an id reaches the driver, so the vocabulary bounds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            n = batch.column(1).to_numpy()
            widths = pc.binary_length(batch.column(0)).to_numpy() // n
            for width in np.unique(widths).tolist():
                ids = batch.column(0).filter(pa.array(widths == width))
                begin, *_, end = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset).tolist()
                own = np.frombuffer(ids.buffers()[2], f"<u{width}", (end - begin) // width, begin)
                total[width] = total.get(width, 0) + np.bincount(own, minlength=1 << 20)
        counts = sum(total.values()) if total else np.zeros(0, np.int64)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["id", "n"])

    counted = rows.select("ids", "n_tokens").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return Frequencies.of(counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_tokens(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` (a written table as of ``tokenised``) below ``path`` by ascending doc_id, nulls first.

    Returns a written table with one row for each block: file, part, block, offset,
    bytes, docs, ids and start, the ids before it. Rows are dealt by ranges of identifier, hash and row, so that
    a hot identifier is split. A task names its own files; only those of finished tasks are listed.
    """
    table = frequencies(rows)
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{TABLE_NAME}", compression=None) as f:
        f.write(table.packed())
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // TASK_IDS))
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "key", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "key", "row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        coder, part = Coder(table), TaskContext.get().partitionId()
        done: list[tuple] = []
        doc_ids: list[int | None] = []
        texts: list[np.ndarray] = []
        out, name, size, waiting = None, "", 0, 0

        def flush() -> None:
            nonlocal out, name, size, waiting, doc_ids, texts
            if out is None:
                name, size = f"{part:07d}-{uuid.uuid4().hex}.ids", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            ids = np.concatenate(texts)
            data = pack_block(coder, doc_ids, np.array([len(t) for t in texts], np.int64), ids)
            out.write(data)
            done.append((f"{path}/{name}", part, len(done), size, len(data), len(doc_ids), len(ids)))
            size, waiting, doc_ids, texts = size + len(data), 0, [], []
            if size >= ROLL_BYTES:
                out.close()
                out = None

        for batch in batches:
            for i, (n, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                own = np.frombuffer(ids.as_buffer(), f"<u{len(ids.as_buffer()) // n}")
                doc_ids.append(batch.column(0)[i].as_py())
                texts.append(own.astype(np.int32))
                waiting += n
                if waiting >= BLOCK_IDS:
                    flush()
        if doc_ids:
            flush()
        if out is not None:
            out.close()
        columns = zip(*done, strict=True) if done else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 6], strict=True)], names=["file", "part", "block", "offset", "bytes", "docs", "ids"])

    written = ordered.select("doc_id", "n_tokens", "ids").mapInArrow(write, "file string, part long, block long, offset long, bytes long, docs long, ids long")
    return materialise(_with_starts(materialise(written, "token-blocks")), "token-index")


def _with_starts(blocks: DataFrame, width: int = 1024) -> DataFrame:
    """``blocks`` with start, the ids of all blocks before: within a part, of parts within a thousand, and of these."""

    def before(rows: DataFrame, order: str, by: list[str], name: str, value: str = "ids") -> DataFrame:
        frame = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(frame), F.lit(0)))

    far = F.floor(F.col("part") / width).alias("far")
    parts = blocks.groupBy(far, "part").agg(F.sum("ids").alias("own"))
    fars = before(parts.groupBy("far").agg(F.sum("own").alias("whole")), "far", [], "far_start", "whole")
    parts = before(parts, "part", ["far"], "part_start", "own").join(fars.select("far", "far_start"), "far")
    inside = before(blocks, "block", ["part"], "block_start").join(parts.select("part", "part_start", "far_start"), "part")
    return inside.select(*blocks.columns, (F.col("far_start") + F.col("part_start") + F.col("block_start")).alias("start"))


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in ``blocks`` (file, offset, bytes, start); ids are little-endian numbers of 32 bits.

    Blocks are read and decoded independently. Damage raises a ValueError that names file and offset.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[str, Coder] = {}
        for batch in batches:
            for file, offset, size, start in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                fs, where = _open(file)
                folder = where.rsplit("/", 1)[0]
                if folder not in coders:
                    with fs.open_input_file(f"{folder}/{TABLE_NAME}") as f:
                        coders[folder] = Coder(Frequencies.unpacked(f.read()))
                with fs.open_input_file(where) as f:
                    f.seek(offset)
                    data = f.read(size)
                try:
                    block = Block.unpacked(data)
                    ids = block.ids(coders[folder]).astype("<u4")
                except ValueError as e:
                    raise ValueError(f"{file} at {offset}: {e}") from None
                ends = np.cumsum(block.lengths)
                own = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 4 * ends).astype("<i4")), pa.py_buffer(ids)])
                columns = [pa.array(block.doc_ids, pa.int64()), pa.array(start + ends - block.lengths), pa.array(block.lengths), own]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    chosen = blocks.select("file", "offset", "bytes", "start")
    tasks = max(1, min(10_000, -(-chosen.count() // 8)))
    return chosen.repartition(tasks).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def tokens_in_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise ``docs``, write the ids below ``path`` and return what is read back: doc_id, start, n_tokens, ids (32-bit little-endian).

    ``tokenizer`` is a file of the tokenizers library for a tokenizer that drops white space; ``end_id`` follows each
    text. start counts the ids of all documents before in the order of doc_id, nulls first, rows of one doc_id by a hash of their
    ids. A null text is empty and has the end alone; repeated rows are written as often as they are there; an empty table
    gives no rows; other columns are not read.
    """
    path = path or scratch(docs.sparkSession, "token-files")
    rows = materialise(tokenised(docs, tokenizer, end_id, identifier, text), "tokenised")
    return read_tokens(write_tokens(rows, path))
