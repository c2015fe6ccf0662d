"""Token files: exact round trips, checkpoints, checksums, and the query against whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomgrain.llm.queries import END_ID, QUERIES
from loomgrain.llm.token_files import Block, Coder, Frequencies, pack_block, read_tokens, tokenised, tokens_in_files, write_tokens
from loomgrain.llm.tokens import byte_bpe, word_bpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = list(" \n\t\r\x0b\x0c\x1c\x1f\x85  　'sStTre1290aABé.,!<|≯́ÅΣςßİ한글字😀‍_-\0H̱") + ["<|endoftext|>", "<|startoftext|>", " 's", "'ll", "  ", "ﬁ", " (foo", "Bar,"]


def table_of(ids):
    own, n = np.unique(ids, return_counts=True)
    return Frequencies.of(own, n)


@pytest.mark.parametrize(("name", "make", "lead", "plain"), [("word_bpe_49k.json", word_bpe, "", False), ("byte_bpe_50k.json", byte_bpe, " ", True)])
def test_pieces_give_the_ids_of_whole_texts(name, make, lead, plain):
    rnd = random.Random(4)
    texts = [lead + "".join(rnd.choice(ODD) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = plain
    encoder = make(public_tokenizers.path(name))
    for _ in range(2):  # known pieces too
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 5000, 70_000])
def test_round_trip_and_checkpoints(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.01, n), 40_000)
    ids[rnd.integers(0, n)] = 49_000  # a rare one
    coder = Coder(table_of(ids))
    block = Block.unpacked(pack_block(coder, [None, 7], np.array([0, n]), ids, lanes=64, every=1024))
    assert (block.ids(coder) == ids).all() and block.doc_ids == [None, 7] and block.lengths.tolist() == [0, n]
    for _ in range(10):
        a, b = sorted(rnd.integers(0, n + 1, 2).tolist())
        assert (block.span(coder, a, b) == ids[a:b]).all()


def test_size_is_near_the_entropy():
    rnd = np.random.default_rng(1)
    ids = np.minimum(rnd.zipf(1.3, 1 << 18), 49_000)
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n / n.sum() * np.log2(n / n.sum())).sum() * len(ids) / 8
    assert len(pack_block(Coder(table_of(ids)), [1], np.array([len(ids)]), ids)) < entropy * 1.08 + 4096


def test_frequencies_add_up():
    for n in (1, 2, 49_408, 60_000):
        counts = np.random.default_rng(n).integers(1, 10**9, n)
        counts[0] = 1
        t = Frequencies.of(np.arange(n), counts)
        assert t.scaled.sum() == 1 << t.bits and t.scaled.min() > 0
        assert (Frequencies.unpacked(t.packed()).scaled == t.scaled).all()


def test_damage_is_seen():
    ids = np.arange(3000) % 100
    coder = Coder(table_of(ids))
    data = pack_block(coder, [1], np.array([3000]), ids)
    for at in range(0, len(data), 97):
        with pytest.raises(ValueError):
            Block.unpacked(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        Block.unpacked(data[:-5])
    with pytest.raises(ValueError):
        Frequencies.unpacked(b"LGRTxxxxxxxxxxx")


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_texts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, SF).collect()) == expected(docs)


def test_many_files_and_blocks(spark, tmp_path, monkeypatch):
    """Small blocks and tasks: starts run on over blocks, files and parts, and a hot identifier is split."""
    from loomgrain.llm import token_files

    monkeypatch.setattr(token_files, "TASK_IDS", 300)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    monkeypatch.setattr(token_files, "ROLL_BYTES", 2000)
    rows = [(k if k % 3 else 5, f"word{k} " * (k % 17)) for k in range(200)] + [(None, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS start")
    index = write_tokens(tokenised(df, PATH, END_ID), tmp_path.as_uri())
    assert index.select("part").distinct().count() > 3 and index.count() > 10
    got = sorted((tuple(r) for r in read_tokens(index).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in rows], key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, np.array([*tokenizer.encode(t or "").ids, END_ID], "<u4").tobytes()) for d, t in rows)
    assert sorted((r[0] is not None, r[0] or 0, bytes(r[3])) for r in got) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert tokens_in_files(df, PATH, END_ID).collect() == []


def test_damaged_file_names_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words " * 500)], "doc_id long, text string")
    index = write_tokens(tokenised(df, PATH, END_ID), tmp_path.as_uri())
    (file,) = tmp_path.glob("*.ids")
    data = bytearray(file.read_bytes())
    data[-20] ^= 4
    file.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        read_tokens(index).collect()
