"""Alignment of two tokenizers against sets and double loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgrain.llm.align import align_corpus, byte_level_table, piece_table, shared_cuts
from loomgrain.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def brute(rows, models):
    a, b = models
    table_a, table_b = byte_level_table(a.get_vocab()), piece_table(b)
    texts, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""  # noqa: PLW2901
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        want = (" " + text).encode()
        if not text or b"".join(table_a[i] for i in ids_a) != want or b"".join(table_b[i] for i in ids_b) != want:
            texts.append((doc_id, None))
            continue
        sa, sb = spans(ids_a, table_a), spans(ids_b, table_b)
        links, j = [], 0
        for lo, hi, x in sa:
            while sb[j][1] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < hi:
                links.append((x, sb[k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, i, j = [], 0, 0
        for c in cuts:
            own_a, own_b = [], []
            while i < len(sa) and sa[i][1] <= c:
                own_a.append(str(sa[i][2]))
                i += 1
            while j < len(sb) and sb[j][1] <= c:
                own_b.append(str(sb[j][2]))
                j += 1
            groups.append(",".join(own_a) + "|" + ",".join(own_b))
        counts.update(links)
        texts.append((doc_id, (len(ids_a), len(ids_b), len(groups), links, ";".join(groups))))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for doc_id, found in texts:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, line = found
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), line))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_query_equals_brute_force(spark, models):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_alignment"](spark, SF).collect()
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(docs, models)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_odd_texts(spark, models):
    """Nulls, empties, special strings, scripts, white space, texts that a tokenizer changes, repeated and long ones."""
    texts = [
        None, "", " ", "  two  spaces ", "\n\n a\tb\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve façade ŒUVRE", "한글 текст 漢字 😀👩‍👩‍👧", "a▁b", "nul \0 in it", "===== ---- _____",
        "ﬁ ½ é", "x" * 5000, ("word, " * 3000), "same", "same", "same",
    ]
    rows = list(enumerate(texts)) + [(None, "no number")]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "id long, body string, pair long, _block long, n long")
    got = align_corpus(df, PATH_A, PATH_B, "id", "body").collect()
    key = lambda r: (r[0] is None, r[0])
    assert sorted([(r["identifier"], *(r[c] for c in COLUMNS), r["groups"]) for r in got], key=key) == sorted(brute(rows, models), key=key)
    assert align_corpus(df.limit(0), PATH_A, PATH_B, "id", "body").collect() == []


def test_shared_cuts_equal_the_intersection():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randrange(1, 60)
        a, b = (np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randrange(n)), n})) for _ in range(2))
        cut = shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        assert a[cut].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shared_cuts_of_one_long_stretch():
    """A stretch with no cut, and one with all: work stays in proportion."""
    a = np.arange(1, 200_001) * 2
    assert shared_cuts(a, np.append(a[:-1] - 1, a[-1]), np.array([0]), np.array([len(a) - 1])).sum() == 1
    assert shared_cuts(a, a, np.array([0]), np.array([len(a) - 1])).all()
