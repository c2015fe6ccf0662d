import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrain.llm.lm_score import Block, bucket_of, learn_weights, score_documents
from loomgrain.llm.queries import op5_lm_scoring

def held():
    return F.col("doc_id") % 3 == 0


def plain_scores(rows):
    """Base scores and counts by dictionaries."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = collections.Counter()
    for i, t in rows:
        if i is None or i % 3:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return n, {(i, t): (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in rows}


def test_base_equals_dictionaries(spark):
    rows = [(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 40))) for k in range(200)] + [(200, None), (201, ""), (None, "W1 w2\tW3"), (5, "rep eat"), (5, "rep eat"), (6, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, "z", 1.5) for i, t in rows], "doc_id long, text string, held string, score double")
    n, want = plain_scores(rows)
    got = score_documents(docs, held()).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    mine = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert mine == sorted((i or -1, *want[i, t][:2], round(want[i, t][2], 6)) for i, t in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert all(r.held_out == (r.doc_id is not None and r.doc_id % 3 == 0) for r in got)


def test_model_sums_to_one(spark):
    """The end follows a known or unknown word with one probability; over all first words, known and unknown, the chain sums to one."""
    texts = [" ".join(np.random.default_rng(k).choice(list("abcde"), 30)) for k in range(40)]
    firsts = [*"abcde", "zz"]  # zz stands for any unknown word
    probes = [(3 * (1000 + k), t) for k, t in enumerate(["", *firsts, *(f"{w} {w}" for w in firsts), *(f"{a} {b}" for a in firsts for b in firsts)])]
    docs = spark.createDataFrame([(3 * k + 1, t) for k, t in enumerate(texts)] + probes, "doc_id long, text string")
    by_id = {r.doc_id: r.score for r in score_documents(docs, held()).collect()}
    p = {t: 10 ** by_id[i] for i, t in probes}
    # p(a b end) = p(a) p(b|a) p(end|b) and p(a end) = p(a) p(end|a), so sum over b of p(a b end) / p(end|b) + p(a end) = p(a)
    for a in firsts:
        ends = {b: p[f"{a} {b}"] / p[f"{b} {b}"] for b in firsts}  # p(a) p(b|a) / (p(b) p(b|b))
        assert all(x > 0 for x in ends.values())
    # with s_w = p(end|w): p(w) = p(w end) / s_w; solve the sums over what may follow each word for s
    step = np.array([[p[f"{a} {b}"] for b in firsts] for a in firsts])
    end = np.array([p[a] for a in firsts])
    # p(a) (1 - s_a) = sum_b p(a b end) / s_b with p(a) = end_a / s_a gives a fixed point in s
    s = np.full(len(firsts), 0.03)
    for _ in range(2000):
        s = end / (end + step @ (1 / s))
    first = end / s
    assert first.sum() + p[""] == pytest.approx(1, abs=1e-6)


def test_weights():
    rng = np.random.default_rng(1)
    bins = np.column_stack((np.full(50, 3), rng.integers(1, 9, 50), rng.random(50), rng.random(50) / 5)).astype(float)
    w = learn_weights(bins, 1e-3)
    assert w.shape[1] == 3 and np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0 and (w[1:] > 0).all()

    def likelihood(x):
        return bins[:, 1] @ np.log(bins[:, 2] * x[0] + bins[:, 3] * x[1] + 1e-3 * x[2])

    for _ in range(200):
        assert likelihood(rng.dirichlet([1, 1, 1])) <= likelihood(w[3]) + 1e-6
    assert np.allclose(learn_weights(np.empty((0, 4)), 0.1).sum(axis=1), 1)
    assert bucket_of(np.array([0, 1, 2, 3, 4])).tolist() == [0, 1, 2, 2, 3]


def test_block_orders_agree():
    block = Block.of([b"a b a", b"", b"B"], np.array([True, True, False]))
    order, starts = block.order(0, 5)
    assert sorted(order) == list(range(len(block.keys[0]))) and starts[-1] == len(order)
    assert block.own(0).sum() == 5 and block.own(1).sum() == 5


def test_held_out_beats_base(spark):
    rows = op5_lm_scoring(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
    one = op5_lm_scoring(spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in one)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(3, "a b")], "doc_id long, text string")
    assert score_documents(docs.limit(0), held()).count() == 0
    row = score_documents(docs, held()).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == pytest.approx(0) and row.score == pytest.approx(0)


def plain_model(rows, block_of, held_row):
    """The model by dictionaries: weights by expectation-maximisation over exact estimates, and the score of each row."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    pairs_of = lambda t: list(zip([b"", *tokens(t)[:-1]], tokens(t), strict=True))
    words, pairs = collections.Counter(), collections.Counter()
    own = {}
    for k, (_, t) in enumerate(rows):
        if not held_row[k]:
            w, p = own.setdefault(block_of[k], (collections.Counter(), collections.Counter()))
            w.update(tokens(t))
            p.update(pairs_of(t))
    for w, p in own.values():
        words.update(w)
        pairs.update(p)
    n, floor = sum(words.values()), 1 / (len(words) + 1)
    held = collections.defaultdict(list)  # by bucket: weight, bigram and unigram estimate without the block's own counts
    for w, p in own.values():
        for (a, b), c in p.items():
            context = words[a] - w[a]
            p2 = (pairs[a, b] - p[a, b]) / context if context else 0.0
            held[int(bucket_of(np.array([context]))[0])].append((c, p2, (words[b] - w[b]) / (n - sum(w.values()))))

    def fit(cells):
        mix = [1 / 3] * 3
        for _ in range(100):
            new = [0.0, 0.0, 0.0]
            for c, p2, p1 in cells:
                parts = [mix[0] * p2, mix[1] * p1, mix[2] * floor]
                for k in range(3):
                    new[k] += c * parts[k] / sum(parts)
            mix = [x / sum(new) for x in new]
        mix = [max(x, 1e-7) for x in mix]
        return [x / sum(mix) for x in mix]

    weights = {b: fit(cells) for b, cells in held.items()}
    rest = fit([c for cells in held.values() for c in cells])

    def score(t, weights):
        total = 0.0
        for a, b in pairs_of(t):
            bucket = int(bucket_of(np.array([words[a]]))[0])
            mix = weights.get(bucket, rest)
            if not bucket:
                mix = [0.0, mix[1] / (mix[1] + mix[2]), mix[2] / (mix[1] + mix[2])]
            total += math.log10(mix[0] * pairs[a, b] / max(words[a], 1) + mix[1] * words[b] / n + mix[2] * floor)
        return total

    return score, weights


@pytest.mark.parametrize("exact", [True, False])
def test_score_equals_dictionaries(spark, monkeypatch, exact):
    """With fixed weights the scores are those of dictionaries; with learned ones they differ by the binning of estimates alone."""
    from loomgrain.llm import lm_score

    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=(s := 1 / np.arange(1, 61)) / s.sum()))) for k in range(150)] + [(1000, None), (1001, "never seen Words here"), (3, "W1 w2 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = docs.select(F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary")), F.lit(8)).alias("b")).collect()
    held_row = [i % 3 == 0 for i, _ in rows]
    score, weights = plain_model(rows, [r.b for r in blocks], held_row)
    if exact:
        fixed = {b: [0.6, 0.3, 0.1] if b % 2 else [0.2, 0.5, 0.3] for b in range(lm_score.BUCKETS)}
        table = np.array([fixed[b] for b in range(lm_score.BUCKETS)])
        table[0] = [0, *(table[0][1:] / table[0][1:].sum())]
        monkeypatch.setattr(lm_score, "learn_weights", lambda *a, **k: table)
        weights = fixed
    got = {(r.doc_id, r.n_tokens): r.score for r in score_documents(docs, held()).collect()}
    off = [abs(got[i, len((t or "").split()) + 1] / score(t, weights) - 1) for i, t in rows]
    assert max(off) < (1e-9 if exact else 0.05) and sum(off) / len(off) < 0.005
