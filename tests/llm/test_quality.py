import math

import numpy as np
from pyspark.sql import functions as F

from loomgrain.llm.quality import N_STATS, classify, drop_rejected, fit_logistic, labelled_sample, stats, train, with_posteriors, words_of

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    known = labels.where("doc_id % 3 <> 0")
    got = classify(docs, known).select("doc_id", "rejected", F.col("low").alias("p")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    low = [r for r in got if r.quality == 0]
    assert len(clean) > 50 and sum(r.rejected for r in clean) == 0
    assert sum(r.rejected for r in low) >= 0.9 * len(low)


def test_held_out_toxic(spark):
    """Toxic documents that are not of low quality as well, so that the toxic target alone must reject them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = classify(docs, labels.where("doc_id % 3 <> 0")).select("doc_id", "rejected", F.col("toxic").alias("p")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    toxic = [r for r in got if r.toxic == 1 and r.quality == 1]
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    assert len(toxic) > 100 and sum(r.p >= 0.5 for r in toxic) >= 0.95 * len(toxic)
    assert sum(r.rejected for r in got if r.toxic == 1) >= 0.95 * sum(r.toxic == 1 for r in got)
    assert len(clean) > 900 and sum(r.rejected for r in clean) <= 0.005 * len(clean)


def plain_posteriors(rows):
    """Posteriors by loops over dictionaries: rows are (host, path, log odds, probability)."""

    def strength(groups):
        n, nn = sum(k for k, _, _ in groups), sum(k * k for k, _, _ in groups)
        if nn <= n:
            return 100.0
        rho = (sum((s - k * m) ** 2 / (m * (1 - m)) for k, s, m in groups) - n) / (nn - n)
        return min(max(1 / rho - 1, 2.0), 1e4) if rho > 0 else 1e4

    def rate(x):
        return min(max(x, 1e-4), 1 - 1e-4)

    hosts, paths = {}, {}
    for host, path, _, p in rows:
        for key, of in ((host, hosts), ((host, path), paths)):
            n, s = of.get(key, (0, 0.0))
            of[key] = (n + 1, s + p)
    mean = rate(sum(r[3] for r in rows) / len(rows))
    outer = strength([(n, s, mean) for n, s in hosts.values()])
    inner = strength([(n, s, rate((outer * mean + hosts[h][1]) / (outer + hosts[h][0]))) for (h, _), (n, s) in paths.items()])
    out = []
    for host, path, llr, p in rows:
        (hn, hs), (n, s) = hosts[host], paths[host, path]
        of_host = (outer * mean + hs - p) / (outer + hn - 1)
        site = rate((inner * of_host + s - p) / (inner + n - 1))
        out.append(1 / (1 + math.exp(-(llr + math.log(site / (1 - site))))))
    return out


def test_posteriors_equal_loops(spark):
    rng = np.random.default_rng(4)
    rows = []
    for h in range(12):
        for p in range(int(rng.integers(1, 5))):
            bad = rng.beta(1, 6)
            rows += [(None if h == 3 else f"h{h}", None if p == 2 else f"p{p}", float(rng.normal()), float(np.clip(rng.normal(bad, 0.1), 0, 1))) for _ in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, host string, path string, low_llr double, low_p double")
    got = {r.doc_id: r.low for r in with_posteriors(df, "low").collect()}
    want = plain_posteriors(rows)
    assert len(got) == len(rows) and np.allclose([got[k] for k in range(len(rows))], want, rtol=1e-9)


def test_fit_logistic():
    rng = np.random.default_rng(0)
    x = np.column_stack((np.ones(4000), rng.normal(size=(4000, 2))))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [0.5, 2.0, -1.0])))).astype(float)
    assert np.abs(fit_logistic(x, y) - [0.5, 2.0, -1.0]).max() < 0.3
    apart = fit_logistic(np.column_stack((np.ones(10), np.arange(10))), (np.arange(10) > 4).astype(float))
    assert np.isfinite(apart).all() and apart[1] > 0


def test_stats_of_odd_texts():
    for text in (b"", b" \n", b"a", b"A!!", b"\xff\xfe", b"word " * 50_000, b"x" * 100_000):
        got = stats(text)
        assert len(got) == N_STATS and np.isfinite(got).all()
    assert words_of(b"Pathetic loser patHos") == {b"pathetic": 1, b"loser": 1, b"pathos": 1, b"path*": 2, b"pathe*": 1, b"patho*": 1, b"lose*": 1}


def test_posteriors_shrink(spark):
    """A large bad host pulls its documents up; a host of one document stays near the global rate."""
    rows = [(k, "bad", "p", 0.0, 0.8) for k in range(200)] + [(k, "good", "p", 0.0, 0.05) for k in range(800)] + [(5000, "lone", "p", 0.0, 0.99), (6000, None, None, 0.0, 0.05)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, low_llr double, low_p double")
    got = {r.host: r for r in with_posteriors(df, "low").collect()}
    assert len(with_posteriors(df, "low").collect()) == len(rows)
    overall = sum(r[4] for r in rows) / len(rows)
    assert got["bad"].low > 0.75 and got["good"].low < 0.07
    assert abs(got["lone"].low - overall) < 0.02 and abs(got[None].low - overall) < 0.02


def test_odd_tables(spark):
    docs, labels = tables(spark)
    more = docs.select("doc_id", "text", "lang", "source", F.lit(1).alias("low"), F.lit("x").alias("rejected"))
    odd = spark.createDataFrame([(None, "text of a kind", None, None, 1, "x"), (-1, None, None, "src1", 1, "x"), (-2, "", "en", None, 1, "x"), (-3, "w " * 50_000, "en", "s", 1, "x")], more.schema)
    wrong = spark.createDataFrame([(None, 0, 1), (1, None, None), (1, 1, 0), (1, 1, 0), (123456, 0, 0)], labels.schema)
    got = classify(more.unionByName(odd).unionByName(odd), labels.unionByName(wrong))
    assert got.count() == docs.count() + 8
    assert got.where("doc_id IS NULL").count() == 2
    assert classify(docs.limit(0), labels).count() == 0
    none = classify(docs, labels.limit(0))
    assert none.where("rejected").count() == 0 and none.count() == docs.count()
    assert train(docs, labels.where("quality = 1"), F.col("quality") == 0, "low", False) is None
    left = drop_rejected(docs, labels)
    assert left.columns == docs.columns and 0.7 * docs.count() < left.count() < docs.count()


def test_sample_is_bounded_by_rows(spark):
    """A labelled document that repeats many times is one row of the sample, with its least text."""
    docs = spark.createDataFrame([(1, f"text {i:03}") for i in range(300)] + [(2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    found = labelled_sample(docs, labels, F.col("quality") == 0, "low").collect()
    assert sorted((bytes(r["body"]), r["low"]) for r in found) == [(b"", False), (b"c", False), (b"text 000", True)]
    assert labelled_sample(docs, labels, F.col("quality") == 0, "low", max_labelled=2).count() <= 2
    assert labelled_sample(docs.limit(0), labels, F.col("quality") == 0, "low").count() == 0
