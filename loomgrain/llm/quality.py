"""Operator 7: quality classifier with hierarchical empirical Bayes.

A logistic document classifier, fitted on a bounded sample of labelled rows, gives
each document's evidence. Grouped sums of that evidence over all documents give
host posteriors, which shrink to the global prior, and path posteriors, which
shrink to their host's; the strength of each shrinking is estimated from the
spread between the groups. A document's posterior combines its own evidence with
that of its path, its own part taken out. Two targets are scored: low quality and
toxic; a document is rejected if either is likelier than not by ``cut``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_key, without

#: Bounds of the fitted model: labelled documents read, words kept, and the fewest documents that a word is in.
MAX_LABELLED = 12_000
MAX_WORDS = 128
MIN_DOCS = 5

_TOKEN = re.compile(rb"[a-z\x80-\xff]+")
_LINE_WORDS = 40
#: Byte classes: lower, upper, digit, blank, sentence marks, other ASCII marks, beyond ASCII.
_CLASS = bytes(
    0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\v\f\r" else 4 if b in b".,;:'\"-()?" else 5 if b < 128 else 6
    for b in range(256)
)
N_STATS = 15


def stats(text: bytes) -> list[float]:
    """Shape of a text: shares of byte classes, word lengths, repetition. Each value is bounded."""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (N_STATS - 1)
    kind = np.frombuffer(text.translate(_CLASS), np.uint8)
    share = np.bincount(kind, minlength=7) / len(text)
    inside = np.diff(np.concatenate(([0], (kind != 3).view(np.int8), [0])))
    first, after = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    lengths, last = after - first, kind[after - 1]
    lower, upper = (np.add.reduceat(kind == k, first, dtype=np.int64) for k in (0, 1))
    counts = Counter(words)
    return [
        0.0,
        share[1], share[2], share[4], share[5],
        float(((upper > 0) & (lower == 0)).mean()),
        float((last == 5).mean()),
        float(((lengths == 1) & (last >= 4) & (last < 6)).mean()),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1) if n > 1 else 1.0,
        len(counts) / n,
        max(counts.values()) / n,
        min(1.0, float(lengths.mean()) / 20),
        min(1.0, math.log1p(n) / 12),
        min(1.0, text.count(b"\n") * _LINE_WORDS / n / 10),
    ]


def words_of(text: bytes) -> Counter:
    """Counts of words, A-Z lower-cased, and with a ``*`` of the starts of four and five bytes that longer words have."""
    own = Counter(_TOKEN.findall(text.lower()))
    out = Counter(own)
    for w, n in own.items():
        for size in (4, 5):
            if len(w) > size:
                out[w[:size] + b"*"] += n
    return out


def features(text: bytes | None, words: list[bytes]) -> list[float]:
    """Shape of the text, its squares, and for each of ``words`` the root of its share of the text, up to a twenty-fifth."""
    text = text or b""
    shape = stats(text)
    own = words_of(text) if words else Counter()
    n = max(1, sum(c for w, c in own.items() if not w.endswith(b"*")))
    return [1.0, *shape, *(x * x for x in shape), *(min(1.0, 5 * math.sqrt(own[w] / n)) if w in own else 0.0 for w in words)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 60) -> np.ndarray:
    """Weights by Newton's method on the penalised likelihood, with step halving; the intercept (column 0) is free."""
    penalty = np.full(x.shape[1], max(ridge * len(y), 1e-2))
    penalty[0] = 1e-6

    def value(w: np.ndarray) -> float:
        z = x @ w
        return float(y @ z - np.logaddexp(0, z).sum() - penalty @ (w * w) / 2)

    w = np.zeros(x.shape[1])
    at = value(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        while (new := value(w + move)) < at and np.abs(move).max() > 1e-9:
            move = move / 2
        w, gain, at = w + move, new - at, new
        if gain < 1e-7 * max(1.0, abs(at)):
            break
    return w


@dataclass
class Model:
    """A fitted classifier: its words, its weights over features and the log odds of the target among its rows."""

    words: list[bytes]
    weights: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights, -30, 30)


def telling_words(labelled: DataFrame, target: str, most: int = MAX_WORDS) -> list[bytes]:
    """Words whose presence tells the target best, by the G statistic over the labelled rows."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            hit: Counter = Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = words_of(text.as_py() or b"").keys()
                seen.update(own)
                if y:
                    hit.update(own)
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.binary()), "n": [seen[k] for k in keys], "k": [hit[k] for k in keys]},
                                             pa.schema([("word", pa.binary()), ("n", pa.int64()), ("k", pa.int64())]))

    rows, positive = labelled.agg(F.count("*"), F.sum(F.col(target).cast("long"))).first()
    if not rows or not positive or positive == rows:
        return []
    counts = labelled.select("body", target).mapInArrow(tokens, "word binary, n long, k long")
    per = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= MIN_DOCS)
    rate = positive / rows
    k, n = F.col("k"), F.col("n")
    g = F.coalesce(k * F.log(k / (n * rate)), F.lit(0.0)) + F.coalesce((n - k) * F.log((n - k) / (n * (1 - rate))), F.lit(0.0))
    best = per.where(k > n * rate).orderBy(g.desc(), "word").limit(most)
    return [bytes(r["word"]) for r in best.where(g > 12).collect()]


def labelled_sample(docs: DataFrame, labels: DataFrame, target: Column, name: str, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(body, ``name``) of at most ``max_labelled`` labelled documents, in the order of a hash of doc_id.

    Of rows that share a doc_id, the one with the least text stands for all, so
    that the bound holds for rows too.
    """
    chosen = labels.where(target.isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias(name))
    chosen = materialise(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "quality-labels")
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")
    found = docs.select("doc_id", body).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", name).agg(F.min("body").alias("body"))
    return materialise(found.select("body", name), "quality-sample")


def train(docs: DataFrame, labels: DataFrame, target: Column, name: str, with_words: bool, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit ``target`` (a boolean over the labels) on the labelled sample.

    Its bound is the only sampling here; all documents are scored. None if the
    labels have one class only.
    """
    rows = labelled_sample(docs, labels, target, name, max_labelled)
    words = telling_words(rows, name) if with_words else []

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(features(t.as_py(), words), np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", name])

    got = rows.mapInArrow(matrix, f"x binary, {name} boolean").toPandas()
    if got[name].nunique() < 2:
        return None
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(np.float64)
    y = got[name].to_numpy(np.float64)
    return Model(words, fit_logistic(x, y), float(np.log(y.mean() / (1 - y.mean()))))


def _strength(groups: DataFrame, mean: Column, n: str, s: str) -> float:
    """Prior strength by moments: the less the groups' sums spread around ``n`` times their mean beyond chance, the stronger."""
    spread = F.pow(F.col(s) - F.col(n) * mean, 2) / (mean * (1 - mean))
    row = groups.agg(F.sum(spread).alias("spread"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not row["n"] or row["nn"] <= row["n"]:
        return 100.0
    # the spread is about n + (nn - n) * rho with rho = 1 / (strength + 1)
    rho = (row["spread"] - row["n"]) / (row["nn"] - row["n"])
    return float(np.clip(1 / rho - 1, 2.0, 1e4)) if rho > 0 else 1e4


def _rate(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))


def with_posteriors(scored: DataFrame, name: str) -> DataFrame:
    """Adds ``{name}``: the posterior of each row from its log odds ``{name}_llr`` and its site.

    ``scored`` has host, path, ``{name}_llr`` and ``{name}_p``. Hosts and paths are
    grouped over all rows, with sums combined before the shuffle; a row's own part
    is taken out of its host and path again.
    """
    llr, p = F.col(f"{name}_llr"), F.col(f"{name}_p")
    by_path = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "quality-paths")
    row = by_path.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(row["s"] / row["n"], 1e-4), 1 - 1e-4) if row["n"] else 0.5
    hosts = by_path.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    outer = _strength(hosts, F.lit(mean), "hn", "hs")
    sites = materialise(
        by_path.withColumnsRenamed({"host": "_of", "path": "_path"}).join(hosts, F.col("_of").eqNullSafe(F.col("_host"))).select("_host", "_path", "n", "s", "hn", "hs"),
        "quality-sites",
    )
    inner = _strength(sites, _rate((F.lit(outer * mean) + F.col("hs")) / (F.lit(outer) + F.col("hn"))), "n", "s")
    joined = scored.join(sites, scored["host"].eqNullSafe(F.col("_host")) & scored["path"].eqNullSafe(F.col("_path")))
    host_rate = (F.lit(outer * mean) + F.col("hs") - p) / (F.lit(outer) + F.col("hn") - 1)
    site = _rate((F.lit(inner) * host_rate + F.col("s") - p) / (F.lit(inner) + F.col("n") - 1))
    logit = llr + F.log(site / (1 - site))
    return joined.withColumn(f"{name}_site", site).withColumn(name, 1 / (1 + F.exp(-logit))).drop("_host", "_path", "n", "s", "hn", "hs")


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", cut: float = 0.5, row_id: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id (or ``row_id``, a string), host, path, low, toxic (posteriors), their site rates, rejected.

    ``labels`` has doc_id, quality and toxic (0/1); repeated labels count as the
    worst one, null ones are skipped. Nulls: a null text counts as empty, null
    hosts and paths are groups of their own, a null doc_id is scored like any.
    Repeated rows get the same score. Without labels of both classes a target's
    posterior is 0 and rejects nothing. Empty tables give no rows; other columns
    are not read.
    """
    models = {
        "low": train(docs, labels, F.col("quality") == 0, "low", with_words=False),
        "toxic": train(docs, labels, F.col("toxic") == 1, "toxic", with_words=True),
    }
    names = [k for k, m in models.items() if m is not None]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for k in names for w in models[k].words]
        take, at = {}, 1 + 2 * N_STATS
        for k in names:
            own = len(models[k].words)
            take[k] = [*range(1 + 2 * N_STATS), *range(at, at + own)]
            at += own
        for batch in batches:
            x = np.array([features(t.as_py(), words) for t in batch.column(3)], np.float64).reshape(batch.num_rows, 1 + 2 * N_STATS + len(words))
            out = []
            for k in models:
                z = models[k].logit(x[:, take[k]]) if k in names else np.full(batch.num_rows, -30.0)
                out += [pa.array(z - (models[k].base if k in names else 0.0)), pa.array(1 / (1 + np.exp(-z)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *out], ["doc_id", "host", "path", *(f"{k}_{s}" for k in models for s in ("llr", "p"))])

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")
    chosen = docs.select((F.col("doc_id").cast("long") if row_id is None else row_id).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), body)
    scored = chosen.mapInArrow(score, f"doc_id {'long' if row_id is None else 'string'}, host string, path string, low_llr double, low_p double, toxic_llr double, toxic_p double")
    scored = materialise(scored, "quality-scores")
    out = with_posteriors(with_posteriors(scored, "low"), "toxic")
    return out.select("doc_id", "host", "path", "low", "toxic", "low_site", "toxic_site", ((F.col("low") >= cut) | (F.col("toxic") >= cut)).alias("rejected"))


def drop_rejected(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects; text, host and path decide, so null and repeated doc_ids don't matter."""
    key = text_key(F.col(host_col), F.col(path_col), F.col("text"))
    found = classify(docs, labels, host_col, path_col, row_id=key).where("rejected").select("doc_id").distinct()
    return without(docs, key, materialise(found, "quality-rejects"), "quality")
