"""Operator 10: SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the shingles' hashes have it.
For radius r, each bit position gets a vector of r + 1 bits, and each non-zero
vector v of r + 1 bits gives one table: its mask holds the positions whose vector
has an odd inner product with v. Up to r differing positions leave some v that is
orthogonal to all of them, so in that table the two fingerprints agree on the
whole mask: no pair within the radius is missed.

A bucket of a table holds the fingerprints that agree on its mask. Inside one, a
task compares bits and emits a spanning forest of the links, never all pairs.
Buckets beyond ``bucket_rows`` are split again by covering masks over the bits
that are still free, down to buckets whose size the free bits bound.

``near_duplicates`` returns the components of these links. ``drop_near_duplicates``
takes them as candidates only and compares the texts' shingles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Filter, materialise, text_key, without
from .components import components


def _shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words count as one shingle, no words give none."""
    words = (text or b"").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(flat, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.array([digest(flat[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    over = np.zeros(64, np.float64)
    for k in range(0, len(hashes), 65536):  # bounds the memory of very long texts
        bits = np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.float32)
        over += np.ones(len(bits), np.float32) @ bits
    return int.from_bytes(np.packbits(2 * over > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text (UTF-8); null, empty and blank texts give zero."""
    return _majority(_shingle_hashes(text, shingle, seed))


def several_fingerprints(text: bytes | None, shingle: int, seed: int, how_many: int) -> list[int]:
    """``how_many`` fingerprints of one text: the first is ``fingerprint``, the others come from the same hashes, mixed anew each time."""
    hashes = _shingle_hashes(text, shingle, seed)
    out = [_majority(hashes)]
    for k in range(1, how_many):
        mixed = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # fixed values of a 64-bit mixer
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        out.append(_majority(mixed))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """id_col and ``fp``, the fingerprint as a signed long, for each row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col), of(F.col(text_col).cast("string").cast("binary")).alias("fp"))


#: A primitive polynomial over GF(2) for each degree.
PRIMITIVE = {1: 0b11, 2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011, 7: 0b10000011, 8: 0b100011101, 9: 0b1000010001}


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks over the given bit positions.

    The positions' vectors are successive powers of a primitive element: any
    radius + 1 neighbours are independent, so every mask fixes some of them.
    """
    width = radius + 1
    vectors, x = [], 1
    for _ in positions:
        vectors.append(x)
        x <<= 1
        x ^= PRIMITIVE[width] if x >> width else 0
    return [sum(1 << p for p, x in zip(positions, vectors, strict=True) if (v & x).bit_count() & 1) for v in range(1, 1 << width)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def spanning_links(fps: np.ndarray, radius: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(member, first) links of the components within ``radius`` among distinct fingerprints.

    The first is the smallest. Fingerprints of one label are known to be connected:
    a link is given for each label of a component but the first's.
    """
    order = np.argsort(fps)
    fps, known = fps[order], np.arange(len(fps)) if labels is None else labels[order]
    own = fps.view(np.uint64)
    root = np.full(len(own), -1, np.int64)
    links = []
    for first in range(len(own)):
        if root[first] >= 0:
            continue
        root[first] = first
        edge = [first]
        while edge and (root < 0).any():
            rest = np.flatnonzero(root < 0)
            at = edge.pop()
            near = (np.bitwise_count(own[rest] ^ own[at]) <= radius) | (known[rest] == known[at])
            root[rest[near]] = first
            edge.extend(rest[near].tolist())
        member = np.flatnonzero(root == first)
        _, one = np.unique(known[member], return_index=True)
        links += [(int(fps[k]), int(fps[first])) for k in member[one].tolist() if known[k] != known[first]]
    return links


def _masks_of(radius: int):
    """Column function: the covering masks of the bits that ``fixed`` leaves free, each together with ``fixed``."""

    @F.pandas_udf("array<long>")
    def of(fixed: pd.Series) -> pd.Series:
        known: dict[int, list[int]] = {}
        for f in fixed.unique().tolist():
            free = [p for p in range(64) if not f >> p & 1]
            known[f] = [_signed(f % (1 << 64) | m) for m in covering_masks(free, radius)]
        return fixed.map(known)

    return of


def fingerprint_links(distinct: DataFrame, radius: int = 4, bucket_rows: int = 1024, labels: DataFrame | None = None) -> DataFrame:
    """Links (space, a, b) that connect all fingerprints ``fp`` of one ``space`` of ``distinct`` within ``radius`` of each other.

    ``labels`` (space, fp, label) tells what is connected already: no links are
    given between fingerprints of one label. Buckets are counted by a grouping, combined before its shuffle, and the counts
    are joined back, so that no task sees a whole hot bucket before it is split.
    """
    if bucket_rows < 1 << (radius + 1):
        raise ValueError("bucket_rows is at least 2 ** (radius + 1)")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for space, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fps, known = rows.values.field("fp").to_numpy(), rows.values.field("label").to_numpy(zero_copy_only=False)
                pairs += [(space, *x) for x in spanning_links(fps, radius, known)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["space", "a", "b"])

    out = None
    # so many tasks that the counts of one fit its memory
    masks = (1 << (radius + 1)) - 1
    distinct = distinct.select("space", "fp").repartition(max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(distinct.count() * masks / 1_000_000)), "fp")
    first = F.array(*map(F.lit, map(_signed, covering_masks(list(range(64)), radius))))
    level = distinct.select("space", "fp", F.explode(first).alias("mask"))
    while True:
        buckets = level.select(F.xxhash64("space", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "space", "mask", "fp")
        counts = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-counts")
        sized = materialise(buckets.join(counts, "bucket"), "simhash-buckets")
        # a hash that two buckets share only makes one of them larger
        small = sized.where(F.col("n") <= bucket_rows)
        small = small.join(labels, ["space", "fp"]) if labels is not None else small.withColumn("label", F.col("fp"))
        small = small.groupBy("bucket", "space").agg(F.collect_list(F.struct("fp", "label")).alias("rows"))
        found = small.select("space", "rows").mapInArrow(links, "space int, a long, b long")
        out = found if out is None else out.unionByName(found)
        large = sized.where(F.col("n") > bucket_rows)
        if large.isEmpty():
            return out
        # the bits that a bucket's rows share are fixed; the next tables cover the others
        level = large.select("space", "fp", F.explode(_masks_of(radius)("mask")).alias("mask"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, bucket_rows: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row.

    Nulls: a null text counts as empty; empty and blank texts have fingerprint
    zero and are linked like any other. A null doc_id never is a component_id
    unless its component has no other identifier. Repeated rows have the same
    fingerprint and so the same component. Empty tables give no rows; other
    columns are not read. ``bucket_rows`` only decides where a bucket is split,
    never what is found.
    """
    own = materialise(fingerprints(docs, shingle=shingle, seed=seed), "fingerprints")
    groups = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(fingerprint_links(groups.select(F.lit(0).alias("space"), "fp"), radius, bucket_rows))
    labelled = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # written out, so that the join deals the fingerprints anew and a hot component can be split
    least = materialise(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-components")
    of = labelled.join(least, "component").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(of, "fp").select("doc_id", text, "component_id")


def _shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle count as one, and none as the empty one."""
    words = text.lower().split()
    grams = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def _similar_to(sets: list[np.ndarray], pivots: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """For each of ``sets`` the numbers of the pivots whose Jaccard similarity with it is at least ``similarity``."""
    sizes = np.array([len(x) for x in pivots])
    owner = np.repeat(np.arange(len(pivots)), sizes)
    every = np.concatenate(pivots)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    for own in sets:
        lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        hit, n = lo[hi > lo], (hi - lo)[hi > lo]
        places = np.repeat(hit - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        common = np.bincount(owner[places], minlength=len(pivots))
        out.append(np.flatnonzero(common >= similarity * (len(own) + sizes - common) - 1e-9))
    return out


def _block_links(table: pa.Table, shingle: int, similarity: float) -> pa.Table:
    """(component, a, b): what is similar in one block, rows to pivots and pivots among themselves; b is the first pivot of what they connect."""
    table = table.sort_by([("pivot", "descending"), ("uid", "ascending")])  # so that all blocks name the same pivot
    uids = table.column("uid").to_pylist()
    sets = [_shingle_set(t.as_py(), shingle) for t in table.column("body")]
    pivots = np.flatnonzero(table.column("pivot").to_numpy())
    parent = list(range(len(uids)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, found in enumerate(_similar_to(sets, [sets[p] for p in pivots], similarity)):
        for p in pivots[found].tolist():
            x, y = sorted((root(k), root(p)))
            parent[y] = x
    links = [(uids[k], uids[root(k)]) for k in range(len(uids)) if root(k) != k]
    component = table.column("component")[0].as_py()
    return pa.table([pa.array([component] * len(links), pa.int64()), *(pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))], ["component", "a", "b"])


def similar_groups(
    rows: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    radius: int = 5,
    fingerprints: int = 4,
    link_shingle: int = 2,
    seed: int = 42,
    bucket_rows: int = 1024,
    pivots: int = 256,
    block_rows: int = 512,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """(key, stays, lead, copies) of each text of ``rows`` (id, text) that has a near copy or repeats.

    ``key`` is the text's ``text_key``, ``stays`` whether it stands for its group,
    ``lead`` its smallest id (nulls last) and ``copies`` the number of its rows.
    Equal texts are one row from here on. Candidates are rows that links of covering LSH connect: in some of the several
    fingerprints of a text they differ in at most ``radius`` bits. These are of
    shingles of ``link_shingle`` words, because an edit changes fewer of these, so
    that similar texts are within a small radius. The decision is exact: two
    connected rows are linked if the Jaccard similarity of their sets of
    ``shingle``-word shingles is at least ``similarity``, and a group is what these
    links connect. Of a group the first text by lead and key stays.

    Rows are compared with up to ``pivots`` rows of their candidate group in blocks
    of a bounded size; a block only tells what it connects, at most one link a row.
    A further round is needed where a candidate group has more rows: those that the
    first round did not connect with its most common pivot are pivots in turn, and
    the others need no comparison with each other. So a large group of copies takes
    a few rounds, and no group is gathered in one task. Rows that the fingerprints
    connect but the texts don't are what costs: u such rows among m are compared
    u * m times, in rounds of up to four times ``pivots``. ``uid`` tells rows apart; a null text counts as empty;
    an empty table gives no rows.
    """

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array(several_fingerprints(t, link_shingle, seed, fingerprints), np.uint64).view(np.int64))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = rows.select("id", text.cast("binary").alias("body"), text_key(text).alias("key"))
    slim = texts.select("id", "key", F.monotonically_increasing_id().alias("uid"), "body").select("id", "key", "uid", of("body").alias("fps"))
    slim = materialise(slim, "near-fingerprints")
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("lead")
    classes = materialise(slim.groupBy("key").agg(F.min("uid").alias("uid"), F.first("fps").alias("fps"), lead, F.count("*").alias("copies")), "near-classes")
    own = materialise(classes.select("uid", F.posexplode("fps").alias("space", "fp")), "near-spaces")
    firsts = materialise(own.groupBy("space", "fp").agg(F.min("uid").alias("first")), "near-firsts")

    def rows_linked(some: str, labels: DataFrame | None = None) -> DataFrame:
        """Links (a, b) between rows by the fingerprints of some spaces: through the first row of each, and the others to it."""
        links = fingerprint_links(firsts.where(some).select("space", "fp"), radius, bucket_rows, labels)
        for end in ("a", "b"):
            links = links.join(firsts.toDF("space", end, f"row_{end}"), ["space", end])
        within = own.where(some).join(firsts, ["space", "fp"]).where("uid <> first").select(F.col("uid").alias("a"), F.col("first").alias("b"))
        return links.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).unionByName(within)

    # what the first fingerprints connect is linked no further by the others
    found = components(rows_linked("space = 0"))
    if fingerprints > 1:
        label = F.coalesce("component", "first").alias("label")
        labels = materialise(firsts.where("space > 0").join(found, F.col("first") == F.col("node"), "left").select("space", "fp", label), "near-labels")
        found = components(rows_linked("space > 0", labels).unionByName(found.toDF("a", "b")))
    found = found.select(F.col("node").alias("uid"), "component")
    wanted = materialise(classes.select("uid", "key", "lead", "copies").join(found, "uid"), "near-wanted")
    some = Filter.of(wanted.select(F.col("key").alias("digest")), Filter.rows_for(wanted.count()), "near-wanted-filter").probed(texts.select("key", "body"), "_hit", "key")
    bodies = some.where("_hit").groupBy("key").agg(F.min("body").alias("body"))
    members = materialise(bodies.join(wanted.select("uid", "component", "key"), "key"), "near-members")
    slim = members.select("uid", "component", F.col("key").alias("sha"), F.octet_length("body").alias("bytes"))

    waiting, joined, most = slim, None, pivots  # rows that may have to be pivots, the links found, and pivots in the next round
    while True:
        place = F.row_number().over(Window.partitionBy("component").orderBy("sha", "uid"))
        chosen = waiting.select("uid", "component", "sha").withColumn("place", place).where(F.col("place") <= most)
        chosen = materialise(chosen.select(F.col("uid").alias("_uid"), "component"), "near-pivots")
        if chosen.isEmpty():
            break
        n, size = F.count("*"), F.sum("bytes")
        blocks = F.ceil(F.greatest(n / block_rows, size / block_bytes)).cast("long")
        sums = materialise(slim.join(chosen.select("component").distinct(), "component", "left_semi").groupBy("component").agg(blocks.alias("blocks")), "near-blocks")
        dealt = members.select("uid", "component", "body").join(sums, "component").join(chosen.select("_uid"), F.col("uid") == F.col("_uid"), "left")
        pivot = F.col("_uid").isNotNull()
        salts = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("uid"), F.col("blocks"))))
        cells = dealt.select("component", F.explode(salts).alias("salt"), "uid", pivot.alias("pivot"), "body")
        new = cells.groupBy("component", "salt").applyInArrow(lambda t: _block_links(t, shingle, similarity), "component long, a long, b long")
        new = materialise(new, "near-links")
        first_round = joined is None
        joined = new if first_round else joined.unionByName(new)
        waiting = materialise(waiting.join(chosen.select("_uid"), F.col("uid") == F.col("_uid"), "left_anti"), "near-waiting")
        if waiting.isEmpty():
            break
        if first_round:  # what the most common pivot connects needs no further comparison
            each = new.groupBy("component", "b").agg(F.countDistinct("a").alias("n"))
            common = each.groupBy("component").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
            inside = new.join(common, ["component", "b"], "left_semi").select(F.col("a").alias("_uid"))
            waiting = materialise(waiting.join(inside, F.col("uid") == F.col("_uid"), "left_anti"), "near-waiting")
        most = min(2 * most, 4 * pivots)
    joined = joined.select("a", "b") if joined is not None else None
    groups = components(joined if joined is not None else found.toDF("a", "b").limit(0)).toDF("_node", "group")
    named = materialise(wanted.join(groups, F.col("uid") == F.col("_node")).drop("_node"), "near-groups")
    first = F.min(F.struct("lead", "key")).alias("first")
    stays = materialise(named.groupBy("group").agg(first).select(F.col("group").alias("_group"), F.col("first.key").alias("_stays")), "near-stays")
    grouped = named.join(stays, F.col("group") == F.col("_group")).select("key", (F.col("key") == F.col("_stays")).alias("stays"), F.col("lead.id").alias("lead"), "copies")
    alone = classes.where("copies > 1").join(named.select("key"), "key", "left_anti").select("key", F.lit(True).alias("stays"), F.col("lead.id").alias("lead"), "copies")
    return grouped.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, **options) -> DataFrame:
    """``docs`` with one row for each group of ``similar_groups``; rows without near copies stay.

    Texts decide, not identifiers: a row with a null or repeated doc_id goes only if
    links of similar texts lead to a row that stays. Of rows with the text that
    stays, the one of the smallest doc_id does; of several that are equal in both,
    one. A null text counts as empty; other columns may have any names.
    """
    key = text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = materialise(similar_groups(docs.select(F.col("doc_id").alias("id"), "text"), similarity, **options), "near-copies")
    left = without(docs, key, materialise(found.where("NOT stays").select("key"), "near-dropped"), "near")
    own, again, lead = (f"_{name}_{uuid.uuid4().hex[:8]}" for name in ("key", "again", "lead"))
    several = found.where("stays AND copies > 1").select(F.col("key").alias(again), F.col("lead").alias(lead))
    if several.isEmpty():
        return left
    marked = left.withColumn(own, key).join(several, F.col(own) == F.col(again), "left")
    first = marked.where(F.col(again).isNotNull() & F.col("doc_id").eqNullSafe(F.col(lead))).dropDuplicates([own])
    return marked.where(F.col(again).isNull()).unionByName(first).drop(own, again, lead)
