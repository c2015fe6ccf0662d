import gzip
import time

import pytest
from pyspark.sql import functions as F

from loomgrain.llm import warc
from loomgrain.llm.common import scratch


def members(n=4):
    return [gzip.compress(warc.build_record(k, f"http://h/{k}", f"payload {k} ".encode() * (k + 1), "response", None, "2024-01-01T00:00:00Z")) for k in range(n)]


def ids(data):
    return [r if isinstance(r, str) else r.fields["warc-record-id"] for _, _, r in warc.salvage(data)]


def covered(data):
    at = 0
    for offset, length, _ in warc.salvage(data):
        assert offset == at
        at += length
    assert at == len(data)


def test_round_trip():
    record = warc.parse_record(warc.build_record(5, "http://h/a b\n", "é".encode(), "response", None, "d"))
    assert record.payload == "é".encode() and record.fields["warc-target-uri"] == "http://h/a%20b%0A"
    assert record.digest == warc.base32_sha1("é".encode()) and len(record.digest) == 32
    revisit = warc.parse_record(warc.build_record(None, None, b"abc", "revisit", 9, "d"))
    assert revisit.full_length == 3 and revisit.payload == b"" and revisit.fields["warc-refers-to"] == "<urn:page:9>"


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "header", "tail"])
def test_salvage_gzip(damage):
    own = members()
    if damage == "flip":
        own[1] = own[1][:40] + bytes([own[1][40] ^ 255]) + own[1][41:]
    elif damage == "cut":
        own[1] = own[1][: len(own[1]) // 2]
    elif damage == "junk":
        own[1] = b"\x1f\x8b\x08 no member \x1f\x8b" + b"\0" * 20
    elif damage == "header":
        own[1] = b"\0" + own[1][1:]
    else:
        own.append(b"tail")
    data = b"".join(own)
    found = [x for x in ids(data) if x.startswith("<")]
    assert found == [f"<urn:page:{k}>" for k in range(4) if k != 1 or damage == "tail"]
    gaps = [(o, n) for o, n, r in warc.salvage(data) if isinstance(r, str)]
    assert gaps == ([(len(own[0]), len(own[1]))] if damage != "tail" else [(len(data) - 4, 4)])
    covered(data)


def test_salvage_plain():
    own = [gzip.decompress(m) for m in members()]
    own[2] = own[2].replace(b"payload 2", b"PAYLOAD 2", 1)  # a digest that does not fit
    data = b"".join(own)
    assert [x for x in ids(data) if x.startswith("<")] == [f"<urn:page:{k}>" for k in (0, 1, 3)]
    covered(data)
    assert list(warc.salvage(b"")) == [] and ids(b"nothing here") == ["no version line"]


def test_salvage_plain_with_gzip_bodies():
    own = [warc.build_record(k, "u", warc.MAGIC + b"body" * 9, "response", None, "d") for k in range(3)]
    data = b"X" + b"".join(own)[1:]
    assert ids(data) == ["no version line", "<urn:page:1>", "<urn:page:2>"]
    covered(data)


def test_salvage_member_of_several_records():
    own = [gzip.decompress(m) for m in members()]
    data = gzip.compress(b"".join(own)) + own[0]
    assert ids(data) == [f"<urn:page:{k}>" for k in (0, 1, 2, 3, 0)]
    covered(data)
    own[1] = own[1].replace(b"payload 1", b"PAYLOAD 1", 1)
    data = gzip.compress(b"".join(own))
    assert ids(data) == ["<urn:page:0>", "payload digest does not fit" if b"Block-Digest" not in own[1] else "block digest does not fit", "<urn:page:2>", "<urn:page:3>"]
    covered(data)


def test_table(spark):
    rows = [(1, "u", "same"), (3, None, "same"), (3, "u", "same"), (2, "u", None), (4, "u", ""), (None, "u", "x"), (None, "u", "same"), (5, "u", "é" * 50_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archive_pages(pages, roll_bytes=1000).collect()
    digest = lambda t: warc.base32_sha1(t.encode())
    want = []
    for page_id, _, html in rows:
        best = {"same": 3, "": 4}.get(html or "")
        again = best is not None and page_id != best
        want.append((page_id, len((html or "").encode()), digest(html or ""), "revisit" if again else "response", best if again else None))
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    small = warc.archive_pages(pages, min_payload=5).where("record_type = 'revisit'")
    assert small.count() == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_reader_reports_gaps(spark, tmp_path):
    own = members()
    own[2] = own[2][:-9] + b"broken!!!"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(own))
    df = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "archive string"))
    rows = df.orderBy("offset").collect()
    assert [(r.page_id, r.gap is not None) for r in rows] == [(0, False), (1, False), (None, True), (3, False)]
    assert rows[0].payload == b"payload 0 " and rows[2].length == len(own[2])
    assert scratch(spark, "x") != scratch(spark, "x")


@pytest.mark.parametrize("kind", ["gzip", "plain", "damaged", "lines", "lengths"])
def test_time_is_in_proportion(kind):
    """Four times the records take about four times as long, damaged ones too."""
    record = warc.build_record(1, "http://h/", b"payload of a page " * 60, "response", None, "d")
    one = {
        "gzip": gzip.compress(record),
        "plain": record,
        "damaged": record.replace(b"payload", b"PAYLOAD", 1),
        "lines": warc.VERSION + b"x" * 300,  # headers that never end
        "lengths": record.replace(b"Content-Length: 1", b"Content-Length: 9", 1).replace(b"Content-Length: ", b"Content-Length: 900"),
    }[kind]

    def seconds(n):
        data, start = one * n, time.perf_counter()
        found = sum(1 for _ in warc.salvage(data))
        assert found == (n if kind in ("gzip", "plain") else 1)
        return time.perf_counter() - start

    n = 200 if kind == "lines" else 4000
    if kind == "lines":
        assert seconds(4 * n) < 5
    else:
        assert min(seconds(4 * n) for _ in range(2)) < 8 * max(seconds(n), 0.02)


def test_payload_of_half_the_pages_is_split(spark):
    """The join's partition of a very common payload is split, so that no task writes half of the archives."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        html = F.when(F.col("id") % 2 == 0, F.lit("common")).otherwise(F.concat(F.lit("page "), F.col("id") % 10_001))
        pages = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("page_id"), F.sha2(F.col("id").cast("string"), 512).alias("url"), html.alias("html"))
        marked = warc.mark_revisits(pages).where("length(url) > 0")
        tasks = marked.select(F.spark_partition_id().alias("p"), "record_type", "url").withColumn("record_type", F.when(F.length("url") > 0, F.col("record_type"))).groupBy("p").agg(F.count_if(F.col("record_type") == "revisit").alias("n")).collect()
        assert sum(r.n for r in tasks) >= 19_999
        assert max(r.n for r in tasks) < 15_000
    finally:
        for k in conf:
            spark.conf.unset(k)
