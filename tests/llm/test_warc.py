import base64
import gzip
import hashlib
import io
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripkit.llm import register, warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, `n` int"


def odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "x\r\ny", "a"), (4, "y", "a"), (None, "y", "a"), (4, "y", "a"), (5, "z", "é" * 300_000), (6, "", "only")]
    return spark.createDataFrame([(*r, "p", "d", 1) for r in rows], SCHEMA)


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip_of_odd_pages(spark):
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(odd_pages(spark), folder, archive_bytes=1)
    rows = warc.read_archives(manifest).collect()
    assert manifest.count() == len(rows) == 8
    got = sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload and bytes(r.payload)) for r in rows), key=str)
    big = ("é" * 300_000).encode()
    want = [
        ("1", "revisit", 0, digest(b""), "2", None), ("2", "response", 0, digest(b""), None, b""),
        ("3", "revisit", 1, digest(b"a"), "4", None), ("4", "response", 1, digest(b"a"), None, b"a"),
        ("4", "response", 1, digest(b"a"), None, b"a"), (None, "revisit", 1, digest(b"a"), "4", None),
        ("5", "response", len(big), digest(big), None, big), ("6", "response", 4, digest(b"only"), None, b"only"),
    ]
    assert got == sorted(((a, b, c, d, e, f or (f if f is None else b"")) for a, b, c, d, e, f in want), key=str)


def test_small_payloads_can_be_kept_out_of_revisits(spark):
    manifest = warc.write_archives(odd_pages(spark), warc.archive_folder(spark), least_bytes=1)
    kinds = {r.page_id: r.record_type for r in warc.read_archives(manifest).collect()}
    assert kinds["1"] == kinds["2"] == "response" and kinds["3"] == "revisit"


def test_no_pages(spark):
    manifest = warc.write_archives(odd_pages(spark).limit(0), warc.archive_folder(spark))
    assert warc.read_archives(manifest).collect() == []


def test_archives_are_plain_gzip_with_a_member_per_record(spark):
    manifest = warc.write_archives(odd_pages(spark).coalesce(1), warc.archive_folder(spark)).collect()
    data = b"".join(Path(r.path.removeprefix("file://").removeprefix("file:")).read_bytes() for r in manifest)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 8
    assert len(list(warc.members(io.BytesIO(data)))) == 8


class Drip(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else 7)


def test_members_across_reads_and_broken_archives():
    records = [warc.page_record(i, f"u{i}", b"x" * i, None, False) for i in range(20)]
    data = b"".join(records)
    assert [len(p) for _, p, _ in warc.read_records(Drip(data))] == list(range(20))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(data[:-5])))
    whole = gzip.decompress(records[9])
    for broken in (whole.replace(b"x" * 9, b"x" * 8 + b"y"), whole.replace(b"Content-Length: ", b"Content-Length: 1", 1), whole[:-2], b"HTTP" + whole, whole.replace(b"\r\nContent-Length", b"\r\nLength", 1)):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(broken))))


def archive(tmp_path, spark, *records):
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(b"".join(records))
    return spark.createDataFrame([(f"file://{path}", len(records), 1)], "path string, records long, number int")


def test_revisits_name_the_record_that_they_refer_to(spark):
    rows = warc.read_archives(warc.write_archives(odd_pages(spark), warc.archive_folder(spark))).collect()
    ids = {r.record_id: r for r in rows}
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert revisits and all(ids[r.refers_to_record].page_id == r.refers_to for r in revisits)
    assert all(r.refers_to_record is None for r in rows if r.record_type != "revisit")


def test_archives_of_other_writers(spark, tmp_path):
    block = warc.http_block(None, 77)
    old = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Type": "text/html"}, b"abc")
    latin = gzip.compress(gzip.decompress(old).replace(b"<a>", b"<caf\xe9>"))
    revisit = warc.record_bytes({"WARC-Type": "revisit", "WARC-Refers-To": "<a>", "Content-Type": "application/http"}, block)
    bare = warc.record_bytes({"WARC-Type": "revisit"}, b"")
    got = warc.read_archives(archive(tmp_path, spark, old, latin, revisit, bare)).collect()
    assert [(r.record_type, r.payload_bytes, r.refers_to_record, r.record_id) for r in got] == [
        ("response", 3, None, "<a>"), ("response", 3, None, "<café>"), ("revisit", 77, "<a>", None), ("revisit", None, None, None),
    ]


def test_a_broken_archive_is_named(spark, tmp_path):
    whole = warc.page_record(1, "u", b"x" * 99, None, False)
    manifest = archive(tmp_path, spark, whole, gzip.compress(gzip.decompress(whole).replace(b"\r\nContent-Length", b"\r\nLength", 1)))
    with pytest.raises(Exception, match="foreign.warc.gz, record 1: the record has no content length"):
        warc.read_archives(manifest).collect()


def test_a_task_reads_one_archive(spark):
    manifest = warc.write_archives(odd_pages(spark).repartition(8), warc.archive_folder(spark), archive_bytes=1)
    rows = warc.read_archives(manifest).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in rows) == [1] * 8


def test_query_against_the_pages(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    groups = defaultdict(list)
    for i, data in pages.items():
        groups[data].append(i)
    want = {(i, len(d), digest(d), "response" if i == max(groups[d]) else "revisit", None if i == max(groups[d]) else max(groups[d])) for i, d in pages.items()}
    assert {tuple(r) for r in register.queries()["op2_warc"](spark, folder).collect()} == want
