import hashlib
import io

import pytest
import zstandard
from pyspark.errors import PythonException

from parcelscope.llm.common import scratch_path
from parcelscope.llm.warc_zstd import (DICT_FRAME, base32_sha1, op5_warc_zstd, parse, read_archives, read_stream,
                                       record, write_archives)
from tests.llm.common import rows

PAGES = "page_id bigint, url string, html string, sha string, size bigint, path string"


def test_query_equals_brute_force(spark, smoke_dir):
    got = {r.page_id: tuple(r)[1:] for r in op5_warc_zstd(spark, smoke_dir).collect()}
    given = rows(smoke_dir, "pages", "page_id", "html")
    first = {}
    for i, html in sorted(given):
        first.setdefault((html or "").encode(), i)
    want = {}
    for i, html in given:
        raw = (html or "").encode()
        own = first[raw] == i
        want[i] = (len(raw), base32_sha1(raw), "response" if own else "revisit", None if own else first[raw])
    assert got == want


def _pages(spark, given):
    return spark.createDataFrame([(i, u, h, "s", 1, "p") for i, u, h in given], PAGES)


def test_round_trip_and_edge_cases(spark):
    long = "<p>é</p>" * 200_000
    given = [(1, "http://a/ b\r\n", long), (2, None, long), (3, "u", None), (4, "u", ""), (None, "u", long),
             (9, "x", "lone"), (9, "x", "lone"), (None, None, "nobody")]
    manifest = write_archives(_pages(spark, given), scratch_path(spark, "warc-test"))
    got = read_archives(manifest).collect()
    assert len(got) == len(given) == sum(r.records for r in manifest.collect())
    found = sorted((r.record_id, r.record_type, r.refers_to or "") for r in got)
    assert found == sorted([
        ("urn:page:1", "response", ""), ("urn:page:2", "revisit", "urn:page:1"), ("urn:page:3", "response", ""),
        ("urn:page:4", "revisit", "urn:page:3"), ("urn:page:", "revisit", "urn:page:1"),
        ("urn:page:9", "response", ""), ("urn:page:9", "response", ""), ("urn:page:", "response", "")])
    one = next(r for r in got if r.record_id == "urn:page:1")
    assert bytes(one.payload).decode() == long and one.target_uri == "http://a/%20b%0D%0A"
    assert read_archives(write_archives(_pages(spark, []), scratch_path(spark, "warc-none"))).count() == 0


def test_least_size_of_revisits(spark):
    manifest = write_archives(_pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]),
                              scratch_path(spark, "warc-least"), revisit_min_bytes=3)
    assert {r.record_id[-1]: r.record_type for r in read_archives(manifest).collect()} == {
        "1": "response", "2": "response", "3": "response", "4": "revisit"}


def _frame(data, dictionary=None):
    return zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True).compress(data)


def test_dictionary_frames():
    records = [record(f"urn:page:{i}", "http://e/", f"<html>page {i} of many pages {i * 7}</html>".encode() * 9,
                      base32_sha1(f"<html>page {i} of many pages {i * 7}</html>".encode() * 9), None, "2000-01-01T00:00:00Z")
               for i in range(300)]
    trained = zstandard.train_dictionary(4096, records)
    for raw in (trained.as_bytes(), zstandard.ZstdCompressor().compress(trained.as_bytes())):
        head = DICT_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
        other = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
        archive = head + b"".join(_frame(r, trained) for r in records[:9]) + other + _frame(records[9], trained)
        got = list(read_stream(io.BytesIO(archive)))
        assert [r["record_id"] for r in got] == [f"urn:page:{i}" for i in range(10)]
    # incompressible, repeated and large records give the other block kinds
    noise = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(9000))
    for payload in (noise, b"a" * 300_000, b""):
        data = record("urn:page:1", None, payload, base32_sha1(payload), None, "2000-01-01T00:00:00Z")
        assert next(read_stream(io.BytesIO(_frame(data))))["payload"] == payload


@pytest.mark.parametrize("change", [
    lambda d: d.replace(b"WARC/1.1", b"WARC/0.9"), lambda d: d.replace(b"WARC-Date: ", b"WARC-Data: "),
    lambda d: d.replace(b"hello", b"hullo"), lambda d: d[:-1], lambda d: d + b"x",
    lambda d: d.replace(b"Content-Length: 5", b"Content-Length: 6")])
def test_faults_are_found(change):
    good = record("urn:page:1", "u", b"hello", base32_sha1(b"hello"), None, "2000-01-01T00:00:00Z")
    assert parse(good)["payload"] == b"hello"
    with pytest.raises(ValueError):
        parse(change(good))


def test_a_cut_archive_fails(spark):
    manifest = write_archives(_pages(spark, [(i, "u", f"page {i}" * 50) for i in range(9)]).coalesce(1),
                              scratch_path(spark, "warc-cut"))
    path = manifest.first().path.removeprefix("file:")
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[:-5])
    with pytest.raises(PythonException, match="archive ends inside a frame"):
        read_archives(manifest).collect()


def test_archives_are_plain_frames(spark):
    manifest = write_archives(_pages(spark, [(i, "u", f"page {i} " * 300) for i in range(400)]).coalesce(1),
                              scratch_path(spark, "warc-plain"))
    with open(manifest.first().path.removeprefix("file:"), "rb") as f:
        data = f.read()
    assert data[:4] == DICT_FRAME.to_bytes(4, "little")
    assert len(data) == manifest.first().bytes and len(list(read_stream(io.BytesIO(data)))) == 400
