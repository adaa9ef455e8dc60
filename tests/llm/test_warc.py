import gzip
import io
import json
import zlib

import pytest

from lexmill.llm import warc

PAGES = [(1, "http://a/", "<p>one</p>"), (2, None, ""), (3, "http://b/\r\nx", None), (None, "u", "é" * 9), (5, "http://c/", "x\r\n\r\nWARC/1.0\r\n" * 60000), (1, "http://a/", "<p>one</p>")]


def rewritten(data, chunk=warc.CHUNK):
    out = io.BytesIO()
    entries, status = warc.rewrite(io.BytesIO(data), out, chunk=chunk)
    return out.getvalue(), entries, status


@pytest.mark.parametrize("chunk", [7, 100, 1 << 18])
def test_members_hold_the_records(chunk):
    records = [warc.record_bytes(*p) for p in (PAGES if chunk > 99 else PAGES[:4])]
    out, entries, status = rewritten(gzip.compress(b"".join(records)), chunk)
    assert status == "whole"
    assert [zlib.decompress(out[e.offset : e.offset + e.length], 31) for e in entries] == records
    assert gzip.decompress(out) == b"".join(records)
    assert sum(e.length for e in entries) == len(out)


def test_streams_that_have_members_already_give_the_same():
    records = [warc.record_bytes(*p) for p in PAGES]
    mono = rewritten(gzip.compress(b"".join(records)))
    many = rewritten(b"".join(gzip.compress(r) for r in records))
    odd = rewritten(gzip.compress(b"".join(records[:2]) + records[2][:9]) + gzip.compress(records[2][9:] + b"".join(records[3:])) + b"\0" * 40)
    assert mono == many == odd


def test_damage_keeps_what_comes_before():
    records = [warc.record_bytes(k, "u", f"{k}" * 999) for k in range(50)]
    data = gzip.compress(b"".join(records))
    out, entries, status = rewritten(data[:-30])
    assert status == "truncated" and 40 < len(entries) <= 50
    assert gzip.decompress(out) == b"".join(records[: len(entries)])
    assert rewritten(gzip.compress(records[0] + b"nonsense\r\n\r\n"))[2] == "skipped"
    assert rewritten(gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\n"))[1:] == ([], "skipped")
    assert rewritten(b"not gzip at all")[1:] == ([], "corrupt")
    assert rewritten(b"")[1:] == ([], "whole")
    assert rewritten(gzip.compress(b""))[1:] == ([], "whole")


def test_round_trip_through_files(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS part").coalesce(2)
    files = warc.cut(warc.write_monolithic(df, f"{tmp_path}/in"))
    index = warc.normalise(files.union(files).union(spark.createDataFrame([(None,)], "path string")), f"{tmp_path}/out")
    assert {r.status for r in index.collect()} == {"whole"}
    got = sorted((tuple(r) for r in warc.read_pages(index).collect()), key=str)
    want = [(None if i is None else str(i), u and u.replace("\r\n", "%0D%0A"), h, len((h or "").encode())) for i, u, h in PAGES]
    assert got == sorted(want, key=str)
    side = warc.read_index(spark, f"{tmp_path}/out")
    assert sorted(map(str, warc.read_pages(side).collect())) == sorted(map(str, warc.read_pages(index).collect()))
    assert json.loads(next((tmp_path / "out").glob("*.idx")).read_text().splitlines()[0])["offset"] == 0
    assert not list((tmp_path / "out").glob("_*"))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_monolithic(none, f"{tmp_path}/in").count() == 0
    assert warc.normalise(spark.createDataFrame([], "path string"), f"{tmp_path}/out").count() == 0
    index = warc.normalise(spark.createDataFrame([], "path string"), f"{tmp_path}/out")
    assert warc.read_pages(index).count() == 0


@pytest.mark.parametrize("chunk", [11, 1 << 18])
def test_bad_headers_cost_themselves_only(chunk):
    records = [warc.record_bytes(k, "u", f"{k}" * 99) for k in range(6)]
    odd = [b"junk without end ", b"WARC/1.0\r\nno colon here\r\n", b"WARC/1.1\r\nContent-Length: -5\r\n\r\n", b"WARC/1.0\r\nA: b\r\n\r\nbody\r\n\r\n", b"\x00\xff" * 500 + b"\r\n"]
    data = b"".join(x for pair in zip(records, odd) for x in pair) + records[5]
    out, entries, status = rewritten(gzip.compress(data), chunk)
    # junk that doesn't end in a line end takes nothing with it but itself
    assert status == "skipped" and gzip.decompress(out) == b"".join(r for k, r in enumerate(records) if k != 1)
    assert len(entries) == 5


def test_long_headers_and_foreign_records(spark, tmp_path):
    long = b"WARC/1.0\r\nWARC-Type: response\r\nX-Long: " + b"y" * (3 << 20) + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    folded = b"WARC/1.1\nWARC-Type: resource\nWARC-Target-URI: http://a/\n  b\nWARC-Record-ID: <urn:uuid:7e0c4f7a-58c6-4c1e-9f0a-2b1f3a1d9c77>\nContent-Length: 2\n\nhi\r\n\r\n"
    plain = warc.record_bytes("a-7", "u", "x")
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(long + folded + plain))
    index = warc.normalise(spark.createDataFrame([(f"{tmp_path}/f.warc.gz",)], "path string"), f"{tmp_path}/out")
    got = sorted((tuple(r) for r in warc.read_pages(index).collect()), key=str)
    assert got == sorted([(None, None, "abc", 3), ("<urn:uuid:7e0c4f7a-58c6-4c1e-9f0a-2b1f3a1d9c77>", "http://a/ b", "hi", 2), ("a-7", "u", "x", 1)], key=str)
