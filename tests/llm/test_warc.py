import gzip
import hashlib
import io

from spanloom.llm import warc

BIG = "<p>" + "x" * 1500 + "é</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/ 2", "small"), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "WARC/1.1\r\n\r\nin\r\n\r\nside"), (None, "u", BIG), (8, "u", "y" * 400_000)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' as payload", "'b' as record_type", "0 as refers_to").repartition(2)


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.round_trip(frame(spark)).collect()}
    assert len(got) == len(PAGES)
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == BIG and page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))


def test_empty_and_repeated(spark):
    assert warc.round_trip(frame(spark).limit(0)).count() == 0
    rows = warc.round_trip(frame(spark, [(3, "u", BIG), (3, "u", BIG), (2, "u", BIG)])).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(2, "revisit"), (3, "response"), (3, "response")]


def test_predicates_reach_the_reader(spark, tmp_path):
    to = f"file://{tmp_path}/w"
    warc.write(frame(spark), to)
    rows = warc.reader(spark).load(to)
    own = rows.filter("record_type = 'revisit' and record_id in ('urn:page:1', 'urn:page:9')")
    assert "Filter" not in own._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].replace("PushedFilters", "") or own.count() == 1
    assert [r.record_id for r in own.collect()] == ["urn:page:1"]
    assert rows.filter("record_type = 'response'").count() == len(PAGES) - 2


def test_unwanted_blocks_are_not_kept():
    def record(kind, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = [record("warcinfo", b"a" * 700_000), record("resource", b"abc"), record("metadata", b"")]
    for data in (b"".join(blocks), b"".join(map(gzip.compress, blocks))):
        rows = list(warc.records(io.BytesIO(data), ["record_id", "payload"], {"record_type": {"resource"}}))
        assert rows == [{"record_id": "urn:resource", "payload": b"abc"}]
        cut = list(warc.records(io.BytesIO(data[: len(data) - 30]), ["record_type"], {}))
        assert [r["record_type"] for r in cut][:2] == ["warcinfo", "resource"]
    assert list(warc.records(io.BytesIO(b""), ["record_id"], {})) == []


def test_decompression_is_bounded():
    """A payload that shrinks a thousandfold, whole and cut short."""
    html = b"\0" * 3_000_000
    record = warc._record(1, "u", html, hashlib.sha1(html).hexdigest(), None)
    assert len(record) < len(html) / 100

    for most in (1000, 1 << 16, 1 << 20):
        stream = warc.Members(io.BytesIO(record), 700, most)
        sizes = []
        while stream._more():
            sizes.append(len(stream.data))
            stream.at = len(stream.data)
        assert max(sizes) <= most and sum(sizes) > len(html)
        (row,) = warc.records(io.BytesIO(record + record[:-200]), ["payload_bytes", "payload_sha1"], {}) if most > 1000 else [None]
        assert row is None or (row["payload_bytes"], row["payload_sha1"]) == (len(html), hashlib.sha1(html).hexdigest())
    assert [len(list(warc.records(io.BytesIO(record[:-n]), ["payload_bytes"], {}))) for n in (200, 400, len(record) // 2)] == [0, 0, 0]


def test_damaged_archives_give_the_records_before():
    whole = warc._record(1, "u", b"abc", "d", None)
    damaged = whole[:40] + bytes(b ^ 255 for b in whole[40:80]) + whole[80:]
    assert [r["record_id"] for r in warc.records(io.BytesIO(whole + damaged + whole), ["record_id"], {})] == ["urn:page:1"]
    plain = gzip.decompress(whole)
    unsized = plain.replace(b"Content-Length: ", b"Content-Length: x", 1)
    assert len(list(warc.records(io.BytesIO(plain + plain.replace(b"Content-Length: 3", b"Content-Length: ?")), ["record_id", "http_length", "payload"], {}))) in (1, 2)
    assert len(list(warc.records(io.BytesIO(plain + unsized.replace(b"application/http", b"text/plain")), ["record_id", "payload"], {}))) >= 1
