import base64
import gzip
import hashlib

from halocline.llm.warc import archive_pages, read_records

SCHEMA = "page_id long, url string, html string, n string, first_id long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def read(spark, rows, **options):
    index, path = archive_pages(pages(spark, rows), **options)
    key = lambda r: (r.record_id, r.record_type)
    return index, path, sorted(read_records(index, path).collect(), key=key)


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "u", "x" * 300_000), (6, "u", "<p>é</p>"), (7, "u", "\r\n\r\n")]
    _, _, got = read(spark, rows)
    by = {r.record_id: r for r in got}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r = by[f"urn:page:{i}"]
        data = (html or "").encode()
        first = min(k for k, _, h in rows if (h or "") == (html or ""))
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(data), sha(data), "response" if first == i else "revisit")
        assert r.refers_to == (None if first == i else f"urn:page:{first}")
        assert r.payload == (data if first == i else None)
    assert by["urn:page:4"].url == "http://a/4%0D%0AX: y" and by["urn:page:3"].url is None


def test_small_payloads_are_all_responses(spark):
    _, _, got = read(spark, [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "x" * 50), (4, "d", "x" * 50)], least_bytes=10)
    assert [r.record_type for r in got] == ["response", "response", "response", "revisit"]


def test_null_and_repeated_ids_and_empty_table(spark):
    _, _, got = read(spark, [(None, "a", "same"), (5, "b", "same"), (5, "c", "same"), (None, "d", "alone")])
    assert sorted((r.record_id, r.record_type) for r in got) == [("urn:page:5", "response"), ("urn:page:5", "response"), ("urn:page:null", "response"), ("urn:page:null", "revisit")]
    assert read(spark, [])[2] == []


def test_selected_records_and_other_readers(spark):
    index, path, _ = read(spark, [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)])
    some = index.where("url like '%7'")
    assert sorted(r.payload.decode() for r in read_records(some, path).collect()) == sorted(f"page {i} " * 50 for i in range(7, 200, 10))
    row = index.where("record_id = 'urn:page:42'").first()
    folder = path.removeprefix("file:")
    with open(f"{'/' + folder.lstrip('/')}/{row.archive}", "rb") as f:
        f.seek(row.offset)
        text = gzip.decompress(f.read(row.length)).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("page 42 " * 50 + "\r\n\r\n")
