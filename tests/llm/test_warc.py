import base64
import hashlib

from swingkit.llm import warc
from swingkit.llm.common import new_folder


def trip(spark, rows, chunk=warc.CHUNK):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk int, value string")
    path = new_folder(spark, "warc")
    warc.write_archives(warc.with_types(pages), path, chunk)
    return path, [tuple(r) for r in warc.read_records(spark, path).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


def expected(page_id, url, html, kind="response", to=None):
    raw = (html or "").encode()
    return page_id, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, to


def test_round_trip(spark):
    nasty = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3 + "é€😀" * 40 + "\r\n\r\n"
    rows = [(2, "u2", nasty), (5, "u5", "same"), (3, "u\r\n3", "same"), (9, None, "same"), (4, "u4", None), (7, "u7", ""), (8, "u8", "x" * 3000), (1, "u1", "WARC/1.1\r\n")]
    want = sorted([
        expected(2, "u2", nasty), expected(5, "u5", "same", "revisit", 3), expected(3, "u%0D%0A3", "same"), expected(9, None, "same", "revisit", 3),
        expected(4, "u4", None), expected(7, "u7", "", "revisit", 4), expected(8, "u8", "x" * 3000), expected(1, "u1", "WARC/1.1\r\n"),
    ])
    for chunk in (7, 1000, warc.CHUNK):
        path, got = trip(spark, [(*r, 1, "v") for r in rows], chunk)
        assert sorted(got) == want
        assert spark.read.text(path, lineSep="\r\n").filter("value like 'WARC-Type: %'").count() >= len(rows)


def test_null_and_repeated_ids_and_no_rows(spark):
    _, got = trip(spark, [(None, "a", "p", 1, ""), (None, "b", "p", 1, ""), (6, "c", "q", 1, ""), (6, "c", "q", 1, ""), (None, "d", "q", 1, "")])
    assert sorted((r[1], r[4], r[5]) for r in got) == [("a", "response", None), ("b", "response", None), ("c", "response", None), ("c", "response", None), ("d", "revisit", 6)]
    _, got = trip(spark, [(1, "a", "p", 1, "")][:0])
    assert got == []


def test_long_payload(spark):
    long = "é" * 200_000
    _, got = trip(spark, [(1, "a", long, 1, "")])
    assert got == [expected(1, "a", long)]


def test_marks_at_the_end_of_payloads_chunks_and_urls(spark):
    rows = [(1, "u WARC/1.1", "x WARC/1.1"), (2, "u", "WARC/1.1"), (3, "u", "abWARC/1.1\r\nWARC/1.1"), (4, "u", "é" * 7 + "WARC/1.1" * 3 + "\r\n"), (5, "u", "WARC")]
    want = sorted(expected(k, u.replace("C/1", "C%2F1"), t) for k, u, t in rows)
    for chunk in (8, 10, 11, warc.CHUNK):
        assert sorted(trip(spark, [(*r, 1, "v") for r in rows], chunk)[1]) == want


def test_headers(spark):
    path, _ = trip(spark, [(1, "http://a", "p" * 25, 1, ""), (2, "http://b", "p" * 25, 1, "")], 10)
    found = sorted((r.value for r in spark.read.text(path, lineSep="WARC/1.1\r\n").collect() if r.value), key=lambda v: ("continuation" in v, "revisit" in v, "Number: 3" in v))
    assert len(found) == 4
    for value in found:
        head, _, rest = value.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n"))
        assert {"WARC-Type", "WARC-Date", "WARC-Record-ID", "Content-Length"} <= set(fields)
        assert len(fields["WARC-Record-ID"]) == len("<urn:uuid:>") + 36 and rest[int(fields["Content-Length"]) :] == "\r\n\r\n"
        assert (fields["WARC-Type"] == "continuation") == ("WARC-Segment-Origin-ID" in fields)
        assert (fields["WARC-Type"] == "revisit") == ("WARC-Profile" in fields) == (fields.get("WARC-Refers-To-Target-URI") == "http://a")
        assert ("WARC-Segment-Total-Length" in fields) == (fields.get("WARC-Segment-Number") == "3")
