import base64
import gzip
import hashlib
import io

import pytest

from trekframe.llm.warc import RecordReader, archive_round_trip, parse_record, read_archives, record_bytes, write_archives

ROWS = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u\r\nv", "x" * 200_000), (6, "http://b", "<p>é</p>"), (7, "n", "\0\0tail\r\n\r\n"), (None, "no id", "<p>é</p>"), (6, "http://b", "<p>é</p>")]


def b32(s):
    return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")


def test_round_trip(pages):
    got = archive_round_trip(pages).collect()
    assert all(r.digest_ok for r in got)
    last = {"<p>é</p>": 6, "": 4}
    want = []
    for i, _, html in ROWS:
        h = html or ""
        ref = last.get(h) if i is not None and h in last and i < last[h] else None
        want.append((i, len(h.encode()), b32(h), "revisit" if ref else "response", ref))
    key = lambda r: (r[0] or 0, r[3])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)


def test_least_bytes(pages):
    got = archive_round_trip(pages, min_bytes=5).collect()
    assert all(r.record_type == "response" for r in got if r.page_id in (3, 4))


def test_payloads_and_files_are_plain_gzip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    write_archives(pages, path, records_per_file=2)
    back = {r.page_id: r.payload for r in read_archives(spark, path).where("record_type = 'response'").collect()}
    assert back[5] == b"x" * 200_000 and back[7] == b"\0\0tail\r\n\r\n"
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


def test_empty(pages):
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_reader_in_small_blocks_and_broken_archives():
    one = record_bytes(1, "u", b"body", b32("body"), None)
    two = record_bytes(2, "u", b"body", b32("body"), 9)
    rows = [parse_record(*r) for r in RecordReader(io.BytesIO(one + b"\0\0" + two), block=3)]
    assert [(r[0], r[2], r[3], r[6], r[7]) for r in rows] == [(1, "response", None, True, b"body"), (2, "revisit", 9, True, None)]
    with pytest.raises(EOFError):
        list(RecordReader(io.BytesIO(one[:-5])))
    wrong = record_bytes(1, "u", b"body", b32("other"), None)
    assert parse_record(*next(iter(RecordReader(io.BytesIO(wrong)))))[6] is False


def test_a_length_that_does_not_hold_is_told():
    raw = gzip.decompress(record_bytes(1, "u", b"body", b32("body"), None)).replace(b"Content-Length: 4\r\n\r\nbody", b"Content-Length: 9\r\n\r\nbody")
    assert parse_record(*next(iter(RecordReader(io.BytesIO(gzip.compress(raw))))))[6] is False


def test_round_trip_raises_on_a_wrong_digest(spark, tmp_path):
    from trekframe.llm import warc

    def lies(rows):
        path = f"file://{tmp_path}/{len(rows)}"
        members = b"\0".join(rows) + b"\0"
        (tmp_path / str(len(rows))).mkdir()
        (tmp_path / str(len(rows)) / "a.warc.gz").write_bytes(members)
        return warc.verified(spark, path).collect()

    good = record_bytes(9, "u", b"body", b32("body"), None)
    assert len(lies([good])) == 1
    with pytest.raises(Exception, match="differs"):
        lies([good, record_bytes(1, "u", b"other", b32("other"), 9)])
    with pytest.raises(Exception, match="differs"):
        lies([good, record_bytes(1, "u", b"x", b32("y"), None), good])
