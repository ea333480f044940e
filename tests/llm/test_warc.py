import hashlib
import base64

import pytest

from sorrel.llm.warc import dedupe_pages, parse_record, read_members, record_bytes

SCHEMA = "page_id long, url string, html string, digest string, file string"


def expected(rows):
    out = []
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(best.get(html or "", (-1, 0)), (-1 if page is None else page, 1))
    for page, url, html in rows:
        p = (html or "").encode()
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()))
    return out


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a", "x" * 5000), (2, "http://b\r\nX-Page-ID: 9", "x" * 5000), (3, None, None), (4, "http://c", ""), (5, "u", "é漢"), (None, "n", "solo"), (7, "v", "a\r\n\r\nWARC/1.1\r\n"), (8, "w", "x" * 5000)]
    got = dedupe_pages(spark, spark.createDataFrame([(*r, "d", "f") for r in rows], SCHEMA)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(expected(rows), key=str)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {1: ("revisit", 8), 2: ("revisit", 8), 8: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None), 7: ("response", None)}
    assert {r.page_id: r.url for r in got}[2] == "http://b%0D%0AX-Page-ID:%209"


def test_repeated_ids_and_floor(spark):
    rows = [(1, "a", "same"), (1, "a", "same"), (2, "b", "a long payload"), (3, "b", "a long payload")]
    df = spark.createDataFrame([(*r, "d", "f") for r in rows], SCHEMA)
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in dedupe_pages(spark, df).collect())
    assert got == [(1, "response", 0), (1, "revisit", 1), (2, "revisit", 3), (3, "response", 0)]
    got = sorted((r.page_id, r.record_type) for r in dedupe_pages(spark, df, min_bytes=10).collect())
    assert got == [(1, "response"), (1, "response"), (2, "revisit"), (3, "response")]


def test_empty(spark):
    assert dedupe_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_split_at_any_byte():
    import io

    raw = record_bytes("response", [("X", "1")], b"abc") + record_bytes("revisit", [("X", "2")], None)
    for chunk in (1, 7, 100, 1 << 20):
        found = [parse_record(m) for m in read_members(io.BytesIO(raw), chunk)]
        assert [f["X"] for f, _ in found] == ["1", "2"] and found[0][1] == b"abc"
    with pytest.raises(ValueError):
        list(read_members(io.BytesIO(raw[:-5])))
