"""Archives: exact round trip with magic inside payloads, over block borders, and the rules for revisits."""

import base64
import hashlib

import pytest

from framelake.llm.warc import read_warc, resolve_revisits, write_warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {}\r\n\r\nboo\r\n\r\n"
PAYLOADS = [
    None, "", "plain", "ends in break\r\n", "\r\n\r\n", "\r\n\r\n\r\n\r\n\r", "\r\r\n\r\n", FAKE.format(3), "x\r\n" + FAKE.format(3) * 3, FAKE.format(10**9), "a\n" + FAKE.format(0),
    "WARC/1.0", "WARC/1.0\r\nContent-Length: 5", "é" * 5000, "z" * 40_000, "\r\n".join(["line"] * 4000), "plain", "", "Content-Length: 7\r\n\r\n", FAKE.format(10), "\u0000\u0001",
]


def rows_of(n):
    return [(i, f"http://h/{i}" if i % 3 else None, PAYLOADS[i % len(PAYLOADS)] if i < 2 * len(PAYLOADS) else f"{i} {PAYLOADS[i % len(PAYLOADS)]}", i) for i in range(n)]


def expected(rows, least):
    largest = {}
    for i, _, p, _ in rows:
        largest[p or ""] = max(largest.get(p or "", i), i)
    out = []
    for i, url, p, _ in rows:
        data = (p or "").encode()
        revisit = len(data) >= least and largest[p or ""] != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((f"<urn:page:{i}>", "revisit" if revisit else "response", url, f"<urn:page:{largest[p or '']}>" if revisit else None, digest, len(data), b"" if revisit else data))
    return sorted(out, key=str)


@pytest.mark.parametrize("split,least", [("128m", 0), ("7k", 6), ("900b", 0)])
def test_round_trip(spark, tmp_path, split, least):
    rows = rows_of(120)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type long").coalesce(2)
        write_warc(df, f"{tmp_path}/w", min_revisit_bytes=least)
        found = read_warc(spark, f"{tmp_path}/w").drop("file").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(((*r[:6], bytes(r[6])) for r in found), key=str) == expected(rows, least)


def test_empty_nulls_ties_and_repeated_rows(spark, tmp_path):
    schema = "page_id long, url string, html string"
    write_warc(spark.createDataFrame([], schema), f"{tmp_path}/none")
    assert read_warc(spark, f"{tmp_path}/none").count() == 0
    write_warc(spark.createDataFrame([(None, None, None), (5, "u\r\nX: y", "p"), (5, "u", "p"), (4, "u", "p"), (None, "u", "p")], schema), f"{tmp_path}/some")
    found = sorted((r.record_id, r.record_type, r.target_uri or "", r.refers_to or "") for r in read_warc(spark, f"{tmp_path}/some").collect())
    assert found == [
        ("<urn:page:4>", "revisit", "u", "<urn:page:5>"), ("<urn:page:5>", "response", "u", ""), ("<urn:page:5>", "response", "u%0A%0AX: y", ""), ("<urn:page:>", "response", "", ""), ("<urn:page:>", "revisit", "u", "<urn:page:5>"),
    ]


def test_foreign_archive_with_a_cut_end(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nwarc-record-id: <a>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record % (4, b"\xff\x00\r\n") + record % (0, b"") + (record % (30, b"q" * 30))[:-20])
    (tmp_path / "b.warc").write_bytes(record % (2, b"ok"))
    assert sorted(bytes(r.payload) for r in read_warc(spark, str(tmp_path)).collect()) == [b"", b"ok", b"\xff\x00\r\n"]


def test_revisits_of_a_foreign_archive_have_their_responses_length(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n"
    rows = [(b"response", b"r", b"", b"hello"), (b"revisit", b"v", b"WARC-Refers-To: <r>\r\n", b""), (b"revisit", b"w", b"WARC-Refers-To: <gone>\r\n", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(head % (kind, name, more, len(body), body) for kind, name, more, body in rows))
    found = resolve_revisits(read_warc(spark, str(tmp_path)))
    assert sorted((r.record_id, r.declared_bytes) for r in found.collect()) == [("<r>", None), ("<v>", 5), ("<w>", None)]
