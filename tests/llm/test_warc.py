"""WARC archives against a brute-force reading of the same rows and of the same bytes."""

from __future__ import annotations

import hashlib

import pytest
from helpers import ordered
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"
LONG = "<p>é " * 60
ROWS = [
    (5, "http://a.example/x?q=1#top", LONG), (3, "http://b.example", LONG), (9, None, LONG), (9, "http://c.example/ü", LONG),
    (1, "http://a.example/", "short"), (2, "http://a.example/", "short"), (4, "", ""), (6, "no url\r\nWARC-Type: metadata", None),
    (7, "http://d.example/", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\r\n\r\n" * 40),
    (8, "http://e.example/", "WARC/1.0\r\nWARC/1.0\r\n"), (10, "http://e.example/", "\r\n\r\n" * 50), (None, "http://f.example/", LONG),
    (None, None, "x" * 300_000), (11, "http://g.example/", "x" * 300_000), (12, "u", "y" * 100), (13, "u", "y" * 100), (14, "u", "y" * 99), (15, "u", "y" * 99),
]


def brute(rows: list[tuple], least: int = 100) -> list[tuple]:
    groups: dict[bytes, list] = {}
    for at, (page, url, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is None, page, url is not None, url or "", at))
    out = []
    for payload, own in groups.items():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3], r[4]))
        for k, r in enumerate(own):
            again = k > 0 and len(payload) >= least
            out.append((r[1], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", own[0][1] if again else None))
    return out


def round_trip(spark, pages, tmp_path, **how):
    from tidemark.llm.warc import archive_records, assemble, capture_rows, page_captures, read_archives, write_archives

    folder = write_archives(archive_records(capture_rows(pages)), f"{tmp_path}/warc", **how)
    return page_captures(assemble(read_archives(spark, folder)))


DIGEST = ("page_id", "payload_bytes", "payload_digest", "kind", "refers_to_page")


@pytest.mark.parametrize("how", [{}, {"compression": "gzip"}])
def test_round_trip(spark, tmp_path, how):
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({c: F.lit("own") for c in ("kind", "record_id", "copy", "digest", "payload", "value")})
    out = round_trip(spark, pages, tmp_path, **how)
    assert ordered(out.select(*DIGEST).collect()) == ordered(brute(ROWS))
    rows = out.collect()
    assert ordered((r.page_id, r.url) for r in rows) == ordered((r[0], r[1]) for r in ROWS)
    assert ordered((r.page_id, r.url, bytes(r.payload)) for r in rows if r.kind == "response") == ordered(
        (p, u, (h or "").encode()) for p, u, h in ROWS if (p, len((h or "").encode())) in {(r.page_id, r.payload_bytes) for r in rows if r.kind == "response"} and (p, u) != (9, "http://c.example/ü"))
    assert all(r.request.block.startswith("GET ") and r.request.target == r.target and r.declared_digest == r.payload_digest for r in rows)


def test_repeated_rows(spark, tmp_path):
    rows = [*ROWS, *ROWS[:1] * 3, ROWS[1], ROWS[4], ROWS[7]]
    assert ordered(round_trip(spark, spark.createDataFrame(rows, PAGES), tmp_path).select(*DIGEST).collect()) == ordered(brute(rows))


@pytest.mark.parametrize("size", ["700"])
def test_files_are_split(spark, tmp_path, size):
    """Blocks that hold version lines are whole again, wherever the files are cut."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for rows in (ROWS, [r for r in ROWS if not (r[2] or "").startswith("WARC")]):
            out = round_trip(spark, spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/{len(rows)}")
            assert ordered(out.select(*DIGEST).collect()) == ordered(brute(rows))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_payloads_join_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.llm.warc.MOST_BROADCAST", 0)
    assert ordered(round_trip(spark, spark.createDataFrame(ROWS, PAGES), tmp_path).select(*DIGEST).collect()) == ordered(brute(ROWS))


def test_bytes_are_a_warc_file(spark, tmp_path):
    """Records one after another, each as long as its header says; links lead to the response."""
    from tidemark.llm.warc import archive_records, capture_rows, write_archives

    write_archives(archive_records(capture_rows(spark.createDataFrame(ROWS, PAGES).coalesce(1))), f"{tmp_path}/warc")
    kinds: dict[str, list] = {}
    for path in tmp_path.glob("warc/part-*"):
        data = path.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            assert first == "WARC/1.0"
            fields = dict(line.split(": ", 1) for line in lines)
            size = int(fields["Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            data = rest[size + 4:]
            kinds.setdefault(fields["WARC-Type"], []).append(fields)
    answers = {f["WARC-Record-ID"] for f in kinds["response"] + kinds["revisit"]}
    assert len(answers) == len(ROWS) and all(f["WARC-Concurrent-To"] in answers for f in kinds["request"] + kinds["metadata"])
    assert {f["WARC-Refers-To"] for f in kinds["revisit"]} <= {f["WARC-Record-ID"] for f in kinds["response"]}


def test_missing_records_and_empty_tables(spark, tmp_path):
    from tidemark.llm.warc import archive_records, assemble, capture_rows, page_captures, read_archives, write_archives

    assert round_trip(spark, spark.createDataFrame([], PAGES), f"{tmp_path}/none").collect() == []
    folder = write_archives(archive_records(capture_rows(spark.createDataFrame(ROWS, PAGES))), f"{tmp_path}/some")
    records = read_archives(spark, folder).filter(~F.col("head").contains("WARC-Type: metadata") & ~F.col("head").contains("WARC-Type: response"))
    rows = page_captures(assemble(records)).collect()
    assert rows and all(r.kind == "revisit" and r.metadata is None and r.request is not None and r.payload_bytes is None and r.page_id is None for r in rows)


def test_text_that_is_no_archive_is_refused(spark, tmp_path):
    from tidemark.llm.warc import read_archives

    (tmp_path / "bad.warc").write_bytes(b"some text\r\n\r\n")
    with pytest.raises(Exception, match="no record"):
        read_archives(spark, str(tmp_path)).collect()


def test_query(spark):
    import duckdb

    from tidemark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert ordered(QUERIES["op11_warc"](spark, "/root/testdata/sf0.001").select(*names).collect()) == ordered(
        con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op11_warc']})").fetchall())
