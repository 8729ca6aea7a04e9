"""Session files: byte ranges, gzip, files that break off, bytes that aren't text; imports that are repeated or refused."""

from __future__ import annotations

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import recordings as R
from tidemark.sources import vendor as V
from tidemark.sources.session_lines import BROKEN, NOT_TEXT, session_lines


def tick(day, minute, spot):
    return json.dumps({"t": "tick", "ts": f"{day}T15:{minute:02d}:00+00:00", "market": {"spot": spot}, "option_rows": [], "bars": []})


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_byte_ranges_give_each_line_once_with_its_place(spark, tmp_path, split):
    lines = ["", "a", "é" * 40, "  ", "b" * 300, "c\r", "last without an end"]
    data = "\n".join(lines).encode()
    (tmp_path / "x_2024-01-02.jsonl").write_bytes(data)
    got = session_lines(spark, str(tmp_path), splitBytes=str(split)).orderBy("position").collect()
    assert [r.line for r in got] == ["a", "é" * 40, "b" * 300, "c", "last without an end"]
    assert all(data[r.position :].startswith(r.line.encode()) for r in got) and {r.session_file for r in got} == {"2024-01-02"}


def test_broken_and_odd_files_are_rows(spark, tmp_path):
    whole = gzip.compress("\n".join(f"line {i} {i * 7919 % 10007}" for i in range(5000)).encode())
    (tmp_path / "ticks_2024-01-02.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "ticks_2024-01-03.jsonl.gz").write_bytes(gzip.compress(b"one\n") + gzip.compress(b"two\n"))
    (tmp_path / "ticks_2024-01-04.jsonl").write_bytes(b"good\n\xff\xfe bad\n")
    (tmp_path / "ticks_2024-01-05.jsonl").write_bytes(b"")
    (tmp_path / "ticks_2024-01-06.jsonl.gz").write_bytes(b"no gzip at all")
    (tmp_path / "_ticks_2024-01-07.jsonl").write_bytes(b"hidden\n")
    rows = session_lines(spark, str(tmp_path)).orderBy("session_file", "position").collect()
    by = {}
    for r in rows:
        by.setdefault(r.session_file, []).append(r)
    cut = by["2024-01-02"]
    assert cut[-1].problem == BROKEN and 0 < len(cut) - 1 < 5000
    assert [r.line for r in cut[:-1]] == [f"line {i} {i * 7919 % 10007}" for i in range(len(cut) - 1)]
    assert [r.line for r in by["2024-01-03"]] == ["one", "two"]
    assert [(r.problem, r.line[-3:]) for r in by["2024-01-04"]] == [(None, "ood"), (NOT_TEXT, "bad")]
    assert [(r.line, r.problem) for r in by["2024-01-06"]] == [(None, BROKEN)]
    assert "2024-01-05" not in by and "2024-01-07" not in by
    one = session_lines(spark, str(tmp_path), ["2024-01-03"])
    assert one.count() == 2 and one.rdd.getNumPartitions() == 1
    assert session_lines(spark, str(tmp_path), []).count() == 0


def test_gzip_lines_cross_chunks_and_members(tmp_path):
    from tidemark.sources.session_lines import packed_lines

    text = b"\n".join([b"x" * 3_000_000, b"", b"y" * 7, b"z" * 2_500_000])
    for packed in (gzip.compress(text), gzip.compress(text[:3_000_005]) + b"\0" * 5 + gzip.compress(text[3_000_005:])):
        path = tmp_path / "a.gz"
        path.write_bytes(packed)
        with pa.OSFile(str(path)) as raw:
            got = list(packed_lines(raw))
        assert b"".join(d for _, d, _ in got) == text and not any(b for _, _, b in got)
        assert all(text.startswith(d, at) for at, d, _ in got)


def test_recording_rows_of_lines_that_are_no_records(spark, tmp_path):
    good = json.dumps({"seq": 0, "snapshot_id": "s", "schema_version": "1", "record_hash": "h", "snapshot": "{}"})
    (tmp_path / "2024-01-02.jsonl").write_text("\n".join([good, "{cut", "[1]", '{"seq": 1}', good]))
    got = R.read_recording(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.parsed for r in got] == [True, False, False, False, True] and got[1].line == "{cut"


def test_import_is_idempotent_and_keeps_live_sessions(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for day in ("2024-01-02", "2024-01-03"):
        lines = [tick(day, m, 100 + m) for m in range(5)] + ["{broken", tick(day, 9, "NaN")]
        (source / f"ticks_{day}.jsonl.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    assert V.import_archive(spark, str(source), target).count() == 0
    again = {(str(r.session_date), r.reason) for r in V.import_archive(spark, str(source), target).collect()}
    assert again == {("2024-01-02", "already imported"), ("2024-01-03", "already imported")}
    assert spark.read.parquet(target).count() == 10
    # the second day becomes live; the archive of the first grows
    rows = [r.asDict() for r in spark.read.parquet(target).filter("session_date = '2024-01-03'").limit(2).collect()]
    live = spark.createDataFrame([{**r, "flags": ["live"]} for r in rows], spark.read.parquet(target).schema)
    live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(target)
    (source / "ticks_2024-01-02.jsonl.gz").write_bytes(gzip.compress("\n".join(tick("2024-01-02", m, 100 + m) for m in range(8)).encode()))
    refused = V.import_archive(spark, str(source), target, overwrite=True).collect()
    assert [(str(r.session_date), r.reason) for r in refused] == [("2024-01-03", "holds live records; not overwritten")]
    counts = {(str(r.session_date), r.flags[0]): r["count"] for r in spark.read.parquet(target).groupBy("session_date", "flags").count().collect()}
    assert counts == {("2024-01-02", "imported"): 8, ("2024-01-03", "live"): 2}
    V.import_archive(spark, str(source), target, ["2024-01-02"], overwrite=True)
    assert spark.read.parquet(target).count() == 10
