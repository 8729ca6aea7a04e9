"""A data source `session_lines`: the lines of session files with their place in the file, plain or gzip.

What the text reader can't give: the position that orders lines inside a file, pruning of files by session, and a file that
breaks off (a recorder that was killed) as a row instead of a failed job. Plain files are cut in byte ranges; a gzip file is
one task, read as a stream. Rows leave in Arrow batches of bounded size.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "session_file string, file string, position bigint, line string, problem string"
DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
BATCH_ROWS, BATCH_BYTES, CHUNK = 4096, 8 << 20, 1 << 20
NOT_TEXT, BROKEN = "not utf-8", "file breaks off"


@dataclass
class Piece(InputPartition):
    """Bytes [start, end) of a file; a line belongs to the piece that its first byte lies in. A gzip file is one piece."""

    session: str
    file: str
    start: int
    end: int
    packed: bool


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def batch(piece: Piece, rows: list[tuple[int, str | None, str | None]]) -> pa.RecordBatch:
    n = len(rows)
    position, line, problem = zip(*rows)
    return pa.record_batch(
        [pa.array([piece.session] * n, pa.string()), pa.array([piece.file] * n, pa.string()), pa.array(position, pa.int64()), pa.array(line, pa.string()), pa.array(problem, pa.string())],
        names=["session_file", "file", "position", "line", "problem"],
    )


def plain_lines(raw: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes, bool]]:
    source, at = io.BufferedReader(raw, CHUNK), start
    if start:
        source.seek(start - 1)
        at += len(source.readline()) - 1
    while at < end and (data := source.readline()):
        yield at, data, False
        at += len(data)


def packed_lines(raw: pa.NativeFile) -> Iterator[tuple[int, bytes, bool]]:
    """Lines of a gzip file of one or more members; where it ends early or is damaged, what is left of the line, marked."""
    at, held = 0, []  # held: the parts of the line that isn't finished
    try:
        for data in unpacked(raw):
            *done, rest = data.split(b"\n")
            for part in done:
                line = b"".join([*held, part, b"\n"])
                yield at, line, False
                at += len(line)
                held = []
            held.append(rest)
        if any(held):
            yield at, b"".join(held), False
    except (EOFError, zlib.error):
        yield at, b"".join(held), True


def unpacked(raw: pa.NativeFile) -> Iterator[bytes]:
    member, data = zlib.decompressobj(wbits=31), b""
    fresh = True  # no byte of this member was seen
    while data or (data := raw.read(CHUNK)):
        if member.eof:
            data = data.lstrip(b"\0")  # padding between members
            member, fresh = zlib.decompressobj(wbits=31), True
            continue
        fresh = False
        out = member.decompress(data, CHUNK)
        data = member.unused_data if member.eof else member.unconsumed_tail
        if out:
            yield out
    while not member.eof and not fresh:
        out = member.decompress(b"", CHUNK)
        if not out:
            raise EOFError
        yield out


class SessionLinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.date = options.get("session", DATE)
        self.sessions = {s for s in options.get("sessions", "").split(",") if s}
        self.split = int(options.get("splitBytes", 128 << 20))

    def partitions(self) -> Sequence[Piece]:
        """Only names and sizes are listed here; files of other sessions are never opened."""
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        pieces = []
        for f in sorted((f for f in found if f.is_file), key=lambda f: f.path):
            inner = f.path[len(root):] if f.path != root else f.base_name
            if any(part[:1] in ("_", ".") for part in inner.split("/") if part):
                continue
            dates = re.findall(self.date, inner)
            session = dates[-1] if dates else ""
            if self.sessions and session not in self.sessions:
                continue
            packed = f.path.endswith(".gz")
            size = f.size or 0
            step = size if packed else self.split
            pieces += [Piece(session, f.path, at, size if packed else min(at + step, size), packed) for at in range(0, size, max(step, 1))]
        return pieces

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # no file: Spark asks once all the same
            return
        system, _ = file_system(self.path)
        rows, held = [], 0
        for row in self.lines(system, piece):
            rows.append(row)
            held += len(row[1] or "")
            if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                yield batch(piece, rows)
                rows, held = [], 0
        if rows:
            yield batch(piece, rows)

    def lines(self, system: pafs.FileSystem, piece: Piece) -> Iterator[tuple[int, str | None, str | None]]:
        """(position, line, problem); blank lines are left out. Positions count the unpacked bytes before the line."""
        with system.open_input_file(piece.file) as raw:
            source = packed_lines(raw) if piece.packed else plain_lines(raw, piece.start, piece.end)
            for at, data, broken in source:
                try:
                    line, problem = data.decode("utf-8"), None
                except UnicodeDecodeError:
                    line, problem = data.decode("utf-8", "replace"), NOT_TEXT
                if broken:
                    yield at, line.rstrip("\r\n") or None, BROKEN
                elif line.strip():
                    yield at, line.rstrip("\r\n"), problem


class SessionLines(DataSource):
    """Options: `path` (a file or a folder, searched below; hidden names are passed over), `sessions` (dates with commas
    between them), `session` (the pattern of the date in a name, the last match counts), `splitBytes`."""

    @classmethod
    def name(cls) -> str:
        return "session_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SessionLinesReader:
        return SessionLinesReader(dict(self.options))


def session_lines(spark: SparkSession, path: str, sessions: Sequence[str] | None = None, **options: str) -> DataFrame:
    """One row per non-blank line: session date of the file name, file, position, line, problem.

    `problem` is null for a good line, 'not utf-8' for one whose bytes aren't text (bad bytes replaced), 'file breaks off' for
    the row that marks where a gzip file ends early or is damaged (what is left of that line, else null). No sessions means all, an empty list none.
    """
    spark.dataSource.register(SessionLines)
    reader = spark.read.format("session_lines")
    for name, value in options.items():
        reader = reader.option(name, value)
    if sessions is not None:
        reader = reader.option("sessions", ",".join(sessions) or "none")
    return reader.load(path)
