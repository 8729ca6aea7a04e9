"""WARC archives: records are written by Spark's text writer, read by its delimiter reader, and joined to captures.

A capture is a transaction of three records: `request`, `response` (or `revisit`) and `metadata`. Request and metadata name
the response in WARC-Concurrent-To, and the reader joins them through it, one nested row per capture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written

VERSION = "WARC/1.0\r\n"  # fixed value of the format: first line of a record
END = "\r\n\r\n"  # fixed value of the format: ends a header and a record
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"  # fixed value of the format
MOST_BROADCAST = 100_000  # repeated payloads whose first capture (about 200 bytes each) is broadcast; beyond, a shuffle join
COLUMNS = ("page_id", "url", "payload", "copy")


def capture_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """(page_id, url, payload, copy, digest, record_id, refers_to, first_id) of each row of pages.

    Of rows with equal payloads of at least `least` bytes the one with the smallest (page_id, url), null ids last and null
    urls first, is the first capture; refers_to is its record id and first_id its page_id, both null on itself and on all
    that revisit nothing. A null html is the empty payload. Rows that repeat page_id, url and payload are told apart by
    `copy`, and its 0 counts as the first. Texts are taken whole. Payload bytes don't move unless rows repeat or more than
    MOST_BROADCAST payloads do.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        F.lit(0).cast("long").alias("copy"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    facts = rows.select("page_id", "url", digest.alias("digest"), F.octet_length("payload").alias("bytes"))
    groups = written(
        facts.groupBy("digest", "page_id", "url", "bytes").agg(F.count(F.lit(1)).alias("n")).groupBy("digest")
        .agg(F.sum("n").alias("n"), F.max("n").alias("same"), F.max("bytes").alias("bytes"),
             F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("first"))
        .filter("n > 1"), "payloads")
    repeated = groups.agg(F.max("same").alias("same"), F.count(F.lit(1)).alias("n")).first()
    if (repeated.same or 0) > 1:
        # rows alike in every column collapse before the shuffle and get a number each
        whole = rows.groupBy("page_id", "url", "payload").agg(F.count(F.lit(1)).alias("n"))
        rows = whole.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(*COLUMNS)
    firsts = groups.filter(F.col("bytes") >= least).select("digest", "first")
    firsts = F.broadcast(firsts) if repeated.n <= MOST_BROADCAST else firsts
    first = F.col("first")
    is_first = first["page_id"].eqNullSafe(F.col("page_id")) & first["url"].eqNullSafe(F.col("url")) & (F.col("copy") == 0)
    again = first.isNotNull() & ~is_first
    none = F.lit(None)
    return rows.withColumn("digest", digest).join(firsts, "digest", "left").select(
        *COLUMNS, "digest", record_id("response", F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy")).alias("record_id"),
        F.when(again, record_id("response", first["page_id"], first["url"], F.col("digest"), F.lit(0))).otherwise(none).alias("refers_to"),
        F.when(again, first["page_id"]).otherwise(none).alias("first_id"))


def record_id(kind: str, page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A name-based record id: the same row has the same id in every run."""
    name = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), page_id.alias("p"), url.alias("u"), digest.alias("d"), copy.alias("c"))).cast("binary"))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(name, a, n) for a, n in at]), F.lit(">"))


def record(kind: Column | str, ident: Column, date: str, more: list[tuple[str, Column]], block: Column) -> Column:
    """A record from its type to the end of its block, without version line and end mark. Headers with a null value are left
    out."""
    head = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(date)), *more,
            ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in head]), F.lit(END), block)


def archive_records(captures: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): for each row of capture_rows one text with its request, its response or revisit, and its metadata record.

    The metadata record holds page_id and url as JSON, so they come back exactly; in header lines control characters and
    blanks of the url are percent-encoded, and a null url is written as urn:page:<page_id>.
    """
    one = captures.withColumns({
        # one replacement for each octet that would break a header line
        "target": F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20\\x7f]", "%20"),
                             F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        "request_id": record_id("request", F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy")),
        "metadata_id": record_id("metadata", F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy")),
    })
    target, own, again = F.col("target"), F.col("record_id"), F.col("refers_to").isNotNull()
    path = F.regexp_extract(target, "^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "),
                     F.regexp_extract(target, "^[A-Za-z]+://([^/?#]*)", 1), F.lit(END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    about = F.to_json(F.struct("page_id", "url"))
    link = ("WARC-Concurrent-To", own)
    uri = ("WARC-Target-URI", target)
    answered = record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), own, date,
        [uri, ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Refers-To", F.col("refers_to")), ("WARC-Profile", F.when(again, F.lit(PROFILE)))],
        F.concat(answer, F.when(again, F.lit("")).otherwise(F.col("payload"))))
    parts = [
        record("request", F.col("request_id"), date, [uri, ("Content-Type", F.lit("application/http; msgtype=request")), link], asked),
        answered,
        record("metadata", F.col("metadata_id"), date, [uri, ("Content-Type", F.lit("application/json")), link], about),
    ]
    return one.select(F.concat_ws(END, *[F.concat(F.lit(VERSION), p) for p in parts]).alias("value"))


def write_archives(records: DataFrame, folder: str, compression: str = "none") -> str:
    """The records as WARC files below folder; returns folder. Spark's text writer commits files as a whole, so a lost
    executor leaves no part of one. compression: none, or gzip for one stream a file."""
    records.write.mode("overwrite").option("lineSep", END).option("compression", compression).text(folder)
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(head, block): header lines and block bytes of every record of the WARC files below folder, in tasks that split files.

    Files are cut at version lines. A block that holds such a line itself comes in several pieces, and its first piece is
    shorter than its Content-Length says; only files with such blocks are sorted and their pieces joined again, in one
    stream a file. Blocks are taken whole and byte by byte. Text that is no record raises an error. An empty folder gives an
    empty table.
    """
    lines = spark.read.option("lineSep", VERSION).text(folder)
    pieces = lines.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    odd = pieces.filter((F.col("value") != "") & ~whole_piece(F.col("value"))).select("path").distinct()
    odd = written(odd, "odd-files")
    plain = pieces.filter(F.col("value") != "")
    if odd.isEmpty():
        found = plain.select("value")
    else:
        found = plain.join(odd, "path", "left_anti").select("value").unionByName(
            pieces.join(odd, "path").repartition("path").sortWithinPartitions("path", "start", "at")
            .select("path", F.col("value").cast("binary").alias("value")).mapInPandas(joined_pieces, "value binary").select(F.col("value").cast("string").alias("value")))
    head = F.substring_index("value", END, 1)
    length = header("Content-Length", head).cast("int")
    return found.select(head.alias("head"), F.col("value").cast("binary").substr(F.octet_length(head) + 1 + len(END), length).alias("block"))


def whole_piece(value: Column) -> Column:
    """Whether a piece between two version lines is a whole record with its end mark."""
    head = F.substring_index(value, END, 1)
    length = header("Content-Length", head).try_cast("long")
    return F.coalesce(F.octet_length(value) == F.octet_length(head) + length + 2 * len(END), F.lit(False))


def joined_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a file, in its order, joined to whole records; one record and one batch are held at a time."""
    end, mark = END.encode(), VERSION.encode()
    path, held, due = None, bytearray(), 0
    for frame in frames:
        out = []
        for file, value in zip(frame["path"], frame["value"]):
            if file != path:
                if due:
                    raise ValueError(f"{path}: the last record is cut off")
                path, held, due = file, bytearray(), 0
            if due:
                held += mark + value
            elif not value:
                continue
            else:
                head = value.partition(end)[0]
                sizes = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
                if not sizes:
                    raise ValueError(f"{path}: no record where one should start")
                held, due = bytearray(value), len(head) + int(sizes[0]) + 2 * len(end)
            if len(held) > due:
                raise ValueError(f"{path}: a record is longer than its header says")
            if len(held) == due:
                out.append(bytes(held))
                held, due = bytearray(), 0
        yield pd.DataFrame({"value": out})
    if due:
        raise ValueError(f"{path}: the last record is cut off")


def header(name: str, head: Column) -> Column:
    """The value of a header line, in any letter case; null where there is none."""
    found = F.regexp_extract(head, f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, kind, target, refers_to, declared_digest, http_head, payload, payload_bytes,
    payload_digest, request, metadata).

    Request and metadata are joined through WARC-Concurrent-To; a capture without one has null there, a request or metadata
    record of no capture stands in no row, and of several for one capture that with the smallest record id counts. payload is null for
    a revisit; its bytes and digest are those of the response that it refers to, and null where the archives hold no such
    response.
    """
    head, block = F.col("head"), F.col("block")
    kinds = records.withColumns({"kind": header("WARC-Type", head), "record_id": header("WARC-Record-ID", head)})
    http = F.substring_index(block.cast("string"), END, 1)
    payload = F.when(F.col("kind") == "response", block.substr(F.octet_length(http) + 1 + len(END), F.octet_length(block)))
    answers = kinds.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", header("WARC-Target-URI", head).alias("target"), header("WARC-Refers-To", head).alias("refers_to"),
        F.regexp_replace(header("WARC-Payload-Digest", head), "^sha256:", "").alias("declared_digest"), http.alias("http_head"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    side = lambda kind: kinds.filter(F.col("kind") == kind).groupBy(header("WARC-Concurrent-To", head).alias("record_id")).agg(
        F.min(F.struct("record_id", header("WARC-Target-URI", head).alias("target"), block.cast("string").alias("block"))).alias(kind))
    # a response stands for itself, so that rows without a reference don't meet at one null key
    answers = answers.withColumn("full_id", F.when(F.col("kind") == "revisit", F.col("refers_to")).otherwise(F.col("record_id")))
    full = answers.filter("kind = 'response'").groupBy(F.col("record_id").alias("full_id")).agg(F.min(F.struct("bytes", "digest")).alias("full"))
    return answers.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left").join(full, "full_id", "left").select(
        "record_id", "kind", "target", "refers_to", "declared_digest", "http_head", "payload",
        F.col("full.bytes").alias("payload_bytes"), F.col("full.digest").alias("payload_digest"), "request", "metadata")


def page_captures(captures: DataFrame) -> DataFrame:
    """captures with page_id and url of the metadata record, and refers_to_page, the page_id of the response that a revisit
    refers to."""
    told = F.from_json("metadata.block", "page_id long, url string")
    again = F.col("kind") == "revisit"
    own = captures.withColumns({"page_id": told["page_id"], "url": told["url"], "full_id": F.when(again, F.col("refers_to")).otherwise(F.col("record_id"))})
    first = own.filter("kind = 'response'").groupBy("full_id").agg(F.min(F.struct("page_id")).alias("first"))
    return own.join(first, "full_id", "left").select(
        "page_id", "url", F.when(again, F.col("first.page_id")).alias("refers_to_page"), *captures.columns)
