"""Recorded sessions: JSON lines in and out, typed child tables, stage artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import RECORD, SNAPSHOT
from tidemark.sources.session_lines import session_lines

DEC = "decimal(18,6)"
REQUIRED = ("snapshot_id", "timestamp", "session_date", "underlying_symbol", "underlying_price", "session_status")


def read_recording(spark: SparkSession, path: str, sessions: Sequence[str] | None = None) -> DataFrame:
    """Every non-blank line of the session files below `path`, plain or gzip: session file, parsed fields, `parsed`, the
    snapshot's exact text, the line, its place in the file and what is wrong with it.

    The snapshot stays text so its hash can be recomputed; `parse_snapshot` types it. A line that isn't a record, or the place
    where a gzip file breaks off, is a row with `parsed` false.
    """
    lines = session_lines(spark, path, sessions)
    rec = F.from_json("line", RECORD, {"mode": "PERMISSIVE"})
    good = F.col("problem").isNull() & F.col("r.seq").isNotNull() & F.col("r.snapshot").isNotNull()
    return lines.select("*", rec.alias("r")).select(
        "session_file", "r.*", F.coalesce(good, F.lit(False)).alias("parsed"), F.col("r.snapshot").alias("payload"), "line", "file", "position", "problem"
    )


def parse_snapshot(records: DataFrame, raw: str = "snapshot") -> tuple[DataFrame, DataFrame]:
    """(typed snapshots, rejected records with the missing required fields). Optional fields become NULL, never a default."""
    # inside a generator the text is parsed once a row; as a plain column it would be parsed again for every field used
    parsed = records.select("*", F.inline(F.array(F.struct(F.from_json(F.col(raw), SNAPSHOT).alias("s")))))
    bad = [F.when(F.col(f"s.{n}").isNull(), F.lit(n)) for n in REQUIRED]
    price = F.try_to_number(F.col("s.underlying_price"), F.lit("999999999999.999999")).cast(DEC)
    ts = F.try_to_timestamp(F.col("s.timestamp"))
    bad += [
        F.when(F.col("s.underlying_price").isNotNull() & price.isNull(), F.lit("underlying_price")),
        F.when(F.col("s.timestamp").isNotNull() & ts.isNull(), F.lit("timestamp")),
    ]
    typed = F.struct(F.array_compact(F.array(*bad)).alias("missing"), price.alias("_price"), ts.alias("_ts"))
    marked = parsed.select("*", F.inline(F.array(typed)))  # likewise once a row, not again for the filter
    good = marked.filter(F.size("missing") == 0).select(
        F.col("s.snapshot_id").alias("snapshot_id"), F.col("_ts").alias("ts"), F.to_date("s.session_date").alias("session_date"),
        F.col("s.underlying_symbol").alias("symbol"), F.col("_price").alias("spot"), *[F.col(f"s.{n}") for n in SNAPSHOT.fieldNames() if n not in ("snapshot_id", "timestamp", "session_date", "underlying_symbol", "underlying_price")],
    )
    return good, marked.filter(F.size("missing") > 0).select(*[c for c in records.columns], "missing")


def explode_bars(snapshots: DataFrame) -> DataFrame:
    b = F.col("b")
    return snapshots.select("snapshot_id", "symbol", "session_date", F.posexplode_outer("bars_1m").alias("pos", "b")).filter(b.isNotNull()).select(
        "snapshot_id", "symbol", "session_date", "pos", F.try_to_timestamp(b["timestamp"]).alias("ts"),
        *[b[n].cast("double").alias(n) for n in ("open", "high", "low", "close")], b["volume"].alias("volume"),
    )


def explode_chain(snapshots: DataFrame) -> DataFrame:
    """One row per quote; `pos` keeps the chain order that some ties break on."""
    q, c = F.col("q"), F.col("q.contract")
    return snapshots.select("snapshot_id", "spot", F.posexplode_outer("option_chain").alias("pos", "q")).filter(q.isNotNull()).select(
        "snapshot_id", "pos", c["contract_id"].alias("contract_id"), F.to_date(c["expiration"]).alias("expiration"), F.lower(c["option_type"]).alias("side"),
        c["strike"].cast("double").alias("strike"), F.col("spot").cast("double").alias("spot"), *[q[n].cast("double").alias(n) for n in ("bid", "ask", "last", "mark")],
        q["volume"].alias("volume"), q["open_interest"].alias("open_interest"), q["implied_volatility"].alias("iv"), q["delta"].alias("delta"), q["gamma"].alias("gamma"),
        q["age_seconds"].alias("age_seconds"), q["quality_flags"].alias("quality_flags"),
    )


def explode_feed(snapshots: DataFrame) -> DataFrame:
    f = F.col("f")
    return snapshots.select("snapshot_id", F.posexplode_outer("feed_observations").alias("seq", "f")).filter(f.isNotNull()).select(
        "snapshot_id", "seq", *[f[n].alias(n) for n in ("component", "provider", "status", "freshness_limit_seconds", "age_seconds", "attempt_order", "fallback_used")]
    )


def to_records(snapshots: DataFrame, payload: Column, session: str = "session_date", version: str = "1") -> DataFrame:
    """Recording lines with gap-free seq per session and a hash of the payload text; rows of a session are numbered in
    hourly chunks, so a session is not one task."""
    from tidemark.operators.windows import number_rows

    rows = snapshots.select("snapshot_id", session, "ts", payload.alias("snapshot"), F.date_trunc("hour", "ts").alias("_slot"))
    numbered = number_rows(rows, [session], "_slot", ["ts", "snapshot_id"], "seq")
    return numbered.select(
        session, "seq", "snapshot_id", F.lit(version).alias("schema_version"), F.concat(F.lit("sha256:"), F.sha2("snapshot", 256)).alias("record_hash"), "snapshot"
    )


def write_recording(records: DataFrame, path: str, session: str = "session_date", fmt: str = "json") -> None:
    """One folder per session; only the sessions present in `records` are replaced. A large session is cut in several files."""
    records.hint("rebalance", session).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).format(fmt).save(path)


def append_artifacts(rows: DataFrame, root: str, stage: str, session: str = "session_date") -> None:
    rows.write.mode("append").partitionBy(session).parquet(f"{root}/{stage}")


def read_artifacts(spark: SparkSession, root: str, stage: str, sessions: Sequence[str] | None = None, session: str = "session_date") -> DataFrame:
    df = spark.read.parquet(f"{root}/{stage}")
    return df.filter(F.col(session).cast("string").isin(*sessions)) if sessions else df


def pending(snapshots: DataFrame, done: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Snapshots no stage has processed yet."""
    return snapshots.join(done.select(key), key, "left_anti")


def snapshot_identity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """content_hash of the identity columns and snapshot_id from it; NULLs take part, so unknown differs from absent text."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return df.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2(text, 256))).withColumn(
        "snapshot_id", F.concat(F.lit("snap-"), F.substring(F.sha2("content_hash", 256), 1, 12))
    )
