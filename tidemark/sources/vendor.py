"""Foreign inputs: vendor tick archives, the legacy snapshot format, experience files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import finite
from tidemark.functions.tables import materialized
from tidemark.schemas import EXPERIENCE, LEGACY, VENDOR_LINE
from tidemark.sources.session_lines import session_lines

IMPORTED = "imported"
# fixed values: component aliases of the legacy format
COMPONENT_ALIASES = {"spot": "spot", "bars": "bars", "chain": "option_chain", "option_chain": "option_chain", "settlement": "settlement"}
STATUSES = ("LIVE", "DELAYED", "STALE", "MISSING", "INVALID", "FALLBACK")


def parse_vendor_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed vendor lines. The vendor writes NaN for unknown, which is not JSON: it becomes null before parsing."""
    clean = F.regexp_replace(F.col(column), r"(?<=[:\[,])\s*-?(NaN|Infinity)(?=\s*[,\]}])", "null")
    # inside a generator a line is parsed once; as a plain column it would be parsed again for every field and filter that uses it
    parsed = lines.select(*[c for c in lines.columns if c != column], F.inline(F.array(F.struct(F.from_json(clean, VENDOR_LINE).alias("v")))))
    return parsed.select(*[c for c in lines.columns if c != column], "v.*", F.col("v.t").isNull().alias("malformed"))


def read_vendor_ticks(spark: SparkSession, path: str, sessions: Sequence[str] | None = None) -> DataFrame:
    """Typed lines of vendor archives (JSON lines, gzip or plain, one or more files per session) in file order.

    `malformed` marks lines that aren't JSON objects of a known kind and the place where a gzip file breaks off; the rest of
    such a file is kept. `pos` orders the lines of a file.
    """
    lines = session_lines(spark, path, sessions).withColumnsRenamed({"session_file": "file_session", "position": "pos", "line": "value"})
    return parse_vendor_lines(lines).withColumn("malformed", F.col("malformed") | F.col("problem").isNotNull())


def _number(m: Column) -> Column:
    return finite(F.try_to_number(m, F.lit("S999999999999.999999999")).cast("double"))


def vendor_snapshots(lines: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """Ticks with a usable spot: session, spot, term structure, breadth, catalyst. Others are not snapshots."""
    ticks = lines.filter("t = 'tick'").withColumn("event_ts", F.try_to_timestamp("ts"))
    m = lambda k: finite(F.col("market")[k].cast("double"))
    spot = m("spot")
    return ticks.filter(F.col("event_ts").isNotNull() & (spot > 0)).select(
        F.col("event_ts").alias("ts"), F.to_date(F.from_utc_timestamp("event_ts", tz)).alias("session_date"), spot.alias("spot"),
        *[F.when(m("vix") > 0, m(k)).alias(k) for k in ("vix", "vix9d", "vix3m", "vvix", "vvix_baseline")], *[m(k).alias(k) for k in ("rsp_spy_div", "sector_align", "top10_pressure")],
        F.coalesce(F.lower(F.col("market")["has_catalyst"]) == "true", F.lit(False)).alias("catalyst_active"), "option_rows", "bars", F.array(F.lit(IMPORTED)).alias("flags"),
    )


def vendor_chain(snapshots: DataFrame, keys: Sequence[str] = ("ts",), *, symbol: str) -> DataFrame:
    """Usable option rows only: side, strike > 0, finite greeks, open interest ≥ 0, 0 < bid ≤ ask; nothing is defaulted."""
    o, side = F.col("o"), F.lower(F.col("o.side"))
    num = lambda n: finite(o[n])
    rows = snapshots.select(*keys, "session_date", "spot", F.posexplode("option_rows").alias("pos", "o"))
    ok = (
        side.isin("call", "put") & (num("strike") > 0) & num("gamma").isNotNull() & num("delta").isNotNull() & (num("oi") >= 0) & (num("bid") > 0) & (num("ask") >= num("bid"))
    )
    dte = F.coalesce(num("dte_days"), F.lit(0.0))
    expiry = F.when(dte >= 1, F.date_add("session_date", F.floor(dte).cast("int"))).otherwise(F.col("session_date"))
    right = F.when(side == "call", "C").otherwise("P")
    return rows.filter(ok).select(
        *keys, "pos", "spot", side.alias("side"), num("strike").alias("strike"), expiry.alias("expiration"),
        F.concat(F.lit(symbol), F.date_format(expiry, "yyMMdd"), right, F.lpad(F.round(num("strike") * 1000).cast("bigint").cast("string"), 8, "0")).alias("contract_id"),
        num("bid").alias("bid"), num("ask").alias("ask"), ((num("bid") + num("ask")) / 2).alias("mark"), F.when(num("volume") >= 0, F.floor(num("volume"))).alias("volume"),
        F.floor(num("oi")).alias("open_interest"), num("delta").alias("delta"), num("gamma").alias("gamma"),
    )


def vendor_bars(snapshots: DataFrame, *, symbol: str) -> DataFrame:
    """Bar rows [iso, o, h, l, c, v]; nine-digit fractions are cut to six; unusable rows dropped. `arrival` is the tick."""
    r = F.col("r")
    iso = F.regexp_replace(r[0], r"(\.\d{6})\d+", "$1")
    num = lambda i: finite(r[i].cast("double"))
    rows = snapshots.select(F.col("ts").alias("arrival"), F.explode("bars").alias("r")).filter(F.size("r") >= 6)
    typed = F.struct(F.try_to_timestamp(iso).alias("ts"), num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"), num(5).alias("volume"))
    bars = rows.select(F.lit(symbol).alias("symbol"), F.inline(F.array(typed)), "arrival")  # typed once a row, not again for the filter
    return bars.filter(F.col("ts").isNotNull() & (F.least("open", "high", "low", "close") > 0) & F.col("close").isNotNull() & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & (F.col("volume") >= 0))


def extract_settlements(lines: DataFrame, order: str = "pos") -> DataFrame:
    """Last finite settle price per date in file order."""
    price = finite("price")
    return lines.filter((F.col("t") == "settle") & price.isNotNull() & F.col("date").isNotNull()).groupBy("date").agg(F.max_by("price", order).alias("settlement_price"))


def import_sessions(source: DataFrame, existing: DataFrame | None, sessions: Sequence[str] | None = None, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to write, sessions skipped with a reason) for snapshots of several sessions.

    A session already present is skipped; with overwrite it is replaced only when every existing row carries the
    importer's flag, so live recordings are never lost.
    """
    rows = source.filter(F.col("session_date").cast("string").isin(*sessions)) if sessions else source
    if existing is None:
        empty = rows.select("session_date").filter(F.lit(False)).withColumn("reason", F.lit(""))
        return rows, empty
    have = existing.groupBy("session_date").agg(F.bool_or(~F.coalesce(F.array_contains("flags", IMPORTED), F.lit(False))).alias("live"))
    wanted = rows.select("session_date").distinct().join(have, "session_date")
    blocked = wanted.filter("live") if overwrite else wanted
    reason = F.when(F.col("live") & F.lit(overwrite), "holds live records; not overwritten").otherwise("already imported")
    skipped = blocked.select("session_date", reason.alias("reason"))
    return rows.join(F.broadcast(skipped.select("session_date")), "session_date", "left_anti"), skipped


def existing_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def import_archive(
    spark: SparkSession, source: str, target: str, sessions: Sequence[str] | None = None, overwrite: bool = False, tz: str = "America/New_York"
) -> DataFrame:
    """Write the snapshots of vendor archives below `target`, one folder per session; returns the sessions skipped and why.

    Snapshots are typed once into a table of their own. What may be written is decided first and kept in another, so a task that
    is run again decides the same though folders have appeared meanwhile. Only folders of sessions that are written are replaced (dynamic overwrite), so
    a second run changes nothing and a run that died is simply repeated with `overwrite`. Sessions named in `sessions` are
    dates of the snapshots. Two imports into one target at a time are not guarded.
    """
    rows = materialized(vendor_snapshots(read_vendor_ticks(spark, source), tz), "import-rows")  # the archive is parsed once
    _, skipped = import_sessions(rows, existing_table(spark, target), sessions, overwrite)
    decided = materialized(skipped, "import-skipped")
    named = rows.filter(F.col("session_date").cast("string").isin(*sessions)) if sessions else rows
    named.join(decided.select("session_date"), "session_date", "left_anti").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("session_date").parquet(target)
    return decided


def adapt_legacy(df: DataFrame, raw: str = "value") -> tuple[DataFrame, DataFrame]:
    """(snapshots, feed observations) of legacy JSON; rows lacking symbol, ts or spot are left out of both."""
    v = df.withColumn("v", F.from_json(F.col(raw), LEGACY)).select("v.*")
    spot = F.coalesce(F.col("market")["spot"], F.col("spot"))
    ok = v.filter(F.col("symbol").isNotNull() & F.try_to_timestamp("ts").isNotNull() & spot.isNotNull())
    snaps = ok.select(
        "snapshot_id", "symbol", F.try_to_timestamp("ts").alias("ts"), spot.cast("decimal(18,6)").alias("spot"), F.col("market")["bid"].cast("decimal(18,6)").alias("bid"), F.col("market")["ask"].cast("decimal(18,6)").alias("ask")
    )
    alias = F.create_map(*[F.lit(x) for kv in COMPONENT_ALIASES.items() for x in kv])
    keys = F.array_distinct(F.concat(F.coalesce(F.map_keys("feed_statuses"), F.array().cast("array<string>")), F.coalesce(F.map_keys("source_ages_seconds"), F.array().cast("array<string>"))))
    feed = ok.select("snapshot_id", F.explode(keys).alias("k"), "feed_statuses", "source_ages_seconds")
    status = F.upper(F.trim(F.try_element_at("feed_statuses", "k")))
    out = feed.select(
        "snapshot_id", F.try_element_at(alias, F.lower("k")).alias("component"), F.try_element_at("source_ages_seconds", "k").alias("age_seconds"),
        F.when(status.isNull(), "MISSING").when(status.isin(*STATUSES), status).otherwise("INVALID").alias("status"),
    )
    return snaps, out.filter(F.col("component").isNotNull())


def load_experience(spark: SparkSession, path: str, sessions: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(EXPERIENCE).json(path)
    return df.filter(F.col("session_date").isin(*sessions)) if sessions else df
