"""OHLCV bars: tick aggregation, session-anchored resampling, vendor-bar normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import finite

ET = "America/New_York"
OPEN_MINUTE = 9 * 60 + 30
DAILY = 1440

# fixed values: timeframe names
TIMEFRAME_NAMES = {1: "1m", 5: "5m", 15: "15m", 30: "30m", 60: "1h", 240: "4h", 1440: "1d"}
DEFAULT_TIMEFRAMES = (1, 5, 15, 30, 60, 240, 1440)


def timeframe_label(minutes: str | Column) -> Column:
    """1m … 1d; other widths as whole hours when they divide, else minutes."""
    m = F.col(minutes) if isinstance(minutes, str) else minutes
    out = F.when(m % 60 == 0, F.concat((m / 60).cast("int").cast("string"), F.lit("h"))).otherwise(
        F.concat(m.cast("int").cast("string"), F.lit("m"))
    )
    for minutes_, label in TIMEFRAME_NAMES.items():
        out = F.when(m == minutes_, F.lit(label)).otherwise(out)
    return out


def local_clock(ts: Column, tz: str | None) -> Column:
    """Wall clock of an instant in `tz`; None means the column already is a wall clock."""
    return F.from_utc_timestamp(ts, tz) if tz else ts


def bucket_columns(ts: Column, minutes: int, tz: str | None) -> dict[str, Column]:
    """session_date, bucket index and bucket start for bars anchored at the 09:30 open.

    The index is a floor, so pre-market minutes get negative buckets; a daily bar is the local date, which no
    clock change can split.
    """
    local = local_clock(ts, tz)
    day = F.to_date(local)
    if minutes >= DAILY:
        index = F.lit(0)
        start = day.cast("timestamp")
    else:
        minute = F.hour(local) * 60 + F.minute(local)
        index = F.floor((minute - OPEN_MINUTE) / minutes).cast("int")
        start = F.timestamp_seconds(
            F.unix_timestamp(day.cast("timestamp")) + (index * minutes + OPEN_MINUTE) * 60
        )
    if tz:
        start = F.to_utc_timestamp(start, tz)
    return {"session_date": day, "bucket": index, "bar_ts": start}


def bars_from_ticks(
    ticks: DataFrame, minutes: int, keys: Sequence[str] = ("symbol",), tie: str = "seq", tz: str | None = ET
) -> DataFrame:
    """Ticks (keys, ts, price, size, tie) to OHLCV bars. Map-side partial aggregation, one shuffle on the bucket."""
    b = bucket_columns(F.col("ts"), minutes, tz)
    first = F.struct("ts", tie)
    return (
        ticks.select(*keys, "ts", "price", "size", tie, *[v.alias(k) for k, v in b.items()])
        .groupBy(*keys, "session_date", "bucket")
        .agg(
            F.min("bar_ts").alias("bar_ts"),
            F.min_by("price", first).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", first).alias("close"),
            F.sum("size").alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def resample_ohlcv(
    bars: DataFrame, minutes: int, keys: Sequence[str] = ("symbol",), tz: str | None = ET
) -> DataFrame:
    """Fold bars into wider ones: first open, max high, min low, last close, summed volume; gaps stay absent."""
    cols = [*keys, "session_date", "ts", "open", "high", "low", "close", "volume"]
    if minutes <= 1:
        day = F.to_date(local_clock(F.col("ts"), tz))
        return bars.withColumn("session_date", day).select(*cols)
    b = bucket_columns(F.col("ts"), minutes, tz)
    return (
        bars.select(*keys, "ts", "open", "high", "low", "close", "volume", *[v.alias(k) for k, v in b.items()])
        .groupBy(*keys, "session_date", "bucket")
        .agg(
            F.min("bar_ts").alias("bar_ts"),
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
        .select(*cols)
    )


def resample_many(
    bars: DataFrame,
    timeframes: Sequence[int] = DEFAULT_TIMEFRAMES,
    keys: Sequence[str] = ("symbol",),
    tz: str | None = ET,
) -> DataFrame:
    """All timeframes in one pass: each bar is tagged with every timeframe and aggregated once (one shuffle)."""
    tagged = F.array(
        *[
            F.struct(F.lit(m).alias("timeframe"), *[v.alias(k) for k, v in bucket_columns(F.col("ts"), m, tz).items()])
            if m > 1
            else F.struct(
                F.lit(1).alias("timeframe"),
                F.to_date(local_clock(F.col("ts"), tz)).alias("session_date"),
                F.floor(F.unix_timestamp("ts") / 60).cast("int").alias("bucket"),
                F.col("ts").alias("bar_ts"),
            )
            for m in timeframes
        ]
    )
    return (
        bars.select(*keys, "ts", "open", "high", "low", "close", "volume", F.inline(tagged))
        .groupBy(*keys, "timeframe", "session_date", "bucket")
        .agg(
            F.min("bar_ts").alias("bar_ts"),
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .drop("bucket")
        .withColumnRenamed("bar_ts", "ts")
    )


def normalize_vendor_bars(raw: DataFrame, keys: Sequence[str] = ("symbol",), max_bars: int | None = None) -> DataFrame:
    """Drop unusable bars, keep the last arrival per timestamp; keep the newest `max_bars` per key if given.

    Prices must be finite and positive; a missing volume is 0, a negative one rejects the bar. `arrival` orders
    duplicates. The newest-N cut is a row_number top-k, which Spark limits per task before the shuffle.
    """
    prices = [finite(p) for p in ("open", "high", "low", "close")]
    volume = F.coalesce(F.when(~F.isnan(F.col("volume").cast("double")), F.col("volume")), F.lit(0))
    usable = volume >= 0
    for p in prices:
        usable = usable & F.coalesce(p > 0, F.lit(False))
    latest = (
        raw.withColumn("volume", volume)
        .filter(usable)
        .groupBy(*keys, "ts")
        .agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "arrival").alias("b"))
        .select(*keys, "ts", "b.*")
    )
    if max_bars is None:
        return latest
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return latest.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= max_bars).drop("_rn")


def merge_tick_bars(tick_bars: DataFrame, keys: Sequence[str] = ("symbol",), keep: int | None = None) -> DataFrame:
    """Union of bars repeated across ticks: first arrival per timestamp wins; the newest `keep` stay if given."""
    first = (
        tick_bars.groupBy(*keys, "ts")
        .agg(F.min_by(F.struct("open", "high", "low", "close", "volume"), "arrival").alias("b"))
        .select(*keys, "ts", "b.*")
    )
    if keep is None:
        return first
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return first.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).drop("_rn")


def daily_settlement(daily_bars: DataFrame, keys: Sequence[str] = ("symbol",), tz: str | None = ET) -> DataFrame:
    """Official close per (symbol, local date) of a daily-bar table; a non-positive close is no settlement."""
    return (
        daily_bars.withColumn("session_date", F.to_date(local_clock(F.col("ts"), tz)))
        .filter(finite("close") > 0)
        .groupBy(*keys, "session_date")
        .agg(F.min_by("close", "ts").alias("settlement_price"))
    )


def fullest_bar_path(snapshots: DataFrame, keys: Sequence[str] = ("session_date",)) -> DataFrame:
    """Bars array of the session's last snapshot that carries any."""
    return (
        snapshots.filter(F.size("bars") > 0)
        .groupBy(*keys)
        .agg(F.max_by("bars", F.struct("ts", "snapshot_id")).alias("bars"), F.max("ts").alias("as_of"))
    )


def session_open_price(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Open of the first bar at or after the session open; the earliest bar when none is."""
    after = F.col("ts") >= F.col("session_open")
    return bars.groupBy(*keys, "session_date").agg(
        F.coalesce(
            F.min_by(F.when(after, F.col("open")), F.when(after, F.col("ts"))), F.min_by("open", "ts")
        ).alias("open_price")
    )


def session_settlement_price(
    bars: DataFrame, keys: Sequence[str] = ("symbol",), tz: str | None = ET, cutoff: int = 15 * 60 + 55
) -> DataFrame:
    """Last close of the session, only when the tape reached 15:55 local; else NULL."""
    local = local_clock(F.col("ts"), tz)
    minute = F.hour(local) * 60 + F.minute(local)
    return (
        bars.groupBy(*keys, "session_date")
        .agg(F.max_by("close", "ts").alias("last_close"), F.max_by(minute, F.col("ts")).alias("last_minute"))
        .select(
            *keys, "session_date", F.when(F.col("last_minute") >= cutoff, F.col("last_close")).alias("settlement_price")
        )
    )
