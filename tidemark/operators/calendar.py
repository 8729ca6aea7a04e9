"""Session calendar as data: one row per exchange session, joined to observations.

A calendar is bounded (about 250 rows a year), so the broadcast below never grows with the observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import codes
from tidemark.operators.bars import ET, local_clock

ENTRY_LOCKOUT_MINUTES = 15
REGULAR_CLOSE_HOUR = 16


def with_session(obs: DataFrame, sessions: DataFrame, tz: str | None = ET) -> DataFrame:
    """Attach session_open/session_close (NULL on a holiday) by the local date of `ts`."""
    dim = sessions.select("session_date", "session_open", "session_close")
    return obs.withColumn("session_date", F.to_date(local_clock(F.col("ts"), tz))).join(
        F.broadcast(dim), "session_date", "left"
    )


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


def session_status(obs: DataFrame, sessions: DataFrame, tz: str | None = ET) -> DataFrame:
    """HOLIDAY / PRE_OPEN / OPEN / CLOSED, whole minutes from open and to close, half day, lockout, settlement."""
    o, cl, ts = F.col("session_open"), F.col("session_close"), F.col("ts")
    close_clock = local_clock(cl, tz)
    to_close = F.when(ts <= cl, F.floor(_seconds(cl, ts) / 60).cast("int"))
    return with_session(obs, sessions, tz).select(
        *obs.columns,
        *([] if "session_date" in obs.columns else ["session_date"]),
        o,
        cl,
        F.when(o.isNull(), "HOLIDAY").when(ts < o, "PRE_OPEN").when(ts >= cl, "CLOSED").otherwise("OPEN").alias(
            "session_status"
        ),
        F.when(ts >= o, F.floor(_seconds(ts, o) / 60).cast("int")).alias("minutes_from_open"),
        to_close.alias("minutes_to_close"),
        F.coalesce(F.hour(close_clock) < REGULAR_CLOSE_HOUR, F.lit(False)).alias("is_half_day"),
        F.coalesce(to_close <= ENTRY_LOCKOUT_MINUTES, F.lit(True)).alias("in_entry_lockout"),
        F.coalesce(ts >= cl, F.lit(False)).alias("settlement_available"),
    )


def session_metadata(obs: DataFrame, sessions: DataFrame, tz: str | None = ET) -> DataFrame:
    """Training metadata: is_session, open/close, early close, minutes since open / to close, weekday (Mon=0)."""
    s = session_status(obs, sessions, tz)
    known = F.col("session_open").isNotNull()
    return s.select(
        *obs.columns,
        *([] if "session_date" in obs.columns else ["session_date"]),
        known.alias("is_session"),
        "session_open",
        "session_close",
        F.when(known, F.col("is_half_day")).alias("is_early_close"),
        F.col("minutes_from_open").cast("double").alias("minutes_since_open"),
        F.col("minutes_to_close").cast("double").alias("minutes_to_close"),
        F.weekday("session_date").alias("day_of_week"),
    )


def lockout_state(
    obs: DataFrame,
    tz: str | None = ET,
    morning_entry: str = "10:00",
    late_lockout: str = "15:30",
    require_market_open: bool = True,
) -> DataFrame:
    """Warm-up / cutoff flags and the reasons array, from ts, market_open, catalyst_active, emergency_lockout."""
    clock = F.date_format(local_clock(F.col("ts"), tz), "HH:mm")
    warmup, cutoff = clock < morning_entry, clock >= late_lockout
    closed = ~F.col("market_open") if require_market_open else F.lit(False)
    return obs.select(
        "*",
        warmup.alias("session_warmup"),
        cutoff.alias("entry_cutoff"),
        (cutoff | F.col("emergency_lockout")).alias("entry_locked"),
        codes(
            (warmup, "session_warmup"),
            (cutoff, "entry_cutoff"),
            (F.col("catalyst_active"), "catalyst_lockout"),
            (F.col("emergency_lockout"), "emergency_lockout"),
            (closed, "market_closed"),
        ).alias("reasons"),
    )
