"""Structured Streaming versions of the tick path. Each has a batch twin it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.exprs import epoch
from tidemark.functions.order import sliding_median_score, sliding_rank
from tidemark.operators.bars import OPEN_MINUTE
from tidemark.operators.quality import classify_feed


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def append_ticks(ticks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append ticks by session; the file sink's log makes the append exactly-once. Sequence numbers are assigned when
    a session is read back (`renumber`)."""
    return (
        ticks.writeStream.format("parquet").partitionBy("session_date").option("checkpointLocation", checkpoint).option("path", path)
        .outputMode("append").trigger(availableNow=True).start()
    )


def streaming_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Event-time OHLCV bars on the 09:30 grid. Tumbling windows start 570 minutes after midnight, so every width
    aligns with the batch buckets; `seq` breaks ties of equal timestamps."""
    offset = f"{OPEN_MINUTE % minutes} minutes"
    first = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy(*keys, F.window("ts", f"{minutes} minutes", f"{minutes} minutes", offset).alias("w"))
        .agg(
            F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"), F.sum("size").alias("volume"),
        )
        .select(*keys, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def once_per_snapshot(snapshots: DataFrame, late: str = "1 day", key: str = "snapshot_id") -> DataFrame:
    """At most one row per snapshot id within the watermark (re-delivered files)."""
    return snapshots.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def duplicate_guard(decisions: DataFrame, ttl: str = "15 minutes") -> DataFrame:
    """Decisions with repeats of the same account|candidate|geometry removed within the time to live."""
    signed = decisions.withColumn("signature", F.concat_ws("|", "account_id", "candidate_id", "geometry_hash"))
    return signed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["signature"])


def split_late(feed: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable, late) observations: STALE, INVALID and MISSING go to the side output. `now` fixes the clock for replays."""
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    age = F.coalesce(F.col("age_seconds"), epoch(clock) - epoch(F.col("observed_at")))
    tagged = feed.withColumn("status", classify_feed(age, F.col("freshness_limit_seconds"), fallback=F.col("fallback_used")))
    late = F.col("status").isin("STALE", "INVALID", "MISSING")
    return tagged.filter(~late), tagged.filter(late)


def join_spot_chain(spot: DataFrame, chain: DataFrame, limit: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Spot and chain ticks of one symbol within the limit of each other (stream-stream join, state bounded both ways).

    Time is cut in stretches of twice the limit. A chain tick lies in one, a spot tick goes to the one or two that its limits
    reach, so a tick meets only what is near it, not the whole state of its symbol, and a pair is found once.
    """
    def stretch(at: str) -> Column:
        return F.expr(f"CAST(floor(unix_micros({at}) / (2 * unix_micros(TIMESTAMP_MICROS(0) + INTERVAL {limit}))) AS BIGINT)")

    reach = F.sequence(stretch(f"spot_ts - INTERVAL {limit}"), stretch(f"spot_ts + INTERVAL {limit}"))
    s = spot.withWatermark("spot_ts", late).withColumn("_stretch", F.explode(reach)).alias("s")
    c = chain.withWatermark("chain_ts", late).withColumn("_stretch", stretch("chain_ts")).alias("c")
    cond = F.expr(
        f"s.symbol = c.symbol AND s._stretch = c._stretch AND c.chain_ts >= s.spot_ts - INTERVAL {limit} AND c.chain_ts <= s.spot_ts + INTERVAL {limit}"
    )
    return s.join(c, cond, "inner").select("s.symbol", "spot_ts", "chain_ts", "spot", "chain")


def per_batch(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch stage on each micro-batch and write its result below `path`, in a folder of the batch's own. A retried
    batch writes the same folder again, so every row counts once. A key whose rows lie in several batches has a partial
    result in each: `merged` puts them together."""

    def write(batch: DataFrame, epoch: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{path}/micro_batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, keys: Sequence[str], parts: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Results of `per_batch` over all micro-batches: one row per key, each column by its own aggregate of the partial ones
    (a sum for counts and sums, min and max for themselves)."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[how(c).alias(c) for c, how in parts.items()])


def settle_closed_sessions(snapshots: DataFrame, value: str = "value", late: str = "1 hour", closed: str = "settlement_available", ts: str = "ts") -> DataFrame:
    """(session_date, settlement): the last value among a day's closed rows. A session settles once, when the watermark has
    passed the end of its day: the state is one value a day, whatever the number of micro-batches, and append mode emits it
    a single time. Days without a closed row give none; all rows move the watermark on."""
    day = F.window(ts, "1 day").alias("_day")
    last = F.max_by(value, F.when(F.col(closed), F.col(ts))).alias("settlement")
    days = snapshots.withWatermark(ts, late).groupBy(day).agg(last, F.count_if(F.col(closed)).alias("_closed"))
    return days.filter("_closed > 0").select(F.to_date("_day.start").alias("session_date"), "settlement")


# -- keyed state: rolling rank and robust score ----------------------------------------------------------------------
PIECE = 50_000  # rows of a result frame


class KeyedWindow(StatefulProcessor):
    """A key's trailing rows (time, value) as list state. Every micro-batch scores its new rows against the held ones, keeps
    those that a later row can still need, and sets a timer: a key that is idle for `age` after its last row, in event time,
    gives up its state."""

    def __init__(self, key: str, value: str, age: float):
        self.key, self.value, self.age = key, value, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t double, v double")

    def scored(self, times: np.ndarray, values: np.ndarray, first: int) -> tuple[dict[str, np.ndarray], int]:
        """Result columns of the rows from `first` on, and the first row to hold."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = np.array([tuple(r) for r in self.held.get()], dtype=float).reshape(-1, 2) if self.held.exists() else np.zeros((0, 2))
        # of a frame only its times and values stay, two numbers a row
        stamps, numbers = map(np.concatenate, zip(*[(f["ts"].to_numpy(copy=True), f[self.value].to_numpy(dtype=float, copy=True)) for f in rows]))
        sorted_ = np.argsort(stamps, kind="stable")
        stamps, numbers = stamps[sorted_], numbers[sorted_]
        seconds = stamps.astype("datetime64[us]").astype("int64") / 1e6
        times, values = np.concatenate((past[:, 0], seconds)), np.concatenate((past[:, 1], numbers))
        # a late row takes its place in time among the held ones
        order = np.argsort(times, kind="stable")
        is_new = np.arange(len(times))[order] >= len(past)
        first = int(np.argmax(is_new))
        columns, keep = self.scored(times[order], values[order], first)
        new = is_new[first:]
        columns = {n: c[new] for n, c in columns.items()}
        for at in range(0, len(stamps), PIECE):  # no frame of a whole key
            yield pd.DataFrame({self.key: key[0], "ts": stamps[at:at + PIECE], **{n: c[at:at + PIECE] for n, c in columns.items()}})
        self.held.put([(float(t), float(v)) for t, v in zip(times[order][keep:], values[order][keep:])])
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int((times.max() + self.age) * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class RollingRank(KeyedWindow):
    def __init__(self, key: str, age: float, max_entries: int | None, min_samples: int):
        super().__init__(key, "net_gex", age)
        self.max_entries, self.min_samples = max_entries, min_samples

    def scored(self, times: np.ndarray, values: np.ndarray, first: int) -> tuple[dict[str, np.ndarray], int]:
        n, below = sliding_rank(times, np.abs(values), self.age, first, self.max_entries)
        keep = int(np.searchsorted(times, times[-1] - self.age, "left"))
        return {"n": n.astype("int32"), "pct_rank": np.where(n < self.min_samples, 0.5, below / n)}, keep if self.max_entries is None else max(keep, len(times) - self.max_entries)


class RobustScore(KeyedWindow):
    def __init__(self, key: str, age: float, window: int, min_samples: int):
        super().__init__(key, "value", age)
        self.window, self.min_samples = window, min_samples

    def scored(self, times: np.ndarray, values: np.ndarray, first: int) -> tuple[dict[str, np.ndarray], int]:
        return {"robust_z": sliding_median_score(values, first, self.window, self.min_samples)}, max(0, len(values) - self.window)


def rolling_rank(prints: DataFrame, key: str = "symbol", max_age_days: float = 10.0, max_entries: int | None = None, min_samples: int = 30, late: str = "1 hour") -> DataFrame:
    """Rank of |net_gex| among the key's prints of the last ten days (the newest max_entries of them, if given), .5 until warm; survives restarts
    with the checkpoint. Twin of the batch `gex_rank`. Columns: key, ts, net_gex.

    The state of a key is its prints of ten days, whatever the stream's length, and goes when the watermark is ten days past
    its last print.
    """
    schema = f"{key} string, ts timestamp, n int, pct_rank double"
    return prints.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(
        RollingRank(key, max_age_days * 86_400.0, max_entries, min_samples), schema, "Append", "EventTime")


def robust_stream(values: DataFrame, key: str = "symbol", window: int = 500, min_samples: int = 20, idle_days: float = 10.0, late: str = "1 hour") -> DataFrame:
    """Robust z-score of each value against the key's earlier ones (newest 500). Twin of the batch `robust_zscore`. A key
    that is idle for idle_days starts anew. Columns: key, ts, value."""
    schema = f"{key} string, ts timestamp, robust_z double"
    return values.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(
        RobustScore(key, idle_days * 86_400.0, window, min_samples), schema, "Append", "EventTime")
