"""Queries: Structured Streaming over the events table, run to its end; results are read back from the sink's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.plans import adapters as A
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.streaming import streams as X


def events_stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    return (
        spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet").load(sf)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def drain(stream, name: str):
    """Run a stream over everything available and return what its file sink holds."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tick_stream(spark, sf):
    return events_stream(spark, sf).select(
        F.col("event_type").alias("symbol"), "ts", (F.lit(100.0) + F.col("value") / 10.0).alias("price"), (F.lit(1) + F.col("user_id") % 10).alias("size"), F.col("event_id").alias("seq")
    )


@query(
    "streaming_bars",
    A.sql(
        """SELECT symbol, epoch(ts)::BIGINT AS ts_sec, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM v_bars30
           WHERE ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
        "v_bars30",
    ),
)
def _(spark, sf):
    b = drain(X.streaming_bars(tick_stream(spark, sf), 30), "bars")
    return b.select("symbol", F.unix_timestamp("ts").alias("ts_sec"), *[r6(c, c) for c in ("open", "high", "low", "close")], "volume")


@query("append_ticks", "SELECT ts::DATE::VARCHAR AS session_date, count(*) AS n, min(event_id) AS first_seq FROM events GROUP BY 1")
def _(spark, sf):
    folder = shared_folder(spark, "ticks")
    q = X.append_ticks(tick_stream(spark, sf).withColumn("session_date", F.to_date("ts")), f"{folder}/out", f"{folder}/cp")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("session_date").cast("string").alias("session_date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )


@query("incremental_stage", "SELECT user_id AS snapshot_id, count(*) AS n_events FROM events GROUP BY 1")
def _(spark, sf):
    folder = shared_folder(spark, "stage")

    def stage(batch):
        return batch.groupBy(F.col("user_id").alias("snapshot_id")).agg(F.count(F.lit(1)).alias("n_events"))

    X.per_batch(events_stream(spark, sf), stage, f"{folder}/out", f"{folder}/cp").awaitTermination()
    return X.merged(spark, f"{folder}/out", ["snapshot_id"], {"n_events": F.sum})


@query("once_per_snapshot", "SELECT DISTINCT event_id AS snapshot_id FROM events")
def _(spark, sf):
    s = events_stream(spark, sf).select(F.col("event_id").alias("snapshot_id"), "ts")
    return drain(X.once_per_snapshot(s.unionByName(s)), "once").select("snapshot_id")


@query(
    "streaming_duplicate_guard",
    """WITH e AS (SELECT event_type AS account_id, user_id::VARCHAR AS candidate_id, strftime(ts, '%Y-%m-%d %H') AS geometry_hash FROM events)
       SELECT DISTINCT account_id, candidate_id, geometry_hash FROM e""",
)
def _(spark, sf):
    d = events_stream(spark, sf).select(
        "ts", F.col("event_type").alias("account_id"), F.col("user_id").cast("string").alias("candidate_id"), F.date_format("ts", "yyyy-MM-dd HH").alias("geometry_hash"), "event_id"
    )
    return drain(X.duplicate_guard(d), "guard").select("account_id", "candidate_id", "geometry_hash")


@query(
    "streaming_late_split",
    "SELECT event_type AS component, count(*) AS n_late FROM events WHERE value - 1 < 0 OR value - 1 > 60 GROUP BY 1",
)
def _(spark, sf):
    f = events_stream(spark, sf).select(
        F.col("event_type").alias("component"), (F.col("value") - 1).alias("age_seconds"), F.lit(20.0).alias("freshness_limit_seconds"), F.lit(False).alias("fallback_used"), F.col("ts").alias("observed_at"),
    )
    late = drain(X.split_late(f, "2024-02-01")[1], "late")
    return late.groupBy("component").agg(F.count(F.lit(1)).alias("n_late"))


@query(
    "streaming_spot_chain_join",
    """SELECT s.event_id AS spot, c.event_id AS chain FROM events s JOIN events c ON s.user_id % 5 = c.user_id % 5 AND s.event_type = 'click' AND c.event_type = 'view'
       AND c.ts BETWEEN s.ts - INTERVAL 60 SECOND AND s.ts + INTERVAL 60 SECOND""",
)
def _(spark, sf):
    e = events_stream(spark, sf).withColumn("symbol", F.col("user_id") % 5)
    spot = e.filter("event_type = 'click'").select("symbol", F.col("ts").alias("spot_ts"), F.col("event_id").alias("spot"))
    chain = e.filter("event_type = 'view'").select("symbol", F.col("ts").alias("chain_ts"), F.col("event_id").alias("chain"))
    return drain(X.join_spot_chain(spot, chain), "spotchain").select("spot", "chain")


@query(
    "streaming_gex_rank",
    """WITH e AS (SELECT event_type AS symbol, ts, event_id, value FROM events) SELECT a.symbol, epoch_us(a.ts) AS micros, count(*) AS n,
       round(CASE WHEN count(*) < 30 THEN 0.5 ELSE count(*) FILTER (abs(b.value - 50) < abs(a.value - 50)) / count(*)::DOUBLE END, 6) AS pct_rank
       FROM e a JOIN e b ON a.symbol = b.symbol AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 10 DAY GROUP BY a.symbol, a.ts, a.value""",
)
def _(spark, sf):
    p = events_stream(spark, sf).select(F.col("event_type").alias("symbol"), "ts", (F.col("value") - 50).alias("net_gex"))
    r = drain(X.rolling_rank(p), "rank")
    return r.select("symbol", F.unix_micros("ts").alias("micros"), "n", r6("pct_rank", "pct_rank"))


@query(
    "streaming_robust_zscore",
    """WITH h AS (SELECT event_type AS symbol, ts, value, list(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS h FROM events),
       m AS (SELECT *, list_median(h) AS med FROM h), d AS (SELECT *, list_median(list_transform(h, lambda v: abs(v - med))) AS mad FROM m)
       SELECT symbol, epoch_us(ts) AS micros, round(CASE WHEN len(h) >= 20 THEN CASE WHEN mad > 0 THEN (value - med) / (1.4826 * mad) ELSE 0 END END, 5) AS robust_z FROM d""",
)
def _(spark, sf):
    v = events_stream(spark, sf).select(F.col("event_type").alias("symbol"), "ts", "value")
    z = drain(X.robust_stream(v), "robust")
    return z.select("symbol", F.unix_micros("ts").alias("micros"), F.round("robust_z", 5).alias("robust_z"))


@query("streaming_settlement", "SELECT ts::DATE::VARCHAR AS session_date, arg_max(value, ts) AS settlement FROM events WHERE day(ts) <= 20 GROUP BY 1")
def _(spark, sf):
    s = events_stream(spark, sf).select("ts", "value", (F.dayofmonth("ts") <= 20).alias("settlement_available"))

    out = drain(X.settle_closed_sessions(s), "settle")
    return out.select(F.col("session_date").cast("string").alias("session_date"), "settlement")
