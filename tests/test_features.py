"""The feature bundle: eight families, what is missing and what failed; the matrix at a snapshot against the series form."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import chain as C
from tidemark.operators import features as X
from tidemark.operators import indicators as I

DAY = dt.datetime(2024, 1, 2, 14, 30)
LONG = "snapshot_id string, name string, value double"


def minute_bars(spark, ids, n=120):
    rows = []
    for sid in ids:
        rng = random.Random(sid)
        close = 100.0
        for i in range(n):
            was, close = close, close + rng.uniform(-1, 1)
            rows.append((sid, DAY + dt.timedelta(minutes=i - 5), was, max(was, close) + 0.1, min(was, close) - 0.1, close, 100 + i % 7))
    return spark.createDataFrame(rows, "snapshot_id string, ts timestamp, open double, high double, low double, close double, volume bigint")


def snapshots(spark, rows):
    return spark.createDataFrame(
        rows, "snapshot_id string, ts timestamp, spot double, minutes_from_open int, minutes_to_close int, penalty double, is_live boolean, underlying_bid double, underlying_ask double"
    )


def test_missing_and_failed_are_told_apart(spark):
    a = spark.createDataFrame([("s1", "a.x", 1.0), ("s1", "a.y", float("nan")), ("s2", "a.x", 2.0), ("s2", "a.y", None)], LONG)
    b = spark.createDataFrame([("s1", "b.x", 3.0), ("s3", "b.x", float("-inf"))], LONG)
    ids = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "snapshot_id string")
    got = {r.snapshot_id: r for r in C.feature_bundle({"b": b, "a": a}, ids).collect()}
    assert (got["s1"].features, got["s1"].missing_families, got["s1"].failed_families) == ({"b.x": 3.0}, [], ["a"])
    assert (got["s2"].features, got["s2"].missing_families, got["s2"].failed_families) == ({"a.x": 2.0}, ["b"], [])
    assert (got["s3"].features, got["s3"].missing_families, got["s3"].failed_families) == ({}, ["a"], ["b"])
    assert (got["s4"].n_features, got["s4"].missing_families, got["s4"].failed_families) == (0, ["b", "a"], [])
    assert len({r.bundle_id for r in got.values()}) == 4


def test_matrix_of_a_snapshot_is_the_last_row_of_its_series(spark):
    bars = minute_bars(spark, ["s1", "s2"])
    at_snapshot = {(r.snapshot_id, r.timeframe): r for r in I.mtf_latest(bars, (1, 5, 30)).collect()}
    series = I.mtf_matrix(bars, (1, 5, 30), ("snapshot_id",))
    last = series.groupBy("snapshot_id", "timeframe").agg(F.max_by(F.struct(*I.FIELDS), F.struct("session_date", "ts")).alias("f"))
    rows = last.collect()
    assert len(rows) == len(at_snapshot) == 6
    for r in rows:
        have = at_snapshot[r.snapshot_id, r.timeframe]
        for name in I.FIELDS:
            x, y = r.f[name], have[name]
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(x))), name


def test_open_price_passes_over_bars_before_the_open(spark):
    bars = minute_bars(spark, ["s1", "s2", "s3"], 10).withColumn("open", F.minute("ts").cast("double"))
    snaps = snapshots(spark, [(s, DAY + dt.timedelta(minutes=30), 1.0, m, None, 0.0, True, None, None) for s, m in (("s1", 30), ("s2", None), ("s3", 5), ("s4", 30))])
    # s1 opened at 14:30; of s2 that isn't known; s3 opened at 14:55, later than all its bars; s4 has none
    assert {r.snapshot_id: r.open_price for r in X.session_open_prices(snaps, bars).collect()} == {"s1": 30.0, "s2": 25.0, "s3": 25.0}


def test_all_eight_families_and_an_empty_snapshot(spark):
    bars = minute_bars(spark, ["s1"])
    chain = spark.createDataFrame(
        [("s1", side, float(k), 100.0, i, 0.05, 0.5, 10, 5, max(b, 0.1), max(b, 0.1) + 0.2, None, None, 0.2) for i, (side, k) in enumerate((s, k) for k in range(90, 111) for s in ("call", "put")) for b in [6 - abs(k - 100) * 0.2 + (100 - k) * (0.5 if side == "call" else -0.5)]],
        "snapshot_id string, side string, strike double, spot double, pos bigint, gamma double, delta double, open_interest bigint, volume bigint, bid double, ask double, mark double, last double, iv double",
    )
    moves = spark.createDataFrame([("s1", s, 0.01, 1) for s in ("SPY", "RSP", "XLK")], "snapshot_id string, symbol string, move double, seq int")
    indices = spark.createDataFrame([("s1", "VIX", 15.0, 90.0, 1)], "snapshot_id string, symbol string, last double, vvix_baseline double, seq int")
    snaps = snapshots(spark, [("s1", DAY, 100.0, 0, 390, 0.0, True, 99.0, 101.0), ("s2", DAY, 100.0, None, None, 0.5, False, None, None)])
    got = {r.snapshot_id: r for r in C.feature_bundle(X.family_rows(snaps, chain, bars, moves, indices), snaps).collect()}
    assert got["s1"].missing_families == [] and got["s1"].failed_families == []
    assert {n.split(".")[0] for n in got["s1"].features} >= {"1m", "gex", "vol", "rnd", "flow", "breadth", "vix", "session"}
    assert got["s1"].features["session.underlying_spread_pct"] == 0.02
    assert got["s2"].missing_families == [n for n in X.FAMILIES if n != "session"]
    assert got["s2"].features == {"session.underlying_price": 100.0, "session.data_quality_penalty": 0.5, "session.is_live": 0.0, "session.contracts": 0.0, "session.strikes": 0.0}


def test_lines_of_a_bundle_move_once(spark, tmp_path):
    """All families start from lines that lie by snapshot, so nothing moves again, however many families read them."""
    from tidemark.plans import QUERIES, load

    load()
    lines = spark.sql(
        "SELECT id AS l_orderkey, id % 7 AS l_partkey, id % 5 AS l_suppkey, CAST(id % 4 AS int) AS l_linenumber, id % 50 + 1D AS l_quantity, 900D + id AS l_extendedprice,"
        " 0.01D * (id % 9) AS l_discount, 0.01D * (id % 8) AS l_tax, substr('ANR', CAST(id % 3 AS int) + 1, 1) AS l_returnflag, timestamp '1994-01-05' AS l_shipdate FROM range(3000)")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("feature_bundle", "feature_families"):
            df = QUERIES[name](spark, str(tmp_path))
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, plan
            assert df.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)


def test_breadth_does_not_depend_on_the_order_of_its_rows(spark):
    rows = [("s1", s, x, 1) for s, x in zip(C.TOP10_WEIGHTS, (0.1, -0.3, 0.07, 0.013, -0.21, 0.33, 0.0007, -0.11, 0.19, 0.23))]
    seen = {C.breadth(spark.createDataFrame(rows[k:] + rows[:k], "snapshot_id string, symbol string, move double, seq int").repartition(k + 1), C.TOP10_WEIGHTS).first().top10_pressure for k in range(10)}
    assert len(seen) == 1
