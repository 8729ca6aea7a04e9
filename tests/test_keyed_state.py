"""Sliding ranks against a naive count, and keyed state over restarts and idle keys."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def naive(times, values, age, most=None):
    out = []
    for t, v in zip(times, values):
        held = [(x, y) for x, y in zip(times, values) if t - age <= x <= t]
        held = held[-most:] if most else held
        out.append((len(held), sum(y < v for _, y in held)))
    return out


def test_sliding_rank(monkeypatch):
    from tidemark.functions import order

    monkeypatch.setattr(order, "RUN", 16)
    rng = np.random.default_rng(1)
    for n, most in ((1, None), (200, None), (200, 25), (50, 3)):
        times, values = np.sort(rng.integers(0, 90, n)).astype(float), rng.integers(0, 12, n).astype(float)
        for first in (0, n // 2):
            got = list(zip(*[x.tolist() for x in order.sliding_rank(times, values, 20.0, first, most)]))
            assert got == naive(times, values, 20.0, most)[first:]


def test_a_hot_key_stays_fast():
    import time

    from tidemark.functions.order import sliding_rank

    rng = np.random.default_rng(1)
    start = time.time()
    n, below = sliding_rank(np.arange(100_000.0), rng.random(100_000), 1e9)
    assert n[-1] == 100_000 and abs(below[-1] / 1e5 - 0.5) < 0.6 and time.time() - start < 30


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, "symbol string, ts timestamp, net_gex double").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_state_restarts_and_expires(spark, tmp_path):
    """Three runs over one checkpoint: the second goes on from the state of the first; after ten idle days a key starts anew."""
    from tidemark.operators.ranks import gex_rank
    from tidemark.streaming.streams import file_stream, rolling_rank

    day, rng = dt.datetime(2024, 1, 1), np.random.default_rng(5)
    schema = "symbol string, ts timestamp, net_gex double"
    rows = [("a", day + dt.timedelta(hours=4 * k), float(rng.integers(-50, 50))) for k in range(90)]
    other = [("b", day + dt.timedelta(hours=k), float(k)) for k in range(20)]
    runs = [rows[:40] + other, rows[40:], [("c", day + dt.timedelta(days=40), 1.0)], [("b", day + dt.timedelta(days=41), 2.0)]]
    for k, part in enumerate(runs):
        feed(spark, tmp_path, "in", part)
        stream = file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        query = rolling_rank(stream, min_samples=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if k == 1:
            got = {(r.symbol, r.ts): (r.n, round(r.pct_rank, 9)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
            batch = gex_rank(spark.createDataFrame(rows + other, schema), "net_gex", min_samples=3).collect()
            assert got == {(r.symbol, r.ts): (r.n, round(r.pct_rank, 9)) for r in batch} and len(got) == 110
    held = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "held").load()
    keys = {r[0] for r in held.select(F.col("key").getField("symbol")).collect()}
    assert "a" not in keys and "b" in keys
    last = spark.read.parquet(f"{tmp_path}/out").filter("symbol = 'b'").orderBy(F.desc("ts")).first()
    assert last.n == 1


def test_a_key_keeps_no_frames(monkeypatch):
    """frames of a key go as they are read, and its result leaves in pieces."""
    import weakref

    from tidemark.streaming import streams as X

    class Handle:
        exists, get, listTimers = (lambda self: False), (lambda self: iter(())), (lambda self: iter(()))
        getListState = lambda self, *_: self
        put = registerTimer = lambda self, _: None

    alive = []

    def frames():
        for k in range(5):
            f = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2024-01-05") - pd.to_timedelta(np.arange(100) + 100 * k, unit="s"), "value": np.arange(100.0)})
            alive.append(weakref.ref(f))
            yield f
            del f
            assert sum(r() is not None for r in alive) <= 1

    monkeypatch.setattr(X, "PIECE", 64, raising=False)
    window = X.RobustScore("symbol", 1e6, 50, 20)
    window.init(Handle())
    out = list(window.handleInputRows(("a",), frames(), None))
    whole = pd.concat(out)
    assert max(map(len, out)) <= 64 and len(whole) == 500 and whole["ts"].is_monotonic_increasing and whole["robust_z"].isna().sum() == 20
