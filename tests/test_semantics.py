"""Hand-checked fixtures for rules the given tables do not exercise."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions.exprs import norm_cdf
from tidemark.operators import bars as B
from tidemark.operators import decide as D
from tidemark.operators import economics as E
from tidemark.operators import evaluation as V
from tidemark.operators import indicators as I
from tidemark.operators import journal as J
from tidemark.operators import risk as K
from tidemark.operators import structures as S
from tidemark.operators import windows as W
from tidemark.sources import recordings as R
from tidemark.sources import vendor as N

UTC = dt.timezone.utc


def make_bars(spark, closes, spread=1.0, start=dt.datetime(2024, 1, 2, 14, 30)):
    rows = []
    for i, c in enumerate(closes):
        ts = start + dt.timedelta(minutes=i)
        rows.append(("X", ts.date(), ts, c, c + spread, c - spread, c, 100 + i % 7))
    return spark.createDataFrame(rows, "symbol string, session_date date, ts timestamp, open double, high double, low double, close double, volume bigint")


def test_normal_distribution(spark):
    xs = [i / 10 for i in range(-60, 61)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) for r in got) < 1e-7


def test_resample_follows_the_exchange_clock_across_daylight_saving(spark):
    # 09:30 New York is 14:30 UTC in winter and 13:30 UTC in summer; both must open bucket 0
    rows = [("X", dt.datetime(2024, 3, 8, 14, 30), 1.0), ("X", dt.datetime(2024, 3, 8, 14, 59), 2.0), ("X", dt.datetime(2024, 3, 11, 13, 30), 3.0), ("X", dt.datetime(2024, 3, 11, 13, 29), 4.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    for c in ("open", "high", "low"):
        df = df.withColumn(c, F.col("close"))
    out = B.resample_ohlcv(df.withColumn("volume", F.lit(1)), 30).orderBy("ts").collect()
    assert [(r.ts, r.close) for r in out] == [(dt.datetime(2024, 3, 8, 14, 30), 2.0), (dt.datetime(2024, 3, 11, 13, 0), 4.0), (dt.datetime(2024, 3, 11, 13, 30), 3.0)]


def test_flat_series_rsi_is_fifty_and_cold_fields_are_null(spark):
    rows = I.indicators(make_bars(spark, [100.0] * 30)).orderBy("ts").collect()
    assert rows[-1].rsi == 50.0 and rows[13].rsi is None
    assert rows[-1].trend_cleanliness is None and rows[10].bb_width is None
    up = I.indicators(make_bars(spark, [100.0 + i for i in range(30)])).orderBy("ts").collect()
    assert up[-1].rsi == 100.0 and abs(up[-1].trend_cleanliness - 1.0) < 1e-9


def test_blocks_do_not_change_indicators(spark):
    rng = random.Random(7)
    closes, c = [], 100.0
    for _ in range(1500):
        c += rng.gauss(0, 0.3)
        closes.append(round(c, 2))
    bars = make_bars(spark, closes)
    names = ["rsi", "adx", "ema_slope", "keltner_width", "bb_compression", "donchian_width", "realized_vol", "cvd_persistence"]
    one = {r.ts: r for r in I.indicators(bars, block_rows=4000).select("ts", *names).collect()}
    many = {r.ts: r for r in I.indicators(bars, block_rows=256).select("ts", *names).collect()}
    assert len(one) == len(many) == 1500
    for ts, r in one.items():
        for n in names:
            a, b = r[n], many[ts][n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (ts, n, a, b)


def test_ranks_stay_exact_when_one_value_holds_a_third_of_the_rows(spark):
    values = [5.0] * 400 + [float(i % 97) for i in range(800)]
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate(values)], "g string, v double, id bigint")
    rows = W.ranked(df, ["g"], "v", ["id"], buckets=8).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 1201)) and {r.n for r in rows} == {1200}
    by_rank = [r.v for r in sorted(rows, key=lambda r: r["rank"])]
    assert by_rank == sorted(values)


def test_drawdown_spans_sessions_and_starts_at_zero(spark):
    rows = [("a", "d1", 1, 5.0), ("a", "d1", 2, -3.0), ("a", "d2", 3, -4.0), ("a", "d2", 4, 9.0), ("b", "d1", 5, -2.0), ("b", "d2", 6, -2.0)]
    df = spark.createDataFrame(rows, "v string, d string, id int, p double")
    got = {r.v: r.maximum_drawdown for r in V.max_drawdown(df, ["v"], "d", ["id"], "p").collect()}
    assert got == {"a": 7.0, "b": 4.0}


def test_greedy_portfolio_matches_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i % 3, "s" + str(i % 2), i, rng.choice(["x", "y", "z"]), rng.choice(["e", "f"]), float(rng.randint(1, 20)), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "account_id int, session_date string, trade_id int, family string, expiration string, max_loss double, gamma double")
    lim = K.RiskLimits(max_daily_loss=60, max_positions=6, gamma_limit=2.0, max_family_positions=3, max_expiration_positions=4)
    got = {r.trade_id: r.accepted for r in K.greedy_portfolio_check(df, lim, ["trade_id"]).collect()}
    state: dict = {}
    for acc, ses, tid, fam, exp, loss, gamma in sorted(rows, key=lambda r: r[2]):
        held = state.setdefault((acc, ses), [])
        ok = (
            sum(h[2] for h in held) + loss <= 60 and len(held) < 6 and sum(h[3] for h in held) + gamma <= 2.0
            and sum(h[0] == fam for h in held) < 3 and sum(h[1] == exp for h in held) < 4
        )
        if ok:
            held.append((fam, exp, loss, gamma))
        assert got[tid] == ok, tid


def test_unbounded_short_calls_are_rejected_and_payoffs_are_exact(spark):
    rows = [("s", t, str(k), "2024-01-02", "100", str(b), str(b + 0.1)) for t in ("call", "put") for k, b in zip(range(95, 106), range(1, 12))]
    chain = spark.createDataFrame(rows, "snapshot_id string, option_type string, strike string, expiration string, spot string, bid string, ask string").select(
        "snapshot_id", "option_type", F.col("strike").cast("decimal(18,6)").alias("strike"), F.to_date("expiration").alias("expiration"), F.col("spot").cast("decimal(18,6)").alias("spot"),
        F.col("bid").cast("decimal(18,6)").alias("bid"), F.col("ask").cast("decimal(18,6)").alias("ask"), F.lit(None).cast("decimal(18,6)").alias("mark"),
        F.lit(None).cast("decimal(18,6)").alias("last"), F.lit(0.2).alias("iv"), F.lit(1.0).alias("age_seconds"), F.concat("option_type", "strike").alias("contract_id"),
    )
    u = S.candidate_universe(chain, dominance=False)
    for r in u.collect():
        net_calls = sum(x.quantity for x in r.legs if x.option_type == "call")
        assert net_calls >= 0
        for spot, pay in zip(r.spots, r.payoffs):
            sign = lambda x: 1 if x.option_type == "call" else -1
            value = sum(x.quantity * max((spot / 1e6 - float(x.strike)) * sign(x), 0.0) for x in r.legs)
            assert abs((float(r.entry_credit) + value) * 1e6 - pay) < 1e-2
        assert r.maximum_loss >= 0 and r.capital_required >= r.maximum_loss
    kept = S.candidate_universe(chain)
    assert 0 < kept.count() <= u.count()
    two = chain.withColumn("expiration", F.when(F.col("option_type") == "put", F.date_add("expiration", 1)).otherwise(F.col("expiration")))
    assert S.enumerate_structures(two).count() == 0


def test_credit_profit_ratio_sign_and_trailing_exit(spark):
    row = spark.range(1).select(
        E.profit_ratio(F.lit(1.0), F.lit(0.5), F.lit(True)).alias("c"), E.profit_ratio(F.lit(1.0), F.lit(0.5), F.lit(False)).alias("d"),
        E.exit_signal(E.ExitPolicy("trailing"), F.lit(0.2), F.lit(0.4), F.lit(1.0), F.lit(700)).alias("t"),
        E.exit_signal(E.ExitPolicy("fixed_target"), F.lit(-0.9), F.lit(0.0), F.lit(1.0), F.lit(700)).alias("h"),
    ).first()
    assert (row.c, row.d, row.t, row.h) == (0.5, -0.5, "trail", "hold")


def test_recording_round_trip_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"s{i}", dt.date(2024, 1, 2 + i % 2), dt.datetime(2024, 1, 2 + i % 2, 15, i), '{"snapshot_id":"s%d"}' % i) for i in range(10)],
        "snapshot_id string, session_date date, ts timestamp, payload string",
    )
    rec = R.to_records(rows, F.col("payload"))
    R.write_recording(rec, str(tmp_path / "rec"))
    back = R.read_recording(spark, str(tmp_path / "rec"))
    assert back.count() == 10 and back.filter("parsed").count() == 10
    report = J.inspect_recordings(back.withColumn("line_no", F.col("seq")), ["session_file"]).collect()
    assert {r.status for r in report} == {"clean"} and {r.session_file for r in report} == {"2024-01-02", "2024-01-03"}
    R.append_artifacts(rows.drop("ts"), str(tmp_path), "features")
    R.append_artifacts(rows.drop("ts").limit(1), str(tmp_path), "features")
    assert R.read_artifacts(spark, str(tmp_path), "features").count() == 11
    assert R.read_artifacts(spark, str(tmp_path), "features", ["2024-01-03"]).filter("session_date <> '2024-01-03'").count() == 0


def test_live_sessions_are_never_overwritten(spark):
    src = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "session_date string")
    have = spark.createDataFrame([("d1", ["imported"]), ("d2", ["imported"]), ("d2", [])], "session_date string, flags array<string>")
    rows, skipped = N.import_sessions(src, have, overwrite=True)
    assert sorted(r.session_date for r in rows.collect()) == ["d1", "d3"]
    assert [r.reason for r in skipped.collect()] == ["holds live records; not overwritten"]
    rows, _ = N.import_sessions(src, have)
    assert [r.session_date for r in rows.collect()] == ["d3"]


def test_stratified_sample_follows_weights_and_is_stable(spark):
    s = spark.range(40000).select(F.col("id").alias("session_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("archetype"))
    w = spark.createDataFrame([("a", 1.0), ("b", 0.25)], "archetype string, weight double")
    n = {r.archetype: r["count"] for r in D.stratified_session_sample(s, w, 0.4).groupBy("archetype").count().collect()}
    # 0.4 of all rows, in proportion 4 : 1
    assert abs(n["a"] / 20000 - 0.64) < 0.02 and abs(n["b"] / 20000 - 0.16) < 0.01
    again = D.stratified_session_sample(s.repartition(3), w, 0.4)
    assert D.stratified_session_sample(s, w, 0.4).exceptAll(again).count() == 0


def test_headline_plans_have_no_nested_loops(spark):
    from tidemark.plans import QUERIES, load

    load()
    for name in ("adx_di", "asof_latest", "label_forward_returns", "rnd_summary", "evaluate_trades", "knn_distance", "revenge_trades"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_medians_are_exact(spark):
    from tidemark.operators.forecast import exact_medians

    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (10.0, 1.0, None), (20.0, None, None), (None, None, None)], "a double, b double, c double")
    assert exact_medians(df, ["a", "b", "c"]) == {"a": 6.0, "b": 5.0, "c": 0.0}


def test_wilder_average_of_a_long_period_equals_the_recursion(spark):
    from tidemark.operators.ranks import wilder_rma

    x = [1.0 if k < 1500 else 1000.0 for k in range(6000)]
    bars = spark.createDataFrame([("s", f"2024-01-{1 + k // 500:02d}", k, v) for k, v in enumerate(x)], "symbol string, session_date string, ts long, v double")
    got = {r.ts: r.rma200 for r in wilder_rma(bars, "v", 200).collect()}
    avg = sum(x[:200]) / 200
    for k in range(199, 6000):
        avg = avg if k == 199 else (avg * 199 + x[k]) / 200
        assert abs(got[k] - avg) < 1e-6 * max(1, avg)


def test_hash_chain_with_nulls_verifies(spark):
    from tidemark.operators.journal import build_hash_chain, verify_hash_chain

    rows = [("a", 1, 7, "p"), ("a", 2, None, "q"), ("a", 3, 9, None), ("b", 1, None, "r")]
    events = spark.createDataFrame(rows, "chain string, sequence_number long, status int, payload string")
    report = verify_hash_chain(build_hash_chain(events)).collect()
    assert {(r.chain, r.events, r.broken) for r in report} == {("a", 3, 0), ("b", 1, 0)}


def test_the_last_of_repeated_quotes_counts(spark):
    from tidemark.operators.structures import snapshot_maps

    quote = "mark decimal(18,6), bid decimal(18,6), ask decimal(18,6), last decimal(18,6), iv double, age_seconds double, contract_id string"
    from decimal import Decimal as N

    rows = [("s", p, "call", N(5), N(5), N(m), N(1), N(2), N(1), 0.2, 1.0, "c", "2024-01-02") for p, m in ((1, 3), (2, 4), (0, 9))]
    chain = spark.createDataFrame(rows, f"snapshot_id string, pos long, option_type string, strike decimal(18,6), spot decimal(18,6), {quote}, expiration string")
    calls = snapshot_maps(chain).first().calls
    assert len(calls) == 1 and next(iter(calls.values())).mid == N(4)


def test_bootstrap_draws_with_replacement(spark):
    from tidemark.operators.forecast import session_bootstrap

    s = spark.createDataFrame([(f"d{k}",) for k in range(3)], "session_date string")
    sizes = [r["count"] for r in session_bootstrap(s, 400).groupBy("replica").count().collect()]
    assert len(sizes) == 400  # never empty
    assert abs(sizes.count(1) / 400 - 1 / 9) < 0.06 and abs(sizes.count(2) / 400 - 2 / 3) < 0.08


def test_streams_keep_every_row_over_many_micro_batches(spark, tmp_path):
    from tidemark.streaming import streams as X

    for k in range(4):
        spark.range(k * 250, k * 250 + 250).select((F.col("id") % 5).alias("snapshot_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = X.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, max_files=1)
    stage = lambda b: b.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):  # a restart finds nothing new
        X.per_batch(source, stage, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = X.merged(spark, str(tmp_path / "out"), ["snapshot_id"], {"n": F.sum}).collect()
    assert {(r.snapshot_id, r.n) for r in got} == {(k, 200) for k in range(5)}


def test_two_flat_symbols_of_one_session_have_no_volatility(spark):
    from tidemark.operators.regimes import label_regimes

    rows = [(s, "d", k, p) for k in range(40) for s, p in (("a", 10.0), ("b", 500.0))]
    obs = spark.createDataFrame(rows, "symbol string, session_date string, ts long, spot double")
    assert label_regimes(obs, keys=("symbol",)).agg(F.max("rv")).first()[0] == 0.0


def test_robust_scaler_medians(spark):
    from tidemark.operators.forecast import robust_scaler

    rows = [([float(k), 5.0, None if k == 2 else float(10 * k)],) for k in range(4)]
    r = robust_scaler(spark.createDataFrame(rows, "vector array<double>"), 3).first()
    assert r.med == [1.5, 5.0, 10.0] and r.mad == [1.0, 1.0, 10.0]


def test_sessions_without_a_close_give_no_outcome(spark):
    day = dt.date(2024, 1, 2)
    leg = lambda kind, k, q: {"option_type": kind, "strike": Decimal(k), "quantity": q, "q": {"iv": 0.2}}
    legs_type = "array<struct<option_type:string,strike:decimal(18,6),quantity:int,q:struct<iv:double>>>"
    rows = [(s, f"c-{s}", d, dt.datetime.combine(d, dt.time(15)), Decimal(2), [leg("call", 100, -1)]) for s, d in (("a", day), ("b", day + dt.timedelta(1)), ("c", day + dt.timedelta(2)))]
    c = spark.createDataFrame(rows, f"snapshot_id string, candidate_id string, expiration date, observed_at timestamp, entry_credit decimal(18,6), legs {legs_type}")
    bars = spark.createDataFrame(
        [(d, dt.datetime.combine(d, dt.time(15, m)), 100.0) for d in (day, day + dt.timedelta(1)) for m in (10, 20)], "session_date date, ts timestamp, close double"
    )
    paths = E.session_paths(bars, F.lit(900))
    settle = spark.createDataFrame([(day, Decimal("101")), (day + dt.timedelta(1), None)], "session_date date, settlement_price decimal(18,6)")
    hold = E.ExitPolicy(take_profit=1e9, stop_loss=1e9, eod_close=False)
    got = E.managed_outcome(c, paths, settle, hold).collect()
    assert [(r.snapshot_id, r.realized_pnl, r.exit_reason) for r in got] == [("a", 1.0, "expiration_settlement")]
    assert E.managed_outcome(c, paths, settle.limit(0), hold).count() == 0
    skipped = {(r.session_date, r.reason, r.n_candidates) for r in E.skipped_sessions(c, paths, settle).collect()}
    assert skipped == {(day + dt.timedelta(n), "never reached the close", 1) for n in (1, 2)}
    later = spark.createDataFrame([(day + dt.timedelta(n), Decimal(100)) for n in (0, 1, 2)], settle.schema)
    assert [(r.session_date, r.reason) for r in E.skipped_sessions(c, paths, later).collect()] == [(day + dt.timedelta(2), "no bars")]
