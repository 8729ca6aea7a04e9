"""Queries whose results changed on larger tables: seven-digit keys, and more bars than a vendor keeps."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest
from oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def folder_with(tmp_path, **tables):
    """A folder of the smallest tables, some of them replaced by what SQL makes of them."""
    con = duckdb.connect()
    for name in ("lineitem", "events"):
        source = f"read_parquet('{SMALL}/{name}.parquet')"
        con.execute(f"COPY ({tables.get(name, 'SELECT * FROM {t}').format(t=source)}) TO '{os.path.join(tmp_path, name)}.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["challenger_decisions", "rank_by_value", "rank_snapshot", "top_k_candidates"])
def test_keys_longer_than_their_width(spark, tmp_path, name):
    from tidemark.plans import ORACLES, QUERIES, load

    load()
    sf = folder_with(tmp_path, lineitem="SELECT * REPLACE (l_partkey * 7919 + 1000000 AS l_partkey, l_suppkey + 100000 AS l_suppkey) FROM {t}")
    result = compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf)
    assert result.startswith("ok"), result


def test_only_the_newest_bars_of_a_vendor_stay(spark):
    from tidemark.plans import ORACLES, QUERIES, load

    load()
    sf, name = "/root/testdata/sf0.1", "normalize_vendor_bars"  # over 8,000 minutes a symbol
    result = compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf)
    assert result.startswith("ok 40000 rows"), result


def test_six_decimals_round_as_sql_rounds_doubles(spark):
    from tidemark.functions.exprs import r6

    values = [0.0631875, 0.0641875, 0.0639375, 0.038212499999999996, 0.042812499999999996, -0.0641875, 1e12 / 3, None]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", r6("v", "v")).collect()
    assert [r.v for r in sorted(rows)] == want


def test_disagreement_of_large_predictions(spark):
    """Squares of the predictions would leave nothing of a variance of 1e-4 here."""
    from tidemark.operators.forecast import mixture_of_experts

    pred = spark.createDataFrame([(1, 0, 1e8), (1, 1, 1e8 + 0.02)], "obs_id int, regime int, pred double")
    p = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], "obs_id int, regime int, p double")
    support = spark.createDataFrame([(0, 1e18), (1, 1e18)], "regime int, sessions double")
    g = spark.createDataFrame([(1, 1e8)], "obs_id int, g double")
    row = mixture_of_experts(pred, p, support, g).first()
    assert abs(row.prediction - (1e8 + 0.01)) < 1e-6 and abs(row.disagreement - 1e-4) < 1e-6


def test_stream_join_pairs_at_the_limit(spark, tmp_path):
    """Pairs on both sides of a stretch's edge, at the limit and beyond it, each once."""
    import datetime as dt

    from tidemark.streaming.streams import join_spot_chain

    start = dt.datetime(2024, 1, 1, 0, 2)
    at = [start + dt.timedelta(seconds=s) for s in (-121, -120, -61, -60, -59, -1, 0, 1, 59, 60, 61, 119, 120, 121)]
    spark.createDataFrame([(i % 2, t, i) for i, t in enumerate(at * 2)], "symbol int, ts timestamp, id int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("symbol int, ts timestamp, id int").parquet(f"{tmp_path}/in")
    joined = join_spot_chain(stream.selectExpr("symbol", "ts AS spot_ts", "id AS spot"), stream.selectExpr("symbol", "ts AS chain_ts", "id AS chain"))
    assert "_stretch" in joined._jdf.queryExecution().analyzed().toString()  # joined on time too, not on the symbol alone
    q = joined.writeStream.format("memory").queryName("spot_chain_pairs").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.spot, r.chain) for r in spark.table("spot_chain_pairs").collect())
    rows = list(enumerate(at * 2))
    assert got == sorted((i, j) for i, s in rows for j, c in rows if i % 2 == j % 2 and abs((s - c).total_seconds()) <= 60)


def test_grouped_medians_equal_the_sorted_middle(spark):
    """Many, few, repeated and one value; even and odd numbers; cuts that are only approximate; a null key and a null group."""
    import random
    import statistics

    from tidemark.operators.evaluation import feature_medians
    from tidemark.operators.windows import grouped_medians

    rng = random.Random(3)
    groups = {
        "many": [rng.gauss(0, 1) for _ in range(30_000)], "odd": [rng.random() for _ in range(20_001)], "few": [float(rng.randrange(4)) for _ in range(9_000)],
        "halves": [0.0] * 5_000 + [1.0] * 5_000, "edge": [0.0] * 5_000 + [1.0] * 5_001, "one": [7.0], "two": [1.0, 4.0], None: [3.0, -1.0, 2.0, 9.0],
    }
    rows = [(k, x) for k, values in groups.items() for x in values] + [("two", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, value double").repartition(7)
    got = {r.name: r.median for r in grouped_medians(df, ["name"], "value").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    assert {r.name: r.median for r in feature_medians(df).collect()} == {k: round(v, 6) for k, v in got.items()} | {"none": None}


def test_bars_of_a_snapshot_move_once(spark):
    """Timeframes, indicators and the last row of a snapshot are made after one exchange of its bars."""
    from tidemark.operators.indicators import mtf_latest

    bars = spark.sql("SELECT 's' || id % 3 AS snapshot_id, timestamp_seconds(1704205800 + id * 60) AS ts, 1D AS open, 2D AS high, 0.5D AS low, 1D AS close, 5L AS volume FROM range(90)")
    plan = mtf_latest(bars, (1, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1, plan


def test_blocks_grow_with_the_rows_and_packs_do_not(spark):
    from tidemark.operators.forecast import QUERY_ROWS, NeighbourIndex

    rows = spark.range(40_000).selectExpr("id", "array(rand(1), rand(2)) AS z")
    index = NeighbourIndex(rows, pivots=4)
    assert (index.block_rows, index.query_rows) == (40_000 // 64, QUERY_ROWS)


def test_regime_of_a_snapshot_without_gamma(spark, tmp_path):
    """A block with few orders has months whose lines have no discount, so no gamma: the SQL's confidence is 1 there."""
    from tidemark.plans import ORACLES, QUERIES, load

    load()
    name = "structural_regime"
    sf = folder_with(tmp_path, lineitem="SELECT * REPLACE (CASE WHEN l_orderkey % 7 < 5 THEN 0.0 ELSE l_discount END AS l_discount, l_orderkey * 300 AS l_orderkey) FROM {t}")
    result = compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("step", ["vendor_snapshots", "vendor_chain", "vendor_bars"])
def test_vendor_lines_are_parsed_once(spark, step):
    """A from_json in a filter and again in a projection parses every line as often."""
    from tidemark.plans.sources import vendor_lines
    from tidemark.sources import vendor as V

    rows = V.vendor_snapshots(vendor_lines(spark, SMALL))
    rows = rows if step == "vendor_snapshots" else getattr(V, step)(rows, symbol="SPY")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_an_import_reads_its_archive_once(spark, tmp_path, monkeypatch):
    from tidemark.sources import vendor as V

    source, target = tmp_path / "source", tmp_path / "target"
    source.mkdir()
    line = '{"t":"tick","ts":"2024-01-02T15:00:00+00:00","market":{"spot":1.5},"option_rows":[],"bars":[]}\n'
    (source / "2024-01-02.jsonl").write_text(line)
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    read = V.session_lines
    monkeypatch.setattr(V, "session_lines", lambda *a: counted(read(*a)))
    for _ in range(2):
        V.import_archive(spark, str(source), str(target), overwrite=True)
    assert spark.read.parquet(str(target)).count() == 1 and seen.value == 2  # one line, two imports


def test_passages_hold_no_session(spark):
    """A session's observations stream through in batches; ids above 2^53 stay exact; null sessions and levels are kept."""
    import datetime as dt

    from tidemark.operators.labels import with_passages

    day, base = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 10)
    minute = lambda m: base + dt.timedelta(minutes=m)
    bars = spark.createDataFrame([("A", day, minute(m), float(m), float(m) - 1) for m in range(200)], "symbol string, session_date date, ts timestamp, high double, low double")
    big = 2**53 + 1
    rows = [(big + 2 * m, "A", day, minute(m), float(m + 5)) for m in range(150)] + [(1, "A", None, minute(0), 5.0), (2, "A", day, minute(0), None)]
    obs = spark.createDataFrame(rows, "obs_id long, symbol string, session_date date, ts timestamp, level double")
    out = with_passages(obs, bars, ["symbol"], {"up": ("level", "up")})
    assert "FlatMapGroupsIn" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.obs_id: r.up for r in out.collect()}
    at = {big + 2 * m: int((minute(m + 5) - base).total_seconds() * 1e6) for m in range(150)}
    origin = got[big] - at[big]
    assert got == {k: v + origin for k, v in at.items()} | {1: None, 2: None}


def test_numbers_of_a_snapshot_are_read_once(spark):
    """The rule that rejects a record also reads its price and time; a filter on it must not read them again."""
    from tidemark.plans.sources import snapshot_lines
    from tidemark.sources.recordings import explode_feed, parse_snapshot

    plan = explode_feed(parse_snapshot(snapshot_lines(spark, SMALL))[0])._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("underlying_price" in line for line in filters)


def test_a_chain_moves_only_what_is_read(spark):
    from tidemark.plans import QUERIES, load

    load()
    plan = QUERIES["black_prices_and_greeks"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_tax" not in plan.split("Relation")[0] and "l_returnflag" not in plan.split("Relation")[0]


def test_horizons_share_rows_and_medians(spark, monkeypatch):
    """a horizon without null labels needs no medians of its own, the others get theirs; rows are written once."""
    from tidemark.operators import forecast as M

    rows = [(k, float(k % 7) if k % 5 else None, k % 3 == 0, k % 4 == 0, None if k % 6 else k % 12 == 0) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, a boolean, b boolean, c boolean").selectExpr("id", "x", "int(a) y_1", "int(b) y_2", "int(c) y_3")
    medians, writes = [], []
    exact, write = M.exact_medians, M.materialized
    monkeypatch.setattr(M, "exact_medians", lambda d, n: medians.append(d.count()) or exact(d, n))
    monkeypatch.setattr(M, "materialized", lambda d, n: writes.append(n) or write(d, n))
    out = M.fill_probability(df, df, ["x"], [1, 2, 3], "id")
    assert medians == [240, 40] and writes == ["fit-rows"]
    assert out.count() == 240 and out.filter("p_1 > p_2 OR p_2 > p_3").count() == 0


@pytest.mark.parametrize("values", [[float(k * k % 1009) for k in range(5000)], [1.0] * 4000 + [-3.0, 7.5, 8.0], [2.5], [float(k) for k in range(7)]])
def test_global_quantiles_rank_no_table(spark, monkeypatch, values):
    """exact quantiles from counts, without a rank of every row."""
    from tidemark.operators import fits, forecast as M

    monkeypatch.setattr(fits, "ranked", lambda *_: pytest.fail("every row was ranked"))
    taus = (0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = M.global_quantiles(spark.createDataFrame([(x,) for x in [*values, None]], "v double").repartition(3), taus)
    assert np.allclose(got, np.quantile(values, taus), rtol=1e-12)


def test_families_of_a_snapshot_need_no_further_shuffle(spark):
    """lines move by their snapshot, and no family moves them again by strike."""
    from __spark_entry__ import queries

    plan = queries()["structural_state"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert moves and not [line for line in moves if "strike" in line.split("hashpartitioning(")[1].split("),")[0]]
