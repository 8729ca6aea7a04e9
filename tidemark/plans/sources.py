"""Queries: recorded and vendor inputs, built as JSON lines from the given tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators.bars import merge_tick_bars
from tidemark.plans import adapters as A
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources import recordings as R
from tidemark.sources import vendor as V


def snapshot_lines(spark, sf):
    """orders ⋈ lineitem as snapshot JSON: every line a quote, one bar and one feed observation per line."""
    li = A.table(spark, sf, "lineitem")
    s = lambda c: c.cast("string")
    raw = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    quote = lambda r: F.struct(
        F.struct(
            F.format_string("k%d", r["l_linenumber"]).alias("contract_id"), F.when(r["l_linenumber"] % 2 == 0, "put").otherwise("call").alias("option_type"), s(r["l_quantity"]).alias("strike"),
            F.date_format(r["l_shipdate"], "yyyy-MM-dd").alias("expiration"),
        ).alias("contract"),
        s(F.round(r["l_extendedprice"] / 1000, 5)).alias("bid"), r["l_discount"].alias("gamma"), r["l_partkey"].alias("open_interest"),
    )
    bar = lambda r: F.struct(
        F.date_format(F.timestamp_seconds(F.unix_timestamp(r["l_shipdate"].cast("timestamp")) + r["l_linenumber"] * 60), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        *[s(r["l_quantity"]).alias(n) for n in ("open", "high", "low", "close")], r["l_suppkey"].alias("volume"),
    )
    feed = lambda r: F.struct(r["l_returnflag"].alias("component"), F.when(r["l_linestatus"] == "O", "LIVE").otherwise("STALE").alias("status"), r["l_tax"].alias("age_seconds"))
    arrays = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*raw))).alias("rows"))  # plain columns move, texts are made after
    o = A.table(spark, sf, "orders").join(arrays, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.col("o_orderdate").cast("timestamp")
    body = F.struct(
        s(F.col("o_orderkey")).alias("snapshot_id"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.date_format(day, "yyyy-MM-dd").alias("session_date"),
        F.lit("IDX").alias("underlying_symbol"), F.when(F.col("o_custkey") % 10 != 0, s(F.round("o_totalprice", 2).cast("decimal(18,2)"))).alias("underlying_price"),
        F.when(F.col("o_custkey") % 25 != 1, "OPEN").alias("session_status"),
        F.transform("rows", quote).alias("option_chain"), F.transform("rows", bar).alias("bars_1m"), F.transform("rows", feed).alias("feed_observations"),
    )
    return o.select("o_orderkey", F.to_json(body).alias("snapshot"))


GOOD = "o_custkey % 10 <> 0 AND o_custkey % 25 <> 1"


@query(
    "parse_snapshot",
    f"""SELECT o_orderkey::VARCHAR AS snapshot_id, o_orderdate::DATE::VARCHAR AS session_date, round(o_totalprice, 2) AS spot FROM orders WHERE {GOOD} AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def _(spark, sf):
    good, _bad = R.parse_snapshot(snapshot_lines(spark, sf))
    return good.select("snapshot_id", F.col("session_date").cast("string").alias("session_date"), F.round(F.col("spot").cast("double"), 2).alias("spot"))


@query(
    "parse_snapshot_rejects",
    f"""SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 10 = 0 THEN 'underlying_price' END, CASE WHEN o_custkey % 25 = 1 THEN 'session_status' END) AS missing
        FROM orders WHERE NOT ({GOOD}) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def _(spark, sf):
    _good, bad = R.parse_snapshot(snapshot_lines(spark, sf))
    return bad.select("o_orderkey", F.array_join("missing", ",").alias("missing"))


LINES = f"FROM (SELECT lineitem.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE {GOOD}"


@query(
    "explode_chain",
    f"SELECT l_orderkey::VARCHAR AS snapshot_id, pos, 'k' || l_linenumber AS contract_id, CASE WHEN l_linenumber % 2 = 0 THEN 'put' ELSE 'call' END AS side, l_quantity AS strike, round(l_extendedprice / 1000, 5) AS bid, l_partkey AS open_interest, l_shipdate::DATE::VARCHAR AS expiration {LINES}",
)
def _(spark, sf):
    c = R.explode_chain(R.parse_snapshot(snapshot_lines(spark, sf))[0])
    return c.select("snapshot_id", "pos", "contract_id", "side", "strike", "bid", "open_interest", F.col("expiration").cast("string").alias("expiration"))


@query("explode_bars", f"SELECT l_orderkey::VARCHAR AS snapshot_id, pos, (epoch(l_shipdate) + l_linenumber * 60)::BIGINT AS ts_sec, l_quantity AS close, l_suppkey AS volume {LINES}")
def _(spark, sf):
    b = R.explode_bars(R.parse_snapshot(snapshot_lines(spark, sf))[0])
    return b.select("snapshot_id", "pos", F.unix_timestamp("ts").alias("ts_sec"), "close", "volume")


@query("explode_feed", f"SELECT l_orderkey::VARCHAR AS snapshot_id, pos AS seq, l_returnflag AS component, CASE l_linestatus WHEN 'O' THEN 'LIVE' ELSE 'STALE' END AS status, l_tax AS age_seconds {LINES}")
def _(spark, sf):
    f = R.explode_feed(R.parse_snapshot(snapshot_lines(spark, sf))[0])
    return f.select("snapshot_id", "seq", "component", "status", "age_seconds")


@query(
    "recording_lines",
    """SELECT ts::DATE::VARCHAR AS session_date, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id::VARCHAR) - 1 AS seq, event_id::VARCHAR AS snapshot_id,
       'sha256:' || sha256(event_type || '|' || event_id) AS record_hash FROM events""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("snapshot_id"), F.to_date("ts").alias("session_date"), F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    r = R.to_records(e, F.concat_ws("|", "event_type", "snapshot_id"))
    return r.select(F.col("session_date").cast("string").alias("session_date"), "seq", "snapshot_id", "record_hash")


@query(
    "snapshot_identity",
    """SELECT event_id, 'sha256:' || sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","unknown":null}') AS content_hash,
       'snap-' || sha256('sha256:' || sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","unknown":null}'))[1:12] AS snapshot_id FROM events""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "event_type", F.lit(None).cast("string").alias("unknown"))
    return R.snapshot_identity(e, ["event_type", "event_id", "unknown"]).select("event_id", "content_hash", "snapshot_id")


@query("incremental_pending", "SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(spark, sf):
    done = A.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("snapshot_id"))
    return R.pending(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id")), done)


def vendor_texts(spark, sf):
    """events as vendor lines (pos, day, value): ticks with options and bars, settle lines for error events, NaN for unknown
    numbers, a broken line here and there."""
    e = A.table(spark, sf, "events")
    s = lambda c: c.cast("string")
    u, v = F.col("user_id"), F.round("value", 2)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spot = F.when(u % 10 == 0, "NaN").otherwise(s(v + 1))
    option = F.concat(
        F.lit('{"side":"'), F.when(u % 3 == 0, "call").when(u % 3 == 1, "put").otherwise("other"), F.lit('","strike":'), s(u + 1), F.lit(',"oi":'), s(u), F.lit(',"gamma":'),
        F.when(u % 7 == 0, "NaN").otherwise("0.05"), F.lit(',"delta":0.5,"bid":'), s(v), F.lit(',"ask":'), s(v + 1 - (u % 4 == 0).cast("int") * 2), F.lit(',"volume":-1,"dte_days":'), s(u % 3), F.lit("}"),
    )
    bar = F.concat(F.lit('["'), iso, F.lit('123+00:00","'), s(v + 1), F.lit('","'), s(v + 2), F.lit('","'), s(v), F.lit('","'), s(v + 1), F.lit('","'), s(u - 1), F.lit('"]'))
    tick = F.concat(F.lit('{"t":"tick","ts":"'), iso, F.lit('+00:00","market":{"spot":'), spot, F.lit(',"vix":'), s(v), F.lit(',"vvix":NaN},"option_rows":['), option, F.lit('],"bars":['), bar, F.lit("]}"))
    settle = F.concat(F.lit('{"t":"settle","date":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('","price":'), F.when(u % 4 == 0, "NaN").otherwise(s(v)), F.lit("}"))
    line = F.when(u % 50 == 49, F.lit("{broken")).when(F.col("event_type") == "error", settle).otherwise(tick)
    return e.select(F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd").alias("day"), line.alias("value"))


def vendor_lines(spark, sf):
    return V.parse_vendor_lines(vendor_texts(spark, sf).drop("day"))


TICK = "user_id % 50 <> 49 AND event_type <> 'error' AND user_id % 10 <> 0"


@query("vendor_snapshots", f"SELECT epoch_us(ts) AS micros, round(round(value, 2) + 1, 2) AS spot, CASE WHEN round(value, 2) > 0 THEN round(value, 2) END AS vix FROM events WHERE {TICK}")
def _(spark, sf):
    s = V.vendor_snapshots(vendor_lines(spark, sf))
    return s.select(F.unix_micros("ts").alias("micros"), F.round("spot", 2).alias("spot"), F.round("vix", 2).alias("vix"))


@query(
    "vendor_chain",
    f"""SELECT epoch_us(ts) AS micros, CASE user_id % 3 WHEN 0 THEN 'call' ELSE 'put' END AS side, (user_id + 1)::DOUBLE AS strike,
        'SPY' || strftime(((ts - INTERVAL 5 HOUR)::DATE + (user_id % 3)::INT), '%y%m%d') || CASE user_id % 3 WHEN 0 THEN 'C' ELSE 'P' END || lpad(((user_id + 1) * 1000)::VARCHAR, 8, '0') AS contract_id, user_id AS open_interest
        FROM events WHERE {TICK} AND user_id % 3 <> 2 AND user_id % 7 <> 0 AND round(value, 2) > 0 AND user_id % 4 <> 0""",
)
def _(spark, sf):
    c = V.vendor_chain(V.vendor_snapshots(vendor_lines(spark, sf)), symbol="SPY")
    return c.select(F.unix_micros("ts").alias("micros"), "side", "strike", "contract_id", F.col("open_interest").cast("bigint").alias("open_interest"))


@query("vendor_bars", f"SELECT epoch_us(ts) AS micros, round(round(value, 2) + 1, 2) AS close, (user_id - 1)::DOUBLE AS volume FROM events WHERE {TICK} AND round(value, 2) > 0 AND user_id >= 1")
def _(spark, sf):
    b = V.vendor_bars(V.vendor_snapshots(vendor_lines(spark, sf)), symbol="SPY")
    return b.select(F.unix_micros("ts").alias("micros"), F.round("close", 2).alias("close"), "volume")


@query("vendor_bar_window", f"SELECT count(*) AS n, min(m) AS first_micros FROM (SELECT epoch_us(ts) AS m FROM events WHERE {TICK} AND round(value, 2) > 0 AND user_id >= 1 ORDER BY ts DESC LIMIT 420)")
def _(spark, sf):
    b = merge_tick_bars(V.vendor_bars(V.vendor_snapshots(vendor_lines(spark, sf)), symbol="SPY"), keep=420)  # the window that a snapshot carries
    return b.agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first_micros"))


@query(
    "extract_settlements",
    """SELECT ts::DATE::VARCHAR AS date, arg_max(round(value, 2), event_id) AS settlement_price FROM events WHERE event_type = 'error' AND user_id % 50 <> 49 AND user_id % 4 <> 0 GROUP BY 1""",
)
def _(spark, sf):
    return V.extract_settlements(vendor_lines(spark, sf)).select("date", F.round("settlement_price", 2).alias("settlement_price"))


def sessions_existing(spark, sf):
    e = A.table(spark, sf, "events").select(F.to_date("ts").alias("session_date"), "event_id", "user_id")
    src = e.select("session_date", "event_id")
    have = e.filter(F.dayofmonth("session_date") % 3 == 0).select(
        "session_date", F.when((F.dayofmonth("session_date") % 2 == 0) & (F.col("event_id") % 9 == 0), F.array(F.lit("live"))).otherwise(F.array(F.lit(V.IMPORTED))).alias("flags")
    )
    return src, have


@query("import_sessions", "SELECT ts::DATE::VARCHAR AS session_date, count(*) AS n FROM events WHERE NOT (day(ts) % 3 = 0 AND day(ts) % 2 = 0) GROUP BY 1")
def _(spark, sf):
    rows, _skipped = V.import_sessions(*sessions_existing(spark, sf), overwrite=True)
    return rows.groupBy(F.col("session_date").cast("string").alias("session_date")).agg(F.count(F.lit(1)).alias("n"))


@query("import_sessions_skipped", "SELECT DISTINCT ts::DATE::VARCHAR AS session_date, 'already imported' AS reason FROM events WHERE day(ts) % 3 = 0")
def _(spark, sf):
    return V.import_sessions(*sessions_existing(spark, sf))[1].withColumn("session_date", F.col("session_date").cast("string"))


@query(
    "adapt_legacy_snapshot",
    """SELECT o_orderkey::VARCHAR AS snapshot_id, c AS component, CASE c WHEN 'spot' THEN 'LIVE' WHEN 'option_chain' THEN CASE WHEN o_custkey % 2 = 0 THEN 'INVALID' ELSE 'STALE' END ELSE 'MISSING' END AS status,
       CASE c WHEN 'bars' THEN (o_custkey % 100)::DOUBLE END AS age_seconds FROM orders, (SELECT unnest(['spot', 'option_chain', 'bars']) AS c) WHERE o_custkey % 10 <> 0""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    c = F.col("o_custkey")
    body = F.struct(
        F.col("o_orderkey").cast("string").alias("snapshot_id"), F.when(c % 10 != 0, "IDX").alias("symbol"), F.lit("2024-01-02T15:00:00+00:00").alias("ts"),
        F.create_map(F.lit("spot"), F.col("o_totalprice").cast("string")).alias("market"),
        F.create_map(F.lit("SPOT"), F.lit("live"), F.lit("chain"), F.when(c % 2 == 0, "odd").otherwise(" stale ")).alias("feed_statuses"), F.create_map(F.lit("bars"), (c % 100).cast("double")).alias("source_ages_seconds"),
    )
    _snaps, feed = V.adapt_legacy(o.select(F.to_json(body).alias("value")))
    return feed.select("snapshot_id", "component", "status", r6("age_seconds", "age_seconds"))


def vendor_archive(spark, sf):
    """The vendor lines written as gzip files, a folder per day."""
    folder = shared_folder(spark, "vendor-archive")
    vendor_texts(spark, sf).hint("rebalance", "day").select("value", "day").write.partitionBy("day").option("compression", "gzip").text(folder)
    return folder


@query(
    "read_vendor_ticks",
    """SELECT ts::DATE::VARCHAR AS session, count(*) AS n_lines, count(*) FILTER (user_id % 50 = 49) AS n_malformed,
       count(*) FILTER (user_id % 50 <> 49 AND event_type <> 'error') AS n_ticks, count(*) FILTER (user_id % 50 <> 49 AND event_type = 'error') AS n_settles FROM events GROUP BY 1""",
)
def _(spark, sf):
    t = V.read_vendor_ticks(spark, vendor_archive(spark, sf))
    return t.groupBy(F.col("file_session").alias("session")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("malformed").alias("n_malformed"), F.count_if(F.col("t") == "tick").alias("n_ticks"), F.count_if(F.col("t") == "settle").alias("n_settles")
    )


@query(
    "import_archive",
    f"""WITH e AS (SELECT (ts - INTERVAL 5 HOUR)::DATE AS d, value FROM events WHERE {TICK})
        SELECT d::VARCHAR AS session_date, count(*) AS n, CASE WHEN day(d) % 7 = 0 THEN count(*) ELSE 0 END AS n_live, round(sum(round(value, 2) + 1), 2) AS sum_spot,
               CASE WHEN day(d) % 7 = 0 THEN 'holds live records; not overwritten' END AS refused FROM e GROUP BY d""",
)
def _(spark, sf):
    """Live records stand for every seventh day of a month; the archive is imported, then twice more with overwrite."""
    source, target = vendor_archive(spark, sf), shared_folder(spark, "vendor-import")
    live = V.vendor_snapshots(V.read_vendor_ticks(spark, source)).filter(F.dayofmonth("session_date") % 7 == 0)
    live.withColumn("flags", F.array(F.lit("live"))).write.partitionBy("session_date").parquet(target)
    V.import_archive(spark, source, target)
    V.import_archive(spark, source, target, overwrite=True)
    refused = V.import_archive(spark, source, target, overwrite=True)
    kept = spark.read.parquet(target).groupBy("session_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("flags", "live")).alias("n_live"), F.round(F.sum("spot"), 2).alias("sum_spot")
    )
    return kept.join(refused.withColumnRenamed("reason", "refused"), "session_date", "left").withColumn("session_date", F.col("session_date").cast("string"))


@query(
    "read_recording",
    """SELECT ts::DATE::VARCHAR AS session, count(*) AS n, count(*) FILTER (user_id % 20 <> 0) AS n_parsed, count(*) FILTER (user_id % 20 = 0) AS n_rejected,
       max(CASE WHEN user_id % 20 <> 0 THEN event_id END) AS last_id FROM events GROUP BY 1""",
)
def _(spark, sf):
    """events recorded as snapshots, lines of every twentieth user cut short, read back with their hashes recomputed."""
    e = A.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("snapshot_id"), F.to_date("ts").alias("session_date"), F.col("ts").cast("timestamp").alias("ts"),
        F.to_json(F.struct("event_type", "value", "user_id")).alias("body"),
    )
    records, folder = R.to_records(e, F.col("body")), shared_folder(spark, "recordings")
    text = F.to_json(F.struct(*[c for c in records.columns if c != "session_date"]))
    cut = F.get_json_object("snapshot", "$.user_id").cast("long") % 20 == 0
    records.select("session_date", F.when(cut, F.left(text, F.length(text) - 9)).otherwise(text).alias("value")).hint("rebalance", "session_date").write.partitionBy("session_date").text(folder)
    back = R.read_recording(spark, folder)
    sound = F.col("parsed") & (F.concat(F.lit("sha256:"), F.sha2("payload", 256)) == F.col("record_hash"))
    return back.groupBy(F.col("session_file").alias("session")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sound).alias("n_parsed"), F.count_if(~F.col("parsed")).alias("n_rejected"),
        F.max(F.when(sound, F.col("snapshot_id").cast("long"))).alias("last_id"),
    )


@query(
    "stage_artifacts",
    """SELECT o_orderdate::DATE::VARCHAR AS session, o_orderpriority AS stage, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL""",
)
def _(spark, sf):
    """Two stages appended in two passes each, read back by stage."""
    o = A.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", "o_orderkey", "o_totalprice")
    root = shared_folder(spark, "artifacts")
    stages = ("1-URGENT", "2-HIGH")
    for stage in stages:
        mine = o.filter(F.col("o_orderpriority") == stage).drop("o_orderpriority")
        for odd in (0, 1):
            R.append_artifacts(mine.filter(F.col("o_orderkey") % 2 == odd).hint("rebalance", "month"), root, stage, "month")
    back = [R.read_artifacts(spark, root, stage, session="month").withColumn("stage", F.lit(stage)) for stage in stages]
    return back[0].unionByName(back[1]).groupBy(F.col("d").cast("string").alias("session"), "stage").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "load_experience",
    """SELECT ts::DATE::VARCHAR AS session_date, count(*) AS n, round(sum(CASE WHEN user_id % 4 <> 0 THEN round(value, 2) END), 2) AS realized, count(*) FILTER (event_type = 'error') AS n_errors,
       round(sum(round(value, 2) * 2), 2) AS counterfactual FROM events GROUP BY 1""",
)
def _(spark, sf):
    """events written as experience files (packet text, outcome, outcomes per candidate) and loaded again."""
    e = A.table(spark, sf, "events")
    v = F.round("value", 2)
    rows = e.select(
        F.col("event_id").cast("string").alias("snapshot_id"), F.date_format("ts", "yyyy-MM-dd").alias("session_date"), F.to_json(F.struct("user_id", "event_type")).alias("packet"),
        F.when(F.col("user_id") % 4 != 0, v).alias("realized_pnl"), F.create_map(F.lit("kind"), F.col("event_type")).alias("labels"),
        F.create_map(F.lit("a"), v, F.lit("b"), v * 2).alias("realized_pnl_by_candidate"),
    )
    folder = shared_folder(spark, "experience")
    rows.write.option("compression", "gzip").json(folder)
    x = V.load_experience(spark, folder)
    return x.groupBy("session_date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("realized_pnl"), 2).alias("realized"), F.count_if(F.col("labels")["kind"] == "error").alias("n_errors"),
        F.round(F.sum(F.col("realized_pnl_by_candidate")["b"]), 2).alias("counterfactual"),
    )
