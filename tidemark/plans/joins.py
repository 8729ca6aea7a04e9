"""Queries: as-of, outcome, parity and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import joins as J
from tidemark.plans import adapters as A
from tidemark.plans.registry import query


@query(
    "asof_guard",
    """SELECT event_type, count(*) FILTER (value <= 60) AS ok, count(*) FILTER (value > 60) AS violations,
       round(sum(60 - value) FILTER (value <= 60), 4) AS total_age FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    rows = e.select(
        "event_type", ts.alias("source_ts"),
        F.timestamp_micros(F.unix_micros(ts) + F.round((60 - F.col("value")) * 1e6).cast("bigint")).alias("obs_ts"),
    )
    good, bad = J.asof_guard(rows)
    g = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("ok"), F.round(F.sum("age_seconds"), 4).alias("total_age"))
    return g.join(bad.groupBy("event_type").agg(F.count(F.lit(1)).alias("violations")), "event_type")


@query(
    "asof_latest",
    A.sql(
        """SELECT e.event_id, round(b.close, 6) AS asof_close, epoch(b.ts)::BIGINT AS source_sec FROM events e
           ASOF LEFT JOIN v_bars30 b ON e.event_type = b.symbol AND e.ts >= b.ts""",
        "v_bars30",
    ),
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    j = J.asof_latest(e, A.bars(spark, sf), ["symbol"], ["close"])
    return j.select("event_id", r6("asof_close", "asof_close"), F.unix_timestamp("source_ts").alias("source_sec"))


@query(
    "bars_asof",
    A.sql(
        """SELECT e.event_id, count(b.ts) AS n_bars FROM events e LEFT JOIN v_bars30 b ON e.event_type = b.symbol AND b.session_date = e.ts::DATE AND b.ts <= e.ts GROUP BY 1""",
        "v_bars30",
    ),
)
def _(spark, sf):
    # bars up to the observation, counted as a running window over the merged axis of one (symbol, session)
    from pyspark.sql import Window

    e = A.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.to_date("ts").alias("session_date"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )
    both = A.bars(spark, sf).select("symbol", "session_date", "ts", F.lit(1).alias("is_bar")).unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy("symbol", "session_date").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("n_bars", F.count("is_bar").over(w)).filter(F.col("event_id").isNotNull()).select("event_id", "n_bars")


@query(
    "asof_feature_row",
    """SELECT event_id, round(((value <= 100)::INT + (user_id % 4 <> 0)::INT + 1) / 3.0, 6) AS coverage,
       CASE WHEN value > 100 THEN 'spot' ELSE '' END AS violations, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS gex_missing FROM events""",
)
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    e = A.table(spark, sf, "events").select(
        "event_id", ts.alias("ts"), "value",
        F.when(F.col("value") > 100, ts + F.expr("INTERVAL 1 SECOND")).otherwise(ts).alias("spot_ts"),
        F.when(F.col("user_id") % 4 == 0, float("nan")).otherwise(1.5).alias("gex"),
    )
    rows = J.asof_feature_row(e, {"spot": ("value", "spot_ts"), "gex": ("gex", "ts"), "flag": ("event_id", "ts")})
    return rows.select(
        "event_id", "coverage", F.array_join("violations", ",").alias("violations"), F.col("missingness")["gex"].alias("gex_missing")
    )


def decisions(spark, sf):
    """One decision per event: snapshot = user, candidate = event type."""
    return A.table(spark, sf, "events").select(
        F.col("event_id").alias("decision_id"),
        F.col("user_id").cast("string").alias("snapshot_id"),
        F.when(F.col("event_type") == "error", "ABSTAIN").when(F.col("event_type") == "view", "SELECT_CANDIDATE").otherwise("TRADE").alias("action"),
        F.when(F.col("value") > 5, F.col("event_type")).otherwise("none").alias("candidate_id"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.when(F.col("value") % 2 < 1, " UP ").otherwise("bearish").alias("direction"),
        F.when(F.col("event_id") % 2 == 0, "champion").otherwise("challenger").alias("authority"),
    )


def outcomes(spark, sf):
    """One outcome per order (several per snapshot; the last wins)."""
    o = A.table(spark, sf, "orders")
    pnl = F.col("o_totalprice") / 1000 - 250
    return o.select(
        (F.col("o_custkey") % 150).cast("string").alias("snapshot_id"),
        F.to_date("o_orderdate").alias("session_date"),
        F.when(F.col("o_custkey") % 9 != 0, pnl).alias("realized_pnl"),
        F.when(pnl > 0, "bull").otherwise("bear").alias("true_direction"),
        F.create_map(
            F.lit("view"), pnl + 5, F.lit("click"), pnl - F.col("o_custkey") % 10, F.lit("purchase"), -pnl
        ).alias("pnl_by_candidate"),
        F.col("o_orderkey").alias("seq"),
    )


DECIDED = """WITH d AS (SELECT event_id AS decision_id, user_id AS sid, CASE event_type WHEN 'error' THEN 'ABSTAIN' WHEN 'view' THEN 'SELECT_CANDIDATE' ELSE 'TRADE' END AS action,
        CASE WHEN value > 5 THEN event_type ELSE 'none' END AS cand, least(value / 100, 1.0) AS confidence, CASE WHEN value % 2 < 1 THEN 'bullish' ELSE 'bearish' END AS dir,
        CASE WHEN event_id % 2 = 0 THEN 'champion' ELSE 'challenger' END AS authority FROM events),
  o AS (SELECT sid, session_date, pnl, p AS raw, ck FROM (SELECT o_custkey % 150 AS sid, o_orderdate::DATE AS session_date, o_totalprice / 1000 - 250 AS p, o_custkey AS ck,
          CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice / 1000 - 250 END AS pnl, row_number() OVER (PARTITION BY o_custkey % 150 ORDER BY o_orderkey DESC) AS r FROM orders)
        WHERE r = 1 AND pnl IS NOT NULL),
  j AS (SELECT d.*, session_date, CASE cand WHEN 'view' THEN raw + 5 WHEN 'click' THEN raw - ck % 10 WHEN 'purchase' THEN -raw ELSE pnl END AS pnl,
          greatest(raw + 5, raw - ck % 10, -raw) AS best, (CASE WHEN raw > 0 THEN 'bullish' ELSE 'bearish' END = dir) AS hit, cand IN ('view', 'click', 'purchase') AS known
        FROM d JOIN o USING (sid) WHERE action <> 'ABSTAIN')"""


@query(
    "decisions_with_outcomes",
    DECIDED + """ SELECT decision_id, session_date::VARCHAR AS session_date, round(pnl, 6) AS pnl, (pnl > 0)::INT AS win, hit::INT AS direction_hit,
      round(CASE WHEN known THEN best - pnl ELSE greatest(best, 0) END, 6) AS regret FROM j""",
)
def _(spark, sf):
    m = J.decisions_with_outcomes(decisions(spark, sf), outcomes(spark, sf))
    return m.select(
        "decision_id", F.col("session_date").cast("string").alias("session_date"), r6("pnl", "pnl"),
        F.col("win").cast("int").alias("win"), F.col("direction_hit").cast("int").alias("direction_hit"), r6("regret", "regret"),
    )


@query(
    "prefer_outcomes",
    """SELECT o_orderkey AS snapshot_id, 'provider' AS origin FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT DISTINCT l_orderkey, 'embedded' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(spark, sf):
    provider = A.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("snapshot_id"))
    embedded = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("snapshot_id")).distinct()
    return J.prefer_outcomes(provider, embedded)


@query(
    "settle_only_journaled",
    "SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def _(spark, sf):
    cands = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"))
    j = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.when(F.col("l_returnflag") == "R", "candidates_generated").otherwise("other").alias("event_type"),
    )
    return J.only_journaled(cands, j)


@query(
    "reconcile_positions",
    """WITH a AS (SELECT o_orderkey AS id, o_custkey % 6 AS acc, 1 + o_custkey % 3 AS q FROM orders WHERE o_orderkey % 7 <> 0),
       b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 101 = 0 THEN 99 ELSE o_custkey % 6 END AS acc, 1 + o_custkey % 3 + (o_orderkey % 55 = 0)::INT AS q FROM orders WHERE o_orderkey % 11 <> 0)
       SELECT coalesce(a.id, b.id) AS position_id, CASE WHEN b.q IS NULL THEN 'missing_position' WHEN a.q IS NULL THEN 'orphan_position' WHEN a.acc <> b.acc THEN 'cross_account' ELSE 'quantity_mismatch' END AS issue
       FROM a FULL JOIN b USING (id) WHERE a.q IS NULL OR b.q IS NULL OR a.acc <> b.acc OR a.q <> b.q""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    local = o.filter(k % 7 != 0).select(
        k.alias("position_id"), (F.col("o_custkey") % 6).alias("account_id"), (1 + F.col("o_custkey") % 3).alias("quantity")
    )
    broker = o.filter(k % 11 != 0).select(
        k.alias("position_id"), F.when(k % 101 == 0, 99).otherwise(F.col("o_custkey") % 6).alias("account_id"),
        (1 + F.col("o_custkey") % 3 + (k % 55 == 0).cast("int")).alias("quantity"),
    )
    return J.reconcile_positions(local, broker).select("position_id", "issue")


@query(
    "reconcile_cash",
    """SELECT c_custkey AS account_id, round(c_acctbal, 2) AS ledger_cash FROM customer WHERE c_custkey % 5 = 0""",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer")
    cash = F.round("c_acctbal", 2).cast("decimal(18,6)")
    ledger = c.select(F.col("c_custkey").alias("account_id"), cash.alias("cash"))
    statement = c.select(
        F.col("c_custkey").alias("account_id"),
        (cash + F.when(F.col("c_custkey") % 5 == 0, F.lit("0.02")).otherwise("0.01").cast("decimal(18,6)")).alias("cash"),
    )
    return J.reconcile_cash(ledger, statement).select("account_id", F.col("ledger_cash").cast("double").alias("ledger_cash"))


@query(
    "decision_parity",
    """WITH l AS (SELECT o_orderkey AS id, o_orderstatus AS action, o_orderpriority AS pick FROM orders WHERE o_orderkey % 10 <> 0),
       r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 20 = 0 THEN 'X' ELSE o_orderstatus END AS action, o_orderpriority AS pick FROM orders WHERE o_orderkey % 9 <> 0),
       j AS (SELECT coalesce(l.id, r.id) AS id, coalesce(l.action, '') AS la, coalesce(r.action, '') AS ra, coalesce(l.pick, '') AS lp, coalesce(r.pick, '') AS rp FROM l FULL JOIN r USING (id))
       SELECT id AS snapshot_id, 'action' AS field, la AS live, ra AS replay FROM j WHERE la <> ra UNION ALL SELECT id, 'pick', lp, rp FROM j WHERE lp <> rp""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    live = o.filter(k % 10 != 0).select(k.alias("snapshot_id"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("pick"))
    replay = o.filter(k % 9 != 0).select(
        k.alias("snapshot_id"), F.when(F.col("o_custkey") % 20 == 0, "X").otherwise(F.col("o_orderstatus")).alias("action"),
        F.col("o_orderpriority").alias("pick"),
    )
    return J.decision_parity(live, replay, ["action", "pick"])


@query(
    "revenge_trades",
    """WITH x AS (SELECT ts::DATE AS d, ts AS exit_at FROM events WHERE event_type = 'error' AND value > 40),
       n AS (SELECT event_id, ts::DATE AS d, ts FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 = 0)
       SELECT event_id FROM n WHERE EXISTS (SELECT 1 FROM x WHERE x.d = n.d AND x.exit_at <= n.ts AND n.ts <= x.exit_at + INTERVAL 900 SECOND)""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("session_date", F.to_date("ts"))
    exits = e.filter("event_type = 'error'").select("session_date", F.col("ts").alias("exit_at"), (40 - F.col("value")).alias("pnl"))
    entries = e.filter("event_type in ('click', 'view')").select(
        "event_id", "session_date", F.col("ts").alias("entry_at"), (F.col("user_id") % 3 != 0).alias("approved")
    )
    return J.revenge_trades(exits, entries).select("event_id")
