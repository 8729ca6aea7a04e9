"""Queries: feed freshness, data quality, session calendar, vetoes and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import calendar as K
from tidemark.operators import quality as Q
from tidemark.plans import adapters as A
from tidemark.plans.registry import query

NEED = ("click", "view", "purchase", "signup")

STATUS_SQL = """CASE WHEN age_seconds IS NULL THEN CASE WHEN fallback_used THEN 'FALLBACK' ELSE 'DELAYED' END
    WHEN age_seconds < 0 THEN 'INVALID' WHEN age_seconds > 60 THEN 'STALE' WHEN age_seconds > 20 THEN 'DELAYED'
    WHEN fallback_used THEN 'FALLBACK' ELSE 'LIVE' END"""
S = f"WITH s AS (SELECT *, {STATUS_SQL} AS status FROM v_feed)"


def status(spark, sf):
    return Q.with_status(A.feeds(spark, sf))


@query("feed_age", "SELECT event_id, round(epoch(ts) - epoch(date_trunc('minute', ts)), 6) AS age FROM events")
def _(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("received_at"))
    e = e.withColumn("observed_at", F.date_trunc("minute", "received_at"))
    return e.select("event_id", r6(Q.feed_age(), "age"))


@query("classify_feed", A.sql(S + " SELECT component, status, count(*) AS n FROM s GROUP BY ALL", "v_feed"))
def _(spark, sf):
    return status(spark, sf).groupBy("component", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "classify_heartbeat",
    """SELECT event_type, CASE WHEN user_id % 19 = 0 THEN 'unknown' WHEN user_id % 4 = 0 OR value <= user_id % 4 * 20
         THEN 'ok' WHEN value <= user_id % 4 * 60 THEN 'late' ELSE 'stale' END AS health, count(*) AS n
       FROM events GROUP BY ALL""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events")
    age = F.when(F.col("user_id") % 19 != 0, F.col("value"))
    return e.groupBy("event_type", Q.classify_heartbeat(age, F.col("user_id") % 4 * 20).alias("health")).agg(
        F.count(F.lit(1)).alias("n")
    )


QUALITY_SQL = S + """,
  last AS (SELECT snapshot_id, component, arg_max(status, seq) AS st FROM s GROUP BY ALL),
  need AS (SELECT unnest(['click', 'view', 'purchase', 'signup']) AS component),
  ids AS (SELECT DISTINCT snapshot_id FROM s),
  miss AS (SELECT i.snapshot_id, n.component, CASE n.component WHEN 'click' THEN 1 WHEN 'view' THEN 2
                  WHEN 'purchase' THEN 3 ELSE 4 END AS o
           FROM ids i CROSS JOIN need n LEFT JOIN last l ON l.snapshot_id = i.snapshot_id AND l.component = n.component
           WHERE l.st IS NULL OR l.st IN ('MISSING', 'INVALID')),
  m AS (SELECT snapshot_id, count(*) AS n_missing, string_agg(component, ',' ORDER BY o) AS missing FROM miss GROUP BY 1),
  live AS (SELECT snapshot_id, count(*) FILTER (st = 'LIVE' AND component IN (SELECT component FROM need)) AS n
           FROM last GROUP BY 1),
  deg AS (SELECT snapshot_id, count(*) AS n_deg, string_agg(DISTINCT component || ':' || status, ',' ORDER BY component || ':' || status) AS tags
          FROM s WHERE status IN ('STALE', 'DELAYED') GROUP BY 1)"""


@query(
    "snapshot_is_live",
    A.sql(QUALITY_SQL + " SELECT snapshot_id, (n = 4)::INT AS is_live FROM live", "v_feed"),
)
def _(spark, sf):
    return Q.snapshot_quality(status(spark, sf), NEED).select("snapshot_id", F.col("is_live").cast("int").alias("is_live"))


@query(
    "missing_components",
    A.sql(QUALITY_SQL + " SELECT i.snapshot_id, coalesce(missing, '') AS missing FROM ids i LEFT JOIN m USING (snapshot_id)", "v_feed"),
)
def _(spark, sf):
    return Q.snapshot_quality(status(spark, sf), NEED).select(
        "snapshot_id", F.array_join("missing_components", ",").alias("missing")
    )


@query(
    "data_quality",
    A.sql(
        QUALITY_SQL + """ SELECT i.snapshot_id, round(least(1.0, 0.5 * coalesce(n_missing, 0) + 0.1 * coalesce(n_deg, 0)), 6) AS penalty,
        (n_missing IS NULL)::INT AS is_healthy,
        concat_ws(',', CASE WHEN missing IS NOT NULL THEN 'missing:' || replace(missing, ',', ',missing:') END, tags) AS flags
        FROM ids i LEFT JOIN m USING (snapshot_id) LEFT JOIN deg USING (snapshot_id)""",
        "v_feed",
    ),
)
def _(spark, sf):
    return Q.snapshot_quality(status(spark, sf), NEED).select(
        "snapshot_id", r6("penalty", "penalty"), F.col("is_healthy").cast("int").alias("is_healthy"),
        F.array_join("flags", ",").alias("flags"),
    )


@query(
    "stale_feed_audit",
    A.sql(S + " SELECT status, count(*) AS n FROM s GROUP BY 1", "v_feed"),
)
def _(spark, sf):
    feed = status(spark, sf)
    return Q.stale_feed_audit(feed, Q.snapshot_quality(feed, NEED))[0]


@query(
    "laundered_snapshots",
    A.sql(
        S + """ SELECT snapshot_id FROM s GROUP BY 1
        HAVING bool_or(status IN ('STALE', 'DELAYED', 'MISSING', 'INVALID')) AND 0.1 * count(*) FILTER (status IN ('STALE', 'DELAYED')) < 0.3""",
        "v_feed",
    ),
)
def _(spark, sf):
    feed = status(spark, sf)
    # a lenient quality rule that forgives up to two degraded feeds, audited against the strict statuses
    lenient = feed.groupBy("snapshot_id").agg(
        F.when(F.count_if(F.col("status").isin("STALE", "DELAYED")) < 3, 0.0).otherwise(1.0).alias("penalty")
    )
    return Q.stale_feed_audit(feed, lenient)[1].select("snapshot_id")


@query(
    "provider_failover",
    A.sql(
        S + """, d AS (SELECT snapshot_id, component,
              first(provider ORDER BY attempt_order, seq) FILTER (ok) AS provider,
              first(attempt_order ORDER BY attempt_order, seq) FILTER (ok) AS ord,
              first(age_seconds ORDER BY attempt_order, seq) FILTER (ok) AS age_seconds
            FROM (SELECT *, age_seconds >= 0 AS ok FROM s) GROUP BY ALL)
        SELECT snapshot_id, component, provider, coalesce(ord > 0, false)::INT AS fallback_used,
          CASE WHEN provider IS NULL THEN 'MISSING' WHEN age_seconds > 60 THEN 'STALE' WHEN age_seconds > 20 THEN 'DELAYED'
               WHEN ord > 0 THEN 'FALLBACK' ELSE 'LIVE' END AS status FROM d""",
        "v_feed",
    ),
)
def _(spark, sf):
    f = A.feeds(spark, sf).withColumn("has_data", F.coalesce(F.col("age_seconds") >= 0, F.lit(False)))
    return Q.failover(f).withColumn("fallback_used", F.col("fallback_used").cast("int"))


# -- sessions --------------------------------------------------------------------------------------------------
def sessions(spark, sf):
    """Weekdays of the tape as sessions; every tenth day of the month closes early."""
    d = A.table(spark, sf, "events").select(F.to_date("ts").alias("session_date")).distinct()
    start = F.col("session_date").cast("timestamp")
    half = F.dayofmonth("session_date") % 10 == 0
    return d.filter(F.weekday("session_date") < 5).select(
        "session_date",
        (start + F.expr("INTERVAL 570 MINUTE")).alias("session_open"),
        F.when(half, start + F.expr("INTERVAL 780 MINUTE")).otherwise(start + F.expr("INTERVAL 960 MINUTE")).alias(
            "session_close"
        ),
    )


SESSION_SQL = """
  WITH e AS (SELECT event_id, ts, ts::DATE AS d, (isodow(ts) <= 5) AS is_s,
        ts::DATE::TIMESTAMP + INTERVAL 570 MINUTE AS o,
        ts::DATE::TIMESTAMP + CASE WHEN day(ts) % 10 = 0 THEN INTERVAL 780 MINUTE ELSE INTERVAL 960 MINUTE END AS c
        FROM events)"""


def observations(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))


@query(
    "session_status",
    SESSION_SQL + """ SELECT event_id, CASE WHEN NOT is_s THEN 'HOLIDAY' WHEN ts < o THEN 'PRE_OPEN' WHEN ts >= c THEN 'CLOSED'
      ELSE 'OPEN' END AS session_status,
      CASE WHEN is_s AND ts >= o THEN floor(epoch(ts - o) / 60)::INT END AS minutes_from_open,
      CASE WHEN is_s AND ts <= c THEN floor(epoch(c - ts) / 60)::INT END AS minutes_to_close,
      (is_s AND day(ts) % 10 = 0)::INT AS is_half_day,
      coalesce(CASE WHEN is_s AND ts <= c THEN floor(epoch(c - ts) / 60) <= 15 END, true)::INT AS in_entry_lockout,
      (is_s AND ts >= c)::INT AS settlement_available FROM e""",
)
def _(spark, sf):
    s = K.session_status(observations(spark, sf), sessions(spark, sf), tz=None)
    return s.select(
        "event_id", "session_status", "minutes_from_open", "minutes_to_close",
        *[F.col(b).cast("int").alias(b) for b in ("is_half_day", "in_entry_lockout", "settlement_available")],
    )


@query(
    "session_metadata",
    SESSION_SQL + """ SELECT event_id, d::VARCHAR AS session_date, is_s::INT AS is_session,
      CASE WHEN is_s THEN (day(ts) % 10 = 0)::INT END AS is_early_close,
      CASE WHEN is_s AND ts >= o THEN floor(epoch(ts - o) / 60)::DOUBLE END AS minutes_since_open,
      CASE WHEN is_s AND ts <= c THEN floor(epoch(c - ts) / 60)::DOUBLE END AS minutes_to_close,
      (isodow(ts) - 1)::INT AS day_of_week FROM e""",
)
def _(spark, sf):
    m = K.session_metadata(observations(spark, sf), sessions(spark, sf), tz=None)
    return m.select(
        "event_id", F.col("session_date").cast("string").alias("session_date"),
        F.col("is_session").cast("int").alias("is_session"), F.col("is_early_close").cast("int").alias("is_early_close"),
        "minutes_since_open", "minutes_to_close", "day_of_week",
    )


@query(
    "lockout_state",
    """SELECT event_id, concat_ws(',', CASE WHEN m < 600 THEN 'session_warmup' END, CASE WHEN m >= 930 THEN 'entry_cutoff' END,
         CASE WHEN event_type = 'purchase' THEN 'catalyst_lockout' END, CASE WHEN user_id % 50 = 0 THEN 'emergency_lockout' END,
         CASE WHEN user_id % 7 = 0 THEN 'market_closed' END) AS reasons,
         (m >= 930 OR user_id % 50 = 0)::INT AS entry_locked
       FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "purchase").alias("catalyst_active"),
        (F.col("user_id") % 50 == 0).alias("emergency_lockout"),
        (F.col("user_id") % 7 != 0).alias("market_open"),
    )
    return K.lockout_state(e, tz=None).select(
        "event_id", F.array_join("reasons", ",").alias("reasons"), F.col("entry_locked").cast("int").alias("entry_locked")
    )


@query(
    "operational_vetoes",
    A.sql(
        """
    WITH k AS (SELECT snapshot_id, count(*) AS contracts_total, count(DISTINCT strike) AS strikes_total,
           bool_or(side = 'call') AS has_calls, bool_or(side = 'put') AS has_puts, sum(volume)::BIGINT AS v
         FROM v_chain GROUP BY 1),
    x AS (SELECT *, ['OPEN', 'CLOSED', 'PRE_OPEN', 'OPEN', 'HOLIDAY'][1 + v % 5] AS session_status,
           ['LIVE', 'STALE', 'DELAYED'][1 + v % 3] AS spot_status, ['FALLBACK', 'MISSING', NULL][1 + v % 3] AS bars_status,
           ['LIVE', 'LIVE', 'STALE', 'INVALID'][1 + v % 4] AS chain_status, v % 6 = 0 AS catalyst_active,
           (v % 40)::INT AS minutes_to_close FROM k)
    SELECT snapshot_id, concat_ws(',',
       CASE WHEN session_status IN ('CLOSED', 'HOLIDAY') THEN 'SESSION_CLOSED' END,
       CASE WHEN spot_status = 'STALE' THEN 'STALE_DATA' END,
       CASE WHEN bars_status IS NULL OR bars_status = 'MISSING' THEN 'STALE_DATA' END,
       CASE WHEN chain_status IN ('STALE', 'INVALID') THEN 'MISSING_CHAIN' END,
       CASE WHEN NOT (has_calls AND has_puts) THEN 'INVALID_SURFACE' WHEN strikes_total < 17 THEN 'INSUFFICIENT_LIQUIDITY' END,
       CASE WHEN catalyst_active THEN 'CATALYST_LOCKOUT' END,
       CASE WHEN session_status = 'PRE_OPEN' THEN 'SESSION_CLOSED' WHEN minutes_to_close <= 15 THEN 'ENTRY_CUTOFF' END) AS vetoes
    FROM x""",
        "v_chain",
    ),
)
def _(spark, sf):
    from tidemark.operators.chain import chain_coverage

    ch = A.chain(spark, sf)
    v = ch.groupBy("snapshot_id").agg(F.sum("volume").alias("v"))
    pick = lambda vals: F.element_at(F.array(*[F.lit(x) for x in vals]), (F.col("v") % len(vals) + 1).cast("int"))
    snap = chain_coverage(ch).join(v, "snapshot_id").select(
        "*",
        pick(["OPEN", "CLOSED", "PRE_OPEN", "OPEN", "HOLIDAY"]).alias("session_status"),
        pick(["LIVE", "STALE", "DELAYED"]).alias("spot_status"),
        pick(["FALLBACK", "MISSING", None]).alias("bars_status"),
        pick(["LIVE", "LIVE", "STALE", "INVALID"]).alias("chain_status"),
        (F.col("v") % 6 == 0).alias("catalyst_active"),
        (F.col("v") % 40).cast("int").alias("minutes_to_close"),
    )
    return Q.operational_vetoes(snap, min_strikes=17).select("snapshot_id", F.array_join("vetoes", ",").alias("vetoes"))


# -- row validation --------------------------------------------------------------------------------------------
@query(
    "validate_fill_records",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 97 = 0 THEN 'fill_record_id_required' END,
       CASE WHEN o_custkey % 89 = 0 THEN 'identity_required' END, CASE WHEN src = 'unknown' THEN 'unknown_source' END,
       CASE WHEN mode = 'live' THEN 'unknown_mode' END,
       CASE WHEN src = 'broker_actual' AND o_orderkey % 4 = 0 THEN 'simulated_as_actual' END,
       CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus = 'F' THEN 'midpoint_filled' END,
       CASE WHEN src = 'advisory' AND o_orderstatus = 'F' THEN 'source_cannot_fill' END,
       CASE WHEN o_orderkey % 5 > 3 THEN 'decision_after_submit' END,
       CASE WHEN o_orderkey % 6 > 4 THEN 'resolved_before_submit' END,
       CASE WHEN o_orderstatus = 'F' AND o_custkey % 8 = 0 THEN 'fill_credit_required' END,
       CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 'partial_without_quantity' END) AS reasons
     FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'broker_actual' WHEN 2 THEN 'advisory' ELSE 'unknown' END AS s0,
                  CASE WHEN o_orderkey % 8 = 4 THEN 'broker_actual' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'broker_actual'
                       WHEN 2 THEN 'advisory' ELSE 'unknown' END END AS src,
                  CASE WHEN o_custkey % 5 = 0 THEN 'live' ELSE 'paper' END AS mode FROM orders)""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    k, cst = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    fills = o.select(
        "o_orderkey",
        F.when(k % 97 != 0, k.cast("string")).alias("fill_record_id"),
        k.cast("string").alias("snapshot_id"),
        F.when(cst % 89 != 0, cst.cast("string")).otherwise("").alias("candidate_id"),
        F.when(k % 8 == 4, "broker_actual").otherwise(
            F.element_at(F.array(*[F.lit(s) for s in ("paper", "broker_actual", "advisory", "unknown")]), (k % 4 + 1).cast("int"))
        ).alias("source"),
        F.when(cst % 5 == 0, "live").otherwise("paper").alias("mode"),
        (k % 4 == 0).alias("simulated"),
        (k % 10 == 0).alias("midpoint_diagnostic"),
        (F.col("o_orderstatus") == "F").alias("filled"),
        (day + F.make_interval(secs=k % 5)).alias("decision_ts"),
        (day + F.make_interval(secs=F.lit(3))).alias("submitted_ts"),
        (day + F.make_interval(secs=F.lit(7) - k % 6)).alias("resolved_ts"),
        F.when(cst % 8 != 0, F.col("o_totalprice")).alias("fill_credit"),
        (F.col("o_orderstatus") == "P").alias("partial_fill"),
        (cst % 3).alias("filled_quantity"),
    )
    return Q.validate_fill_records(fills).select("o_orderkey", F.array_join("reject_reasons", ",").alias("reasons"))


@query(
    "realized_fill_fraction",
    """SELECT l_orderkey, l_linenumber, round(raw, 6) AS raw, round(greatest(0, least(1, raw)), 6) AS clipped
       FROM (SELECT *, CASE WHEN abs(l_tax * 10) < 1e-9 THEN 0.0 ELSE (l_quantity - (l_quantity - l_discount * 4)) / (l_tax * 10) END AS raw
             FROM lineitem)""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem")
    mid = F.col("l_quantity")
    raw, clipped = Q.realized_fill_fraction(mid, mid - F.col("l_tax") * 10, mid - F.col("l_discount") * 4)
    return li.select("l_orderkey", "l_linenumber", r6(raw, "raw"), r6(clipped, "clipped"))


@query(
    "approved_family",
    """SELECT p_partkey, CASE WHEN fam IN ('naked_short_call', 'covered_call') THEN NULL
         WHEN fam = 'put_credit' THEN 'bull_put_credit_spread' WHEN fam = 'iron_fly' THEN 'iron_butterfly' ELSE fam END AS canonical_family,
         CASE fam WHEN 'put_credit' THEN 'bullish' WHEN 'iron_fly' THEN 'short_vol' WHEN 'long_straddle' THEN 'long_vol' END AS family_direction,
         (fam IN ('put_credit', 'iron_fly', 'long_straddle'))::INT AS approved
       FROM (SELECT p_partkey, ['put_credit', 'iron_fly', 'long_straddle', 'naked_short_call', 'covered_call'][1 + p_size % 5] AS fam FROM part)""",
)
def _(spark, sf):
    names = ["put_credit", "iron_fly", "long_straddle", "naked_short_call", "covered_call"]
    p = A.table(spark, sf, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_size") % 5 + 1)).alias("family")
    )
    return Q.approved_family(p).select(
        "p_partkey", "canonical_family", "family_direction", F.col("approved").cast("int").alias("approved")
    )


@query(
    "strip_label_leakage",
    """SELECT o_orderkey, 'adx,price' AS kept FROM orders""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    v = F.col("o_totalprice")
    names = ["price", "adx", "realized_vol", "future_return", "label_up", "human_note", "m_win"]
    m = F.create_map(*[x for n in names for x in (F.lit(n), v)])
    return o.select(
        "o_orderkey", F.array_join(F.sort_array(F.map_keys(Q.strip_label_leakage(m))), ",").alias("kept")
    )


@query(
    "required_inputs_present",
    """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag <> 'R' THEN 'mark' END, 'vix') AS missing
       FROM lineitem""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(1.0).alias("spot"), F.when(F.col("l_returnflag") == "R", 1.0).alias("mark")
    )
    return Q.missing_inputs(li, ["spot", "mark", "vix"]).select(
        "l_orderkey", "l_linenumber", F.array_join("missing_inputs", ",").alias("missing")
    )


@query(
    "domain_checks",
    """SELECT rule, count(*) AS n FROM (
         SELECT unnest(list_filter([CASE WHEN l_linenumber = 7 THEN 'finite:x' END, CASE WHEN l_quantity / 40 > 1 THEN 'probability:p' END,
                CASE WHEN l_discount - l_tax < 0 THEN 'non_negative:edge' END], lambda r: r IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_tax")).alias("x"),
        (F.col("l_quantity") / 40).alias("p"),
        (F.col("l_discount") - F.col("l_tax")).alias("edge"),
    )
    checked = Q.domain_checks(li, ["x"], ["p"], ["edge"])
    return checked.select(F.explode("domain_violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
