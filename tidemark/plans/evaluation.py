"""Queries: trade, decision and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import evaluation as E
from tidemark.operators import joins as J
from tidemark.plans import adapters as A
from tidemark.plans.joins import DECIDED, decisions, outcomes
from tidemark.plans.registry import query

EVAL = """WITH t AS (SELECT *, was_traded AND NOT abstained AS took, pnl::DOUBLE AS p FROM v_trades),
  eq AS (SELECT variant, session_date, trade_id, p, sum(p) OVER (PARTITION BY variant ORDER BY session_date, trade_id) AS e FROM t WHERE took),
  dd AS (SELECT variant, max(greatest(m, 0) - e) AS dd FROM (SELECT variant, e, max(e) OVER (PARTITION BY variant ORDER BY session_date, trade_id) AS m FROM eq) GROUP BY 1),
  rk AS (SELECT variant, p, row_number() OVER (PARTITION BY variant ORDER BY p) AS r, count(*) OVER (PARTITION BY variant) AS n FROM t WHERE took),
  cv AS (SELECT variant, avg(p) AS cvar FROM rk WHERE r <= greatest(1, floor(n * 0.05 + 0.9999)) GROUP BY 1),
  g AS (SELECT variant, sum(p) FILTER (took) AS net, count(*) FILTER (took) AS n, count(*) FILTER (took AND p > 0) AS w, count(*) FILTER (took AND p < 0) AS l,
          sum(p) FILTER (took AND p > 0) AS gw, -sum(p) FILTER (took AND p < 0) AS gl, sum(max_loss::DOUBLE) FILTER (took AND max_loss > 0) AS risk, count(*) AS na,
          count(*) FILTER (abstained) AS ab, count(*) FILTER (took AND false_positive) AS fp, count(*) FILTER (vetoed) AS v, avg(brier) AS br, avg(log_loss) AS ll,
          stddev_samp(p) FILTER (took) AS sd, count(DISTINCT session_date) AS ns FROM t GROUP BY 1),
  ev AS (SELECT * FROM g JOIN dd USING (variant) JOIN cv USING (variant))"""


@query(
    "evaluate_trades",
    A.sql(
        EVAL + """ SELECT variant, round(net, 4) AS net_pnl, round(net / n, 6) AS expectancy, round(net / risk, 6) AS return_on_defined_risk, round(w / n::DOUBLE, 6) AS win_rate,
        round(gw / gl, 6) AS profit_factor, round(ab / na::DOUBLE, 6) AS abstention_rate, round(fp / n::DOUBLE, 6) AS false_positive_trade_rate,
        round(v / (v + l)::DOUBLE, 6) AS veto_effectiveness, round(br, 6) AS brier_score, round(ll, 6) AS log_loss, round(sd, 6) AS realized_move_error,
        n AS trade_count, ns AS session_count FROM ev""",
        "v_trades",
    ),
)
def _(spark, sf):
    r = E.evaluate_trades(A.trades(spark, sf))
    names = ("expectancy", "return_on_defined_risk", "win_rate", "profit_factor", "abstention_rate", "false_positive_trade_rate",
             "veto_effectiveness", "brier_score", "log_loss", "realized_move_error")
    return r.select("variant", F.round("net_pnl", 4).alias("net_pnl"), *[r6(n, n) for n in names], "trade_count", "session_count")


@query("max_drawdown", A.sql(EVAL + " SELECT variant, round(dd, 4) AS maximum_drawdown FROM dd", "v_trades"))
def _(spark, sf):
    t = A.trades(spark, sf).filter("was_traded and not abstained")
    return E.max_drawdown(t, ["variant"], "session_date", ["trade_id"], "pnl").select(
        "variant", F.round("maximum_drawdown", 4).alias("maximum_drawdown")
    )


@query("cvar_worst_tail", A.sql(EVAL + " SELECT variant, round(cvar, 6) AS cvar FROM cv", "v_trades"))
def _(spark, sf):
    t = A.trades(spark, sf).filter("was_traded and not abstained")
    return E.worst_tail_mean(t, ["variant"], "pnl", ["trade_id"]).select("variant", r6("cvar", "cvar"))


@query(
    "compare_variants",
    A.sql(
        EVAL + """ SELECT a.variant, 'v0' AS baseline, round(a.net - b.net, 4) AS delta_net_pnl, round(a.dd - b.dd, 4) AS delta_drawdown, round(a.cvar - b.cvar, 6) AS delta_cvar
        FROM ev a JOIN ev b ON b.variant = 'v0' WHERE a.variant <> 'v0'""",
        "v_trades",
    ),
)
def _(spark, sf):
    c = E.compare_variants(E.evaluate_trades(A.trades(spark, sf)), "v0")
    return c.select(
        "variant", "baseline", F.round("delta_net_pnl", 4).alias("delta_net_pnl"),
        F.round("delta_drawdown", 4).alias("delta_drawdown"), r6("delta_cvar", "delta_cvar"),
    )


def matches(spark, sf):
    return J.decisions_with_outcomes(decisions(spark, sf), outcomes(spark, sf))


SESSIONS = DECIDED + """, m AS (SELECT *, pnl > 0 AS win, CASE WHEN known THEN best - pnl ELSE greatest(best, 0) END AS regret FROM j),
  s AS (SELECT authority, session_date, count(*) AS trades, sum(pnl) AS spnl, count(*) FILTER (win) AS wins FROM m GROUP BY ALL)"""


@query(
    "decision_report",
    SESSIONS + """ SELECT authority, count(*) AS trades, round(sum(pnl), 4) AS total_pnl, round(avg(win::INT), 6) AS win_rate, round(avg(hit::INT), 6) AS dir_hit,
      round(avg(regret), 5) AS regret, round(avg(abs(confidence - win::INT)), 5) AS calibration_error, count(DISTINCT session_date) AS n_sessions,
      (SELECT round(avg((spnl > 0)::INT), 6) FROM s WHERE s.authority = m.authority) AS session_win_rate FROM m GROUP BY authority""",
)
def _(spark, sf):
    r = E.decision_report(matches(spark, sf))[0]
    return r.select(
        "authority", "trades", F.round("total_pnl", 4).alias("total_pnl"), r6("win_rate", "win_rate"), r6("dir_hit", "dir_hit"),
        F.round("regret", 5).alias("regret"), F.round("calibration_error", 5).alias("calibration_error"), "n_sessions",
        r6("session_win_rate", "session_win_rate"),
    )


@query(
    "decision_report_sessions",
    SESSIONS + " SELECT authority, session_date::VARCHAR AS session_date, trades, round(spnl, 6) AS total_pnl, round(wins / trades::DOUBLE, 6) AS win_rate FROM s",
)
def _(spark, sf):
    r = E.decision_report(matches(spark, sf))[1]
    return r.select(
        "authority", F.col("session_date").cast("string").alias("session_date"), "trades",
        F.round("total_pnl", 6).alias("total_pnl"), r6("win_rate", "win_rate"),
    )


ARCH = SESSIONS + """, a AS (SELECT *, 'arch' || (sid % 8) AS archetype, sid AS universe_id FROM m),
  q AS (SELECT archetype, universe_id, session_date, sum(pnl) AS spnl, count(*) AS trades, sum(hit::INT) AS hits FROM a GROUP BY ALL),
  x AS (SELECT archetype, count(DISTINCT universe_id) AS n_universes, sum(trades)::BIGINT AS trades, avg(spnl) AS mean, avg((spnl > 0)::INT) AS swr, sum(hits) / sum(trades) AS dh, count(*) AS n_sessions FROM q GROUP BY 1)"""


def by_archetype(spark, sf):
    sid = F.col("snapshot_id").cast("int")
    return matches(spark, sf).select(
        "*", F.concat(F.lit("arch"), (sid % 8).cast("string")).alias("archetype"), sid.alias("universe_id")
    )


@query(
    "archetype_matrix",
    ARCH + " SELECT archetype, n_universes, trades, round(mean, 6) AS mean_session_pnl, round(swr, 6) AS session_win_rate, round(dh, 6) AS dir_hit, n_sessions FROM x",
)
def _(spark, sf):
    return E.archetype_matrix(by_archetype(spark, sf)).select(
        "archetype", "n_universes", "trades", "mean_session_pnl",
        r6("session_win_rate", "session_win_rate"), r6("dir_hit", "dir_hit"), "n_sessions",
    )


@query("losing_archetypes", ARCH + " SELECT archetype, round(mean, 4) AS mean_session_pnl, n_sessions FROM x WHERE mean < 0 AND n_sessions >= 2")
def _(spark, sf):
    m = E.losing_archetypes(E.archetype_matrix(by_archetype(spark, sf)), 2)
    return m.select("archetype", F.round("mean_session_pnl", 4).alias("mean_session_pnl"), "n_sessions")


@query(
    "score_by_archetype",
    ARCH + """ SELECT authority, coalesce(archetype, 'ALL') AS archetype, count(*) AS trades, round(sum(pnl), 6) AS total_pnl, round(avg(win::INT), 6) AS win_rate
      FROM a GROUP BY GROUPING SETS ((authority, archetype), (authority))""",
)
def _(spark, sf):
    return E.score_by_archetype(by_archetype(spark, sf)).select(
        "authority", "archetype", "trades", F.round("total_pnl", 6).alias("total_pnl"), r6("win_rate", "win_rate")
    )


@query(
    "coverage_matrix",
    """WITH g AS (SELECT * FROM (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'absent']) AS archetype), (SELECT unnest(['r0', 'r1', 'r2', 'r3', 'r9']) AS regime)),
       s AS (SELECT event_type AS archetype, 'r' || (user_id % 4) AS regime, count(*) AS minutes FROM events GROUP BY ALL)
       SELECT archetype, regime, coalesce(minutes, 0) AS minutes, round(20 / 30.0, 6) AS visited_share FROM g LEFT JOIN s USING (archetype, regime)""",
)
def _(spark, sf):
    m = A.table(spark, sf, "events").select(
        F.col("event_type").alias("archetype"), F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("regime"),
        F.lit(1).alias("minutes"),
    )
    c = E.coverage_matrix(m, ["click", "view", "purchase", "signup", "error", "absent"], ["r0", "r1", "r2", "r3", "r9"])
    return c.withColumn("visited_share", F.round("visited_share", 6))


@query(
    "reliability_bins",
    A.sql(
        "SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM v_probs GROUP BY 1", "v_probs"
    ),
)
def _(spark, sf):
    return E.reliability_bins(A.probs(spark, sf)).select("bin", "n", r6("mean_p", "mean_p"), r6("observed", "observed"))


@query(
    "probability_scores",
    A.sql(
        """SELECT lang, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss,
           round(CASE WHEN avg(y) * (1 - avg(y)) > 0 THEN 1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))) END, 6) AS brier_skill
           FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM v_probs) GROUP BY 1""",
        "v_probs",
    ),
)
def _(spark, sf):
    s = E.probability_scores(A.probs(spark, sf), ["lang"])
    return s.select("lang", "n", r6("brier", "brier"), r6("log_loss", "log_loss"), r6("brier_skill", "brier_skill"))


@query(
    "forecast_scores",
    """WITH s AS (SELECT l_returnflag AS k, l_extendedprice / 1000 AS y, l_quantity * 1.1 AS pred, l_quantity * 0.5 AS lo, l_quantity * 1.6 AS hi FROM lineitem)
       SELECT k AS returnflag, round(avg(greatest(0.9 * (y - pred), -0.1 * (y - pred))), 6) AS pinball, round(avg((y BETWEEN lo AND hi)::INT), 6) AS coverage,
         round(1 - avg(abs(y - pred)) / avg(abs(y - 25)), 6) AS mae_skill FROM s GROUP BY 1""",
)
def _(spark, sf):
    q = F.col("l_quantity")
    s = A.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("returnflag"), (F.col("l_extendedprice") / 1000).alias("y"), (q * 1.1).alias("pred"),
        (q * 0.5).alias("lower"), (q * 1.6).alias("upper"), F.lit(25.0).alias("naive"),
    )
    return E.forecast_scores(s, 0.9, ["returnflag"]).select(
        "returnflag", r6("pinball", "pinball"), r6("coverage", "coverage"), r6("mae_skill", "mae_skill")
    )


@query(
    "confusion_matrix",
    "SELECT quality AS y_true, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY 1",
)
def _(spark, sf):
    s = A.table(spark, sf, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    return E.confusion_matrix(s, [0, 1]).withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


@query(
    "multiclass_scores",
    """WITH s AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 16 THEN 'A' ELSE 'N' END AS yp, l_quantity / 100 AS pr, 0.3 AS pa, 0.7 - l_quantity / 100 AS pn FROM lineitem)
       SELECT count(*) AS n, round(avg((y = yp)::INT), 6) AS accuracy,
         round(avg(((pr - (y = 'R')::INT) ** 2 + (pa - (y = 'A')::INT) ** 2 + (pn - (y = 'N')::INT) ** 2) / 3), 6) AS macro_brier,
         round(avg(-ln(CASE y WHEN 'R' THEN pr WHEN 'A' THEN pa ELSE pn END)), 6) AS log_loss FROM s""",
)
def _(spark, sf):
    q = F.col("l_quantity")
    s = A.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("y_true"),
        F.when(q > 33, "R").when(q > 16, "A").otherwise("N").alias("y_pred"),
        F.create_map(F.lit("R"), q / 100, F.lit("A"), F.lit(0.3), F.lit("N"), 0.7 - q / 100).alias("probs"),
    )
    return E.multiclass_scores(s, ["R", "A", "N"]).select(
        "n", r6("accuracy", "accuracy"), r6("macro_brier", "macro_brier"), r6("log_loss", "log_loss")
    )


@query(
    "fill_support",
    """WITH f AS (SELECT p_brand AS family, count(*) AS attempts, count(*) FILTER (p_size > 30 AND p_partkey % 9 <> 0) AS fills FROM part GROUP BY 1)
       SELECT family, attempts, fills, CASE WHEN attempts >= 50 AND fills >= 25 THEN 'exact_family' WHEN sum(attempts) OVER () >= 200 AND sum(fills) OVER () >= 100
         THEN 'global_empirical' ELSE 'deterministic_prior' END AS fallback_level FROM f""",
)
def _(spark, sf):
    p = A.table(spark, sf, "part").select(
        F.col("p_brand").alias("family"), (F.col("p_size") > 30).alias("filled"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("fill_credit"),
    )
    return E.fill_support(p)


@query(
    "expert_support",
    """SELECT 'r' || (user_id % 7) AS regime, count(DISTINCT ts::DATE) AS support_sessions, count(*) AS n_rows, (count(DISTINCT ts::DATE) >= 20)::INT AS available FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("regime"), F.to_date("ts").alias("session_date")
    )
    return E.expert_support(e).withColumn("available", F.col("available").cast("int"))


@query(
    "top_decile_edge",
    """WITH r AS (SELECT l_discount - l_tax AS pnl, l_extendedprice AS pred, row_number() OVER (ORDER BY l_extendedprice DESC) AS rn, count(*) OVER () AS n FROM lineitem)
       SELECT max(n) AS n, count(*) FILTER (rn <= n // 10) AS top_n, round(avg(pred) FILTER (rn <= n // 10), 4) AS top_pred, round(avg(pnl), 6) AS overall_mean FROM r""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("pred"), (F.col("l_discount") - F.col("l_tax")).alias("pnl"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
    )
    r = E.top_decile_edge(li, outcome="pred")
    o = li.agg(F.avg("pnl").alias("m"))
    return r.join(F.broadcast(o), F.lit(True)).select(
        "n", F.floor(F.col("n") / 10).alias("top_n"), F.round("top_decile_mean", 4).alias("top_pred"), r6("m", "overall_mean")
    )


@query(
    "feature_medians",
    """SELECT name, round(median(value), 6) AS median FROM (SELECT 'quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem
       UNION ALL SELECT 'spread', l_tax - l_discount FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_tax") - F.col("l_discount")).alias("spread")
    )
    return E.feature_medians(li.unpivot([], ["quantity", "price", "spread"], "name", "value"))


@query(
    "observation_census",
    """SELECT o_orderdate::DATE::VARCHAR AS session_date, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS n_observations,
       count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_skipped FROM orders GROUP BY 1""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.to_date("o_orderdate").alias("session_date"))
    obs = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("snapshot_id")).distinct()
    return E.observation_census(o, obs).withColumn("session_date", F.col("session_date").cast("string"))


@query(
    "recording_status",
    """SELECT d::VARCHAR AS session_date, n AS ticks, round(epoch(d::TIMESTAMP + INTERVAL 1 DAY - last), 5) AS age_seconds
       FROM (SELECT ts::DATE AS d, count(*) AS n, max(ts) AS last FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 1)""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").select(F.to_date("ts").alias("session_date"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.col("session_date").cast("timestamp") + F.expr("INTERVAL 1 DAY")
    return E.recording_status(e, now).select(
        F.col("session_date").cast("string").alias("session_date"), "ticks", F.round("age_seconds", 5).alias("age_seconds")
    )


@query(
    "token_usage_by_model",
    """SELECT role AS model, conv_id % 7 AS day, count(*) AS calls, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens,
         round(sum(CASE WHEN role LIKE '%assist%' THEN length(text) * 3.0 + turn * 15.0 WHEN role LIKE '%s%' THEN length(text) * 0.2 + turn * 0.5 END) / 1e6, 8) AS cost
       FROM conversations GROUP BY ALL""",
)
def _(spark, sf):
    c = A.table(spark, sf, "conversations").select(
        F.col("role").alias("model"), (F.col("conv_id") % 7).alias("day"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")
    )
    u = E.token_usage(c, [("assist", 3.0, 15.0), ("s", 0.2, 0.5)])
    return u.withColumn("cost", F.round("cost", 8))


@query(
    "uniform_version_audit",
    "SELECT 'lang' AS \"column\", count(DISTINCT lang) AS n_versions, 0 AS uniform FROM documents UNION ALL SELECT 'one', 1, 1",
)
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("lang", F.lit("v1").alias("one"))
    return E.uniform_versions(d, ["lang", "one"]).withColumn("uniform", F.col("uniform").cast("int"))


@query(
    "retention_check",
    A.sql(
        """WITH b AS (SELECT session_date AS d, avg(pnl::DOUBLE) AS s FROM v_trades WHERE variant = 'v0' GROUP BY 1), a AS (SELECT session_date AS d, avg(pnl::DOUBLE) AS s FROM v_trades WHERE variant = 'v1' GROUP BY 1)
           SELECT count(*) AS n, round(sum(a.s) - sum(b.s), 4) AS forward_transfer, round(avg(b.s - a.s) FILTER (b.s > a.s), 6) AS forgetting_penalty,
             (coalesce(avg(b.s - a.s) FILTER (b.s > a.s), 0) <= 0.05)::INT AS retained FROM a JOIN b USING (d)""",
        "v_trades",
    ),
)
def _(spark, sf):
    t = A.trades(spark, sf)
    score = lambda v: t.filter(F.col("variant") == v).groupBy("session_date").agg(F.avg(F.col("pnl").cast("double")).alias("score"))
    return E.retention_check(score("v0"), score("v1")).select(
        "n", F.round("forward_transfer", 4).alias("forward_transfer"), r6("forgetting_penalty", "forgetting_penalty"),
        F.col("retained").cast("int").alias("retained"),
    )


# -- attribution -------------------------------------------------------------------------------------------------
def planned_actual(spark, sf):
    o = A.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    d = lambda x: x.cast("decimal(12,4)")
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(day) + s)
    planned = o.filter(k % 4 != 0).select(
        k.alias("snapshot_id"), F.to_date(day).alias("session_date"), (c % 10).cast("string").alias("candidate_id"),
        (1 + c % 3).alias("contracts"), d((k % 300) / 100).alias("entry_price"), d((c % 400) / 100).alias("exit_price"),
        at(k % 100).alias("decided_at"), at(5000 + k % 50).alias("planned_exit_at"),
    )
    actual = o.filter(k % 5 != 0).select(
        k.alias("snapshot_id"), F.to_date(day).alias("session_date"),
        F.when(k % 7 == 0, "sub").otherwise((c % 10).cast("string")).alias("candidate_id"),
        (1 + k % 3).alias("contracts"), d((k % 290) / 100).alias("entry_price"), d((c % 410) / 100).alias("exit_price"),
        (k % 13 != 0).alias("approved"),
        F.when(k % 14 == 0, d((k % 310) / 100)).alias("modeled_entry_price"),
        F.when(k % 14 == 0, d((c % 405) / 100)).alias("modeled_exit_price"),
        at(k % 300).alias("entry_at"), at(5000 + c % 50).alias("exit_at"),
    )
    return planned, actual


ATTR = """WITH p AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, (o_custkey % 10)::VARCHAR AS cid, 1 + o_custkey % 3 AS n, ((o_orderkey % 300) / 100.0)::DECIMAL(12, 4) AS i, ((o_custkey % 400) / 100.0)::DECIMAL(12, 4) AS x,
       o_orderkey % 100 AS dec, 5000 + o_orderkey % 50 AS pex FROM orders WHERE o_orderkey % 4 <> 0),
  a AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 7 = 0 THEN 'sub' ELSE (o_custkey % 10)::VARCHAR END AS cid, 1 + o_orderkey % 3 AS n, ((o_orderkey % 290) / 100.0)::DECIMAL(12, 4) AS i,
       ((o_custkey % 410) / 100.0)::DECIMAL(12, 4) AS x, o_orderkey % 13 <> 0 AS ok, CASE WHEN o_orderkey % 14 = 0 THEN ((o_orderkey % 310) / 100.0)::DECIMAL(12, 4) END AS mi,
       CASE WHEN o_orderkey % 14 = 0 THEN ((o_custkey % 405) / 100.0)::DECIMAL(12, 4) END AS mx, o_orderkey % 300 AS ent, 5000 + o_custkey % 50 AS ext FROM orders WHERE o_orderkey % 5 <> 0),
  j AS (SELECT coalesce(p.k, a.k) AS k, coalesce(p.d, a.d) AS d, p.k IS NOT NULL AS hp, a.k IS NOT NULL AS ha, p.n AS pn, a.n AS an, ok, dec, pex, ent, ext, p.cid AS pcid, a.cid AS acid,
         (p.x - p.i) * p.n * 100 AS p0, (a.x - a.i) * a.n * 100 AS p4, a.i AS ai,
         coalesce(mi, CASE WHEN p.cid = a.cid THEN p.i ELSE a.i END) AS mi, coalesce(mx, CASE WHEN p.cid = a.cid THEN p.x ELSE a.x END) AS mx FROM p FULL JOIN a ON p.k = a.k),
  w AS (SELECT *, CASE WHEN hp THEN p0 ELSE 0 END AS model, CASE WHEN ha THEN p4 ELSE 0 END AS actual, hp AND ha AS b FROM j),
  z AS (SELECT k, d, hp, ha, pcid, acid, model, actual, actual - model AS gap, CASE WHEN b THEN 0 WHEN ha THEN p4 ELSE -p0 END AS participation, CASE WHEN b THEN (mx - mi) * pn * 100 - p0 ELSE 0 END AS selection,
         CASE WHEN b THEN (mx - mi) * (an - pn) * 100 ELSE 0 END AS sizing, CASE WHEN b THEN (mi - ai) * an * 100 ELSE 0 END AS entry, CASE WHEN b THEN p4 - (mx - ai) * an * 100 ELSE 0 END AS exit,
         CASE WHEN hp THEN ha AND NOT ok ELSE true END AS unapproved,
         concat_ws(',', CASE WHEN NOT ha THEN 'missed_signal' END, CASE WHEN CASE WHEN hp THEN ha AND NOT ok ELSE true END THEN 'unapproved_trade' END,
           CASE WHEN b AND (an - pn) / pn::DOUBLE > 0.1 THEN 'oversized' END, CASE WHEN b AND (an - pn) / pn::DOUBLE < -0.1 THEN 'undersized' END,
           CASE WHEN b AND ent - dec > 120 THEN 'late_entry' END, CASE WHEN b AND ext < pex THEN 'premature_exit' END, CASE WHEN b AND ext > pex THEN 'held_past_plan' END) AS flags FROM w)"""
COMPONENTS = ("participation", "selection", "sizing", "entry", "exit")


@query(
    "attribute_trades",
    ATTR + " SELECT k AS snapshot_id, " + ", ".join(f"round({c}::DOUBLE, 4) AS \"{c}\"" for c in COMPONENTS)
    + ", round(gap::DOUBLE, 4) AS gap, 1 AS reconciles, flags FROM z",
)
def _(spark, sf):
    t = E.attribute_trades(*planned_actual(spark, sf))
    return t.select(
        "snapshot_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in (*COMPONENTS, "gap")],
        F.col("reconciles").cast("int").alias("reconciles"), F.array_join("flags", ",").alias("flags"),
    )


@query(
    "planned_vs_actual_join",
    ATTR + " SELECT count(*) FILTER (hp AND ha) AS both_sides, count(*) FILTER (hp AND NOT ha) AS planned_only, count(*) FILTER (ha AND NOT hp) AS actual_only FROM z",
)
def _(spark, sf):
    t = E.attribute_trades(*planned_actual(spark, sf))
    p, a = F.col("planned_candidate_id").isNotNull(), F.col("actual_candidate_id").isNotNull()
    return t.agg(
        F.count_if(p & a).alias("both_sides"), F.count_if(p & ~a).alias("planned_only"), F.count_if(a & ~p).alias("actual_only")
    )


@query(
    "shadow_account",
    ATTR + """ SELECT d::VARCHAR AS session_date, count(*) FILTER (hp) AS n_planned, count(*) FILTER (ha) AS n_taken, round(sum(model)::DOUBLE, 4) AS model_pnl, round(sum(actual)::DOUBLE, 4) AS actual_pnl,
      round(sum(selection)::DOUBLE, 4) AS selection, round(avg((model > 0)::INT) FILTER (hp), 6) AS model_win_rate, round(avg((actual > 0)::INT) FILTER (ha), 6) AS actual_win_rate,
      CASE WHEN count(*) FILTER (ha) = 0 THEN 'no_data' WHEN sum(model) > 0 AND sum(gap) >= 0 THEN 'healthy' WHEN sum(model) > 0 THEN 'execution_drag' WHEN sum(gap) >= 0 THEN 'model_weak'
        ELSE 'model_weak_and_execution_drag' END AS verdict FROM z GROUP BY d""",
)
def _(spark, sf):
    s = E.shadow_account(E.attribute_trades(*planned_actual(spark, sf)))
    return s.select(
        F.col("session_date").cast("string").alias("session_date"), "n_planned", "n_taken",
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("model_pnl", "actual_pnl", "selection")],
        r6("model_win_rate", "model_win_rate"), r6("actual_win_rate", "actual_win_rate"), "verdict",
    )


@query("behaviour_flag_counts", ATTR + " SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM z WHERE flags <> '') GROUP BY 1")
def _(spark, sf):
    return E.flag_counts(E.attribute_trades(*planned_actual(spark, sf)))


@query(
    "session_flags",
    ATTR + """ SELECT d::VARCHAR AS session_date, count(pcid) AS approved, count(acid) AS taken, count(*) FILTER (unapproved) AS unapproved FROM z GROUP BY d
      HAVING count(*) FILTER (unapproved) > 1 OR (count(pcid) > 0 AND count(acid) > count(pcid) * 1.5)""",
)
def _(spark, sf):
    return E.session_flags(E.attribute_trades(*planned_actual(spark, sf))).withColumn("session_date", F.col("session_date").cast("string"))
