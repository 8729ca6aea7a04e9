"""Queries: regimes, archetypes and transition matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import regimes as R
from tidemark.plans import adapters as A
from tidemark.plans.registry import query


def observations(spark, sf):
    """Quarter-hour closes as observations; damped so all classes occur."""
    t = A.bars(spark, sf, 15, symbols=False)
    return t.select("session_date", "ts", (F.lit(100.0) + (F.col("close") - 100) / 40).alias("spot"), (F.col("volume") % 7 - 3).alias("net_gex"))


REG = """WITH o AS (SELECT session_date AS d, ts, 100.0 + (close - 100) / 40 AS spot, volume % 7 - 3 AS g FROM v_tape15),
  r AS (SELECT *, ln(spot / lag(spot) OVER (PARTITION BY d ORDER BY ts)) AS ret FROM o),
  f AS (SELECT *, coalesce(stddev_samp(ret) OVER w, 0) * sqrt(98280) AS rv, sum(ret) OVER w AS mv FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY d ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
  m AS (SELECT d, median(rv) FILTER (rv > 0) AS med FROM f GROUP BY 1),
  l AS (SELECT f.*, CASE WHEN rv / med >= 1.7 THEN 'breakout' WHEN rv / med <= 0.6 THEN 'compression' WHEN mv / (med / sqrt(98280) * sqrt(15)) >= 0.6 THEN 'drift_up'
        WHEN mv / (med / sqrt(98280) * sqrt(15)) <= -0.6 THEN 'drift_down' ELSE 'pin' END AS regime FROM f JOIN m USING (d)),
  dy AS (SELECT d, coalesce(sum(ret), 0) AS net, coalesce(stddev_samp(ret), 0) * sqrt(98280) AS rv, arg_min(spot, ts) AS s0, arg_max(spot, ts) AS s1, avg(CASE WHEN g > 0 THEN 1.0 ELSE -1.0 END) AS gs FROM r GROUP BY 1),
  dc AS (SELECT *, median(rv) OVER () AS ref, coalesce(ln(s0 / lag(s1) OVER (ORDER BY d)), 0) AS gap FROM dy),
  ar AS (SELECT d, CASE WHEN abs(gap) >= 0.006 THEN 'gap_shock' WHEN rv >= 1.2 * ref AND net <= -0.008 THEN 'crash' WHEN rv >= 1.2 * ref AND net >= 0.008 THEN 'squeeze_melt_up' WHEN rv >= 1.2 * ref THEN 'vol_expansion'
        WHEN net >= 0.004 THEN 'grind_up' WHEN net <= -0.004 THEN 'grind_down' WHEN rv <= 0.85 * ref AND gs > 0.4 THEN 'calm_pin' ELSE 'range_chop' END AS archetype FROM dc)"""


@query("label_regime", A.sql(REG + " SELECT d::VARCHAR AS session_date, epoch(ts)::BIGINT AS ts_sec, regime FROM l", "v_tape15"))
def _(spark, sf):
    return R.label_regimes(observations(spark, sf)).select(
        F.col("session_date").cast("string").alias("session_date"), F.unix_timestamp("ts").alias("ts_sec"), "regime"
    )


@query("label_archetype", A.sql(REG + " SELECT d::VARCHAR AS session_date, archetype FROM ar", "v_tape15"))
def _(spark, sf):
    return R.label_archetypes(observations(spark, sf)).select(F.col("session_date").cast("string").alias("session_date"), "archetype")


@query(
    "transition_matrix",
    A.sql(
        REG + """, p AS (SELECT regime AS a, lead(regime) OVER (PARTITION BY d ORDER BY ts) AS b FROM l), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
        s AS (SELECT unnest(['pin', 'drift_up', 'drift_down', 'compression', 'breakout']) AS s), g AS (SELECT x.s AS a, y.s AS b FROM s x, s y)
        SELECT g.a AS "from", g.b AS "to", coalesce(n, 0) AS n, round((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY g.a), 6) AS p FROM g LEFT JOIN c USING (a, b)""",
        "v_tape15",
    ),
)
def _(spark, sf):
    lab = R.label_regimes(observations(spark, sf))
    return R.transition_matrix(lab, R.REGIMES, ["ts"], "regime", ["session_date"]).withColumn("p", F.round("p", 6))


@query(
    "calibrate_regimes",
    A.sql(
        REG + """, p AS (SELECT archetype, regime AS a, lead(regime) OVER (PARTITION BY l.d ORDER BY ts) AS b FROM l JOIN ar USING (d)), c AS (SELECT archetype, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
        s AS (SELECT unnest(['pin', 'drift_up', 'drift_down', 'compression', 'breakout']) AS s), g AS (SELECT k.archetype, x.s AS a, y.s AS b FROM s x, s y, (SELECT DISTINCT archetype FROM ar) k)
        SELECT g.archetype, g.a AS "from", g.b AS "to", round((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY g.archetype, g.a), 6) AS p FROM g LEFT JOIN c USING (archetype, a, b)""",
        "v_tape15",
    ),
)
def _(spark, sf):
    return R.calibrate_regimes(observations(spark, sf))[1].select("archetype", "from", "to", r6("p", "p"))


@query(
    "labeler_accuracy",
    A.sql(
        REG + """ SELECT (SELECT count(*) FROM l) AS n_minutes, (SELECT round(avg((regime = CASE WHEN g > 0 THEN 'drift_up' ELSE 'drift_down' END)::INT), 6) FROM l) AS regime_accuracy,
        (SELECT count(*) FROM ar) AS n_sessions, (SELECT round(avg((archetype = 'range_chop')::INT), 6) FROM ar) AS archetype_accuracy""",
        "v_tape15",
    ),
)
def _(spark, sf):
    o = observations(spark, sf).select(
        "*", F.lit("range_chop").alias("true_archetype"), F.when(F.col("net_gex") > 0, "drift_up").otherwise("drift_down").alias("true_regime")
    )
    a = R.labeler_accuracy(o)
    return a.select("n_minutes", r6("regime_accuracy", "regime_accuracy"), "n_sessions", r6("archetype_accuracy", "archetype_accuracy"))
