"""Queries: models, calibration, uncertainty, ensembles, paths and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import r6
from tidemark.operators import forecast as M
from tidemark.operators import training as T
from tidemark.plans import adapters as A
from tidemark.plans.registry import query


def doc_rows(spark, sf):
    """Labelled documents as observations: simple text statistics as features."""
    d = A.table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.log1p("n_chars").alias("size"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / (F.col("n_chars") + 1)).alias("upper_share"),
        F.when(F.col("n_chars") % 7 != 0, F.size(F.split("text", " ")) / (F.col("n_chars") + 1)).alias("word_rate"), (F.length(F.regexp_replace("text", "[^0-9]", "")) / (F.col("n_chars") + 1)).alias("digit_share"),
    )
    return A.table(spark, sf, "labels").join(d, "doc_id").select("*", (F.col("doc_id") % 30).alias("session"))


NAMES = ["size", "upper_share", "word_rate", "digit_share"]


@query(
    "vectorize",
    """WITH m AS (SELECT median(l_extendedprice) FILTER (l_linenumber <> 3) AS a, median(l_quantity) AS b FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_extendedprice ELSE a END AS price, l_quantity AS qty, (l_linenumber = 3)::INT AS price_missing FROM lineitem, m""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("a_price"), F.col("l_quantity").alias("b_qty")
    )
    v = F.col("vector")
    return M.vectorize(li, ["b_qty", "a_price"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v[0].alias("price"), v[1].alias("qty"), v[2].cast("int").alias("price_missing")
    )


@query("direction_model")
def _(spark, sf):
    r = doc_rows(spark, sf)
    s = M.direction_model(r.filter("session < 18"), r.filter("session between 18 and 23"), r, NAMES, "quality")
    return s.select("doc_id", r6("p", "p"))


@query("range_survival_model")
def _(spark, sf):
    e = A.bars(spark, sf).select(
        "symbol", "ts", "session_date", F.col("open").alias("spot"), (F.col("open") * 1.02).alias("upper"), (F.col("open") * 0.98).alias("lower"), F.lit(3.0).alias("expected_move"),
        ((F.col("high") < F.col("open") * 1.02) & (F.col("low") > F.col("open") * 0.98)).cast("int").alias("y"), F.hour("ts").cast("double").alias("hour"), F.col("volume").cast("double").alias("vol"),
    )
    g = M.barrier_geometry(e)
    day = F.dayofmonth("session_date")
    s = M.direction_model(g.filter(day <= 15), g.filter(day.between(16, 20)), g, ["up_distance", "down_distance", "interval_width", "hour", "vol"])
    return s.select("symbol", F.unix_timestamp("ts").alias("ts_sec"), r6("p", "p"))


@query("barrier_touch_model")
def _(spark, sf):
    e = A.bars(spark, sf).select(
        "symbol", "ts", "session_date", F.col("open").alias("spot"), (F.col("open") + 2).alias("upper"), F.col("open").alias("lower"), F.lit(3.0).alias("expected_move"),
        (F.col("high") >= F.col("open") + 2).cast("int").alias("y"), F.hour("ts").cast("double").alias("hour"),
    )
    g = M.barrier_geometry(e)
    day = F.dayofmonth("session_date")
    s = M.direction_model(g.filter(day <= 15), g.filter(day.between(16, 20)), g, ["up_distance", "interval_width", "hour"])
    return s.select("symbol", F.unix_timestamp("ts").alias("ts_sec"), r6("p", "p"))


def bar_returns(spark, sf):
    return A.bars(spark, sf).select(
        "symbol", "ts", "session_date", F.hour("ts").cast("double").alias("hour"), F.col("volume").cast("double").alias("vol"), (F.col("high") - F.col("low")).alias("width"),
        F.ln(F.col("close") / F.col("open")).alias("y"),
    )


@query("return_quantiles")
def _(spark, sf):
    b = bar_returns(spark, sf)
    q = M.return_quantiles(b.filter(F.dayofmonth("session_date") <= 20), b, ["hour", "vol", "width"])
    return q.select("symbol", F.unix_timestamp("ts").alias("ts_sec"), *[r6(n, n) for n in ("q10", "q50", "q90")])


@query("volatility_model")
def _(spark, sf):
    b = bar_returns(spark, sf).withColumn("y", F.abs("y"))
    q = M.volatility_forecast(M.return_quantiles(b.filter(F.dayofmonth("session_date") <= 20), b, ["hour", "vol"]))
    return q.select("symbol", F.unix_timestamp("ts").alias("ts_sec"), r6("expected_move", "expected_move"), r6("spread_uncertainty", "spread_uncertainty"))


def fill_rows(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select(
        "p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 1000).alias("price"), *[(F.col("p_size") % 30 <= h).cast("int").alias(f"y_{h}") for h in (5, 15, 25)],
        (F.col("p_size") % 11 / 10.0).alias("fill_fraction"), F.lit(0.5).alias("prior"), (F.col("p_retailprice") - 1000 - F.col("p_size")).alias("pnl"),
    )


@query("fill_probability_model")
def _(spark, sf):
    r = fill_rows(spark, sf)
    return M.fill_probability(r, r, ["size", "price"], [5, 15, 25], "p_partkey").select("p_partkey", *[r6(f"p_{h}", f"p_{h}") for h in (5, 15, 25)])


@query("fill_concession_model")
def _(spark, sf):
    r = fill_rows(spark, sf)
    return M.fill_concession(r, r, ["size", "price"]).select("p_partkey", *[r6(n, n) for n in ("concession", "q10", "q50", "q90")])


@query("candidate_value_model")
def _(spark, sf):
    r = fill_rows(spark, sf)
    return M.candidate_value(r, r, ["size", "price"]).select("p_partkey", *[r6(n, n) for n in ("expected_net_pnl", "p_profit", "pnl_q05", "pnl_q50", "expected_shortfall")])


@query("platt_calibration")
def _(spark, sf):
    s = A.probs(spark, sf)
    a, b = M.fit_platt(s)
    return s.select("doc_id", r6(M.apply_platt(F.col("p"), a, b), "p_platt"))


@query("isotonic_calibration")
def _(spark, sf):
    s = A.probs(spark, sf).select("doc_id", "p", "y")
    return M.apply_isotonic(M.fit_isotonic(s), s).select("doc_id", r6("p_iso", "p_iso"))


@query("regime_probabilities")
def _(spark, sf):
    e = A.table(spark, sf, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(8)]
    r = e.select("vec_id", "label", *cols)
    r = r.withColumn("session", F.col("vec_id") % 40)
    p = M.regime_probabilities(r.filter("session < 24"), r, [f"x{i}" for i in range(8)], "label", 10, r.filter("session between 24 and 31"), "session")
    return p.select("vec_id", "predicted", r6("entropy", "entropy"), r6("support_uncertainty", "support_uncertainty"), r6(F.array_max("probs"), "top_p"))


@query("bootstrap_predictions")
def _(spark, sf):
    b = bar_returns(spark, sf).withColumn("up", (F.col("y") > 0).cast("int"))
    p = M.bootstrap_predictions(b, b.select("symbol", "ts", "hour", "vol", "width"), ["hour", "vol", "width"], "up")
    rounded = F.transform("replicas", lambda x: F.round(x, 6))
    return p.select("symbol", F.unix_timestamp("ts").alias("ts_sec"), F.array_join(rounded, ",").alias("replicas"), r6("spread", "spread"))


CONF = "WITH s AS (SELECT greatest(l_quantity * 0.7 - l_extendedprice / 2000, l_extendedprice / 2000 - l_quantity * 1.4, 0) AS s, l_shipdate AS d FROM lineitem), c AS (SELECT quantile_cont(s, least(1, ceil(round((count(*) + 1) * 0.9, 9)) / count(*))) AS corr FROM (SELECT * FROM s))"


@query(
    "split_conformal",
    """WITH s AS (SELECT greatest(l_quantity * 0.7 - l_extendedprice / 2000, l_extendedprice / 2000 - l_quantity * 1.4, 0) AS s, l_shipdate::DATE AS d FROM lineitem),
       r AS (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS n FROM s), h AS (SELECT max(n) AS n, (max(n) - 1) * least(1, ceil(round((max(n) + 1) * 0.9, 9)) / max(n)) AS h FROM r)
       SELECT (SELECT count(*) FROM s) AS support_rows, (SELECT count(DISTINCT d) FROM s) AS support_sessions,
         round((SELECT s FROM r WHERE r = floor(h) + 1) + (h - floor(h)) * ((SELECT s FROM r WHERE r = least(floor(h) + 2, n)) - (SELECT s FROM r WHERE r = floor(h) + 1)), 6) AS correction, (SELECT round(avg(s), 6) FROM s) AS score_mean FROM h""",
)
def _(spark, sf):
    c = conformal_rows(spark, sf)
    s = M.split_conformal(c)
    return s.select("support_rows", "support_sessions", r6("correction", "correction"), r6("score_mean", "score_mean"))


def conformal_rows(spark, sf):
    q = F.col("l_quantity")
    return A.table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("session_date"), (F.col("l_extendedprice") / 2000).alias("y"), (q * 0.7).alias("lower"), (q * 1.4).alias("upper"), (F.col("l_discount") * 10).alias("ood_score"), "l_returnflag"
    )


@query(
    "conformal_interval_coverage",
    """WITH s AS (SELECT greatest(l_quantity * 0.7 - l_extendedprice / 2000, l_extendedprice / 2000 - l_quantity * 1.4, 0) AS s, l_extendedprice / 2000 AS y, l_quantity * 0.7 AS lo, l_quantity * 1.4 AS hi,
         l_discount * 10 AS ood, l_returnflag FROM lineitem),
       r AS (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS n FROM s), h AS (SELECT max(n) AS n, (max(n) - 1) * least(1, ceil(round((max(n) + 1) * 0.9, 9)) / max(n)) AS h FROM r),
       c AS (SELECT (SELECT s FROM r WHERE r = floor(h) + 1) + (h - floor(h)) * ((SELECT s FROM r WHERE r = least(floor(h) + 2, n)) - (SELECT s FROM r WHERE r = floor(h) + 1)) AS c FROM h),
       k AS (SELECT s.*, c * CASE WHEN ood >= 0.8 THEN 1.5 ELSE 1 END AS k FROM s, c)
       SELECT l_returnflag, count(*) AS n, round(avg((y >= lo - k AND y <= hi + k)::INT), 6) AS coverage FROM k GROUP BY 1""",
)
def _(spark, sf):
    c = conformal_rows(spark, sf)
    a = M.apply_conformal(c, M.split_conformal(c))
    inside = (F.col("y") >= F.col("conformal_lower")) & (F.col("y") <= F.col("conformal_upper"))
    return a.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(inside.cast("int")), 6).alias("coverage"))


@query(
    "compose_uncertainty",
    """WITH p AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN least(value / 100, 1) END AS a, CASE WHEN user_id % 4 <> 0 THEN (user_id % 10) / 10.0 END AS b, (user_id % 97) / 97.0 AS c, CASE WHEN user_id % 5 <> 0 THEN 0.9 END AS d FROM events)
       SELECT event_id, round((coalesce(0.25 * a, 0) + coalesce(0.2 * b, 0) + 0.25 * c + coalesce(0.15 * d, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + 0.25 + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END), 6) AS composite,
         concat_ws(',', CASE WHEN a IS NULL THEN 'missing_ensemble_component' END, CASE WHEN b IS NULL THEN 'missing_conformal_component' END, CASE WHEN d IS NULL THEN 'missing_calibration_component' END, 'missing_data_quality_component', 'missing_model_age_component',
           CASE WHEN (coalesce(0.25 * a, 0) + coalesce(0.2 * b, 0) + 0.25 * c + coalesce(0.15 * d, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + 0.25 + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END) >= 0.85 THEN 'ABSTAIN_SHADOW' END) AS reasons FROM p""",
)
def _(spark, sf):
    u = F.col("user_id")
    e = A.table(spark, sf, "events").select(
        "event_id", F.when(u % 3 != 0, F.col("value") / 100).alias("ensemble"), F.when(u % 4 != 0, u % 10 / 10.0).alias("conformal"), (u % 97 / 97.0).alias("out_of_distribution"),
        F.when(u % 5 != 0, 0.9).alias("calibration"), F.lit(None).cast("double").alias("data_quality"), F.lit(None).cast("double").alias("model_age"),
    )
    return M.compose_uncertainty(e).select("event_id", r6("composite", "composite"), F.array_join("reasons", ",").alias("reasons"))


@query(
    "uncertainty_parts",
    """WITH v AS (SELECT l_orderkey AS k, list_sort(list(l_discount)) AS d, avg(l_tax) AS t, max(l_linenumber) AS m FROM lineitem GROUP BY 1)
       SELECT k AS l_orderkey, round(CASE WHEN len(d) < 2 THEN 0 ELSE least(1, list_stddev_pop(d) / 0.5) END, 6) AS ens_cls,
         round(CASE WHEN len(d) < 2 THEN 0 ELSE (list_aggregate(d, 'quantile_cont', 0.75) - list_aggregate(d, 'quantile_cont', 0.25)) / (2 * (abs(list_aggregate(d, 'quantile_cont', 0.5)) + 1e-6) + list_aggregate(d, 'quantile_cont', 0.75) - list_aggregate(d, 'quantile_cont', 0.25)) END, 6) AS ens_reg,
         round((1 - t + least(1, m * 5 / 30.0)) / 2, 6) AS quality, round((least(1, t / 0.5) + abs(t - 1)) / 2, 6) AS calibration, round(least(1, m * 10 / 30.0), 6) AS age FROM v""",
)
def _(spark, sf):
    g = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("d"), F.avg("l_tax").alias("feature_coverage"), F.max("l_linenumber").alias("m"))
    g = g.withColumn("max_source_age", F.col("m") * 5.0)
    t, none = F.col("feature_coverage"), F.lit(None).cast("double")
    return g.select(
        "l_orderkey", r6(M.ensemble_uncertainty(F.col("d")), "ens_cls"), r6(M.ensemble_uncertainty(F.col("d"), False), "ens_reg"), r6(M.data_quality_uncertainty(g), "quality"),
        r6(M.calibration_uncertainty(none, t, t, none, none), "calibration"), r6(M.model_age_uncertainty(F.col("m") * 10.0, none, none, F.lit(0)), "age"),
    )


def components(spark, sf):
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("obs_id"), "l_linenumber").agg(
        F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q")
    )
    return li.select(
        "obs_id", F.col("l_linenumber").alias("component"), (F.col("d") * 40).alias("oos_loss"), F.lit(1.0).alias("prior"), (F.col("q") > 45).alias("negative_skill"), (F.col("t") * 12).alias("ood"),
        F.when(F.col("l_linenumber") != 5, F.col("q") / 50).alias("prediction"), F.col("t").alias("uncertainty"),
    )


ENS = """WITH c AS (SELECT l_orderkey AS obs_id, l_linenumber AS component, max(l_discount) AS d, max(l_tax) AS t, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
  r AS (SELECT *, CASE WHEN q > 45 THEN 1e-6 ELSE greatest(exp(-d * 40) * CASE WHEN t * 12 >= 0.8 THEN 0.25 ELSE 1 END, 1e-6) END AS raw FROM c),
  w AS (SELECT *, raw / sum(raw) OVER (PARTITION BY obs_id) AS w, raw <= 1e-4 AS tiny FROM r), o AS (SELECT *, w > 0.6 + 1e-12 AND NOT tiny AS ov FROM w),
  a AS (SELECT *, coalesce(sum(CASE WHEN ov THEN 0.6 END) OVER p, 0) AS capped, coalesce(sum(CASE WHEN tiny THEN w END) OVER p, 0) AS tm, coalesce(sum(CASE WHEN NOT ov AND NOT tiny THEN w END) OVER p, 0) AS fr, bool_or(ov) OVER p AS ao, count(*) OVER p AS n FROM o WINDOW p AS (PARTITION BY obs_id)),
  m AS (SELECT *, CASE WHEN NOT ao THEN w WHEN fr <= 1e-12 AND tm <= 0 THEN 1.0 / n WHEN ov THEN 0.6 WHEN tiny THEN w WHEN fr > 1e-12 AND 1 - capped - tm > 1e-12 THEN w / fr * (1 - capped - tm) ELSE w END AS mv FROM a),
  f AS (SELECT *, mv / sum(mv) OVER (PARTITION BY obs_id) AS weight FROM m)"""


@query("ensemble_weights", ENS + " SELECT obs_id, component, round(weight, 6) AS weight FROM f")
def _(spark, sf):
    return M.ensemble_weights(components(spark, sf)).select("obs_id", "component", r6("weight", "weight"))


@query(
    "weighted_blend",
    ENS + """, x AS (SELECT *, CASE WHEN component <> 5 THEN q / 50 END AS pr FROM f), b AS (SELECT obs_id, sum(weight * pr) AS bl, sum(weight * t) FILTER (pr IS NOT NULL) AS u, count(pr) AS n, count(*) - count(pr) AS miss FROM x GROUP BY 1),
      z AS (SELECT b.obs_id, any_value(bl) AS bl, any_value(u) AS u, any_value(miss) AS miss, CASE WHEN any_value(b.n) <= 1 THEN 0 ELSE sum(weight * (pr - bl) ** 2) FILTER (pr IS NOT NULL) END AS dis FROM b JOIN x USING (obs_id) GROUP BY 1)
      SELECT obs_id, round(bl, 6) AS prediction, round(dis, 6) AS disagreement, round(least(1, 0.4 * u + 0.3 * sqrt(dis) + 0.02 * miss), 5) AS composite FROM z WHERE bl IS NOT NULL""",
)
def _(spark, sf):
    b = M.weighted_blend(M.ensemble_weights(components(spark, sf)))
    return b.filter("prediction is not null").select(
        "obs_id", r6("prediction", "prediction"), r6("disagreement", "disagreement"), F.round("composite_uncertainty", 5).alias("composite")
    )


@query(
    "mixture_of_experts",
    """WITH p AS (SELECT l_orderkey AS obs_id, l_linenumber % 3 AS regime, sum(l_quantity) AS p, avg(l_discount) AS pred FROM lineitem GROUP BY ALL), s AS (SELECT * FROM (VALUES (0, 60.0), (1, 25.0), (2, 10.0)) t(regime, sessions)),
       g AS (SELECT obs_id, avg(pred) AS g FROM p GROUP BY 1), x AS (SELECT p.obs_id, p, CASE WHEN sessions >= 20 THEN sessions / (sessions + 40) ELSE 0 END AS w, pred, g FROM p JOIN s USING (regime) JOIN g USING (obs_id)),
       y AS (SELECT *, w * pred + (1 - w) * g AS sx FROM x), m AS (SELECT obs_id, sum(p * sx) / sum(p) AS mu FROM y GROUP BY 1)
       SELECT y.obs_id, round(any_value(mu), 6) AS prediction, round(sum(p * (sx - mu) ** 2) / sum(p) + 1e-11, 8) AS disagreement FROM y JOIN m USING (obs_id) GROUP BY 1""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("obs_id"), (F.col("l_linenumber") % 3).alias("regime")).agg(F.sum("l_quantity").alias("p"), F.avg("l_discount").alias("pred"))
    support = spark.createDataFrame([(0, 60.0), (1, 25.0), (2, 10.0)], "regime int, sessions double")
    g = li.groupBy("obs_id").agg(F.avg("pred").alias("g"))
    m = M.mixture_of_experts(li.select("obs_id", "regime", "pred"), li.select("obs_id", "regime", "p"), support, g)
    return m.select("obs_id", r6("prediction", "prediction"), F.round(F.col("disagreement") + 1e-11, 8).alias("disagreement"))  # decimals end on a 5


@query(
    "ood_score",
    """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT id, label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM e),
       m AS (SELECT d, median(x) AS med FROM l WHERE label < 8 GROUP BY 1), a AS (SELECT d, any_value(med) AS med, median(abs(x - med)) AS mad FROM l JOIN m USING (d) WHERE label < 8 GROUP BY 1),
       z AS (SELECT id, any_value(label) AS label, list(greatest(-6, least(6, 0.6745 * (x - med) / CASE WHEN mad > 1e-12 THEN mad ELSE 1 END)) ORDER BY d) AS z FROM l JOIN a USING (d) GROUP BY 1),
       p AS (SELECT q.id, q.label, q.id = t.id AS self, list_distance(q.z, t.z) AS d FROM z q JOIN z t ON t.label < 8),
       n AS (SELECT id, avg(d) AS mean_distance FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM p) WHERE r <= 5 GROUP BY 1),
       o AS (SELECT avg(d) AS d FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM p WHERE label < 8 AND NOT self) WHERE r <= 5 GROUP BY id),
       c AS (SELECT n.id, any_value(n.mean_distance) AS mean_distance, count(*) FILTER (o.d <= n.mean_distance) / count(*) AS pct FROM n, o GROUP BY 1)
       SELECT c.id, round(0.35 * len([x FOR x IN z IF abs(x) >= 6 * 0.85]) / len(z) + 0.65 * pct, 6) AS score, round(pct, 6) AS percentile, round(mean_distance, 6) AS mean_distance,
         CASE WHEN pct <= 0.80 THEN 'normal_support' WHEN pct <= 0.95 THEN 'reduced_support' WHEN pct <= 0.99 THEN 'high_ood' ELSE 'extreme_ood' END AS bucket FROM c JOIN z USING (id)""",
)
def _(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    o = M.ood_score(e.filter("label < 8").select("id", "vector"), e.select("id", "vector"), 64)
    return o.select("id", r6("score", "score"), r6("percentile", "percentile"), r6("mean_distance", "mean_distance"), "bucket")


@query(
    "knn_distance",
    """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT q.id, list_distance(q.v, t.v) AS d FROM e q JOIN e t ON t.label < 8),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d) SELECT id, round(avg(d), 6) AS mean_distance, round(min(d), 6) AS nearest_distance FROM r WHERE r <= 5 GROUP BY 1""",
)
def _(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    k = M.knn_distance(e.select("id", "z"), e.filter("label < 8").select("id", "z"))
    return k.select("id", r6("mean_distance", "mean_distance"), r6("nearest_distance", "nearest_distance"))


@query(
    "hazards_to_incidence",
    """WITH RECURSIVE h AS (SELECT l_orderkey AS k, l_linenumber AS i, max(l_discount) * 6 AS a, max(l_tax) * 6 AS b FROM lineitem GROUP BY ALL), n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, a / greatest(a + b, 1) AS a, b / greatest(a + b, 1) AS b FROM h),
       c AS (SELECT k, i, 1.0::DOUBLE * a AS pt, 1.0::DOUBLE * b AS ps, 1 - a - b AS s FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, pt + s * a, ps + s * b, s * (1 - a - b) FROM c JOIN n ON n.k = c.k AND n.i = c.i + 1)
       SELECT k AS l_orderkey, round(arg_max(pt, i), 6) AS p_target_first, round(arg_max(ps, i), 6) AS p_stop_first, round(arg_max(s, i), 6) AS p_neither FROM c GROUP BY 1""",
)
def _(spark, sf):
    g = A.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_discount") * 6).alias("a"), (F.max("l_tax") * 6).alias("b"))
    arr = g.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "a", "b"))).alias("s"))
    h = arr.select("l_orderkey", F.transform("s", lambda x: x["a"]).alias("h_target"), F.transform("s", lambda x: x["b"]).alias("h_stop"))
    return M.hazards_to_incidence(h).select("l_orderkey", r6("p_target_first", "p_target_first"), r6("p_stop_first", "p_stop_first"), r6("p_neither", "p_neither"))


def paths(spark, sf):
    """Half-hour closes as paths: one path per (session, event type), keyed by session."""
    b = A.bars(spark, sf).select(
        F.col("session_date").cast("string").alias("snapshot_id"), F.col("symbol").alias("path_id"), F.unix_timestamp("ts").alias("step"), F.col("close").alias("price")
    )
    c = lambda v, n: F.lit(v).alias(n)
    lv = b.select("snapshot_id").distinct().select(
        "snapshot_id", c(105.0, "spot"), c(112.0, "target"), c(101.0, "stop"), c(110.0, "call_wall"), c(100.6, "put_wall"), c(104.0, "gamma_flip"), c(100.3, "lower"), c(125.0, "upper")
    )
    return b, lv


@query(
    "score_path_events",
    A.sql(
        """WITH p AS (SELECT session_date::VARCHAR AS k, symbol, ts, close AS c, lag(close) OVER (PARTITION BY session_date, symbol ORDER BY ts) AS pv FROM v_bars30), q AS (SELECT *, least(c, pv) AS lo, greatest(c, pv) AS hi FROM p WHERE pv IS NOT NULL),
      e AS (SELECT k, symbol, min(ts) FILTER (hi >= 112) AS t, min(ts) FILTER (lo <= 101) AS s, min(ts) FILTER (hi >= 110) AS cw, min(ts) FILTER (lo <= 100.6) AS pw, bool_or(c < 104) AS x, bool_and(lo > 100.3 AND hi < 125) AS al FROM q GROUP BY ALL)
      SELECT k AS snapshot_id, count(*) AS n_paths, round(avg((t IS NOT NULL AND (s IS NULL OR t < s))::INT), 6) AS p_target_first, round(avg((s IS NOT NULL AND (t IS NULL OR s <= t))::INT), 6) AS p_stop_first,
        round(avg((cw IS NOT NULL)::INT), 6) AS p_touch_call, round(avg((pw IS NOT NULL)::INT), 6) AS p_touch_put, round(avg(x::INT), 6) AS p_cross_flip, round(avg(al::INT), 6) AS p_range_survive FROM e GROUP BY 1""",
        "v_bars30",
    ),
)
def _(spark, sf):
    e = M.score_path_events(*paths(spark, sf))
    names = ("p_target_first", "p_stop_first", "p_touch_call", "p_touch_put", "p_cross_flip", "p_range_survive")
    return e.select("snapshot_id", "n_paths", *[r6(n, n) for n in names])


RES = """WITH r AS (SELECT session_date, ts, ln(close / lag(close) OVER (PARTITION BY session_date ORDER BY ts)) AS ret FROM v_tape15), z AS (SELECT * FROM r WHERE ret IS NOT NULL)"""


def tape_returns(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("session_date").orderBy("ts")
    return A.bars(spark, sf, 15, symbols=False).select("session_date", "ts", F.ln(F.col("close") / F.lag("close").over(w)).alias("ret"))


@query(
    "residual_library",
    A.sql(RES + " SELECT epoch(ts)::BIGINT AS ts_sec, round((ret - avg(ret) OVER p) / greatest(stddev_pop(ret) OVER p, 1e-8), 6) AS residual FROM z WINDOW p AS (PARTITION BY session_date)", "v_tape15"),
)
def _(spark, sf):
    return M.residual_library(tape_returns(spark, sf)).select(F.unix_timestamp("ts").alias("ts_sec"), r6("residual", "residual"))


@query(
    "eligible_blocks",
    A.sql(RES + ", n AS (SELECT session_date, ts, row_number() OVER (PARTITION BY session_date ORDER BY ts) AS r, count(*) OVER (PARTITION BY session_date) AS n FROM z) SELECT session_date::VARCHAR AS session_date, count(*) AS starts FROM n WHERE r + 9 <= n GROUP BY 1", "v_tape15"),
)
def _(spark, sf):
    b = M.eligible_blocks(M.residual_library(tape_returns(spark, sf)), 10)
    return b.groupBy(F.col("session_date").cast("string").alias("session_date")).agg(F.count(F.lit(1)).alias("starts"))


@query(
    "session_bootstrap",
    """WITH s AS (SELECT DISTINCT ts::DATE AS d FROM events), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM s),
       x AS (SELECT DISTINCT rep::INT AS replica, ('0x' || substr(md5('42|' || rep || '|' || i), 1, 8))::BIGINT % n AS i FROM r, range(7) t(rep))
       SELECT replica, d::VARCHAR AS session_date FROM x JOIN r USING (i)""",
)
def _(spark, sf):
    s = A.table(spark, sf, "events").select(F.to_date("ts").alias("session_date"))
    return M.session_bootstrap(s).withColumn("session_date", F.col("session_date").cast("string"))


@query(
    "population_stability",
    """WITH r AS (SELECT l_returnflag AS name, l_extendedprice AS v, l_linestatus AS ls FROM lineitem), q AS (SELECT name, list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS c FROM r WHERE ls = 'F' GROUP BY 1),
       b AS (SELECT name, ls, len(list_filter(c, lambda x: x < v)) AS bin, count(*) AS n FROM r JOIN q USING (name) GROUP BY ALL), s AS (SELECT name, ls, bin, n / sum(n) OVER (PARTITION BY name, ls) AS p FROM b)
       SELECT name, round(sum((a.p - z.p) * ln(a.p / z.p)), 6) AS psi FROM s a JOIN s z USING (name, bin) WHERE a.ls = 'F' AND z.ls = 'O' GROUP BY 1""",
)
def _(spark, sf):
    li = A.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("value"), "l_linestatus")
    p = M.population_stability(li.filter("l_linestatus = 'F'"), li.filter("l_linestatus = 'O'"))
    return p.select("name", r6("psi", "psi"))


@query(
    "drift_level",
    """SELECT level, count(*) AS n FROM (SELECT CASE WHEN user_id % 20 = 0 THEN 'rollback' WHEN sk < -0.1 THEN 'rollback' WHEN sk < 0 AND psi < 0.1 THEN 'freeze' WHEN psi >= 0.25 THEN 'freeze' WHEN psi >= 0.1 THEN 'watch' ELSE 'ok' END AS level
         FROM (SELECT user_id, value / 300 AS psi, (user_id % 40) / 100.0 - 0.15 AS sk FROM events)) GROUP BY 1""",
)
def _(spark, sf):
    u = F.col("user_id")
    e = A.table(spark, sf, "events").select((F.col("value") / 300).alias("psi"), (u % 40 / 100.0 - 0.15).alias("brier_skill"), F.when(u % 20 == 0, -1.0).otherwise(0.0).alias("expectancy_delta"))
    return M.drift_level(e).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def group_rows(spark, sf):
    """Quarter-hour observations with every role's label and features known at their time."""
    from pyspark.sql import Window

    from tidemark.operators import labels as L
    from tidemark.plans import labels as PL

    obs, tape = PL.observations(spark, sf), PL.tape(spark, sf)
    labels = L.label_observations(obs, tape, base_bar_minutes=15, horizons={"30m": 30})
    day = Window.partitionBy("session_date").orderBy("ts")
    c = F.col("close")
    features = tape.select(
        F.unix_timestamp("ts").alias("obs_id"), (F.hour("ts") + F.minute("ts") / 60.0).alias("hour"), F.col("volume").cast("double").alias("vol"), (F.col("high") - F.col("low")).alias("width"),
        F.ln(c / F.col("open")).alias("body"), F.ln(c / F.lag("close", 4).over(day)).alias("momentum"), (c - F.floor(c)).alias("wall_place"))
    cols = [r[1] for r in T.ROLES]
    return labels.select("obs_id", "session_date", *cols).join(features, "obs_id")


GROUP = ["hour", "vol", "width", "body", "momentum", "wall_place"]


@query("train_group")
def _(spark, sf):
    report, _, _ = T.train_group(group_rows(spark, sf), GROUP)
    metrics = F.transform_values("metrics", lambda _, v: F.round(v, 6))
    return report.select("role", "label", "n_rows", F.col("trained").cast("int").alias("trained"), "reason", "fold_count", F.to_json(metrics).alias("metrics"), r6("skill", "skill"), F.col("edge").cast("int").alias("edge"))


@query("out_of_fold_predictions")
def _(spark, sf):
    _, held, _ = T.train_group(group_rows(spark, sf), GROUP)
    return held.select("role", "fold", "obs_id", "name", r6("y", "y"), r6("value", "value"))


@query("serve_forecasts")
def _(spark, sf):
    rows = group_rows(spark, sf)
    _, _, group = T.train_group(rows, GROUP)
    group.required = ("hour", "width")
    served = T.serve_group(rows.select("obs_id", *GROUP), group)
    rounded = F.transform_values("forecast", lambda _, m: F.transform_values(m, lambda _, v: F.round(v, 6)))
    return served.select("obs_id", F.col("served").cast("int").alias("served"), "reason", F.to_json(rounded).alias("bundle"))
