"""Regime and archetype labels from minute observations, and their transition matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio, trailing

# fixed values: state names and label thresholds
ARCHETYPES = (
    "calm_pin", "grind_up", "grind_down", "range_chop", "vol_expansion", "squeeze_melt_up", "crash", "gap_shock",
)
REGIMES = ("pin", "drift_up", "drift_down", "compression", "breakout")
MINUTES_PER_YEAR = 98280.0
BREAKOUT_Z, COMPRESSION_Z, TREND_Z = 1.7, 0.6, 0.6
HI_RV_Z, LO_RV_Z, GAP_ABS = 1.20, 0.85, 0.006
CRASH_NET, SQUEEZE_NET, GRIND_NET, CALM_GEX = 0.008, 0.008, 0.004, 0.4
ABS_RV_REF, ABS_MOVE_REF = 0.14, 0.0009


def _returns(obs: DataFrame, session: str, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, session).orderBy("ts")
    prev = F.lag("spot").over(w)
    return obs.withColumn("ret", F.when((F.col("spot") > 0) & (prev > 0), F.ln(F.col("spot") / F.nullif(prev, F.lit(0.0)))))


def label_regimes(obs: DataFrame, window: int = 15, session: str = "session_date", keys: Sequence[str] = ()) -> DataFrame:
    """Regime of every observation after a session's first, relative to the session's own volatility.

    Priority: breakout, compression, drift up, drift down, pin. Windows stay inside a session
    of one series; `keys` name the series (a symbol) where obs holds several.
    """
    rets = _returns(obs, session, keys).filter(F.col("ret").isNotNull())
    w = Window.partitionBy(*keys, session).orderBy("ts")
    rv = F.coalesce(F.stddev_samp("ret").over(trailing(w, window)), F.lit(0.0)) * (MINUTES_PER_YEAR**0.5)
    feat = rets.select("*", rv.alias("rv"), F.sum("ret").over(trailing(w, window)).alias("move"))
    med = F.median(F.when(F.col("rv") > 0, F.col("rv"))).over(Window.partitionBy(*keys, session))
    ctx = feat.withColumn("rv_median", F.coalesce(med, F.lit(0.0)))
    known = F.col("rv_median") > 0
    rv_z = F.when(known, ratio("rv", "rv_median")).otherwise(F.col("rv") / ABS_RV_REF)
    scale = F.when(known, F.col("rv_median") / (MINUTES_PER_YEAR**0.5) * (window**0.5)).otherwise(ABS_MOVE_REF)
    trend = ratio("move", scale)
    regime = (
        F.when(rv_z >= BREAKOUT_Z, "breakout").when(rv_z <= COMPRESSION_Z, "compression")
        .when(trend >= TREND_Z, "drift_up").when(trend <= -TREND_Z, "drift_down").otherwise("pin")
    )
    return ctx.select(*obs.columns, "rv", "move", regime.alias("regime"))


def label_archetypes(obs: DataFrame, session: str = "session_date", keys: Sequence[str] = ()) -> DataFrame:
    """Day-level archetype per session from net move, volatility against the cross-session median, gap, gamma sign."""
    rets = _returns(obs, session, keys)
    day = rets.groupBy(*keys, session).agg(
        F.coalesce(F.sum("ret"), F.lit(0.0)).alias("net"),
        (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) * (MINUTES_PER_YEAR**0.5)).alias("day_rv"),
        F.min_by("spot", "ts").alias("first_spot"),
        F.max_by("spot", "ts").alias("last_spot"),
        F.avg(F.when(F.col("net_gex") > 0, 1.0).otherwise(-1.0)).alias("mean_gex_sign"),
    )
    # one row per session: the calendar bounds both windows
    cal = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    prev = F.lag("last_spot").over(cal.orderBy(session))
    ctx = day.select(
        "*", F.nullif(F.median("day_rv").over(cal), F.lit(0.0)).alias("rv_med"),
        F.coalesce(F.when(prev > 0, F.ln(F.col("first_spot") / prev)), F.lit(0.0)).alias("gap"),
    )
    ref = F.coalesce("rv_med", F.nullif(F.col("day_rv"), F.lit(0.0)), F.lit(1e-9))
    hi, lo, net = F.col("day_rv") >= HI_RV_Z * ref, F.col("day_rv") <= LO_RV_Z * ref, F.col("net")
    archetype = (
        F.when(F.abs("gap") >= GAP_ABS, "gap_shock")
        .when(hi & (net <= -CRASH_NET), "crash")
        .when(hi & (net >= SQUEEZE_NET), "squeeze_melt_up")
        .when(hi, "vol_expansion")
        .when(net >= GRIND_NET, "grind_up")
        .when(net <= -GRIND_NET, "grind_down")
        .when(lo & (F.col("mean_gex_sign") > CALM_GEX), "calm_pin")
        .otherwise("range_chop")
    )
    return ctx.select(*keys, session, archetype.alias("archetype"), "net", "day_rv", "gap", "mean_gex_sign")


def transition_matrix(
    labeled: DataFrame, states: Sequence[str], order: Sequence[str], state: str, sequence: Sequence[str] = (),
    keys: Sequence[str] = (), smoothing: float = 0.5, prior: DataFrame | None = None,
) -> DataFrame:
    """Row-stochastic transition probabilities (keys, from, to, n, p) with Laplace smoothing over the full grid.

    Pairs never cross a `sequence` boundary (a session). A source state never seen takes its prior row, renormalised.
    """
    spark, keys, sequence = labeled.sparkSession, list(keys), list(sequence)
    w = Window.partitionBy(*keys, *sequence).orderBy(*order) if keys or sequence else Window.partitionBy(F.lit(0)).orderBy(*order)
    pairs = labeled.select(*keys, F.col(state).alias("from"), F.lead(state).over(w).alias("to")).filter(F.col("to").isNotNull())
    counts = pairs.groupBy(*keys, "from", "to").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(a, b) for a in states for b in states], "`from` string, `to` string")
    if keys:
        grid = labeled.select(*keys).distinct().join(F.broadcast(grid), F.lit(True))
    full = grid.join(counts, [*keys, "from", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = Window.partitionBy(*keys, "from")
    smoothed = F.col("n") + smoothing
    p = smoothed / F.sum(smoothed).over(row)
    if prior is None:
        return full.select(*keys, "from", "to", "n", p.alias("p"))
    both = full.join(F.broadcast(prior.select("from", "to", F.col("p").alias("prior_p"))), ["from", "to"], "left")
    seen = F.sum("n").over(row) > 0
    fallback = ratio(F.coalesce("prior_p", F.lit(0.0)), F.sum(F.coalesce("prior_p", F.lit(0.0))).over(row))
    has_prior = F.count("prior_p").over(row) > 0
    return both.select(*keys, "from", "to", "n", F.when(~seen & has_prior, fallback).otherwise(p).alias("p"))


def calibrate_regimes(obs: DataFrame, window: int = 15, smoothing: float = 0.5, session: str = "session_date", keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(archetype day chain, regime minute chain per archetype)."""
    days = label_archetypes(obs, session, keys)
    arch = transition_matrix(days, ARCHETYPES, [session], "archetype", keys, smoothing=smoothing)
    minutes = label_regimes(obs, window, session, keys).join(days.select(*keys, session, "archetype"), [*keys, session])
    reg = transition_matrix(minutes, REGIMES, ["ts"], "regime", [*keys, session], ["archetype"], smoothing)
    return arch, reg


def labeler_accuracy(obs: DataFrame, window: int = 15, session: str = "session_date", keys: Sequence[str] = ()) -> DataFrame:
    """Hit rates of the labels against `true_archetype` and `true_regime`; a session's first minute has no label."""
    lab = label_regimes(obs, window, session, keys)
    minutes = lab.agg(
        F.count(F.lit(1)).alias("n_minutes"), F.avg((F.col("regime") == F.col("true_regime")).cast("int")).alias("regime_accuracy")
    )
    truth = obs.groupBy(*keys, session).agg(F.max_by("true_archetype", "ts").alias("t"))
    days = label_archetypes(obs, session, keys).join(truth, [*keys, session]).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg((F.col("archetype") == F.col("t")).cast("int")).alias("archetype_accuracy")
    )
    return minutes.join(F.broadcast(days), F.lit(True))


__all__ = ["Column", "calibrate_regimes", "label_archetypes", "label_regimes", "labeler_accuracy", "transition_matrix"]
