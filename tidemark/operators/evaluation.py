"""Trade, decision and forecast evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.operators.windows import grouped_medians, ranked

PROFIT_FACTOR_CAP = 999.0


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def max_drawdown(
    rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str
) -> DataFrame:
    """Largest fall of running equity below its running peak (the peak starts at 0), per key.

    Chunks (sessions) are scanned independently to (total, highest prefix, lowest prefix, own drawdown) and then
    combined over one row per (key, chunk), so a key's whole history never sits in one task.
    """
    keys = list(keys)
    part = [*keys, chunk]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scan = rows.select(*part, *order, F.sum(value).over(w).alias("_p"))
    peaks = scan.withColumn("_m", F.max("_p").over(w))
    blocks = peaks.groupBy(*part).agg(
        F.max_by("_p", F.struct(*order)).alias("_total"),
        F.max("_p").alias("_maxp"),
        F.min("_p").alias("_minp"),
        F.max(F.col("_m") - F.col("_p")).alias("_dd"),
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    off = blocks.withColumn("_off", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    peak = off.withColumn(
        "_peak", F.greatest(F.coalesce(F.max(F.col("_off") + F.col("_maxp")).over(before), F.lit(0)), F.lit(0))
    )
    return peak.groupBy(*keys).agg(
        F.max(F.greatest(F.col("_dd"), F.col("_peak") - F.col("_off") - F.col("_minp"), F.lit(0)))
        .cast("double")
        .alias("maximum_drawdown")
    )


def worst_tail_mean(rows: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], share: float = 0.05) -> DataFrame:
    """Mean of the worst share of values per key (at least one); exact ranks without one task per key."""
    r = ranked(rows, keys, value, tie)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share + 0.9999))
    return r.filter(F.col("rank") <= k).groupBy(*keys).agg((F.avg(F.col(value).cast("double"))).alias("cvar"))


def evaluate_trades(trades: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """One result row per key from settled outcomes; a trade counts when traded and not abstained."""
    keys = list(keys)
    pnl = F.col("pnl").cast("double")
    took = F.col("was_traded") & ~F.col("abstained")
    t = lambda x: F.when(took, x)
    agg = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(took).alias("trade_count"),
        F.coalesce(F.sum(t(F.col("pnl"))), F.lit(0)).alias("net_pnl"),
        F.count_if(took & (pnl > 0)).alias("n_win"),
        F.count_if(took & (pnl < 0)).alias("n_loss"),
        or_zero(F.sum(t(F.when(pnl > 0, pnl)))).alias("gross_win"),
        or_zero(-F.sum(t(F.when(pnl < 0, pnl)))).alias("gross_loss"),
        or_zero(F.sum(t(F.when(F.col("max_loss") > 0, F.col("max_loss").cast("double"))))).alias("risk"),
        F.count_if("abstained").alias("n_abstain"),
        F.count_if(took & F.col("false_positive")).alias("n_fp"),
        F.count_if("vetoed").alias("n_veto"),
        or_zero(F.avg("brier")).alias("brier_score"),
        or_zero(F.avg("log_loss")).alias("log_loss"),
        or_zero(F.stddev_samp(t(pnl))).alias("realized_move_error"),
    )
    sessions = trades.groupBy(*keys, "session_date").agg(F.lit(1).alias("_s")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("session_count")
    )
    real = trades.filter(took).select(*keys, "session_date", "trade_id", "pnl")
    dd = max_drawdown(real, keys, "session_date", ["trade_id"], "pnl")
    tail = worst_tail_mean(real, keys, "pnl", ["trade_id"])
    net, n = F.col("net_pnl").cast("double"), F.col("trade_count")
    joined = agg.join(sessions, keys).join(dd, keys, "left").join(tail, keys, "left")
    return joined.select(
        *keys,
        net.alias("net_pnl"),
        or_zero(ratio(net, n)).alias("expectancy"),
        or_zero(ratio(net, "risk")).alias("return_on_defined_risk"),
        or_zero(F.col("maximum_drawdown")).alias("maximum_drawdown"),
        or_zero(F.col("cvar")).alias("cvar"),
        or_zero(ratio("n_win", n)).alias("win_rate"),
        F.when(F.col("gross_loss") > 0, ratio("gross_win", "gross_loss"))
        .when(F.col("gross_win") > 0, PROFIT_FACTOR_CAP)
        .otherwise(0.0)
        .alias("profit_factor"),
        or_zero(ratio("n_abstain", "n_all")).alias("abstention_rate"),
        or_zero(ratio("n_fp", n)).alias("false_positive_trade_rate"),
        or_zero(ratio("n_veto", F.col("n_veto") + F.col("n_loss"))).alias("veto_effectiveness"),
        "brier_score",
        "log_loss",
        "realized_move_error",
        "trade_count",
        "session_count",
    )


def compare_variants(results: DataFrame, baseline: str, key: str = "variant") -> DataFrame:
    """Each variant against the baseline row, with the change in net P&L, drawdown and CVaR."""
    base = results.filter(F.col(key) == baseline).select(
        *[F.col(c).alias(f"base_{c}") for c in ("net_pnl", "expectancy", "maximum_drawdown", "cvar")]
    )
    # one row by construction: the result row of a single variant
    others = results.filter(F.col(key) != baseline)
    return others.join(F.broadcast(base.limit(1)), F.lit(True)).select(
        key,
        F.lit(baseline).alias("baseline"),
        "net_pnl",
        "base_net_pnl",
        (F.col("net_pnl") - F.col("base_net_pnl")).alias("delta_net_pnl"),
        (F.col("maximum_drawdown") - F.col("base_maximum_drawdown")).alias("delta_drawdown"),
        (F.col("cvar") - F.col("base_cvar")).alias("delta_cvar"),
    )


def decision_report(matches: DataFrame, keys: Sequence[str] = ("authority",)) -> tuple[DataFrame, DataFrame]:
    """(per-key report, per-(key, session) rows) from matched decisions."""
    keys = list(keys)
    win = F.col("win").cast("int")
    per_session = matches.groupBy(*keys, "session_date").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("pnl").alias("total_pnl"),
        F.sum(win).alias("wins"),
        F.sum(F.col("direction_hit").cast("int")).alias("hits"),
        F.count("direction_hit").alias("n_dir"),
        F.sum("regret").alias("regret_sum"),
        F.count("regret").alias("n_regret"),
        F.sum(F.abs(F.coalesce("confidence", F.lit(0.0)) - win)).alias("cal_sum"),
    )
    report = per_session.groupBy(*keys).agg(
        F.sum("trades").alias("trades"),
        F.round(F.sum("total_pnl"), 6).alias("total_pnl"),
        ratio(F.sum("wins"), F.sum("trades")).alias("win_rate"),
        F.round(F.avg("total_pnl"), 6).alias("mean_session_pnl"),
        F.avg((F.col("total_pnl") > 0).cast("int")).alias("session_win_rate"),
        ratio(F.sum("hits"), F.sum("n_dir")).alias("dir_hit"),
        F.round(ratio(F.sum("regret_sum"), F.sum("n_regret")), 6).alias("regret"),
        F.round(ratio(F.sum("cal_sum"), F.sum("trades")), 6).alias("calibration_error"),
        F.count(F.lit(1)).alias("n_sessions"),
    )
    rows = per_session.select(
        *keys, "session_date", "trades", F.round("total_pnl", 6).alias("total_pnl"),
        ratio("wins", "trades").alias("win_rate"),
    )
    return report, rows


def archetype_matrix(matches: DataFrame, archetype: str = "archetype", universe: str = "universe_id") -> DataFrame:
    """Per archetype: universes, snapshots, mean session P&L, win rate, direction hit rate, trades."""
    per = matches.groupBy(archetype, universe, "session_date").agg(
        F.sum("pnl").alias("spnl"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.col("direction_hit").cast("int")).alias("hits"),
        F.count("direction_hit").alias("n_dir"),
    )
    uni = per.groupBy(archetype, universe).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("spnl").alias("pnl"),
        F.count_if(F.col("spnl") > 0).alias("wins"), F.sum("trades").alias("trades"),
        F.sum("hits").alias("hits"), F.sum("n_dir").alias("n_dir"),
    )
    return uni.groupBy(archetype).agg(
        F.count(F.lit(1)).alias("n_universes"),
        F.sum("trades").alias("trades"),
        F.round(ratio(F.sum("pnl"), F.sum("sessions")), 6).alias("mean_session_pnl"),
        ratio(F.sum("wins"), F.sum("sessions")).alias("session_win_rate"),
        ratio(F.sum("hits"), F.sum("n_dir")).alias("dir_hit"),
        F.sum("sessions").alias("n_sessions"),
        F.round(F.sum("pnl"), 6).alias("total_pnl"),
    )


def score_by_archetype(matches: DataFrame, archetype: str = "archetype", authority: str = "authority") -> DataFrame:
    """Totals for authority × archetype and for each authority over all archetypes, in one pass (rollup)."""
    return (
        matches.rollup(authority, archetype)
        .agg(
            F.count(F.lit(1)).alias("trades"), F.round(F.sum("pnl"), 6).alias("total_pnl"),
            F.avg(F.col("win").cast("int")).alias("win_rate"),
        )
        .filter(F.col(authority).isNotNull())
        .withColumn(archetype, F.coalesce(archetype, F.lit("ALL")))
    )


def losing_archetypes(matrix: DataFrame, min_sessions: int = 1) -> DataFrame:
    """Archetypes with a negative mean session P&L and enough sessions, worst first."""
    return matrix.filter((F.col("n_sessions") >= min_sessions) & (F.col("mean_session_pnl") < 0)).orderBy(
        "mean_session_pnl", "archetype"
    )


def coverage_matrix(minutes: DataFrame, archetypes: Sequence[str], regimes: Sequence[str]) -> DataFrame:
    """Minutes per (archetype, regime) over the full grid, with the share of cells visited; unvisited cells are 0."""
    spark = minutes.sparkSession
    grid = spark.createDataFrame([(a, r) for a in archetypes for r in regimes], "archetype string, regime string")
    seen = minutes.groupBy("archetype", "regime").agg(F.sum("minutes").alias("minutes"))
    full = grid.join(seen, ["archetype", "regime"], "left").withColumn("minutes", F.coalesce("minutes", F.lit(0)))
    # the grid is the fixed catalogue (archetypes × regimes), so one global window over it is bounded
    every = Window.partitionBy(F.lit(0))
    return full.select("*", F.avg((F.col("minutes") > 0).cast("int")).over(every).alias("visited_share"))


def reliability_bins(scored: DataFrame, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins of p (the last one closed): count, mean prediction, observed rate; empty bins absent."""
    b = F.least(F.floor(F.col("p") * n_bins), F.lit(n_bins - 1)).cast("int")
    return scored.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed")
    )


TRAINING_EPS = 1e-6
FORECAST_EPS = 1e-12


def log_loss_of(p: Column, y: Column, eps: float = TRAINING_EPS) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q))


def pinball_of(y: Column, q: Column, tau: float) -> Column:
    d = y - q
    return F.greatest(tau * d, (tau - 1.0) * d)


def probability_scores(scored: DataFrame, keys: Sequence[str] = (), eps: float = TRAINING_EPS) -> DataFrame:
    """Brier, log loss and Brier skill against the base rate; p and y columns."""
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"),
        F.avg(log_loss_of(F.col("p"), F.col("y"), eps)).alias("log_loss"),
        F.avg("y").alias("base_rate"),
    )
    reference = F.col("base_rate") * (1.0 - F.col("base_rate"))
    return agg.withColumn("brier_skill", F.when(reference > 0, 1.0 - ratio("brier", reference)))


def forecast_scores(scored: DataFrame, tau: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Pinball loss, interval coverage and MAE skill; columns y, pred, lower, upper, naive."""
    y = F.col("y")
    agg = scored.groupBy(*keys).agg(
        F.avg(pinball_of(y, F.col("pred"), tau)).alias("pinball"),
        F.avg(((y >= F.col("lower")) & (y <= F.col("upper"))).cast("int")).alias("coverage"),
        F.avg(F.abs(y - F.col("pred"))).alias("mae"),
        F.avg(F.abs(y - F.col("naive"))).alias("naive_mae"),
    )
    return agg.withColumn("mae_skill", F.when(F.col("naive_mae") > 0, 1.0 - ratio("mae", "naive_mae")))


def confusion_matrix(scored: DataFrame, classes: Sequence) -> DataFrame:
    """Counts by (true, predicted) with one column per predicted class."""
    return scored.groupBy("y_true").pivot("y_pred", list(classes)).count().na.fill(0)


def multiclass_scores(scored: DataFrame, classes: Sequence, eps: float = FORECAST_EPS) -> DataFrame:
    """Accuracy, macro Brier and log loss from y_true and a map of class probabilities."""
    p = lambda k: F.coalesce(F.col("probs")[F.lit(k)], F.lit(0.0))
    brier = sum((F.pow(p(k) - (F.col("y_true") == k).cast("int"), F.lit(2.0)) for k in classes), F.lit(0.0)) / len(classes)
    own = F.least(F.greatest(F.coalesce(F.try_element_at("probs", "y_true"), F.lit(0.0)), F.lit(eps)), F.lit(1.0))
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"),
        F.avg(brier).alias("macro_brier"),
        F.avg(-F.ln(own)).alias("log_loss"),
    )


def fill_support(fills: DataFrame) -> DataFrame:
    """Attempts / fills per family and overall → the level a family's fill model may use."""
    per = fills.groupBy("family").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("filled") & F.col("fill_credit").isNotNull()).alias("fills")
    )
    every = Window.partitionBy(F.lit(0))  # one row per family (13 approved families)
    both = per.select("*", F.sum("attempts").over(every).alias("ga"), F.sum("fills").over(every).alias("gf"))
    level = (
        F.when((F.col("attempts") >= 50) & (F.col("fills") >= 25), "exact_family")
        .when((F.col("ga") >= 200) & (F.col("gf") >= 100), "global_empirical")
        .otherwise("deterministic_prior")
    )
    return both.select("family", "attempts", "fills", level.alias("fallback_level"))


def expert_support(rows: DataFrame, regime: str = "regime", session: str = "session_date", minimum: int = 20) -> DataFrame:
    """Distinct sessions and rows per regime; a regime below the minimum falls back to the global expert."""
    per = rows.groupBy(regime, session).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(regime).agg(
        F.count(F.lit(1)).alias("support_sessions"), F.sum("n").alias("n_rows")
    ).withColumn("available", F.col("support_sessions") >= minimum)


def top_decile_edge(rows: DataFrame, prediction: str = "pred", outcome: str = "pnl", tie: str = "id") -> DataFrame:
    """Mean outcome of the top tenth by prediction (at least one row) minus the overall mean."""
    r = ranked(rows.withColumn("_neg", -F.col(prediction)), [], "_neg", [tie])
    top = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return r.agg(
        F.max("n").alias("n"),
        F.avg(F.when(top, F.col(outcome))).alias("top_decile_mean"),
        F.avg(outcome).alias("overall_mean"),
        (F.avg(F.when(top, F.col(outcome))) - F.avg(outcome)).alias("edge"),
    )


def feature_medians(long_features: DataFrame) -> DataFrame:
    """Exact median per feature name, rounded to 6 digits; null for a name without values. No task holds a name's values."""
    names = long_features.select(F.col("name").alias("_name")).distinct()
    found = names.join(grouped_medians(long_features, ["name"], "value"), F.col("_name").eqNullSafe(F.col("name")), "left")
    return found.select(F.col("_name").alias("name"), F.round("median", 6).alias("median"))


def medians_fingerprint(medians: DataFrame) -> DataFrame:
    """Content hash of the (bounded) feature-median table."""
    rows = F.sort_array(F.collect_list(F.struct("name", "median")))
    return medians.agg(F.sha2(F.to_json(rows), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_features"))


def observation_census(snapshots: DataFrame, observations: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Usable observations and skipped snapshots per session."""
    used = snapshots.join(observations.select(key).withColumn("_u", F.lit(1)), key, "left")
    return used.groupBy("session_date").agg(
        F.count("_u").alias("n_observations"), F.count_if(F.col("_u").isNull()).alias("n_skipped")
    )


def recording_status(ticks: DataFrame, now: Column) -> DataFrame:
    """Latest session with its tick count and the age of its last tick in seconds."""
    per = ticks.groupBy("session_date").agg(F.count(F.lit(1)).alias("ticks"), F.max("ts").alias("last_tick"))
    return per.orderBy(F.col("session_date").desc()).limit(1).withColumn(
        "age_seconds", (F.unix_micros(now) - F.unix_micros("last_tick")) / 1e6
    )


def token_usage(calls: DataFrame, prices: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Daily calls, tokens and cost per model; the first matching price pattern applies (per million tokens)."""
    pin, pout = F.lit(None).cast("double"), F.lit(None).cast("double")
    for pattern, p_in, p_out in reversed(list(prices)):
        hit = F.contains(F.lower("model"), F.lit(pattern))
        pin, pout = F.when(hit, F.lit(p_in)).otherwise(pin), F.when(hit, F.lit(p_out)).otherwise(pout)
    return (
        calls.select("day", "model", "input_tokens", "output_tokens", pin.alias("pin"), pout.alias("pout"))
        .groupBy("day", "model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            (F.sum(F.col("input_tokens") * F.col("pin") + F.col("output_tokens") * F.col("pout")) / 1e6).alias("cost"),
        )
    )


def uniform_versions(snapshots: DataFrame, columns: Sequence[str] = ("schema_version", "normalization_version")) -> DataFrame:
    """Distinct versions per column and whether each is uniform."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("version")) for c in columns])
    per = snapshots.select(F.inline(rows)).groupBy("column", "version").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_versions"), (F.count(F.lit(1)) == 1).alias("uniform")
    )


def retention_check(before: DataFrame, after: DataFrame, tolerance: float = 0.05, key: str = "session_date") -> DataFrame:
    """Forward transfer, mean regression (forgetting) and whether retention holds, from per-session scores."""
    d = before.select(key, F.col("score").alias("b")).join(after.select(key, F.col("score").alias("a")), key)
    loss = F.col("b") - F.col("a")
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("a") - F.sum("b")).alias("forward_transfer"),
        or_zero(F.avg(F.when(loss > 0, loss))).alias("forgetting_penalty"),
    ).withColumn("retained", F.col("forgetting_penalty") <= tolerance)


# -- attribution ------------------------------------------------------------------------------------------------
CENTS = "decimal(18,4)"


def _pnl(entry: Column, exit_: Column, contracts: Column, multiplier: int) -> Column:
    return F.bround(((exit_ - entry) * contracts * multiplier).cast("decimal(28,8)"), 4).cast(CENTS)


def attribute_trades(
    planned: DataFrame, actual: DataFrame, multiplier: int = 100, size_tolerance: float = 0.10, late_seconds: float = 120.0
) -> DataFrame:
    """Model versus actual P&L per snapshot, split in participation, selection, sizing, entry and exit.

    Each step changes one attribute of the trade and is priced against the step before, so the five components sum
    exactly to the gap (`reconciles`). Prices are signed position values.
    """
    zero = F.lit(0).cast(CENTS)
    p = planned.select("snapshot_id", F.struct("*").alias("p"))
    a = actual.select("snapshot_id", F.struct("*").alias("a"))
    j = p.join(a, "snapshot_id", "full_outer")
    P, Q = (lambda n: F.col(f"p.{n}")), (lambda n: F.col(f"a.{n}"))
    has_p, has_a = F.col("p").isNotNull(), F.col("a").isNotNull()
    both = has_p & has_a
    same = P("candidate_id") == Q("candidate_id")
    m_in = F.coalesce(Q("modeled_entry_price"), F.when(same, P("entry_price")).otherwise(Q("entry_price")))
    m_out = F.coalesce(Q("modeled_exit_price"), F.when(same, P("exit_price")).otherwise(Q("exit_price")))
    p0 = _pnl(P("entry_price"), P("exit_price"), P("contracts"), multiplier)
    p1 = _pnl(m_in, m_out, P("contracts"), multiplier)
    p2 = _pnl(m_in, m_out, Q("contracts"), multiplier)
    p3 = _pnl(Q("entry_price"), m_out, Q("contracts"), multiplier)
    p4 = _pnl(Q("entry_price"), Q("exit_price"), Q("contracts"), multiplier)
    priced = j.select(
        "snapshot_id",
        F.coalesce(P("session_date"), Q("session_date")).alias("session_date"),
        P("candidate_id").alias("planned_candidate_id"),
        Q("candidate_id").alias("actual_candidate_id"),
        Q("entry_at").alias("entry_at"), Q("exit_at").alias("exit_at"), Q("approved").alias("approved"),
        P("contracts").alias("pc"), Q("contracts").alias("qc"),
        P("decided_at").alias("decided_at"), P("planned_exit_at").alias("planned_exit_at"),
        F.when(has_p, p0).otherwise(zero).alias("model_pnl"),
        F.when(has_a, p4).otherwise(zero).alias("actual_pnl"),
        F.when(both, zero).when(has_a, p4).otherwise(-p0).cast(CENTS).alias("participation"),
        F.when(both, p1 - p0).otherwise(zero).cast(CENTS).alias("selection"),
        F.when(both, p2 - p1).otherwise(zero).cast(CENTS).alias("sizing"),
        F.when(both, p3 - p2).otherwise(zero).cast(CENTS).alias("entry"),
        F.when(both, p4 - p3).otherwise(zero).cast(CENTS).alias("exit"),
        has_p.alias("has_plan"), has_a.alias("has_actual"),
    )
    both = F.col("has_plan") & F.col("has_actual")
    drift = F.when(both & (F.col("pc") > 0), ratio(F.col("qc") - F.col("pc"), "pc"))
    late = F.when(both, (F.unix_micros("entry_at") - F.unix_micros("decided_at")) / 1e6)
    held = F.when(both, F.unix_micros("exit_at") - F.unix_micros("planned_exit_at"))
    unapproved = F.when(F.col("has_plan"), F.col("has_actual") & ~F.coalesce("approved", F.lit(True))).otherwise(True)
    from tidemark.functions.exprs import codes

    components = ("participation", "selection", "sizing", "entry", "exit")
    gap = (F.col("actual_pnl") - F.col("model_pnl")).cast(CENTS)
    total = sum((F.col(c) for c in components[1:]), F.col(components[0]))
    return priced.select(
        "snapshot_id", "session_date", "planned_candidate_id", "actual_candidate_id", "entry_at", "exit_at",
        "model_pnl", "actual_pnl", gap.alias("gap"), *components,
        (total == gap).alias("reconciles"),
        unapproved.alias("unapproved"),
        codes(
            (~F.col("has_actual"), "missed_signal"),
            (unapproved, "unapproved_trade"),
            (drift > size_tolerance, "oversized"),
            (drift < -size_tolerance, "undersized"),
            (late > late_seconds, "late_entry"),
            (held < 0, "premature_exit"),
            (held > 0, "held_past_plan"),
        ).alias("flags"),
    )


def shadow_account(attributed: DataFrame, keys: Sequence[str] = ("session_date",)) -> DataFrame:
    """Model book and actual book per key: totals, components, win rates, expectancies, verdict."""
    planned, taken = F.col("planned_candidate_id").isNotNull(), F.col("actual_candidate_id").isNotNull()
    components = ("participation", "selection", "sizing", "entry", "exit")
    agg = attributed.groupBy(*keys).agg(
        F.count_if(planned).alias("n_planned"),
        F.count_if(taken).alias("n_taken"),
        F.count_if(F.array_contains("flags", "missed_signal")).alias("n_missed"),
        F.count_if(F.array_contains("flags", "unapproved_trade")).alias("n_unapproved"),
        F.sum("model_pnl").alias("model_pnl"),
        F.sum("actual_pnl").alias("actual_pnl"),
        *[F.sum(c).alias(c) for c in components],
        F.avg(F.when(planned, (F.col("model_pnl") > 0).cast("int"))).alias("model_win_rate"),
        F.avg(F.when(taken, (F.col("actual_pnl") > 0).cast("int"))).alias("actual_win_rate"),
        F.sum(F.when(planned, F.col("model_pnl"))).alias("_mp"),
        F.sum(F.when(taken, F.col("actual_pnl"))).alias("_ap"),
    )
    mean = lambda s, n: F.bround(F.coalesce(F.try_divide(F.col(s), F.col(n)), F.lit(0)).cast("decimal(28,10)"), 4)
    gap = F.col("actual_pnl") - F.col("model_pnl")
    good, ok = F.col("model_pnl") > 0, gap >= 0
    verdict = (
        F.when(F.col("n_taken") == 0, "no_data").when(good & ok, "healthy").when(good, "execution_drag")
        .when(ok, "model_weak").otherwise("model_weak_and_execution_drag")
    )
    return agg.select(
        *keys, "n_planned", "n_taken", "n_missed", "n_unapproved", "model_pnl", "actual_pnl", gap.alias("gap"),
        *components, "model_win_rate", "actual_win_rate",
        mean("_mp", "n_planned").alias("model_expectancy"), mean("_ap", "n_taken").alias("actual_expectancy"),
        verdict.alias("verdict"),
    )


def flag_counts(attributed: DataFrame) -> DataFrame:
    return attributed.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def session_flags(attributed: DataFrame, max_unapproved: int = 1, ratio_limit: float = 1.5) -> DataFrame:
    """Sessions that overtrade: too many unapproved trades, or far more taken than approved."""
    per = attributed.groupBy("session_date").agg(
        F.count("planned_candidate_id").alias("approved"),
        F.count("actual_candidate_id").alias("taken"),
        F.count_if("unapproved").alias("unapproved"),
    )
    over = (F.col("unapproved") > max_unapproved) | (
        (F.col("approved") > 0) & (F.col("taken") > F.col("approved") * ratio_limit)
    )
    return per.filter(over)
