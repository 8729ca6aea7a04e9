"""Ranking, policies, what-if knobs, promotion gates and curriculum weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, codes, mean_known, uniform_hash


def rank_snapshot(candidates: DataFrame) -> DataFrame:
    """Rank per snapshot: vetoed last, then utility desc, uncertainty asc, capital asc, id asc.

    Adds rank, the margin of the first over the second selectable one, and regret (best utility − own).
    """
    w = Window.partitionBy("snapshot_id").orderBy(
        F.col("vetoed"), F.coalesce("utility", F.lit(0.0)).desc(), "uncertainty", "capital", "candidate_id"
    )
    every = Window.partitionBy("snapshot_id")
    free = F.when(~F.col("vetoed"), F.coalesce("utility", F.lit(0.0)))
    r = candidates.select(
        "*", F.row_number().over(w).alias("rank"), F.lead(free).over(w).alias("_next"), F.max(free).over(every).alias("_best")
    )
    return r.select(
        *candidates.columns, "rank",
        F.when((F.col("rank") == 1) & ~F.col("vetoed"), F.col("utility") - F.col("_next")).alias("margin"),
        (F.col("_best") - F.coalesce("utility", F.lit(0.0))).alias("regret"),
    )


def top_k(candidates: DataFrame, k: int = 8) -> DataFrame:
    """First k per snapshot by utility (unknown last), then rank, then id; k <= 0 keeps all.

    `row_number <= k` lets Spark cut each task to k rows per snapshot before the shuffle.
    """
    w = Window.partitionBy("snapshot_id").orderBy(F.col("utility").desc_nulls_last(), F.col("rank").asc_nulls_last(), "candidate_id")
    r = candidates.withColumn("position", F.row_number().over(w))
    return r.filter(F.col("position") <= k) if k > 0 else r


def rank_by_value(candidates: DataFrame) -> DataFrame:
    """Position by expected value, unpriced last, then id."""
    w = Window.partitionBy("snapshot_id").orderBy(F.col("expected_value").desc_nulls_last(), "candidate_id")
    return candidates.withColumn("position", F.row_number().over(w))


# fixed values: utility penalties
UTILITY = {"shortfall": 0.50, "tail": 0.25, "fill": 0.25, "model": 0.25, "forecast": 0.20, "ood": 0.20, "capital": 0.10}


def candidate_utility(df: DataFrame, budget: float = 1.0) -> DataFrame:
    """Expected net P&L minus penalties for shortfall, tail, execution, model, forecast, OOD and capital."""
    c, z = F.col, lambda n: F.coalesce(F.col(n), F.lit(0.0))
    low = F.coalesce("pnl_q05", "pnl_q10")
    tail = F.coalesce(F.greatest(c("pnl_q50") - low, F.lit(0.0)), F.lit(0.0))
    tail = F.when(c("pnl_q50").isNull() | low.isNull(), 0.0).otherwise(tail)
    u = (
        z("expected_net_pnl") - UTILITY["shortfall"] * z("expected_shortfall") - UTILITY["tail"] * tail
        - UTILITY["fill"] * z("execution_uncertainty") - UTILITY["model"] * z("model_uncertainty")
        - UTILITY["forecast"] * z("forecast_uncertainty") - UTILITY["ood"] * z("ood_score")
        - UTILITY["capital"] * z("capital_required") / max(budget, 1e-9)
    )
    return df.withColumn("utility", u)


@dataclass(frozen=True)
class MetaThresholds:
    # fixed values: abstention thresholds
    uncertainty: float = 0.75
    ood: float = 0.95
    data_quality: float = 0.60
    trade_probability: float = 0.58
    order_value: float = 0.0
    utility: float = 0.0


def meta_action(df: DataFrame, t: MetaThresholds | None = None) -> DataFrame:
    """TRADE / NO_EDGE / ABSTAIN / HARD_VETO with reasons; a veto overrides, abstention beats no-edge."""
    t, c = t or MetaThresholds(), F.col
    abstain = codes(
        (c("composite_uncertainty") >= t.uncertainty, "uncertainty_abstain"),
        (c("ood_score") >= t.ood, "ood_abstain"),
        (c("data_quality") < t.data_quality, "low_data_quality"),
    )
    edge = (
        F.when(c("selected_candidate_id").isNull(), "no_selected_candidate")
        .when(c("p_positive_utility") < t.trade_probability, "low_trade_probability")
        .when(c("expected_order_value") < t.order_value, "non_positive_order_value")
        .when(c("selected_candidate_utility") < t.utility, "utility_below_minimum")
    )
    staged = df.withColumn("_a", abstain).withColumn("_e", edge)
    veto = F.transform("hard_vetoes", lambda v: F.concat(F.lit("hard_veto:"), v))
    base = F.when(F.size("_a") > 0, F.col("_a")).when(F.col("_e").isNotNull(), F.array("_e")).otherwise(F.array().cast("array<string>"))
    action = (
        F.when(F.size("hard_vetoes") > 0, "HARD_VETO").when(F.size("_a") > 0, "ABSTAIN").when(F.col("_e").isNotNull(), "NO_EDGE").otherwise("TRADE")
    )
    return staged.select(
        *df.columns, action.alias("meta_action"), F.concat(base, veto).alias("meta_reasons"),
        F.when(action == "TRADE", c("selected_candidate_id")).alias("meta_candidate_id"),
    )


# -- policies ------------------------------------------------------------------------------------------------------
def policy_inputs(snapshots: DataFrame, legacy: DataFrame, envelopes: DataFrame, universe: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per snapshot: vetoes, permissions, size cap, risk cap, candidates in universe order, forecast fields.

    A snapshot's candidates are bounded; they fold into one ordered array before the joins.
    """
    cands = universe.groupBy("snapshot_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "candidate_id", "direction", "max_loss", "rank", "utility"))).alias("candidates")
    )
    empty = F.array().cast("array<struct<position:int,candidate_id:string,direction:string,max_loss:double,rank:int,utility:double>>")
    out = snapshots.select("snapshot_id", "inputs_present")
    for side in (legacy, envelopes, cands, forecasts):
        out = out.join(side, "snapshot_id", "left")
    return out.withColumn("candidates", F.coalesce("candidates", empty)).withColumn(
        "vetoes", F.coalesce("vetoes", F.array().cast("array<string>"))
    )


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _decision(name: str, steps: Sequence[tuple[Column, str, str]], chosen: Column, reason: str, confidence: Column) -> Column:
    """First matching (condition, action, reason) step, else SELECT_CANDIDATE, as a struct over the columns of policy inputs."""
    over = F.coalesce(chosen["max_loss"] > F.col("risk_cap"), F.lit(False))
    action, why = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for cond, act, code in [*steps, (chosen.isNull(), "NO_EDGE", "empty_universe"), (over, "NO_EDGE", "risk_envelope")]:
        hit = F.coalesce(cond, F.lit(False))
        action, why = action.when(hit, act), why.when(hit, code)
    action, why = action.otherwise("SELECT_CANDIDATE"), why.otherwise(reason)
    return F.struct(
        F.lit(name).alias("policy"), action.alias("action"),
        F.when(action == "SELECT_CANDIDATE", chosen["candidate_id"]).alias("candidate_id"),
        why.alias("reason"), F.when(action == "SELECT_CANDIDATE", confidence).otherwise(0.0).alias("confidence"),
    )


def legacy_view() -> Column:
    return _decision(
        "legacy",
        [
            (~F.col("inputs_present"), "ABSTAIN", "missing_inputs"),
            (F.size("vetoes") > 0, "ABSTAIN", "hard_veto"),
            (~F.col("permitted"), "NO_EDGE", "permissions_deny"),
        ],
        _first(F.col("candidates")), "legacy_select", clip(F.coalesce("structural_confidence", F.lit(0.5)), 0.0, 1.0),
    )


def v2_view(max_uncertainty: float = 0.75, min_quality: float = 0.40, min_prob: float = 0.58) -> Column:
    p = F.col("p_up")
    edge = F.greatest(p, 1.0 - p)
    unc = F.coalesce(F.nullif("uncertainty", F.lit(0.0)), F.lit(0.5))
    aligned = F.filter(
        "candidates", lambda x: F.when(p >= 0.5, x["direction"].isin("bullish", "long_vol")).otherwise(x["direction"].isin("bearish", "long_vol"))
    )
    chosen = F.coalesce(_first(aligned), _first(F.col("candidates")))
    return _decision(
        "v2",
        [
            (~F.col("inputs_present") | ~F.col("has_forecast"), "ABSTAIN", "missing_forecast"),
            (F.size("vetoes") > 0, "ABSTAIN", "hard_veto"),
            (~F.col("permitted"), "NO_EDGE", "permissions_deny"),
            (unc >= max_uncertainty, "ABSTAIN", "high_uncertainty"),
            (F.coalesce("data_quality", F.lit(0.0)) < min_quality, "ABSTAIN", "low_data_quality"),
            (p.isNull(), "ABSTAIN", "missing_direction"),
            (edge < min_prob, "NO_EDGE", "no_directional_edge"),
        ],
        chosen, "v2_select", F.least(edge, F.lit(1.0)),
    )


def v3_view() -> Column:
    ranked = F.sort_array(F.transform(F.filter("candidates", lambda x: x["rank"].isNotNull()), lambda x: F.struct(x["rank"].alias("rank"), x["candidate_id"].alias("candidate_id"), x["max_loss"].alias("max_loss"))))
    chosen = _first(ranked)
    meta = F.col("meta_action")
    return _decision(
        "v3",
        [
            (~F.col("inputs_present"), "ABSTAIN", "missing_inputs"),
            (F.size("vetoes") > 0, "ABSTAIN", "hard_veto"),
            (~F.col("permitted"), "NO_EDGE", "permissions_deny"),
            (meta == "HARD_VETO", "ABSTAIN", "meta_hard_veto"),
            (meta == "ABSTAIN", "ABSTAIN", "meta_abstain"),
            (meta == "NO_EDGE", "NO_EDGE", "meta_no_edge"),
            (chosen.isNull(), "NO_EDGE", "no_ranked_candidate"),
        ],
        chosen, "v3_rank_select", F.lit(0.7),
    )


def policy_views(inputs: DataFrame, *views: Column) -> DataFrame:
    """One row per (snapshot, policy), of all three policies or of the given ones, out of one pass over the inputs."""
    return inputs.select("snapshot_id", F.inline(F.array(*(views or (legacy_view(), v2_view(), v3_view())))))


def policy_legacy(inputs: DataFrame) -> DataFrame:
    """First candidate in universe order when nothing vetoes and the view permits."""
    return policy_views(inputs, legacy_view())


def policy_v2(inputs: DataFrame, max_uncertainty: float = 0.75, min_quality: float = 0.40, min_prob: float = 0.58) -> DataFrame:
    """Directional policy: probability edge, then the first candidate aligned with it (else the first)."""
    return policy_views(inputs, v2_view(max_uncertainty, min_quality, min_prob))


def policy_v3(inputs: DataFrame) -> DataFrame:
    """Meta action first, then the best-ranked candidate within the risk cap."""
    return policy_views(inputs, v3_view())


def _mode(names: Column) -> Column:
    """(minus its count, name) of the most frequent name, ties to the lower one; NULL of an empty array."""
    return F.array_min(
        F.transform(F.array_distinct(names), lambda a: F.struct((-F.size(F.filter(names, lambda x: x == a))).alias("k"), a.alias("a")))
    )


def _tallied(views: DataFrame, *sides: Column) -> DataFrame:
    """One row per snapshot: `sides`, the modal action and candidate with their counts. A snapshot has one vote a policy."""
    vote = F.struct("action", "candidate_id")
    votes = views.groupBy("snapshot_id").agg(*sides, F.collect_list(vote).alias("votes"))
    selects = F.filter("votes", lambda v: (v["action"] == "SELECT_CANDIDATE") & v["candidate_id"].isNotNull())
    named = votes.withColumns({"actions": F.transform("votes", lambda v: v["action"]), "selected": F.transform(selects, lambda v: v["candidate_id"])})
    return named.withColumns({
        "m": _mode(F.col("actions")), "mc": _mode(F.col("selected")),
        "action_conflict": F.size(F.array_distinct("actions")) > 1, "candidate_conflict": F.size(F.array_distinct("selected")) > 1,
    }).withColumn("disagree", F.col("action_conflict") | F.col("candidate_conflict"))


def policy_disagreement(views: DataFrame) -> DataFrame:
    """Action / candidate conflict over a snapshot's policies, with the modal action and how many share it.

    Ties of the mode go to the lower name, so the result does not depend on row order. One shuffle.
    """
    select_mode = (F.col("m.a") == "SELECT_CANDIDATE") & F.col("mc").isNotNull()
    return _tallied(views).select(
        "snapshot_id", "action_conflict", "candidate_conflict", "disagree", F.col("m.a").alias("modal_action"),
        F.when(select_mode, -F.col("mc.k")).otherwise(-F.col("m.k")).alias("n_agreeing"),
        F.col("mc.a").alias("modal_candidate"), F.coalesce(-F.col("mc.k"), F.lit(0)).alias("modal_votes"), F.size("votes").alias("n_views"),
    )


def policy_ensemble(views: DataFrame, mode: str = "shadow") -> DataFrame:
    """Authority by mode: legacy / shadow follow legacy; champion follows v3, falling back on missing inputs and
    taking a two-vote majority when candidates conflict. One shuffle."""
    side = lambda p: F.max(F.when(F.col("policy") == p, F.struct("action", "candidate_id", "reason", "confidence"))).alias(p)
    j = _tallied(views, side("legacy"), side("v3"))
    if mode in ("legacy", "shadow"):
        auth, source = F.col("legacy"), F.lit("legacy" if mode == "legacy" else "legacy_shadow")
        vote = F.lit(False)
    else:
        fallback = (F.col("v3.action") == "ABSTAIN") & F.col("v3.reason").contains("missing")
        auth = F.when(fallback, F.col("legacy")).otherwise(F.col("v3"))
        source = F.when(fallback, "fallback_legacy").otherwise("v3")
        vote = F.col("candidate_conflict") & (auth["action"] == "SELECT_CANDIDATE") & (F.coalesce(-F.col("mc.k"), F.lit(0)) >= 2)
    return j.select(
        "snapshot_id", auth["action"].alias("action"), F.when(vote, F.col("mc.a")).otherwise(auth["candidate_id"]).alias("candidate_id"),
        F.when(vote, F.least(auth["confidence"] + 0.1, F.lit(1.0))).otherwise(auth["confidence"]).alias("confidence"),
        source.alias("source"), "disagree", vote.alias("majority"),
    )


def compare_shadow(views: DataFrame, authority: str = "legacy") -> DataFrame:
    """Shadow decisions against the authority's: what differs per (snapshot, shadow). Both are rows of `views`
    (snapshot_id, policy, action, candidate_id), each policy once per snapshot, so one shuffle brings them together."""
    view = F.struct(F.col("policy").alias("shadow"), F.col("action").alias("shadow_action"), F.col("candidate_id").alias("shadow_candidate"))
    ours = F.col("policy") == authority
    both = views.groupBy("snapshot_id").agg(
        F.max(F.when(ours, F.struct("action", "candidate_id"))).alias("a"), F.collect_list(F.when(~ours, view)).alias("shadows")
    )
    return both.filter(F.col("a").isNotNull()).select("snapshot_id", "a", F.inline("shadows")).select(
        "snapshot_id", "shadow", (F.col("shadow_action") != F.col("a.action")).alias("action_differs"),
        (~F.col("shadow_candidate").eqNullSafe(F.col("a.candidate_id"))).alias("candidate_differs"),
    )


# -- knobs ---------------------------------------------------------------------------------------------------------
OOD_VETO = "challenger_ood_abstain"


def apply_knobs(decisions: DataFrame, knobs: DataFrame) -> DataFrame:
    """Re-score every decision under every knob row (a small config table, broadcast).

    Knobs only shrink: size is capped, uncertainty at or above the threshold adds a veto, an under-confident trade
    abstains. knobs: config_id, risk_max_size_scalar, min_confidence, prefer_abstain_on_ood, ood_threshold.
    """
    j = decisions.join(F.broadcast(knobs), F.lit(True))
    base = clip(F.col("size_scalar"), 0.0, 1.0)
    trade = F.col("action").isin("TRADE", "SELECT_CANDIDATE")
    ood = F.col("prefer_abstain_on_ood") & (F.col("uncertainty") >= F.col("ood_threshold"))
    weak = trade & (F.col("min_confidence") > 0) & (F.col("confidence") < F.col("min_confidence"))
    vetoes = F.when(ood & ~F.array_contains("hard_vetoes", OOD_VETO), F.concat("hard_vetoes", F.array(F.lit(OOD_VETO)))).otherwise(F.col("hard_vetoes"))
    out = F.when((trade & (F.size(vetoes) > 0)) | weak, "ABSTAIN").otherwise(F.col("action"))
    return j.select(
        "config_id", *decisions.columns, vetoes.alias("effective_vetoes"), F.least(base, F.coalesce("risk_max_size_scalar", base)).alias("effective_size"),
        out.alias("effective_action"), F.when(out == "ABSTAIN", None).otherwise(F.col("candidate_id")).alias("effective_candidate_id"),
    )


def challenger_decisions(decisions: DataFrame, candidates: DataFrame, knobs: DataFrame) -> DataFrame:
    """Deterministic selection under knobs: the best candidate of a snapshot whose decision survives them."""
    best = top_k(candidates, 1).select("snapshot_id", F.col("candidate_id").alias("best_id"))
    kept = apply_knobs(decisions, knobs)
    return kept.join(best, "snapshot_id", "left").select(
        "config_id", "snapshot_id", F.when(F.col("effective_action") == "ABSTAIN", "ABSTAIN").when(F.col("best_id").isNull(), "ABSTAIN").otherwise("TRADE").alias("action"),
        F.when(F.col("effective_action") != "ABSTAIN", F.col("best_id")).alias("candidate_id"), "effective_size",
    )


# -- promotion and curriculum --------------------------------------------------------------------------------------
def promotion_gates(trials: DataFrame, min_trades: int = 20, min_sessions: int = 3, min_edge: float = 0.0, max_drop: float = 0.05, cooldown_hours: float = 6.0, min_target_trades: int = 10) -> DataFrame:
    """Named gates per trial row (array of name, passed), the first blocker and the status; absent evidence blocks."""
    c, no = F.col, F.lit(False)
    gates = [
        ("cooldown", c("hours_since_promotion").isNull() | (c("hours_since_promotion") >= cooldown_hours)),
        ("evidence", (c("status") == "ok") & (c("trades") >= min_trades) & (c("n_sessions") >= min_sessions)),
        ("pnl_edge", (c("total_pnl") - c("champion_pnl")) > min_edge),
        ("win_rate", c("champion_win_rate").isNull() | (c("champion_win_rate") - c("win_rate") <= max_drop)),
        ("forward_transfer", c("mean_forward_transfer") >= 0),
        ("retention", F.coalesce(c("retention_ok"), F.lit(True))),
        ("universe", c("universe_pnl").isNull() | (c("universe_pnl") >= c("universe_champion_pnl"))),
        ("archetype_repair", c("target").isNull() | ((c("target_pnl") > c("target_champion_pnl")) & (c("target_trades") >= min_target_trades))),
        ("changed", c("actionable")),
    ]
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(cond, no).alias("passed")) for n, cond in gates])
    staged = trials.withColumn("gates", arr)
    blocked = F.filter("gates", lambda g: ~g["passed"])
    return staged.select("*", _first(blocked)["name"].alias("first_blocker"), F.when(F.size(blocked) == 0, "promote").otherwise("hold").alias("decision"))


def weakness_score(scores: DataFrame, scale: float = 100.0) -> DataFrame:
    """Mean of squashed loss, 1 − win rate, 1 − direction hits over what is known; .5 for an unscored archetype."""
    pnl = F.col("mean_session_pnl")
    scored = (F.coalesce("n_sessions", F.lit(0)) > 0) & pnl.isNotNull()
    parts = mean_known(0.5 - 0.5 * (pnl / (scale + F.abs(pnl))), 1.0 - clip(F.col("session_win_rate"), 0.0, 1.0), 1.0 - clip(F.col("dir_hit"), 0.0, 1.0))
    return scores.withColumn("weakness", F.when(scored, F.coalesce(parts, F.lit(0.5))).otherwise(0.5))


def _bounded(raw: Column, mean: Column) -> Column:
    return F.greatest(F.lit(0.25) * mean, F.least(F.lit(4.0) * mean, raw))


def next_weights(scored: DataFrame, inertia: float = 0.35) -> DataFrame:
    """Curriculum weights: weakness + .5 per unvisited regime, bounded to [¼, 4] of the mean, blended with the prior.

    Rows are the archetype catalogue (eight), so the global windows are bounded.
    """
    every = Window.partitionBy(F.lit(0))
    raw = scored.withColumn("proposed_raw", F.col("weakness") + 0.5 * F.coalesce("unvisited", F.lit(0)))
    p = raw.withColumn("proposed", _bounded(F.col("proposed_raw"), F.avg("proposed_raw").over(every)))
    prior_mean = F.coalesce(F.avg(F.when(F.col("prior") > 0, F.col("prior"))).over(every), F.lit(1.0))
    q = F.when(F.col("prior") > 0, F.col("prior")).otherwise(prior_mean)
    b = p.withColumn("blended", F.when(F.count("prior").over(every) > 0, (1 - inertia) * F.col("proposed") + inertia * q).otherwise(F.col("proposed")))
    return b.withColumn("weight", _bounded(F.col("blended"), F.avg("blended").over(every))).drop("proposed_raw", "blended")


def curriculum_weights(catalogue: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved weights over the catalogue; a missing or non-positive one takes the mean of the positive ones."""
    j = catalogue.join(saved.select("archetype", F.when(F.col("weight") > 0, F.col("weight")).alias("w")), "archetype", "left")
    return j.select("archetype", F.coalesce("w", F.avg("w").over(Window.partitionBy(F.lit(0))), F.lit(1.0)).alias("weight"))


def focus_archetypes(weights: DataFrame, n: int = 3) -> DataFrame:
    """Heaviest archetypes; after the first only those at or above the mean weight."""
    every = Window.partitionBy(F.lit(0))
    w = every.orderBy(F.col("weight").desc(), "archetype")
    r = weights.select("*", F.row_number().over(w).alias("r"), F.avg("weight").over(every).alias("mean_weight"))
    return r.filter((F.col("r") <= n) & ((F.col("r") == 1) | (F.col("weight") >= F.col("mean_weight")))).select(*weights.columns, F.col("r").alias("position"))


def weakest_archetypes(gaps: DataFrame, n: int = 2, full_evidence: int = 6) -> DataFrame:
    """Worst gaps by |negative mean P&L| × evidence share (n sessions of six)."""
    sev = F.abs(F.least(F.lit(0.0), F.col("mean_session_pnl"))) * F.least(F.lit(1.0), F.col("n_sessions") / float(full_evidence))
    return gaps.withColumn("severity", sev).orderBy(F.col("severity").desc(), "archetype").limit(n)


def stratified_session_sample(sessions: DataFrame, weights: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Sessions sampled so that archetypes appear in proportion to their weights, `share` of all rows in expectation.

    An archetype's rate is share · N · weight / (Σ weights · its own rows); a session stays if the md5 of its id falls
    below the rate, so the draw is stable under repartitioning and reruns. A rate above 1 keeps the whole archetype, and
    the sample is smaller than `share` by what it lacks.
    """
    every = Window.partitionBy(F.lit(0))  # one row per archetype
    sizes = sessions.groupBy("archetype").agg(F.count(F.lit(1)).alias("_n"))
    rates = weights.join(sizes, "archetype").select(
        "archetype", (share * F.sum("_n").over(every) * F.col("weight") / (F.sum("weight").over(every) * F.col("_n"))).alias("_f"))
    u = uniform_hash(F.lit(seed), "session_id") / float(1 << 32)
    return sessions.join(F.broadcast(rates), "archetype").filter(u < F.col("_f")).drop("_f")


# -- close projection ----------------------------------------------------------------------------------------------
def close_projection(views: DataFrame) -> DataFrame:
    """Signed score from VWAP, flip, RSI and CVD, pinned or amplified by net gamma, capped at the walls, with a cone."""
    c = F.col
    spot = c("spot")
    rng = F.when(c("expected_range") > 0, c("expected_range"))
    straddle = F.abs(c("straddle_breakeven") - spot)
    band = F.least(F.coalesce(rng, F.when(straddle > 0, straddle), spot * 0.004), spot * 0.05)
    staged = views.filter(spot > 0).withColumn("band", band)
    part = lambda x, weight: F.coalesce(clip(x, -1.0, 1.0) * weight, F.lit(0.0))
    raw = (
        part((spot - c("vwap")) / c("band"), 0.9) + part((spot - c("gamma_flip")) / c("band"), 0.6)
        + part((c("rsi") - 50.0) / 25.0, 0.7) + part(c("cvd_slope") * 4.0, 0.5)
    )
    scored = staged.withColumn("score", clip(raw / (0.9 + 0.6 + 0.7 + 0.5), -1.0, 1.0))
    pin = F.when(c("net_gex").isNull(), 1.0).when(c("net_gex") > 0, 0.55).otherwise(1.15)
    t0 = scored.withColumn("_t", spot + c("score") * c("band") * 0.6 * pin)
    t1 = t0.withColumn("_t", F.when(c("_t") > c("call_wall"), spot + (c("call_wall") - spot) * 0.85).otherwise(c("_t")))
    t2 = t1.withColumn("target", F.when(c("_t") < c("put_wall"), spot - (spot - c("put_wall")) * 0.85).otherwise(c("_t")))
    trend = F.coalesce(clip((c("adx") - 12.0) / 25.0, 0.0, 1.0), F.lit(0.4))
    where = F.coalesce(clip(c("gex_pct_rank"), 0.0, 1.0), F.lit(0.5))
    conf = t2.withColumn("confidence", clip(0.20 + 0.45 * F.abs("score") + 0.20 * trend + 0.15 * where, 0.15, 0.9))
    cone = c("band") * (1.30 - 0.55 * c("confidence"))
    return conf.select(
        *views.columns, F.when(c("score") > 0.18, "bullish").when(c("score") < -0.18, "bearish").otherwise("neutral").alias("bias"),
        F.round("target", 2).alias("target"), F.round(c("target") - cone, 2).alias("target_low"), F.round(c("target") + cone, 2).alias("target_high"),
        F.round("band", 3).alias("band"), F.round("confidence", 3).alias("confidence"), "score",
    )


def key_levels(views: DataFrame, ids: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """One row per known level: call wall (resistance), put wall (support), flip and VWAP (pivots)."""
    rows = [("call_wall", "Call wall", "resistance"), ("put_wall", "Put wall", "support"), ("gamma_flip", "Gamma flip", "pivot"), ("vwap", "VWAP", "pivot")]
    arr = F.array_compact(
        F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.round(n, 2).alias("price"), F.lit(label).alias("label"), F.lit(kind).alias("kind"))) for n, label, kind in rows])
    )
    return views.select(*ids, F.inline(arr))


