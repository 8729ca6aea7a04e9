"""Sizing, portfolio state, envelopes, firewall and guard checks, position and account roll-forward."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import codes, ratio
from tidemark.operators.windows import chunked_lag, chunked_running_sum, fold_sorted

MONEY = "decimal(18,4)"


def size_contracts(df: DataFrame, max_contracts: int = 0) -> DataFrame:
    """Whole contracts within equity·fraction·scalar and the dollar cap; needs equity, risk_frac, size_scalar,
    max_loss and max_risk_dollars."""
    c = F.col
    budget = c("equity") * c("risk_frac") * c("size_scalar")
    capped = F.when(c("max_risk_dollars") > 0, F.least(budget, c("max_risk_dollars"))).otherwise(budget)
    raw = F.greatest(F.lit(0), F.floor(ratio(capped, "max_loss"))).cast("int")
    n = F.least(raw, F.lit(max_contracts)) if max_contracts > 0 else raw
    reason = (
        F.when(c("max_loss") <= 0, "non_positive_max_loss")
        .when((c("equity") <= 0) | (c("risk_frac") <= 0) | (c("size_scalar") <= 0), "zero_budget")
        .when(n < 1, "insufficient_budget")
        .otherwise("sized")
    )
    contracts = F.when(reason == "sized", n).otherwise(0)
    return df.select(
        "*", contracts.alias("contracts"), (contracts * c("max_loss")).cast(MONEY).alias("risk_dollars"), reason.alias("size_reason")
    )


def half_kelly_risk(
    trades: DataFrame, keys: Sequence[str], floor: float = 0.02, ceiling: float = 0.10, fraction: float = 0.5, min_trades: int = 30
) -> DataFrame:
    """Earned risk fraction per key from win rate and payoff ratio; the floor until an edge is measurable."""
    pnl = F.col("pnl").cast("double")
    s = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((pnl > 0).cast("int")).alias("win_rate"),
        F.avg(F.when(pnl > 0, pnl)).alias("avg_win"),
        F.avg(F.when(pnl < 0, -pnl)).alias("avg_loss"),
    )
    kelly = F.col("win_rate") - ratio(1.0 - F.col("win_rate"), ratio("avg_win", "avg_loss"))
    risky = (F.col("n_trades") >= min_trades) & (F.col("avg_loss") > 0) & (F.col("win_rate") > 0) & (kelly > 0)
    scaled = F.greatest(F.lit(floor), F.least(F.lit(ceiling), kelly * fraction))
    return s.select(*keys, "n_trades", "win_rate", kelly.alias("kelly"), F.when(risky, scaled).otherwise(floor).alias("risk_frac"))


def portfolio_state(positions: DataFrame, keys: Sequence[str] = ("account_id", "session_date")) -> DataFrame:
    """Open count, committed risk, greeks, and family / expiration counts as maps.

    Counts fold per (keys, family) and (keys, expiration) first, so the maps collect one entry per distinct value.
    """
    keys = list(keys)
    fam = positions.groupBy(*keys, "family").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("max_loss") * F.col("contracts")).cast(MONEY)).alias("risk"),
        F.sum(F.abs("gamma")).alias("gamma"), F.sum("delta").alias("delta"),
    )
    exp = positions.groupBy(*keys, "expiration").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("expiration"), F.col("n"))))).alias("expiration_counts")
    )
    base = fam.groupBy(*keys).agg(
        F.sum("n").alias("open_positions"), F.sum("risk").alias("open_risk_dollars"), F.sum("gamma").alias("portfolio_gamma"),
        F.sum("delta").alias("portfolio_delta"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "n")))).alias("family_counts"),
    )
    return base.join(exp, keys)


@dataclass(frozen=True)
class RiskLimits:
    max_risk_dollars: float = 0.0
    max_contracts: int = 0
    max_positions: int = 0
    max_daily_loss: float = 0.0
    gamma_limit: float | None = None
    delta_limit: float | None = None
    max_family_positions: int = 0
    max_expiration_positions: int = 0
    risk_per_trade_frac: float = 0.02
    decision_ttl_seconds: int = 60


def greedy_portfolio_check(proposals: DataFrame, limits: RiskLimits, order: Sequence[str], keys=("account_id", "session_date")) -> DataFrame:
    """Accept proposals in order while the caps hold; a session starts empty. Vetoes name the caps that failed.

    The next verdict depends on the acceptances before, so each (account, session) streams in order through a fold
    whose state is the running totals only.
    """
    lim = limits

    def fresh() -> dict:
        return {"loss": 0.0, "n": 0, "gamma": 0.0, "fam": {}, "exp": {}}

    def step(s: dict, r) -> tuple:
        v = []
        if lim.max_daily_loss > 0 and s["loss"] + r.max_loss > lim.max_daily_loss + 1e-9:
            v.append("daily_loss")
        if lim.max_positions > 0 and s["n"] >= lim.max_positions:
            v.append("max_positions")
        if lim.gamma_limit and s["gamma"] + abs(r.gamma) > lim.gamma_limit + 1e-12:
            v.append("max_gamma")
        if lim.max_family_positions > 0 and s["fam"].get(r.family, 0) + 1 > lim.max_family_positions:
            v.append("family_concentration")
        if lim.max_expiration_positions > 0 and s["exp"].get(r.expiration, 0) + 1 > lim.max_expiration_positions:
            v.append("expiration_concentration")
        if not v:
            s["loss"] += r.max_loss
            s["n"] += 1
            s["gamma"] += abs(r.gamma)
            s["fam"][r.family] = s["fam"].get(r.family, 0) + 1
            s["exp"][r.expiration] = s["exp"].get(r.expiration, 0) + 1
        return (not v, ",".join(v))

    return fold_sorted(proposals, keys, order, step, fresh, "accepted boolean, vetoes string")


def risk_envelope(state: DataFrame, limits: RiskLimits, size_scalar_cap: float = 1.0) -> DataFrame:
    """Remaining budgets and slots per account; any hard veto rejects the envelope with zero size.

    Needs equity, open_risk_dollars, daily_realized_pnl, open_positions, portfolio_gamma, portfolio_delta,
    operational_vetoes.
    """
    c, zero = F.col, F.lit(0.0)
    consumed = c("open_risk_dollars").cast("double") + F.greatest(-c("daily_realized_pnl").cast("double"), zero)
    daily = F.greatest(zero, F.lit(limits.max_daily_loss) - consumed) if limits.max_daily_loss > 0 else F.lit(limits.max_daily_loss)
    slots = F.greatest(F.lit(0), F.lit(limits.max_positions) - c("open_positions")) if limits.max_positions > 0 else F.lit(10**9)
    cap = F.lit(limits.max_risk_dollars)
    if limits.max_daily_loss > 0:
        cap = daily if limits.max_risk_dollars <= 0 else F.least(cap, daily)
    by_equity = F.round(c("equity").cast("double") * limits.risk_per_trade_frac, 4)
    cap = F.when((cap <= 0) & (c("equity") > 0) & F.lit(limits.risk_per_trade_frac > 0), by_equity).otherwise(cap)
    over = lambda col, lim: (F.abs(c(col)) > lim) if lim else F.lit(False)
    vetoes = F.array_distinct(
        F.concat(
            "operational_vetoes",
            codes(
                (F.lit(limits.max_daily_loss > 0) & (daily <= 0), "daily_loss_exhausted"),
                (F.lit(limits.max_positions > 0) & (slots <= 0), "max_positions"),
                (cap <= 0, "zero_risk_budget"),
                (over("portfolio_gamma", limits.gamma_limit), "portfolio_gamma"),
                (over("portfolio_delta", limits.delta_limit), "portfolio_delta"),
            ),
        )
    )
    ok = F.size(vetoes) == 0
    return state.select(
        "*", daily.alias("remaining_daily_loss"), slots.alias("remaining_slots"), vetoes.alias("envelope_vetoes"), ok.alias("envelope_approved"),
        F.when(ok, cap).otherwise(zero).alias("envelope_risk_dollars"), F.when(ok, size_scalar_cap).otherwise(zero).alias("max_size_scalar"),
    )


def failed(*checks: tuple[str, Column]) -> Column:
    """Array of the names of checks that did not pass (NULL counts as not passed)."""
    return codes(*[(~F.coalesce(passed, F.lit(False)), name) for name, passed in checks])


def risk_firewall(decisions: DataFrame, limits: RiskLimits, min_fill: float = 0.0, max_ages=(5.0, 120.0, 5.0)) -> DataFrame:
    """Named checks of a decision row against envelope, portfolio and freshness; fail-closed veto array and sizing.

    One row carries the decision, its candidate (NULL candidate_id = not in the universe), the account's portfolio
    state and envelope. Non-order actions and unknown candidates stop at the first check.
    """
    c, L = F.col, limits
    unknown_or = lambda col, cond: c(col).isNull() | cond
    loss = c("max_loss").cast("double")
    cap = c("envelope_risk_dollars")
    fam = F.coalesce(F.try_element_at("family_counts", c("family")), F.lit(0))
    exp = F.coalesce(F.try_element_at("expiration_counts", c("expiration")), F.lit(0))
    age = (F.unix_micros("now") - F.unix_micros("decided_at")) / 1e6
    yes = F.lit(True)
    equity = c("equity").cast("double")
    frac = F.when(equity > 0, F.least(F.lit(1.0), cap / equity)).otherwise(0.0)
    budget = equity * frac * F.least(c("size_scalar"), c("max_size_scalar"))
    budget = F.when(cap > 0, F.least(budget, cap)).otherwise(budget)
    n = F.when((loss > 0) & (budget > 0), F.floor(F.round(ratio(budget, loss), 9))).otherwise(0).cast("int")
    n = F.least(n, F.lit(L.max_contracts)) if L.max_contracts > 0 else n
    n = F.when(c("requested_contracts") > 0, F.least(n, c("requested_contracts"))).otherwise(n)
    checks = failed(
        ("deployment_mode", c("envelope_approved")),
        ("emergency_lockout", ~c("lockout_active") & (F.size("envelope_vetoes") == 0)),
        ("session_status", c("market_open") & c("data_valid")),
        ("entry_cutoff", ~c("entry_locked") & ~c("session_warmup")),
        ("journal_availability", c("journal_available")),
        ("operational_vetoes", F.size("operational_vetoes") == 0),
        ("spot_freshness", unknown_or("spot_age", c("spot_age") <= max_ages[0])),
        ("bar_freshness", unknown_or("bar_age", c("bar_age") <= max_ages[1])),
        ("quote_freshness", unknown_or("quote_age", c("quote_age") <= max_ages[2])),
        ("geometry_hash", F.when(c("expected_geometry_hash").isNotNull(), c("geometry_hash") == c("expected_geometry_hash")).otherwise(F.length("geometry_hash") > 0)),
        ("maximum_loss", (loss > 0) & ((cap <= 0) | (loss <= cap))),
        ("fill_estimate", unknown_or("fill_probability", c("fill_probability") >= min_fill)),
        ("account_equity", equity > 0),
        ("daily_realized_loss", (c("remaining_daily_loss") >= loss) if L.max_daily_loss > 0 else yes),
        ("open_risk", (c("open_risk_dollars").cast("double") + loss <= L.max_daily_loss) if L.max_daily_loss > 0 else yes),
        ("position_count", (c("open_positions") < L.max_positions) if L.max_positions > 0 else yes),
        ("family_concentration", (fam < L.max_family_positions) if L.max_family_positions > 0 else yes),
        ("expiration_concentration", (exp < L.max_expiration_positions) if L.max_expiration_positions > 0 else yes),
        ("delta", (F.abs("portfolio_delta") <= L.delta_limit) if L.delta_limit else yes),
        ("gamma", (c("portfolio_gamma") + F.abs("gamma") <= L.gamma_limit) if L.gamma_limit else yes),
        ("equivalent_position", ~c("equivalent_open")),
        ("duplicate_order", ~c("duplicate_order")),
        ("stale_decision", unknown_or("decided_at", age.between(0, L.decision_ttl_seconds))),
        ("exit_policy", c("exit_policy_approved")),
        ("sizing", n >= 1),
    )
    vetoes = (
        F.when(~(c("action") == "SELECT_CANDIDATE") | c("selected_candidate_id").isNull(), F.array(F.lit("order_intent")))
        .when(c("candidate_id").isNull(), F.array(F.lit("candidate_id")))
        .otherwise(checks)
    )
    out = decisions.withColumn("vetoes", vetoes).withColumn("_n", n)
    ok = F.size("vetoes") == 0
    return out.select(
        "*", ok.alias("approved"), F.when(ok, c("_n")).otherwise(0).alias("approved_contracts"),
        F.when(ok, c("_n") * loss).otherwise(0.0).alias("approved_risk_dollars"),
    ).drop("_n")


@dataclass(frozen=True)
class GuardLimits:
    # fixed values: conservative defaults
    max_loss_per_trade: float = 500.0
    max_capital_per_trade: float = 2500.0
    max_size_scalar: float = 1.0
    max_contracts: int = 10
    max_open_positions: int = 3
    max_positions_per_family: int = 1
    min_fill_probability: float = 0.35
    max_quote_age_seconds: float = 5.0
    session_open: str = "09:30:00"
    session_close: str = "16:00:00"
    allow_live: bool = False
    modes: tuple[str, ...] = ("shadow", "paper", "live")


def execution_guard(decisions: DataFrame, limits: GuardLimits | None = None) -> DataFrame:
    """Block codes, clamped size and contracts for decided rows; a non-TRADE action passes with zero exposure.

    Candidate figures come from the joined eligible candidate (NULL eligible_id = not eligible).
    """
    L, c = limits or GuardLimits(), F.col
    known = c("eligible_id").isNotNull()
    clock = F.date_format("local_time", "HH:mm:ss")
    size = F.least(F.greatest(c("size_scalar"), F.lit(0.0)), F.lit(L.max_size_scalar))
    contracts = F.least(F.greatest(c("requested_contracts"), F.lit(0)), F.lit(L.max_contracts))
    blocks = codes(
        (~c("trading_enabled"), "trading_disabled"),
        (~c("eligibility_passed"), "eligibility_not_passed"),
        (F.size("snapshot_vetoes") > 0, "snapshot_hard_veto"),
        (~F.coalesce(c("mode").isin(*L.modes), F.lit(False)), "unknown_mode"),
        ((c("mode") == "live") & F.lit(not L.allow_live), "live_not_permitted"),
        (c("candidate_id").isNull(), "no_candidate_selected"),
        (c("candidate_id").isNotNull() & ~known, "candidate_not_eligible"),
        (known & c("hard_vetoed"), "candidate_hard_vetoed"),
        (c("local_time").isNull(), "missing_timestamp"),
        (~clock.between(L.session_open, L.session_close), "outside_session_window"),
        (c("open_positions") >= L.max_open_positions, "position_limit"),
        (known & (c("maximum_loss") > L.max_loss_per_trade), "max_loss_exceeded"),
        (known & (c("capital_required") > L.max_capital_per_trade), "capital_exceeded"),
        (known & (c("capital_required") > c("buying_power")), "insufficient_buying_power"),
        (known & (c("family_open") >= L.max_positions_per_family), "family_concentration"),
        (known & (c("fill_probability") < L.min_fill_probability), "fill_probability_too_low"),
        (c("quote_age") > L.max_quote_age_seconds, "quote_stale"),
        (size <= 0, "size_not_positive"),
        (contracts <= 0, "contracts_exceeded"),
    )
    trade = F.upper(F.trim("action")) == "TRADE"
    blocked = decisions.withColumn("blocks", F.when(trade, blocks).otherwise(F.array().cast("array<string>")))
    ok = F.size("blocks") == 0
    go = trade & ok
    return blocked.select(
        "*", ok.alias("approved"), F.when(go, size).otherwise(0.0).alias("guarded_size"), F.when(go, contracts).otherwise(0).alias("guarded_contracts"),
        F.when(
            trade,
            codes((size < c("size_scalar"), "size_scalar"), (contracts < c("requested_contracts"), "contracts")),
        ).otherwise(F.array().cast("array<string>")).alias("clamps"),
    )


def duplicate_decisions(decisions: DataFrame, ttl_minutes: int = 15) -> DataFrame:
    """Flag a decision whose account|candidate|geometry was seen within the last 15 minutes."""
    signed = decisions.withColumn("signature", F.concat_ws("|", "account_id", "candidate_id", "geometry_hash")).withColumn(
        "_slot", F.date_trunc("hour", "ts")
    )
    lagged = chunked_lag(signed, ["signature"], "_slot", ["ts", "decision_id"], {"ts": "previous_ts"})
    gap = F.unix_micros("ts") - F.unix_micros("previous_ts")
    return lagged.drop("_slot").withColumn("is_duplicate", F.coalesce(gap <= ttl_minutes * 60_000_000, F.lit(False)))


def decision_freshness(decided_at: Column, now: Column, ttl_seconds: int = 60) -> Column:
    """fresh / stale_decision / decision_in_future / missing_decision_timestamp."""
    age = F.unix_micros(now) - F.unix_micros(decided_at)
    return (
        F.when(decided_at.isNull(), "missing_decision_timestamp").when(age < 0, "decision_in_future")
        .when(age > ttl_seconds * 1_000_000, "stale_decision").otherwise("fresh")
    )


def position_rollforward(fills: DataFrame, chunk: str = "session_date") -> DataFrame:
    """Open contracts, realised and unrealised P&L after each fill event of a position.

    Events: open (+contracts at entry_price) and reduce / close (−contracts at price). Realised P&L of a reduction is
    (price − entry)·contracts; marks apply to what stays open.
    """
    cut = F.col("event").isin("reduce", "close")
    q = F.col("contracts")
    ev = fills.select(
        "*",
        F.when(cut, -q).otherwise(q).cast("bigint").alias("_dq"),
        F.when(cut, (F.col("price") - F.col("entry_price")) * q).otherwise(0).cast(MONEY).alias("_pnl"),
    )
    run = chunked_running_sum(ev, ["position_id"], chunk, ["seq"], {"_dq": "open_contracts", "_pnl": "realized_pnl"})
    left = F.col("open_contracts")
    return run.drop("_dq", "_pnl").select(
        "*", ((F.col("price") - F.col("entry_price")) * left).cast(MONEY).alias("unrealized_pnl"),
        F.when(left <= 0, "closed").when(F.col("event") == "reduce", "partially_reduced").otherwise("open").alias("status"),
    )


def account_ledger(events: DataFrame, starting_cash: str, chunk: str = "session_date") -> DataFrame:
    """Cash after every fill (debit: −quantity·price−fees, credit: +) and realised P&L entry, isolated per account."""
    notional = F.col("quantity") * F.col("price")
    flow = (
        F.when(F.col("kind") == "debit", -(notional + F.col("fees")))
        .when(F.col("kind") == "credit", notional + F.col("fees"))
        .otherwise(F.col("realized_pnl"))
    ).cast(MONEY)
    ev = events.select(
        "*", flow.alias("_flow"), F.when(F.col("kind") == "realize", F.col("realized_pnl")).otherwise(0).cast(MONEY).alias("_pnl"),
        F.when(F.col("kind") == "debit", 1).otherwise(0).alias("_n"),
    )
    run = chunked_running_sum(ev, ["account_id"], chunk, ["seq"], {"_flow": "_cash", "_pnl": "realized_total", "_n": "trade_count"})
    return run.select(
        *events.columns, (F.col("_cash") + F.lit(starting_cash).cast(MONEY)).alias("cash"), "realized_total", "trade_count"
    )
