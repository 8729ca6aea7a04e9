"""Fill economics, option marks, managed exits and settlement of structures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, norm_cdf, norm_pdf, ratio
from tidemark.operators.journal import thin_by_interval
from tidemark.operators.structures import DEC, dec, terminal_payoff

# fixed values: fill priors by leg count and family
FILL_BY_LEGS = {1: 0.35, 2: 0.50, 3: 0.55, 4: 0.65}
FILL_BY_FAMILY = {
    "long_call": 0.35, "long_put": 0.35,
    "bull_put_credit_spread": 0.50, "bear_call_credit_spread": 0.50, "put_credit": 0.50, "call_credit": 0.50,
    "call_debit_spread": 0.50, "put_debit_spread": 0.50, "long_call_spread": 0.50, "long_put_spread": 0.50,
    "long_strangle": 0.55, "long_straddle": 0.55, "bounded_broken_wing_butterfly": 0.55, "broken_wing": 0.55,
    "bounded_backspread_call": 0.55, "bounded_backspread_put": 0.55, "backspread_call": 0.55, "backspread_put": 0.55,
    "iron_butterfly": 0.65, "iron_fly": 0.65, "iron_condor": 0.65,
}
FEE_PER_LEG = "0.0035"


def _dsum(values: Column) -> Column:
    return F.aggregate(values, dec(0), lambda a, x: (a + x).cast(DEC))


def leg_prices(structures: DataFrame, quotes: DataFrame) -> DataFrame:
    """Net mid and natural per structure by joining its legs to the quotes; any missing leg leaves NULL.

    For structures stored without embedded quotes: legs explode, join on (snapshot, contract), fold back.
    """
    legs = structures.select("snapshot_id", "candidate_id", F.size("legs").alias("n_legs"), F.explode("legs").alias("x"))
    q = quotes.select(
        "snapshot_id", "contract_id", F.coalesce("mark", ((F.col("bid") + F.col("ask")) / 2).cast(DEC)).alias("mid"), "bid", "ask"
    )
    flat = legs.select("snapshot_id", "candidate_id", "n_legs", F.col("x.contract_id").alias("contract_id"), F.col("x.quantity").alias("qty"))
    joined = flat.join(q, ["snapshot_id", "contract_id"], "left")
    side = F.when(F.col("qty") > 0, F.col("ask")).otherwise(F.col("bid"))
    agg = joined.groupBy("snapshot_id", "candidate_id").agg(
        F.max("n_legs").alias("n"), F.count("mid").alias("n_mid"), F.count(F.when(F.col("bid").isNotNull() & F.col("ask").isNotNull(), 1)).alias("n_two"),
        F.sum((-F.col("qty") * F.col("mid")).cast(DEC)).alias("m"), F.sum((-F.col("qty") * side).cast(DEC)).alias("nat"),
    )
    return agg.select(
        "snapshot_id", "candidate_id",
        F.when(F.col("n_mid") == F.col("n"), F.col("m")).cast(DEC).alias("mid_price"),
        F.when(F.col("n_two") == F.col("n"), F.col("nat")).cast(DEC).alias("natural_price"),
    )


def net_prices(legs: str | Column = "legs") -> tuple[Column, Column]:
    """(mid, natural) of quoted legs: short adds, long subtracts; buys at ask and sells at bid for natural."""
    mid = lambda x: F.coalesce(x["q"]["mark"], ((x["q"]["bid"] + x["q"]["ask"]) / 2).cast(DEC))
    natural = lambda x: F.when(x["quantity"] > 0, x["q"]["ask"]).otherwise(x["q"]["bid"])
    two_sided = F.forall(legs, lambda x: x["q"]["bid"].isNotNull() & x["q"]["ask"].isNotNull())
    priced = F.forall(legs, lambda x: mid(x).isNotNull())
    return (
        F.when(priced, _dsum(F.transform(legs, lambda x: (-x["quantity"] * mid(x)).cast(DEC)))),
        F.when(two_sided, _dsum(F.transform(legs, lambda x: (-x["quantity"] * natural(x)).cast(DEC)))),
    )


def fill_price(mid: Column, natural: Column, fraction: Column) -> Column:
    """Interpolation from mid to natural by a fraction clipped to [0, 1]."""
    f = clip(fraction, 0.0, 1.0).cast("decimal(9,6)")
    return (mid - f * (mid - natural)).cast(DEC)


def fill_fraction_prior(
    family: Column, n_legs: Column, age: Column, minutes_to_close: Column, relative_spread: Column, realized_vol: Column
) -> Column:
    """Family (else leg-count) base plus late-day, stale, wide and high-volatility penalties, clipped to [0, 1]."""
    by_family = F.create_map(*[x for k, v in FILL_BY_FAMILY.items() for x in (F.lit(k), F.lit(v))])
    by_legs = F.create_map(*[x for k, v in FILL_BY_LEGS.items() for x in (F.lit(k), F.lit(v))])
    base = F.coalesce(F.try_element_at(by_family, family), by_legs[F.greatest(F.lit(1), F.least(F.lit(4), n_legs.cast("int")))])
    penalty = lambda cond, size: F.when(F.coalesce(cond, F.lit(False)), size).otherwise(0.0)
    return F.greatest(
        F.lit(0.0),
        F.least(
            F.lit(1.0),
            base
            + penalty(minutes_to_close <= 60, 0.10)
            + penalty(age >= 5.0, 0.10)
            + penalty(relative_spread >= 0.15, 0.10)
            + penalty(realized_vol >= 0.25, 0.05),
        ),
    )


def candidate_economics(candidates: DataFrame, conservative_boost: float = 0.25, exit_boost: float = 0.10, stop_boost: float = 0.25) -> DataFrame:
    """Expected and conservative fills, fees, slippage, fill probability, expected value and return on risk.

    Needs legs with quotes, family, maximum_loss, minutes_to_close; optional expected_net_pnl. Row expressions only.
    """
    n = F.size("legs")
    mid, natural = net_prices()
    age = F.array_max(F.transform("legs", lambda x: x["q"]["age_seconds"]))
    priced = candidates.select("*", n.alias("n_legs"), mid.alias("mid_price"), natural.alias("_nat"), age.alias("quote_age"))
    half = F.greatest(F.col("mid_price") - F.col("_nat"), dec(0)).cast(DEC)
    scale = F.when(F.col("mid_price") == 0, dec(1)).otherwise(F.abs("mid_price"))
    spread = priced.select(
        "*",
        F.least("_nat", "mid_price").alias("natural_price"),
        half.alias("half_spread"),
        F.when(half.isNotNull(), ratio(half, scale)).alias("relative_spread"),
    )
    rv = F.col("realized_vol") if "realized_vol" in candidates.columns else F.lit(None).cast("double")
    frac = fill_fraction_prior(
        F.col("family"), F.col("n_legs"), F.col("quote_age"), F.col("minutes_to_close"), F.col("relative_spread"), rv
    )
    filled = spread.withColumn("expected_fill_fraction", F.round(frac, 6))
    f = F.col("expected_fill_fraction")
    cut = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    known_natural = F.col("_nat").isNotNull() & F.col("mid_price").isNotNull()
    expected = F.least(fill_price(F.col("mid_price"), F.col("natural_price"), f), F.col("mid_price"))
    conservative = fill_price(F.col("mid_price"), F.col("natural_price"), cut(f + conservative_boost))
    half0 = F.coalesce("half_spread", dec(0))
    p_fill = cut(F.greatest(F.lit(0.05), 1.0 - 0.5 * f))
    pnl = F.col("expected_net_pnl").cast("double") if "expected_net_pnl" in candidates.columns else F.lit(None).cast("double")
    ev = F.round(p_fill * pnl, 8)
    exp = F.when(known_natural, expected)
    return filled.select(
        *candidates.columns,
        "mid_price", "natural_price", "relative_spread", "quote_age",
        exp.alias("expected_fill_price"),
        F.when(known_natural, F.least(conservative, expected)).alias("conservative_fill_price"),
        p_fill.alias("fill_probability"),
        "expected_fill_fraction",
        (F.col("n_legs") * dec(FEE_PER_LEG) * 2).cast(DEC).alias("fees"),
        F.greatest(F.coalesce(F.col("mid_price") - exp, dec(0)), dec(0)).cast(DEC).alias("entry_slippage"),
        (cut(f + exit_boost).cast("decimal(9,6)") * half0).cast(DEC).alias("exit_slippage"),
        (cut(f + stop_boost).cast("decimal(9,6)") * half0).cast(DEC).alias("stop_slippage"),
        ev.alias("expected_value"),
        F.when(F.col("maximum_loss") > 0, ratio(ev, "maximum_loss")).alias("return_on_defined_risk"),
        F.array_compact(
            F.array(F.when(F.col("quote_age") >= 5.0, F.lit("stale_quote")), F.when(F.col("relative_spread") >= 0.15, F.lit("wide_spread")))
        ).alias("quote_flags"),
    )


def blend_with_prior(empirical: Column, prior: Column, support: Column, prior_support: int = 100) -> tuple[Column, Column]:
    """(blend, weight) with weight = support / (support + prior support)."""
    s = F.greatest(support, F.lit(0)).cast("double")
    w = s / (s + float(max(prior_support, 1)))
    return w * empirical + (1.0 - w) * prior, w


# -- option marks ------------------------------------------------------------------------------------------------
YEAR_MINUTES = 365.0 * 24.0 * 60.0
FALLBACK_IV = 0.20


def black_call(forward: Column, strike: Column, total_vol: Column) -> Column:
    """Undiscounted forward-Black call with total volatility; intrinsic when inputs are degenerate."""
    live = (forward > 0) & (strike > 0) & (total_vol > 0)
    s = F.when(live, total_vol)
    d1 = F.ln(F.when(live, forward) / F.when(live, strike)) / s + 0.5 * s
    return F.when(live, forward * norm_cdf(d1) - strike * norm_cdf(d1 - s)).otherwise(
        F.greatest(forward - strike, F.lit(0.0))
    )


def black_value(is_call: Column, forward: Column, strike: Column, total_vol: Column) -> Column:
    call = black_call(forward, strike, total_vol)
    return F.when(is_call, call).otherwise(call - forward + strike)


def black_greeks(forward: Column, strike: Column, total_vol: Column, years: Column, is_call: Column) -> dict[str, Column]:
    """delta, gamma, theta (per year), vega (per 1.00 of annual vol); a step delta and zeros when degenerate."""
    live = (forward > 0) & (strike > 0) & (total_vol > 0) & (years > 0)
    s, t = F.when(live, total_vol), F.when(live, years)
    d1 = F.ln(F.when(live, forward) / F.when(live, strike)) / s + 0.5 * s
    pdf, cdf = norm_pdf(d1), norm_cdf(d1)
    step = F.when(is_call, (forward > strike).cast("double")).otherwise(-(forward < strike).cast("double"))
    return {
        "delta": F.when(live, F.when(is_call, cdf).otherwise(cdf - 1.0)).otherwise(step),
        "gamma": F.when(live, pdf / (forward * s)).otherwise(0.0),
        "theta": F.when(live, -(forward * pdf * (s / F.sqrt(t))) / (2.0 * F.sqrt(t))).otherwise(0.0),
        "vega": F.when(live, forward * pdf * F.sqrt(t)).otherwise(0.0),
    }


def smile_vol(atm: Column, skew: Column, curv: Column, wing: Column, k: Column, min_vol: float) -> Column:
    """Total vol at log-moneyness k: atm − skew·k + curv·k² + wing·|k|, floored."""
    return F.greatest(atm - skew * k + curv * k * k + wing * F.abs(k), F.lit(min_vol))


def profit_ratio(entry: Column, mark: Column, credit: Column) -> Column:
    """Signed gain as a share of the entry price; positive is profit for credits and debits alike."""
    move = ratio(mark - entry, entry)
    return F.when(credit, -move).otherwise(move)


@dataclass(frozen=True)
class ExitPolicy:
    policy_id: str = "target_and_stop"
    take_profit: float = 0.5
    stop_loss: float = 0.35
    trail_arm: float = 0.25
    trail_giveback: float = 0.15
    max_holding_minutes: int = 0
    eod_close: bool = True


EOD_MINUTE = 15 * 60 + 55
CLOSE_MINUTE = 16 * 60


def exit_signal(
    policy: ExitPolicy, pnl: Column, peak: Column, held_minutes: Column, local_minute: Column,
    expired: Column | None = None, structural: Column | None = None, emergency: Column | None = None,
) -> Column:
    """Reason of the first rule that fires, or 'hold'; rules are gated by the policy id."""
    pid, no = policy.policy_id, F.lit(False)
    expired, structural, emergency = expired if expired is not None else no, structural if structural is not None else no, emergency if emergency is not None else no
    gate = lambda *ids: F.lit(pid in ids)
    return (
        F.when(emergency, "emergency_exit")
        .when(expired, "expiration_settlement")
        .when(structural & gate("structural_ras_exit", "target_and_stop", "trailing"), "structural_ras_exit")
        .when(gate("fixed_target", "target_and_stop", "trailing") & F.lit(policy.take_profit > 0) & (pnl >= policy.take_profit), "target")
        .when(gate("fixed_stop", "target_and_stop", "trailing") & F.lit(policy.stop_loss > 0) & (pnl <= -policy.stop_loss), "stop")
        .when(gate("trailing") & (peak >= policy.trail_arm) & (peak - pnl >= policy.trail_giveback), "trail")
        .when(F.lit(policy.max_holding_minutes > 0) & (held_minutes >= policy.max_holding_minutes), "time_exit")
        .when((F.lit(policy.eod_close) | gate("eod_exit")) & (local_minute >= EOD_MINUTE), "eod")
        .otherwise("hold")
    )


def session_paths(bars: DataFrame, local_minute: Column) -> DataFrame:
    """One row per session: its bars as an array of (ts in µs, close, minute of the local day). Sessions are bounded."""
    bar = F.struct(F.unix_micros("ts").alias("t"), F.col("close").cast("double").alias("close"), local_minute.alias("minute"))
    return bars.groupBy("session_date").agg(F.sort_array(F.collect_list(bar)).alias("path"))


MAX_LEGS = 4


def marked_paths(candidates: DataFrame, paths: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (candidate, later bar of the session it expires in): t (µs), minute, close, value, pnl ratio.

    The legs (at most four; more are refused by an error) become plain columns before the bars are unrolled, so the marks are generated code, and
    each candidate's rows are produced and consumed in one task: what follows aggregates them before any shuffle.
    """
    credit = F.col("entry_credit").cast("double")
    joined = candidates.join(paths, candidates.expiration == paths.session_date).filter(F.col("entry_credit") != 0)
    joined = joined.withColumn("legs", F.when(F.size("legs") > MAX_LEGS, F.raise_error(F.lit("more than four legs"))).otherwise(F.col("legs")))
    legs = []
    for i in range(1, MAX_LEGS + 1):
        x = F.try_element_at("legs", F.lit(i))
        iv = F.coalesce(F.when(x["q"]["iv"] > 0, x["q"]["iv"]), F.lit(FALLBACK_IV))
        legs += [
            (x["option_type"] == "call").alias(f"_c{i}"), x["strike"].cast("double").alias(f"_k{i}"),
            x["quantity"].alias(f"_q{i}"), F.when(x.isNotNull(), iv).alias(f"_iv{i}"),
        ]
    rows = joined.select(
        "snapshot_id", "candidate_id", "session_date", *extra, credit.alias("credit"), F.unix_micros("observed_at").alias("_t0"), *legs,
        F.inline(F.filter("path", lambda b: b["t"] > F.unix_micros("observed_at"))),
    )
    n = range(1, MAX_LEGS + 1)
    years = F.greatest(F.lit(CLOSE_MINUTE) - F.col("minute"), F.lit(0)) / YEAR_MINUTES
    f = F.col("close")
    vols = rows.select("*", *[(F.col(f"_iv{i}") * F.sqrt(years)).alias(f"_v{i}") for i in n])
    d1 = lambda i: F.ln(f / F.col(f"_k{i}")) / F.col(f"_v{i}") + 0.5 * F.col(f"_v{i}")
    ds = vols.select("*", *[F.when(F.col(f"_v{i}") > 0, d1(i)).alias(f"_d{i}") for i in n])

    def call(i: int) -> Column:
        k, d, v = F.col(f"_k{i}"), F.col(f"_d{i}"), F.col(f"_v{i}")
        return F.when(d.isNotNull(), f * norm_cdf(d) - k * norm_cdf(d - v)).otherwise(F.greatest(f - k, F.lit(0.0)))

    calls = ds.select("*", *[call(i).alias(f"_p{i}") for i in n])
    worth = lambda i: F.when(F.col(f"_c{i}"), F.col(f"_p{i}")).otherwise(F.col(f"_p{i}") - f + F.col(f"_k{i}"))
    value = sum((F.coalesce(F.col(f"_q{i}") * F.round(worth(i), 6), F.lit(0.0)) for i in n), F.lit(0.0))
    valued = calls.select("snapshot_id", "candidate_id", "session_date", *extra, "credit", "_t0", "t", "minute", "close", value.alias("value"))
    return valued.withColumn("pnl", profit_ratio(F.abs("credit"), F.abs("value"), F.col("credit") > 0))


def managed_outcome(candidates: DataFrame, paths: DataFrame, settlements: DataFrame, policy: ExitPolicy | None = None) -> DataFrame:
    """P&L a policy would have realised: closed at the first bar that fires, else settled at expiry.

    `settlements` is (session_date, settlement_price). No row for structures that do not expire that session, have no
    later bar or no entry price, nor for those held to the close of a session without a settlement price. Only a trailing policy needs the running peak, hence a window per candidate.
    """
    policy = policy or ExitPolicy()
    # what settling needs travels with the marks, so candidates are built once
    leg = lambda x: F.struct(x["option_type"].alias("option_type"), x["strike"].alias("strike"), x["quantity"].alias("quantity"))
    extra = [c for c in ("family",) if c in candidates.columns]
    terms = candidates.withColumn("terms_", F.struct("expiration", "entry_credit", *extra, F.transform("legs", leg).alias("legs")))
    m = marked_paths(terms, paths, ("terms_",))
    peak = F.lit(0.0)
    if policy.policy_id == "trailing":
        w = Window.partitionBy("snapshot_id", "candidate_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        peak = F.greatest(F.lit(0.0), F.max("pnl").over(w))
    signal = exit_signal(
        policy, F.col("pnl"), peak, (F.col("t") - F.col("_t0")) / 60e6, F.col("minute"), expired=F.col("minute") >= CLOSE_MINUTE
    )
    fired = m.withColumn("signal", signal)
    hit = F.when(F.col("signal") != "hold", F.col("t"))
    first = fired.groupBy("snapshot_id", "candidate_id").agg(
        F.min_by(F.struct(F.col("signal").alias("reason"), "t", "value"), hit).alias("x"), F.max("t").alias("_last"), F.first("terms_").alias("terms_")
    )
    done = first.join(settlements, F.col("terms_.expiration") == settlements.session_date, "left")
    credit = F.col("terms_.entry_credit")
    settled = terminal_payoff(F.col("terms_.legs"), credit, F.col("settlement_price").cast(DEC)).cast("double")
    held = F.col("x.reason").isNull()
    pnl = F.when(held, settled).otherwise(credit.cast("double") + F.col("x.value"))
    return done.select(
        "snapshot_id", "candidate_id", *[F.col(f"terms_.{c}") for c in extra], F.col("terms_.expiration").alias("session_date"),
        F.round(pnl, 6).alias("realized_pnl"),
        F.coalesce("x.reason", F.lit("expiration_settlement")).alias("exit_reason"),
        F.coalesce("x.t", "_last").alias("exit_micros"),
        (held | (F.col("x.reason") == "expiration_settlement")).alias("held_to_expiry"),
    ).filter(F.col("realized_pnl").isNotNull())


def skipped_sessions(candidates: DataFrame, paths: DataFrame, settlements: DataFrame) -> DataFrame:
    """(session_date, reason, n_candidates) of the sessions that give no training rows: no close, else no bars."""
    closed = settlements.filter(F.col("settlement_price").isNotNull()).select(F.col("session_date").alias("expiration"), F.lit(True).alias("_closed")).distinct()
    walked = paths.select(F.col("session_date").alias("expiration"), F.lit(True).alias("_walked")).distinct()
    counted = candidates.groupBy("expiration").agg(F.count(F.lit(1)).alias("n_candidates"))
    reason = F.when(F.col("_closed").isNull(), "never reached the close").when(F.col("_walked").isNull(), "no bars")
    return counted.join(closed, "expiration", "left").join(walked, "expiration", "left").select(
        F.col("expiration").alias("session_date"), reason.alias("reason"), "n_candidates"
    ).filter(F.col("reason").isNotNull())


def candidate_training_set(
    candidates: DataFrame, paths: DataFrame, settlements: DataFrame, policy: ExitPolicy | None = None, seconds: float = 300.0
) -> DataFrame:
    """Training rows of the candidate value model: of snapshots at least `seconds` apart within their session, every
    candidate with its economics as features and its managed P&L, absolute and per unit of maximum loss, as labels.

    Needs what `candidate_economics` and `managed_outcome` need. Sessions that `skipped_sessions` names and candidates
    without an outcome give no row.
    """
    closed = settlements.filter(F.col("settlement_price").isNotNull())
    candidates = candidates.join(closed.select(F.col("session_date").alias("expiration")).distinct(), "expiration", "left_semi")
    snapshots = candidates.groupBy("snapshot_id").agg(F.min("expiration").alias("session"), F.min("observed_at").alias("seen"))
    kept = thin_by_interval(snapshots, ["session"], ts="seen", seconds=seconds, tie=["snapshot_id"]).select("snapshot_id")
    mine = candidates.join(kept, "snapshot_id", "left_semi")
    features = candidate_economics(mine).select(
        "snapshot_id", "candidate_id", F.size("legs").alias("n_legs"), "minutes_to_close", "relative_spread", "quote_age", "expected_fill_fraction",
        "fill_probability", "fees", "entry_slippage", "exit_slippage", "maximum_loss",
    )
    labels = managed_outcome(mine, paths, closed, policy)
    return labels.join(features, ["snapshot_id", "candidate_id"]).withColumn(
        "return_on_risk", F.when(F.col("maximum_loss") > 0, ratio(F.col("realized_pnl"), F.col("maximum_loss").cast("double")))
    )


def settle_session(positions: DataFrame, settlements: DataFrame) -> DataFrame:
    """Terminal P&L × contracts to 4 places (half-even) for traded and blocked (counterfactual) candidates."""
    pnl = terminal_payoff(F.col("legs"), F.col("entry_credit"), F.col("settlement_price").cast(DEC)) * F.col("contracts")
    return positions.join(settlements, positions.expiration == settlements.session_date).select(
        "snapshot_id", "candidate_id", "session_date", "settlement_price", "was_traded", "contracts",
        F.bround(pnl.cast("decimal(24,6)"), 4).alias("realized_pnl"),
        F.sha2(F.concat_ws("|", F.col("session_date").cast("string"), "candidate_id", F.col("was_traded").cast("string"), F.col("settlement_price").cast("string")), 256).alias("record_id"),
    ).filter(F.col("settlement_price").isNotNull())
