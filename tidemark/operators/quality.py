"""Feed freshness, data quality, operational vetoes and row validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import codes, finite

# fixed values: feed components, statuses, vetoes, fill provenance
REQUIRED_COMPONENTS = ("spot", "bars", "option_chain", "settlement")
FRESH = ("LIVE", "DELAYED", "FALLBACK")
DELAYED_MULTIPLE = 3.0
FILL_SOURCES = (
    "paper", "manual_paper", "broker_actual", "user_confirmed", "hypothetical",
    "rejected", "cancelled", "expired_unfilled", "advisory",
)
FILL_MODES = ("research", "shadow", "advisory", "candidate", "champion", "paper")


def feed_age(received_at: str | Column = "received_at", observed_at: str | Column = "observed_at") -> Column:
    """Seconds from observation to receipt; NULL when the observation time is unknown."""
    return (F.unix_micros(received_at) - F.unix_micros(observed_at)) / F.lit(1e6)


def classify_feed(
    age: Column, limit: Column, present: Column | None = None, valid: Column | None = None,
    fallback: Column | None = None,
) -> Column:
    """Feed status, fail-closed: missing and invalid win over freshness."""
    fb = F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))
    out = (
        F.when(age.isNull(), F.when(fb, "FALLBACK").otherwise("DELAYED"))
        .when(age < 0, "INVALID")
        .when(age > limit * DELAYED_MULTIPLE, "STALE")
        .when(age > limit, "DELAYED")
        .otherwise(F.when(fb, "FALLBACK").otherwise("LIVE"))
    )
    if valid is not None:
        out = F.when(~valid, "INVALID").otherwise(out)
    if present is not None:
        out = F.when(~present, "MISSING").otherwise(out)
    return out


def with_status(feed: DataFrame) -> DataFrame:
    return feed.withColumn(
        "status", classify_feed(F.col("age_seconds"), F.col("freshness_limit_seconds"), fallback=F.col("fallback_used"))
    )


def classify_heartbeat(age: Column, interval: Column, stale_multiple: float = 3.0) -> Column:
    """ok / late / stale / unknown."""
    return (
        F.when(age.isNull(), "unknown")
        .when((interval <= 0) | (age <= interval), "ok")
        .when(age <= interval * stale_multiple, "late")
        .otherwise("stale")
    )


def latest_status(feed: DataFrame) -> DataFrame:
    """Last reported status per (snapshot, component); partial aggregation, no sort."""
    return feed.groupBy("snapshot_id", "component").agg(F.max_by("status", "seq").alias("status"))


def snapshot_quality(feed: DataFrame, required: Sequence[str] = REQUIRED_COMPONENTS) -> DataFrame:
    """Per snapshot: is_live, missing required components, quality flags, penalty, health.

    `feed` holds status rows (snapshot_id, component, status, seq). The latest status per component decides what is
    missing and whether the snapshot is live; every stale or delayed observation counts as degraded.
    """
    need = F.array(*[F.lit(r) for r in required])
    tag = F.concat_ws(":", "component", "status")
    degraded = F.col("status").isin("STALE", "DELAYED")
    # counts per tag first, so a snapshot with very many observations collects only the distinct tags
    per_tag = feed.groupBy("snapshot_id", "component", "status").agg(
        F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")
    )
    per_component = per_tag.groupBy("snapshot_id", "component").agg(
        F.max_by("status", "seq").alias("last_status"),
        F.collect_list(F.when(degraded, F.struct(tag.alias("tag"), F.col("n").alias("n")))).alias("bad"),
    )
    ok = ~F.col("last_status").isin("MISSING", "INVALID")
    agg = per_component.groupBy("snapshot_id").agg(
        F.collect_set(F.when(ok, F.col("component"))).alias("usable"),
        F.count_if((F.col("last_status") == "LIVE") & F.col("component").isin(*required)).alias("n_live"),
        F.flatten(F.collect_list("bad")).alias("bad"),
    )
    missing = F.array_except(need, F.col("usable"))
    n_degraded = F.aggregate("bad", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return agg.select(
        "snapshot_id",
        (F.col("n_live") == len(required)).alias("is_live"),
        missing.alias("missing_components"),
        F.concat(
            F.transform(missing, lambda m: F.concat(F.lit("missing:"), m)),
            F.sort_array(F.transform("bad", lambda b: b["tag"])),
        ).alias("flags"),
        F.least(F.lit(1.0), 0.5 * F.size(missing) + 0.1 * n_degraded).alias("penalty"),
        (F.size(missing) == 0).alias("is_healthy"),
    )


def operational_vetoes(snap: DataFrame, entry_lockout: int = 15, min_strikes: int = 5) -> DataFrame:
    """Ordered veto codes of one snapshot row.

    Needs session_status, spot/bars/option_chain status columns, contracts_total, strikes_total, has_calls,
    has_puts, catalyst_active and minutes_to_close.
    """
    c = F.col
    fresh = lambda name: F.coalesce(c(name).isin(*FRESH), F.lit(False))
    empty = F.coalesce(c("contracts_total"), F.lit(0)) == 0
    both = c("has_calls") & c("has_puts")
    pre = c("session_status") == "PRE_OPEN"
    return snap.withColumn(
        "vetoes",
        codes(
            (c("session_status").isin("CLOSED", "HOLIDAY"), "SESSION_CLOSED"),
            (~fresh("spot_status"), "STALE_DATA"),
            (~fresh("bars_status"), "STALE_DATA"),
            (~fresh("chain_status"), "MISSING_CHAIN"),
            (empty, "MISSING_CHAIN"),
            (~empty & ~both, "INVALID_SURFACE"),
            (~empty & both & (c("strikes_total") < min_strikes), "INSUFFICIENT_LIQUIDITY"),
            (c("catalyst_active"), "CATALYST_LOCKOUT"),
            (pre, "SESSION_CLOSED"),
            (~pre & (c("minutes_to_close") <= entry_lockout), "ENTRY_CUTOFF"),
        ),
    )


def validate_fill_records(fills: DataFrame) -> DataFrame:
    """Fill rows with the array of provenance rules each one breaks (empty = valid)."""
    c = F.col
    blank = lambda n: F.coalesce(F.trim(c(n)) == "", F.lit(True))
    filled = F.coalesce(c("filled"), F.lit(False))
    return fills.withColumn(
        "reject_reasons",
        codes(
            (blank("fill_record_id"), "fill_record_id_required"),
            (blank("snapshot_id") | blank("candidate_id"), "identity_required"),
            (~F.coalesce(c("source").isin(*FILL_SOURCES), F.lit(False)), "unknown_source"),
            (~F.coalesce(c("mode").isin(*FILL_MODES), F.lit(False)), "unknown_mode"),
            ((c("source") == "broker_actual") & c("simulated"), "simulated_as_actual"),
            (c("midpoint_diagnostic") & filled, "midpoint_filled"),
            (c("source").isin("hypothetical", "advisory") & filled, "source_cannot_fill"),
            (c("decision_ts") > c("submitted_ts"), "decision_after_submit"),
            (c("resolved_ts") < c("submitted_ts"), "resolved_before_submit"),
            (filled & c("fill_credit").isNull(), "fill_credit_required"),
            (c("partial_fill") & (F.coalesce(c("filled_quantity"), F.lit(0)) <= 0), "partial_without_quantity"),
        ),
    )


def realized_fill_fraction(mid: Column, natural: Column, fill: Column, eps: float = 1e-9) -> tuple[Column, Column]:
    """Concession from mid toward natural as (raw, clipped to [0,1]); 0 when mid and natural coincide."""
    denom = mid - natural
    raw = F.when(fill.isNotNull(), F.when(F.abs(denom) < eps, 0.0).otherwise(F.try_divide(mid - fill, denom)))
    return raw, F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def missing_inputs(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Names of required columns that are NULL (a column that does not exist is always missing)."""
    have = set(df.columns)
    checks = [(F.col(n).isNull() if n in have else F.lit(True), n) for n in required]
    return df.withColumn("missing_inputs", codes(*checks))


def domain_checks(df: DataFrame, finite_cols=(), probabilities=(), non_negative=()) -> DataFrame:
    """Array of broken domain rules per row, named rule:column."""
    checks: list[tuple[Column, str]] = []
    for n in finite_cols:
        checks.append((F.col(n).isNotNull() & finite(n).isNull(), f"finite:{n}"))
    for n in probabilities:
        p = finite(n)
        checks.append((F.col(n).isNotNull() & ~F.coalesce(p.between(0.0, 1.0), F.lit(False)), f"probability:{n}"))
    for n in non_negative:
        v = finite(n)
        checks.append((F.col(n).isNotNull() & ~F.coalesce(v >= 0, F.lit(False)), f"non_negative:{n}"))
    return df.withColumn("domain_violations", codes(*checks))


# fixed values: feature-name prefixes that leak labels
LEAK_PREFIXES = ("realized_", "future_", "label_", "human_", "m_")
CANDIDATE_COLUMNS = ("candidate_id", "family", "legs", "candidate_rank", "gate_result", "policy_choice", "pnl")


def strip_label_leakage(features: Column) -> Column:
    """Feature map without label-like names."""
    def keep(name: Column, _value: Column) -> Column:
        bad = F.lit(False)
        for prefix in LEAK_PREFIXES:
            bad = bad | F.startswith(name, F.lit(prefix))
        return ~bad

    return F.map_filter(features, keep)


def refuse_candidate_columns(df: DataFrame, banned: Sequence[str] = CANDIDATE_COLUMNS) -> DataFrame:
    """Fail when an expert feature table carries candidate-level columns."""
    found = sorted(set(df.columns) & set(banned))
    if found:
        raise ValueError(f"candidate columns among expert features: {found}")
    return df


def failover(feed: DataFrame) -> DataFrame:
    """Per (snapshot, component) the lowest-order provider with data; a later order is flagged FALLBACK.

    Input: snapshot_id, component, provider, attempt_order, has_data, age_seconds, freshness_limit_seconds, seq.
    """
    usable = F.col("has_data")
    pick = F.struct("attempt_order", "seq")
    got = feed.groupBy("snapshot_id", "component").agg(
        F.min_by(
            F.when(usable, F.struct("provider", "attempt_order", "age_seconds", "freshness_limit_seconds")),
            F.when(usable, pick),
        ).alias("s"),
    )
    used = F.col("s.attempt_order") > 0
    return got.select(
        "snapshot_id",
        "component",
        F.col("s.provider").alias("provider"),
        F.coalesce(used, F.lit(False)).alias("fallback_used"),
        classify_feed(
            F.col("s.age_seconds"), F.col("s.freshness_limit_seconds"), present=F.col("s").isNotNull(), fallback=used
        ).alias("status"),
    )


def stale_feed_audit(feed: DataFrame, quality: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status counts, snapshots that are degraded but carry no penalty)."""
    counts = feed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    degraded = feed.filter(F.col("status").isin("STALE", "DELAYED", "MISSING", "INVALID")).select("snapshot_id").distinct()
    laundered = quality.filter(F.col("penalty") == 0).join(degraded, "snapshot_id", "left_semi")
    return counts, laundered


# fixed values: approved structure families (direction, entry bias, aliases)
FAMILIES = (
    ("long_call", "bullish", "debit", ()),
    ("long_put", "bearish", "debit", ()),
    ("call_debit_spread", "bullish", "debit", ("long_call_spread",)),
    ("put_debit_spread", "bearish", "debit", ("long_put_spread",)),
    ("bull_put_credit_spread", "bullish", "credit", ("put_credit",)),
    ("bear_call_credit_spread", "bearish", "credit", ("call_credit",)),
    ("iron_condor", "short_vol", "credit", ()),
    ("iron_butterfly", "short_vol", "credit", ("iron_fly",)),
    ("bounded_broken_wing_butterfly", "neutral", "credit", ("broken_wing",)),
    ("long_straddle", "long_vol", "debit", ()),
    ("long_strangle", "long_vol", "debit", ()),
    ("bounded_backspread_call", "bullish", "debit", ("backspread_call",)),
    ("bounded_backspread_put", "bearish", "debit", ("backspread_put",)),
)


def approved_family(df: DataFrame, column: str = "family") -> DataFrame:
    """Canonical family, direction and entry bias by name or alias; NULLs and approved=false for anything else."""
    rows = [
        (name, fam, direction, bias)
        for fam, direction, bias, aliases in FAMILIES
        for name in (fam, *aliases)
    ]
    dim = df.sparkSession.createDataFrame(
        rows, "_name string, canonical_family string, family_direction string, entry_bias string"
    )
    return (
        df.join(F.broadcast(dim), F.col(column) == F.col("_name"), "left")
        .drop("_name")
        .withColumn("approved", F.col("canonical_family").isNotNull())
    )
