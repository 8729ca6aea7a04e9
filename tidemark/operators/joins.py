"""As-of, horizon, interval and reconciliation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import codes


def asof_age(source_ts: str | Column, obs_ts: str | Column) -> Column:
    """Source age in seconds at the observation (negative = the source lies in the future)."""
    return (F.unix_micros(obs_ts) - F.unix_micros(source_ts)) / F.lit(1e6)


def asof_guard(rows: DataFrame, source_ts: str = "source_ts", obs_ts: str = "obs_ts") -> tuple[DataFrame, DataFrame]:
    """(rows with `age_seconds`, rows whose source is in the future). A future source is reported, never dropped
    silently: callers write the second frame out or fail on it."""
    aged = rows.withColumn("age_seconds", asof_age(source_ts, obs_ts))
    future = F.coalesce(F.col("age_seconds") < 0, F.lit(False))
    return aged.filter(~future), aged.filter(future)


def asof_guard_strict(rows: DataFrame, source_ts: str = "source_ts", obs_ts: str = "obs_ts") -> DataFrame:
    """Rows with `age_seconds`; the job fails on the first future source it meets."""
    age = asof_age(source_ts, obs_ts)
    message = F.concat(F.lit("as-of violation: source in the future by "), (-age).cast("string"), F.lit("s"))
    return rows.withColumn("age_seconds", F.when(age < 0, F.raise_error(message).cast("double")).otherwise(age))


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: str | None = None,
    chunk: str = "hour",
) -> DataFrame:
    """Latest right row with ts <= the left row's ts, per key; NULLs when there is none.

    Rows are windowed per (key, hour), and the last right row of earlier hours is carried in from a window over one
    row per (key, hour), so a key with any share of the rows is spread over its hours. No range join.
    """
    keys = list(keys)
    slot = lambda ts: F.date_trunc(chunk, ts)
    payload = F.struct(F.col(right_ts).alias("_rts"), *[F.col(v).alias(v) for v in values])
    order = F.struct(right_ts, tie) if tie else F.struct(right_ts)
    lhs = left.select("*", slot(left_ts).alias("_slot"))
    rhs = right.select(*keys, F.col(right_ts), *([tie] if tie else []), *[v for v in values if v not in (right_ts, tie)],
                       slot(right_ts).alias("_slot"))
    latest = rhs.groupBy(*keys, "_slot").agg(F.max_by(payload, order).alias("_last"))
    slots = latest.unionByName(lhs.select(*keys, "_slot").distinct(), allowMissingColumns=True).groupBy(*keys, "_slot").agg(
        F.max("_last").alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*keys, "_slot", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    events = rhs.select(
        *keys, "_slot", F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
        (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("_tie"), payload.alias("_r"),
    ).unionByName(
        lhs.select(
            *keys, "_slot", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"),
            F.struct(*left.columns).alias("_l"),
        ),
        allowMissingColumns=True,
    )
    w = Window.partitionBy(*keys, "_slot").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = events.select(*keys, "_slot", "_side", "_l", F.last("_r", ignorenulls=True).over(w).alias("_r")).filter(
        "_side = 1"
    )
    got = F.coalesce("_r", "_carry")
    return filled.join(carry, [*keys, "_slot"]).select(
        "_l.*", got["_rts"].alias("source_ts"), *[got[v].alias(f"asof_{v}") for v in values if v != right_ts]
    )


def asof_feature_row(obs: DataFrame, features: dict[str, tuple[str, str]], obs_ts: str = "ts") -> DataFrame:
    """Feature map, missingness, ages and coverage from (value column, source timestamp column) pairs.

    A NaN is missing. A value whose source lies in the future is listed in `violations` and not used.
    """
    known, future = {}, {}
    for name, (value, ts) in features.items():
        v = F.col(value).cast("double")
        future[name] = F.coalesce(F.col(ts) > F.col(obs_ts), F.lit(False))
        known[name] = F.when(~F.isnan(v) & ~future[name], v)
    n = len(features)
    present = sum((k.isNotNull().cast("int") for k in known.values()), F.lit(0))
    return obs.select(
        "*",
        F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)]).alias("features"),
        F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v.isNull().cast("int"))]).alias("missingness"),
        F.create_map(
            *[x for k, v in known.items() for x in (F.lit(k), F.when(v.isNotNull(), asof_age(features[k][1], obs_ts)))]
        ).alias("source_ages"),
        F.round(present / float(n), 6).alias("coverage"),
        codes(*[(f, k) for k, f in future.items()]).alias("violations"),
    )


def decisions_with_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Trading decisions with the P&L of what they chose.

    The last outcome per snapshot wins (`seq`); a per-candidate P&L overrides the snapshot's; regret is the best
    candidate's P&L minus the chosen one's. Outcomes without P&L do not match.
    """
    last = outcomes.groupBy("snapshot_id").agg(
        F.max_by(F.struct("session_date", "realized_pnl", "true_direction", "pnl_by_candidate"), "seq").alias("o")
    )
    taken = decisions.filter(F.col("action").isin("TRADE", "SELECT_CANDIDATE"))
    by = F.col("o.pnl_by_candidate")
    own = F.try_element_at(by, F.col("candidate_id"))
    best = F.array_max(F.map_values(by))
    pnl = F.coalesce(own, F.col("o.realized_pnl"))
    norm = lambda c: _direction_alias(F.lower(F.trim(c)))
    return (
        taken.join(last, "snapshot_id")
        .filter(F.col("o.realized_pnl").isNotNull())
        .select(
            *decisions.columns,
            F.col("o.session_date").alias("session_date"),
            pnl.alias("pnl"),
            (pnl > 0).alias("win"),
            (norm(F.col("o.true_direction")) == norm(F.col("direction"))).alias("direction_hit"),
            F.when(
                F.size(by) > 0, F.when(own.isNull(), F.greatest(best, F.lit(0.0))).otherwise(best - own)
            ).alias("regret"),
        )
    )


# fixed values: direction aliases
DIRECTION_ALIASES = {
    "up": "bullish", "down": "bearish", "bull": "bullish", "bear": "bearish", "long": "bullish", "short": "bearish",
}


def _direction_alias(c: Column) -> Column:
    out = c
    for alias, name in DIRECTION_ALIASES.items():
        out = F.when(c == alias, F.lit(name)).otherwise(out)
    return out


def prefer_outcomes(provider: DataFrame, embedded: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Provider rows first; an embedded outcome only where the provider has none."""
    return provider.withColumn("origin", F.lit("provider")).unionByName(
        embedded.join(provider.select(key).distinct(), key, "left_anti").withColumn("origin", F.lit("embedded"))
    )


def only_journaled(candidates: DataFrame, journal: DataFrame, event_type: str = "candidates_generated") -> DataFrame:
    """Snapshots with a matching journal event (semi join)."""
    ids = journal.filter(F.col("event_type") == event_type).select("snapshot_id")
    return candidates.join(ids, "snapshot_id", "left_semi")


def reconcile_positions(local: DataFrame, broker: DataFrame) -> DataFrame:
    """Open positions that differ by id: missing at the broker, orphan at the broker, or a quantity mismatch."""
    a = local.select("position_id", F.col("account_id").alias("l_account"), F.col("quantity").alias("l_qty"))
    b = broker.select("position_id", F.col("account_id").alias("b_account"), F.col("quantity").alias("b_qty"))
    issue = (
        F.when(F.col("b_qty").isNull(), "missing_position")
        .when(F.col("l_qty").isNull(), "orphan_position")
        .when(F.col("l_account") != F.col("b_account"), "cross_account")
        .when(F.col("l_qty") != F.col("b_qty"), "quantity_mismatch")
    )
    return a.join(b, "position_id", "full_outer").withColumn("issue", issue).filter(F.col("issue").isNotNull())


def reconcile_cash(ledger: DataFrame, statement: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Accounts whose cash differs by more than the tolerance, or exists on one side only."""
    a = ledger.select("account_id", F.col("cash").alias("ledger_cash"))
    b = statement.select("account_id", F.col("cash").alias("statement_cash"))
    gap = F.abs(F.col("ledger_cash") - F.col("statement_cash"))
    return a.join(b, "account_id", "full_outer").filter(
        F.coalesce(gap > F.lit(tolerance).cast("decimal(18,6)"), F.lit(True))
    )


def decision_parity(live: DataFrame, replay: DataFrame, fields: Sequence[str], key: str = "snapshot_id") -> DataFrame:
    """Per (key, field) rows where live and replay differ, over the union of ids; absent counts as ''."""
    side = lambda df, p: df.select(
        key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"{p}_{f}") for f in fields]
    )
    joined = side(live, "l").join(side(replay, "r"), key, "full_outer")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    diffs = F.array_compact(
        F.array(
            *[
                F.when(
                    blank(f"l_{f}") != blank(f"r_{f}"),
                    F.struct(F.lit(f).alias("field"), blank(f"l_{f}").alias("live"), blank(f"r_{f}").alias("replay")),
                )
                for f in fields
            ]
        )
    )
    return joined.select(key, F.inline(diffs))


def revenge_trades(exits: DataFrame, entries: DataFrame, window_seconds: int = 900) -> DataFrame:
    """Unapproved entries at most 15 minutes after a losing exit of the same session.

    Each entry only needs the latest losing exit at or before it: an as-of lookup on the session key, linear in the
    rows, where a range join would pair every entry with every exit.
    """
    losing = exits.filter(F.col("pnl") < 0).select("session_date", F.col("exit_at"))
    unapproved = entries.filter(~F.col("approved"))
    looked = asof_latest(unapproved, losing, ["session_date"], ["exit_at"], left_ts="entry_at", right_ts="exit_at")
    gap = F.unix_micros("entry_at") - F.unix_micros("source_ts")
    return looked.filter(gap.between(0, window_seconds * 1_000_000))
