"""Append-only records: sequence checks, hash chains, state transitions, read models, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import chunked_lag, fold_sorted, number_rows

CHUNK_ROWS = 100_000


def _chunked(df: DataFrame, seq: str) -> DataFrame:
    """Blocks of consecutive sequence numbers, so a hot session or chain spreads over tasks."""
    return df.withColumn("_slot", F.floor(F.col(seq) / CHUNK_ROWS))


def verify_sequence(records: DataFrame, keys: Sequence[str], order: str = "line_no", seq: str = "seq") -> DataFrame:
    """Records whose seq does not follow the previous record's (file order), with that previous seq."""
    lagged = chunked_lag(_chunked(records, order), keys, "_slot", [order], {seq: "previous_seq"})
    return lagged.drop("_slot").filter(F.col(seq) != F.col("previous_seq") + 1)


def record_hash(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def inspect_recordings(records: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """Per recording: clean / sequence_gap / unrepairable / empty, with counts.

    `records` holds every line: payload and record_hash, seq, `parsed` (false for an unreadable line). A hash
    mismatch or a missing key is unrepairable; an unreadable line is dropped.
    """
    keys = list(keys)
    good = F.col("parsed") & F.col("seq").isNotNull() & F.col("record_hash").isNotNull() & F.col("payload").isNotNull()
    hash_ok = F.coalesce(record_hash(F.col("payload")) == F.col("record_hash"), F.lit(False))
    lines = records.select("*", (good & hash_ok).alias("_ok"), (F.col("parsed") & ~(good & hash_ok)).alias("_hard"))
    breaks = verify_sequence(lines.filter("_ok"), keys, order).groupBy(*keys).agg(F.count(F.lit(1)).alias("sequence_breaks"))
    agg = lines.groupBy(*keys).agg(
        F.count_if("_ok").alias("records"), F.count_if("_hard").alias("hard_errors"), F.count_if(~F.col("parsed")).alias("skipped")
    )
    n = F.coalesce("sequence_breaks", F.lit(0))
    status = (
        F.when(F.col("hard_errors") > 0, "unrepairable").when(F.col("records") == 0, "empty").when(n > 0, "sequence_gap").otherwise("clean")
    )
    return agg.join(breaks, keys, "left").select(
        *keys, status.alias("status"), "records", "hard_errors", n.alias("sequence_breaks"), "skipped"
    )


def renumber(records: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """Gap-free seq from 0 in file order."""
    slotted = _chunked(records, order)
    return number_rows(slotted.drop("seq"), keys, "_slot", [order], "seq").drop("_slot")


def repair_recordings(records: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """Records of recordings whose only fault is a sequence gap, renumbered; other recordings are left out."""
    keys = list(keys)
    report = inspect_recordings(records, keys, order).filter("status = 'sequence_gap'").select(*keys)
    return renumber(records.filter("parsed").join(report, keys, "left_semi"), keys, order)


def event_digest(previous: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts, F.coalesce(previous, F.lit(""))), 256)


def build_hash_chain(events: DataFrame, chain: str = "chain", order: str = "sequence_number", parts: Sequence[str] = ("status",)) -> DataFrame:
    """Stamp payload_hash, previous_event_hash and event_hash. Serial within a chain, so it streams in order with the
    previous digest as the only state; chains run in parallel."""
    prepared = events.withColumn("payload_hash", F.sha2("payload", 256))
    # all but the previous digest is put together in Spark, as the verification does, so nulls and types read alike
    own = F.concat_ws("|", *[F.col(c).cast("string") for c in (chain, order, *parts)], F.col("payload_hash"))
    prepared = prepared.withColumn("digest_text", own)

    def step(state: dict, row) -> tuple:
        previous = state["h"]
        text = f"{row.digest_text}|{previous or ''}"
        state["h"] = hashlib.sha256(text.encode()).hexdigest()
        return previous, state["h"]

    return fold_sorted(prepared, [chain], [order], step, lambda: {"h": None}, "previous_event_hash string, event_hash string").drop("digest_text")


def verify_hash_chain(events: DataFrame, chain: str = "chain", order: str = "sequence_number", parts: Sequence[str] = ("status",)) -> DataFrame:
    """Per chain: events, broken links (sequence, previous hash or digest), and whether it verifies. Fully parallel:
    each event recomputes its own digest and compares with its neighbour."""
    slotted = _chunked(events, order)
    lagged = chunked_lag(slotted, [chain], "_slot", [order], {order: "_pseq", "event_hash": "_phash"})
    digest = event_digest(
        F.col("previous_event_hash"), *[F.col(c).cast("string") for c in (chain, order, *parts)], F.sha2("payload", 256)
    )
    seq_ok = F.col(order) == F.coalesce(F.col("_pseq"), F.lit(0)) + 1
    link_ok = F.col("previous_event_hash").eqNullSafe(F.col("_phash"))
    bad = ~(seq_ok & link_ok & (digest == F.col("event_hash")))
    return lagged.groupBy(chain).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(bad).alias("broken"), F.min(F.when(bad, F.col(order))).alias("first_broken")
    ).withColumn("verified", F.col("broken") == 0)


# fixed values: allowed status transitions
ORDER_TRANSITIONS = {
    "CREATED": ("VALIDATED", "REJECTED", "ERROR", "ROUTED", "CANCELED"),
    "VALIDATED": ("SUBMITTED_SIMULATED", "REJECTED", "EXPIRED", "ERROR", "ROUTED"),
    "SUBMITTED_SIMULATED": ("ACKNOWLEDGED", "REJECTED", "CANCEL_PENDING", "EXPIRED", "ERROR"),
    "ROUTED": ("ACKNOWLEDGED", "PARTIALLY_FILLED", "FILLED", "CANCELED", "REJECTED", "CANCEL_PENDING", "EXPIRED", "ERROR"),
    "ACKNOWLEDGED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_PENDING", "REJECTED", "EXPIRED", "ERROR"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_PENDING", "EXPIRED", "ERROR", "CANCELED"),
    "CANCEL_PENDING": ("CANCELED", "PARTIALLY_FILLED", "FILLED", "ERROR"),
    "FILLED": (), "CANCELED": (), "REJECTED": (), "EXPIRED": (), "ERROR": (),
}
POSITION_TRANSITIONS = {
    "PENDING_OPEN": ("OPEN", "CLOSED", "RECONCILIATION_ERROR"),
    "OPEN": ("PARTIALLY_REDUCED", "CLOSE_PENDING", "CLOSING", "CLOSED", "EXPIRED", "RECONCILIATION_ERROR"),
    "PARTIALLY_REDUCED": ("PARTIALLY_REDUCED", "CLOSE_PENDING", "CLOSING", "CLOSED", "EXPIRED", "RECONCILIATION_ERROR"),
    "CLOSE_PENDING": ("OPEN", "PARTIALLY_REDUCED", "CLOSED", "EXPIRED", "RECONCILIATION_ERROR"),
    "CLOSING": ("CLOSED", "RECONCILIATION_ERROR"),
    "CLOSED": ("SETTLED", "RECONCILIATION_ERROR"),
    "EXPIRED": ("SETTLED", "RECONCILIATION_ERROR"),
    "SETTLED": (), "RECONCILIATION_ERROR": (),
}


def validate_transitions(events: DataFrame, key: str, order: str, transitions: dict[str, Sequence[str]], status: str = "status") -> DataFrame:
    """Every step with its previous status: `valid`, and `terminal` for statuses nothing may follow.

    The allowed pairs are a fixed small map held as a literal, so there is no join.
    """
    lagged = chunked_lag(_chunked(events, order), [key], "_slot", [order], {status: "previous_status"})
    allowed = F.create_map(*[x for k, v in transitions.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    nexts = F.try_element_at(allowed, F.col("previous_status"))
    valid = F.col("previous_status").isNull() | F.coalesce(F.array_contains(nexts, F.col(status)), F.lit(False))
    terminal = F.col(status).isin(*[k for k, v in transitions.items() if not v]) if any(not v for v in transitions.values()) else F.lit(False)
    return lagged.drop("_slot").select("*", valid.alias("valid"), terminal.alias("terminal"))


def _latest(col: str, seq: str = "sequence_number") -> Column:
    """Last known value of a field in sequence order (an absent field keeps the earlier value)."""
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(seq)))


def journal_projections(events: DataFrame) -> dict[str, DataFrame]:
    """Order, position, outcome and session read models of an (unordered) journal.

    Needs event_type, aggregate_id, sequence_number, account_id, candidate_id, filled_contracts, open_contracts,
    realized_pnl, record_id, session_date (payload fields, NULL when absent).
    """
    c = F.col
    orders = events.filter(c("event_type").startswith("order_")).groupBy("aggregate_id").agg(
        F.upper(F.regexp_replace(_latest("event_type"), "^order_", "")).alias("status"),
        _latest("account_id").alias("account_id"), _latest("candidate_id").alias("candidate_id"),
        F.coalesce(_latest("filled_contracts"), F.lit(0)).alias("filled_contracts"),
    )
    closed = F.max(F.when(c("event_type") == "position_closed", c("sequence_number")))
    positions = events.filter(c("event_type").startswith("position_")).groupBy("aggregate_id").agg(
        F.upper(F.regexp_replace(_latest("event_type"), "^position_", "")).alias("status"),
        _latest("account_id").alias("account_id"), _latest("candidate_id").alias("candidate_id"),
        F.when(closed == F.max("sequence_number"), 0).otherwise(F.coalesce(_latest("open_contracts"), F.lit(0))).alias("open_contracts"),
    )
    settled = events.filter(c("event_type").isin("outcome_settled", "counterfactual_settled")).withColumn(
        "counterfactual", c("event_type") == "counterfactual_settled"
    )
    outcomes = settled.groupBy("record_id").agg(
        F.max_by(F.struct("candidate_id", "realized_pnl", "counterfactual"), "sequence_number").alias("o")
    ).select("record_id", "o.*")
    sessions = settled.groupBy(F.coalesce("session_date", F.lit("unknown")).alias("session_date")).agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(~c("counterfactual")).alias("outcomes"),
        F.count_if("counterfactual").alias("counterfactuals"),
        F.coalesce(F.sum(F.when(~c("counterfactual"), c("realized_pnl"))), F.lit(0)).alias("realized_pnl_total"),
    )
    return {"orders": orders, "positions": positions, "outcomes": outcomes, "sessions": sessions}


def rebuild(events: DataFrame, **chain_columns) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(chains that do not verify, projections of the chains that do) from an unordered journal."""
    checked = verify_hash_chain(events, **chain_columns)
    broken = checked.filter(~F.col("verified"))
    good = events.join(broken.select("chain"), "chain", "left_anti")
    return broken, journal_projections(good)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content fingerprint of a whole table: row count plus two independent sums of row hashes.

    Sums combine map-side, so nothing is sorted or collected; equal tables always agree.
    """
    cols = list(columns or sorted(df.columns))
    wide = "decimal(38,0)"
    return df.select(
        F.xxhash64(*cols).alias("a"), F.conv(F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 15), 16, 10).cast("bigint").alias("b")
    ).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("a").cast(wide)).cast("string").alias("hash_sum"),
        F.sum(F.col("b").cast(wide)).cast("string").alias("digest_sum"),
    )


def require_same(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> None:
    """Refuse a comparison whose inputs differ (manifest rule)."""
    a, b = fingerprint(left, columns).first(), fingerprint(right, columns).first()
    if a != b:
        raise ValueError(f"inputs differ, comparison refused: {a} vs {b}")


def latest_wins(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Current view of an append-only log: the last row per id."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def open_gaps(log: DataFrame, now: Column, max_age_days: int = 14) -> DataFrame:
    """Losing archetypes still open: latest row per archetype says weak, and it is at most 14 days old."""
    view = latest_wins(log, "archetype", ["observed_at"])
    age = F.unix_micros(now) - F.unix_micros("observed_at")
    return view.filter((F.col("kind") == "weak_archetype") & (age <= max_age_days * 86_400_000_000))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, tagged with the side (multiset difference both ways)."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


def expanding_folds(sessions: DataFrame, n_folds: int = 4, embargo: int = 1, min_train: int = 8, min_val: int = 2, calibration: float | None = None) -> DataFrame:
    """Walk-forward membership rows (fold, session_date, role) over chronologically ranked sessions.

    Roles: train, embargo, test and, when a calibration share is given, calibration carved from the end of train with
    its own embargo. Bounds are arithmetic on ranks; one row per session, so the ranking window is a calendar.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sessions.select("session_date").distinct().select(
        "session_date", (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("session_date")) - 1).alias("r"),
        F.count(F.lit(1)).over(every).alias("n"),
    )
    step = F.greatest(F.lit(min_val), F.floor((F.col("n") - min_train) / max(n_folds, 1))).cast("int")
    ok = (F.col("n") >= min_train + embargo + min_val) & (F.col("n") - min_train >= min_val)
    rows = ranked.filter(ok).select("*", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    train_end = F.lit(min_train) + F.col("fold") * (F.col("step") + embargo)
    test_start = F.least(train_end + embargo, F.col("n"))
    test_end = F.least(test_start + F.col("step"), F.col("n"))
    live = rows.select("*", train_end.alias("te"), test_start.alias("ts"), test_end.alias("tz")).filter(F.col("ts") < F.col("tz"))
    fit_end, cal_start = F.col("te"), F.col("te")
    if calibration is not None:
        n_cal = F.least(F.lit(max(min_val, 1)), F.greatest(F.lit(0), F.rint(F.col("te") * calibration).cast("int")))
        n_cal = F.when(F.col("te") - n_cal < min_train, 0).otherwise(n_cal)
        enough = (n_cal > 0) & (F.col("te") - n_cal - embargo >= min_train)
        fit_end = F.when(enough, F.col("te") - n_cal - embargo).otherwise(F.col("te"))
        cal_start = F.when(enough, F.col("te") - n_cal).otherwise(F.col("te"))
    r = F.col("r")
    role = (
        F.when(r < fit_end, "train").when(r < cal_start, "embargo").when(r < F.col("te"), "calibration")
        .when(r < F.col("ts"), "embargo").when(r < F.col("tz"), "test")
    )
    return live.select("fold", "session_date", role.alias("role")).filter(F.col("role").isNotNull())


def prequential_walk(scores: DataFrame, warm: int = 2, embargo: int = 1, sealed: Sequence[str] = ()) -> DataFrame:
    """Blind-day differences champion − baseline per session after warm-up and embargo, sealed sessions left out.

    `scores` has one row per session (session_date, champion, baseline).
    """
    order = Window.partitionBy(F.lit(0)).orderBy("session_date")
    ranked = scores.select("*", (F.row_number().over(order) - 1).alias("r"))
    open_days = ranked.filter((F.col("r") >= warm + embargo) & ~F.col("session_date").cast("string").isin(*sealed) if sealed else (F.col("r") >= warm + embargo))
    return open_days.select("session_date", (F.col("champion") - F.col("baseline")).alias("forward_transfer"))


def thin_by_interval(rows: DataFrame, keys: Sequence[str], ts: str = "ts", seconds: float = 300.0, tie: Sequence[str] = ()) -> DataFrame:
    """Keep a row when at least the interval has passed since the last *kept* row of its key (greedy, in order)."""
    timed = rows.withColumn("micros_", F.unix_micros(ts))

    def step(state: dict, row) -> tuple:
        keep = state["t"] is None or row.micros_ - state["t"] >= seconds * 1e6
        if keep:
            state["t"] = row.micros_
        return (keep,)

    folded = fold_sorted(timed, keys, ["micros_", *tie], step, lambda: {"t": None}, "kept boolean")
    return folded.filter("kept").drop("kept", "micros_")


def recent_sessions(rows: DataFrame, n: int, session: str = "session_date") -> DataFrame:
    """Rows of the newest n recorded sessions."""
    newest = rows.select(session).distinct().orderBy(F.col(session).desc()).limit(n)
    return rows.join(F.broadcast(newest), session, "left_semi")
