"""Forward-looking labels from a session's completed bars.

Observations and bars are unioned and windowed per (symbol, session): a session's bars are bounded, and future
bars enter only through forward range frames, so no observation is paired with bars it does not use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio

# fixed values: horizons in minutes, direction thresholds
HORIZONS = {"5m": 5, "15m": 15, "30m": 30, "60m": 60}
MINUTE = 60_000_000  # microseconds
MIN_RETURN = 0.0002
MOVE_FRACTION = 0.05


def direction_label(
    ret: Column, implied_move: Column | None = None, cost: float = 0.0, min_return: float = MIN_RETURN,
    move_fraction: float = MOVE_FRACTION,
) -> Column:
    """+1 / −1 / 0 against max(minimum, share of the implied move, cost); NULL for an unknown return."""
    implied = F.coalesce(implied_move, F.lit(0.0)) if implied_move is not None else F.lit(0.0)
    threshold = F.greatest(F.lit(min_return), implied * move_fraction, F.lit(cost))
    return F.when(ret > threshold, 1).when(ret < -threshold, -1).when(ret.isNotNull(), 0)


def realized_direction(move: Column, band: float = 0.001) -> Column:
    """bullish / bearish outside the band, neutral inside."""
    return F.when(F.abs(move) < band, "neutral").when(move > 0, "bullish").when(move.isNotNull(), "bearish")


def _axis(obs: DataFrame, bars: DataFrame, keys: Sequence[str], obs_cols: Sequence[str]) -> DataFrame:
    """Bars and observations on one time axis; bar columns are NULL on observation rows and vice versa."""
    part = [*keys, "session_date"]
    w = Window.partitionBy(*part).orderBy("ts")
    b = bars.select(
        *part, "ts", "high", "low", "close",
        F.ln(F.col("close") / F.lag("close").over(w)).alias("ret"),
    ).withColumn("bar_ts", F.unix_micros("ts"))
    o = obs.select(*part, "ts", *obs_cols).withColumn("is_obs", F.lit(True))
    return (
        b.unionByName(o, allowMissingColumns=True)
        .withColumn("t", F.unix_micros("ts"))
        .withColumn("is_obs", F.coalesce("is_obs", F.lit(False)))
    )


BUCKET = 64  # bars of a bucket


def first_hit(high, low, start, level, kind: str):
    """Place of the first bar from `start` on whose high reaches the level (up), whose low does (down), or whose range holds
    it (touch); -1 if none. Buckets know their highest high and lowest low, so bars are looked at only in buckets that can
    hold the level."""
    import numpy as np

    n, found = len(high), np.full(len(start), -1, dtype=np.int64)
    for at in range(0, n, BUCKET):
        end = min(at + BUCKET, n)
        h, lo = high[at:end], low[at:end]
        can = (found < 0) & (start < end)
        if kind != "down":
            can &= np.nanmax(h, initial=-np.inf) >= level
        if kind != "up":
            can &= np.nanmin(lo, initial=np.inf) <= level
        rows = np.flatnonzero(can)
        if len(rows):
            want = level[rows][:, None]
            hit = np.arange(at, end)[None, :] >= start[rows][:, None]
            if kind != "down":
                hit &= h[None, :] >= want
            if kind != "up":
                hit &= lo[None, :] <= want
            some = hit.any(axis=1)
            found[rows[some]] = at + hit[some].argmax(axis=1)
    return found


def with_passages(obs: DataFrame, bars: DataFrame, keys: Sequence[str], levels: dict[str, tuple[str, str]]) -> DataFrame:
    """obs with one column for each entry name → (level column, kind): the time in microseconds of the first later bar of the
    session that hits the level (see first_hit), null if none does or the level is null.

    A session's bars stand once beside its observations; none is copied for an observation. Rows arrive sorted, a session's
    bars first, and leave batch by batch: a task holds the bars of one session, however many observations it has.
    """
    part = [*keys, "session_date"]
    names = {n: f"_l_{n}" for n in levels}
    tagged = obs.filter(F.col("ts").isNotNull()).withColumns({names[n]: F.col(c).cast("double") for n, (c, _) in levels.items()}).withColumns({"_t": F.unix_micros("ts"), "_bar": F.lit(False)})
    tape = bars.select(*part, F.unix_micros("ts").alias("_t"), F.col("high").cast("double").alias("_high"), F.col("low").cast("double").alias("_low"), F.lit(True).alias("_bar"))
    rows = tagged.unionByName(tape.filter(F.col("_high").isNotNull() & F.col("_low").isNotNull()), allowMissingColumns=True)
    keep = [f.name for f in obs.schema.fields]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in obs.schema.fields], *[f"`{n}` bigint" for n in levels]])

    def passages(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        current, tape, whole = None, [], None
        for batch in batches:
            bar = batch["_bar"].to_numpy(zero_copy_only=False)
            at, found = batch["_t"].to_numpy(zero_copy_only=False), {n: [] for n in levels}
            ends = sorted({e for p in part for e in pc.run_end_encode(batch[p]).run_ends.to_pylist()})
            for first, end in zip([0, *ends], ends):
                key = tuple(batch[p][first].as_py() for p in part)
                if key != current:
                    current, tape, whole = key, [], None
                split = first + int(bar[first:end].sum())
                if split > first:
                    tape.append([at[first:split], *[batch[c][first:split].to_numpy(zero_copy_only=False) for c in ("_high", "_low")]])
                    whole = None
                if split == end:
                    continue
                if whole is None:
                    whole = [np.concatenate(c) for c in zip(*tape)] if tape else [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)]
                times, high, low = whole
                start = np.searchsorted(times, at[split:end], "right")
                for n, (_, kind) in levels.items():
                    level = batch[names[n]][split:end].to_numpy(zero_copy_only=False).astype(float)
                    hit = first_hit(high, low, start, np.where(np.isnan(level), np.inf if kind != "down" else -np.inf, level), kind)
                    found[n].append(pa.array(times[hit] if len(times) else np.zeros(len(hit), dtype=np.int64), pa.int64(), mask=hit < 0))
            out = batch.filter(pa.array(~bar))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([*[out[c] for c in keep], *[pa.concat_arrays(found[n]) for n in levels]], names=[*keep, *levels])

    return rows.repartition(*part).sortWithinPartitions(*part, F.desc("_bar"), "_t").mapInArrow(passages, schema)


def label_observations(
    obs: DataFrame,
    bars: DataFrame,
    keys: Sequence[str] = ("symbol",),
    base_bar_minutes: int = 1,
    horizons: dict[str, int] | None = None,
    implied_move: str | None = None,
) -> DataFrame:
    """Every label per horizon for observations (obs_id, keys, session_date, ts, spot, call_wall, put_wall,
    gamma_flip).

    A horizon is NULL when its boundary lies past the last bar, or when the first bar at or after the boundary is
    more than one bar late; it is never truncated. Frames are in microseconds and start
    just after the observation.
    """
    horizons = HORIZONS if horizons is None else horizons
    have = [c for c in ("call_wall", "put_wall", "gamma_flip") if c in obs.columns]
    extra = [implied_move] if implied_move else []
    if "gamma_flip" in have:
        obs = with_passages(obs, bars, keys, {"_touch": ("gamma_flip", "touch")})
        extra = [*extra, "_touch"]
    axis = _axis(obs, bars, keys, ["obs_id", "spot", *have, *extra])
    part = [*keys, "session_date"]
    w = Window.partitionBy(*part).orderBy("t")
    spot = F.col("spot")
    bar = F.col("bar_ts").isNotNull()
    one = F.when(bar, F.struct("bar_ts", "high", "low", "close", "ret"))
    key = F.when(bar, F.col("t"))
    ahead = w.rangeBetween(1, Window.unboundedFollowing)
    tol = base_bar_minutes * MINUTE

    cols: list[Column] = [
        F.max(key).over(Window.partitionBy(*part)).alias("close_ts"),
        F.min_by(one, key).over(ahead).alias("start"),
        F.max(F.col("high")).over(ahead).alias("hi_close"),
        F.min(F.col("low")).over(ahead).alias("lo_close"),
        F.max(F.col("close")).over(ahead).alias("maxc_close"),
        F.min(F.col("close")).over(ahead).alias("minc_close"),
        F.sum(F.col("ret") * F.col("ret")).over(ahead).alias("r2_close"),
        F.max_by(one, key).over(ahead).alias("end_close"),
    ]
    for h, minutes in horizons.items():
        s = minutes * MINUTE
        end = w.rangeBetween(s, s + tol)
        inner = w.rangeBetween(1, s - 1)
        cols += [
            F.min_by(one, key).over(end).alias(f"end_{h}"),
            F.max("high").over(inner).alias(f"hi_{h}"),
            F.min("low").over(inner).alias(f"lo_{h}"),
            F.max("close").over(inner).alias(f"maxc_{h}"),
            F.min("close").over(inner).alias(f"minc_{h}"),
            F.sum(F.col("ret") * F.col("ret")).over(inner).alias(f"r2_{h}"),
        ]
    framed = axis.select("*", *cols).filter("is_obs")

    out: list[Column] = [F.col("obs_id"), *[F.col(c) for c in part], F.col("ts"), spot]
    implied = F.col(implied_move) if implied_move else None
    for h in [*horizons, "close"]:
        e = F.col(f"end_{h}")
        if h == "close":
            ok = F.col("t") < F.col("close_ts")
            hi, lo = F.col("hi_close"), F.col("lo_close")
            maxc, minc, r2 = F.col("maxc_close"), F.col("minc_close"), F.col("r2_close")
        else:
            s = horizons[h] * MINUTE
            ok = (F.col("t") + s <= F.col("close_ts")) & e.isNotNull()
            hi, lo = F.greatest(f"hi_{h}", e["high"]), F.least(f"lo_{h}", e["low"])
            maxc, minc = F.greatest(f"maxc_{h}", e["close"]), F.least(f"minc_{h}", e["close"])
            r2 = F.coalesce(f"r2_{h}", F.lit(0.0)) + F.coalesce(e["ret"] * e["ret"], F.lit(0.0))
        first = F.col("start")
        var = (
            r2
            - F.coalesce(first["ret"] * first["ret"], F.lit(0.0))
            + F.pow(F.ln(first["close"] / spot), F.lit(2.0))
        )
        fwd = F.when(ok, F.ln(e["close"] / spot))
        up, dn = F.when(ok, F.ln(hi / spot)), F.when(ok, F.ln(lo / spot))
        out += [
            fwd.alias(f"fwd_return_{h}"),
            F.when(fwd.isNotNull(), (fwd > 0).cast("int")).alias(f"up_{h}"),
            direction_label(fwd, implied).alias(f"direction_{h}"),
            up.alias(f"up_mfe_{h}"),
            dn.alias(f"up_mae_{h}"),
            (-dn).alias(f"down_mfe_{h}"),
            (-up).alias(f"down_mae_{h}"),
            F.when(ok, var).alias(f"realized_variance_{h}"),
            F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0)))).alias(f"realized_volatility_{h}"),
            F.abs(fwd).alias(f"abs_return_{h}"),
            F.when(ok, F.ln(hi / lo)).alias(f"high_low_range_{h}"),
            F.greatest(F.abs(up), F.abs(dn)).alias(f"max_intrahorizon_move_{h}"),
        ]
        if "call_wall" in have:
            out.append(F.when(ok, (hi >= F.col("call_wall")).cast("int")).alias(f"touch_call_wall_{h}"))
        if "put_wall" in have:
            out.append(F.when(ok, (lo <= F.col("put_wall")).cast("int")).alias(f"touch_put_wall_{h}"))
        if {"call_wall", "put_wall"} <= set(have):
            inside = (hi < F.col("call_wall")) & (lo > F.col("put_wall"))
            out.append(F.when(ok, inside.cast("int")).alias(f"range_survive_{h}"))
        if "gamma_flip" in have:
            flip = F.col("gamma_flip")
            touched = F.coalesce(F.col("_touch") <= e["bar_ts"], F.lit(False))
            crossed = (
                F.when(spot > flip, minc < flip).when(spot < flip, maxc > flip).otherwise((minc != flip) | (maxc != flip))
            )
            known = ok & flip.isNotNull()
            out.append(F.when(known, touched.cast("int")).alias(f"touch_gamma_flip_{h}"))
            out.append(F.when(known, crossed.cast("int")).alias(f"cross_gamma_flip_{h}"))
    out.append(
        F.greatest(F.abs(F.col("hi_close") / spot - 1.0), F.abs(F.col("lo_close") / spot - 1.0)).alias(
            "remaining_realized_move"
        )
    )
    return framed.select(*out)


def first_passage(
    obs: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",), direction: str = "up"
) -> DataFrame:
    """Which of `target` and `stop` is hit first after the observation; both in one bar is ambiguous (stop)."""
    if direction not in ("up", "down"):
        raise ValueError(f"direction must be 'up' or 'down', got {direction!r}")
    part = [*keys, "session_date"]
    up, down = ("up", "down") if direction == "up" else ("down", "up")
    rows = obs.select("obs_id", *part, "ts", "target", "stop")
    timed = with_passages(rows, bars, keys, {"t_target": ("target", up), "t_stop": ("stop", down)}).withColumn("t", F.unix_micros("ts"))
    t, s = F.col("t_target"), F.col("t_stop")
    event = (
        F.when(t == s, "ambiguous")
        .when(t.isNotNull() & (s.isNull() | (t < s)), "target")
        .when(s.isNotNull(), "stop")
        .otherwise("neither")
    )
    return timed.select(
        "obs_id",
        *part,
        event.alias("first_event"),
        F.when(event == "ambiguous", "stop").otherwise(event).alias("first_event_conservative"),
        (event == "ambiguous").cast("int").alias("ambiguous_same_bar"),
        ((F.least(t, s) - F.col("t")) / float(MINUTE)).alias("time_to_first_event"),
    )


def wall_first_passage(obs: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Which wall is reached first and the minutes to call wall, put wall and gamma flip."""
    part = [*keys, "session_date"]
    rows = obs.select("obs_id", *part, "ts", "call_wall", "put_wall", "gamma_flip")
    timed = with_passages(rows, bars, keys, {"tc": ("call_wall", "up"), "tp": ("put_wall", "down"), "tf": ("gamma_flip", "touch")})
    timed = timed.withColumn("t", F.unix_micros("ts"))
    c, p = F.col("tc"), F.col("tp")
    both = F.col("call_wall").isNotNull() & F.col("put_wall").isNotNull()
    ambiguous = F.coalesce(c == p, F.lit(False))
    call_first = c.isNotNull() & (p.isNull() | (c < p))
    put_first = p.isNotNull() & (c.isNull() | (p < c))
    flag = lambda cond: F.when(both & ~ambiguous, F.coalesce(cond, F.lit(False)).cast("int"))
    minutes = lambda x: (x - F.col("t")) / float(MINUTE)
    return timed.select(
        "obs_id",
        *part,
        flag(call_first).alias("call_wall_first"),
        flag(put_first).alias("put_wall_first"),
        F.when(both, F.when(ambiguous, 0).otherwise((c.isNull() & p.isNull()).cast("int"))).alias("neither_wall"),
        F.when(both, ambiguous.cast("int")).alias("wall_first_ambiguous"),
        minutes(c).alias("time_to_call_wall"),
        minutes(p).alias("time_to_put_wall"),
        minutes(F.col("tf")).alias("time_to_flip"),
    )


def observation_id(symbol: Column, et_ts: Column, version: Column, seq: Column) -> Column:
    """Stable id: sha256 of symbol | exchange time to the second | feature version | source sequence."""
    return F.sha2(F.concat_ws("|", symbol, F.date_format(et_ts, "yyyy-MM-dd'T'HH:mm:ss"), version, seq.cast("string")), 256)


def fill_horizon_label(filled: Column, seconds: Column, horizon: Column) -> Column:
    """1 when filled within the horizon; a fill of unknown time counts as within."""
    return F.when(~filled, 0).when(seconds.isNull(), 1).otherwise((seconds <= horizon).cast("int"))


# fixed values: structure families per regime
DEBIT_FAMILIES = ("call_debit_spread", "put_debit_spread", "long_call", "long_put")
PREMIUM_FAMILIES = (
    "bull_put_credit_spread", "bear_call_credit_spread", "iron_condor", "iron_butterfly",
)
FLIP_BAND_BN = 0.05


def structural_regime(levels: DataFrame) -> DataFrame:
    """Gamma regime of a snapshot with direction, permitted / prohibited families, confidence and size cap.

    Needs spot, net_gex_bn, net_ratio, gex_concentration, gamma_flip and an array `vetoes`.
    """
    net, spot, flip = F.col("net_gex_bn"), F.col("spot"), F.col("gamma_flip")
    transition = F.abs(net) < FLIP_BAND_BN
    label = F.when(transition, "flip_transition").when(net > 0, "long_gamma_pin").otherwise("short_gamma_trend")
    trend = F.when(spot > flip, "call_biased").when(spot < flip, "put_biased").otherwise("neutral")
    arr = lambda names: F.array(*[F.lit(n) for n in names])
    short = label == "short_gamma_trend"
    confidence = F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.abs("net_ratio") + 0.5 * F.col("gex_concentration"))
    )
    vetoes = F.when(short, F.concat("vetoes", F.array(F.lit("SHORT_GAMMA_REGIME")))).otherwise(F.col("vetoes"))
    return levels.select(
        "snapshot_id",
        label.alias("regime"),
        F.when(short, trend).otherwise("neutral").alias("direction"),
        F.when(label == "long_gamma_pin", arr(PREMIUM_FAMILIES)).otherwise(arr(DEBIT_FAMILIES)).alias("permitted"),
        F.when(short, arr(PREMIUM_FAMILIES)).otherwise(F.array().cast("array<string>")).alias("prohibited"),
        confidence.alias("confidence"),
        vetoes.alias("vetoes"),
        F.when(F.size(vetoes) > 0, 0.0).otherwise(confidence).alias("size_cap"),
    )


__all__ = [
    "HORIZONS", "direction_label", "fill_horizon_label", "first_passage", "label_observations", "observation_id",
    "ratio", "realized_direction", "structural_regime", "wall_first_passage",
]
