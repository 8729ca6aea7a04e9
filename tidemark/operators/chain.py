"""Option-chain analytics: gamma exposure, flow, straddle, parity spot, risk-neutral density.

A chain row is (snapshot_id, pos, side, strike, spot, gamma, delta, open_interest, volume, bid, ask, mark, last).
Every aggregate first folds to (snapshot, strike) with partial aggregation, so what later groups by snapshot alone
is bounded by the number of listed strikes however many rows a snapshot has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import bind, finite, ratio
from tidemark.operators.indicators import FIELDS  # noqa: F401  (re-export for feature bundles)

MULTIPLIER = 100.0


def quote_mid(bid: str = "bid", ask: str = "ask", mark: str = "mark", last: str = "last") -> Column:
    """Two-sided mid when ask >= bid >= 0, else mark, else last."""
    b, a = F.col(bid), F.col(ask)
    return F.coalesce(F.when((a >= b) & (b >= 0), (b + a) / 2), F.col(mark), F.col(last))


def quote_mid_mark_first(bid: str = "bid", ask: str = "ask", mark: str = "mark") -> Column:
    """Mark when present, else the plain mid (the pricing convention)."""
    return F.coalesce(F.col(mark), (F.col(bid) + F.col(ask)) / 2)


def quote_quality(bid: str = "bid", ask: str = "ask") -> Column:
    """1/(1+spread); 0 for a one-sided or crossed quote."""
    spread = F.col(ask) - F.col(bid)
    return F.when(spread >= 0, 1.0 / (1.0 + spread)).otherwise(0.0)


def chain_coverage(chain: DataFrame) -> DataFrame:
    """Contracts, distinct strikes, strike range, sides present. Two-level, no distinct aggregate."""
    per_strike = chain.groupBy("snapshot_id", "strike").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("side") == "call").alias("c"),
        F.bool_or(F.col("side") == "put").alias("p"),
    )
    return per_strike.groupBy("snapshot_id").agg(
        F.sum("n").alias("contracts_total"),
        F.count(F.lit(1)).alias("strikes_total"),
        F.min("strike").alias("min_strike"),
        F.max("strike").alias("max_strike"),
        F.bool_or("c").alias("has_calls"),
        F.bool_or("p").alias("has_puts"),
    )


def gex_by_strike(chain: DataFrame) -> DataFrame:
    """Signed dollar gamma per strike (calls +, puts −) with each side's absolute gamma and first position."""
    gamma, oi = finite("gamma"), F.col("open_interest")
    usable = chain.filter(gamma.isNotNull() & (oi > 0))
    dollar = gamma * oi * MULTIPLIER * F.col("spot") * F.col("spot") * 0.01
    call, put = F.col("side") == "call", F.col("side") == "put"
    return usable.groupBy("snapshot_id", "strike").agg(
        F.sum(F.when(call, dollar).otherwise(-dollar)).alias("gex"),
        F.sum(F.when(call, F.abs(dollar))).alias("call_gamma"),
        F.sum(F.when(put, F.abs(dollar))).alias("put_gamma"),
        F.min(F.when(call, F.col("pos"))).alias("call_pos"),
        F.min(F.when(put, F.col("pos"))).alias("put_pos"),
        F.count(F.lit(1)).alias("n_contracts"),
        F.max("spot").alias("spot"),
    )


def gex_levels(chain: DataFrame) -> DataFrame:
    """Net / gross gamma, ratio, concentration, walls and flip per snapshot."""
    k, spot = F.col("strike"), F.col("spot")
    w = Window.partitionBy("snapshot_id").orderBy("strike")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cum = gex_by_strike(chain).withColumn("cum", F.sum("gex").over(run))
    steps = cum.select("*", F.lag("cum").over(w).alias("prev_cum"), F.lag("strike").over(w).alias("prev_k"))
    pc, cu = F.col("prev_cum"), F.col("cum")
    crossed = ((pc < 0) & (cu >= 0)) | ((pc > 0) & (cu <= 0))
    flip = F.col("prev_k") + (k - F.col("prev_k")) * (-pc) / F.nullif(cu - pc, F.lit(0.0))
    call_key = F.when(F.col("call_pos").isNotNull(), F.struct(k >= spot, "call_gamma", -F.col("call_pos")))
    put_key = F.when(F.col("put_pos").isNotNull(), F.struct(k <= spot, "put_gamma", -F.col("put_pos")))
    agg = steps.groupBy("snapshot_id").agg(
        F.max("spot").alias("spot"),
        (F.sum("gex") / 1e9).alias("net_gex_bn"),
        (F.sum(F.abs("gex")) / 1e9).alias("gross"),
        (F.max(F.abs("gex")) / 1e9).alias("top"),
        F.min_by(F.when(crossed, flip), F.when(crossed, k)).alias("flip"),
        F.max_by(F.when(call_key.isNotNull(), k), call_key).alias("cw"),
        F.max_by(F.when(call_key.isNotNull(), F.col("call_gamma")), call_key).alias("cwg"),
        F.max_by(F.when(put_key.isNotNull(), k), put_key).alias("pw"),
        F.max_by(F.when(put_key.isNotNull(), F.col("put_gamma")), put_key).alias("pwg"),
        F.sum("call_gamma").alias("cg"),
        F.sum("put_gamma").alias("pg"),
        F.sum("n_contracts").alias("n_contracts"),
        F.count(F.lit(1)).alias("n_strikes"),
    )
    share = lambda g, total: F.coalesce(g / F.when(total == 0, 1.0).otherwise(total), F.lit(0.0))
    return agg.select(
        "snapshot_id",
        "spot",
        "net_gex_bn",
        F.coalesce(ratio("net_gex_bn", "gross"), F.lit(0.0)).alias("net_ratio"),
        F.round(F.coalesce("flip", "spot"), 4).alias("gamma_flip"),
        F.round(F.coalesce("cw", "spot"), 4).alias("call_wall"),
        F.round(F.coalesce("pw", "spot"), 4).alias("put_wall"),
        F.coalesce(ratio("top", "gross"), F.lit(0.0)).alias("gex_concentration"),
        F.greatest(share(F.col("cwg"), F.col("cg")), share(F.col("pwg"), F.col("pg"))).alias("wall_concentration"),
        "n_contracts",
        "n_strikes",
    )


def flow(chain: DataFrame) -> DataFrame:
    """Call/put volume, open interest, put/call ratio and participation; ratios NULL when undefined."""
    vol = F.when(F.col("volume") >= 0, F.col("volume"))
    agg = chain.groupBy("snapshot_id").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "call", vol)), F.lit(0)).alias("call_volume"),
        F.coalesce(F.sum(F.when(F.col("side") == "put", vol)), F.lit(0)).alias("put_volume"),
        F.coalesce(F.sum(F.when(F.col("open_interest") > 0, F.col("open_interest"))), F.lit(0)).alias(
            "total_open_interest"
        ),
    )
    total = F.col("call_volume") + F.col("put_volume")
    return agg.select(
        "*",
        ratio("put_volume", "call_volume").alias("pcr_volume"),
        F.when(total > 0, ratio(total, "total_open_interest")).alias("volume_oi_ratio"),
    )


def atm_straddle(chain: DataFrame, open_prices: DataFrame | None = None) -> DataFrame:
    """Nearest-strike straddle (lower strike on a tie) as the expected move; consumed share vs the session open.

    `open_prices` (snapshot_id, open_price) is one row per snapshot.
    """
    mid = quote_mid()
    call, put = F.col("side") == "call", F.col("side") == "put"
    seen = mid.isNotNull()
    per_strike = chain.groupBy("snapshot_id", "strike").agg(
        F.max("spot").alias("spot"),
        F.min_by(F.when(call & seen, mid), F.when(call & seen, F.col("pos"))).alias("call_mid"),
        F.min_by(F.when(put & seen, mid), F.when(put & seen, F.col("pos"))).alias("put_mid"),
    )
    atm = per_strike.groupBy("snapshot_id").agg(
        F.min_by(
            F.struct("strike", "spot", "call_mid", "put_mid"), F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")
        ).alias("a")
    )
    straddle = F.col("a.call_mid") + F.col("a.put_mid")
    out = atm.filter(straddle.isNotNull()).select(
        "snapshot_id",
        F.col("a.strike").alias("atm_strike"),
        F.col("a.spot").alias("spot"),
        straddle.alias("atm_straddle"),
        straddle.alias("expected_move"),
        F.coalesce(ratio(straddle, "a.spot"), F.lit(0.0)).alias("expected_move_pct"),
    )
    if open_prices is None:
        return out.withColumn("expected_move_consumed", F.lit(None).cast("double"))
    return out.join(open_prices.select("snapshot_id", "open_price"), "snapshot_id", "left").withColumn(
        "expected_move_consumed",
        F.when(F.col("atm_straddle") > 0, ratio(F.abs(F.col("spot") - F.col("open_price")), "atm_straddle")),
    ).drop("open_price")


def spot_from_parity(chain: DataFrame, window: int = 5) -> DataFrame:
    """Spot implied by put-call parity near the money; NULL when it cannot be recovered.

    Tightest quote per (strike, side); at-the-money = smallest |C−P|; upper median of C−P+K over the 5 nearest
    strikes; else the strike of the call whose delta is nearest .5.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    tight = F.struct(F.when(mid > 0, ratio(F.col("ask") - F.col("bid"), mid)).otherwise(float("inf")), F.col("pos"))
    call, put = F.col("side") == "call", F.col("side") == "put"
    usable_delta = call & (F.col("delta") > 0)
    per_strike = chain.groupBy("snapshot_id", "strike").agg(
        F.min_by(F.when(call, mid), F.when(call, tight)).alias("c"),
        F.min_by(F.when(put, mid), F.when(put, tight)).alias("p"),
        F.min(F.when(usable_delta, F.struct(F.abs(F.col("delta") - 0.5).alias("gap"), "pos", "strike"))).alias("d"),
    )
    diff = F.col("c") - F.col("p")
    agg = per_strike.groupBy("snapshot_id").agg(
        F.sort_array(
            F.collect_list(
                F.when(diff.isNotNull(), F.struct(F.abs(diff).alias("gap"), F.col("strike").alias("k"), (diff + F.col("strike")).alias("e")))
            )
        ).alias("paired"),
        F.min("d").alias("d"),
    )
    atm = F.try_element_at("paired", F.lit(1))["k"]
    nearest = F.slice(
        F.sort_array(
            F.transform("paired", lambda s: F.struct(F.abs(s["k"] - atm).alias("gap"), s["k"].alias("k"), s["e"].alias("e")))
        ),
        1,
        window,
    )
    median = bind(
        F.sort_array(F.transform(nearest, lambda s: s["e"])),
        lambda e: F.try_element_at(e, (F.floor(F.size(e) / 2) + 1).cast("int")),
    )
    by_delta = F.when(F.col("d.strike") > 0, F.col("d.strike"))
    return agg.withColumn("_m", median).select(
        "snapshot_id",
        F.size("paired").alias("n_paired"),
        F.round(F.when(F.size("paired") > 0, F.when(F.col("_m") > 0, F.col("_m"))).otherwise(by_delta), 2).alias(
            "implied_spot"
        ),
    )


def rnd_summary(chain: DataFrame, grid_points: int = 201, min_strikes: int = 5) -> DataFrame:
    """Risk-neutral density from call mids: interpolate on an even grid, differentiate twice, clip, normalise.

    Each strike segment emits only its own grid points, so the cost is the grid size per snapshot; the derivatives
    are lag/lead over the grid.
    """
    last = grid_points - 1
    mid = quote_mid()
    calls = (
        chain.filter((F.col("side") == "call") & mid.isNotNull())
        .groupBy("snapshot_id", "strike")
        .agg(F.max_by(mid, F.col("pos")).alias("c"), F.max("spot").alias("spot"))
    )
    w = Window.partitionBy("snapshot_id").orderBy("strike")
    every = Window.partitionBy("snapshot_id")
    segs = calls.select(
        "snapshot_id", "spot", "strike", "c",
        F.lead("strike").over(w).alias("k2"),
        F.lead("c").over(w).alias("c2"),
        F.min("strike").over(every).alias("k0"),
        F.max("strike").over(every).alias("kn"),
        F.count(F.lit(1)).over(every).alias("n_strikes"),
    ).filter(F.col("k2").isNotNull() & (F.col("n_strikes") >= min_strikes))
    h = (F.col("kn") - F.col("k0")) / float(last)
    lo = F.greatest(F.floor((F.col("strike") - F.col("k0")) / h) - 1, F.lit(0)).cast("int")
    hi = F.least(F.ceil((F.col("k2") - F.col("k0")) / h) + 1, F.lit(last)).cast("int")
    x = F.when(F.col("j") == last, F.col("kn")).otherwise(F.col("k0") + F.col("j") * F.col("h"))
    grid = (
        segs.select("*", h.alias("h"), F.explode(F.sequence(lo, hi)).alias("j"))
        .withColumn("x", x)
        .filter(
            (F.col("x") >= F.col("strike"))
            & ((F.col("x") < F.col("k2")) | ((F.col("k2") == F.col("kn")) & (F.col("j") == last)))
        )
        .select(
            "snapshot_id", "spot", "n_strikes", "h", "j", "x",
            (F.col("c") + (F.col("c2") - F.col("c")) * (F.col("x") - F.col("strike")) / (F.col("k2") - F.col("strike"))).alias("f"),
        )
    )
    g = Window.partitionBy("snapshot_id").orderBy("j")

    def gradient(name: str) -> Column:
        nxt, prv = F.lead(name).over(g), F.lag(name).over(g)
        return (
            F.when(F.col("j") == 0, (nxt - F.col(name)) / F.col("h"))
            .when(F.col("j") == last, (F.col(name) - prv) / F.col("h"))
            .otherwise((nxt - prv) / (2.0 * F.col("h")))
        )

    dens = grid.withColumn("g1", gradient("f")).withColumn("d", F.greatest(gradient("g1"), F.lit(0.0)))
    edge = F.when((F.col("j") == 0) | (F.col("j") == last), 0.5).otherwise(1.0)
    below = F.max(F.when(F.col("x") < F.col("spot"), F.col("j"))).over(every)
    weighted = dens.select(
        "*",
        (F.col("d") * F.col("h") * edge).alias("m"),
        F.when(
            F.col("j") <= below,
            F.when(below == 0, 0.0).otherwise(
                F.col("d") * F.col("h") * F.when((F.col("j") == 0) | (F.col("j") == below), 0.5).otherwise(1.0)
            ),
        ).alias("mb"),
    )
    centred = weighted.select(
        "*",
        F.sum("m").over(every).alias("area"),
        F.sum(F.col("x") * F.col("m")).over(every).alias("xm"),
    ).filter(F.col("area") > 0)
    dev = F.col("x") - F.col("xm") / F.col("area")
    agg = centred.groupBy("snapshot_id").agg(
        F.max("n_strikes").alias("n_strikes"),
        F.max(F.col("xm") / F.col("area")).alias("mean"),
        F.sum(dev * dev * F.col("m") / F.col("area")).alias("var"),
        F.sum(dev * dev * dev * F.col("m") / F.col("area")).alias("m3"),
        (F.coalesce(F.sum("mb"), F.lit(0.0)) / F.max("area")).alias("pb"),
    )
    sd = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
    return agg.select(
        "snapshot_id",
        F.col("mean").alias("forward"),
        "mean",
        sd.alias("std"),
        F.coalesce(ratio("m3", sd * sd * sd), F.lit(0.0)).alias("skew"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pb"))).alias("prob_below_spot"),
        "n_strikes",
    )


# fixed values: breadth baskets and index symbols
SECTORS = ("XLK", "XLF", "XLV", "XLY", "XLP", "XLE", "XLI", "XLB", "XLRE", "XLU", "XLC")
VOL_INDICES = ("VIX", "VIX9D", "VIX3M", "VVIX")


def day_change(pct: Column, last: Column, prev: Column) -> Column:
    """Vendor percentage when given, else last/prevclose − 1."""
    return F.coalesce(pct / 100.0, ratio(last, prev) - 1.0)


def breadth(moves: DataFrame, weights: dict[str, float], key: str = "snapshot_id") -> DataFrame:
    """Equal-weight divergence, share of sectors up, weight-normalised pressure; each independently NULL.

    `moves` holds (key, symbol, move, seq); the newest row per symbol counts.
    """
    latest = moves.groupBy(key, "symbol").agg(F.max_by("move", "seq").alias("move"))
    weight = F.lit(None).cast("double")
    for symbol, value in weights.items():
        weight = F.when(F.col("symbol") == symbol, F.lit(value)).otherwise(weight)
    known = F.col("move").isNotNull()
    sector = F.col("symbol").isin(*SECTORS) & known
    # few symbols have a weight; adding them in order of size gives the same last digit however the rows are dealt
    added = lambda x: F.aggregate(F.sort_array(F.collect_list(F.when(known, x))), F.lit(0.0), lambda a, v: a + v)
    agg = latest.withColumn("w", weight).groupBy(key).agg(
        F.max(F.when(F.col("symbol") == "SPY", F.col("move"))).alias("spy"),
        F.max(F.when(F.col("symbol") == "RSP", F.col("move"))).alias("rsp"),
        F.count_if(sector).alias("sectors_observed"),
        F.count_if(sector & (F.col("move") > 0)).alias("up"),
        added(F.col("w") * F.col("move")).alias("num"),
        added(F.col("w")).alias("den"),
    )
    return agg.select(
        key,
        (F.col("rsp") - F.col("spy")).alias("rsp_spy_div"),
        ratio("up", "sectors_observed").alias("sector_align"),
        F.when(F.col("den") > 0, ratio("num", "den")).alias("top10_pressure"),
        "sectors_observed",
    )


def vix_term_structure(index_quotes: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Volatility indices side by side, no backfill; NULL row dropped when VIX itself is unknown."""
    good = index_quotes.filter(finite("last") > 0)
    out = good.groupBy(key).agg(
        *[
            F.max_by(F.when(F.col("symbol") == s, F.col("last")), F.when(F.col("symbol") == s, F.col("seq"))).alias(
                s.lower()
            )
            for s in VOL_INDICES
        ],
        F.max("vvix_baseline").alias("vvix_baseline"),
    ).filter(F.col("vix").isNotNull())
    return out.select(
        key,
        *[s.lower() for s in VOL_INDICES],
        (ratio("vix3m", "vix") - 1.0).alias("contango"),
        (ratio("vix9d", "vix") - 1.0).alias("near_term_stress"),
        (ratio("vvix", "vvix_baseline") - 1.0).alias("vvix_elevation"),
    )


def live_quote_fraction(chain: DataFrame) -> DataFrame:
    """Share of quotes flagged live_quote."""
    return chain.groupBy("snapshot_id").agg(
        F.avg(F.array_contains("quality_flags", "live_quote").cast("int")).alias("live_fraction")
    )


def structural_state(gex: DataFrame, vol: DataFrame, rnd: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Outer join of the structural families on snapshot_id with the list of families that are missing."""
    g = gex.select("snapshot_id", F.struct(*[c for c in gex.columns if c != "snapshot_id"]).alias("gex_oi"))
    v = vol.select("snapshot_id", F.struct(*[c for c in vol.columns if c != "snapshot_id"]).alias("volatility"))
    r = rnd.select("snapshot_id", F.struct(*[c for c in rnd.columns if c != "snapshot_id"]).alias("rnd"))
    joined = (
        snapshots.select("snapshot_id").join(g, "snapshot_id", "left").join(v, "snapshot_id", "left").join(r, "snapshot_id", "left")
    )
    from tidemark.functions.exprs import codes

    return joined.withColumn(
        "missing_fields",
        codes(*[(F.col(n).isNull(), n) for n in ("gex_oi", "volatility", "rnd")]),
    ).withColumn("structural_state_id", F.concat(F.lit("struct-"), F.substring(F.sha2("snapshot_id", 256), 1, 12)))


def feature_rows(family: str, df: DataFrame, columns: list[str], ids: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """Long (ids, name, value) rows `<family>.<column>` of the known values; NaN and infinities stay, as signs of a defect."""
    return (
        df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(list(ids), columns, "_c", "value")
        .filter(F.col("value").isNotNull())
        .select(*ids, F.concat(F.lit(f"{family}."), F.col("_c")).alias("name"), "value")
    )


def packed_features(family: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """`feature_rows` of a family with one row a snapshot, as one array: (snapshot_id, kv) with structs (name, value)."""
    every = F.array(*[F.struct(F.lit(f"{family}.{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select("snapshot_id", F.filter(every, lambda x: x["value"].isNotNull()).alias("kv"))


def gex_features(levels: DataFrame) -> DataFrame:
    """GEX levels with sign and spot-relative distances, named as features."""
    c, s = F.col, F.col("spot")
    return levels.select(
        "snapshot_id",
        c("net_gex_bn").alias("net_bn"), "net_ratio", F.signum("net_gex_bn").alias("gamma_sign"),
        c("gex_concentration").alias("concentration"), "wall_concentration", "n_contracts", "n_strikes",
        "gamma_flip", "call_wall", "put_wall",
        ratio(s - c("gamma_flip"), s).alias("flip_cushion"),
        ratio(c("call_wall") - s, s).alias("call_wall_distance"),
        ratio(s - c("put_wall"), s).alias("put_wall_distance"),
        ratio(c("call_wall") - c("put_wall"), s).alias("channel_width"),
    )


def feature_bundle(families: dict[str, DataFrame], snapshots: DataFrame, version: str = "1") -> DataFrame:
    """One row per snapshot: sorted feature map, missing and failed families, content id.

    `families` maps a family name to long (snapshot_id, name, value) rows, or to rows (snapshot_id, kv) that hold a snapshot's
    (name, value) structs as one array. A family without rows for a snapshot is missing
    there; one with a value that isn't a finite number has failed there, and none of its values is published. Families are
    listed in the order given.
    """
    broken = F.exists("kv", lambda x: F.isnan(x["value"]) | (F.abs(x["value"]) == float("inf")))
    joined, of = snapshots.select("snapshot_id"), {}
    for name, df in families.items():
        # a family has a bounded number of names, so its rows of a snapshot are one small array; it is built where they are
        if "kv" not in df.columns:
            df = df.filter(F.col("value").isNotNull()).groupBy("snapshot_id").agg(F.collect_list(F.struct("name", "value")).alias("kv"))
        part = df.filter(F.size("kv") > 0).select("snapshot_id", F.struct("kv", broken.alias("broken")).alias(f"_in_{name}"))
        of[name] = F.col(f"_in_{name}")
        joined = joined.join(part, "snapshot_id", "left")
    nothing = F.array().cast("array<struct<name:string,value:double>>")
    published = F.array(*[F.when(~f["broken"], f["kv"]).otherwise(nothing) for f in of.values()])
    names = lambda cond: F.array_compact(F.array(*[F.when(cond(f), F.lit(n)) for n, f in of.items()]))
    agg = joined.select(
        "snapshot_id", F.sort_array(F.flatten(published)).alias("kv"),
        names(lambda f: f.isNull()).alias("missing_families"), names(lambda f: f["broken"]).alias("failed_families"),
    )
    kv = F.col("kv")
    return agg.select(
        "snapshot_id",
        F.map_from_entries(kv).alias("features"),
        F.size(kv).alias("n_features"),
        "missing_families",
        "failed_families",
        F.concat(
            F.lit("feat-"), F.substring(F.sha2(F.to_json(F.struct("snapshot_id", F.lit(version).alias("v"), kv.alias("f"))), 256), 1, 12)
        ).alias("bundle_id"),
    )


# fixed values: approximate weights of the ten largest index members
TOP10_WEIGHTS = {
    "NVDA": 7.5, "MSFT": 6.8, "AAPL": 6.1, "AMZN": 4.0, "META": 2.9,
    "AVGO": 2.5, "GOOGL": 2.2, "GOOG": 1.8, "TSLA": 1.7, "BRK.B": 1.6,
}
