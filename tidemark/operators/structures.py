"""Multi-leg structures: enumeration, payoff proofs, identity, dominance.

Enumeration needs one shuffle: a snapshot's quotes fold into two strike maps (bounded by the listing), and every
family is an array expression over them, exploded once. Legs are looked up in the maps, so there is no self-join and
no pair of strikes is materialised outside its allowed band.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tables import materialized
from tidemark.operators.quality import FAMILIES

DEC = "decimal(18,6)"
VERSION = "1"
DIRECTION = {name: direction for name, direction, _bias, _aliases in FAMILIES}


@dataclass(frozen=True)
class StructureConfig:
    # fixed values: default widths and moneyness bands
    widths: tuple[str, ...] = ("1", "2", "3", "5")
    short_otm: tuple[str, str] = ("0.0015", "0.030")
    long_otm: tuple[str, str] = ("-0.005", "0.015")
    condor_max_skew: str = "0.010"
    strangle_max_gap: str = "0.5"
    families: tuple[str, ...] | None = None


def dec(x: Column | str | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast(DEC)


def leg(side: str, strike: Column, quantity: int) -> Column:
    return F.struct(
        F.lit(side).alias("option_type"), strike.cast(DEC).alias("strike"), F.lit(quantity).alias("quantity")
    )


def _spec(family: str, *legs: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), F.array(*legs).alias("legs"))


def snapshot_maps(chain: DataFrame) -> DataFrame:
    """One row per single-expiration snapshot: call and put maps strike → quote, sorted strikes, spot. Of the quotes of one
    side and strike the one with the largest `pos` counts (any, without that column)."""
    mid = F.coalesce("mark", ((F.col("bid") + F.col("ask")) / 2).cast(DEC), "last").cast(DEC)
    spread = F.col("ask") - F.col("bid")
    quality = F.when(spread >= 0, F.lit(1.0) / (F.lit(1.0) + spread.cast("double"))).otherwise(0.0)
    quote = F.struct(
        mid.alias("mid"), quality.alias("quality"), F.col("bid"), F.col("ask"), F.col("mark"), F.col("iv"),
        F.col("age_seconds"), F.col("contract_id"),
    )
    arrival = F.col("pos") if "pos" in chain.columns else F.lit(0)
    entry = F.struct(F.col("strike").cast(DEC).alias("k"), arrival.alias("pos"), quote.alias("q"))
    side = lambda s: F.sort_array(F.collect_list(F.when((F.col("option_type") == s) & F.col("strike").isNotNull(), entry)))

    def last(entries: str) -> Column:
        """strike → quote; sorted entries of one strike end with the largest pos."""
        e = F.col(entries)
        kept = F.filter(e, lambda x, i: (i == F.size(e) - 1) | (F.get(e, i + 1)["k"] != x["k"]))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["q"])))

    return (
        chain.groupBy("snapshot_id")
        .agg(
            side("call").alias("calls"),
            side("put").alias("puts"),
            F.sort_array(F.collect_set(F.col("strike").cast(DEC))).alias("strikes"),
            F.max("spot").cast(DEC).alias("spot"),
            F.min("expiration").alias("expiration"),
            F.max("expiration").alias("_last"),
        )
        .filter((F.col("spot") > 0) & (F.col("expiration") == F.col("_last")))
        .drop("_last")
        .withColumns({"calls": last("calls"), "puts": last("puts")})
    )


def _families(cfg: StructureConfig) -> dict[str, Column]:
    """family → array of specs, as expressions over the columns of `snapshot_maps` and the four strike bands."""
    widths = F.array(*[dec(w) for w in cfg.widths])
    spot, atm = F.col("spot"), F.col("atm")
    sp, sc, lp, lc = F.col("short_puts"), F.col("short_calls"), F.col("long_puts"), F.col("long_calls")

    def each(band: Column, make) -> Column:
        return F.transform(band, make)

    def by_width(band: Column, make) -> Column:
        return F.flatten(F.transform(band, lambda k: F.transform(widths, lambda w: make(k, w))))

    def condors() -> Column:
        near = lambda kp, kc: F.abs((spot - kp) - (kc - spot)) <= spot * dec(cfg.condor_max_skew)
        return F.flatten(
            F.transform(
                sp,
                lambda kp: F.flatten(
                    F.transform(
                        F.filter(sc, lambda kc: near(kp, kc)),
                        lambda kc: F.transform(
                            widths,
                            lambda w: _spec(
                                "iron_condor",
                                leg("put", kp, -1), leg("put", kp - w, 1), leg("call", kc, -1), leg("call", kc + w, 1),
                            ),
                        ),
                    )
                ),
            )
        )

    def strangles() -> Column:
        dc = lambda kc: kc - spot
        ok = lambda kc, kp: F.abs(dc(kc) - (spot - kp)) < dc(kc) * dec(cfg.strangle_max_gap)
        return F.flatten(
            F.transform(
                F.filter(sc, lambda kc: kc > spot),
                lambda kc: F.transform(
                    F.filter(sp, lambda kp: (kp < spot) & ok(kc, kp)),
                    lambda kp: _spec("long_strangle", leg("call", kc, 1), leg("put", kp, 1)),
                ),
            )
        )

    def backspreads(side: str, family: str) -> Column:
        sells, buys = (lc, sc) if side == "call" else (lp, sp)
        further = (lambda b, s: b > s) if side == "call" else (lambda b, s: b < s)
        return F.flatten(
            F.transform(
                sells,
                lambda s: F.transform(
                    F.filter(buys, lambda b: further(b, s)),
                    lambda b: _spec(family, leg(side, s, -1), leg(side, b, 2)),
                ),
            )
        )

    pairs = [(n, f) for n in cfg.widths for f in cfg.widths if float(f) > float(n)]
    return {
        "bull_put_credit_spread": by_width(
            sp, lambda k, w: _spec("bull_put_credit_spread", leg("put", k, -1), leg("put", k - w, 1))
        ),
        "bear_call_credit_spread": by_width(
            sc, lambda k, w: _spec("bear_call_credit_spread", leg("call", k, -1), leg("call", k + w, 1))
        ),
        "call_debit_spread": by_width(
            lc, lambda k, w: _spec("call_debit_spread", leg("call", k, 1), leg("call", k + w, -1))
        ),
        "put_debit_spread": by_width(
            lp, lambda k, w: _spec("put_debit_spread", leg("put", k, 1), leg("put", k - w, -1))
        ),
        "long_call": each(lc, lambda k: _spec("long_call", leg("call", k, 1))),
        "long_put": each(lp, lambda k: _spec("long_put", leg("put", k, 1))),
        "iron_condor": condors(),
        "iron_butterfly": F.transform(
            widths,
            lambda w: _spec(
                "iron_butterfly", leg("put", atm, -1), leg("put", atm - w, 1), leg("call", atm, -1), leg("call", atm + w, 1)
            ),
        ),
        "bounded_broken_wing_butterfly": F.array(
            *[
                _spec(
                    "bounded_broken_wing_butterfly",
                    leg("put", atm + dec(near), 1), leg("put", atm, -2), leg("put", atm - dec(far), 1),
                )
                for near, far in pairs
            ]
        ),
        "long_straddle": F.array(_spec("long_straddle", leg("call", atm, 1), leg("put", atm, 1))),
        "long_strangle": strangles(),
        "bounded_backspread_call": backspreads("call", "bounded_backspread_call"),
        "bounded_backspread_put": backspreads("put", "bounded_backspread_put"),
    }


def enumerate_structures(chain: DataFrame, cfg: StructureConfig | None = None) -> DataFrame:
    """(snapshot_id, family, expiration, spot, legs with their quotes) for every approved geometry on the chain."""
    cfg = cfg or StructureConfig()
    maps = snapshot_maps(chain)
    spot = F.col("spot")

    def band(sign: int, lo: str, hi: str) -> Column:
        gap = (lambda k: k - spot) if sign > 0 else (lambda k: spot - k)
        return F.filter("strikes", lambda k: (gap(k) >= spot * dec(lo)) & (gap(k) <= spot * dec(hi)))

    ranked = F.sort_array(F.transform("strikes", lambda k: F.struct(F.abs(k - spot).alias("d"), k.alias("k"))))
    banded = maps.select(
        "*",
        band(-1, *cfg.short_otm).alias("short_puts"),
        band(+1, *cfg.short_otm).alias("short_calls"),
        band(-1, *cfg.long_otm).alias("long_puts"),
        band(+1, *cfg.long_otm).alias("long_calls"),
        ranked[0]["k"].alias("atm"),
    )
    specs = _families(cfg)
    wanted = [n for n in specs if cfg.families is None or n in cfg.families]

    def quoted(x: Column) -> Column:
        q = F.when(x["option_type"] == "call", F.try_element_at("calls", x["strike"])).otherwise(
            F.try_element_at("puts", x["strike"])
        )
        return F.struct(*[x[n].alias(n) for n in ("option_type", "strike", "quantity")], q.alias("q"))

    every = F.transform(
        F.concat(*[specs[n] for n in wanted]),
        lambda s: F.struct(s["family"].alias("family"), F.sort_array(F.transform(s["legs"], quoted)).alias("legs")),
    )
    # the quote check sits inside the generator: a filter above it would be pushed down and repeat the lookups
    complete = F.filter(every, lambda s: F.forall(s["legs"], lambda x: x["q"].isNotNull()))
    return banded.select("snapshot_id", "expiration", "spot", F.inline(complete))


def _dsum(values: Column) -> Column:
    return F.aggregate(values, dec(0), lambda a, x: (a + x).cast(DEC))


def entry_credit(legs: str | Column = "legs") -> Column:
    """Cash collected at mids (short adds, long subtracts); NULL when a mid is missing or negative."""
    ok = F.forall(legs, lambda x: F.coalesce(x["q"]["mid"] >= 0, F.lit(False)))
    return F.when(ok, _dsum(F.transform(legs, lambda x: (-x["quantity"] * x["q"]["mid"]).cast(DEC))))


def intrinsic(option_type: Column, strike: Column, spot: Column) -> Column:
    """Worth at settlement; NULL where the price is (greatest alone would skip the NULL and say 0)."""
    gap = F.when(option_type == "call", spot - strike).otherwise(strike - spot)
    return F.when(gap.isNotNull(), F.greatest(gap, dec(0)).cast(DEC))


def terminal_payoff(legs: Column, credit: Column, spot: Column) -> Column:
    """P&L per share at settlement: entry credit plus signed intrinsic value."""
    return (
        credit
        + _dsum(F.transform(legs, lambda x: (x["quantity"] * intrinsic(x["option_type"], x["strike"], spot)).cast(DEC)))
    ).cast(DEC)


def evaluation_spots(legs: Column) -> Column:
    """0, the strikes, the midpoints between them, and a far point above (ten spans, a span being at least 1)."""
    ks = F.sort_array(F.array_distinct(F.transform(legs, lambda x: x["strike"])))
    lo, hi = F.array_min(ks), F.array_max(ks)
    far = (hi + F.greatest(hi - lo, dec(1)) * 10).cast(DEC)
    mids = F.filter(
        F.zip_with(F.slice(ks, 1, F.size(ks)), F.slice(F.concat(ks, F.array(dec(0))), 2, F.size(ks)), lambda a, b: F.when(b > a, ((a + b) / 2).cast(DEC))),
        lambda m: m.isNotNull(),
    )
    return F.sort_array(F.array_distinct(F.concat(F.array(dec(0)), ks, mids, F.array(far))))


def _micros(x: Column) -> Column:
    """Exact money as whole millionths, so the curve runs on long arithmetic."""
    return (x * 1_000_000).cast("bigint")


def _money(x: Column) -> Column:
    return (x.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast(DEC)


def payoff_micros(legs: Column, credit: Column, spot: Column) -> Column:
    """`terminal_payoff` over legs of (t, k, q) in millionths."""
    return F.aggregate(
        legs,
        credit,
        lambda a, x: a
        + x["q"] * F.greatest(F.when(x["t"] == "call", spot - x["k"]).otherwise(x["k"] - spot), F.lit(0).cast("bigint")),
    )


def leg_micros(legs: Column) -> Column:
    return F.transform(
        legs,
        lambda x: F.struct(
            x["option_type"].alias("t"), _micros(x["strike"]).alias("k"), x["quantity"].cast("bigint").alias("q")
        ),
    )


def prove_bounded_loss(structures: DataFrame) -> DataFrame:
    """Adds entry_credit, payoff curve, max loss / profit, capital; drops unbounded, unpriced and riskless rows.

    The proof is one generated row per structure: the generator evaluates the curve once, where a filter on its
    results would be pushed below and evaluate it again for every reference.
    """
    zero = F.lit(0).cast("bigint")

    def measured(p: Column) -> Column:
        worst, best = F.array_min(p["payoffs"]), F.array_max(p["payoffs"])
        debit = F.greatest(-p["credit"], zero)
        raw = F.greatest(-worst, zero)
        floor = (raw <= 0) & (p["credit"] <= 0)
        return F.struct(
            p["credit"].alias("credit"), p["spots"].alias("spots"), p["payoffs"].alias("payoffs"),
            F.when(floor, debit).otherwise(raw).alias("loss"),
            F.when(p["net_calls"] == 0, F.greatest(best, zero)).alias("profit"),
            debit.alias("debit"), floor.alias("debit_floor"),
        )

    def proof(m: Column) -> Column:
        priced = bind_struct(
            credit=_micros(entry_credit()),
            net_calls=F.aggregate("legs", F.lit(0), lambda a, x: a + F.when(x["option_type"] == "call", x["quantity"]).otherwise(0)),
        )
        allowed = F.filter(priced, lambda p: p["credit"].isNotNull() & (p["net_calls"] >= 0))
        spots = F.transform(evaluation_spots(F.col("legs")), _micros)
        with_spots = F.transform(allowed, lambda p: F.struct(p["credit"].alias("credit"), p["net_calls"].alias("net_calls"), spots.alias("spots")))
        curves = F.transform(
            with_spots,
            lambda p: F.struct(
                p["credit"].alias("credit"), p["net_calls"].alias("net_calls"), p["spots"].alias("spots"),
                F.transform(p["spots"], lambda s: payoff_micros(m, p["credit"], s)).alias("payoffs"),
            ),
        )
        return F.filter(F.transform(curves, measured), lambda p: (p["loss"] != 0) | (p["credit"] != 0))

    rows = structures.select(
        "*", F.explode(F.flatten(F.transform(F.array(leg_micros(F.col("legs"))), proof))).alias("_p")
    )
    money = lambda n: _money(F.col(f"_p.{n}"))
    return rows.select(
        *structures.columns,
        money("credit").alias("entry_credit"),
        F.col("_p.spots").alias("spots"),
        F.col("_p.payoffs").alias("payoffs"),
        money("loss").alias("maximum_loss"),
        money("profit").alias("maximum_profit"),
        _money(F.greatest("_p.loss", "_p.debit")).alias("capital_required"),
        F.col("_p.debit_floor").alias("debit_floor"),
    )


def bind_struct(**cols: Column) -> Column:
    return F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))


def breakevens(spots: Column, payoffs: Column) -> Column:
    """Spots (from whole millionths) with zero payoff and linear zero crossings, ascending in numeric order."""
    n = F.size(spots)
    pts = F.arrays_zip(spots.alias("s"), payoffs.alias("p"))
    pairs = F.zip_with(
        F.slice(pts, 1, n - 1), F.slice(pts, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    zeros = F.transform(F.filter(pts, lambda x: x["p"] == 0), lambda x: x["s"] / 1e6)
    crossing = F.filter(pairs, lambda x: F.signum(x["a"]["p"]) * F.signum(x["b"]["p"]) < 0)
    crossed = F.transform(
        crossing,
        lambda x: x["a"]["s"] / 1e6
        + (x["b"]["s"] - x["a"]["s"]) / 1e6 * F.try_divide(x["a"]["p"].cast("double"), (x["a"]["p"] - x["b"]["p"]).cast("double")),
    )
    return F.sort_array(F.array_distinct(F.concat(zeros, crossed)))


def legs_text(legs: Column) -> Column:
    """Stable text of the normalized legs: type:strike:quantity, joined by commas."""
    return F.array_join(
        F.transform(
            legs,
            lambda x: F.concat_ws(":", x["option_type"], x["strike"].cast("string"), x["quantity"].cast("string")),
        ),
        ",",
    )


def with_identity(structures: DataFrame) -> DataFrame:
    """geometry_hash (family, expiration, legs), payoff_hash (credit, curve) and the per-snapshot candidate_id."""
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    geometry = F.sha2(
        F.concat_ws("|", F.lit(VERSION), "family", F.col("expiration").cast("string"), legs_text(F.col("legs"))), 256
    )
    payoff = F.sha2(
        F.concat_ws("|", F.col("entry_credit").cast("string"), text(F.col("spots")), text(F.col("payoffs"))), 256
    )
    direction = F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])
    credit = F.col("entry_credit")
    return structures.withColumn("geometry_hash", geometry).select(
        "*",
        payoff.alias("payoff_hash"),
        F.concat(
            F.lit("cand-"), F.substring(F.sha2(F.concat_ws("|", "snapshot_id", F.lit(VERSION), "geometry_hash"), 256), 1, 12)
        ).alias("candidate_id"),
        direction[F.col("family")].alias("direction"),
        F.when(credit > 0, "credit").when(credit < 0, "debit").otherwise("even").alias("entry_type"),
        F.array_min(F.transform("legs", lambda x: x["q"]["quality"])).alias("quote_quality"),
    )


def dedupe_by_geometry(candidates: DataFrame) -> DataFrame:
    """Best quote quality per geometry in a snapshot, then the lower id."""
    w = Window.partitionBy("snapshot_id", "geometry_hash").orderBy(F.col("quote_quality").desc(), "candidate_id")
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def dedupe_by_payoff(candidates: DataFrame) -> DataFrame:
    """Highest credit per payoff curve in a snapshot, then the lower id."""
    w = Window.partitionBy("snapshot_id", "payoff_hash").orderBy(F.col("entry_credit").desc(), "candidate_id")
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def payoff_rows(candidates: DataFrame) -> DataFrame:
    """(snapshot_id, candidate_id, credit, calls, strikes, quantities, grid) in millionths: all that the payoff needs. grid is
    0, every strike of the snapshot's candidates and 50 above the last."""
    leg = lambda f: F.transform("legs", f)
    rows = candidates.select(
        "snapshot_id", "candidate_id", _micros(F.col("entry_credit")).alias("credit"), leg(lambda x: x["option_type"] == "call").alias("calls"),
        leg(lambda x: _micros(x["strike"])).alias("strikes"), leg(lambda x: x["quantity"].cast("bigint")).alias("quantities"))
    grid = rows.select("snapshot_id", F.explode("strikes").alias("k")).groupBy("snapshot_id").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    grid = grid.select("snapshot_id", F.concat(F.array(F.lit(0).cast("bigint")), "ks", F.array(F.array_max("ks") + 50_000_000)).alias("grid"))
    return rows.join(grid, "snapshot_id")


def payoff_points(frame):
    """Matrix of the entry credit and the P&L on the grid, one line a candidate of one snapshot. A candidate beats another
    when none of its points is lower and its P&L sum is higher."""
    import numpy as np

    grid = np.asarray(frame["grid"].iloc[0], dtype=np.int64)
    credit = frame["credit"].to_numpy(dtype=np.int64)
    out = np.repeat(credit[:, None], len(grid) + 1, axis=1)
    for i, (calls, strikes, quantities) in enumerate(zip(frame["calls"], frame["strikes"], frame["quantities"])):
        for call, k, q in zip(calls, strikes, quantities):
            out[i, 1:] += q * np.maximum(grid - k if call else k - grid, 0)
    return out


def maximal_rows(points, area, chunk: int = 256) -> tuple[list[int], int]:
    """Rows that no other one beats, and the pairs compared.

    Rows come in descending area, so only earlier ones can beat a row, and as the relation is transitive only earlier
    maximal ones need to be asked: a chunk meets the maximal rows so far in one comparison, then its own rest.
    """
    import numpy as np

    order = np.lexsort((np.arange(len(area)), -area))
    kept = np.zeros(0, dtype=int)
    compared = 0
    for at in range(0, len(order), chunk):
        part = order[at:at + chunk]
        for top in range(0, len(kept), chunk):
            best = kept[top:top + chunk]
            compared += len(best) * len(part)
            beaten = ((points[best][:, None, :] >= points[part][None, :, :]).all(axis=2) & (area[best][:, None] > area[part][None, :])).any(axis=0)
            part = part[~beaten]
        compared += len(part) * len(part)
        beaten = ((points[part][:, None, :] >= points[part][None, :, :]).all(axis=2) & (area[part][:, None] > area[part][None, :])).any(axis=0)
        kept = np.concatenate((kept, part[~beaten]))
    return sorted(kept.tolist()), compared


def drop_dominated(candidates: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Candidates that no other one of their snapshot beats (see payoff_points). The relation is a strict partial order, so a
    snapshot is cut in blocks, each block gives its maximal rows, and those of all blocks meet in one merge."""
    candidates = materialized(candidates, "candidates")
    rows = payoff_rows(candidates)
    sizes = rows.groupBy("snapshot_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))

    def maximal(frame):
        points = payoff_points(frame)
        return frame.iloc[maximal_rows(points, points[:, 1:].sum(axis=1))[0]]

    cut = rows.join(sizes, "snapshot_id").withColumn("block", F.pmod(F.xxhash64("candidate_id"), F.col("blocks")))
    keep = [c for c in rows.columns]
    local = cut.groupBy("snapshot_id", "block").applyInPandas(lambda f: maximal(f)[keep], rows.schema)
    survivors = local.groupBy("snapshot_id").applyInPandas(maximal, rows.schema).select("snapshot_id", "candidate_id")
    return candidates.join(survivors, ["snapshot_id", "candidate_id"], "left_semi")


def candidate_universe(
    chain: DataFrame, cfg: StructureConfig | None = None, dominance: bool = True
) -> DataFrame:
    """Enumerate → price → prove bounded → identify → dedupe → prune; one row per surviving candidate."""
    built = with_identity(prove_bounded_loss(enumerate_structures(chain, cfg)))
    kept = drop_dominated(dedupe_by_payoff(dedupe_by_geometry(built))) if dominance else built
    return kept.withColumn("breakevens", breakevens(F.col("spots"), F.col("payoffs")))


def universe_ids(candidates: DataFrame, keys: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """One content id per snapshot's set of candidate ids."""
    return candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.concat(
            F.lit("univ-"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("candidate_id")), ","), 256), 1, 12)
        ).alias("universe_id"),
    )
