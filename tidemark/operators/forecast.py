"""Forecast models on Spark ML, calibration, conformal intervals, uncertainty, ensembles and path scoring."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import bind, clip, codes, mean_known, ratio, uniform_hash
from tidemark.functions.tables import materialized
from tidemark.operators.fits import Fit, Prepared, fit_many, predict_many, prepare, rearranged
from tidemark.operators.windows import grouped_medians, ranked

SEED = 42


# -- feature vectors and fits ---------------------------------------------------------------------------------------
def exact_medians(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Median of each column's known values, 0 where there is none. One number a column comes to the driver."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("e"))
    known = long.select("e.name", "e.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return dict.fromkeys(names, 0.0) | {r.name: r.median for r in grouped_medians(known, ["name"], "v").collect()}


def vector_stages(df: DataFrame, names: Sequence[str], medians: dict[str, float] | None = None) -> list:
    """Imputation by the exact medians of df (medians, where they are known), missing flags, one standardised vector."""
    names = sorted(names)
    imputed = [f"{n}__i" for n in names]
    filled = ", ".join(f"coalesce(`{n}`, {m!r}D) AS `{n}__i`" for n, m in (medians or exact_medians(df, names)).items())
    return [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[*imputed, *[f"{n}__m" for n in names]], outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def with_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Double features plus a missing flag each; NaN counts as missing."""
    known = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    return df.withColumns({n: known(n) for n in names} | {f"{n}__m": known(n).isNull().cast("double") for n in names})


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores: a small file of many rows is otherwise the work of one task or two."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def fit_rows(df: DataFrame, names: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Flagged features and labels, dealt over all cores and written once: medians, scales and every round of a fit read them."""
    return materialized(spread(with_flags(df.select(*dict.fromkeys([*names, *labels])), names)), "fit-rows")


def vectorize(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values (sorted names, medians for the missing) followed by missing flags, as one array column."""
    flagged = with_flags(df, names)
    stages = vector_stages(flagged, names)[:2]
    return Pipeline(stages=stages).fit(flagged).transform(flagged).withColumn("vector", vector_to_array("raw_features"))


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Row weights n / (2·n_class), from one small aggregate."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))  # one row per class
    return df.join(F.broadcast(g.select(label, (total / (F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * F.col("_n"))).alias("weight"))), label)


def logistic(df: DataFrame, names: Sequence[str], label: str, l1_ratio: float = 0.5, c: float = 0.1, balanced: bool = True,
             medians: dict[str, float] | None = None):
    """Elastic-net logistic model. The penalty is 1/(C·n), the same objective as a summed loss with strength C. medians: those
    of the rows with a label, where df is of fit_rows and they are known."""
    known = df.filter(F.col(label).isNotNull())
    rows = (known if medians else fit_rows(known, names, [label])).withColumn(label, F.col(label).cast("double"))
    rows = balanced_weight(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0))
    n = rows.count()
    lr = LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", elasticNetParam=l1_ratio, regParam=1.0 / (c * max(n, 1)), maxIter=50
    )
    return Pipeline(stages=[*vector_stages(rows, names, medians), lr]).fit(rows)


def probability(model, df: DataFrame, names: Sequence[str], out: str = "p") -> DataFrame:
    scored = model.transform(with_flags(df, names))
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def fit_platt(scored: DataFrame, p: str = "p", y: str = "y") -> tuple[float, float]:
    """(slope, intercept) of a logistic fit on the logit of p."""
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    rows = scored.select(F.col(y).cast("double").alias("y"), F.ln(q / (1 - q)).alias("logit"))
    rows = VectorAssembler(inputCols=["logit"], outputCol="x").transform(rows)
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0, maxIter=50).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(p: Column, slope: float, intercept: float) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return 1.0 / (1.0 + F.exp(-(slope * F.ln(q / (1 - q)) + intercept)))


def fit_isotonic(scored: DataFrame, p: str = "p", y: str = "y"):
    rows = VectorAssembler(inputCols=[p], outputCol="x").transform(scored.withColumn(y, F.col(y).cast("double")))
    return IsotonicRegression(featuresCol="x", labelCol=y).fit(rows)


def apply_isotonic(model, df: DataFrame, p: str = "p", out: str = "p_iso") -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=[p], outputCol="x").transform(df))
    return scored.withColumnRenamed("prediction", out).drop("x")


def direction_model(train: DataFrame, later: DataFrame, score: DataFrame, names: Sequence[str], label: str = "y") -> DataFrame:
    """Fit on the early sessions, Platt on the later ones, score the rest. A single-class training set scores its
    base rate."""
    classes = train.filter(F.col(label).isNotNull()).groupBy(label).count().limit(2).count()
    if classes < 2:
        base = train.agg(F.avg(label).alias("p"))
        return score.join(F.broadcast(base), F.lit(True))
    model = logistic(train, names, label)
    slope, intercept = fit_platt(probability(model, later, names).withColumnRenamed(label, "y"))
    return probability(model, score, names).withColumn("p", apply_platt(F.col("p"), slope, intercept))


def barrier_geometry(df: DataFrame) -> DataFrame:
    """Distance features of an interval or barrier in units of the expected move."""
    move = F.nullif(F.col("expected_move"), F.lit(0.0))
    return df.select(
        "*", ratio(F.col("upper") - F.col("spot"), move).alias("up_distance"), ratio(F.col("spot") - F.col("lower"), move).alias("down_distance"),
        ratio(F.col("upper") - F.col("lower"), "spot").alias("interval_width"),
    )


def return_quantiles(train: DataFrame, score: DataFrame, names: Sequence[str], label: str = "y", taus: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantile forecasts q<100·tau> of score, in ascending order: quantile regressions on the features and on a gradient-boosted
    centre, all fitted in the same rounds of reweighted normal equations (see fits.fit_many)."""
    flagged = with_flags(train.filter(F.col(label).isNotNull()), names)
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=15, maxDepth=3, seed=SEED, stepSize=0.1)
    model = Pipeline(stages=[*vector_stages(flagged, names), gbt]).fit(flagged)
    centre = lambda df: model.transform(with_flags(df, names))
    inputs = [*names, "prediction"]
    rows = materialized(centre(train.filter(F.col(label).isNotNull())).select(*inputs, F.col(label).cast("double").alias(label)).withColumn("_w", F.array(F.lit(1.0))), "quantile-rows")
    fits = [Fit(f"q{round(t * 100)}", label, "quantile", 0, t, l2=1e-3) for t in taus]
    prepared = prepare(rows, inputs, "_w", 1)
    beta = fit_many(rows, inputs, fits, "_w", prepared)
    scored = predict_many(centre(score).select(*score.columns, "prediction"), inputs, fits, beta, prepared, "_fitted")
    q = rearranged([F.col("_fitted")[f.name] for f in fits])
    return scored.select(*score.columns, F.col("prediction").alias("center"), *[c.alias(f.name) for c, f in zip(q, fits)])


def volatility_forecast(quantiles: DataFrame) -> DataFrame:
    """Expected move and spread uncertainty from the quantiles of |return|."""
    return quantiles.select("*", F.greatest(F.col("q50"), F.lit(0.0)).alias("expected_move"), F.greatest(F.col("q90") - F.col("q10"), F.lit(0.0)).alias("spread_uncertainty"))


def huber(train: DataFrame, names: Sequence[str], label: str, medians: dict[str, float] | None = None):
    """Huber regression. medians: those of the rows with a label, where train is of fit_rows and they are known."""
    lr = LinearRegression(featuresCol="features", labelCol=label, loss="huber", epsilon=1.35, maxIter=50)
    known = train.filter(F.col(label).isNotNull())
    rows = known if medians else fit_rows(known, names, [label])
    return Pipeline(stages=[*vector_stages(rows, names, medians), lr]).fit(rows)


def fill_concession(train: DataFrame, score: DataFrame, names: Sequence[str], label: str = "fill_fraction", prior: str = "prior") -> DataFrame:
    """Huber concession forecast blended with the prior by support, plus exact quantiles of the training fills."""
    model = huber(train, names, label)
    n = train.filter(F.col(label).isNotNull()).count()
    q = global_quantiles(train.select(F.col(label).cast("double").alias("v")), (0.1, 0.5, 0.9))
    w = n / (n + 100.0)
    blended = clip(F.col("prediction") * w + F.col(prior) * (1.0 - w), 0.0, 1.0)
    return model.transform(with_flags(score, names)).select(*score.columns, blended.alias("concession"), *[F.lit(x).alias(c) for c, x in zip(("q10", "q50", "q90"), q)])


def global_quantiles(values: DataFrame, taus: Sequence[float]) -> list[float | None]:
    """Exact quantiles of column v over the whole table; one number each comes to the driver.

    Approximate quantiles beside each tau cut a narrow band; counts say whether it holds the wanted order statistics, and where
    it doesn't, the band is open on that side. Only the distinct values of the bands are sorted.
    """
    v, known = F.col("v"), values.select("v").filter(F.col("v").isNotNull())
    taus = [float(t) for t in taus]
    edges = [min(max(t + d, 0.0), 1.0) for t in taus for d in (-0.001, 0.001)]
    n, cuts = known.agg(F.count(F.lit(1)), F.percentile_approx("v", edges, 10_000)).first()
    if not n:
        return [None] * len(taus)
    sizes = known.agg(*[F.count_if(v < cuts[k]) if k % 2 == 0 else F.count_if(v <= cuts[k]) for k in range(len(cuts))]).first()
    places = [(n - 1) * t + 1 for t in taus]
    low = [math.floor(h) for h in places]
    high = [min(k + 1, n) for k in low]
    before, inside = [], []
    for k in range(len(taus)):
        above, below = sizes[2 * k] < low[k], sizes[2 * k + 1] >= high[k]
        before.append(sizes[2 * k] if above else 0)
        inside.append((v >= cuts[2 * k] if above else F.lit(True)) & (v <= cuts[2 * k + 1] if below else F.lit(True)))
    at = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)])))
    counts = known.select("v", at.alias("k")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    pick = lambda numbers: F.array(*[F.lit(x).cast("long") for x in numbers])[F.col("k")]
    last = counts.withColumn("last", pick(before) + F.sum("c").over(upto))
    holds = lambda rank: F.max(F.when((F.col("last") >= rank) & (F.col("last") - F.col("c") < rank), v))
    got = {r.k: (r.a, r.b) for r in last.groupBy("k").agg(holds(pick(low)).alias("a"), holds(pick(high)).alias("b")).collect()}
    return [got[k][0] + (h - low[k]) * (got[k][1] - got[k][0]) for k, h in enumerate(places)]


def fill_probability(train: DataFrame, score: DataFrame, names: Sequence[str], horizons: Sequence[int], id_col: str) -> DataFrame:
    """Logistic fill probability per horizon (labels y_<h>), made monotone over the horizon by a running maximum. The rows are
    written once for all horizons, and those that every row has a label of share the medians."""
    labels = [f"y_{h}" for h in horizons]
    rows = fit_rows(train, names, labels)
    known = rows.agg(F.count(F.lit(1)).alias("_all"), *[F.count(y).alias(y) for y in labels]).first()
    shared = exact_medians(rows, sorted(names)) if any(known[y] == known["_all"] for y in labels) else None
    out = spread(score)
    for h, y in zip(horizons, labels):
        medians = shared if known[y] == known["_all"] else exact_medians(rows.filter(F.col(y).isNotNull()), sorted(names))
        out = probability(logistic(rows, names, y, l1_ratio=0.0, c=1.0, balanced=False, medians=medians), out, names, f"p_{h}")
    hs = sorted(horizons)
    return out.select(id_col, *[F.greatest(*[F.col(f"p_{g}") for g in hs[: i + 1]], F.lit(0.0)).alias(f"p_{h}") for i, h in enumerate(hs)])


def candidate_value(train: DataFrame, score: DataFrame, names: Sequence[str], label: str = "pnl") -> DataFrame:
    """Huber expected P&L, logistic P(profit), training residual quantiles shifted to the forecast, shortfall. Both fits read
    the same rows and medians, which are made once."""
    rows = fit_rows(train.withColumn("won", (F.col(label) > 0).cast("double")), names, [label, "won"])
    medians = exact_medians(rows.filter(F.col(label).isNotNull()), sorted(names))
    ev = huber(rows, names, label, medians)
    win = logistic(rows, names, "won", l1_ratio=0.0, c=1.0, balanced=False, medians=medians)
    resid = materialized(ev.transform(rows).select((F.col(label) - F.col("prediction")).cast("double").alias("v")), "residuals")
    taus = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90)
    q = global_quantiles(resid, taus)
    tail = resid.filter(F.col("v") <= F.lit(q[0])).agg(F.avg("v")).first()[0]  # one number
    scored = ev.transform(with_flags(probability(win, spread(score), names, "p_profit"), names))
    quant = [(F.col("prediction") + F.lit(x)).alias(f"pnl_q{round(t * 100):02d}") for t, x in zip(taus, q)]
    return scored.select(
        *score.columns, F.col("prediction").alias("expected_net_pnl"), "p_profit", *quant,
        F.greatest(-(F.col("prediction") + F.lit(tail)), F.lit(0.0)).alias("expected_shortfall"),
    )


def regime_probabilities(train: DataFrame, score: DataFrame, names: Sequence[str], label: str, n_classes: int, later: DataFrame | None = None, session: str | None = None, shrinkage: float = 40.0) -> DataFrame:
    """Class probabilities (probs), normalised entropy, most likely class and, with a session column, support uncertainty.

    later: rows after those of train; each class is calibrated on them by a logistic curve of its own (all curves in the same
    rounds) and the row is normalised again. A class that later doesn't show both ways stays as it is. Support of a class
    is the number of distinct training sessions that show it.
    """
    flagged = with_flags(train, names).withColumn(label, F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", regParam=0.01, maxIter=40)
    model = Pipeline(stages=[*vector_stages(flagged, names), lr]).fit(flagged)
    # a class that training doesn't show has no probability
    whole = lambda p: F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.try_element_at(p, k + 1), F.lit(0.0)))
    raw = lambda df: model.transform(with_flags(df, names)).select(*df.columns, whole(vector_to_array("probability")).alias("probs"))
    logit = lambda k: F.ln(clip(F.col("probs")[k], 1e-6, 1 - 1e-6) / (1 - clip(F.col("probs")[k], 1e-6, 1 - 1e-6)))
    scored = raw(score)
    if later is not None:
        own = [f"_s{k}" for k in range(n_classes)]
        rows = raw(later).select(
            *[logit(k).alias(own[k]) for k in range(n_classes)], *[(F.col(label) == k).cast("double").alias(f"_y{k}") for k in range(n_classes)], F.array(F.lit(1.0)).alias("_w"))
        plain = Prepared(tuple(own), np.zeros((1, n_classes)), np.zeros((1, n_classes)), np.ones((1, n_classes)))
        curves = [Fit(f"{k}", f"_y{k}", "logistic", columns=(0, 1 + k)) for k in range(n_classes)]
        beta = fit_many(materialized(rows, "calibration"), own, curves, "_w", plain)
        each = [F.col("probs")[k] if f"{k}" not in beta else 1.0 / (1.0 + F.exp(-(logit(k) * float(beta[f"{k}"][1]) + float(beta[f"{k}"][0])))) for k in range(n_classes)]
        scored = scored.withColumn("_each", F.array(*each)).withColumn("_sum", F.aggregate("_each", F.lit(0.0), lambda a, x: a + x))
        scored = scored.withColumn("probs", F.transform("_each", lambda x: x / F.col("_sum"))).drop("_each", "_sum")
    entropy = F.aggregate(F.transform("probs", lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    predicted = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    out = scored.select(*score.columns, "probs", (entropy / F.ln(F.lit(float(n_classes)))).alias("entropy"), predicted.alias("predicted"))
    if session is None:
        return out
    seen = {int(r[0]): float(r[1]) for r in train.groupBy(label).agg(F.count_distinct(session)).collect()}  # a row a class
    support = F.array(*[F.lit(seen.get(k, 0.0)) for k in range(n_classes)])
    weighted = F.aggregate(F.zip_with("probs", support, lambda p, s: p * s / (s + shrinkage)), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("support_uncertainty", clip(1.0 - weighted, 0.0, 1.0))


# -- mixtures and ensembles -----------------------------------------------------------------------------------------
def mixture_of_experts(predictions: DataFrame, probabilities: DataFrame, support: DataFrame, global_pred: DataFrame, shrinkage: float = 40.0, minimum: float = 20.0) -> DataFrame:
    """Regime-weighted blend of experts shrunk toward the global model by support, with disagreement.

    predictions (obs_id, regime, pred), probabilities (obs_id, regime, p), support (regime, sessions: a handful of
    rows), global_pred (obs_id, g).
    """
    j = (
        probabilities.join(predictions, ["obs_id", "regime"], "left").join(F.broadcast(support), "regime", "left").join(global_pred, "obs_id")
    )
    s = F.coalesce("sessions", F.lit(0.0))
    w = F.when(s >= minimum, s / (s + shrinkage)).otherwise(0.0)
    shrunk = w * F.coalesce("pred", "g") + (1.0 - w) * F.col("g")
    rows = j.select("obs_id", F.struct("regime", F.greatest("p", F.lit(0.0)).alias("p"), shrunk.alias("x")).alias("r"))
    # an observation has a row a regime: a small array in one order, so sums don't depend on how the rows arrive
    total = lambda f: F.aggregate("r", F.lit(0.0), lambda a, e: a + F.coalesce(f(e), F.lit(0.0)))
    agg = rows.groupBy("obs_id").agg(F.sort_array(F.collect_list("r"), asc=False).alias("r")).select(
        "*", total(lambda e: e["p"]).alias("sp"), F.nullif(F.size(F.filter("r", lambda e: e["x"].isNotNull())), F.lit(0)).alias("n"))
    weighted = F.col("sp") > 1e-12
    mean = F.when(weighted, F.when(F.col("n") > 0, total(lambda e: e["p"] * e["x"]) / F.col("sp"))).otherwise(total(lambda e: e["x"]) / F.col("n"))
    off = lambda e: (e["x"] - F.col("prediction")) * (e["x"] - F.col("prediction"))
    spread = F.when(weighted, total(lambda e: e["p"] * off(e)) / F.col("sp")).otherwise(total(off) / F.col("n"))
    return agg.withColumn("prediction", mean).select("obs_id", "prediction", spread.alias("disagreement"))


def mixture_uncertainty(within: Column, disagreement: Column, entropy: Column, support: Column, ood: Column) -> Column:
    raw = 0.35 * within + 0.25 * F.sqrt(F.greatest(disagreement, F.lit(0.0))) + 0.20 * entropy + 0.15 * support + 0.05 * ood
    return clip(raw, 0.0, 1.0)


def ensemble_weights(components: DataFrame, keys: Sequence[str] = ("obs_id",), eta: float = 1.0, cap: float = 0.60, protect: float = 1e-4) -> DataFrame:
    """Normalised component weights prior·e^(−η·loss): negative skill 1e-6, OOD ≥ .8 quartered, one capping round.

    Needs component, oos_loss, prior, negative_skill, ood. Tiny protected weights never grow from the redistribution.
    """
    w = Window.partitionBy(*keys)
    raw = F.when(F.col("negative_skill"), 1e-6).otherwise(
        F.greatest(F.col("prior") * F.exp(-eta * F.coalesce("oos_loss", F.lit(1.0))) * F.when(F.col("ood") >= 0.8, 0.25).otherwise(1.0), F.lit(1e-6))
    )
    a = components.withColumn("_raw", raw)
    b = a.select("*", (F.col("_raw") / F.sum("_raw").over(w)).alias("_w"), (F.col("_raw") <= protect).alias("_tiny"))
    over = (F.col("_w") > cap + 1e-12) & ~F.col("_tiny")
    c = b.select("*", over.alias("_over"))
    capped = F.sum(F.when(F.col("_over"), cap).otherwise(0.0)).over(w)
    tiny = F.sum(F.when(F.col("_tiny"), F.col("_w")).otherwise(0.0)).over(w)
    free = F.sum(F.when(~F.col("_over") & ~F.col("_tiny"), F.col("_w")).otherwise(0.0)).over(w)
    any_over = F.max(F.col("_over").cast("int")).over(w) == 1
    remain = F.greatest(F.lit(0.0), 1.0 - capped - tiny)
    n = F.count(F.lit(1)).over(w)
    lone = (free <= 1e-12) & (tiny <= 0)
    moved = (
        F.when(~any_over, F.col("_w")).when(lone, 1.0 / n).when(F.col("_over"), cap).when(F.col("_tiny"), F.col("_w"))
        .when((free > 1e-12) & (remain > 1e-12), F.col("_w") / free * remain).otherwise(F.col("_w"))
    )
    d = c.withColumn("_m", moved)
    return d.select(*components.columns, (F.col("_m") / F.sum("_m").over(w)).alias("weight"))


def weighted_blend(weighted: DataFrame, keys: Sequence[str] = ("obs_id",)) -> DataFrame:
    """Blend, weighted disagreement and composite uncertainty per key; a NULL prediction counts as missing."""
    ok = F.col("prediction").isNotNull() & (F.col("weight") > 0)
    x = lambda e: F.when(ok, e)
    p, w = F.col("prediction"), F.col("weight")
    agg = weighted.groupBy(*keys).agg(
        F.sum(x(w * p)).alias("blend"), F.sum(x(w * p * p)).alias("_pp"), F.sum(x(w)).alias("_w"), F.count(x(F.lit(1))).alias("n"),
        F.sum(x(w * F.coalesce("uncertainty", F.lit(0.0)))).alias("_u"), F.count_if(F.col("prediction").isNull()).alias("missing"),
    )
    dis = F.when(F.col("n") <= 1, 0.0).otherwise(F.greatest(F.col("_pp") - 2 * F.col("blend") * F.col("blend") + F.col("blend") * F.col("blend") * F.col("_w"), F.lit(0.0)))
    comp = clip(0.4 * F.col("_u") + 0.3 * F.sqrt(dis) + 0.2 * 0.1 * F.col("missing"), 0.0, 1.0)
    return agg.select(*keys, F.col("blend").alias("prediction"), dis.alias("disagreement"), comp.alias("composite_uncertainty"), "missing")


# -- uncertainty ----------------------------------------------------------------------------------------------------
# fixed values: composite weights and the abstention threshold
UNCERTAINTY_WEIGHTS = {"ensemble": 0.25, "conformal": 0.20, "out_of_distribution": 0.25, "calibration": 0.15, "data_quality": 0.10, "model_age": 0.05}
ABSTAIN_AT = 0.85


def compose_uncertainty(df: DataFrame) -> DataFrame:
    """Weighted mean of the clipped known parts, weights renormalised; 1 when none is known; reasons for the rest."""
    part = {n: clip(F.col(n), 0.0, 1.0) for n in UNCERTAINTY_WEIGHTS}
    num = sum((F.coalesce(p * UNCERTAINTY_WEIGHTS[n], F.lit(0.0)) for n, p in part.items()), F.lit(0.0))
    den = sum((F.when(p.isNotNull(), UNCERTAINTY_WEIGHTS[n]).otherwise(0.0) for n, p in part.items()), F.lit(0.0))
    composite = F.coalesce(F.when(den > 0, num / F.nullif(den, F.lit(0.0))), F.lit(1.0))
    reasons = codes(
        *[(p.isNull(), f"missing_{n}_component") for n, p in part.items()], (den == 0, "no_uncertainty_components_available"), (composite >= ABSTAIN_AT, "ABSTAIN_SHADOW")
    )
    return df.select("*", composite.alias("composite"), reasons.alias("reasons"))


def ensemble_uncertainty(values: Column, classification: bool = True) -> Column:
    """Spread of an ensemble's predictions in [0, 1]: standard deviation over .5, or IQR against the median scale."""
    n = F.size(values)
    if classification:
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
        var = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n
        return F.when(n < 2, 0.0).otherwise(clip(F.sqrt(var) / 0.5, 0.0, 1.0))

    def quantile(s: Column, t: float) -> Column:
        h = (F.size(s) - 1) * t
        lo = F.floor(h).cast("int")
        return F.try_element_at(s, lo + 1) + (h - lo) * (F.try_element_at(s, F.least(lo + 2, F.size(s))) - F.try_element_at(s, lo + 1))

    def spread(s: Column) -> Column:
        iqr = quantile(s, 0.75) - quantile(s, 0.25)
        scale = F.abs(quantile(s, 0.5)) + 1e-6
        return clip(iqr / (2.0 * scale + iqr), 0.0, 1.0)

    return F.when(n < 2, 0.0).otherwise(bind(F.sort_array(values), spread))


def data_quality_uncertainty(df: DataFrame, max_age: float = 30.0) -> Column:
    """Mean of the known quality penalties; 0 when nothing is known."""
    c = F.col
    inv = lambda n: clip(1.0 - c(n), 0.0, 1.0)
    parts = [inv(n) for n in ("feature_coverage", "chain_strike_coverage", "quote_consistency") if n in df.columns]
    if "max_source_age" in df.columns:
        parts.append(clip(c("max_source_age") / max_age, 0.0, 1.0))
    if "feed_failover" in df.columns:
        parts.append(F.when(c("feed_failover"), 0.6))
    if "arbitrage_violations" in df.columns:
        parts.append(F.when(c("arbitrage_violations") > 0, clip(0.2 * c("arbitrage_violations"), 0.0, 1.0)))
    if "missingness_count" in df.columns:
        parts.append(F.when(c("missingness_count") > 0, clip(c("missingness_count") / 20.0, 0.0, 1.0)))
    return F.coalesce(mean_known(*parts), F.lit(0.0))


def calibration_uncertainty(brier: Column, log_loss: Column, slope: Column, intercept: Column, support: Column) -> Column:
    """Mean of the known calibration drifts; NULL when none is known."""
    return mean_known(
        clip(brier, 0.0, 1.0), clip(log_loss / 0.5, 0.0, 1.0), clip(F.abs(slope - 1.0), 0.0, 1.0), clip(F.abs(intercept), 0.0, 1.0), clip(1.0 - support, 0.0, 1.0)
    )


def model_age_uncertainty(age_days: Column, eval_gap_days: Column, shift: Column, missing_sessions: Column) -> Column:
    return F.coalesce(
        mean_known(
            clip(age_days / 30.0, 0.0, 1.0), clip(eval_gap_days / 5.0, 0.0, 1.0), clip(shift, 0.0, 1.0), F.when(missing_sessions > 0, clip(missing_sessions / 5.0, 0.0, 1.0))
        ),
        F.lit(0.0),
    )


def split_conformal(calibration: DataFrame, coverage: float = 0.9, session: str = "session_date") -> DataFrame:
    """One row: the finite-sample correction max(lo−y, y−hi, 0) at level ⌈(n+1)·coverage⌉/n, with support counts.

    The level depends on n, so the exact linear-interpolated quantile is taken from the two neighbouring order
    statistics, found by distributed ranks.
    """
    s = calibration.select(F.greatest(F.col("lower") - F.col("y"), F.col("y") - F.col("upper"), F.lit(0.0)).alias("score"), session, F.monotonically_increasing_id().alias("_id"))
    stats = s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(session).alias("support_sessions"), F.avg("score").alias("score_mean"))
    level = F.least(F.lit(1.0), F.ceil(F.round((F.col("n") + 1) * coverage, 9)) / F.col("n"))
    # rank over (score) needs no tie rule: equal scores give equal order statistics
    r = ranked(s.select("score", "_id"), [], "score", ["_id"])
    h = (F.col("n") - 1) * level
    lo = F.floor(h) + 1
    near = r.filter((F.col("rank") == lo) | (F.col("rank") == F.least(lo + 1, F.col("n"))))
    pair = near.agg(F.min("score").alias("a"), F.max("score").alias("b"), F.max(h - F.floor(h)).alias("f"))
    out = stats.join(F.broadcast(pair), F.lit(True))
    return out.select((F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("correction"), F.col("n").alias("support_rows"), "support_sessions", "score_mean")


def apply_conformal(df: DataFrame, correction: DataFrame, ood_threshold: float = 0.8, ood_multiplier: float = 1.5) -> DataFrame:
    c = df.join(F.broadcast(correction.select("correction")), F.lit(True))
    k = F.col("correction") * F.when(F.col("ood_score") >= ood_threshold, ood_multiplier).otherwise(1.0)
    return c.select(*df.columns, (F.col("lower") - k).alias("conformal_lower"), (F.col("upper") + k).alias("conformal_upper"))


# -- out of distribution --------------------------------------------------------------------------------------------
def robust_scaler(train: DataFrame, dims: int, vector: str = "vector") -> DataFrame:
    """One row: exact medians and MADs per dimension (MAD 0 → 1), 0 and 1 for a dimension without values. They are computed
    once: two numbers a dimension come to the driver, and plans that use the scaler don't hold its own."""
    long = train.select(F.posexplode(F.col(vector)).alias("d", "x")).filter(F.col("x").isNotNull())
    med = {r.d: r.median for r in grouped_medians(long, ["d"], "x").collect()}
    centre = F.array(*[F.lit(float(med.get(d, 0.0))) for d in range(dims)])
    off = long.withColumn("off", F.abs(F.col("x") - centre[F.col("d")]))
    mad = {r.d: r.median for r in grouped_medians(off, ["d"], "off").collect()}
    wide = [mad.get(d, 0.0) for d in range(dims)]
    return train.sparkSession.createDataFrame(
        [([float(med.get(d, 0.0)) for d in range(dims)], [float(m) if m > 1e-12 else 1.0 for m in wide])], "med array<double>, mad array<double>")


def robust_z(df: DataFrame, scaler: DataFrame, vector: str = "vector", limit: float = 6.0) -> DataFrame:
    z = F.zip_with(F.zip_with(F.col(vector), "med", lambda x, m: F.coalesce(x, m) - m), "mad", lambda d, s: F.greatest(F.lit(-limit), F.least(F.lit(limit), 0.6745 * d / s)))
    return df.join(F.broadcast(scaler), F.lit(True)).withColumn("z", z).drop("med", "mad")


# -- exact nearest neighbours ---------------------------------------------------------------------------------------------
MOST_PIVOTS = 1_024  # rows that come to the driver and are broadcast
RINGS = 16  # rings of a cell at most
QUERY_ROWS = 512  # queries of a pack
WALK_ROWS = 16_384  # queries that a task holds while the blocks pass: 8 MB of 64 dimensions
MOST_ROWS = 8_192  # training rows of a block: a pack against one is a matrix of 32 MB


def _distances(a, b):
    """All distances between the rows of two matrices, by one matrix product."""
    import numpy as np

    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


def _closest(qids, q, tids, t, k: int, exclude_self: bool):
    """The k smallest distances of each query row to the rows of a block, infinite where there are fewer. The product picks the
    candidates, differences give their distances, so a distance of 0 is 0."""
    import numpy as np

    d = _distances(q, t)
    if exclude_self:
        d[qids[:, None] == tids[None, :]] = np.inf
    few = min(d.shape[1], k + 4)
    at = np.argpartition(d, few - 1, axis=1)[:, :few]
    exact = np.sqrt(((q[:, None, :] - t[at]) ** 2).sum(axis=2))
    exact[~np.isfinite(np.take_along_axis(d, at, axis=1))] = np.inf
    best = np.full((len(q), k), np.inf)
    best[:, : min(k, few)] = np.sort(exact, axis=1)[:, :k]
    return best


def _closer(best, qids, q, tids, t, k: int, exclude_self: bool):
    """best with the distances to the rows of a block that are among the k smallest then. Where k are known, only pairs below the
    last of them are looked at."""
    import numpy as np

    if np.isfinite(best).all():
        size = (q * q).sum(1)
        length = (t * t).sum(1)
        most = best[:, -1] ** 2 - size + 1e-10 * (1.0 + size + length.max())  # a margin for the rounding of products
        at, to = np.nonzero(np.hstack([-2.0 * q, np.ones((len(q), 1))]) @ np.hstack([t, length[:, None]]).T <= most[:, None])
        if exclude_self:
            other = qids[at] != tids[to]
            at, to = at[other], to[other]
        if not len(at):
            return best
        if len(at) <= 8 * (k + 4) * len(q):
            exact = np.sqrt(((q[at] - t[to]) ** 2).sum(axis=1))
            order = np.lexsort((exact, at))
            at, exact = at[order], exact[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            near = np.full(best.shape, np.inf)
            near[at[place < k], place[place < k]] = exact[place < k]
            return np.sort(np.hstack([best, near]), axis=1)[:, :k]
    return np.sort(np.hstack([best, _closest(qids, q, tids, t, k, exclude_self)]), axis=1)[:, :k]


class NeighbourIndex:
    """Training rows in blocks of about block_rows, by nearest pivot and by ring of the distance to it, one file a block below
    the cluster's shared folder.

    Queries move once, in packs; a task walks its packs past the files of the blocks that the triangle inequality leaves and
    keeps the k smallest distances so far, so what is moved and written grows with the rows, not with the pairs. A task holds
    WALK_ROWS queries and one block. Blocks grow with the rows (a 64th of them, 512 to MOST_ROWS).
    Pivots grow with the root of the rows. Each cell is cut in up to RINGS rings at quantiles of the distance, and a ring
    beyond block_rows (repeated rows, crowded cells) in salts, so no block holds more than a few times block_rows. Every
    block knows its lowest and highest distance.
    """

    def __init__(self, train: DataFrame, pivots: int | None = None, block_rows: int | None = None):
        import numpy as np

        total = train.count()
        block_rows = block_rows or max(QUERY_ROWS, min(MOST_ROWS, total // 64))
        self.block_rows, self.query_rows = block_rows, min(block_rows, QUERY_ROWS)
        count = pivots or max(1, min(MOST_PIVOTS, int(total ** 0.5) // 8))
        picked = train.orderBy(F.xxhash64("id"), "id").limit(count).select("z").collect()
        self.centres = np.array([r.z for r in picked], dtype=float)
        rows = self.celled(train)  # read again for each count: vectors are written once, in their blocks
        cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)]).alias("cuts"))
        # at most MOST_PIVOTS rows, and RINGS times as many: the plan of every search needs them
        self.cuts = cells.select("cell", "cuts", F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows)).cast("int").alias("rings"))
        known = self.cuts.collect()
        self.cuts = train.sparkSession.createDataFrame(known, self.cuts.schema)
        ringed = self.ringed(rows)
        rings = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect() if known else []
        salts = train.sparkSession.createDataFrame([(r.cell, r.ring, -(-r.n // block_rows)) for r in rings], "cell int, ring int, salts long")
        salt = F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("salts", F.lit(1)))
        salted = ringed.join(F.broadcast(salts), ["cell", "ring"], "left").withColumn("salt", salt)
        packed = _blocks(salted, ["cell", "ring", "salt"], "t_", F.min("d").alias("low"), F.max("d").alias("high"))
        self.blocks = materialized(packed, "blocks", 1)
        self.places = self.blocks.select("cell", "ring", "salt", "low", "high", F.col("_metadata.file_path").alias("path")).collect() if known else []

    def celled(self, df: DataFrame) -> DataFrame:
        """(id, z, cell, d): nearest pivot and the distance to it."""
        centres = self.centres

        def nearest(batches):
            import numpy as np
            import pandas as pd

            for f in batches:
                if not len(f) or not len(centres):
                    continue
                d = _distances(np.stack(f["z"].to_numpy()).astype(float), centres)
                at = d.argmin(axis=1)
                yield pd.DataFrame({"id": f["id"], "z": f["z"], "cell": at.astype("int32"), "d": d[np.arange(len(d)), at]})

        return df.select(F.col("id").cast("long").alias("id"), "z").mapInPandas(nearest, "id long, z array<double>, cell int, d double")

    def ringed(self, rows: DataFrame) -> DataFrame:
        ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("d"))) * F.col("rings") / RINGS).cast("int")
        return rows.join(F.broadcast(self.cuts), "cell", "left").select("id", "z", "cell", "d", F.coalesce(ring, F.lit(0)).alias("ring"))

    def packs(self, queries: DataFrame | None) -> DataFrame:
        """(q_ids, q_zs): queries by nearest pivot and ring; the training rows' own blocks for None, which don't move."""
        if queries is None:
            return self.blocks.select(F.col("t_ids").alias("q_ids"), F.col("t_zs").alias("q_zs"))
        rows = self.ringed(self.celled(queries))
        sizes = rows.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / self.query_rows).alias("parts"))  # a row a ring
        part = F.pmod(F.xxhash64("id", F.lit(11)), F.coalesce("parts", F.lit(1)))
        parted = rows.join(F.broadcast(sizes), ["cell", "ring"], "left").withColumn("part", part)
        return _blocks(parted, ["cell", "ring", "part"], "q_").select("q_ids", "q_zs")

    def walk(self, k: int, exclude_self: bool):
        """A function of batches of packs that gives, for each WALK_ROWS queries, (ids, best, looks): the k smallest distances,
        and which queries met which block. A first look at the block that is nearest to a pack gives bounds."""
        import numpy as np

        dims, centres, rows = self.centres.shape[-1], self.centres, self.query_rows
        cell = np.array([r.cell for r in self.places], dtype=int)
        low, high = np.array([r.low for r in self.places]), np.array([r.high for r in self.places])
        paths = [r.path for r in self.places]

        def block(j):
            import pyarrow.parquet as pq

            from tidemark.sources.session_lines import file_system

            system, path = file_system(paths[j])
            with system.open_input_file(path) as f:
                t = pq.read_table(f, columns=["t_ids", "t_zs"])
            ids, zs = (t.column(n).combine_chunks().flatten().to_numpy() for n in ("t_ids", "t_zs"))
            return ids, zs.reshape(-1, dims)

        def met(group):
            gaps, first, best, looks = [], [], [], []
            for _, q in group:
                to = _distances(q, centres)[:, cell]
                gap = np.maximum(to - high, low - to) - 1e-6 * (1.0 + to)  # a margin for the rounding of products
                gaps.append(gap.astype("float32"))
                first.append(int(gap.mean(axis=0).argmin()))
                best.append(np.full((len(q), k), np.inf))
            for look in (True, False):
                for j in range(len(paths)):
                    near = [np.flatnonzero(gaps[i][:, j] <= best[i][:, -1]) if (first[i] == j) == look else () for i in range(len(group))]
                    if not any(len(n) for n in near):
                        continue
                    tids, t = block(j)
                    for i, n in enumerate(near):
                        if len(n):
                            qids, q = group[i]
                            best[i][n] = _closer(best[i][n], qids[n], q[n], tids, t, k, exclude_self)
                            looks.append((qids[n], j))
            return np.concatenate([qids for qids, _ in group]), np.concatenate(best), looks

        def run(batches):
            group, held = [], 0
            for f in batches:
                for qids, qz in zip(f["q_ids"], f["q_zs"]):
                    qids, q = np.asarray(qids), np.asarray(qz, dtype=float).reshape(len(qids), -1)
                    for i in range(0, len(qids), rows):
                        group.append((qids[i : i + rows], q[i : i + rows]))
                        held += len(group[-1][0])
                        if held >= WALK_ROWS:
                            yield met(group)
                            group, held = [], 0
            if group:
                yield met(group)

        return run

    def visits(self, queries: DataFrame | None, k: int, exclude_self: bool) -> DataFrame:
        """(q_ids, cell, ring, salt): which queries of a pack a search compares with which block."""
        run, places = self.walk(k, exclude_self), [(r.cell, r.ring, r.salt) for r in self.places]

        def looks(batches):
            import pandas as pd

            for _, _, seen in run(batches):
                yield pd.DataFrame([(qids, *places[j]) for qids, j in seen], columns=["q_ids", "cell", "ring", "salt"])

        return self.packs(queries).mapInPandas(looks, "q_ids array<long>, cell int, ring int, salt long")

    def search(self, queries: DataFrame | None, k: int, exclude_self: bool) -> DataFrame:
        """(id, best): the k smallest distances of each query, ascending; fewer where there are fewer rows. None: the training
        rows are the queries."""
        run = self.walk(k, exclude_self)

        def compare(batches):
            import numpy as np
            import pandas as pd

            for ids, best, _ in run(batches):
                yield pd.DataFrame({"id": ids, "best": [row[np.isfinite(row)] for row in best]})

        found = self.packs(queries).mapInPandas(compare, "id bigint, best array<double>").filter(F.size("best") > 0)
        return found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def _blocks(rows: DataFrame, keys: Sequence[str], prefix: str, *facts: Column) -> DataFrame:
    """ids and one flat list of components for each block, and further facts of its rows."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct("id", "z")).alias("_rows"), *facts)
    return packed.select(
        *[c for c in packed.columns if c != "_rows"], F.transform("_rows", lambda r: r["id"]).alias(f"{prefix}ids"), F.flatten(F.transform("_rows", lambda r: r["z"])).alias(f"{prefix}zs"))


def knn_distance(queries: DataFrame, train: DataFrame, k: int = 5, exclude_self: bool = False, pivots: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Mean and nearest distance of (id, z) rows to the k closest training rows, exact. Packs of queries meet the blocks of
    training rows that the triangle inequality can't rule out, one matrix product a pair; only queries move.
    Queries without any training row to compare with are left out; an id stands for one row."""
    return mean_nearest(NeighbourIndex(train, pivots, block_rows).search(queries, k, exclude_self))


def mean_nearest(best: DataFrame) -> DataFrame:
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")
    return best.select("id", mean.alias("mean_distance"), F.element_at("best", 1).alias("nearest_distance"))


def ood_score(train: DataFrame, queries: DataFrame, dims: int, k: int = 5, limit: float = 6.0) -> DataFrame:
    """Out-of-distribution score: .35 × share of features at the range limit + .65 × percentile of the kNN distance
    among the training rows' own (self excluded); buckets at .80 / .95 / .99.

    The percentile of each query is its rank in the merged distances, from distributed ranks; no pair of rows is
    compared twice.
    """
    scaler = robust_scaler(train, dims)
    tz, qz = robust_z(train, scaler, limit=limit), robust_z(queries, scaler, limit=limit)
    index = NeighbourIndex(tz.select("id", "z"))
    # a search is the costly part and its result three numbers a row: what follows reads them several times
    own = materialized(mean_nearest(index.search(None, k, True)), "ood-own").select(F.lit(None).cast("bigint").alias("id"), F.col("mean_distance").alias("d"), F.lit(1).alias("t"))
    theirs = materialized(mean_nearest(index.search(qz, k, False)), "ood-theirs")
    both = own.unionByName(theirs.select("id", F.col("mean_distance").alias("d"), F.lit(0).alias("t")))
    # share of training distances <= own: counts per distance value, then a running sum over ranges of values
    cuts = both.agg(F.percentile_approx("d", [i / 64 for i in range(1, 64)]).alias("cuts"))
    per = both.join(F.broadcast(cuts), F.lit(True)).select("id", "d", "t", F.size(F.filter("cuts", lambda c: c < F.col("d"))).alias("b"))
    sizes = per.groupBy("b").agg(F.sum("t").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    off = sizes.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    w = Window.partitionBy("b").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    pct = per.withColumn("within", F.sum("t").over(w)).join(F.broadcast(off), "b").filter("id is not null").select("id", ((F.col("off") + F.col("within")) / F.col("total")).alias("percentile"))
    edge = F.lit(limit * 0.85)
    out_share = F.size(F.filter("z", lambda v: F.abs(v) >= edge)) / F.size("z")
    j = qz.select("id", out_share.alias("range_share")).join(pct, "id").join(theirs, "id")
    p = F.col("percentile")
    bucket = F.when(p <= 0.80, "normal_support").when(p <= 0.95, "reduced_support").when(p <= 0.99, "high_ood").otherwise("extreme_ood")
    return j.select(
        "id", clip(0.35 * F.col("range_share") + 0.65 * p, 0.0, 1.0).alias("score"), "percentile", "nearest_distance", "mean_distance", bucket.alias("bucket")
    )


# -- competing risks and paths ----------------------------------------------------------------------------------------
def hazards_to_incidence(hazards: DataFrame) -> DataFrame:
    """Competing-risk incidence per observation from arrays h_target, h_stop (bounded steps): first-event probabilities,
    survival and expected event times. One fold over the arrays, no window."""
    pair = F.zip_with(
        "h_target", "h_stop",
        lambda a, b: F.struct((a / F.greatest(a + b, F.lit(1.0))).alias("t"), (b / F.greatest(a + b, F.lit(1.0))).alias("s")),
    )
    zero = F.struct(F.lit(1.0).alias("surv"), F.lit(0.0).alias("pt"), F.lit(0.0).alias("ps"), F.lit(0.0).alias("tt"), F.lit(0.0).alias("ts"), F.lit(0.0).alias("i"))

    def step(a: Column, h: Column) -> Column:
        i = a["i"] + 1.0
        return F.struct(
            (a["surv"] * (1.0 - h["t"] - h["s"])).alias("surv"), (a["pt"] + a["surv"] * h["t"]).alias("pt"), (a["ps"] + a["surv"] * h["s"]).alias("ps"),
            (a["tt"] + i * a["surv"] * h["t"]).alias("tt"), (a["ts"] + i * a["surv"] * h["s"]).alias("ts"), i.alias("i"),
        )

    f = hazards.withColumn("_f", F.aggregate(pair, zero, step))
    z = F.col("_f.pt") + F.col("_f.ps") + F.col("_f.surv")
    pt, ps = F.col("_f.pt") / z, F.col("_f.ps") / z
    return f.select(
        *[c for c in hazards.columns if c not in ("h_target", "h_stop")], pt.alias("p_target_first"), ps.alias("p_stop_first"), (F.col("_f.surv") / z).alias("p_neither"),
        F.when(pt > 1e-12, F.col("_f.tt") / pt).alias("expected_target_time"), F.when(ps > 1e-12, F.col("_f.ts") / ps).alias("expected_stop_time"),
    )


def score_path_events(paths: DataFrame, levels: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Event probabilities per snapshot from simulated paths (key, path_id, step, price) and its levels.

    A path touches a level when it lies between two consecutive prices; target and stop in one step count as the stop.
    Two aggregations: path level, then snapshot level. levels: spot, target, stop, call_wall, put_wall, gamma_flip,
    lower, upper (one row per key).
    """
    w = Window.partitionBy(key, "path_id").orderBy("step")
    steps = paths.withColumn("prev", F.lag("price").over(w)).join(levels, key)
    lo, hi, c = F.least("prev", "price"), F.greatest("prev", "price"), F.col
    live = F.col("prev").isNotNull()
    up = c("target") >= c("spot")
    t_hit = F.when(up, hi >= c("target")).otherwise(lo <= c("target"))
    s_hit = F.when(up, lo <= c("stop")).otherwise(hi >= c("stop"))
    at = lambda cond: F.min(F.when(live & cond, c("step")))
    side0 = F.signum(c("spot") - c("gamma_flip"))
    crossed = F.when(side0 == 0, c("price") != c("gamma_flip")).otherwise(F.signum(c("price") - c("gamma_flip")) == -side0)
    per = steps.groupBy(key, "path_id").agg(
        at(t_hit).alias("t"), at(s_hit).alias("s"), at(hi >= c("call_wall")).alias("cw"), at(lo <= c("put_wall")).alias("pw"), at(crossed).alias("x"),
        F.bool_and(F.when(live, (lo > c("lower")) & (hi < c("upper")))).alias("alive"), F.max_by("price", "step").alias("last"),
        F.max(F.when(live, c("price"))).alias("hi"), F.min(F.when(live, c("price"))).alias("lo"), F.max("spot").alias("spot"),
    )
    rate = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("int"))
    t, s = c("t"), c("s")
    return per.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_paths"),
        rate(t.isNotNull() & (s.isNull() | (t < s))).alias("p_target_first"), rate(s.isNotNull() & (t.isNull() | (s <= t))).alias("p_stop_first"),
        rate(t.isNull() & s.isNull()).alias("p_neither"), F.count_if(t == s).alias("ambiguous"),
        rate(c("cw").isNotNull()).alias("p_touch_call"), rate(c("pw").isNotNull()).alias("p_touch_put"),
        rate(c("cw").isNotNull() & (c("pw").isNull() | (c("cw") < c("pw")))).alias("p_call_first"), rate(c("x").isNotNull()).alias("p_cross_flip"),
        rate(c("alive")).alias("p_range_survive"), F.avg(c("hi") / c("spot") - 1.0).alias("mean_mfe"), F.avg(c("lo") / c("spot") - 1.0).alias("mean_mae"),
        F.percentile("last", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("terminal_quantiles"),
    )


def residual_library(returns: DataFrame, session: str = "session_date", eps: float = 1e-8) -> DataFrame:
    """Per-session standardised returns (population sd, floored)."""
    w = Window.partitionBy(session)
    sd = F.stddev_pop("ret").over(w)
    z = (F.col("ret") - F.avg("ret").over(w)) / F.when(sd < eps, eps).otherwise(sd)
    return returns.filter(F.col("ret").isNotNull()).withColumn("residual", z)


def eligible_blocks(library: DataFrame, length: int, session: str = "session_date", order: str = "ts") -> DataFrame:
    """Rows that start a full block of `length` inside their session."""
    w = Window.partitionBy(session)
    r = library.select("*", F.row_number().over(w.orderBy(order)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    return r.filter(F.col("_r") + length - 1 <= F.col("_n")).drop("_r", "_n")


# -- sessions, drift, training ------------------------------------------------------------------------------------------
def session_bootstrap(sessions: DataFrame, n: int = 7, seed: int = SEED, session: str = "session_date") -> DataFrame:
    """(replica, session) membership of n bootstrap samples of whole sessions.

    Each replica draws N of N sessions with replacement: draw k takes the session whose place is a seeded md5 of
    (replica, k) modulo N. A session drawn more than once is a member once. The calendar bounds the sessions.
    """
    uniq = sessions.select(session).distinct()
    every = Window.partitionBy(F.lit(0))
    placed = uniq.select(session, (F.row_number().over(every.orderBy(session)) - 1).alias("_at"), F.count(F.lit(1)).over(every).alias("_n"))
    draws = placed.select("_n", F.col("_at").alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replica"))
    draws = draws.select("replica", F.pmod(uniform_hash(F.lit(seed), "replica", "_k"), F.col("_n")).alias("_at"))
    return draws.distinct().join(placed.select(session, "_at"), "_at").select("replica", session)


def bootstrap_predictions(train: DataFrame, score: DataFrame, names: Sequence[str], label: str, kind: str = "logistic", n: int = 7, session: str = "session_date", l2: float = 1.0) -> DataFrame:
    """score with `replicas`, the predictions of n models, each fitted on the sessions of one bootstrap sample, and `spread`
    (see ensemble_uncertainty). The samples are entries of one weight array, so a round fits all models in one pass."""
    members = session_bootstrap(train, n, session=session).groupBy(session).agg(F.collect_set("replica").alias("_in"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.coalesce(F.array_contains("_in", r), F.lit(False)).cast("double"))
    rows = train.join(F.broadcast(members), session, "left").select(*names, F.col(label).cast("double").alias(label), weights.alias("_w"))  # a row a session
    rows = materialized(rows, "replica-rows")
    prepared = prepare(rows, names, "_w", n)
    fits = [Fit(f"{r}", label, kind, r, l2=l2) for r in range(n)]
    beta = fit_many(rows, names, fits, "_w", prepared)
    scored = predict_many(score, names, fits, beta, prepared, "_fitted")
    replicas = F.array(*[F.col("_fitted")[f.name] for f in fits if f.name in beta]) if beta else F.array().cast("array<double>")
    return scored.select(*score.columns, replicas.alias("replicas"), ensemble_uncertainty(replicas, kind == "logistic").alias("spread"))


def population_stability(reference: DataFrame, current: DataFrame, value: str = "value", keys: Sequence[str] = ("name",), bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index per key over the reference's quantile bins: Σ(p−q)·ln(p/q)."""
    keys = list(keys)
    cuts = reference.groupBy(*keys).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("cuts"))

    def share(df: DataFrame, name: str) -> DataFrame:
        b = df.join(F.broadcast(cuts), keys).select(*keys, F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("bin"))
        n = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
        return n.select(*keys, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias(name))

    j = share(reference, "p").join(share(current, "q"), [*keys, "bin"], "full_outer")
    p, q = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(eps)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(eps))
    return j.groupBy(*keys).agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))


def drift_level(df: DataFrame, watch: float = 0.1, freeze: float = 0.25, min_skill: float = 0.0, max_fall: float = 0.5) -> DataFrame:
    """ok / watch / freeze / rollback from psi, brier_skill and expectancy_delta."""
    psi, skill, fall = F.col("psi"), F.col("brier_skill"), F.col("expectancy_delta") < -abs(max_fall)
    base = F.when(psi >= freeze, "freeze").when(psi >= watch, "watch").otherwise("ok")
    level = (
        F.when(fall, "rollback").when(skill < min_skill - 0.1, "rollback").when((skill < min_skill) & (base == "ok"), "freeze").otherwise(base)
    )
    return df.withColumn("level", level)
