"""Many linear models in one pass: logistic, quantile and squared-error fits by reweighted normal equations.

A round is one job over the rows. Every partition adds up, for each model, the weighted normal equations of its rows; the
sums meet per model, and only these (features² numbers a model) come to the driver, which solves them. Rows count for a model
with their entry in a weight array, so folds, bootstrap replicas and roles are fitted together and no row is copied for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import ranked


@dataclass(frozen=True)
class Fit:
    """One model: kind is logistic, quantile (of tau) or square; rows weigh weights[weight]. l1 and l2 are penalties on the
    summed loss; the first column, the intercept, has none. balanced: both classes weigh the same in sum."""

    name: str
    label: str
    kind: str
    weight: int = 0
    tau: float = 0.5
    l1: float = 0.0
    l2: float = 1e-6
    balanced: bool = False
    columns: tuple[int, ...] = ()  # columns of the design that it uses; all if empty


@dataclass(frozen=True)
class Prepared:
    """Medians, centres and scales of the features in each weight set, from the set's own rows."""

    names: tuple[str, ...]
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, values: np.ndarray, at: int) -> np.ndarray:
        """[1, standardised values, missing flags] for a weight set; a missing value is the set's median."""
        gone = ~np.isfinite(values)
        filled = np.where(gone, self.median[at], values)
        return np.hstack((np.ones((len(values), 1)), (filled - self.mean[at]) / self.scale[at], gone.astype(float)))


def prepare(rows: DataFrame, names: Sequence[str], weights: str, sets: int) -> Prepared:
    """One aggregate over all rows: a median (percentile_approx at its finest accuracy), mean and deviation for each feature and weight set."""
    aggs = []
    for s in range(sets):
        for n in names:
            v = F.when(F.col(weights)[s] > 0, F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")))
            aggs += [F.percentile_approx(v, 0.5, 100_000).alias(f"m_{s}_{n}"), F.avg(v).alias(f"a_{s}_{n}"), F.stddev_pop(v).alias(f"d_{s}_{n}")]
    got = rows.agg(*aggs).first()
    table = lambda kind, none: np.array([[none if (x := got[f"{kind}_{s}_{n}"]) is None else x for n in names] for s in range(sets)], dtype=float)
    scale = table("d", 0.0)
    return Prepared(tuple(names), table("m", 0.0), table("a", 0.0), np.where(scale > 1e-12, scale, 1.0))


def matrix(frame, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([frame[n].to_numpy(dtype=float) for n in names]) if len(names) else np.zeros((len(frame), 0))


def equations(fit: Fit, x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, width: float, classes: tuple[float, float]) -> np.ndarray:
    """Flat normal equations (X'WX, X'Wz) and loss of the rows at the present coefficients."""
    score = x @ beta
    if fit.kind == "logistic":
        if fit.balanced:
            w = w * np.where(y > 0.5, classes[1], classes[0])
        p = 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30)))
        v = np.maximum(p * (1.0 - p), 1e-6)
        weight, target = w * v, score + (y - p) / v
        loss = -(w * np.where(y > 0.5, np.log(np.maximum(p, 1e-300)), np.log(np.maximum(1 - p, 1e-300)))).sum()
    elif fit.kind == "quantile":
        r = y - score
        # width keeps the weights of rows on the line finite and shrinks from round to round
        weight, target = w * np.where(r >= 0, fit.tau, 1.0 - fit.tau) / np.maximum(np.abs(r), width), y
        loss = (w * np.maximum(fit.tau * r, (fit.tau - 1.0) * r)).sum()
    else:
        weight, target = w, y
        loss = (w * (y - score) ** 2).sum() / 2
    xw = x * weight[:, None]
    return np.concatenate(((xw.T @ x).ravel(), xw.T @ target, [loss, w.sum()]))


def solve(fit: Fit, flat: np.ndarray, d: int, beta: np.ndarray) -> np.ndarray:
    """Coefficients of the penalised normal equations: elastic net by coordinate descent, ridge directly."""
    h, b = flat[:d * d].reshape(d, d), flat[d * d:d * d + d]
    free = np.r_[0.0, np.ones(d - 1)]
    if fit.l1 <= 0:
        return np.linalg.lstsq(h + np.diag(fit.l2 * free), b, rcond=None)[0]
    beta = beta.copy()
    for _ in range(500):
        before = beta.copy()
        for j in range(d):
            rest = b[j] - h[j] @ beta + h[j, j] * beta[j]
            below = h[j, j] + fit.l2 * free[j]
            beta[j] = 0.0 if below <= 0 else np.sign(rest) * max(abs(rest) - fit.l1 * free[j], 0.0) / below
        if np.abs(beta - before).max() < 1e-10:
            break
    return beta


def fit_many(rows: DataFrame, names: Sequence[str], fits: Sequence[Fit], weights: str, prepared: Prepared, rounds: int = 25, tolerance: float = 1e-5) -> dict[str, np.ndarray]:
    """Coefficients of every fit by name, in the order of Prepared.design. Rows with a null label or no weight don't count
    for a fit; a fit without rows, or a logistic one with one class, has no entry. `weights` is an array column."""
    if not fits:
        return {}
    wide = tuple(range(1 + 2 * len(names)))
    labels = sorted({f.label for f in fits})
    counts = rows.agg(*[
        F.sum(F.when(F.col(f.label).isNotNull() & (~F.lit(f.kind == "logistic") | (F.col(f.label) == value)), F.col(weights)[f.weight])).alias(f"{k}_{value}")
        for k, f in enumerate(fits) for value in (0, 1)], *[F.stddev_pop(F.when(F.col(weights)[f.weight] > 0, F.col(f.label).cast("double"))).alias(f"s_{k}") for k, f in enumerate(fits)]).first()
    live, classes, spread = [], {}, {}
    for k, f in enumerate(fits):
        zero, one = counts[f"{k}_0"] or 0.0, counts[f"{k}_1"] or 0.0
        if zero > 0 and one > 0:
            live.append(f)
            classes[f.name], spread[f.name] = ((zero + one) / (2 * zero), (zero + one) / (2 * one)), max(counts[f"s_{k}"] or 0.0, 1e-12)
    beta = {f.name: np.zeros(len(f.columns or wide)) for f in live}
    open_ = {f.name for f in live}
    slim = rows.select(*names, *labels, weights)
    for n in range(rounds):
        todo = [f for f in live if f.name in open_]
        if not todo:
            break
        now = {f.name: beta[f.name] for f in todo}
        width = {f.name: spread[f.name] * max(1e-6, 0.3 * 0.5**n) for f in todo}
        kind = {f.name: "square" if f.kind == "quantile" and n == 0 else f.kind for f in todo}

        def add(batches, todo=todo, now=now, width=width, kind=kind):
            import pandas as pd

            total: dict[str, np.ndarray] = {}
            for frame in batches:
                values, counted = matrix(frame, names), np.stack(frame[weights].to_numpy()).astype(float) if len(frame) else None
                designs: dict[int, np.ndarray] = {}
                for f in todo:
                    if counted is None:
                        continue
                    y, w = frame[f.label].to_numpy(dtype=float), counted[:, f.weight]
                    use = np.isfinite(y) & (w > 0)
                    if use.any():
                        if f.weight not in designs:
                            designs[f.weight] = prepared.design(values, f.weight)
                        start = Fit(f.name, f.label, kind[f.name], f.weight, f.tau, balanced=f.balanced)
                        part = equations(start, designs[f.weight][use][:, list(f.columns or wide)], y[use], w[use], now[f.name], width[f.name], classes[f.name])
                        total[f.name] = total.get(f.name, 0.0) + part
            if total:
                yield pd.DataFrame({"name": list(total), "part": [v.tolist() for v in total.values()]})

        parts = slim.mapInPandas(add, "name string, part array<double>").select("name", array_to_vector("part").alias("part"))
        sums = {r.name: r.total.toArray() for r in parts.groupBy("name").agg(Summarizer.sum(F.col("part")).alias("total")).collect()}
        for f in todo:
            after = solve(f, sums[f.name], len(f.columns or wide), now[f.name])
            moved = np.abs(after - now[f.name]).max() / max(1.0, np.abs(after).max())
            beta[f.name] = after
            if moved < tolerance or f.kind == "square":
                open_.discard(f.name)
    return beta


def predict_many(rows: DataFrame, names: Sequence[str], fits: Sequence[Fit], beta: dict[str, np.ndarray], prepared: Prepared, out: str = "fitted", use: str | None = None) -> DataFrame:
    """rows with `out`, a map of fit name to prediction: a probability for a logistic fit, else a value. use: a column of
    weight sets, so that a row is scored by the fits of its own sets only."""
    known = [f for f in fits if f.name in beta]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{out}` map<string,double>"

    def score(batches):
        for frame in batches:
            values = matrix(frame, names)
            cols = {}
            for f in known:
                x = prepared.design(values, f.weight)
                s = (x[:, list(f.columns)] if f.columns else x) @ beta[f.name]
                cols[f.name] = 1.0 / (1.0 + np.exp(-np.clip(s, -30, 30))) if f.kind == "logistic" else s
            sets = None if use is None else frame[use].tolist()
            yield frame.assign(**{out: [{f.name: float(cols[f.name][i]) for f in known if sets is None or f.weight in sets[i]} for i in range(len(frame))]})

    return rows.mapInPandas(score, schema)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, taus: Sequence[float], tie: str) -> DataFrame:
    """(keys, tau, quantile): linear interpolation between order statistics found by distributed ranks, so a group may hold
    all rows. Null values don't count."""
    taus_col = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    r = ranked(df.filter(F.col(value).isNotNull()).select(*keys, value, tie), keys, value, [tie])
    near = r.select(*keys, value, "rank", "n", taus_col).withColumn("h", (F.col("n") - 1) * F.col("tau") + 1)
    near = near.filter((F.col("rank") == F.floor("h")) | (F.col("rank") == F.least(F.floor("h") + 1, F.col("n"))))
    low, high = F.min(F.struct("rank", value)), F.max(F.struct("rank", value))
    g = near.groupBy(*keys, "tau").agg(low.alias("lo"), high.alias("hi"), F.max(F.col("h") - F.floor("h")).alias("f"))
    a, b = F.col("lo")[value], F.col("hi")[value]
    return g.select(*keys, "tau", (a + F.col("f") * (b - a)).alias("quantile"))


def rearranged(values: Sequence[Column]) -> list[Column]:
    """Quantile predictions of a row in ascending order, so they never cross."""
    ordered = F.sort_array(F.array(*values))
    return [ordered[i] for i in range(len(values))]
