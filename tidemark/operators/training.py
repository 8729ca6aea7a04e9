"""Training of a model group: six roles over walk-forward folds, fitted together, scored on held-out sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip
from tidemark.functions.tables import materialized
from tidemark.operators.fits import Fit, Prepared, exact_quantiles, fit_many, predict_many, prepare, rearranged
from tidemark.operators.journal import expanding_folds

# fixed values: role, label, kind
ROLES = (
    ("direction_30m", "up_30m", "classifier"),
    ("return_quantiles_30m", "fwd_return_30m", "quantile"),
    ("volatility", "remaining_realized_move", "regressor"),
    ("range_survive_close", "range_survive_close", "classifier"),
    ("touch_call_wall", "touch_call_wall_30m", "classifier"),
    ("touch_put_wall", "touch_put_wall_30m", "classifier"),
)
# fixed values: gates and quantiles
MIN_ROWS = 200
MIN_SESSIONS = 11
MIN_SKILL = 0.01
TAUS = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
SERVABLE = ("direction_30m", "return_quantiles_30m", "volatility")
FINAL = 0  # weight set of all sessions; fold f is set f + 1


@dataclass
class ModelGroup:
    """Coefficients of every trained role on all sessions, with what it takes to apply them, and the report."""

    names: tuple[str, ...]
    prepared: Prepared
    fits: list[Fit]
    beta: dict[str, np.ndarray]
    platt: dict[str, tuple[float, float]]
    trained: list[str] = field(default_factory=list)
    required: tuple[str, ...] = ()


def role_fits(role: str, label: str, kind: str, at: int) -> list[Fit]:
    if kind == "quantile":
        return [Fit(f"{role}|{at}|{q}", label, "quantile", at, tau, l2=1e-3) for q, tau in TAUS.items()]
    if kind == "regressor":
        return [Fit(f"{role}|{at}|q50", label, "quantile", at, 0.5, l2=1e-3)]
    # fixed values: C 0.1, even elastic net and balanced classes for the direction, ridge at C 1 for the others
    if role.startswith("direction"):
        return [Fit(f"{role}|{at}|p", label, "logistic", at, l1=5.0, l2=5.0, balanced=True)]
    return [Fit(f"{role}|{at}|p", label, "logistic", at, l2=1.0)]


def membership(rows: DataFrame, session: str, n_folds: int, calibration: float) -> tuple[DataFrame, int]:
    """rows with train, calibration (arrays over the weight sets) and test (fold of which the session is held out, null if
    none). The final set trains on all sessions but the last ones, which calibrate it. The session calendar is broadcast."""
    sessions = rows.select(F.col(session).alias("session_date")).distinct()
    folds = expanding_folds(sessions, n_folds=n_folds, calibration=calibration)
    nth = Window.partitionBy(F.lit(0)).orderBy("session_date")
    calendar = sessions.select("session_date", F.row_number().over(nth).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("of"))
    roles = folds.groupBy("session_date").agg(F.map_from_entries(F.collect_list(F.struct("fold", "role"))).alias("roles"))
    calendar = calendar.join(roles, "session_date", "left")
    enough = F.col("of") >= MIN_SESSIONS
    late = enough & (F.col("nth") > F.col("of") - F.greatest(F.lit(2), F.floor(F.col("of") * calibration)))
    gap = enough & (F.col("nth") == F.col("of") - F.greatest(F.lit(2), F.floor(F.col("of") * calibration)))  # embargo
    of = lambda f, what: enough & (F.coalesce(F.try_element_at("roles", F.lit(f)), F.lit("")) == what)
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    test = F.coalesce(*[F.when(of(f, "test"), f) for f in range(n_folds)])
    calendar = calendar.select(
        F.col("session_date").alias(session), F.array(number(~late & ~gap), *[number(of(f, "train")) for f in range(n_folds)]).alias("train"),
        F.array(number(late), *[number(of(f, "calibration")) for f in range(n_folds)]).alias("calibration"), test.alias("test"))
    # one row per session
    return materialized(rows.join(F.broadcast(calendar), session), "group-rows"), n_folds + 1


def train_group(observations: DataFrame, names: Sequence[str], roles: Sequence[tuple[str, str, str]] = ROLES, session: str = "session_date", id_col: str = "obs_id",
                min_rows: int = MIN_ROWS, n_folds: int = 4, calibration: float = 0.25, rounds: int = 25) -> tuple[DataFrame, DataFrame, ModelGroup]:
    """(report, out-of-fold predictions, group).

    observations: id, session, features (null or NaN is missing) and one label column per role. report: one row per role with
    trained, n_rows, reason (why it was skipped), fold_count, metrics (means over the folds of held-out scores, empty where no
    fold could be formed), skill (the least of the *_skill metrics against a constant that knows the held-out rows) and edge.
    A role needs min_rows labelled rows, a classifier both classes, folds MIN_SESSIONS sessions and min_rows training rows each.
    Predictions: (role, fold, id, session, y, name, value), name one of p, q10, q50, q90.
    All roles and folds are fitted in the same rounds of one job each (see fits.fit_many); labels of later sessions never
    reach a fold, and probabilities are calibrated on sessions after those of the fit where both classes occur there.
    """
    labels = [r[1] for r in roles]
    slim = observations.select(F.col(id_col).alias("obs_id"), session, *names, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(labels)])
    rows, sets = membership(slim, session, n_folds, calibration)
    counts = rows.agg(
        F.count_distinct(session).alias("sessions"), *[F.count(c).alias(f"n_{c}") for c in labels], *[F.min(c).alias(f"lo_{c}") for c in labels], *[F.max(c).alias(f"hi_{c}") for c in labels],
        *[F.sum(F.when(F.col(c).isNotNull(), F.col("train")[s] + F.col("calibration")[s])).alias(f"t_{c}_{s}") for c in labels for s in range(sets)],
        *[F.count(F.when(F.col("test") == s, F.col(c))).alias(f"v_{c}_{s}") for c in labels for s in range(n_folds)]).first()
    report, fits = [], []
    folds_of: dict[str, list[int]] = {}
    for role, label, kind in roles:
        n = counts[f"n_{label}"]
        reason = ""
        if n < min_rows:
            reason = f"{n} rows < {min_rows} minimum"
        elif kind == "classifier" and counts[f"lo_{label}"] == counts[f"hi_{label}"]:
            reason = f"single-class target (always {int(counts[f'lo_{label}'])}) over the training window"
        report.append([role, label, kind, n, reason])
        if not reason:
            folds_of[role] = [s for s in range(1, sets) if (counts[f"t_{label}_{s}"] or 0) >= min_rows and counts[f"v_{label}_{s - 1}"]] if counts.sessions >= MIN_SESSIONS else []
            for at in (FINAL, *folds_of[role]):
                fits += role_fits(role, label, kind, at)
    prepared = prepare(rows, names, "train", sets)
    beta = fit_many(rows, names, fits, "train", prepared, rounds)
    platt = calibrate(rows, names, fits, beta, prepared, rounds)
    group = ModelGroup(tuple(names), prepared, [f for f in fits if f.weight == FINAL], {k: v for k, v in beta.items() if k.split("|")[1] == str(FINAL)}, platt)
    group.trained = [r[0] for r in report if not r[4] and any(f.name in beta for f in role_fits(r[0], r[1], r[2], FINAL))]
    held = held_out(rows.filter("test IS NOT NULL"), names, roles, fits, beta, platt, prepared, session)
    held = materialized(held, "held-out")
    scores = fold_metrics(held, roles)
    spark = observations.sparkSession
    base = spark.createDataFrame(
        [(role, label, kind, n, reason or ("" if role in group.trained else "fit failed: no varied training rows"), role in group.trained) for role, label, kind, n, reason in report],
        "role string, label string, kind string, n_rows long, reason string, trained boolean")
    means = scores.groupBy("role", "metric").agg(F.avg("value").alias("value")).groupBy("role").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("oof_"), "metric"), "value"))).alias("metrics"),
        F.min(F.when(F.col("metric").endswith("_skill"), F.col("value"))).alias("skill"))
    n_scored = scores.groupBy("role").agg(F.count_distinct("fold").cast("int").alias("fold_count"))
    out = base.join(F.broadcast(means), "role", "left").join(F.broadcast(n_scored), "role", "left")  # a row a role
    return out.select(
        "role", "label", "kind", "n_rows", "trained", "reason", F.coalesce("fold_count", F.lit(0)).alias("fold_count"),
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"), "skill", F.coalesce(F.col("skill") >= MIN_SKILL, F.lit(False)).alias("edge")), held, group


def calibrate(rows: DataFrame, names: Sequence[str], fits: Sequence[Fit], beta: dict, prepared: Prepared, rounds: int) -> dict[str, tuple[float, float]]:
    """(slope, intercept) on the logit for the logistic fits whose calibration sessions hold both classes: all in one more
    run of rounds, with the models' own scores as the only feature."""
    todo = [f for f in fits if f.kind == "logistic" and f.name in beta]
    if not todo:
        return {}
    scored = predict_many(rows, names, todo, beta, prepared)
    p = {f.name: clip(F.col("fitted")[f.name], 1e-6, 1 - 1e-6) for f in todo}
    cols = {f"s{k}": F.ln(p[f.name] / (1 - p[f.name])) for k, f in enumerate(todo)}
    late = F.exists("calibration", lambda w: w > 0)
    logits = materialized(scored.filter(late).select(*sorted({f.label for f in todo}), "calibration", *[c.alias(n) for n, c in cols.items()]), "logits")
    sets, own = prepared.median.shape[0], [f"s{k}" for k in range(len(todo))]
    plain = Prepared(tuple(own), np.zeros((sets, len(own))), np.zeros((sets, len(own))), np.ones((sets, len(own))))
    curves = [Fit(f.name, f.label, "logistic", f.weight, columns=(0, 1 + k)) for k, f in enumerate(todo)]
    got = fit_many(logits, own, curves, "calibration", plain, rounds)
    return {name: (float(b[1]), float(b[0])) for name, b in got.items()}


def calibrated(p: Column, at: tuple[float, float] | None) -> Column:
    if at is None:
        return p
    q = clip(p, 1e-6, 1 - 1e-6)
    return 1.0 / (1.0 + F.exp(-(at[0] * F.ln(q / (1 - q)) + at[1])))


def role_values(role: str, label: str, kind: str, at: int, beta: dict, platt: dict, source: str = "fitted") -> dict[str, Column]:
    """Predictions of a role by the fits of a weight set, from the map of predict_many; empty where it has no fit."""
    got = lambda q: F.col(source)[f"{role}|{at}|{q}"]
    have = [f for f in role_fits(role, label, kind, at) if f.name in beta]
    if not have:
        return {}
    if kind == "quantile":
        return dict(zip(TAUS, rearranged([got(q) for q in TAUS])))
    if kind == "regressor":
        return {"q50": F.greatest(got("q50"), F.lit(0.0))}
    return {"p": calibrated(got("p"), platt.get(have[0].name))}


def held_out(rows: DataFrame, names: Sequence[str], roles, fits: Sequence[Fit], beta: dict, platt: dict, prepared: Prepared, session: str) -> DataFrame:
    """(role, fold, obs_id, session, y, name, value) of the rows whose session a fold holds out."""
    folds = [f for f in fits if f.weight != FINAL and f.name in beta]
    scored = predict_many(rows.withColumn("own_sets", F.array(F.col("test") + 1)), names, folds, beta, prepared, use="own_sets")
    entries = []
    for role, label, kind in roles:
        for at in sorted({f.weight for f in folds}):
            for name, value in role_values(role, label, kind, at, beta, platt).items():
                entries.append(F.when((F.col("test") == at - 1) & F.col(label).isNotNull(), F.struct(
                    F.lit(role).alias("role"), F.lit(at - 1).alias("fold"), F.col(label).alias("y"), F.lit(name).alias("name"), value.alias("value"))))
    if not entries:
        empty = "role string, fold int, obs_id string, y double, name string, value double"
        return rows.sparkSession.createDataFrame([], empty).withColumn(session, F.lit(None).cast("date"))
    return scored.select("obs_id", session, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select(
        "e.role", "e.fold", "obs_id", session, "e.y", "e.name", "e.value")


def fold_metrics(held: DataFrame, roles: Sequence[tuple[str, str, str]] = ROLES) -> DataFrame:
    """(role, fold, metric, value): Brier, pinball or absolute losses of the held-out rows, and skill against a constant that
    knows them (base rate, quantile, median); no skill where the constant is perfect."""
    kinds = held.join(F.broadcast(held.sparkSession.createDataFrame([(r, k) for r, _, k in roles], "role string, kind string")), "role")
    tau = F.when(F.col("name") == "q10", 0.1).when(F.col("name") == "q90", 0.9).otherwise(0.5)
    flat = exact_quantiles(kinds.filter("kind != 'classifier'").withColumn("tie", F.xxhash64("obs_id")), ["role", "fold", "name"], "y", list(TAUS.values()), "tie")
    flat = flat.select("role", "fold", "name", F.col("tau").alias("t"), F.col("quantile").alias("flat"))
    rows = kinds.withColumn("t", tau).join(flat, ["role", "fold", "name", "t"], "left")
    loss = lambda r: F.when(F.col("kind") == "quantile", F.greatest(F.col("t") * r, (F.col("t") - 1) * r)).when(F.col("kind") == "regressor", F.abs(r)).otherwise(r * r)
    g = rows.groupBy("role", "fold", "kind", "name").agg(
        F.avg(loss(F.col("y") - F.col("value"))).alias("loss"), F.avg(loss(F.col("y") - F.col("flat"))).alias("flat_loss"), F.avg("y").alias("mean"))
    base = F.when(F.col("kind") == "classifier", F.col("mean") * (1 - F.col("mean"))).otherwise(F.col("flat_loss"))
    metric = F.when(F.col("kind") == "classifier", "brier").when(F.col("kind") == "regressor", "mae").otherwise(F.concat(F.lit("pinball_"), "name"))
    entries = F.array(
        F.struct(metric.alias("metric"), F.col("loss").alias("value")), F.when(base > 0, F.struct(F.concat(metric, F.lit("_skill")).alias("metric"), (1 - F.col("loss") / base).alias("value"))),
        F.when(F.col("kind") == "classifier", F.struct(F.lit("base_rate").alias("metric"), F.col("mean").alias("value"))))
    return g.select("role", "fold", F.inline(F.filter(entries, lambda e: e.isNotNull())))


def serve_group(rows: DataFrame, group: ModelGroup, roles: Sequence[tuple[str, str, str]] = ROLES) -> DataFrame:
    """rows with `forecast` (role → name → value of every trained role), `served` and `reason`.

    Fail closed: no forecast where the group has none of the roles that serving needs, or where a required input of the row
    is missing; the reason says which.
    """
    scored = predict_many(rows, list(group.names), group.fits, group.beta, group.prepared)
    parts = []
    for role, label, kind in roles:
        values = role_values(role, label, kind, FINAL, group.beta, group.platt) if role in group.trained else {}
        if values:
            parts += [F.lit(role), F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])]
    empty = F.create_map().cast("map<string,map<string,double>>")
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in group.required]), lambda c: c.isNotNull()) if group.required else F.array().cast("array<string>")
    servable = bool(set(group.trained) & set(SERVABLE))
    reason = F.when(~F.lit(servable), F.lit("no servable role")).when(F.size(missing) > 0, F.concat(F.lit("missing required: "), F.array_join(missing, ",")))
    return scored.select(
        *rows.columns, F.when(reason.isNull(), F.create_map(*parts) if parts else empty).otherwise(empty).alias("forecast"), reason.isNull().alias("served"), reason.alias("reason"))
