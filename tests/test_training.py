"""Joint fits and group training against fits and scores made row by row in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

NAMES = ["x0", "x1", "x2"]


def frame(n: int = 900, sessions: int = 30, seed: int = 3):
    import datetime as dt

    import pandas as pd

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    noise = rng.normal(size=n)
    ret = 0.4 * x[:, 0] - 0.2 * x[:, 1] + (0.3 + 0.2 * np.abs(x[:, 2])) * noise
    out = pd.DataFrame(x, columns=NAMES)
    out["obs_id"] = [f"o{k}" for k in range(n)]
    out["session_date"] = [dt.date(2024, 1, 1) + dt.timedelta(days=int(k * sessions / n)) for k in range(n)]
    out["fwd_return_30m"], out["up_30m"] = ret, (ret > 0).astype(int)
    out["remaining_realized_move"] = np.abs(ret) + 0.1 * np.abs(x[:, 1])
    out["range_survive_close"], out["touch_call_wall_30m"], out["touch_put_wall_30m"] = (np.abs(ret) < 0.4).astype(int), (ret > 0.5).astype(int), 1
    out.loc[::7, "x1"] = np.nan
    return out


def design(values, keep):
    gone = ~np.isfinite(values)
    known = np.where(gone, np.nan, values)[keep]
    med, mean, sd = np.nanmedian(known, axis=0), np.nanmean(known, axis=0), np.nanstd(known, axis=0)
    return np.hstack((np.ones((len(values), 1)), (np.where(gone, med, values) - mean) / sd, gone.astype(float)))


def logistic(x, y, l1, l2, w):
    """Proximal gradient on the same objective."""
    beta, free = np.zeros(x.shape[1]), np.r_[0.0, np.ones(x.shape[1] - 1)]
    step = 1.0 / (np.linalg.norm(x * np.sqrt(w / 4)[:, None], 2) ** 2 + l2)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta - step * (x.T @ (w * (p - y)) + l2 * free * beta)
        beta = np.sign(beta) * np.maximum(np.abs(beta) - step * l1 * free, 0)
    return beta


@pytest.fixture(scope="module")
def data(spark):
    pdf = frame()
    return pdf, spark.createDataFrame(pdf)


def test_fits_equal_numpy(spark, data):
    from tidemark.operators.fits import Fit, fit_many, prepare

    pdf, df = data
    weights = F.array(F.lit(1.0), (F.substring("obs_id", 2, 9).cast("int") % 3 != 0).cast("double"))
    rows = df.withColumn("w", weights)
    fits = [Fit("l0", "up_30m", "logistic", 0, l1=5.0, l2=5.0, balanced=True), Fit("l1", "up_30m", "logistic", 1, l2=1.0), Fit("s", "fwd_return_30m", "square", 1),
            Fit("one", "touch_put_wall_30m", "logistic"), *[Fit(f"q{t}", "fwd_return_30m", "quantile", 0, t) for t in (0.1, 0.5, 0.9)]]
    prepared = prepare(rows, NAMES, "w", 2)
    beta = fit_many(rows, NAMES, fits, "w", prepared)
    assert "one" not in beta  # a single class has no fit
    keep = np.arange(len(pdf)) % 3 != 0
    x0, x1, y = design(pdf[NAMES].to_numpy(), np.ones(len(pdf), bool)), design(pdf[NAMES].to_numpy(), keep), pdf["up_30m"].to_numpy()
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    assert np.allclose(beta["l0"], logistic(x0, y, 5.0, 5.0, balance), atol=5e-3)
    assert np.allclose(beta["l1"], logistic(x1[keep], y[keep], 0.0, 1.0, np.ones(keep.sum())), atol=5e-3)  # a median of an even number is one of the middle pair
    assert np.allclose(beta["s"], np.linalg.lstsq(x1[keep], pdf["fwd_return_30m"].to_numpy()[keep], rcond=None)[0], atol=5e-3)
    for t in (0.1, 0.5, 0.9):
        assert abs((pdf["fwd_return_30m"].to_numpy() <= x0 @ beta[f"q{t}"]).mean() - t) < 0.02


def test_exact_quantiles(spark, data):
    from tidemark.operators.fits import exact_quantiles

    pdf, df = data
    got = exact_quantiles(df.withColumn("g", F.substring("obs_id", 2, 9).cast("int") % 2).withColumn("tie", F.xxhash64("obs_id")), ["g"], "fwd_return_30m", [0.05, 0.5, 0.93], "tie").collect()
    for r in got:
        assert abs(r.quantile - np.quantile(pdf["fwd_return_30m"][r.g::2], r.tau)) < 1e-12
    assert len(got) == 6


def test_train_group(spark, data):
    from tidemark.operators.training import serve_group, train_group

    pdf, df = data
    report, held, group = train_group(df, NAMES, rounds=14)
    rows = {r.role: r for r in report.collect()}
    assert len(rows) == 6 and not rows["touch_put_wall"].trained and rows["touch_put_wall"].reason == "single-class target (always 1) over the training window"
    assert all(r.trained and r.n_rows == 900 and r.fold_count == 4 and not r.reason for k, r in rows.items() if k != "touch_put_wall")
    assert rows["direction_30m"].edge and rows["return_quantiles_30m"].edge and rows["direction_30m"].skill > 0.1
    out = held.toPandas()
    # a fold only holds out sessions after its own training sessions, once each
    assert not out.duplicated(["role", "obs_id", "name"]).any() and out["session_date"].min() > sorted(pdf["session_date"].unique())[8]

    def mean_of(role, name, score):
        part = out[(out.role == role) & (out.name == name)]
        return np.mean([score(g["y"].to_numpy(), g["value"].to_numpy()) for _, g in part.groupby("fold")])

    brier = lambda y, p: ((y - p) ** 2).mean()
    m = rows["direction_30m"].metrics
    assert abs(m["oof_brier"] - mean_of("direction_30m", "p", brier)) < 1e-9
    assert abs(m["oof_brier_skill"] - mean_of("direction_30m", "p", lambda y, p: 1 - brier(y, p) / brier(y, y.mean()))) < 1e-9
    q = rows["return_quantiles_30m"].metrics
    for name, t in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
        pin = lambda y, p, t=t: np.maximum(t * (y - p), (t - 1) * (y - p)).mean()
        assert abs(q[f"oof_pinball_{name}"] - mean_of("return_quantiles_30m", name, pin)) < 1e-9
        assert abs(q[f"oof_pinball_{name}_skill"] - mean_of("return_quantiles_30m", name, lambda y, p, t=t, pin=pin: 1 - pin(y, p) / pin(y, np.quantile(y, t)))) < 1e-9
    v = rows["volatility"].metrics
    assert abs(v["oof_mae_skill"] - mean_of("volatility", "q50", lambda y, p: 1 - np.abs(y - p).mean() / np.abs(y - np.median(y)).mean())) < 1e-9
    wide = out[out.role == "return_quantiles_30m"].pivot(index="obs_id", columns="name", values=["value", "y"])
    for name, t in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
        assert abs((wide["y"][name] <= wide["value"][name]).mean() - t) < 0.05
    assert (wide["value"]["q10"] <= wide["value"]["q50"]).all() and (wide["value"]["q50"] <= wide["value"]["q90"]).all()

    served = serve_group(df, group).select("served", "forecast", "reason").collect()
    assert all(r.served and set(r.forecast) == set(group.trained) and set(r.forecast["return_quantiles_30m"]) == {"q10", "q50", "q90"} for r in served)
    group.required = ("x1",)
    closed = serve_group(df, group).filter("NOT served").select("forecast", "reason").collect()
    assert len(closed) == -(-900 // 7) and all(not r.forecast and r.reason == "missing required: x1" for r in closed)
    group.trained = ["touch_call_wall"]
    assert {r.reason for r in serve_group(df, group).select("reason").collect()} == {"no servable role"}


def test_gates(spark, data):
    from tidemark.operators.training import train_group

    _, df = data
    report, held, _ = train_group(df.filter("session_date < '2024-01-11'"), NAMES, rounds=6)
    rows = {r.role: r for r in report.collect()}
    assert rows["direction_30m"].trained and rows["direction_30m"].metrics == {} and rows["direction_30m"].skill is None and not rows["direction_30m"].edge
    assert held.count() == 0
    few = {r.role: r for r in train_group(df.limit(150), NAMES)[0].collect()}
    assert all(not r.trained and r.reason == "150 rows < 200 minimum" for r in few.values())


def test_quantile_forecasts_cover(spark, data):
    from tidemark.operators.forecast import fill_concession, return_quantiles

    _, df = data
    big = spark.createDataFrame(frame(4000, 30, 11))
    place = F.substring("obs_id", 2, 9).cast("int")
    q = return_quantiles(big.filter(place % 2 == 0), big.filter(place % 2 == 1), NAMES, "fwd_return_30m").toPandas()
    for name, t in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
        assert abs((q["fwd_return_30m"] <= q[name]).mean() - t) < 0.03
    assert (q["q10"] <= q["q50"]).all() and (q["q50"] <= q["q90"]).all()
    f = fill_concession(df.withColumn("prior", F.lit(0.5)), df.withColumn("prior", F.lit(0.5)), NAMES, "remaining_realized_move").first()
    pdf = frame()
    assert np.allclose([f.q10, f.q50, f.q90], np.quantile(pdf["remaining_realized_move"], [0.1, 0.5, 0.9]))


def test_replicas_equal_separate_fits(spark, data):
    from tidemark.operators.fits import Fit, fit_many, predict_many, prepare
    from tidemark.operators.forecast import bootstrap_predictions, session_bootstrap

    _, df = data
    out = bootstrap_predictions(df, df.select("obs_id", *NAMES), NAMES, "up_30m", n=3).toPandas().set_index("obs_id")
    assert out["spread"].between(0, 1).all() and (out["replicas"].map(len) == 3).all()
    members = session_bootstrap(df, 3)
    for r in range(3):
        part = df.join(members.filter(F.col("replica") == r), "session_date").withColumn("w", F.array(F.lit(1.0)))
        prepared = prepare(part, NAMES, "w", 1)
        one = [Fit("m", "up_30m", "logistic", l2=1.0)]
        alone = predict_many(df.select("obs_id", *NAMES), NAMES, one, fit_many(part, NAMES, one, "w", prepared), prepared).toPandas().set_index("obs_id")
        assert np.allclose(alone["fitted"].map(lambda m: m["m"]).loc[out.index], out["replicas"].map(lambda x: x[r]), atol=1e-4)  # noqa: B023


def test_class_calibration(spark):
    import pandas as pd

    from tidemark.operators.forecast import regime_probabilities

    rng = np.random.default_rng(8)
    label = rng.integers(0, 3, 1500)
    x = rng.normal(size=(1500, 2)) + np.stack((label == 1, label == 2), axis=1) * 1.5
    # later rows are noisier, so the fitted probabilities are too sure of themselves
    x[600:] += rng.normal(size=(900, 2)) * 1.5
    pdf = pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "label": label, "k": range(1500), "session": np.arange(1500) % 50})
    df = spark.createDataFrame(pdf)
    train, later, test = df.filter("k < 600"), df.filter("k between 600 and 1099"), df.filter("k >= 1100")
    loss = {}
    for name, how in (("raw", {}), ("calibrated", {"later": later, "session": "session"})):
        out = regime_probabilities(train, test, ["x0", "x1"], "label", 4, **how).toPandas()
        p = np.stack(out["probs"].to_numpy())
        assert p.shape[1] == 4 and np.allclose(p.sum(axis=1), 1) and (p[:, 3] < 1e-3).all()
        loss[name] = -np.log(np.maximum(p[np.arange(len(p)), out["label"]], 1e-9)).mean()
    assert loss["calibrated"] < loss["raw"] - 0.01
    assert np.allclose(out["support_uncertainty"], 1 - 50 / 90, atol=2e-3)
