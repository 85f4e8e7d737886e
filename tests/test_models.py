"""Splits, metrics, regression and registry against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import backtest, diagnose, ordered, registry, regress
from tidemark.plans import training
from tidemark.operators.backtest import (
    InfeasibleSplit,
    LinearModel,
    RollingOrigin,
    SeasonalNaive,
    WeatherResponse,
)


@pytest.fixture(scope="module")
def frame(spark):
    """400 hours with temperature, a collinear pair and a daily shape."""
    rng = np.random.default_rng(3)
    n = 400
    t = 12 + 8 * np.sin(np.arange(n) * 2 * np.pi / 240) + rng.normal(0, 2, n)
    y = 1000 + 40 * np.maximum(0, 15.5 - t) + 90 * np.sin(np.arange(n) * 2 * np.pi / 24) + rng.normal(0, 5, n)
    pdf = pd.DataFrame(
        {
            "ix": np.arange(n),
            "timestamp_utc": pd.date_range("2024-01-01", periods=n, freq="h"),
            "temperature_2m": t,
            "x2": rng.normal(0, 1, n),
            "flag": (np.arange(n) % 5 == 0).astype(float),
            "y": y,
        }
    )
    pdf["not_flag"] = 1.0 - pdf["flag"]
    return spark.createDataFrame(pdf).cache(), pdf


def score(spark, pairs, names):
    return metrics.score(spark.createDataFrame(pairs, "y_true double, y_pred double"), names).first()


def test_metric_values(spark):
    got = score(spark, [(100.0, 110.0), (200.0, 190.0), (50.0, 50.0)], ("mae", "rmse", "mape", "wape"))
    assert got["mae"] == pytest.approx(20 / 3)
    assert got["rmse"] == pytest.approx((200 / 3) ** 0.5)
    assert got["mape"] == pytest.approx((0.1 + 0.05) / 3)
    assert got["wape"] == pytest.approx(20 / 350)


@pytest.mark.parametrize(
    "pairs,name",
    [([], "mae"), ([(1.0, None)], "mae"), ([(float("nan"), 1.0)], "rmse"), ([(0.0, 1.0)], "mape"), ([(0.0, 1.0)], "wape")],
)
def test_metric_guards(spark, pairs, name):
    with pytest.raises(Exception):
        score(spark, pairs, (name,))


def test_metric_registry(spark):
    metrics.register("bias", lambda y, p: F.avg(y - p))
    assert score(spark, [(3.0, 1.0)], ("bias",))["bias"] == 2.0
    metrics.METRICS.pop("bias")
    with pytest.raises(KeyError):
        metrics.resolve(["nope"])


@pytest.mark.parametrize("n,train,test,step,gap,fixed", [
    (100, 30, 10, 10, 0, False), (100, 30, 10, 7, 3, True), (41, 30, 10, 5, 1, False), (97, 10, 20, 3, 0, True),
])
def test_split_laws(spark, n, train, test, step, gap, fixed):
    split = RollingOrigin(train, test, step, gap, fixed)
    want = []
    for origin in range(train + gap, n - test + 1, step):
        end = origin - gap
        want.append((end - train if fixed else 0, end, origin, origin + test))
    assert [tuple(r)[1:] for r in split.plan(spark, n).orderBy("fold_index").collect()] == want
    rows = spark.range(n).select(F.col("id").alias("ix"))
    tests = {tuple(r) for r in backtest.test_rows(rows, split, split.folds(n)).select("fold_index", "ix").collect()}
    assert tests == {(i, ix) for i, (_, _, c, d) in enumerate(want) for ix in range(c, d)}
    trains = {tuple(r) for r in backtest.train_rows(rows, split, split.folds(n)).select("fold_index", "ix").collect()}
    assert trains == {(i, ix) for i, (a, b, _, _) in enumerate(want) for ix in range(a, b)}


def test_split_errors():
    with pytest.raises(InfeasibleSplit):
        RollingOrigin(30, 10, 10, 1).folds(40)
    with pytest.raises(ValueError):
        RollingOrigin(0, 1, 1)


def design_matrix(pdf, columns):
    return np.column_stack([np.ones(len(pdf)), pdf[list(columns)].to_numpy()])


@pytest.mark.parametrize("features", [("temperature_2m", "x2"), ("temperature_2m", "flag", "not_flag")])
def test_ols_matches_lstsq(frame, features):
    df, pdf = frame
    fit = regress.fit_ols(df, features, "y").first()
    want = np.linalg.lstsq(design_matrix(pdf, features), pdf["y"], rcond=None)[0]
    # Collinear one-hots get the minimum-norm solution.
    assert fit["coefficients"] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-6)
    resid = pdf["y"] - design_matrix(pdf, features) @ want
    assert fit["r_squared"] == pytest.approx(1 - (resid**2).sum() / ((pdf["y"] - pdf["y"].mean()) ** 2).sum())
    assert fit["n_obs"] == len(pdf)


def test_wide_and_narrow_moments_agree(frame, monkeypatch):
    df, _ = frame
    keyed = df.withColumn("g", F.col("ix") % 3)
    features = ["temperature_2m", "x2", "flag"]
    narrow = regress.moments(keyed, features, "y", ["g"]).orderBy("g").collect()
    monkeypatch.setattr(regress, "SQL_MOMENT_COLUMNS", 1)
    wide = regress.moments(keyed, features, "y", ["g"]).orderBy("g").collect()
    for a, b in zip(narrow, wide, strict=True):
        assert a["g"] == b["g"] and a["packed"] == pytest.approx(b["packed"], rel=1e-9)


def test_rows_with_nulls_weigh_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 9.0), (3.0, None)], "x double, y double")
    fit = regress.fit_ols(df, ["x"], "y").first()
    assert fit["coefficients"] == pytest.approx([0.0, 2.0], abs=1e-9) and fit["n_obs"] == 2


def test_weather_response_matches_numpy(frame):
    df, pdf = frame
    wide, names = regress.weather_response_design(df, diurnal=3, weekly=2)
    fit = regress.fit_ols(wide, names, "y").first()
    hours = (pdf["timestamp_utc"] - pd.Timestamp("1970-01-01")) / pd.Timedelta(hours=1)
    cols = [np.ones(len(pdf)), np.maximum(0, 15.5 - pdf["temperature_2m"]), np.maximum(0, pdf["temperature_2m"] - 22)]
    for period, ks in ((24, 3), (168, 2)):
        for k in range(1, ks + 1):
            cols += [np.sin(2 * np.pi * k * hours / period), np.cos(2 * np.pi * k * hours / period)]
    x = np.column_stack(cols)
    beta = np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    assert len(names) + 1 == 13
    assert fit["coefficients"] == pytest.approx(beta.tolist(), rel=1e-5, abs=1e-4)
    resid = pdf["y"] - x @ beta
    cov = np.linalg.pinv(x.T @ x) * (resid @ resid) / (len(pdf) - np.linalg.matrix_rank(x))
    assert fit["std_errors"][:2] == pytest.approx(np.sqrt(np.diag(cov))[:2].tolist(), rel=1e-4)


@pytest.mark.parametrize("loss", ["soft_l1", "huber", "cauchy"])
def test_robust_fit_ignores_outliers(spark, loss):
    rng = np.random.default_rng(0)
    x = np.arange(120.0)
    y = 3 + 2 * x + rng.normal(0, 0.1, 120)
    y[::15] += 500
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).cache()
    robust = regress.fit_robust(df, ["x"], "y", loss).first()["coefficients"]
    plain = regress.fit_ols(df, ["x"], "y").first()["coefficients"]
    assert abs(robust[1] - 2) < 0.05 < abs(plain[0] - 3)
    # The weighted normal equations hold at the solution.
    r = y - robust[0] - robust[1] * x
    z = r**2
    w = {"soft_l1": 1 / np.sqrt(1 + z), "huber": np.where(z <= 1, 1, 1 / np.sqrt(z)), "cauchy": 1 / (1 + z)}[loss]
    assert abs((w * r).sum()) < 1e-2 * np.abs(w * r).sum() + 1e-6


def test_robust_steps_that_tie_are_told_apart_by_their_gradient():
    # Sums of the same losses in another order differ in their last digits.
    assert regress._least([442316.70046283095, 442316.70046283090], [1e-9, 1e-6]) == 0
    assert regress._least([442316.7005, 442316.6005, 442316.8], [0.0, 1.0, 0.0]) == 1


@pytest.mark.parametrize("loss", ["soft_l1", "huber"])
def test_robust_fit_without_a_complete_row(spark, loss):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "x double, y double")
    for rows in (df, df.limit(0)):
        fits = regress.fit_robust(rows, ["x"], "y", loss)
        assert [(r["coefficients"], r["n_obs"]) for r in fits.collect()] == [(None, 0)]
        pulls = regress.robust_gradient(rows, fits, ["x"], "y", loss)
        assert {tuple(r) for r in pulls.collect()} == {("intercept", 0.0), ("x", 0.0)}


@pytest.mark.parametrize("split", [RollingOrigin(200, 24, 24), RollingOrigin(150, 48, 20, 5, True)])
@pytest.mark.parametrize("model", [LinearModel("m", ("temperature_2m", "x2")), WeatherResponse(diurnal=1, weekly=0)])
def test_backtest_equals_fold_by_fold(frame, split, model):
    df, pdf = frame
    wide, features = model.design(df, "timestamp_utc")
    wide = wide.toPandas().sort_values("ix").reset_index(drop=True)
    got = backtest.predictions(model, df, split, "y").toPandas()
    for i in range(split.folds(len(pdf))):
        end = i * split.step + split.min_train
        start = i * split.step if split.fixed_window else 0
        origin = end + split.gap
        beta = np.linalg.lstsq(
            design_matrix(wide[start:end], features), wide["y"][start:end], rcond=None
        )[0]
        want = design_matrix(wide[origin : origin + split.test_len], features) @ beta
        part = got[got["fold_index"] == i].sort_values("horizon_h")
        assert part["horizon_h"].tolist() == list(range(split.test_len))
        assert part["y_pred"].to_numpy() == pytest.approx(want, rel=1e-6)
        assert part["error"].to_numpy() == pytest.approx((part["y_true"] - part["y_pred"]).to_numpy())


def test_naive_never_looks_past_training(frame):
    df, _ = frame
    split = RollingOrigin(200, 48, 48)
    got = backtest.predictions(SeasonalNaive("n", "same_hour_yesterday"), df, split, "y").toPandas()
    # The second test day would need the first one, which is not training data.
    assert got[got["horizon_h"] >= 24]["y_pred"].isna().all()
    assert got[got["horizon_h"] < 24]["y_pred"].notna().all()
    with pytest.raises(backtest.MissingHistory, match="48/"):
        backtest.require_found(
            backtest.predictions(
                SeasonalNaive("n", "same_hour_yesterday"), df, RollingOrigin(350, 48, 24, 0), "y"
            ).filter("horizon_h >= 0").withColumn("y_pred", F.lit(None).cast("double"))
        )


def test_holdout_split(frame):
    df, _ = frame
    at = lambda s: F.lit(s).cast("timestamp")
    split = backtest.holdout_split(df, at("2024-01-11"), at("2024-01-12 23:00:00"), 168)
    assert (split.min_train, split.test_len, split.step, split.fixed_window) == (240, 48, 48, True)
    with pytest.raises(InfeasibleSplit):
        backtest.holdout_split(df, at("2030-01-01"), at("2030-02-01"))


def test_across_folds_uses_population_and_registry_sample_deviation(spark):
    per_fold = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 8.0)], "fold_index long, mae double")
    assert backtest.across_folds(per_fold, ["mae"]).first()["std"] == pytest.approx(np.std([1, 3, 8]))
    summary = registry.summarise(per_fold, ["mae"]).first()["metrics"]["mae"]
    assert summary["std"] == pytest.approx(np.std([1, 3, 8], ddof=1))
    assert summary["per_fold"] == [1.0, 3.0, 8.0]


def test_leaderboard_puts_missing_last(spark, tmp_path):
    per_fold = spark.createDataFrame([(0, 2.0)], "fold_index long, mae double")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    path = str(tmp_path / "runs")
    for name, value in (("b", 2.0), ("a", 1.0), ("c", float("nan"))):
        summary = registry.summarise(per_fold.withColumn("mae", F.lit(value)), ["mae"])
        registry.register(registry.run_row(summary, name, "linear", "weather_only", "y", ["x"], at), path)
    table = registry.runs(spark, path)
    for ascending, want in ((True, ["a", "b", "c"]), (False, ["b", "a", "c"])):
        assert [r["name"] for r in registry.leaderboard(table, ascending=ascending).collect()] == want
        board = ordered.numbered(registry.leaderboard(table, ascending=ascending), "position")
        assert [r["name"] for r in board.orderBy("position").collect()] == want
    assert registry.leaderboard(table, target="other").count() == 0
    assert registry.describe(table, "a_20240102T0304").count() == 1
    stored = table.select("run_id", F.array(F.lit(1.0), F.col("metrics")["mae"]["mean"]).alias("coefficients"))
    scored = training.score_batch(spark.range(3).withColumnRenamed("id", "x"), stored, ["x"], runs=table)
    assert {(r["run_id"], r["prediction"]) for r in scored.collect()} == {("a_20240102T0304", 1.0 + k) for k in range(3)}
    with pytest.raises(registry.UnknownRun):
        training.score_batch(spark.range(1), stored, ["id"], runs=table.where("name = 'c'"))
    with pytest.raises(registry.UnknownRun):
        registry.describe(table, "missing")
    for bad in ("a/b", "../x", ""):
        with pytest.raises(ValueError):
            registry.describe(table, bad)


@pytest.mark.parametrize("block", [11, 10_000])
def test_autocorrelation_and_decomposition(frame, block):
    df, pdf = frame
    y = pdf["y"].to_numpy() - pdf["y"].mean()
    got = diagnose.autocorrelation(df, "y", 30, block=block).orderBy("lag").toPandas()
    want = [1.0] + [float((y[:-k] * y[k:]).sum() / (y * y).sum()) for k in range(1, 31)]
    assert got["acf"].tolist() == pytest.approx(want)
    assert got["band"][1] == pytest.approx(1.959963984540054 / len(y) ** 0.5)
    parts = diagnose.decompose(df.select("ix", "y"), "y", 24, block=block).orderBy("ix").toPandas()
    assert parts["trend"].isna().sum() == 24
    total = parts["trend"] + parts["seasonal"] + parts["remainder"]
    assert total.dropna().to_numpy() == pytest.approx(parts["y"][12:-12].to_numpy())


def test_standardise_clamps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in regress.standardise(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_tail_split_minimum(spark):
    rows = spark.range(50).select(F.col("id").alias("ix"))
    assert ordered.tail_split(rows, 0.1, 1).filter("is_tail").count() == 5
    assert ordered.tail_split(rows, 0.1, 12).filter("is_tail").count() == 12


def test_hinge_slopes_by_hand(frame):
    df, pdf = frame
    got = regress.hinge_slopes(df, "y", "temperature_2m").first()
    heat = np.maximum(0, 15.5 - pdf["temperature_2m"])
    centred = pdf["y"] - pdf["y"].mean()
    assert got["alpha"] == pytest.approx(pdf["y"].mean())
    assert got["beta_heat"] == pytest.approx((heat * centred).sum() / (heat * heat).sum())


@pytest.mark.parametrize("rows", [5, 60, 10_000])
def test_capped_sample_keeps_the_smallest_hashes(spark, rows):
    import hashlib

    df = spark.range(3000)
    got = [r[0] for r in diagnose.capped_sample(df, "id", rows, 3).collect()]
    ranked = sorted(range(3000), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    assert got == sorted(ranked[:rows])
