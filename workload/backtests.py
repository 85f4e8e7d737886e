"""Rolling-origin backtests, regression, benchmark and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import metrics, textfn, timefn
from tidemark.operators import backtest, diagnose, ordered, registry, regress, resample
from tidemark.operators.backtest import LinearModel, RollingOrigin, SeasonalNaive, WeatherResponse
from tidemark.plans import training
from tidemark.session import stage
from workload import query, roles
from workload.roles import FEATURES, HOURLY, ntz, rounded
from workload.series import ARCHIVE, archive, stamp

SPLIT = RollingOrigin(min_train=336, test_len=24, step=24)
SLIDING = RollingOrigin(min_train=240, test_len=48, step=24, gap=6, fixed_window=True)
METRICS = ("mae", "mape", "rmse", "wape")

_IX = f"{HOURLY}, ix AS (SELECT *, row_number() OVER (ORDER BY timestamp_utc) - 1 AS ix FROM hourly), n AS (SELECT count(*) AS n FROM ix)"


def _folds(split: RollingOrigin) -> str:
    s = split
    start = f"i * {s.step}" if s.fixed_window else "0"
    return f"""folds AS (SELECT i AS fold_index, {start} AS a, i * {s.step} + {s.min_train} AS b, i * {s.step} + {s.min_train + s.gap} AS c, i * {s.step} + {s.min_train + s.gap + s.test_len} AS d
FROM (SELECT unnest(generate_series(0, CAST(floor((n - {s.test_len} - {s.min_train} - {s.gap}) / {s.step}) AS BIGINT))) AS i FROM n))"""


def frame(spark, sf):
    return training.prepare(roles.hourly(spark, sf))


@query("fold_plan_expanding", f"WITH {_IX}, {_folds(SPLIT)} SELECT fold_index, CAST(a AS BIGINT) AS train_start, b AS train_end, c AS test_start, d AS test_end FROM folds")
def fold_plan_expanding(spark, sf):
    return SPLIT.plan(spark, backtest.count_rows(roles.hourly(spark, sf)))


@query("fold_plan_sliding", f"WITH {_IX}, {_folds(SLIDING)} SELECT fold_index, a AS train_start, b AS train_end, c AS test_start, d AS test_end FROM folds")
def fold_plan_sliding(spark, sf):
    return SLIDING.plan(spark, backtest.count_rows(roles.hourly(spark, sf)))


@query(
    "fold_train_rows",
    f"WITH {_IX}, {_folds(SLIDING)} SELECT fold_index, ix FROM folds JOIN ix ON ix >= a AND ix < b",
)
def fold_train_rows(spark, sf):
    rows = frame(spark, sf)
    folds = SLIDING.folds(backtest.count_rows(rows))
    return backtest.train_rows(rows, SLIDING, folds).select("fold_index", "ix")


@query(
    "fold_test_rows",
    f"WITH {_IX}, {_folds(SLIDING)} SELECT fold_index, ix, ix - c AS horizon_h FROM folds JOIN ix ON ix >= c AND ix < d",
)
def fold_test_rows(spark, sf):
    rows = frame(spark, sf)
    folds = SLIDING.folds(backtest.count_rows(rows))
    return backtest.test_rows(rows, SLIDING, folds).select("fold_index", "ix", "horizon_h")


_LAGGED = f"""{_IX}, pairs AS (SELECT a.timestamp_utc, CAST(a.nd_mw AS DOUBLE) AS y, CAST(b.nd_mw AS DOUBLE) AS p FROM hourly a JOIN hourly b ON b.timestamp_utc = a.timestamp_utc - INTERVAL 24 HOUR)"""
_METRIC_SQL = "round(avg(abs(y - p)), 6) AS mae, round(avg(abs((y - p) / y)), 6) AS mape, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(sum(abs(y - p)) / sum(abs(y)), 6) AS wape"


@query("error_metrics", f"WITH {_LAGGED} SELECT {_METRIC_SQL} FROM pairs")
def error_metrics(spark, sf):
    hourly = roles.hourly(spark, sf).select("timestamp_utc", "nd_mw")
    pairs = backtest.fixed_lag(hourly, 24, "nd_mw").filter("y_pred is not null")
    return rounded(metrics.score(pairs, METRICS, actual="nd_mw"))


def _naive_sql(split: RollingOrigin, lag: int) -> str:
    return f"""WITH {_IX}, {_folds(split)},
preds AS (SELECT fold_index, ix.ix - c AS horizon_h, ix.timestamp_utc, CAST(ix.nd_mw AS DOUBLE) AS y, CAST(h.nd_mw AS DOUBLE) AS p
 FROM folds JOIN ix ON ix.ix >= c AND ix.ix < d LEFT JOIN ix h ON h.timestamp_utc = ix.timestamp_utc - INTERVAL {lag} HOUR AND h.ix >= a AND h.ix < b),
spans AS (SELECT fold_index, min(timestamp_utc) AS test_start, max(timestamp_utc) AS test_end FROM preds GROUP BY 1),
ends AS (SELECT fold_index, timestamp_utc AS train_end FROM folds JOIN ix ON ix = b - 1)"""


NAIVE_DAY = SeasonalNaive("naive-day", "same_hour_yesterday")
NAIVE_WEEK = SeasonalNaive("naive-week", "same_hour_last_week")
NAIVE_SLOT = SeasonalNaive("naive-slot", "same_hour_same_weekday")


@query(
    "backtest_predictions_naive",
    _naive_sql(SPLIT, 168)
    + " SELECT fold_index, test_start, test_end, horizon_h, timestamp_utc, y AS y_true, p AS y_pred, y - p AS error FROM preds JOIN spans USING (fold_index)",
)
def backtest_predictions_naive(spark, sf):
    return ntz(backtest.predictions(NAIVE_WEEK, frame(spark, sf), SPLIT, "nd_mw"))


@query(
    "backtest_metrics_naive",
    _naive_sql(SPLIT, 24)
    + f", m AS (SELECT fold_index, {_METRIC_SQL} FROM preds GROUP BY 1) SELECT fold_index, train_end, test_start, test_end, mae, mape, rmse, wape FROM m JOIN spans USING (fold_index) JOIN ends USING (fold_index)",
)
def backtest_metrics_naive(spark, sf):
    per_fold, _ = backtest.evaluate(NAIVE_DAY, frame(spark, sf), SPLIT, "nd_mw", METRICS)
    return ntz(rounded(per_fold))


@query(
    "backtest_same_weekday",
    f"""WITH {_IX}, {_folds(SPLIT)}
SELECT fold_index, t.ix - c AS horizon_h, CAST(t.nd_mw AS DOUBLE) AS y_true, CAST(arg_max(h.nd_mw, h.ix) AS DOUBLE) AS y_pred
FROM folds JOIN ix t ON t.ix >= c AND t.ix < d JOIN ix h ON h.ix >= a AND h.ix < b AND isodow(h.timestamp_utc) = isodow(t.timestamp_utc) AND hour(h.timestamp_utc) = hour(t.timestamp_utc) AND h.timestamp_utc <= t.timestamp_utc
GROUP BY fold_index, t.ix, c, t.nd_mw""",
)
def backtest_same_weekday(spark, sf):
    out = backtest.predictions(NAIVE_SLOT, frame(spark, sf), SPLIT, "nd_mw")
    return out.select("fold_index", "horizon_h", "y_true", "y_pred")


@query(
    "metrics_across_folds",
    _naive_sql(SPLIT, 24)
    + f""", m AS (SELECT fold_index, {_METRIC_SQL.replace("round(", "(").replace(", 6)", ")")} FROM preds GROUP BY 1)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds FROM (UNPIVOT m ON mae, mape, rmse, wape INTO NAME metric VALUE value) GROUP BY 1""",
)
def metrics_across_folds(spark, sf):
    per_fold, _ = backtest.evaluate(NAIVE_DAY, frame(spark, sf), SPLIT, "nd_mw", METRICS)
    return rounded(backtest.across_folds(per_fold, METRICS))


@query(
    "error_band_by_horizon",
    _naive_sql(SPLIT, 24)
    + " SELECT horizon_h, round(quantile_cont(y - p, 0.1), 6) AS q_low, round(quantile_cont(y - p, 0.9), 6) AS q_high FROM preds GROUP BY 1",
)
def error_band_by_horizon(spark, sf):
    predicted = backtest.predictions(NAIVE_DAY, frame(spark, sf), SPLIT, "nd_mw")
    return rounded(diagnose.error_band(predicted))


@query(
    "forecast_with_band",
    _naive_sql(SPLIT, 24)
    + """, band AS (SELECT horizon_h, quantile_cont(y - p, 0.1) AS lo, quantile_cont(y - p, 0.9) AS hi FROM preds GROUP BY 1)
SELECT fold_index, horizon_h, p AS y_pred, round(p + lo, 6) AS band_low, round(p + hi, 6) AS band_high FROM preds JOIN band USING (horizon_h)""",
)
def forecast_with_band(spark, sf):
    predicted = stage(backtest.predictions(NAIVE_DAY, frame(spark, sf), SPLIT, "nd_mw"))
    out = diagnose.forecast_band(predicted, diagnose.error_band(predicted))
    return rounded(out.select("fold_index", "horizon_h", "y_pred", "band_low", "band_high"))


@query(
    "forecast_overlay",
    f"""WITH {HOURLY} SELECT a.timestamp_utc, CAST(a.nd_mw AS DOUBLE) AS y_true, CAST(b.nd_mw AS DOUBLE) AS "day", CAST(c.nd_mw AS DOUBLE) AS "week",
timezone('Europe/London', timezone('UTC', a.timestamp_utc)) AS local_time
FROM hourly a LEFT JOIN hourly b ON b.timestamp_utc = a.timestamp_utc - INTERVAL 24 HOUR LEFT JOIN hourly c ON c.timestamp_utc = a.timestamp_utc - INTERVAL 168 HOUR""",
)
def forecast_overlay(spark, sf):
    hourly = roles.hourly(spark, sf).select("timestamp_utc", F.col("nd_mw").cast("double").alias("y_true"))
    forecasts = {
        "day": backtest.fixed_lag(hourly, 24, "y_true"),
        "week": backtest.fixed_lag(hourly, 168, "y_true"),
    }
    return ntz(diagnose.overlay(hourly, forecasts))


@query(
    "residual_series",
    f"WITH {_LAGGED} SELECT timestamp_utc, y - p AS residual FROM pairs",
)
def residual_series(spark, sf):
    hourly = roles.hourly(spark, sf).select("timestamp_utc", F.col("nd_mw").alias("y_true"))
    pairs = backtest.fixed_lag(hourly, 24, "y_true").filter("y_pred is not null")
    return ntz(diagnose.residual_series(pairs))


# Two regressors by the closed form on centred moments.
_OLS = """s AS (SELECT {by} count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
 covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy FROM rows {group}),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)"""
_OLS_OUT = "round(my - b1 * m1 - b2 * m2, 4) AS intercept, round(b1, 4) AS beta_1, round(b2, 4) AS beta_2, round((b1 * s1y + b2 * s2y) / syy, 6) AS r_squared, CAST(n AS BIGINT) AS n_obs"


def _ols_columns(fits, *by):
    c = F.col("coefficients")
    return rounded(
        fits.select(
            *by,
            F.round(c[0], 4).alias("intercept"),
            F.round(c[1], 4).alias("beta_1"),
            F.round(c[2], 4).alias("beta_2"),
            "r_squared",
            "n_obs",
        )
    )


@query(
    "ols_fit",
    f"WITH rows AS (SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), {_OLS.format(by='', group='')} SELECT {_OLS_OUT} FROM b",
)
def ols_fit(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    return _ols_columns(regress.fit_ols(rows, ["l_quantity", "l_discount"], "l_extendedprice"))


@query(
    "ols_fit_per_group",
    f"WITH rows AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), {_OLS.format(by='l_returnflag,', group='GROUP BY 1')} SELECT l_returnflag, {_OLS_OUT} FROM b",
)
def ols_fit_per_group(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    fits = regress.fit_ols(
        rows, ["l_quantity", "l_discount"], "l_extendedprice", ["l_returnflag"]
    )
    return _ols_columns(fits, "l_returnflag")


@query(
    "ols_predict",
    f"""WITH rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), {_OLS.format(by='', group='')}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((my - b1 * m1 - b2 * m2) + b1 * x1 + b2 * x2, 3) AS y_pred FROM rows, b""",
)
def ols_predict(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    features = ["l_quantity", "l_discount"]
    fits = regress.fit_ols(rows, features, "l_extendedprice")
    scored = regress.apply_fit(rows, fits, features)
    return rounded(scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y_pred"), 3)


_RESPONSE = f"{FEATURES}, rows AS (SELECT CAST(nd_mw AS DOUBLE) AS y, greatest(0e0, 15.5 - temperature_2m) AS x1, greatest(0e0, temperature_2m - 22) AS x2 FROM features)"


@query(
    "weather_response_fit",
    f"WITH {_RESPONSE}, {_OLS.format(by='', group='')} SELECT {_OLS_OUT} FROM b",
)
def weather_response_fit(spark, sf):
    rows = roles.feature_rows(spark, sf)
    wide, names = regress.weather_response_design(rows, diurnal=0, weekly=0)
    return _ols_columns(regress.fit_ols(wide, names, "nd_mw"))


def _design_sql(diurnal, weekly):
    """The columns of the weather response after the intercept."""
    hours = "(epoch(timestamp_utc) / 3600e0)"
    pairs = [("diurnal", 24, k) for k in range(1, diurnal + 1)] + [("weekly", 168, k) for k in range(1, weekly + 1)]
    waves = [(f"{name}_{f}_k{k}", f"{f}(2e0 * pi() * {k} * {hours} / {period})") for name, period, k in pairs for f in ("sin", "cos")]
    return [("hdd", "greatest(0e0, 15.5 - temperature_2m)"), ("cdd", "greatest(0e0, temperature_2m - 22)"), *waves]


def _solved(columns, by="", source="rows"):
    """SQL for the normal equations of ``rows(x, y)``, reduced to (coefficients, inverse) column by column.

    ``m`` holds rows of the moment matrix, its right side, and the unit matrix; a step of the
    recursion clears one column. A column of zeros gets the coefficient 0.
    """
    p = columns + 1
    cell = {(i, j): f"sum(x[{i + 1}] * x[{j + 1}])" for i in range(p) for j in range(p)}
    eye = [["1e0" if i == j else "0e0" for j in range(p)] for i in range(p)]
    rows = ", ".join(
        "[" + ", ".join([*(cell[i, j] for j in range(p)), f"sum(x[{i + 1}] * y)", *eye[i]]) + "]" for i in range(p)
    )
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""moments AS (SELECT {key}count(*) AS n, sum(y) AS sy, sum(y * y) AS yy, [{rows}] AS m FROM {source} {group}),
steps AS (SELECT {key}n, sy, yy, 1 AS k, m, m AS m0 FROM moments UNION ALL
SELECT {key}n, sy, yy, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / coalesce(nullif(m[k][k], 0), 1))
ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / coalesce(nullif(m[k][k], 0), 1)) END), m0 FROM steps WHERE k <= {p}),
solved AS (SELECT {key}n, sy, yy, list_transform(m, lambda r: r[{p + 1}]) AS b, m, m0 FROM steps WHERE k = {p + 1})"""


_FULL = _design_sql(3, 2)
_FULL_NAMES = ["intercept", *(name for name, _ in _FULL)]


@query(
    "weather_response_full",
    f"""WITH RECURSIVE {FEATURES}, rows AS (SELECT CAST(nd_mw AS DOUBLE) AS y, [1e0, {", ".join(x for _, x in _FULL)}] AS x FROM features WHERE nd_mw IS NOT NULL AND temperature_2m IS NOT NULL),
{_solved(len(_FULL))},
spread AS (SELECT *, (yy - list_sum(list_transform(b, lambda v, i: v * m0[i][{len(_FULL) + 2}]))) / (n - {len(_FULL) + 1}) AS s2 FROM solved),
cells AS (SELECT unnest({_FULL_NAMES}) AS parameter, unnest(range(1, {len(_FULL) + 2})) AS i, b, m, s2 FROM spread),
c AS (SELECT parameter, b[i] AS value, sqrt(m[i][{len(_FULL) + 2} + i] * s2) AS std_error FROM cells)
SELECT parameter, round(value, 4) AS value, round(std_error, 4) AS std_error, round(value - 1.96 * std_error, 4) AS low, round(value + 1.96 * std_error, 4) AS high FROM c""",
)
def weather_response_full(spark, sf):
    """All 13 parameters with standard errors and intervals."""
    rows = roles.feature_rows(spark, sf)
    wide, names = regress.weather_response_design(rows)
    fits = regress.fit_ols(wide, names, "nd_mw")
    return rounded(regress.coefficient_table(fits, regress.design(names)), 4)


_ROBUST = ["intercept", *(name for name, _ in _design_sql(1, 0))]


def _robust_design(spark, sf):
    return regress.weather_response_design(stage(roles.feature_rows(spark, sf)), diurnal=1, weekly=0)


@query("weather_response_robust")
def weather_response_robust(spark, sf):
    """Robust refit of the hinged response, Huber loss."""
    wide, names = _robust_design(spark, sf)
    fits = regress.fit_robust(wide, names, "nd_mw", "huber")
    return rounded(regress.coefficient_table(fits, regress.design(names)), 3)


@query(
    "weather_response_robust_gradient",
    f"SELECT loss, parameter, 0e0 AS gradient FROM (SELECT unnest(['huber', 'soft_l1']) AS loss), (SELECT unnest({_ROBUST}) AS parameter)",
)
def weather_response_robust_gradient(spark, sf):
    """The mean loss's gradient at the fitted coefficients, taken from the rows: zero at the minimum, as the losses are convex."""
    wide, names = _robust_design(spark, sf)
    out = None
    for loss in ("huber", "soft_l1"):
        fits = regress.fit_robust(wide, names, "nd_mw", loss)
        part = regress.robust_gradient(wide, fits, names, "nd_mw", loss).withColumn("loss", F.lit(loss))
        out = part if out is None else out.unionByName(part)
    return out.select("loss", "parameter", (F.round("gradient", 4) + F.lit(0.0)).alias("gradient"))


@query(
    "hinge_slopes",
    f"""WITH {_RESPONSE}, m AS (SELECT avg(y) AS m FROM rows)
SELECT round(any_value(m), 6) AS alpha, round(coalesce(sum(x1 * (y - m)) / nullif(sum(x1 * x1), 0), 0), 6) AS beta_heat,
round(coalesce(sum(x2 * (y - m)) / nullif(sum(x2 * x2), 0), 0), 6) AS beta_cool FROM rows, m""",
)
def hinge_slopes(spark, sf):
    rows = roles.feature_rows(spark, sf)
    return rounded(regress.hinge_slopes(rows, "nd_mw", "temperature_2m"))


@query(
    "response_curve_fitted",
    f"""WITH {_RESPONSE}, m AS (SELECT avg(y) AS m FROM rows),
h AS (SELECT any_value(m) AS alpha, coalesce(sum(x1 * (y - m)) / nullif(sum(x1 * x1), 0), 0) AS bh, coalesce(sum(x2 * (y - m)) / nullif(sum(x2 * x2), 0), 0) AS bc FROM rows, m)
SELECT CAST(t AS DOUBLE) AS temperature, round(alpha + bh * greatest(0, 15.5 - t) + bc * greatest(0, t - 22), 4) AS fitted FROM h, LATERAL (SELECT unnest(range(-10, 36)) AS t)""",
)
def response_curve_fitted(spark, sf):
    rows = roles.feature_rows(spark, sf)
    slopes = regress.hinge_slopes(rows, "nd_mw", "temperature_2m")
    return rounded(regress.response_curve(slopes, -10, 35), 4)


def feature_frame(spark, sf):
    return training.prepare(roles.feature_rows(spark, sf))


_FIX = f"{FEATURES}, ix AS (SELECT *, row_number() OVER (ORDER BY timestamp_utc) - 1 AS ix FROM features), n AS (SELECT count(*) AS n FROM ix)"
LINEAR = LinearModel("linear", ("temperature_2m", "cloud_cover"))


def _linear_sql(split: RollingOrigin) -> str:
    return f"""WITH {_FIX}, {_folds(split)},
rows AS (SELECT fold_index, CAST(nd_mw AS DOUBLE) AS y, temperature_2m AS x1, cloud_cover AS x2 FROM folds JOIN ix ON ix >= a AND ix < b),
{_OLS.format(by="fold_index,", group="GROUP BY 1")}"""


@query(
    "fold_parameters_expanding",
    _linear_sql(SPLIT) + f" SELECT fold_index, {_OLS_OUT} FROM b",
)
def fold_parameters_expanding(spark, sf):
    rows = feature_frame(spark, sf)
    folds = SPLIT.folds(backtest.count_rows(rows))
    return _ols_columns(LINEAR.fit_folds(rows, SPLIT, folds, "timestamp_utc", "nd_mw"), "fold_index")


@query(
    "fold_parameters_sliding",
    _linear_sql(SLIDING) + f" SELECT fold_index, {_OLS_OUT} FROM b",
)
def fold_parameters_sliding(spark, sf):
    rows = feature_frame(spark, sf)
    folds = SLIDING.folds(backtest.count_rows(rows))
    fits = LINEAR.fit_folds(rows, SLIDING, folds, "timestamp_utc", "nd_mw")
    return _ols_columns(fits, "fold_index")


@query(
    "final_fold_parameters",
    _linear_sql(SPLIT) + f" SELECT fold_index, {_OLS_OUT} FROM b QUALIFY fold_index = max(fold_index) OVER ()",
)
def final_fold_parameters(spark, sf):
    rows = feature_frame(spark, sf)
    folds = SPLIT.folds(backtest.count_rows(rows))
    fits = LINEAR.fit_folds(rows, SPLIT, folds, "timestamp_utc", "nd_mw")
    return _ols_columns(backtest.final_fit(fits), "fold_index")


_LINEAR_PREDS = (
    _linear_sql(SPLIT)
    + """, preds AS (SELECT fold_index, ix - c AS horizon_h, timestamp_utc, CAST(nd_mw AS DOUBLE) AS y, (my - b1 * m1 - b2 * m2) + b1 * temperature_2m + b2 * cloud_cover AS p
FROM folds JOIN ix ON ix >= c AND ix < d JOIN b USING (fold_index))"""
)


@query(
    "backtest_metrics_linear",
    _LINEAR_PREDS
    + f""", ends AS (SELECT fold_index, timestamp_utc AS train_end FROM folds JOIN ix ON ix = b - 1)
SELECT fold_index, any_value(train_end) AS train_end, min(timestamp_utc) AS test_start, max(timestamp_utc) AS test_end, {_METRIC_SQL.replace(", 6)", ", 4)")} FROM preds JOIN ends USING (fold_index) GROUP BY 1""",
)
def backtest_metrics_linear(spark, sf):
    per_fold, _ = backtest.evaluate(LINEAR, feature_frame(spark, sf), SPLIT, "nd_mw", METRICS)
    return ntz(rounded(per_fold, 4))


_FULL_ROW = f"[1e0, {', '.join(x for _, x in _FULL)}]"


@query(
    "backtest_weather_response",
    f"""WITH RECURSIVE {_FIX}, {_folds(SPLIT)},
rows AS (SELECT fold_index, CAST(nd_mw AS DOUBLE) AS y, {_FULL_ROW} AS x FROM folds JOIN ix ON ix >= a AND ix < b),
{_solved(len(_FULL), "fold_index")},
preds AS (SELECT fold_index, timestamp_utc, CAST(nd_mw AS DOUBLE) AS y, list_dot_product(s.b, {_FULL_ROW}) AS p FROM folds JOIN ix ON ix >= c AND ix < d JOIN solved s USING (fold_index)),
ends AS (SELECT fold_index, timestamp_utc AS train_end FROM folds JOIN ix ON ix = b - 1)
SELECT fold_index, any_value(train_end) AS train_end, min(timestamp_utc) AS test_start, max(timestamp_utc) AS test_end, {_METRIC_SQL.replace(", 6)", ", 4)")} FROM preds JOIN ends USING (fold_index) GROUP BY 1""",
)
def backtest_weather_response(spark, sf):
    """All folds of the 13-parameter model from one pass of moments."""
    per_fold, _ = backtest.evaluate(
        WeatherResponse(), feature_frame(spark, sf), SPLIT, "nd_mw", METRICS
    )
    return ntz(rounded(per_fold, 4))


@query(
    "holdout_in_chunks",
    f"""WITH {_IX}, h AS (SELECT count(*) FILTER (WHERE timestamp_utc < TIMESTAMP '2024-01-15') AS before, count(*) FILTER (WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-25') AS inside FROM ix)
SELECT i AS fold_index, i * least(72, inside) AS train_start, i * least(72, inside) + before AS train_end, i * least(72, inside) + before AS test_start, i * least(72, inside) + before + least(72, inside) AS test_end
FROM h, n, LATERAL (SELECT unnest(generate_series(0, CAST(floor((n - least(72, inside) - before) / least(72, inside)) AS BIGINT))) AS i)""",
)
def holdout_in_chunks(spark, sf):
    rows = frame(spark, sf)
    split = backtest.holdout_split(rows, stamp("2024-01-15"), stamp("2024-01-25"), 72)
    return split.plan(spark, backtest.count_rows(rows))


_BENCH = f"""{ARCHIVE}, bench AS (SELECT date_trunc('hour', timestamp_utc) AS timestamp_utc, avg(demand_forecast_mw) AS f, avg(demand_outturn_mw) AS o FROM archive GROUP BY 1)"""


def _mean_metrics(source: str) -> str:
    inner = _METRIC_SQL.replace("round(", "(").replace(", 6)", ")")
    return f"(SELECT avg(mae) AS mae, avg(mape) AS mape, avg(rmse) AS rmse, avg(wape) AS wape FROM (SELECT fold_index, {inner} FROM {source} GROUP BY fold_index))"


def _naive_preds(name: str, lag: int) -> str:
    return f"{name} AS (SELECT fold_index, t.timestamp_utc, CAST(t.nd_mw AS DOUBLE) AS y, CAST(h.nd_mw AS DOUBLE) AS p FROM folds JOIN ix t ON t.ix >= c AND t.ix < d JOIN ix h ON h.timestamp_utc = t.timestamp_utc - INTERVAL {lag} HOUR)"


_ROUND4 = ", ".join(f"round({m}, 4) AS {m}" for m in METRICS)


@query(
    "benchmark_comparison",
    f"""WITH {_IX}, {_folds(SPLIT)}, {_naive_preds("d1", 24)}, {_naive_preds("d7", 168)}, {_BENCH},
span AS (SELECT min(timestamp_utc) AS lo, max(timestamp_utc) AS hi FROM d1),
e AS (SELECT o AS y, f AS p FROM bench, span WHERE timestamp_utc BETWEEN lo AND hi AND o IS NOT NULL AND f IS NOT NULL)
SELECT 0 AS position, 'naive-day' AS model, {_ROUND4} FROM {_mean_metrics("d1")}
UNION ALL SELECT 1, 'naive-week', {_ROUND4} FROM {_mean_metrics("d7")}
UNION ALL SELECT 2, 'neso', {_METRIC_SQL.replace(", 6)", ", 4)")} FROM e""",
)
def benchmark_comparison(spark, sf):
    hourly_archive = resample.hourly_aligned(archive(spark, sf), "mean")
    models = {"naive-week": NAIVE_WEEK, "naive-day": NAIVE_DAY}
    return rounded(
        backtest.compare_with_benchmark(
            models, frame(spark, sf), hourly_archive, SPLIT, "nd_mw", METRICS
        ),
        4,
    )


@query(
    "benchmark_window_overlap",
    f"""WITH {_BENCH} SELECT timestamp_utc, round(f, 4) AS demand_forecast_mw, round(o, 4) AS demand_outturn_mw FROM bench
WHERE f IS NOT NULL AND o IS NOT NULL AND timestamp_utc BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
)
def benchmark_window_overlap(spark, sf):
    hourly_archive = resample.hourly_aligned(archive(spark, sf), "mean")
    inside = backtest.overlap_window(hourly_archive, stamp("2024-01-10"), stamp("2024-01-20"))
    return ntz(rounded(inside, 4))


def _scored(spark, sf):
    """Metrics of each fold, and errors, of the two naive models."""
    rows = frame(spark, sf)
    n = backtest.count_rows(rows)
    out = errors = None
    for model in (NAIVE_DAY, NAIVE_WEEK):
        per_fold, predicted = backtest.evaluate(model, rows, SPLIT, "nd_mw", METRICS, n_rows=n)
        named = per_fold.withColumn("model", F.lit(model.name))
        out = named if out is None else out.unionByName(named)
        residual = predicted.select(F.lit(model.name).alias("model"), "error")
        errors = residual if errors is None else errors.unionByName(residual)
    return out, errors


def _scores(spark, sf):
    return _scored(spark, sf)[0]


@query(
    "ablation_table",
    f"""WITH {_IX}, {_folds(SPLIT)}, {_naive_preds("d1", 24)}, {_naive_preds("d7", 168)},
m AS (SELECT 'naive-day' AS model, * FROM {_mean_metrics("d1")} UNION ALL SELECT 'naive-week', * FROM {_mean_metrics("d7")}),
r AS (SELECT 'naive-day' AS model, stddev_pop(y - p) AS s FROM d1 UNION ALL SELECT 'naive-week', stddev_pop(y - p) FROM d7)
SELECT model, {_ROUND4}, round(s, 4) AS residual_std, round(((SELECT mape FROM m WHERE model = 'naive-day') - mape) * 100, 4) AS improvement_pp FROM m JOIN r USING (model)""",
)
def ablation_table(spark, sf):
    scores, errors = _scored(spark, sf)
    return rounded(diagnose.ablation(scores, "naive-day", METRICS, residuals=errors), 4)


_SUMMARY = f"""WITH {_IX}, {_folds(SPLIT)}, {_naive_preds("d1", 24)}, {_naive_preds("d7", 168)},
per AS (SELECT 'naive-day' AS model, fold_index, avg(abs(y - p)) AS mae FROM d1 GROUP BY 2 UNION ALL SELECT 'naive-week', fold_index, avg(abs(y - p)) FROM d7 GROUP BY 2)"""


@query(
    "run_metric_summary",
    _SUMMARY
    + " SELECT model, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS std, list(round(mae, 4) ORDER BY fold_index) AS per_fold FROM per GROUP BY 1",
)
def run_metric_summary(spark, sf):
    summary = registry.summarise(_scores(spark, sf), ["mae"], ["model"])
    m = F.col("metrics")["mae"]
    return rounded(
        summary.select(
            "model",
            m["mean"].alias("mean"),
            m["std"].alias("std"),
            F.transform(m["per_fold"], lambda v: F.round(v, 4)).alias("per_fold"),
        ),
        4,
    )


def _runs(spark, sf):
    """A registry of runs: one per order, with a metric that is missing for some."""
    key = F.col("o_orderkey")
    mean = F.when(key % 10 == 0, F.lit(float("nan"))).when(key % 10 != 1, F.col("o_totalprice"))
    summary = F.struct(
        mean.alias("mean"),
        F.lit(1.0).alias("std"),
        F.transform(F.sequence(F.lit(1), (key % 3 + 4).cast("int")), lambda i: i.cast("double")).alias("per_fold"),
    )
    empty = F.create_map().cast("map<string,struct<mean:double,std:double,per_fold:array<double>>>")
    return roles.table(spark, sf, "orders").select(
        registry.run_id(F.concat(F.lit("model-"), key.cast("string")), F.col("o_orderdate")).alias("run_id"),
        F.concat(F.lit("model-"), key.cast("string")).alias("name"),
        F.col("o_orderpriority").alias("type"),
        F.when(key % 2 == 0, "weather_only").otherwise("with_remit").alias("feature_set"),
        F.col("o_orderstatus").alias("target"),
        F.when(key % 4 == 1, F.array(F.lit("temperature_2m"), F.lit("remit_unavail_mw_next_24h")))
        .otherwise(F.array(F.lit("temperature_2m")))
        .alias("feature_columns"),
        F.col("o_orderdate").alias("fit_utc"),
        F.when(key % 10 == 2, empty).otherwise(F.create_map(F.lit("mae"), summary)).alias("metrics"),
    )


@query(
    "run_ids",
    "SELECT 'model-' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%dT%H%M') AS run_id FROM orders",
)
def run_ids(spark, sf):
    return _runs(spark, sf).select("run_id")


@query(
    "leaderboard",
    """WITH r AS (SELECT 'model-' || o_orderkey AS name, CASE WHEN o_orderkey % 10 NOT IN (0, 1, 2) THEN o_totalprice END AS mae FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0)
SELECT row_number() OVER (ORDER BY mae IS NULL, mae DESC, name) AS position, name, mae FROM r""",
)
def leaderboard(spark, sf):
    """Descending order with missing metrics last; the position of every run."""
    board = registry.leaderboard(
        _runs(spark, sf), target="F", feature_set="weather_only", ascending=False
    )
    mae = F.col("metrics")["mae"]["mean"]
    placed = ordered.numbered(board.select("name", F.when(~F.isnan(mae), mae).alias("mae")), "position")
    return placed.select((F.col("position") + 1).alias("position"), "name", "mae")


@query(
    "latest_matching_run",
    """SELECT 'model-' || o_orderkey AS name, o_orderdate AS fit_utc FROM orders WHERE o_orderkey % 4 = 1
QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, 'model-' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%dT%H%M') DESC) = 1""",
)
def latest_matching_run(spark, sf):
    found = registry.latest_run(
        _runs(spark, sf), "with_remit", "model", with_column="remit_unavail_mw_next_24h"
    )
    return ntz(found.select("name", "fit_utc"))


@query(
    "run_comparability",
    """SELECT count(DISTINCT (o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 10 = 2 THEN 0 ELSE o_orderkey % 3 + 4 END)) AS n_protocols,
count(DISTINCT (o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 10 = 2 THEN 0 ELSE o_orderkey % 3 + 4 END)) <= 1 AS comparable FROM orders""",
)
def run_comparability(spark, sf):
    return registry.comparability(_runs(spark, sf))


@query(
    "trained_runs",
    f"""WITH {_IX}, {_folds(SPLIT)}, {_naive_preds("d1", 24)}, {_naive_preds("d7", 168)}
SELECT 'naive-day_20240201T0000' AS run_id, 'SeasonalNaive' AS type, {_ROUND4} FROM {_mean_metrics("d1")}
UNION ALL SELECT 'naive-week_20240201T0000', 'SeasonalNaive', {_ROUND4} FROM {_mean_metrics("d7")}""",
)
def trained_runs(spark, sf):
    """Backtest two models, register both, read the registry back."""
    from tidemark.session import scratch_path

    models = {"naive-day": NAIVE_DAY, "naive-week": NAIVE_WEEK}
    rows = training.train_and_register(
        models, frame(spark, sf), SPLIT, "nd_mw", "weather_only", stamp("2024-02-01"), METRICS
    )
    path = scratch_path(spark, "runs")
    registry.register(rows, path)
    stored = registry.runs(spark, path)
    return rounded(
        stored.select(
            "run_id", "type", *(F.col("metrics")[m]["mean"].alias(m) for m in METRICS)
        ),
        4,
    )


@query(
    "batch_scoring",
    f"""WITH rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), {_OLS.format(by='', group='')}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((my - b1 * m1 - b2 * m2) + b1 * x1 + b2 * x2, 3) AS prediction, 'linear_20240201T0000' AS run_id, 'linear' AS model_name, 'l_extendedprice' AS target,
substr(sha256('{{"l_discount": ' || CAST(x2 AS VARCHAR) || ', "l_quantity": ' || CAST(x1 AS VARCHAR) || '}}'), 1, 16) AS feature_hash FROM rows, b""",
)
def batch_scoring(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    features = ["l_quantity", "l_discount"]
    stored = stage(
        regress.fit_ols(rows, features, "l_extendedprice").select(
            registry.run_id(F.lit("linear"), stamp("2024-02-01")).alias("run_id"), "coefficients"
        )
    )
    scored = training.score_batch(
        rows, stored, features, "linear_20240201T0000", name="linear", target="l_extendedprice"
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    logged = ["prediction", "run_id", "model_name", "target", "feature_hash"]
    return rounded(scored.select(*keys, *logged), 3)


@query(
    "feature_hashes_canonical",
    """SELECT event_id, substr(sha256('{"caf\\u00e9": "' || event_type || '", "share": ' || CAST(value / 7e0 AS VARCHAR) || ', "small": ' || CAST(value / 3e9 AS VARCHAR) || '}'), 1, 16) AS feature_hash FROM events""",
)
def feature_hashes_canonical(spark, sf):
    """Long fractions, exponents and a name beyond ASCII."""
    rows = roles.table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("café"),
        (F.col("value") / 7.0).alias("share"),
        (F.col("value") / 3e9).alias("small"),
    )
    return rows.select("event_id", textfn.feature_hash(["small", "café", "share"]).alias("feature_hash"))


@query(
    "feature_hashes",
    """SELECT o_orderkey, substr(sha256('{"o_custkey": ' || o_custkey || ', "o_orderstatus": "' || o_orderstatus || '"}'), 1, 16) AS feature_hash FROM orders""",
)
def feature_hashes(spark, sf):
    orders = roles.table(spark, sf, "orders")
    return orders.select(
        "o_orderkey", textfn.feature_hash(["o_orderstatus", "o_custkey"]).alias("feature_hash")
    )


@query(
    "hour_floor_counts",
    "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1",
)
def hour_floor_counts(spark, sf):
    events = roles.table(spark, sf, "events")
    return ntz(events.groupBy(timefn.hour_floor("ts").alias("hour")).agg(F.count("*").alias("n")))
