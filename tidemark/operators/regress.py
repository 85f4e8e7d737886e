"""Least squares from moments.

Rows are reduced to the moment matrix of (1, x..., y) on the executors. Only
p x p numbers per group are solved, next to the data in an Arrow batch, so the
cost of a fit is one aggregation whatever the number of rows or folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timefn
from tidemark.session import stage_table

# Up to this many design columns the moments are one SQL aggregate; a wider
# design needs a sum per pair of columns, which a matrix product does better.
SQL_MOMENT_COLUMNS = 8
# Layout of packed sums: rows, weight, weighted target, then the upper triangle
# of the moment matrix of (design columns, target).
HEAD = 3
# Eigenvalues of X'X below this share of the largest count as zero.
PINV_CUTOFF = 1e-12

FIT_SCHEMA = (
    "coefficients array<double>, std_errors array<double>, covariance array<double>, "
    "r_squared double, residual_variance double, n_obs long"
)


def design(features: Sequence[str], intercept: bool = True) -> list[str]:
    return (["intercept"] if intercept else []) + list(features)


def _design_row(features: Sequence[str], target: str, intercept: bool) -> list[Column]:
    cells = [F.lit(1.0)] if intercept else []
    cells += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    return [*cells, F.coalesce(F.col(target).cast("double"), F.lit(0.0))]


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def moments(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    by: Sequence[str] = (),
    intercept: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Packed (weighted) sums per group: columns ``by`` and ``packed`` (array).

    Rows with a null weigh nothing, and a group of only such rows keeps zeros.
    """
    by = list(by)
    complete = F.col(target).isNotNull()
    for c in features:
        complete = complete & F.col(c).isNotNull()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = _design_row(features, target, intercept)
    rows = df.select(
        *by,
        F.when(complete, w).otherwise(0.0).alias("__w"),
        complete.cast("double").alias("__n"),
        *(c.alias(f"__x{i}") for i, c in enumerate(cells)),
    )
    if len(cells) > SQL_MOMENT_COLUMNS:
        return _wide_moments(rows, len(cells), by)
    last = f"__x{len(cells) - 1}"
    sums = [F.sum("__n"), F.sum("__w"), F.sum(F.col("__w") * F.col(last))]
    sums += [
        F.sum(F.col("__w") * F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in _pairs(len(cells))
    ]
    summed = rows.groupBy(*by).agg(*(c.alias(f"__s{i}") for i, c in enumerate(sums)))
    empty = F.lit(0.0)
    return summed.select(
        *by, F.array(*(F.coalesce(f"__s{i}", empty) for i in range(len(sums)))).alias("packed")
    )


def _fields(df: DataFrame, by: Sequence[str]) -> str:
    if not by:
        return ""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)


def _wide_moments(rows: DataFrame, width: int, by: list[str]) -> DataFrame:
    """The same sums for wide designs: a partial matrix per Arrow batch, then added."""
    upper = np.triu_indices(width)
    narrow = rows.select(*by, F.array(*(f"__x{i}" for i in range(width))).alias("x"), "__w", "__n")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, part in batch.groupby(by, dropna=False) if by else [((), batch)]:
                if part.empty:
                    continue
                x = np.vstack(part["x"].to_numpy())
                w = part["__w"].to_numpy()
                gram = (x * w[:, None]).T @ x
                head = [float(part["__n"].sum()), float(w.sum()), float(w @ x[:, -1])]
                key = key if isinstance(key, tuple) else (key,)
                out.append((*key, head + gram[upper].tolist()))
            yield pd.DataFrame(out, columns=[*by, "packed"])

    return add_packed(narrow.mapInPandas(partial, f"{_fields(rows, by)}packed array<double>"), by)


def unpack(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and position of the packed sums."""
    return parts.select(*by, F.posexplode("packed").alias("pos", "value"))


def pack(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Positions back to one array per group (as long as the packed layout)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).alias("v"))))
    return (
        long.groupBy(*by)
        .agg(listed.alias("cells"))
        .select(*by, F.transform("cells", lambda c: c["v"]).alias("packed"))
    )


def add_packed(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum packed partial sums per group, position by position."""
    by = list(by)
    return pack(unpack(parts, by).groupBy(*by, "pos").agg(F.sum("value").alias("value")), by)


def solve_packed(packed: Sequence[float], intercept: bool = True) -> tuple:
    """Least squares from one group's packed sums, in the order of ``FIT_SCHEMA``."""
    n, sum_w, sum_y = int(packed[0]), packed[1], packed[2]
    width = int((np.sqrt(8 * (len(packed) - HEAD) + 1) - 1) / 2)
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = packed[HEAD:]
    full = full + np.triu(full, 1).T
    xtx, xty, yty = full[:-1, :-1], full[:-1, -1], full[-1, -1]
    # Pseudo-inverse: collinear columns get the minimum-norm solution.
    inverse = np.linalg.pinv(xtx, rcond=PINV_CUTOFF, hermitian=True)
    beta = inverse @ xty
    residual = max(float(yty - beta @ xty), 0.0)
    total = float(yty - sum_y * sum_y / sum_w) if intercept else float(yty)
    rank = np.linalg.matrix_rank(xtx, tol=PINV_CUTOFF * max(np.abs(xtx).max(), 1e-300), hermitian=True)
    free = n - rank
    variance = residual / free if free > 0 else float("inf")
    covariance = inverse * variance if np.isfinite(variance) else np.full_like(inverse, np.inf)
    diagonal = np.diag(covariance)
    errors = np.where(
        np.isfinite(diagonal) & (diagonal >= 0), np.sqrt(np.maximum(diagonal, 0)), np.inf
    )
    r_squared = 1.0 - residual / total if total > 0 else float("nan")
    return beta.tolist(), errors.tolist(), covariance.ravel().tolist(), r_squared, variance, n


NO_FIT = (None, None, None, None, None, 0)


def solve(sums: DataFrame, by: Sequence[str] = (), intercept: bool = True) -> DataFrame:
    """Coefficients, standard errors, covariance, R2 per group of moments.

    A group without a complete row keeps its place: null results and ``n_obs`` 0.
    """
    by = list(by)
    kinds = _fields(sums, by)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [
            "coefficients", "std_errors", "covariance", "r_squared", "residual_variance", "n_obs",
        ]
        for batch in batches:
            solved = [
                solve_packed(packed, intercept) if packed is not None and packed[0] > 0 else NO_FIT
                for packed in batch["packed"]
            ]
            out = pd.DataFrame(solved, columns=names)
            for k in by:
                out[k] = batch[k].to_numpy()
            yield out[[*by, *names]]

    return sums.mapInPandas(fit, f"{kinds}{FIT_SCHEMA}")


def fit_ols(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    by: Sequence[str] = (),
    intercept: bool = True,
) -> DataFrame:
    """One row of results per group."""
    return solve(moments(df, features, target, by, intercept), by, intercept)


def dot(features: Sequence[str], coefficients: Column, intercept: bool = True) -> Column:
    """Design row times a coefficient array."""
    total = F.element_at(coefficients, 1) if intercept else F.lit(0.0)
    start = 2 if intercept else 1
    for i, c in enumerate(features):
        total = total + F.element_at(coefficients, start + i) * F.col(c).cast("double")
    return total


def apply_fit(
    df: DataFrame,
    fits: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    intercept: bool = True,
    name: str = "y_pred",
) -> DataFrame:
    """Predictions. Without groups the single coefficient row is a scalar subquery.

    Rows of a group without a fit are kept, with a null prediction.
    """
    if by:
        joined = df.join(fits.select(*by, F.col("coefficients").alias("__b")), list(by), "left")
        return joined.withColumn(name, dot(features, F.col("__b"), intercept)).drop("__b")
    beta = fits.select("coefficients").scalar()
    return df.withColumn(name, dot(features, beta, intercept))


def coefficient_table(
    fits: DataFrame, names: Sequence[str], by: Sequence[str] = (), z: float = 1.96
) -> DataFrame:
    """Long form: value, standard error and the normal interval per parameter."""
    zipped = F.arrays_zip(
        F.array(*(F.lit(n) for n in names)).alias("parameter"),
        F.col("coefficients").alias("value"),
        F.col("std_errors").alias("std_error"),
    )
    rows = fits.select(*by, F.explode(zipped).alias("c")).select(
        *by,
        F.col("c.parameter").alias("parameter"),
        F.col("c.value").alias("value"),
        F.col("c.std_error").alias("std_error"),
    )
    return rows.withColumn("low", F.col("value") - z * F.col("std_error")).withColumn(
        "high", F.col("value") + z * F.col("std_error")
    )


def weather_response_design(
    df: DataFrame,
    temperature: str = "temperature_2m",
    ts: str = "timestamp_utc",
    diurnal: int = 3,
    weekly: int = 2,
    t_heat: float = 15.5,
    t_cool: float = 22.0,
) -> tuple[DataFrame, list[str]]:
    """Heating and cooling degrees with daily and weekly Fourier pairs.

    The model is linear in its parameters once the hinges are fixed, so the
    least-squares fit needs no optimiser.
    """
    heating, cooling = timefn.degree_terms(temperature, t_heat, t_cool)
    daily = timefn.fourier_terms(ts, 24, diurnal, "diurnal")
    week = timefn.fourier_terms(ts, 168, weekly, "weekly")
    names = ["hdd", "cdd"]
    for k in range(1, diurnal + 1):
        names += [f"diurnal_sin_k{k}", f"diurnal_cos_k{k}"]
    for k in range(1, weekly + 1):
        names += [f"weekly_sin_k{k}", f"weekly_cos_k{k}"]
    return df.select("*", heating.alias("hdd"), cooling.alias("cdd"), *daily, *week), names


def loss_weight(loss: str, residual: Column) -> Column:
    """Derivative of the robust loss at the squared residual, unit scale."""
    z = residual * residual
    if loss == "linear":
        return F.lit(1.0)
    if loss == "soft_l1":
        return 1.0 / F.sqrt(1.0 + z)
    if loss == "huber":
        return F.when(z <= 1.0, F.lit(1.0)).otherwise(1.0 / F.sqrt(F.greatest(z, F.lit(1.0))))
    if loss == "cauchy":
        return 1.0 / (1.0 + z)
    raise ValueError(f"unknown loss {loss!r}")


class NotConverged(ValueError):
    """A robust fit that has not settled within its passes."""


# Steps tried in one pass: how far to lean from the Newton direction to the re-weighted
# one, and how far to go along it.
LEANINGS = (1e-4, 1e-2, 1e-1, 0.3, 1.0, 10.0)
LENGTHS = (4.0, 1.0, 0.5, 0.125)
# From one pass to the next the scale of the loss falls by this factor, down to 1.
SCALE_FALL = 20.0
# Sums of losses are known to this share of themselves.
LOSS_ROUNDING = 1e-12
# Tasks that add up the sums of all others, before the driver adds theirs.
ADDERS = 8


def _loss_terms(loss: str, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The loss at residuals, half its slope, and half its curvature where that is not negative."""
    z = r * r
    if loss == "soft_l1":
        root = np.sqrt(1.0 + z)
        return 2.0 * (root - 1.0), r / root, root**-3.0
    if loss == "huber":
        size = np.abs(r)
        return np.where(z <= 1.0, z, 2.0 * size - 1.0), np.clip(r, -1.0, 1.0), (z <= 1.0).astype(float)
    if loss == "cauchy":
        return np.log1p(z), r / (1.0 + z), np.maximum((1.0 - z) / (1.0 + z) ** 2, 0.0)
    raise ValueError(f"unknown loss {loss!r}")


def _sums_at(x: np.ndarray, y: np.ndarray, loss: str, points: np.ndarray, scale: float) -> np.ndarray:
    """For each point: the loss, its gradient, and the upper halves of two curvature matrices.

    The first is that of the loss, the second that of its weighted least squares.
    """
    width = x.shape[1]
    upper = np.triu_indices(width)
    residuals = (y[:, None] - x @ points.T) / scale
    out = []
    for r in residuals.T:
        value, slope, curvature = _loss_terms(loss, r)
        weight = np.divide(slope, r, out=np.ones_like(r), where=r != 0)
        newton, weighted = (x * curvature[:, None]).T @ x, (x * weight[:, None]).T @ x
        out.append(np.concatenate([[value.sum()], x.T @ slope, newton[upper], weighted[upper]]))
    return np.concatenate(out)


def _robust_sums(rows: DataFrame, loss: str, points: np.ndarray, scale: float) -> np.ndarray:
    """Sums over all rows ``x, y`` for all points, in one aggregate."""
    width, size = points.shape[1], len(points) * (1 + points.shape[1] * (points.shape[1] + 2))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            total += _sums_at(x, batch.column("y").to_numpy(), loss, points, scale)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += batch.column("packed").flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["packed"])

    parts = rows.mapInArrow(partial, "packed array<double>").repartition(ADDERS)
    added = parts.mapInArrow(add, "packed array<double>").collect()
    return np.sum([r["packed"] for r in added], axis=0).reshape(len(points), -1)


def _unpacked(sums: np.ndarray, width: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    half = width * (width + 1) // 2
    cells = np.split(sums[1:], [width, width + half])

    def square(upper: np.ndarray) -> np.ndarray:
        full = np.zeros((width, width))
        full[np.triu_indices(width)] = upper
        return full + np.triu(full, 1).T

    return sums[0], cells[0], square(cells[1]), square(cells[2])


def _least(losses: Sequence[float], gradients: Sequence[float]) -> int:
    """The point of least loss; of those level with it up to rounding, that of least gradient."""
    values = np.array(losses)
    level = np.flatnonzero(values <= np.min(values) + LOSS_ROUNDING * abs(np.min(values)))
    return int(level[np.argmin(np.array(gradients)[level])])


@dataclass(frozen=True)
class RobustSteps:
    """Coefficients of a robust fit, the passes over the rows it took, and what is left of the gradient.

    The gradient is that of the mean loss, for each column in units of the column's root mean square.
    """

    coefficients: list[float] | None
    passes: int
    gradient: float


def robust_steps(
    df: DataFrame, features: Sequence[str], target: str, loss: str, iterations: int = 50, tolerance: float = 1e-8
) -> RobustSteps:
    """Minimise a robust loss by safeguarded Newton steps, one aggregate over the rows for each.

    An aggregate takes the loss, its gradient and its curvature at many points at once: steps of several
    lengths in directions between Newton's, which is right near the minimum, and that of re-weighted
    least squares, which is safe far from it. The point with the least loss is the next one.
    The scale of the loss starts at the residuals' own and falls to 1, so that the curvature
    is never that of a few rows. Stopping short of a gradient near zero is an error.
    Losses that agree but for the rounding of their sums say nothing about which point is better; there
    the least gradient does. Without a complete row there are no coefficients.
    """
    _loss_terms(loss, np.zeros(1))
    packed = moments(df, features, target).first()["packed"]
    if not packed or packed[0] == 0:
        return RobustSteps(None, 1, 0.0)
    start, _, _, _, variance, n = solve_packed(packed)
    point, width = np.array(start), len(start)
    diagonal = np.array(packed[HEAD:])[[i for i, (a, b) in enumerate(_pairs(width + 1)) if a == b < width]]
    unit = np.where(diagonal > 0, np.sqrt(diagonal / n), 1.0)
    scale = max(1.0, np.sqrt(variance)) if np.isfinite(variance) else 1.0
    cells = _design_row(features, target, True)
    complete = F.col(target).isNotNull()
    for c in features:
        complete = complete & F.col(c).isNotNull()
    rows = stage_table(df.where(complete).select(F.array(*cells[:-1]).alias("x"), cells[-1].alias("y")), "robust")
    points, passes = point[None, :], 1
    change = float("inf")
    while passes <= iterations:
        sums = [_unpacked(row, width) for row in _robust_sums(rows, loss, points, scale)]
        passes += 1
        best = _least([s[0] for s in sums], [float(np.max(np.abs(s[1]) / unit)) for s in sums])
        point, (_, gradient, newton, weighted) = points[best], sums[best]
        change = float(np.max(np.abs(gradient) / unit) / n)
        if scale == 1.0 and change <= tolerance:
            return RobustSteps(point.tolist(), passes, change)
        outer = np.outer(unit, unit)
        ways = [np.linalg.pinv((newton + lean * weighted) / outer, rcond=PINV_CUTOFF, hermitian=True) for lean in LEANINGS]
        steps = [way @ (gradient / unit) / unit * scale for way in ways]
        points = np.array([point] + [point + length * step for step in steps for length in LENGTHS])
        scale = max(1.0, scale / SCALE_FALL)
    raise NotConverged(f"{loss} fit has a gradient of {change:.3g} after {iterations} passes")


def fit_robust(
    df: DataFrame, features: Sequence[str], target: str, loss: str, iterations: int = 50, tolerance: float = 1e-8
) -> DataFrame:
    """One row of results like :func:`fit_ols`; errors are those of the weighted least squares at the fit."""
    if loss == "linear":
        return solve(moments(df, features, target))
    beta = robust_steps(df, features, target, loss, iterations, tolerance).coefficients
    if beta is None:
        return solve(moments(df, features, target))
    residual = F.col(target).cast("double") - dot(features, F.array(*(F.lit(float(b)) for b in beta)))
    weighted = df.withColumn("__weight", loss_weight(loss, residual))
    return solve(moments(weighted, features, target, weight="__weight"))


def robust_gradient(df: DataFrame, fits: DataFrame, features: Sequence[str], target: str, loss: str) -> DataFrame:
    """``parameter, gradient``: the mean loss's gradient at a fit by each coefficient, from the rows themselves.

    Where no row is complete there is nothing to pull at a coefficient, and the gradient is 0.
    """
    scored = apply_fit(df, fits, features, name="__fit")
    residual = F.col(target).cast("double") - F.col("__fit")
    pull = loss_weight(loss, residual) * residual
    named = zip(design(features), [F.lit(1.0), *(F.col(c).cast("double") for c in features)], strict=True)
    complete = F.col(target).isNotNull()
    for c in features:
        complete = complete & F.col(c).isNotNull()
    none = F.count_if(complete) == 0
    means = scored.agg(*(F.when(none, 0.0).otherwise(F.avg(pull * x)).alias(name) for name, x in named))
    return means.unpivot([], design(features), "parameter", "gradient")


def hinge_slopes(
    df: DataFrame,
    target: str,
    temperature: str,
    t_heat: float = 15.5,
    t_cool: float = 22.0,
) -> DataFrame:
    """Mean level and through-origin heating and cooling slopes in one aggregate.

    The slope about the mean, sum(h (y - m)) / sum(h h), splits into plain sums.
    """
    y = F.col(target).cast("double")
    heating, cooling = timefn.degree_terms(temperature, t_heat, t_cool)

    def slope(h: Column) -> Column:
        about_mean = F.sum(h * y) - F.avg(y) * F.sum(F.when(y.isNotNull(), h))
        return F.coalesce(F.try_divide(about_mean, F.sum(h * h)), F.lit(0.0))

    return df.agg(
        F.avg(y).alias("alpha"), slope(heating).alias("beta_heat"), slope(cooling).alias("beta_cool")
    )


def response_curve(
    slopes: DataFrame, low: int, high: int, steps: int = 1, t_heat: float = 15.5, t_cool: float = 22.0
) -> DataFrame:
    """The fitted response of :func:`hinge_slopes` on a temperature grid, ``steps`` to a degree."""
    grid = F.explode(F.sequence(F.lit(low * steps), F.lit(high * steps)))
    curve = slopes.select("*", grid.alias("__step"))
    curve = curve.withColumn("temperature", F.col("__step") / F.lit(float(steps)))
    heating, cooling = timefn.degree_terms("temperature", t_heat, t_cool)
    fitted = F.col("alpha") + F.col("beta_heat") * heating + F.col("beta_cool") * cooling
    return curve.select("temperature", fitted.alias("fitted"))


def standardise(
    df: DataFrame, columns: Sequence[str], train: Column | None = None
) -> DataFrame:
    """Zero mean, unit population deviation of the training part; constants scale by 1."""
    fitted = df.filter(train) if train is not None else df
    stats = fitted.agg(
        F.struct(
            *(F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns),
            *(F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns),
        ).alias("stats")
    ).scalar()
    scaled = df.withColumn("__stats", stats)
    return scaled.select(
        *(
            (
                (F.col(c).cast("double") - F.col(f"__stats.m_{c}"))
                / F.when(F.col(f"__stats.s_{c}") > 0, F.col(f"__stats.s_{c}")).otherwise(1.0)
            ).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        )
    )
