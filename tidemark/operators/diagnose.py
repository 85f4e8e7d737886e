"""Residual diagnostics and the tables behind the usual figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import timefn
from tidemark.operators import ordered, quantiles


def hour_weekday_means(
    df: DataFrame, value: str = "error", ts: str = "timestamp_utc", zone: str = timefn.LOCAL_ZONE
) -> DataFrame:
    """Mean by local weekday and hour, long form (weekday 0 = Monday)."""
    wall = timefn.local_wall(ts, zone)
    return df.groupBy(F.weekday(wall).alias("weekday"), F.hour(wall).alias("hour")).agg(
        F.avg(value).alias("mean_error")
    )


def hour_weekday_pivot(
    df: DataFrame, value: str = "error", ts: str = "timestamp_utc", zone: str = timefn.LOCAL_ZONE
) -> DataFrame:
    """The same as a 7 x 24 table with columns h00..h23."""
    wall = timefn.local_wall(ts, zone)
    wide = (
        df.withColumn("__hour", F.format_string("h%02d", F.hour(wall)))
        .groupBy(F.weekday(wall).alias("weekday"))
        .pivot("__hour", [f"h{h:02d}" for h in range(24)])
        .agg(F.avg(value))
    )
    days = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return days.join(wide, "weekday", "left")


def error_band(
    df: DataFrame, low: float = 0.1, high: float = 0.9, error: str = "error"
) -> DataFrame:
    """Empirical error quantiles per horizon, linear interpolation; all horizons at once, without a buffer."""
    if not 0.0 <= low < high <= 1.0:
        raise ValueError(f"need 0 <= low < high <= 1, got {(low, high)}")
    bands = quantiles.quantiles(df, ["horizon_h"], error, [low, high])
    return bands.select("horizon_h", F.col("q")[0].alias("q_low"), F.col("q")[1].alias("q_high"))


def forecast_band(point: DataFrame, band: DataFrame, predicted: str = "y_pred") -> DataFrame:
    """Point forecast with its band; joined on the horizon."""
    return (
        point.join(band, "horizon_h", "left")
        .withColumn("band_low", F.col(predicted) + F.col("q_low"))
        .withColumn("band_high", F.col(predicted) + F.col("q_high"))
        .drop("q_low", "q_high")
    )


def autocorrelation(
    df: DataFrame,
    value: str,
    lags: int = 168,
    ix: str = "ix",
    block: int = 10_000,
    z: float = 1.959963984540054,
) -> DataFrame:
    """Biased autocorrelation for lags 0..L with the Bartlett band.

    A block of the series, with the L rows after it, gives its L + 1 sums of
    products as dot products; a sum for each lag and block is all that is
    shuffled. A null value is an error.
    """
    x = F.col(value).cast("double")
    mean = df.agg(F.avg(x)).scalar()
    centred = df.select(ix, (x - mean).alias("d"))
    block = max(block, lags + 1)
    at, own = F.col(ix), F.floor(F.col(ix) / F.lit(block))
    # A row serves its own block and, near its start, the block before.
    reach = F.floor((at - F.lit(lags)) / F.lit(block))
    copies = centred.select(
        "d", at.alias("ix"), F.explode(F.sequence(F.greatest(reach, F.lit(0).cast("long")), own)).alias("block")
    )

    def block_sums(key, rows):
        place = rows.column("ix").to_numpy() - key[0].as_py() * block
        d = np.zeros(block + lags)
        d[place] = rows.column("d").to_numpy()
        s = [float(d[:block] @ d[lag : lag + block]) for lag in range(lags + 1)]
        return pa.table({"lag": pa.array(range(lags + 1), pa.int32()), "s": s})

    sums = copies.groupBy("block").applyInArrow(block_sums, "lag int, s double")
    sums = sums.groupBy("lag").agg(F.sum("s").alias("s"))
    whole = df.agg(
        F.struct(F.count(x).alias("n"), F.sum((x - mean) * (x - mean)).alias("v")).alias("w")
    ).scalar()
    acf = sums.withColumn("__w", whole).select(
        "lag", F.try_divide("s", F.col("__w.v")).alias("acf"), F.col("__w.n").alias("n")
    )
    # L + 1 rows: the band needs the sum of squares of the earlier lags.
    earlier = Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    below = F.sum(F.when(F.col("lag") >= 1, F.col("acf") * F.col("acf"))).over(earlier)
    band = z * F.sqrt((1 + 2 * F.coalesce(below, F.lit(0.0))) / F.col("n"))
    return acf.select("lag", "acf", F.when(F.col("lag") > 0, band).otherwise(0.0).alias("band"))


def decompose(
    df: DataFrame, value: str, period: int, ix: str = "ix", block: int = 10_000
) -> DataFrame:
    """Classical additive parts: centred moving average, mean by phase, remainder.

    Even periods use the 2 x period average. Edges without a full frame have a
    null trend and remainder.
    """
    half = period // 2
    x = F.col(value).cast("double")

    def frames(w) -> dict:
        full = F.count(x).over(w.rowsBetween(-half, half)) == 2 * half + 1
        if period % 2:
            mean = F.avg(x).over(w.rowsBetween(-half, half))
        else:
            left = F.sum(x).over(w.rowsBetween(-half, half - 1))
            right = F.sum(x).over(w.rowsBetween(-half + 1, half))
            mean = (left + right) / (2.0 * period)
        return {"trend": F.when(full, mean)}

    trended = ordered.blocked(df, frames, before=half, after=half, ix=ix, block=block)
    phase = F.pmod(F.col(ix), F.lit(period))
    detrended = trended.withColumn("phase", phase).withColumn("__d", x - F.col("trend"))
    by_phase = detrended.groupBy("phase").agg(F.avg("__d").alias("__m"))
    level = by_phase.agg(F.avg("__m")).scalar()
    seasonal = by_phase.select("phase", (F.col("__m") - level).alias("seasonal"))
    return (
        detrended.join(seasonal, "phase", "left")
        .withColumn("remainder", F.col("__d") - F.col("seasonal"))
        .drop("__d", "phase")
    )


def overlay(
    actual: DataFrame,
    forecasts: Mapping[str, DataFrame],
    ts: str = "timestamp_utc",
    zone: str = timefn.LOCAL_ZONE,
) -> DataFrame:
    """Actual values beside each named forecast, on UTC and local time."""
    parts = None
    for name, frame in forecasts.items():
        rows = frame.select(ts, F.lit(name).alias("model"), F.col("y_pred").alias("v"))
        parts = rows if parts is None else parts.unionByName(rows)
    wide = parts.groupBy(ts).pivot("model", list(forecasts)).agg(F.max("v"))
    return actual.join(wide, ts, "left").withColumn("local_time", timefn.local_wall(ts, zone))


def residual_series(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    return df.select(ts, (F.col("y_true") - F.col("y_pred")).alias("residual"))


def ablation(
    scores: DataFrame,
    baseline: str,
    names: Sequence[str],
    points_of: str = "mape",
    residuals: DataFrame | None = None,
) -> DataFrame:
    """Metric means per model and the improvement on a baseline in points.

    With ``residuals(model, error)``, also the deviation of each model's errors.
    """
    means = scores.groupBy("model").agg(*(F.avg(n).alias(n) for n in names))
    if residuals is not None:
        spread = residuals.groupBy("model").agg(F.stddev_pop("error").alias("residual_std"))
        means = means.join(spread, "model", "left")
    base = means.filter(F.col("model") == baseline).select(points_of).scalar()
    return means.withColumn("improvement_pp", (base - F.col(points_of)) * 100.0)


def capped_sample(df: DataFrame, key: str, rows: int = 20_000, seed: int = 0) -> DataFrame:
    """A seeded sample of at most ``rows`` rows: those with the smallest key hash.

    This is the sampling operator itself; the row limit is its purpose. A
    partition passes on at most ``rows`` rows, and the sample comes back in the
    order of its key.
    """
    drawn = df.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256))
    return drawn.orderBy("__h").limit(rows).drop("__h").orderBy(key)
