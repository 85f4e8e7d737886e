"""Local regression on a grid from one pass over the rows.

Rows are reduced to the moments of narrow bins of the regressor; a grid point weighs the bins near it with
a kernel and solves two equations. The cost after the pass depends on bins and grid points, not
on rows. Inside a bin the moments are exact; only the kernel's weight is that of the bin's middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage_table

MOMENTS = ("n", "sx", "sy", "sxx", "sxy")


def bin_moments(df: DataFrame, x: str, y: str, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, bin`` and the sums of 1, x, y, xx, xy over each bin of ``width``; sums of these are moments, too."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, F.floor(a / F.lit(width)).alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum(a).alias("sx"),
        F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"),
        F.sum(a * b).alias("sxy"),
    )


def local_line(
    df: DataFrame,
    x: str,
    y: str,
    step: float = 1.0,
    bandwidth: float = 3.0,
    width: float = 0.25,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``*by, x, fitted, slope, rows_near``: a kernel-weighted line at each grid point with rows near.

    Grid points are the multiples of ``step`` between the least and the greatest bin. A bin at
    distance d < ``bandwidth`` weighs (1 - (d / bandwidth)^3)^3. Where all weight lies on one
    value of x the fit is the mean and the slope null. Rows with a null do not count.
    """
    moments = stage_table(bin_moments(df, x, y, width, by), "bin-moments")
    middle = (F.col("bin") + 0.5) * F.lit(width)
    # The grid points a bin can reach: a handful for each bin.
    low, high = F.ceil((middle - bandwidth) / step), F.floor((middle + bandwidth) / step)
    span = F.struct(F.ceil(F.min("bin") * width / step).alias("first"), F.floor((F.max("bin") + 1) * width / step).alias("last"))
    ends = moments.groupBy(*by).agg(span.alias("span"))
    reach = moments.withColumn("middle", middle).withColumn("point", F.explode(F.sequence(low, high)))
    distance = F.abs(F.col("middle") - F.col("point") * F.lit(step)) / F.lit(bandwidth)
    weight = F.when(distance < 1, F.pow(1 - F.pow(distance, F.lit(3.0)), F.lit(3.0))).otherwise(0.0)
    summed = (
        reach.withColumn("w", weight)
        .where("w > 0")
        .groupBy(*by, "point")
        .agg(F.sum("n").alias("rows_near"), *(F.sum(F.col("w") * F.col(m)).alias(m) for m in MOMENTS))
    )
    inside = summed.join(ends, list(by)) if by else summed.withColumn("span", ends.scalar())
    inside = inside.where("point between span.first and span.last")
    mean_x, mean_y = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    spread = F.col("sxx") / F.col("n") - mean_x * mean_x
    shared = F.col("sxy") / F.col("n") - mean_x * mean_y
    # Rounding leaves a little spread where there is none.
    slope = F.when(spread > 1e-12 * F.greatest(F.col("sxx") / F.col("n"), F.lit(1e-300)), shared / spread)
    at = F.col("point") * F.lit(step)
    return inside.select(
        *by,
        at.alias("x"),
        F.when(slope.isNull(), mean_y).otherwise(mean_y + slope * (at - mean_x)).alias("fitted"),
        slope.alias("slope"),
        "rows_near",
    )
