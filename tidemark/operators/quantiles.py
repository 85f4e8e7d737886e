"""Exact quantiles of many groups at once, by narrowing cells instead of buffering values.

For each group and rank the cell of values that holds the rank is known. One pass counts the
values of all open cells in bins of equal width, with each bin's least and greatest value, and the
bin that holds the rank is the next cell. Counts are combined before the shuffle, so a group with
a large share of all rows costs no more than its bins. The first pass bins by sign and binary exponent,
so that outliers do not blunt the later ones. A cell is closed when its values are equal; a cell of
a bounded number of values is read and put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage_table

BINS = 1024
# A cell of so many values is read as it is.
SMALL_CELL = 2048
# Beyond the exponents of doubles, which end at -1074 and 1024.
EXPONENT_SHIFT = 1100
INFINITE_BIN, NAN_BIN = 3000, 4000


def _first_bin(v: Column) -> Column:
    """A number that never falls as ``v`` grows: the binary exponent with the sign of ``v``."""
    exponent = F.floor(F.log2(F.abs(v))) + EXPONENT_SHIFT
    return (
        F.when(F.isnan(v), F.lit(NAN_BIN))
        .when(v == float("inf"), F.lit(INFINITE_BIN))
        .when(v == float("-inf"), F.lit(-INFINITE_BIN))
        .when(v == 0, F.lit(0))
        .otherwise(F.when(v > 0, exponent).otherwise(-exponent))
        .cast("int")
    )


def _chosen(binned: DataFrame, by: list[str]) -> DataFrame:
    """The cells of the ranks: ``binned(*by, rank, skip, bin, n, low, high)``, one bin for each rank."""
    before = Window.partitionBy(*by, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = (F.col("below") <= F.col("skip")) & (F.col("skip") < F.col("below") + F.col("n"))
    return placed.where(inside).select(*by, "rank", (F.col("skip") - F.col("below")).alias("skip"), "n", "low", "high")


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Column, small: int = SMALL_CELL) -> DataFrame:
    """``*by, rank, n_values, value``: the values at 0-based ``ranks`` of each group in ascending order.

    ``ranks`` is an array computed from ``n_values``, the number of a group's values that are not
    null; ranks beyond it have no row. Groups may be null. NaN is the greatest value.
    """
    by = list(by)
    # A struct is never null and equal to one with the same nulls, so cells join by equality.
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull()).select(key.alias("__key"), F.col(value).cast("double").alias("__v"))
    rows = stage_table(rows, "quantiles")
    extent = (F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    first = stage_table(rows.groupBy("__key", _first_bin(F.col("__v")).alias("bin")).agg(*extent), "first-bins")
    totals = first.groupBy("__key").agg(F.sum("n").alias("n_values"))
    asked = totals.select("__key", "n_values", F.explode(F.array_distinct(ranks)).alias("rank"))
    asked = stage_table(asked.where("rank between 0 and n_values - 1"), "ranks")
    binned = first.join(asked.select("__key", "rank", F.col("rank").alias("skip")), "__key")
    cells = stage_table(_chosen(binned, ["__key"]), "cells")
    done = None

    while True:
        # Equal by order, not by ==, so that a cell of NaN is closed, too.
        closed = cells.where("low <=> high").select("__key", "rank", F.col("low").alias("value"))
        done = closed if done is None else done.unionByName(closed)
        few = cells.where(~F.col("low").eqNullSafe(F.col("high")) & (F.col("n") <= small))
        wide = cells.where(~F.col("low").eqNullSafe(F.col("high")) & (F.col("n") > small))
        done = done.unionByName(_read_small(rows, few))
        if wide.isEmpty():
            break
        found = rows.join(wide.drop("n"), "__key").where("__v between low and high")
        share = (F.col("__v") - F.col("low")) / (F.col("high") - F.col("low"))
        # The greatest value has its own bin: a cell always loses at least one value.
        place = F.when(F.col("__v") == F.col("high"), F.lit(BINS)).otherwise(F.floor(share * BINS))
        binned = found.groupBy("__key", "rank", "skip", place.cast("int").alias("bin")).agg(*extent)
        cells = stage_table(_chosen(binned, ["__key"]), "cells")

    named = asked.join(done, ["__key", "rank"])
    return named.select(*(F.col(f"__key.{c}").alias(c) for c in by), "rank", "n_values", "value")


def _read_small(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The values at the ranks of cells with a bounded number of values."""
    inside = rows.join(cells, "__key").where("__v between low and high")
    place = F.row_number().over(Window.partitionBy("__key", "rank").orderBy("__v"))
    return inside.withColumn("place", place - 1).where("place = skip").select("__key", "rank", F.col("__v").alias("value"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float], small: int = SMALL_CELL) -> DataFrame:
    """``*by, n_values, q``: quantiles of each group at ``levels``, with linear interpolation.

    ``q`` is an array in the order of ``levels``. Null values do not count, and a group without
    others has no row.
    """
    if not levels or any(not 0.0 <= p <= 1.0 for p in levels):
        raise ValueError(f"levels must lie between 0 and 1, got {list(levels)}")
    by = list(by)
    last = (F.col("n_values") - 1).cast("double")
    ends = [f(F.lit(float(p)) * last).cast("long") for p in levels for f in (F.floor, F.ceil)]
    found = order_statistics(df, by, value, F.array(*ends), small)
    held = found.groupBy(*by, "n_values").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def level(p: float) -> Column:
        position = F.lit(float(p)) * last
        low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
        between = F.col("at")[low] * (high - position) + F.col("at")[high] * (position - low)
        return F.when(low == high, F.col("at")[low]).otherwise(between)

    return held.select(*by, "n_values", F.array(*(level(p) for p in levels)).alias("q"))
