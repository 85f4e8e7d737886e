"""Ordered operations that never put all rows of a series on one task.

Running values, row positions, as-of lookups and lagged frames all need rows in
order. A plain ``Window.orderBy`` without a partition sends the whole table to
one task, and a window by key sends a hot key there. Here the order column is
cut into buckets:

1. a window inside each (key, bucket) gives the local running value;
2. one summary row per (key, bucket) is combined across buckets (a table as
   small as the number of buckets);
3. the carry of the earlier buckets joins back on (key, bucket).

How the buckets are cut is a parameter, a function that adds the bucket column;
the path is the same at every size. ``width`` is arithmetic and lazy: right
where the order values are unique on a grid (hourly tables), because the width
then bounds the rows of a bucket. ``balanced`` takes quantiles of the order
column, so that a burst in time or one hot key is still cut in even pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage_table

BUCKET = "__bucket"
DAY_MICROS = 86_400_000_000
# 30 days of an hourly series: 720 rows per key.
DEFAULT_WIDTH_MICROS = 30 * DAY_MICROS
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 8

BucketCut = Callable[[DataFrame, Sequence[str]], DataFrame]


def order_number(df: DataFrame, column: str) -> Column:
    """The order column as a long: microseconds for instants, days for dates."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(column)).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    raise TypeError(f"order column {column!r} has type {kind.simpleString()}")


def width(size: int = DEFAULT_WIDTH_MICROS) -> BucketCut:
    """Equal-width buckets: ``size`` microseconds (or units of an integer order)."""

    def cut(df: DataFrame, order: Sequence[str]) -> DataFrame:
        return df.withColumn(BUCKET, F.floor(order_number(df, order[0]) / F.lit(size)))

    return cut


def balanced(
    rows_per_bucket: int = ROWS_PER_BUCKET, least_buckets: int = LEAST_BUCKETS
) -> BucketCut:
    """Equal-depth buckets from the quantiles of the order column.

    The rows are staged first, so that the count, the quantiles and both halves
    of the ordered operation read them from there and not from their sources.
    There are ``least_buckets`` at any size, and more where a bucket would
    exceed ``rows_per_bucket``. All edges are fixed once, as literals or in a
    staged table: a task that runs again cuts as before.
    """

    def cut(df: DataFrame, order: Sequence[str]) -> DataFrame:
        df = stage_table(df, "ordered")
        number = order_number(df, order[0]).cast("double")
        buckets = max(least_buckets, -(-df.count() // rows_per_bucket), 2)
        probabilities = [i / buckets for i in range(1, buckets)]
        splits = df.select(number.alias("v")).approxQuantile(
            "v", probabilities, 1.0 / (4 * buckets)
        )
        if not splits:  # no rows
            return df.withColumn(BUCKET, F.lit(0).cast("long"))
        repeats = Counter(splits)
        crowded = [v for v, n in repeats.items() if n > 1]
        # Order values are whole numbers, so [v, v + 1) holds one crowded value only.
        inner = sorted({*splits, *(v + 1 for v in crowded)})
        cutter = Bucketizer(
            splits=[float("-inf"), *inner, float("inf")], inputCol="__order", outputCol=BUCKET
        )
        placed = cutter.transform(df.withColumn("__order", number))
        placed = placed.withColumn(BUCKET, F.col(BUCKET).cast("long"))
        if crowded and len(order) > 1 and _countable(df, order[1]):
            placed = _cut_ties(placed, order[1], crowded, 2 * max(repeats[v] for v in crowded))
        return placed.drop("__order")

    return cut


def _countable(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, (T.TimestampType, T.DateType, T.IntegralType))


def _cut_ties(placed: DataFrame, tie: str, crowded: list[float], pieces: int) -> DataFrame:
    """Cut the buckets of crowded order values by quantiles of the next order column."""
    probabilities = F.array(*(F.lit(i / pieces) for i in range(1, pieces)))
    edges = (
        placed.filter(F.col("__order").isin(crowded))
        .groupBy(F.col("__order"))
        .agg(
            F.percentile_approx(
                order_number(placed, tie), probabilities, F.lit(20 * pieces)
            ).alias("__edges")
        )
    )
    # The sketch depends on the order of merges; staged, it is taken once.
    edges = stage_table(edges, "edges")
    piece = F.size(F.filter("__edges", lambda e: e <= order_number(placed, tie)))
    return (
        placed.join(edges, "__order", "left")
        .withColumn(
            BUCKET,
            F.struct(
                F.col(BUCKET).alias("at"),
                F.when(F.col("__edges").isNull(), 0).otherwise(piece).alias("piece"),
            ),
        )
        .drop("__edges")
    )


@dataclass(frozen=True)
class Running:
    """One running value: its kind and the column it runs over."""

    kind: str  # sum | min | max | count | last
    column: str

    def over(self, window) -> Column:
        c = F.col(self.column)
        if self.kind == "last":
            return F.last(c, ignorenulls=True).over(window)
        return getattr(F, self.kind)(c).over(window)

    def summary(self, position: Column) -> Column:
        c = F.col(self.column)
        if self.kind == "last":
            # max_by over rows that hold a value: nulls carry nothing forward.
            return F.max_by(c, F.when(c.isNotNull(), position))
        return getattr(F, self.kind)(c)

    def carry(self, summary: Column, window) -> Column:
        if self.kind == "last":
            return F.last(summary, ignorenulls=True).over(window)
        if self.kind == "count":
            return F.sum(summary).over(window)
        return getattr(F, self.kind)(summary).over(window)

    def combine(self, carry: Column, local: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(local, carry)
        if self.kind == "min":
            return F.least(carry, local)
        if self.kind == "max":
            return F.greatest(carry, local)
        if self.kind == "count":
            return F.coalesce(carry, F.lit(0)) + local
        return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))


def guard_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refuse null keys, so that the carry can join by plain equality.

    Plain equality keeps the (key, bucket) partitioning of the window, so the
    rows are not shuffled a second time.
    """
    if not keys:
        return df
    return df.withColumns(
        {k: F.coalesce(F.col(k), F.raise_error(F.lit(f"null in key {k}"))) for k in keys}
    )


def attach(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of the carries on (key, bucket)."""
    return left.join(right, list(on), "left")


def running(
    df: DataFrame,
    order: str | Sequence[str],
    values: dict[str, Running],
    keys: Sequence[str] = (),
    cut: BucketCut | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running values up to each row, per key, with or without the row itself.

    ``order`` names the order column and further columns that break ties;
    together they must be unique within a key. Buckets are cut on the first one,
    and ``balanced`` cuts a crowded value of it further on the second.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = list(keys)
    placed = (cut or balanced())(guard_keys(df, keys), order)
    group = [*keys, BUCKET]
    inside = (
        Window.partitionBy(*group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = placed.select(
        "*", *(v.over(inside).alias(f"__l_{name}") for name, v in values.items())
    )
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    summaries = placed.groupBy(*group).agg(
        *(v.summary(position).alias(f"__s_{name}") for name, v in values.items())
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = summaries.select(
        *group,
        *(
            v.carry(F.col(f"__s_{name}"), earlier).alias(f"__c_{name}")
            for name, v in values.items()
        ),
    )
    joined = attach(local, carries, group)
    return joined.select(
        *(c for c in df.columns if c not in values),
        *(
            v.combine(F.col(f"__c_{name}"), F.col(f"__l_{name}")).alias(name)
            for name, v in values.items()
        ),
    )


def row_index(
    df: DataFrame,
    order: str | Sequence[str],
    keys: Sequence[str] = (),
    cut: BucketCut | None = None,
    name: str = "ix",
) -> DataFrame:
    """0-based position of every row in its series."""
    counted = running(
        df.withColumn("__one", F.lit(1).cast("long")),
        order,
        {name: Running("sum", "__one")},
        keys,
        cut,
    )
    return counted.withColumn(name, F.col(name) - 1).drop("__one")


def numbered(ordered_rows: DataFrame, name: str = "ix") -> DataFrame:
    """0-based positions in the order a frame is already in.

    A row has its place inside its part; the parts before it add their row counts. The order is the
    frame's own: nothing is sorted or compared again.
    """
    rows = stage_table(ordered_rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    place = F.col("__at") - F.shiftleft("__part", 33) + F.col("__start")
    placed = rows.withColumn("__part", part).join(starts, "__part")
    return placed.withColumn(name, place).drop("__part", "__at", "__start")


def following(
    df: DataFrame,
    order: str,
    column: str,
    name: str,
    keys: Sequence[str] = (),
    cut: BucketCut | None = None,
) -> DataFrame:
    """The column's value on the next row of the key; null on the last row."""
    keys = list(keys)
    placed = (cut or balanced())(guard_keys(df, keys), [order])
    group = [*keys, BUCKET]
    inside = Window.partitionBy(*group).orderBy(order)
    local = placed.withColumn("__next", F.lead(F.struct(column)).over(inside))
    firsts = placed.groupBy(*group).agg(
        F.min_by(F.struct(column), F.col(order)).alias("__first")
    )
    later = Window.partitionBy(*keys).orderBy(BUCKET)
    carries = firsts.select(*group, F.lead("__first").over(later).alias("__carry"))
    joined = attach(local, carries, group)
    value = F.coalesce(F.col("__next"), F.col("__carry"))[column]
    return joined.select(*df.columns, value.alias(name))


def blocked(
    df: DataFrame,
    build: Callable[[object], dict[str, Column]],
    keys: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    ix: str = "ix",
    block: int = 10_000,
) -> DataFrame:
    """Windows that look at most ``before`` rows back and ``after`` rows on.

    Rows are cut by position in equal blocks, and each block also receives the
    few rows next to it, so any frame inside [-before, +after] is complete and
    no block can be hot. ``build`` gets the ordered window of a block.
    """
    block = max(block, before + after)
    home = F.floor(F.col(ix) / F.lit(block))
    low = F.floor((F.col(ix) - F.lit(after)) / F.lit(block))
    high = F.floor((F.col(ix) + F.lit(before)) / F.lit(block))
    copies = df.select("*", F.explode(F.sequence(low, high)).alias(BUCKET))
    window = Window.partitionBy(*keys, BUCKET).orderBy(ix)
    columns = build(window)
    return (
        copies.select("*", *(c.alias(name) for name, c in columns.items()))
        .filter(F.col(BUCKET) == home)
        .drop(BUCKET)
    )


def bounded_fill(
    df: DataFrame,
    columns: Sequence[str],
    limit: int,
    keys: Sequence[str] = (),
    ix: str = "ix",
    block: int = 10_000,
) -> DataFrame:
    """Fill nulls from at most ``limit`` rows back (rows, not elapsed time)."""
    if limit <= 0:
        return df
    filled = blocked(
        df,
        lambda w: {
            f"__f_{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))
            for c in columns
        },
        keys,
        before=limit,
        ix=ix,
        block=block,
    )
    return filled.select(
        *(F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns)
    )


def lagged(
    df: DataFrame,
    column: str,
    rows: int,
    name: str,
    keys: Sequence[str] = (),
    ix: str = "ix",
    block: int = 10_000,
) -> DataFrame:
    """The column's value a fixed number of rows back."""
    return blocked(
        df, lambda w: {name: F.lag(column, rows).over(w)}, keys, before=rows, ix=ix, block=block
    )


def seasonal_difference(
    df: DataFrame, column: str, rows: int, name: str, keys: Sequence[str] = (), ix: str = "ix"
) -> DataFrame:
    """y(t) - y(t - rows); null for the first season."""
    back = lagged(df, column, rows, "__lag", keys, ix)
    return back.withColumn(name, F.col(column) - F.col("__lag")).drop("__lag")


def sequence_windows(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int,
    keys: Sequence[str] = (),
    ix: str = "ix",
    block: int = 10_000,
) -> DataFrame:
    """The features of the previous ``length`` rows with the target of this row.

    Only full windows are kept, so a series of n rows gives n - length windows.
    """
    if length < 2:
        raise ValueError(f"length must be >= 2, got {length}")
    row = F.array(*(F.col(c).cast("float") for c in features))
    framed = blocked(
        df.withColumn("__row", row),
        lambda w: {"window": F.collect_list("__row").over(w.rowsBetween(-length, -1))},
        keys,
        before=length,
        ix=ix,
        block=block,
    )
    return framed.filter(F.size("window") == length).select(
        *keys, ix, "window", F.col(target).cast("float").alias("target")
    )


def tail_split(
    df: DataFrame,
    fraction: float = 0.1,
    minimum: int = 1,
    ix: str = "ix",
    name: str = "is_tail",
) -> DataFrame:
    """Mark the last ``fraction`` of a series, at least ``minimum`` rows."""
    rows = df.agg((F.max(ix) + 1).alias("n")).scalar()
    tail = F.greatest(F.lit(minimum).cast("long"), F.floor(rows * F.lit(fraction)))
    return df.withColumn(name, F.col(ix) >= rows - tail)


def running_total(
    windows: DataFrame,
    start: str,
    end: str,
    value: str,
    keys: Sequence[str] = (),
    cut: BucketCut | None = None,
) -> DataFrame:
    """Step series of intervals: +value at start, -value at end, summed over time.

    Deltas of the same instant are summed before anything is ordered, so the
    ordered part sees each instant once.
    """
    keys = list(keys)
    deltas = windows.filter(F.col(start) < F.col(end)).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("t"), F.col(value).cast("double").alias("delta")),
                F.struct(F.col(end).alias("t"), (-F.col(value).cast("double")).alias("delta")),
            )
        ).alias("e"),
    )
    per_instant = deltas.groupBy(*keys, F.col("e.t").alias("t")).agg(
        F.sum("e.delta").alias("delta")
    )
    return running(per_instant, "t", {"total": Running("sum", "delta")}, keys, cut or balanced())


def step_lookup(
    steps: DataFrame,
    grid: DataFrame,
    order: str,
    value: str,
    keys: Sequence[str] = (),
    default: object | None = None,
    cut: BucketCut | None = None,
) -> DataFrame:
    """Latest step at or before each grid row (backward as-of), per key.

    ``steps`` holds one row per (key, order). Equal instants match.
    """
    keys = list(keys)
    extra = [c for c in grid.columns if c not in (*keys, order)]
    wrapped = F.struct(F.col(value)).alias("__step")
    step_rows = steps.select(*keys, order, F.lit(0).alias("__side"), wrapped)
    # Many grid rows may share an instant: each instant is asked once and joined back.
    asked = grid.select(*keys, order).distinct().withColumn("__side", F.lit(1))
    both = step_rows.unionByName(asked, allowMissingColumns=True)
    found = running(both, [order, "__side"], {"__hit": Running("last", "__step")}, keys, cut)
    answers = found.filter(F.col("__side") == 1).select(*keys, order, "__hit")
    hit = F.col("__hit")[value]
    if default is not None:
        hit = F.coalesce(hit, F.lit(default))
    return grid.join(answers, [*keys, order], "left").select(
        *keys, order, *extra, hit.alias(value)
    )
