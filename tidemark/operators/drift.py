"""Drift of feature distributions against a reference, and prediction error over time.

Tables are long, ``feature, window, value``; the reference is the rows of ``feature, value`` it is
compared with. All features and windows are done at once. Nothing here knows the model or how windows
were cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.quantiles import quantiles
from tidemark.session import stage_table

# A share that is compared by its logarithm is at least this.
LEAST_SHARE = 1e-4
# Distinct values of a part of the merged order.
PART_ROWS = 200_000
DAY_MICROS = ordered.DAY_MICROS


def long_form(df: DataFrame, features: Sequence[str], window: Column) -> DataFrame:
    """A feature table as ``feature, window, value``."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features))
    rows = df.select(window.alias("window"), F.explode(cells).alias("c"))
    return rows.select(F.col("c.feature").alias("feature"), "window", F.col("c.value").alias("value"))


def bin_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """``feature, edges``: the inner quantiles of the reference that cut it in bins of equal share."""
    levels = [i / bins for i in range(1, bins)]
    cut = quantiles(reference, ["feature"], "value", levels)
    return cut.select("feature", F.array_distinct("q").alias("edges"))


def binned_counts(rows: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """``*by, bin, n``: values in each bin; those equal to an edge are below it. Sums of such counts are counts."""
    joined = rows.where("value is not null").join(edges, "feature")
    place = F.size(F.filter("edges", lambda e: e < F.col("value")))
    return joined.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))


def distribution_drift(reference: DataFrame, rows: DataFrame, bins: int = 10) -> DataFrame:
    """``feature, window, n, psi, overlap`` for every window of every feature of the reference.

    Bins are the reference's quantiles. ``psi`` is the stability index, in which an empty bin counts as a
    share of ``LEAST_SHARE``; ``overlap`` the sum of the smaller shares, 1 for equal histograms. Features
    without reference have no row. Nulls do not count.
    """
    edges = stage_table(bin_edges(reference, bins), "edges")
    was = binned_counts(reference, edges, ["feature"])
    was = was.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))
    now = stage_table(binned_counts(rows, edges, ["feature", "window"]), "binned")
    totals = now.groupBy("feature", "window").agg(F.sum("n").alias("total"))
    # Every bin of a window, also those that it or the reference has no value in.
    slots = totals.join(edges, "feature").select(
        "feature", "window", "total", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin")
    )
    cells = _matched(slots, now, ["feature", "window", "bin"]).withColumn("n", F.coalesce("n", F.lit(0)))
    cells = cells.join(was.select("feature", "bin", "p"), ["feature", "bin"], "left")
    p, q = F.coalesce("p", F.lit(0.0)), F.col("n") / F.col("total")
    low_p, low_q = F.greatest(p, F.lit(LEAST_SHARE)), F.greatest(q, F.lit(LEAST_SHARE))
    return cells.groupBy("feature", "window").agg(
        F.max("total").alias("n"),
        F.sum((low_q - low_p) * F.log(low_q / low_p)).alias("psi"),
        F.sum(F.least(p, q)).alias("overlap"),
    )


def _matched(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on columns in which null equals null."""
    right = right.select(*(F.col(c).alias(f"__{c}" if c in names else c) for c in right.columns))
    match = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names))
    return left.join(right, match, "left").drop(*(f"__{c}" for c in names))


def ks_distance(reference: DataFrame, rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``feature, window, n, n_reference, ks``: the largest gap between the two distribution functions, exactly.

    Equal values are counted first, and the distinct ones of both samples are merged in one order for
    each feature, cut in parts of bounded size. A part needs only the counts of the parts before it, so
    no feature is ordered in one task, and the reference is not copied for each window. Values that
    are null or NaN do not count; a feature without reference, or a window without values, has no row.
    """
    usable = "value is not null and not isnan(value)"
    # A struct with a null window is not null: null itself marks the reference.
    own = rows.where(usable).select("feature", F.struct("window").alias("w"), F.col("value").cast("double"))
    none = F.lit(None).cast(own.schema["w"].dataType).alias("w")
    base = reference.where(usable).select("feature", none, F.col("value").cast("double"))
    counts = own.unionByName(base).groupBy("feature", "w", "value").agg(F.count("*").alias("n"))
    counts = stage_table(counts, "ks-counts")
    parts = max(2, -(-counts.count() // part_rows))
    cut = counts.repartitionByRange(parts, "feature", "value").sortWithinPartitions("feature", "value")
    cut = stage_table(cut.withColumn("part", F.spark_partition_id()), "ks-parts")
    sums = cut.groupBy("feature", "w", "part").agg(F.sum("n").alias("n"))
    sums = sums.select(
        "feature",
        "w",
        "part",
        "n",
        F.sum("n").over(Window.partitionBy("feature", "w")).alias("total"),
    )
    sums = stage_table(sums, "ks-sums")
    spans = sums.select("feature", "part").distinct()
    # A window may have no value in a part in which the reference moves away from it.
    totals = sums.where("w is not null").groupBy("feature", "w").agg(F.max("total").alias("total"))
    inside = sums.where("w is not null").select("feature", "w", F.col("part"), "n")
    reach = totals.join(spans.select("feature", "part"), "feature")
    present = _matched(reach, inside, ["feature", "w", "part"]).withColumn("n", F.coalesce("n", F.lit(0)))
    by_part = Window.partitionBy("feature", "w").orderBy("part")
    carried = present.withColumn("below", F.sum("n").over(by_part) - F.col("n")).drop("n")
    ref_below = sums.where("w is null").groupBy("feature").agg(F.max("total").alias("n_reference"))
    ref_n = sums.where("w is null").select("feature", "part", F.col("n").alias("ref_n"))
    ref = spans.join(ref_n, ["feature", "part"], "left")
    ref = ref.withColumn("ref_n", F.coalesce("ref_n", F.lit(0)))
    by_feature = Window.partitionBy("feature").orderBy("part")
    ref = ref.select("feature", "part", (F.sum("ref_n").over(by_feature) - F.col("ref_n")).alias("ref_below"))
    carried = carried.join(ref, ["feature", "part"]).join(ref_below, "feature")

    def widest(group: pa.Table, carries: pa.Table) -> pa.Table:
        value, n = group.column("value").to_numpy(), group.column("n").to_numpy()
        which = group.column("w").combine_chunks()
        is_ref = np.array(which.is_null())
        named = {}
        labels = [None if w is None else repr(w) for w in which.to_pylist()]
        for k, label in enumerate(labels):
            named.setdefault(label, []).append(k)
        order = np.argsort(value, kind="stable")
        value, rank = value[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # The last place of each distinct value: functions are compared after all equal values.
        last = np.flatnonzero(np.append(value[1:] != value[:-1], True)) if len(value) else np.zeros(0, np.int64)
        step = np.zeros(len(order))
        step[rank[is_ref]] = n[is_ref]
        ref = np.cumsum(step)[last]
        gaps = []
        for carry in carries.to_pylist():
            mine = np.array(named.get(repr(carry["w"]), []), np.int64)
            step = np.zeros(len(order))
            step[rank[mine]] = n[mine]
            here = np.cumsum(step)[last] + carry["below"]
            gap = np.abs(here / carry["total"] - (ref + carry["ref_below"]) / carry["n_reference"])
            gaps.append(float(gap.max(initial=0.0)))
        columns = [carries.column(c) for c in ("feature", "w", "total", "n_reference")]
        return pa.Table.from_arrays([*columns, pa.array(gaps, pa.float64())], ["feature", "w", "n", "n_reference", "gap"])

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    ddl = f"feature {kinds['feature']}, w {kinds['w']}, n long, n_reference long, gap double"
    found = cut.groupBy("feature", "part").cogroup(carried.groupBy("feature", "part")).applyInArrow(widest, ddl)
    return (
        found.groupBy("feature", F.col("w.window").alias("window"))
        .agg(F.max("n").alias("n"), F.max("n_reference").alias("n_reference"), F.max("gap").alias("ks"))
    )


def rolling_error(
    rows: DataFrame,
    days: Sequence[int],
    keys: Sequence[str] = (),
    ts: str = "timestamp_utc",
    error: str = "error",
    block_micros: int = DAY_MICROS,
) -> DataFrame:
    """Mean absolute and root mean square error over the last ``days`` at every instant that has rows.

    ``*keys, ts`` and for each length d ``n_d, mae_d, rmse_d``. The frame of instant t holds the rows in
    (t - d, t]; rows need not be regular, and rows at one instant share their frame. Null errors do not count.

    Time is cut in blocks. A frame is the end of the block it starts in, whole blocks, and the start
    of the block of t. Whole blocks come from a table with one row for each block, so a row is not copied
    into the frames that hold it, whatever their length. Inside blocks, sums run in order.
    """
    keys = list(keys)
    if any(d * DAY_MICROS % block_micros for d in days):
        raise ValueError("a frame is a whole number of blocks")
    e = F.col(error).cast("double")
    at = rows.groupBy(*keys, ts).agg(
        F.count(e).alias("n"),
        F.coalesce(F.sum(F.abs(e)), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum(e * e), F.lit(0.0)).alias("s"),
    )
    micros = F.unix_micros(F.col(ts))
    at = stage_table(at.withColumn("block", F.floor(micros / F.lit(block_micros))), "instants")
    sums = ("n", "a", "s")
    blocks = stage_table(at.groupBy(*keys, "block").agg(*(F.sum(c).alias(c) for c in sums)), "blocks")
    out = None
    # Running sums of a block up to and with an instant; a block of any size is cut by ``running``.
    kinds = {f"in_{c}": ordered.Running("sum", f"in_{c}") for c in sums}
    copied = at.select(*keys, ts, "block", *(F.col(c).alias(f"in_{c}") for c in sums))
    upto = stage_table(ordered.running(copied, ts, kinds, [*keys, "block"]), "upto")
    held = at.select(*keys, "block").distinct()
    for d in days:
        span = d * DAY_MICROS // block_micros
        # Whole blocks after the one of t - d and before the one of t: a block is in the frames of the next ones.
        reached = F.sequence(F.lit(1), F.lit(span - 1)) if span > 1 else F.expr("cast(array() as array<int>)")
        lent = blocks.withColumn("on", F.explode(reached)).withColumn("block", F.col("block") + F.col("on"))
        lent = lent.groupBy(*keys, "block").agg(*(F.sum(c).alias(f"whole_{c}") for c in sums))
        whole = held.join(lent, [*keys, "block"], "left")
        # What block of t - d has up to t - d: the latest running sum at or before it, if of that block.
        grid = at.select(*keys, ts, (F.col("block") - span).alias("block"))
        grid = grid.withColumn("__t", F.timestamp_micros(F.unix_micros(ts) - F.lit(d * DAY_MICROS)))
        steps = upto.select(*keys, "block", F.col(ts).alias("__t"), F.struct(*(f"in_{c}" for c in sums)).alias("past"))
        past = ordered.step_lookup(steps, grid.select(*keys, "block", "__t"), "__t", "past", [*keys, "block"])
        past = past.join(blocks.select(*keys, "block", F.struct(*sums).alias("all")), [*keys, "block"], "left")
        past = past.select(
            *keys,
            F.timestamp_micros(F.unix_micros("__t") + F.lit(d * DAY_MICROS)).alias(ts),
            *(
                (F.coalesce(F.col(f"all.{c}"), F.lit(0)) - F.coalesce(F.col(f"past.in_{c}"), F.lit(0))).alias(f"tail_{c}")
                for c in sums
            ),
        )
        framed = upto.join(whole, [*keys, "block"], "left").join(past, [*keys, ts])
        total = {c: F.col(f"in_{c}") + F.coalesce(F.col(f"whole_{c}"), F.lit(0)) + F.col(f"tail_{c}") for c in sums}
        n = total["n"].cast("long")
        one = framed.select(
            *keys,
            ts,
            n.alias(f"n_{d}"),
            F.try_divide(total["a"], n).alias(f"mae_{d}"),
            F.sqrt(F.greatest(F.try_divide(total["s"], n), F.lit(0.0))).alias(f"rmse_{d}"),
        )
        out = one if out is None else out.join(one, [*keys, ts])
    return out
