"""The outage log: what was known when, and what was active when.

Published time (when a revision became known) and valid time (when the outage
runs) are separate axes. Two rules for "latest" exist and differ when revisions
arrive out of order: ``as_of`` takes the highest revision number published so
far, the hourly roll-up takes the last one in (published, revision) order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import timefn
from tidemark.operators import ordered
from tidemark.operators.ordered import BucketCut, Running
from tidemark.sources.contracts import ContractError, require_instants

WITHDRAWN = "Withdrawn"
UNPLANNED = "unplanned"
ROLLUP_INPUT = (
    "mrid",
    "revision_number",
    "message_status",
    "published_at",
    "effective_from",
    "effective_to",
    "cause",
    "affected_mw",
)


def latest_revision(log: DataFrame, key: str = "mrid", revision: str = "revision_number"):
    """The row with the highest revision per key.

    ``max_by`` combines before the shuffle, so a hot key is one row per task.
    """
    rest = [c for c in log.columns if c != key]
    return (
        log.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(revision)).alias("__row"))
        .select(key, "__row.*")
        .select(*log.columns)
    )


def as_of(log: DataFrame, t: Column) -> DataFrame:
    """Messages known at ``t``: published by then, latest revision, not withdrawn."""
    require_instants(log, "published_at")
    known = log.filter(F.col("published_at") <= t)
    return latest_revision(known).filter(F.col("message_status") != WITHDRAWN)


def active_at(known: DataFrame, t: Column) -> DataFrame:
    """Valid-time part: the outage runs at ``t``."""
    return known.filter(
        (F.col("effective_from") <= t)
        & (F.col("effective_to").isNull() | (F.col("effective_to") > t))
    )


def visibility(
    log: DataFrame, cut: BucketCut | None = None
) -> DataFrame:
    """When each revision is the highest known one of its key.

    A revision is visible from its publication until any higher revision is
    published; one that a higher revision preceded is never visible. The end is
    a running minimum over falling revision numbers, exclusive of the row.
    """
    falling = log.withColumns(
        {
            "__falling": -F.col("revision_number").cast("long"),
            "__published": F.col("published_at"),
        }
    )
    ends = ordered.running(
        falling,
        "__falling",
        {"visible_to": Running("min", "__published")},
        ["mrid"],
        cut or ordered.balanced(),
        inclusive=False,
    )
    return ends.select(*log.columns, F.col("published_at").alias("visible_from"), "visible_to")


def active_on(
    log: DataFrame,
    instants: DataFrame,
    step: str,
    t: str = "t",
    cut: BucketCut | None = None,
) -> DataFrame:
    """``active_at(as_of(t), t)`` for many evenly spaced instants in one pass.

    ``instants`` holds one row with the first and last instant (``lo``, ``hi``)
    and ``step`` is their spacing: one whole unit, such as ``1 month``. Each
    visible and active stretch expands to the instants it covers, which is the
    size of the answer; the log is not joined with the instants.
    """
    live = visibility(log, cut).filter(F.col("message_status") != WITHDRAWN)
    bounds = instants.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    start = F.greatest("visible_from", "effective_from")
    end = F.least("visible_to", "effective_to")  # least skips nulls: open ends stay open
    stretches = live.withColumn("__from", start).withColumn("__to", end)
    stretches = stretches.filter(
        (F.col("__to").isNull() | (F.col("__from") < F.col("__to"))) & (F.col("__from") <= hi)
    )
    unit = step.split()[-1]
    floor = F.date_trunc(unit, F.greatest(F.col("__from"), lo))
    first = F.when(floor >= F.greatest(F.col("__from"), lo), floor).otherwise(
        floor + F.expr(f"INTERVAL {step}")
    )
    last = F.least(hi, timefn.shift("__to", -1))
    return (
        stretches.withColumn("__first", first)
        .withColumn("__last", last)
        .filter(F.col("__first") <= F.col("__last"))
        .withColumn(
            t, F.explode(F.sequence("__first", "__last", F.expr(f"INTERVAL {step}")))
        )
        .select(t, *log.columns)
    )


def month_bounds(log: DataFrame, ts: str = "published_at") -> DataFrame:
    """First and last month start the fuel mix is read at."""
    month = lambda c: F.date_trunc("month", c)
    day = lambda c: F.date_trunc("day", c)
    return log.agg(
        month(F.min(ts)).alias("lo"),
        month(day(F.max(ts) + F.expr("INTERVAL 31 DAYS"))).alias("hi"),
    )


def fuel_mix(log: DataFrame, cut: BucketCut | None = None) -> DataFrame:
    """Unavailable MW by fuel at each month start, in long form.

    A missing fuel is 'Unknown'; a group with only null capacities sums to 0.
    """
    active = active_on(log, month_bounds(log), "1 month", "month", cut)
    return active.groupBy(
        "month", F.coalesce(F.nullif("fuel_type", F.lit("")), F.lit("Unknown")).alias("fuel_type")
    ).agg(F.coalesce(F.sum("affected_mw"), F.lit(0.0)).alias("total_mw"))


def fuel_mix_wide(mix: DataFrame, fuels: Sequence[str]) -> DataFrame:
    """One column per fuel, zero where a month has none."""
    return mix.groupBy("month").pivot("fuel_type", list(fuels)).agg(F.sum("total_mw")).fillna(0.0)


def revision_validity(log: DataFrame, cut: BucketCut | None = None) -> DataFrame:
    """``valid_from`` / ``valid_to`` of every revision on the published axis.

    Order within a key is (published, revision); withdrawn rows end the one
    before them. The last revision is open (null). Revisions published at the
    same instant end at once, all but the highest: so only one row per (key,
    instant) has to be put in order.
    """
    instants = log.groupBy("mrid", "published_at").agg(
        F.max("revision_number").alias("__top")
    )
    nexts = ordered.following(
        instants,
        "published_at",
        "published_at",
        "__next",
        ["mrid"],
        cut or ordered.balanced(),
    )
    joined = log.join(nexts, ["mrid", "published_at"], "left")
    ends = F.when(F.col("revision_number") < F.col("__top"), F.col("published_at")).otherwise(
        F.col("__next")
    )
    return joined.select(
        *log.columns, F.col("published_at").alias("valid_from"), ends.alias("valid_to")
    )


def known_stretches(log: DataFrame, cut: BucketCut | None = None) -> DataFrame:
    """Revisions that count towards the roll-up, withdrawn ones dropped last."""
    return revision_validity(log, cut).filter(F.col("message_status") != WITHDRAWN)


def active_windows(known: DataFrame, far: Column) -> DataFrame:
    """Published axis meets valid axis: [max of starts, min of ends), not empty."""
    start = F.greatest("valid_from", "effective_from")
    end = F.least(F.coalesce("valid_to", far), F.coalesce("effective_to", far))
    return known.withColumns({"window_from": start, "window_to": end}).filter(
        F.col("window_from") < F.col("window_to")
    )


def forward_windows(known: DataFrame, far: Column, hours: int) -> DataFrame:
    """The ``hours`` before the start while the revision is known: [from - N, from)."""
    start = F.greatest(F.col("valid_from"), timefn.shift_hours("effective_from", -hours))
    end = F.least(F.coalesce("valid_to", far), F.col("effective_from"))
    return known.withColumns({"window_from": start, "window_to": end}).filter(
        F.col("window_from") < F.col("window_to")
    )


def is_unplanned(cause: Column | str) -> Column:
    c = F.col(cause) if isinstance(cause, str) else cause
    return F.lower(F.coalesce(c, F.lit(""))) == UNPLANNED


def grid_end(grid: DataFrame, ts: str = "timestamp_utc") -> Column:
    """Right edge that stands for 'open': two hours past the last grid hour."""
    return grid.agg(timefn.shift_hours(F.max(ts), 2).alias("far")).scalar()


def outage_rollup(
    log: DataFrame,
    grid: DataFrame,
    lookahead_hours: int = 24,
    ts: str = "timestamp_utc",
    cut: BucketCut | None = None,
) -> DataFrame:
    """Active MW, active unplanned count and MW starting soon, per grid hour.

    Each revision becomes at most four deltas. A delta counts from the first
    whole hour at or after it, so deltas are summed per hour before anything is
    put in order: what is left to order is as long as the calendar, not as the
    log. Nothing published after an hour reaches that hour.
    """
    if lookahead_hours < 0:
        raise ValueError(f"lookahead_hours must be >= 0, got {lookahead_hours}")
    missing = [c for c in ROLLUP_INPUT if c not in log.columns]
    if missing:
        raise ContractError(f"missing column(s): {missing}")
    require_instants(grid, ts)
    far = grid_end(grid, ts)
    known = known_stretches(log.select(*ROLLUP_INPUT), cut)
    mw = F.coalesce(F.col("affected_mw"), F.lit(0.0))
    one = F.when(is_unplanned("cause"), 1).otherwise(0).cast("long")
    zero_mw, zero_n = F.lit(0.0), F.lit(0).cast("long")

    def delta(at: Column, total: Column, unplanned: Column, soon: Column) -> Column:
        return F.struct(
            at.alias("at"), total.alias("total"), unplanned.alias("unplanned"), soon.alias("soon")
        )

    open_end = F.coalesce("valid_to", far)
    a_from = F.greatest("valid_from", "effective_from")
    a_to = F.least(open_end, F.coalesce("effective_to", far))
    f_from = F.greatest(F.col("valid_from"), timefn.shift_hours("effective_from", -lookahead_hours))
    f_to = F.least(open_end, F.col("effective_from"))
    none = F.array().cast("array<struct<at:timestamp,total:double,unplanned:bigint,soon:double>>")
    active = F.when(
        a_from < a_to,
        F.array(delta(a_from, mw, one, zero_mw), delta(a_to, -mw, -one, zero_mw)),
    ).otherwise(none)
    soon = F.when(
        f_from < f_to,
        F.array(delta(f_from, zero_mw, zero_n, mw), delta(f_to, zero_mw, zero_n, -mw)),
    ).otherwise(none)
    deltas = known.select(F.explode(F.concat(active, soon)).alias("d")).select("d.*")
    hourly = deltas.groupBy(timefn.hour_ceil("at").alias(ts)).agg(
        F.sum("total").alias("total"),
        F.sum("unplanned").alias("unplanned"),
        F.sum("soon").alias("soon"),
    )
    # Grid hours join the deltas as zero rows, so hours between grid rows count too.
    both = hourly.withColumn("on_grid", F.lit(False)).unionByName(
        grid.select(
            ts,
            zero_mw.alias("total"),
            zero_n.alias("unplanned"),
            zero_mw.alias("soon"),
            F.lit(True).alias("on_grid"),
        )
    )
    per_hour = both.groupBy(ts).agg(
        F.sum("total").alias("total"),
        F.sum("unplanned").alias("unplanned"),
        F.sum("soon").alias("soon"),
        F.max("on_grid").alias("on_grid"),
    )
    # As long as the calendar.
    summed = ordered.running(
        per_hour,
        ts,
        {
            "total_now": Running("sum", "total"),
            "unplanned_now": Running("sum", "unplanned"),
            "soon_now": Running("sum", "soon"),
        },
    )
    total_name, count_name, soon_name = schemas.OUTAGE_COLUMNS
    return summed.filter("on_grid").select(
        ts,
        F.col("total_now").cast("float").alias(total_name),
        F.col("unplanned_now").cast("int").alias(count_name),
        F.col("soon_now").cast("float").alias(soon_name),
    )


def override_capacity(log: DataFrame, extracted: DataFrame, validate: bool = True) -> DataFrame:
    """Prefer the extracted capacity where there is one; every log row survives."""
    key = ["mrid", "revision_number"]
    side = extracted.select(*key, "affected_capacity_mw")
    if validate:
        from tidemark.operators.checks import assert_unique

        assert_unique(side, key, "extracted table")
    joined = log.join(side, key, "left")
    value = F.coalesce("affected_capacity_mw", "affected_mw")
    return joined.select(
        *(value.alias(c) if c == "affected_mw" else F.col(c) for c in log.columns)
    )
