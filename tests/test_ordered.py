"""Two-phase operators equal plain windows, whatever the buckets."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.ordered import Running

CUTS = {
    "narrow": ordered.width(50),
    "one wide": ordered.width(10**9),
    "balanced": ordered.balanced(120),
    "uncut": ordered.balanced(10**6),
}


@pytest.fixture(scope="module")
def series(spark):
    """A hot key with most rows, gaps in the order, nulls in the value."""
    i = F.col("id")
    return (
        spark.range(900)
        .filter((i < 200) | (i > 420))
        .select(
            (i * 7 + (i % 3)).alias("t"),
            F.when(i % 10 == 0, "cold").otherwise("hot").alias("k"),
            F.when((i * 37) % 11 > 5, (i * 13) % 101).alias("v"),
        )
        .cache()
    )


@pytest.mark.parametrize("cut", CUTS.values(), ids=CUTS.keys())
@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_window(series, cut, keys, inclusive):
    names = {"s": "sum", "lo": "min", "hi": "max", "n": "count", "l": "last"}
    got = ordered.running(
        series, "t", {n: Running(kind, "v") for n, kind in names.items()}, keys, cut, inclusive
    )
    w = (
        Window.partitionBy(*keys)
        .orderBy("t")
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    want = series.select(
        "t", "k", "v",
        F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("lo"),
        F.max("v").over(w).alias("hi"), F.count("v").over(w).alias("n"),
        F.last("v", True).over(w).alias("l"),
    )
    columns = ["t", "k", "s", "lo", "hi", "n", "l"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(
        map(tuple, want.select(columns).collect()), key=str
    )


@pytest.mark.parametrize("cut", CUTS.values(), ids=CUTS.keys())
def test_row_index_and_following(series, cut):
    w = Window.partitionBy("k").orderBy("t")
    want = series.select(
        "t", "k", (F.row_number().over(w) - 1).alias("ix"), F.lead("v").over(w).alias("nx")
    )
    index = ordered.row_index(series, "t", ["k"], cut).select("t", "ix")
    nexts = ordered.following(series, "t", "v", "nx", ["k"], cut).select("t", "nx")
    assert sorted(map(tuple, index.collect())) == sorted(
        map(tuple, want.select("t", "ix").collect())
    )
    assert sorted(map(tuple, nexts.collect()), key=str) == sorted(
        map(tuple, want.select("t", "nx").collect()), key=str
    )


@pytest.mark.parametrize("block", [1, 7, 10_000])
@pytest.mark.parametrize("limit", [1, 3])
def test_bounded_fill_is_by_rows(series, block, limit):
    indexed = ordered.row_index(series, "t", cut=ordered.width(100))
    got = ordered.bounded_fill(indexed, ["v"], limit, block=block)
    w = Window.orderBy("t").rowsBetween(-limit, 0)
    want = series.withColumn("v", F.last("v", True).over(w))
    assert sorted(map(tuple, got.select("t", "v").collect()), key=str) == sorted(
        map(tuple, want.select("t", "v").collect()), key=str
    )


def test_fill_limit_zero_changes_nothing(series):
    assert ordered.bounded_fill(series, ["v"], 0) is series


@pytest.mark.parametrize("block", [3, 50])
def test_sequence_windows(series, block):
    indexed = ordered.row_index(series, "t", cut=ordered.width(100))
    rows = indexed.orderBy("ix").collect()
    got = {
        r["ix"]: (list(r["window"]), r["target"])
        for r in ordered.sequence_windows(
            indexed.withColumn("v", F.coalesce("v", F.lit(-1))), ["v"], "v", 4, block=block
        ).collect()
    }
    values = [-1 if r["v"] is None else r["v"] for r in rows]
    assert len(got) == len(values) - 4
    for i in range(4, len(values)):
        assert got[i] == ([[float(x)] for x in values[i - 4 : i]], float(values[i]))
    with pytest.raises(ValueError):
        ordered.sequence_windows(indexed, ["v"], "v", 1)


@pytest.mark.parametrize("cut", CUTS.values(), ids=CUTS.keys())
def test_step_lookup(spark, cut):
    steps = spark.createDataFrame([(10, 1.0), (20, 2.0), (700, 3.0)], "t int, level double")
    grid = spark.createDataFrame([(5, "a"), (10, "b"), (19, "c"), (20, "d"), (650, "e"), (9999, "f")], "t int, tag string")
    got = {r["tag"]: r["level"] for r in ordered.step_lookup(steps, grid, "t", "level", default=0.0, cut=cut).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 1.0, "d": 2.0, "e": 2.0, "f": 3.0}


def test_null_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "t int, k string")
    with pytest.raises(Exception, match="null in key"):
        ordered.row_index(rows, "t", ["k"], ordered.width(1)).collect()


def test_plans_keep_rows_off_one_task(series):
    """Only the per-bucket carry may sit on a single partition."""
    out = ordered.row_index(series.select("t", "v"), "t", cut=ordered.width(50))
    plan = out._jdf.queryExecution().executedPlan().toString()
    single = [i for i, line in enumerate(plan.splitlines()) if "SinglePartition" in line]
    assert len(single) <= 1
    for i in single:
        # Below the single exchange there is the per-bucket aggregate.
        assert "HashAggregate" in plan.splitlines()[i + 1]
    assert "Python" not in plan


@pytest.mark.parametrize("rows_per_bucket", [40, 150])
def test_one_crowded_order_value_is_cut_on_the_next_column(spark, rows_per_bucket):
    """Two thirds of all rows share one order value and one key."""
    i = F.col("id")
    df = spark.range(900).select(
        F.when(i % 3 == 0, i).otherwise(500).alias("t"),
        i.alias("seq"),
        F.lit("hot").alias("k"),
        ((i * 13) % 101).alias("v"),
    ).cache()
    cut = ordered.balanced(rows_per_bucket)
    sizes = [r["count"] for r in cut(df, ["t", "seq"]).groupBy(ordered.BUCKET).count().collect()]
    assert max(sizes) <= 2 * rows_per_bucket
    w = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("seq", F.sum("v").over(w).alias("s")).collect()
    got = ordered.running(df, ["t", "seq"], {"s": Running("sum", "v")}, ["k"], cut)
    assert sorted(map(tuple, got.select("seq", "s").collect())) == sorted(map(tuple, want))
