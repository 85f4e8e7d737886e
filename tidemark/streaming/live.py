"""Stream counterparts of three table operators.

They are ordinary DataFrame transformations, so the same code runs on a stream
or on a table; ``drain`` runs a finite stream into a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bitemporal import WITHDRAWN
from tidemark.session import scratch_path


def hourly(
    events: DataFrame, ts: str, value: str, keys: Sequence[str] = (), late: str = "2 hours"
) -> DataFrame:
    """Hourly mean and max with a bound on late data."""
    return (
        events.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, "1 hour").alias("w"))
        .agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("hour"), "mean", "max", "n")
    )


def deduplicate(
    messages: DataFrame,
    keys: Sequence[str] = ("mrid", "revision_number"),
    ts: str = "published_at",
    within: str = "7 days",
) -> DataFrame:
    """Drop replays of a message seen within the bound."""
    return messages.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def current_state(messages: DataFrame, key: str = "mrid") -> DataFrame:
    """Highest revision per key so far, whatever order they arrive in (update mode).

    Withdrawn states are kept here, because a later revision must still find
    them; the sink filters with ``known``.
    """
    rest = [c for c in messages.columns if c != key]
    return (
        messages.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col("revision_number")).alias("state"))
        .select(key, "state.*")
    )


def known(state: DataFrame) -> DataFrame:
    return state.filter(F.col("message_status") != WITHDRAWN)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run an available-now query to its end and return what it wrote.

    Every batch appends to a table with its batch number; in update mode a
    reader takes the newest row per key with ``newest``.
    """
    spark: SparkSession = stream.sparkSession
    target = scratch_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        # One folder per batch: a retried batch replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", target).schema(
        stream.schema.add("batch", "long")
    ).parquet(target)


def newest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("r"))
        .select(*keys, "r.*")
    )
