"""Exact duplicates: binary-fuse filters of a snapshot screen a batch, exact buckets decide.

An immutable snapshot's distinct digests are cut in shards, and each shard gets a static
3-wise binary-fuse filter, about 9 bits a digest. The distinct digests of an incoming batch
meet the filter of their shard. Those that pass, with digests repeated within the batch or
within the snapshot, name the only rows whose texts are read again: they are grouped by
digest *and* whole normalised text, so the decision is made on bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames
from tidemark.llm.frames import staged
from tidemark.llm.words import mix

# Digests of one filter at most, on average, and of one of a small table, which is cut finer.
SHARD_KEYS = 100_000
LEAST_SHARD_KEYS = 250
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots and the fingerprint of each key."""
    h = mix(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, own slot), each slot used by that key alone among the keys still there."""
    n = slots.shape[1]
    degree = np.bincount(slots.ravel(), minlength=size)
    total = np.bincount(slots.ravel(), weights=np.tile(np.arange(n, dtype=float), 3), minlength=size).astype(np.int64)
    alone, rounds, left = np.flatnonzero(degree == 1), [], n
    while len(alone):
        keys, at = np.unique(total[alone], return_index=True)
        rounds.append((keys, alone[at]))
        left -= len(keys)
        touched = slots[:, keys].ravel()
        np.subtract.at(degree, touched, 1)
        np.subtract.at(total, touched, np.tile(keys, 3))
        alone = np.unique(touched[degree[touched] == 1])
    return rounds if left == 0 else None


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """``seed, segment length, segments, fingerprints`` over distinct 64-bit keys."""
    n = max(len(keys), 2)
    length = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    capacity = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(capacity / length) - 2)
    seed = 1
    while True:
        slots, prints = _slots(keys, seed, length, segments)
        rounds = _peel(slots, (segments + 2) * length)
        if rounds is not None:
            break
        seed += 1
        if seed % 8 == 0:  # a few small key sets need more room
            segments += 1
    table = np.zeros((segments + 2) * length, np.uint8)
    for own, slot in reversed(rounds):
        other = table[slots[0, own]] ^ table[slots[1, own]] ^ table[slots[2, own]]
        table[slot] = prints[own] ^ other
    return seed, length, segments, table.tobytes()


def passes(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    """Whether each key may be in the filter: always for its keys, for about 1 in 256 others."""
    cells = np.frombuffer(table, np.uint8)
    slots, prints = _slots(keys, seed, length, segments)
    return (cells[slots[0]] ^ cells[slots[1]] ^ cells[slots[2]]) == prints


def snapshot_filters(digests: DataFrame, shards: int) -> DataFrame:
    """A filter row for each shard of the distinct ``h`` of a snapshot."""

    def build(table):
        keys = table.column("h").to_numpy().view(np.uint64)
        seed, length, segments, cells = build_filter(keys)
        return pa.table(
            {
                "shard": table.column("shard")[:1],
                "seed": [seed],
                "length": [length],
                "segments": [segments],
                "cells": pa.array([cells], pa.binary()),
            }
        )

    return (
        digests.select("h")
        .distinct()
        .withColumn("shard", F.pmod("h", F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(build, "shard long, seed long, length long, segments long, cells binary")
    )


def screened(filters: DataFrame, digests: DataFrame, shards: int) -> DataFrame:
    """The distinct ``h`` of a batch that pass the filter of their shard."""

    def screen(rows, cells):
        keys = rows.column("h").to_numpy().view(np.uint64)
        keep = np.zeros(len(keys), bool)
        for f in cells.to_pylist():
            keep |= passes(keys, f["seed"], f["length"], f["segments"], f["cells"])
        return pa.table({"h": keys[keep].view(np.int64)})

    rows = digests.select("h").distinct().withColumn("shard", F.pmod("h", F.lit(shards)))
    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(screen, "h long")


def exact_duplicates(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text, ...)``.

    ``in_snapshot`` says which rows are the snapshot; a null counts as no. The groups are the
    same wherever the line is drawn; only which filter screens which row changes.

    Texts are equal when they are after each run of white space became one space. A null text
    is empty; all empty texts are one group. The smallest id of a group stays. A null id never
    stays unless the whole group has none, and then all its rows do; rows that repeat an id
    and its text share their verdict. Other columns are ignored. An empty table gives an empty
    result.
    """
    text = normalised(F.col("text"))
    read = docs.select("doc_id", text.alias("t"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    sha = F.unhex(F.sha2("t", 256))
    seen = staged(read.select("doc_id", "old", sha.alias("sha"), F.xxhash64("t").alias("h")), "digests")
    n, spread = seen.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.ceil(n / SHARD_KEYS), min(spread, math.ceil(n / LEAST_SHARD_KEYS)))
    snapshot, batch = seen.where("old"), seen.where("not old")
    filters = staged(snapshot_filters(snapshot, shards), "filters")
    repeated = seen.groupBy("old", "h").count().where("count > 1").select("h")
    wanted = screened(filters, batch, shards).union(repeated).distinct()
    # The buckets of these digests: few rows are read again, as texts. A digest with many copies stays spread.
    wanted = staged(wanted, "wanted")
    bucket = staged(frames.small_join(seen, wanted, "h", "left_semi", 64).select("doc_id"), "bucket")
    known = bucket.where("doc_id is not null").select("doc_id").distinct()
    texts = frames.small_join(docs.select("doc_id", text.alias("t")), known, "doc_id", "left_semi", 16)
    if not bucket.where("doc_id is null").isEmpty():
        texts = texts.union(docs.where("doc_id is null").select("doc_id", text.alias("t")))
    groups = (
        texts.groupBy(F.xxhash64("t").alias("h"), "t")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(sha.alias("sha"), "keep_id", "group_size", F.lit(True).alias("grouped"))
    )
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return (
        seen.join(groups, "sha", "left")
        .withColumn("keep_id", keep)
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def midpoint(docs: DataFrame) -> Column:
    """Rows in the lower half of the id range, as the older of two snapshots."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= F.lit(None if low is None else (low + high) // 2).cast("long")


def drop_exact_duplicates(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows that repeat both id and text stay together. A null id stays if no row of its group has one.
    """
    verdict = staged(exact_duplicates(docs, in_snapshot), "verdict")
    gone = verdict.where("not kept").select("doc_id", "text_sha256").distinct()
    named = gone.where("doc_id is not null").select("doc_id").distinct()
    # An id may carry several texts; then the text decides, too.
    marked = docs.withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    if verdict.where("kept").join(named, "doc_id", "left_semi").isEmpty() and gone.where("doc_id is null").isEmpty():
        return frames.small_join(docs, named, "doc_id", "left_anti", 16)
    pairs = gone.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    match = marked["doc_id"].eqNullSafe(pairs["__id"]) & (marked["__sha"] == pairs["__sha"])
    return marked.join(pairs, match, "left_anti").drop("__sha")
