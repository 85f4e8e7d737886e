"""Staging, size-checked joins, and Arrow iteration shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_session, scratch_path

# A side is broadcast only when its counted rows stay below this many bytes.
BROADCAST_BYTES = 16 << 20
# Text worked on at once inside a task.
SLICE_BYTES = 2 << 20
# What Spark hands to a Python worker at once: its buffers lie outside the heap, twice for each task.
BATCH_BYTES = 2 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and small Arrow batches."""
    ensure_session(spark)
    for key, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 4000)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return spark


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    This cuts the lineage: what follows survives a lost executor without the
    work above being done again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_join(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with a staged side, broadcast if its counted size allows, shuffled beyond that.

    The rows are the same either way; only the larger side's shuffle is saved.
    """
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    ends = offsets_of(batch.column(column))
    ends = ends[1:] - ends[0]
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind) if texts.buffers()[1] is not None else np.zeros(1, kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; a null is empty."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no group of equal keys is cut."""
    carry: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        starts = group_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])).combine_chunks()
        carry = table.slice(int(starts[-1]))
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the (non-null, integer) keys change."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def by_group(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Run ``fn`` over tables of whole groups.

    Callers bound the rows of a group. ``fn`` gets a table of many whole groups,
    so small groups do not pay a call each.
    """

    def run(batches):
        for table in whole_groups(batches, keys):
            yield from fn(table)

    placed = df.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, schema)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a 2-d array."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def binary_rows(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Back from :func:`fixed_binary`: equal-width binaries as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, offsets = text_bytes(column)
    width = int(offsets[1] - offsets[0]) if len(offsets) > 1 else 0
    return raw.view(np.uint8).reshape(len(offsets) - 1, width).copy().view(dtype)


def blocked(members: DataFrame, key: str, size: str, node: str, rows_per_block: int) -> DataFrame:
    """Deal the members of each group to pairs of blocks, so that every two members meet once.

    ``size`` is the group's counted rows. A group of up to ``rows_per_block`` is one
    block; a larger one is cut in n blocks, and each member goes to the n pairs that
    hold its block. Adds ``block``, ``left_block`` and ``right_block``.
    """
    n = F.ceil(F.col(size) / F.lit(float(rows_per_block))).cast("int")
    block = F.pmod(F.xxhash64(F.col(node), F.lit(17)), n.cast("long")).cast("int")
    out = members.withColumn("n_blocks", n).withColumn("block", block)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return out.withColumns(
        {"left_block": F.least("block", "other"), "right_block": F.greatest("block", "other")}
    ).drop("other", "n_blocks", size)


def merge_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        label = new[label]
        differ = label[left] != label[right]
        left, right = left[differ], right[differ]
    return label
