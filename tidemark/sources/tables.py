"""Writing and reusing tables: atomic replace, cache policies, fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class CachePolicy(Enum):
    AUTO = "auto"
    REFRESH = "refresh"
    OFFLINE = "offline"


class CacheMissing(FileNotFoundError):
    """OFFLINE was asked for and there is no table."""


def _filesystem(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def table_exists(spark: SparkSession, path: str) -> bool:
    """True for a finished write: the folder has its success marker. An interrupted swap is finished first."""
    fs, _ = _filesystem(spark, path)
    finish_swap(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS"))


def finish_swap(spark: SparkSession, path: str) -> None:
    """Bring back a table whose replacement was interrupted between its two renames.

    The folder is then missing, and beside it lie the new table, which is complete, and the old one.
    """
    path = path.rstrip("/")
    fs, target = _filesystem(spark, path)
    if fs.exists(target):
        return
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for kind in ("incoming", "outgoing"):
        for found in fs.globStatus(path_of(f"{path}.{kind}-*")) or ():
            done = fs.exists(path_of(f"{found.getPath().toString()}/_SUCCESS"))
            # Without an old table that was moved away there was no swap, only a first write.
            moved = kind == "outgoing" or fs.globStatus(path_of(f"{path}.outgoing-*"))
            if done and moved and fs.rename(found.getPath(), target):
                for rest in fs.globStatus(path_of(f"{path}.outgoing-*")) or ():
                    fs.delete(rest.getPath(), True)
                return


def replace_table(df: DataFrame, path: str, sort: Sequence[str] = ()) -> str:
    """Write next to the target, then swap folders.

    A failed write leaves the old table as it was, and a crash between the two
    renames is made good by :func:`finish_swap`, which every function here calls
    before it looks at a table. ``sort`` gives rows a stable order within each
    file, which also tightens min/max statistics.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    finish_swap(spark, path)
    tag = uuid.uuid4().hex
    incoming, outgoing = f"{path}.incoming-{tag}", f"{path}.outgoing-{tag}"
    ordered = df.sortWithinPartitions(*sort) if sort else df
    ordered.write.parquet(incoming)
    fs, target = _filesystem(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    had_old = fs.exists(target)
    if had_old and not fs.rename(target, path_of(outgoing)):
        raise OSError(f"could not move the old table at {path}")
    if not fs.rename(path_of(incoming), target):
        if had_old:
            fs.rename(path_of(outgoing), target)
        raise OSError(f"could not move the new table to {path}")
    if had_old:
        fs.delete(path_of(outgoing), True)
    return path


def materialise(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    policy: CachePolicy = CachePolicy.AUTO,
    sort: Sequence[str] = (),
) -> DataFrame:
    """Reuse, rebuild, or fail when absent, by policy."""
    present = table_exists(spark, path)
    if policy is CachePolicy.OFFLINE and not present:
        raise CacheMissing(f"no table at {path}")
    if policy is CachePolicy.REFRESH or not present:
        built = build()
        replace_table(built, path, sort)
    return spark.read.parquet(path)


def union_tables(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name."""
    if not parts:
        raise ValueError("nothing to union")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_digests(df: DataFrame, text: str, name: str = "digest") -> DataFrame:
    """The other columns with the text's digest in its place, to put in order instead of texts."""
    return df.withColumn(name, F.sha2(F.col(text), 256)).drop(text)


def corpus_fingerprint(
    df: DataFrame, order: str, digest: str = "digest", width: int = 10_000, name: str = "fingerprint"
) -> DataFrame:
    """Order-sensitive SHA-256 of the texts, as one row.

    The digests of the rows (:func:`text_digests`) of one stretch of the order
    column are joined in order and hashed, and so on until one row is left. A
    stretch holds at most ``width`` short digests, so nothing grows with the corpus.
    ``order`` is a gap-free 0-based position (``ordered.row_index``), so the row
    count alone says how many levels there are.
    """
    rows = df.select(F.col(order).cast("long").alias("pos"), F.col(digest).alias("digest"))
    last = df.count() - 1
    if last < 0:
        return df.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias(name))
    level = rows
    while True:
        level = (
            level.groupBy(F.floor(F.col("pos") / F.lit(width)).alias("pos"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("part"))
            .select(
                "pos",
                F.sha2(
                    F.array_join(F.transform("part", lambda p: p["digest"]), "\n"), 256
                ).alias("digest"),
            )
        )
        last //= width
        if last == 0:
            return level.select(F.col("digest").alias(name))


def cached_vectors(
    spark: SparkSession,
    path: str,
    fingerprint: str,
    model_id: str,
    build: Callable[[], DataFrame],
    force: bool = False,
) -> tuple[DataFrame, bool]:
    """Vectors keyed by (corpus fingerprint, model id): reuse or rebuild.

    The key sits in a one-row table beside the vectors. It is deleted before the
    vectors change and written after, so a crash in between leaves no key and
    never an old key beside new vectors. An unreadable or stale cache is
    rebuilt. Returns the vectors and whether the cache was used.
    """
    vectors_path, key_path = f"{path}/vectors", f"{path}/key"
    if not force and table_exists(spark, vectors_path) and table_exists(spark, key_path):
        key = spark.read.parquet(key_path).first()
        if key and key["fingerprint"] == fingerprint and key["model_id"] == model_id:
            return spark.read.parquet(vectors_path), True
    fs, old_key = _filesystem(spark, key_path)
    if fs.exists(old_key) and not fs.delete(old_key, True):
        raise OSError(f"could not delete the old key at {key_path}")
    replace_table(build(), vectors_path)
    key_row = spark.range(1).select(
        F.lit(fingerprint).alias("fingerprint"),
        F.lit(model_id).alias("model_id"),
        F.current_timestamp().alias("built_at_utc"),
    )
    replace_table(key_row, key_path)
    return spark.read.parquet(vectors_path), False


def provenance(
    df: DataFrame, column: str = "retrieved_at_utc", explicit: Column | None = None
) -> Column:
    """Stamp of a source: explicit, else its earliest non-null stamp, else now."""
    if explicit is not None:
        return explicit
    if column not in df.columns:
        return F.current_timestamp()
    return F.coalesce(
        df.agg(F.min(column).alias("stamp")).scalar(), F.current_timestamp()
    )
