"""Session settings and the shared folder every staged table goes to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def ensure_session(spark: SparkSession) -> SparkSession:
    """Pin UTC, ANSI casts and adaptive execution on an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_library(spark)
    return spark


def ship_library(spark: SparkSession) -> None:
    """Send the library's sources to the executors, once for each application.

    Functions that run in tasks are named by module, so the workers must be able
    to import them wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-src-"), "tidemark_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for package in ("tidemark", "workload"):
            for folder, _, names in os.walk(os.path.join(here, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, here))
    context.addPyFile(archive)
    context._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, read from the session.

    Only a local master may fall back to a temporary folder, because there the
    driver and the tasks are one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    Used where a costly aggregate feeds an operator that reads it more than
    once: the scan below it then runs once, and a lost executor only re-reads
    the checkpoint files.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, label: str = "staged") -> DataFrame:
    """Cut lineage with a parquet table below the shared folder.

    Like :func:`stage`, but columnar: later passes read only the columns they
    use, and counting reads the footers.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal the rows of a few unsplittable files to all cores; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
