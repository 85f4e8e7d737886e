"""Separator-delimited text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "<|endoftext|>"
# Unicode white space, as Python's str.strip and \s see it.
SPACE = r"\p{IsWhite_Space}"


def strip(text: Column) -> Column:
    """Drop white space at both ends, all Unicode kinds."""
    return F.regexp_replace(
        F.regexp_replace(text, f"^{SPACE}+", ""), f"(?<!{SPACE}){SPACE}+$", ""
    )


def read_pieces(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """Every piece between separators, stripped, empty ones kept."""
    pieces = spark.read.option("lineSep", separator).text(path)
    return pieces.select(strip(F.col("value")).alias("text"))


def read_documents(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """Documents of a separator-delimited corpus: stripped and not empty."""
    return read_pieces(spark, path, separator).filter(F.col("text") != "")


def write_documents(df: DataFrame, path: str, text: str = "text", separator: str = SEPARATOR):
    """Write documents back in the separated format."""
    df.select(F.col(text)).write.option("lineSep", f"\n{separator}\n").text(path)


def bernoulli_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Keep each row independently with the given probability.

    The draw is a 48-bit hash of (seed, key), so a re-run or a retried task keeps
    the same rows, the sample needs no shuffle, and tiny fractions work.
    """
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256), 1, 12), 16, 10)
    return df.filter(draw.cast("long") < F.lit(round(fraction * 2**48)))


def sample_to_bytes(
    df: DataFrame, key: str, text: str, target_bytes: int, seed: int = 0
) -> DataFrame:
    """Bernoulli sample sized to about ``target_bytes`` of text."""
    size = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    fraction = 1.0 if size == 0 else min(1.0, target_bytes / size)
    return bernoulli_sample(df, key, fraction, seed)
