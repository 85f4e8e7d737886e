"""Text corpus profile, pre-tokens and counts of byte pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import textfn
from tidemark.sources.corpora import SPACE

# Fixed value: the public GPT-2 pre-tokenisation pattern. \s is spelled out,
# because Java's \s is ASCII only.
PRETOKEN_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)"
    r"| ?\p{L}+"
    r"| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|{SPACE}+(?!\P{{IsWhite_Space}})"
    rf"|{SPACE}+"
)
# Two neighbours of a fenced word. Only one bar is consumed, so that the right
# symbol is seen again as the left one of the next pair.
NEIGHBOURS = r"(?=\|([0-9A-F]+\|\|[0-9A-F]+)\|)\|"
# Distinct pre-tokens per partition of the merge table.
WORDS_PER_PART = 250_000


def profile(pieces: DataFrame, text: str = "text") -> DataFrame:
    """Documents, empties, bytes and length percentiles of a corpus, one row.

    Lengths are counted first: the exact percentiles then read one row per
    distinct length, whatever the number of documents.
    """
    sizes = pieces.groupBy(F.octet_length(text).alias("size")).agg(F.count("*").alias("n"))
    full = F.col("size") > 0
    levels = F.array(*(F.lit(p) for p in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)))
    size = F.when(full, F.col("size"))
    one = sizes.agg(
        F.sum("n").alias("pieces"),
        F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("empties"),
        F.sum(F.col("size") * F.col("n")).alias("bytes"),
        F.percentile(size, levels, F.col("n")).alias("q"),
    )
    names = ("len_min", "len_p50", "len_p90", "len_p95", "len_p99", "len_max")
    return one.select(
        "pieces",
        "documents",
        "empties",
        "bytes",
        *(F.col("q")[i].alias(n) for i, n in enumerate(names)),
        F.try_divide("bytes", "documents").alias("len_mean"),
    )


def non_ascii_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each character beyond ASCII."""
    chars = df.select(
        F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x7F]"), 0)).alias("ch")
    )
    return chars.groupBy("ch").agg(F.count("*").alias("n")).select(
        "ch", code_point(F.col("ch")).alias("code_point"), "n"
    )


def code_point(ch: Column) -> Column:
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("long")


def non_ascii_top(df: DataFrame, text: str = "text", top: int = 12) -> DataFrame:
    """The most frequent characters beyond ASCII; a report of the first few."""
    return non_ascii_counts(df, text).orderBy(F.desc("n"), F.asc("code_point")).limit(top)


def non_ascii_share(df: DataFrame, text: str = "text") -> DataFrame:
    """Characters beyond ASCII over all characters, one line feed between documents."""
    outside = F.length(F.regexp_replace(F.col(text), r"[\x00-\x7F]", ""))
    return df.agg(
        F.sum(outside).alias("n_non_ascii"),
        (F.sum(F.length(text)) + F.count("*") - 1).alias("n_chars"),
    ).withColumn("share", F.try_divide("n_non_ascii", "n_chars"))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN_PATTERN), 0)


def pretoken_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Frequency of each distinct pre-token; combined before the shuffle."""
    return (
        df.select(F.explode(pretokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("freq"))
    )


def words_table(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct pre-tokens as fenced byte symbols with their frequency.

    The table is short in bytes but every pass over it is computation, so it is
    spread over all cores instead of being packed into few partitions by size.
    """
    cores = counts.sparkSession.sparkContext.defaultParallelism
    words = counts.select(textfn.fenced_bytes(F.col("token")).alias("word"), "freq")
    return words.repartition(max(cores, parts or 0))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent symbol pairs inside words, weighted by word frequency."""
    found = F.regexp_extract_all(F.col("word"), F.lit(NEIGHBOURS), 1)
    counted = (
        words.select("freq", F.explode(found).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("freq").alias("n"))
    )
    sides = F.split("pair", r"\|\|")
    return counted.select(sides[0].alias("left"), sides[1].alias("right"), "n")


def best_pairs(pairs: DataFrame, top: int) -> DataFrame:
    """Most frequent pairs first, then the lexicographically greatest (byte order)."""
    return pairs.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(top)


def token_total(words: DataFrame) -> DataFrame:
    return words.agg(
        F.coalesce(F.sum(F.size(textfn.unfence(F.col("word"))) * F.col("freq")), F.lit(0)).alias(
            "total"
        )
    )
