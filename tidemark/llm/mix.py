"""Mixing sources to target weights: budgets met by subset sums over document lengths.

Documents of one length are interchangeable for a budget, so a source is planned on its
histogram of lengths. Whole copies of the source come first; what is left of the budget takes
the same share of every length; what the rounding leaves is a bounded knapsack over the
documents still there, solved exactly by dynamic programming on a bitmap of reachable sums.
Which documents of a length are taken is the order of a seeded hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.frames import BROADCAST_BYTES, small_join, staged

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# Budget up to which the bitmap is used, and lengths that are tried before all of them.
KNAPSACK_BUDGET = 1 << 17
KNAPSACK_LENGTHS = 256
# Documents of one source and length that a task ranks together, on average.
RANKED_ROWS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by repeating weights, none above ``most`` times its size."""
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[k % len(weights)] for k in open_)
        share = {k: left * weights[k % len(weights)] / total for k in open_}
        full = [k for k in open_ if share[k] > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = share[k]
            break
        for k in full:
            out[k] = float(most * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def reachable(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take for the largest sum within ``budget``; exact."""
    # A common divisor of all lengths makes the bitmap shorter, and a budget it cannot meet, one it can.
    unit = math.gcd(*counts) or 1
    if unit > 1:
        scaled = reachable(budget // unit, {length // unit: n for length, n in counts.items()})
        return {length * unit: n for length, n in scaled.items()}
    sums, before = 1, []
    mask = (1 << (budget + 1)) - 1
    items = []
    for length, count in counts.items():
        step = 1  # binary splitting: 1, 2, 4, ... and the rest
        while count > 0:
            take = min(step, count)
            items.append((length, take))
            count -= take
            step *= 2
    for length, take in items:
        before.append(sums)
        sums |= sums << (length * take) & mask
        if sums >> budget & 1:
            break
    goal, out = sums.bit_length() - 1, {}
    for (length, take), seen in zip(reversed(items[: len(before)]), reversed(before), strict=True):
        if not seen >> goal & 1:
            goal -= length * take
            out[length] = out.get(length, 0) + take
    return out


def _spread(lengths: list[int]) -> list[int]:
    """The shortest of many ascending lengths and an even spread of the others."""
    if len(lengths) <= KNAPSACK_LENGTHS:
        return lengths
    half = KNAPSACK_LENGTHS // 2
    step = (len(lengths) - half) / half
    return lengths[:half] + [lengths[half + int(k * step)] for k in range(half)]


def plan_source(counts: dict[int, int], target: float) -> dict[int, tuple[int, int]]:
    """``length -> (copies of every document, documents with one copy more)`` for one source."""
    size = sum(length * n for length, n in counts.items())
    if size == 0:
        return dict.fromkeys(counts, (0, 0))
    budget = round(target)
    copies = min(budget // size, MOST_REPEATS)
    rest = budget - copies * size if copies < MOST_REPEATS else 0
    # An even share of every length: cumulated counts are rounded, so single documents count too.
    extra, cumulated = {}, 0
    for length in sorted(counts):
        low = cumulated * rest // size
        cumulated += counts[length]
        extra[length] = cumulated * rest // size - low
    left = rest - sum(length * n for length, n in extra.items())
    # Too much: give back the shortest document that settles it, or else the longest.
    while left < 0:
        taken = sorted(length for length, n in extra.items() if n and length)
        back = next((length for length in taken if length >= -left), taken[-1])
        n = max(1, min(extra[back], -left // back))
        extra[back] -= n
        left += n * back
    # Whole documents from the longest down, until the bitmap can take what is left.
    for length in sorted(counts, reverse=True):
        if length == 0 or left <= KNAPSACK_BUDGET:
            break
        more = min(counts[length] - extra[length], (left - KNAPSACK_BUDGET // 2) // length)
        if more > 0:
            extra[length] += more
            left -= more * length
    if 0 < left <= KNAPSACK_BUDGET:
        free = {length: counts[length] - extra[length] for length in sorted(counts) if 0 < length <= left}
        free = {length: min(n, left // length) for length, n in free.items() if n}
        # A few lengths nearly always suffice; where they fall short, all of them are used.
        found = reachable(left, {length: free[length] for length in reversed(_spread(list(free)))})
        if len(free) > KNAPSACK_LENGTHS and sum(length * n for length, n in found.items()) < left:
            found = reachable(left, {length: free[length] for length in reversed(list(free))})
        for length, n in found.items():
            extra[length] += n
    return {length: (copies, n) for length, n in extra.items()}


def mix_sources(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source, ...)``.

    Size is the number of words. Sources in code point order, null last, weigh 5, 2, 1,
    repeating, and share the sum of all sizes; no target exceeds 3 times its source. ``taken``
    is a whole number of copies of the document, at most 3, in words. A source's taken words
    fall short of its rounded target only if no choice of documents can fill what is left after an even
    share of all lengths, and after the longest documents where more than ``KNAPSACK_BUDGET`` words are left.

    A null text has size 0 and takes nothing; so do sources of such texts. A null source is a
    source of its own. Repeated rows and null ids are documents like others; rows alike in
    source, size and id are interchangeable. Other columns are ignored. An empty table gives an
    empty result. The same input and seed give the same mix.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = staged(sized, "sizes")
    histogram = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    # One row for each source of the mixture; the driver holds its weights anyway.
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()
    # Python orders strings by code point.
    ranked = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    goals = targets([r.total for r in ranked])
    spark = docs.sparkSession
    rows = [(r.source, r.total, goal) for r, goal in zip(ranked, goals, strict=True)]
    sources = spark.createDataFrame(rows, "source string, source_size long, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True))
        chosen = plan_source(counts, float(pdf["target"].iloc[0]))
        out = pdf[["source", "source_size", "target", "size", "n"]].copy()
        out["copies"] = [chosen[k][0] for k in pdf["size"]]
        out["extra"] = [chosen[k][1] for k in pdf["size"]]
        return out

    same = histogram["source"].eqNullSafe(sources["source"])
    # Names and numbers of a source take some 128 bytes.
    side = F.broadcast(sources) if len(rows) * 128 <= BROADCAST_BYTES else sources
    plans = (
        histogram.join(side, same)
        .select(histogram["source"], "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(
            plan, "source string, source_size long, target double, size long, n long, copies long, extra long"
        )
    )
    plans = staged(plans, "plans")
    # Equal keys for null sources, so that the join is a plain equi-join.
    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("null"), "size")
    planned = (
        sized.withColumn("key", key)
        .join(plans.withColumn("key", key).drop("source", "size"), "key")
        .drop("key")
    )
    some = planned.where("extra > 0 and extra < n")
    draw = F.xxhash64(F.lit(seed), "doc_id")
    some = some.withColumn("draw", draw).withColumn(
        "part", F.pmod(F.xxhash64("draw"), F.ceil(F.col("n") / F.lit(float(RANKED_ROWS))).cast("long"))
    )
    group = ["source", "size", "part"]
    parts = some.groupBy(*group).agg(F.count("*").alias("rows"), F.first("extra").alias("wanted"))
    before = F.sum("rows").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("rows")
    quota = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("wanted") - before))
    parts = parts.select(
        F.coalesce("source", F.lit("")).alias("s"),
        F.col("source").isNull().alias("no_source"),
        "size",
        "part",
        quota.alias("quota"),
    )
    place = F.row_number().over(
        Window.partitionBy("s", "no_source", "size", "part").orderBy("draw", "doc_id")
    )
    some = some.select(
        "*", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source")
    )
    one_more = (
        some.withColumn("place", place)
        .join(parts, ["s", "no_source", "size", "part"])
        .withColumn("more", (F.col("place") <= F.col("quota")).cast("long"))
    )
    all_or_none = planned.where("extra = 0 or extra >= n").withColumn("more", (F.col("extra") > 0).cast("long"))
    columns = [
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        ((F.col("copies") + F.col("more")) * F.col("size")).alias("taken"),
        (F.col("copies") + F.col("more")).alias("repeats"),
    ]
    return one_more.select(*columns).union(all_or_none.select(*columns))


def take_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is repeated, with all their columns.

    Rows that share an id, or have none, are taken as often as the one of them taken most.
    """
    mixed = mix_sources(docs, seed)
    taken = mixed.groupBy(F.col("doc_id").alias("__id")).agg(F.max("repeats").alias("__repeats"))
    taken = staged(taken.where("__repeats > 0"), "taken")
    joined = small_join(docs, taken, docs["doc_id"].eqNullSafe(taken["__id"]), "inner", 24)
    copies = F.explode(F.array_repeat(F.lit(True), F.col("__repeats").cast("int")))
    return joined.withColumn("__copy", copies).select(*docs.columns)
