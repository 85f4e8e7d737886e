"""A clustered vector table that is searched exactly without reading most vectors.

Rows are kept with their nearest centre, in ranges of clusters, and a cluster has a radius: the
largest angle from its centre. For a question, the angle to a centre less the radius bounds what any
row of the cluster can score. Each row also has a code of one byte for each dimension, with the length
of what the code leaves out. By the Cauchy-Schwarz inequality that length bounds how far a
score taken from the code is from the true one. So a search

1. scores the codes of the nearest clusters that hold k rows, which gives a score that the k-th
   best row is known to reach,
2. scores the codes of the clusters whose bound reaches it, and raises it,
3. reads the vectors of rows whose bound reaches it, a little more than k of them.

Codes are a column of their own: the first two steps read no vectors. New rows join the nearest of the
old centres and widen the radius; nothing written before is touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.vectors import QUERIES_PER_PASS, SCORE_DECIMALS, DimensionMismatch, _matrix
from tidemark.session import stage_table

# Centres are fitted on so many rows, those with the smallest hashes of their ids.
SAMPLE_ROWS = 50_000
MOST_CLUSTERS = 1024
FIT_ROUNDS = 8
# Rows whose codes are dealt together, questions that meet them together, and scores of these held at once.
CODE_BLOCK = 8192
QUESTION_BLOCK = 2048
SCORES_AT_ONCE = 2**21
# Scores are compared after rounding: two that differ by less may be equal then.
ROUNDING = 10.0**-SCORE_DECIMALS
# Slack for sums in floating point.
FLOAT_SLACK = 1e-9


@dataclass(frozen=True)
class ClusteredIndex:
    """Written parts of an index, its centres (one row each), and each cluster's radius and rows."""

    spark: SparkSession
    path: str
    parts: tuple[str, ...]
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def table(self) -> DataFrame:
        """``id, cluster, code, scale, rest, vector`` of all parts."""
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(p) for p in self.parts))


def fit_centres(vectors: np.ndarray, clusters: int, seed: int = 0) -> np.ndarray:
    """Unit centres of unit rows: rounds of assignment and mean, from rows drawn by a seed."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), clusters, replace=False)]
    for _ in range(FIT_ROUNDS):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length == 0, 1.0, length), centres)
    return centres


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A signed byte for each number, the step, and the length of what is left out."""
    scale = np.abs(unit).max(axis=1, initial=0.0) / 127.0
    code = np.round(unit / np.where(scale == 0, 1.0, scale)[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(unit - scale[:, None] * code, axis=1)


def _place(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        unit = _matrix(batch.column("vector"), centres.shape[1])
        code, scale, rest = _coded(unit)
        cosines = unit @ centres.T
        own = np.argmax(cosines, axis=1)
        angle = _angles(cosines[np.arange(len(own)), own])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(own, pa.int32()),
                pa.array([row.tobytes() for row in code], pa.binary()),
                pa.array(scale),
                pa.array(rest),
                pa.array(angle),
                batch.column("vector"),
            ],
            names=["id", "cluster", "code", "scale", "rest", "angle", "vector"],
        )


def _write(rows: DataFrame, centres: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Write placed rows; gives each cluster's radius and number of rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = f"id {kinds['id']}, cluster int, code binary, scale double, rest double, angle double, vector {kinds['vector']}"
    placed = rows.mapInArrow(lambda batches: _place(batches, centres), ddl)
    # A cluster of any size is spread by its ids.
    ranged = placed.repartitionByRange("cluster", F.xxhash64("id")).sortWithinPartitions("cluster")
    ranged.write.parquet(path)
    radius, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    stats = rows.sparkSession.read.parquet(path).groupBy("cluster").agg(F.max("angle"), F.count("*"))
    for cluster, widest, n in stats.collect():  # one row for each centre
        radius[cluster], counts[cluster] = widest, n
    return radius, counts


def build_index(
    rows: DataFrame, path: str, clusters: int | None = None, sample_rows: int = SAMPLE_ROWS
) -> ClusteredIndex:
    """Index ``rows(id, vector)`` below ``path``. All rows are kept; centres are fitted on a sample.

    ``clusters`` is the root of the number of rows unless given. A vector of another length than the others,
    or a null one, is an error. Zero vectors score 0 with every question. Ids must be unique.
    """
    rows = rows.select("id", _present(F.col("vector"), "vector"))
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()
    sample = _matrix(drawn.column("vector").combine_chunks())
    if len(sample) == 0:
        raise ValueError("an index needs at least one row")
    wanted = clusters or max(1, min(MOST_CLUSTERS, math.isqrt(n)))
    centres = fit_centres(sample, min(wanted, len(sample)))
    part = f"{path}/rows-0"
    radius, counts = _write(rows, centres, part)
    return ClusteredIndex(rows.sparkSession, path, (part,), centres, radius, counts)


def append_rows(index: ClusteredIndex, more: DataFrame) -> ClusteredIndex:
    """The index with further rows, written as a part of its own."""
    part = f"{index.path}/rows-{len(index.parts)}"
    radius, counts = _write(more.select("id", _present(F.col("vector"), "vector")), index.centres, part)
    return ClusteredIndex(
        index.spark,
        index.path,
        (*index.parts, part),
        index.centres,
        np.maximum(index.radius, radius),
        index.rows + counts,
    )


def _present(vector: Column, name: str) -> Column:
    return F.coalesce(vector, F.raise_error(F.lit(f"null in {name}"))).alias(name)


def _groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each cluster, and in how many blocks of rows a group is cut: only a large cluster, alone in its group, is."""
    group, blocks, held = np.zeros(len(sizes), np.int32), [], 0
    for cluster, n in enumerate(sizes.tolist()):
        if not blocks or held + n > CODE_BLOCK:
            blocks.append(1)
            held = 0
        held += n
        group[cluster] = len(blocks) - 1
        blocks[-1] = max(1, -(-held // CODE_BLOCK))
    return group, np.array(blocks)


def _asked_clusters(index: ClusteredIndex, k: int, nearest: bool):
    """A function of batches ``query_id, vector, floor``: the clusters each question asks, listed by group.

    These are the nearest clusters that hold k rows, or else the others whose bound, the most that a row of
    the cluster can score, reaches the floor. A few questions at a time meet the centres.
    """
    centres, radius, rows = index.centres, index.radius, index.rows
    filled, (group, _) = np.flatnonzero(rows), _groups(rows)
    step = QUERIES_PER_PASS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for first in range(0, some.num_rows, step):
                batch = some.slice(first, step)
                unit = _matrix(batch.column("vector"), centres.shape[1])
                angle = _angles(unit @ centres[filled].T)
                order = np.argsort(angle, axis=1, kind="stable")
                before = np.cumsum(rows[filled][order], axis=1) - rows[filled][order]
                wanted = np.zeros_like(angle, bool)
                np.put_along_axis(wanted, order, before < k, axis=1)
                if not nearest:
                    bound = np.cos(np.maximum(angle - radius[filled] - FLOAT_SLACK, 0.0)) + FLOAT_SLACK
                    wanted = ~wanted & (bound >= batch.column("floor").to_numpy()[:, None] - ROUNDING)
                q, c = np.nonzero(wanted)
                if len(q) == 0:
                    continue
                cluster = filled[c]
                g = group[cluster]
                starts = np.flatnonzero(np.append(True, (np.diff(q) != 0) | (np.diff(g) != 0)))
                ends = pa.array(np.append(starts, len(q)), pa.int32())
                at = pa.array(q[starts])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("query_id").take(at),
                        batch.column("vector").take(at),
                        batch.column("floor").take(at),
                        pa.array(g[starts], pa.int32()),
                        pa.ListArray.from_arrays(ends, pa.array(cluster, pa.int32())),
                    ],
                    names=["query_id", "vector", "floor", "group", "clusters"],
                )

    return ask


def _scan_codes(index: ClusteredIndex, wanted: DataFrame, k: int, id_type: str, key_type: str) -> DataFrame:
    """``query_id, cluster, id, low, high`` of rows that may be among the k best of their block.

    ``wanted(query_id, vector, floor, group, clusters)`` names the clusters to scan for each question, and a
    score that its k best rows are known to reach. Small clusters are dealt together in groups, large ones are
    cut in blocks of rows, and the questions that ask a group in blocks, too; where two blocks meet, each
    cluster's codes meet the questions that ask it, a few at a time.
    """
    spark = index.spark
    group, blocks = _groups(index.rows)
    asking = wanted.groupBy("group").agg(F.count("*").alias("n_asking"))
    cut = spark.createDataFrame([(g, n) for g, n in enumerate(blocks.tolist())], "group int, n_blocks int")
    grid = asking.join(cut, "group").withColumn("n_parts", F.ceil(F.col("n_asking") / QUESTION_BLOCK).cast("int"))
    grid = stage_table(grid.select("group", "n_blocks", "n_parts"), "grid")
    placed = spark.createDataFrame([(c, g) for c, g in enumerate(group.tolist())], "cluster int, group int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(column: str, n: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(n)).cast("int")

    # One row for each centre at most.
    codes = index.table().select("id", "cluster", "code", "scale", "rest")
    codes = codes.join(F.broadcast(placed), "cluster").join(F.broadcast(grid), "group")
    left = codes.withColumn("block", own("id", "n_blocks")).withColumn("part", every("n_parts"))
    left = left.drop("n_blocks", "n_parts")
    right = wanted.join(F.broadcast(grid), "group").withColumn("part", own("query_id", "n_parts"))
    right = right.withColumn("block", every("n_blocks")).drop("n_blocks", "n_parts")
    width, most = index.centres.shape[1], QUERIES_PER_PASS

    def scan(rows: pa.Table, questions: pa.Table) -> pa.Table:
        names = ["query_id", "cluster", "id", "low", "high"]
        if rows.num_rows == 0 or questions.num_rows == 0:
            none = pa.array([], pa.float64())
            return pa.Table.from_arrays(
                [questions.column("query_id")[:0], rows.column("cluster")[:0], rows.column("id")[:0], none, none], names
            )
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, width)
        scale, rest = rows.column("scale").to_numpy(), rows.column("rest").to_numpy() + FLOAT_SLACK
        unit = _matrix(questions.column("vector").combine_chunks(), width)
        floor = questions.column("floor").to_numpy().copy()
        listed = questions.column("clusters").combine_chunks()
        asks, who = pc.list_flatten(listed).to_numpy(), pc.list_parent_indices(listed).to_numpy()
        owner, found = rows.column("cluster").to_numpy(), []
        for cluster in np.unique(owner):
            r, asking = np.flatnonzero(owner == cluster), who[asks == cluster]
            near = (code[r].astype(np.float64) * scale[r, None]).T
            step = max(1, min(most, SCORES_AT_ONCE // len(r)))
            for at in range(0, len(asking), step):
                q = asking[at : at + step]
                score = unit[q] @ near
                if len(r) > k:
                    known = np.partition(score - rest[r], len(r) - k, axis=1)[:, len(r) - k]
                    floor[q] = np.maximum(floor[q], known)
                i, j = np.nonzero(score + rest[r] >= floor[q][:, None] - ROUNDING)
                found.append((q[i], r[j], score[i, j]))
        q, r, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        high = score + rest[r]
        # Later clusters have raised the floor.
        kept = high >= floor[q] - ROUNDING
        q, r, score, high = q[kept], r[kept], score[kept], high[kept]
        at_r = pa.array(r)
        return pa.Table.from_arrays(
            [
                questions.column("query_id").take(pa.array(q)),
                rows.column("cluster").take(at_r),
                rows.column("id").take(at_r),
                pa.array(score - rest[r], pa.float64()),
                pa.array(high, pa.float64()),
            ],
            names,
        )

    keys = ("group", "block", "part")
    ddl = f"query_id {key_type}, cluster int, id {id_type}, low double, high double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, ddl)


def _kth_low(found: DataFrame, k: int) -> DataFrame:
    """``query_id, floor``: a score that k of the found rows are known to reach."""
    best = Window.partitionBy("query_id").orderBy(F.desc("low"))
    ranked = found.select("query_id", "low", F.row_number().over(best).alias("place")).where(F.col("place") == k)
    return ranked.select("query_id", F.col("low").alias("floor"))


def search(index: ClusteredIndex, questions: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """The k best rows for each of ``questions(query_id, vector)`` by cosine, exactly, with their rank.

    ``query_id, id, score, rank, vectors_read, clusters_read``: the last two are the rows whose vectors and
    the clusters whose codes were read for the question. Scores that agree to six decimals are a
    tie, which the smaller id wins; k is clipped to the rows. Question ids must be unique.
    """
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    table = index.table()
    id_type = table.schema["id"].dataType.simpleString()
    key_type = questions.schema[query_id].dataType.simpleString()
    asked = questions.select(F.col(query_id).alias("query_id"), _present(F.col("vector"), "vector"))
    kind = asked.schema["vector"].dataType.simpleString()
    ddl = f"query_id {key_type}, vector {kind}, floor double, `group` int, clusters array<int>"
    lowest = F.lit(-2.0)
    near = asked.withColumn("floor", lowest).mapInArrow(_asked_clusters(index, k, True), ddl)
    near = stage_table(near, "near-clusters")
    first = stage_table(_scan_codes(index, near, k, id_type, key_type), "near-codes")
    known = stage_table(_kth_low(first, k), "floors")
    open_ = asked.join(known, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest))
    more = stage_table(open_.mapInArrow(_asked_clusters(index, k, False), ddl), "open-clusters")
    second = _scan_codes(index, more, k, id_type, key_type)
    found = stage_table(first.unionByName(second), "coded")
    floors = _kth_low(found, k)
    kept = found.join(floors, "query_id", "left").where(F.col("high") >= F.coalesce("floor", lowest) - ROUNDING)
    kept = stage_table(kept.select("query_id", "cluster", "id"), "kept")
    scored = (
        table.select("cluster", "id", F.col("vector").alias("v"))
        .join(kept, ["cluster", "id"])
        .join(asked, "query_id")
        .mapInArrow(_exact, f"query_id {key_type}, id {id_type}, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(best))
    ranked = ranked.withColumn("vectors_read", F.count("*").over(Window.partitionBy("query_id")))
    scanned = near.select("query_id", "clusters").unionByName(more.select("query_id", "clusters")).groupBy("query_id")
    scanned = scanned.agg(F.sum(F.size("clusters")).alias("clusters_read"))
    return ranked.where(F.col("rank") <= k).join(scanned, "query_id")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of pairs of whole vectors."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows, asked = _matrix(batch.column("v")), _matrix(batch.column("vector"))
        if rows.shape != asked.shape:
            raise DimensionMismatch(f"corpus {rows.shape[1]}, query {asked.shape[1]}")
        score = np.round(np.einsum("ij,ij->i", rows, asked), SCORE_DECIMALS) + 0.0
        yield pa.RecordBatch.from_arrays(
            [batch.column("query_id"), batch.column("id"), pa.array(score)], names=["query_id", "id", "score"]
        )
