"""A Merkle manifest of a table: few levels are stored, proofs regenerate the others.

Rows become leaves, the leaves of each group a tree, and the groups' roots one more tree.
Nodes of a level are numbered from 0, so a run of ``FANOUT ** apart`` consecutive nodes is the
foot of an aligned subtree of ``apart`` levels. Only the feet are stored: leaves, and every
``apart``-th level above them. To extract proofs, the inner nodes of each subtree are
computed again from its stored foot, handed out as siblings, and dropped; the part of a proof
above the subtree is that of the stored node at its top.

A subtree's foot is one row with a bounded list of nodes, so no group, however large, is in one
task. Positions come from a range partitioning: numbers inside a partition, moved by the counts
of the partitions before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import small_join
from tidemark.session import scratch_path

FANOUT = 2
# Levels between two stored ones.
APART = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"
# Monotonic ids hold the partition above this bit and the row below it.
PARTITION_BIT = 33


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(**replaced: Column) -> Column:
    """The digest of a row's fields in the order of ``COLUMNS``."""
    return digest(*(field(replaced.get(name, F.col(name))) for name in COLUMNS))


def group_key(group: Column) -> Column:
    """Text that orders as the group does, null first, and is never null itself."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


@dataclass(frozen=True)
class Tree:
    """Stored feet ``key, block, of, nodes`` from the leaves up, and ``roots(key, digest)``."""

    levels: list[DataFrame]
    roots: DataFrame
    apart: int


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(rows: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """``rows`` with ``at``, the place among the rows of the same ``key``, and ``of``, their number.

    Rows that agree in all of ``order`` are told apart by where they were read, so that
    many of them may be split.
    """
    read = _written(rows.withColumn("read_at", F.monotonically_increasing_id()), f"{path}/rows")
    ranged = read.repartitionByRange("key", *order, "read_at").sortWithinPartitions("key", *order, "read_at")
    placed = _written(ranged.drop("read_at").withColumn("id", F.monotonically_increasing_id()), f"{path}/ranged")
    part = F.shiftright("id", PARTITION_BIT)
    placed = placed.withColumn("part", part).withColumn("at", F.col("id") - F.shiftleft("part", PARTITION_BIT)).drop("id")
    counts = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    counts = _written(counts, f"{path}/counts")
    shifts = counts.selectExpr(
        "key",
        "part",
        "sum(n) over (partition by key order by part) - n - first as shift",
        "sum(n) over (partition by key) as of",
    )
    shifts = _written(shifts, f"{path}/shifts")
    joined = small_join(placed, shifts, ["key", "part"], "inner", 256)
    return joined.withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def _feet(nodes: DataFrame, payload: Sequence[str], foot: int) -> DataFrame:
    """Nodes ``key, at, of, digest`` gathered to the feet of aligned subtrees."""
    return (
        nodes.groupBy("key", F.floor(F.col("at") / foot).alias("block"), "of")
        .agg(F.array_sort(F.collect_list(F.struct("at", "digest", *payload))).alias("nodes"))
        .select("key", "block", "of", "nodes")
    )


def _inner(foot: list[str], of: int, apart: int) -> list[list[str]]:
    """The levels of a subtree from its foot, of a level with ``of`` nodes, up to its top."""
    levels = [foot]
    while of > 1 and len(levels) <= apart:
        below = levels[-1]
        levels.append(
            [
                hashlib.sha256("".join(below[k : k + FANOUT]).encode()).hexdigest()
                for k in range(0, len(below), FANOUT)
            ]
        )
        of = -(-of // FANOUT)
    return levels


def _feet_of(batch: pa.RecordBatch):
    nodes = batch.column("nodes")
    digests, ends = nodes.flatten().field("digest").to_pylist(), nodes.offsets.to_pylist()
    for (start, stop), of in zip(pairwise(ends), batch.column("of").to_pylist(), strict=True):
        yield digests[start - ends[0] : stop - ends[0]], of


def _tops(batches, apart: int):
    """The top node of each subtree, as a node of the next stored level."""
    for batch in batches:
        tops, counts = [], []
        for foot, of in _feet_of(batch):
            levels = _inner(foot, of, apart)
            tops.append(levels[-1][0])
            for _ in levels[1:]:
                of = -(-of // FANOUT)
            counts.append(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("block"), pa.array(counts, pa.int64()), pa.array(tops, pa.string())],
            names=["key", "at", "of", "digest"],
        )


def _own_steps(batches, apart: int):
    """Each subtree with ``own``: for every node of its foot the steps of its proof up to the top."""
    for batch in batches:
        left, right, steps, nodes = [], [], [], []
        for foot, of in _feet_of(batch):
            levels = _inner(foot, of, apart)[:-1]
            nodes.append(len(foot))
            for at in range(len(foot)):
                for level in levels:
                    start = at - at % FANOUT
                    left.append("".join(level[start:at]))
                    right.append("".join(level[at + 1 : start + FANOUT]))
                    at //= FANOUT
                steps.append(len(levels))
        step = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *steps]), pa.int32()), step)
        own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *nodes]), pa.int32()), inner)
        yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "own"])


def build_tree(
    leaves: DataFrame, order: Sequence[str], payload: Sequence[str], path: str, apart: int = APART
) -> Tree:
    """A tree for each ``key`` of ``leaves(key, digest, *order, *payload)``, its feet below ``path``."""
    nodes, levels, roots = positions(leaves, order, f"{path}/positions"), [], None
    spark, extra = leaves.sparkSession, list(payload)
    while True:
        at = f"{path}/level-{len(levels) * apart}"
        levels.append(_written(_feet(nodes, extra, FANOUT**apart), at))
        tops = levels[-1].mapInArrow(lambda b: _tops(b, apart), "key string, at long, of long, digest string")
        tops = _written(tops, f"{at}-tops")
        done = tops.where("of = 1").select("key", "digest")
        roots = done if roots is None else roots.union(done)
        nodes, extra = tops.where("of > 1"), []
        if nodes.isEmpty():
            return Tree(levels, _written(roots, f"{path}/roots"), apart)


def open_tree(spark: SparkSession, path: str, levels: int, apart: int = APART) -> Tree:
    """A tree that :func:`build_tree` stored, of so many stored levels."""
    feet = [spark.read.parquet(f"{path}/level-{k * apart}") for k in range(levels)]
    return Tree(feet, spark.read.parquet(f"{path}/roots"), apart)


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """``key, subroot, at, digest, *payload, proof`` for every leaf of the tree.

    ``proof`` lists, level by level, the joined digests left and right of the node on the
    way up. ``above(key, subroot, path)`` has what follows a key's root.
    """
    upper, apart = None, tree.apart
    foot = FANOUT**apart
    for feet in reversed(tree.levels):
        whole = feet.where(F.col("of") <= foot).join(above, "key")
        if upper is not None:
            inner = feet.where(F.col("of") > foot).join(upper, ["key", "block"])
            whole = whole.unionByName(inner)
        own = whole.mapInArrow(lambda b: _own_steps(b, apart), _ddl(whole, f"own array<array<{STEP}>>"))
        each = own.select("key", "subroot", "path", F.explode(F.arrays_zip("nodes", "own")).alias("it"))
        each = each.select("key", "subroot", "it.nodes.*", F.concat("it.own", "path").alias("proof"))
        upper = each.select("key", "subroot", F.col("at").alias("block"), F.col("proof").alias("path"))
    return each


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of a proof give."""
    return F.aggregate(proof, start, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(proof: Column) -> Column:
    joined = F.transform(proof, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.concat_ws("", joined).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, the tree over their roots, and its root (None without rows)."""

    groups: Tree
    top: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """``key, subroot, at, digest, proof`` and the payload of every leaf, proved up to the root."""
        nothing = F.expr(f"cast(array() as array<{STEP}>)")
        over = proofs(self.top, self.top.roots.select("key", F.col("digest").alias("subroot"), nothing.alias("path")))
        above = over.selectExpr("`group` as key", "digest as subroot", "proof as path")
        return proofs(self.groups, above)


def build_manifest(
    docs: DataFrame,
    group: str,
    order: str,
    payload: dict[str, Column],
    path: str | None = None,
    apart: int = APART,
) -> Manifest:
    """Store the manifest of ``docs``: trees by ``group`` in the order of ``order``.

    ``payload`` columns are kept with the leaves. ``path`` is a new folder in a shared store;
    by default one below the session's shared folder.

    Nulls count as fields of their own; null groups come first. Rows with one ``order`` value
    are put in order of their digests, and null ones come first. Repeated rows are a leaf each.
    Columns that are not in ``COLUMNS`` or ``payload`` are ignored. A table without rows has no root.
    """
    path = path or scratch_path(docs.sparkSession, "merkle")
    leaves = docs.select(
        group_key(F.col(group)).alias("key"),
        leaf_digest().alias("digest"),
        F.col(order).alias("order_by"),
        *(c.alias(name) for name, c in payload.items()),
    )
    groups = build_tree(leaves, ["order_by", "digest"], list(payload), f"{path}/groups", apart)
    subroots = groups.roots.select(F.lit("").alias("key"), "digest", F.col("key").alias("group"))
    top = build_tree(subroots, ["group"], ["group"], f"{path}/top", apart)
    root = top.roots.first()
    return Manifest(groups, top, None if root is None else root["digest"])


def tampered(number: int = 7) -> Column:
    """Whether the check tampers with a row: its id's checksum is divisible by ``number``."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(number)) == 0, F.lit(False))


def proved_leaves(docs: DataFrame, path: str | None = None, apart: int = APART) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of documents.

    Every row is proved with the siblings stored for it. The rows of :func:`tampered` are folded from
    what they are after 1 is added to ``n_chars``; a null stays null, and the largest long,
    which has no successor, becomes null. A row without an id is not tampered with.
    """
    changed = F.when(tampered(), leaf_digest(n_chars=F.try_add(F.col("n_chars"), F.lit(1))))
    manifest = build_manifest(docs, "lang", "doc_id", {"doc_id": F.col("doc_id"), "changed": changed}, path, apart)
    root = F.lit(manifest.root).cast("string")
    proved = manifest.proofs().withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("proof")))
    return proved.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
