"""Near-duplicate vectors by randomly rotated binary codes with stored corrections.

A unit vector ``x`` is padded and rotated at random; its code is the signs of the result and its
correction ``f`` is the inner product of the rotated vector with its normalised code. For a
rotated vector ``q`` and a code ``b``, ``<q, b> / f`` estimates ``<q, x>`` without bias, and its
error is below ``EPSILON * sqrt((1 - f*f) / (f*f * (bits - 1)))`` but for a chance that falls off
like a normal tail. A pair is recomputed in double precision only if the upper confidence bound
reaches the threshold; what is recomputed alone decides.

Pairs to look at share a band: a group of code bits, as many as the number of vectors asks for,
and as many bands as keep the chance of missing a pair at the threshold below ``MISS``. A pair is
counted in the first band it shares only, so nothing is counted twice and no pair leaves a task:
a task gives link counts and a star for each connected part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, graph, near
from tidemark.llm.frames import staged
from tidemark.llm.words import mix

EPSILON = 4.5
MISS = 1e-4
LEAST_BAND_BITS = 8
# Distinct vectors that fall in one band bucket by chance, about.
BUCKET = 16
BLOCK = 256


def rotation(width: int, bits: int) -> np.ndarray:
    """Columns of random orthogonal matrices: ``bits`` x ``width``, bits a multiple of a padded width."""
    rng = np.random.default_rng(11)
    size = 64 * math.ceil(width / 64)
    parts = [np.linalg.qr(rng.standard_normal((size, size)))[0][:, :width] for _ in range(math.ceil(bits / size))]
    return np.concatenate(parts).astype(np.float32)


def bands_for(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a band for ``n`` vectors and bands so that a pair at ``cosine`` is missed with chance ``MISS``."""
    width = max(LEAST_BAND_BITS, math.ceil(math.log2(max(n, 2) / BUCKET)))
    same = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(MISS) / math.log1p(-same))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors (scaled to norm 1 over all bits), code signs as bool, corrections."""
    turned = vectors.astype(np.float32) @ turn.T
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    signs = turned > 0
    correction = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
    return turned, signs, correction


def band_keys(signs: np.ndarray, width: int, bands: int) -> np.ndarray:
    """One 64-bit key for each vector and band, the band's number folded in."""
    power = np.uint64(1) << np.arange(width, dtype=np.uint64)
    bits = signs[:, : width * bands].reshape(len(signs), bands, width)
    value = (bits * power).sum(axis=2, dtype=np.uint64)
    return mix(value + (np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40)))


def unit_vectors(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors, in double precision, of the usable vectors of one width."""
    lists = table.column("vector")
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    rows, out = [], []
    for width in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == width)
        block = flat[(ends[own] - width)[:, None] + np.arange(width)]
        # A scale first, so that squares neither overflow nor vanish.
        scale = np.abs(block).max(axis=1)
        good = np.isfinite(scale) & (scale > 0)
        block = block[good] / scale[good, None]
        rows.append(own[good])
        out.append(block / np.linalg.norm(block, axis=1, keepdims=True))
    if len(out) > 1:
        raise ValueError("vectors of several widths cannot be compared")
    return (rows[0], out[0]) if out else (np.zeros(0, np.int64), np.zeros((0, 1)))


def check_widths(vectors: DataFrame) -> None:
    """One width over the whole table, or an error that names two; vectors that link with nothing do not count."""
    value = F.col("embedding").cast("array<double>")
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = value.isNotNull() & ~odd & F.exists(value, lambda x: x != 0)
    width = F.when(F.coalesce(fit, F.lit(False)), F.size(value))
    low, high = vectors.agg(F.min(width), F.max(width)).first()
    if low != high:
        raise ValueError(f"vectors of several widths cannot be compared: {low} and {high}")


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, unit)``: the unit vector as bytes of doubles; null, zero and non-finite vectors are left out."""

    def run(batches):
        for batch in batches:
            rows, units = unit_vectors(batch)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows)), frames.fixed_binary(units)], names=["vec_id", "unit"]
                )

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).mapInArrow(
        run, "vec_id long, unit binary"
    )


def banded(units: DataFrame, width: int, bands: int) -> DataFrame:
    """A row for each vector: ``node, copies, unit, code, correction, keys``."""

    def run(batches):
        turn = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = frames.binary_rows(batch.column("unit"), np.float64)
            if turn is None:
                turn = rotation(vectors.shape[1], width * bands)
            _, signs, correction = encode(vectors, turn)
            keys = band_keys(signs, width, bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("copies"),
                    batch.column("unit"),
                    frames.fixed_binary(np.packbits(signs, axis=1)),
                    pa.array(correction.astype(np.float64)),
                    frames.list_array(keys.view(np.int64).ravel(), np.full(len(keys), bands), pa.int64()),
                ],
                names=["node", "copies", "unit", "code", "correction", "keys"],
            )

    return units.mapInArrow(
        run, "node long, copies long, unit binary, code binary, correction double, keys array<long>"
    )


def linked_in_buckets(members: DataFrame, cosine: float, width: int, bands: int) -> DataFrame:
    """Links found in the buckets: ``a, b, links``.

    ``links`` is what ``a`` gains in linked vectors, copies counted; ``b`` is a smaller vector
    connected to ``a``, or ``a`` itself.
    """

    def compare(table, s, e, turn):
        part = table.slice(s, e - s)
        nodes, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
        units = frames.binary_rows(part.column("unit"), np.float64)
        packed = frames.binary_rows(part.column("code"), np.uint8)
        f = part.column("correction").to_numpy()
        signs = np.unpackbits(packed, axis=1).astype(bool)
        bits = signs.shape[1]
        turned = units.astype(np.float32) @ turn.T
        turned /= np.linalg.norm(turned, axis=1, keepdims=True)
        code = np.where(signs, np.float32(1 / math.sqrt(bits)), np.float32(-1 / math.sqrt(bits)))
        estimate = (turned @ code.T) / f
        margin = EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f * (bits - 1)))
        # Both orders estimate the same product; either bound may keep the pair.
        maybe = estimate + margin >= cosine
        maybe |= maybe.T
        block = part.column("block").to_numpy()
        apart = part.column("left_block")[0].as_py() != part.column("right_block")[0].as_py()
        i, j = np.nonzero(np.triu(maybe, 1))
        if apart:
            cross = block[i] != block[j]
            i, j = i[cross], j[cross]
        # In an earlier band the pair has been counted already.
        band = part.column("band")[0].as_py()
        if band and len(i):
            keys = band_keys(signs, width, bands)[:, :band]
            new = np.ones(len(i), bool)
            for at in range(0, len(i), 1 << 16):
                cut = slice(at, at + (1 << 16))
                new[cut] = ~(keys[i[cut]] == keys[j[cut]]).any(axis=1)
            i, j = i[new], j[new]
        linked = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            cut = slice(at, at + (1 << 14))
            linked[cut] = np.einsum("ij,ij->i", units[i[cut]], units[j[cut]]) >= cosine
        i, j = i[linked], j[linked]
        gained = np.bincount(i, weights=copies[j], minlength=len(nodes))
        gained += np.bincount(j, weights=copies[i], minlength=len(nodes))
        spoke, centre = near.stars(nodes, i, j)
        lead = dict(zip(spoke.tolist(), centre.tolist(), strict=True))
        own = np.flatnonzero(gained)
        return nodes[own], np.array([lead.get(x, x) for x in nodes[own].tolist()], np.int64), gained[own]

    def run(table):
        bounds = np.append(frames.group_starts(table, ["key", "left_block", "right_block"]), table.num_rows)
        turn, out = None, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s > 1:
                if turn is None:
                    dim = len(table.column("unit")[int(s)].as_buffer()) // 8
                    turn = rotation(dim, width * bands)
                out.append(compare(table, int(s), int(e), turn))
        a, b, links = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(links.astype(np.int64))], names=["a", "b", "links"]
        )

    keyed = members.select("node", F.posexplode("keys").alias("band", "key"))
    # Staged, so that both sides of the join are shuffled and a hot bucket can be split.
    counts = staged(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    hits = frames.blocked(keyed.join(counts, "key"), "key", "members", "node", BLOCK)
    hits = hits.join(members.select("node", "copies", "unit", "code", "correction"), "node")
    return frames.by_group(hits, ["key", "left_block", "right_block"], run, "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, ...)``.

    Vectors link at a cosine of ``cosine`` or more, computed in double precision. Vectors of
    equal direction, component by component after scaling, are one vector with copies, and copies
    link. A pair just at the threshold is missed with a chance of ``MISS``, a closer one with less.

    Vectors that are null, empty or zero, or hold a null or a non-finite component, link with
    nothing. A row with a null id has no links and a null component and is kept. Repeated rows
    count as vectors of their own. Vectors of different widths are an error. Other columns are
    ignored. An empty table gives an empty result.
    """
    given = vectors.where("vec_id is not null and not exists(embedding, x -> x is null or isnan(x))")
    check_widths(given)
    units = staged(usable(given), "units")
    classes = units.groupBy("unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = staged(classes, "classes")
    n = classes.count()
    width, bands = bands_for(n, cosine)
    members = staged(banded(classes.select("node", "copies", "unit"), width, bands), "codes")
    found = staged(linked_in_buckets(members, cosine, width, bands), "links")
    gained = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("gained"))
    parts = graph.components(found.where("a != b").select("a", "b"))
    by_class = classes.join(gained, "node", "left").join(parts, "node", "left").select(
        "unit",
        (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    verdict = units.join(by_class, "unit").groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    component = F.coalesce("component_id", "vec_id")
    return vectors.select("vec_id").join(verdict, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
