"""MinHash near-duplicates, with odd sketches checking the banded candidates.

1. A document's shingle set gives MinHash samples, band keys from groups of samples, a
   digest of the whole set, and an odd sketch: every (position, sample) flips one bit of a
   bitmap. Two bitmaps differ in about 1 bit for each element of the symmetric difference of
   the sampled sets, which is small and precise just where the similarity is high.
2. Documents with equal sets collapse to one representative.
3. Representatives that share a band key are compared by XOR population count of their
   sketches and by set size, inside tasks; a task passes on a star for each connected part
   rather than its pairs. Components of these stars are the candidate clusters.
4. The members of a cluster are compared on their full sets: a block of documents by its
   shared shingles is a 0/1 matrix whose product with its transpose holds every intersection
   size. Links again leave as stars; their components are the result.

Band keys and clusters with many members are dealt to pairs of bounded blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, graph, words
from tidemark.llm.frames import staged

SHINGLE = 5
ROWS_PER_BAND = 4
LEAST_SAMPLES = 96
SKETCH_BITS = 512
# Chance that a pair just at the threshold shares no band, and that its sketches look too far apart.
MISS = 1e-6
BAND_BLOCK = 256
SET_BLOCK = 128
SET_BLOCK_SHINGLES = 2 << 20


def bands_for(percent: int) -> int:
    """Bands needed so that a pair at the threshold is missed with a chance of ``MISS`` at most."""
    agree = min(percent / 100, 0.999) ** ROWS_PER_BAND
    return math.ceil(math.log(MISS) / math.log1p(-agree))


def most_odd_bits(samples: int, percent: int) -> int:
    """Odd bits that a pair at the threshold exceeds with a chance of about ``MISS``."""
    p, tail, differ = 1 - percent / 100, 1.0, 0
    term = (1 - p) ** samples
    while tail > MISS and differ < samples:
        tail -= term
        term *= (samples - differ) / (differ + 1) * p / (1 - p)
        differ += 1
    flips = 2 * differ
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return math.ceil(expected + 2 * flips * math.sqrt(2 / SKETCH_BITS))


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows, in row order, of every shingle; a shorter text is one shingle of all its words."""
    starts, ends, rows = words.word_spans(raw, offsets)
    hashes = words.word_hashes(raw, starts, ends, lower=True)
    counts = words.row_counts(rows, len(offsets) - 1)
    parts = [words.window_hashes(hashes, rows, width)]
    out, at = [parts[0][0]], [rows[parts[0][1]]]
    for short in range(1, width):
        here = counts[rows] == short
        if here.any():
            some, first = words.window_hashes(hashes[here], rows[here], short)
            out.append(some)
            at.append(rows[here][first])
    values, owner = np.concatenate(out), np.concatenate(at)
    if len(out) > 1:
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, owner


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, keys, sketch`` of each row of ``doc_id, text``.

    A text without words has no shingles, no keys and null digests.
    """
    n_bands = bands_for(percent)
    samples = max(LEAST_SAMPLES, n_bands * ROWS_PER_BAND)

    def run(batches):
        rng = np.random.default_rng(7)
        factor = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 2**63, samples, dtype=np.uint64)
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                raw, offsets = frames.text_bytes(part.column("text"))
                values, owner = shingles(raw, offsets)
                single, single_owner = distinct(values, owner)
                sizes = words.row_counts(single_owner, part.num_rows)
                full = np.flatnonzero(sizes)
                first = np.searchsorted(owner, full)
                lowest = np.empty((len(full), samples), np.uint64)
                for k in range(samples if len(full) else 0):
                    lowest[:, k] = np.minimum.reduceat(values * factor[k] + shift[k], first)
                own = np.searchsorted(single_owner, full)
                d1 = np.add.reduceat(words.mix(single ^ np.uint64(0x51)), own) if len(full) else own
                d2 = np.add.reduceat(words.mix(single * np.uint64(0x9FB21C651E98DF25)), own) if len(full) else own
                keys = np.zeros((len(full), n_bands), np.uint64)
                for band in range(n_bands):
                    key = np.full(len(full), band + 1, np.uint64)
                    for k in range(ROWS_PER_BAND):
                        key = words.mix(key ^ lowest[:, band * ROWS_PER_BAND + k])
                    keys[:, band] = key
                bits = words.mix(lowest ^ words.mix(np.arange(1, samples + 1, dtype=np.uint64)))
                flat = (bits % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(full))[:, None] * SKETCH_BITS
                odd = np.bincount(flat.ravel(), minlength=len(full) * SKETCH_BITS) & 1
                sketch = np.packbits(odd.astype(bool).reshape(len(full), SKETCH_BITS), axis=1)
                has = np.zeros(part.num_rows, np.int64)
                has[full] = np.arange(len(full)) + 1
                missing = has == 0
                pick = np.maximum(has - 1, 0)

                def spread(x, pick=pick, missing=missing):
                    rows = x.view(np.int64)[pick] if len(x) else np.zeros(len(pick), np.int64)
                    return pa.array(rows, mask=missing)

                blank = np.zeros((1, SKETCH_BITS // 8), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes),
                        spread(d1),
                        spread(d2),
                        frames.list_array(
                            keys.view(np.int64).ravel(), np.where(missing, 0, n_bands), pa.int64()
                        ),
                        frames.fixed_binary(sketch[pick] if len(full) else np.repeat(blank, len(pick), 0)),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sketch binary"
    )


def stars(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``nodes`` as one star for each connected part, at its smallest node."""
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    label = merge = frames.merge_labels(len(nodes), rank[left], rank[right])
    spoke = np.flatnonzero(merge != np.arange(len(nodes)))
    return nodes[order][spoke], nodes[order][label[spoke]]


def _edge_batch(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    """Stars over the representatives whose sketches and sizes allow the similarity and that share a band."""
    most = most_odd_bits(max(LEAST_SAMPLES, bands_for(percent) * ROWS_PER_BAND), percent)
    members = reps.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    # Staged, so that both sides of the join are shuffled and a hot bucket can be split.
    counts = members.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    counts = staged(counts, "buckets")
    hits = members.join(counts, "key")
    hits = frames.blocked(hits, "key", "members", "node", BAND_BLOCK)
    sketches = reps.select(F.col("doc_id").alias("node"), "n_shingles", "sketch")
    hits = hits.join(sketches, "node")

    def run(table):
        keys = ["key", "left_block", "right_block"]
        starts = np.append(frames.group_starts(table, keys), table.num_rows)
        nodes = table.column("node").to_numpy()
        sizes = table.column("n_shingles").to_numpy()
        block = table.column("block").to_numpy()
        apart = table.column("left_block").to_numpy() != table.column("right_block").to_numpy()
        sketch = frames.binary_rows(table.column("sketch"), np.uint64)
        out = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            i, j = np.triu_indices(e - s, 1)
            near = 100 * np.minimum(sizes[s + i], sizes[s + j]) >= percent * np.maximum(sizes[s + i], sizes[s + j])
            if apart[s]:
                near &= block[s + i] != block[s + j]
            i, j = i[near], j[near]
            close = np.bitwise_count(sketch[s + i] ^ sketch[s + j]).sum(axis=1, dtype=np.int64) <= most
            out.append(stars(nodes[s:e], i[close], j[close]))
        yield _edge_batch(out)

    edges = frames.by_group(hits, ["key", "left_block", "right_block"], run, "a long, b long")
    return edges.where("a != b").distinct()


def full_sets(docs: DataFrame) -> DataFrame:
    """``(cluster, members, node, set)``: the sorted distinct shingle hashes of the rows of ``docs``."""

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                raw, offsets = frames.text_bytes(part.column("text"))
                values, owner = distinct(*shingles(raw, offsets))
                counts = words.row_counts(owner, part.num_rows)
                ends = np.zeros(part.num_rows + 1, np.int32)
                np.cumsum(counts * 8, out=ends[1:])
                sets = pa.Array.from_buffers(
                    pa.binary(), part.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("cluster"), part.column("members"), part.column("node"), sets],
                    names=["cluster", "members", "node", "set"],
                )

    return docs.select("cluster", "members", "node", "text").mapInArrow(
        run, "cluster long, members double, node long, set binary"
    )


def intersections(values: np.ndarray, owner: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of ``n`` sets, exactly, from products of 0/1 matrices."""
    single, place, times = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    place, owner = column[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((n, n))
    for start in range(0, int((times > 1).sum()), columns):
        low, high = np.searchsorted(place, [start, start + columns])
        part = np.zeros((n, min(columns, int((times > 1).sum()) - start)), np.float32)
        part[owner[low:high], place[low:high] - start] = 1
        out += part @ part.T
    return out.astype(np.int64)


def verified_edges(sets: DataFrame, percent: int) -> DataFrame:
    """Stars over the documents of each cluster that are linked on their full sets."""
    dealt = frames.blocked(sets, "cluster", "members", "node", SET_BLOCK)

    def run(table):
        keys = ["cluster", "left_block", "right_block"]
        starts = np.append(frames.group_starts(table, keys), table.num_rows)
        nodes = table.column("node").to_numpy()
        column = table.column("set").combine_chunks()
        raw, offsets = frames.text_bytes(column)
        values, offsets = raw.copy().view(np.uint64), offsets // 8
        out = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            sizes = np.diff(offsets[s : e + 1])
            owner = np.repeat(np.arange(e - s), sizes)
            both = intersections(values[offsets[s] : offsets[e]], owner, e - s)
            linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            i, j = np.nonzero(np.triu(linked, 1))
            out.append(stars(nodes[s:e], i, j))
        yield _edge_batch(out)

    edges = frames.by_group(dealt, ["cluster", "left_block", "right_block"], run, "a long, b long")
    return edges.where("a != b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` on their sets of distinct
    5-word shingles of the text with A-Z lowered; a shorter text is one shingle.

    A null or empty text, or one of white space, has ``n_shingles`` 0 and is its own
    component. A row with a null id is not linked: its component is null and it is kept.
    Rows that share an id are one document with the links of all their texts. Other columns
    are ignored. An empty table gives an empty result.
    """
    seen = staged(signatures(docs, percent), "signatures")
    some = seen.where("doc_id is not null and n_shingles > 0")
    # Staged, so that both sides of the join are shuffled and a large class can be split.
    classes = staged(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "reps")
    members = staged(
        some.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "rep").distinct(), "classes"
    )
    reps = some.join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    clusters = graph.components(candidate_edges(reps.select("doc_id", "n_shingles", "keys", "sketch"), percent))
    lengths = some.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n"))
    sized = clusters.join(lengths, "node").groupBy("component").agg(
        F.greatest(F.count("*").cast("double"), F.sum("n") * (SET_BLOCK / SET_BLOCK_SHINGLES)).alias("members")
    )
    clusters = staged(
        clusters.join(sized, "component").select(F.col("component").alias("cluster"), "members", "node"), "clusters"
    )
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    sets = full_sets(frames.small_join(texts, clusters, "node", "inner", 24))
    links = verified_edges(sets, percent)
    copies = members.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    parts = graph.components(links)
    rooted = members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id")
    )
    # An id with several texts belongs to several classes; joining them keeps one component.
    several = members.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not several.isEmpty():
        parts = graph.components(links.union(copies).union(members.select(F.col("doc_id").alias("a"), "rep")))
        rooted = parts.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return seen.join(rooted, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the smallest id stays.

    Rows with a null id stay, and so do all rows that share the id that stays.
    """
    verdict = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return frames.small_join(docs, staged(verdict, "copies"), "doc_id", "left_anti", 16)
