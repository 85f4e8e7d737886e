"""Substring duplicates by suffix automata over reference shards.

A window is 13 consecutive words of one text. The smallest 6-word hash of a window is its
anchor, so equal windows have equal anchors and neighbouring windows share one; texts are about
two ninths as many anchors as words.

1. Anchors found in two different texts go into a bit table of bounded size. Only texts with
   such an anchor are read on; the table's false positives cost work, not correctness.
2. The hashes of their windows, grouped, name the smallest document of every shared window:
   its owner.
3. What a document owns is a reference span. Reference spans are dealt by owner to shards of
   bounded size, and a suffix automaton is built over the words of each shard, every state with
   its smallest document. The spans of later documents go to the shards of their owners; a shard
   asked by many gets its automaton in several tasks.
4. A span streamed through the automaton has a matching statistic at each word. Where 13 words
   match and the state's smallest document comes before the span's own, the window is a repeat;
   overlapping repeats are maximal spans, and their words go.

Texts with equal words collapse first: all but the first one's words are repeats.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, words
from tidemark.llm.frames import staged

WINDOW = 13
ANCHOR = 6
# Bits of the anchor table for each shared anchor, and its size at most.
TABLE_BITS = 16
MOST_BITS = 1 << 28
# Reference words of a shard and words streamed through one copy of it, on average.
SHARD_WORDS = 50_000
# A small table is cut finer, so that every task has a shard.
LEAST_SHARD_WORDS = 1_000
STREAM_WORDS = 1_000_000


class Words:
    """The words of a slice of texts."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = frames.text_bytes(texts)
        self.starts, self.ends, self.rows = words.word_spans(self.raw, self.offsets)
        self.hashes = words.word_hashes(self.raw, self.starts, self.ends)
        self.n = len(texts)
        self.counts = words.row_counts(self.rows, self.n)
        self.first = np.append(0, np.cumsum(self.counts))[:-1]

    def digests(self, keep: np.ndarray | None = None) -> list[bytes]:
        """SHA-256 of each text's kept words, joined by one space."""
        kept = np.arange(len(self.starts)) if keep is None else np.flatnonzero(keep)
        rows, starts, ends = self.rows[kept], self.starts[kept], self.ends[kept]
        edge = np.zeros(len(self.raw) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        # A kept word that is not the row's last has white space behind it.
        gaps = ends[:-1][rows[:-1] == rows[1:]]
        raw = self.raw.copy()
        raw[gaps] = 0x20
        inside[gaps] = True
        length = np.append(0, np.cumsum(inside))[self.offsets]
        joined = memoryview(raw[inside])
        return [hashlib.sha256(joined[a:b]).digest() for a, b in zip(length[:-1], length[1:], strict=True)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and first word of every window."""
        grams, at = words.window_hashes(self.hashes, self.rows, ANCHOR)
        span = WINDOW - ANCHOR + 1
        if len(grams) < span:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        least = grams
        for step in (1, 2, 4):
            least = np.minimum(least[:-step], least[step:])
        n = len(least)
        inside = self.rows[at[:n]] == self.rows[at[span - 1 :]]
        return least[inside], at[:n][inside]


def class_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``(anchor, class)`` of the texts, once for neighbouring windows."""

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                w = Words(part.column("text"))
                anchors, at = w.anchors()
                rows = w.rows[at]
                new = np.ones(len(anchors), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
                classes = class_of(w.digests())[rows[new]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[new].view(np.int64)), pa.array(classes)], names=["anchor", "class"]
                )

    return docs.select("text").mapInArrow(run, "anchor long, class long")


def shared_anchors(docs: DataFrame) -> DataFrame:
    """``(key,)``: the anchors that two different texts have."""
    shared = anchor_rows(docs).groupBy("anchor").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    return staged(shared.where("a != b").select(F.col("anchor").alias("key")), "anchors")


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bit table of the staged ``key`` values; 32 MB at most."""
    bits = 1 << 16
    wanted = keys.count() * TABLE_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    slot = F.pmod("key", F.lit(bits))
    cells = keys.groupBy(F.shiftright(slot, 6).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) & 63 as int))")).alias("bits")
    )
    table = np.zeros(bits // 64, np.uint64)
    got = cells.toArrow()  # a row for each 64 bits of the table at most
    table[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def in_table(table: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    slot = anchors % np.uint64(64 * len(table))
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


class SuffixAutomaton:
    """Suffix automaton of several word sequences, each of a document.

    ``least[state]`` is the smallest document in which the state's sequences occur.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [math.inf]

    def add(self, sequence: list[int], doc: int) -> None:
        """Append a sequence; it starts anew at the root, so none runs across two."""
        next_, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in sequence:
            there = next_[last].get(word)
            if there is not None and length[there] == length[last] + 1:
                last = there
                least[last] = min(least[last], doc)
                continue
            state = last
            if there is None:
                new = len(next_)
                next_.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(doc)
                while state >= 0 and word not in next_[state]:
                    next_[state][word] = new
                    state = link[state]
                if state < 0:
                    last = new
                    continue
                there = next_[state][word]
                if length[there] == length[state] + 1:
                    link[new] = there
                    last = new
                    continue
            else:
                new = None
            copy = len(next_)
            next_.append(dict(next_[there]))
            length.append(length[state] + 1)
            link.append(link[there])
            least.append(least[there])
            while state >= 0 and next_[state].get(word) == there:
                next_[state][word] = copy
                state = link[state]
            link[there] = copy
            if new is None:
                last = copy
                least[copy] = min(least[copy], doc)
            else:
                link[new] = copy
                last = new

    def finish(self) -> None:
        """Hand the smallest documents on to the suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            if self.least[state] < self.least[above]:
                self.least[above] = self.least[state]

    def repeats(self, sequence: list[int], doc: int, width: int) -> list[int]:
        """Starts of the windows of ``width`` words that occur in a document before ``doc``."""
        next_, link, length, least = self.next, self.link, self.length, self.least
        state = matched = 0
        out = []
        for at, word in enumerate(sequence):
            to = next_[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = next_[state].get(word)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= width:
                while length[link[state]] >= width:
                    state = link[state]
                matched = width
                if least[state] < doc:
                    out.append(at - width + 1)
        return out


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]


def screened(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Per row: word count, digest of the joined words, its class, and the text if it has a shared anchor."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                texts = part.column("text")
                w = Words(texts)
                anchors, at = w.anchors()
                hit = np.zeros(w.n, bool)
                hit[w.rows[at[in_table(shared.value, anchors)]]] = True
                digests = w.digests()
                kept = texts.take(pa.array(np.arange(w.n), mask=~hit))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(w.counts),
                        pa.array(digests, pa.binary()),
                        pa.array(class_of(digests)),
                        kept.cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "sha", "class", "text"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, sha binary, class long, text string"
    )


def window_rows(work: DataFrame, anchors: np.ndarray, windows: np.ndarray | None = None) -> DataFrame:
    """``(window, doc_id, class, start)`` of the windows with a shared anchor, and with a bit in ``windows``."""
    shared = work.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches):
        anchor_bits, window_bits = shared.value
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                w = Words(part.column("text"))
                found, at = w.anchors()
                at = at[in_table(anchor_bits, found)]
                hashes, first = words.window_hashes(w.hashes, w.rows, WINDOW)
                hashes = hashes[np.searchsorted(first, at)]
                if window_bits is not None:
                    some = in_table(window_bits, hashes)
                    hashes, at = hashes[some], at[some]
                rows = w.rows[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        part.column("doc_id").take(pa.array(rows)),
                        part.column("class").take(pa.array(rows)),
                        pa.array((at - w.first[rows]).astype(np.int32)),
                    ],
                    names=["window", "doc_id", "class", "start"],
                )

    return work.select("doc_id", "class", "text").mapInArrow(run, "window long, doc_id long, class long, start int")


def window_owners(work: DataFrame, anchors: np.ndarray) -> DataFrame:
    """``(key, owner)``: the windows that several documents have, and the smallest of these."""
    found = window_rows(work, anchors).select("window", "doc_id")
    owners = found.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    # Staged, so that both sides of the later join are shuffled and a very common window can be split.
    return staged(owners.where("owner < last").select(F.col("window").alias("key"), "owner"), "owners")


def packed_windows(found: DataFrame, owners: DataFrame, shards: int) -> DataFrame:
    """``(class, windows)``: of each shared window, in one number, its shard, whether it asks, and its start."""
    asks = (F.col("owner") != F.col("doc_id")).cast("long")
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards))
    one = F.shiftleft(F.shiftleft(shard, 1) + asks, 31) + F.col("start")
    owned = owners.withColumnRenamed("key", "window")
    joined = found.join(owned, "window").select("class", one.alias("one"))
    return joined.groupBy("class").agg(F.collect_list("one").alias("windows"))


def span_rows(placed: DataFrame) -> DataFrame:
    """Reference spans and asking spans of ``doc_id, class, text, windows``, by shard."""

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                w = Words(part.column("text"))
                docs, classes = part.column("doc_id").to_numpy(), part.column("class").to_numpy()
                lists = part.column("windows")
                out = []
                for row in range(part.num_rows):
                    # In order of shard, kind and start, runs of windows are runs of numbers.
                    for a, b in zip(*_runs(np.unique(lists[row].values.to_numpy())), strict=True):
                        key, start = divmod(int(a), 1 << 31)
                        at = w.first[row] + start
                        span = w.hashes[at : at + int(b - a) + WINDOW]
                        out.append((key // 2, bool(key % 2), docs[row], classes[row], start, len(span), span.tobytes()))
                names = ["shard", "asks", "doc_id", "class", "start", "n_words", "words"]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                )

    return placed.select("doc_id", "class", "text", "windows").mapInArrow(
        run, "shard long, asks boolean, doc_id long, class long, start int, n_words long, words binary"
    )


def repeated_spans(spans: DataFrame) -> DataFrame:
    """``(class, first, last)``: runs of windows that the shards' automata find in earlier documents."""
    load = spans.groupBy("shard").agg(F.sum(F.when(F.col("asks"), F.col("n_words"))).alias("asked"))
    load = load.where("asked is not null").select(
        "shard", F.ceil(F.col("asked") / F.lit(float(STREAM_WORDS))).cast("int").alias("copies")
    )
    dealt = spans.join(load, "shard")
    one = F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("copies").cast("long")).cast("int"))
    every = F.sequence(F.lit(0), F.col("copies") - 1)
    dealt = dealt.withColumn("copy", F.explode(F.when(F.col("asks"), one).otherwise(every))).drop("copies")

    def run(table):
        bounds = np.append(frames.group_starts(table, ["shard", "copy"]), table.num_rows)
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        docs, classes = table.column("doc_id").to_numpy(), table.column("class").to_numpy()
        starts = table.column("start").to_numpy()
        column = table.column("words").combine_chunks()
        out = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.arange(s, e)
            automaton = SuffixAutomaton()
            for row in own[~asks[s:e]]:
                automaton.add(np.frombuffer(column[row].as_buffer(), np.int64).tolist(), int(docs[row]))
            automaton.finish()
            for row in own[asks[s:e]]:
                sequence = np.frombuffer(column[row].as_buffer(), np.int64).tolist()
                found = automaton.repeats(sequence, int(docs[row]), WINDOW)
                if found:
                    a, b = _runs(np.array(found, np.int64))
                    out.append((np.full(len(a), classes[row]), a + starts[row], b + starts[row]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in cols], names=["class", "first", "last"]
        )

    return frames.by_group(dealt, ["shard", "copy"], run, "class long, first long, last long")


def without_spans(placed: DataFrame) -> DataFrame:
    """``class, n_removed, kept`` (a digest) of ``class, text, runs(first, last)``."""

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                w = Words(part.column("text"))
                edge = np.zeros(len(w.starts) + 1, np.int64)
                lists = part.column("runs")
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                inner = lists.flatten()
                base = w.first[rows]
                np.add.at(edge, base + inner.field("first").to_numpy(), 1)
                np.add.at(edge, base + inner.field("last").to_numpy() + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.bincount(w.rows[gone], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), pa.array(removed), pa.array(w.digests(~gone), pa.binary())],
                    names=["class", "n_removed", "kept"],
                )

    return placed.select("class", "text", "runs").mapInArrow(run, "class long, n_removed long, kept binary")


def _with_texts(work: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of ``work`` whose class is in the staged ``lists``, with these; other texts are not shuffled."""
    wanted = frames.small_join(work, lists.select("class"), "class", "left_semi", 16)
    return wanted.join(lists, "class")


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs(doc_id, text, ...)``.

    A word goes if a 13-word window over it also starts in a document with a smaller id;
    windows are those of the input. ``kept_sha256`` is the digest of the words that stay, joined
    by one space.

    A null or empty text and one of fewer than 13 words lose nothing. A row with a null id
    neither loses words nor makes others lose theirs. Rows that share an id do not make each
    other lose words. Other columns are ignored. An empty table gives an empty result.
    """
    table = bit_table(shared_anchors(docs))
    seen = staged(screened(docs, table), "screened")
    some = seen.where("doc_id is not null and n_words >= %d" % WINDOW)
    firsts = staged(some.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    later = some.select("doc_id", "sha").join(firsts.where("n > 1"), "sha").where("doc_id > first")
    later = staged(later.select("doc_id", "sha").distinct(), "later")
    work = some.where("text is not null")
    work = frames.small_join(work, later, ["doc_id", "sha"], "left_anti", 48).select("doc_id", "class", "text")
    owners = window_owners(work, table)
    n = owners.count()
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.ceil(n / SHARD_WORDS), min(spread, math.ceil(n / LEAST_SHARD_WORDS)))
    found = window_rows(work, table, bit_table(owners.select("key")))
    lists = staged(packed_windows(found, owners, shards), "lists")
    spans = staged(span_rows(_with_texts(work, lists)), "spans")
    runs = repeated_spans(spans).groupBy("class").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = staged(runs, "runs")
    cut = without_spans(_with_texts(work, runs)).dropDuplicates(["class"])
    gone = later.withColumn("later", F.lit(True))
    empty = F.lit(hashlib.sha256(b"").digest())
    n_removed = (
        F.when(F.col("later"), F.col("n_words"))
        .when(F.col("doc_id").isNull(), F.lit(0))
        .otherwise(F.coalesce("n_removed", F.lit(0)))
    )
    kept = (
        F.when(F.col("later"), empty)
        .when(F.col("doc_id").isNull(), F.col("sha"))
        .otherwise(F.coalesce("kept", "sha"))
    )
    return (
        seen.select("doc_id", "n_words", "sha", "class")
        .join(cut, "class", "left")
        .join(gone, ["doc_id", "sha"], "left")
        .select("doc_id", "n_words", n_removed.cast("long").alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256"))
    )
