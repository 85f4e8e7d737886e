"""Byte-pair training over an inverted index from pairs to words.

The distinct words of a corpus are written once as postings: for each pair of neighbouring
symbols the words that hold it, in ranges of pairs, so that a pair's postings are a few row
groups. A merge reads the postings of its own pair only. It spells the words found there with the
merges made so far, joins the pair, and hands out two things: what changed in the counts of pairs,
and postings of the pairs that are new in a word. Postings of pairs that a word no longer has stay where
they are; spelling shows that they are void.

Counts are never taken anew. The driver holds the most frequent pairs, a bounded number, and a
bound for the counts of all others. Merges lower the counts of old pairs and make new ones, whose
counts are complete in the changes, so the bound stays true until the last pair above it is
merged. Only then the full table of counts, brought up to date by all changes, is ranked again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import corpus
from tidemark.session import stage_table
from tidemark.sources.corpora import SEPARATOR

# Pairs the driver holds at most.
HELD_PAIRS = 2048
# Up to so many merges are spelled by replacing text, one after the other.
FEW_MERGES = 64
Pair = tuple[str, str]

CHANGES = pa.schema(
    [
        ("left", pa.string()),
        ("right", pa.string()),
        # A posting has a word and its frequency; a change of a count has ``n``.
        ("word", pa.string()),
        ("freq", pa.int64()),
        ("n", pa.int64()),
        # Symbols saved by a merge, in a row with its number; void postings met, with none.
        ("merge", pa.int32()),
        ("saved", pa.int64()),
    ]
)
CHANGES_DDL = "left string, right string, word string, freq long, n long, merge int, saved long"


@dataclass(frozen=True)
class Pass:
    """What one pass merged and read: postings of its pairs, and those of words that hold them."""

    merges: int
    postings_read: int
    words_touched: int


@dataclass
class Merges:
    """Result of training: merges in order, the history of each step, and the passes made."""

    total_before: int
    pairs: list[Pair] = field(default_factory=list)
    history: list[tuple[int, str, str, int, int]] = field(default_factory=list)
    passes: list[Pass] = field(default_factory=list)
    rankings: int = 1

    def vocabulary(self, special: tuple[str, ...] = (SEPARATOR,)) -> list[bytes]:
        """256 bytes, then the special tokens, then the merges."""
        base = [bytes([i]) for i in range(256)]
        base += [token.encode("utf-8") for token in special]
        return base + [bytes.fromhex(a + b) for a, b in self.pairs]


def join_pair(symbols: list[str], left: str, right: str) -> list[str]:
    """Each (left, right) joined, from the left and without overlap."""
    out, at, last = [], 0, len(symbols) - 1
    while at <= last:
        if at < last and symbols[at] == left and symbols[at + 1] == right:
            out.append(left + right)
            at += 2
        else:
            out.append(symbols[at])
            at += 1
    return out


def fenced_merge(left: str, right: str) -> tuple[str, str]:
    """A pair in a fenced word, and what it becomes: replacing joins from the left and without overlap."""
    return f"|{left}||{right}|", f"|{left}{right}|"


class Speller:
    """Spells words with merges in the order in which they were made."""

    def __init__(self, merges: Iterable[Pair]):
        self.steps: dict[Pair, list[int]] = {}
        self.texts: list[tuple[str, str]] = []
        for step, pair in enumerate(merges):
            self.steps.setdefault(pair, []).append(step)
            self.texts.append(fenced_merge(*pair))

    def fenced(self, word: str) -> str:
        """The fenced word after all merges."""
        if len(self.texts) > FEW_MERGES:
            return "|" + "||".join(self.spell(word)) + "|"
        for apart, joined in self.texts:
            if apart in word:
                word = word.replace(apart, joined)
        return word

    def spell(self, word: str) -> list[str]:
        """The symbols of a fenced word of single bytes."""
        if len(self.texts) <= FEW_MERGES:
            return self.fenced(word)[1:-1].split("||")
        symbols = word[1:-1].split("||")
        after = 0
        while len(symbols) > 1:
            # The next merge in order that finds its pair; a pair may be merged again later.
            best = None
            for pair in zip(symbols, symbols[1:], strict=False):
                steps = self.steps.get(pair)
                if steps is not None:
                    k = bisect_left(steps, after)
                    if k < len(steps) and (best is None or steps[k] < best[0]):
                        best = (steps[k], pair)
            if best is None:
                break
            after = best[0] + 1
            symbols = join_pair(symbols, *best[1])
        return symbols


def independent_head(ranked: Sequence[tuple[str, str, int]], floor: int, symbols: set[str]) -> list[tuple[str, str, int]]:
    """The head of the ranking that one pass may merge, still in exact order.

    A merge of (a, b) only changes pairs that hold a or b, and a new pair with the joined symbol
    is at most as frequent as the pair of its parts that was in the ranking. So the next pair
    stays the true maximum as long as no pair ranked level with it or above shares a symbol
    with the merges before it. Pairs that are not ranked have counts of ``floor`` at most. A merge
    whose joined symbol was there before is the last one: other pairs may have it, too.
    """
    taken: list[tuple[str, str, int]] = []
    used: set[str] = set()
    for position, (a, b, n) in enumerate(ranked):
        if n <= floor:
            break
        if taken:
            level = [p for p in ranked[position:] if p[2] == n]
            if any(x in used or y in used for x, y, _ in level):
                break
        taken.append((a, b, n))
        used |= {a, b}
        if a == b or a + b in symbols:
            break
    return taken


def _postings(words: DataFrame) -> DataFrame:
    """Words by each pair they hold, in ranges, so that one pair's words lie together."""
    found = F.array_distinct(F.regexp_extract_all(F.col("word"), F.lit(corpus.NEIGHBOURS), 1))
    pairs = words.select("word", "freq", F.explode(found).alias("pair"))
    sides = F.split("pair", r"\|\|")
    rows = pairs.select(sides[0].alias("left"), sides[1].alias("right"), "word", "freq")
    return rows.repartitionByRange("left", "right", "word").sortWithinPartitions("left", "right")


def _merge(batches, made: list[Pair], batch_pairs: list[Pair]):
    """Changes that merging the pairs makes to the words of their postings; a word may come more than once."""
    speller, met = Speller(made), set()
    texts = [fenced_merge(*pair) for pair in batch_pairs]
    changes, saved, read, void = {}, Counter(), 0, 0
    for batch in batches:
        posted: list[tuple] = []
        for word, freq in zip(batch.column("word").to_pylist(), batch.column("freq").to_pylist(), strict=True):
            if word in met:
                continue
            met.add(word)
            read += 1
            spelled = before = speller.fenced(word)
            for step, (apart, joined) in enumerate(texts):
                # A pair that only an earlier merge of this batch made is not in its batch.
                if apart in spelled:
                    shorter = spelled.replace(apart, joined)
                    # A merge takes one fence of two bars.
                    saved[step] += (len(spelled) - len(shorter)) // 2 * freq
                    spelled = shorter
            if spelled is before:
                void += 1
                continue
            old, new = before[1:-1].split("||"), spelled[1:-1].split("||")
            # What both ends share does not change.
            head, most = 0, min(len(old), len(new))
            while head < most and old[head] == new[head]:
                head += 1
            tail = 0
            while tail < most - head and old[-1 - tail] == new[-1 - tail]:
                tail += 1
            first, last = max(head - 1, 0), max(tail - 1, 0)
            gone = list(zip(old[first : len(old) - last], old[first + 1 : len(old) - last], strict=False))
            come = list(zip(new[first : len(new) - last], new[first + 1 : len(new) - last], strict=False))
            for pair in gone:
                changes[pair] = changes.get(pair, 0) - freq
            for pair in come:
                changes[pair] = changes.get(pair, 0) + freq
            fresh = set(come).difference(gone)
            if fresh:
                # A word has postings of the pairs it held before anywhere.
                posted += [(*pair, word, freq) for pair in fresh.difference(zip(old, old[1:], strict=False))]
        if posted:
            yield _columns(len(posted), **dict(zip(("left", "right", "word", "freq"), zip(*posted, strict=True), strict=True)))
    moved = [(a, b, n) for (a, b), n in changes.items() if n]
    if moved:
        yield _columns(len(moved), **dict(zip(("left", "right", "n"), zip(*moved, strict=True), strict=True)))
    if saved:
        yield _columns(len(saved), merge=list(saved), saved=list(saved.values()))
    yield _columns(1, n=[read], saved=[void])


def _columns(rows: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in CHANGES]
    return pa.RecordBatch.from_arrays(arrays, schema=CHANGES)


class _Counts:
    """Counts of pairs: a written table, changes since, and the most frequent ones held here."""

    def __init__(self, table: DataFrame, held: int):
        self.table, self.held, self.changes = table, held, []
        self.rank()

    def rank(self) -> None:
        """Bring the table up to date and hold its most frequent pairs."""
        if self.changes:
            rows = self.table
            for change in self.changes:
                rows = rows.unionByName(change)
            rows = rows.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0")
            self.table, self.changes = stage_table(rows, "pair-counts"), []
        best = corpus.best_pairs(self.table, self.held + 1).collect()
        # All pairs that are not held have counts up to the floor.
        self.floor = best[self.held]["n"] if len(best) > self.held else 0
        self.best = {(r["left"], r["right"]): r["n"] for r in best if r["n"] > self.floor}

    def ranked(self) -> list[tuple[str, str, int]]:
        return [(a, b, n) for n, a, b in sorted(((n, a, b) for (a, b), n in self.best.items()), reverse=True)]

    def change(self, changes: DataFrame, merged: list[Pair]) -> list:
        """Apply a pass's changes; gives the rows that say what the merges saved.

        Of pairs that are not held, only new ones can rise above the floor, and of these the
        most frequent are fetched; the floor rises to the others.
        """
        touched = {s for pair in merged for s in pair}
        mine = [f"{a}|{b}" for a, b in self.best if a in touched or b in touched]
        held = F.concat_ws("|", "left", "right").isin(mine)
        most = len(mine) + len(merged) + 1 + self.held
        summed = (
            changes.where("word is null")
            .groupBy("left", "right", "merge")
            .agg(F.sum("n").alias("n"), F.sum("saved").alias("saved"))
            .withColumn("wanted", F.col("left").isNull() | held)
            .where(F.col("wanted") | (F.col("n") > self.floor))
            .orderBy(F.desc("wanted"), F.desc("n"))
            .limit(most)
        )
        rows, notes = summed.collect(), []
        if len(rows) == most:
            self.floor = max(self.floor, rows[-1]["n"])
        for r in rows:
            if r["left"] is None:
                notes.append(r)
            else:
                key = (r["left"], r["right"])
                self.best[key] = self.best.get(key, 0) + r["n"]
        self.changes.append(changes.where("left is not null and n is not null").select("left", "right", "n"))
        if len(self.best) > 2 * self.held:
            self.floor = max(self.floor, self.ranked()[self.held][2])
        self.best = {k: n for k, n in self.best.items() if n > self.floor}
        return notes


def train_merges(counts: DataFrame, merges: int, held: int = HELD_PAIRS) -> Merges:
    """Greedy byte-pair training on distinct pre-tokens ``counts(token, freq)``.

    Each step merges the most frequent pair, of equally frequent ones the lexicographically
    greatest in byte order. ``held`` bounds what the driver holds. The number of a pass's rows
    depends on the words that hold its pairs, not on all words.
    """
    counts = stage_table(counts, "pretokens")
    words = stage_table(corpus.words_table(counts, counts.count() // corpus.WORDS_PER_PART), "words")
    out = Merges(total_before=corpus.token_total(words).first()["total"])
    base = stage_table(_postings(words), "postings")
    known = _Counts(stage_table(corpus.pair_counts(words), "pair-counts"), held)
    bytes_of = {f"{b:02X}" for b in range(256)}
    # In which passes each joined symbol appeared: a pair's postings are where its symbols did.
    born: dict[str, list[int]] = {}
    written: list[DataFrame] = []
    total = out.total_before
    while len(out.pairs) < merges:
        symbols = bytes_of | born.keys()
        batch = independent_head(known.ranked(), known.floor, symbols)[: merges - len(out.pairs)]
        if not batch:
            if known.floor == 0:
                break
            known.rank()
            out.rankings += 1
            continue
        pairs = [(a, b) for a, b, _ in batch]
        made = list(out.pairs)
        found = _found(base, written, born, pairs)
        changes = found.mapInArrow(lambda rows, m=made, p=pairs: _merge(rows, m, p), CHANGES_DDL)
        # Kept on the executors. A lost part is computed again from the written postings, through
        # the passes that made its symbols, which are no more than a symbol has bytes.
        changes = changes.persist(StorageLevel.MEMORY_AND_DISK)
        notes = known.change(changes, pairs)
        saved = {r["merge"]: r["saved"] for r in notes if r["merge"] is not None}
        seen = next((r for r in notes if r["merge"] is None), None)
        for step, (a, b, n) in enumerate(batch):
            total -= saved.get(step, 0)
            out.history.append((len(out.pairs), a, b, n, total))
            out.pairs.append((a, b))
            passes = born.setdefault(a + b, [])
            if not passes or passes[-1] != len(written):
                passes.append(len(written))
        written.append(changes)
        read, void = (seen["n"], seen["saved"]) if seen else (0, 0)
        out.passes.append(Pass(len(batch), read, read - void))
        if any(a + b in symbols for a, b in pairs):
            # Pairs of an old symbol became more frequent; their counts are in the table only.
            known.rank()
            out.rankings += 1
    for changes in written:
        changes.unpersist()
    return out


def _found(base: DataFrame, written: list[DataFrame], born: dict[str, list[int]], pairs: list[Pair]) -> DataFrame:
    """The words among the postings of the pairs, read where such postings can be."""
    places: dict[int | None, list[Pair]] = {}
    for a, b in pairs:
        made_in = {k for s in (a, b) for k in born.get(s, ())}
        # Words of the corpus hold a pair of single bytes from the start.
        if len(a) == len(b) == 2:
            places.setdefault(None, []).append((a, b))
        for k in made_in:
            places.setdefault(k, []).append((a, b))
    rows = None
    for place, wanted in places.items():
        table = base if place is None else written[place].where("word is not null")
        match = None
        for a, b in wanted:
            one = (F.col("left") == a) & (F.col("right") == b)
            match = one if match is None else match | one
        part = table.where(match).select("word", "freq")
        rows = part if rows is None else rows.unionByName(part)
    # Equal words meet in one task, which drops repeats; all cores take part in a small table, too.
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "word")


def history_frame(spark, result: Merges) -> DataFrame:
    """The merge history as a table (one short row per merge)."""
    rows = [
        (step, a, b, n, total, result.total_before / total if total else None)
        for step, a, b, n, total in result.history
    ]
    return spark.createDataFrame(
        rows, "step int, left string, right string, n long, total long, ratio double"
    )
