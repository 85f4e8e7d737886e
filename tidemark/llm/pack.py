"""Best-fit packing of token pieces in rounds: local bins first, then underfull bins as items.

Every task packs what it holds by best fit, longest first. Bins with almost no room left are
done. The others become items of their used length and meet in fewer tasks, round after
round, where best fit puts whole bins together. A task never gets more than
``ITEMS_PER_TASK`` items on average, and a bin carries no tokens, only its pieces' places.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames
from tidemark.llm.frames import staged

ROOM = 2048
# Room that is not worth another round.
SLACK = 8
ITEMS_PER_TASK = 50_000
FIRST_ITEMS_PER_TASK = 4_096
FAN_IN = 8
MOST_ROUNDS = 6
# A round that saves a smaller share of its bins is the last.
LEAST_GAIN = 0.002
END_ID = 0
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """Byte-level BPE from a rank file; its ids are those of the same vocabulary's json file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
    )


@lru_cache(maxsize=2)
def json_tokenizer(ranks_path: str):
    """The json file of the same vocabulary, which lies beside its rank file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(Path(ranks_path).with_suffix(".json")))


def token_ids(text: str, ranks_path: str) -> np.ndarray:
    """Ids of a text. The rank library's splitting gives up on very long runs of white space; the json's does not."""
    encode = encoder(ranks_path)
    try:
        if SPECIAL in text:
            return np.array(encode.encode(text, allowed_special="all"), np.uint32)
        return encode.encode_to_numpy(text, disallowed_special=())
    except ValueError:
        return np.array(json_tokenizer(ranks_path).encode(text, add_special_tokens=False).ids, np.uint32)


def default_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def piece_bounds(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` ids: full pieces after a first one that may be shorter."""
    first = n % room or min(n, room)
    return [(0, first), *((start, room) for start in range(first, n, room))]


def pieces(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids and the end id."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for row, text in enumerate(batch.column("text")):
                all_ids = np.append(token_ids(text.as_py() or "", ranks_path), END_ID).astype("<u4")
                for k, (start, n) in enumerate(piece_bounds(len(all_ids))):
                    out.append((row, k, start, n, zlib.crc32(all_ids[start : start + n].tobytes())))
            if out:
                row, piece, start, n, crc = (np.array(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: best fit, longest first.

    Open bins are stacked by the room they have left; a bitmap of the non-empty stacks
    gives the tightest fit at once.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    mask, n = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            stack = stacks[left]
            own = stack.pop()
            if not stack:
                mask ^= 1 << left
        else:
            left, own = room, n
            n += 1
        bins[item], offsets[item] = own, room - left
        left -= size
        if left:
            stacks[left].append(own)
            mask |= 1 << left
    return bins, offsets, n


def pack_items(used: np.ndarray, lists: pa.ListArray, room: int = ROOM) -> tuple[np.ndarray, pa.ListArray]:
    """Pack items that hold pieces; used length and pieces of each bin."""
    bins, offsets, n = best_fit(used, room)
    order = np.lexsort((offsets, bins))
    lists = lists.take(pa.array(order))
    lengths = lists.value_lengths().to_numpy()
    inner = lists.flatten()
    moved = pa.array(inner.field("offset").to_numpy() + np.repeat(offsets[order], lengths))
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    inner = pa.StructArray.from_arrays([*(inner.field(f) for f in fields), moved], names=[*fields, "offset"])
    ends = np.append(0, np.cumsum(np.bincount(bins[order], weights=lengths, minlength=n))).astype(np.int32)
    total = np.bincount(bins, weights=used, minlength=n).astype(np.int64)
    return total, pa.ListArray.from_arrays(pa.array(ends), inner)


def packed_bins(items: DataFrame, room: int = ROOM) -> DataFrame:
    """One best-fit round inside each task over ``used, pieces``; adds ``done``."""

    def emit(tables):
        table = pa.concat_tables(tables).combine_chunks()
        lists = table.column("pieces").combine_chunks()
        total, out = pack_items(table.column("used").to_numpy(), lists, room)
        return pa.RecordBatch.from_arrays(
            [pa.array(total), out, pa.array(total >= room - SLACK)], names=["used", "pieces", "done"]
        )

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
            if rows >= 2 * ITEMS_PER_TASK:
                yield emit(held)
                held, rows = [], 0
        if held:
            yield emit(held)

    return items.select("used", "pieces").mapInArrow(run, f"used long, pieces array<{PIECE}>, done boolean")


def pack_documents(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Places of all pieces of ``docs(doc_id, text, ...)`` in sequences of at most 2048 tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document is its
    ids and the end id 0; only longer ones are cut, in full pieces after a first one that may
    be shorter. A null or empty text is the end id alone. The special string of the vocabulary
    is its special id, as the library has it by default. A text that the rank library cannot
    split, as one with a million white-space characters in a row, gets the same ids from the
    vocabulary's json file. Repeated rows and null ids are packed
    like others. Other columns are ignored. An empty table gives an empty result.
    """
    # Staged, so that no task holds a tokenizing and a packing worker at once.
    cut = staged(pieces(docs, ranks_path or default_ranks()), "pieces")
    one = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    items = cut.select(F.col("length").alias("used"), F.array(one).alias("pieces"))
    bins = staged(packed_bins(items), "bins")
    done, left = bins.where("done"), bins.where("not done")
    n = left.count()
    tasks = math.ceil(n / FIRST_ITEMS_PER_TASK) * FAN_IN
    for round_ in range(MOST_ROUNDS):
        if n < 2:
            break
        tasks = max(1, math.ceil(n / ITEMS_PER_TASK), tasks // FAN_IN)
        key = F.xxhash64(F.lit(round_), F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["piece"], "used")
        bins = staged(packed_bins(left.repartition(tasks, key)), "bins")
        done, left = done.union(bins.where("done")), bins.where("not done")
        before, n, full = n, left.count(), bins.where("done").count()
        if tasks == 1 or n + full > before * (1 - LEAST_GAIN) and tasks <= math.ceil(n / ITEMS_PER_TASK):
            break
    numbered = done.union(left).select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    return numbered.select("sequence_id", F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset"
    )
