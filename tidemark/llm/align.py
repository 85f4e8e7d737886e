"""Alignment of two tokenizers' tokens over a corpus, with a fast path for equal tokens.

A document's two token sequences spell the same bytes, and each offset at which a token of both
ends closes a group. Most groups are one token of each side with the same bytes. For these an
array from the first vocabulary's ids to the other's, computed once from the vocabularies, says
the partner, so a task counts them in one vector as long as the vocabulary. The last tokens of
other groups have different bytes (or are twins of the array's entry, see :class:`Vocabularies`);
only these pairs are shuffled, after each chunk of texts has counted its own.

Texts are read and encoded once. A chunk keeps, for each document, numbers into the chunk's
table of pairs, and gets the corpus-wide counts of that table back.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames
from tidemark.llm.frames import staged

# Bytes of text in a chunk, whose pairs are counted together; one text at least.
CHUNK_BYTES = 1 << 20
SPACE_MARK = "▁"

ENCODED = {
    "doc_id": pa.list_(pa.int64()),
    "n_a": pa.list_(pa.int64()),
    "n_b": pa.list_(pa.int64()),
    "n_groups": pa.list_(pa.int64()),
    "groups_sha256": pa.list_(pa.string()),
    # Tokens of groups on the fast path: distinct ids of each document and how often they occur.
    "same_id": pa.list_(pa.int32()),
    "same_n": pa.list_(pa.int32()),
    "same_in_doc": pa.list_(pa.int32()),
    # Other groups: places in the chunk's table of pairs.
    "pair_at": pa.list_(pa.int32()),
    "pair_n": pa.list_(pa.int32()),
    "pair_in_doc": pa.list_(pa.int32()),
    "pair_a": pa.list_(pa.int32()),
    "pair_b": pa.list_(pa.int32()),
    "pair_total": pa.list_(pa.int64()),
    # One row of a task: the fast path's counts.
    "vector_id": pa.list_(pa.int32()),
    "vector_n": pa.list_(pa.int64()),
}
SPARK_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
ENCODED_DDL = ", ".join(f"{k} array<{SPARK_TYPES[t.value_type]}>" for k, t in ENCODED.items())
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


def ranks_beside(json_path: str):
    """The rank file of the same vocabulary as an encoder, if it lies beside the json: same ids, three times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    path = Path(json_path).with_suffix(".tiktoken")
    if not path.exists():
        return None
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Vocabularies:
    """Both encoders, the bytes of their ids, and ``same``: the other id with an id's bytes, or -1.

    Where two of the second vocabulary's ids have the same bytes (a byte and the character it is),
    ``same`` has the larger, which is the character's; a group with the other takes the slow path.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.ranked = ranks_beside(a_path)
        # Code points by which both libraries of the first vocabulary were seen to split alike, or not.
        self.alike, self.unlike = set(map(chr, range(128))), set()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        decode = byte_characters()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(decode[c] for c in self.a.id_to_token(k)) for k in range(size)]
        self.b_bytes = [self._b_bytes(k) for k in range(self.b.get_piece_size())]
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        ids = {t: k for k, t in enumerate(self.b_bytes) if not (self.b.is_control(k) or self.b.is_unknown(k))}
        self.same = np.array([ids.get(t, -1) for t in self.a_bytes], np.int32)
        # Ids as text with what may follow: a comma, a bar, a semicolon, nothing.
        most = max(size, len(self.b_bytes))
        self.written = [f"{k}{end}" for end in (",", "|", ";", "") for k in range(most)]
        self.most = most

    def _b_bytes(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(k) else piece.replace(SPACE_MARK, " ").encode()

    def _splits_alike(self, text: str) -> bool:
        """Whether the rank library may stand in for the json's: each code point is tried once in both."""
        if text.isascii():
            return True
        met = set(text)
        for c in met - self.alike - self.unlike:
            tried = f"a{c}a {c}1{c}1 {c}!{c}! {c} {c}\n{c}{c}"
            same = self.ranked.encode_ordinary(tried) == self.a.encode(tried, add_special_tokens=False).ids
            (self.alike if same else self.unlike).add(c)
        return self.unlike.isdisjoint(met)

    def _a_ids(self, text: str) -> np.ndarray:
        if self.ranked is not None and self._splits_alike(text):
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # runs of white space too long for it
                pass
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none for empty texts and where the bytes differ."""
        none = np.zeros(0, np.int64)
        a_ids = [self._a_ids(f" {t}") for t in texts]
        b_ids = self.b.encode(texts, num_threads=1)
        out_a, out_b = [], []
        for text, a, b in zip(texts, a_ids, b_ids, strict=True):
            want = f" {text}".encode()
            fits = (
                text != ""
                and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want
                and b"".join(map(self.b_bytes.__getitem__, b)) == want
            )
            out_a.append(a if fits else none)
            out_b.append(np.array(b, np.int64) if fits else none)
        return out_a, out_b


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


@dataclass(frozen=True)
class Groups:
    """Groups of one text: the place of each one's last token on both sides."""

    a_last: np.ndarray
    b_last: np.ndarray

    @property
    def single(self) -> np.ndarray:
        """Groups of one token on each side."""
        return (np.diff(self.a_last, prepend=-1) == 1) & (np.diff(self.b_last, prepend=-1) == 1)


def groups_of(a: np.ndarray, b: np.ndarray, v: Vocabularies) -> Groups:
    _, at_a, at_b = np.intersect1d(
        np.cumsum(v.a_length[a]), np.cumsum(v.b_length[b]), assume_unique=True, return_indices=True
    )
    return Groups(at_a, at_b)


def written(a: np.ndarray, b: np.ndarray, groups: Groups, v: Vocabularies) -> str:
    """``a1,a2|b1;a3|b2,b3``: all ids in order, groups apart."""
    n_a = np.diff(groups.a_last, prepend=-1)
    n_b = np.diff(groups.b_last, prepend=-1)
    # Tokens of a group follow those of all earlier groups of both sides.
    before_a = np.repeat(np.cumsum(n_b) - n_b, n_a)
    before_b = np.repeat(np.cumsum(n_a), n_b)
    codes = np.empty(len(a) + len(b), np.int64)
    a_code, b_code = a.copy(), b.copy()
    a_code[groups.a_last] += v.most
    b_code[groups.b_last] += 2 * v.most
    if len(b_code):
        b_code[-1] += v.most
    codes[np.arange(len(a)) + before_a] = a_code
    codes[np.arange(len(b)) + before_b] = b_code
    return "".join(map(v.written.__getitem__, codes.tolist()))


def _counted(values: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each document, their counts, and the number of them in each document."""
    codes, n = np.unique(doc * span + values, return_counts=True)
    return codes % span, n, codes // span


def _chunk_columns(ids: pa.Array, texts: list[str], v: Vocabularies, vector: np.ndarray) -> dict[str, np.ndarray]:
    a_ids, b_ids = v.encode(texts)
    docs = len(texts)
    n_groups, shas = np.zeros(docs, np.int64), []
    last_a, last_b, single, owner = [], [], [], []
    for k, (a, b) in enumerate(zip(a_ids, b_ids, strict=True)):
        groups = groups_of(a, b, v)
        n_groups[k] = len(groups.a_last)
        shas.append(hashlib.sha256(written(a, b, groups, v).encode()).hexdigest() if len(a) else "")
        last_a.append(a[groups.a_last])
        last_b.append(b[groups.b_last])
        single.append(groups.single)
        owner.append(np.full(len(groups.a_last), k, np.int64))
    a, b, alone, doc = (np.concatenate(x) for x in (last_a, last_b, single, owner))
    fast = alone & (v.same[a] == b)
    vector += np.bincount(a[fast], minlength=len(vector))
    same_id, same_n, same_doc = _counted(a[fast], doc[fast], len(v.a_bytes))
    span = len(v.b_bytes)
    pairs, at = np.unique(a[~fast] * span + b[~fast], return_inverse=True)
    pair_at, pair_n, pair_doc = _counted(at, doc[~fast], max(len(pairs), 1))
    return {
        "doc_id": ids,
        "n_a": np.array([len(x) for x in a_ids], np.int64),
        "n_b": np.array([len(x) for x in b_ids], np.int64),
        "n_groups": n_groups,
        "groups_sha256": shas,
        "same_id": same_id,
        "same_n": same_n,
        "same_in_doc": np.bincount(same_doc, minlength=docs),
        "pair_at": pair_at,
        "pair_n": pair_n,
        "pair_in_doc": np.bincount(pair_doc, minlength=docs),
        "pair_a": pairs // span,
        "pair_b": pairs % span,
        "pair_total": np.bincount(at, minlength=len(pairs)),
    }


def _row(columns: dict) -> pa.RecordBatch:
    arrays = []
    for name, kind in ENCODED.items():
        if name not in columns:
            arrays.append(pa.nulls(1, kind))
            continue
        values = columns[name]
        flat = values.cast(kind.value_type) if isinstance(values, pa.Array) else pa.array(values, kind.value_type)
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
    return pa.RecordBatch.from_arrays(arrays, names=list(ENCODED))


def encode_chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of texts, and one with the fast path's vector for each task."""

    def run(batches):
        v = vocabularies(a_path, b_path)
        vector = np.zeros(len(v.a_bytes), np.int64)
        for batch in batches:
            for part in frames.text_slices(batch, "text", chunk_bytes):
                texts = part.column("text").fill_null("").to_pylist()
                yield _row(_chunk_columns(part.column("doc_id"), texts, v, vector))
        met = np.flatnonzero(vector)
        yield _row({"vector_id": met, "vector_n": vector[met]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED_DDL)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``a, b, total`` of all pairs off the fast path."""
    pairs = chunks.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_total")).alias("p")).select("p.*")
    return pairs.groupBy(F.col("pair_a").alias("a"), F.col("pair_b").alias("b")).agg(F.sum("pair_total").alias("total"))


def same_counts(chunks: DataFrame) -> DataFrame:
    """``a, total`` of the fast path: the tasks' vectors added."""
    cells = chunks.where("vector_id is not null")
    cells = cells.select(F.explode(F.arrays_zip("vector_id", "vector_n")).alias("v")).select("v.*")
    return cells.groupBy(F.col("vector_id").alias("a")).agg(F.sum("vector_n").alias("total"))


def link_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``a, b, total`` for every pair of ids that is linked somewhere in the corpus."""
    a_path, b_path = _paths(a_path, b_path)
    chunks = staged(encode_chunks(docs, a_path, b_path), "aligned")
    same = vocabularies(a_path, b_path).same
    partners = pa.table({"a": pa.array(np.arange(len(same)), pa.int32()), "b": pa.array(same, pa.int32())})
    fast = same_counts(chunks).join(docs.sparkSession.createDataFrame(partners), "a")
    return pair_counts(chunks).unionByName(fast.select("a", "b", "total"))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    a, b = default_paths()
    return a_path or a, b_path or b


def aligned_documents(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of documents.

    A link is a pair of tokens that end at the same byte, so every group has one, between its last
    tokens. Its count is that of its two ids in the whole corpus, and it is best if no other pair
    with its second id has a larger one.

    Texts that are null, empty, or not spelled by the tokens of both sides have zeros and an empty
    digest. Rows with null or repeated ids are counted and returned like others. Texts of any
    length are encoded whole. Other columns are ignored; without rows the result is empty.
    """
    a_path, b_path = _paths(a_path, b_path)
    v = vocabularies(a_path, b_path)
    chunks = encode_chunks(docs, a_path, b_path, chunk_bytes)
    chunks = staged(chunks.withColumn("chunk", F.monotonically_increasing_id()), "aligned")
    # Both are as long as a vocabulary at most.
    same = np.zeros(len(v.a_bytes), np.int64)
    for part in same_counts(chunks).toArrow().to_batches():
        same[part.column("a").to_numpy()] = part.column("total").to_numpy()
    counts = staged(pair_counts(chunks), "pair-counts")
    best = np.zeros(len(v.b_bytes), np.int64)
    for part in counts.groupBy("b").agg(F.max("total").alias("total")).toArrow().to_batches():
        best[part.column("b").to_numpy()] = part.column("total").to_numpy()
    has = v.same >= 0
    np.maximum.at(best, v.same[has], same[has])

    table = F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("at", "p")
    asked = chunks.where("size(pair_a) > 0").select("chunk", table)
    asked = asked.select("chunk", "at", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    told = (
        asked.join(counts, ["a", "b"])
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list(F.struct("at", "total"))).getField("total").alias("totals"))
    )
    kept = [name for name in ENCODED if name not in ("pair_a", "pair_total", "vector_id", "vector_n")]
    rows = chunks.where("doc_id is not null").join(told, "chunk", "left").select(*kept, "totals")
    partner = v.same

    def settle(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield _settled(batch.slice(k, 1), same, partner, best)

    return rows.mapInArrow(settle, RESULT)


def _settled(row: pa.RecordBatch, same: np.ndarray, partner: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of one chunk with the counts of their links."""

    def values(name):
        return row.column(name).flatten()

    def numbers(name):
        return values(name).to_numpy(zero_copy_only=False).astype(np.int64)

    docs = len(values("doc_id"))
    count_sum, n_best = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    pair_total = numbers("totals")
    for kind, total, top in (
        ("same", same, best[partner]),
        ("pair", pair_total, best[numbers("pair_b")]),
    ):
        at = numbers("same_id" if kind == "same" else "pair_at")
        n, doc = numbers(f"{kind}_n"), np.repeat(np.arange(docs), numbers(f"{kind}_in_doc"))
        np.add.at(count_sum, doc, n * total[at])
        np.add.at(n_best, doc, np.where(total[at] == top[at], n, 0))
    n_groups = values("n_groups")
    return pa.RecordBatch.from_arrays(
        [
            values("doc_id"),
            values("n_a"),
            values("n_b"),
            n_groups,
            n_groups,
            pa.array(n_best),
            pa.array(count_sum),
            values("groups_sha256"),
        ],
        names=[field.split()[0] for field in RESULT.split(", ")],
    )
