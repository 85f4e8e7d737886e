"""Embedding tables and exact cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import textfn

# Question vectors of one block; up to one block of them goes to the tasks as it is.
QUERIES_PER_PASS = 256
# Corpus rows and questions of one block, about, where both sides are dealt in blocks, and corpus rows of a
# small corpus. A vector is copied once for each block of the other side, so blocks are large.
CORPUS_BLOCK = 16384
QUESTION_BLOCK = 16384
LEAST_BLOCK = 256
# Corpus rows of a block whose k best give a score that all its k best reach.
FIRST_ROWS = 2048
# Scores equal to this many decimals are a tie, broken by id.
SCORE_DECIMALS = 6


class DimensionMismatch(ValueError):
    """Vectors of different lengths."""


class Embedder(Protocol):
    """Texts to vectors. ``batch`` is for documents, ``query`` for questions."""

    dim: int
    model_id: str

    def batch(self, text: Column) -> Column: ...

    def query(self, text: Column) -> Column: ...


class HashEmbedder:
    """Content hash as a vector: deterministic, no model, pure expressions."""

    def __init__(self, dim: int = 8) -> None:
        if dim <= 0:
            raise ValueError(f"dim must be positive, got {dim}")
        self.dim = dim
        self.model_id = f"stub-sha256-{dim}"

    def batch(self, text: Column) -> Column:
        return textfn.hash_vector(text, self.dim)

    def query(self, text: Column) -> Column:
        return textfn.hash_vector(F.concat(F.lit(textfn.QUERY_PREFIX), text), self.dim)


class ModelEmbedder:
    """A user's model behind an iterator Pandas UDF, loaded once per Python worker."""

    def __init__(
        self,
        dim: int,
        model_id: str,
        load: Callable[[], Callable[[Sequence[str]], np.ndarray]],
        query_prefix: str = textfn.QUERY_PREFIX,
    ) -> None:
        self.dim, self.model_id, self._prefix = dim, model_id, query_prefix
        import pandas as pd

        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in batches:
                vectors = np.asarray(encode(texts.tolist()), dtype="float32").reshape(-1, dim)
                yield pd.Series(list(vectors))

        embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        self._udf = F.pandas_udf(embed, "array<float>")

    def batch(self, text: Column) -> Column:
        return self._udf(text)

    def query(self, text: Column) -> Column:
        return self._udf(F.concat(F.lit(self._prefix), text))


def index_rows(
    df: DataFrame, vector: str, dim: int, vector_id: str = "id"
) -> DataFrame:
    """Rows of a vector index: id and unit vector; another length is an error."""
    v = F.col(vector)
    checked = F.when(F.size(v) == dim, v).otherwise(
        F.raise_error(F.concat(F.lit("vector length "), F.size(v).cast("string")))
    )
    return df.select(
        F.col(vector_id).alias("id"), textfn.l2_normalise(checked).alias("vector")
    )


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Equal-length vectors as unit rows in double precision."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype("float64")
    rows = len(column)
    matrix = flat.reshape(rows, -1) if rows and len(flat) % rows == 0 else np.zeros((0, 0))
    if len(matrix) != rows or (width is not None and matrix.shape[1] != width):
        raise DimensionMismatch(f"corpus {len(flat) / max(rows, 1):g}, query {width}")
    return _unit(matrix)


def _best(scores: np.ndarray, ids: pa.Array | pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and question of exactly the k best rows of each question: by score, ties by the smaller id."""
    place = np.empty(len(scores), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(scores))
    if len(scores) <= k:
        rows, cols = np.indices(scores.shape)
        return rows.ravel(), cols.ravel()
    rows, cols = [], []
    for q in range(scores.shape[1]):
        s = scores[:, q]
        edge = np.partition(s, len(s) - k)[len(s) - k]
        above, level = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
        level = level[np.argsort(place[level])][: k - len(above)]
        rows.append(np.append(above, level))
        cols.append(np.full(k, q))
    return np.concatenate(rows), np.concatenate(cols)


def _score_batches(queries: np.ndarray, keys: list, k: int, key_type):
    unit = _unit(queries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = _matrix(batch.column("vector"), unit.shape[1])
            scores = np.round(matrix @ unit.T, SCORE_DECIMALS) + 0.0
            r, c = _best(scores, batch.column("id"), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in c], type=key_type),
                    batch.column("id").take(pa.array(r)),
                    pa.array(scores[r, c]),
                ],
                names=["query_id", "id", "score"],
            )

    return score


def _best_of_block(part: np.ndarray, asked: np.ndarray, ids: pa.Array | pa.ChunkedArray, k: int):
    """Row, question and score of exactly the k best of unit rows ``part`` for each of the unit rows ``asked``.

    Single precision finds the rows that can be among the k best, by what k of the first rows reach; their
    scores are then taken in double precision. A few questions at a time.
    """
    place = np.empty(len(part), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(part))
    coarse, coarse_asked = part.astype(np.float32).T.copy(), asked.astype(np.float32)
    # Single precision, and rounding of the scores compared.
    slack = (part.shape[1] + 4) * 2.0**-22 + 2 * 10.0**-SCORE_DECIMALS
    first, found = min(len(part), max(FIRST_ROWS, k)), []
    for at in range(0, len(asked), QUERIES_PER_PASS):
        some = asked[at : at + QUERIES_PER_PASS]
        scores = coarse_asked[at : at + QUERIES_PER_PASS] @ coarse
        edge = np.partition(scores[:, :first], max(first - k, 0), axis=1)[:, max(first - k, 0)]
        q, r = np.divmod(np.flatnonzero(scores >= (edge - np.float32(slack))[:, None]), len(part))
        if len(q) > 8 * (k + 64) * len(some):
            # Many rows score alike: all scores in double precision, question by question.
            exact = np.round(part @ some.T, SCORE_DECIMALS) + 0.0
            r, q = _best(exact, ids, k)
            found.append((r, q + at, exact[r, q]))
            continue
        exact = np.round(np.einsum("ij,ij->i", part[r], some[q]), SCORE_DECIMALS) + 0.0
        order = np.lexsort((place[r], -exact, q))
        q = q[order]
        among = np.arange(len(q)) - np.searchsorted(q, q) < k
        kept = order[among]
        found.append((r[kept], q[among] + at, exact[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def block_counts(rows: int, questions: int, spread: int) -> tuple[int, int]:
    """Blocks of the corpus and of the questions: of bounded size, and enough of them for all tasks."""
    q_blocks = max(1, -(-questions // QUESTION_BLOCK))
    enough = min(-(-2 * spread // q_blocks), -(-rows // LEAST_BLOCK))
    return max(1, -(-rows // CORPUS_BLOCK), enough), q_blocks


def _score_blocks(corpus: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame:
    """The k best of each question in each block of the corpus, for any number of questions."""
    spread = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, q_blocks = block_counts(corpus.count(), asked.count(), spread)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    left = corpus.withColumn("__b", own("id", blocks)).withColumn("__q", every(q_blocks))
    right = asked.withColumn("__q", own("query_id", q_blocks)).withColumn("__b", every(blocks))

    def score(part: pa.Table, block: pa.Table) -> pa.Table:
        if part.num_rows == 0 or block.num_rows == 0:
            empty = [block.column("query_id")[:0], part.column("id")[:0], pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=["query_id", "id", "score"])
        unit = _matrix(block.column("vector"))
        r, c, scores = _best_of_block(_matrix(part.column("vector"), unit.shape[1]), unit, part.column("id"), k)
        return pa.Table.from_arrays(
            [block.column("query_id").take(pa.array(c)), part.column("id").take(pa.array(r)), pa.array(scores)],
            names=["query_id", "id", "score"],
        )

    return left.groupBy("__b", "__q").cogroup(right.groupBy("__b", "__q")).applyInArrow(score, schema)


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "vector",
) -> DataFrame:
    """The k nearest corpus rows per query by cosine, with their rank.

    ``corpus`` has ``id`` and ``vector``. Up to ``QUERIES_PER_PASS`` questions go
    to the tasks, and the corpus stays where it is; more are dealt in blocks to
    the executors, where each block of the corpus meets each block of questions.
    Either way a block is one matrix product that passes on exactly k rows for
    each question. k is clipped to the corpus, a zero vector scores 0, and ties
    go to the smaller id.
    """
    if k < 0:
        raise ValueError(f"k must be >= 0, got {k}")
    id_kind = corpus.schema["id"].dataType
    key_kind = queries.schema[query_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"query_id {key_kind.simpleString()}, id {id_kind.simpleString()}, score double"
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    rows = asked.limit(QUERIES_PER_PASS + 1).collect() if k else []
    if not rows:
        return corpus.sparkSession.createDataFrame([], f"{schema}, rank int")
    if len(rows) <= QUERIES_PER_PASS:
        matrix = np.array([list(r["vector"]) for r in rows], dtype="float64")
        keys = [r["query_id"] for r in rows]
        score = _score_batches(matrix, keys, k, to_arrow_type(key_kind))
        parts = corpus.select("id", "vector").mapInArrow(score, schema)
    else:
        parts = _score_blocks(corpus.select("id", "vector"), asked, k, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def enrich(
    neighbours: DataFrame,
    corpus: DataFrame,
    extracted: DataFrame | None = None,
    corpus_id: str = "id",
) -> DataFrame:
    """Neighbours with the corpus columns and, where known, extracted fields."""
    out = neighbours.join(corpus.withColumnRenamed(corpus_id, "id"), "id", "left")
    return out if extracted is None else out.join(extracted, "id", "left")
