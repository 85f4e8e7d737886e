"""Embed a corpus and query it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import textfn
from tidemark.operators import ordered, vectors
from tidemark.sources import tables


def corpus_texts(log: DataFrame) -> DataFrame:
    """Id and text of every message."""
    return log.select(
        textfn.composite_id().alias("id"), textfn.embeddable_text().alias("text")
    )


def embed_corpus(
    log: DataFrame, embedder: vectors.Embedder, path: str, force: bool = False
) -> tuple[DataFrame, bool]:
    """Vectors of the corpus from the cache, or built and cached."""
    spark = log.sparkSession
    texts = corpus_texts(log)
    # Any fixed order will do for the fingerprint. A hash of the id has no ties
    # to speak of, so its quantiles cut the corpus evenly.
    placed = ordered.row_index(
        tables.text_digests(texts, "text").withColumn("__at", F.xxhash64("id")),
        ["__at", "id"],
        name="pos",
    )
    print_of = tables.corpus_fingerprint(placed, "pos").first()["fingerprint"]

    def build() -> DataFrame:
        embedded = texts.select("id", embedder.batch(F.col("text")).alias("vector"))
        return vectors.index_rows(embedded, "vector", embedder.dim)

    return tables.cached_vectors(spark, path, print_of, embedder.model_id, build, force)


def search(
    index: DataFrame, questions: DataFrame, embedder: vectors.Embedder, k: int, text: str = "text"
) -> DataFrame:
    """Top k messages for each question text."""
    asked = questions.select("query_id", embedder.query(F.col(text)).alias("vector"))
    return vectors.top_k(index, asked, k)
