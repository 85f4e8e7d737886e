"""Embedding and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import textfn
from tidemark.operators import clusters, vectors
from tidemark.plans import retrieval
from tidemark.session import scratch_path
from workload import query, roles
from workload.roles import OUTAGE_LOG, rounded

DIM = 64


def corpus(spark, sf):
    rows = roles.table(spark, sf, "embeddings")
    return vectors.index_rows(rows, "embedding", DIM, "vec_id")


def questions(spark, sf):
    """One question per label: its first vector."""
    rows = roles.table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return first.select(F.col("label").alias("query_id"), "vector")


_TOP = """q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY 1),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query(
    "cosine_top_k",
    f"WITH {_TOP} SELECT query_id, id, score, rank FROM r WHERE rank <= 10",
)
def cosine_top_k(spark, sf):
    rows = roles.table(spark, sf, "embeddings")
    indexed = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.top_k(indexed, questions(spark, sf), 10)


@query(
    "cosine_top_k_enriched",
    f"WITH {_TOP} SELECT query_id, id, rank, e.label AS neighbour_label FROM r JOIN embeddings e ON e.vec_id = r.id WHERE rank <= 5",
)
def cosine_top_k_enriched(spark, sf):
    rows = roles.table(spark, sf, "embeddings")
    found = vectors.top_k(
        rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")),
        questions(spark, sf),
        5,
    )
    labels = rows.select("vec_id", F.col("label").alias("neighbour_label"))
    return vectors.enrich(found, labels, corpus_id="vec_id").select(
        "query_id", "id", "rank", "neighbour_label"
    )


@query(
    "cosine_top_k_of_all",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 4""",
)
def cosine_top_k_of_all(spark, sf):
    """Every vector is a question: blocks of questions meet blocks of the corpus."""
    rows = roles.table(spark, sf, "embeddings")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    indexed = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.top_k(indexed, asked, 4)


_OF_ALL = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _identified(rows, name):
    return rows.select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))


@query(
    "indexed_top_k_of_all",
    f"""WITH {_OF_ALL} SELECT query_id, id, score, rank, true AS few_vectors_read FROM r WHERE rank <= 4""",
)
def indexed_top_k_of_all(spark, sf):
    """The same through the clustered index, with whether a question read less than half of the vectors."""
    rows = roles.table(spark, sf, "embeddings")
    index = clusters.build_index(_identified(rows, "id"), scratch_path(spark, "index"))
    found = clusters.search(index, _identified(rows, "query_id"), 4)
    few = F.col("vectors_read") < F.lit(int(index.rows.sum()) / 2)
    return found.select("query_id", "id", "score", "rank", few.alias("few_vectors_read"))


@query(
    "appended_index_search",
    f"""WITH {_TOP} SELECT query_id, id, score, rank FROM r WHERE rank <= 10""",
)
def appended_index_search(spark, sf):
    """An index of half of the vectors, the others appended, and one question for each label."""
    rows = roles.table(spark, sf, "embeddings")
    index = clusters.build_index(_identified(rows.where("vec_id % 2 = 0"), "id"), scratch_path(spark, "index"))
    index = clusters.append_rows(index, _identified(rows.where("vec_id % 2 = 1"), "id"))
    return clusters.search(index, questions(spark, sf), 10).select("query_id", "id", "score", "rank")


@query(
    "vector_index_rows",
    """SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm_before, 1e0 AS norm_after FROM embeddings""",
)
def vector_index_rows(spark, sf):
    rows = roles.table(spark, sf, "embeddings")
    unit = vectors.index_rows(rows, "embedding", DIM, "vec_id")
    before = rows.select(
        F.col("vec_id").alias("id"), textfn.l2_norm(F.col("embedding")).alias("norm_before")
    )
    after = unit.select("id", textfn.l2_norm(F.col("vector")).alias("norm_after"))
    return rounded(before.join(after, "id"), 4)


_HASHED = "list_transform(range(8), lambda i: CAST('0x' || substr({h}, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) - 128)"


@query(
    "hash_vectors",
    f"""WITH v AS (SELECT doc_id, {_HASHED.format(h="sha256(text)")} AS raw FROM documents)
SELECT doc_id, list_transform(raw, lambda x: round(CAST(CAST(x / sqrt(list_sum(list_transform(raw, lambda y: y * y))) AS FLOAT) AS DOUBLE), 4)) AS vector FROM v""",
)
def hash_vectors(spark, sf):
    docs = roles.table(spark, sf, "documents")
    v = vectors.HashEmbedder(8).batch(F.col("text"))
    return docs.select(
        "doc_id", F.transform(v, lambda x: F.round(x.cast("double"), 4)).alias("vector")
    )


_SEARCH = f"""WITH {OUTAGE_LOG},
c AS (SELECT mrid || '::' || revision_number AS id, coalesce(nullif(trim(message_description), ''), concat_ws(' ', event_type, cause, fuel_type, affected_unit)) AS text FROM log),
cv AS (SELECT id, {_HASHED.format(h="sha256(text)")} AS v FROM c),
qv AS (SELECT n_nationkey AS query_id, {_HASHED.format(h="sha256('query: ' || n_name)")} AS q FROM nation),
s AS (SELECT query_id, id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM qv, cv)
SELECT query_id, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3"""


@query("embed_and_search", _SEARCH)
def embed_and_search(spark, sf):
    """Embed the message corpus through the cache and ask one question per nation."""
    log = roles.outage_log(spark, sf)
    embedder = vectors.HashEmbedder(8)
    path = scratch_path(spark, "vectors")
    index, _ = retrieval.embed_corpus(log, embedder, path)
    index, hit = retrieval.embed_corpus(log, embedder, path)
    if not hit:
        raise RuntimeError("the vector cache was not reused")
    asked = roles.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text")
    )
    found = retrieval.search(index, asked, embedder, 3)
    return found.select("query_id", "id", "rank", "score")


@query(
    "corpus_fingerprint",
    "SELECT sha256(sha256_of) AS fingerprint FROM (SELECT string_agg(sha256(text), chr(10) ORDER BY doc_id) AS sha256_of FROM documents)",
)
def corpus_fingerprint(spark, sf):
    """Order-sensitive digest of all texts; one level of the tree at this size."""
    from tidemark.operators import ordered
    from tidemark.sources import tables

    docs = roles.table(spark, sf, "documents").select("doc_id", "text")
    # Digests are put in order, not texts.
    placed = ordered.row_index(tables.text_digests(docs, "text"), "doc_id", name="pos")
    return tables.corpus_fingerprint(placed, "pos")


@query(
    "hash_prefixes",
    "SELECT doc_id, substr(sha256(text), 1, 12) AS prefix, strlen(text) AS n_bytes FROM documents",
)
def hash_prefixes(spark, sf):
    docs = roles.table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        textfn.hash_prefix(F.col("text")).alias("prefix"),
        textfn.utf8_bytes("text").alias("n_bytes"),
    )
