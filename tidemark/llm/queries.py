"""One query for each operator of this subpackage over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import align, chat, codes, exact, html, langid, merkle, mix, near, pack, quality, spans, tokens
from tidemark.llm.frames import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Smallest id reachable over the links of a table ``e(a, b)``.
_REACH = """both_ways AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
reach AS (SELECT x AS node, x AS other FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
parts AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)"""
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_minhash_near_dedup",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
    l AS (SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
          ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END AS l
          FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, unnest(l) AS s FROM l),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
    {_REACH}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id,
           coalesce(component, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN parts ON node = d.doc_id
    """,
)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query(
    "op8_exact_dedup",
    r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    WINDOW g AS (PARTITION BY t)
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.exact_duplicates(docs, exact.midpoint(docs))


@query("op2_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query(
    "op9_substring_dedup",
    f"""
    WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
    starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
    windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM starts),
    owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY 1),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM windows JOIN owners USING (k) WHERE owner < doc_id),
    placed AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
    lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
    SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated_spans(table(spark, sf_dir, "documents"))


@query(
    "op7_embedding_near_dedup",
    f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id
          WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
    {_REACH},
    links AS (SELECT x, count(*) AS n FROM both_ways GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
           coalesce(component, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN links ON x = vec_id LEFT JOIN parts ON node = vec_id
    """,
)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whose host is their source, and pages, which have all the evidence."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train_text_model(docs.select("doc_id", "text", "lang"))
    pages = langid.page_evidence(table(spark, sf_dir, "pages"), model.languages)
    return langid.identify(langid.document_evidence(docs).union(pages), model, ["doc_id", "page_id"])


@query("op10_html_main_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# A field of a leaf, and the CRC-32 of an id's decimal digits, bit by bit.
_FIELD = "coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(_FIELD.format(x=x) for x in fields)})"


@query(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
        FROM (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
                     CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS seen FROM documents)),
    t AS (SELECT coalesce('1' || lang, '0') AS k, 0 AS level, i, leaf AS h, n FROM leaves
          UNION ALL SELECT k, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max((n + 1) // 2) FROM t WHERE n > 1 GROUP BY k, level, i // 2),
    subroots AS (SELECT k, h, row_number() OVER (ORDER BY encode(k)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT 0 AS level, i, h, n FROM subroots
          UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max((n + 1) // 2) FROM u WHERE n > 1 GROUP BY level, i // 2),
    root AS (SELECT h AS root FROM u WHERE n = 1),
    places AS (SELECT doc_id, leaf, seen, coalesce('1' || lang, '0') AS k, leaves.i, s.i AS j, s.h AS subroot
               FROM leaves JOIN subroots s ON s.k = coalesce('1' || lang, '0')),
    siblings AS (
        SELECT p.k, p.i, a.level AS step, CASE WHEN b.h IS NULL THEN 'N' WHEN b.i < a.i THEN 'L' ELSE 'R' END || coalesce(b.h, '') AS s
        FROM places p JOIN t a ON a.k = p.k AND a.n > 1 AND a.i = p.i >> a.level
        LEFT JOIN t b ON b.k = a.k AND b.level = a.level AND b.i = xor(a.i, 1)
        UNION ALL
        SELECT p.k, p.i, 1000 + a.level, CASE WHEN b.h IS NULL THEN 'N' WHEN b.i < a.i THEN 'L' ELSE 'R' END || coalesce(b.h, '')
        FROM places p JOIN u a ON a.n > 1 AND a.i = p.j >> a.level LEFT JOIN u b ON b.level = a.level AND b.i = xor(a.i, 1)),
    steps AS (SELECT k, i, list(s ORDER BY step) AS s FROM siblings GROUP BY 1, 2),
    folds AS (SELECT doc_id, leaf, subroot, root,
              sha256(array_to_string(list_transform(coalesce(s, []), lambda x: x[2:]), '')) AS proof_sha256,
              list_reduce(list_prepend(seen, coalesce(s, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
              FROM places LEFT JOIN steps USING (k, i), root)
    SELECT *, folded_root = root AS verified FROM folds
    """,
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proved_leaves(table(spark, sf_dir, "documents"))


@query("op12_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned_documents(table(spark, sf_dir, "documents"))


def _escaped(text: str) -> str:
    """SQL for the escaped text: no control string overlaps another, so they can be replaced one by one."""
    out = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


@query(
    "op13_chat_formatting",
    f"""
    WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said, length({_escaped("text")}) AS chars,
                 CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15
                      ELSE 18 + length({_escaped("role")}) END AS marks FROM m)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(length(said)) AS BIGINT) AS loss_chars, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256,
           CAST(sum(chars + marks) AS BIGINT) AS formatted_chars
    FROM e GROUP BY 1
    """,
)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(chat.marked_conversation(spark))))
