"""Text corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import textfn
from tidemark.operators import corpus, merges
from tidemark.plans import reports
from tidemark.session import scratch_path, spread_scan
from tidemark.sources import corpora
from workload import query, roles
from workload.roles import rounded

# White space as Unicode has it, for the SQL engine's regular expressions.
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = f"regexp_replace(regexp_replace(text, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


def documents(spark, sf):
    docs = spread_scan(roles.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", corpora.strip(F.col("text")).alias("text"))


@query(
    "corpus_profile",
    f"""WITH d AS (SELECT CAST(strlen({_STRIP}) AS BIGINT) AS size FROM documents), f AS (SELECT size FROM d WHERE size > 0)
SELECT count(*) AS pieces, count(*) FILTER (WHERE size > 0) AS documents, count(*) FILTER (WHERE size = 0) AS empties, CAST(sum(size) AS BIGINT) AS bytes,
(SELECT CAST(min(size) AS DOUBLE) FROM f) AS len_min, (SELECT round(quantile_cont(size, 0.5), 4) FROM f) AS len_p50, (SELECT round(quantile_cont(size, 0.9), 4) FROM f) AS len_p90,
(SELECT round(quantile_cont(size, 0.95), 4) FROM f) AS len_p95, (SELECT round(quantile_cont(size, 0.99), 4) FROM f) AS len_p99, (SELECT CAST(max(size) AS DOUBLE) FROM f) AS len_max,
round(sum(size) / count(*) FILTER (WHERE size > 0), 4) AS len_mean FROM d""",
)
def corpus_profile(spark, sf):
    return rounded(corpus.profile(documents(spark, sf)), 4)


@query(
    "non_ascii_top",
    r"""WITH c AS (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents)
SELECT ch, CAST(unicode(ch) AS BIGINT) AS code_point, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, code_point LIMIT 12""",
)
def non_ascii_top(spark, sf):
    return corpus.non_ascii_top(roles.table(spark, sf, "documents"))


@query(
    "non_ascii_share",
    r"""SELECT CAST(sum(length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) AS BIGINT) AS n_non_ascii, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_chars,
round(sum(length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) / (sum(length(text)) + count(*) - 1), 8) AS share FROM documents""",
)
def non_ascii_share(spark, sf):
    return rounded(corpus.non_ascii_share(roles.table(spark, sf, "documents")), 8)


# The SQL engine has no lookahead: a mark is set before the last white space of
# each run that a word follows, and the runs then end at the mark.
_TOKENS = rf"""marked AS (SELECT regexp_replace(text, '([{_WS}]+)([{_WS}][^{_WS}])', '\1' || chr(1) || '\2', 'g') AS text FROM (SELECT {_STRIP} AS text FROM documents)),
tokens AS (SELECT unnest(regexp_extract_all(text, '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}\x01]+|[{_WS}]+')) AS token FROM marked),
counts AS (SELECT token, count(*) AS freq FROM tokens GROUP BY 1)"""


@query("pretoken_counts", f"WITH {_TOKENS} SELECT token, freq FROM counts")
def pretoken_counts(spark, sf):
    return corpus.pretoken_counts(documents(spark, sf))


@query(
    "most_common_pretokens",
    f"WITH {_TOKENS} SELECT token, freq FROM counts ORDER BY freq DESC, token DESC LIMIT 20",
)
def most_common_pretokens(spark, sf):
    counts = corpus.pretoken_counts(documents(spark, sf))
    return counts.orderBy(F.desc("freq"), F.desc("token")).limit(20)


_PAIRS = f"""{_TOKENS}, hexed AS (SELECT hex(encode(token)) AS h, freq FROM counts),
pairs AS (SELECT substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS "left", substr(h, CAST(2 * i + 3 AS INTEGER), 2) AS "right", CAST(sum(freq) AS BIGINT) AS n
FROM (SELECT h, freq, unnest(range(length(h) // 2 - 1)) AS i FROM hexed) GROUP BY 1, 2)"""


@query("byte_pair_counts", f"WITH {_PAIRS} SELECT * FROM pairs")
def byte_pair_counts(spark, sf):
    words = corpus.words_table(corpus.pretoken_counts(documents(spark, sf)))
    return corpus.pair_counts(words)


@query("best_byte_pairs", f'WITH {_PAIRS} SELECT * FROM pairs ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 10')
def best_byte_pairs(spark, sf):
    words = corpus.words_table(corpus.pretoken_counts(documents(spark, sf)))
    return corpus.best_pairs(corpus.pair_counts(words), 10)


@query(
    "merge_one_pair",
    rf"""WITH {_TOKENS}, f AS (SELECT freq, token, regexp_replace(hex(encode(token)), '(..)', '|\1|', 'g') AS w FROM counts)
SELECT token, replace(w, '|65||6E|', '|656E|') AS word FROM f""",
)
def merge_one_pair(spark, sf):
    """Every distinct pre-token with its symbols after joining the bytes of 'en'."""
    counts = corpus.pretoken_counts(documents(spark, sf))
    symbols = textfn.byte_symbols(F.col("token"))
    return counts.select(
        "token", textfn.fence(textfn.merge_pair(symbols, "65", "6E")).alias("word")
    )


# Every generation of words holds the merge that made it.
def _trained(steps: int, columns: str = "") -> str:
    return f"""WITH RECURSIVE {_TOKENS},
gen AS (
  SELECT -1 AS step, regexp_replace(hex(encode(token)), '(..)', '|\\1|', 'g') AS w, freq, '' AS "left", '' AS "right", CAST(0 AS BIGINT) AS n FROM counts
  UNION ALL
  SELECT step + 1, replace(w, '|' || b.l || '||' || b.r || '|', '|' || b.l || b.r || '|'), freq, b.l, b.r, b.n
  FROM gen, (SELECT p[1] AS l, p[2] AS r, CAST(sum(freq) AS BIGINT) AS n
             FROM (SELECT freq, unnest(list_zip(s[:-2], s[2:])) AS p FROM (SELECT freq, string_split(trim(w, '|'), '||') AS s FROM gen))
             GROUP BY 1, 2 ORDER BY n DESC, l DESC, r DESC LIMIT 1) b
  WHERE step < {steps - 1}),
sizes AS (SELECT step, any_value("left") AS "left", any_value("right") AS "right", any_value(n) AS n,
          CAST(sum(freq * len(string_split(trim(w, '|'), '||'))) AS BIGINT) AS total FROM gen GROUP BY 1)
SELECT s.step, s."left", s."right", s.n, s.total, round(b.total / s.total, 6) AS ratio{columns} FROM sizes s, sizes b WHERE b.step = -1 AND s.step >= 0"""


@query("byte_pair_training", _trained(48))
def byte_pair_training(spark, sf):
    """The first 48 merges over all documents with their history."""
    counts = corpus.pretoken_counts(documents(spark, sf))
    return rounded(merges.history_frame(spark, merges.train_merges(counts, 48)))


@query("corpus_to_tokenizer", _trained(12, ", (SELECT count(*) FROM documents) AS pieces, (SELECT count(*) FROM counts) AS pretokens"))
def corpus_to_tokenizer(spark, sf):
    """The whole report over a corpus in one call: the first merges beside its sizes."""
    report = reports.corpus_report(documents(spark, sf), 12)
    sizes = [report["profile"].select("pieces").scalar(), report["pretokens"].agg(F.count("*")).scalar()]
    history = rounded(merges.history_frame(spark, report["merges"]))
    return history.withColumns(dict(zip(("pieces", "pretokens"), sizes, strict=True)))


@query(
    "separated_corpus_read",
    f"""SELECT count(*) AS documents, CAST(sum(strlen(t)) AS BIGINT) AS bytes, count(DISTINCT t) AS distinct_texts FROM (SELECT {_STRIP} AS t FROM documents) WHERE t <> ''""",
)
def separated_corpus_read(spark, sf):
    """Write the documents in separated form and read them back."""
    path = scratch_path(spark, "corpus")
    corpora.write_documents(roles.table(spark, sf, "documents"), path)
    back = corpora.read_documents(spark, path)
    per_text = back.groupBy("text").agg(F.count("*").alias("n"))
    return per_text.agg(
        F.sum("n").alias("documents"),
        F.sum(F.octet_length("text") * F.col("n")).alias("bytes"),
        F.count("*").alias("distinct_texts"),
    )


@query(
    "bernoulli_sample",
    """SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256('7:' || doc_id), 1, 12) AS BIGINT) < 70368744177664""",
)
def bernoulli_sample(spark, sf):
    return corpora.bernoulli_sample(
        roles.table(spark, sf, "documents").select("doc_id"), "doc_id", 0.25, seed=7
    )


@query(
    "capped_sample",
    "SELECT event_id FROM events ORDER BY sha256('3:' || event_id) LIMIT 500",
)
def capped_sample(spark, sf):
    from tidemark.operators import diagnose

    return diagnose.capped_sample(
        roles.table(spark, sf, "events").select("event_id"), "event_id", 500, seed=3
    )
