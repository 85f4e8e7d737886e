"""Language identification by Bayesian fusion of text, declared language, address and host.

*Text.* Each language has a multinomial over hashed byte trigrams of lower-cased letters, from
counts over all labelled rows outside the held-out fold. Trigrams overlap, so their
log-likelihoods count as ``1 / TEMPER`` of independent ones. A flat distribution stands for text
in none of the languages.

*Other evidence.* From the texts' own best languages, grouped counts give how often a language
is declared as what, which address marks it has, and its share on each host. A host's shares are
smoothed towards its domain's, and those towards all rows'; a row's own vote is taken out first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames
from tidemark.llm.frames import staged

BUCKETS = 1 << 14
TEMPER = 6.0
# Weight, in rows, of the level above when shares are smoothed.
PRIOR_ROWS = 10.0
# A row is kept if the likeliest language is at least as likely as this and likelier than none.
LEAST_CONFIDENCE = 0.35
NONE_PRIOR = 0.01
FOLDS = 5

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class TextModel:
    """Languages, and log-probabilities by language and trigram bucket; the last row is none of them."""

    languages: tuple[str, ...]
    table: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each trigram that has a letter and lies within a row."""
    letters = _LETTER[raw].astype(np.uint32)
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:]
    good = value != 0x202020
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    for back in (1, 2):
        cut = inner - back
        good[cut[(cut >= 0) & (cut < len(good))]] = False
    at = np.flatnonzero(good)
    bucket = (value[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def train_text_model(docs: DataFrame) -> TextModel:
    """Counts over all rows of ``docs(doc_id, text, lang)`` with a language, outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                bucket, row = trigrams(*frames.text_bytes(part.column("text")))
                langs = part.column("lang").dictionary_encode()
                code = langs.indices.to_numpy()[row]
                names = langs.dictionary.to_pylist()
                flat = np.bincount(code * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for name, counts in zip(names, flat.reshape(len(names), BUCKETS), strict=True):
                    sums[name] = sums.get(name, 0) + counts
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"]
            )

    counts = known.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long")
    # At most a row for each language and bucket.
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    table = np.full((len(names) + 1, BUCKETS), 0.5)
    place = {name: k for k, name in enumerate(names)}
    row = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    table[row, got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    table = np.log(table / table.sum(axis=1, keepdims=True))
    return TextModel(tuple(names), table.astype(np.float32))


def text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    """The columns but ``text``, with ``scores`` (log-likelihoods, none last), ``vote`` and ``letters``.

    ``vote`` is the index of the likeliest language, null if that is none or the text has no letters.
    """
    others = [c for c in rows.columns if c != "text"]
    n = len(model.languages)

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                bucket, row = trigrams(*frames.text_bytes(part.column("text")))
                scores = np.zeros((part.num_rows, n + 1))
                for k in range(n + 1):
                    scores[:, k] = np.bincount(row, model.table[k][bucket], part.num_rows)
                scores /= TEMPER
                vote = scores.argmax(axis=1)
                letters = np.bincount(row, minlength=part.num_rows) > 0
                none = (vote == n) | ~letters
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in others]
                    + [
                        frames.list_array(scores.ravel(), np.full(part.num_rows, n + 1), pa.float64()),
                        pa.array(vote, pa.int32(), mask=none),
                        pa.array(letters),
                    ],
                    names=[*others, "scores", "vote", "letters"],
                )

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in others)
    return rows.select(*others, "text").mapInArrow(run, f"{schema}, scores array<double>, vote int, letters boolean")


def _votes(scored: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
    """Votes for each language as an array, for each value of ``by``."""
    sums = F.array(*[F.sum((F.col("vote") == k).cast("double")) for k in range(n)])
    return scored.where("vote is not null").groupBy(*by).agg(sums.alias(name))


def fuse(scored: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """``keys, lang, confidence, text_lang, kept`` from scores and the grouped counts of all rows."""
    n = len(model.languages)
    totals = _votes(scored, [], "votes", n).first()
    total = np.array(totals.votes if totals and totals.votes and totals.votes[0] is not None else [0.0] * n)
    share = (total + 1) / (total + 1).sum()
    hosts = staged(_votes(scored.where("host is not null"), ["host"], "host_votes", n), "hosts")
    domains = staged(_votes(scored.where("domain is not null"), ["domain"], "domain_votes", n), "domains")
    declared = staged(_votes(scored.where("declared is not null"), ["declared"], "declared_votes", n), "declared")
    address = staged(_votes(scored.where("address is not null"), ["address"], "address_votes", n), "address")
    joined = scored
    for side, key in ((hosts, "host"), (domains, "domain"), (declared, "declared"), (address, "address")):
        joined = joined.join(side, key, "left")
    marks = ["host_votes", "domain_votes", "declared_votes", "address_votes"]

    def run(batches):
        log_none = np.log(NONE_PRIOR)
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            scores = batch.column("scores").flatten().to_numpy().reshape(rows, n + 1)
            vote = batch.column("vote").fill_null(-1).to_numpy()
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            own = np.zeros((rows, n))
            own[vote >= 0, vote[vote >= 0]] = 1
            counts = {}
            for mark in marks:
                column = batch.column(mark)
                has = column.is_valid().to_numpy(zero_copy_only=False)
                counts[mark] = np.zeros((rows, n))
                counts[mark][has] = column.flatten().to_numpy().reshape(-1, n)
                counts[mark][has] -= own[has]
            prior = np.tile(share, (rows, 1))
            for mark in ("domain_votes", "host_votes"):
                seen = counts[mark]
                prior = (seen + PRIOR_ROWS * prior) / (seen.sum(axis=1, keepdims=True) + PRIOR_ROWS)
            posterior = scores.copy()
            posterior[:, :n] += np.log(prior) + np.log1p(-NONE_PRIOR)
            posterior[:, n] += log_none
            for mark in ("declared_votes", "address_votes"):
                # How much commoner the mark is in a language than overall.
                seen = counts[mark]
                given = (seen + PRIOR_ROWS * share) / (seen.sum(axis=1, keepdims=True) + PRIOR_ROWS)
                posterior[:, :n] += np.log(given / share)
            posterior -= posterior.max(axis=1, keepdims=True)
            posterior = np.exp(posterior)
            posterior /= posterior.sum(axis=1, keepdims=True)
            best = posterior.argmax(axis=1)
            confidence = posterior.max(axis=1)
            known = best < n
            names = pa.array(model.languages, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys]
                + [
                    names.take(pa.array(best, mask=~known)),
                    pa.array(confidence),
                    names.take(pa.array(np.maximum(vote, 0), mask=vote < 0)),
                    pa.array(known & letters & (confidence >= LEAST_CONFIDENCE)),
                ],
                names=[*keys, "lang", "confidence", "text_lang", "kept"],
            )

    kinds = dict(scored.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return joined.select(*keys, "scores", "vote", "letters", *marks).mapInArrow(
        run, f"{schema}, lang string, confidence double, text_lang string, kept boolean"
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as evidence rows: the text, and the source as host."""
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id",
        F.lit(None).cast("long").alias("page_id"),
        "text",
        none.alias("declared"),
        none.alias("address"),
        F.concat(F.lit("source:"), F.col("source")).alias("host"),
        none.alias("domain"),
    )


def page_evidence(pages: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Pages as evidence rows: visible text, language of the markup, address mark, host and domain.

    The address mark is a language code that begins the path, or else the last label of the host.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2,3})(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1))
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        "page_id",
        visible.alias("text"),
        F.when(declared != "", declared).alias("declared"),
        F.when(path.isin(*languages) if languages else F.lit(False), path).otherwise(suffix).alias("address"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )


def identify(evidence: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """``keys, lang, confidence, text_lang, kept`` for every row of ``evidence``.

    ``evidence`` has ``text, declared, address, host, domain``; all may be null. ``lang`` is the
    likeliest language after all evidence, null if none of them; ``text_lang`` is the likeliest by
    the text alone. A row is kept if its text has letters and a language, the likeliest of all and
    likelier than none, is as likely as ``LEAST_CONFIDENCE``. A null or empty text is
    not kept. A model without languages keeps every row and names no language. Repeated rows vote
    each. An empty table gives an empty result.
    """
    if not model.languages:
        none = F.lit(None).cast("string")
        return evidence.select(
            *keys, none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), F.lit(True).alias("kept")
        )
    return fuse(staged(text_scores(evidence, model), "scores"), model, keys)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns.

    The model is trained on the rows' own ``lang``, outside the held-out fold; a row's ``lang`` is
    no evidence for itself beyond that. Rows without an id are kept: no verdict can name them.
    Rows that share an id stay if one of them is identified.
    """
    model = train_text_model(docs.select("doc_id", "text", "lang"))
    verdict = identify(document_evidence(docs.where("doc_id is not null")), model, ["doc_id"])
    gone = verdict.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return frames.small_join(docs, staged(gone, "rejected"), "doc_id", "left_anti", 16)
