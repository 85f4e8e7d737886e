"""Extraction report and corpus-to-merges report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import corpus, extract, merges
from tidemark.session import stage_table


def extraction_report(
    log: DataFrame, labels: DataFrame, extractor: extract.Extractor, shown: int = 10
) -> dict[str, DataFrame]:
    """Agreement per field, the first disagreements, and how many more there are."""
    keyed = labels.select(*extract.KEY)
    labelled = log.join(keyed, list(extract.KEY), "left_semi")
    compared = extract.compare(labels, extractor.extract(labelled))
    head, more = extract.first_disagreements(compared, shown)
    return {"agreement": extract.agreement(compared), "first": head, "more": more}


def corpus_report(documents: DataFrame, steps: int, text: str = "text") -> dict[str, object]:
    """Profile, non-ASCII inventory, pre-token counts and trained merges."""
    # Read by the caller and by the training, so the texts are cut once.
    counts = stage_table(corpus.pretoken_counts(documents, text), "pretokens")
    return {
        "profile": corpus.profile(documents, text),
        "non_ascii": corpus.non_ascii_top(documents, text),
        "pretokens": counts,
        "merges": merges.train_merges(counts, steps),
    }
