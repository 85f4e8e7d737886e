"""Structured extraction from messages and its scoring against labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import textfn
from tidemark.sources.contracts import cast_to_contract

KEY = ("mrid", "revision_number")
# Compared fields with their tolerance (MW, hours) and its label.
FIELDS = {
    "event_type": (None, "—"),
    "fuel_type": (None, "—"),
    "affected_capacity_mw": (5.0, "±5 MW"),
    "effective_from": (1.0, "±1 h"),
    "effective_to": (1.0, "±1 h"),
}
RESULT_SCHEMA = (
    "event_type string, fuel_type string, affected_capacity_mw double, "
    "effective_from timestamp, effective_to timestamp, confidence float, "
    "prompt_hash string, model_id string"
)


class Extractor(Protocol):
    """Log rows in, one result row per log row out; never fails on a row."""

    def extract(self, log: DataFrame) -> DataFrame: ...


def default_result() -> dict[str, Column]:
    """What is reported for a message nothing is known about."""
    return {
        "event_type": F.coalesce("event_type", F.lit("Other")),
        "fuel_type": F.coalesce("fuel_type", F.lit("Other")),
        "affected_capacity_mw": F.lit(None).cast("double"),
        "effective_from": F.col("effective_from"),
        "effective_to": F.col("effective_to"),
        "confidence": F.lit(0.0).cast("float"),
        "prompt_hash": F.lit(None).cast("string"),
        "model_id": F.lit(None).cast("string"),
    }


class LabelExtractor:
    """Look the answer up in a labelled set, else the default."""

    def __init__(self, labels: DataFrame) -> None:
        self._labels = labels

    def extract(self, log: DataFrame) -> DataFrame:
        wanted = ("event_type", "fuel_type", "affected_capacity_mw", "effective_from",
                  "effective_to", "confidence")
        labels = self._labels.select(*KEY, F.struct(*wanted).alias("__label"))
        joined = log.join(labels, list(KEY), "left")
        hit = F.col("__label").isNotNull()
        columns = [
            (
                F.when(hit, F.col(f"__label.{name}")).otherwise(value)
                if name in wanted
                else value
            ).alias(name)
            for name, value in default_result().items()
        ]
        return joined.select(*KEY, *columns)


def _answers(answer: Callable[[Sequence[str]], list[dict | None]], texts: list[str]) -> list[dict | None]:
    """One answer for each text; a failure costs the texts that cause it only."""
    try:
        results = list(answer(texts))
    except Exception:  # noqa: BLE001 - the surface never raises
        results = None
    if results is not None and len(results) == len(texts):
        return results
    if len(texts) <= 1:
        return [None] * len(texts)
    half = len(texts) // 2
    return _answers(answer, texts[:half]) + _answers(answer, texts[half:])


class ModelExtractor:
    """A user's model behind an iterator Pandas UDF.

    ``load`` returns a function from a batch of message texts to a list of
    dicts (or None). Where a batch fails, or its answers do not match its texts
    one to one, each half is asked on its own, down to single texts; only a text
    that fails alone, or is answered None, becomes the default row.
    """

    def __init__(
        self,
        load: Callable[[], Callable[[Sequence[str]], list[dict | None]]],
        model_id: str,
        prompt: str,
    ) -> None:
        import pandas as pd

        fields = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            answer = load()
            for texts in batches:
                results = _answers(answer, texts.tolist())
                rows = [
                    {**dict.fromkeys(fields), **(r or {}), "model_id": model_id if r else None}
                    for r in results
                ]
                yield pd.DataFrame(rows, columns=fields)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        self._udf = F.pandas_udf(run, RESULT_SCHEMA)
        self._prompt_hash = textfn.hash_prefix(F.lit(prompt))

    def extract(self, log: DataFrame) -> DataFrame:
        answered = log.withColumn("__r", self._udf(textfn.embeddable_text()))
        # A batch answer carries model_id only where the model gave a result.
        hit = F.col("__r.model_id").isNotNull()
        columns = []
        for name, value in default_result().items():
            found = self._prompt_hash if name == "prompt_hash" else F.col(f"__r.{name}")
            if name in ("event_type", "fuel_type", "effective_from", "confidence"):
                found = F.coalesce(found, value)
            columns.append(F.when(hit, found).otherwise(value).alias(name))
        return answered.select(*KEY, *columns)


def extracted_table(log: DataFrame, extractor: Extractor, extracted_at: Column) -> DataFrame:
    """One result per log row under the extracted-events contract."""
    return cast_to_contract(
        extractor.extract(log).withColumn("extracted_at_utc", extracted_at), schemas.EXTRACTED
    )


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per (label, field) with exact and tolerant agreement.

    A label whose message has no answer is compared with nulls, so every label
    counts.
    """
    joined = expected.select(
        *KEY, *(F.col(f).alias(f"e_{f}") for f in FIELDS)
    ).join(actual.select(*KEY, *(F.col(f).alias(f"a_{f}") for f in FIELDS)), list(KEY), "left")

    def number(side: str, field: str) -> Column:
        c = F.col(f"{side}_{field}")
        if field.startswith("effective"):
            return F.unix_micros(c) / F.lit(3.6e9)
        return c

    cells = []
    for field, (tolerance, _) in FIELDS.items():
        e, a = F.col(f"e_{field}"), F.col(f"a_{field}")
        exact = e.eqNullSafe(a)
        close = (
            exact
            if tolerance is None
            else textfn.within(number("e", field), number("a", field), tolerance)
        )
        cells.append(
            F.struct(
                F.lit(field).alias("field"),
                exact.alias("exact"),
                close.alias("close"),
                e.cast("string").alias("expected"),
                a.cast("string").alias("actual"),
            )
        )
    return joined.select(*KEY, F.explode(F.array(*cells)).alias("c")).select(*KEY, "c.*")


def agreement(compared: DataFrame) -> DataFrame:
    """Exact and tolerance counts per field."""
    return compared.groupBy("field").agg(
        F.count("*").alias("total"),
        F.count_if("exact").alias("exact_match"),
        F.count_if("close").alias("tolerance_match"),
    )


def disagreements(compared: DataFrame) -> DataFrame:
    return compared.filter(~F.col("close"))


def first_disagreements(compared: DataFrame, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the first ones in key order, one row with how many more there are)."""
    wrong = disagreements(compared)
    position = F.array_position(F.array(*(F.lit(f) for f in FIELDS)), F.col("field"))
    head = wrong.orderBy(*KEY, position).limit(shown)
    more = wrong.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("n_more"))
    return head, more
