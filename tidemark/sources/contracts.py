"""Schema contracts on read and before write."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table does not have the columns it is declared to have."""


def check_contract(df: DataFrame, contract: T.StructType, allow_extra: bool = False) -> DataFrame:
    """Compare names and types on the driver; no data is read.

    The result is projected to the contract's order.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in contract.fields if f.name not in actual]
    if missing:
        raise ContractError(f"missing column(s): {missing}")
    mistyped = [
        f"{f.name}: expected {f.dataType.simpleString()}, got {actual[f.name].simpleString()}"
        for f in contract.fields
        if actual[f.name] != f.dataType
    ]
    if mistyped:
        raise ContractError(f"mistyped column(s): {mistyped}")
    extra = [name for name in actual if name not in set(contract.names)]
    if extra and not allow_extra:
        raise ContractError(f"unexpected column(s): {extra}")
    return df.select(*contract.names)


def read_exact(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """Read parquet; a missing, mistyped or extra column is an error."""
    return check_contract(spark.read.parquet(path), contract)


def read_required(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """Read parquet; extra columns are tolerated and pruned from the scan."""
    return check_contract(spark.read.parquet(path), contract, allow_extra=True)


def require_columns(
    df: DataFrame, required: Sequence[str], ignore: Iterable[str] = ("_id",)
) -> DataFrame:
    """Keep the required columns; warn about unknown ones, fail on missing ones."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"required column(s) missing: {missing}")
    unknown = sorted(set(df.columns) - set(required) - set(ignore))
    if unknown:
        warnings.warn(f"{len(unknown)} unknown column(s) ignored: {unknown}", stacklevel=2)
    return df.select(*required)


def cast_to_contract(
    df: DataFrame,
    contract: T.StructType,
    backfill: dict[str, object] | None = None,
    lenient: Iterable[str] = (),
) -> DataFrame:
    """Project to the declared order and cast; overflow is an error (ANSI casts).

    ``backfill`` names columns that may be absent or unparsable and the value
    they then take (``None`` for null). ``lenient`` columns turn an unparsable
    value into null instead of failing.
    """
    backfill = backfill or {}
    soft = {*backfill, *lenient}

    def column(field: T.StructField) -> Column:
        kind = field.dataType
        fallback = F.lit(backfill.get(field.name)).cast(kind)
        if field.name not in df.columns:
            if field.name not in backfill:
                raise ContractError(f"missing column(s): {[field.name]}")
            return fallback.alias(field.name)
        value = F.col(field.name)
        if field.name in soft:
            value = value.try_cast(kind)
            if backfill.get(field.name) is not None:
                value = F.coalesce(value, fallback)
            return value.alias(field.name)
        return value.cast(kind).alias(field.name)

    return df.select(*(column(f) for f in contract.fields))


def require_instants(df: DataFrame, *columns: str) -> DataFrame:
    """Refuse time columns without a zone (NTZ, dates, strings)."""
    for name in columns:
        if name not in df.columns:
            raise ContractError(f"missing column(s): {[name]}")
        kind = df.schema[name].dataType
        if not isinstance(kind, T.TimestampType):
            raise ContractError(f"{name} must be a UTC instant, got {kind.simpleString()}")
    return df
