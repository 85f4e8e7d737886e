"""Column expressions on text, ids, hashes and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.corpora import strip

# The fields a text falls back to, and the query prefix.
TEXT_FIELDS = ("event_type", "cause", "fuel_type", "affected_unit")
QUERY_PREFIX = "query: "


def _text(c: str) -> Column:
    return F.nullif(strip(F.col(c).cast("string")), F.lit(""))


def embeddable_text(
    description: str = "message_description", fields: Sequence[str] = TEXT_FIELDS
) -> Column:
    """The stripped description, else the non-empty fields joined by spaces, else ''."""
    return F.coalesce(_text(description), F.concat_ws(" ", *(_text(f) for f in fields)))


def composite_id(key: str = "mrid", revision: str = "revision_number") -> Column:
    """``key::revision``; a missing part is 'NULL'."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    return F.concat(part(key), F.lit("::"), part(revision))


def hash_prefix(text: Column, chars: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def feature_hash(columns: Sequence[str]) -> Column:
    """First 16 hex digits of the SHA-256 of the canonical JSON object.

    Canonical is what Python's ``json.dumps`` gives with sorted keys: shortest
    numbers, ``\\u`` escapes beyond ASCII, ", " and ": " between parts.
    """
    parts = []
    for name in sorted(columns):
        parts.append(F.concat(json_text(F.lit(name)), F.lit(": "), json_value(F.col(name))))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return hash_prefix(body, 16)


def json_value(value: Column) -> Column:
    """A scalar as canonical JSON. A float is written with its own shortest digits."""
    kind = F.typeof(value)
    # A runtime's own text may carry a digit more than needed; fewer digits that read back win.
    text = value.cast("string")
    for digits in (16, 15):
        shorter = F.format_string(f"%.{digits}e", value.cast("double"))
        text = F.when(
            (kind == "double") & (shorter.try_cast("double") == value.cast("double")), shorter
        ).otherwise(text)
    number = json_number(text)
    return (
        F.when(value.isNull(), F.lit("null"))
        .when(kind == "string", json_text(value.cast("string")))
        .when(kind.isin("double", "float"), number)
        .when(kind.isin("boolean", "tinyint", "smallint", "int", "bigint"), value.cast("string"))
        .otherwise(json_text(value.cast("string")))
    )


def json_number(shortest: Column) -> Column:
    """Spark's shortest text of a double (``1.0E-4``, ``12.5``) as JSON has it (``0.0001``, ``12.5``).

    Plain digits from 1e-4 up to 1e16, and an exponent of two digits or more beyond.
    """
    sign = F.regexp_extract(shortest, r"^(-?)", 1)
    exponent = F.coalesce(F.try_element_at(F.split(shortest, "[Ee]"), F.lit(2)).cast("int"), F.lit(0))
    mantissa = F.regexp_replace(F.element_at(F.split(shortest, "[Ee]"), 1), "^-", "")
    whole, part = F.element_at(F.split(mantissa, r"\."), 1), F.element_at(F.split(mantissa, r"\."), 2)
    part = F.regexp_replace(part, "0+$", "")
    digits = F.concat(whole, part)
    # The point stands after this many digits.
    point = F.length(whole) + exponent
    fraction = F.substr(digits, point + 1)
    plain = (
        F.when(
            point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        )
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)), F.lit(".0")))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), fraction))
    )
    small = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(
        whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")), F.lit("e"), small,
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"),
    )
    special = F.element_at(
        F.create_map(*(F.lit(x) for x in ("NaN", "NaN", "Infinity", "Infinity", "-Infinity", "-Infinity"))), shortest
    )
    text = F.when((exponent >= -4) & (exponent < 16), plain).otherwise(scientific)
    return F.coalesce(special, F.concat(sign, text))


def json_text(text: Column) -> Column:
    """A JSON string; everything outside printable ASCII is escaped by UTF-16 unit."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), 1)
    named = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}

    def unit(u: Column) -> Column:
        out = F.when((u >= "0020") & (u < "007F"), F.char(F.conv(u, 16, 10).cast("bigint"))).otherwise(
            F.concat(F.lit("\\u"), F.lower(u))
        )
        for code, escape in named.items():
            out = F.when(u == code, F.lit(escape)).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.array_join(F.transform(units, unit), ""), F.lit('"'))


def utf8_bytes(text: Column | str) -> Column:
    return F.octet_length(F.col(text) if isinstance(text, str) else text)


def fence(symbols: Column) -> Column:
    """Array of hex symbols as one string, each symbol between its own bars."""
    barred = F.transform(symbols, lambda x: F.concat(F.lit("|"), x, F.lit("|")))
    return F.array_join(barred, "")


def unfence(fenced: Column) -> Column:
    """The array behind a fenced string."""
    return F.regexp_extract_all(fenced, F.lit("[0-9A-F]+"), 0)


def merge_fenced(fenced: Column, left: str, right: str) -> Column:
    """Join each (left, right) pair of a fenced string, left to right, not overlapping.

    Every symbol has its own bars, so a match is always two whole symbols, and
    string replacement goes left to right without overlap, which is the rule.
    """
    return F.replace(fenced, F.lit(f"|{left}||{right}|"), F.lit(f"|{left}{right}|"))


def merge_pair(symbols: Column, left: str, right: str) -> Column:
    """The same on an array of hex symbols."""
    return unfence(merge_fenced(fence(symbols), left, right))


def fenced_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as a fenced string of two-digit hex symbols."""
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "|$1|")


def byte_symbols(text: Column) -> Column:
    """The same as an array."""
    return unfence(fenced_bytes(text))


def within(expected: Column, actual: Column, tolerance: float | None) -> Column:
    """Equal up to a tolerance; null equals null only."""
    if tolerance is None:
        return expected.eqNullSafe(actual)
    both_null = expected.isNull() & actual.isNull()
    return both_null | F.coalesce(F.abs(expected - actual) <= tolerance, F.lit(False))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times.

    Expressions inside a lambda are evaluated per element; a bound value is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def l2_normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    def scaled(v: Column) -> Column:
        norm = l2_norm(v)
        scale = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
        return bind(
            F.struct(v.alias("v"), scale.alias("s")),
            lambda p: F.transform(p["v"], lambda x: (x.cast("double") / p["s"]).cast("float")),
        )

    return bind(vector, scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def hash_vector(text: Column, dim: int) -> Column:
    """Deterministic unit vector: bytes of chained SHA-256 digests, centred.

    The text is hashed once, then each digest's bytes are hashed again until
    there are enough bytes; the first ``dim`` of them less 128 are normalised.
    """
    if dim <= 0:
        raise ValueError(f"dim must be positive, got {dim}")
    digest = F.sha2(text.cast("binary"), 256)
    chain = digest
    for _ in range((dim + 31) // 32 - 1):
        digest = F.sha2(F.unhex(digest), 256)
        chain = F.concat(chain, digest)
    cells = bind(
        chain,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: (
                F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("float") - F.lit(128.0)
            ).cast("float"),
        ),
    )
    return l2_normalise(cells)
