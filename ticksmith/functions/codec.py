"""JSON message codec: bytes -> text -> typed row -> JSON.

Decoding is PERMISSIVE (the default mode, so no options map: with options
Spark keeps every field of the struct instead of pruning to the ones used).
Bad messages become all-NULL rows; they re-encode as ``{}`` and drop out of
time windows because their event time is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DECODED = "data"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: str | Column) -> Column:
    """Message bytes (or text) -> UTF-8 string."""
    return _c(c).cast("string")


def decode(c: str | Column, schema: StructType) -> Column:
    return F.from_json(as_text(c), schema)


def unwrap_double_encoded(c: str | Column) -> Column:
    """A JSON string literal holding JSON text -> that text; anything else unchanged.

    Wrapping the message in ``[...]`` and reading it as ``array<string>``
    yields the inner text when the message was encoded twice.
    """
    text = as_text(c)
    inner = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 0)
    return F.coalesce(inner, text)


def decode_lenient(c: str | Column, schema: StructType) -> Column:
    """Decode plain and double-encoded objects alike; bad input -> NULL."""
    return F.from_json(unwrap_double_encoded(c), schema)


def encode_row(*cols: str | Column) -> Column:
    """JSON object of the given columns (all columns when none); NULLs omitted."""
    return F.to_json(F.struct(*(cols or ["*"])))


def decode_frame(df: DataFrame, schema: StructType, value: str = "value",
                 lenient: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One message column -> the schema's columns, flattened."""
    dec = decode_lenient(value, schema) if lenient else decode(value, schema)
    return df.select(*(keep or []), dec.alias(DECODED)).select(*(keep or []), f"{DECODED}.*")


def with_quarantine(df: DataFrame, schema: StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split messages into decoded rows and the originals that failed to decode.

    A message fails when every field decodes to NULL (malformed text, empty,
    a non-object), which PERMISSIVE parsing would otherwise pass on as ``{}``.
    """
    dec = df.select(F.col(value), decode(value, schema).alias(DECODED))
    fields = [F.col(f"{DECODED}.{f.name}") for f in schema.fields]
    all_null = F.lit(True)
    for f in fields:
        all_null = all_null & f.isNull()
    good = dec.filter(~all_null).select(f"{DECODED}.*")
    bad = dec.filter(all_null).select(F.col(value))
    return good, bad
