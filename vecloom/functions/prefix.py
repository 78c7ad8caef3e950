"""Contextual prefix in front of a text, from payload columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.text import bind, is_blank, strip
from vecloom.operators.filters import field
from vecloom.spec import PrefixPolicy


def as_text(value: Column, dtype: T.DataType) -> Column:
    """A payload value as prefix text; null where it has none.

    Strings are stripped, numbers and booleans written out (booleans capitalised), arrays joined element by
    element, objects ignored.  Floating-point numbers use Spark's notation.
    """
    if isinstance(dtype, T.StringType):
        return bind(strip(value), lambda s: F.when(s != "", s))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, T.NumericType):
        return value.cast("string")
    if isinstance(dtype, T.VariantType):
        return variant_text(value)
    if isinstance(dtype, T.ArrayType):
        parts = F.filter(F.transform(value, lambda x: as_text(x, dtype.elementType)), lambda s: s.isNotNull())
        return bind(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, ", ")))
    return F.lit(None).cast("string")


def variant_text(value: Column, depth: int = 3) -> Column:
    """The same for a value out of a JSON object; arrays in arrays count up to ``depth``."""
    kind = F.schema_of_variant(value)

    def typed(name: str) -> Column:
        return F.try_variant_get(value, "$", name)

    text = (
        F.when(kind == "STRING", bind(strip(typed("string")), lambda s: F.when(s != "", s)))
        .when(kind == "BOOLEAN", F.initcap(typed("boolean").cast("string")))
        .when(kind == "BIGINT", typed("bigint").cast("string"))
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), typed("double").cast("string"))
    )
    if not depth:
        return text
    parts = F.filter(F.transform(typed("array<variant>"), lambda x: variant_text(x, depth - 1)), lambda s: s.isNotNull())
    return text.when(kind.startswith("ARRAY"), bind(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, ", "))))


def render(policy: PrefixPolicy, schema: T.StructType) -> Column:
    """The prefix of a row; null when the policy is off or no part has a value."""
    if not policy.enabled:
        return F.lit(None).cast("string")
    parts = []
    for part in policy.parts:
        found = field(part.payload_key, schema)
        if found is None:
            continue
        value = as_text(*found)
        parts.append(F.concat(F.lit(f"{part.label}: "), value) if part.label else value)
    if not parts:
        return F.lit(None).cast("string")
    body = F.concat_ws(policy.separator, *parts)
    return F.when(
        F.coalesce(*parts).isNotNull(), F.concat(F.lit(policy.prefix), body, F.lit(policy.suffix))
    )


def source_text(text: Column, payload_text: Column | None) -> Column:
    """The text itself, else the payload's text; null when both are blank."""
    base = F.when(~is_blank(text), text)
    return base if payload_text is None else F.coalesce(base, F.when(~is_blank(payload_text), payload_text))
