"""Structured payload filters compiled to one Column.

A filter is a mapping.  With any of ``must`` / ``should`` / ``must_not`` present it is a clause filter and
every other top-level key is ignored; otherwise it is shorthand for equality on each key.  Conditions are
``{"key": k, "match": value | [values]}`` or ``{"key": k, "range": {"gt"|"gte"|"lt"|"lte": bound}}``.
The result is a plain predicate, so it prunes partitions and reaches the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAUSES = ("must", "should", "must_not")
BOUNDS = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def compile_filter(spec: Mapping | None, schema: T.StructType) -> Column:
    """Predicate for ``spec`` over rows of ``schema``; ``None`` and ``{}`` hold for every row."""
    if not spec:
        return F.lit(True)
    if not any(name in spec for name in CLAUSES):
        return _all([_condition({"key": k, "match": v}, schema) for k, v in spec.items()])
    must, should, must_not = ([_condition(c, schema) for c in spec.get(name) or ()] for name in CLAUSES)
    parts = list(must)
    if should:
        parts.append(reduce(or_, should))
    # A null condition is "does not hold", so its negation must keep the row.
    parts.extend(~F.coalesce(c, F.lit(False)) for c in must_not)
    return _all(parts)


def apply_filter(df: DataFrame, spec: Mapping | None) -> DataFrame:
    return df.filter(compile_filter(spec, df.schema)) if spec else df


def _all(parts: Sequence[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def _condition(item, schema: T.StructType) -> Column:
    if not isinstance(item, Mapping) or "key" not in item:
        raise ValueError(f"Unsupported filter condition: {item!r}")
    if "range" not in item and item.get("match") is None:
        raise ValueError(f"Filter condition without match or range: {item!r}")
    found = field(item["key"], schema)
    if found is None:
        return F.lit(False)
    column, dtype = found
    if "range" in item:
        return _range(column, dtype, item["range"] or {})
    match = item["match"]
    return _match(column, dtype, list(match) if isinstance(match, (list, tuple)) else [match])


def field(key: str, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    """Column and type of a payload key: a column, a dotted path, or an entry of a map column ``payload``."""
    if key in schema.names:
        return F.col(f"`{key}`"), schema[key].dataType
    column, dtype = None, schema
    for step in key.split("."):
        if not isinstance(dtype, T.StructType) or step not in dtype.names:
            break
        column = F.col(f"`{step}`") if column is None else column.getField(step)
        dtype = dtype[step].dataType
    else:
        return column, dtype
    if "payload" in schema.names and isinstance(schema["payload"].dataType, T.MapType):
        return F.col("payload").getItem(key), schema["payload"].dataType.valueType
    for name in ("payload", "extra"):
        kind = schema[name].dataType if name in schema.names else None
        if isinstance(kind, (T.VariantType, T.StringType)):
            value = F.col(name) if isinstance(kind, T.VariantType) else F.try_parse_json(F.col(name))
            path = "$" + "".join("['" + step.replace("'", "\\'") + "']" for step in key.split("."))
            return F.try_variant_get(value, path, "variant"), T.VariantType()
    return None


def _typed(value: Column, sample) -> tuple[Column, Column]:
    """A variant as the type of ``sample``, and as an array of that type; null where it is neither.

    Fixed values: the type names are those Spark reports for variants.
    """
    kind = F.schema_of_variant(value)
    if isinstance(sample, bool):
        want, names = "boolean", ["BOOLEAN"]
    elif isinstance(sample, (int, float)):
        want, names = "double", ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"]
    else:
        want, names = "string", ["STRING"]
    one = F.when(kind.rlike("^(" + "|".join(names) + ")"), F.try_variant_get(value, "$", want))
    many = F.when(kind.rlike("^ARRAY<(" + "|".join(names) + ")"), F.try_variant_get(value, "$", f"array<{want}>"))
    return one, many


def _comparable(value, dtype: T.DataType) -> bool:
    if isinstance(dtype, T.BooleanType) or isinstance(value, bool):
        return isinstance(dtype, T.BooleanType) and isinstance(value, bool)
    if isinstance(dtype, T.NumericType):
        return isinstance(value, (int, float))
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    return True


def _match(column: Column, dtype: T.DataType, values: list) -> Column:
    """Any of the values; a value of another type than the field never matches."""
    if isinstance(dtype, T.VariantType):
        found = []
        for value in values:
            one, many = _typed(column, value)
            literal = F.lit(float(value) if isinstance(value, int) and not isinstance(value, bool) else value)
            found.append(F.coalesce(one == literal, F.array_contains(many, literal), F.lit(False)))
        return reduce(or_, found) if found else F.lit(False)
    element = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    usable = [v for v in values if _comparable(v, element)]
    if not usable:
        return F.lit(False)
    if isinstance(dtype, T.ArrayType):
        wanted = F.array(*[F.lit(v).cast(element) for v in usable])
        return F.arrays_overlap(column, wanted)
    return column == F.lit(usable[0]) if len(usable) == 1 else column.isin(usable)


def _range(column: Column, dtype: T.DataType, bounds: Mapping) -> Column:
    unknown = set(bounds) - set(BOUNDS)
    if unknown:
        raise ValueError(f"Unsupported range bounds: {sorted(unknown)}")
    given = {name: value for name, value in bounds.items() if value is not None}
    if any(isinstance(v, str) for v in given.values()):
        return _datetime_range(column, dtype, given)
    if isinstance(dtype, T.VariantType):
        column, dtype = _typed(column, 0.0)[0], T.DoubleType()
    if not isinstance(dtype, T.NumericType):
        return F.lit(False)
    return _all([BOUNDS[name](column, F.lit(v)) for name, v in given.items()])


def _datetime_range(column: Column, dtype: T.DataType, bounds: Mapping) -> Column:
    """One string bound makes the whole range a range of instants; a bound without a zone is UTC."""
    if isinstance(dtype, T.VariantType):
        column, dtype = _typed(column, "")[0], T.StringType()
    if isinstance(dtype, T.StringType):
        column, dtype = F.try_to_timestamp(column), T.TimestampType()
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(False)
    zoned = not isinstance(dtype, T.TimestampNTZType)
    return _all([BOUNDS[name](column, _instant(v, zoned)) for name, v in bounds.items()])


def _instant(value, zoned: bool) -> Column:
    at = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    at = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at.astimezone(dt.timezone.utc)
    # Written out with or without its zone, so that the session's time zone has no say.
    return F.lit(at.isoformat()).cast("timestamp") if zoned else F.lit(at.replace(tzinfo=None).isoformat()).cast("timestamp_ntz")
