"""Validation as a split: rows that pass, and rows with the reason they do not.

Each rule is a ``(broken, reason)`` pair of columns; the first broken rule of a row gives its reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.text import is_blank, strip
from vecloom.functions.vectors import first_bad
from vecloom.operators.embed import lookup
from vecloom.spec import MAX_BATCH_ITEMS, MAX_LIMIT, SEARCH_MODES, Catalog, CollectionSpec

Rule = tuple[Column, Column]


def first_reason(rules: Sequence[Rule]) -> Column:
    """Reason of the first broken rule; null for a valid row.  A rule that is null is not broken."""
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules], F.lit(None).cast("string"))


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumn("reason", first_reason(rules))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; the rejected rows carry ``reason``."""
    checked = check(df, rules)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def strict(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Fail the job on the first row that breaks a rule."""
    reason = first_reason(rules)
    # ``filter`` keeps the check in the plan even if nothing reads the columns it looks at.
    return df.filter(F.when(reason.isNotNull(), F.raise_error(reason).cast("boolean")).otherwise(F.lit(True)))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _at(array: Column, test) -> Column:
    """Position from 0 of the first element for which ``test`` holds; null if none."""
    where = F.array_position(F.transform(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))
    return F.when(where > 0, where - 1)


# --- text -----------------------------------------------------------------------------------------------


def text_rules(column: str, name: str | None = None) -> list[Rule]:
    name = name or column
    return [(is_blank(F.col(column)), _text(f"'{name}' must not be blank"))]


def texts_rules(column: str, name: str | None = None) -> list[Rule]:
    """A list of texts: not empty, no blank item."""
    name = name or column
    items = F.col(column)
    blank = _at(items, is_blank)
    return [
        (F.coalesce(F.size(items), F.lit(0)) <= 0, _text(f"'{name}' must not be empty")),
        (blank.isNotNull(), _text(f"'{name}[", blank, "]' must not be blank")),
    ]


# --- vectors --------------------------------------------------------------------------------------------


def dense_rules(vector: Column, name: str) -> list[Rule]:
    bad = first_bad(vector)
    return [
        (vector.isNotNull() & (F.size(vector) == 0), _text(f"'{name}' must not be empty")),
        (bad.isNotNull(), _text(f"'{name}[", bad, "]' must be a finite number")),
    ]


def size_rules(vector: Column, collection: Column, expected: Column) -> list[Rule]:
    """Unknown collections (null ``expected``) accept any size."""
    return [
        (
            vector.isNotNull() & (F.size(vector) != expected),
            _text("Collection '", collection, "' expects dense vector size ", expected, ", got ", F.size(vector)),
        )
    ]


def sparse_rules(vector: Column, name: str) -> list[Rule]:
    indices, values = vector.getField("indices"), vector.getField("values")
    given = vector.isNotNull()
    order = F.transform(indices, lambda x, i: (i > 0) & (x <= F.get(indices, i - 1)))
    negative = _at(indices, lambda x: x < 0)
    unordered = F.array_position(order, F.lit(True))
    bad = first_bad(values)
    # The list is read from the left: whichever fault comes first is the one reported.
    negative_first = negative.isNotNull() & ((unordered == 0) | (negative < unordered))
    return [
        (
            given & (indices.isNull() | values.isNull()),
            _text(f"'{name}' sparse vector must include list 'indices' and 'values'"),
        ),
        (given & (F.size(indices) == 0), _text(f"'{name}.indices' must not be empty")),
        (
            given & (F.size(indices) != F.size(values)),
            _text(f"'{name}' sparse vector requires the same number of indices and values"),
        ),
        (given & negative_first, _text(f"'{name}.indices[", negative, "]' must be non-negative")),
        (given & (unordered > 0), _text(f"'{name}.indices' must be strictly increasing")),
        (given & bad.isNotNull(), _text(f"'{name}.values[", bad, "]' must be a finite number")),
    ]


def named_rules(df: DataFrame, vectors: Sequence[str]) -> list[Rule]:
    """A point with one column per vector name: at least one is set, and each is a valid vector."""
    if any(not v.strip() for v in vectors):
        raise ValueError("'vector' contains an empty vector name")
    given = sum((F.col(v).isNotNull().cast("int") for v in vectors), F.lit(0))
    rules: list[Rule] = [(given == 0, _text("'vector' must not be empty"))]
    for name in vectors:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.ArrayType):
            rules += dense_rules(F.col(name), f"vector.{name}")
        elif isinstance(dtype, T.StructType):
            rules += sparse_rules(F.col(name), f"vector.{name}")
        else:
            raise ValueError(f"'vector.{name}' must be a dense float list or sparse vector object")
    return rules


# --- ids and request sizes ------------------------------------------------------------------------------


def id_rules(column: str = "id", name: str | None = None) -> list[Rule]:
    return [(strip(F.col(column).cast("string")) == "", _text(f"'{name or column}' must not be blank"))]


def request_sizes(rows: DataFrame, requests: DataFrame, key: str, name: str, cap: int = MAX_BATCH_ITEMS) -> DataFrame:
    """``(key, n, reason)`` for every request: it must have between 1 and ``cap`` rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    sized = requests.select(key).distinct().join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return check(
        sized,
        [
            (F.col("n") == 0, _text(f"'{name}' must not be empty")),
            (F.col("n") > cap, _text(f"'{name}' must contain at most {cap} items")),
        ],
    )


# --- queries, chunks, specs, patches --------------------------------------------------------------------


def query_rules() -> list[Rule]:
    """Search requests: ``text, query_text, vector, limit, search_mode``."""
    text, query_text, vector = F.col("text"), F.col("query_text"), F.col("vector")
    terms_of = F.coalesce(query_text, text)
    # A blank mode is as good as none.
    mode = F.lower(F.when(F.col("search_mode") != "", F.col("search_mode")).otherwise("auto"))
    limit = F.col("limit")
    return [
        (text.isNotNull() & is_blank(text), _text("'text' must not be blank")),
        (query_text.isNotNull() & is_blank(query_text), _text("'query_text' must not be blank")),
        (
            text.isNull() & query_text.isNull() & vector.isNull(),
            _text("One of 'text', 'query_text', or 'vector' is required"),
        ),
        *dense_rules(vector, "vector"),
        ((limit < 1) | (limit > MAX_LIMIT), _text(f"'limit' must be between 1 and {MAX_LIMIT}")),
        (~mode.isin(*SEARCH_MODES), _text("'search_mode' must be one of: auto, dense, sparse, hybrid")),
        ((mode == "sparse") & vector.isNotNull(), _text("'vector' is not allowed when 'search_mode' is 'sparse'")),
        (
            (mode == "sparse") & is_blank(terms_of),
            _text("'query_text' or 'text' is required when 'search_mode' is 'sparse'"),
        ),
    ]


def embed_rules() -> list[Rule]:
    """Embedding requests: exactly one of ``text`` and ``texts``."""
    text, texts = F.col("text"), F.col("texts")
    some = F.coalesce(F.size(texts), F.lit(0)) > 0
    blank = _at(texts, is_blank)
    return [
        (text.isNotNull() & some, _text("Provide either 'text' or 'texts', not both")),
        (text.isNull() & ~some, _text("One of 'text' or 'texts' is required")),
        (text.isNotNull() & is_blank(text), _text("'text' must not be blank")),
        (blank.isNotNull(), _text("'texts[", blank, "]' must not be blank")),
    ]


def chunk_rules(text: str = "chunk_text", vector: str = "vector") -> list[Rule]:
    t, v = F.col(text), F.col(vector)
    return [
        (t.isNull() & v.isNull(), _text("Each chunk requires either 'text' or 'vector'")),
        (t.isNotNull() & is_blank(t), _text("'text' must not be blank")),
        *dense_rules(v, "vector"),
    ]


def spec_rules() -> list[Rule]:
    """A table of collection specs: ``collection, vector_size, vector_name, sparse_vector_name, aliases``."""
    dense, sparse, aliases = F.col("vector_name"), F.col("sparse_vector_name"), F.col("aliases")
    blank = _at(aliases, lambda a: strip(a) == "")
    return [
        (is_blank(F.col("collection")), _text("'collection' must not be blank")),
        (F.col("vector_size") < 1, _text("'vector_size' must be greater than 0")),
        (dense.isNotNull() & is_blank(dense), _text("'vector_name' must not be blank")),
        (sparse.isNotNull() & is_blank(sparse), _text("'sparse_vector_name' must not be blank")),
        (dense == sparse, _text("'vector_name' and 'sparse_vector_name' must be different")),
        (blank.isNotNull(), _text("'aliases[", blank, "]' must not be blank")),
        (F.size(F.array_distinct(aliases)) != F.size(aliases), _text("'aliases' must not contain duplicates")),
    ]


def patch_rules(patch: str = "patch", id_column: str = "id") -> list[Rule]:
    return [
        *id_rules(id_column, "id"),
        (F.coalesce(F.size(F.col(patch)), F.lit(0)) <= 0, _text("'payload' must not be empty")),
    ]


# --- against the collections ----------------------------------------------------------------------------


def dense_of(df: DataFrame, spec: CollectionSpec | None, vectors: Sequence[str]) -> Column:
    """The dense vector of a point with one column per vector name, as one collection sees it.

    Named collection: that column.  Unnamed with a sparse vector: the first dense column.  Neither: the only
    column, when there is exactly one.  Unknown collection: none.
    """
    nothing = F.lit(None).cast("array<float>")
    if spec is None:
        return nothing
    dense = [v for v in vectors if v in df.columns and isinstance(df.schema[v].dataType, T.ArrayType)]
    if spec.vector_name:
        return F.col(spec.vector_name) if spec.vector_name in dense else nothing
    if spec.sparse_vector_name:
        usable = [F.col(v) for v in dense if v != spec.sparse_vector_name]
        return F.coalesce(*usable) if usable else nothing
    set_columns = sum((F.col(v).isNotNull().cast("int") for v in vectors), F.lit(0))
    return F.when(set_columns == 1, F.coalesce(*[F.col(v) for v in dense])) if dense else nothing


def vector_rules(spec: CollectionSpec, dense: Column) -> list[Rule]:
    """A point of a collection needs a dense vector, of the collection's size."""
    return target_vector_rules(spec.name, spec, dense)


def target_vector_rules(target: str, spec: CollectionSpec | None, dense: Column) -> list[Rule]:
    rules: list[Rule] = [(dense.isNull(), _text(f"Collection '{target}' requires a dense vector payload for upsert"))]
    return rules if spec is None else rules + size_rules(dense, F.lit(target), F.lit(spec.vector_size))


def target_rules(df: DataFrame, catalog: Catalog, targets: Sequence[str], vectors: Sequence[str]) -> list[Rule]:
    """Every write target must find a dense vector of its size in the point."""
    rules: list[Rule] = []
    for target in targets:
        spec = catalog.collection(target)
        rules += target_vector_rules(target, spec, dense_of(df, spec, vectors))
    return rules


def model_rules(catalog: Catalog, purpose: str) -> list[Rule]:
    """``physical`` and ``model`` of a row must agree on the vector size; unknown sizes agree with all."""
    produced = lookup({m.name: m.size for m in catalog.models}, F.col("model"))
    expected = lookup({c.name: c.vector_size for c in catalog.collections}, F.col("physical"))
    return [
        (
            produced != expected,
            _text(
                "Model '", F.col("model"), "' produces ", produced, "-dim vectors but collection '",
                F.col("physical"), "' expects ", expected, f" for {purpose}",
            ),
        )
    ]
