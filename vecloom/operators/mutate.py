"""Changes to point tables as DataFrame-to-DataFrame functions (storage is in ``sources.tables``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.text import is_blank, sparse_or_null
from vecloom.operators.embed import Embedder, embed_texts
from vecloom.operators.prefix import apply_prefix
from vecloom.operators.validate import chunk_rules, split
from vecloom.spec import PrefixPolicy


def last_wins(batch: DataFrame, ordinal: str, key: str = "id") -> DataFrame:
    """One row per id: the one with the highest ordinal; a null ordinal is the lowest.

    ``max_by`` combines on the map side, so an id that is a third of the batch costs one row per task.
    """
    others = [c for c in batch.columns if c not in (key, ordinal)]
    best = batch.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(ordinal)).alias("_row"))
    return best.select(key, *[F.col("_row").getField(c).alias(c) for c in others])


def upsert_points(target: DataFrame, batch: DataFrame, ordinal: str | None = None, key: str = "id") -> DataFrame:
    """``target`` with the rows of ``batch`` put in place of those with the same id.

    Columns only one side has are null on the other.
    """
    new = last_wins(batch, ordinal, key) if ordinal else batch
    kept = target.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def payload_set(points: DataFrame, ids: DataFrame, patch: dict[str, Column | object], key: str = "id") -> DataFrame:
    """Set the same payload values on every listed id; other keys and rows stay."""
    if not patch:
        raise ValueError("'payload' must not be empty")
    # Values outside the ids' rows are untouched, so the patch travels as literals and only ids are joined.
    marked = points.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    changes = {}
    for name, value in patch.items():
        new = value if isinstance(value, Column) else F.lit(value)
        old = F.col(name) if name in points.columns else F.lit(None)
        changes[name] = F.when(hit, new).otherwise(old)
    return marked.withColumns(changes).drop("_hit")


def payload_set_counts(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``(requested, matched)``: listed ids, and distinct points they hit."""
    requested = ids.agg(F.count("*").alias("requested"))
    matched = points.join(ids.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("matched"))
    return requested.withColumn("matched", matched.scalar())


def fold_patches(patches: DataFrame, fields: Sequence[str], ordinal: str = "ordinal", key: str = "id", clear: str | None = None) -> DataFrame:
    """One row per id: ``_new_<field>`` is a struct of the field's last value, null where no patch has the field.

    A null field is not part of a patch, unless the patch's array ``clear`` names it: then it is set to null.  Later patches win field by
    field.  The patches of an id are folded on the map side first.
    """

    def given(field: str) -> Column:
        cleared = F.coalesce(F.array_contains(clear, field), F.lit(False)) if clear else F.lit(False)
        return F.col(field).isNotNull() | cleared

    return patches.groupBy(key).agg(
        *[F.max_by(F.struct(F.col(f).alias("value")), F.when(given(f), F.col(ordinal))).alias(f"_new_{f}") for f in fields]
    )


def payload_patch(
    points: DataFrame, patches: DataFrame, fields: Sequence[str], ordinal: str = "ordinal", key: str = "id", clear: str | None = None
) -> DataFrame:
    """Apply a table of ``(id, ordinal, field...)`` patches, see ``fold_patches``."""
    joined = points.join(fold_patches(patches, fields, ordinal, key, clear), key, "left")
    changes = {}
    for f in fields:
        new, old = F.col(f"_new_{f}"), F.col(f) if f in points.columns else F.lit(None)
        changes[f] = F.when(new.isNotNull(), new.getField("value")).otherwise(old)
    return joined.withColumns(changes).drop(*[f"_new_{f}" for f in fields])


def merge_maps(old: Column, new: Column) -> Column:
    """Payload kept as a map: keys of ``new`` replace those of ``old``."""
    mine = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(mine, new))


def merge_json(old: Column, new: Column) -> Column:
    """Payload kept as a JSON object: top-level keys of ``new`` replace those of ``old``, types are kept."""
    kind = "map<string, variant>"
    merged = F.to_json(merge_maps(F.from_json(old, kind), F.from_json(new, kind)))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(merged)


def default_id(collection: str, text: Column, id_column: Column, content: Column | None = None) -> Column:
    """The given id, else a hash of collection, text and ``content`` (everything else that makes the point).

    A random id would change when a lost task runs again; the hash does not.  Rows that are equal in text and content are one
    point; rows that differ in either are not.
    """
    if content is None:
        made = F.concat_ws("\u0001", F.lit(collection), text)
    else:
        # A mark in front, so that a missing part is no empty one.
        parts = [F.coalesce(F.concat(F.lit("+"), part.cast("string")), F.lit("-")) for part in (text, content)]
        made = F.concat_ws("\u0001", F.lit(collection), *parts)
    return F.coalesce(id_column.cast("string"), F.md5(made))


def copy_vector(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.withColumn(target, F.col(source))


def sparse_from_payload(df: DataFrame, sparse: str = "sparse", text: str = "text") -> DataFrame:
    """Fill a missing sparse vector from the payload's ``text``; blank texts stay without one."""
    made = F.when(~is_blank(F.col(text)), sparse_or_null(F.col(text)))
    return df.withColumn(sparse, F.coalesce(F.col(sparse), made) if sparse in df.columns else made)


def prepare_chunks(
    chunks: DataFrame,
    collection: str,
    embedder: Embedder,
    policy: PrefixPolicy | None = None,
    *,
    sparse: str | None = "sparse",
    dense: str = "dense",
) -> tuple[DataFrame, DataFrame]:
    """Chunks to points: validate, prefix, payload text, embed, id, sparse.  ``(points, rejected)``.

    ``chunks``: ``id, chunk_text, vector`` and payload columns.  The embedding sees the (prefixed) chunk
    text; the sparse terms see the payload's ``text``, which is the caller's own if it gave one and no
    prefix was put in front.
    """
    valid, rejected = split(chunks, chunk_rules())
    if policy is not None and policy.enabled:
        valid = apply_prefix(valid, policy)
    given = F.col("text") if "text" in valid.columns else F.lit(None).cast("string")
    valid = valid.withColumn("text", F.coalesce(given, F.col("chunk_text")))
    valid = valid.withColumn("id", default_id(collection, F.col("chunk_text"), F.col("id"), F.to_json(F.struct("*"))))
    if sparse:
        valid = sparse_from_payload(valid, sparse)
    valid = embed_texts(valid, "chunk_text", embedder, into="_made", keep=F.col("vector").isNull())
    points = valid.withColumn(dense, F.coalesce(F.col("vector").cast("array<float>"), F.col("_made")))
    return points.drop("_made", "vector", "chunk_text"), rejected
