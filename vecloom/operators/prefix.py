"""Prefix policies over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.prefix import render, source_text
from vecloom.spec import Catalog, PrefixPolicy


def policy_for(catalog: Catalog, collection: str) -> PrefixPolicy | None:
    """The enabled policy of a logical name; of a physical name, the policy of the only enabled logical
    collection that lists it."""
    logical = catalog.logical_collection(collection)
    if logical is not None:
        return logical.prefix if logical.prefix and logical.prefix.enabled else None
    users = [
        spec.prefix
        for spec in catalog.logical
        if spec.prefix and spec.prefix.enabled and collection in (*spec.read_targets, *spec.write_targets)
    ]
    return users[0] if len(users) == 1 else None


def policy_owners(logical: DataFrame) -> DataFrame:
    """``(collection, policy_owner)`` for every name a policy applies to, from a table of logical collections.

    ``logical``: ``name, read_targets, write_targets, prefix_enabled``.
    """
    enabled = logical.filter("prefix_enabled")
    own = logical.select(F.col("name").alias("collection"), F.when(F.col("prefix_enabled"), F.col("name")).alias("policy_owner"))
    physical = (
        enabled.select("name", F.explode(F.array_union("read_targets", "write_targets")).alias("collection"))
        .groupBy("collection")
        .agg(F.count("*").alias("n"), F.min("name").alias("name"))
        .filter("n = 1")
        .select("collection", F.col("name").alias("policy_owner"))
    )
    return own.filter("policy_owner is not null").unionByName(
        physical.join(logical.select(F.col("name").alias("collection")), "collection", "left_anti")
    )


def apply_prefix(df: DataFrame, policy: PrefixPolicy | None, text: str = "chunk_text", *, always_text: bool = False) -> DataFrame:
    """Put the prefix in front of column ``text`` and record it in the payload columns.

    * base text: ``text``, else the payload's text column; a row without either stays unchanged;
    * no prefix for the row: ``text`` becomes the base text, payload unchanged;
    * otherwise ``text`` and the payload's text column become prefix + newline + base (a base
      that already starts with the prefix is kept), the prefix column is set, and the raw text column is set
      where it was null.

    ``always_text`` also fills the payload's text column of unprefixed rows (the bulk transform).
    """
    if policy is None or not policy.enabled:
        raise ValueError("no enabled prefix policy")

    def existing(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    base = source_text(F.col(text), existing(policy.text_key))
    staged = df.withColumns({"_base": base, "_prefix": F.when(base.isNotNull(), render(policy, df.schema))})
    has = F.col("_prefix").isNotNull()
    joined = F.when(F.col("_base").startswith(F.col("_prefix")), F.col("_base")).otherwise(
        F.concat(F.col("_prefix"), F.lit("\n"), F.col("_base"))
    )
    new_text = F.coalesce(F.when(has, joined), F.col("_base"), F.col(text))
    payload_text = F.when(has, joined).otherwise(existing(policy.text_key))
    if always_text:
        payload_text = F.coalesce(payload_text, new_text)
    changes = {
        policy.prefix_key: F.when(has, F.col("_prefix")).otherwise(existing(policy.prefix_key)),
        policy.text_key: payload_text,
        text: new_text,
    }
    if policy.raw_text_key:
        raw = existing(policy.raw_text_key)
        changes[policy.raw_text_key] = F.when(has, F.coalesce(raw, F.col("_base"))).otherwise(raw)
    if policy.text_key == text:
        changes[text] = new_text
    return staged.withColumns(changes).drop("_base", "_prefix")
