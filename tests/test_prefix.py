import pytest

from vecloom.operators.prefix import apply_prefix, policy_for
from vecloom.spec import Catalog, LogicalSpec, PrefixPart, PrefixPolicy

POLICY = PrefixPolicy((PrefixPart("expert_name"), PrefixPart("source", "Source"), PrefixPart("topic", "Topic")))
SCHEMA = "id string, chunk_text string, text string, expert_name string, source string, topic array<string>, text_raw string"
PREFIX = "[Alice | Source: https://x | Topic: routing, graphs]"


def run(spark, row, **more):
    return apply_prefix(spark.createDataFrame([row], SCHEMA), POLICY, **more).head()


def test_apply(spark):
    r = run(spark, ("1", "Chunk body", None, "Alice", "https://x", ["routing", " ", None, "graphs"], None))
    assert r.metadata_prefix == PREFIX
    assert r.chunk_text == r.text == PREFIX + "\nChunk body" and r.text_raw == "Chunk body"


def test_parts_are_skipped(spark):
    r = run(spark, ("1", "Body", None, "  Alice ", " \n", [], None))
    assert r.metadata_prefix == "[Alice]"


def test_nothing_to_render(spark):
    r = run(spark, ("1", " ", "From payload", None, None, None, None))
    assert (r.chunk_text, r.text, r.metadata_prefix, r.text_raw) == ("From payload", "From payload", None, None)


def test_no_text(spark):
    r = run(spark, ("1", "  ", None, "Alice", None, None, None))
    assert (r.chunk_text, r.text, r.metadata_prefix) == ("  ", None, None)


def test_prefixed_text_is_kept(spark):
    r = run(spark, ("1", "[Alice]\nBody", None, "Alice", None, None, None))
    # Without a raw text of its own the prefixed text is what is recorded as raw.
    assert r.chunk_text == "[Alice]\nBody" and r.text_raw == "[Alice]\nBody"
    r = run(spark, ("1", "Body", None, "Alice", None, None, "kept"))
    assert r.text_raw == "kept"


def test_bulk_always_has_text(spark):
    r = run(spark, ("1", "Body", None, None, None, None, None), always_text=True)
    assert r.text == "Body" and r.metadata_prefix is None


def test_needs_a_policy(spark):
    df = spark.createDataFrame([("1", "x", None, None, None, None, None)], SCHEMA)
    for policy in (None, PrefixPolicy((), enabled=False)):
        with pytest.raises(ValueError):
            apply_prefix(df, policy)
    with pytest.raises(ValueError):
        PrefixPolicy(())


def test_lookup():
    off = PrefixPolicy((), enabled=False)
    catalog = Catalog(
        logical=(
            LogicalSpec("knowledge", ("kb_v2",), ("kb_v2", "kb_v3"), prefix=POLICY), LogicalSpec("wiki", ("docs",), prefix=off),
            LogicalSpec("other", ("shared",), prefix=POLICY), LogicalSpec("third", ("shared",), prefix=POLICY),
        )
    )
    assert policy_for(catalog, "knowledge") is POLICY
    assert policy_for(catalog, "kb_v3") is POLICY
    assert policy_for(catalog, "wiki") is None and policy_for(catalog, "docs") is None
    assert policy_for(catalog, "shared") is None and policy_for(catalog, "unknown") is None
