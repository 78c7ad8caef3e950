"""A Merkle manifest of a table: one tree for each group, one over the groups' roots, and a proof for every row.

Each built level is a table of nodes that know their parent and their place among its children, and hold the digests of
their own children in a row.  A recursive query climbs from the leaves to the root along these links: at every step it folds
the digests of the rows as they are found now with the siblings as they were stored, and appends the siblings to the proof.
The leaves of one run share every sibling above it, so they climb in one row of the recursion, each with its own digest.

Digests travel as 32 bytes and are hashed as lower-case hex text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.ordering import number_rows
from vecloom.session import written

ARITY = 16
WIDTH = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The tree over the groups; names of the groups' own trees are empty or begin with another letter.
TOP = "t"


@dataclass(frozen=True)
class Manifest:
    """``runs``: leaves that share a parent; ``nodes``: everything above them; ``root``: hex digest, None without rows."""

    runs: DataFrame
    nodes: DataFrame
    root: str | None


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: of each value its count of UTF-8 bytes, a colon and itself; ``-`` for a null."""
    texts = [value.cast("string") for value in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def build_manifest(
    rows: DataFrame, *, group: str = "source", key: str = "doc_id", fields: Sequence[str] = FIELDS, found: Column | None = None
) -> Manifest:
    """Hash ``fields`` of every row and build the trees.

    Within a group leaves ascend by ``key`` (null first, equal keys by their digest, so repeated rows are leaves beside each
    other); a null group is a group of its own and comes first, the others follow in the order of their bytes.  While a level
    has several nodes, every 16 consecutive ones become one.  ``found`` is the digest of the row as it is now, if it is to
    be checked against the manifest; null means unchanged.  Only the named columns are read.  Texts are hashed in the
    scan and not shuffled; hot groups are numbered by ranges of group and key, and no task holds a whole one.
    """
    spark = rows.sparkSession
    leaf = leaf_digest(*[F.col(f"`{name}`") for name in fields])
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{key}`").alias("key"),
        leaf.alias("leaf"),
        (F.lit(None).cast("binary") if found is None else found).alias("found"),
    )
    # Written first: the range partitioning below looks at its input twice.
    leaves = written(leaves, "merkle-leaves")
    placed = number_rows(leaves, ["tree"], ["key", "leaf", "found"], "place").withColumn("place", F.col("place") - 1)
    run = F.floor(F.col("place") / ARITY)
    members = F.sort_array(F.collect_list(F.struct("place", "key", "leaf", "found")))
    runs = written(placed.groupBy("tree", run.alias("run")).agg(members.alias("members")), "merkle-runs")
    sizes = runs.groupBy("tree").agg(F.sum(F.size("members")).alias("n"))

    # A run of a group with one row only is no node: the leaf is the group's root.
    first = runs.join(written(sizes, "merkle-sizes"), "tree").withColumn("body", _joined("members", "leaf"))
    height, nodes = _levels(
        first.select("tree", "run", "n", "body").where("n > 1"),
        first.where("n = 1").select("tree", F.col("members")[0].getField("leaf").alias("digest")),
    )
    subroots = written(number_rows(height, [], ["tree"], "place").withColumn("place", F.col("place") - 1), "merkle-subroots")
    groups = subroots.count()
    tops = subroots.select(F.lit(TOP).alias("tree"), "place", F.col("digest").alias("leaf"), F.lit(groups).cast("long").alias("n"))
    tops = tops.groupBy("tree", F.floor(F.col("place") / ARITY).alias("run"), "n").agg(
        F.sort_array(F.collect_list(F.struct("place", "leaf"))).alias("members")
    )
    top_root, top_nodes = _levels(
        tops.select("tree", "run", "n", _joined("members", "leaf").alias("body")).where("n > 1"),
        subroots.select(F.lit(TOP).alias("tree"), "digest").limit(1 if groups == 1 else 0),
    )
    root = top_root.select(hex_text(F.col("digest")).alias("root")).head()

    # Where a group's root hangs in the tree over the groups; nowhere if there is one group only.
    hangs = subroots.select(
        "tree",
        F.col("digest").alias("subroot"),
        F.when(F.lit(groups > 1), node_name(F.lit(TOP), F.lit(1), F.floor(F.col("place") / ARITY))).alias("top"),
        F.when(F.lit(groups > 1), F.col("place") % ARITY).alias("top_place"),
    )
    own = nodes.join(hangs, "tree")
    whole = own.select("node", F.coalesce("parent", "top").alias("parent"), F.when(F.col("parent").isNull(), F.col("top_place")).otherwise(F.col("at")).alias("at"), "body")
    above = top_nodes.select("node", "parent", F.when(F.col("parent").isNotNull(), F.col("at")).alias("at"), "body")
    nodes = written(whole.unionByName(above), "merkle-nodes")
    return Manifest(_anchors(runs, sizes, hangs), nodes, root["root"] if root else None)


def node_name(tree: Column, level: Column, index: Column) -> Column:
    return F.concat_ws("|", tree, level.cast("string"), index.cast("string"))


def _joined(column: str, field: str) -> Column:
    """The digests of at most 16 children, one behind the other."""
    return F.aggregate(column, F.lit(b""), lambda all_, one: F.concat(all_, one.getField(field)))


def _levels(bodies: DataFrame, lone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The root of every tree ``(tree, digest)``, and all nodes ``(tree, node, parent, at, body)``.

    ``bodies``: the lowest nodes ``(tree, run, n, body)`` with the number of things below; each turn of the loop is one level,
    so there are as many as the logarithm of the largest tree.
    """
    nodes, roots, level = [], [lone], 1
    bodies = bodies.withColumn("n", _fewer(F.col("n")))
    while True:
        now = written(bodies.withColumn("digest", digest(hex_text(F.col("body")))), "merkle-level")
        more = F.col("n") > 1
        up = F.floor(F.col("run") / ARITY)
        nodes.append(
            now.select(
                "tree", node_name(F.col("tree"), F.lit(level), F.col("run")).alias("node"),
                F.when(more, node_name(F.col("tree"), F.lit(level + 1), up)).alias("parent"), (F.col("run") % ARITY).alias("at"), "body",
            )
        )
        roots.append(now.where(~more).select("tree", "digest"))
        if now.where(more).isEmpty():
            break
        members = F.sort_array(F.collect_list(F.struct("run", "digest")))
        bodies = now.where(more).groupBy("tree", up.alias("up"), "n").agg(members.alias("members"))
        bodies = bodies.select("tree", F.col("up").alias("run"), _fewer(F.col("n")).alias("n"), _joined("members", "digest").alias("body"))
        level += 1
    return _union(roots), _union(nodes)


def _fewer(n: Column) -> Column:
    return F.ceil(n / ARITY)


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    all_ = tables[0]
    for one in tables[1:]:
        all_ = all_.unionByName(one)
    return all_


def _anchors(runs: DataFrame, sizes: DataFrame, hangs: DataFrame) -> DataFrame:
    """Where the climb of each run begins: ``(members, subroot, single, node, up, at)``."""
    single = F.col("n") == 1
    return runs.join(sizes, "tree").join(hangs, "tree").select(
        "members",
        "subroot",
        # The only leaf of its group hangs in the tree over the groups itself.
        F.when(single, F.col("top")).otherwise(node_name(F.col("tree"), F.lit(1), F.col("run"))).alias("up"),
        F.when(single, F.col("top_place")).alias("at"),
        single.alias("single"),
    )


def beside(body: Column, place: Column) -> tuple[Column, Column]:
    """The digests left and right of a place in a row of digests."""
    start = (place * WIDTH).cast("int")
    return F.substring(body, F.lit(1), start), F.substring(body, start + WIDTH + 1, F.lit(ARITY * WIDTH))


CLIMB = f"""
WITH RECURSIVE climb (members, subroot, folded, siblings, up, at) AS (
  SELECT members, subroot, folded, siblings, up, at FROM {{anchor}}
  UNION ALL
  SELECT climb.members, climb.subroot,
         transform(climb.folded, (x, i) -> unhex(sha2(lower(hex(concat(
           substring(nodes.body, 1, {WIDTH} * coalesce(climb.at, i)), x, substring(nodes.body, {WIDTH} * coalesce(climb.at, i) + {WIDTH + 1})))), 256))),
         concat(climb.siblings, CASE WHEN climb.at IS NULL THEN X'' ELSE
           concat(substring(nodes.body, 1, {WIDTH} * climb.at), substring(nodes.body, {WIDTH} * climb.at + {WIDTH + 1})) END),
         nodes.parent, nodes.at
  FROM climb JOIN {{nodes}} AS nodes ON climb.up = nodes.node)
SELECT members, subroot, folded, siblings FROM climb WHERE up IS NULL
"""


@contextmanager
def _any_number_of_rows(spark: SparkSession) -> Iterator[None]:
    """Spark stops a recursion at a million rows unless told otherwise; its depth stays limited."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def climb(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """One row per leaf: ``key, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as hex text.

    ``proof_sha256`` is the digest of all siblings from the run to the root, left to right; a row without siblings has the
    digest of nothing.  ``folded_root`` is what the row as it was found leads to, ``verified`` whether that is the root.
    A table without rows gives none.
    """
    spark = manifest.nodes.sparkSession
    folded = F.transform("members", lambda m: F.coalesce(m.getField("found"), m.getField("leaf")))
    # Nothing is null here, but the recursion's columns must be allowed to be.
    anchor = manifest.runs.select(
        "members", "subroot", folded.alias("folded"), F.lit(b"").alias("siblings"), "up", F.col("at").cast("int").alias("at")
    )
    nodes = manifest.nodes.select("node", "parent", F.col("at").cast("int").alias("at"), "body")
    with _any_number_of_rows(spark):
        tops = written(spark.sql(CLIMB, anchor=anchor, nodes=nodes), "merkle-climb")
    each = tops.select(
        "subroot", "siblings", _joined("members", "leaf").alias("body"),
        F.posexplode(F.arrays_zip("members", "folded")).alias("i", "m"),
    )
    left, right = beside(F.col("body"), F.col("i"))
    folded_root = hex_text(F.col("m.folded"))
    return each.select(
        F.col("m.members.key").alias(key),
        hex_text(F.col("m.members.leaf")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(hex_text(F.concat(left, right, "siblings")), 256).alias("proof_sha256"),
        folded_root.alias("folded_root"),
        (folded_root == F.lit(manifest.root)).alias("verified"),
    )
