"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import discard
from vecloom.session import written


def _least(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours; counted on the map side, so a hub is one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The row of the smallest neighbour itself becomes the node's own link to it.
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return down.join(_least(down), "u").select(moved.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _edges(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def contracted(links: DataFrame, label: str = "contracted") -> DataFrame:
    """``links`` (a, b) -> as many or fewer links (a, b) of the same components, nearer to stars by one round."""
    return written(_small(_large(_edges(links))).select(F.col("u").alias("a"), F.col("v").alias("b")), label)


def parents(links: DataFrame) -> DataFrame:
    """``links`` of ``contracted`` -> (node, root): some smaller node of the same component; a node without one is absent.

    Nodes of one root hang together.  Nodes that hang together may still have several roots.
    """
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``links`` (a, b) -> (node, root): the smallest node that links reach, for every node that is in a link.

    Each round is a written table, so a lost executor costs one round.  Rows with a null end, and links of a node
    with itself, are left out.
    """
    edges = written(_edges(links).distinct(), label)
    before = _state(edges)
    while before[0]:
        last, edges = edges, written(_small(_large(edges)), label)
        discard(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
