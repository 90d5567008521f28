"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of ``links`` (a, b: longs).

    Alternates large-star and small-star steps: every node's links are moved to the smallest node it sees, which
    halves distances at least, so rounds grow with the logarithm of the longest chain. Each round is written to the
    shared folder, which cuts the lineage; the driver only compares counts. A node with a third of all links is
    summed on the map side and joined back under adaptive skew handling.

    Links with a null end or from a node to itself are ignored; repeated links count once; no links, no rows.
    """
    edges = _directed(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    edges = materialize(edges, "links")
    seen = None
    while True:
        large = _to_smallest(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger_only=True)
        small = materialize(_directed(_to_smallest(large, larger_only=False)), "links")
        state = small.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum("b")).first()
        if state == seen:
            break
        edges, seen = small, state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)


def _directed(links: DataFrame) -> DataFrame:
    """Every link once, from its larger to its smaller node."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _to_smallest(links: DataFrame, larger_only: bool) -> DataFrame:
    """Neighbours of a node (a) moved to the smallest of the node and its neighbours.

    ``larger_only`` keeps the links to neighbours above the node (large-star over links in both directions);
    otherwise links go downwards only and the node itself is moved as well (small-star).
    """
    lowest = links.groupBy(F.col("a").alias("at")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = links.join(lowest, F.col("a") == F.col("at"))
    if larger_only:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        lowest.select(F.col("at").alias("a"), F.col("m").alias("b"))
    )
