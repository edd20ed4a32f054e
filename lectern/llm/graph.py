"""Connected components of an edge table, in rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.storage import written


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex of the (a, b) rows.

    Each round hooks every vertex to its smallest neighbour, follows that one step further, and contracts the edges;
    rounds go on until no edge is left. All sides are tables of the shared folder, none is broadcast by force.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mapping = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        hooked = written(hooked, "hooked")
        upper = hooked.select(F.col("v").alias("p"), F.col("p").alias("root"))
        roots = written(hooked.join(upper, "p").select("v", "root"), "roots")
        if mapping is None:
            mapping = roots.select(F.col("v").alias("vertex"), F.col("root").alias("component"))
        else:
            step = roots.select(F.col("v").alias("component"), "root")
            mapping = mapping.join(step, "component", "left").select("vertex", F.coalesce("root", "component").alias("component"))
        mapping = written(mapping, "components")
        moved = links.join(roots.select(F.col("v").alias("a"), F.col("root").alias("x")), "a")
        moved = moved.join(roots.select(F.col("v").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        links = written(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    if mapping is None:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return mapping
