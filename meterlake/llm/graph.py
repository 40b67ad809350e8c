"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _resolved(pointers: DataFrame, written) -> DataFrame:
    """(node, to) with to < node, followed to the end; each pass halves the depth."""
    pointers = written(pointers, "pointers")
    while True:
        ahead = pointers.select(F.col("node").alias("to"), F.col("to").alias("further"))
        if pointers.join(ahead, "to", "left_semi").isEmpty():
            return pointers
        pointers = written(pointers.join(ahead, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "pointers")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node of the component; only for nodes that aren't roots.

    Every node points to its smallest smaller neighbour, pointers are followed to their ends, and
    links between the ends are the next round's. Nothing is gathered but whether links are left.
    scratch: where the tables on the way are noted.
    """
    written = (scratch or Scratch(links.sparkSession)).written
    edge = lambda d: d.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, out = written(edge(links), "links"), None
    while not links.isEmpty():
        to = _resolved(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), written)
        if out is None:
            out = to.select("node", F.col("to").alias("root"))
        else:
            moved = out.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            out = written(moved.unionByName(to.select("node", F.col("to").alias("root"))), "roots")
        for end in ("a", "b"):
            links = links.join(to.select(F.col("node").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = written(edge(links), "links")
    return out if out is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
