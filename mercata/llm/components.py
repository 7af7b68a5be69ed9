"""Connected components of an edge table, without collecting any of it.

Contraction: every vertex takes the smallest vertex within two edges, chains
of such steps are followed to their ends by doubling, and the edges go on
between the ends until none is left.  Ends lie more than two edges apart, so
each round leaves at most half of the vertices.  A round is two grouped minima
with partial aggregation and equi-joins that adaptive execution can split, so
one huge component or hub is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def moved(rows: DataFrame, column: str, label: DataFrame) -> DataFrame:
    """``rows`` with the vertices of ``column`` replaced by their components."""
    to = label.select(F.col("vertex").alias("_vertex"), F.col("component").alias("_component"))
    joined = rows.join(to, F.col(column) == F.col("_vertex"), "left")
    return joined.select(*(F.coalesce("_component", c).alias(c) if c == column else c for c in rows.columns))


def _two_edges(edges: DataFrame) -> DataFrame:
    """(vertex, component): vertices with a smaller one within two edges, and
    the end of the chain of smallest ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    step = cut(both.join(least, "a").groupBy(F.col("b").alias("vertex")).agg(F.min("m").alias("component")).where("component < vertex"))
    while not step.join(step.select(F.col("vertex").alias("component")), "component", "left_semi").isEmpty():
        step = cut(moved(step, "component", step))
    return step


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): every vertex of an edge (a, b) that is not the
    smallest of its component, with that smallest vertex."""
    edges = cut(edges.where("a <> b").select("a", "b"))
    label = None
    while True:
        step = _two_edges(edges)
        label = step if label is None else cut(moved(label, "component", step).unionByName(step))
        edges = cut(moved(moved(edges, "a", step), "b", step).where("a <> b"))
        if edges.isEmpty():
            return label
