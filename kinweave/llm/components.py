"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import materialize


def _roots(points: DataFrame) -> DataFrame:
    """Follow ``(node, to)`` to the end, doubling the step each time; every ``to`` is a node and not above its own."""
    while True:
        ahead = points.select(F.col("node").alias("to"), F.col("to").alias("far"))
        points = materialize(
            points.join(ahead, "to").select("node", F.col("far").alias("to"), (F.col("far") < F.col("to")).alias("moved")), "labels"
        )
        moved = points.filter("moved").limit(1).count()
        points = points.select("node", "to")
        if not moved:
            return points


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of edges ``(u, v)``, both long; a component is its smallest node.

    Every round points each node to its smallest neighbour (or itself), follows
    the pointers to their ends and contracts the edges onto these. Each node
    that still has an edge is merged, so nodes at least halve per round and
    edges are joined about twice in all. Every step is stored.
    """
    live = materialize(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while labels is None or live.limit(1).count():
        both = live.unionAll(live.select("v", "u"))
        points = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("to")), "labels")
        ends = _roots(points)
        if labels is None:
            labels = ends.select("node", F.col("to").alias("component"))
        else:
            of = ends.select(F.col("node").alias("component"), "to")
            labels = materialize(labels.join(of, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        start, end = (ends.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("u", "v"))
        moved = live.join(start, "u").join(end, "v").filter("u_to <> v_to")
        live = materialize(moved.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).distinct(), "edges")
    return labels
