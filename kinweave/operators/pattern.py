"""Graph patterns as DataFrame steps.

Each function adds one pattern element to a binding table, whose columns are
named ``<variable>_<property>``; predicates, projections, aggregates, ordering
and limits are the ordinary DataFrame methods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.graph import CodeGraph
from kinweave.operators.traverse import reach

_LABELS = {"CodeSymbol": "symbols", "File": "files", "Record": "records"}
# Relationship type -> (table, source label column or label, target label column or label)
_RELS = {
    "CONTAINS": ("contains", "src_label", "CodeSymbol"),
    "CALLS": ("calls", "CodeSymbol", "CodeSymbol"),
    "EXTENDS": ("extends", "CodeSymbol", "CodeSymbol"),
    "ABOUT": ("about", "Record", "dst_label"),
    "SUPERSEDES": ("supersedes", "Record", "Record"),
}


def nodes(graph: CodeGraph, var: str, label: str | None = None, **equals: object) -> DataFrame:
    """``(var:label {prop: value})``. Without a label: all node tables, missing properties null."""
    if label is not None:
        table = getattr(graph, _LABELS[label])
    else:
        table = graph.symbols.unionByName(graph.files, allowMissingColumns=True).unionByName(
            graph.records, allowMissingColumns=True
        )
    for prop, value in equals.items():
        table = table.filter(F.col(prop) == F.lit(value))
    return table.select(*[F.col(c).alias(f"{var}_{c}") for c in table.columns])


def edges(graph: CodeGraph, var: str, rel: str) -> DataFrame:
    """``()-[var:rel]->()``: the edge table itself, no node join."""
    table = getattr(graph, _RELS[rel][0])
    return table.select(*[F.col(c).alias(f"{var}_{c}") for c in table.columns])


def expand(
    bindings: DataFrame,
    graph: CodeGraph,
    source: str,
    rel: str,
    target: DataFrame,
    var: str,
    *,
    reverse: bool = False,
    how: str = "inner",
) -> DataFrame:
    """``(source)-[:rel]->(var)`` where ``target`` is a :func:`nodes` table for ``var``.

    ``reverse`` follows the edge backwards; ``how="left"`` is an optional match.
    """
    edge = edges(graph, "_e", rel)
    near, far = ("_e_dst", "_e_src") if reverse else ("_e_src", "_e_dst")
    hop = edge.join(target, edge[far] == target[f"{var}_id"])
    return bindings.join(hop, bindings[f"{source}_id"] == hop[near], how).drop("_e_src", "_e_dst")


def expand_var(
    bindings: DataFrame, graph: CodeGraph, source: str, rel: str, target: DataFrame, var: str, max_hops: int
) -> DataFrame:
    """``(source)-[:rel*1..max_hops]->(var)``, each pair once at its minimum depth."""
    seeds = bindings.select(F.col(f"{source}_id").alias("seed"))
    found = reach(getattr(graph, _RELS[rel][0]), seeds, max_hops, include_seed=True)
    hop = found.join(target, found["node"] == target[f"{var}_id"]).drop("node")
    return (
        bindings.join(hop, bindings[f"{source}_id"] == hop["seed"])
        .drop("seed")
        .withColumnRenamed("depth", f"{var}_depth")
    )


def where_not_exists(
    bindings: DataFrame, graph: CodeGraph, var: str, rel: str, *, incoming: bool = True
) -> DataFrame:
    """``NOT EXISTS { ()-[:rel]->(var) }`` (or outgoing), as an anti join."""
    table = getattr(graph, _RELS[rel][0])
    touched = table.select(F.col("dst" if incoming else "src").alias("_touched"))
    return bindings.join(touched, bindings[f"{var}_id"] == touched["_touched"], "left_anti")
