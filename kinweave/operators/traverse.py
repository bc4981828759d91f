"""Call and inheritance traversal over edge tables.

Seeds are a DataFrame with one column ``seed``, so one job answers the question
for one symbol or for a million.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.graph import CodeGraph
from kinweave.session import materialize, placed

# Default and largest depth of a call walk, and the hop bound of
# an inheritance walk.
DEFAULT_DEPTH = 3
MAX_DEPTH = 10
MAX_SUPERTYPE_HOPS = 20

NODE_COLUMNS = ("id", "fqn", "file_path", "symbol_type")


def clamp_depth(depth: float) -> int:
    return max(1, min(MAX_DEPTH, int(depth // 1)))


def _describe(graph: CodeGraph, hits: DataFrame, columns: tuple[str, ...] = NODE_COLUMNS) -> DataFrame:
    """Attach symbol columns to rows that carry a ``node``."""
    extra = [c for c in hits.columns if c not in ("seed", "node")]
    nodes = graph.symbols.select(*[F.col(c) for c in columns])
    return hits.join(nodes, hits["node"] == nodes["id"]).select("seed", *columns, *extra)


def get_callers(graph: CodeGraph, seeds: DataFrame) -> DataFrame:
    """Distinct direct callers of each seed."""
    hits = graph.calls.join(seeds, graph.calls["dst"] == seeds["seed"], "left_semi")
    return _describe(graph, hits.select(F.col("dst").alias("seed"), F.col("src").alias("node")).distinct())


def get_callees(graph: CodeGraph, seeds: DataFrame) -> DataFrame:
    """Distinct direct callees of each seed."""
    hits = graph.calls.join(seeds, graph.calls["src"] == seeds["seed"], "left_semi")
    return _describe(graph, hits.select(F.col("src").alias("seed"), F.col("dst").alias("node")).distinct())


def unresolved_of(graph: CodeGraph, seeds: DataFrame) -> DataFrame:
    """How many calls of each seed could not be linked; 0 for an unknown seed."""
    counts = graph.symbols.select("id", "unresolved_calls")
    return seeds.join(counts, seeds["seed"] == counts["id"], "left").select(
        "seed", F.coalesce("unresolved_calls", F.lit(0)).cast("bigint").alias("unresolved_calls")
    )


def reach(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None,
    *,
    with_path: bool = False,
    include_seed: bool = False,
) -> DataFrame:
    """Every node within ``max_depth`` hops of each seed, at its minimum depth; None walks until nothing is new.

    Returns ``(seed, node, depth[, path])``. One equi-join per level expands all
    seeds at once; candidates are reduced to one row per (seed, node) before the
    visited rows are anti-joined away. Each level is written to the shared
    folder, so the plan never grows, a lost executor costs one level at most, and
    a small frontier is broadcast because its size is known. A hub that holds
    many edges is one key of an inner join, which adaptive execution splits.

    ``edges`` is scanned once per level and should be a stored table; one that is
    bucketed on ``src`` is joined without being moved. Parallel edges are harmless.

    With ``with_path`` the lexicographically smallest shortest path is kept;
    since all paths of a level have equal length, it is found level by level.
    ``include_seed`` lets a cycle report the seed itself.
    """
    edges = edges.select("src", "dst")
    start = seeds.select("seed").distinct().withColumn("node", F.col("seed"))
    if with_path:
        start = start.withColumn("path", F.array("seed"))
    frontier = materialize(start, "frontier")
    keep = ["seed", "node", "path"] if with_path else ["seed", "node"]

    levels: list[DataFrame] = []
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"])
        if with_path:
            found = (
                step.select("seed", F.col("dst").alias("node"), F.col("path").alias("prefix"))
                .groupBy("seed", "node")
                .agg(F.min("prefix").alias("prefix"))
                .select("seed", "node", F.concat("prefix", F.array("node")).alias("path"))
            )
        else:
            found = step.select("seed", F.col("dst").alias("node")).distinct()
        if not include_seed:
            found = found.filter(F.col("node") != F.col("seed"))
        if levels:
            seen = reduce(DataFrame.unionByName, [level.select("seed", "node") for level in levels])
            found = found.join(placed(seen), ["seed", "node"], "left_anti")
        frontier = materialize(found.select(*keep, F.lit(depth).alias("depth")), f"level{depth}")
        if frontier.isEmpty():
            break
        levels.append(frontier)

    out = reduce(DataFrame.unionByName, levels or [frontier])
    return out.select("seed", "node", "depth", *(["path"] if with_path else []))


def get_impact(
    graph: CodeGraph, seeds: DataFrame, depth: float = DEFAULT_DEPTH, *, with_path: bool = True
) -> DataFrame:
    """What each seed reaches through calls, with depth and one shortest path."""
    return _describe(graph, reach(graph.calls, seeds, clamp_depth(depth), with_path=with_path))


def get_callers_transitive(
    graph: CodeGraph, seeds: DataFrame, depth: float = DEFAULT_DEPTH, *, with_path: bool = True
) -> DataFrame:
    """What reaches each seed through calls; paths run from the seed outward."""
    reverse = graph.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _describe(graph, reach(reverse, seeds, clamp_depth(depth), with_path=with_path))


def get_supertypes(graph: CodeGraph, seeds: DataFrame) -> DataFrame:
    """Distinct transitive supertypes; a cycle may report the seed itself."""
    found = reach(graph.extends, seeds, MAX_SUPERTYPE_HOPS, include_seed=True)
    return _describe(graph, found.select("seed", "node"), ("id", "fqn", "symbol_type"))
