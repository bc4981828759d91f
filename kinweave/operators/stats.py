"""Counts over the graph and the checks built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.graph import CodeGraph


def graph_stats(graph: CodeGraph) -> DataFrame:
    """``(metric, value)``: nodes per label, live records, edges per counted type."""
    counted = {
        "symbols": graph.symbols,
        "files": graph.files,
        "records": graph.records,
        "live_records": graph.records.filter("live"),
        "CONTAINS": graph.contains,
        "CALLS": graph.calls,
        "ABOUT": graph.about,
        "SUPERSEDES": graph.supersedes,
    }
    rows = [
        df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        for name, df in counted.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def status_totals(graph: CodeGraph) -> DataFrame:
    """Node and edge totals next to the non-zero single counts."""
    stats = graph_stats(graph)
    group = (
        F.when(F.col("metric").isin("symbols", "files", "records"), "nodes")
        .when(F.col("metric") != "live_records", "edges")
    )
    totals = (
        stats.withColumn("metric", group)
        .filter(F.col("metric").isNotNull())
        .groupBy("metric")
        .agg(F.sum("value").alias("value"))
    )
    return stats.filter("value > 0").unionByName(totals)


def stale_graph(graph: CodeGraph, log_records: DataFrame) -> DataFrame:
    """One row: records on disk, records in the graph, and whether the graph lags.

    An empty answer from a graph that holds no records while the log has some is
    stale data, not an empty knowledge base.
    """
    on_disk = log_records.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit("disk").alias("side"))
    indexed = graph.records.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit("graph").alias("side"))
    counts = on_disk.unionByName(indexed).agg(
        F.sum(F.when(F.col("side") == "disk", F.col("n"))).alias("on_disk"),
        F.sum(F.when(F.col("side") == "graph", F.col("n"))).alias("indexed"),
    )
    return counts.withColumn("stale", (F.col("indexed") == 0) & (F.col("on_disk") > 0))


def build_skew(running: str, graph_build: str | None) -> dict[str, object]:
    """Compare the build that answers with the build that wrote the graph."""
    out: dict[str, object] = {"running": running, "graph": graph_build, "in_sync": None, "advice": None}
    if graph_build is None or "unknown" in (running, graph_build):
        return out
    out["in_sync"] = running == graph_build
    if not out["in_sync"]:
        newer_graph = running.isdigit() and graph_build.isdigit() and int(graph_build) > int(running)
        out["advice"] = "restart this session" if newer_graph else "rebuild the graph"
    return out
