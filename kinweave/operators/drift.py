"""Integrity of records against the graph, the working tree and staged changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.paths import relative_path
from kinweave.functions.records import provenance_pointer
from kinweave.functions.text import is_local_ref
from kinweave.graph import CodeGraph
from kinweave.operators.records import disk_entries
from kinweave.sources.record_log import live_records

# Fixed value: how many entries a notice lists before it only counts.
PREVIEW = 3


@dataclass(frozen=True)
class DriftReport:
    unresolved: DataFrame  # (record_id, subject, claim)
    missing_refs: DataFrame  # (record_id, ref, claim): soft, documents may move
    fabricated_refs: DataFrame  # (record_id, pointer, claim): hard, a cited source is not there
    invalid: DataFrame  # (line, id, message)


def drift_report(graph: CodeGraph, log: DataFrame, errors: DataFrame, listing: DataFrame) -> DriftReport:
    """Check live records of the log, not of the graph, so a stale graph cannot hide drift.

    ``listing`` holds the paths of the working tree; existence is a join against
    it, which gives every executor the same answer.
    """
    live = live_records(log)
    known = graph.symbols.select(F.col("id").alias("subject")).unionByName(
        graph.files.select(F.col("id").alias("subject"))
    )
    unresolved = (
        live.select(F.col("id").alias("record_id"), F.explode("sb").alias("subject"), F.col("cl").alias("claim"))
        .join(known, "subject", "left_anti")
        .select("record_id", "subject", "claim")
    )
    on_disk = disk_entries(listing).select(F.col("path").alias("on_disk"))
    refs = live.filter((F.col("rf") != "") & is_local_ref(F.col("rf"))).select(
        F.col("id").alias("record_id"), F.col("rf").alias("ref"), F.col("cl").alias("claim")
    )
    missing = refs.join(on_disk, relative_path(F.col("ref")) == F.col("on_disk"), "left_anti")
    cited = live.select(
        F.col("id").alias("record_id"), provenance_pointer(F.col("pv")).alias("pointer"), F.col("cl").alias("claim")
    ).filter("pointer IS NOT NULL")
    fabricated = cited.join(on_disk, relative_path(F.col("pointer")) == F.col("on_disk"), "left_anti")
    return DriftReport(unresolved, missing, fabricated, errors)


def drift_keys(report: DriftReport) -> DataFrame:
    """One ``key`` per signal that is shown once per state."""
    drift = report.unresolved.select(F.concat_ws(" ", "record_id", "subject").alias("key"), "record_id")
    pointers = report.fabricated_refs.select(
        F.concat(F.col("record_id"), F.lit(" pv:"), F.col("pointer")).alias("key"), "record_id"
    )
    return drift.unionByName(pointers)


def new_drift(keys: DataFrame, reported: DataFrame) -> DataFrame:
    """Keys the previous run did not report.

    The caller then *replaces* ``reported`` with all current keys, so drift that
    went away and came back is reported again.
    """
    return keys.join(reported.select("key"), "key", "left_anti")


def preview(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first entries to show and a one-row count of the rest."""
    rest = df.agg(F.greatest(F.count("*") - PREVIEW, F.lit(0)).alias("more"))
    return df.orderBy(*order).limit(PREVIEW), rest


def staged_changes(lines: DataFrame) -> DataFrame:
    """Parse name-status lines (column ``value``) into ``(path, change)``.

    Deleted and renamed paths are ``removed`` (for a rename the old path),
    modified ones ``modified``; everything else is ignored.
    """
    parts = F.split(F.trim(F.col("value")), "\t")
    status = F.get(parts, F.lit(0))
    change = F.when((status == "D") | F.startswith(status, F.lit("R")), "removed").when(
        status == "M", "modified"
    )
    return lines.select(F.get(parts, F.lit(1)).alias("path"), change.alias("change")).filter(
        "path <> '' AND change IS NOT NULL"
    )


def staged_check(graph: CodeGraph, changes: DataFrame) -> DataFrame:
    """Live records about changed code: ``removed`` is a violation, ``modified`` a warning."""
    symbols = graph.symbols.select(F.col("id").alias("dst"), F.col("file_path").alias("path"))
    by_symbol = graph.about.join(symbols, "dst").select("src", F.col("dst").alias("subject"), "path")
    by_id = graph.about.select("src", F.col("dst").alias("subject"), F.col("dst").alias("path"))
    touched = by_symbol.unionByName(by_id).join(changes.select("path", "change").distinct(), "path")
    hits = touched.select("src", "subject", "change").distinct()
    live = graph.records.filter("live").select("id", "claim")
    return hits.join(live, F.col("src") == F.col("id")).select(
        F.when(F.col("change") == "removed", "violation").otherwise("warning").alias("severity"),
        F.col("id").alias("record_id"), "subject", "claim",
    )


def manifest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, status)`` with status added, changed or deleted, by modification time."""
    old = previous.select("path", F.col("mtime").alias("old"))
    new = current.select("path", F.col("mtime").alias("new"))
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old") != F.col("new"), "changed")
    )
    return old.join(new, "path", "full_outer").select("path", status.alias("status")).filter("status IS NOT NULL")
