"""Turn parsed records into graph rows: nodes, ABOUT and SUPERSEDES edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.functions.paths import ancestor_dirs, extension, has_fqn
from kinweave.functions.records import parse_ts, provenance_kind
from kinweave.graph import CodeGraph
from kinweave.session import placed


@dataclass(frozen=True)
class RecordIndex:
    records: DataFrame
    about: DataFrame
    supersedes: DataFrame
    unresolved: DataFrame  # (record_id, subject) of live records only
    anchors: DataFrame  # File rows for subjects on disk that were never analysed


def with_liveness(records: DataFrame) -> DataFrame:
    """Add ``live``: no record names this id in ``ss``."""
    superseded = (
        records.filter(F.col("ss").isNotNull() & (F.col("ss") != ""))
        .select(F.col("ss").alias("id"))
        .distinct()
        .withColumn("dead", F.lit(True))
    )
    return records.join(placed(superseded), "id", "left").withColumn("live", F.col("dead").isNull()).drop("dead")


def record_nodes(records: DataFrame) -> DataFrame:
    """Wire keys to graph columns."""
    live = with_liveness(records)
    return live.select(
        "id",
        F.col("kn").alias("kind"),
        F.col("cl").alias("claim"),
        F.col("bc").alias("because"),
        F.col("gv").alias("given"),
        F.col("wn").alias("when_"),
        F.col("tn").alias("then_"),
        F.col("rf").alias("ref"),
        F.col("pv").alias("provenance"),
        provenance_kind(F.col("pv")).alias("provenance_kind"),
        parse_ts(F.col("ts")).alias("ts"),
        "live",
    )


def disk_entries(listing: DataFrame) -> DataFrame:
    """Files of a listing plus every directory above them, as ``(path, kind)``."""
    files = listing.select("path", F.lit("other").alias("kind"))
    dirs = listing.select(F.explode(ancestor_dirs(F.col("path"))).alias("path")).distinct()
    return files.unionByName(dirs.withColumn("kind", F.lit("dir")))


def _targets(graph: CodeGraph, listing: DataFrame | None) -> DataFrame:
    """``(target, rank, kind)``: one row per id, symbols before files before disk entries."""
    known = graph.symbols.select(F.col("id").alias("target"), F.lit(0).alias("rank"), F.lit("symbol").alias("kind"))
    files = graph.files.select(F.col("id").alias("target"), F.lit(1).alias("rank"), F.lit("file").alias("kind"))
    known = known.unionByName(files)
    if listing is not None:
        on_disk = disk_entries(listing).filter(~has_fqn(F.col("path")))
        known = known.unionByName(on_disk.select(F.col("path").alias("target"), F.lit(2).alias("rank"), "kind"))
    return known.groupBy("target").agg(F.min(F.struct("rank", "kind")).alias("best"))


def index_records(graph: CodeGraph, records: DataFrame, listing: DataFrame | None = None) -> RecordIndex:
    """Anchor records to the graph.

    A subject resolves to a symbol, else to a file node, else to a file or
    directory of ``listing`` (columns ``path``). What resolves to nothing is
    reported for live records and never becomes a node.
    """
    nodes = record_nodes(records)
    subjects = with_liveness(records).select(
        F.col("id").alias("record_id"), "live", F.explode("sb").alias("subject")
    )
    resolved = subjects.join(
        placed(_targets(graph, listing)), F.col("subject") == F.col("target"), "left"
    )
    about = resolved.filter("target IS NOT NULL").select(
        F.col("record_id").alias("src"),
        F.col("target").alias("dst"),
        F.when(F.col("best.rank") == 0, "CodeSymbol").otherwise("File").alias("dst_label"),
    )
    unresolved = resolved.filter("target IS NULL AND live").select("record_id", "subject")
    anchors = (
        resolved.filter("best.rank = 2")
        .select(
            F.col("target").alias("id"),
            F.col("target").alias("path"),
            F.when(F.col("best.kind") == "dir", "").otherwise(extension(F.col("target"))).alias("ext"),
            F.col("best.kind").alias("kind"),
        )
        .distinct()
    )
    newer = records.filter("ss <> ''").select(F.col("id").alias("src"), "ss")
    supersedes = newer.join(
        placed(records.select(F.col("id").alias("dst"))), F.col("ss") == F.col("dst")
    ).select("src", "dst")
    return RecordIndex(nodes, about, supersedes, unresolved, anchors)


def apply_index(graph: CodeGraph, index: RecordIndex) -> CodeGraph:
    """The graph with its record side replaced; anchors of the previous index go."""
    files = graph.files.filter(~F.col("kind").isin("dir", "other"))
    return graph.with_tables(
        records=index.records,
        about=index.about,
        supersedes=index.supersedes,
        files=files.unionByName(schema.conform(index.anchors, schema.FILES)),
    )


def index_stats(index: RecordIndex) -> DataFrame:
    """``(metric, value)`` of one indexing run."""

    def count(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value")

    return (
        count(index.records, "records")
        .unionByName(count(index.records.filter("live"), "live"))
        .unionByName(count(index.about, "about"))
        .unionByName(count(index.supersedes, "supersedes"))
        .unionByName(count(index.unresolved, "unresolved"))
    )
