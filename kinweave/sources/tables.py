"""Graph tables, manifests and other state on shared storage."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.graph import CodeGraph
from kinweave.operators.lookup import RULE_MARKER
from kinweave.session import materialize
from kinweave.sources.files import DEFAULT_EXCLUDES, list_tree, qualified, read_sources
from kinweave.sources.versions import Versions, bucket_of

_STATE_BUCKETS = 16
# The key each edge or node table is mostly joined on.
BUCKET_KEYS = {
    "symbols": "id", "files": "id", "records": "id", "contains": "dst",
    "calls": "src", "extends": "src", "about": "dst", "supersedes": "src",
}


def save_graph(graph: CodeGraph, path: str) -> None:
    """Write the graph tables below ``path``, a new folder per build.

    Readers of an earlier build keep their files; nothing is overwritten.
    """
    for name, df in graph.tables().items():
        df.write.parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> CodeGraph:
    """Read the tables below ``path``; a missing table is empty, a missing column null."""
    found = {}
    for name in schema.TABLES:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return CodeGraph.from_tables(spark, **found)


def save_bucketed(graph: CodeGraph, database: str, buckets: int) -> None:
    """Catalog tables bucketed on their join keys, so traversals join without moving edges."""
    for name, df in graph.tables().items():
        key = BUCKET_KEYS[name]
        df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")


def load_bucketed(spark: SparkSession, database: str) -> CodeGraph:
    return CodeGraph.from_tables(
        spark,
        **{n: spark.table(f"{database}.{n}") for n in schema.TABLES if spark.catalog.tableExists(f"{database}.{n}")},
    )


def load_state(spark: SparkSession, path: str, layout: schema.T.StructType) -> DataFrame:
    """A state table (reported drift, build marker); empty when it was never written. What cannot be read is an error."""
    return Versions(spark, path).read("state", layout)


def save_state(df: DataFrame, path: str) -> None:
    """Replace a state table by its next version; readers keep the one they have. The new rows may derive from the old ones."""
    versions = Versions(df.sparkSession, path)
    versions.commit({"state": (df.withColumn("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(_STATE_BUCKETS))), None)}, versions.latest())
    versions.vacuum(keep=2)


def publish_graph(graph: CodeGraph, path: str, buckets: int = 64) -> int:
    """The number of the version of the graph that is written below ``path``."""
    versions = Versions(graph.spark, path)
    tables = {n: (df.withColumn("bucket", bucket_of(F.col(BUCKET_KEYS[n]), buckets)), None) for n, df in graph.tables().items()}
    return versions.commit(tables, versions.latest())


def open_graph(spark: SparkSession, path: str, number: int | None = None) -> CodeGraph:
    """A version of a published graph, the latest by default."""
    versions = Versions(spark, path)
    return CodeGraph.from_tables(spark, **{n: versions.read(n, layout, number) for n, layout in schema.TABLES.items()})


def drop_graphs(spark: SparkSession, path: str, keep: int = 0, older_than: float = 86_400) -> list[str]:
    """Delete published versions but the last ``keep`` (all of them at once by default)."""
    versions = Versions(spark, path)
    if keep:
        return versions.vacuum(keep, older_than)
    versions.drop()
    return [path]


def write_rules(documents: DataFrame, path: str) -> None:
    """One file per rule in ``path``; generated rules that are no longer produced are removed, other files stay.

    A rule's lines are sorted in its task and streamed to a file that takes its
    final name at the end, so a reader never sees half a rule.
    """
    spark = documents.sparkSession
    uri = qualified(spark, path)
    order = ["rule_file", "file", "priority", "id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        rows = ((r["rule_file"], r["line"]) for batch in batches for r in batch.to_pylist())
        for name, lines in groupby(rows, key=itemgetter(0)):
            attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(attempt) as out:
                for _, line in lines:
                    out.write(f"{line}\n".encode())
            store.move(attempt, f"{base}/{name}")
            yield pa.record_batch([pa.array([name])], names=["rule_file"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store.delete_file(f"{base}/{name}")
            yield batch

    placed = documents.repartition("rule_file").sortWithinPartitions(*order).select("rule_file", "line")
    written = materialize(placed.mapInArrow(write, "rule_file string"), "rules")
    listed = list_tree(spark, path).filter((F.instr("path", "/") == 0) & F.endswith(F.col("path"), F.lit(".mdc")))
    existing = read_sources(spark, path, listed).select(F.col("file_path").alias("rule_file"), F.col("text").alias("body"))
    materialize(stale_rules(existing, written).mapInArrow(remove, "rule_file string"), "removed-rules")


def stale_rules(existing: DataFrame, current: DataFrame) -> DataFrame:
    """Generated rules that are no longer produced; a hand-written file never qualifies.

    ``existing`` has ``(rule_file, body)``, ``current`` has ``rule_file``.
    """
    return (
        existing.filter(F.contains("body", F.lit(RULE_MARKER)))
        .join(current.select("rule_file").distinct(), "rule_file", "left_anti")
        .select("rule_file")
    )


# The accepted notification modes.
NOTIFY_MODES = ("all", "inferred", "never")


@dataclass
class Config:
    include: list[str] = field(default_factory=lambda: ["src"])
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    languages: list[str] = field(default_factory=lambda: ["typescript"])
    notify: str = "inferred"

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Missing keys and unknown modes fall back to the defaults; so does unreadable text."""
        base = cls()
        try:
            raw = json.loads(text)
            scan, notify = raw.get("analyze") or {}, (raw.get("knowledge") or {}).get("notify")
        except (ValueError, AttributeError):
            return base
        return cls(
            include=scan.get("include", base.include),
            exclude=scan.get("exclude", base.exclude),
            languages=scan.get("languages", base.languages),
            notify=notify if notify in NOTIFY_MODES else base.notify,
        )

    def to_json(self) -> str:
        scan = {k: v for k, v in asdict(self).items() if k != "notify"}
        return json.dumps({"analyze": scan, "knowledge": {"notify": self.notify}}, indent=2)
