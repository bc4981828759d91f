"""From source text to graph, in full or for the files that changed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.extract import php, python, typescript
from kinweave.extract.facts import Extraction
from kinweave.extract.sql import sql_symbols
from kinweave.functions.paths import extension
from kinweave.graph import CodeGraph
from kinweave.operators import resolve
from kinweave.operators.drift import manifest_diff
from kinweave.operators.records import apply_index, index_records
from kinweave.plans import incremental
from kinweave.session import materialize, placed
from kinweave.sources.files import language_of, list_tree, read_sources, walk
from kinweave.sources.record_log import parse_log, read_log_lines
from kinweave.sources.tables import Config
from kinweave.sources.versions import Versions


def _sql(files: DataFrame) -> Extraction:
    spark = files.sparkSession
    return Extraction(
        materialize(sql_symbols(files), "sql-symbols"),
        schema.empty(spark, schema.CALL_REF),
        schema.empty(spark, schema.INHERITANCE),
        spark.createDataFrame([], "file_path string, error string"),
    )


_EXTRACTORS = {
    "typescript": typescript.extract,
    "php": php.extract,
    "sql": _sql,
    "python": python.extract,
}


def extract_sources(files: DataFrame, languages: list[str] | tuple[str, ...]) -> Extraction:
    """Run each language over its files of ``(file_path, text)``."""
    tagged = files.withColumn("language", language_of(F.col("file_path")))
    parts = [
        _EXTRACTORS[name](tagged.filter(F.col("language") == name).select("file_path", "text"))
        for name in _EXTRACTORS
        if name in languages
    ]
    return reduce(Extraction.union, parts)


@dataclass(frozen=True)
class CodeIndex:
    """Extracted rows, with references as they are written; :func:`link` builds the graph from them."""

    symbols: DataFrame
    refs: DataFrame
    inheritance: DataFrame
    files: DataFrame
    errors: DataFrame


def build_index(files: DataFrame, languages: list[str] | tuple[str, ...]) -> CodeIndex:
    found = extract_sources(files, languages)
    path = F.col("file_path")
    nodes = files.select(
        path.alias("id"), path.alias("path"), extension(path).alias("ext"), F.lit("source").alias("kind")
    )
    return CodeIndex(found.symbols, found.refs, found.inheritance, nodes, found.errors)


def merge_index(old: CodeIndex, changed: CodeIndex, gone: DataFrame) -> CodeIndex:
    """Replace the rows of the ``gone`` paths (changed or deleted) by those of ``changed``."""
    paths = gone.select(F.col("path").alias("file_path"))

    def swap(before: DataFrame, after: DataFrame, key: str = "file_path") -> DataFrame:
        kept = before.join(placed(paths.withColumnRenamed("file_path", key)), key, "left_anti")
        return kept.select(before.columns).unionByName(after)

    return CodeIndex(
        swap(old.symbols, changed.symbols),
        swap(old.refs, changed.refs),
        swap(old.inheritance, changed.inheritance),
        swap(old.files, changed.files, "id"),
        swap(old.errors, changed.errors),
    )


def linked(index: CodeIndex) -> dict[str, DataFrame]:
    """``nodes, contains, calls, extends`` and the ``resolved`` references they come from."""
    symbols = materialize(resolve.dedup_symbols(index.symbols), "symbols")
    extends = materialize(resolve.extends_edges(symbols, index.inheritance), "extends")
    resolved = materialize(resolve.resolve_calls(symbols, index.refs, extends), "resolved")
    return {**incremental.graph_rows(symbols, resolved), "extends": extends, "resolved": resolved}


def link(index: CodeIndex) -> CodeGraph:
    """Deduplicate symbols, then build containment, inheritance and call edges."""
    found = linked(index)
    return CodeGraph.from_tables(
        index.symbols.sparkSession, symbols=found["nodes"], files=index.files, contains=found["contains"], calls=found["calls"], extends=found["extends"]
    )


def index_summary(index: CodeIndex, graph: CodeGraph) -> DataFrame:
    """``(metric, value)`` of one analysis."""
    counted = {
        "files_scanned": index.files,
        "symbols_found": graph.symbols,
        "call_edges": graph.calls,
        "contains_edges": graph.contains,
        "file_nodes": graph.files,
        "parse_errors": index.errors,
    }
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
            for name, df in counted.items()
        ],
    )


@dataclass(frozen=True)
class Analysis:
    mode: str  # full, incremental or skip
    graph: CodeGraph
    index: CodeIndex
    log_errors: DataFrame


_EXTRACTED = ("symbols", "refs", "inheritance", "files", "errors")
BUCKETS = 64


def analyze(
    spark: SparkSession, root: str, state: str, config: Config, log_path: str | None = None, full: bool = False, buckets: int = BUCKETS
) -> Analysis:
    """Bring the graph of ``root`` up to date, opening only the files that changed.

    ``state`` is a shared folder. It keeps versions of the manifest, the
    extracted rows and the graph, in ``buckets`` buckets of files. Where nothing
    changed, nothing is linked; otherwise references that the change can concern
    are linked again (:mod:`kinweave.plans.incremental`) and the buckets that
    came out different are written. A run that dies leaves the last version as it
    is; a run beside another one raises :class:`Conflict`. With ``full``, or
    without a version, everything is read. Records are indexed again in every
    run: the log changes independently of the sources.
    """
    listing = materialize(list_tree(spark, root, config.exclude), "listing")
    current = walk(listing, config.include, config.languages, config.exclude).select("path", "mtime")
    versions = Versions(spark, f"{state}/code-{buckets}")
    number = versions.latest()
    mode, changes = "full", {}
    if full or number is None:
        index = build_index(read_sources(spark, root, current), config.languages)
        tables = {n: getattr(index, n) for n in _EXTRACTED} | {"manifest": current} | linked(index)
        changes = {n: (incremental.in_buckets(n, rows, buckets), None) for n, rows in tables.items()}
    else:
        stored = incremental.Stored(lambda name, wanted: versions.read(name, incremental.layout(name), number, wanted), buckets)
        diff = materialize(manifest_diff(stored.table("manifest"), current), "diff")
        mode = "skip" if diff.isEmpty() else "incremental"
        if mode == "incremental":
            present = diff.filter("status <> 'deleted'")
            index = build_index(read_sources(spark, root, present), config.languages)
            fresh = {n: getattr(index, n) for n in _EXTRACTED} | {"manifest": current.join(present.select("path"), "path", "left_semi")}
            changes = incremental.relink(stored, fresh, diff)
    if changes:
        number = versions.commit(changes, number)
        versions.vacuum(keep=2)

    def table(name: str) -> DataFrame:
        return versions.read(name, incremental.layout(name), number)

    graph = CodeGraph.from_tables(spark, symbols=table("nodes"), **{n: table(n) for n in ("files", "contains", "calls", "extends")})
    errors = spark.createDataFrame([], "line bigint, id string, message string")
    if log_path is not None:
        graph, errors = reindex(graph, read_log_lines(spark, log_path), listing)
    return Analysis(mode, graph, CodeIndex(**{n: table(n) for n in _EXTRACTED}), errors)


def reindex(graph: CodeGraph, lines: DataFrame, listing: DataFrame | None = None) -> tuple[CodeGraph, DataFrame]:
    """Rebuild the record side from log lines; refused, graph unchanged, while the log has errors."""
    records, errors = parse_log(lines)
    errors = materialize(errors, "log-errors")
    if not errors.isEmpty():
        return graph, errors
    return apply_index(graph, index_records(graph, materialize(records, "log-records"), listing)), errors
