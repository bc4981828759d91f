"""Whole workflows over the parts: adding records, bootstrapping a log, the check of a hook, server information."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.extract.knowledge import merge_markers
from kinweave.functions.records import should_notify
from kinweave.graph import CodeGraph
from kinweave.operators.drift import DriftReport, drift_keys, new_drift
from kinweave.operators.stats import build_skew, graph_stats, stale_graph
from kinweave.plans.records import admit_records, bootstrap, extracted_knowledge
from kinweave.session import materialize
from kinweave.sources.files import decision_documents, list_tree, read_git_log, read_sources, walk
from kinweave.sources.record_log import append_log, parse_log, read_log_lines
from kinweave.sources.tables import Config, load_state, save_state

REPORTED = schema._table("key string")
BUILD = schema._table("build string")


@dataclass(frozen=True)
class Added:
    """What became of candidate records. With ``log_errors`` nothing was admitted."""

    accepted: DataFrame  # wire records
    rejected: DataFrame  # (claim, message)
    notices: DataFrame  # accepted records that a person should look at
    log_errors: DataFrame  # (line, id, message)


def _log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid records and errors of a log; a log that does not exist is empty."""
    try:
        lines = read_log_lines(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "line bigint, value string")
    records, errors = parse_log(lines)
    return materialize(records, "log-records"), materialize(errors, "log-errors")


def add_records(
    spark: SparkSession, log_path: str, candidates: DataFrame, listing: DataFrame, now: Column, notify: str = "inferred"
) -> Added:
    """Check candidates against the log and the tree and append the good ones; refused while the log has errors."""
    log, errors = _log(spark, log_path)
    none = schema.empty(spark, schema.WIRE_RECORD)
    if not errors.isEmpty():
        return Added(none, spark.createDataFrame([], "claim string, message string"), none, errors)
    accepted, rejected = admit_records(log, candidates, listing, now)
    accepted = materialize(accepted, "accepted")
    append_log(accepted, log_path)
    return Added(accepted, rejected, accepted.filter(should_notify(notify, F.col("pv"))), errors)


def bootstrap_tree(
    spark: SparkSession, root: str, log_path: str, config: Config, now: Column, git_dump: str | None = None,
    markers: list[str] | None = None, docs: list[str] | tuple[str, ...] = (),
) -> Added:
    """Append what markers, reverts and decision documents of a tree say and the log does not have yet.

    Running it again appends nothing; refused while the log has errors.
    """
    log, errors = _log(spark, log_path)
    none, rejected = schema.empty(spark, schema.WIRE_RECORD), spark.createDataFrame([], "claim string, message string")
    if not errors.isEmpty():
        return Added(none, rejected, none, errors)
    listing = materialize(list_tree(spark, root, config.exclude), "listing")
    sources = read_sources(spark, root, walk(listing, config.include, config.languages, config.exclude))
    commits = read_git_log(spark, git_dump) if git_dump else spark.createDataFrame([], "value string")
    documents = read_sources(spark, root, decision_documents(listing, docs))
    found = extracted_knowledge(sources, commits, documents, merge_markers(markers or []))
    fresh = materialize(bootstrap(found, log, now), "bootstrap")
    append_log(fresh, log_path)
    return Added(fresh, rejected, fresh.filter(should_notify(config.notify, F.col("pv"))), errors)


def hook_check(spark: SparkSession, report: DriftReport, state_path: str) -> DataFrame:
    """``(signal, text)`` to show: drift and fabricated sources that the last check did not show, and every invalid line.

    The state is replaced by all present keys, so what went away and comes back is shown again.
    """
    keys = materialize(drift_keys(report).select("key").distinct(), "drift-keys")
    fresh = materialize(new_drift(keys, load_state(spark, state_path, REPORTED)), "new-drift")
    save_state(keys, state_path)
    invalid = report.invalid.select(F.lit("invalid").alias("signal"), F.concat_ws(" ", F.col("line").cast("string"), "message").alias("text"))
    return fresh.select(F.lit("drift").alias("signal"), F.col("key").alias("text")).unionByName(invalid)


def save_build(spark: SparkSession, state: str, build: str) -> None:
    """Remember which build wrote the graph below ``state``."""
    save_state(spark.createDataFrame([(build,)], BUILD), f"{state}/build")


def server_info(spark: SparkSession, graph: CodeGraph, log: DataFrame, state: str, running: str) -> dict[str, object]:
    """Counts, staleness and the skew between the running build and the one that wrote the graph."""
    written = load_state(spark, f"{state}/build", BUILD).first()
    stale = stale_graph(graph, log).first()
    counts = {r["metric"]: r["value"] for r in graph_stats(graph).collect()}
    return {"counts": counts, "stale": stale["stale"], "on_disk": stale["on_disk"], **build_skew(running, written and written["build"])}


def diagnose(error: Exception) -> str:
    """What a failed graph query most likely needs, from Spark's error condition."""
    condition = error.getCondition() if hasattr(error, "getCondition") else None
    condition = condition or ""
    if condition.startswith("UNRESOLVED_COLUMN"):
        return "unknown column: the graph was written by another build or the name is wrong; see the table layouts"
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND") or condition == "PATH_NOT_FOUND":
        return "missing table: analyze the tree first"
    if condition.startswith("PARSE_SYNTAX_ERROR"):
        return "the statement does not parse"
    return f"the query failed: {str(error).splitlines()[0] if str(error) else type(error).__name__}"
