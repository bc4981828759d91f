"""Writing records: admission of new ones, and what can be extracted mechanically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.extract.knowledge import scan_decisions, scan_markers, scan_reverts
from kinweave.functions.paths import relative_path
from kinweave.functions.records import canonical_json, provenance_pointer
from kinweave.functions.text import dedup_key
from kinweave.operators.records import disk_entries
from kinweave.session import materialize, placed
from kinweave.sources.record_log import parse_log


def _fresh_ids(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Give each row a ten-digit hexadecimal id no taken record has.

    Random ids are written down before anything joins them, since a recomputed
    task would draw others.
    """
    drawn = rows.withColumn("entropy", F.sha2(F.expr("uuid()"), 256))
    drawn = materialize(drawn, "ids")
    used = placed(taken.select(F.col("id").alias("used")).distinct())
    first, second = F.substring("entropy", 1, 10), F.substring("entropy", 11, 32)
    return drawn.join(used, first == F.col("used"), "left").withColumn(
        "id", F.when(F.col("used").isNull(), first).otherwise(second)
    ).drop("entropy", "used")


def _as_wire(rows: DataFrame) -> DataFrame:
    return schema.conform(rows, schema.WIRE_RECORD)


def admit_records(log: DataFrame, candidates: DataFrame, listing: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Check candidate records (wire columns, any subset) against the log and the working tree.

    Returns the accepted records, with ids and timestamps, and the rejected ones
    as ``(claim, message)``. A candidate must validate, supersede only a record
    that exists, and cite only files that exist.
    """
    rows = _fresh_ids(candidates.drop("id", "ts", "line"), log).withColumn("ts", now)
    rows = _as_wire(rows.withColumn("pv", F.coalesce("pv", F.lit("a"))) if "pv" in rows.columns else rows.withColumn("pv", F.lit("a")))
    numbered = materialize(rows.withColumn("line", F.monotonically_increasing_id()), "candidates")
    valid, errors = parse_log(numbered.select("line", canonical_json().alias("value")))
    problems = errors.select("line", "message")

    known = placed(log.select(F.col("id").alias("known")).distinct())
    dangling = numbered.filter("ss <> ''").join(known, F.col("ss") == F.col("known"), "left_anti").select(
        "line", F.concat(F.lit("no record '"), "ss", F.lit("' to supersede")).alias("message")
    )
    on_disk = placed(disk_entries(listing).select(F.col("path").alias("on_disk")))
    cited = numbered.select("line", provenance_pointer(F.col("pv")).alias("pointer")).filter("pointer IS NOT NULL")
    fabricated = cited.join(on_disk, relative_path(F.col("pointer")) == F.col("on_disk"), "left_anti").select(
        "line", F.concat(F.lit("provenance cites a file that does not exist: "), "pointer").alias("message")
    )
    problems = problems.unionByName(dangling).unionByName(fabricated)
    rejected = numbered.select("line", F.col("cl").alias("claim")).join(placed(problems), "line").select("claim", "message")
    return valid.join(placed(problems.select("line")), "line", "left_anti").select(valid.columns), rejected


def extracted_knowledge(sources: DataFrame, commits: DataFrame, documents: DataFrame, markers: list[str]) -> DataFrame:
    """Candidate records in scan order: markers, reverts, decision documents."""
    file, none = F.col("file_path"), F.lit(None).cast("string")
    no_subject = F.lit(None).cast("array<string>")

    def rows(df: DataFrame, rank: int, kind: str, claim: str, because: Column, subjects: Column, pv: Column, *order: str) -> DataFrame:
        position = F.struct(
            F.lit(rank).alias("rank"),
            *[F.col(order[i]).cast("string").alias(f"k{i}") if i == 0 else F.col(order[i]).cast("bigint").alias(f"k{i}") for i in range(len(order))],
            *([F.lit(0).cast("bigint").alias("k1")] if len(order) == 1 else []),
        )
        return df.select(
            position.alias("position"), F.lit(kind).alias("kn"), F.col(claim).alias("cl"),
            because.alias("bc"), subjects.alias("sb"), pv.alias("pv"),
        )

    found = scan_markers(sources, markers)
    gotchas = rows(
        found, 0, "gotcha", "claim", none, F.array(file),
        F.concat(F.lit("n:"), file, F.lit(":"), F.col("line").cast("string")), "file_path", "line",
    )
    rejected = rows(
        scan_reverts(commits), 1, "rejected", "claim", F.concat(F.lit("reverted in "), "sha"), no_subject,
        F.concat(F.lit("g:"), "sha"), "sha",
    )
    decisions = rows(
        scan_decisions(documents), 2, "decision", "claim", F.col("because"), F.array(file),
        F.concat(F.lit("d:"), file), "file_path",
    )
    return gotchas.unionByName(rejected).unionByName(decisions)


def drop_known(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """One candidate per (kind, normalised claim), the first by position, unless the log has it.

    The first is found by aggregation, so a claim that occurs in a third of all
    files is reduced map-side.
    """
    key = dedup_key(F.col("kn"), F.col("cl"))
    columns = [c for c in candidates.columns if c != "position"]
    first = (
        candidates.withColumn("key", key).groupBy("key")
        .agg(F.min(F.struct("position", *columns)).alias("c"), F.count("*").alias("copies"))
    )
    known = placed(existing.select(dedup_key(F.col("kn"), F.col("cl")).alias("key")).distinct())
    return first.join(known, "key", "left_anti").select(*[F.col(f"c.{c}").alias(c) for c in columns])


def bootstrap_counts(candidates: DataFrame, added: DataFrame) -> DataFrame:
    """``(kind, n)`` of the added records, with the rest under ``skipped``."""
    per_kind = added.groupBy(F.col("kn").alias("kind")).agg(F.count("*").alias("n"))
    sizes = candidates.agg(F.count("*").alias("n")).unionByName(added.agg((-F.count("*")).alias("n")))
    skipped = sizes.agg(F.sum("n").alias("n")).select(F.lit("skipped").alias("kind"), "n")
    return per_kind.unionByName(skipped)


def bootstrap(candidates: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """New log records; running it again over its own output adds nothing."""
    fresh = drop_known(candidates, existing)
    return _as_wire(_fresh_ids(fresh, existing).withColumn("ts", now))


