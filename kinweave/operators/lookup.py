"""Which records apply to a symbol or a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.paths import ancestor_dirs, dir_depth, enclosing_scopes, file_of, has_fqn, rule_file_name
from kinweave.functions.records import MAX_INJECTED, kind_priority, overflow_line, record_line
from kinweave.graph import CodeGraph
from kinweave.operators.search import RECORD_COLUMNS
from kinweave.session import placed

# Fixed value: a directory anchor sorts after every symbol or file anchor of the
# same kind, the deeper one first.
DIR_SCOPE_BASE = 100

RULE_MARKER = "<!-- kinweave-managed-rule -->"


def records_for_symbols(graph: CodeGraph, seeds: DataFrame, include_superseded: bool = False) -> DataFrame:
    """Records that apply to each ``seed`` (a symbol id or a bare file path).

    They may be anchored at the seed, its file, an enclosing class, or a
    directory above; for a bare path also at any symbol in the file. A record
    reached through several anchors is returned once, with the widest of them as
    ``subject``. Presentation order: :func:`order_records`.
    """
    seeds = seeds.select("seed").distinct()
    seed = F.col("seed")
    fixed = F.concat(F.array(seed, file_of(seed)), enclosing_scopes(seed))
    direct = seeds.select("seed", F.posexplode(fixed).alias("rank", "target"), F.lit(False).alias("dir"))
    in_file = (
        seeds.filter(~has_fqn(seed))
        .join(placed(graph.symbols.select("file_path", "id")), seed == F.col("file_path"))
        .select("seed", F.lit(1000).alias("rank"), F.col("id").alias("target"), F.lit(False).alias("dir"))
    )
    above = seeds.select("seed", F.explode(ancestor_dirs(file_of(seed))).alias("target")).select(
        "seed", (F.lit(3000) - dir_depth(F.col("target"))).alias("rank"), "target", F.lit(True).alias("dir")
    )
    targets = direct.unionByName(in_file).unionByName(above)

    dirs = graph.files.filter("kind = 'dir'").select(F.col("id").alias("dir_id"))
    about = graph.about.join(placed(dirs), (F.col("dst") == F.col("dir_id")) & (F.col("dst_label") == "File"), "left")
    records = placed(graph.records if include_superseded else graph.records.filter("live"))
    hits = (
        placed(targets).join(about, F.col("target") == F.col("dst"))
        .filter("NOT dir OR dir_id IS NOT NULL")
        .groupBy("seed", F.col("src").alias("record_id"))
        .agg(F.max(F.struct("rank", "target")).alias("via"))
    )
    return hits.join(records, F.col("record_id") == records["id"]).select(
        "seed", *[records[c] for c in RECORD_COLUMNS], F.col("via.target").alias("subject")
    )


def order_records(records: DataFrame, *leading: str) -> DataFrame:
    """Traps and invariants first; a wider anchor after a narrower one; then id."""
    scope = ["scope"] if "scope" in records.columns else []
    return records.orderBy(*leading, kind_priority(F.col("kind")), *scope, "id")


def _anchored(graph: CodeGraph) -> DataFrame:
    """Live ``(anchor, is_dir, record)`` rows, one per record and anchor.

    Symbol subjects are anchored at their file, so several symbols of one file
    count once.
    """
    symbols = graph.symbols.select(F.col("id").alias("dst"), F.col("file_path").alias("anchor"))
    files = graph.files.select(
        F.col("id").alias("dst"), F.col("id").alias("anchor"), (F.col("kind") == "dir").alias("is_dir")
    )
    via_symbol = (
        graph.about.filter("dst_label = 'CodeSymbol'").join(placed(symbols), "dst")
        .select("src", "anchor", F.lit(False).alias("is_dir"))
    )
    via_file = graph.about.filter("dst_label = 'File'").join(placed(files), "dst").select("src", "anchor", "is_dir")
    anchors = (
        via_symbol.unionByName(via_file)
        .filter("anchor IS NOT NULL AND anchor <> ''")
        .groupBy("src", "anchor")
        .agg(F.min("is_dir").alias("is_dir"))
    )
    records = placed(graph.records.filter("live").select("id", "kind", "claim", "because", "provenance", "ref"))
    return anchors.join(records, F.col("src") == F.col("id")).drop("src")


def context_for_files(graph: CodeGraph, files: DataFrame, limit: int = MAX_INJECTED) -> DataFrame:
    """The ``limit`` most relevant records per ``file``, plus ``total`` and ``position``.

    A record applies through the file itself, its symbols, or a directory above
    it. Records are cut to ``limit`` per anchor *before* files meet anchors, so a
    directory that holds most records contributes ``limit`` rows per file below
    it instead of all of them. The cut is exact: within one kind every record of
    an anchor keeps its relative order, and a record that also has a narrower
    anchor only moves forward.

    ``total`` counts distinct applicable records without pairing them with
    files: a record is counted at its topmost anchor on the path only, so the
    per-anchor counts add up.
    """
    anchored = _anchored(graph).withColumn("priority", kind_priority(F.col("kind")))
    best = Window.partitionBy("anchor").orderBy("priority", "id")
    top = anchored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit).drop("n")

    pairs = anchored.select("id", "anchor", "is_dir")
    nested = (
        pairs.select("id", "anchor", F.explode(ancestor_dirs(F.col("anchor"))).alias("above"))
        .join(
            placed(pairs.filter("is_dir").select("id", F.col("anchor").alias("above"))),
            ["id", "above"], "left_semi",
        )
        .select("id", "anchor").distinct()
    )
    counts = (
        pairs.join(placed(nested), ["id", "anchor"], "left_anti")
        .groupBy("anchor", "is_dir").agg(F.count("*").alias("n_records"))
    )

    file = F.col("file")
    chain = files.select("file").distinct().select(
        "file",
        F.explode(
            F.concat(
                F.array(F.struct(file.alias("anchor"), F.lit(0).alias("scope"))),
                F.transform(
                    ancestor_dirs(file),
                    lambda d: F.struct(d.alias("anchor"), (F.lit(DIR_SCOPE_BASE) - dir_depth(d)).alias("scope")),
                ),
            )
        ).alias("link"),
    ).select("file", "link.anchor", "link.scope")
    # An ancestor link only matches directory anchors.
    applies = "scope = 0 OR is_dir"

    totals = (
        placed(chain).join(counts, "anchor").filter(applies)
        .groupBy("file").agg(F.sum("n_records").alias("total"))
    )
    columns = ["kind", "claim", "because", "provenance", "ref", "priority"]
    candidates = (
        placed(chain).join(top, "anchor").filter(applies)
        .groupBy("file", "id")
        .agg(F.min(F.struct("scope", "anchor", *columns)).alias("r"))
        .select("file", "id", "r.scope", "r.anchor", *[f"r.{c}" for c in columns])
    )
    per_file = Window.partitionBy("file").orderBy("priority", "scope", "id")
    return (
        candidates.withColumn("position", F.row_number().over(per_file))
        .filter(F.col("position") <= limit)
        .join(placed(totals), "file")
        .select(
            "file", "position", "id", "kind", "claim", "because", "provenance", "ref", "scope",
            F.when(F.col("scope") > 0, F.col("anchor")).alias("anchor_dir"), "total",
        )
    )


def context_lines(context: DataFrame) -> DataFrame:
    """``(file, position, line)``: the rendered records and one overflow note per file."""
    lines = context.select(
        "file", "position",
        record_line(*[F.col(c) for c in ("kind", "claim", "because", "ref", "anchor_dir", "id", "provenance")]).alias("line"),
    )
    hidden = (
        context.groupBy("file").agg(F.count("*").alias("shown"), F.max("total").alias("total"))
        .filter("total > shown")
        .select(
            "file", (F.col("shown") + 1).cast("int").alias("position"),
            overflow_line(F.col("total") - F.col("shown")).alias("line"),
        )
    )
    return lines.unionByName(hidden)


def rule_lines(graph: CodeGraph) -> DataFrame:
    """Every live record as one line of the rule of its file or directory.

    Rows are ``(file, is_dir, rule_file, priority, id, line)``; a rule is its rows
    in ``(priority, id)`` order. No rule is assembled in one task, so a directory
    that holds a third of all records is just more rows.
    """
    anchored = _anchored(graph)
    return anchored.select(
        F.col("anchor").alias("file"),
        "is_dir",
        rule_file_name(F.col("anchor")).alias("rule_file"),
        kind_priority(F.col("kind")).alias("priority"),
        "id",
        record_line(
            F.col("kind"), F.col("claim"), F.col("because"), F.col("ref"), F.lit(None).cast("string"),
            F.col("id"), F.col("provenance"),
        ).alias("line"),
    )


def rule_documents(graph: CodeGraph) -> DataFrame:
    """:func:`rule_lines` framed by the header and footer lines of each rule."""
    body = rule_lines(graph)
    file = F.col("file")
    glob = F.when(F.col("is_dir"), F.concat(file, F.lit("/**"))).otherwise(file)
    heading = F.when(F.col("is_dir"), F.concat(F.lit("# Known about module "), file)).otherwise(
        F.concat(F.lit("# Known about "), file)
    )
    header = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("description: Knowledge records for "), file),
        F.concat(F.lit("globs: "), glob), F.lit("alwaysApply: false"), F.lit("---"), F.lit(""), heading, F.lit(""),
    )
    footer = F.concat_ws(
        "\n", F.lit(""),
        F.lit("Where an edit contradicts one of these, raise the conflict first; record new decisions when done."),
        F.lit(""), F.lit(RULE_MARKER),
    )
    rules = body.groupBy("file", "is_dir", "rule_file").agg(F.count("*").alias("n"))
    frame = rules.select(
        "file", "is_dir", "rule_file",
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("priority"), F.lit("").alias("id"), header.alias("line")),
                F.struct(F.lit(1000).alias("priority"), F.lit("").alias("id"), footer.alias("line")),
            )
        ).alias("f"),
    ).select("file", "is_dir", "rule_file", "f.priority", "f.id", "f.line")
    return body.unionByName(frame)
