"""Every operator as a named query over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import adapters as a
from kinweave.extract import knowledge, php, python, typescript
from kinweave.extract.sql import sql_symbols
from kinweave.functions import paths, records as rec, text
from kinweave.operators import drift, lookup, name_index, pattern, resolve, search, stats, traverse
from kinweave.operators.records import index_records, index_stats, record_nodes
from kinweave.plans import index as ix
from kinweave.plans import records as plan_records
from kinweave.session import materialize, placed
from kinweave.sources import files as src
from kinweave.sources.record_log import live_records, parse_log
from kinweave.sources.tables import stale_rules
from kinweave.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
col, lit = F.col, F.lit


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _all_symbols(s: SparkSession, d: str) -> DataFrame:
    return a.symbols(s, d).select(col("id").alias("seed"))


# --- call graph ---------------------------------------------------------------


@query
def get_callers(s, d):
    return traverse.get_callers(a.code_graph(s, d), _all_symbols(s, d))


@query
def get_callees(s, d):
    return traverse.get_callees(a.code_graph(s, d), _all_symbols(s, d))


@query
def callees_unresolved(s, d):
    return traverse.unresolved_of(a.code_graph(s, d), _all_symbols(s, d))


@query
def get_impact(s, d):
    return traverse.get_impact(a.code_graph(s, d), a.busiest_symbols(s, d), 3, with_path=False)


@query
def impact_path(s, d):
    hits = traverse.get_impact(a.code_graph(s, d), a.busiest_symbols(s, d), 2)
    return hits.select("seed", "id", "depth", F.array_join("path", " > ").alias("path"))


@query
def get_callers_transitive(s, d):
    return traverse.get_callers_transitive(a.code_graph(s, d), a.busiest_symbols(s, d), 3, with_path=False)


@query
def get_supertypes(s, d):
    return traverse.get_supertypes(a.code_graph(s, d), _all_symbols(s, d))


@query
def containment(s, d):
    return a.code_graph(s, d).contains


@query
def ancestor_dirs(s, d):
    path = col("path")
    rows = a.listing(s, d).select("path", F.posexplode(paths.ancestor_dirs(path)).alias("n", "dir"))
    return rows.select("path", "n", "dir", paths.dir_depth(col("dir")).alias("depth"))


@query
def enclosing_scopes(s, d):
    return a.symbols(s, d).select("id", F.posexplode(paths.enclosing_scopes(col("id"))).alias("n", "scope"))


# --- search and statistics ----------------------------------------------------


@query
def search_symbols(s, d):
    return search.search_symbols(a.code_graph(s, d), "ring", 20)


@query
def search_symbols_indexed(s, d):
    graph = a.code_graph(s, d)
    index = name_index.build_name_index(graph.symbols)
    asked = [("ring", None), ("c1", "class"), (".", None), ("STEEL", "method"), ("xyzzy", None)]
    parts = [name_index.score_symbols(graph, index, q, kind).withColumn("query", lit(q)) for q, kind in asked]
    return reduce(DataFrame.unionByName, parts)


@query
def score_symbols(s, d):
    return search.score_symbols(a.code_graph(s, d), "C1", "class")


@query
def identifier_words(s, d):
    words = text.identifier_words(col("fqn"))
    return a.symbols(s, d).select("id", F.array_join(words, " ").alias("words"))


@query
def undocumented_symbols(s, d):
    return search.undocumented_symbols(a.knowledge_graph(s, d))


@query
def unwarned_symbols(s, d):
    """Symbols that no trap is recorded for: the search over records of one kind."""
    graph = a.knowledge_graph(s, d)
    traps = graph.records.filter("kind = 'gotcha'").select(col("id").alias("src"))
    return search.undocumented_symbols(graph.with_tables(about=graph.about.join(traps, "src", "left_semi")))


@query
def indexed_graph(s, d):
    return stats.stale_graph(a.knowledge_graph(s, d), a.log_records(s, d))


@query
def graph_stats(s, d):
    return stats.graph_stats(a.knowledge_graph(s, d))


@query
def status_totals(s, d):
    return stats.status_totals(a.knowledge_graph(s, d))


@query
def stale_graph(s, d):
    return stats.stale_graph(a.code_graph(s, d), a.log_records(s, d))


@query
def search_records(s, d):
    return search.search_records(a.knowledge_graph(s, d), "STEP 7", 50).drop("ts")


@query
def match_records(s, d):
    return search.match_records(a.knowledge_graph(s, d), "purchase", "gotcha").drop("ts")


@query
def records_by_kind(s, d):
    found = search.get_records_by_kind(a.knowledge_graph(s, d), "rejected")
    return found.withColumn("ts", rec.format_ts(col("ts")))


@query
def records_by_ref(s, d):
    return search.get_records_by_ref(a.knowledge_graph(s, d), "docs/d7.md").withColumn("ts", rec.format_ts(col("ts")))


# --- record log ---------------------------------------------------------------


@query
def record_parse(s, d):
    good, _ = parse_log(a.log_lines(s, d))
    return good.select("line", "id", "kn", F.array_join("sb", "|").alias("subjects"), "cl", "pv", "ts")


@query
def record_errors(s, d):
    _, errors = parse_log(a.log_lines(s, d))
    subject = F.regexp_extract("message", r"^'(\w+)'", 1)
    return errors.select("line", F.coalesce("id", lit("")).alias("id"), subject.alias("key"))


@query
def record_serialize(s, d):
    return a.log_records(s, d).select("id", rec.canonical_json().alias("json"))


@query
def record_live(s, d):
    return live_records(a.log_records(s, d)).select("id", "kn")


@query
def record_nodes_query(s, d):
    nodes = record_nodes(a.log_records(s, d))
    return nodes.withColumn("ts", rec.format_ts(col("ts")))


QUERIES["record_nodes"] = QUERIES.pop("record_nodes_query")


def _index(s, d):
    return index_records(a.code_graph(s, d), a.log_records(s, d), a.listing(s, d))


@query
def record_about(s, d):
    return _index(s, d).about


@query
def record_anchors(s, d):
    return _index(s, d).anchors


@query
def record_unresolved(s, d):
    return _index(s, d).unresolved


@query
def record_supersedes(s, d):
    return _index(s, d).supersedes


@query
def record_index_stats(s, d):
    return index_stats(_index(s, d))


@query
def provenance(s, d):
    pv = col("pv")
    return a.log_records(s, d).select(
        "id", rec.provenance_kind(pv).alias("kind"), F.coalesce(rec.provenance_pointer(pv), lit("")).alias("pointer"),
        rec.is_unvouched(pv).cast("int").alias("unvouched"), rec.should_notify("inferred", pv).cast("int").alias("notify"),
        rec.valid_provenance(pv).cast("int").alias("valid"),
    )


@query
def ts_format(s, d):
    events = a.table(s, d, "events")
    wire = rec.format_ts(col("ts"))
    parsed = rec.parse_ts(F.concat(F.substring(wire, 1, 6), F.lpad((col("event_id") % 40).cast("string"), 2, "0"), F.substring(wire, 9, 6)))
    return events.select("event_id", wire.alias("wire"), F.coalesce(rec.format_ts(parsed), lit("")).alias("shifted"))


@query
def admit_records(s, d):
    log = a.log_records(s, d).filter("ss IS NULL")
    good, _ = plan_records.admit_records(log, a.log_records(s, d), a.listing(s, d), lit("20260101000000"))
    return good.select("kn", "cl", "bc", "pv", "ss", F.array_join("sb", "|").alias("subjects"), "ts")


@query
def admit_rejections(s, d):
    log = a.log_records(s, d).filter("ss IS NULL")
    _, bad = plan_records.admit_records(log, a.log_records(s, d), a.listing(s, d), lit("20260101000000"))
    reason = F.when(F.contains("message", lit("supersede")), "supersedes").otherwise("provenance")
    return bad.groupBy("claim", reason.alias("reason")).agg(F.count("*").alias("n"))


# --- records in scope ---------------------------------------------------------


@query
def records_for_symbol(s, d):
    found = lookup.records_for_symbols(a.knowledge_graph(s, d), a.busiest_symbols(s, d))
    return found.select("seed", "id", "kind", "claim", "subject", rec.format_ts(col("ts")).alias("ts"))


@query
def records_for_symbol_all(s, d):
    found = lookup.records_for_symbols(a.knowledge_graph(s, d), a.busiest_symbols(s, d), include_superseded=True)
    return found.select("seed", "id", "subject")


@query
def records_for_file(s, d):
    seeds = a.busiest_symbols(s, d).select(paths.file_of(col("seed")).alias("seed"))
    return lookup.records_for_symbols(a.knowledge_graph(s, d), seeds).select("seed", "id", "kind", "subject")


def _context(s, d):
    return lookup.context_for_files(a.knowledge_graph(s, d), a.files(s, d).select(col("path").alias("file")))


@query
def context_topk(s, d):
    return _context(s, d).select(
        "file", "position", "id", "kind", "scope", F.coalesce("anchor_dir", lit("")).alias("anchor_dir"), "total"
    )


@query
def context_lines(s, d):
    return lookup.context_lines(_context(s, d))


@query
def rules_by_file(s, d):
    return lookup.rule_lines(a.knowledge_graph(s, d))


@query
def rule_documents(s, d):
    documents = lookup.rule_documents(a.knowledge_graph(s, d))
    return documents.select("rule_file", "priority", "id", F.sha2(col("line").cast("binary"), 256).alias("line_sha256"))


@query
def rules_stale(s, d):
    listed = a.listing(s, d).select(
        paths.rule_file_name(F.regexp_replace("path", "/[^/]*$", "")).alias("rule_file"),
        F.when(F.startswith("path", lit("tests/")), "by hand").otherwise(lookup.RULE_MARKER).alias("body"),
    ).distinct()
    return stale_rules(listed, lookup.rule_lines(a.knowledge_graph(s, d)))


@query
def rule_slug(s, d):
    return a.listing(s, d).select("path", paths.rule_file_name(col("path"), "rule-").alias("rule_file"))


# --- drift and change ---------------------------------------------------------


def _drift(s, d) -> drift.DriftReport:
    log = a.log_records(s, d)
    no_errors = s.createDataFrame([], "line bigint, id string, message string")
    return drift.drift_report(a.code_graph(s, d), log, no_errors, a.listing(s, d))


@query
def drift_unresolved(s, d):
    return _drift(s, d).unresolved


@query
def drift_missing_refs(s, d):
    return _drift(s, d).missing_refs


@query
def drift_fabricated(s, d):
    return _drift(s, d).fabricated_refs


@query
def drift_new(s, d):
    """The log of errors and clicks was reported before; what is new since?"""
    keys = drift.drift_keys(_drift(s, d))
    claims = a.log_records(s, d).select(col("id").alias("record_id"), "cl")
    seen = keys.join(claims, "record_id").filter(F.startswith("cl", lit("click")) | F.startswith("cl", lit("error")))
    return drift.new_drift(keys, seen).select("key", "record_id")


@query
def drift_preview(s, d):
    shown, _ = drift.preview(_drift(s, d).fabricated_refs, "record_id", "pointer")
    return shown


@query
def drift_preview_rest(s, d):
    _, rest = drift.preview(_drift(s, d).fabricated_refs, "record_id", "pointer")
    return rest


@query
def staged_parse(s, d):
    return drift.staged_changes(a.staged_lines(s, d))


@query
def staged_check(s, d):
    return drift.staged_check(a.knowledge_graph(s, d), drift.staged_changes(a.staged_lines(s, d)))


@query
def manifest_diff(s, d):
    return drift.manifest_diff(*a.manifests(s, d))


@query
def debounce_windows(s, d):
    bursts = watch.flush_windows(a.table(s, d, "events"), "user_id", 6 * 3600)
    return bursts.select(
        "user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"),
        F.date_format("end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("end"), "n_events",
    )


@query
def debounce_batches(s, d):
    items = watch.flush_batches(a.table(s, d, "events"), "user_id", "event_type", 6 * 3600)
    return items.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def path_filter(s, d):
    page = F.regexp_extract("url", r"^https?://([^?]*)", 1).alias("path")
    ignored = paths.watch_ignored(col("path"), ["fr", "es"], "de")
    return a.table(s, d, "pages").select("page_id", page).select(
        "page_id", ignored.cast("int").alias("ignored"),
        paths.under_excluded_dir(col("path"), ["fr", "es"]).cast("int").alias("excluded"),
        paths.extension(F.regexp_extract("path", "^([^/]*)", 1)).alias("ext"),
    )


@query
def walk_sources(s, d):
    return src.walk(a.listing(s, d), ["src"], ["typescript"], ["d1"]).select("path", src.language_of(col("path")).alias("language"))


@query
def watch_roots(s, d):
    tree = a.listing(s, d)
    every = src.watch_roots(tree, [".", "src/m1"], ["docs"]).select(lit("all").alias("kind"), "root")
    named = src.watch_roots(tree, ["src/m1", "./src/m1/d1/", "docs/", "nowhere"], ["docs"]).select(lit("named").alias("kind"), "root")
    return every.unionByName(named)


# --- extraction ---------------------------------------------------------------


@query
def marker_scan(s, d):
    return knowledge.scan_markers(a.commented_documents(s, d))


@query
def revert_scan(s, d):
    return knowledge.scan_reverts(a.revert_log(s, d))


@query
def adr_scan(s, d):
    return knowledge.scan_decisions(a.decision_texts(s, d))


def _candidates(s, d):
    return plan_records.extracted_knowledge(
        a.commented_documents(s, d), a.revert_log(s, d), a.decision_texts(s, d), knowledge.merge_markers()
    )


def _earlier(s, d):
    """Documents that were bootstrapped before: the title of every decision on a labelled document."""
    labelled = a.table(s, d, "labels").select(F.concat(lit("docs/adr/"), col("doc_id").cast("string"), lit(".md")).alias("file_path"))
    earlier = knowledge.scan_decisions(a.decision_texts(s, d)).join(labelled, "file_path", "left_semi")
    return earlier.select(lit("decision").alias("kn"), F.upper("claim").alias("cl"))


@query
def bootstrap_records(s, d):
    return plan_records.drop_known(_candidates(s, d), _earlier(s, d)).select("kn", "cl", "pv")


@query
def bootstrap_counts(s, d):
    candidates = materialize(_candidates(s, d), "candidates")
    return plan_records.bootstrap_counts(candidates, plan_records.drop_known(candidates, _earlier(s, d)))


@query
def clip_claims(s, d):
    docs = a.table(s, d, "documents")
    return docs.select("doc_id", text.clip(col("text")).alias("claim"))


@query
def dedup_keys(s, d):
    key = F.replace(text.dedup_key(lit("gotcha"), col("line")), lit("\0"), lit("|"))
    return a.document_lines(s, d).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query
def sql_objects(s, d):
    return sql_symbols(a.ddl_documents(s, d)).drop("ordinal", "language")


@query
def tsx_symbols(s, d):
    found = typescript.extract(a.tagged_documents(s, d)).symbols
    return found.select("id", "fqn", "symbol_type", "file_path", "line_start", "line_end")


@query
def tsx_call_refs(s, d):
    found = typescript.extract(a.tagged_documents(s, d))
    errors = found.errors.select(F.lit("").alias("caller_id"), F.col("error").alias("target_name"), F.col("file_path").alias("kind"), F.lit(0).cast("bigint").alias("line"))
    return found.refs.select("caller_id", "target_name", "kind", "line").unionByName(errors)


@query
def enclosing_symbol(s, d):
    lines = (
        a.table(s, d, "lineitem")
        .select(F.expr("l_partkey div 5").alias("c"), (col("l_quantity") + 0.0).cast("bigint").alias("line"))
        .select(a.group_path(col("c")).alias("file_path"), "line").distinct()
    )
    found = resolve.enclosing_symbol(lines, a.symbols(s, d).withColumn("ordinal", col("k")))
    return found.select("file_path", "line", "symbol_id")


@query
def dedup_symbols(s, d):
    """Order lines as repeated declarations of one symbol per order and part group."""
    lines = a.table(s, d, "lineitem")
    rows = lines.select(
        F.concat(lit("src/o"), col("l_orderkey").cast("string"), lit(".ts::"), "l_returnflag").alias("id"),
        col("l_returnflag").alias("fqn"), lit("method").alias("symbol_type"),
        (col("l_partkey") + 1).alias("line_start"), (col("l_partkey") + 5).alias("line_end"),
    )
    return resolve.dedup_symbols(rows).select("id", "fqn", "line_start", "line_end")


def _extraction(s, d, ext):
    module = {".ts": typescript, ".php": php, ".py": python}[ext]
    return module.extract(a.source_files(s, d, ext))


def _register_language(name: str, ext: str) -> None:
    def symbols(s, d):
        return _extraction(s, d, ext).symbols.drop("ordinal", "language")

    def call_refs(s, d):
        return _extraction(s, d, ext).refs.drop("file_path")

    def inheritance(s, d):
        return _extraction(s, d, ext).inheritance

    QUERIES[f"{name}_symbols"] = symbols
    QUERIES[f"{name}_call_refs"] = call_refs
    if ext != ".py":
        QUERIES[f"{name}_inheritance"] = inheritance


for _name, _ext in (("ts", ".ts"), ("php", ".php"), ("python", ".py")):
    _register_language(_name, _ext)


# --- indexing -----------------------------------------------------------------


def _built(s, d, ext=".ts"):
    return ix.build_index(a.source_files(s, d, ext), ["php" if ext == ".php" else "typescript"])


@query
def index_calls(s, d):
    return ix.link(_built(s, d)).calls


@query
def index_php_calls(s, d):
    return ix.link(_built(s, d, ".php")).calls


@query
def index_extends(s, d):
    return ix.link(_built(s, d)).extends


@query
def index_contains(s, d):
    return ix.link(_built(s, d)).contains


@query
def index_unresolved(s, d):
    return ix.link(_built(s, d)).symbols.select("id", "unresolved_calls")


@query
def index_summary(s, d):
    built = _built(s, d)
    return ix.index_summary(built, ix.link(built))


@query
def index_incremental(s, d):
    """Odd folders are stale: they are replaced by a fresh extraction, which must give the full result."""
    sources = materialize(a.source_files(s, d, ".ts"), "sources")
    outdated = sources.withColumn("text", F.replace("text", lit("shared"), lit("missing")))
    changed = placed(sources.select(col("file_path").alias("path")).filter(col("path").rlike("/d[12]/")))
    mixed = (
        sources.join(changed, col("file_path") == col("path"), "left_anti")
        .unionByName(outdated.join(changed, col("file_path") == col("path"), "left_semi"))
    )
    before = ix.build_index(mixed, ["typescript"])
    fresh = ix.build_index(sources.join(changed, col("file_path") == col("path"), "left_semi"), ["typescript"])
    return ix.link(ix.merge_index(before, fresh, changed)).calls


# --- graph patterns -----------------------------------------------------------


@query
def pattern_label_scan(s, d):
    return pattern.nodes(a.code_graph(s, d), "n", "CodeSymbol", symbol_type="class").select("n_id", "n_fqn")


@query
def pattern_one_hop(s, d):
    g = a.code_graph(s, d)
    classes = pattern.nodes(g, "b", "CodeSymbol", symbol_type="class").select("b_id", "b_fqn")
    rows = pattern.expand(pattern.nodes(g, "a", "CodeSymbol").select("a_id"), g, "a", "CALLS", classes, "b")
    return rows.select("a_id", "b_fqn").distinct()


@query
def pattern_reverse_hop(s, d):
    g = a.code_graph(s, d)
    callers = pattern.nodes(g, "b", "CodeSymbol").select("b_id")
    rows = pattern.expand(pattern.nodes(g, "a", "CodeSymbol").select("a_id"), g, "a", "CALLS", callers, "b", reverse=True)
    return rows.groupBy("a_id").agg(F.count("b_id").alias("n_callers"))


@query
def pattern_any_node(s, d):
    g = a.knowledge_graph(s, d)
    records = pattern.nodes(g, "r", "Record").filter("r_live").select("r_id", "r_kind")
    rows = pattern.expand(records, g, "r", "ABOUT", pattern.nodes(g, "t").select("t_id", "t_fqn", "t_kind"), "t")
    return rows.select("r_id", "t_id", F.coalesce("t_fqn", lit("")).alias("t_fqn"), F.coalesce("t_kind", lit("")).alias("t_kind"))


@query
def pattern_edge_count(s, d):
    return pattern.edges(a.code_graph(s, d), "r", "CALLS").groupBy("r_call_kind").agg(F.count("*").alias("n"))


@query
def pattern_variable_length(s, d):
    g = a.code_graph(s, d)
    start = pattern.nodes(g, "c", "CodeSymbol", symbol_type="class").select("c_id", "c_fqn")
    rows = pattern.expand_var(start, g, "c", "EXTENDS", pattern.nodes(g, "p", "CodeSymbol").select("p_id", "p_fqn"), "p", 3)
    return rows.select("c_fqn", "p_fqn", "p_depth")


@query
def pattern_not_exists(s, d):
    g = a.code_graph(s, d)
    return pattern.where_not_exists(pattern.nodes(g, "c", "CodeSymbol").select("c_id", "c_fqn"), g, "c", "EXTENDS")


@query
def pattern_optional(s, d):
    g = a.knowledge_graph(s, d)
    records = pattern.nodes(g, "r", "Record").select("r_id")
    rows = pattern.expand(records, g, "r", "SUPERSEDES", pattern.nodes(g, "o", "Record").select("o_id"), "o", how="left")
    return rows.select("r_id", F.coalesce("o_id", lit("")).alias("o_id"))


@query
def pattern_temporal(s, d):
    g = a.knowledge_graph(s, d)
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    rows = pattern.nodes(g, "r", "Record").filter((col("r_ts") > since) & col("r_provenance_kind").isin("t", "d"))
    return rows.groupBy("r_kind").agg(F.count("*").alias("n"))


@query
def graph_sql(s, d):
    return a.code_graph(s, d).sql(
        "SELECT s.symbol_type AS symbol_type, count(DISTINCT c.dst) AS n_callees "
        "FROM calls c JOIN symbols s ON s.id = c.src WHERE c.call_kind = :kind GROUP BY s.symbol_type",
        kind="static_call",
    )
