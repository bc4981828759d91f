"""Link again only what a change of some files can have changed.

Extracted rows, resolved references and graph tables are kept in buckets of
their files. After a change

1. the symbols of the changed files are compared with what they were: a symbol
   that only moved changes nothing elsewhere;
2. inheritance is looked up again for classes in changed files and for those
   whose parent's name was defined, moved or removed;
3. classes below one whose parents or methods changed may inherit other
   methods, however far below;
4. references are resolved again if they are in a changed file, if their name
   or the class in it is one of the changed names, or if that class is one of 3;
5. of all tables only the buckets whose rows came out different are written.

Steps 2 and 4 read the name columns of all rows and join them with the changed
names, which are few; nothing but the rows they select is moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.functions.paths import file_of, last_segment, parent_fqn
from kinweave.operators import resolve
from kinweave.session import materialize
from kinweave.sources.versions import Change, bucket_of

RESOLVED = schema._table("caller_id string, target_name string, kind string, callee_id string, n_refs bigint")
# Of each stored table its layout and the file that its rows belong to.
TABLES: dict[str, tuple[schema.T.StructType, Column]] = {}


def _tables() -> dict[str, tuple[schema.T.StructType, Column]]:
    """Columns need a session, so the table of them is made when it is first used."""
    if not TABLES:
        path = F.col("file_path")
        TABLES.update(
            symbols=(schema.EXTRACTED_SYMBOL, path), refs=(schema.CALL_REF, path), inheritance=(schema.INHERITANCE, path),
            files=(schema.FILES, F.col("id")), errors=(schema._table("file_path string, error string"), path),
            manifest=(schema.MANIFEST, F.col("path")), resolved=(RESOLVED, file_of(F.col("caller_id"))),
            extends=(schema.EXTENDS, file_of(F.col("src"))), nodes=(schema.SYMBOLS, path),
            contains=(schema.CONTAINS, file_of(F.col("dst"))), calls=(schema.CALLS, file_of(F.col("src"))),
        )
    return TABLES


def layout(name: str) -> schema.T.StructType:
    return _tables()[name][0]


def in_buckets(name: str, rows: DataFrame, buckets: int) -> DataFrame:
    own, path = _tables()[name]
    return schema.conform(rows, own).withColumn("bucket", bucket_of(path, buckets))


def buckets_of(paths: DataFrame, path: Column, buckets: int) -> set[int]:
    """The buckets of some files, as numbers; there are at most ``buckets``."""
    return {r["bucket"] for r in paths.select(bucket_of(path, buckets)).distinct().collect()}


def graph_rows(symbols: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """Nodes, containment and calls of whole files."""
    return {
        "nodes": resolve.count_unresolved(symbols, resolved), "contains": resolve.contains_edges(symbols), "calls": resolve.call_edges(resolved)
    }


@dataclass(frozen=True)
class Stored:
    """The tables of one version; ``read(name, buckets)`` gives one, or some of its buckets."""

    read: object
    buckets: int

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        return self.read(name, buckets)


def _signature(symbols: DataFrame) -> DataFrame:
    """What other files can see of symbols."""
    class_like = F.col("symbol_type").isin(*resolve.CLASS_LIKE).alias("class_like")
    return resolve.dedup_symbols(symbols).select("id", "fqn", class_like)


def _differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one side only."""
    keys = before.columns
    both = before.withColumn("side", F.lit(-1)).unionByName(after.withColumn("side", F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("side").alias("side")).filter("side <> 0").drop("side")


def _below(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``(id)``: the classes and everything that inherits from them."""
    seen = frontier = materialize(classes.select("id").distinct(), "classes")
    while True:
        step = edges.join(frontier, edges["dst"] == frontier["id"]).select(edges["src"].alias("id")).distinct()
        frontier = materialize(step.join(seen, "id", "left_anti"), "classes")
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier), "classes")


def _named(rows: DataFrame, column: Column, names: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: true where ``column`` is one of ``names(name)``."""
    known = names.select(F.col("name").alias("_name")).distinct().withColumn(flag, F.lit(True))
    return rows.withColumn("_name", column).join(known, "_name", "left").drop("_name")


def relink(stored: Stored, fresh: dict[str, DataFrame], gone: DataFrame) -> dict[str, Change]:
    """The changes to stored tables after files ``gone(path)`` were changed or removed; ``fresh`` are their new rows.

    ``fresh`` has ``symbols, refs, inheritance, files, errors`` and ``manifest``.
    """
    n = stored.buckets
    paths = materialize(gone.select(F.col("path").alias("file_path")).distinct(), "changed-paths")
    own = buckets_of(paths, F.col("file_path"), n)

    def merged(name: str, buckets: set[int] | None = None) -> DataFrame:
        path = _tables()[name][1]
        rows = stored.table(name, buckets).withColumn("_file", path)
        return rows.join(paths.select(F.col("file_path").alias("_file")), "_file", "left_anti").drop("_file").unionByName(
            schema.conform(fresh[name], layout(name))
        )

    changes: dict[str, Change] = {}
    for name in ("symbols", "refs", "inheritance", "files", "errors", "manifest"):
        changes[name] = (in_buckets(name, merged(name, own), n), own)

    # 1. names whose meaning may have changed
    before = _signature(stored.table("symbols", own).join(paths, "file_path", "left_semi"))
    changed = materialize(_differences(before, _signature(fresh["symbols"])), "changed-symbols")
    names = changed.select(F.col("fqn").alias("name")).distinct()
    simple = changed.filter("class_like").select(last_segment(F.col("fqn")).alias("name")).distinct()

    # 2. inheritance of the classes they touch
    inheritance, all_symbols = merged("inheritance"), merged("symbols")
    touched = _named(inheritance.join(paths.withColumn("_own", F.lit(True)), "file_path", "left"), F.col("parent"), simple, "_parent")
    children = materialize(touched.filter("_own OR _parent").select("file_path", "child").distinct(), "children")
    pairs = materialize(inheritance.join(children, ["file_path", "child"], "left_semi"), "pairs")
    wanted = pairs.select(F.col("child").alias("name")).unionByName(pairs.select(F.col("parent").alias("name")))
    classes = _named(all_symbols.filter(F.col("symbol_type").isin(*resolve.CLASS_LIKE)), last_segment(F.col("fqn")), wanted, "_wanted").filter("_wanted").drop("_wanted")
    new_extends = materialize(resolve.extends_edges(resolve.dedup_symbols(classes), pairs), "new-extends")
    old = stored.table("extends").withColumns({"file_path": file_of(F.col("src")), "child": last_segment(F.substring_index("src", "::", -1))})
    old = old.join(paths.withColumn("_own", F.lit(True)), "file_path", "left").join(children.withColumn("_child", F.lit(True)), ["file_path", "child"], "left")
    old_extends = materialize(old.filter("_own OR _child").select("src", "dst"), "old-extends")
    kept = old.filter("coalesce(_own, _child, false) = false").select("src", "dst")
    extends = materialize(kept.unionByName(new_extends), "extends")
    moved = materialize(_differences(old_extends, new_extends), "moved-edges")

    # 3. classes that may inherit other methods now
    owner = F.when(F.instr("fqn", ".") > 0, F.regexp_replace("id", r"\.[^.:/]*\z", "")).otherwise(F.col("id"))
    start = moved.select(F.col("src").alias("id")).unionByName(changed.select(owner.alias("id")))
    below = _below(materialize(extends.unionByName(old_extends).distinct(), "edges"), start)
    class_names = names.unionByName(below.select(F.substring_index("id", "::", -1).alias("name"))).distinct()

    # 4. references to resolve again
    is_super = F.startswith(F.col("target_name"), F.lit("parent::"))
    refs = merged("refs").join(paths.withColumn("_own", F.lit(True)), "file_path", "left")
    refs = _named(refs, F.col("target_name"), names, "_target")
    refs = _named(refs, F.when(~is_super, parent_fqn(F.col("target_name"))), class_names, "_class")
    refs = _named(refs, F.when(is_super, F.regexp_replace("caller_id", r"\.[^.:/]*\z", "")), below.select(F.col("id").alias("name")), "_super")
    affected = materialize(refs.filter("_own OR _target OR _class OR _super").select([f.name for f in schema.CALL_REF.fields]), "affected")
    method = F.when(is_super, F.expr("substring(target_name, 9)")).otherwise(last_segment(F.col("target_name")))
    full = affected.select(F.col("target_name").alias("name")).unionByName(affected.filter(~is_super).select(parent_fqn(F.col("target_name")).alias("name")))
    visible = _named(all_symbols, F.col("fqn"), full, "_named")
    visible = _named(visible, F.when(F.instr("fqn", ".") > 0, last_segment(F.col("fqn"))), affected.select(method.alias("name")), "_method")
    visible = materialize(resolve.dedup_symbols(visible.filter("_named OR _method").drop("_named", "_method")), "visible")
    found = materialize(schema.conform(resolve.resolve_calls(visible, affected, extends), RESOLVED), "resolved-again")

    # 5. what came out different
    keys = affected.select("caller_id", "target_name", "kind").distinct().withColumn("_again", F.lit(True))
    files = paths.withColumn("_own", F.lit(True))
    past = stored.table("resolved").withColumn("file_path", file_of(F.col("caller_id"))).join(files, "file_path", "left").join(keys, ["caller_id", "target_name", "kind"], "left")
    past_again = past.filter("_own OR _again").select([f.name for f in RESOLVED.fields])
    turned = _differences(past_again, found)
    linked = own | buckets_of(turned, file_of(F.col("caller_id")), n)
    rows = in_buckets("resolved", past.filter("coalesce(_own, _again, false) = false").unionByName(found, allowMissingColumns=True), n)
    resolved = materialize(rows.filter(F.col("bucket").isin(*linked)), "resolved")
    changes["resolved"] = (resolved, linked)
    parents = own | buckets_of(moved, file_of(F.col("src")), n)
    changes["extends"] = (in_buckets("extends", extends, n).filter(F.col("bucket").isin(*parents)), parents)
    symbols = materialize(resolve.dedup_symbols(merged("symbols", linked).filter(bucket_of(F.col("file_path"), n).isin(*linked))), "symbols")
    for name, table in graph_rows(symbols, resolved.drop("bucket")).items():
        changes[name] = (in_buckets(name, table, n), linked)
    return changes
