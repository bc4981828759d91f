"""Inputs that the generated tables do not hold."""

import os

import pytest
from pyspark.sql import functions as F

from kinweave import schema, session
from kinweave.extract import python, sql
from kinweave.extract.knowledge import decision_reason, decision_title
from kinweave.functions.paths import relative_path
from kinweave.graph import CodeGraph, MutatingQueryError, is_mutating
from kinweave.operators import resolve
from kinweave.operators.lookup import RULE_MARKER
from kinweave.sources.files import list_tree, read_git_log, read_sources, read_staged_changes, walk
from kinweave.sources.record_log import append_log, parse_log, read_log_lines
from kinweave.sources.tables import write_rules


def test_hidden_names_are_listed_and_exactly_the_wanted_files_are_read(spark, tmp_path):
    for name in ("src/a.py", "src/__init__.py", "src/_util.py", "src/__tests__/t.py", ".github/ci.yml", "docs/_x.md", "node_modules/p/i.py", "src/sp ace+é.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    listing = list_tree(spark, str(tmp_path), ["node_modules"])
    paths = {r.path for r in listing.collect()}
    assert paths == {"src/a.py", "src/__init__.py", "src/_util.py", "src/__tests__/t.py", ".github/ci.yml", "docs/_x.md", "src/sp ace+é.py"}
    wanted = walk(listing, ["src"], ["python"])
    os.chmod(tmp_path / "docs/_x.md", 0)
    assert {(r.file_path, r.text) for r in read_sources(spark, str(tmp_path), wanted).collect()} == {(p, f"# {p}") for p in paths if p.startswith("src/")}
    assert list_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_no_write_passes_as_a_read(spark, tmp_path):
    graph = CodeGraph.from_tables(spark)
    for statement in (
        f"FROM files INSERT OVERWRITE DIRECTORY '{tmp_path}/w' USING parquet SELECT *", "WITH q AS (SELECT * FROM files) INSERT INTO t SELECT * FROM q",
        "CREATE TABLE t AS SELECT 1", "DROP VIEW files", "CACHE TABLE files", "SET x=1",
    ):
        assert is_mutating(statement, spark), statement
        with pytest.raises(MutatingQueryError):
            graph.sql(statement)
    assert not (tmp_path / "w").exists()
    spark.range(3).createOrReplaceTempView("files")
    assert graph.sql("WITH q AS (FROM files) SELECT count(*) AS n FROM q").first().n == 0
    assert not is_mutating("SHOW TABLES", spark) and not is_mutating("(SELECT 1) UNION (VALUES (2))", spark)
    assert spark.table("files").count() == 3
    spark.catalog.dropTempView("files")


def test_one_odd_file_leaves_the_others(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    found = python.extract(spark.createDataFrame([("a.py", deep), ("b.py", None), ("c.py", "def ok(): pass"), ("d.py", "def (")], "file_path string, text string"))
    assert {r.fqn for r in found.symbols.collect()} == {"ok"}
    assert {r.file_path for r in found.errors.collect()} == {"a.py", "b.py", "d.py"}


def test_the_first_append_of_an_id_wins(spark, tmp_path):
    wire = "line long, id string, kn string, cl string, pv string, ts string"
    for run in range(4):
        path = str(tmp_path / f"log{run}")
        for version in (1, 2, 3):
            append_log(schema.conform(spark.createDataFrame([(0, "a1b2c3", "decision", f"version {version}", "u", "20260617143022")], wire), schema.WIRE_RECORD), path)
        append_log(schema.conform(spark.createDataFrame([], wire), schema.WIRE_RECORD), path)
        records, errors = parse_log(read_log_lines(spark, path))
        assert [r.cl for r in records.collect()] == ["version 1"] and sorted(r.line for r in errors.collect()) == [2, 3]


def test_rules_leave_hand_written_files_and_remove_stale_ones(spark, tmp_path):
    (tmp_path / "mine.mdc").write_text("by hand")
    (tmp_path / "old.mdc").write_text(f"body {RULE_MARKER}")
    rows = [("r.mdc", "f", 2, "b", "second"), ("r.mdc", "f", 1, "a", "first"), ("s.mdc", "g", 1, "a", RULE_MARKER)]
    documents = spark.createDataFrame(rows, "rule_file string, file string, priority int, id string, line string")
    write_rules(documents, str(tmp_path))
    assert {f.name for f in tmp_path.iterdir()} == {"mine.mdc", "r.mdc", "s.mdc"}
    assert (tmp_path / "r.mdc").read_text() == "first\nsecond\n" and (tmp_path / "mine.mdc").read_text() == "by hand"
    write_rules(documents.limit(0), str(tmp_path))
    assert {f.name for f in tmp_path.iterdir()} == {"mine.mdc", "r.mdc"}  # r.mdc carries no marker


def test_paths_are_compared_from_the_top(spark):
    given = {"./docs/x.md": "docs/x.md", "docs//a/../x.md": "docs/x.md", "../x": "../x", "a/b/../../c/": "c", "/abs/./p": "/abs/p", "": "", ".": ""}
    rows = spark.createDataFrame([(k,) for k in given], "p string").select("p", relative_path(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in rows} == given


def test_titles_and_reasons(spark):
    cases = [
        ("#\n\nUse X\n", "Use X", None), ("text\n# 0007. Keep queues\n\n## Status\nok\n## Decision\n\nWe keep\nthem.\n\nMore.", "Keep queues", "We keep them."),
        ("# ADR-12: Split\n### decision \nBecause\n# Next", "Split", "Because"), ("## only\n# 3 blind mice", "blind mice", None), ("#no\n", "", None),
        ("# 2024\n", "2024", None), ("", "", None), ("# ADR\n## Decision", "ADR", None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", decision_title(F.col("t")).alias("a"), decision_reason(F.col("t")).alias("b")).collect()
    assert {r.i: (r.a, r.b) for r in rows} == {i: c[1:] for i, c in enumerate(cases)}


def test_objects_that_sql_lines_create(spark):
    lines = {
        "CREATE TABLE IF NOT EXISTS `db`.`t1` (": ("table", "t1"), "create temporary table t2(id int)": ("table", "t2"), "CREATE UNIQUE INDEX i ON table x": None,
        "CREATE OR REPLACE ALGORITHM = MERGE DEFINER=`r`@`%` SQL SECURITY INVOKER VIEW v1 AS": ("view", "v1"), "CREATE MATERIALIZED VIEW s.v2": ("view", "v2"),
        "CREATE DEFINER = admin FUNCTION f1() RETURNS INT": ("function", "f1"), "CREATE OR REPLACE PROCEDURE [dbo].[p1]": ("procedure", "p1"),
        "x; CREATE TRIGGER \"tr\" BEFORE": ("trigger", "tr"), "CREATE TABLE": None, "recreate table q": None, "CREATE TEMPORARY FUNCTION f": None,
    }
    rows = spark.createDataFrame([(k,) for k in lines], "l string").select("l", sql.created_object(F.col("l")).alias("o")).collect()
    assert {r.l: r.o and (r.o.kind, r.o.name) for r in rows} == lines


def test_methods_are_inherited_over_any_number_of_levels(spark):
    n = 26
    rows = [(f"f::C{i}", f"C{i}", "class", "f", 1, 1, "php", i) for i in range(n)] + [(f"f::C{n - 1}.run", f"C{n - 1}.run", "method", "f", 1, 1, "php", n)]
    symbols = resolve.dedup_symbols(spark.createDataFrame(rows, schema.EXTRACTED_SYMBOL))
    extends = spark.createDataFrame([(f"f::C{i}", f"f::C{i + 1}") for i in range(n - 1)] + [(f"f::C{n - 1}", "f::C0")], "src string, dst string")
    refs = spark.createDataFrame([("f::main", "C0.run", "static_call", 1, "f")], schema.CALL_REF)
    assert [r.callee_id for r in resolve.resolve_calls(symbols, refs, extends).collect()] == [f"f::C{n - 1}.run"]


def test_dumps_are_read_by_record_and_line(spark, tmp_path):
    (tmp_path / "log").write_text("abc\x1fRevert \"x\"\x1fbody\nline\x1e\ndef\x1fs\x1fb\x1e")
    (tmp_path / "staged").write_text("D\ta.ts\nR100\tb.ts\tc.ts\n")
    assert [v for v in (r.value.strip() for r in read_git_log(spark, str(tmp_path / "log")).collect()) if v] == ['abc\x1fRevert "x"\x1fbody\nline', "def\x1fs\x1fb"]
    assert [r.value for r in read_staged_changes(spark, str(tmp_path / "staged")).collect()] == ["D\ta.ts", "R100\tb.ts\tc.ts"]


def test_release_deletes_what_this_application_stored(spark, tmp_path, monkeypatch):
    kept = tmp_path / "kinweave" / "another" / "t"
    kept.mkdir(parents=True)
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    assert session.materialize(spark.range(3), "x").count() == 3
    assert len(list((tmp_path / "kinweave").iterdir())) == 2
    session.release(spark)
    assert [p.name for p in (tmp_path / "kinweave").iterdir()] == ["another"]
