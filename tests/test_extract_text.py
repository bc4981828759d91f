"""Python, SQL and prose extraction, and text functions."""

import pytest
from pyspark.sql import functions as F

from kinweave.extract import knowledge, python
from kinweave.extract.sql import sql_symbols
from kinweave.functions import paths, text
from kinweave.plans.records import drop_known, extracted_knowledge


def one(spark, source, path="a.txt"):
    return spark.createDataFrame([(path, source)], "file_path string, text string")


def evaluate(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()
    return [r[0] for r in rows]


PY = '''"""Doc."""
MAX_RETRIES = 3
timeout = 30

def total(items):
    return sum(items)

class Order:
    STATUS: str = "open"

    def __init__(self, c):
        self.total()
        Other.make(self.c.deep())

    @property
    def empty(self):
        def hidden(): pass
        return total(Widget())

    class Line:
        def price(self): return 0
'''


def test_python(spark):
    files = spark.createDataFrame([("o.py", PY), ("bad.py", "def ("), ("void.py", "")], "file_path string, text string")
    found = python.extract(files)
    assert {(r.fqn, r.symbol_type, r.line_start, r.line_end) for r in found.symbols.collect()} == {
        ("MAX_RETRIES", "constant", 2, 2), ("total", "function", 5, 6), ("Order", "class", 8, 21),
        ("Order.STATUS", "constant", 9, 9), ("Order.__init__", "method", 11, 13), ("Order.empty", "method", 16, 18),
        ("Order.Line", "class", 20, 21), ("Order.Line.price", "method", 21, 21),
    }
    assert {(r.caller_id, r.target_name, r.kind) for r in found.refs.collect()} == {
        ("o.py::total", "sum", "static_call"), ("o.py::Order.__init__", "Order.total", "static_call"),
        ("o.py::Order.__init__", "Other.make", "static_call"), ("o.py::Order.empty", "total", "static_call"),
        ("o.py::Order.empty", "Widget", "instantiation"),
    }
    assert [r.file_path for r in found.errors.collect()] == ["bad.py"]


SQL = """-- CREATE TABLE ghost (id INT);
CREATE TABLE IF NOT EXISTS inventory.`stock` (
  id INT
);
create or replace algorithm = merge definer = root@localhost sql security invoker view v AS SELECT 1;
CREATE MATERIALIZED VIEW mv AS SELECT 1;
ALTER TABLE x ADD y INT; DROP TABLE z;
CREATE OR REPLACE FUNCTION f() RETURNS INT
BEGIN END;
CREATE PROCEDURE [p](); CREATE TRIGGER t
"""


def test_sql(spark):
    rows = sql_symbols(one(spark, SQL, "db/x.sql")).orderBy("line_start").collect()
    assert [(r.fqn, r.symbol_type, r.line_start, r.line_end) for r in rows] == [
        ("stock", "table", 2, 4), ("v", "view", 5, 5), ("mv", "view", 6, 7), ("f", "function", 8, 9), ("p", "procedure", 10, 11),
    ]
    assert rows[0].id == "db/x.sql::stock"


SQL_LINES = """SELECT 1; CREATE INDEX i ON a(b); CREATE TABLE t1 (x INT);
/* create */ CREATE TABLE t2 (
CREATE VIEW v3 AS SELECT 1; create temporary   table if not exists a.[t3] (x INT)
CREATE  FUNCTION create()
CREATE OR REPLACE UNIQUE INDEX i; CREATE SCHEMA s
create definer = `r`@`h` procedure "p5"() ; CREATE TRIGGER g
CREATE TABLE IF (x INT)
CREATE materialized or replace VIEW w
"""


def test_every_create_of_a_line_is_looked_at(spark):
    rows = sql_symbols(one(spark, SQL_LINES, "db/y.sql")).orderBy("line_start").collect()
    assert [(r.fqn, r.symbol_type, r.line_start, r.line_end) for r in rows] == [
        ("t1", "table", 1, 1), ("t2", "table", 2, 2), ("t3", "table", 3, 3), ("create", "function", 4, 5), ("p5", "procedure", 6, 6), ("IF", "table", 7, 9),
    ]
    many = one(spark, "CREATE INDEX i; " * 20_000 + "CREATE VIEW last AS SELECT 1", "db/z.sql")
    assert [r.fqn for r in sql_symbols(many).collect()] == ["last"]


def test_readers_evaluate_each_step_once(spark):
    """The size of a plan is that of what is written: helpers that use a value twice do not copy its tree."""
    def splits(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("split(")

    files = one(spark, "x", "a")
    assert splits(sql_symbols(files)) < 12
    assert splits(knowledge.scan_decisions(files)) < 12
    assert splits(knowledge.scan_markers(files)) < 12


def test_markers(spark):
    source = "\n".join(
        ["// HACK: first", "x # fixme - second", "/* WARNING: third */", "// TODO: no", "// this is a HACK: no", "// HACK", "* Danger  x */ y", "// C++: custom",
         "/* XXX: */", "// HACK --", "// HACK:", "# hack: crlf \r"]
    )
    found = knowledge.scan_markers(one(spark, source), knowledge.merge_markers(["c++"]))
    assert [(r.line, r.marker, r.claim) for r in found.orderBy("line").collect()] == [
        (1, "HACK", "first"), (2, "FIXME", "second"), (3, "WARNING", "third"), (7, "DANGER", "x */ y"), (8, "C++", "custom"),
        (9, "XXX", "*/"), (10, "HACK", "-"), (12, "HACK", "crlf"),
    ]
    source = "\n".join(
        ["a // x # ** HACK: late * more // end", "///HACK: slashes", "url http://hack no", "/** WARNING- doc */", "#*# Xxx : z", "HACK: no sign", "// HACKS: no", "// fixme:no gap",
         "// c#: sharp", "a*b#c//d " * 3000 + "// danger: far"]
    )
    found = knowledge.scan_markers(one(spark, source), knowledge.merge_markers(["c#"]))
    assert [(r.line, r.marker, r.claim) for r in found.orderBy("line").collect()] == [
        (1, "HACK", "late * more // end"), (2, "HACK", "slashes"), (3, "HACK", "no"), (4, "WARNING", "doc"), (5, "XXX", "z"), (8, "FIXME", "no gap"),
        (9, "C#", "sharp"), (10, "DANGER", "far"),
    ]


def test_reverts(spark):
    log = spark.createDataFrame(
        [('0123456789abcdef\x1fRevert "Cache it"\x1fbody',), ("\nfeed\x1fAdd x\x1f",), ("",), ('\nbeef\x1f Revert "a \\"b\\"" \x1f',)], "value string"
    )
    assert {(r.sha, r.claim) for r in knowledge.scan_reverts(log).collect()} == {("012345678", "Cache it"), ("beef", 'a \\"b\\"')}


def test_decisions(spark):
    docs = spark.createDataFrame(
        [
            ("a.md", "# ADR-12: Use X\n\n## Status\nok\n\n## Decision\n\nBecause\n it is  fast.\n\nMore"),
            ("b.md", "# 0003. Keep Y\n\n## Consequences\n"), ("c.md", "no title"), ("d.md", "# T\n### decision\n## Next\n"),
        ],
        "file_path string, text string",
    )
    assert {(r.file_path, r.claim, r.because) for r in knowledge.scan_decisions(docs).collect()} == {
        ("a.md", "Use X", "Because it is fast."), ("b.md", "Keep Y", None), ("d.md", "T", "## Next"),
    }


def test_bootstrap_is_idempotent(spark):
    sources = one(spark, "// HACK: Same  claim\n// HACK: same claim\n// FIXME: other", "src/a.ts")
    none = spark.createDataFrame([], "value string")
    docs = one(spark, "# Use X", "docs/adr/1.md")
    found = extracted_knowledge(sources, none, docs, knowledge.merge_markers())
    empty = spark.createDataFrame([], "kn string, cl string")
    added = drop_known(found, empty)
    assert {(r.kn, r.cl, r.pv) for r in added.collect()} == {
        ("gotcha", "Same  claim", "n:src/a.ts:1"), ("gotcha", "other", "n:src/a.ts:3"), ("decision", "Use X", "d:docs/adr/1.md"),
    }
    assert drop_known(found, added.select("kn", "cl")).count() == 0


def test_clip_counts_utf16_units(spark):
    values = ["x" * 280, "x" * 281, "  y ", "😀" * 140, "😀" * 141, "x" + "😀" * 140, "a" * 278 + " b" * 3]
    got = evaluate(spark, text.clip, *values)
    assert got[0] == "x" * 280 and got[1] == "x" * 279 + "…" and got[2] == "y"
    assert got[3] == "😀" * 140 and got[4] == "😀" * 139 + "…" and got[5] == "x" + "😀" * 139 + "…"
    assert got[6] == "a" * 278 + "…"


@pytest.mark.parametrize(
    ("path", "dirs"),
    [("apps/bmf/src/Foo.php", ["apps/bmf/src", "apps/bmf", "apps"]), ("README.md", []), ("/foo/bar/baz.php", ["foo/bar", "foo"]), ("", [])],
)
def test_ancestor_dirs(spark, path, dirs):
    assert evaluate(spark, paths.ancestor_dirs, path) == [dirs]


def test_path_functions(spark):
    assert evaluate(spark, paths.dir_depth, "", "/a/", "a/b/c") == [0, 1, 3]
    assert evaluate(spark, paths.extension, "a/B.TS", ".env", "Makefile", "x.tar.gz") == [".ts", "", "", ".gz"]
    assert evaluate(spark, paths.rule_file_name, "src/a.ts") == ["kinweave-src-a-ts.mdc"]
    assert evaluate(spark, lambda c: paths.under_excluded_dir(c, ["dist"]), "dist/a.ts", "a/dist/b", "a/dist") == [True, True, False]
    assert evaluate(spark, lambda c: paths.watch_ignored(c, ["dist"]), ".git/x", "a/dist", ".kinweave", "src/a") == [True, True, True, False]
    assert evaluate(spark, text.identifier_words, "Tax.signInWith_big__X") == [["Tax", "sign", "In", "With", "big", "X"]]
    assert evaluate(spark, text.is_local_ref, "docs/a.md", "HTTPS://x", "git+ssh://x") == [True, False, False]
    assert evaluate(spark, text.is_constant_name, "MAX_1", "_", "Max") == [True, False, False]
