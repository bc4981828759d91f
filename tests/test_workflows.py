"""Workflows from the tree and the log to the appended records and the hook's answer."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.graph import CodeGraph
from kinweave.operators.drift import drift_report
from kinweave.plans import workflows
from kinweave.sources.files import list_tree
from kinweave.sources.tables import Config



def now():
    return F.lit("20260617143022")


def test_records_are_added_refused_and_noticed(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/_a.md").write_text("x")
    log, listing = str(tmp_path / "log"), list_tree(spark, str(tmp_path))
    wanted = spark.createDataFrame(
        [("decision", "keep it", "d:./docs/_a.md"), ("decision", "invented", "d:docs/none.md"), ("gotcha", "seen", "a")], "kn string, cl string, pv string"
    )
    first = workflows.add_records(spark, log, wanted, listing, now())
    assert {r.cl for r in first.accepted.collect()} == {"keep it", "seen"} and [r.cl for r in first.notices.collect()] == ["seen"]
    assert [r.claim for r in first.rejected.collect()] == ["invented"]
    (tmp_path / "log" / "broken").write_text("{no json\n")
    again = workflows.add_records(spark, log, wanted, listing, now())
    assert again.accepted.isEmpty() and again.log_errors.count() == 1


def test_bootstrap_reads_tree_dump_and_documents_once(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"src/__init__.py": "# HACK: order matters\n", "docs/adr/_1.md": "#\n\n1. Use queues\n\n## Decision\n\nThey decouple.\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (tmp_path / "dump").write_text('0123456789ab\x1fRevert "faster path"\x1fbody\x1e')
    run = lambda: workflows.bootstrap_tree(
        spark, str(root), str(tmp_path / "log"), Config(languages=["python"]), now(), git_dump=str(tmp_path / "dump")
    )
    assert {(r.kn, r.cl) for r in run().accepted.collect()} == {("gotcha", "order matters"), ("rejected", "faster path"), ("decision", "Use queues")}
    assert run().accepted.isEmpty()


def test_hook_shows_drift_once_and_invalid_lines_always(spark, tmp_path):
    graph = CodeGraph.from_tables(spark)
    wire = "line long, id string, kn string, sb array<string>, cl string, pv string, ts string"
    log = lambda rows: schema.conform(spark.createDataFrame(rows, wire), schema.WIRE_RECORD)
    errors = spark.createDataFrame([(9, None, "malformed JSON")], "line long, id string, message string")
    nothing = spark.createDataFrame([], "path string, mtime long")
    one, state = [(1, "r1", "gotcha", ["a::B"], "c", "u", "20260617143022")], str(tmp_path / "state")
    show = lambda rows: sorted((r.signal, r.text) for r in workflows.hook_check(spark, drift_report(graph, log(rows), errors, nothing), state).collect())
    invalid = ("invalid", "9 malformed JSON")
    assert show(one) == [("drift", "r1 a::B"), invalid]
    assert show(one) == [invalid] and show([]) == [invalid]
    assert show(one) == [("drift", "r1 a::B"), invalid]


def test_server_info_and_diagnosis(spark, tmp_path):
    graph, log = CodeGraph.from_tables(spark), schema.empty(spark, schema.WIRE_RECORD)
    assert workflows.server_info(spark, graph, log, str(tmp_path), "12")["in_sync"] is None
    workflows.save_build(spark, str(tmp_path), "13")
    info = workflows.server_info(spark, graph, log, str(tmp_path), "12")
    assert (info["in_sync"], info["advice"], info["stale"]) == (False, "restart this session", False)

    def says(statement):
        try:
            graph.sql(statement).collect()
        except AnalysisException as error:
            return workflows.diagnose(error)

    assert says("SELECT nope FROM files").startswith("unknown column")
    assert says("SELECT * FROM nothing_here").startswith("missing table")
    assert workflows.diagnose(ValueError("odd")).endswith("odd")
