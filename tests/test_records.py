"""The record log: validation, liveness, indexing, scoped lookup and drift."""

import json

import pytest

from kinweave.graph import CodeGraph
from kinweave.operators import drift, lookup
from kinweave.operators.records import apply_index, index_records
from kinweave.plans.index import reindex
from kinweave.plans.records import admit_records
from kinweave.sources.record_log import append_log, live_records, parse_log, read_log_lines


def rec(**over):
    return {"id": "a1b2c3", "kn": "decision", "cl": "use composite key", "pv": "u", "ts": "20260617143022"} | over


def lines(spark, *records):
    rows = [(i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "line bigint, value string")


BAD = {
    "malformed": '{"id": "x"',
    "object": "[1]",
    "id": rec(id="Nope!"),
    "kn": rec(kn="note"),
    "cl": rec(cl="  \n "),
    "cl-type": rec(cl=7),
    "pv": rec(pv="z:1"),
    "pv-empty": rec(pv="t:"),
    "ts": rec(ts="20260231000000"),
    "ts-hour": rec(ts="20260617253022"),
    "ts-short": rec(ts="2026061714302"),
    "sb": rec(sb="x"),
    "sb-null": rec(sb=None),
    "sb-empty": rec(sb=[""]),
    "sb-type": rec(sb=["a", 1]),
    "ss": rec(ss=""),
    "wn+tn": rec(kn="behavior"),
    "gv": rec(gv="x"),
    "rf": rec(kn="source"),
    "rf-misplaced": rec(rf="docs/a.md"),
}
GOOD = [
    rec(id="g1"), rec(id="g2", sb=[]), rec(id="g3", sb=["a", "b"], ss="g1"), rec(id="g4", kn="behavior", wn="w", tn="t", gv="g"),
    rec(id="g5", kn="source", rf="docs/a.md"), rec(id="g6", pv="n:src/a.ts:3"), rec(id="g7", ts="20240229235959"),
]


def test_validation(spark):
    good, errors = parse_log(lines(spark, *BAD.values(), "", *GOOD))
    assert {r.id for r in good.collect()} == {r["id"] for r in GOOD}
    per_line = {}
    for r in errors.collect():
        per_line.setdefault(r.line, []).append(r.message)
    assert set(per_line) == set(range(1, len(BAD) + 1))
    for number, name in enumerate(BAD, 1):
        for key in name.split("-")[0].split("+"):
            assert any(key in m for m in per_line[number]), (name, per_line[number])


def test_repeated_ids(spark):
    good, errors = parse_log(lines(spark, rec(), rec(), rec(cl="other"), rec(id="b2")))
    assert sorted((r.id, r.line) for r in good.collect()) == [("a1b2c3", 1), ("b2", 4)]
    assert [(r.line, r.id) for r in errors.collect()] == [(3, "a1b2c3")]


def test_liveness(spark):
    good, _ = parse_log(
        lines(spark, rec(id="a"), rec(id="b", ss="a"), rec(id="c", ss="b"), rec(id="d", ss="gone"),
              rec(id="e", ss="f"), rec(id="f", ss="e"), rec(id="h", ss="h"))
    )
    assert {r.id for r in live_records(good).collect()} == {"c", "d"}


def test_append_and_read_keeps_line_numbers(spark, tmp_path):
    path = tmp_path / "log.ndjson"
    path.write_text("\n".join(json.dumps(rec(id=f"r{i}")) if i != 7 else "" for i in range(200)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        numbered = {r.line: r.value for r in read_log_lines(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(numbered) == 200 and numbered[8] == ""
    assert all(json.loads(v)["id"] == f"r{n - 1}" for n, v in numbered.items() if v)
    good, _ = parse_log(lines(spark, *GOOD))
    append_log(good, str(tmp_path / "out"))
    again, errors = parse_log(read_log_lines(spark, str(tmp_path / "out")))
    assert errors.count() == 0
    assert sorted(map(str, again.drop("line").collect())) == sorted(map(str, good.drop("line").collect()))


SYMBOLS = [("src/a.ts::Svc", "Svc"), ("src/a.ts::Svc.run", "Svc.run"), ("apps/bmf/src/x.ts::X", "X"), ("apps/bmfx/src/y.ts::Y", "Y")]
RECORDS = [
    rec(id="aaa1", kn="gotcha", cl="method trap", sb=["src/a.ts::Svc.run"]),
    rec(id="bbb2", kn="constraint", cl="class invariant", sb=["src/a.ts::Svc"]),
    rec(id="ccc3", kn="intent", cl="file purpose", sb=["src/a.ts"]),
    rec(id="ddd4", kn="rejected", cl="tried caching", pv="t:tests/gone.ts"),
    rec(id="eee5", cl="old", sb=["src/a.ts::Svc"]),
    rec(id="fff6", cl="new", sb=["src/a.ts::Svc"], ss="eee5"),
    rec(id="sss7", kn="source", cl="protocol", rf="docs/none.md", sb=["src/a.ts::Svc", "src/a.ts::Svc.run"]),
    rec(id="mod8", kn="constraint", cl="module rule", sb=["apps/bmf/src", "apps/bmf/src/x.ts"]),
    rec(id="lost9", cl="about nothing", sb=["src/gone.ts::G"], pv="d:docs/a.md"),
]


@pytest.fixture(scope="module")
def world(spark):
    symbols = spark.createDataFrame(SYMBOLS, "id string, fqn string").selectExpr(
        "id", "fqn", "'class' AS symbol_type", "substring_index(id, '::', 1) AS file_path"
    )
    files = symbols.selectExpr("file_path AS id", "file_path AS path", "'.ts' AS ext", "'source' AS kind").distinct()
    listing = spark.createDataFrame(
        [("src/a.ts",), ("apps/bmf/src/x.ts",), ("apps/bmfx/src/y.ts",), ("docs/a.md",)], "path string"
    )
    graph = CodeGraph.from_tables(spark, symbols=symbols, files=files)
    log, errors = parse_log(lines(spark, *RECORDS))
    index = index_records(graph, log, listing)
    return graph, log, errors, listing, index, apply_index(graph, index)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed string")


def test_index(world):
    index = world[4]
    assert [(r.record_id, r.subject) for r in index.unresolved.collect()] == [("lost9", "src/gone.ts::G")]
    assert [(r.id, r.kind) for r in index.anchors.collect()] == [("apps/bmf/src", "dir")]
    assert [(r.src, r.dst) for r in index.supersedes.collect()] == [("fff6", "eee5")]


def test_records_for_symbol(spark, world):
    graph = world[5]
    found = lookup.records_for_symbols(graph, seeds(spark, "src/a.ts::Svc.run"))
    ordered = [r.id for r in lookup.order_records(found).collect()]
    assert ordered == ["aaa1", "bbb2", "fff6", "sss7", "ccc3"]
    everything = lookup.records_for_symbols(graph, seeds(spark, "src/a.ts::Svc"), include_superseded=True)
    assert "eee5" in {r.id for r in everything.collect()}
    assert {r.id for r in lookup.records_for_symbols(graph, seeds(spark, "src/a.ts")).collect()} == {
        "aaa1", "bbb2", "ccc3", "fff6", "sss7"
    }
    near = lookup.records_for_symbols(graph, seeds(spark, "apps/bmf/src/x.ts::X", "apps/bmfx/src/y.ts::Y")).collect()
    assert [(r.seed, r.id) for r in near] == [("apps/bmf/src/x.ts::X", "mod8")]


def test_context_counts_each_record_once(spark, world):
    graph = world[5]
    files = spark.createDataFrame([("src/a.ts",), ("apps/bmf/src/x.ts",), ("apps/bmf/src/new.ts",)], "file string")
    rows = lookup.context_for_files(graph, files, limit=2).collect()
    assert {(r.file, r.id, r.scope, r.anchor_dir, r.total) for r in rows} == {
        ("src/a.ts", "aaa1", 0, None, 5), ("src/a.ts", "bbb2", 0, None, 5),
        ("apps/bmf/src/x.ts", "mod8", 0, None, 1), ("apps/bmf/src/new.ts", "mod8", 97, "apps/bmf/src", 1),
    }
    text = {(r.file, r.position): r.line for r in lookup.context_lines(lookup.context_for_files(graph, files, 2)).collect()}
    assert text["src/a.ts", 1] == "  • [gotcha] method trap  (aaa1, u)"
    assert text["src/a.ts", 3].strip().startswith("… 3 more")
    assert "[module: apps/bmf/src]" in text["apps/bmf/src/new.ts", 1]


def test_drift(world):
    graph, log, errors, listing, *_ = world
    report = drift.drift_report(graph, log, errors, listing)
    # drift looks at graph nodes only, so the on-disk directory counts until it is indexed
    assert {(r.record_id, r.subject) for r in report.unresolved.collect()} == {
        ("lost9", "src/gone.ts::G"), ("mod8", "apps/bmf/src")
    }
    assert {(r.record_id, r.pointer) for r in report.fabricated_refs.collect()} == {("ddd4", "tests/gone.ts")}
    assert {(r.record_id, r.ref) for r in report.missing_refs.collect()} == {("sss7", "docs/none.md")}
    keys = drift.drift_keys(report)
    seen = keys.filter("record_id <> 'lost9'")
    assert [r.key for r in drift.new_drift(keys, seen).collect()] == ["lost9 src/gone.ts::G"]


def test_staged_changes(spark, world):
    dump = spark.createDataFrame(
        [("D\tsrc/a.ts",), ("R100\tapps/bmf/src/x.ts\tb.ts",), ("M\tapps/bmfx/src/y.ts",), ("A\tsrc/n.ts",), ("",)], "value string"
    )
    changes = drift.staged_changes(dump)
    assert {(r.path, r.change) for r in changes.collect()} == {
        ("src/a.ts", "removed"), ("apps/bmf/src/x.ts", "removed"), ("apps/bmfx/src/y.ts", "modified")
    }
    hits = drift.staged_check(world[5], changes).collect()
    assert {(r.severity, r.record_id) for r in hits} == {
        ("violation", i) for i in ("aaa1", "bbb2", "ccc3", "fff6", "sss7", "mod8")
    }


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, mtime bigint")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, mtime bigint")
    assert {(r.path, r.status) for r in drift.manifest_diff(old, new).collect()} == {
        ("b", "changed"), ("c", "deleted"), ("d", "added")
    }


def test_admission(spark, world):
    _, log, _, listing, *_ = world
    wanted = spark.createDataFrame(
        [("decision", "fine", None, None, "d:docs/a.md"), ("source", "no ref", None, None, None),
         ("decision", "lost", "zzz", None, "a"), ("decision", "made up", None, None, "t:tests/nope.ts"),
         ("decision", "newer", "fff6", None, None)],
        "kn string, cl string, ss string, rf string, pv string",
    )
    from pyspark.sql import functions as F

    good, bad = admit_records(log, wanted, listing, F.lit("20260101000000"))
    rows = good.collect()
    assert {r.cl for r in rows} == {"fine", "newer"} and all(len(r.id) == 10 for r in rows)
    assert {r.pv for r in rows} == {"d:docs/a.md", "a"}
    assert {r.claim for r in bad.collect()} == {"no ref", "lost", "made up"}


def test_reindex_is_refused_while_the_log_has_errors(spark, world):
    graph = world[0]
    same, errors = reindex(graph, lines(spark, rec(), "{"))
    assert errors.count() == 1 and same.records.count() == 0
    fresh, errors = reindex(graph, lines(spark, rec()))
    assert errors.count() == 0 and fresh.records.count() == 1
