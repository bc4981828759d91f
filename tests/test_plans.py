"""Indexing, incremental analysis, stored tables and streaming."""

import json
import os

from kinweave.plans import index as ix
from kinweave.sources import files, tables
from kinweave.streaming import watch


def build(spark, sources, languages):
    rows = spark.createDataFrame(list(sources.items()), "file_path string, text string")
    return ix.link(ix.build_index(rows, languages))


def pairs(graph):
    return {(r.src.split("::")[1], r.dst.split("::")[1]) for r in graph.calls.collect()}


PHP = {
    "src/cache.php": "<?php\nclass Base { public function clear(): void {} public function set($v) {} }\n"
    "class Mid extends Base {}\nclass Child extends Mid {\n  public function reset(): void { $this->clear(); }\n"
    "  public function set($v) { parent::set($v); }\n}",
    "src/svc.php": "<?php\nclass Service {\n  public function __construct(private VendorClient $client) {}\n"
    "  public function run(): void {\n    $this->client->send();\n    $this->helper();\n  }\n  public function helper(): void {}\n}",
}


def test_php_resolution(spark):
    graph = build(spark, PHP, ["php"])
    assert pairs(graph) == {("Child.reset", "Base.clear"), ("Child.set", "Base.set"), ("Service.run", "Service.helper")}
    assert {(r.src, r.dst) for r in graph.extends.collect()} == {
        ("src/cache.php::Child", "src/cache.php::Mid"), ("src/cache.php::Mid", "src/cache.php::Base")
    }
    missing = {r.fqn: r.unresolved_calls for r in graph.symbols.collect()}
    assert missing["Service.run"] == 1 and missing["Service.helper"] == 0
    contains = {(r.src, r.src_label, r.dst) for r in graph.contains.collect()}
    assert ("src/svc.php", "File", "src/svc.php::Service") in contains
    assert ("src/svc.php::Service", "CodeSymbol", "src/svc.php::Service.run") in contains


def test_overloads_collapse(spark):
    source = "class Box:\n    def get(self, i): ...\n    def get(self, i): ...\n    def get(self, i):\n        return i\n"
    graph = build(spark, {"src/over.py": source}, ["python"])
    assert [r.line_start for r in graph.symbols.filter("fqn = 'Box.get'").collect()] == [2]


def write(root, sources):
    for path, body in sources.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)


def test_analyze_modes(spark, tmp_path):
    root, state, log = tmp_path / "proj", str(tmp_path / "state"), tmp_path / "log.ndjson"
    write(root, {
        "src/a.py": "def helper():\n    pass\n", "src/b+c d.py": "def run():\n    helper()\n    gone()\n",
        "src/node_modules/x.py": "def vendored(): pass\n", "other/y.py": "def outside(): pass\n",
    })
    log.write_text(json.dumps({"id": "r1", "kn": "gotcha", "cl": "c", "pv": "u", "ts": "20260101000000", "sb": ["src/a.py::helper", "other"]}) + "\n")
    config = tables.Config(languages=["python"])
    first = ix.analyze(spark, str(root), state, config, str(log))
    assert first.mode == "full" and pairs(first.graph) == {("run", "helper")}
    assert {r.id for r in first.graph.files.filter("kind = 'source'").collect()} == {"src/a.py", "src/b+c d.py"}
    assert {(r.dst, r.dst_label) for r in first.graph.about.collect()} == {("src/a.py::helper", "CodeSymbol"), ("other", "File")}
    summary = {r.metric: r.value for r in ix.index_summary(first.index, first.graph).collect()}
    assert summary["call_edges"] == 1 and summary["parse_errors"] == 0

    assert ix.analyze(spark, str(root), state, config).mode == "skip"
    write(root, {"src/c.py": "def gone():\n    pass\n"})
    os.remove(root / "src/a.py")
    second = ix.analyze(spark, str(root), state, config)
    # the untouched caller loses one edge and gains another
    assert second.mode == "incremental" and pairs(second.graph) == {("run", "gone")}

    tables.save_graph(second.graph, str(tmp_path / "graph"))
    again = tables.load_graph(spark, str(tmp_path / "graph"))
    assert pairs(again) == {("run", "gone")}


def test_bucketed_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kin")
    graph = build(spark, {"src/a.py": "def f():\n    g()\ndef g():\n    pass\n"}, ["python"])
    tables.save_bucketed(graph, "kin", 2)
    assert pairs(tables.load_bucketed(spark, "kin")) == {("f", "g")}


def test_missing_tables_load_empty(spark, tmp_path):
    assert tables.load_graph(spark, str(tmp_path / "nothing")).calls.count() == 0


def test_config():
    assert tables.Config.from_json("{").languages == ["typescript"]
    config = tables.Config.from_json('{"analyze": {"include": ["lib"]}, "knowledge": {"notify": "loud"}}')
    assert (config.include, config.notify) == (["lib"], "inferred")
    assert tables.Config.from_json(config.to_json()) == config


def test_decision_documents(spark):
    names = ["docs/adr/1.md", "docs/adr/README.md", "docs/adr/deep/2.md", "notes/x.md", "y.md", "adr/z.txt"]
    listing = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.path for r in files.decision_documents(listing).collect()] == ["docs/adr/1.md"]
    assert [r.path for r in files.decision_documents(listing, ["notes/", "y.md"], False).collect()] == ["notes/x.md", "y.md"]


def test_stale_rules(spark):
    from kinweave.operators.lookup import RULE_MARKER

    existing = spark.createDataFrame([("a.mdc", f"x {RULE_MARKER}"), ("b.mdc", f"y {RULE_MARKER}"), ("mine.mdc", "z")], "rule_file string, body string")
    current = spark.createDataFrame([("a.mdc",)], "rule_file string")
    assert [r.rule_file for r in tables.stale_rules(existing, current).collect()] == ["b.mdc"]


EVENTS = [("p", "src/a", "2026-01-01 00:00:00"), ("p", "src/a", "2026-01-01 00:00:01"), ("p", "src/b", "2026-01-01 00:00:02"),
          ("p", "src/a", "2026-01-01 00:00:10"), ("q", "src/z", "2026-01-01 00:00:01"), ("p", ".git/x", "2026-01-01 00:00:05")]


def test_debounce(spark):
    raw = spark.createDataFrame(EVENTS, "root string, path string, at string")
    for kind in ("timestamp", "timestamp_ntz"):
        events = watch.watched(raw.selectExpr("root", "path", f"CAST(at AS {kind}) AS ts"), [])
        assert sorted((r.root, r.n_events) for r in watch.flush_windows(events).collect()) == [("p", 1), ("p", 3), ("q", 1)]
        batches = sorted((r.root, r.start.second, r.path, r.n_events) for r in watch.flush_batches(events).collect())
        assert batches == [("p", 0, "src/a", 2), ("p", 0, "src/b", 1), ("p", 10, "src/a", 1), ("q", 1, "src/z", 1)]


def test_streams(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    for i, chunk in enumerate((EVENTS, [("p", "src/late", "2026-01-01 00:10:00")])):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("root", "path", "ts"), e))) for e in chunk))

    def stream():
        return spark.readStream.schema("root string, path string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))

    query = (
        watch.stream_flush_windows(watch.watched(stream(), []), late="1 second").writeStream.outputMode("append")
        .format("memory").queryName("bursts").start()
    )
    query.processAllAvailable()
    query.stop()
    assert sorted((r.root, r.n_events) for r in spark.table("bursts").collect()) == [("p", 1), ("p", 3), ("q", 1)]

    flushed = []
    query = watch.reindex_on_change(
        stream(), lambda changed: flushed.append(sorted(r.path for r in changed.collect())), str(tmp_path / "cp"), trigger="0 seconds"
    )
    query.processAllAvailable()
    query.stop()
    assert sorted(flushed) == sorted([["src/a", "src/b", "src/z"], ["src/late"]])
