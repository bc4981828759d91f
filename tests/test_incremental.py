"""Versions of stored tables, and linking after changes against a build from scratch."""

import os
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kinweave.plans import index as ix
from kinweave.sources import tables
from kinweave.sources.versions import Conflict, Versions, bucket_of


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key string").withColumn("bucket", bucket_of(F.col("key"), 8))


KEY = tables.schema._table("key string")


def keys(versions, number=None):
    return sorted(r.key for r in versions.read("t", KEY, number).collect())


def test_versions_replace_buckets_and_keep_earlier_ones(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "state"))
    assert versions.latest() is None and keys(versions) == []
    one = versions.commit({"t": (rows(spark, "a", "b", "c"), None)}, None)
    of_a = rows(spark, "a").first()["bucket"]
    same = [k for k in "abc" if rows(spark, k).first()["bucket"] == of_a]
    two = versions.commit({"t": (rows(spark, "a").withColumn("key", F.lit("a2")), [of_a])}, one)
    assert keys(versions, one) == ["a", "b", "c"] and keys(versions) == sorted({"a", "b", "c", "a2"} - set(same))
    assert sorted(r.key for r in versions.read("t", KEY, two, [of_a]).collect()) == ["a2"]
    three = versions.commit({"t": (rows(spark).limit(0), [of_a])}, two)  # a bucket may become empty
    assert "a2" not in keys(versions, three)
    with pytest.raises(Conflict):
        versions.commit({"t": (rows(spark, "x"), None)}, two)
    assert keys(versions, three) == keys(versions)
    assert versions.vacuum(keep=1) == []  # fresh folders may belong to a writer
    assert versions.numbers() == [three]
    removed = versions.vacuum(keep=1, older_than=-10)
    assert removed and keys(versions) == sorted({"b", "c"} - set(same))
    versions.drop()
    assert versions.latest() is None


def test_a_killed_write_leaves_the_old_state(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "state"))
    versions.commit({"t": (rows(spark, "a"), None)}, None)
    broken = rows(spark, "b").withColumn("key", F.expr("raise_error('lost')"))
    with pytest.raises(Exception, match="lost"):
        versions.commit({"t": (rows(spark, "n"), None), "u": (broken, None)}, 1)
    assert versions.latest() == 1 and keys(versions) == ["a"]
    tables.save_state(spark.createDataFrame([("x",)], "key string"), str(tmp_path / "drift"))
    tables.save_state(tables.load_state(spark, str(tmp_path / "drift"), KEY).withColumn("key", F.concat("key", F.lit("y"))), str(tmp_path / "drift"))
    assert [r.key for r in tables.load_state(spark, str(tmp_path / "drift"), KEY).collect()] == ["xy"]
    assert tables.load_state(spark, str(tmp_path / "never"), KEY).count() == 0
    (folders,) = [list(b.values()) for b in versions.tables().values()]
    for parts in folders:
        for part in parts:
            for name in os.listdir(tmp_path / "state" / part):
                os.remove(tmp_path / "state" / part / name)
    with pytest.raises(AnalysisException):  # lost rows are no empty table
        versions.read("t", KEY).count()


def test_published_graphs_can_be_dropped(spark, tmp_path):
    source = spark.createDataFrame([("src/a.py", "def f():\n    g()\ndef g():\n    pass\n")], "file_path string, text string")
    graph = ix.link(ix.build_index(source, ["python"]))
    path = str(tmp_path / "graphs")
    one, two = tables.publish_graph(graph, path), tables.publish_graph(graph.with_tables(calls=graph.calls.limit(0)), path)
    assert (tables.open_graph(spark, path, one).calls.count(), tables.open_graph(spark, path).calls.count()) == (1, 0)
    assert tables.drop_graphs(spark, path, keep=1, older_than=-10) and tables.open_graph(spark, path).symbols.count() == 2
    with pytest.raises(Exception, match="00000001"):
        tables.open_graph(spark, path, one)
    assert two == 2 and tables.drop_graphs(spark, path) == [path] and tables.open_graph(spark, path).symbols.count() == 0


def _php(rng, i, n):
    """A class whose parent, methods and calls are drawn."""
    parent = f" extends K{rng.randrange(n)}" if rng.random() < 0.7 else ""
    methods = "".join(
        f"  public function m{m}() {{ $this->m{rng.randrange(4)}(); K{rng.randrange(n)}::m{rng.randrange(4)}(); parent::m{rng.randrange(4)}(); new K{rng.randrange(n)}(); }}\n"
        for m in range(4) if rng.random() < 0.4
    )
    name = f"K{i if rng.random() < 0.9 else rng.randrange(n)}"  # now and then a second definition of a class
    return f"<?php\nclass {name}{parent} {{\n{methods}}}\n"


def _write(root, path, text, tick):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    os.utime(target, (tick, tick))


def _tables(graph):
    return {name: sorted(map(repr, df.collect())) for name, df in graph.tables().items()}


def test_linking_after_changes_equals_a_full_build(spark, tmp_path):
    rng = random.Random(7)
    root, n, tick = tmp_path / "proj", 16, 1_700_000_000
    for i in range(n):
        _write(root, f"src/k{i}.php", _php(rng, i, n), tick)
    config, state = tables.Config(languages=["php"]), str(tmp_path / "state")
    assert ix.analyze(spark, str(root), state, config, buckets=8).mode == "full"
    for step in range(2):
        tick += 10
        for k, i in enumerate(rng.sample(range(n), 3)):
            path = root / f"src/k{i}.php"
            if k == step and path.exists():
                path.unlink()
            else:
                _write(root, f"src/k{i}.php", _php(rng, i, n), tick)
        found = ix.analyze(spark, str(root), state, config, buckets=8)
        assert found.mode == "incremental"
        whole = ix.analyze(spark, str(root), str(tmp_path / f"whole{step}"), config, buckets=8)
        assert whole.mode == "full" and _tables(found.graph) == _tables(whole.graph)


def test_one_changed_file_writes_its_buckets_only(spark, tmp_path, monkeypatch):
    root, state, tick = tmp_path / "proj", str(tmp_path / "state"), 1_700_000_000
    for i in range(200):
        _write(root, f"src/f{i}.py", f"def f{i}():\n    f{(i + 1) % 200}()\n", tick)
    config = tables.Config(languages=["python"])
    ix.analyze(spark, str(root), state, config, buckets=32)
    versions = Versions(spark, f"{state}/code-32")
    before = versions.tables()
    _write(root, "src/f7.py", "# moved down\n\ndef f7():\n    f8()\n", tick + 10)
    second = ix.analyze(spark, str(root), state, config, buckets=32)
    after = versions.tables()
    written = {name: [b for b in after[name] if after[name][b] != before[name].get(b)] for name in after}
    assert second.mode == "incremental" and all(len(b) <= 1 for b in written.values())
    assert second.graph.symbols.filter("id = 'src/f7.py::f7'").first().line_start == 3
    # a new name: its file, and the file that calls it
    _write(root, "src/f7.py", "def g7():\n    f8()\n", tick + 20)
    third = ix.analyze(spark, str(root), state, config, buckets=32)
    last = versions.tables()
    written = {name: [b for b in last[name] if last[name][b] != after[name].get(b)] for name in last}
    assert len(written["symbols"]) == 1 and 1 <= len(written["calls"]) <= 2
    assert third.graph.symbols.filter("id = 'src/f6.py::f6'").first().unresolved_calls == 1 and third.graph.calls.count() == 199
    # nothing is linked where nothing changed
    monkeypatch.setattr(ix, "linked", None)
    monkeypatch.setattr(ix.incremental, "relink", None)
    assert ix.analyze(spark, str(root), state, config, buckets=32).mode == "skip" and versions.latest() == 3
