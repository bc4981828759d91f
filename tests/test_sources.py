"""Trees with links and files that vanish, and the folders to watch."""

import os

from kinweave.sources import files, record_log


def _tree(root, *paths):
    for path in paths:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)


def test_links_are_not_followed(spark, tmp_path):
    root = tmp_path / "proj"
    _tree(root, "a/x.py", "a/b/y.py", ".hidden/z.py", "_own/w.py")
    os.symlink(root, root / "a/loop")
    os.symlink(root / "a", root / "again")
    os.symlink(root / "a/x.py", root / "a/link.py")
    os.symlink(root / "gone", root / "a/b/broken.py")
    assert sorted(r.path for r in files.list_tree(spark, str(root)).collect()) == [".hidden/z.py", "_own/w.py", "a/b/y.py", "a/x.py"]
    assert files.list_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_vanished_and_unreadable_files_are_left_out(spark, tmp_path):
    root = tmp_path / "proj"
    _tree(root, "a.py", "b.py")
    (root / "c.py").mkdir()
    wanted = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",), ("gone/d.py",)], "path string")
    os.remove(root / "b.py")
    assert [(r.file_path, r.text) for r in files.read_sources(spark, str(root), wanted).collect()] == [("a.py", "a.py")]


def test_watch_roots(spark):
    listing = spark.createDataFrame(
        [(p,) for p in ("top.py", "src/a.py", "src/deep/b.py", "lib/c.py", "node_modules/x/d.js", ".git/HEAD", ".kinweave/state", "docs/e.md", "lib/node_modules/f.js")],
        "path string",
    )
    roots = lambda *include: sorted(r.root for r in files.watch_roots(listing, include).collect())
    assert roots(".") == roots("") == roots("./") == ["docs", "lib", "src"]
    assert roots("src", "src/deep", "docs/") == ["docs", "src"]
    assert roots("src/deep", "nowhere", "top.py") == ["src/deep"]
    assert roots(".", "src/deep") == ["docs", "lib", "src"]
    assert roots(".", "node_modules/x") == ["docs", "lib", "node_modules/x", "src"]
    assert roots() == []


def test_merged_appends_are_read_as_the_appends_were(spark, tmp_path):
    path = str(tmp_path / "log")
    wire = record_log.schema.WIRE_RECORD

    def append(*ids, claim="c"):
        rows = spark.createDataFrame([(i, k, "decision", claim, "u", "20260617143022") for i, k in enumerate(ids)], "line long, id string, kn string, cl string, pv string, ts string")
        record_log.append_log(record_log.schema.conform(rows, wire), path)

    lines = lambda: [(r.line, r.value) for r in record_log.read_log_lines(spark, path).orderBy("line").collect()]
    append("a1b2c3", "b1b2c3")
    append("a1b2c3", claim="later")
    append("c1b2c3")
    before = lines()
    reader = record_log.read_log_lines(spark, path)  # its files are listed already
    assert [n for n, _ in before] == [1, 2, 3, 4]
    assert record_log.compact_log(spark, path) == 3 and lines() == before
    append("d1b2c3")
    assert [n for n, _ in lines()] == [1, 2, 3, 4, 5] and lines()[:4] == before
    records, errors = record_log.parse_log(record_log.read_log_lines(spark, path))
    assert {r.id: r.cl for r in records.collect()}["a1b2c3"] == "c" and [r.line for r in errors.collect()] == [3]
    assert record_log.compact_log(spark, path) == 1 and record_log.compact_log(spark, path) == 0
    assert reader.count() == 4 and record_log.drop_merged(spark, path) == []
    assert len(record_log.drop_merged(spark, path, older_than=-10)) == 5
    assert [n for n, _ in lines()] == [1, 2, 3, 4, 5] and lines()[:4] == before
    append("e1b2c3")
    assert len(lines()) == 6
