"""Work that must grow no faster than its input: joins by key, tasks by the amount of text."""

import time
from collections import Counter

from kinweave.extract import facts, php, structure, tokens, typescript
from kinweave.extract.facts import assemble
from kinweave.graph import CodeGraph
from kinweave.operators import lookup, resolve
from kinweave.operators.records import with_liveness
from kinweave.plans import catalog
from kinweave.session import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_enclosing_symbols_do_not_go_through_the_driver(spark):
    lines = spark.createDataFrame([("a.ts", 3), ("a.ts", 9)], "file_path string, line bigint")
    symbols = spark.createDataFrame(
        [("a.ts::A", "A", "a.ts", 1, 5, 0), ("a.ts::A.b", "A.b", "a.ts", 2, 4, 1)],
        "id string, fqn string, file_path string, line_start bigint, line_end bigint, ordinal bigint",
    )
    found = resolve.enclosing_symbol(lines, symbols)
    assert "Broadcast" not in _plan(found)
    assert [(r.line, r.symbol_id) for r in found.collect()] == [(3, "a.ts::A.b")]


def test_files_are_dealt_by_the_amount_of_text(spark, monkeypatch):
    files = spark.createDataFrame([(f"f{i}.ts", "x" * 100) for i in range(50)], "file_path string, text string")
    assert tokens.spread(files)[1] == 4
    monkeypatch.setattr(tokens, "TASK_TEXT", 500)
    dealt, tasks = tokens.spread(files)
    assert tasks == dealt.rdd.getNumPartitions() == 10
    assert dealt.count() == 50


def test_texts_are_scanned_once_and_behind_the_deal(spark):
    files = spark.createDataFrame([("a.ts", "f(1)")], "file_path string, text string")
    plan = _plan(tokens.tokenize(files, typescript.typescript_tokens))
    assert plan.count("ArrowEvalPython [") == 1
    assert "Exchange" in plan[plan.index("ArrowEvalPython"):]


def test_token_rows_are_not_shuffled(spark):
    files = spark.createDataFrame([("a.ts", "f(1)"), ("b.ts", None)], "file_path string, text string")
    rows = tokens.tokenize(files, typescript.typescript_tokens)
    plan = _plan(tokens.neighbours(rows, back=range(1, 2)))
    assert "Exchange" not in plan[: plan.index("Generate")]
    assert sorted((r.file_path, r.tok) for r in rows.collect()) == [("a.ts", "("), ("a.ts", ")"), ("a.ts", "1"), ("a.ts", "f")]


def test_a_batch_of_long_files_keeps_every_token(spark):
    text = "a(b);\n" * 8_000  # 40,000 tokens: two files fill an output batch
    files = spark.createDataFrame([(f"f{i}.ts", text) for i in range(9)], "file_path string, text string").coalesce(1)
    rows = tokens.tokenize(files, typescript.typescript_tokens).groupBy("file_path").count().collect()
    assert sorted((r.file_path, r["count"]) for r in rows) == [(f"f{i}.ts", 40_000) for i in range(9)]


def test_later_windows_sort_a_part_of_the_tokens(spark):
    files = spark.createDataFrame([("a", "class A { m() { return this.n(1) } }")], "file_path string, text string")
    for scan in (php._scan, typescript._scan):
        steps = [line.strip(" +-*()0123456789").split(" ")[0] for line in _plan(scan(files)).splitlines()]
        first = len(steps) - 1 - steps[::-1].index("Window")
        assert steps[:first].count("Sort") >= 2  # above the first window
        assert "Filter" in steps[len(steps) - 1 - steps[::-1].index("Sort", len(steps) - first):first]


def test_bodies_that_are_left_out_keep_their_ends(spark):
    deep = "{ if (a) { b(1, [2]) } }\n" * 30
    text = f"class A {{\n m() {{\n{deep}\n }}\n n() {{ this.m() }}\n}}\nfunction f() {{\n{deep}}}\nclass B {{ o() {{ {deep}"
    rows = [("a.ts", text), ("b.ts", "x(1)")]
    found = typescript.extract(spark.createDataFrame(rows, "file_path string, text string"))
    got = {(r.fqn, r.line_start, r.line_end) for r in found.symbols.collect()}
    assert got == {("A", 1, 36), ("A.m", 2, 34), ("A.n", 35, 35), ("f", 37, 68), ("B", 69, 98), ("B.o", 69, 98)}
    assert [r.file_path for r in found.errors.collect()] == ["a.ts"]
    text = "<?php\n" + text.replace("m()", "function m()", 1).replace(" n()", " function n()").replace("o()", "function o()").replace("this.m", "$this->m")
    found = php.extract(spark.createDataFrame([("a.php", text)], "file_path string, text string"))
    got = {(r.fqn, r.line_start, r.line_end) for r in found.symbols.collect()}
    assert got == {("A", 2, 37), ("A.m", 3, 35), ("A.n", 36, 36), ("f", 38, 69), ("B", 70, 99), ("B.o", 70, 99)}
    assert {(r.caller_id, r.target_name) for r in found.refs.collect()} == {("a.php::A.n", "A.m")}


def test_calls_are_linked_where_the_scan_left_them(spark):
    text = "class A {\n  private d: B;\n  m() {\n    this.n();\n    this.d.k(); new C();\n  }\n}\nx.y();\n"
    files = spark.createDataFrame([("a.ts", text), ("a.ts", "z.y()"), (None, text)], "file_path string, text string").filter("text like 'class%'")
    found = typescript.extract(files)
    assert "Exchange" not in _plan(found.refs)
    assert "Exchange" not in _plan(php.extract(spark.createDataFrame([("a.php", "<?php f();")], "file_path string, text string")).refs)
    got = sorted((r.caller_id, r.target_name, r.kind, r.line) for r in found.refs.collect())
    assert got == [("a.ts::A.m", "A.n", "static_call", 4), ("a.ts::A.m", "B.k", "static_call", 5), ("a.ts::A.m", "C", "instantiation", 5)]


def test_records_meet_the_graph_by_key(spark):
    records = spark.createDataFrame([("r1", None), ("r2", "r1")], "id string, ss string")
    live = with_liveness(records)
    assert "Broadcast" not in _plan(live)
    assert sorted((r.id, r.live) for r in live.collect()) == [("r1", False), ("r2", True)]
    seeds = spark.createDataFrame([("a.ts::A",)], "seed string")
    graph = CodeGraph.from_tables(
        spark,
        records=spark.createDataFrame([("r1", "gotcha", True)], "id string, kind string, live boolean"),
        about=spark.createDataFrame([("r1", "a.ts::A", "CodeSymbol")], "src string, dst string, dst_label string"),
    )
    found = lookup.records_for_symbols(graph, seeds)
    assert "Broadcast" not in _plan(found)
    assert [(r.seed, r.id) for r in found.collect()] == [("a.ts::A", "r1")]


def test_candidates_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([(i, f"first {i}\nsecond", "en", "web", 9) for i in range(8)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = catalog.QUERIES["bootstrap_counts"](spark, str(tmp_path))
    assert any("candidates-" in f for f in counts.inputFiles())
    assert sum(r.n for r in counts.collect()) == 16 + 3 + 8


TS_TEXT = (
    "import { x } from 'y';\nexport abstract class A extends B implements C, D {\n  private dep: X<Y>;\n  constructor(private readonly o: P) {}\n"
    "  @dec(1)\n  m(a: B): void { this.dep.k(); this.n(); super.o(); Q.r?.(); new S(); `${T.u()}` }\n  abstract y(): void;\n  'q'() {}\n}\n"
    "class E extends A implements V.W {\n  f: G;\n  h() { this.f.i(); }\n}\nconst a = 1, b = 2\nfunction k() { L.z() }\ninterface I { j(): void }\n"
)
PHP_TEXT = (
    "<?php\nnamespace N {\nfinal class A extends \\B\\C {\n  use D, E;\n  private ?F $g, $h;\n  function __construct(private X $y) {}\n"
    "  #[At(1)]\n  public static function &m() { $this->g->k(); $this->n(); parent::o(); self::p(); Q\\R::s(); new T(); }\n}\n"
    "trait U { function v() { W::x(); } }\nenum Y: int { case Z; }\nfunction f() { A::m(); }\n}\n"
)


def test_one_pass_and_windows_find_the_same(spark):
    cases = (
        (typescript, TS_TEXT, ["}", "{", "`", "class", "\n", ";", "(", "abstract ", "this."]),
        (php, PHP_TEXT, ["}", "{", "class ", "\n", ";", "(", "use ", "$this->", "?>"]),
    )
    for module, text, signs in cases:
        ext = module.EXTENSIONS[0]
        texts = [text] + [text[:i] + signs[i % len(signs)] + text[i + i % 4:] for i in range(0, len(text), 7)]
        rows = [(f"f{i}{ext}", t) for i, t in enumerate(texts)] + [(f"f1{ext}", texts[1]), (None, text), (f"e{ext}", ""), (f"n{ext}", None)]
        files = spark.createDataFrame(rows, "file_path string, text string")
        name = module.__name__.rpartition(".")[2]
        want, got = assemble(module._scan(files), name), module.extract(files)
        for table in ("symbols", "refs", "inheritance", "errors"):
            one, other = (Counter(tuple(r) for r in getattr(e, table).collect()) for e in (got, want))
            assert one == other and one


def test_no_token_becomes_a_row(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(facts, "materialize", lambda df, label: plans.append(_plan(df)) or materialize(df, label))
    for module, text in ((typescript, TS_TEXT), (php, PHP_TEXT)):
        module.extract(spark.createDataFrame([("a" + module.EXTENSIONS[0], text)], "file_path string, text string"))
    assert len(plans) == 2 and not any(step in plan for plan in plans for step in ("Window", "Generate"))
    assert all(plan.count("Exchange") == 1 and "MapInArrow" in plan for plan in plans)


def test_calls_meet_symbols_in_time_that_grows_with_both():
    n = 20_000
    found = [(i, "symbol", f"A{i}", "method", "", 1, 2 * n - i) for i in range(n)] + [(n + i, "call", "f", "new", "", i + 1, i + 1) for i in range(n)]
    began = time.monotonic()
    around = {r[6]: r[8] for r in structure.linked("a.ts", found) if r[2] == "call"}
    assert around == {i: f"A{n - 1}" for i in range(1, n + 1)} and time.monotonic() - began < 20
