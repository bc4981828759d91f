from kinweave.graph import CodeGraph
from kinweave.operators import name_index, search

NAMES = [
    "Tax", "Tax.signInWith", "tax_rate", "SyntaxTree.walk", "x", "Ax", "İstanbul.çay", "a.b", "get", "getter.getGetter", "GET_ALL", "__init__", "Straße", "\U0001d4d0bc", "", "aaa", "aaaa",
]


def _graph(spark):
    rows = [(f"f{i}::{n}", n, ("class", "method", "constant")[i % 3], f"f{i}") for i, n in enumerate(NAMES)]
    return CodeGraph.from_tables(spark, symbols=spark.createDataFrame(rows, "id string, fqn string, symbol_type string, file_path string"))


def test_indexed_search_equals_the_scan(spark, tmp_path):
    graph = _graph(spark)
    index = name_index.build_name_index(graph.symbols, str(tmp_path / "names"))
    for query in ("TAX", "Tax", "x", "get", "getg", "a.b", "_", "__init__", "İ", "aaaaa", "tqx", "\U0001d4d0b", ""):
        for kind in (None, "class", "nonsense") if query == "x" else ("method",) if query == "get" else (None,):
            rows = [sorted(map(tuple, df.collect())) for df in (search.score_symbols(graph, query, kind), name_index.score_symbols(graph, index, query, kind))]
            assert rows[0] == rows[1], (query, kind)
    top = [(r.id, r.score) for r in name_index.search_symbols(graph, index, "get", 2).collect()]
    assert top == [(r.id, r.score) for r in search.search_symbols(graph, "get", 2).collect()] and top[0][1] == 100


def test_a_search_reads_few_postings(spark):
    symbols = spark.range(3000).selectExpr("concat('f::common_', id) AS id", "concat('common_', id) AS fqn", "'function' AS symbol_type", "'f' AS file_path")
    index = name_index.build_name_index(symbols)
    found = name_index.candidates(index, "common_2718")
    assert [r.id for r in found.collect()] == ["f::common_2718"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(run, [" in plan  # by the rarest runs: row groups without them are not opened
    assert index.counts.filter("run = 'com'").first()["n"] == 3000
