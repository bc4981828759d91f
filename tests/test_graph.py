"""Traversal, search and pattern operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from kinweave.graph import CodeGraph, MutatingQueryError
from kinweave.operators import pattern, search, stats, traverse


def make(spark, symbols, calls=(), extends=(), about=(), records=()):
    nodes = [(f"src/x.ts::{s}", s, kind, "src/x.ts") for s, kind in symbols]

    def edge(pairs, layout):
        return spark.createDataFrame([tuple(f"src/x.ts::{n}" for n in p) for p in pairs], layout)

    tables = {"symbols": spark.createDataFrame(nodes, "id string, fqn string, symbol_type string, file_path string")}
    if calls:
        tables["calls"] = edge(calls, "src string, dst string").withColumn("call_kind", F.lit("static_call"))
    if extends:
        tables["extends"] = edge(extends, "src string, dst string")
    if about:
        tables["about"] = spark.createDataFrame(list(about), "src string, dst string, dst_label string")
    if records:
        tables["records"] = spark.createDataFrame(list(records), "id string, kind string, claim string, because string, ref string, live boolean")
    return CodeGraph.from_tables(spark, **tables)


def seed(spark, *names):
    return spark.createDataFrame([(f"src/x.ts::{n}",) for n in names], "seed string")


def short(value):
    return value.split("::")[1]


@pytest.fixture(scope="module")
def diamond(spark):
    return make(spark, [(n, "function") for n in "abcd"], [("a", "b"), ("b", "c"), ("a", "d"), ("d", "b")])


def test_callers_and_callees(spark, diamond):
    assert {r.fqn for r in traverse.get_callers(diamond, seed(spark, "b")).collect()} == {"a", "d"}
    assert {r.fqn for r in traverse.get_callees(diamond, seed(spark, "a")).collect()} == {"b", "d"}
    assert traverse.unresolved_of(diamond, seed(spark, "nope")).first().unresolved_calls == 0


def test_impact_depth_and_path(spark, diamond):
    rows = traverse.get_impact(diamond, seed(spark, "a"), 3).collect()
    assert {r.fqn: r.depth for r in rows} == {"b": 1, "d": 1, "c": 2}
    assert [short(p) for p in next(r.path for r in rows if r.fqn == "c")] == ["a", "b", "c"]
    assert {r.fqn for r in traverse.get_impact(diamond, seed(spark, "a"), 1).collect()} == {"b", "d"}
    back = traverse.get_callers_transitive(diamond, seed(spark, "c"), 5).collect()
    assert {r.fqn: r.depth for r in back} == {"b": 1, "a": 2, "d": 2}


def test_impact_excludes_the_seed_in_a_cycle(spark):
    graph = make(spark, [(n, "function") for n in "abc"], [("a", "b"), ("b", "c"), ("c", "a")])
    assert {r.fqn for r in traverse.get_impact(graph, seed(spark, "a"), 10).collect()} == {"b", "c"}


def test_depth_is_clamped():
    assert [traverse.clamp_depth(d) for d in (-3, 0, 2.9, 99)] == [1, 1, 2, 10]


def test_supertypes(spark):
    graph = make(
        spark, [(n, "class") for n in ("Root", "Base", "Child", "X", "Y")],
        extends=[("Child", "Base"), ("Base", "Root"), ("X", "Y"), ("Y", "X")],
    )
    rows = traverse.get_supertypes(graph, seed(spark, "Child", "Root", "X")).collect()
    assert {(short(r.seed), r.fqn) for r in rows} == {
        ("Child", "Base"), ("Child", "Root"), ("X", "Y"), ("X", "X"),  # the cycle returns to its start
    }


def test_reach_matches_breadth_first_search(spark):
    import random

    rng = random.Random(7)
    for n, m in ((12, 20), (30, 60)):
        pairs = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)]
        edges = spark.createDataFrame(pairs, "src string, dst string")
        seeds = spark.createDataFrame([(str(i),) for i in range(n)], "seed string")
        got = {(r.seed, r.node): (r.depth, tuple(r.path)) for r in traverse.reach(edges, seeds, 4, with_path=True).collect()}
        want = {}
        for s in map(str, range(n)):
            level = {s: (s,)}
            seen = {s}
            for depth in range(1, 5):
                following = {}
                for node, path in level.items():
                    for a, b in pairs:
                        if a == node and b not in seen:
                            following[b] = min(following.get(b, path + (b,)), path + (b,))
                seen |= set(following)
                want |= {(s, b): (depth, p) for b, p in following.items()}
                level = following
        assert got == want


def test_search_scores_and_limits(spark):
    names = [("signInWithGoogle", "function"), ("Tax.calculateTax", "method"), ("Tax", "class"), ("my_helper", "function")]
    graph = make(spark, names)
    assert [(r.fqn, r.score) for r in search.search_symbols(graph, "Tax").collect()] == [("Tax", 100), ("Tax.calculateTax", 50)]
    assert [r.fqn for r in search.search_symbols(graph, "tax", kind="class").collect()] == ["Tax"]
    assert search.search_symbols(graph, "tax", kind="nonsense").count() == 2
    assert search.search_symbols(graph, "").count() == 0
    assert search.search_symbols(graph, "a", limit=1).count() == 1


def test_record_reads(spark):
    graph = make(
        spark, [("Svc", "class"), ("Svc.run", "method"), ("bare", "function")],
        about=[("r1", "src/x.ts::Svc", "CodeSymbol"), ("r2", "src/x.ts::Svc.run", "CodeSymbol")],
        records=[
            ("r1", "gotcha", "method trap", None, None, True),
            ("r2", "decision", "old", "invalidation", None, False),
            ("r3", "source", "protocol", None, "https://wiki/svc", True),
        ],
    )
    assert [r.id for r in search.search_records(graph, "TRAP").collect()] == ["r1"]
    assert search.search_records(graph, "invalidation").count() == 0
    assert [r.id for r in search.get_records_by_ref(graph, "https://wiki/svc").collect()] == ["r3"]
    assert [r.id for r in search.get_records_by_kind(graph, "gotcha").collect()] == ["r1"]
    with pytest.raises(ValueError):
        search.get_records_by_kind(graph, "nonsense")
    # a superseded record still documents its symbol
    assert [r.fqn for r in search.undocumented_symbols(graph).collect()] == ["bare"]
    counts = {r.metric: r.value for r in stats.graph_stats(graph).collect()}
    assert (counts["symbols"], counts["records"], counts["live_records"], counts["ABOUT"]) == (3, 3, 2, 2)


def test_sql_is_read_only(spark, diamond):
    assert diamond.sql("SELECT count(*) AS n FROM calls WHERE call_kind = :k", k="static_call").first().n == 4
    for statement in ("DROP TABLE calls", "  insert into calls values (1)", "CREATE TABLE x (a int)", "SET a=1"):
        with pytest.raises(MutatingQueryError):
            diamond.sql(statement)


def test_patterns(spark, diamond):
    start = pattern.nodes(diamond, "a", "CodeSymbol", fqn="a").select("a_id")
    hop = pattern.expand(start, diamond, "a", "CALLS", pattern.nodes(diamond, "b", "CodeSymbol"), "b")
    assert {r.b_fqn for r in hop.collect()} == {"b", "d"}
    far = pattern.expand_var(start, diamond, "a", "CALLS", pattern.nodes(diamond, "b", "CodeSymbol"), "b", 2)
    assert {(r.b_fqn, r.b_depth) for r in far.collect()} == {("b", 1), ("d", 1), ("c", 2)}
    roots = pattern.where_not_exists(pattern.nodes(diamond, "n", "CodeSymbol"), diamond, "n", "CALLS")
    assert {r.n_fqn for r in roots.collect()} == {"a"}


def test_build_skew():
    assert stats.build_skew("2", None)["in_sync"] is None
    assert stats.build_skew("2", "2")["in_sync"] is True
    assert stats.build_skew("1", "2")["advice"] != stats.build_skew("2", "1")["advice"]
