"""Scored symbol search, record filters and the documentation gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.records import RECORD_KINDS
from kinweave.functions.text import identifier_words
from kinweave.graph import CodeGraph

# Result limits, the score of each kind of hit, and the symbol
# kinds a search may be narrowed to.
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
SCORE_EXACT, SCORE_SUBSTRING, SCORE_WORD_PREFIX = 100, 50, 25
SYMBOL_KINDS = (
    "class", "function", "method", "interface", "type", "enum", "constant",
    "table", "view", "procedure", "trigger",
)

RECORD_COLUMNS = (
    "id", "kind", "claim", "because", "given", "when_", "then_", "ref", "provenance", "ts",
)


def clamp_limit(limit: float) -> int:
    return max(1, min(MAX_LIMIT, int(limit // 1)))


def score_symbol(fqn: Column, query: Column) -> Column:
    needle = F.lower(query)
    return (
        F.when(fqn == query, SCORE_EXACT)
        .when(F.contains(F.lower(fqn), needle), SCORE_SUBSTRING)
        .when(
            F.exists(identifier_words(fqn), lambda word: F.startswith(F.lower(word), needle)),
            SCORE_WORD_PREFIX,
        )
        .otherwise(0)
    )


def score_symbols(graph: CodeGraph, query: str, kind: str | None = None) -> DataFrame:
    """Every matching symbol with its score; an unknown ``kind`` is ignored."""
    symbols = graph.symbols.select("id", "fqn", "file_path", "symbol_type")
    if not query:
        return symbols.withColumn("score", F.lit(0)).limit(0)
    if kind in SYMBOL_KINDS:
        symbols = symbols.filter(F.col("symbol_type") == kind)
    return symbols.withColumn("score", score_symbol(F.col("fqn"), F.lit(query))).filter("score > 0")


def search_symbols(
    graph: CodeGraph, query: str, limit: float = DEFAULT_LIMIT, kind: str | None = None
) -> DataFrame:
    """The best matches, ties by id."""
    ranked = score_symbols(graph, query, kind).orderBy(F.desc("score"), "id")
    return ranked.limit(clamp_limit(limit))


def _live_records(graph: CodeGraph) -> DataFrame:
    return graph.records.filter("live").select(*RECORD_COLUMNS)


def match_records(graph: CodeGraph, query: str, kind: str | None = None) -> DataFrame:
    """Live records whose claim or reason contains ``query``, in any case."""
    records = _live_records(graph)
    if not query:
        return records.limit(0)
    if kind in RECORD_KINDS:
        records = records.filter(F.col("kind") == kind)
    text = F.lower(F.concat_ws(" ", F.coalesce("claim", F.lit("")), F.coalesce("because", F.lit(""))))
    return records.filter(F.contains(text, F.lower(F.lit(query))))


def search_records(
    graph: CodeGraph, query: str, limit: float = DEFAULT_LIMIT, kind: str | None = None
) -> DataFrame:
    return match_records(graph, query, kind).orderBy("id").limit(clamp_limit(limit))


def get_records_by_kind(graph: CodeGraph, kind: str) -> DataFrame:
    if kind not in RECORD_KINDS:
        raise ValueError(f"unknown kind {kind!r}; expected one of: {', '.join(RECORD_KINDS)}")
    return _live_records(graph).filter(F.col("kind") == kind).orderBy(F.desc("ts"), "id")


def get_records_by_ref(graph: CodeGraph, ref: str) -> DataFrame:
    records = _live_records(graph)
    if not ref:
        return records.limit(0)
    return records.filter(F.col("ref") == ref).orderBy(F.desc("ts"), "id")


def undocumented_symbols(graph: CodeGraph, file_path: str | None = None) -> DataFrame:
    """Symbols no record is about; a superseded record still counts as documentation."""
    symbols = graph.symbols.select("id", "fqn", "symbol_type", "file_path")
    if file_path is not None:
        symbols = symbols.filter(F.col("file_path") == file_path)
    documented = graph.about.filter("dst_label = 'CodeSymbol'").select(F.col("dst").alias("id"))
    return symbols.join(documented, "id", "left_anti").orderBy("file_path", "fqn", "id")
