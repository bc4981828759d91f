"""A stored index of symbol names for searches by part of a name.

A name is held under every run of one to three of its characters, in lower case.
A search takes the rarest runs of what is looked for, intersects their posting
lists, and scores only the symbols in all of them; as every hit holds what is
looked for, none is lost. Postings are sorted by run, so a search opens the few
row groups that its runs lie in, and not the names of all symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.graph import CodeGraph
from kinweave.operators.search import DEFAULT_LIMIT, SYMBOL_KINDS, clamp_limit, score_symbol
from kinweave.session import materialize, placed

LONGEST = 3
SPREAD = 16  # tasks that share the names of one run
INTERSECTED = 3  # posting lists of so many runs, the rarest ones, are read in a search


def runs(text: Column, sizes: tuple[int, ...] = tuple(range(1, LONGEST + 1))) -> Column:
    """The distinct runs of characters of the given sizes."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def of_size(n: int) -> Column:
        return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))), lambda g: F.length(g) == n)

    return F.array_distinct(F.flatten(F.array(*[of_size(n) for n in sizes])))


@dataclass(frozen=True)
class NameIndex:
    postings: DataFrame  # (run, symbol_type, id), each file sorted by run
    counts: DataFrame  # (run, n), sorted by run


def build_name_index(symbols: DataFrame, path: str | None = None) -> NameIndex:
    """Index the names of ``symbols(id, fqn, symbol_type)``; below ``path``, or for this application where none is given."""
    rows = symbols.select(F.explode(runs(F.lower("fqn"))).alias("run"), "symbol_type", "id")
    # a run that most names hold is dealt to several tasks; hashes, unlike ranges, need no sample, which would make all rows twice
    placed = rows.repartition("run", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("run")
    if path is None:
        postings = materialize(placed, "name-runs")
        return NameIndex(postings, materialize(postings.groupBy("run").agg(F.count("*").alias("n")).sort("run"), "name-counts"))
    placed.write.mode("error").parquet(f"{path}/postings")
    symbols.sparkSession.read.parquet(f"{path}/postings").groupBy("run").agg(F.count("*").alias("n")).sort("run").write.mode("error").parquet(f"{path}/counts")
    return open_name_index(symbols.sparkSession, path)


def open_name_index(spark: SparkSession, path: str) -> NameIndex:
    return NameIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"))


def candidates(index: NameIndex, query: str, kind: str | None = None) -> DataFrame:
    """``(id)`` of the symbols whose names hold the rarest runs of ``query``."""
    spark = index.postings.sparkSession
    needle = F.lower(F.lit(query))
    size = min(LONGEST, spark.range(1).select(F.length(needle)).first()[0])
    asked = [r["run"] for r in spark.range(1).select(F.explode(runs(needle, (size,))).alias("run")).collect()]
    known = index.counts.filter(F.col("run").isin(asked)).orderBy("n", "run").collect()  # a row per run of the query
    if len(known) < len(asked):
        return index.postings.select("id").limit(0)  # some run is in no name
    rarest = [r["run"] for r in known[:INTERSECTED]]
    held = index.postings.filter(F.col("run").isin(rarest))
    if kind in SYMBOL_KINDS:
        held = held.filter(F.col("symbol_type") == kind)
    return held.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("id")


def score_symbols(graph: CodeGraph, index: NameIndex, query: str, kind: str | None = None) -> DataFrame:
    """The rows of :func:`kinweave.operators.search.score_symbols`, found through the index."""
    symbols = graph.symbols.select("id", "fqn", "file_path", "symbol_type")
    if not query:
        return symbols.withColumn("score", F.lit(0)).limit(0)
    found = symbols.join(placed(candidates(index, query, kind)), "id", "left_semi")
    return found.withColumn("score", score_symbol(F.col("fqn"), F.lit(query))).filter("score > 0")


def search_symbols(graph: CodeGraph, index: NameIndex, query: str, limit: float = DEFAULT_LIMIT, kind: str | None = None) -> DataFrame:
    """The best matches, ties by id."""
    return score_symbols(graph, index, query, kind).orderBy(F.desc("score"), "id").limit(clamp_limit(limit))
