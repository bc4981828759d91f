"""Benchmark passages in a corpus, found with a distributed positional inverted index.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
ASCII letters lower-cased. The items' windows (``width`` consecutive words; an
item with fewer words is one window) are phrase queries against the corpus:

1. A pass over all texts counts the corpus occurrences of every item term.
   Each window orders its words from the rarest on.
2. A second pass over all texts stores the postings: per document row and item
   term the ordered positions. A document that lacks, of every window, one of
   its three rarest terms can hold no window, so its postings are left out; its
   row and its number of words are stored all the same.
3. The posting lists of the rarest terms meet the windows on the term, which
   gives offset-adjusted starts; each is intersected with the second rarest
   term's list, and what is left with those of all other words. A join key is
   (document row, term) there, so neither a frequent passage nor a long
   document gathers in one task.

Windows are taken in blocks of about ``BLOCK_WINDOWS`` by their hash, so that is
what bounds the terms that are broadcast; one block is the usual case, and with
more of them the texts are stored once and the hits are united. Postings meet
the windows with a broadcast up to ``BROADCAST_WINDOWS`` windows and with a
shuffle beyond. As postings are stored for documents that can match, an index
serves the items that it was built for; others need a new pass.

Defined results: null and empty texts have no words and no hits; items without
words have no window; repeated documents are separate rows, each with its own
hits; repeated items count once per item id, null ids are an id of their own
that is left out of the digest; empty tables give no rows, an empty benchmark
no hits; a column with the name of a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, give_back, lower_ascii, quoted, whole_row, with_results
from kinweave.session import materialize

BLOCK_WINDOWS = 400_000
BROADCAST_WINDOWS = 200_000
# Upper-case letters to lower case, other ASCII but letters and digits to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split(b" ")


def words_column(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def item_windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(window, item_id, size, words)``: the distinct windows of each item."""
    words = items.select(F.col(quoted(id_col)).alias("item_id"), words_column(F.col(quoted(text_col))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return (
        words.filter(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s + 1, width))).alias("words"))
        .distinct().select(F.monotonically_increasing_id().alias("window"), "item_id", F.size("words").alias("size"), "words")
    )


class Postings:
    """Word positions of the listed terms in one text."""

    def __init__(self, terms: list[str]) -> None:
        self.ids = {t.encode(): i for i, t in enumerate(terms)}

    def read(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of words, and term and position of each listed one."""
        words = [w for w in text.translate(_FOLD).split(b" ") if w]
        get = self.ids.get
        found = np.fromiter((get(w, -1) for w in words), np.int32, len(words)) if words else np.zeros(0, np.int32)
        at = np.flatnonzero(found >= 0)
        return len(words), found[at], at.astype(np.int32)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.large_binary()):
        yield text.as_py() or b""


def corpus_counts(docs: DataFrame, terms: list[str], text_col: str = "text") -> np.ndarray:
    """Occurrences of each term in all texts."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, total = Postings(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                total += np.bincount(postings.read(text)[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["term", "n"])
        del postings, total
        give_back()

    counted = docs.select(F.col(quoted(text_col)).cast("binary")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.zeros(len(terms), np.int64)
    for row in counted.collect():  # one row per benchmark term at most
        total[row["term"]] = row["n"]
    return total


def build_index(docs: DataFrame, terms: list[str], needed: list[list[int]], text_col: str = "text") -> DataFrame:
    """The stored table ``(doc_row, row, n_words, postings)``; ``postings`` is ``array<struct<term, positions>>``.

    ``needed`` lists groups of terms, of which a document must hold one whole group to have postings.
    """
    return _index(_numbered(docs, text_col), terms, needed)


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """``(doc_row, row, text)``: rows with a number, their other columns as a struct, and their text."""
    kept = [c for c in docs.columns if c != text_col]
    row = whole_row(docs.select(*[quoted(c) for c in kept])) if kept else F.lit(None)
    return docs.select(F.monotonically_increasing_id().alias("doc_row"), row.alias("row"), F.col(quoted(text_col)).cast("binary").alias("text"))


class Groups:
    """Groups of terms by their first, rarest one: only groups whose rarest term a document holds are looked at."""

    def __init__(self, needed: list[list[int]], n_terms: int) -> None:
        width = max(map(len, needed), default=1)
        groups = np.array(sorted(g + g[:1] * (width - len(g)) for g in needed), np.int32).reshape(-1, width)
        self.groups, self.starts = groups, np.searchsorted(groups[:, 0], np.arange(n_terms + 1))
        self.present = np.zeros(n_terms, bool)

    def held(self, terms: np.ndarray) -> bool:
        """Whether a text with these terms holds all of some group."""
        terms = np.unique(terms)
        first, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.arange(size.sum()) + np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) if len(terms) else np.zeros(0, np.int64)
        self.present[terms] = True
        found = bool(self.present[self.groups[at]].all(axis=1).any())
        self.present[terms] = False
        return found


def _index(rows: DataFrame, terms: list[str], needed: list[list[int]]) -> DataFrame:
    """:func:`build_index` of numbered rows."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((terms, needed))

    @F.arrow_udf("struct<n_words:long,postings:array<struct<term:int,positions:array<int>>>>")
    def positions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, needed = shared.value
        postings, groups = Postings(terms), Groups(needed, len(terms))
        for texts in batches:
            n_words, per_doc, kept_terms, per_list, kept_at = [], [0], [], [0], []
            for text in _texts(texts):
                n, term, at = postings.read(text)
                n_words.append(n)
                if groups.held(term):
                    order = np.argsort(term, kind="stable")
                    term, at = term[order], at[order]
                    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                    kept_terms.append(term[first])
                    per_list.extend((per_list[-1] + np.append(first[1:], len(term))).tolist())
                    kept_at.append(at)
                per_doc.append(len(per_list) - 1)
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(per_list, pa.int32()), pa.array(flat(kept_at), pa.int32()))
            pairs = pa.StructArray.from_arrays([pa.array(flat(kept_terms), pa.int32()), lists], ["term", "positions"])
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), pairs)], ["n_words", "postings"]
            )
        del postings, groups
        give_back()

    indexed = rows.select("doc_row", "row", positions("text").alias("p"))
    return materialize(indexed.select("doc_row", "row", "p.n_words", "p.postings"), "postings")


def find_phrases(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc_row, item_id, start, size)``: the exact occurrences of the windows.

    ``windows`` has ``(window, item_id, size, words)``; ``words`` are structs
    ``(term, offset)`` from the rarest to the most frequent.
    """
    lists = index.filter(F.size("postings") > 0).select("doc_row", F.explode("postings").alias("p")).select("doc_row", "p.term", "p.positions")
    rarest = windows.select("window", "item_id", "size", F.col("words")[0].alias("a"), F.get("words", F.lit(1)).alias("b"), F.slice("words", 3, 1 << 20).alias("rest"))
    rarest = rarest.withColumn("term", F.col("a.term"))
    small = windows.count() <= BROADCAST_WINDOWS
    started = lists.join(F.broadcast(rarest) if small else rarest, "term").select(
        "doc_row", "window", "item_id", "size", "b", "rest",
        F.filter(F.transform("positions", lambda p: p - F.col("a.offset")), lambda s: s >= 0).alias("starts"),
    )
    lone = started.filter(F.col("b").isNull())
    second = (
        started.filter(F.col("b").isNotNull()).withColumn("term", F.col("b.term")).join(lists, ["doc_row", "term"])
        .withColumn("starts", F.array_intersect("starts", F.transform("positions", lambda p: p - F.col("b.offset"))))
        .drop("positions", "term")
    )
    open_ = lone.unionByName(second).filter(F.size("starts") > 0)
    done = open_.filter(F.size("rest") == 0).select("doc_row", "window", "item_id", "size", F.explode("starts").alias("start"))
    checked = (
        open_.filter(F.size("rest") > 0)
        .select("doc_row", "window", "item_id", "size", F.explode("starts").alias("start"), "rest")
        .select("doc_row", "window", "item_id", "size", "start", F.size("rest").alias("n"), F.explode("rest").alias("r"))
        .select("doc_row", "window", "item_id", "size", "start", "n", F.col("r.term").alias("term"), (F.col("start") + F.col("r.offset")).alias("at"))
        .join(lists, ["doc_row", "term"]).filter(F.array_contains("positions", F.col("at")))
        .groupBy("doc_row", "window", "item_id", "size", "start", "n").agg(F.count("*").alias("held")).filter("held = n")
    )
    return done.unionByName(checked.select(*done.columns)).select("doc_row", "item_id", F.col("start").cast("int"), "size")


def find_proximity(index: DataFrame, windows: DataFrame, distance: int) -> DataFrame:
    """``(doc_row, item_id, window, center)``: places of a window's rarest term that have every other word
    of the window at most ``distance`` words away, in any order."""
    lists = index.filter(F.size("postings") > 0).select("doc_row", F.explode("postings").alias("p")).select("doc_row", "p.term", "p.positions")
    seeds = windows.select(
        "window", "item_id", F.col("words")[0]["term"].alias("term"),
        F.array_distinct(F.transform("words", lambda w: w["term"])).alias("terms"),
    ).withColumn("terms", F.array_except("terms", F.array("term")))
    at = lists.join(seeds, "term").select("doc_row", "window", "item_id", "terms", F.explode("positions").alias("center"))
    lone = at.filter(F.size("terms") == 0).select("doc_row", "item_id", "window", "center")
    near = (
        at.filter(F.size("terms") > 0)
        .select("doc_row", "window", "item_id", "center", F.size("terms").alias("n"), F.explode("terms").alias("term"))
        .join(lists, ["doc_row", "term"])
        .filter(F.exists("positions", lambda p: F.abs(p - F.col("center")) <= distance))
        .groupBy("doc_row", "window", "item_id", "center", "n").agg(F.count("*").alias("held")).filter("held = n")
    )
    return lone.unionByName(near.select("doc_row", "item_id", "window", "center"))


def ranked_windows(items: DataFrame, docs: DataFrame, width: int, text_col: str, item_id: str, item_text: str) -> tuple[DataFrame, list[str], list[list[int]]]:
    """The items' windows with their words from the rarest on, all item terms, and the three rarest terms of each window."""
    return _ranked(materialize(item_windows(items, width, item_id, item_text), "windows"), docs, text_col)


def _ranked(windows: DataFrame, docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str], list[list[int]]]:
    """:func:`ranked_windows` of a block of windows, whose number bounds what comes to the driver."""
    spark = docs.sparkSession
    terms = sorted(r[0] for r in windows.select(F.explode("words").alias("w")).distinct().collect())
    counts = corpus_counts(docs, terms, text_col) if terms else np.zeros(0, np.int64)
    known = spark.createDataFrame(
        [(t, i, int(c)) for i, (t, c) in enumerate(zip(terms, counts))], "word string, term int, n long"
    )
    ranked = (
        windows.select("window", "item_id", "size", F.posexplode("words").alias("offset", "word")).join(known, "word")
        .groupBy("window", "item_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("w"))
        .select("window", "item_id", "size", F.transform("w", lambda x: F.struct(x["term"].alias("term"), x["offset"].alias("offset"))).alias("words"))
    )
    ranked = materialize(ranked, "windows")
    rarest = F.transform(F.slice("words", 1, 3), lambda w: w["term"])
    needed = [list(r[0]) for r in ranked.select(rarest).distinct().collect()]
    return ranked, terms, needed


def merged_spans(hits: DataFrame) -> DataFrame:
    """``(doc_row, spans)``: the ranges ``(doc_row, first, last)`` of each document, merged where they meet and sorted."""
    of_doc = Window.partitionBy("doc_row").orderBy("first", "last")
    reached = F.max("last").over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = hits.withColumn("opens", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    numbered = apart.withColumn("span", F.sum("opens").over(of_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = numbered.groupBy("doc_row", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.groupBy("doc_row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_words``, ``n_hit``, ``item_ids`` (sorted strings), ``spans``
    (merged hit word ranges) and ``contaminated``."""
    windows = materialize(item_windows(items, width, item_id, item_text), "windows")
    blocks = max(1, math.ceil(windows.count() / BLOCK_WINDOWS))
    rows = _numbered(docs, text_col)
    if blocks > 1:
        rows = materialize(rows, "texts")  # every block has to number them alike
    index = hits = None
    for number in range(blocks):
        mine = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == number)
        ranked, terms, needed = _ranked(mine, rows, "text")
        of_block = _index(rows, terms, needed)
        found = materialize(find_phrases(of_block, ranked), "hits")
        index, hits = of_block if index is None else index, found if hits is None else hits.unionByName(found)
    ranges = hits.select("doc_row", F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("last")).distinct()
    items_of = hits.groupBy("doc_row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = index.select("doc_row", "row", "n_words").join(merged_spans(ranges).join(items_of, "doc_row"), "doc_row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))
    kept = [c for c in docs.columns if c != text_col]
    return found.select(
        *with_results(
            "row", kept, n_words=F.col("n_words"), n_hit=n_hit, item_ids=F.coalesce("items", F.array().cast("array<string>")),
            spans=spans, contaminated=n_hit > 0,
        )
    )
