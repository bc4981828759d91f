"""Ranked lexical search with range-maximum sparse tables over posting lists.

The index is a stored table of segments. A segment holds some thousand
documents in the order of their ids: per term the ordered documents and counts,
and one row with the ids and lengths. It covers every term of every text and is
searched any number of times.

A search scores each segment in one task and merges the segments' best rows:

1. The documents' impacts (the share of the score that a term gives) become one
   array per segment, list after list, with a sparse table of the places of the
   maxima of all power-of-two ranges. A look-up of two places gives the maximum
   impact of a term in any interval of documents.
2. Of each item, intervals of documents wait with a bound: the sum of the range
   maxima of its terms, repeats included. The intervals with the highest bounds
   are taken, many at a time, and each is split at the document with its largest
   single impact. That document is scored exactly; the parts before and after
   get bounds of their own, for the terms that still occur in them.
3. An interval goes as soon as its bound cannot enter the ``k`` best any more.
   Documents are ordered by id, so of equal scores only smaller ids can enter.

The first pass scores ``PILOT`` of the segments. An item's k-th best score
there can only rise with more documents, so it is where all other segments
start to discard from.

Queries are broadcast in rounds of about ``QUERY_BYTES``; an index of any size
is read once or twice per round, and a round's result is stored before the next
one begins. Statistics (documents, terms, document frequencies) cover all texts.

Defined results: terms are maximal runs of ASCII letters and digits and of all
non-ASCII characters, ASCII letters lower-cased; null and empty texts have no
term, count nowhere and are never found; items without terms have no rows; each
row of the items ranks for itself, also where ids repeat; repeated documents
rank one after the other; a null document id ranks after others of its score;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, lower_ascii, quoted
from kinweave.session import materialize

SEGMENT_DOCS = 8192
SEGMENT_TERMS = 1 << 22
QUERY_BYTES = 32 << 20
PILOT = 16  # one in so many segments
_PIECE = 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NO_ID = np.iinfo(np.int64).max


class Segment:
    """Documents on their way into one segment."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        folded, at, numbers = text.translate(_FOLD), 0, []
        while at < len(folded):  # piece by piece: a long text is never a list of all its words
            end = folded.find(b" ", at + _PIECE)
            end = len(folded) if end < 0 else end
            words = folded[at:end].split()
            numbers.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
            at = end
        total = sum(map(len, numbers))
        if total:
            terms, counts = np.unique(np.concatenate(numbers), return_counts=True)
            self.ids.append(doc_id)
            self.sizes.append(total)
            self.terms.append(terms)
            self.counts.append(counts.astype(np.int32))
            self.postings += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.postings >= SEGMENT_TERMS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The segment's rows: its documents (no term), then its terms in order."""
        keys = np.array([_NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((np.array([i is None for i in self.ids]), keys))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        ids = pa.array([self.ids[i] for i in order], pa.int64())
        lengths = pa.array(np.array(self.sizes, np.int32)[order])
        one = pa.array([0, len(order)], pa.int32())
        none = pa.array([None], pa.list_(pa.int32()))
        yield _batch(number, pa.array([None], pa.binary()), [len(order)], none, pa.ListArray.from_arrays(one, lengths), pa.ListArray.from_arrays(one, ids))

        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter((self.vocabulary[n] for n in names), np.int64, len(names))] = np.arange(len(names))
        terms = rank[np.concatenate(self.terms)]
        docs = np.repeat(place, [len(t) for t in self.terms])
        order = np.lexsort((docs, terms))
        terms, docs, counts = terms[order], docs[order], np.concatenate(self.counts)[order]
        edges = np.searchsorted(terms, np.arange(len(names) + 1)).astype(np.int32)
        for start in range(0, len(names), 8192):
            stop = min(start + 8192, len(names))
            offsets = pa.array(edges[start: stop + 1] - edges[start])
            values = slice(edges[start], edges[stop])
            empty = pa.nulls(stop - start, pa.list_(pa.int64()))
            yield _batch(
                number, pa.array(names[start:stop], pa.binary()), np.diff(edges[start: stop + 1]),
                pa.ListArray.from_arrays(offsets, pa.array(docs[values])), pa.ListArray.from_arrays(offsets, pa.array(counts[values])), empty,
            )


def _batch(number: int, terms: pa.Array, n: list | np.ndarray, docs: pa.Array, counts: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.full(len(terms), number, np.int64)), terms, pa.array(np.asarray(n, np.int64)), docs, counts, ids],
        names=["segment", "term", "n", "docs", "counts", "ids"],
    )


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The stored table ``(segment, term, n, docs, counts, ids)``.

    A row with a term lists its ``n`` documents, by place in the segment, and its
    counts in them. A segment's row without a term holds the documents' ids, and
    their lengths as ``counts``.
    """
    bounded_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 32, Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                segment.add(doc_id, text.as_py() or b"")
                if segment.full():
                    yield from segment.rows(number)
                    number, segment = number + 1, Segment()
        if segment.ids:
            yield from segment.rows(number)

    texts = docs.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("binary"))
    schema = "segment long, term binary, n long, docs array<int>, counts array<int>, ids array<long>"
    return materialize(texts.mapInArrow(read, schema), "segments")


class Lists:
    """The posting lists of one segment as arrays, with the sparse table of their maxima."""

    def __init__(self, n_docs: int, docs: np.ndarray, impacts: np.ndarray, edges: np.ndarray) -> None:
        self.docs, self.impacts, self.edges = docs, impacts, edges
        self.keys = np.repeat(np.arange(len(edges) - 1, dtype=np.int64) * n_docs, np.diff(edges)) + docs
        self.base = self.keys - docs
        levels = [np.arange(len(docs), dtype=np.int32)]
        longest = int(np.diff(edges).max(initial=1))
        while 2 << (len(levels) - 1) <= longest:
            half = 1 << (len(levels) - 1)
            below = levels[-1]
            left, right = below[:-half], below[half:]
            level = below.copy()  # the last places start no whole range and are never looked up
            level[: len(left)] = np.where(impacts[left] >= impacts[right], left, right)
            levels.append(level)
        self.table = np.stack(levels).reshape(-1)

    def top(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The places of the largest impacts of the ranges ``first`` to ``last`` (not included)."""
        level = np.frexp((last - first).astype(np.float64))[1].astype(np.int64) - 1
        row = level * len(self.docs)
        left, right = self.table[row + first], self.table[row + last - (np.int64(1) << level)]
        return np.where(self.impacts[left] >= self.impacts[right], left, right)


class Pairs:
    """Ranges of posting lists, those of one interval next to each other; arrays that grow by doubling."""

    def __init__(self) -> None:
        self.size, self.data = 0, np.empty((3, 1 << 12), np.int64)

    def add(self, rows: np.ndarray) -> int:
        start, self.size = self.size, self.size + rows.shape[1]
        if self.size > self.data.shape[1]:
            grown = np.empty((3, 2 * self.size), np.int64)
            grown[:, :start] = self.data[:, :start]
            self.data = grown
        self.data[:, start: self.size] = rows
        return start


def _gather(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and which range each belongs to."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(owner)) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes), owner


def best_documents(lists: Lists, n_docs: int, first: np.ndarray, last: np.ndarray, repeats: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the ``k`` best documents with a score of at least ``floor`` and above 0.

    ``first`` and ``last`` are the ranges of the item's posting lists, none of them empty.
    """
    pairs = Pairs()
    scores, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = max(floor, 1)
    # intervals: bound, from, to, place to split at, start of their pairs, number of pairs
    waiting = np.zeros((6, 0), np.int64)

    def hopeful(bound: np.ndarray, low: np.ndarray) -> np.ndarray:
        if len(scores) < k:
            return bound >= least
        return (bound >= least) & ((bound > scores[-1]) | ((bound == scores[-1]) & (low < places[-1])))

    def enter(owner: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The intervals of ``rows`` (repeats, first, last; by owner) that may hold a result."""
        if not len(owner):
            return waiting[:, :0]
        at = lists.top(rows[1], rows[2])
        gain = rows[0] * lists.impacts[at]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(owner)))
        bound, most = np.add.reduceat(gain, starts), np.maximum.reduceat(gain, starts)
        peaks = np.flatnonzero(gain == np.repeat(most, sizes))
        peaks = peaks[np.append(True, owner[peaks[1:]] != owner[peaks[:-1]])]
        who = owner[starts]
        kept = np.flatnonzero(hopeful(bound, low[who]))
        if not len(kept):
            return waiting[:, :0]
        places_of, _ = _gather(starts[kept], sizes[kept])
        start = pairs.add(rows[:, places_of])
        sizes = sizes[kept]
        return np.stack([bound[kept], low[who[kept]], high[who[kept]], lists.docs[at[peaks[kept]]], start + np.append(0, np.cumsum(sizes)[:-1]), sizes])

    if len(first):
        waiting = enter(np.zeros(len(first), np.int64), np.array([0]), np.array([n_docs]), np.stack([repeats, first, last]))
    while waiting.shape[1]:
        take = min(waiting.shape[1], max(32, waiting.shape[1] // 4))
        order = np.argpartition(-waiting[0], take - 1) if take < waiting.shape[1] else np.arange(take)
        _, low, high, split, start, sizes = waiting[:, order[:take]]
        waiting = waiting[:, order[take:]]
        at, owner = _gather(start, sizes)
        repeat, begin, end = pairs.data[:, at]
        split_of = split[owner]
        middle = np.searchsorted(lists.keys, lists.base[begin] + split_of)
        holds = (middle < end) & (lists.docs[np.minimum(middle, len(lists.docs) - 1)] == split_of)
        after = middle + holds

        held = np.flatnonzero(holds)  # every interval splits at a document of one of its lists
        by = owner[held]
        exact = np.add.reduceat(repeat[held] * lists.impacts[middle[held]], np.flatnonzero(np.append(True, by[1:] != by[:-1])))
        good = exact >= least
        scores, places = np.append(scores, exact[good]), np.append(places, split[good])
        best = np.lexsort((places, -scores))[:k]
        scores, places = scores[best], places[best]

        left, right = np.flatnonzero(begin < middle), np.flatnonzero(after < end)
        waiting = np.concatenate([
            waiting[:, hopeful(waiting[0], waiting[1])],
            enter(owner[left], low, split, np.stack([repeat[left], begin[left], middle[left]])),
            enter(owner[right], split + 1, high, np.stack([repeat[right], after[right], end[right]])),
        ], axis=1)
    return scores, places


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The stored table ``(query, item_id, term, repeats)``; ``query`` numbers the rows of ``items``."""
    words = F.filter(F.split(lower_ascii(F.col(quoted(text_col))), _NOT_TERM), lambda w: w != "")
    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col(quoted(id_col)).alias("item_id"), words.alias("words"))
    terms = rows.select("query", "item_id", F.explode("words").alias("word")).select("query", "item_id", F.col("word").cast("binary").alias("term"))
    return materialize(terms.groupBy("query", "item_id", "term").agg(F.count("*").alias("repeats")), "items")


def _search_round(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(query, score, doc_id)`` of the best documents for a round of queries."""
    spark = index.sparkSession
    known = asked.select("term").distinct()
    found = index.select("term", "n").join(F.broadcast(known), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()  # the round's terms
    numbers = {bytes(r["term"]): i for i, r in enumerate(found)}
    weights = np.array([weight(n_docs, r["df"]) for r in found], np.int64)
    terms = spark.createDataFrame([(t, i) for t, i in numbers.items()], "term binary, number int")
    queries: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in asked.select("query", "term", "repeats").collect():  # QUERY_BYTES
        if (number := numbers.get(bytes(r["term"]))) is not None:
            queries[r["query"]].append((number, r["repeats"]))
    packed = {q: np.array(sorted(t), np.int64).T for q, t in queries.items()}

    lists = index.join(F.broadcast(terms), "term").select("segment", "number", "docs", "counts", "ids")
    documents = index.filter("term IS NULL").select("segment", F.lit(-1).alias("number"), F.array().cast("array<int>").alias("docs"), "counts", "ids")
    rows = materialize(lists.unionByName(documents), "lists")

    def searched(part: DataFrame, floors: dict[int, int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((packed, weights, floors))

        def rank(group: pa.Table) -> pa.Table:
            packed, weights, floors = shared.value
            group = group.combine_chunks().sort_by("number")
            number = group.column("number").to_numpy()
            ids = group.column("ids")[0].values
            size = group.column("counts")[0].values.to_numpy().astype(np.int64)
            norm = 100 - 25 + (25 * size * n_docs) // n_terms
            docs, counts = (group.column(c).slice(1).combine_chunks() for c in ("docs", "counts"))
            edges = np.append(0, np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            docs, counts = docs.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            w = np.repeat(weights[number[1:]], np.diff(edges))
            lists = Lists(len(size), docs, w * ((1_000_000_000 * counts) // (1000 * counts + 12 * norm[docs])), edges)
            place = np.full(len(weights), -1, np.int64)
            place[number[1:]] = np.arange(len(number) - 1)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for query, (terms, repeats) in packed.items():
                here = place[terms]
                repeats, here = repeats[here >= 0], here[here >= 0]
                scores, at = best_documents(lists, len(size), edges[here], edges[here + 1], repeats, k, floors.get(query, 0))
                out.append((np.full(len(scores), query, np.int64), scores, at))
            query, scores, at = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
            return pa.table([pa.array(query), pa.array(scores), ids.take(pa.array(at.astype(np.int64)))], names=["query", "score", "doc_id"])

        per_segment = part.groupBy("segment").applyInArrow(rank, "query long, score long, doc_id long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = materialize(per_segment.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        shared.unpersist()
        return best.select("query", "score", "doc_id", "rank")

    in_pilot = F.pmod(F.xxhash64("segment"), F.lit(PILOT)) == 0
    first = searched(rows.filter(in_pilot), {})
    floors = {r["query"]: r["score"] for r in first.filter(F.col("rank") == k).collect()}  # a number per query of the round
    return first.unionByName(searched(rows.filter(~in_pilot), floors)).drop("rank")


def search(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest score above 0 for each row of ``items``."""
    asked = item_terms(items, item_id, item_text)
    stats = index.filter("term IS NULL").agg(F.sum("n").alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("terms")).first()
    volume = asked.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    rounds = max(1, math.ceil(volume / QUERY_BYTES))
    found = None
    for number in range(rounds if stats["n"] and volume else 0):
        part = asked.filter(F.pmod(F.xxhash64("query"), F.lit(rounds)) == number) if rounds > 1 else asked
        best = _search_round(index, part, stats["n"], stats["terms"], k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")
