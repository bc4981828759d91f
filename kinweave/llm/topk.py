"""Exact top-k inner products by multi-resolution segment statistics.

Vectors become integers, ``floor(scale * x)``. A segment of ``l`` components is
known by its mean and deviation; over all segments

    sum l * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

is a lower bound of the squared distance, and as the squared distance is
``|q|^2 + |x|^2 - 2 q.x``, it is an upper bound of the inner product. Bounds
are taken from coarse to fine; a pair is dropped as soon as its bound is below
the query's k-th best score so far, and survivors get the exact integer score.

Queries go through the candidates in blocks of about ``block``, one after the
other: a block's results are stored and its broadcast is destroyed before the
next one is read, so the driver and the executors hold one block, whatever the
number of queries. Every task keeps k rows per query, and only those are shuffled.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; a query and a candidate of
other length do not meet; every other row is a candidate, repeated rows count
each, but rows with the query's id never; of repeated query ids the smallest
vector asks; equal scores go to the smaller id; scores beyond 64 bits are cut
to that range; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import quoted
from kinweave.session import materialize

LEVELS = (2, 4, 8, 16, 32)
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(id, v)`` of the rows that take part, ``v`` as ``array<long>``."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    whole = F.size(v) > 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(quoted(id_col)).isNotNull() & v.isNotNull() & whole & finite).select(
        F.col(quoted(id_col)).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of ``x``: means and deviations, weighted by segment length."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    weights = np.sqrt([p.shape[1] for p in parts])
    means = np.stack([p.mean(axis=1) for p in parts], axis=1) * weights
    return np.concatenate([means, np.stack([p.std(axis=1) for p in parts], axis=1) * weights], axis=1)


class Block:
    """Queries of one length and the best rows that a task has seen for them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.k, self.exact = ids, k, vectors
        self.floats = vectors.astype(np.float64)
        self.levels = [n for n in LEVELS if n < vectors.shape[1]]
        self.features = [segment_features(self.floats, n) for n in self.levels]
        self.norms = np.sqrt((self.floats**2).sum(axis=1))
        self.at, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        floats = vectors.astype(np.float64)
        norms = np.sqrt((floats**2).sum(axis=1))
        alive = self.ids[:, None] != ids[None, :]
        # rounding of the bounds is far below this share of the norms
        floor = self.floor[:, None] - 1e-9 * self.norms[:, None] * norms[None, :] - 1e-9
        for level, features in zip(self.levels, self.features):
            columns = np.flatnonzero(alive.any(axis=0))
            if not len(columns):
                return
            bound = features @ segment_features(floats[columns], level).T
            alive[:, columns] &= bound >= floor[:, columns]
        at, column = np.nonzero(alive)
        if not len(at):
            return
        score = self._scores(at, column, vectors, floats)
        kept = score >= self.floor[at]
        self._merge(at[kept], ids[column[kept]], score[kept])

    def _scores(self, at: np.ndarray, column: np.ndarray, vectors: np.ndarray, floats: np.ndarray) -> np.ndarray:
        reach = float(np.abs(self.floats).max()) * float(np.abs(floats).max()) * floats.shape[1]
        if reach >= 2.0**53:  # exact with integers of any size
            exact = [sum(int(a) * int(b) for a, b in zip(self.exact[i], vectors[j])) for i, j in zip(at, column)]
            return np.array([min(max(s, LONG.min), LONG.max) for s in exact], np.int64)
        if len(at) * 20 > len(self.ids) * len(vectors):
            return (self.floats @ floats.T)[at, column].astype(np.int64)
        step = 1 << 17
        return np.concatenate(
            [np.einsum("ij,ij->i", self.floats[at[i: i + step]], floats[column[i: i + step]]) for i in range(0, len(at), step)]
        ).astype(np.int64)

    def _merge(self, at: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        at, found, scores = (np.concatenate(x) for x in ((self.at, at), (self.found, found), (self.scores, scores)))
        order = np.lexsort((found, -scores.astype(object) if (scores == LONG.min).any() else -scores, at))
        at, found, scores = at[order], found[order], scores[order]
        first = np.searchsorted(at, at, side="left")
        best = np.arange(len(at)) - first < self.k
        self.at, self.found, self.scores = at[best], found[best], scores[best]
        full = np.bincount(self.at, minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.at, np.arange(len(self.ids)), side="right") - 1
        self.floor[full] = self.scores[last[full]]


def _matrices(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix for each length of vector."""
    sizes = np.diff(np.asarray(vectors.offsets))
    keys, flat = np.asarray(ids), np.asarray(vectors.flatten())
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield keys[rows], flat[(ends[rows] - size)[:, None] + np.arange(size)]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``(id, v)`` queries against ``(id, v)`` candidates."""
    spark = candidates.sparkSession
    asked = materialize(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, math.ceil(asked.count() / block))

    def best(number: int) -> DataFrame:
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        held = [(i, v) for i, v in _matrices(rows.column(0).combine_chunks(), rows.column(1).combine_chunks())] if rows.num_rows else []
        shared = spark.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size = {v.shape[1]: Block(i, v, k) for i, v in shared.value}
            for batch in batches:
                for ids, vectors in _matrices(batch.column(0), batch.column(1)):
                    if target := by_size.get(vectors.shape[1]):
                        step = max(64, (1 << 21) // len(target.ids))  # pairs at a time
                        for i in range(0, len(ids), step):
                            target.see(ids[i: i + step], vectors[i: i + step])
            for b in by_size.values():
                yield pa.record_batch([pa.array(b.ids[b.at]), pa.array(b.found), pa.array(b.scores)], names=["query_id", "vec_id", "score"])

        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = candidates.mapInArrow(scan, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(ranked))
        done = materialize(found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        shared.destroy()  # before the next block comes to the driver
        return done

    return reduce(DataFrame.unionAll, [best(n) for n in range(blocks)])
