"""SimHash near duplicates by tables of distances to reference fingerprints.

1. Every text gets a 64-bit fingerprint: a bit is set if it is set in over half
   the hashes of the text's word shingles. Texts with one fingerprint are one
   row from here on.
2. The pivot table: the Hamming distances of each fingerprint to ``PIVOTS``
   reference fingerprints, taken byte by byte. The distances of a whole
   fingerprint are the sums over its bytes.
3. Of two fingerprints at most two bits apart at least six of the eight bytes
   are equal, so in these every distance of the table is equal. A row is dealt
   by the distances of each choice of six bytes (28 keys), and only rows with
   an equal key meet. The references tell all values of a byte apart, so a key
   fixes 48 bits and a group has at most 65,536 fingerprints, whatever the
   data; there is no key that grows with the corpus.
4. Inside a group, rows are ordered by their distance to the first reference. A
   row meets only those after it within ``bits``; pairs whose distances to any
   other reference differ by more are discarded, and survivors are verified.
   Groups go through a task as sorted rows, many small ones in one array step.
5. Of a group's links only a spanning forest leaves the task, so the edges are
   fewer than the rows; components are found by contraction.

A fingerprint that holds a large share of all rows is joined back by a
broadcast of at most ``HOT_ROWS`` rows, all others by a shuffle.

Defined results: null and empty texts, and those of white space, have no
shingles and fingerprint zero, which is linked like any other; repeated rows
are separate rows of one component; a null id takes part, but no component is
named after it (null if it has no other member); an empty table gives no rows;
a column with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, quoted, whole_row, with_results
from kinweave.llm.components import connected_components
from kinweave.session import materialize

PIVOTS = 16
PARTS = 8
HOT_ROWS = 1000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PAIR_BLOCK = 1 << 20


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of all words if there are fewer."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.append(0, ends[:-1] + 1)
    size = min(words, len(parts))
    spans = zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in spans), np.uint64, len(parts) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        block = hashes[start: start + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``(row, fp)``: the columns of ``docs`` but the text as a struct, and the fingerprint as a long."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([majority(shingle_hashes(t.as_py() or b"", words, seed)) for t in texts.cast(pa.large_binary())], pa.int64())

    kept = [c for c in docs.columns if c != text_col]
    row = whole_row(docs.select(*[quoted(c) for c in kept])) if kept else F.lit(None)
    return docs.select(row.alias("row"), simhash(F.col(quoted(text_col)).cast("binary")).alias("fp"))


def references(seed: int = 1) -> np.ndarray:
    """``PIVOTS`` reference fingerprints, as rows of eight bytes, that tell all values of every byte apart."""
    rng = np.random.default_rng(seed)
    values = np.arange(256, dtype=np.uint8)
    while True:
        pivots = rng.integers(0, 256, (PIVOTS, PARTS), dtype=np.uint8)
        if all(len(np.unique(np.bitwise_count(values[:, None] ^ pivots[None, :, p]), axis=0)) == 256 for p in range(PARTS)):
            return pivots


class PivotTable:
    """Distances of fingerprints to the references, byte by byte."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        values = np.arange(256, dtype=np.uint8)
        # of each byte: its distances to the references' byte, four bits each, as one word
        self.words = np.zeros((PARTS, 256), np.uint64)
        for part in range(PARTS):
            for k in range(PIVOTS):
                self.words[part] |= np.bitwise_count(values ^ pivots[k, part]).astype(np.uint64) << np.uint64(4 * k)

    def by_part(self, fps: np.ndarray) -> np.ndarray:
        """``(rows, PARTS)``: the packed distances of each byte."""
        parts = fps.astype(">i8").view(np.uint8).reshape(-1, PARTS)
        return np.stack([self.words[p][parts[:, p]] for p in range(PARTS)], axis=1)

    def whole(self, by_part: np.ndarray) -> np.ndarray:
        """``(rows, PIVOTS)``: the distances of whole fingerprints."""
        return np.stack([((by_part >> np.uint64(4 * k)) & np.uint64(15)).sum(axis=1) for k in range(PIVOTS)], axis=1).astype(np.uint8)


def _mixed(columns: np.ndarray) -> np.ndarray:
    """One hash per row of 64-bit words; equal rows have equal hashes."""
    out = np.full(len(columns), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns.T:
        out = (out ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


def keyed_rows(fps: DataFrame, bits: int = 2, seed: int = 1) -> DataFrame:
    """``(key, fp, near)``: every fingerprint once per choice of bytes that must be equal, with its row of the pivot table."""
    table, choices = PivotTable(references(seed)), list(combinations(range(PARTS), PARTS - bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(start, 4096).to_numpy()
                by_part = table.by_part(values)
                near = pa.array([bytes(r) for r in table.whole(by_part)], pa.binary())
                for number, choice in enumerate(choices):
                    key = _mixed(np.column_stack([np.full(len(values), number, np.uint64), by_part[:, list(choice)]]))
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(values), near], names=["key", "fp", "near"])

    return fps.select("fp").mapInArrow(deal, "key long, fp long, near binary")


def close_pairs(keys: np.ndarray, fps: np.ndarray, near: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs at most ``bits`` apart among rows sorted by key and first distance."""
    found, rows = [], np.arange(len(keys))
    step, live = 1, rows[:-1]
    while len(live):
        live = live[live + step < len(keys)]
        same = (keys[live] == keys[live + step]) & (near[live + step, 0].astype(np.int16) - near[live, 0] <= bits)
        live = live[same]  # rows are sorted, so a row without a partner here has none further on
        for start in range(0, len(live), _PAIR_BLOCK):
            left = live[start: start + _PAIR_BLOCK]
            for k in range(1, PIVOTS):
                apart = np.abs(near[left, k].astype(np.int16) - near[left + step, k])
                left = left[apart <= bits]
            left = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= bits]
            if len(left):
                found.append((left, left + step))
        step += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


def _forest(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs that join two parts that were apart until then."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            yield a, b


def links(fps: DataFrame, bits: int = 2, seed: int = 1) -> DataFrame:
    """``(u, v)``: links of distinct fingerprints that join all that are at most ``bits`` apart (0 to 3)."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be from 0 to 3: with more, a key would fix too little of a fingerprint to bound its group")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the group that the next batch may continue

        def pairs(group: pa.Table) -> pa.RecordBatch:
            group = group.combine_chunks()
            keys, values = group.column(0).to_numpy(), group.column(1).to_numpy()
            near = np.frombuffer(b"".join(group.column(2).to_pylist()), np.uint8).reshape(-1, PIVOTS)
            order = np.lexsort((near[:, 0], keys))
            left, right = close_pairs(keys[order], values[order], near[order], bits)
            kept = list(_forest(values[order][left], values[order][right]))
            return pa.record_batch([pa.array([a for a, _ in kept], pa.int64()), pa.array([b for _, b in kept], pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            last = keys[batch.num_rows - 1].as_py()
            start = pc.index(keys, last).as_py()
            if start or (held and held[-1].column(0)[0].as_py() != last):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            held.append(batch.slice(start))
        if held:
            yield pairs(pa.Table.from_batches(held))

    rows = keyed_rows(fps, bits, seed)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "u long, v long").distinct()


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, bits: int = 2) -> DataFrame:
    """The columns of ``docs`` but the text, with ``fp`` (long), ``fingerprint`` (hex) and ``component_id``."""
    rows = materialize(fingerprints(docs, text_col, words), "fingerprints")
    names = [c for c in docs.columns if c != text_col]
    of_row = F.col(f"row.{quoted(id_col)}")
    fps = materialize(rows.groupBy("fp").agg(F.min(of_row).alias("first_id"), F.count("*").alias("n")), "distinct")
    labels = connected_components(links(fps, bits))
    grouped = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("component"))
    named = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = materialize(grouped.join(named, "component").select("fp", "component_id", "n"), "components")

    total = fps.agg(F.sum("n")).first()[0] or 0
    hot = known.filter(F.col("n") > total / HOT_ROWS).select("fp", "component_id")  # under HOT_ROWS rows, as counts add up to the total
    in_hot = rows.join(F.broadcast(hot), "fp")
    others = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(known.filter(F.col("n") <= total / HOT_ROWS).select("fp", "component_id"), "fp")
    return in_hot.unionByName(others).select(
        *with_results("row", names, fp=F.col("fp"), fingerprint=F.lpad(F.lower(F.hex("fp")), 16, "0"), component_id=F.col("component_id"))
    )
