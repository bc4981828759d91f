"""N-gram Jaccard self-join with signature trees.

A document is the set of its distinct ``n``-word shingles; two documents link
when ``100 * |intersection| >= threshold * |union|``. The result is each
document's component of links.

1. Sets are hashed in one pass. Documents with equal sets are one *class* from
   here on, so exact copies never meet each other.
2. Classes that could link are brought together without a frequency order and
   without loss: sets of sizes that can link differ in at most ``d`` shingles,
   so of their shingles cut by hash into more than ``d`` parts all but ``d``
   parts are equal. A class emits the hash of each part that is not empty, for
   the two size windows it lies in; a class with ``d`` such parts or fewer emits
   its empty parts too, as only those might be equal (the number of parts is
   chosen so that this is rare). Classes joined by shared parts are a *block*;
   every link lies within a block. Parts hold several shingles, so a passage
   that many documents share hardly ever fills one.
3. Within a block a signature tree is built over its members, ordered by size:
   nodes hold the OR of their members' bitmaps, the least number of bits and the
   size range. A dual traversal starts from the root pair and drops node pairs
   that cannot reach the threshold (by size range, or by the bits that one side
   must have outside the other's bitmap), and pairs that links found so far have
   already put into one component. What is left is compared exactly.
4. A block of more than ``leaf`` members, chained by passages that fill parts, is
   blocked once more: its members' shingles are put into one order, rare ones
   first (counted in ``ORDER_SLOTS`` slots; any common order is right), and of
   two sets that link the first ``size - ceil(threshold * size) + 1`` shingles
   have one in common. A passage of many documents comes last in that order.
   Members that share none of these shingles link with nothing and go. A block
   that is chained again is replaced by one block for each smallest holder of a
   shared shingle, with all holders of its shingles; members may be in several
   of these, whose sizes do not grow with the length of chains.
   Shingles are stored once: places in blocks are rows of their own.
5. A block that still has more than ``leaf`` members is cut into leaves of about that size:
   leaves are joined in themselves, then their components' heads among each
   other, and at last the members outside the block's largest component meet
   every leaf. No task holds more than about two leaves; nothing is left out.

Hashes have 64 bits: texts with different shingles are taken for equal with a
probability of about 2^-64 per pair compared.

Defined results: a text with fewer than ``n`` words is one shingle (its whole
word sequence); null texts and texts without words have an empty set, are
linked with nothing and are their own component; repeated rows are documents of
one class; the smallest id of a component ignores null ids and is null where
all are; an empty table gives no rows; other columns are kept, a column with
the name of a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, give_back, quoted
from kinweave.llm.components import connected_components
from kinweave.llm.url_filter import Level
from kinweave.session import discard, materialize

BITS = 4096
FANOUT = 8
MAX_FILTER_WORDS = 1 << 21  # 16 MB of Bloom filter bits
BROADCAST_ROWS = 2_000_000
ORDER_SLOTS = 1 << 20
SLOT_ROW = 1 << 16  # slots whose counts are one row
COUNTERS = 64  # tasks that count slots, each for all of them
# From this size on a group's memory is returned after it, not kept for the next.
GROUP_BYTES = 1 << 20
ROUNDS = 8
ROUND_KEYS = 1 << 23  # with fewer keys there is one round
ROUND_BYTES = 1 << 28  # of shingles that are shuffled at a time
KEY_BLOCK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, n: int, memo: _WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; ASCII letters are lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > 40_000:
        memo.clear()
    h = np.array(list(map(memo.__getitem__, words)), np.uint64)
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i: len(h) - size + 1 + i])
    return np.unique(out)


def fingerprint(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Windows:
    """Size classes and, for each window of two neighbouring classes, the number of parts."""

    def __init__(self, threshold: int) -> None:
        self.t = threshold
        self.starts = [1]
        self._parts: list[int] = []
        self._apart: list[int] = []

    def upper(self, size: int) -> int:
        """The largest set that can link with one of ``size``."""
        return size * 100 // self.t

    def reach(self, size: int) -> None:
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, self.upper(last - 1) + 1))
            x = self.starts[-1] - 1
            apart = (100 - self.t) * (x + self.upper(x)) // (100 + self.t)
            self._apart.append(apart)
            self._parts.append(self._enough(apart, last) if apart else 0)

    @staticmethod
    def _enough(apart: int, least: int) -> int:
        """So many parts that a set of ``least`` shingles fills more than ``apart`` of them almost surely."""
        parts = apart + 1
        while True:
            filled = parts * (1 - np.exp(-least / parts))
            spread = np.sqrt(parts * np.exp(-least / parts) * (1 - (1 + least / parts) * np.exp(-least / parts)))
            if filled - 3.5 * spread > apart or parts > 4 * least:
                return parts
            parts += max(1, parts // 50)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.starts), sizes, side="right") - 1

    def parts(self, window: np.ndarray) -> np.ndarray:
        return np.where(window >= 0, np.array(self._parts, np.int64)[np.maximum(window, 0)], 0)

    def apart(self, window: np.ndarray) -> np.ndarray:
        """In how many shingles two sets of a window may differ that link."""
        return np.where(window >= 0, np.array(self._apart, np.int64)[np.maximum(window, 0)], 0)


def part_keys(sets: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, offsets)``: the part hashes of each set for its two windows."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    held_keys, held_owner = [], []
    own = windows.of(sizes)
    mixed = _mix(flat ^ np.uint64(0x5851F42D4C957F2D))
    for window in (own, own - 1):
        parts = np.where(sizes > 0, windows.parts(window), 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        live = parts[owner] > 0
        slot = base[owner[live]] + (flat[live] % np.maximum(parts[owner[live]], 1).astype(np.uint64)).astype(np.int64)
        total = int(base[-1])
        fold, count = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        with np.errstate(over="ignore"):
            np.add.at(fold, slot, mixed[live])
            of = np.repeat(np.arange(len(sets)), parts)
            empty = count == 0
            sparse = np.bincount(of[~empty], minlength=len(sets)) <= windows.apart(window)
            kept = ~empty | sparse[of]
            number = (np.arange(total) - base[of]).astype(np.uint64)
            where = _mix(window[of].astype(np.uint64) * np.uint64(1 << 32) + number)
            held_keys.append(_mix(fold + where)[kept])
        held_owner.append(of[kept])
    keys, of = np.concatenate(held_keys), np.concatenate(held_owner)
    order = np.argsort(of, kind="stable")
    return keys[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sets)))])


class SignatureTree:
    """A balanced tree over sets ordered by size; node arrays per level, leaves first."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            at = s % np.uint64(BITS)
            np.bitwise_or.at(bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        fewest = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, fewest, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            b, f, low, high = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(b, at), np.minimum.reduceat(f, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))
            )

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))

    def members(self, level: int, node: int) -> slice:
        width = FANOUT**level
        return slice(node * width, min((node + 1) * width, len(self.sets)))


def may_link(a: tuple, i: int, b: tuple, j: np.ndarray, t: int) -> np.ndarray:
    """Whether a member of node ``i`` could link with one of the nodes ``j``."""
    low_a, high_a, low_b, high_b = a[2][i], a[3][i], b[2][j], b[3][j]
    shared = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=-1).astype(np.int64)
    miss_a, miss_b = np.maximum(a[1][i] - shared, 0), np.maximum(b[1][j] - shared, 0)
    return (
        (100 * high_a >= t * low_b) & (100 * high_b >= t * low_a)
        & (100 * high_a - miss_a * (100 + t) >= t * low_b) & (100 * high_b - miss_b * (100 + t) >= t * low_a)
    )


class Joined:
    """Components of the members of one or two trees (union-find by smallest place)."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def union(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def roots(self, at: range) -> set[int]:
        return {self.root(i) for i in at}


def _linked(a: np.ndarray, b: np.ndarray, t: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= t * (len(a) + len(b) - shared)


def traverse(left: SignatureTree, right: SignatureTree, joined: Joined, shift: int, t: int) -> None:
    """Unite all linked members of two trees (one tree with itself if they are the same); the right one's members
    are numbered from ``shift``."""
    if not left.sets or not right.sets:
        return
    same = left is right
    todo = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while todo:
        la, i, lb, j = todo.pop()
        if la == 0 and lb == 0:
            if not (same and i == j) and joined.root(i) != joined.root(shift + j) and _linked(left.sets[i], right.sets[j], t):
                joined.union(i, shift + j)
            continue
        if not (same and la == lb and i == j):
            a, b = left.members(la, i), right.members(lb, j)
            both = joined.roots(range(a.start, a.stop)) | joined.roots(range(shift + b.start, shift + b.stop))
            if len(both) == 1:
                continue
        if same and la == lb and i == j:
            nodes = list(left.children(la, i))
            pairs = []
            for k, x in enumerate(nodes):
                rest = np.array(nodes[k + 1:], np.int64)
                if len(rest):
                    pairs += [(la - 1, x, lb - 1, int(y)) for y in rest[may_link(left.levels[la - 1], x, right.levels[lb - 1], rest, t)]]
            # a stack: nodes are joined in themselves before they meet each other
            todo += pairs[::-1] + [(la - 1, x, lb - 1, x) for x in nodes if la > 1]
        elif la >= lb:
            nodes = np.array(left.children(la, i))
            kept = nodes[may_link(right.levels[lb], j, left.levels[la - 1], nodes, t)]
            todo += [(la - 1, int(x), lb, j) for x in kept[::-1]]
        else:
            nodes = np.array(right.children(lb, j))
            kept = nodes[may_link(left.levels[la], i, right.levels[lb - 1], nodes, t)]
            todo += [(la, i, lb - 1, int(y)) for y in kept[::-1]]


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


EDGE = "fp long, root long"


def _join_group(table: pa.Table, t: int) -> pa.Table:
    """Edges (member, component head) of one group; with a ``side`` column only pairs of different sides are compared,
    and members with the same ``label`` are linked already."""
    fps = np.asarray(table.column("fp").combine_chunks())
    _, first = np.unique(fps, return_index=True)
    cross = "side" in table.column_names
    if cross:
        side = np.asarray(table.column("side").combine_chunks())
        first = np.array([i for s in (0, 1) for i in sorted(np.flatnonzero(side == s), key=lambda i: fps[i])], np.int64)
    fps, sets = fps[first], _sets(table.column("shingles").combine_chunks().take(pa.array(first)))
    order = np.lexsort((fps, [len(s) for s in sets], side[first] if cross else np.zeros(len(first))))
    fps, sets = fps[order], [sets[i] for i in order]
    joined = Joined(len(sets))
    if cross:
        split = int((side[first] == 0).sum())
        label = np.asarray(table.column("label").combine_chunks())[first][order]
        for value in np.unique(label):
            same = np.flatnonzero(label == value)
            for i in same[1:]:
                joined.union(int(same[0]), int(i))
        traverse(SignatureTree(sets[:split]), SignatureTree(sets[split:]), joined, split, t)
    else:
        tree = SignatureTree(sets)
        traverse(tree, tree, joined, 0, t)
    roots = np.array([joined.root(i) for i in range(len(sets))], np.int64)
    return pa.table({"fp": pa.array(fps), "root": pa.array(fps[roots])})


def _within(members: DataFrame, keys: list[str], t: int) -> DataFrame:
    columns = [*keys, "fp", "shingles", *[c for c in ("side", "label") if c in members.columns]]

    def join(table: pa.Table) -> pa.Table:
        found = _join_group(table, t)
        if table.nbytes >= GROUP_BYTES:
            give_back()
        return found

    return members.select(*columns).groupBy(*keys).applyInArrow(join, EDGE)


def _links_within(places: DataFrame | None, members: DataFrame, keys: list[str], t: int) -> DataFrame:
    """The stored links of :func:`_within` for the groups of ``places(*keys, fp[, side, label])``, or of ``members`` as they are.

    Shingles are stored once, in ``members``, however many places their set has.
    They meet their places in up to ``ROUNDS`` rounds of whole groups, so that
    no more than a round's share of them is shuffled.
    """
    sizes = members.select("fp", F.length("shingles").alias("bytes"))
    sizes = sizes if places is None else places.join(sizes.dropDuplicates(["fp"]), "fp")
    size, n = sizes.agg(F.sum("bytes"), F.count("*")).first()
    rounds = int(min(ROUNDS, 1 + (size or 0) // ROUND_BYTES))
    groups = members if places is None else places
    links = None
    for number in range(rounds):
        mine = groups if rounds == 1 else groups.filter(F.pmod(F.xxhash64(F.lit(rounds), *keys), F.lit(rounds)) == number)
        if places is not None:
            mine = members.select("fp", "shingles").join(F.broadcast(mine) if 2 * n // rounds <= BROADCAST_ROWS else mine, "fp")
        found = materialize(_within(mine, keys, t), "links")
        discard(members.sparkSession)
        links = found if links is None else links.unionByName(found)
    return links


def _flagged(level: Level, keys: np.ndarray) -> np.ndarray:
    """Whether the filter holds each key; some keys at a time, as a test makes several arrays of their length."""
    parts = [level.contains(keys[i: i + KEY_BLOCK], keys[i: i + KEY_BLOCK]) for i in range(0, len(keys), KEY_BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _candidate_edges(sets: DataFrame) -> DataFrame:
    """``(u, v)``: each class with the smallest class of every part that it shares.

    Keys go through in up to ``ROUNDS`` rounds by their hash. A round's edges are
    stored and its other files are let go before the next one begins, so no
    more than its share of the keys is on disk beside the stored sets.
    """
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    rounds = int(min(ROUNDS, 1 + total // ROUND_KEYS))
    edges = None
    for number in range(rounds):
        mine = F.col("keys") if rounds == 1 else F.filter("keys", lambda k: F.pmod(F.shiftrightunsigned(k, 7), F.lit(rounds)) == number)
        heads, found = _round_edges(sets.select(mine.alias("keys"), "fp"))
        found = materialize(found, "candidates")
        edges = found if edges is None else edges.unionByName(found)
        discard(spark, heads)
    return edges.distinct()


def _round_edges(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored table of shared keys, and the edges, which read it."""
    exploded = sets.select(F.explode("keys").alias("key"), "fp")
    heads = materialize(
        exploded.groupBy("key").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).filter("head <> last").select("key", "head"), "parts"
    )
    n = heads.count()
    words = int(min(MAX_FILTER_WORDS, max(1, n * 12 // 64 + 1)))
    blank = Level(np.zeros(words, np.uint64), 4, 7)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(words, np.uint64)
        for batch in batches:
            keys = np.asarray(batch.column(0)).view(np.uint64)
            for i in range(0, len(keys), KEY_BLOCK):
                at = blank.positions(keys[i: i + KEY_BLOCK], keys[i: i + KEY_BLOCK]).ravel()
                np.bitwise_or.at(mine, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(mine)
        for i in range(0, len(used), KEY_BLOCK):
            at = used[i: i + KEY_BLOCK]
            yield pa.record_batch([pa.array(at), pa.array(mine[at].view(np.int64))], names=["word", "bits"])
        del mine
        give_back()

    found = heads.select("key").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    blank.words[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    shared = sets.sparkSession.sparkContext.broadcast(blank)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            lists = batch.column(0)
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.flatten())
            owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
            hit = _flagged(level, flat.view(np.uint64))
            yield pa.record_batch([pa.array(flat[hit]), pa.array(np.asarray(batch.column(1))[owner[hit]])], names=["key", "fp"])
        give_back()

    shared_parts = sets.filter(F.size("keys") > 0).select("keys", "fp").mapInArrow(kept, "key long, fp long")
    return heads, shared_parts.join(heads, "key").filter("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v")).distinct()


def document_sets(docs: DataFrame, n: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """The stored table ``(id, n_shingles, fp, keys)``; ``fp`` is null for empty sets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, windows = _WordHashes(), Windows(threshold)
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                sets = [shingle_set(t.as_py(), n, memo) for t in batch.column(1).cast(pa.large_binary())]
                keys, offsets = part_keys(sets, windows)
                yield pa.record_batch(
                    [
                        batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64))),
                    ],
                    names=["id", "n_shingles", "fp", "keys"],
                )
        memo.clear()
        give_back()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(read, "id long, n_shingles long, fp long, keys array<long>"), "sets")


def _members(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``(block, fp, shingles)`` of the classes ``wanted(block, fp, id)``, hashed again from one text of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                sets = [shingle_set(t.as_py(), n, memo) for t in batch.column(2).cast(pa.large_binary())]
                own = pa.array([bool(len(s)) and fingerprint(s) == fp for s, fp in zip(sets, batch.column(1).to_pylist())])
                out = pa.record_batch([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["block", "fp", "shingles"])
                yield out.filter(own)
        memo.clear()
        give_back()

    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("of"), F.col(quoted(text_col)).cast("binary").alias("text"))
    picked = texts.join(F.broadcast(wanted) if small else wanted, F.col("of").eqNullSafe(F.col("id")))
    found = picked.select("block", "fp", "text").mapInArrow(read, "block long, fp long, shingles binary")
    return materialize(found, "members")


def _large(places: DataFrame, leaf: int) -> DataFrame:
    return materialize(places.groupBy("block").agg(F.count_distinct("fp").alias("m")).filter(F.col("m") > leaf), "large")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(ORDER_SLOTS)).astype(np.int64)


def prefix(shingles: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """The first shingles of a set in the order of ``counts``, so many that two sets that link share one."""
    size = len(shingles)
    order = np.lexsort((shingles, counts[_slots(shingles)]))
    return shingles[order[: size - -(-t * size // 100) + 1]]


def _unchained(edges: DataFrame, leaf: int) -> DataFrame:
    """``(fp, block)``: the components of ``edges``, long ones in blocks that may share members.

    An edge leads from a holder of a key to the smallest holder. A component of
    more than ``leaf`` members is replaced by the holders around each smallest
    one: any two holders of a key are together in the block of its smallest.
    """
    parts = materialize(connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("block")), "finer")
    long = materialize(parts.groupBy("block").agg(F.count("*").alias("m")).filter(F.col("m") > leaf).select("block"), "long")
    if not long.limit(1).count():
        return parts
    chained = edges.join(parts.join(long, "block", "left_semi").select(F.col("fp").alias("u")), "u", "left_semi")
    around = chained.select(F.explode(F.array("u", "v")).alias("fp"), F.col("v").alias("block")).distinct()
    return parts.join(long, "block", "left_anti").select("fp", "block").unionByName(around)


def _slot_counts(chained: DataFrame) -> np.ndarray:
    """How many sets hold each slot of the order. A task's counts are ``ORDER_SLOTS / SLOT_ROW`` rows of numbers and few
    tasks count, so what is moved does not grow with the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ORDER_SLOTS, np.int64)
        for batch in batches:
            for shingles in _sets(batch.column(0)):
                np.add.at(held, _slots(shingles), 1)
        for i in range(0, ORDER_SLOTS, SLOT_ROW):
            yield pa.record_batch([pa.array([i // SLOT_ROW]), pa.array([held[i: i + SLOT_ROW].tobytes()], pa.binary())], names=["part", "counts"])
        del held
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[part] = held.get(part, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([n.tobytes() for n in held.values()], pa.binary())], names=["part", "counts"])
        give_back()

    rows = "part long, counts binary"
    found = chained.select("shingles").coalesce(COUNTERS).mapInArrow(count, rows).repartition("part").mapInArrow(add, rows).toArrow()
    counts = np.zeros(ORDER_SLOTS, np.int64)
    for part, held in zip(found.column("part").to_pylist(), found.column("counts").to_pylist()):
        counts[part * SLOT_ROW: (part + 1) * SLOT_ROW] = np.frombuffer(held, np.int64)
    return counts


def _split(members: DataFrame, t: int, leaf: int) -> DataFrame:
    """``(block, fp)`` of ``members``, with blocks of more than ``leaf`` members replaced by the blocks of their rare
    shingles, several for some members."""
    large = _large(members, leaf)
    if not large.limit(1).count():
        return members.select("block", "fp").distinct()
    chained = members.join(large.select("block"), "block", "left_semi").select("block", "fp", "shingles")
    shared = members.sparkSession.sparkContext.broadcast(_slot_counts(chained))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            blocks = np.asarray(batch.column(0)).view(np.uint64)
            keys = [_mix(prefix(s, order, t) ^ _mix(blocks[i: i + 1])).view(np.int64) for i, s in enumerate(_sets(batch.column(2)))]
            yield pa.record_batch([batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["fp", "keys"])
        give_back()

    rare = materialize(chained.mapInArrow(first, "fp long, keys array<long>"), "rare")
    edges = materialize(_candidate_edges(rare), "edges")
    discard(members.sparkSession, rare)
    finer = _unchained(edges, leaf)
    kept = members.join(large.select("block"), "block", "left_anti").select("block", "fp").distinct()
    # a member without a shared rare shingle has no links in its block and no place
    return materialize(kept.unionByName(finer.select("block", "fp")), "places")


def _bucket(key: str, count: str, leaf: int, salt: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.ceil(F.col(count) / leaf)).cast("int")


def _block_links(members: DataFrame, t: int, leaf: int) -> DataFrame:
    """``(fp, root)`` for all members; ``root`` is the same for the members of a component. The table of ``members`` goes."""
    spark = members.sparkSession
    if not _large(members, leaf).limit(1).count():
        links = _links_within(None, members, ["block"], t)
        discard(spark, members)
        return links
    places = _split(members, t, leaf)
    large_blocks = _large(places, leaf)
    n_large = large_blocks.count()
    if not n_large:
        links = _joined(_links_within(places, members, ["block"], t))
        discard(spark, members, places)
        return links
    cut = places.join(large_blocks, "block", "left").withColumn("leaf", F.when(F.col("m").isNotNull(), _bucket("fp", "m", leaf, 1)).otherwise(0))
    first = _links_within(cut, members, ["block", "leaf"], t)
    large = cut.filter(F.col("m").isNotNull()).dropDuplicates(["block", "fp"])
    heads = large.drop("m", "leaf").join(first.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi")
    counts = heads.groupBy("block").agg(F.count("*").alias("h"))
    second = _links_within(heads.join(counts, "block").withColumn("chunk", _bucket("fp", "h", leaf, 2)), members, ["block", "chunk"], t)
    edges = first.unionByName(second)
    labels = connected_components(edges.filter("fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v")))
    known = materialize(
        large.join(labels, large.fp == labels.node, "left").select("block", "leaf", "m", "fp", F.coalesce("component", "fp").alias("label")), "labelled"
    )
    main = known.groupBy("block", "label").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    others = known.join(main, "block").filter("label <> main")
    n_others = others.groupBy("block").agg(F.count("*").alias("o"))
    others = materialize(others.join(n_others, "block").withColumn("chunk", _bucket("fp", "o", leaf, 3)).select("block", "m", "o", "chunk", "fp", "label"), "others")
    leaves = F.sequence(F.lit(0), F.ceil(F.col("m") / leaf).cast("int") - 1)
    chunks = F.sequence(F.lit(0), F.ceil(F.col("o") / leaf).cast("int") - 1)
    meeting = others.select("block", "chunk", F.explode(leaves).alias("leaf"), "fp", "label", F.lit(0).alias("side")).unionByName(
        known.join(others.select("block", "o").distinct(), "block")
        .select("block", F.explode(chunks).alias("chunk"), "leaf", "fp", "label", F.lit(1).alias("side"))
    )
    third = _links_within(meeting, members, ["block", "chunk", "leaf"], t)
    discard(spark, members, places, known, others)
    return _joined(edges.unionByName(third))


def _joined(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` of the members that links of ``(fp, root)`` put into one component."""
    joined = connected_components(edges.filter("fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v")))
    return joined.select(F.col("node").alias("fp"), F.col("component").alias("root"))


def jaccard_components(
    docs: DataFrame, n: int = 3, threshold: int = 90, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512,
) -> DataFrame:
    """``(id, n_shingles, component_id)``, one row per row of ``docs``."""
    if not 50 <= threshold <= 100:
        raise ValueError("threshold is a percentage from 50 to 100")
    sets = document_sets(docs, n, threshold, id_col, text_col)
    documents = materialize(sets.drop("keys"), "documents")
    classes = materialize(
        documents.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes"
    )
    blocks = connected_components(_candidate_edges(sets))
    wanted = materialize(
        blocks.join(classes, blocks.node == classes.fp).select(F.col("component").alias("block"), "fp", "id"), "wanted"
    )
    discard(docs.sparkSession, sets)  # the keys took most of it
    links = _block_links(_members(docs, wanted, n, id_col, text_col), threshold, leaf)
    linked = links.select("fp", "root").distinct().join(wanted.select("fp", "id"), "fp")
    smallest = linked.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("k")).filter("k > 1")
    moved = linked.join(smallest, "root").select("fp", "component_id")
    known = materialize(
        classes.join(moved, "fp", "left").filter(F.col("component_id").isNotNull() | (F.col("copies") > 1))
        .select("fp", F.coalesce("component_id", "id").alias("component_id"), F.lit(True).alias("grouped")), "components"
    )
    return documents.join(known, "fp", "left").select(
        "id", "n_shingles", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
