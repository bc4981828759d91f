"""URL filter rules held in Bloom filter cascades.

A rule is ``host/path``: it fits its host and all subdomains when the url's
path starts with the rule's. The candidate keys of a url are its host suffixes
(as many labels as some rule has) with its path prefixes (as long as some
rule's). All candidate keys of the corpus are the key universe. A cascade
encodes the listed keys exactly over that universe: level 1 holds the listed
keys, level 2 the unlisted keys that level 1 lets through, level 3 the listed
keys that level 2 lets through, and so on until a level lets nothing wrong
through. The first level that rejects a key decides, so urls are judged by
array expressions and bit tests; no join is left.

Sizes: level 1 is built for a false-positive rate of about ``rules / universe``,
so that later levels hold about as many keys as there are rules, and a cascade
has about ``rules * log2(universe / rules)`` bits. The rules are a parameter of
at most ``MAX_RULES`` entries; that is the bound of what is broadcast.

Defined results: a null url or one without ``://`` has an empty host and path
and fits no rule; urls that fit no rule are allowed; of several rules the
longest wins; repeated urls are judged alike; an empty corpus gives no rows;
other columns are kept, a column with the name of a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import lower_ascii, quoted, whole_row, with_results
from kinweave.session import materialize

MAX_RULES = 1_000_000
MAX_LEVELS = 64


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, other for each salt."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Level:
    """One Bloom filter; ``words`` are 64-bit words of its bits."""

    words: np.ndarray
    hashes: int
    salt: int

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b = _mix(h1, 2 * self.salt), _mix(h2, 2 * self.salt + 1) | np.uint64(1)
        with np.errstate(over="ignore"):
            at = a[None, :] + np.arange(self.hashes, dtype=np.uint64)[:, None] * b[None, :]
        return at % np.uint64(len(self.words) * 64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.positions(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """The filter of ``n`` keys; bits are set in the tasks and meet as 64-bit words, which the filter's size bounds."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(1, math.ceil(max(n, 1) * hashes / math.log(2) / 64))
    blank = Level(np.zeros(size, np.uint64), hashes, salt)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            at = blank.positions(h1, h2).ravel()
            bits = np.zeros(size, np.uint64)
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            used = np.flatnonzero(bits)
            yield pa.record_batch([pa.array(used, pa.int64()), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

    rows = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).collect()
    blank.words[[r["word"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    return blank


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of its universe. Without levels it lists nothing."""

    levels: tuple[Level, ...] = ()

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(h1), bool)
        live = np.arange(len(h1))
        for depth, level in enumerate(self.levels):
            hit = level.contains(h1[live], h2[live])
            inside[live[~hit]] = depth % 2 == 1
            live = live[hit]
        inside[live] = len(self.levels) % 2 == 1
        return inside

    def filter(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys(h1, h2, ...)`` that it contains."""
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h1, h2 = (np.asarray(batch.column(n)).view(np.uint64) for n in ("h1", "h2"))
                yield batch.filter(pa.array(self.contains(h1, h2)))

        return keys.mapInArrow(kept, keys.schema)


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def build_cascade(listed: list[str], universe: DataFrame) -> Cascade:
    """The cascade of the keys ``listed`` over ``universe(key)``, which may repeat keys."""
    spark = universe.sparkSession
    if len(listed) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not listed:
        return Cascade()
    wanted = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string").select("key", *_hashed(F.col("key")))
    n = len(set(listed))
    size = universe.agg(F.approx_count_distinct("key", 0.05)).first()[0] or 0
    levels = [_level(wanted.select("h1", "h2"), n, min(0.5, n / max(size, 1)), 1)]
    hashed = universe.select("key", *_hashed(F.col("key")))
    wrong = Cascade(tuple(levels)).filter(hashed).distinct().join(wanted.select("key"), "key", "left_anti")
    wrong = materialize(wrong, "cascade")
    sides, counts = [wanted, wrong], [n, wrong.count()]
    while counts[1]:
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        side = len(levels) % 2  # 1: the level encodes unlisted keys
        levels.append(_level(sides[side].select("h1", "h2"), counts[side], 0.5, len(levels) + 1))
        # of the other side only what the new level lets through is still undecided
        other = 1 - side
        sides[other] = materialize(Cascade((levels[-1],)).filter(sides[other]), "cascade")
        counts[other] = sides[other].count()
        if not counts[other]:
            break
    return Cascade(tuple(levels))


def candidate_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """The keys that a rule of ``rules`` may equal, longest first."""
    split = [r.partition("/") for r in rules]
    labels = sorted({h.count(".") + 1 for h, _, _ in split})
    lengths = sorted({len(p) + 1 for _, _, p in split})
    n_labels = F.size(F.split(host, r"\."))
    keys = [
        F.when((n_labels >= n) & (F.length(path) >= k) & path.startswith("/"), F.concat(F.substring_index(host, ".", -n), F.left(path, F.lit(k))))
        for n in labels for k in lengths
    ]
    if not keys:
        return F.array().cast("array<string>")
    by_length = lambda a, b: (
        F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    )
    return F.array_sort(F.array_compact(F.array(*keys)), by_length)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``. ``rules`` are ``(verdict, "host/path")``;
    of a rule that is given with both verdicts, ``block`` counts."""
    keys = [k for _, k in rules]
    url = F.col(quoted(url_col))
    parsed = pages.select(whole_row(pages).alias("row"), url_host(url).alias("h"), url_path(url).alias("p"))
    parsed = parsed.withColumn("cands", candidate_keys(F.col("h"), F.col("p"), keys))
    universe = parsed.select(F.explode("cands").alias("key"))
    block = {k for v, k in rules if v == "block"}
    cascades = {
        v: build_cascade(sorted(s), universe) for v, s in (("block", block), ("allow", {k for v, k in rules if v == "allow"} - block))
    }
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(cascades)

    def listed(verdict: str) -> Column:
        @F.arrow_udf("array<boolean>")
        def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
            flat = [np.asarray(x.values).view(np.uint64)[x.offsets[0].as_py(): x.offsets[-1].as_py()] for x in (h1, h2)]
            offsets = np.asarray(h1.offsets)
            inside = shared.value[verdict].contains(*flat)
            return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(inside))

        return test("h1s", "h2s")

    tested = (
        parsed.withColumn("h1s", F.transform("cands", lambda k: F.xxhash64(k)))
        .withColumn("h2s", F.transform("cands", lambda k: F.xxhash64(F.lit(1), k)))
        .withColumn("blocked", listed("block")).withColumn("allowed", listed("allow"))
    )
    hits = F.filter(
        F.zip_with(
            F.arrays_zip("cands", "blocked"), "allowed",
            lambda a, ok: F.struct(a["cands"].alias("key"), a["blocked"].alias("blocked"), ok.alias("allowed")),
        ),
        lambda x: x["blocked"] | x["allowed"],
    )
    hit = F.get(hits, 0)
    judged = tested.withColumn("hit", hit)
    verdict = F.when(F.col("hit.blocked"), "block").otherwise("allow")
    return judged.select(
        *with_results("row", pages.columns, host=F.col("h"), path=F.col("p"), rule=F.col("hit.key"), verdict=verdict)
    )
