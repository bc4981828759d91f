import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import pivot_join as P


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, fps, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    out = {}
    for i, d in enumerate(ids):
        out.setdefault(root(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in out.items()}
    return [least[root(i)] for i in range(len(ids))]


def test_components_against_brute_force(spark, docs):
    rng = random.Random(13)
    words = [f"W{i}" for i in range(400)] + ["é", "ñandú", " x"]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 60, 300]))
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\t", "\r\n ", "\x0b"]).join(copy))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(5, None), (4, ""), (6, " \n\t "), (7, "one"), (8, "ONE"), (None, "one"), (None, "only a null id here"), (9, texts[3]), (9, texts[3])]
    schema = "doc_id long, text string, row int, fp string, component_id string, n int, first_id int, component int"
    for bits in (2, 0, 3):
        out = P.simhash_components(docs(rows, schema), bits=bits).collect()
        fps = [_fingerprint(t) for _, t in rows]
        want = sorted((repr((d, f"{f:016x}", c)) for (d, _), f, c in zip(rows, fps, _components([d for d, _ in rows], fps, bits))))
        assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in out) == want
    assert "text" not in out[0].asDict() and "n" in out[0].asDict()
    assert len({c for c in _components([d for d, _ in rows], fps, 2)}) < len(set(fps))  # there are links between different fingerprints


def test_hash_and_bits_are_those_of_the_engine(spark):
    texts = ["a", "a b c", "é ñ 😀", "x" * 500]
    ours = [int(np.int64(np.uint64(P.shingle_hashes(t.encode())[0]))) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h"))
    assert ours == [r.h for r in df.collect()]
    assert P.majority(np.array([3, 1], np.uint64)) == 1  # a bit of exactly half the hashes is not set
    assert P.majority(np.zeros(0, np.uint64)) == 0
    assert P.majority(np.full(40_000, 2**64 - 1, np.uint64)) == -1


def test_references_tell_bytes_apart_and_distances_add_up():
    pivots = P.references()
    table = P.PivotTable(pivots)
    fps = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 500)
    by_part = table.by_part(fps)
    whole = table.whole(by_part)
    for k in range(P.PIVOTS):
        reference = int.from_bytes(pivots[k].tobytes(), "big")
        assert whole[:, k].tolist() == [((int(f) & (2**64 - 1)) ^ reference).bit_count() for f in fps]
    for part in range(P.PARTS):
        assert len(set(table.words[part].tolist())) == 256


def test_dense_ball_and_batches_that_cut_groups(spark):
    rng = np.random.default_rng(5)
    centre = 0x0123456789ABCDEF
    near = {centre}
    while len(near) < 3000:  # fingerprints around one point: large groups, many links
        f = centre
        for b in rng.choice(63, rng.integers(1, 5), replace=False):
            f ^= 1 << int(b)
        near.add(f)
    far = [int(x) for x in rng.integers(0, 2**62, 300)]
    values = sorted(near) + far
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        edges = [(r.u, r.v) for r in P.links(fps).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((u ^ v).bit_count() <= 2 for u, v in edges)
    arr = np.array(values, np.int64)
    group = {v: v for v in values}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in edges:
        group[root(u)] = root(v)
    for i, v in enumerate(values):
        for w in arr[i + 1:][np.bitwise_count(arr[i + 1:] ^ v) <= 2].tolist():
            assert root(v) == root(w)


def test_pairs_are_cut_by_the_table_before_they_are_verified():
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63 - 1, 2000)
    fps[1000:] = fps[:1000] ^ np.int64(5)
    table = P.PivotTable(P.references())
    near = table.whole(table.by_part(fps))
    order = np.argsort(near[:, 0], kind="stable")
    left, right = P.close_pairs(np.zeros(2000, np.int64), fps[order], near[order], 2)
    assert len(left) == 1000 and set(np.bitwise_count(fps[order][left] ^ fps[order][right]).tolist()) == {2}


def test_empty_table_and_wrong_bits(spark, docs):
    assert P.simhash_components(docs([])).count() == 0
    with pytest.raises(ValueError):
        P.links(docs([]).select(F.lit(1).cast("long").alias("fp")), bits=4)
