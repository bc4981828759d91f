import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import decontamination as D
from kinweave.llm import signature_join as S
from kinweave.llm import topk
from kinweave.llm.components import connected_components
from kinweave.session import materialize, scratch_dir

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORDS.findall((text or "").translate(FOLD))


def _contaminated(text, items, width):
    words, hit, found = _words(text), set(), set()
    for item_id, item in items:
        w = _words(item)
        size = min(width, len(w))
        for window in {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if w else ():
            for s in range(len(words) - size + 1):
                if tuple(words[s: s + size]) == window:
                    hit.update(range(s, s + size))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_contamination_against_brute_force(spark, docs):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "a1", "ñ"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 9, 14])))) for i in range(25)]
    items += [(40, None), (41, "..."), (3, items[3][1]), (42, "w1 w1 w1 w1 w1 w1"), (43, "É")]
    rows = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.choice([0, 3, 40, 200]))
        if i % 3:
            text[len(text) // 2: len(text) // 2] = [rng.choice([x for _, x in items if x]).upper().replace("É", "É")]
        rows.append((i % 55, rng.choice([" ", ", ", "--"]).join(text)))
    rows += [(100, None), (101, ""), (102, "w1 " * 3000), (103, rows[1][1]), (103, rows[1][1])]
    for width in (4, 10):
        out = D.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"), width).collect()
        assert len(out) == len(rows) and "text" not in out[0].asDict() and "shard" in out[0].asDict()
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in out)
        want = sorted((i, *c, c[1] > 0) for i, c in ((i, _contaminated(t, items, width)) for i, t in rows))
        assert got == want
        assert all(sum(s["last"] - s["first"] for s in r.spans) == r.n_hit for r in out)


def test_contamination_in_blocks_of_windows(spark, docs, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(12)], k=rng.choice([2, 5, 12])))) for i in range(20)]
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(14)], k=60))) for i in range(30)] + [(99, None)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    read = lambda: sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.spans) for r in D.contamination(docs(rows), asked, 4).collect())
    one = read()
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 20)
    assert read() == one and [(i, *c) for i, c in ((i, _contaminated(t, items, 4)) for i, t in rows)] == [r[:4] for r in one]


def test_groups_are_found_by_their_rarest_term():
    groups = D.Groups([[3, 1, 2], [5], [3, 4]], 7)
    held = lambda *t: groups.held(np.array(t, np.int32))
    assert held(1, 2, 3) and held(5) and held(3, 4, 0) and not held(3, 1) and not held(1, 2, 4) and not held(6) and not held()
    assert not D.Groups([], 3).held(np.array([1], np.int32)) and not D.Groups([], 0).held(np.zeros(0, np.int32))


def test_merged_spans(spark):
    hits = spark.createDataFrame([(1, 0, 4), (1, 2, 3), (1, 4, 6), (1, 8, 9), (2, 5, 7)] + [(3, i, i + 2) for i in range(5000)], "doc_row long, first int, last int")
    got = {r.doc_row: [tuple(x) for x in r.spans] for r in D.merged_spans(hits).collect()}
    assert got == {1: [(0, 6), (8, 9)], 2: [(5, 7)], 3: [(0, 5001)]}


def test_contamination_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contamination(docs([]), items).count() == 0
    (row,) = D.contamination(docs([(1, "a b c")]), items.limit(0)).collect()
    assert (row.n_words, row.n_hit, row.item_ids) == (3, 0, [])


def test_proximity_matches_words_in_any_order(spark, docs):
    items = spark.createDataFrame([(1, "red fox jumps")], "item_id long, text string")
    df = docs([(1, "jumps the red old fox"), (2, "red x x x x x x fox jumps"), (3, "red fox")])
    windows, terms, needed = D.ranked_windows(items, df, 10, "text", "item_id", "text")
    index = D.build_index(df, terms, needed)
    rows = {r.doc_row: r.row.doc_id for r in index.collect()}
    near = lambda d: {rows[r.doc_row] for r in D.find_proximity(index, windows, d).collect()}
    assert near(1) == set() and near(4) == {1} and near(9) == {1, 2}


def _top(vectors, k):
    q = {}
    for i, v in vectors:
        if i is not None and i % 2 == 0:
            q[i] = min(q[i], v) if i in q else v
    out = []
    for i, v in q.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j is not None and j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_one_block_of_queries_is_held_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    live, most, make = set(), [], type(spark.sparkContext).broadcast

    def broadcast(self, value):
        shared = make(self, value)
        live.add(id(shared))
        most.append(len(live))
        drop = shared.destroy
        shared.destroy = lambda *a, **k: (live.discard(id(shared)), drop(*a, **k))
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert topk.top_k(df, df, k=3, block=20).count() == 600
    assert len(most) == 10 and max(most) == 1 and not live


@pytest.mark.parametrize("size,high", [(7, 1000), (64, 300), (1, 3), (33, 2**30)])
def test_top_k_against_brute_force(spark, size, high):
    rng = np.random.default_rng(size)
    rows = [(int(i), [int(x) for x in rng.integers(-high, high, size)]) for i in rng.integers(0, 400, 260)]
    rows += [rows[0]] * 20 + [(7, rows[1][1][:1] + [1] * size)]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("id % 2 = 0"), k=5, block=60).select("query_id", "rank", "vec_id", "score").collect())
    assert got == _top(rows, 5)


def test_vectors_that_take_no_part(spark):
    bad = [(1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 0.0], 0), (None, [1.0, 1.0], 0), (6, [0.5, -0.0001], 0)]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<float>, id int")
    assert [(r.id, list(r.v)) for r in topk.quantised(df).collect()] == [(6, [512, -1])]
    empty = topk.quantised(df.limit(0))
    assert topk.top_k(empty, empty).count() == 0


def _components(rows, n, t):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, text in rows:
        w = split.findall((text or "").translate(FOLD))
        k = min(n, len(w))
        sets.append({tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= t * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return sorted(((k, len(sets[i]), min([x for x in least[root(i)] if x is not None], default=None)) for i, (k, _) in enumerate(rows)), key=str)


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_jaccard_components_against_brute_force(spark, docs):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 2, 3, 8, 12, 30, 90]))]
        for _ in range(rng.randint(1, 7)):
            rows.append((len(rows), " ".join(_edited(rng, base, rng.choice([0, 1, 1, 2, 4])))))
    rows += [(len(rows) + i, " ".join(passage + [f"u{i}x{k}" for k in range(20)])) for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One Two"), (904, "one\ttwo"), (905, "one"), (906, "ÀB ÀB ÀB"), (906, "ÀB ÀB ÀB"), (None, "one"), (None, None)]
    rng.shuffle(rows)
    for n, t in ((3, 90), (5, 80), (1, 60)):
        got = sorted(((r.id, r.n_shingles, r.component_id) for r in S.jaccard_components(docs(rows), n, t).collect()), key=str)
        assert got == _components(rows, n, t)


def test_large_blocks_are_cut_and_lose_no_link(spark, docs):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(_edited(rng, base, rng.choice([0, 1, 2, 3, 6])))) for i in range(40)]
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in S.jaccard_components(docs(rows), 3, 80, leaf=5).collect()), key=str)
    assert got == _components(rows, 3, 80)
    assert S.jaccard_components(docs([])).count() == 0


def test_blocks_chained_by_a_passage_are_split_and_keep_every_link(spark, docs):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(40):
        own = [f"g{g}w{i}" for i in range(rng.choice([40, 60, 90]))]
        rows += [(2 * g, " ".join(own + passage)), (2 * g + 1, " ".join(_edited(rng, own, 2) + passage))]
    sets = [S.shingle_set(t.encode(), 5, S._WordHashes()) for _, t in rows]
    members = spark.createDataFrame([(7, i, bytearray(s.tobytes())) for (i, _), s in zip(rows, sets)], "block long, fp long, shingles binary")
    block = {r.fp: r.block for r in S._split(members, 80, 8).collect()}
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if S._linked(sets[i], sets[j], 80)]
    assert len(linked) >= 40 and all(block[i] == block[j] for i, j in linked)
    assert max(sum(b == x for b in block.values()) for x in set(block.values())) <= 8
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in S.jaccard_components(docs(rows), 5, 80, leaf=8).collect()), key=str)
    assert got == _components(rows, 5, 80)


def test_long_chains_of_shared_passages_end_in_small_blocks(spark, docs):
    rng = random.Random(10)
    passage = [[f"g{g}w{i}" for i in range(30)] for g in range(121)]
    rows = [(g, " ".join(passage[g] + passage[g + 1])) for g in range(120)]
    rows += [(200 + g, " ".join(_edited(rng, passage[g] + passage[g + 1], 1))) for g in range(0, 120, 10)]
    sets = [S.shingle_set(t.encode(), 3, S._WordHashes()) for _, t in rows]
    members = spark.createDataFrame([(7, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "block long, fp long, shingles binary")
    blocks = defaultdict(set)
    for r in S._split(members, 80, 8).collect():
        blocks[r.block].add(r.fp)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if S._linked(sets[i], sets[j], 80)]
    assert len(linked) >= 10 and all(any({i, j} <= held for held in blocks.values()) for i, j in linked)
    assert max(map(len, blocks.values())) <= 8
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in S.jaccard_components(docs(rows), 3, 80, leaf=8).collect()), key=str)
    assert got == _components(rows, 3, 80)


def test_part_keys_meet_for_every_pair_that_may_link():
    rng = np.random.default_rng(7)
    for t in (60, 80, 90):
        windows, sets = S.Windows(t), []
        for _ in range(60):
            size = int(rng.integers(1, 160))
            pool = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64))
            a, b = pool[:size], pool[size:]
            away = int(rng.integers(0, max(1, size // 4) + 1))
            sets += [np.sort(a), np.sort(np.concatenate([a[away:], b[: int(rng.integers(0, away + 1))]]))]
        keys, offsets = S.part_keys(sets, windows)
        own = [set(keys[offsets[i]: offsets[i + 1]].tolist()) for i in range(len(sets))]
        for i in range(0, len(sets), 2):
            a, b = set(sets[i].tolist()), set(sets[i + 1].tolist())
            if b and a != b and 100 * len(a & b) >= t * len(a | b):
                assert own[i] & own[i + 1]


def test_tree_bounds_never_drop_a_link():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = sorted((np.sort(rng.choice(base, int(rng.integers(5, 290)), replace=False)) for _ in range(60)), key=len)
    for t in (60, 90):
        tree = S.SignatureTree(sets)
        for level in range(len(tree.levels)):
            nodes = tree.levels[level]
            for i in range(len(nodes[0])):
                may = S.may_link(nodes, i, nodes, np.arange(len(nodes[0])), t)
                for j in range(len(nodes[0])):
                    linked = any(S._linked(x, y, t) for x in sets[tree.members(level, i)] for y in sets[tree.members(level, j)])
                    assert may[j] or not linked


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (3, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{i: 100 for i in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_candidates_do_not_depend_on_rounds(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, [rng.randrange(-(2**63), 2**63) if rng.random() < 0.5 else rng.randrange(40) * 2**40 - 2**45 for _ in range(rng.randrange(9))]) for i in range(300)]
    sets = spark.createDataFrame(rows, "fp long, keys array<long>")
    one = {(r.u, r.v) for r in S._candidate_edges(sets).collect()}
    monkeypatch.setattr(S, "ROUND_KEYS", 100)
    monkeypatch.setattr(S, "KEY_BLOCK", 7)
    assert {(r.u, r.v) for r in S._candidate_edges(sets).collect()} == one and len(one) > 100


def test_join_leaves_no_table_of_shingles_or_keys(spark, docs):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(_edited(rng, base, rng.choice([0, 1, 2, 3, 6])))) for i in range(40)]
    folder = Path(scratch_dir(spark))
    before = set(folder.glob("*")) if folder.exists() else set()
    got = S.jaccard_components(docs(rows), 3, 80, leaf=5)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert "components" in left and not left & {"sets", "parts", "rare", "members", "leaves", "labelled", "others"}
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == _components(rows, 3, 80)


def test_shingles_are_stored_once_however_many_blocks_a_member_has(spark, docs, monkeypatch):
    rng = random.Random(12)
    passage = [[f"g{g}w{i}" for i in range(30)] for g in range(31)]
    rows = [(g, " ".join(passage[g] + passage[g + 1])) for g in range(30)]
    rows += [(200 + g, " ".join(_edited(rng, passage[g] + passage[g + 1], 1))) for g in range(0, 30, 10)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, rows[7][1])]
    stored = []
    monkeypatch.setattr(S, "materialize", lambda df, label: stored.append((label, df.columns)) or materialize(df, label))
    monkeypatch.setattr(S, "ROUND_BYTES", 1 << 15)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in S.jaccard_components(docs(rows), 3, 80, leaf=4).collect()), key=str)
    assert got == _components(rows, 3, 80)
    assert [c for c in stored if "shingles" in c[1]] == [("members", ["block", "fp", "shingles"])]
    assert ("places", ["block", "fp"]) in stored


def test_slots_are_counted_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTERS", 3)
    sets = [np.arange(i, i + 50, dtype=np.uint64) for i in range(40)]
    chained = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "shingles binary").repartition(9)
    plans = []
    seen = type(chained).toArrow
    monkeypatch.setattr(type(chained), "toArrow", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or seen(df))
    counts = S._slot_counts(chained)
    assert counts[:89].tolist() == [sum(s[0] <= v <= s[-1] for s in sets) for v in range(89)] and not counts[89:].any()
    assert "Coalesce 3" in plans[0]
