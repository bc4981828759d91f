import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinweave.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, rank int, score string"


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(rows, items, k):
    docs = [(d, Counter(t)) for d, t in ((d, _terms(t)) for d, t in rows) if t]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c in docs:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in _terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def _rows(rng, n=400):
    words = [f"w{i}" for i in range(60)] + ["É", "ñ", "A1", "b_c", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i * 7 % 1000, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for i in range(n)]
    return rows + [(5000, None), (5001, ""), (5002, "-- \x00"), (None, "w1 w2 w50"), (5003, "w1 " * 3000)] + [(6000 + i % 5, "w40 w41 w42") for i in range(60)]


@pytest.mark.parametrize("segment,pilot", [(8192, 16), (37, 2)])
def test_ranking_against_brute_force(spark, docs, monkeypatch, segment, pilot):
    monkeypatch.setattr(R, "PILOT", pilot)
    monkeypatch.setattr(R, "QUERY_BYTES", 2000 if pilot == 2 else 32 << 20)  # several rounds
    rng = random.Random(12)
    rows = _rows(rng)
    df = docs(rows, "doc_id long, text string, row int, term string, score string, rank int, n int").repartition(3)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(70)] + ["é", "a1", "THE"], k=rng.choice([1, 2, 10, 60])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w41 w41 W41"), (103, "w2 nowhere"), (104, "w40 w41 w42"), (None, "w3 w59")]
    asked = spark.createDataFrame([(*i, None, None) for i in items], ITEM)
    if segment == 37:
        df = df.repartition(13)  # small segments: few documents a task
    index = R.build_index(df)
    for k in (20, 3):
        got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in R.search(index, asked, k).collect()), key=repr)
        assert got == _expected(rows, items, k)


def test_index_holds_every_term_of_every_text(spark, docs):
    rows = _rows(random.Random(3), 120)
    index = R.build_index(docs(rows).repartition(4)).collect()
    ids = {r.segment: r.ids for r in index if r.term is None}
    assert all(s == sorted(s, key=lambda d: (d is None, d)) for s in ids.values())
    got = Counter((ids[r.segment][d], bytes(r.term).decode(), c) for r in index if r.term is not None for d, c in zip(r.docs, r.counts))
    want = Counter((d, t, c) for d, text in rows for t, c in Counter(_terms(text)).items())
    assert got == want
    lengths = Counter((d, n) for r in index if r.term is None for d, n in zip(r.ids, r.counts))
    assert lengths == Counter((d, len(_terms(t))) for d, t in rows if _terms(t))


def test_segments_are_cut_by_documents_and_by_postings(monkeypatch):
    segment = R.Segment()
    monkeypatch.setattr(R, "SEGMENT_DOCS", 2)
    segment.add(1, b"a")
    segment.add(2, b"")
    assert not segment.full()
    segment.add(3, b"b")
    assert segment.full() and segment.ids == [1, 3]
    monkeypatch.setattr(R, "_PIECE", 3)  # a long text goes piece by piece, and no word is cut
    segment = R.Segment()
    segment.add(1, b"alpha beta, alpha gamma")
    assert segment.sizes == [4] and set(segment.vocabulary) == {b"alpha", b"beta", b"gamma"} and sorted(segment.counts[0].tolist()) == [1, 1, 2]


def test_range_maxima_and_best_first_prune():
    rng = np.random.default_rng(2)
    n_docs, lists = 3000, []
    for share in (0.9, 0.5, 0.1, 0.02, 0.001):
        lists.append(np.flatnonzero(rng.random(n_docs) < share))
    edges = np.append(0, np.cumsum([len(x) for x in lists]))
    impacts = rng.integers(0, 1000, edges[-1])
    table = R.Lists(n_docs, np.concatenate(lists).astype(np.int32), impacts, edges)
    for _ in range(300):
        t = rng.integers(0, len(lists))
        a, b = sorted(rng.integers(edges[t], edges[t + 1] + 1, 2))
        if a < b:
            assert impacts[table.top(np.array([a]), np.array([b]))[0]] == impacts[a:b].max()
    looked = []
    top = table.top
    table.top = lambda first, last: (looked.append(len(first)), top(first, last))[1]
    total = defaultdict(int)
    repeats = np.array([1, 2, 1, 5, 40])
    for t, r in enumerate(repeats):
        for p in range(edges[t], edges[t + 1]):
            total[int(table.docs[p])] += int(r * impacts[p])
    want = sorted(((-s, d) for d, s in total.items() if s > 0))[:5]
    scores, places = R.best_documents(table, n_docs, edges[:-1], edges[1:], repeats, 5)
    assert list(zip((-scores).tolist(), places.tolist())) == want
    assert sum(looked) < edges[-1] / 4  # far fewer look-ups than postings
    floor = -want[2][0]
    scores, places = R.best_documents(table, n_docs, edges[:-1], edges[1:], repeats, 5, floor)
    assert list(zip((-scores).tolist(), places.tolist())) == [w for w in want if -w[0] >= floor]


def test_equal_scores_take_the_smallest_places_without_visiting_all():
    n_docs = 5000
    table = R.Lists(n_docs, np.arange(n_docs, dtype=np.int32), np.full(n_docs, 7), np.array([0, n_docs]))
    scores, places = R.best_documents(table, n_docs, np.array([0]), np.array([n_docs]), np.array([1]), 4)
    assert scores.tolist() == [7] * 4 and places.tolist() == [0, 1, 2, 3]


def test_empty_tables(spark, docs):
    asked = spark.createDataFrame([(1, "a", None, None)], ITEM)
    assert R.search(R.build_index(docs([])), asked).count() == 0
    index = R.build_index(docs([(1, "a b"), (2, "a")]))
    assert R.search(index, asked.limit(0)).count() == 0
    assert [(r.item_id, r["rank"], r.doc_id) for r in R.search(index, spark.createDataFrame([(1, "b", None, None)], ITEM)).collect()] == [(1, 1, 1)]
