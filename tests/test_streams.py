"""Debouncing: bursts of busy projects in batches, and streams that wait until a project is quiet."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinweave.streaming import watch
from kinweave.streaming.quiet import changes_of, merged, spans_of

START = datetime(2026, 3, 29, 0, 59, 50)  # next to a change of the clock in many zones


def _bursts(events, gap):
    """``{(root, start): (last, n, {path: n})}`` the plain way."""
    out, open_ = {}, {}
    for root, path, ts in sorted((e for e in events if e[2] is not None), key=lambda e: (e[0], e[2])):
        key = open_.get(root)
        if key is None or (ts - out[key][0]).total_seconds() > gap:
            key = open_[root] = (root, ts)
            out[key] = [ts, 0, {}]
        out[key][0] = ts
        out[key][1] += 1
        out[key][2][path] = out[key][2].get(path, 0) + 1
    return out


def _events(rng):
    events = []
    for root, n, span in (("busy", 900, 400), ("calm", 30, 4000), ("one", 1, 1), ("dense", 300, 20)):
        for _ in range(n):
            ts = START + timedelta(microseconds=rng.choice([250_000, 1_000_000, 1]) * rng.randrange(span * 4))
            events.append((root, f"p{rng.randrange(7)}", ts))
    events += [("edge", "a", START), ("edge", "b", START + timedelta(seconds=2)), ("edge", "c", START + timedelta(seconds=4, microseconds=1))]
    return events + [("calm", None, START), ("calm", "x", None)]


@pytest.mark.parametrize(("kind", "block"), [("timestamp", 1), ("timestamp_ntz", 3), ("timestamp", 4096)])
def test_bursts_do_not_depend_on_slots_and_blocks(spark, monkeypatch, kind, block):
    monkeypatch.setattr(watch, "BLOCK", block)
    events = _events(random.Random(block))
    rows = spark.createDataFrame([(r, p, t and t.isoformat(" ")) for r, p, t in events], "root string, path string, at string")
    df = rows.selectExpr("root", "path", f"CAST(at AS {kind}) AS ts", "1 AS slot", "2 AS us")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    want = _bursts(events, 2)
    got = {(r.root, r.s): (r.e, r.n_events) for r in watch.flush_windows(df).select("root", text("start").alias("s"), text("end").alias("e"), "n_events").collect()}
    stamp = lambda t: t.strftime("%Y-%m-%d %H:%M:%S.%f")
    assert got == {(r, stamp(s)): (stamp(last + timedelta(seconds=2)), n) for (r, s), (last, n, _) in want.items()}
    items = sorted((r.root, r.s, str(r.path), r.n_events) for r in watch.flush_batches(df).select("root", text("start").alias("s"), "path", "n_events").collect())
    assert items == sorted((r, stamp(s), str(p), n) for (r, s), (_, _, paths) in want.items() for p, n in paths.items())


def test_busy_root_is_spread_over_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(watch, "BLOCK", 8)
    df = spark.range(2000).selectExpr("'p' AS root", "CAST(id % 3 AS string) AS path", "timestamp_seconds(1000000 + id) AS ts")
    (burst,) = watch.flush_windows(df).collect()
    assert burst.n_events == 2000
    islands = watch._islands(watch._slot_table(df, "root", 2), "root", 2)
    assert islands.groupBy("block").count().agg(F.max("count")).first()[0] <= 8 and islands.select("block").distinct().count() == 125
    assert watch._stitched(islands, "root", 2).count() == 125  # one row per block is all that a window of the root sees


def test_spans_and_changes():
    assert spans_of([1, 2, 9, 30], 5) == [(1, 2, 2), (9, 9, 1), (30, 30, 1)]
    assert merged([(20, 21, 1), (1, 2, 2), (7, 9, 1)], 5) == [(1, 9, 3), (20, 21, 1)]
    assert merged([(1, 50, 3), (10, 12, 1), (54, 55, 1)], 5) == [(1, 55, 5)]
    assert changes_of(["a", "b", "a", "a"], [1, 2, 2, 31], [(1, 2, 3), (31, 31, 1)]) == [("a", 1), ("a", 31), ("b", 1)]


@pytest.fixture
def stateful(spark):
    before = spark.conf.get(watch.STATE_STORE[0], None)
    spark.conf.set(*watch.STATE_STORE)
    yield spark
    spark.conf.unset(watch.STATE_STORE[0]) if before is None else spark.conf.set(watch.STATE_STORE[0], before)


def _source(spark, folder, chunks):
    folder.mkdir(exist_ok=True)
    for i, chunk in enumerate(chunks):
        (folder / f"{i:03}.json").write_text("\n".join(json.dumps({"root": r, "path": p, "ts": (START + timedelta(seconds=s)).isoformat(" ")}) for r, p, s in chunk))
    return spark.readStream.schema("root string, path string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))


CHUNKS = [
    [("p", "a", 0), ("p", "b", 1), ("q", "z", 0)],
    [("p", "a", 2.5), ("p", ".git/x", 3), ("p", "c", 30), ("q", "z", 1), ("slow", "s0", 0)],
    [("p", "late", 29), ("p", "d", 31.5), ("slow", "s1", 30)],  # out of order: belongs to the second burst of p
    [("slow", "s2", 31), ("slow", "s3", 32)],
    [("end", "e", 100)],
    [("end", "f", 200)],
]
WANT = [
    ("p", 0, 4.5, 3, ["a", "b"]), ("q", 0, 3, 2, ["z"]), ("slow", 0, 2, 1, ["s0"]), ("p", 29, 33.5, 3, ["c", "d", "late"]),
    ("slow", 30, 34, 3, ["s1", "s2", "s3"]), ("end", 100, 102, 1, ["e"]),
]


def test_two_bursts_are_two_rows_with_their_paths(stateful, tmp_path):
    events = watch.watched(_source(stateful, tmp_path / "in", CHUNKS), [])
    query = watch.debounced(events, late="10 seconds").writeStream.outputMode("append").format("memory").queryName("quiet").start()
    query.processAllAvailable()
    query.stop()
    seconds = lambda t: (t - START).total_seconds()
    got = [(r.root, seconds(r.start), seconds(r.end), r.n_events, r.paths) for r in stateful.table("quiet").collect()]
    assert sorted(got) == sorted(WANT)


def test_a_burst_leaves_by_the_clock_and_survives_a_restart(stateful, tmp_path):
    flushed, fail = [], [True]

    def on_flush(changed):
        if fail.pop() if fail else False:
            raise OSError("reindexing failed")
        flushed.append(sorted((r.root, r.path) for r in changed.collect()))

    def start():
        events = _source(stateful, tmp_path / "in", CHUNKS[:1])
        return watch.reindex_when_quiet(events, on_flush, str(tmp_path / "cp"), quiet_seconds=1, trigger="200 milliseconds")

    query = start()
    with pytest.raises(Exception, match="reindexing failed"):
        query.awaitTermination(60)
    query = start()  # the same burst comes again
    deadline = time.time() + 60
    while not flushed and time.time() < deadline:
        time.sleep(0.2)
    time.sleep(2)
    query.stop()
    assert sorted(sum(flushed, [])) == [("p", "a"), ("p", "b"), ("q", "z")]


def test_state_store_must_keep_timers(spark, tmp_path):
    events = _source(spark, tmp_path / "in", CHUNKS[:1])
    if spark.conf.get(watch.STATE_STORE[0], "") != watch.STATE_STORE[1]:
        with pytest.raises(ValueError):
            watch.debounced(events)
