"""The state of a debounced stream: what waits per root, and the timer of its flush."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Span = tuple[int, int, int]  # first and last event in microseconds, number of events
Change = tuple[str, int]  # path and the time of one of its events


def spans_of(times: Iterable[int], gap: int) -> list[Span]:
    """Sorted times chained where they are at most ``gap`` apart."""
    out: list[Span] = []
    for t in times:
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def merged(spans: Iterable[Span], gap: int) -> list[Span]:
    """Spans chained where they overlap or are at most ``gap`` apart."""
    out: list[Span] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def changes_of(paths: Iterable[str], times: Iterable[int], spans: list[Span]) -> list[Change]:
    """Each path once per span, with the span's first time."""
    starts = [s[0] for s in spans]
    return sorted({(p, starts[bisect_right(starts, t) - 1]) for p, t in zip(paths, times)})


class QuietPeriod(StatefulProcessor):
    """Collects the changes of a root until it has been quiet.

    Input is reduced to spans and to distinct paths per span before it becomes
    state; lists only grow by appending, so an event costs its own size.
    """

    def __init__(self, seconds: int, by_event_time: bool) -> None:
        self.gap, self.by_event_time = seconds * 1_000_000, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first long, last long, n long")
        self.changes = handle.getListState("changes", "path string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = 0
        for frame in rows:
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            spans = spans_of(sorted(times), self.gap)
            named = frame["path"].notna()
            self.spans.appendList(spans)
            changes = changes_of(frame["path"][named], times[named], spans)
            if changes:
                self.changes.appendList(changes)
            latest = max(latest, spans[-1][1])
        if self.by_event_time:
            # events out of order may be earlier than others that wait: the earlier timer stays, and looks again
            if not any(True for _ in self.handle.listTimers()):
                self._wait_until(latest + self.gap)
        else:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        spans, changes = list(self.spans.get()), list(self.changes.get())
        if self.by_event_time:
            bursts = merged(spans, self.gap)
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            done = [b for b in bursts if b[1] + self.gap <= passed]
        else:  # whatever came until the root was quiet is one burst
            bursts = done = [(min(s[0] for s in spans), max(s[1] for s in spans), sum(s[2] for s in spans))] if spans else []
        starts = [b[0] for b in bursts]
        of: dict[int, set[str]] = {}
        for path, at in changes:
            of.setdefault(starts[bisect_right(starts, at) - 1], set()).add(path)
        waiting = [b for b in bursts if b not in done]
        self.spans.clear()
        self.changes.clear()
        if waiting:
            self.spans.put(waiting)
            kept = [(p, b[0]) for b in waiting for p in sorted(of.get(b[0], ()))]
            if kept:
                self.changes.put(kept)
            self._wait_until(waiting[0][1] + self.gap)
        if done:
            stamp = lambda us: pd.Timestamp(us, unit="us", tz="UTC")
            yield pd.DataFrame({
                "root": [key[0]] * len(done), "start": [stamp(b[0]) for b in done], "end": [stamp(b[1] + self.gap) for b in done],
                "n_events": [b[2] for b in done], "paths": [sorted(of.get(b[0], ())) for b in done],
            })

    def _wait_until(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass
