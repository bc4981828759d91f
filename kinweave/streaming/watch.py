"""File-change events: filtering, debouncing and reindexing in micro-batches.

Events are rows ``(root, path, ts)``: the project, the path relative to it and
the arrival time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.functions.paths import watch_ignored
from kinweave.streaming.quiet import QuietPeriod

# Fixed value: how long it must be quiet before changes are flushed.
QUIET_SECONDS = 2
QUIET_PERIOD = f"{QUIET_SECONDS} seconds"
# Slots of one gap length that are chained in one task.
BLOCK = 4096
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def watched(events: DataFrame, exclude: list[str] | tuple[str, ...]) -> DataFrame:
    """Drop events of the root itself, of state and version-control folders and of excluded folders."""
    return events.filter((F.col("path") != "") & (F.col("path") != ".") & ~watch_ignored(F.col("path"), list(exclude)))


def _micros(at: Column, zoneless: bool) -> Column:
    """Microseconds on the time axis of ``at``, whatever the session's time zone."""
    if not zoneless:
        return F.unix_micros(at)
    minutes = F.unix_date(F.to_date(at)).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)
    return (minutes * 60_000_000 + F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")


def _chains(part: Window, opens: Column) -> Column:
    """Number of the chain that a row belongs to; ``opens`` is true for the first row of each."""
    return F.sum(opens.cast("long")).over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _slotted(events: DataFrame, gap_seconds: int, *columns: str) -> DataFrame:
    """``columns`` of the events with their time and slot: two events of one slot are less than a gap apart."""
    zoneless = dict(events.dtypes)["ts"] == "timestamp_ntz"
    us = _micros(F.col("ts"), zoneless)
    return events.filter("ts IS NOT NULL").select(*columns, "ts", us.alias("us"), F.floor(us / (gap_seconds * 1_000_000)).cast("long").alias("slot"))


def _islands(slots: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """``slots`` with the block and the chain of neighbouring slots inside it that each belongs to.

    A block is ``BLOCK`` slots of one key, so a key that is busy all the time is
    spread over as many tasks as it has blocks.
    """
    blocks = slots.withColumn("block", F.floor(F.col("slot") / BLOCK).cast("long"))
    in_block = Window.partitionBy(key, "block").orderBy("slot")
    apart = F.col("first_us") - F.lag("last_us").over(in_block) > gap_seconds * 1_000_000
    return blocks.withColumn("island", _chains(in_block, F.coalesce(apart, F.lit(False))))


def _stitched(islands: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Islands ``(key, block, island)`` with the ``start`` of their burst.

    Only the first and the last island of a block can go on in another one, so
    a key's window sees two rows per block, not its events.
    """
    parts = islands.groupBy(key, "block", "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sum("n_events").alias("n_events"),
    )
    in_block = Window.partitionBy(key, "block")
    parts = parts.withColumn("outer", (F.col("island") == 0) | (F.col("island") == F.max("island").over(in_block)))
    of_key = Window.partitionBy(key).orderBy("first_us")
    apart = F.col("first_us") - F.lag("last_us").over(of_key) > gap_seconds * 1_000_000
    outer = parts.filter("outer").withColumn("burst", _chains(of_key, F.coalesce(apart, F.lit(False))))
    outer = outer.withColumn("start", F.min("first").over(Window.partitionBy(key, "burst")))
    return outer.drop("burst").unionByName(parts.filter("NOT outer").withColumn("start", F.col("first")))


def _slot_table(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    return _slotted(events, gap_seconds, key).groupBy(key, "slot").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n_events")
    )


def flush_windows(events: DataFrame, key: str = "root", gap_seconds: int = QUIET_SECONDS) -> DataFrame:
    """``(key, start, end, n_events)`` per burst of a batch of events; gaps of a burst are at most ``gap_seconds`` long.

    Events are counted per slot of one gap before the first shuffle. Slots are
    chained within blocks, and blocks by their outer chains only: no task holds
    all events, or all slots, of one project. Events without a time are left out.
    """
    found = _stitched(_islands(_slot_table(events, key, gap_seconds), key, gap_seconds), key, gap_seconds)
    return found.groupBy(key, "start").agg(F.max("last").alias("last"), F.sum("n_events").alias("n_events")).select(
        key, "start", F.expr(f"last + interval {gap_seconds} seconds").alias("end"), "n_events"
    )


def flush_batches(events: DataFrame, key: str = "root", item: str = "path", gap_seconds: int = QUIET_SECONDS) -> DataFrame:
    """``(key, start, item, n_events)``: the distinct items of each burst, on a batch of events.

    All events of a slot are of one burst, so counted items meet the bursts on
    (key, slot): an equi-join that spreads a busy key over its slots.
    """
    islands = _islands(_slot_table(events, key, gap_seconds), key, gap_seconds)
    starts = _stitched(islands, key, gap_seconds).select(key, "block", "island", "start")
    slots = islands.select(key, "slot", "block", "island").join(starts, [key, "block", "island"]).select(key, "slot", "start")
    counted = _slotted(events, gap_seconds, key, item).groupBy(key, "slot", item).agg(F.count("*").alias("n_events"))
    return counted.join(slots, [key, "slot"]).groupBy(key, "start", item).agg(F.sum("n_events").alias("n_events"))


def stream_flush_windows(events: DataFrame, key: str = "root", gap: str = QUIET_PERIOD, late: str = "10 seconds") -> DataFrame:
    """:func:`flush_windows` on a stream; a burst is emitted once the watermark has passed it.

    Events later than ``late`` are dropped by the watermark. The manifest diff of
    the next analysis finds their files, as it compares the tree and not events.
    """
    return (
        events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    )


def debounced(events: DataFrame, quiet_seconds: int = QUIET_SECONDS, late: str | None = None) -> DataFrame:
    """``(root, start, end, n_events, paths)``: a stream's bursts with their distinct changed paths, sorted.

    Every event of a root puts its flush off to ``quiet_seconds`` after it;
    roots wait for themselves alone. Without ``late`` the quiet period is measured
    by the clock: a burst leaves although nothing follows it. With ``late`` (such
    as ``"10 seconds"``) it is measured by the events' own times: bursts are
    those of :func:`flush_windows`, also where events come out of order, and
    leave once the watermark has passed them.

    The state of a root is what waits to be flushed; it needs the state store
    that :data:`STATE_STORE` names.
    """
    spark = events.sparkSession
    if spark.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]} to keep timers and lists as state")
    rows = events.filter("ts IS NOT NULL").select("root", "path", F.col("ts").cast("timestamp").alias("ts"))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("root").transformWithStateInPandas(
        QuietPeriod(quiet_seconds, late is not None),
        "root string, start timestamp, end timestamp, n_events long, paths array<string>",
        "Append", "EventTime" if late is not None else "ProcessingTime",
    )


def reindex_when_quiet(
    events: DataFrame, on_flush: Callable[[DataFrame], None], checkpoint: str, exclude: list[str] | tuple[str, ...] = (),
    quiet_seconds: int = QUIET_SECONDS, late: str | None = None, trigger: str = "1 second",
) -> StreamingQuery:
    """Hand the bursts of :func:`debounced` to ``on_flush``, as ``(root, path)``; flushes never run at once.

    A flush that fails ends the query, and its burst comes again when the query
    is started with the same ``checkpoint``.
    """

    def flush(batch: DataFrame, _: int) -> None:
        changed = batch.select("root", F.explode("paths").alias("path")).distinct()
        if not changed.isEmpty():
            on_flush(changed)

    return (
        debounced(watched(events, exclude), quiet_seconds, late).writeStream.outputMode("append").foreachBatch(flush)
        .option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
    )


def reindex_on_change(
    events: DataFrame, on_flush: Callable[[DataFrame], None], checkpoint: str, exclude: list[str] | tuple[str, ...] = (),
    trigger: str = QUIET_PERIOD,
) -> StreamingQuery:
    """Hand the distinct changed ``(root, path)`` of each micro-batch to ``on_flush``.

    Micro-batches run one at a time and pick up whatever arrived meanwhile, so a
    flush is never concurrent with itself and no change is lost.
    """

    def flush(batch: DataFrame, _: int) -> None:
        changed = watched(batch, exclude).select("root", "path").distinct()
        if not changed.isEmpty():
            on_flush(changed)

    return (
        events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
        .trigger(processingTime=trigger).start()
    )
