"""The append-only record log: newline-delimited JSON with short keys."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.functions.records import RECORD_KINDS, canonical_json, parse_ts, valid_provenance
from kinweave.functions.text import is_blank, strip
from kinweave.session import materialize, placed

# What the name of a folder of merged appends ends with; it sorts behind the last of them.
MERGED = "-merged"
_TEXT_KEYS = ("id", "kn", "cl", "bc", "gv", "wn", "tn", "rf", "pv", "ts", "ss")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` with 1-based line numbers, read in parallel splits.

    A split knows its position in its file, and rows keep their order inside a
    split, so a line number is the number of lines in earlier splits plus the
    position within the split. Splits are summed up per file, and one row per file
    goes through the window over all of them. Appends are read in their order
    (:func:`append_log` numbers their folders); what :func:`compact_log` has merged
    is read in place of the appends it holds.
    """
    return _numbered(spark, _segments(spark, path))


def _numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """:func:`read_log_lines` of the given files and folders."""
    rows = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    blocks = rows.groupBy("file", "block").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    offsets = blocks.withColumn("within", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(files, "file").select(
        "file", "block", "first_seq", (F.col("within") + F.col("start")).alias("offset")
    )
    return rows.join(offsets, ["file", "block"]).select(
        (F.col("seq") - F.col("first_seq") + F.col("offset") + 1).alias("line"), "value"
    )


def _decode(lines: DataFrame) -> DataFrame:
    """Non-blank lines with the type and the value of each key.

    Types are kept next to values because a plain typed read turns a value of
    the wrong type into null, which would then look like an absent key. A type is
    null when the key is absent and ``VOID`` for JSON null.
    """
    keys = F.col("keys")
    decoded = (
        lines.select("line", strip(F.col("value")).alias("raw"))
        .filter("raw <> ''")
        .withColumn("doc", F.try_parse_json("raw"))
        .withColumn("keys", F.try_variant_get("doc", "$", "map<string,variant>"))
    )
    return decoded.select(
        "line", F.col("doc").isNotNull().alias("is_json"), keys.isNotNull().alias("is_object"),
        *[F.schema_of_variant(keys[k]).alias(f"{k}_type") for k in (*_TEXT_KEYS, "sb")],
        *[F.try_variant_get(keys[k], "$", "string").alias(k) for k in _TEXT_KEYS],
        F.try_variant_get(keys["sb"], "$", "array<string>").alias("sb"),
    )


def _problems() -> Column:
    """Array of messages, one per violated rule; empty for a valid record."""

    def text(key: str) -> Column:
        return F.coalesce(F.col(f"{key}_type") == "STRING", F.lit(False))

    def present(key: str) -> Column:
        return F.col(f"{key}_type").isNotNull()

    def filled(key: str) -> Column:
        return text(key) & ~is_blank(F.col(key))

    def rule(broken: Column, message: Column | str) -> Column:
        return F.when(broken, F.lit(message) if isinstance(message, str) else message)

    def misplaced(key: str, home: str) -> Column:
        shown = F.coalesce(F.col("kn"), F.lit("undefined"))
        return rule(
            present(key) & ~kind_is(home),
            F.concat(F.lit(f"'{key}' belongs to kind '{home}' only, not to '"), shown, F.lit("'")),
        )

    def kind_is(kind: str) -> Column:
        return text("kn") & F.coalesce(F.col("kn") == kind, F.lit(False))

    subjects_ok = (F.col("sb_type") == "ARRAY<STRING>") & ~F.exists("sb", lambda s: s == "")
    subjects_ok |= (F.size("sb") == 0) & F.startswith(F.col("sb_type"), F.lit("ARRAY"))
    rules = [
        rule(~(text("id") & F.col("id").rlike(r"\A[0-9a-z]+\z")), "'id' must be lowercase letters and digits"),
        rule(~(text("kn") & F.col("kn").isin(*RECORD_KINDS)), "'kn' must be one of: " + ", ".join(RECORD_KINDS)),
        rule(~filled("cl"), "'cl' must be a non-empty claim"),
        rule(~(text("pv") & valid_provenance(F.col("pv"))), "'pv' must be u, a, i or g:, t:, n:, d: with a pointer"),
        rule(~(text("ts") & parse_ts(F.col("ts")).isNotNull()), "'ts' must be a UTC instant as YYYYMMDDHHMMSS"),
        rule(present("sb") & ~F.coalesce(subjects_ok, F.lit(False)), "'sb' must be an array of non-empty strings"),
        rule(present("ss") & ~(text("ss") & (F.col("ss") != "")), "'ss' must be a record id"),
        rule(kind_is("behavior") & ~filled("wn"), "'wn' is required on kind 'behavior'"),
        rule(kind_is("behavior") & ~filled("tn"), "'tn' is required on kind 'behavior'"),
        *[misplaced(key, "behavior") for key in ("gv", "wn", "tn")],
        rule(kind_is("source") & ~filled("rf"), "'rf' is required on kind 'source'"),
        misplaced("rf", "source"),
    ]
    return (
        F.when(~F.col("is_json"), F.array(F.lit("malformed JSON")))
        .when(~F.col("is_object"), F.array(F.lit("not a JSON object")))
        .otherwise(F.array_compact(F.array(*rules)))
    )


def parse_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(line, value)`` into valid records and errors.

    Records: :data:`schema.WIRE_RECORD`. Errors: ``(line, id, message)``. The
    first valid line of an id wins; an identical repeat is dropped silently and a
    different one is an error, because one of the two records would be lost. The
    winner is found with an aggregate rather than a window, so an id that was
    appended endlessly is reduced before the shuffle.

    The checked lines are written once: records and errors both read them, and
    filters on the outcome do not drag the JSON parsing along with them.
    """
    fields = [f.name for f in schema.WIRE_RECORD.fields]
    checked = materialize(
        _decode(lines).select(*fields, "id_type", _problems().alias("problems")), "checked-log"
    )
    invalid = checked.filter(F.size("problems") > 0).select(
        "line",
        F.when(F.col("id_type") == "STRING", F.col("id")).alias("id"),
        F.explode("problems").alias("message"),
    )
    valid = checked.filter(F.size("problems") == 0).select(*fields)
    first = (
        valid.withColumn("canonical", canonical_json())
        .groupBy("id")
        .agg(
            F.min(F.struct("line", "canonical", *[f for f in fields if f not in ("id", "line")])).alias("r"),
            F.count("*").alias("copies"),
        )
    )
    records = first.select(*[F.col(f) if f == "id" else F.col(f"r.{f}").alias(f) for f in fields])
    reused = (
        valid.select("line", "id", canonical_json().alias("canonical"))
        .join(
            placed(first.filter("copies > 1").select(
                "id", F.col("r.line").alias("first_line"), F.col("r.canonical").alias("first_canonical")
            )),
            "id",
        )
        .filter("line > first_line AND canonical <> first_canonical")
        .select(
            "line", "id",
            F.concat(F.lit("'id' "), "id", F.lit(" is reused with different content")).alias("message"),
        )
    )
    return records, invalid.unionByName(reused)


def _folders(spark: SparkSession, path: str) -> tuple[object, list[tuple[str, int]]]:
    """The store of a log, and names and times of change of its numbered folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(folder) if store.exists(folder) else []
    return store, sorted((x.getPath().getName(), x.getModificationTime()) for x in found if x.getPath().getName().startswith("seq="))


def _number(name: str) -> int:
    return int(name.removeprefix("seq=").removesuffix(MERGED))


def _segments(spark: SparkSession, path: str, up_to: int | None = None) -> list[str]:
    """What to read of a log (``up_to`` an append): the last merged folder and the appends after it; the path itself
    where nothing was merged."""
    names = [n for n, _ in _folders(spark, path)[1] if up_to is None or _number(n) <= up_to]
    merged = [n for n in names if n.endswith(MERGED)]
    if not merged:
        return [path] if up_to is None else [f"{path}/{n}" for n in names]
    last = max(merged, key=_number)
    return [f"{path}/{last}", *[f"{path}/{n}" for n in names if not n.endswith(MERGED) and _number(n) > _number(last)]]


def append_log(records: DataFrame, path: str) -> None:
    """Append canonical lines; whole lines only, nothing for an empty input.

    Every append is a folder of its own with the next number, whose name sorts
    after all that is there. Of two writers that draw one number the second fails
    before it writes anything.
    """
    lines = materialize(records.select("line", canonical_json().alias("value")) if "line" in records.columns else records.select(
        F.monotonically_increasing_id().alias("line"), canonical_json().alias("value")
    ), "append")
    if lines.isEmpty():
        return
    taken = [_number(n) for n, _ in _folders(records.sparkSession, path)[1]]
    lines.repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("error").text(
        f"{path}/seq={max(taken, default=0) + 1:012d}"
    )


def compact_log(spark: SparkSession, path: str) -> int:
    """Merge all appends so far into one segment, lines in their order; returns how many were merged.

    The segment is written aside and moved into place at once, next to what it
    holds: a reader that has begun keeps its files, a later one reads the segment
    instead, and appends that come meanwhile stay behind it. Line numbers and the
    first record of an id remain what they were.
    """
    store, found = _folders(spark, path)
    parts = [n for n, _ in found if not n.endswith(MERGED)]
    done = max((_number(n) for n, _ in found if n.endswith(MERGED)), default=0)
    fresh = [n for n in parts if _number(n) > done]
    if not fresh:
        return 0
    last = max(map(_number, fresh))
    aside = f"{path}/_merge-{uuid.uuid4().hex}"
    _numbered(spark, _segments(spark, path, last)).repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(aside)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/seq={last:012d}{MERGED}")
    if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target):
        raise FileExistsError(str(target))
    return len(fresh)


def drop_merged(spark: SparkSession, path: str, older_than: float = 86_400) -> list[str]:
    """Delete the folders that a merged segment holds, once it is ``older_than`` seconds old and nobody reads them any more."""
    store, found = _folders(spark, path)
    merged = [(n, t) for n, t in found if n.endswith(MERGED) and t <= (time.time() - older_than) * 1000]
    if not merged:
        return []
    last = max((n for n, _ in merged), key=_number)
    held = [n for n, _ in found if n != last and _number(n) <= _number(last)]
    for name in held:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return held


def live_records(records: DataFrame) -> DataFrame:
    """Records no other record supersedes. Cycles and self-references kill their members."""
    superseded = records.filter(F.col("ss").isNotNull() & (F.col("ss") != "")).select(F.col("ss").alias("id"))
    return records.join(superseded.distinct(), "id", "left_anti")
