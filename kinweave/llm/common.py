"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts be 4 MB at most, unless the session was given another bound than Spark's own.

    A batch is held by the executor and by its Python worker at once, in and out.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, "4m")


def give_back() -> None:
    """Return what this Python worker has freed to the system.

    Workers are reused by later tasks and stages; what their allocators keep
    would be held beside the executor's own memory for as long as they live.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names of a helper column never clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def with_results(row: str, names: list[str], **results: Column) -> list[Column]:
    """The fields of struct column ``row`` and the results; a result replaces an input column of its name."""
    kept = [F.col(f"{row}.{quoted(n)}").alias(n) for n in names if n not in results]
    return [*kept, *[c.alias(n) for n, c in results.items()]]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
