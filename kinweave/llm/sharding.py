"""Two-pass external shuffle of records into shards, built from DataFrame operations only.

Pass one scatters records into memory-sized buckets by a seeded hash of the
record's place and id. Pass two sorts a bucket by that hash, permutes it with
Fisher-Yates (Spark's ``shuffle`` of an array) and writes it. The buckets in
order are then one random permutation of the input, which is cut into shards
whose row counts differ by one at most.

Defined results: null texts count as empty; null and repeated ids are records
like any other (the place of a record is part of its hash, so a third of all
rows with one id still spreads over all buckets); an empty input gives no rows;
an input column with the name of a result is replaced by it. The order is the
same whenever the same files are read with the same split size, shard count
and seed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import quoted, whole_row, with_results
from kinweave.session import materialize

BLOCK = 1024


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _offsets(written: DataFrame) -> DataFrame:
    """``(bucket, offset)``: rows before each bucket. Blocks of buckets are summed first, so that
    no task sees more than one row per block."""
    counts = written.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"bucket div {BLOCK}"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    starts = blocks.select(
        "block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("start")
    )
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("within", F.coalesce(F.sum("n").over(within), zero))
        .join(starts, "block").select("bucket", (F.col("start") + F.col("within")).alias("offset"))
    )


def external_shuffle(
    docs: DataFrame, shards: int = 8, seed: int = 20240607, bucket_bytes: int = 16 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The records in random order with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``bucket_bytes`` is the mean size of a bucket and has to fit a task's
    memory a few times; the number of buckets follows the input.
    """
    text = F.col(quoted(text_col))
    total, rows = docs.agg(F.sum(record_size(text)), F.count("*")).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.col("place"), F.col("id"))
    scattered = (
        docs.select(F.monotonically_increasing_id().alias("place"), F.col(quoted(id_col)).alias("id"), whole_row(docs).alias("row"))
        .select("place", place.alias("h"), "row")
        .withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
        .repartitionById(buckets, F.col("bucket"))
    )
    dealt = (
        scattered.sortWithinPartitions("bucket", "h", "place")
        .groupBy("bucket").agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "row"))
    )
    written = materialize(dealt, "shuffled")
    at = F.col("offset") + F.col("pos")
    n, k = max(rows, 1), shards
    shard = F.expr(f"((offset + pos) * {k}L) div {n}L")
    first = F.expr(f"(shard_no * {n}L + {k - 1}L) div {k}L")
    placed = (
        # Stored first: Spark then knows that it is small and does not move the records a second time.
        written.join(materialize(_offsets(written), "offsets"), "bucket").withColumn("shard_no", shard)
        .withColumn("slot_no", at - first)
    )
    return placed.select(*with_results("row", docs.columns, shard=F.col("shard_no").cast("int"), slot=F.col("slot_no")))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; rows keep their slot, which is their order."""
    shuffled.write.partitionBy("shard").parquet(path)
