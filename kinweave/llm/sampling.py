"""Bounded samples of distinct rows, drawn by hash and cut exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.session import materialize

_RANGE = 1 << 62


def drawn_at(h: Column) -> Column:
    """A place in ``[0, 2^62)`` that the hash ``h`` gives its row."""
    return F.shiftrightunsigned(h, 2)


def smallest_hashes(keys: DataFrame, cls: str, n: dict[object, int], size: dict[object, int]) -> DataFrame:
    """The stored table ``(cls, h)`` of the ``size[c]`` different hashes that come first in each class ``c`` of ``(cls, h)``.

    ``n`` is about how many different hashes each class has. Only rows that can
    be among the first are moved: those under a threshold that leaves about
    twice as many as needed. Copies of a row have one hash and count once.
    """
    spark = keys.sparkSession
    limits = [(c, min(_RANGE, int((2 * size[c] + 100) / max(n[c], 1) * _RANGE)), size[c]) for c in n]
    known = spark.createDataFrame(limits, f"{cls} {dict(keys.dtypes)[cls]}, place long, size int")  # a row per class
    near = keys.join(F.broadcast(known), cls).filter(drawn_at(F.col("h")) < F.col("place"))
    order = Window.partitionBy(cls).orderBy(drawn_at(F.col("h")), "h")
    first = near.select(cls, "h", "size").distinct().withColumn("rank", F.row_number().over(order)).filter("rank <= size")
    return materialize(first.select(cls, "h"), "sample")
