"""Column layout of the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "strings": T.ArrayType(T.StringType()),
}


def _table(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SYMBOLS = _table(
    "id string, fqn string, symbol_type string, file_path string, "
    "line_start bigint, line_end bigint, language string, unresolved_calls bigint"
)
FILES = _table("id string, path string, ext string, kind string")
RECORDS = _table(
    "id string, kind string, claim string, because string, given string, when_ string, "
    "then_ string, ref string, provenance string, provenance_kind string, "
    "ts timestamp_ntz, live boolean"
)
CONTAINS = _table("src string, src_label string, dst string")
CALLS = _table("src string, dst string, call_kind string")
EXTENDS = _table("src string, dst string")
ABOUT = _table("src string, dst string, dst_label string")
SUPERSEDES = _table("src string, dst string")

TABLES: dict[str, T.StructType] = {
    "symbols": SYMBOLS,
    "files": FILES,
    "records": RECORDS,
    "contains": CONTAINS,
    "calls": CALLS,
    "extends": EXTENDS,
    "about": ABOUT,
    "supersedes": SUPERSEDES,
}

# One row of a parsed record log, before it becomes a graph node.
WIRE_RECORD = _table(
    "line bigint, id string, kn string, sb strings, cl string, bc string, gv string, "
    "wn string, tn string, rf string, pv string, ts string, ss string"
)

# What the language extractors emit.
EXTRACTED_SYMBOL = _table(
    "id string, fqn string, symbol_type string, file_path string, "
    "line_start bigint, line_end bigint, language string, ordinal bigint"
)
CALL_REF = _table("caller_id string, target_name string, kind string, line bigint, file_path string")
INHERITANCE = _table("file_path string, child string, parent string")

MANIFEST = _table("path string, mtime bigint")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema``; a column an older table lacks becomes null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
