"""What token scans report, and the tables built from it.

A scan makes one pass over a file and emits facts:

* ``error``: name = what is wrong with the file
* ``symbol``: name = fqn, a = symbol type
* ``parent``: name = child, a = parent
* ``prop``: name = property, a = declaring class, b = declared type
* ``call``: name = method or class, a = form, b = object or property; forms are
  ``new``, ``bare`` (a plain function), ``static`` (written object), ``own`` (this
  class), ``super`` and ``prop`` (a typed property of this class)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.functions.paths import parent_fqn
from kinweave.operators.resolve import enclosing_in_place
from kinweave.session import materialize


@dataclass(frozen=True)
class Extraction:
    symbols: DataFrame  # schema.EXTRACTED_SYMBOL
    refs: DataFrame  # schema.CALL_REF
    inheritance: DataFrame  # schema.INHERITANCE
    errors: DataFrame  # (file_path, error)

    def union(self, other: Extraction) -> Extraction:
        return Extraction(
            self.symbols.unionByName(other.symbols),
            self.refs.unionByName(other.refs),
            self.inheritance.unionByName(other.inheritance),
            self.errors.unionByName(other.errors),
        )


def fact(
    kind: str, when: Column, name: Column, a: Column, b: Column | None = None,
    line: Column | None = None, end_line: Column | None = None,
) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("fact"),
            name.alias("name"),
            a.alias("a"),
            (F.lit("") if b is None else b).alias("b"),
            (F.col("line") if line is None else line).cast("bigint").alias("line"),
            (F.col("end_line") if end_line is None else end_line).cast("bigint").alias("end_line"),
        ),
    )


def unbalanced(outside: Column | None = None) -> Column:
    """An error at the last token (``n1`` is empty) of a file whose braces do not close; ``outside`` is the depth
    around the file's top level."""
    after = F.col("depth") + F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)
    return fact("error", (F.col("n1") == "") & (after != (F.lit(0) if outside is None else outside)), F.lit("braces are not balanced"), F.lit(""))


def facts_here(*facts: Column) -> Column:
    """The facts that hold at a token."""
    return F.array_compact(F.array(*facts))


def collect_facts(rows: DataFrame, *facts: Column) -> DataFrame:
    """Rows of facts: those found ``here`` before, and ``facts``."""
    found = F.explode(F.concat("here", facts_here(*facts)))
    return rows.select("file_path", F.col("pos").cast("bigint").alias("pos"), found.alias("f")).select(
        "file_path", "pos", "f.*"
    )


def _linked(facts: DataFrame) -> DataFrame:
    """Facts with the symbol ``around`` each call and the declared type ``prop_type`` of a property in that symbol's class.

    Both are found in windows by file, where the scan has placed the facts: no call is shuffled for them.
    """
    is_call, is_prop = F.col("fact") == "call", F.col("fact") == "prop"
    facts = enclosing_in_place(facts, is_call, F.col("fact") == "symbol", F.col("name"))
    facts = facts.withColumns(
        {
            "cls": F.when(is_call, parent_fqn(F.col("around"))).when(is_prop, F.col("a")),
            "prop": F.when(is_call & (F.col("a") == "prop"), F.col("b")).when(is_prop, F.col("name")),
        }
    )
    declared = F.max_by(F.when(is_prop, F.col("b")), F.when(is_prop, F.col("pos"))).over(Window.partitionBy("file_path", "cls", "prop"))
    return facts.withColumn("prop_type", F.when(is_call & F.col("cls").isNotNull() & F.col("prop").isNotNull(), declared)).drop("prop")


def assemble(facts: DataFrame, language: str) -> Extraction:
    """The tables of ``facts``, which are linked within their files here."""
    return tables(_linked(facts), language)


def tables(linked: DataFrame, language: str) -> Extraction:
    """Linked facts are written once, so the text is tokenized once for all three outputs."""
    facts = materialize(linked, f"facts-{language}")
    symbols = facts.filter("fact = 'symbol'").select(
        F.concat("file_path", F.lit("::"), "name").alias("id"),
        F.col("name").alias("fqn"),
        F.col("a").alias("symbol_type"),
        "file_path",
        F.col("line").alias("line_start"),
        F.col("end_line").alias("line_end"),
        F.lit(language).alias("language"),
        F.col("pos").alias("ordinal"),
    )
    inheritance = facts.filter("fact = 'parent'").select(
        "file_path", F.col("name").alias("child"), F.col("a").alias("parent")
    )
    calls = facts.filter("fact = 'call'").withColumn("symbol_id", F.concat("file_path", F.lit("::"), "around"))
    dotted = F.when(F.col("a") == "static", F.col("b")).when(F.col("a") == "own", F.col("cls")).when(
        F.col("a") == "prop", F.col("prop_type")
    )
    target = (
        F.when(F.col("a").isin("new", "bare"), F.col("name"))
        .when(F.col("a") == "super", F.concat(F.lit("parent::"), "name"))
        .otherwise(F.concat(dotted, F.lit("."), "name"))
    )
    refs = calls.select(
        F.col("symbol_id").alias("caller_id"),
        target.alias("target_name"),
        F.when(F.col("a") == "new", "instantiation").otherwise("static_call").alias("kind"),
        "line",
        "file_path",
    ).filter("target_name IS NOT NULL")
    errors = facts.filter("fact = 'error'").select("file_path", F.col("name").alias("error")).distinct()
    return Extraction(schema.conform(symbols, schema.EXTRACTED_SYMBOL), refs, inheritance, errors)
