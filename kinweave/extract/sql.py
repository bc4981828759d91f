"""Objects that SQL scripts create, one candidate per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.functions.binding import let
from kinweave.functions.text import sql_object_name

# What may stand between CREATE and each kind of object, in this
# order; ``<>`` is a word of the writer's. Of several objects on one line the kind
# that is listed first counts.
MODIFIERS = {
    "table": ("temporary",),
    "view": ("or replace", "algorithm=<>", "definer=<>", "sql security <>", "materialized"),
    "function": ("or replace", "definer=<>"),
    "procedure": ("or replace", "definer=<>"),
    "trigger": ("or replace", "definer=<>"),
}
# The longest statement head: five modifiers of nine words, six more where signs
# stand apart, the kind, a guard of three words and the name.
_HEAD_WORDS = 20
_CREATE = rf"(?i)\bCREATE(?=((?:\s+\S+){{1,{_HEAD_WORDS}}}+))"
_NAME = r"""^[\w`"\[\]]+(?:\.[\w`"\[\]]+)*"""


def _object_in(head: Column) -> Column:
    """``struct<rank, kind, name>`` of the words after CREATE, null where they create nothing that is known."""
    words = F.filter(F.split(F.regexp_replace(head, r"\s*=\s*", "="), r"\s+"), lambda w: w != "")

    def read(words: Column, place: Column, kind: Column) -> Column:
        before = F.array_join(F.transform(F.slice(words, 1, place - 1), lambda w: F.lower(w)), " ")
        fits = F.lit(False)
        for name, phrases in MODIFIERS.items():
            shape = "".join(f"({p.replace('<>', '[^ ]+')} )?" for p in phrases)
            fits = F.when(kind == name, F.concat(before, F.when(place > 1, " ").otherwise("")).rlike(f"^{shape}$")).otherwise(fits)
        guarded = (kind == "table") & (F.lower(F.array_join(F.slice(words, place + 1, 3), " ")) == "if not exists")
        named = lambda i: sql_object_name(F.regexp_extract(F.coalesce(F.get(words, i), F.lit("")), _NAME, 0))
        name = let(F.when(guarded, named(place + 3)).otherwise(""), lambda n: F.when(n != "", n).otherwise(named(place)))
        rank = F.array_position(F.array(*[F.lit(k) for k in MODIFIERS]), kind)
        return F.when(fits, let(name, lambda n: F.when(n != "", F.struct(rank.alias("rank"), kind.alias("kind"), n.alias("name")))))

    def at_kind(words: Column) -> Column:
        place = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*MODIFIERS)), F.lit(True)).cast("int")
        return let(place, lambda p: F.when(p > 0, let(F.lower(F.get(words, p - 1)), lambda kind: read(words, p, kind))))

    return let(words, at_kind)


def created_object(line: Column) -> Column:
    """``struct<kind, name>`` of the object that a line creates, null for none.

    Every CREATE of the line is looked at; the words after it are modifiers, the
    kind, then the name.
    """
    found = F.transform(F.regexp_extract_all(line, F.lit(_CREATE), F.lit(1)), _object_in)
    first = let(F.array_compact(found), lambda o: F.get(F.array_sort(F.transform(o, lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("place"), x["kind"].alias("kind"), x["name"].alias("name")))), F.lit(0)))
    return let(first, lambda o: F.when(o.isNotNull(), F.struct(o["kind"].alias("kind"), o["name"].alias("name"))))


def source_lines(files: DataFrame) -> DataFrame:
    """``(file_path, line, value, n_lines)`` from ``(file_path, text)``, 1-based."""
    parts = F.split("text", "\n")
    return files.select("file_path", F.size(parts).alias("n_lines"), F.posexplode(parts).alias("i", "value")).select(
        "file_path", (F.col("i") + 1).cast("bigint").alias("line"), "value", F.col("n_lines").cast("bigint")
    )


def sql_symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``(file_path, text)``; each ends where the next one starts.

    Only the hits are moved to their file's task.
    """
    value = F.col("value")
    # the exploded array keeps later filters behind the reading of the line
    hit = F.explode(F.array_compact(F.array(created_object(value))))
    hits = source_lines(files).filter(value.rlike(r"(?i)\bCREATE\s") & ~value.rlike(r"^\s*--")).select("file_path", "line", "n_lines", hit.alias("hit"))
    in_file = Window.partitionBy("file_path").orderBy("line")
    end = F.greatest("line", F.coalesce(F.lead("line").over(in_file) - 1, F.col("n_lines")))
    return hits.select(
        F.concat("file_path", F.lit("::"), "hit.name").alias("id"),
        F.col("hit.name").alias("fqn"),
        F.col("hit.kind").alias("symbol_type"),
        "file_path",
        F.col("line").alias("line_start"),
        end.alias("line_end"),
        F.lit("sql").alias("language"),
        F.col("line").alias("ordinal"),
    ).select([f.name for f in schema.EXTRACTED_SYMBOL.fields])
