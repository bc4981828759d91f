"""Fill-in-the-middle documents by counted quantifiers of regular expressions.

``regexp_count`` gives a text's number of units ``n``. Two seeded hashes of the
row's id choose ``0 <= a <= b <= n``, and a pattern of the row's own,

    \\A(unit{a}+)(unit{b-a}+)(.*+)\\z

captures prefix, middle and suffix in one match, whose replacement writes the
three in the order of the form. The quantifiers are possessive, so a match
never backtracks and takes no stack, whatever the length of the text. Units are
counted in blocks first (``unit{1024}+``), then the rest one by one, so counting
holds one copy of a text and not an object per unit. All of it are column
functions: rows stay where they are, there is no shuffle and no Python worker.

Defined results: a null text is an empty one; an empty text, one that holds a
marker, and the share of rows that ``rate`` leaves out stay plain, with null
lengths; a null id is hashed as an empty string; repeated rows give equal
results; a unit is what ``unit`` matches from left to right without a gap, and
what it does not match any more belongs to the suffix; an empty table gives no
rows; a column with the name of a result is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import quoted, whole_row, with_results

MARKERS = ("<P>", "<S>", "<M>")
BLOCK = 1024


def check_markers(markers: tuple[str, str, str]) -> None:
    """Raise where text next to a marker could be read as another one."""
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("markers must be three different strings")
    for a in markers:
        for b in markers:
            shared = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b)) if k < len(b))
            if shared or (a != b and a in b):
                raise ValueError(f"the markers {a!r} and {b!r} overlap")


def count_units(text: Column, unit: str = ".") -> Column:
    """How many units follow each other from the start of ``text``."""
    blocks = F.regexp_count(text, F.lit(rf"(?s)\G(?:{unit}){{{BLOCK}}}+"))
    rest = F.regexp_replace(text, rf"(?s)\A(?:(?:{unit}){{{BLOCK}}}+)*+", "")
    return (blocks * BLOCK + F.regexp_count(rest, F.lit(rf"(?s)\G(?:{unit})"))).cast("long")


def cut_pattern(a: Column, b: Column, unit: str = ".") -> Column:
    """The pattern that captures the first ``a`` units, those up to ``b``, and the rest."""
    return F.concat(
        F.lit(rf"(?s)\A((?:{unit}){{"), a.cast("string"), F.lit(rf"}}+)((?:{unit}){{"), (b - a).cast("string"), F.lit(r"}+)(.*+)\z")
    )


def _literal(marker: str) -> str:
    """``marker`` as it is written in a replacement."""
    return re.sub(r"([\\$])", r"\\\1", marker)


def fill_in_middle(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 1, unit: str = ".",
    rate: int = 90, spm_share: int = 20, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """The columns of ``docs`` with ``n``, ``form`` (plain, psm or spm), ``prefix_units``, ``middle_units`` and ``output``.

    ``rate`` per cent of the texts are transformed, ``spm_share`` per cent of
    them suffix first. ``unit`` is a Java pattern of one unit (``.`` is a code
    point) that matches no empty string and has no capturing group.
    """
    check_markers(markers)
    if re.match(unit, ""):
        raise ValueError("the pattern of a unit must not match an empty string")
    prefix, suffix, middle = map(_literal, markers)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")))
    rows = docs.select(
        whole_row(docs).alias("row"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("body"), F.sha2(key.cast("binary"), 256).alias("hex")
    )
    h1, h2, h3, h4 = (F.conv(F.substring("hex", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    marked = F.contains("body", F.lit(markers[0])) | F.contains("body", F.lit(markers[1])) | F.contains("body", F.lit(markers[2]))
    form = F.when((F.col("body") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    # each step is a projection of its own, so that the count and the cuts are computed once
    counted = rows.select("row", "body", "hex", form.alias("form"), count_units(F.col("body"), unit).alias("n"))
    cut = counted.select(
        "row", "body", "form", "n", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("a"), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("b"),
    )
    order = F.when(F.col("form") == "psm", f"{prefix}$1{suffix}$3{middle}$2").otherwise(f"{suffix}$3{prefix}$1{middle}$2")
    moved = F.col("form") != "plain"
    output = F.when(moved, F.regexp_replace("body", cut_pattern(F.col("a"), F.col("b"), unit), order)).otherwise(F.col("body"))
    return cut.select(
        *with_results(
            "row", docs.columns, n=F.col("n"), form=F.col("form"), prefix_units=F.when(moved, F.col("a")),
            middle_units=F.when(moved, F.col("b") - F.col("a")), output=output,
        )
    )


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that gave ``output``, from it and its form alone."""
    check_markers(markers)
    prefix, suffix, middle = (rf"\Q{m}\E" for m in markers)
    psm = F.regexp_replace(output, rf"(?s)\A{prefix}(.*?){suffix}(.*?){middle}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{suffix}(.*?){prefix}(.*?){middle}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
