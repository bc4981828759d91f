"""Source text as rows of tokens.

A scanner (:mod:`kinweave.extract.lexer`) reads each text once and gives every
token its line and its nesting depth. What declarations and calls need besides
comes from window functions over the file. A file's tokens are one array that is
placed by path before it is exploded: the explode and every window below keep
that placement, so the text and its tokens are shuffled once each.

What a token and its neighbours tell is worked out in the first window, and only
the tokens that shape declarations (:func:`outline`) or are facts by themselves
go on: later windows sort a part of the tokens, without their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.extract.lexer import Token, with_depths
from kinweave.session import materialize

_TOKEN = pa.struct(
    [("tok", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("depth", pa.int32()), ("parens", pa.int32()), ("newline", pa.bool_())]
)
# A task's share of the text: its token rows take some hundred times that space.
TASK_TEXT = 1 << 18
BATCH_TOKENS = 1 << 16
IDENT = r"\A[\p{L}_$#\\][\p{L}\p{N}_$\\]*\z"


def in_file() -> Window:
    return Window.partitionBy("file_path").orderBy("pos")


def before() -> Window:
    """All earlier tokens of the file."""
    return in_file().rowsBetween(Window.unboundedPreceding, -1)


def up_to() -> Window:
    """The earlier tokens of the file and this one."""
    return in_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def spread(files: DataFrame, share: int | None = None) -> tuple[DataFrame, int]:
    """Files of ``(file_path, text[, ...])`` dealt to tasks of about ``share`` characters (``TASK_TEXT`` if none is given),
    and the number of tasks.

    The number grows with the text, so what a task sorts stays in its memory. It
    is explicit so that adaptive execution does not merge partitions by the size
    of the text: its tokens take many times that space and time. The texts are
    written down first, as they are read twice.
    """
    files = materialize(files, "texts")
    size = files.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (share or TASK_TEXT)))
    return files.repartition(tasks, "file_path"), tasks


def tokenize(files: DataFrame, scan: Callable[..., list[Token]], flag: Column | None = None) -> DataFrame:
    """Tokens of ``(file_path, text[, ...])`` without comments; ``scan`` takes a text and, if given, its flag.

    Adds ``pos, tok, line, end_line, depth, parens, newline``: ``depth`` and
    ``parens`` count the braces and the parentheses or brackets open *before* the
    token, ``newline`` tells whether it starts a line.
    """
    flagged = flag is not None

    @F.arrow_udf("array<struct<tok:string,line:int,end_line:int,depth:int,parens:int,newline:boolean>>")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Arrays end after a file that brings them to ``BATCH_TOKENS``, however many files a batch has."""
        for texts, flags in batches:
            parts, offsets = [], [0]
            for text, known in zip(texts, flags):  # one file's tokens are Python objects at a time
                found = list(zip(*with_depths(scan(text.as_py() or "", *([known.as_py()] if flagged else [])))))
                parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found or [[]] * 6, _TOKEN)], fields=list(_TOKEN)))
                offsets.append(offsets[-1] + len(parts[-1]))
                if offsets[-1] >= BATCH_TOKENS:
                    yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))
                    parts, offsets = [], [0]
            if parts:
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))

    others = [c for c in files.columns if c not in ("file_path", "text")]
    dealt, tasks = spread(files)
    # Called deterministic, the scan would also run before the files are dealt: Spark would put a test for tokens there.
    tokens = read.asNondeterministic()(F.col("text"), F.lit(False) if flag is None else flag)
    # Spark does not know what a Python function keeps of the placement, so it is made again where windows can use it.
    scanned = dealt.select("file_path", *others, tokens.alias("tokens")).repartition(tasks, "file_path")
    return scanned.select("file_path", *others, F.posexplode("tokens").alias("pos", "t")).select(
        "file_path", *others, "pos", "t.tok", F.col("t.line").cast("bigint").alias("line"), F.col("t.end_line").cast("bigint").alias("end_line"),
        "t.depth", "t.parens", "t.newline",
    )


def neighbours(rows: DataFrame, back: range = range(0), ahead: range = range(0)) -> DataFrame:
    """Add ``p<i>`` and ``n<i>``: the tokens ``i`` before and after each token, '' past the ends.

    Every later window would copy these columns, so a scan drops them first.
    """
    return rows.withColumns(
        {f"p{i}": F.lag("tok", i, "").over(in_file()) for i in back}
        | {f"n{i}": F.lead("tok", i, "").over(in_file()) for i in ahead}
    )


def outline() -> Column:
    """Tokens that can begin or end a statement or a member, or stand in its head; needs ``n1``.

    A token moves the depth by one at most. So the last token of a statement is
    at depth 1 or less, that of a member's body is there too or is the brace that
    leads back to depth 1, unless the file ends first.
    """
    return (F.col("depth") <= 1) | ((F.col("depth") == 2) & (F.col("tok") == "}")) | (F.col("n1") == "")


def is_ident(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).rlike(IDENT)


def carry(condition: Column, value: Column) -> Column:
    """``value`` at the last token so far where ``condition`` held."""
    return F.last(F.when(condition, value), ignorenulls=True).over(up_to())


def since(start: Column, counted: Column) -> Column:
    """How many ``counted`` tokens lie between the last ``start`` and this token, both ends open at this one."""
    total = F.coalesce(F.sum(counted.cast("int")).over(before()), F.lit(0))
    return total - F.coalesce(carry(start, total), F.lit(0))
