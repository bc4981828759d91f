"""Chat formatting with typed content parts, built from DataFrame operations only.

A turn is a list of parts ``struct<kind, text, ref, tokens>``. The visitor maps
each part to text: adjacent text parts are joined and escaped as one, any other
part becomes the ordered placeholder ``<|kind:k|>`` (k counts the attachments of the conversation from
0), and its reference and token count are recorded. A formatted conversation is
the concatenation of ``<|turn|>role\\ncontent<|end|>``; the text parts of
assistant turns are under the loss mask.

Control strings inside texts (``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) get a backslash after their bracket; a bracket that already has
backslashes there gets one more, so unescaping is exact. Roles are
percent-encoded.

Defined results: null roles, texts, kinds and references count as empty, null
parts as no parts, null token counts as 0; equal turn numbers are ordered by
role and content, null turn numbers come first; repeated rows are turns of
their own; null conversation ids form one conversation; an empty input gives no
rows; other columns are ignored. A conversation is one row of the result, so a
single task holds one conversation's turns: turns are escaped and measured
before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
_CONTROL = r"(?=\||/?s>|/?INST\])"
PART = "struct<kind:string,text:string,ref:string,tokens:long>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=[<\[])(\\*){_CONTROL}", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=[<\[])\\(\\*){_CONTROL}", "$1")


def text_part(text: Column) -> Column:
    """A turn's parts when it is plain text."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("tokens")
        )
    ).cast(f"array<{PART}>")


def _visit(parts: Column, first: Column) -> tuple[Column, Column]:
    """The text of a turn whose attachments are numbered from ``first``, and those attachments."""
    is_text = lambda p: F.coalesce(p["kind"], F.lit("")) == "text"
    attached = F.filter(parts, lambda p: ~is_text(p))
    numbered = F.transform(
        attached,
        lambda p, i: F.struct(
            (first + i).cast("int").alias("index"), F.coalesce(p["kind"], F.lit("")).alias("kind"),
            F.coalesce(p["ref"], F.lit("")).alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"),
        ),
    )
    text_of = lambda p: F.coalesce(p["text"], F.lit(""))

    def run(i: Column) -> Column:
        """The text of the adjacent text parts from place ``i`` on: a control string may lie across their borders."""
        rest = F.slice(parts, i + 1, F.size(parts))
        stop = F.array_position(F.transform(rest, is_text), F.lit(False)).cast("int")
        kept = F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
        return F.when(F.size(parts) == 1, text_of(F.get(parts, F.lit(0)))).otherwise(F.array_join(F.transform(kept, text_of), ""))

    begins = lambda i: (i == 0) | ~F.coalesce(is_text(F.get(parts, i - 1)), F.lit(False))
    piece = F.transform(
        parts,
        lambda p, i: F.when(is_text(p) & begins(i), escape(run(i))).when(is_text(p), "").otherwise(
            F.concat(
                F.lit("<|"), F.url_encode(F.coalesce(p["kind"], F.lit(""))), F.lit(":"),
                (first + F.size(F.filter(F.slice(parts, 1, i), lambda q: ~is_text(q)))).cast("string"), F.lit("|>"),
            )
        ),
    )
    return F.array_join(piece, ""), numbered


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """``(conv_id, formatted, loss_spans, attachments, attachment_tokens)`` per conversation.

    ``loss_spans`` holds ``(start, end)`` in code points and ``(byte_start,
    byte_end)`` in UTF-8 bytes of ``formatted``, one span per learned turn.
    """
    order = ["turn", "role", "key"]
    base = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"),
    ).withColumn("key", F.to_json("parts"))
    by = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    n_attached = F.size(F.filter("parts", lambda p: F.coalesce(p["kind"], F.lit("")) != "text"))
    base = base.withColumn("first", F.coalesce(F.sum(n_attached).over(by), zero))
    content, attached = _visit(F.col("parts"), F.col("first"))
    head = F.concat(F.lit(TURN), F.url_encode("role"), F.lit("\n"))
    laid = (
        base.withColumn("content", content).withColumn("attached", attached).withColumn("head", head)
        .withColumn("whole", F.concat("head", "content", F.lit(END)))
        .withColumn("at", F.coalesce(F.sum(F.length("whole")).over(by), zero))
        .withColumn("byte_at", F.coalesce(F.sum(F.octet_length("whole")).over(by), zero))
        .withColumn("ordinal", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    )
    start, byte_start = F.col("at") + F.length("head"), F.col("byte_at") + F.octet_length("head")
    span = F.when(
        F.col("role").isin(*learned),
        F.struct(
            start.alias("start"), (start + F.length("content")).alias("end"),
            byte_start.alias("byte_start"), (byte_start + F.octet_length("content")).alias("byte_end"),
        ),
    )
    collected = laid.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "whole", span.alias("span"), "attached"))).alias("t")
    )
    return collected.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["whole"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t: t["attached"])).alias("attachments"),
    ).withColumn(
        "attachment_tokens", F.aggregate("attachments", zero, lambda a, x: a + x["tokens"])
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, unescaped."""
    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substring(
                    p, F.instr(p, "\n") + 1,
                    F.length(p) - F.instr(p, "\n") - len(END),
                )
            ).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    raw = formatted.cast("binary")
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(
                F.substring(raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string")
            ),
        ),
        "",
    )
