"""Facts of a file from one pass over its tokens, linked within the file.

A language gives a scanner and a reader. The reader goes through the tokens of a
path once and keeps what the windows of its ``_scan`` carry from row to row; no
token becomes a row. Both give the same facts, which the tests compare.

Texts that share a path are read as one, their tokens ordered by position, as
windows by path take them; so are those without a path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from kinweave.extract.lexer import Token, with_depths
from kinweave.extract.tokens import spread

SCAN_TEXT = 1 << 21  # a task's share of the text; nothing but facts leaves the scan
BATCH_FACTS = 1 << 15
PADDING = ("",) * 6
FACTS = (
    "file_path string, pos bigint, fact string, name string, a string, b string, line bigint, end_line bigint, "
    "around string, cls string, prop_type string"
)
_SCHEMA = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in FACTS.split(", ")])
_WORD = re.compile(r"(?:[^\W\d]|[$#\\])[\w$\\]*\Z")

Fact = tuple  # pos, fact, name, a, b, line, end_line


class Rows(NamedTuple):
    """The tokens of a path by column. ``tok`` ends in ``PADDING``, so neighbours past either end are ''."""

    pos: list[int]
    tok: list[str]
    line: list[int]
    end: list[int]
    depth: list[int]
    parens: list[int]
    newline: list[bool]
    outside: list[int]  # the depth around the text that the token is from


class _Words(dict):
    """Whether a token is a name (``tokens.IDENT``); short ones are remembered."""

    def __missing__(self, token: str) -> bool:
        known = _WORD.match(token) is not None and (token[0].isalpha() or token[0] in "_$#\\")
        if len(token) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[token] = known
        return known


WORDS = _Words()


def tokens_of(texts: list[tuple[list[Token], int]]) -> Rows:
    """The rows of ``(tokens, outside)`` of each text of a path."""
    rows = [(i, *row, outside) for tokens, outside in texts for i, row in enumerate(with_depths(tokens))]
    if len(texts) > 1:
        rows.sort(key=itemgetter(0))
    pos, tok, line, end, depth, parens, newline, outside = map(list, zip(*rows)) if rows else ([] for _ in range(8))
    tok += PADDING
    return Rows(pos, tok, line, end, depth, parens, newline, outside)


def linked(path: str | None, found: list[Fact]) -> Iterator[tuple]:
    """Rows of ``FACTS``: symbols, parents and errors, and each call with the narrowest symbol around its line (the
    earlier on a tie) and the declared type of its property in that symbol's class. Calls outside of symbols go, and
    properties, which nothing else needs."""
    calls, symbols, types = [], [], {}
    for row in found:
        pos, fact, name, a, b, line, end = row
        if fact == "call":
            calls.append(row)
            continue
        if fact == "prop":
            types[a, name] = max(types.get((a, name), (pos, b)), (pos, b), key=itemgetter(0))
            continue
        yield (path, *row, None, None, None)
        if fact == "symbol" and line is not None and end is not None and end >= line:
            symbols.append((line, end, (end - line, pos, name)))
    if path is None:
        return
    calls.sort(key=itemgetter(5))
    symbols.sort()
    open_, at = [], 0
    for row in calls:
        line = row[5]
        while at < len(symbols) and symbols[at][0] <= line:
            heappush(open_, (symbols[at][2], symbols[at][1]))
            at += 1
        while open_ and open_[0][1] < line:
            heappop(open_)
        if open_:
            around = open_[0][0][2]
            cls = around.rpartition(".")[0] if "." in around else None
            held = types.get((cls, row[4])) if cls is not None and row[3] == "prop" else None
            yield (path, *row, around, cls, held and held[1])


def read(files: DataFrame, flag: Column, scan: Callable[[str, object], tuple[list[Token], int]], facts: Callable[[Rows], list[Fact]]) -> DataFrame:
    """``FACTS`` of ``(file_path, text)``; ``scan`` takes a text and its ``flag`` and gives tokens and the depth around them."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        path, texts = None, []
        each = (zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()) for b in batches)
        for at, text, known in chain.from_iterable(each):
            if texts and at != path:
                yield from linked(path, facts(tokens_of(texts)))
                texts = []
            path = at
            texts.append(scan(text.as_py() or "", known))
        if texts:
            yield from linked(path, facts(tokens_of(texts)))

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) >= BATCH_FACTS:
                yield _batch(held)
                held = []
        yield _batch(held)

    dealt, _ = spread(files.select("file_path", "text"), SCAN_TEXT)
    return dealt.select("file_path", "text", flag.alias("flag")).sortWithinPartitions("file_path").mapInArrow(batched, FACTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in _SCHEMA)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
