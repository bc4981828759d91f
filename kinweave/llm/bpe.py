"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Each piece of a text is a row of symbols. A segment tree holds, per adjacent
pair, its merge rank followed by its place, so its root is the leftmost pair of
the lowest rank. A merge changes two pairs: two points are updated in
logarithmic time, until the root shows no mergeable pair. Pieces of similar
length are handled together, one array row per piece, so that a step of the
algorithm is a few array operations over all of them; the longest piece costs
n log n.

Texts are cut at the tokenizer's added tokens first, then composed (NFC),
lower-cased character by character and split into pieces by the tokenizer's
pattern; pieces are bytes spelled as printable characters, the last one with
the end-of-word suffix. Different pieces are encoded once per batch and kept in
a memo of at most ``MEMO`` pieces per worker.

The vocabulary is read on the driver and broadcast as text; its size is fixed
by the tokenizer and checked against ``MAX_MODEL_BYTES``.

Defined results: a null or empty text has no tokens and decodes to an empty
text; symbols outside the vocabulary are dropped; repeated rows are encoded
alike; an empty table gives no rows; a column with the name of a result is
replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, give_back, quoted, whole_row, with_results

MAX_MODEL_BYTES = 64 << 20
MEMO = 60_000
NONE = np.int64(1 << 62)
# The contractions that the tokenizer's pattern keeps whole.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _char_class(kind: str, last: int) -> str:
    """The characters up to ``last`` whose general category starts with ``kind``, as ranges of a pattern."""
    out, start = [], None
    for code in range(last + 2):
        inside = code <= last and unicodedata.category(chr(code)).startswith(kind)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=2)
def piece_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """The pieces of texts whose characters are at most ``last``. Classes without astral ranges are searched faster."""
    letter, number = _char_class("L", last), _char_class("N", last)
    space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile("|".join([f"[{letter}]+", *CONTRACTIONS, f"[{number}]", f"[^{space}{letter}{number}]+"]))


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character of each byte: itself where it is visible Latin-1, the next unused code point otherwise."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class BpeModel:
    """Tables of a tokenizer file of this kind, and the memo of its pieces."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        spelled = [""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            spelled[i] = token
        self.spelled = pa.array(spelled)
        symbols = byte_symbols()
        self.first_ids = np.array([[vocab.get(s, -1), vocab.get(s + suffix, -1)] for s in symbols], np.int64)
        left, right, merged = [], [], []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left.append(vocab[a]), right.append(vocab[b]), merged.append(vocab[a + b])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.pair_ids = keys[order], order.astype(np.int64), np.array(merged, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.memo_ids, self.memo_starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; NONE where there is none (or a side is missing, -1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Apply all merges to each row of ``symbols``; -1 pads rows on the right and stands for merged-away places."""
        n, width = symbols.shape
        leaves = 1 << max(1, int(width - 1).bit_length())
        out = np.full((n, leaves), -1, np.int64)
        out[:, :width] = symbols
        place = np.arange(leaves, dtype=np.int64)
        following = np.broadcast_to(np.append(place[1:], -1), out.shape).copy()
        before = np.broadcast_to(place - 1, out.shape).copy()
        shift = leaves.bit_length()
        tree = np.full((n, 2 * leaves), NONE)
        rank = self.ranks(out[:, :-1], out[:, 1:])
        tree[:, leaves: 2 * leaves - 1] = np.where(rank < NONE, rank << shift | place[:-1], NONE)
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level: 2 * level] = np.minimum(tree[:, 2 * level: 4 * level: 2], tree[:, 2 * level + 1: 4 * level: 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        mask = np.int64((1 << shift) - 1)

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            after = following[rows, at]
            rank = self.ranks(out[rows, at], np.where(after >= 0, out[rows, after], -1))
            return np.where(rank < NONE, rank << shift | at, NONE)

        while len(live):
            root = tree[live, 1]
            at = root & mask
            gone = following[live, at]
            after = following[live, gone]
            out[live, at] = self.pair_ids[root >> shift]
            out[live, gone] = -1
            following[live, at] = after
            some = after >= 0
            before[live[some], after[some]] = at[some]
            update(live, gone, np.full(len(live), NONE))
            update(live, at, pair(live, at))
            ahead = before[live, at]
            some = ahead >= 0
            if some.any():
                update(live[some], ahead[some], pair(live[some], ahead[some]))
            live = live[tree[live, 1] < NONE]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are new and append them to the memo, in their order."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.array([len(r) for r in raw], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        found: list[np.ndarray | None] = [None] * len(raw)
        counts = np.zeros(len(raw), np.int64)
        bands = np.array([int(x - 1).bit_length() for x in np.maximum(lengths, 1)])
        for band in np.unique(bands):
            members = np.flatnonzero(bands == band)
            step = max(1, (1 << 19) >> int(band))  # a few MB per array, whatever the length
            for chunk in (members[i: i + step] for i in range(0, len(members), step)):
                width = int(lengths[chunk].max())
                cols = np.arange(width)
                inside = cols[None, :] < lengths[chunk][:, None]
                symbols = np.full(inside.shape, -1, np.int64)
                symbols[inside] = self.first_ids[data[(starts[chunk][:, None] + cols)[inside]], 0]
                symbols[np.arange(len(chunk)), lengths[chunk] - 1] = self.first_ids[data[starts[chunk] + lengths[chunk] - 1], 1]
                merged = self.merge(symbols)
                kept = merged >= 0
                counts[chunk] = kept.sum(axis=1)
                for i, ids in zip(chunk, np.split(merged[kept].astype(np.int32), np.cumsum(counts[chunk])[:-1])):
                    found[i] = ids
        self.memo_ids = np.concatenate([self.memo_ids, *[f for f in found if f is not None]])
        self.memo_starts = np.concatenate([self.memo_starts, self.memo_starts[-1] + np.cumsum(counts)])

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pieces and ids of added tokens, in order."""
        at = 0
        for found in self.added_pattern.finditer(text) if self.added_pattern else ():
            yield self._split(text[at: found.start()])
            yield self.added[found.group()]
            at = found.end()
        yield self._split(text[at:])

    @staticmethod
    def _split(text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower() knows a final form of this letter, a tokenizer that lowers characters one by one does not
        text = text.replace("Σ", "σ").lower()
        return piece_pattern(0xFFFF if not text or max(text) <= "\uffff" else sys.maxunicode).findall(text)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of text i are ``ids[offsets[i]:offsets[i + 1]]``."""
        if len(self.slots) > MEMO:
            self._forget()
        slots, new, codes, counts = self.slots, [], [], []
        for text in texts:
            n = 0
            for part in self.pieces(text) if text else ():
                if isinstance(part, int):
                    codes.append([-1 - part])
                    n += 1
                    continue
                for piece in set(part).difference(slots):
                    slots[piece] = len(slots)
                    new.append(piece)
                codes.append(list(map(slots.__getitem__, part)))
                n += len(part)
            counts.append(n)
        if new:
            self._learn(new)
        flat = np.fromiter((c for part in codes for c in part), np.int64, sum(counts))
        special = flat < 0
        slot = np.where(special, 0, flat)
        length = np.where(special, 1, np.diff(self.memo_starts)[slot] if len(self.memo_starts) > 1 else 1)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        start = np.where(special, 0, self.memo_starts[slot])
        source = np.arange(total) - np.repeat(ends - length, length) + np.repeat(start, length)
        ids = np.empty(total, np.int32)
        of_special = np.repeat(special, length)
        ids[~of_special] = self.memo_ids[source[~of_special]]
        ids[of_special] = (-1 - flat[special]).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[at]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token spellings joined by a space, as a tokenizer without a decoder does."""
        flat = pc.take(self.spelled, ids.flatten())
        offsets = np.asarray(ids.offsets)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), flat), " ")


_models: dict[str, BpeModel] = {}


def _model(text: str) -> BpeModel:
    """The worker's model of a tokenizer text; it lives as long as the worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _models:
        _models[key] = BpeModel(text)
    return _models[key]


def _shared(df: DataFrame, path: str):
    bounded_batches(df.sparkSession)
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if len(text) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(text)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text. ``path`` is the tokenizer file, as seen by the driver."""
    shared = _shared(docs, path)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(shared.value)
        for texts in batches:
            out = []
            for i in range(0, len(texts), 128):
                ids, offsets = model.encode_batch(texts.slice(i, 128).to_pylist())
                out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        model._forget()  # the worker lives on, for other work
        give_back()

    rows = docs.select(whole_row(docs).alias("row"), ids_of(F.col(quoted(text_col))).alias("ids"))
    return rows.select(*with_results("row", docs.columns, **{ids_col: F.col("ids")}))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for; special tokens stay in it."""
    shared = _shared(encoded, path)

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(shared.value)
        for ids in batches:
            yield model.decode(ids)
        give_back()

    rows = encoded.select(whole_row(encoded).alias("row"), text_of(F.col(quoted(ids_col))).alias("decoded"))
    return rows.select(*with_results("row", encoded.columns, **{decoded_col: F.col("decoded")}))
