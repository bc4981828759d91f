"""Language identification with a sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed character n-grams of words with their ends marked;
a text's value for an n-gram is its share of all n-grams times its inverse
document frequency. As that is linear in the words, a text's logits are the
sums of its words' contributions over the number of its n-grams, and each
worker keeps the contributions of words it has seen.

Document frequencies are counted over all training texts. The weights are
fitted with follow-the-regularised-leader and elastic-net penalties on at most
``PER_LANGUAGE`` different texts of each language and ``IN_ALL`` of all (at
least one of each language), those of the smallest seeded hashes; a fifth of
them is kept apart for the temperature that calibrates the scores.

Defined results: a null text or one without a letter is ``und`` with score 0;
texts of any length are read whole; copies of a text are one text to learn from;
rows with a null language teach nothing; without any training text all
documents are ``und`` with score 0; equal scores go to the language that sorts
first; repeated rows are judged alike; an empty table gives no rows; a column
with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, give_back, held_out, quoted, whole_row, with_results
from kinweave.llm.linear import Ftrl, WordMemo, sliced, softmax, temperature
from kinweave.llm.sampling import smallest_hashes

PER_LANGUAGE = 1500
IN_ALL = 8000
FEATURES = 1 << 15
SIZES = (1, 2, 3)
UNKNOWN = "und"
SCALE = 50.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point below 2^16 is a letter."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def word_ngrams(words: list[bytes]) -> list[np.ndarray]:
    """The hashed n-grams of each word, repeats included. Runs of letters are marked with a space at both ends."""
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == 32) - 1
    low = np.minimum(code, 65535).astype(np.int64)
    letter = _letters()[low]
    for i in np.flatnonzero(code > 65535):
        letter[i] = chr(code[i]).isalpha()
    code = np.where(letter, code, 32)
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(code) < n:
                continue
            h, last = np.full(len(code) - n + 1, n, np.uint64), len(code) - n + 1
            for k in range(n):
                h = (h ^ code[k: last + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inner = np.ones(last, bool)  # a space is an end only, and something must be a letter
            for k in range(1, n - 1):
                inner &= letter[k: last + k]
            inner &= letter[:last] | letter[n - 1: last + n - 1] if n < 3 else inner
            found.append((h[inner] >> np.uint64(20)).astype(np.int64) % FEATURES)
            owner.append(word[:last][inner])
    at = np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=len(words))[: len(words)]
    return np.split(np.concatenate(found)[order].astype(np.int32), np.cumsum(counts)[:-1])


def _memo() -> WordMemo:
    return WordMemo(word_ngrams)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # features by languages, times idf and SCALE
    bias: np.ndarray
    heat: float

    def contributions(self, words: list[bytes]) -> np.ndarray:
        """Per word the sums of its n-grams' weights, and their number."""
        ngrams = word_ngrams(words)
        sizes = np.array([len(g) for g in ngrams])
        out = np.zeros((len(words), len(self.languages) + 1))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            out[some, :-1] = np.add.reduceat(self.weights[np.concatenate([ngrams[i] for i in some])], starts, axis=0)
        out[:, -1] = sizes
        return out

    def predict(self, texts: list[list[bytes]], memo: WordMemo) -> tuple[list[str], np.ndarray]:
        sums = np.zeros((len(texts), len(self.languages) + 1))
        slots = memo.slots(texts)
        if any(map(len, slots)):
            used, at = np.unique(np.concatenate(slots), return_inverse=True)
            values = np.stack([memo.held[s] for s in used])[at]
            sizes = np.array([len(s) for s in slots])
            some = np.flatnonzero(sizes)
            sums[some] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0)
        known = sums[:, -1] > 0
        logits = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias
        scores = softmax(logits / self.heat) if self.languages else np.zeros((len(texts), 1))
        best = scores.argmax(axis=1)
        return [self.languages[b] if k and self.languages else UNKNOWN for b, k in zip(best, known)], np.where(known, scores.max(axis=1), 0.0)


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each n-gram is, and how many texts there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total, flags = _memo(), np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES, bool)
        for batch in batches:
            total[-1] += batch.num_rows
            for texts in sliced(batch.column(0)):
                for slots in memo.slots(texts):
                    if len(slots):
                        at = np.concatenate([memo.held[s] for s in set(slots.tolist())])
                        flags[at] = True
                        total[:-1] += flags
                        flags[at] = False
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["feature", "n"])
        del memo
        give_back()

    # one row per feature at most reaches the driver
    rows = texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(FEATURES + 1, np.int64)
    total[np.asarray(rows.column("feature"))] = np.asarray(rows.column("n"))
    return total[:-1], int(total[-1])


def _sample(training: DataFrame, per_language: int, in_all: int) -> tuple[list[str], list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """All languages, and of a bounded number of different texts of each its index, n-grams and their counts."""
    training = training.withColumn("h", F.xxhash64(F.lit(11), "text"))
    counts = training.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row per language
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], [], []
    size = max(1, min(per_language, in_all // len(languages)))
    sample = smallest_hashes(training.select("lang", "h"), "lang", {r["lang"]: r["n"] for r in counts}, dict.fromkeys(languages, size))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = _memo(), set()
        names = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]  # copies are counted once
            ids, ns = [], []
            for texts in sliced(batch.column(2).take(pa.array(new, pa.int64()))):
                for slots in memo.slots(texts):
                    grams = np.concatenate([memo.held[s] for s in slots]) if len(slots) else np.zeros(0, np.int32)
                    values, n = np.unique(grams, return_counts=True)
                    ids.append(values), ns.append(n.astype(np.int32))
            lang = pa.array([names[keys[i][0]] for i in new], pa.int32())
            h = pa.array([keys[i][1] for i in new], pa.int64())
            yield pa.record_batch([lang, h, pa.array(ids, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))], names=["lang", "h", "ids", "ns"])
        del memo
        give_back()

    read = training.join(F.broadcast(sample), ["lang", "h"]).select("lang", "h", "text").mapInArrow(packed, "lang int, h long, ids array<int>, ns array<int>")
    rows = read.dropDuplicates(["lang", "h"]).select("lang", "ids", "ns").toArrow()  # at most ``size`` rows a language
    # views of the table's memory, not copies
    grams = [(np.asarray(i.values), np.asarray(n.values)) for i, n in zip(rows.column("ids"), rows.column("ns"))]
    return languages, rows.column("lang").to_pylist(), grams


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, epochs: int = 3,
    seed: int = 5, alpha: float = 0.3, beta: float = 0.1, l1: float = 0.02, l2: float = 0.01,
) -> LanguageModel:
    """A model from the rows of ``docs`` with a language; rows to learn from are the caller's choice.

    It learns from at most ``per_language`` different texts a language and
    ``in_all`` altogether (but one of each language at least).
    """
    bounded_batches(docs.sparkSession)
    training = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).alias("text")).filter("lang is not null and text is not null")
    languages, langs, grams = _sample(training, per_language, in_all)
    if not languages:
        return LanguageModel((), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    seen, n_texts = _frequencies(training.select("text"))
    idf = np.log((1 + n_texts) / (1 + seen)) + 1
    kept = sorted((i for i, g in enumerate(grams) if len(g[0])), key=lambda i: (xxhash.xxh64_intdigest(grams[i][0].tobytes() + grams[i][1].tobytes()), langs[i]))

    def example(i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, n = grams[i]
        return np.append(ids, FEATURES), np.append(SCALE * n / n.sum() * idf[ids], 1.0)

    targets = np.eye(len(languages))
    order = np.array(kept, np.int64)[np.random.default_rng(seed).permutation(len(kept))]
    kept_apart, learned = order[: len(order) // 5], order[len(order) // 5:]
    model = Ftrl(FEATURES + 1, len(languages), alpha, beta, l1, l2)
    for _ in range(epochs):
        for i in learned:
            model.learn(*example(i), targets[langs[i]])
    weights = model.weights()
    logits = np.array([x @ weights[at] for at, x in map(example, kept_apart)]).reshape(-1, len(languages))
    heat = temperature(logits, targets[[langs[i] for i in kept_apart]].reshape(-1, len(languages)))
    return LanguageModel(tuple(languages), weights[:-1] * (SCALE * idf)[:, None], weights[-1], heat)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        memo = WordMemo(model.contributions)
        for texts in batches:
            names, scores = [], []
            for words in sliced(texts):
                of_slice = model.predict(words, memo)
                names += of_slice[0]
                scores += of_slice[1].tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        del memo
        give_back()

    rows = docs.select(whole_row(docs).alias("row"), predict(F.col(quoted(text_col))).alias("p"))
    return rows.select(*with_results("row", docs.columns, lang_pred=F.col("p.lang_pred"), score=F.col("p.score")))


def train_on_kept_in(docs: DataFrame) -> LanguageModel:
    """The model of the rows of a ``documents`` table that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))))
