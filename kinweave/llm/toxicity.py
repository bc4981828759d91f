"""Toxicity scores by weak supervision.

Voters are rules that fire for one class or abstain, and abstaining is no
evidence: small lexicons of insults, typographic
patterns, stems or words that are dense in texts labelled toxic, and the
annotation itself, which is a pair of noisy voters and ties the rules of
different languages to one class; one more voter fires where no rule does. A
generative label model (a latent class with one accuracy per voter, and joint
vote tables for groups of voters that stay correlated within a class) is fitted
by expectation maximisation on their votes; its posteriors are the targets of
a sparse linear classifier on words and stems, which scores every text.

A feature is a word or a word's first 4 to 8 letters, either *present* (worth
less the longer the text is) or *dense* (at least ``DENSE`` of all words, and
twice or more in texts of ``SHORT`` words; a lexicon's word is dense wherever
it is). Everything is
fitted on at most ``MAX_TOXIC`` and ``MAX_CLEAN`` different labelled texts (those
of the smallest seeded hashes, drawn after labels have met their documents and
weighted back to the shares of all labelled texts); scoring reads whole texts.

Defined results: null and empty texts get the classifier's score of no
feature; rows with a null label teach nothing; of repeated ids each different
text is labelled, and copies of one count once; with no labelled text of either
class every score is the share of toxic labels (0 without labels); repeated
rows are scored alike; an empty table gives no rows; a column with the name of
a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, give_back, held_out, quoted, whole_row, with_results
from kinweave.llm.linear import Ftrl, WordMemo, lower_words, sliced, softmax, temperature
from kinweave.llm.sampling import smallest_hashes
from kinweave.session import materialize

MAX_TOXIC, MAX_CLEAN = 2000, 4000
FEATURES = 1 << 22
DENSE = 0.005
SHORT = 100
STEMS = range(4, 9)
THRESHOLD = 0.3
MINED = 32
BIAS = 4.0  # the value of the constant feature, so that the penalties hardly touch it
MAX_GROUP = 6

LEXICONS = (
    ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "dumbass", "retard"),
    ("scum", "trash", "garbage", "filth", "vermin", "parasite", "pig"),
    ("loser", "clown", "pathetic", "worthless", "useless", "coward"),
    ("disgusting", "hate", "despise", "ugly", "creep", "freak", "jerk", "bastard", "bitch", "asshole", "shit", "fuck"),
)
PATTERNS = (
    re.compile(r"\b(?:you|your|ihr|du|tu|vous)\b[^.!?]{0,40}\b(?:idiot|moron|loser|clown|scum|trash)", re.I),
    re.compile(r"(?:\b[^\W\d_a-zß-öø-ÿ]{3,}!+\s*){3}"),
    re.compile(r"\b[^\W\d_]{1,3}[*@#$]{2,}[^\W\d_]*", re.I),
)
STATIC = len(LEXICONS) + len(PATTERNS)


def word_ids(word: bytes) -> list[int]:
    """Hashed ids (even numbers) of a word and its stems; the next odd number stands for the dense form."""
    letters = word.decode("utf-8", "replace")
    names = [letters, *[letters[:k] + "*" for k in STEMS if len(letters) > k]]
    return [2 * (xxhash.xxh32_intdigest(n) % (FEATURES // 2)) for n in names]


def word_features(words: list[bytes]) -> list[np.ndarray]:
    return [np.array(word_ids(w), np.int32) for w in words]


_LEXICON_IDS = np.array([word_ids(w.encode())[0] for lexicon in LEXICONS for w in lexicon])


def _hits(text: str) -> int:
    """The static voters that fire, as bits."""
    words = set(lower_words(text))
    bits = sum(1 << i for i, lexicon in enumerate(LEXICONS) if any(w.encode() in words for w in lexicon))
    return bits | sum(1 << len(LEXICONS) + i for i, p in enumerate(PATTERNS) if p.search(text))


def _present(slots: np.ndarray, held: list[np.ndarray], n_words: int) -> np.ndarray:
    """The features of a text from the slots of its words."""
    slots, counts = np.unique(slots, return_counts=True)
    per_word = [held[s] for s in slots]
    sizes = [len(f) for f in per_word]
    if not sum(sizes):
        return np.zeros(0, np.int64)
    ids, inverse = np.unique(np.concatenate(per_word), return_inverse=True)
    total = np.bincount(inverse, np.repeat(counts, sizes))
    dense = (total >= (2 if n_words >= SHORT else 1)) & (total >= DENSE * n_words)
    dense |= np.isin(ids, _LEXICON_IDS)
    return np.concatenate([ids, ids[dense] + 1]).astype(np.int64)


def values_of(ids: np.ndarray, n_words: int) -> np.ndarray:
    """The values of a text's features."""
    return np.where(ids & 1, 1.0, 1 / (1 + n_words / 50))


def mine_voters(features: list[np.ndarray], toxic: np.ndarray, weights: np.ndarray, size: int, count: int = MINED, cover: int = 3) -> list[int]:
    """Of ``size`` features those that hold for toxic texts and hardly for others, each toxic text covered up to ``cover`` times."""
    positive, toxic_mass, clean_mass = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
    for f, is_toxic, weight in zip(features, toxic, weights):  # a text holds a feature once
        if is_toxic:
            positive[f] += 1
            toxic_mass[f] += weight
        else:
            clean_mass[f] += weight
    fit = np.flatnonzero((positive >= 4) & (toxic_mass >= 0.8 * (toxic_mass + clean_mass + 1)))
    at = np.full(size, -1, np.int32)
    at[fit] = np.arange(len(fit))
    holders: list[list[int]] = [[] for _ in fit]
    for i in np.flatnonzero(toxic):
        for f in at[features[i]]:
            if f >= 0:
                holders[f].append(i)
    need, chosen = np.full(len(features), cover), []
    sets = [np.array(h, np.int64) for h in holders]
    gains = np.array([len(h) * 1.0 for h in sets])
    while len(chosen) < count and len(gains) and gains.max() >= 4:
        best = int(gains.argmax())  # gains only fall: look again until the best is up to date
        now = float((need[sets[best]] > 0).sum())
        if now < gains[best]:
            gains[best] = now
            continue
        chosen.append(int(fit[best]))
        need[sets[best]] -= 1
        gains[best] = 0
    return chosen


@dataclass
class LabelModel:
    """P(toxic) and, per group of voters, the probability of each vote pattern given the class."""

    prior: float
    groups: list[list[int]]
    tables: list[np.ndarray]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for group, table in zip(self.groups, self.tables):
            pattern = _pattern(votes, group)
            log += np.where(pattern[:, None] > 0, np.log(table)[pattern], 0.0)
        return softmax(log)[:, 1]


def _pattern(votes: np.ndarray, group: list[int]) -> np.ndarray:
    return votes[:, group].astype(np.int64) @ (1 << np.arange(len(group)))


def _maximise(votes: np.ndarray, groups: list[list[int]], soft: np.ndarray, weights: np.ndarray, prior: float) -> LabelModel:
    mass = np.stack([weights * (1 - soft), weights * soft], axis=1)
    tables = []
    for group in groups:
        table = np.full((1 << len(group), 2), 0.5 / (1 << len(group)))
        np.add.at(table, _pattern(votes, group), mass)
        tables.append(table / table.sum(axis=0))
    return LabelModel(prior, groups, tables)


def _groups(votes: np.ndarray, soft: np.ndarray, weights: np.ndarray, least: float = 0.3) -> list[list[int]]:
    """Voters joined where their votes correlate beyond what the class explains; the strongest pairs first."""
    n = votes.shape[1]
    strength = np.zeros((n, n))
    for share in (soft, 1 - soft):
        w = weights * share
        if w.sum() < 1:
            continue
        centred = (votes - np.average(votes, axis=0, weights=w)) * np.sqrt(w / w.sum())[:, None]
        cov = centred.T @ centred
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        strength += np.abs(cov / np.outer(dev, dev)) * (w.sum() / weights.sum())
    of = {v: [v] for v in range(n)}
    for i, j in sorted(((i, j) for i in range(n) for j in range(i)), key=lambda p: (-strength[p], p)):
        if strength[i, j] < least:
            break
        if of[i] is not of[j] and len(of[i]) + len(of[j]) <= MAX_GROUP:
            joined = of[i] + of[j]
            of.update({v: joined for v in joined})
    return sorted({id(g): sorted(g) for g in of.values()}.values())


def fit_label_model(votes: np.ndarray, weights: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximisation from the last voter's view (the annotation's), first with independent voters, then with the groups that their correlations show."""
    soft = np.where(votes[:, -1], 0.9, 0.05)
    prior = float(np.clip(np.average(votes[:, -1], weights=weights), 1e-4, 1 - 1e-4))  # the class balance is the annotation's
    groups = [[v] for v in range(votes.shape[1])]
    for stage in range(2):
        for _ in range(rounds):
            model = _maximise(votes, groups, soft, weights, prior)
            soft = model.posterior(votes)
        if not stage:
            groups = _groups(votes, soft, weights)
    return model


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights of the linear classifier; features are sorted."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    heat: float

    def memo(self) -> WordMemo:
        """Of each word those features that carry weight in either form."""
        weighted = frozenset((self.features & ~1).tolist())

        def of(words: list[bytes]) -> list[np.ndarray | None]:
            kept = [[i for i in word_ids(w) if i in weighted] for w in words]
            return [np.array(ids, np.int32) if ids else None for ids in kept]

        return WordMemo(of)

    def _at(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.features, ids), len(self.features) - 1)
        return np.where(self.features[at] == ids, at, -1)

    def score(self, slots: np.ndarray, memo: WordMemo) -> float:
        logit, used = self.bias, slots[slots > 0]
        if len(used):
            ids = _present(used, memo.held, len(slots))
            at = self._at(ids)
            logit += float(self.weights[at[at >= 0]] @ values_of(ids, len(slots))[at >= 0])
        return float(1 / (1 + np.exp(-np.clip(logit / self.heat, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
          max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, epochs: int = 4, seed: int = 3,
          alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.02) -> ToxicityModel:
    """A model from the labelled rows; which rows to learn from is the caller's choice (filter ``labels``)."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col(quoted(label_col)).isin(0, 1)).select(
        F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")
    ).distinct()
    # rows to learn from are different (id, text, label); whatever repeats counts once
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    texts = texts.withColumn("h", F.xxhash64(F.lit(23), "id", "text"))
    keys = materialize(texts.select("id", "h").distinct().join(known, "id").select("y", "h").distinct(), "labelled")
    totals = {r["y"]: r["n"] for r in keys.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    nothing = np.zeros(0, np.int64), np.zeros(0)
    if not n_toxic or not n_clean:
        return ToxicityModel(*nothing, 40.0 if n_toxic else -40.0, 1.0)
    sample = smallest_hashes(keys, "y", totals, {0: max_clean, 1: max_toxic})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordMemo(word_features), set()
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = pa.array([i for i, k in enumerate(names) if not (k in seen or seen.add(k))], pa.int64())
            batch, rows, sizes = batch.take(new), [], []
            for part in sliced(batch.column(2)):
                for slots in memo.slots(part):
                    rows.append(_present(slots, memo.held, len(slots)).astype(np.int32))
                    sizes.append(len(slots))
            hits = [_hits(t or "") for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(hits, pa.int32()), pa.array(sizes, pa.int32()), pa.array(rows, pa.list_(pa.int32()))],
                names=["y", "h", "hits", "n_words", "features"],
            )
        del memo
        give_back()

    found = texts.join(F.broadcast(sample), "h").select("y", "h", "text").mapInArrow(read, "y int, h long, hits int, n_words int, features array<int>")
    rows = found.dropDuplicates(["y", "h"]).drop("h").toArrow()  # at most max_toxic + max_clean rows
    toxic = np.asarray(rows.column("y")) == 1
    # views of the table's memory, not copies
    features = [np.asarray(f.values) for f in rows.column("features")]
    order = sorted(range(len(features)), key=lambda i: (xxhash.xxh64_intdigest(features[i].tobytes(), seed), toxic[i]))
    toxic, features = toxic[order], [features[i] for i in order]
    hits, n_words = (np.asarray(rows.column(c))[order] for c in ("hits", "n_words"))
    weights = np.where(toxic, n_toxic / toxic.sum(), n_clean / (~toxic).sum())
    weights = weights / weights.mean()

    # From here on features are numbered by their place among those that occur in the sample.
    known_ids = np.zeros(0, np.int32)
    for start in range(0, len(features), 256):
        known_ids = np.union1d(known_ids, np.concatenate(features[start: start + 256]))
    odd, bias = known_ids & 1, len(known_ids)
    features = [np.searchsorted(known_ids, f).astype(np.int32) for f in features]
    del rows

    def example(i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.append(features[i], bias), np.append(values_of(odd[features[i]], n_words[i]), BIAS)

    voters = mine_voters(features, toxic, weights, bias)
    votes = np.zeros((len(features), STATIC + len(voters) + 3), bool)
    votes[:, :STATIC] = hits[:, None] >> np.arange(STATIC) & 1
    for i, f in enumerate(features):
        votes[i, STATIC:-3] = np.isin(voters, f)
    votes[:, -3], votes[:, -2], votes[:, -1] = ~votes.any(axis=1), ~toxic, toxic
    target = fit_label_model(votes, weights).posterior(votes)

    kept_apart = len(features) // 5
    model = Ftrl(bias + 1, 2, alpha, beta, l1, l2)
    for _ in range(epochs):
        for i in range(kept_apart, len(features)):
            model.learn(*example(i), np.array([1 - target[i], target[i]]), weights[i])
    every = model.weights()
    every = every[:, 1] - every[:, 0]
    logits = np.array([every[at] @ x for at, x in map(example, range(kept_apart))])
    soft = target[:kept_apart]
    heat = temperature(
        np.stack([np.zeros(kept_apart), logits], axis=1), np.stack([1 - soft, soft], axis=1), weights[:kept_apart]
    )
    at = np.flatnonzero(every[:bias])
    return ToxicityModel(known_ids[at].astype(np.int64), every[at], float(BIAS * every[bias]), heat)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        memo = model.memo()
        for texts in batches:
            yield pa.array([model.score(s, memo) for words in sliced(texts) for s in memo.slots(words)], pa.float64())
        del memo
        give_back()

    rows = docs.select(whole_row(docs).alias("row"), scores(F.col(quoted(text_col))).alias("s"))
    return rows.select(*with_results("row", docs.columns, score=F.col("s"), predicted=(F.col("s") >= THRESHOLD).cast("int")))


def train_on_kept_in(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the labelled rows that are not held out."""
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))
