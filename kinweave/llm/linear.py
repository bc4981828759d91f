"""Words of a text and an online linear learner, shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

# ASCII but letters to spaces; texts are lower-cased before.
_SPLIT = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def lower_words(text: str) -> list[bytes]:
    """The lower-cased words of a text, cut at every ASCII character that is no letter."""
    return text.lower().encode("utf-8", "replace").translate(_SPLIT).split()


def sliced(texts: pa.Array, size: int = 64) -> Iterator[list[list[bytes]]]:
    """The words of texts (an Arrow array of strings), some texts at a time."""
    for i in range(0, len(texts), size):
        yield [lower_words(t) if t else [] for t in texts.slice(i, size).to_pylist()]


class WordMemo:
    """What ``make`` gives for the words of texts, made for all new words of some texts at once.

    Slot 0 stands for all words for which ``make`` gives None. A memo of more
    than ``limit`` words starts anew with the next texts, so its memory is
    bounded and its results are not.
    """

    def __init__(self, make: Callable[[list[bytes]], Sequence[object]], limit: int = 60_000) -> None:
        self.make, self.limit = make, limit
        self.index: dict[bytes, int] = {}
        self.held: list[object] = [None]

    def slots(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.index) > self.limit:
            self.index, self.held = {}, [None]
        new = list(set().union(*texts).difference(self.index))
        for word, value in zip(new, self.make(new) if new else ()):
            self.index[word] = 0 if value is None else len(self.held)
            if value is not None:
                self.held.append(value)
        get = self.index.__getitem__
        return [np.array(list(map(get, words)), np.int64) for words in texts]


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression with elastic-net penalties.

    A coordinate's weight is zero while its accumulated gradient is below
    ``l1``; otherwise it is the minimiser of the linearised losses so far plus
    ``l1 |w| + l2 w^2 / 2`` and the proximal terms of its own learning rate.
    """

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        """One example: features ``at`` with values ``x``, target probabilities of the classes."""
        w = self.weights(at)
        gradient = weight * x[:, None] * (softmax((x @ w)[None, :])[0] - target)[None, :]
        squared = gradient**2
        self.z[at] += gradient - (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += squared


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, targets: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The temperature, between 1/20 and 20, whose softmax has the least log loss (golden-section search over its logarithm)."""
    if not len(logits):
        return 1.0
    weights = np.ones(len(logits)) if weights is None else weights

    def loss(t: float) -> float:
        return float(-(weights[:, None] * targets * np.log(softmax(logits / np.exp(t)) + 1e-12)).sum())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
