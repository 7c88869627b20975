"""Supervised subword embeddings: a quality classifier in the manner of fastText.

Hashed vectors of words, of pairs of neighbouring words and of character
n-grams (2 to 4) are averaged per document and go through a softmax; numpy
stochastic gradient descent learns both from a bounded sample of labelled
documents (``samples.PER_CLASS`` of either class, balanced). A pair's bucket is
the difference of its words' hashes, so that any word said twice running falls
into the same bucket, whose vector is learned like the rest. Vectors start at
zero, so what the sample never held says nothing. As the softmax is linear in
the average, scoring needs one number a feature: each distinct word's features
are summed once, pairs are looked up in the weights, and every whole text is a
weighted mean of them, in parts of ``AT_ONCE`` words.

Defined cases: null and empty texts, and texts of blanks, score as an average
of zero, which is the bias alone; a very long text is averaged whole; repeated
rows score alike; without labels of both classes every score is 0.5; an empty
table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, is_held_out, words_in_parts
from .samples import PER_CLASS, labelled_texts
from .subwords import char_ngrams, word_hashes

BUCKETS = 1 << 17
DIM = 8
SIZES = (2, 3, 4)
STEPS = 500
BATCH = 32
RATE = 0.3
THRESHOLD = 0.3
#: Words of a text that are scored at once; bounds memory.
AT_ONCE = 1 << 18


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number); words and n-grams share the buckets."""
    grams, owner, _ = char_ngrams(words, SIZES, BUCKETS)
    return np.concatenate([word_hashes(words, BUCKETS), grams]), np.concatenate([np.arange(len(words)), owner])


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, whose hashes these are."""
    return (hashes[1:] - hashes[:-1]) % BUCKETS


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text with their shares of all its features."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    f, owner = word_features(list(number))
    total = np.bincount(f, np.bincount(ids, minlength=len(number))[owner], BUCKETS) if len(f) else np.zeros(BUCKETS)
    if len(ids) > 1:
        total += np.bincount(pair_features(word_hashes(list(number), BUCKETS)[ids]), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / max(total.sum(), 1)).astype(np.float32)


def fit(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, float]:
    """A log-odds weight for each feature bucket, and the bias."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    docs = [document_features(t) for t in texts]
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    out = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_o = np.full((BUCKETS, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32)
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(steps):
        rate = RATE * (1 - step / steps)
        picks = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        ids = np.concatenate([docs[i][0] for i in picks])
        share = np.concatenate([docs[i][1] for i in picks])
        row = np.repeat(np.arange(len(picks)), [len(docs[i][0]) for i in picks])
        near = vectors[ids]
        hidden = np.stack([np.bincount(row, share * near[:, d], len(picks)) for d in range(DIM)], 1).astype(np.float32)
        logits = hidden @ out + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(picks)), y[picks]] -= 1
        p /= len(picks)
        back = p @ out.T
        g_out = hidden.T @ p
        seen_o += g_out**2
        out -= rate * g_out / np.sqrt(seen_o)
        bias -= rate * p.sum(0)
        for d in range(DIM):
            g = np.bincount(ids, share * back[row, d], BUCKETS).astype(np.float32)
            hit = np.flatnonzero(g)
            seen_v[hit, d] += g[hit] ** 2
            vectors[hit, d] -= rate * g[hit] / np.sqrt(seen_v[hit, d])
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class _Scorer(WordTable):
    """Per distinct word: the sum of its features' weights, their number and its hash."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.reset()
        super().__init__()

    def reset(self) -> None:
        self.used = 0
        self.sums, self.counts, self.hashes = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.int64)

    def grow(self) -> None:
        if self.fresh:
            f, owner = word_features(self.fresh)
            n = self.used + len(self.fresh)
            if n > len(self.sums):
                more = max(n, 2 * self.used) - self.used
                self.sums, self.counts, self.hashes = (np.concatenate([x[: self.used], np.zeros(more, x.dtype)]) for x in (self.sums, self.counts, self.hashes))
            new = slice(self.used, n)
            self.sums[new] = np.bincount(owner, self.weights[f], len(self.fresh))
            self.counts[new] = np.bincount(owner, minlength=len(self.fresh))
            self.hashes[new] = f[: len(self.fresh)]
            self.used, self.fresh = n, []

    def mean(self, text: str | None) -> float:
        total = n = 0.0
        last = None
        for part in words_in_parts(text, AT_ONCE):
            self.start()
            ids = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            self.grow()
            hashes = self.hashes[ids] if last is None else np.concatenate([[last], self.hashes[ids]])
            pairs = pair_features(hashes)
            total += self.sums[ids].sum() + self.weights[pairs].sum(dtype=float)
            n += self.counts[ids].sum() + len(pairs)
            last = hashes[-1]
        return total / n if n else 0.0


def scorer(weights: np.ndarray, bias: float):
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Scorer(weights)
        for texts in parts:
            logit = np.fromiter((words.mean(t) for t in texts), float, len(texts)) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    return score


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts, y = labelled_texts(docs, labels, "quality", per_class)
    score = scorer(*fit(texts, y))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
