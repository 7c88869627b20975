"""License scans: MinHash over overlapping windows, then exact containment.

Words are runs of letters and digits, lower-cased. A template is its set of
five-word shingles (a shorter one is its words as one shingle). For each size
of template a text's shingles are cut into windows that overlap so much that
any stretch of a quarter more than the template's length lies wholly in one.
A window and a template meet if one of ``BANDS`` bands of one MinHash sample
each agrees. A window that holds four fifths of a template has a similarity of
``least_similarity`` or more to it by construction, so it is missed with
probability (1 - that) ** BANDS: below 1e-5 for every template here, which
``miss_probability`` tells and a test asserts.

What is met is verified exactly: of a template's shingles, 80 of 100 must
occur in the window. Windows of one template that overlap are one match.

The templates are a fixed list of a few kB; the scan is one pass over the
texts without a shuffle. Many texts are hashed together; shingles across two
texts never match. A text of more than ``CHUNK`` words goes in stretches that
overlap by two of the largest windows, so memory doesn't depend on its length
(but for its own bytes) and every window lies wholly in one stretch.

Defined cases: null and empty texts match nothing; repeated rows match alike;
a very long text is scanned whole; ties between templates are all reported; an
empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64
from .license_texts import TEMPLATES
from .near_dedup import Hashes

SHINGLE, PERCENT, BANDS = 5, 80, 48
#: Words hashed together; bounds memory.
CHUNK = 1 << 16

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_rng = np.random.default_rng(20240307)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower())


def stretches_of(text: str, most: int, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text, ``most`` at a time and with the last ``overlap`` before them, and the number of the first."""
    words = (m[0] for m in _WORD.finditer(text.encode("utf-8", "replace").lower()))
    held = list(islice(words, most))
    start = 0
    while held:
        yield start, held
        new = list(islice(words, most))
        if not new:
            break
        start += max(0, len(held) - overlap)
        held = held[-overlap:] + new


def _samples(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h[None, :] * _MULTIPLIERS[:, None] + _ADDENDS[:, None]


def window_shape(size: int) -> tuple[int, int]:
    """(step, steps in a window) for templates of that many shingles; steps are powers of two."""
    step = 1 << max(0, (size // 2).bit_length() - 1)
    return step, -(-(size + size // 4 + step) // step)


def least_similarity(size: int, percent: int = PERCENT) -> float:
    """Of a window and a template of that many shingles, of which the window holds ``percent`` of 100."""
    step, steps = window_shape(size)
    held = -(-percent * size // 100)
    return held / (step * steps + size - held)


def miss_probability(size: int) -> float:
    return (1 - least_similarity(size)) ** BANDS


class Scanner:
    def __init__(self, templates: dict[tuple[str, str], str] = TEMPLATES, percent: int = PERCENT) -> None:
        self.words, self.percent = Hashes(), percent
        self.templates = []
        for (name, kind), text in templates.items():
            h, _, whole = self._shingles([words_of(text)])
            h = np.unique(h[whole])
            self.templates.append((name, kind, h, _samples(h).min(1), len(words_of(text)) < SHINGLE))
        self.sizes = sorted({len(t[2]) for t in self.templates})
        shapes = [window_shape(n) for n in self.sizes]
        #: Of two stretches: a window of any size and place lies in one of them.
        self.overlap = max(step * (steps + 1) for step, steps in shapes) + SHINGLE
        self.overlap += -self.overlap % max(step for step, _ in shapes)

    def _shingles(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingle hashes of texts end to end, where each text starts, and which are whole. One place a word; those across two texts match nothing."""
        lens = np.array([len(t) for t in texts])
        first = np.cumsum(lens) - lens
        total = int(lens.sum())
        ids = np.fromiter((self.words[w] for t in texts for w in t), np.int64, total)
        self.words.grow()
        h = np.concatenate([self.words.values[ids], np.zeros(SHINGLE, np.uint64)])
        left = np.repeat(first + lens, lens) - np.arange(total)  # words to the end of the text
        with np.errstate(over="ignore"):
            out = np.zeros(total, np.uint64)
            for k in range(SHINGLE):
                out += np.where(left > k, h[k : k + total] * _PLACE[k], np.uint64(0))
            out = mix64(out + np.uint64(SHINGLE))
            # Only a text shorter than a shingle has a short one, its first.
            whole = (left >= SHINGLE) | ((np.repeat(lens, lens) < SHINGLE) & (left == np.repeat(lens, lens)))
            out[~whole] = mix64(np.flatnonzero(~whole).astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return out, first, whole

    def scan(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text its matches: licence, kind, start, end (words), held, of."""
        out: list[list[tuple]] = [[] for _ in texts]
        group: list[tuple[int, int, list[bytes]]] = []
        held = 0
        for i, text in enumerate(texts):
            for start, words in stretches_of(text or "", max(CHUNK, 2 * self.overlap), self.overlap):
                group.append((i, start, words))
                held += len(words)
                if held >= CHUNK:
                    self._group(group, out)
                    group, held = [], 0
        if group:
            self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, int, list[bytes]]], out: list[list[tuple]]) -> None:
        h, first, _ = self._shingles([w for _, _, w in group])
        met = self._retrieve(h)
        ends = np.append(first[1:], len(h))
        for t, a, b in met:
            name, kind, own, _, short = self.templates[t]
            for d in range(np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b - 1, "right")):
                lo, hi = max(a, first[d]), min(b, ends[d])
                if lo >= hi:
                    continue
                at = np.flatnonzero(np.isin(h[lo:hi], own))
                if not len(at):
                    continue
                found = len(np.unique(h[lo:hi][at]))
                if 100 * found >= self.percent * len(own):
                    i, before, words = group[d]
                    start, end = int(lo + at[0] - first[d]), int(min(lo + at[-1] + (len(words) if short else SHINGLE), ends[d]) - first[d])
                    self._add(out[i], (name, kind, before + start, before + end, found, len(own)))
        self.words.start()

    @staticmethod
    def _add(matches: list[tuple], new: tuple) -> None:
        """A window that overlaps a match of its template extends it; those before the last matter where stretches overlap."""
        for i in range(len(matches) - 1, -1, -1):
            old = matches[i]
            if old[:2] == new[:2]:
                if new[2] < old[3] and old[2] < new[3]:
                    matches[i] = (*old[:2], min(old[2], new[2]), max(old[3], new[3]), max(old[4], new[4]), old[5])
                    return
                if old[3] <= new[2]:
                    break
        matches.append(new)

    def _retrieve(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, window start, window end) of each window that shares a band with a template."""
        n = len(h)
        met = []
        level, least = 1, _samples(h)
        for size in self.sizes:
            step, steps = window_shape(size)
            while level < step:
                if least.shape[1] % 2:
                    least = np.concatenate([least, np.full((BANDS, 1), np.iinfo(np.uint64).max, np.uint64)], 1)
                least = np.minimum(least[:, ::2], least[:, 1::2])
                level *= 2
            windows = max(1, least.shape[1] - steps + 1)
            low = least[:, :windows].copy()
            for k in range(1, min(steps, least.shape[1])):
                tail = least[:, k : k + windows]
                np.minimum(low[:, : tail.shape[1]], tail, out=low[:, : tail.shape[1]])
            for t, (_, _, own, sample, _) in enumerate(self.templates):
                if len(own) == size:
                    for w in np.flatnonzero((low == sample[:, None]).any(0)):
                        met.append((t, int(w) * step, min(int(w) * step + step * steps, n)))
        return met


_MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("n_held", T.LongType()), T.StructField("n_shingles", T.LongType())]))


def matches_udf(templates: dict[tuple[str, str], str] | None = None, percent: int = PERCENT):
    @F.pandas_udf(_MATCHES)
    def matches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates or TEMPLATES, percent)
        for texts in parts:
            yield pd.Series([[dict(zip(_MATCHES.elementType.names, m, strict=True)) for m in found] for found in scanner.scan(list(texts))])

    return matches


def scan(docs: DataFrame, templates: dict[tuple[str, str], str] | None = None, percent: int = PERCENT) -> DataFrame:
    """A row for each match: doc_id, license, kind, start_word, end_word, n_held, n_shingles, containment."""
    found = docs.select("doc_id", F.explode(matches_udf(templates, percent)(F.col("text"))).alias("m"))
    return found.select("doc_id", "m.*", (F.col("m.n_held") / F.col("m.n_shingles")).alias("containment"))
