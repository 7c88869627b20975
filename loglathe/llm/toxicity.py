"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as two learned vectors side by side: one of the word itself
(words of the sample; others none) and the mean of the vectors of its
character n-grams (hashed, word ends marked), so spellings never seen still
say something. Two gated recurrent layers read a window forwards and
backwards, attention pools their states, and a logistic unit scores the
window. Windows of ``WINDOW`` words start every ``STEP`` words and cover every
whole text, so each place is seen in two windows; a text scores as its worst
window, through a shift fitted on the sample.

Training runs in numpy on a bounded sample of labelled documents
(``samples.PER_CLASS`` of either class). All vectors start at zero and are
learned through the network alone. As a label is of the text and not of a
window, a toxic text trains first through windows at random, then through
those that look worst so far; a clean one through windows at random and those
that look worst.

Defined cases: null and empty texts, and texts of blanks, have no window and
score 0; a very long text is read in stretches that share a window, so none is
missed; repeated rows score alike; without labels of both classes every text
scores 0; an empty table gives an empty result; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, is_held_out, words_in_parts
from .samples import PER_CLASS, labelled_texts
from .subwords import char_ngrams

WINDOW, STEP = 24, 12
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 16, 16, 8, 8
CHAR_BUCKETS, CHAR_SIZES = 1 << 15, (3, 4, 5, 6, 8)
#: How much more the n-grams at the front of a word count than others.
FRONT = 4.0
MAX_VOCABULARY, MIN_DOCS = 30_000, 2
#: Learning rates, of the vectors (plain descent) and of all else (Adam).
VECTOR_RATE, RATE = 20.0, 0.02
ROUNDS, STEPS, BATCH = 3, 150, 128
#: Words whose n-grams are computed together; words of a long text that are read together.
WORDS_AT_ONCE, STRETCH = 1 << 14, STEP << 14
#: Windows scored at once; bounds the memory of scoring.
CHUNK = 4096
THRESHOLD = 0.5
#: Where in the gap between the sample's clean and toxic texts 0.5 lies; clean texts never seen reach further than the sample's.
NEAR_TOXIC = 0.75
_H3 = 3 * HIDDEN
_F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and shares of the words' character n-grams, word after word, and where each word's start; a word's shares sum to 1."""
    parts, lens = [], []
    for a in range(0, len(words), WORDS_AT_ONCE):
        part = words[a : a + WORDS_AT_ONCE]
        grams, owner, front = char_ngrams(part, CHAR_SIZES, CHAR_BUCKETS)
        weight = np.where(front, FRONT, 1.0)
        share = weight / np.maximum(np.bincount(owner, weight, len(part)), 1)[owner]
        order = np.argsort(owner, kind="stable")
        parts.append((grams[order].astype(np.int32), share[order].astype(_F32)))
        lens.append(np.bincount(owner, minlength=len(part)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, _F32), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.append(0, np.cumsum(np.concatenate(lens)))


def window_starts(n: int) -> list[int]:
    """Starts of windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STEP))
    return [*starts, n - WINDOW]


def windows_of(ids: np.ndarray, pad: int) -> np.ndarray:
    """(windows, WINDOW) of word numbers; only a text shorter than a window is padded."""
    n = len(ids)
    if n < WINDOW:
        return np.concatenate([ids, np.full(WINDOW - n, pad, ids.dtype)])[None, :] if n else np.zeros((0, WINDOW), ids.dtype)
    return ids[np.array(window_starts(n))[:, None] + np.arange(WINDOW)]


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    shift: float = 0.0
    seen: dict[str, tuple] = field(default_factory=dict)

    @classmethod
    def new(cls, vocabulary: dict[bytes, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(_F32)
        p = {"word": np.zeros((len(vocabulary) + 1, WORD_DIM), _F32), "char": np.zeros((CHAR_BUCKETS, CHAR_DIM), _F32)}
        for d in "fb":
            p |= {f"wx_{d}": normal(WORD_DIM + CHAR_DIM, _H3), f"wh_{d}": normal(HIDDEN, _H3), f"b_{d}": np.zeros(_H3, _F32)}
        p |= {"wa": normal(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, _F32), "va": normal(ATTEND), "wo": normal(2 * HIDDEN), "bo": np.zeros(1, _F32)}
        return cls(vocabulary, p)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input vector of each word; a last row of zeros is for padding."""
        x = np.zeros((len(words) + 1, WORD_DIM + CHAR_DIM), _F32)
        x[:-1, :WORD_DIM] = self.p["word"][np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))]
        for a in range(0, len(words), WORDS_AT_ONCE):
            part = words[a : a + WORDS_AT_ONCE]
            grams, share, first = grams_of(part)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                x[a + some, WORD_DIM:] = np.add.reduceat(self.p["char"][grams] * share[:, None], first[some])
        return x

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wx_f"] + self.p["b_f"], x @ self.p["wx_b"] + self.p["b_b"]

    def score(self, ids: np.ndarray, gf: np.ndarray, gb: np.ndarray, pad: int) -> np.ndarray:
        """The logit of each window; gf and gb are the words' gate inputs."""
        out = np.empty(len(ids), _F32)
        for a in range(0, len(ids), CHUNK):
            part = np.ascontiguousarray(ids[a : a + CHUNK].T)
            real = part != pad
            mask = None if real.all() else real
            states = np.concatenate([self._read(part, gf, "f", mask)[0], self._read(part, gb, "b", mask)[0]], 2)
            out[a : a + CHUNK] = self._pool(states, mask)[0]
        return out

    def _read(self, ids: np.ndarray, gates: np.ndarray, d: str, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of one direction, (WINDOW, windows, HIDDEN), and what going back needs."""
        wh = self.p[f"wh_{d}"]
        h = np.zeros((ids.shape[1], HIDDEN), _F32)
        states = np.empty((ids.shape[0], ids.shape[1], HIDDEN), _F32)
        kept = []
        for t in range(ids.shape[0]) if d == "f" else range(ids.shape[0] - 1, -1, -1):
            g, u = gates[ids[t]], h @ wh
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if mask is not None:
                new *= mask[t][:, None]
            if keep:
                kept.append((t, h, z, r, n, u[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states, kept

    def _pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple:
        u = np.tanh(states @ self.p["wa"] + self.p["ba"])
        s = u @ self.p["va"]
        if mask is not None:
            s = np.where(mask, s, _F32(-1e9))
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        c = np.einsum("tb,tbh->bh", a, states)
        return c @ self.p["wo"] + self.p["bo"][0], u, a, c

    def gradients(self, ids: np.ndarray, y: np.ndarray, words: tuple) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of windows (word numbers of ``words``, below 0 for padding) with labels y, and its gradient by parameter."""
        vocab, grams, shares, first = words
        own = np.unique(ids[ids >= 0])
        local = np.searchsorted(own, ids)
        local[ids < 0] = len(own)
        x = np.zeros((len(own) + 1, WORD_DIM + CHAR_DIM), _F32)
        x[:-1, :WORD_DIM] = self.p["word"][vocab[own]]
        lens = first[own + 1] - first[own]
        owner = np.repeat(np.arange(len(own)), lens)
        at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(first[own], lens)
        flat, share = grams[at], shares[at]
        for d in range(CHAR_DIM):
            x[:-1, WORD_DIM + d] = np.bincount(owner, share * self.p["char"][flat, d], len(own))
        gf, gb = self.gates(x)
        part = np.ascontiguousarray(local.T)
        mask = part != len(own)
        sf, kf = self._read(part, gf, "f", mask, True)
        sb, kb = self._read(part, gb, "b", mask, True)
        states = np.concatenate([sf, sb], 2)
        logit, u, a, c = self._pool(states, mask)
        loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit).astype(float))))
        grad: dict[str, np.ndarray] = {}
        dl = ((_sigmoid(logit) - y) / len(y)).astype(_F32)
        grad["wo"], grad["bo"] = c.T @ dl, np.array([dl.sum()], _F32)
        dc = dl[:, None] * self.p["wo"]
        da = np.einsum("bh,tbh->tb", dc, states)
        ds = a * (da - (a * da).sum(0))
        grad["va"] = np.einsum("tb,tba->a", ds, u)
        du = ds[:, :, None] * self.p["va"] * (1 - u * u)
        grad["wa"], grad["ba"] = np.einsum("tbh,tba->ha", states, du), du.sum((0, 1))
        back = a[:, :, None] * dc + du @ self.p["wa"].T
        dx = np.zeros_like(x)
        for d, kept, gs in (("f", kf, back[:, :, :HIDDEN]), ("b", kb, back[:, :, HIDDEN:])):
            wh, gwh, dg = self.p[f"wh_{d}"], np.zeros((HIDDEN, _H3), _F32), np.zeros((len(own) + 1, _H3), _F32)
            dh = np.zeros((len(y), HIDDEN), _F32)
            for t, h, z, r, n, un in reversed(kept):
                g = (dh + gs[t]) * mask[t][:, None]
                dn = g * (1 - z) * (1 - n * n)
                dz = g * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                gate = np.concatenate([dz, dr, dn], 1)
                hidden = np.concatenate([dz, dr, dn * r], 1)
                gwh += h.T @ hidden
                dh = g * z + hidden @ wh.T
                np.add.at(dg, part[t], gate)
            grad[f"wh_{d}"], grad[f"b_{d}"], grad[f"wx_{d}"] = gwh, dg.sum(0), x.T @ dg
            dx += dg @ self.p[f"wx_{d}"].T
        dx = dx[:-1]
        rows = vocab[own]
        gw = np.zeros_like(self.p["word"])
        np.add.at(gw, rows, dx[:, :WORD_DIM])
        gw[-1] = 0  # words outside the vocabulary stay at zero
        grad["word"] = gw
        dx = dx[:, WORD_DIM:]
        grad["char"] = np.stack([np.bincount(flat, share * dx[owner, d], CHAR_BUCKETS) for d in range(CHAR_DIM)], 1).astype(_F32)
        return loss, grad

    def train(self, ids: np.ndarray, y: np.ndarray, words: tuple, rate: float) -> None:
        """One step, by Adam but for the vectors."""
        grad = self.gradients(ids, y, words)[1]
        for k in ("word", "char"):  # plain descent: what many windows share moves more than what one holds
            self.p[k] -= _F32(VECTOR_RATE * rate / RATE) * grad.pop(k)
        for k, g in grad.items():
            m, v, n = self.seen.get(k) or (np.zeros_like(g), np.zeros_like(g), 0)
            m, v, n = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, n + 1
            self.seen[k] = (m, v, n)
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6)).astype(_F32)


def fit(texts: list[bytes], labels: list[int], seed: int = 3) -> Network | None:
    """The network trained on whole texts with labels 0 and 1; None unless both occur."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    number: dict[bytes, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in t.lower().split()), np.int32) for t in texts]
    words = list(number)
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(words))
    common = np.argsort(-df, kind="stable")[:MAX_VOCABULARY]
    vocabulary = {words[i]: k for k, i in enumerate(common[df[common] >= MIN_DOCS])}
    net = Network.new(vocabulary, seed)
    table = (np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words)), *grams_of(words))

    windows = [windows_of(d, -1) for d in docs]
    counts = np.array([len(w) for w in windows])
    of, every = np.repeat(np.arange(len(docs)), counts), np.concatenate(windows)
    starts = np.append(0, np.cumsum(counts))
    toxic_docs, clean = np.flatnonzero((y == 1) & (counts > 0)), np.flatnonzero(y[of] == 0)
    if not len(toxic_docs) or not len(clean):
        return None
    worst: np.ndarray | None = None
    for turn in range(ROUNDS):
        if worst is None:  # any window of a toxic text, each text alike
            toxic, hard = np.flatnonzero(y[of] == 1), clean
            chance = 1 / counts[of[toxic]] / len(toxic_docs)
        else:
            toxic, chance = _suspects(worst, starts, toxic_docs, turn > 1), None
            hard = clean[np.argsort(-worst[clean], kind="stable")[: max(64, len(clean) // 20)]]
        for step in range(STEPS):
            pick = np.concatenate([rng.choice(toxic, BATCH // 2, p=chance), rng.choice(hard, BATCH // 4), rng.choice(clean, BATCH // 4)])
            net.train(every[pick], (y[of[pick]]).astype(_F32), table, RATE * (1 - 0.7 * step / STEPS) / (1 + turn))
        gf, gb = net.gates(net.inputs(words))
        worst = net.score(every, gf, gb, -1)
    net.shift = _calibrate(np.array([worst[starts[i] : starts[i + 1]].max() if counts[i] else -20 for i in range(len(docs))]), y)
    net.seen = {}
    return net


def _suspects(worst: np.ndarray, starts: np.ndarray, toxic_docs: np.ndarray, several: bool) -> np.ndarray:
    """The windows that toxic texts train through: the worst of each, or several of those that look bad.

    Some texts marked toxic hold nothing that tells; learning them by heart
    would flag clean ones, so those whose worst window looks best are left out.
    """
    peak = np.array([worst[starts[i] : starts[i + 1]].max() for i in toxic_docs])
    enough = min(0.0, np.quantile(peak, 0.5)) if several else np.quantile(peak, 0.2)
    out = []
    for i in toxic_docs[peak >= enough]:
        mine = np.arange(starts[i], starts[i + 1])
        out.append(mine[np.argsort(-worst[mine], kind="stable")[: 1 + (several and int((worst[mine] > 2).sum()) // 2)]])
    return np.concatenate(out)


def _calibrate(top: np.ndarray, y: np.ndarray) -> float:
    """The shift after which 0.5 lies in the gap where least is wrong; a clean text flagged counts three times."""
    order = np.argsort(top, kind="stable")
    s, t = top[order], y[order]
    wrong = np.concatenate([[3 * (t == 0).sum()], 3 * ((t == 0).sum() - np.cumsum(t == 0)) + np.cumsum(t == 1)])
    best = np.flatnonzero(wrong == wrong.min())
    k = best[len(best) // 2]
    clean, toxic = s[max(k - 1, 0)], s[min(k, len(s) - 1)]
    return float(-(clean + NEAR_TOXIC * (toxic - clean)))


class _Scorer(WordTable):
    limit = 150_000

    def __init__(self, net: Network) -> None:
        self.net = net
        self.reset()
        super().__init__()

    def reset(self) -> None:
        self.used = 0
        self.gf = self.gb = np.zeros((1, _H3), _F32)

    def grow(self) -> None:
        """Row ``used`` of the gates is the padding word's."""
        if self.fresh:
            gf, gb = self.net.gates(self.net.inputs(self.fresh))
            for name, new in (("gf", gf), ("gb", gb)):
                have = getattr(self, name)
                if len(have) < self.used + len(new):
                    more = np.empty((max(2 * len(have), self.used + len(new)), _H3), _F32)
                    more[: self.used] = have[: self.used]
                    setattr(self, name, more)
                getattr(self, name)[self.used : self.used + len(new)] = new
            self.used += len(self.fresh)
            self.fresh = []

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; texts go through the network together, ``CHUNK`` windows or so at once."""
        top = np.full(len(texts), -np.inf)
        group: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            before: list[bytes] = []
            for part in words_in_parts(text, STRETCH, lower=True):
                words = before + part  # the window that ends a stretch opens the next
                before = words[-WINDOW:]
                ids = windows_of(np.fromiter(map(self.__getitem__, words), np.int32, len(words)), -1)
                group.append((i, ids))
                held += len(ids)
                if held >= CHUNK:
                    self._flush(group, top)
                    group, held = [], 0
        self._flush(group, top)
        return np.where(np.isfinite(top), 1 / (1 + np.exp(-np.clip(top + self.net.shift, -500, 500))), 0.0)

    def _flush(self, group: list[tuple[int, np.ndarray]], top: np.ndarray) -> None:
        if group:
            self.grow()
            ids = np.concatenate([g[1] for g in group])
            ids = np.where(ids < 0, self.used, ids)
            if self.used >= len(self.gf):
                self.gf, self.gb = (np.concatenate([g, np.zeros((1, _H3), _F32)]) for g in (self.gf, self.gb))
            logit = self.net.score(ids, self.gf, self.gb, self.used)
            first = np.cumsum([0] + [len(g[1]) for g in group[:-1]])
            np.maximum.at(top, [g[0] for g in group], np.maximum.reduceat(logit, first))
        self.start()


def scorer(net: Network | None):
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _Scorer(net) if net else None
        for texts in parts:
            yield pd.Series(own.score(list(texts)) if net else np.zeros(len(texts)))

    return score


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(fit(*labelled_texts(docs, labels, "toxic", per_class)))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
