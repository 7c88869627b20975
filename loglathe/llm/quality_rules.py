"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are counted in Arrow batches. From those of a
bounded sample of labelled documents, sequential covering grows conjunctions
of thresholds for low quality by FOIL gain, prunes them on rows kept apart,
and stops when no conjunction is precise enough. The list becomes one ordered
Spark ``CASE WHEN``, so the verdict on all documents runs in the JVM.

Defined cases: null text counts as empty (all statistics 0, base_failed);
repeated rows get equal verdicts; without labels of both classes the list is
empty and only the base rule rejects; a very long text is counted whole, at
some 100 bytes a word; an empty table gives an empty result;
other columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, q
from .samples import labelled_ids

#: Labelled documents of either class whose statistics the rules are learned from, at most.
PER_CLASS = 4000
MIN_WORDS = 50
MAX_RULES, MAX_CONDITIONS = 12, 4
MIN_PRECISION = 0.98
MIN_COVERED = 3
CUTS = 48

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
STATS_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in STATS])

#: Features of the rules, each as SQL over the statistics; none tells a text's length, which is no fault.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
}


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    number: dict[bytes, int] = {}
    return repeated(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))


def repeated(ids: np.ndarray) -> int:
    """The same over words' numbers."""
    n = len(ids)
    if n < 4:
        return 0
    most = int(ids.max()) + 1
    if most < 1 << 21:
        key = (ids[:-2] * most + ids[1:-1]) * most + ids[2:]
    else:  # too many for one number: number the pairs first
        _, pair = np.unique(ids[:-1] * most + ids[1:], return_inverse=True)
        key = pair[:-1] * most + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(_BLANK))
        else:
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (len(words), len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), len(lines), upper, text.count("!") + text.count("?"))


@F.pandas_udf(STATS_SCHEMA)
def stats_udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        yield pd.DataFrame([statistics(t) for t in texts], columns=list(STATS), dtype="int64")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def __call__(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] >= self.cut if self.at_least else rows[self.feature] <= self.cut

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] >= F.lit(self.cut) if self.at_least else features[self.feature] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.cut:.4g}"


def _covered(rule: list[Condition], rows: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(rows.values()))), bool)
    for c in rule:
        out &= c(rows)
    return out


def _cuts(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Midpoints where the class changes in sorted order, thinned evenly."""
    order = np.argsort(values, kind="stable")
    v, b = values[order], bad[order]
    change = np.flatnonzero((v[1:] > v[:-1]) & ((b[1:] != b[:-1]) | (np.arange(1, len(v)) % max(1, len(v) // 16) == 0)))
    if len(change) > CUTS:
        change = change[np.linspace(0, len(change) - 1, CUTS).astype(int)]
    return (v[change] + v[change + 1]) / 2


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, apart: np.ndarray) -> list[Condition]:
    """Grown by gain on the rows not kept apart; those kept apart have a say on what is precise."""
    rule: list[Condition] = []
    whole = live.copy()
    inside = live & ~apart
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, best_gain = None, (False, 1e-9)
        for feature, values in rows.items():
            for cut in _cuts(values[inside], bad[inside]):
                for at_least in (True, False):
                    c = Condition(feature, at_least, float(cut))
                    hit = inside & c(rows)
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    gain = (False, 0.0)
                    if p:  # a condition that is precise by itself goes before any that is not
                        every = whole & c(rows)
                        pe, ne = (every & bad).sum(), (every & ~bad).sum()
                        gain = (bool(pe >= MIN_COVERED and pe / (pe + ne) >= MIN_PRECISION), p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))))
                    if gain > best_gain:
                        best, best_gain = c, gain
        if best is None:
            break
        rule.append(best)
        inside &= best(rows)
        whole &= best(rows)
    return rule


def _prune(rule: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, apart: np.ndarray) -> list[Condition]:
    """Of the prefixes that are precise enough on all rows, the one worth most on those kept apart, then the shortest."""
    best, worth = [], -2.0
    for k in range(len(rule), 0, -1):
        hit = _covered(rule[:k], rows) & live
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if p < MIN_COVERED or p / (p + n) < MIN_PRECISION:
            continue
        p, n = (hit & apart & bad).sum(), (hit & apart & ~bad).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value >= worth:
            best, worth = rule[:k], value
    return best


def learn(rows: dict[str, np.ndarray], quality: np.ndarray, seed: int = 5) -> list[list[Condition]]:
    """Sequential covering for quality 0: an ordered list of conjunctions."""
    bad = quality == 0
    rules: list[list[Condition]] = []
    if not len(bad) or bad.all() or not bad.any():
        return rules
    apart = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    live = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (live & bad & ~apart).any():
        rule = _prune(_grow(rows, bad, live, apart), rows, bad, live, apart)
        if not rule:
            break
        hit = _covered(rule, rows) & live
        rules.append(rule)
        live &= ~hit
    return rules


def features(stats: dict[str, str] | None = None) -> dict[str, Column]:
    """The features as columns over statistics columns, which may carry other names."""
    out = {}
    for name, text in FEATURES.items():
        for c, own in (stats or {}).items():
            text = text.replace(c, f"`{own}`")
        out[name] = F.expr(f"cast({text} as double)")
    return out


def verdict(rules: list[list[Condition]], columns: dict[str, Column]) -> Column:
    """The decision list as one ordered conditional: the first rule that holds rejects, else keep."""
    out: Column | None = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(columns)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_from(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[list[Condition]]:
    ids = labelled_ids(labels, "quality", per_class)
    s = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", stats_udf(F.col("text")).alias("s")).select("doc_id", "y", "s.*")
    cols = [c.alias(n) for n, c in features().items()]
    # Of documents with equal doc_id the one whose features sort first, so 2 * per_class rows at most.
    s = s.select("doc_id", "y", F.struct(*cols).alias("f")).groupBy("doc_id", "y").agg(F.min("f").alias("f"))
    got = s.select("doc_id", "y", "f.*").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["y"].to_numpy())


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * 50)


def judge(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every document."""
    rules = learn_from(docs, labels, per_class)
    s = docs.select("doc_id", stats_udf(F.col("text")).alias("s")).select("doc_id", "s.*")
    s = s.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return s.withColumn("kept", ~F.col("base_failed") & verdict(rules, features()))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that neither the base rule nor the decision list rejects."""
    rules = learn_from(docs, labels, per_class)
    (s,) = fresh(docs, "stats")
    names = fresh(docs.withColumn(s, F.lit(0)), *STATS)
    d = docs.withColumn(s, stats_udf(F.col("text")))
    d = d.withColumns({n: q(s)[c] for n, c in zip(names, STATS, strict=True)})
    own = dict(zip(STATS, names, strict=True))
    ok = ~base_failed(q(own["n_words"]), q(own["n_repeat_words"])) & verdict(rules, features(own))
    return d.where(ok).select([q(c) for c in docs.columns])
