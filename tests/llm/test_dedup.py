"""Near-dedup, line dedup and mixing against brute force."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from loglathe.llm import line_dedup, mixing, near_dedup


def brute_components(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.fixture(scope="module")
def corpus(vocabulary):
    rng = random.Random(9)
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = []
    for base in (pick(60), pick(200), pick(1500)):
        for edits in (0, 0, 1, 2, 3, 5, 8, 12, 20):
            w = list(base)
            for _ in range(edits * len(base) // 200 + (edits > 0)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w))
    chain = pick(100)  # each near the next, the ends far apart
    for k in range(8):
        docs.append(" ".join(chain[4 * k :] + pick(4 * k)))
    docs += [" ".join(pick(80)) for _ in range(20)] + ["", "  \n", None, "two words", "Two  WORDS", "one"]
    rows = [(3 * i, t) for i, t in enumerate(docs)]
    return [*rows, rows[0], (None, docs[0]), (None, None)]


def test_near_dedup(make_docs, corpus):
    docs = make_docs(corpus)
    got = near_dedup.mark(docs, 4, 80).collect()
    want, sizes = brute_components(corpus, 4, 80)
    assert len(got) == len(corpus)
    for r in got:
        assert r.component_id == want.get(r.doc_id, r.doc_id)
        assert r.kept == (r.doc_id == r.component_id or r.doc_id is None)
        if r.doc_id is not None:
            assert r.n_shingles == sizes.get(r.doc_id, 0)


def test_drop_near(make_docs, corpus):
    docs = make_docs(corpus)
    kept = near_dedup.drop_near(docs)
    want, _ = brute_components(corpus, 5, 80)
    assert kept.columns == docs.columns
    left = sorted([r.doc_id for r in kept.collect()], key=str)
    assert left == sorted([i for i, _ in corpus if i is None or want.get(i, i) == i], key=str)
    assert near_dedup.drop_near(make_docs([])).count() == 0


def test_intermediate_tables_go(spark, make_docs, corpus):
    """A run leaves no more than what its result reads."""
    from loglathe.llm.common import shared_dir

    top = Path(shared_dir(spark).removeprefix("file://")) / "loglathe" / spark.sparkContext.applicationId
    before = set(top.glob("*")) if top.exists() else set()
    kept = near_dedup.drop_near(make_docs(corpus))
    left = {p.name.rsplit("-", 1)[0] for p in set(top.glob("*")) - before}
    assert left <= {"near-dropped", "members", "profiles", "comps"} and kept.count()


def test_sketches_never_rule_out_what_is_similar(spark, vocabulary):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows, words = [], near_dedup.Hashes()
    for n in (20, 300, 900, 1100, 5000):
        for _ in range(12):
            base = [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
            other = list(base)
            for at in rng.integers(0, n, max(1, n // 42)):
                other[at] = vocabulary[rng.integers(0, len(vocabulary))]
            sets = [words.shingles(" ".join(x), 5) for x in (base, other)]
            row = [near_dedup.similar(*sets, 80)]
            for s in sets:
                row += [len(s), near_dedup.odd_sketch(s).tolist()]
            rows.append(row)
    df = spark.createDataFrame(rows, "near boolean, n_x long, sketch_x array<long>, n_y long, sketch_y array<long>")
    def with_sides(df):
        sides = [near_dedup.emptiness(F.col(f"n_{x}"), 80) for x in "xy"]
        return df.withColumns({f"{c}_{x}": e for x, s in zip("xy", sides) for c, e in zip(("empty", "root"), s)})

    out = with_sides(df).select("near", near_dedup.may_be_similar("x", "y", 80).alias("may")).collect()
    assert sum(r.near for r in out) > 20 and all(r.may for r in out if r.near)
    far = [words.shingles(" ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n)), 5) for n in (300, 300, 9000, 9000)]
    rows = [(len(a), near_dedup.odd_sketch(a).tolist(), len(b), near_dedup.odd_sketch(b).tolist()) for a, b in (far[:2], far[2:])]
    df = spark.createDataFrame(rows, "n_x long, sketch_x array<long>, n_y long, sketch_y array<long>")
    assert not any(r[0] for r in with_sides(df).select(near_dedup.may_be_similar("x", "y", 80)).collect())


def test_long_texts_are_hashed_whole(vocabulary, monkeypatch):
    rng = random.Random(1)
    words = [rng.choice(vocabulary) for _ in range(900)]
    want = near_dedup.Hashes().shingles(" ".join(words), 4)
    assert len(near_dedup.Hashes().shingles("a b c d e f g " * 300_000 + "end", 4)) == 8
    monkeypatch.setattr(near_dedup, "AT_ONCE", 7)
    assert (near_dedup.Hashes().shingles("\n".join(words), 4) == want).all()


def brute_lines(docs):
    """doc_id -> text without later three-line windows; docs in order of id, equal rows alike."""
    seen, out = set(), {}
    for i, t in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        if t is None:
            out[i, t] = None
            continue
        lines = t.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a, b, c in zip(filled, filled[1:], filled[2:]):
            w = (lines[a], lines[b], lines[c])
            if w in seen:
                gone.update(range(a, c + 1))
            seen.add(w)
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(make_docs):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        lines = [rng.choice(["alpha", "beta", "gamma", "delta", "", " ", f"line {rng.randrange(9)}"]) for _ in range(rng.randrange(14))]
        docs.append((i, "\n".join(lines)))
    docs += [(60, None), (61, ""), (62, "\n\n\n"), (63, "a\nb\nc\na\nb\nc\na\nb\nc"), (64, "x\r\ny\r\nz"), (65, "x\r\ny\r\nz"), docs[5], (None, "q\nr\ns"), (66, "a\n\nb\n\nc")]
    frame = make_docs(docs)
    got = line_dedup.dedup_lines(frame)
    assert got.columns == frame.columns
    want = brute_lines(docs)
    before = defaultdict(set)
    for i, t in docs:
        before[i].add(t)
    for r in got.collect():
        assert r.text in {want[r.doc_id, t] for t in before[r.doc_id]}, r.doc_id
        assert r.n_chars == (len(r.text) if r.text is not None else 0)
    assert got.count() == len(docs)
    assert line_dedup.dedup_lines(make_docs([])).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(3 * sizes[s]) for s in over}
        free -= over
    return target


def test_mixing(make_docs):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randrange(40))) for i in range(300)]
    docs += [(300, None), (301, ""), docs[7], docs[7], (None, "w w w")]
    names = ["big"] * 12 + ["mid", "small", "z", None]
    frame = make_docs(docs, names)
    got = mixing.mix(frame).collect()
    assert len(got) == len(docs)
    source = {(r.doc_id): r.source for r in frame.collect()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        targets[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 3
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(frame.repartition(7)).collect()))
    mixed = mixing.apply_mix(frame)
    assert mixed.columns == frame.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - taken[s]) <= 3 for s in sizes)
    assert mixing.mix(make_docs([])).count() == 0 and mixing.apply_mix(make_docs([])).count() == 0
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()


def test_very_long_texts_native(make_docs):
    """Half a million lines and three million words in one row."""
    lines = "\n".join(f"line {i} of it" for i in range(300_000))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make_docs([(1, lines), (2, "line 7 of it\nline 8 of it\nline 9 of it\nown end")]), counts=True).collect()}
    assert got[1].text == lines and got[1].n_lines == 300_000 and got[2].text == "own end" and got[2].n_removed == 3
    assert mixing.mix(make_docs([(1, "w " * 2_000_000), (2, "w")], ["a"])).agg({"size": "sum"}).first()[0] == 2_000_001
