"""Classifiers, rules and licence scans."""

import random
import re
import tracemalloc
from zlib import crc32

import numpy as np
import pytest

from loglathe.llm import license_texts, licenses, quality_model, quality_rules, samples, toxicity

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in labels.collect()}


# Few rows are both toxic and held out at this size; README has the figures of sf0.1.
@pytest.mark.parametrize(("module", "target", "least"), [(toxicity, "toxic", 0.75), (quality_model, "quality", 0.9)])
def test_held_out_accuracy(tables, module, target, least):
    docs, labels, truth = tables
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    rows = [(r.score, truth[r.doc_id][target]) for r in got if r.held_out and r.doc_id in truth]
    one, two = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    better = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in two])
    assert better >= least, better


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_odd_inputs(spark, make_docs, tables, module):
    docs = make_docs([(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "b"), (5, "word " * 30_000)])
    got = module.classify(docs, tables[1].limit(0)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert module.classify(make_docs([]), tables[1]).count() == 0
    clash = docs.withColumnsRenamed({"__js": "score", "n_words": "predicted"}).withColumn("held_out", docs.text)
    assert sorted(map(str, module.classify(clash, tables[1].limit(0)).collect())) == sorted(map(str, got))


def test_training_tells_vocabularies_apart():
    rng = random.Random(1)
    good, bad = [b"calm", b"river", b"stone"], [b"vile", b"scum", b"filth"]
    texts = [b" ".join(rng.choice(good) for _ in range(60)) for _ in range(80)]
    texts += [t[:100] + b" " + b" ".join(rng.choice(bad) for _ in range(8)) + b" " + t[100:] for t in texts[:40]]
    net = toxicity.fit(texts, [0] * 80 + [1] * 40)
    scores = toxicity._Scorer(net).score(["calm river stone " * 20, "calm river " * 10 + "vile scum filth vile scum " + "stone " * 20, None, ""])
    assert scores[0] < 0.5 < scores[1] and scores[2] == scores[3] == 0


@pytest.fixture
def small_net():
    """A network of random vectors in double precision, its words and their table."""
    words = [f"w{i}".encode() for i in range(9)] + [b"\xc3\xa9t\xc3\xa9", b"a"]
    net = toxicity.Network.new({w: i for i, w in enumerate(words[:6])}, 1)
    rng = np.random.default_rng(4)
    for k, v in net.p.items():
        net.p[k] = rng.normal(0, 0.4, v.shape)
    net.p["word"][-1] = 0
    return net, words, (np.array([net.vocabulary.get(w, -1) for w in words]), *toxicity.grams_of(words))


def naive_logit(net, words):
    """The network by its formulas, one number or one step at a time."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    xs = []
    for w in words:
        buckets, _, front = toxicity.char_ngrams([w], toxicity.CHAR_SIZES, toxicity.CHAR_BUCKETS)
        share = [toxicity.FRONT if f else 1.0 for f in front]
        chars = sum((s * p["char"][b] for s, b in zip(share, buckets)), np.zeros(toxicity.CHAR_DIM)) / max(sum(share), 1)
        xs.append(np.concatenate([p["word"][net.vocabulary.get(w, -1)], chars]))
    states = [[None, None] for _ in words]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for side, d in enumerate("fb"):
        s = np.zeros(h)
        for t in range(len(xs)) if d == "f" else reversed(range(len(xs))):
            g, u = xs[t] @ p[f"wx_{d}"] + p[f"b_{d}"], s @ p[f"wh_{d}"]
            z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
            n = np.tanh(g[2 * h :] + r * u[2 * h :])
            s = states[t][side] = (1 - z) * n + z * s
    both = [np.concatenate(x) for x in states]
    e = np.exp([np.tanh(x @ p["wa"] + p["ba"]) @ p["va"] for x in both])
    return sum(a * x for a, x in zip(e / e.sum(), both)) @ p["wo"] + p["bo"][0]


def test_scores_equal_the_formulas(small_net):
    net, words, _ = small_net
    rng = random.Random(6)
    net.shift = -0.3
    for n in (1, 5, 24, 25, 60, 400):
        text = [rng.choice(words) for _ in range(n)]
        want = max(naive_logit(net, text[a : a + toxicity.WINDOW]) for a in toxicity.window_starts(n))
        got = toxicity._Scorer(net).score([b" ".join(text).upper().decode(), None])
        assert got[0] == pytest.approx(1 / (1 + np.exp(-(want - 0.3))), abs=1e-4) and got[1] == 0


def test_long_texts_are_read_whole(small_net, monkeypatch):
    net, words, _ = small_net
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words).decode() for _ in range(n)) for n in (47, 48, 49, 60, 61, 97, 500)]
    want = toxicity._Scorer(net).score(texts)
    monkeypatch.setattr(toxicity, "STRETCH", 48)
    assert np.allclose(toxicity._Scorer(net).score(texts), want, atol=1e-5)


def test_gradients(small_net):
    """Of every parameter against differences of the loss; one window is shorter than the others."""
    net, words, table = small_net
    rng = np.random.default_rng(3)
    ids = rng.integers(0, len(words), (4, toxicity.WINDOW))
    ids[2, 7:] = -1
    y = np.array([1.0, 0.0, 1.0, 0.0])
    loss, grad = net.gradients(ids, y, table)
    want = np.mean([np.log1p(np.exp(-(2 * t - 1) * naive_logit(net, [words[i] for i in row if i >= 0]))) for row, t in zip(ids, y)])
    assert loss == pytest.approx(want, rel=1e-4) and set(grad) == set(net.p)
    for k, g in grad.items():
        flat = np.argsort(-np.abs(g).ravel())[:4]
        for at in flat:
            i = np.unravel_index(at, g.shape)
            sides = []
            for step in (1e-2, -1e-2):
                keep = net.p[k][i]
                net.p[k][i] = keep + step
                sides.append(np.mean([np.log1p(np.exp(-(2 * t - 1) * naive_logit(net, [words[j] for j in row if j >= 0]))) for row, t in zip(ids, y)]))
                net.p[k][i] = keep
            assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(g[i], rel=0.02, abs=2e-5), k


def test_quality_scores_equal_brute_force(monkeypatch):
    """The mean of the weights of all words, pairs and n-grams, counted one by one."""
    rng = random.Random(2)
    weights = np.random.default_rng(2).normal(size=quality_model.BUCKETS)
    words = ["ab", "\xe9t\xe9", "x", "longer,", "AB"]
    scorer = quality_model._Scorer(weights)
    number = lambda w: crc32(w.encode()) % quality_model.BUCKETS
    for at_once in (1 << 18, 7):
        monkeypatch.setattr(quality_model, "AT_ONCE", at_once)
        for n in (0, 1, 2, 7, 8, 40):
            text = [rng.choice(words) for _ in range(n)]
            found = []
            for w in text:
                found.append(number(w))
                found += quality_model.char_ngrams([w.encode()], quality_model.SIZES, quality_model.BUCKETS)[0].tolist()
            found += [(number(b) - number(a)) % quality_model.BUCKETS for a, b in zip(text, text[1:])]
            assert scorer.mean("  ".join(text)) == pytest.approx(np.mean([weights[f] for f in found]) if found else 0)


@pytest.mark.parametrize("n", [0, 1, 5, 23, 24, 25, 36, 37, 100, 101])
def test_windows_cover_every_word(n):
    starts = toxicity.window_starts(n)
    seen = {k for a in starts for k in range(a, min(n, a + toxicity.WINDOW))}
    assert seen == set(range(n))


def brute_stats(text):
    text = text or ""
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        dup += x in seen and bool(x.strip(" \t\x0b\x0c\r"))
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics():
    rng = random.Random(2)
    texts = [None, "", " ", "a", "a b c a b c", "#$ <x> é ü\x1c日本", "x\n\nx\nx ", "a\tb\x0bc\x0cd\re"]
    texts += ["".join(rng.choice("ab #\n") for _ in range(rng.randrange(200))) for _ in range(60)]
    for t in texts:
        assert quality_rules.statistics(t)[:5] == brute_stats(t), t


def test_learned_list(spark):
    rng = np.random.default_rng(0)
    rows = {f: rng.random(900) for f in quality_rules.FEATURES}
    quality = 1 - ((rows["symbol_rate"] > 0.8) & (rows["upper_share"] < 0.5) | (rows["mark_rate"] > 0.9)).astype(int)
    rules = quality_rules.learn(rows, quality)
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= quality_rules._covered(rule, rows)
    # The CASE WHEN over statistics gives what the list gives row by row.
    stats = [(int(a), int(b), int(c), 0, 0, 1, int(d), int(e)) for a, b, c, d, e in rng.integers(0, 60, (300, 5))]
    frame = spark.createDataFrame(stats, quality_rules.STATS_SCHEMA)
    got = frame.select(*[c.alias(f) for f, c in quality_rules.features().items()], quality_rules.verdict(rules, quality_rules.features()).alias("kept")).toPandas()
    seen = {f: got[f].to_numpy(float) for f in quality_rules.FEATURES}
    rejected = np.zeros(len(got), bool)
    for rule in rules:
        rejected |= quality_rules._covered(rule, seen)
    assert (got["kept"].to_numpy() == ~rejected).all() and 0 < rejected.sum() < len(got)
    assert rules and (hit & (quality == 1)).mean() < 0.02 and hit[quality == 0].mean() > 0.8
    assert quality_rules.learn(rows, np.ones(900)) == []


def test_rules_on_tables(tables, make_docs):
    docs, labels, truth = tables
    got = quality_rules.judge(docs, labels).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        n, chars, symbols, dup, rep = quality_rules.statistics(text[r.doc_id])[:5]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.kept and r.base_failed)
    good = [r.kept for r in got if r.doc_id in truth and truth[r.doc_id].quality == 1 and not r.base_failed]
    assert np.mean(good) > 0.95
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    odd = make_docs([(1, None), (2, ""), (3, "w " * 60), (3, "w " * 60), (None, " ".join(map(str, range(80))))])
    assert [r.n_words for r in quality_rules.judge(odd, labels).orderBy("n_words").collect()] == [0, 0, 60, 60, 80]
    assert quality_rules.keep_good(odd, labels).columns == odd.columns
    assert quality_rules.judge(make_docs([]), labels).count() == 0
    long = make_docs([(1, "\n".join(" ".join(f"w{k}x{j}" for k in range(9)) for j in range(120_000)) + "\nagain and again and again and")])
    r = quality_rules.judge(long, labels).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (1_080_006, 6, False)


def test_samples_are_bounded(spark, make_docs):
    docs = make_docs([(2, "b"), (2, "a"), (2, None), (3, "x" * 100_000), (4, None), (7, "z")] * 3)
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (4, 0), (7, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    texts, y = samples.labelled_texts(docs, labels, "toxic")
    want = [(b"a", 1)] * (not held_out(2)) + [(b"x" * 100_000, 0)] * (not held_out(3))
    assert list(zip(texts, y)) == want and want


def test_band_settings_guarantee_collisions():
    assert all(licenses.miss_probability(n) < 1e-5 for n in licenses.Scanner().sizes)


def brute_containment(text, template):
    """The most of a template's shingles that any stretch of a quarter more than its length holds, and the template's size."""
    words, own = (re.findall(rb"[a-z0-9\x80-\xff]+", x.encode().lower()) for x in (text, template))
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    g, want = grams(words), set(grams(own))
    size = len(want) + len(want) // 4
    return max((len(want & set(g[a : a + size])) for a in range(max(1, len(g) - size + 1))), default=0), len(want)


def test_licences_equal_brute_force(vocabulary, monkeypatch):
    """Every stretch that holds four fifths is found, nothing that holds less; in parts of any length."""
    rng = random.Random(11)
    texts = []
    for (_, kind), text in license_texts.TEMPLATES.items():
        for edits in (0, 1, 2, 5):
            words = text.split()
            for _ in range(edits * len(words) // 60 if kind != "line" else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            pad = [rng.choice(vocabulary) for _ in range(rng.randrange(300))]
            texts.append(" ".join(pad + words + pad[: rng.randrange(300)]))
    texts += [" ".join(texts[:12]), texts[5] + " " + texts[5]]
    for chunk in (1 << 16, 1):
        monkeypatch.setattr(licenses, "CHUNK", chunk)
        scanner = licenses.Scanner()
        for text, found in zip(texts, scanner.scan(texts)):
            by = {f[:2]: f for f in sorted(found, key=lambda f: f[4])}
            for key, template in license_texts.TEMPLATES.items():
                held, size = brute_containment(text, template)
                if 100 * held >= 80 * size:
                    assert key in by and by[key][4] >= held, (key, chunk)
                elif key in by:  # a window is longer than the stretch
                    words = licenses.words_of(text)[by[key][2] : by[key][3]]
                    inside = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
                    own = licenses.words_of(template)
                    assert 100 * len(inside & {tuple(own[k : k + 5]) for k in range(len(own) - 4)}) >= 80 * size


def test_long_text_in_bounded_memory():
    """Fifty megabytes and two notices, of which one lies across a seam, in some hundred megabytes beyond the text's bytes."""
    notice = license_texts.TEMPLATES["ISC", "grant"]
    text = " ".join([*("filler%d" % (i % 977) for i in range(licenses.CHUNK - 12)), notice, *("longerfillerwords%d" % (i % 877) for i in range(2_500_000)), notice])
    tracemalloc.start()
    try:
        found = licenses.Scanner().scan([text])[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(text) > 50_000_000 and peak < 3 * len(text) + 150_000_000
    assert sorted({f[:2] for f in found}) == [("ISC", "grant")] and len(found) == 2 and all(f[4] == f[5] for f in found)


def test_licence_scan(make_docs, vocabulary):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, want = [], {}
    for i, ((name, kind), text) in enumerate(license_texts.TEMPLATES.items()):
        docs.append((i, f"{filler(rng.randrange(400))} {text.upper() if i % 2 else text} {filler(rng.randrange(400))}"))
        want[i] = (name, kind)
    docs += [docs[0], docs[0], (None, docs[1][1]), (905, text := " ".join([license_texts.TEMPLATES["MIT", "line"], license_texts.TEMPLATES["MIT", "line-2"]])), (905, text)]
    docs += [(900, filler(3000)), (901, None), (902, ""), (903, filler(40_000) + " " + license_texts.TEMPLATES["ISC", "grant"]), (904, "MIT License")]
    found = licenses.scan(make_docs(docs)).collect()
    by = {(r.doc_id, r.license, r.kind): r for r in found}
    for i, key in want.items():
        assert by[(i, *key)].containment == 1.0, key
    n_of = lambda i, key: sum((r.doc_id, r.license, r.kind) == (i, *key) for r in found)
    assert n_of(0, want[0]) == 3 and n_of(None, want[1]) == 1  # repeated rows match alike
    assert n_of(905, ("MIT", "line")) == n_of(905, ("MIT", "line-2")) == 2
    clash = make_docs(docs).withColumnsRenamed({"__js": "m", "n_words": "license"})
    assert licenses.scan(clash).count() == len(found)
    assert (903, "ISC", "grant") in by and not {r.doc_id for r in found} & {900, 901, 902, 904}
    assert licenses.scan(make_docs([])).count() == 0
