"""Top-k, packing and archives: brute force and round trips; then the pipeline."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from loglathe.llm import archives, packing, registry, topk

SF = "/root/testdata/sf0.001"


def brute_top(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append(np.floor(64 * np.array(v, float)).astype(np.int64))
    out = {}
    for q, vs in good.items():
        if q % every == 0:
            best = [(-max(int(a @ b) for a in vs for b in ws), i) for i, ws in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(best)[:k]]
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(scale=0.3, size=8)).astype(np.float32).tolist()) for i in range(n)]
    if n > 100:
        for i in range(100, 160):
            rows[i] = (i, rows[0][1])  # many equal vectors
        rows += [(n, None), (n + 1, [1.0] * 7 + [None]), (n + 2, [float("nan")] * 8), (None, [1.0] * 8), rows[40], (n + 3, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, embedding array<float>, dist double, cell string")
    got = defaultdict(list)
    for r in topk.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert dict(got) == {q: x for q, x in brute_top(rows, 20, 20).items() if x}


def test_clustered_vectors_are_mostly_skipped(spark, monkeypatch):
    """Of the blocks that a group of queries could meet, few are fetched where the data has clusters; the result stays exact."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 12))
    rows = [(i, (centre[i % 30] + rng.normal(scale=0.02, size=12)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "GROUP", 32)
    p = topk.prepare(df)
    assert p.groups.count() >= 300 // 32 and p.n_blocks >= 6000 // 64
    assert p.pairs.count() < 0.3 * p.groups.count() * p.n_blocks
    assert p.pairs.select("batch", "block").distinct().count() == p.pairs.count()
    got = defaultdict(list)
    for r in topk.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == brute_top(rows, 20, 20)


def test_packing(make_docs):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["plain words here", "", None, "tabs\tand\n\n  spaces  ", "it's we'll <|endoftext|> x", "日本 é ñ 123 456", "long text " * 3000, "x" * 5000, "a b " * 511, "a b " * 512]
    docs = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    docs += [(100 + i, "some words of text " * (1 + i % 170)) for i in range(300)]
    got = packing.pack(make_docs(docs)).collect()
    whole = defaultdict(list)
    for i, t in docs:
        whole[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(whole)
    for i, rows in pieces.items():
        assert sum(r.length for r in rows) == sum(map(len, whole[i]))
        for r in rows:
            cuts = [w[r.start : r.start + r.length] for w in whole[i]]
            assert r.ids_crc32 in [crc32(np.array(c, "<u4").tobytes()) for c in cuts]
        if len(whole[i][0]) <= 1024:
            assert all(r.piece == 0 for r in rows)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, sum(whole.values(), [])))
    assert len(bins) <= 1.03 * total / 1024 + 3
    assert packing.pack(make_docs([])).count() == 0


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4, 8, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert bins.place(6)[0] == 4  # closes sequence 2, the fullest
    assert bins.place(2)[0] != 2


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    pages = [(1, "http://a b/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nx 0 0 0 9\nfiledesc://"), (6, "é", "日本\r\n\r\n"), (7, "http://x\n", "<p>x</p>"), (5, "u", "twice"), (5, "u", "twice"), (None, "n", "n")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, page int")
    got = archives.convert(df, version).collect()
    best = defaultdict(list)
    for i, _, h in pages:
        if i is not None:
            best[h or ""].append(i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        top = max(best[h or ""], default=None)
        revisit = i is not None and i < top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert archives.convert(df.limit(0)).count() == 0


def test_arc_headers():
    blocks = [("http://a/", b"one\ntwo"), ("http://b/", b""), ("http://c/", b"http://d/ 0.0.0.0 2 text/html 3\nabc")]
    for version, fields in ((1, 5), (2, 10)):
        data = archives.arc_header(version) + b"\n" + b"\n".join(archives.arc_record(u, p, version) for u, p in blocks)
        records = list(archives.parse_arc(data))
        assert [(r["URL"], r["payload"]) for r in records] == blocks and len(records[0]) == fields + 1
    with pytest.raises(ValueError, match="cut short"):
        list(archives.parse_arc(data[:-1]))
    assert archives.warc_date("20240203040506") == "2024-02-03T04:05:06Z" and archives.warc_date("2024") == "2024-01-01T00:00:00Z"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    rows = registry.QUERIES[name](spark, SF).select(names).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall()))


def test_pipeline_equals_brute_force(spark):
    """run() against plain loops over all documents; of the library only the learned list is taken, and applied by hand."""
    import hashlib as h

    import corpus_pipeline as c
    from loglathe.llm import quality_rules
    from loglathe.llm.common import table
    from tokenizers import Tokenizer

    from .test_dedup import brute_components, brute_lines, brute_targets
    from .test_scoring import brute_stats

    frame = table(spark, SF, "documents")
    assert [n for n, _ in c.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    assert all(f(spark, frame.limit(20), SF).columns == frame.columns for _, f in c.STAGES[:2])
    rules = quality_rules.learn_from(frame, table(spark, SF, "labels"))
    docs = {r.doc_id: (r.text, r.source) for r in frame.collect()}

    def good(text):
        n, chars, symbols, dup, repeat = brute_stats(text)
        text = text or ""
        lines, upper, marks = len(text.split("\n")), sum("A" <= x <= "Z" for x in text), sum(x in "!?" for x in text)
        seen = {"word_length": chars / max(n, 1), "symbol_rate": symbols / max(n, 1), "dup_line_share": dup / max(lines, 1), "repeat_share": repeat / max(n, 1), "upper_share": upper / max(chars, 1), "mark_rate": marks / max(n, 1)}
        bad = any(all(seen[k.feature] >= k.cut if k.at_least else seen[k.feature] <= k.cut for k in rule) for rule in rules)
        return n >= 50 and 100 * repeat <= 50 * n and not bad

    texts = {i: t for i, (t, _) in docs.items() if good(t)}
    assert 0 < len(texts) < len(docs)
    texts = {i: t for (i, _), t in brute_lines(list(texts.items())).items()}
    root, _ = brute_components(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if root.get(i, i) == i}

    words = {i: [w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w] for i, t in texts.items()}
    sizes = defaultdict(int)
    for i, w in words.items():
        sizes[docs[i][1]] += len(w)
    mixed = []
    for source, target in brute_targets(sizes).items():
        goal = int(target + 0.5)
        whole = goal // max(sizes[source], 1)
        left = goal - whole * sizes[source]
        for i in sorted((i for i in words if docs[i][1] == source), key=lambda i: h.md5(f"mix-1:{i}".encode()).hexdigest()[:15]):
            taken = min(left, len(words[i]))
            left -= taken
            mixed += [(i, texts[i])] * (whole if words[i] else 0)
            if taken:
                mixed.append((i, texts[i] if taken == len(words[i]) else " ".join(words[i][:taken])))

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in mixed:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : first if k == 0 else a + 1024]
            want.append((i, k, a, len(part), crc32(np.array(part, "<u4").tobytes())))
    got = c.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert all(a == sum(n for _, n in places[:k]) for k, (a, _) in enumerate(places)) and sum(n for _, n in places) <= 1024
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 1024 + 1


def test_every_merge_is_what_lower_ranks_give():
    """The premise of encoding by rank: a merge's bytes, merged by lower ranks, are its two parts."""
    pytest.importorskip("public_tokenizers")
    ids = packing.Ids(packing.default_tokenizer())
    ranks = packing.byte_ranks(ids.tokenizer)
    names = json.loads(ids.tokenizer.to_str())["model"]["vocab"]
    name_of, bytes_of = {i: t for t, i in names.items()}, {i: b for b, i in ranks.items()}
    for a, b in json.loads(ids.tokenizer.to_str())["model"]["merges"]:
        rank, want = names[a + b], [bytes_of[names[a]], bytes_of[names[b]]]
        parts = [bytes([x]) for x in bytes_of[rank]]
        while (best := min((ranks.get(x + y, 1 << 30), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))))[0] < rank:
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 1:
                break
        assert parts == want, name_of[rank]


def test_ids_equal_the_tokenizer(monkeypatch):
    pytest.importorskip("public_tokenizers")
    ids = packing.Ids(packing.default_tokenizer())
    rng = random.Random(4)
    odd = [*"ab1.,'! \n\t\r", "  ", "\n\n", "é", "日", "\x1c", "\x85", "<|endoftext|>", "'s", "'ll", " \n", "n't", "\u0301", "😀"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(60))) for _ in range(4000)]
    for at_once in (packing.AT_ONCE, 9):
        monkeypatch.setattr(packing, "AT_ONCE", at_once)
        for t in texts:
            assert ids(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_archives_of_long_pages(spark, monkeypatch):
    """A page far beyond a file's bytes, in its own file, with memory in proportion to the page."""
    monkeypatch.setattr(archives, "FILE_BYTES", 1 << 16)
    long = "long page " * 5_000_000
    df = spark.createDataFrame([(i, f"u{i}", long if i == 7 else f"page {i % 5} " * 500) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r for r in archives.convert(df, file_bytes=1 << 16).collect()}
    assert got[7].payload_bytes == 50_000_000 and got[7].payload_digest == base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert sum(r.record_type == "revisit" for r in got.values()) == 40 - 6 and got[39].record_type == "response"
    zipped = zlib.compress(b"x 0 0 0 5\n12345", wbits=31) * 1  # two members after one another
    assert archives.Inflated(zipped + zipped).take(99) == b"x 0 0 0 5\n12345" * 2
