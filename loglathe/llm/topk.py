"""Exact top-k search by a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, sorted by
that key over all partitions, and stored in blocks: thin annuli around one
pivot. The pivots come from a bounded sample, spread by farthest-first
choice; every vector is indexed whatever the sample held.

For a query q and a vector x in an annulus [lo, hi] around p the triangle
inequality gives |q - x| >= gap = max(lo - |q - p|, |q - p| - hi, 0), hence
q.x <= (|q|^2 + |x|^2 - gap^2) / 2. A floor, which a query's k-th best score is
not below, comes from the sample and from the annuli around the query itself,
which pass by it as the index is built. Queries of neighbouring keys form a
group; a group fetches, around each pivot, the stretch of distances that some
of its floors leave open. Its blocks come in order of their distance, are held
against each query's own bound, raise the floors, and are skipped as soon as
they fall below. Bounds carry a slack far above rounding, scores are exact
integers.

A group's blocks are dealt out by salt, as many as they need, and the partial
results meet in a last ranking of at most k rows a part.

What it costs: blocks move once for each group of up to ``GROUP`` queries that
reaches them. Where distances say little (uniform data of many dimensions, as
the table of this repository, in which annuli of no width and true 20th scores
would still leave 97 of 100 pairs open) every group reaches every block: the
result stays exact, N^2 / 20 products are computed and N^2 / 20 / GROUP vectors
move. On clustered data most blocks are never fetched, which a test asserts.

Defined cases: a null vector, one with a null or non-finite component and one
without an id take no part; vectors of unequal length compare as if padded
with zeros; a repeated row (equal id and vector) counts once, and where one id
has several vectors the best score counts; equal scores rank by id; fewer
candidates than k give fewer rows; an empty table gives an empty result;
other columns, whatever their names, are ignored. Scores beyond a 64-bit integer are undefined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

SCALE = 64
K = 20
QUERY_EVERY = 20
#: Vectors that the pivots are chosen from, and pivots, at most.
SAMPLE, PIVOTS = 2048, 64
#: Vectors of a block, queries of a group, blocks that pass by before a floor is taken.
BLOCK, GROUP, PASSING = 512, 4096, 3
#: Blocks that one task holds against a group, more or less, and parts of a group's blocks at least.
BLOCKS_A_PART, LEAST_PARTS = 256, 8
#: Rings of equal width around each pivot, by which groups and blocks meet.
RINGS = 64


@dataclass
class Index:
    """What each task needs: sizes, pivots and the sample; all bounded."""

    dim: int
    stored: str
    exact: str
    pivots: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.stored).reshape(-1, self.dim)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(self.exact) @ b.astype(self.exact).T).astype(np.int64)

    def distances(self, v: np.ndarray) -> np.ndarray:
        v, p = v.astype(float), self.pivots.astype(float)
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * v @ p.T, 0))


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<long>) of the vectors that take part."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(x.cast("double") - x.cast("double") == 0, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def spread(v: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first choice of distinct vectors."""
    v = np.unique(v, axis=0).astype(float)
    chosen, gap = [0], ((v - v[0]) ** 2).sum(1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen].astype(np.int64)


def _padded(arrays: list, dim: int) -> np.ndarray:
    out = np.zeros((len(arrays), dim), np.int64)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def fit(vectors: DataFrame) -> Index | None:
    """Sizes over all vectors, pivots from a sample; None of an empty table."""
    longest = F.max(F.array_max(F.transform("v", F.abs)))
    dim, largest = vectors.agg(F.max(F.size("v")), longest).first()
    if dim is None:
        return None
    dim, largest = max(dim, 1), largest or 0
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    of = {r.vec_id: r.v for r in got}
    sample = _padded(list(of.values()), dim)
    total = largest * largest * dim
    return Index(dim, "<i4" if largest < 1 << 31 else "<i8", "float32" if total < 1 << 24 else "float64" if total < 1 << 53 else "int64", spread(sample, PIVOTS), np.array(list(of), np.int64), sample)


def _key(index: Index):
    def key(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            v = _padded(rows["v"].tolist(), index.dim)
            d = index.distances(v)
            cell = d.argmin(1)
            stored = v.astype(index.stored)
            yield pd.DataFrame({"vec_id": rows["vec_id"], "cell": cell.astype(np.int32), "dist": d[np.arange(len(d)), cell], "norm": (v.astype(float) ** 2).sum(1), "raw": [x.tobytes() for x in stored]})

    return key


def _as_block(number: int, rows: pd.DataFrame) -> dict:
    return {"block": number, "cell": rows["cell"].iloc[0], "lo": rows["dist"].min(), "hi": rows["dist"].max(), "norm": rows["norm"].max(), "ids": rows["vec_id"].to_numpy("<i8").tobytes(), "raw": b"".join(rows["raw"]), "floors": None}


def _as_group(number: int, ids: np.ndarray, raw: bytes, floors: np.ndarray) -> dict:
    return {"block": number, "cell": -1, "lo": 0.0, "hi": 0.0, "norm": 0.0, "ids": ids.astype("<i8").tobytes(), "raw": raw, "floors": floors.astype("<f8").tobytes()}


_BLOCKS = "block long, cell int, lo double, hi double, norm double, ids binary, raw binary, floors binary"


def _blocks(index: Index, k: int, every: int):
    """Runs of sorted rows as blocks, which end where the pivot changes; and their queries (cell -1) with floors from the blocks around them."""

    def near_floors(passing: list[pd.DataFrame], own: pd.DataFrame) -> dict | None:
        asked = own[own["vec_id"] % every == 0]
        if not len(asked):
            return None
        around = pd.concat(passing, ignore_index=True)
        ids, v = asked["vec_id"].to_numpy(), index.unpack(b"".join(asked["raw"]))
        floors = np.maximum(_floors(index, ids, v, k, index.sample_ids, index.sample), _floors(index, ids, v, k, around["vec_id"].to_numpy(), index.unpack(b"".join(around["raw"]))))
        return _as_group(0, ids, b"".join(asked["raw"]), floors)

    def block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: pd.DataFrame | None = None
        passing: list[pd.DataFrame] = []
        for rows in _then_none(parts):
            last = rows is None
            if not last:
                held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            out = []
            while held is not None and len(held):
                own = held.iloc[:BLOCK]
                own = own[own["cell"] == own["cell"].iloc[0]]
                if not last and len(own) < BLOCK and len(own) == len(held):
                    break  # more of it may follow
                held = held.iloc[len(own) :]
                out.append(_as_block(number, own))
                number += 1
                passing = [*passing, own][-PASSING:]
                if len(passing) > 1 and (asked := near_floors(passing, passing[-2])):
                    out.append(asked)
            if last and passing and (asked := near_floors(passing, passing[-1])):
                out.append(asked)
            if out:
                yield pd.DataFrame(out)

    return block


def _then_none(parts: Iterator) -> Iterator:
    yield from parts
    yield None


def _join_groups(size: int):
    """Neighbouring groups of queries as groups of ``size``, but for the last."""

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for rows in _then_none(parts):
            held += [] if rows is None else list(zip(rows["ids"], rows["raw"], rows["floors"], strict=True))
            n = sum(len(h[0]) for h in held) // 8
            if held and (n >= size or rows is None):
                ids, raw, floors = (b"".join(h[i] for h in held) for i in range(3))
                width = len(raw) // n
                cuts = range(0, n, size)
                yield pd.DataFrame([_as_group(number + i, np.frombuffer(ids, "<i8")[a : a + size], raw[a * width : (a + size) * width], np.frombuffer(floors, "<f8")[a : a + size]) for i, a in enumerate(cuts)])
                number, held = number + len(cuts), []

    return join


def _slack(x: np.ndarray) -> np.ndarray:
    return 1e-6 + 1e-9 * np.abs(x)


def _floors(index: Index, ids: np.ndarray, v: np.ndarray, k: int, other_ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Per query the k-th best score among others of distinct ids, which no final k-th score is below."""
    other_ids, first = np.unique(other_ids, return_index=True)
    if len(other_ids) <= k:
        return np.full(len(ids), -np.inf)
    s = index.scores(v, others[first]).astype(float)
    s[ids[:, None] == other_ids[None, :]] = -np.inf
    return np.partition(s, -k, axis=1)[:, -k]


def _reach(index: Index, cells: dict[int, tuple[float, float, float]]):
    """Adds to each group of queries the stretch of distances to fetch around each pivot."""

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for number, raw_ids, raw, raw_floors in zip(rows["block"], rows["ids"], rows["raw"], rows["floors"], strict=True):
                v, floors = index.unpack(raw), np.frombuffer(raw_floors, "<f8")
                d, norm = index.distances(v), (v.astype(float) ** 2).sum(1)
                stretches = []
                for cell, (lo, hi, most) in cells.items():
                    square = norm + most - 2 * floors
                    square = square + _slack(norm) + _slack(np.full(1, most)) + _slack(np.where(np.isfinite(floors), floors, 0))
                    some = square >= 0
                    if some.any():
                        r = np.sqrt(square[some]) + 1e-6
                        a, b = max(lo, (d[some, cell] - r).min()), min(hi, (d[some, cell] + r).max())
                        if a <= b:
                            stretches.append({"cell": cell, "lo": float(a), "hi": float(b)})
                out.append({"batch": number, "ids": raw_ids, "raw": raw, "floors": raw_floors, "stretches": stretches})
            yield pd.DataFrame(out, columns=["batch", "ids", "raw", "floors", "stretches"])

    return reach


class _Batch:
    """The queries of a group with their best so far."""

    def __init__(self, index: Index, raw_ids: bytes, raw: bytes, floors: bytes, k: int) -> None:
        self.index, self.k = index, k
        self.ids, self.v = np.frombuffer(raw_ids, "<i8"), index.unpack(raw)
        self.norm, self.d = (self.v.astype(float) ** 2).sum(1), index.distances(self.v)
        self.floor = np.frombuffer(floors, "<f8").copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)

    def bounds(self, cell: int, lo: float, hi: float, norm: float) -> np.ndarray:
        gap = np.maximum(np.maximum(lo - self.d[:, cell], self.d[:, cell] - hi) - 1e-6, 0)
        return (self.norm + norm - gap**2) / 2

    def meet(self, cell: int, lo: float, hi: float, norm: float, raw_ids: bytes, raw: bytes) -> None:
        bound = self.bounds(cell, lo, hi, norm)
        live = np.flatnonzero(bound + _slack(bound) >= self.floor)
        if not len(live):
            return
        ids = np.frombuffer(raw_ids, "<i8")
        scores = self.index.scores(self.v[live], self.index.unpack(raw))
        good = (scores >= self.floor[live][:, None]) & (ids[None, :] != self.ids[live][:, None])
        for at in np.flatnonzero(good.any(1)):
            i = live[at]
            s, x = np.concatenate([self.best[i][0], scores[at, good[at]]]), np.concatenate([self.best[i][1], ids[good[at]]])
            order = np.lexsort((x, -s))
            s, x = s[order], x[order]
            _, first = np.unique(x, return_index=True)  # an id's best comes first
            first.sort()
            s, x = s[first[: self.k]], x[first[: self.k]]
            self.best[i] = (s, x)
            if len(s) == self.k:
                self.floor[i] = max(self.floor[i], s[-1])

    def rows(self) -> pd.DataFrame:
        n = [len(s) for s, _ in self.best]
        return pd.DataFrame({"query_id": np.repeat(self.ids, n), "vec_id": np.concatenate([x for _, x in self.best]), "score": np.concatenate([s for s, _ in self.best])})


def _search(index: Index, k: int):
    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = None, None
        for rows in parts:
            for r in rows.itertuples(index=False):
                if r.cell < 0:
                    if own is not None:
                        yield own.rows()
                    own, at = _Batch(index, r.ids, r.raw, r.floors, k), (r.batch, r.salt)
                elif (r.batch, r.salt) == at:
                    own.meet(r.cell, r.lo, r.hi, r.norm, r.ids, r.raw)
        if own is not None:
            yield own.rows()

    return search


@dataclass
class Prepared:
    """The index, its blocks, the groups of queries and which blocks each group is to fetch (batch, block, far)."""

    index: Index
    blocks: DataFrame
    groups: DataFrame
    pairs: DataFrame
    n_blocks: int


def prepare(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE) -> Prepared | None:
    spark = embeddings.sparkSession
    vectors = quantised(embeddings, scale)
    index = fit(vectors)
    if index is None:
        return None
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialise(vectors.mapInPandas(_key(index), "vec_id long, cell int, dist double, norm double, raw binary"), "keyed")
    order = ["cell", "dist", "vec_id"]
    stored = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_blocks(index, k, every), _BLOCKS)
    stored = materialise(stored.withColumn("asks", F.col("cell") < 0), "annuli", "asks")
    release(keyed)
    blocks = stored.where(~F.col("asks"))
    cells = {r.cell: (r.lo, r.hi, r.norm, r.n) for r in blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    asked = stored.where(F.col("asks"))
    queries = asked.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    asked = asked.coalesce(max(1, -(-queries // 8 // GROUP))).mapInPandas(_join_groups(GROUP), _BLOCKS)
    reached = asked.mapInPandas(_reach(index, {c: r[:3] for c, r in cells.items()}), "batch long, ids binary, raw binary, floors binary, stretches array<struct<cell: int, lo: double, hi: double>>")
    groups = materialise(reached, "groups")

    width = max([r[1] for r in cells.values()], default=0.0) / RINGS or 1.0
    ring = lambda d: F.floor(d / F.lit(width)).cast("int")
    rings = lambda lo, hi: F.explode(F.sequence(ring(lo), ring(hi)))
    s = groups.select("batch", F.explode("stretches").alias("s")).select("batch", F.col("s.cell").alias("cell"), F.col("s.lo").alias("s_lo"), F.col("s.hi").alias("s_hi"))
    s = s.select("*", rings(F.col("s_lo"), F.col("s_hi")).alias("ring"))
    own = blocks.select("block", "cell", "lo", "hi", rings(F.col("lo"), F.col("hi")).alias("ring"))
    once = F.col("ring") == F.greatest(ring(F.col("lo")), ring(F.col("s_lo")))
    mid = (F.col("s_lo") + F.col("s_hi")) / 2
    pairs = own.join(s, ["cell", "ring"]).where(once & (F.col("hi") >= F.col("s_lo")) & (F.col("lo") <= F.col("s_hi")))
    pairs = pairs.select("batch", "block", F.greatest(F.col("lo") - mid, mid - F.col("hi"), F.lit(0.0)).alias("far"))
    return Prepared(index, blocks, groups, pairs, sum(r[3] for r in cells.values()))


def search(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, which are the rows of ids divisible by ``every``."""
    spark = embeddings.sparkSession
    p = prepare(embeddings, k, every, scale)
    if p is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(LEAST_PARTS, -(-p.n_blocks // BLOCKS_A_PART))
    none = F.lit(None).cast("binary")
    near = p.blocks.join(p.pairs, "block").select("batch", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("salt"), "far", "cell", "lo", "hi", "norm", "ids", "raw", none.alias("floors"))
    zero = F.lit(0.0)
    heads = p.groups.select("batch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"), F.lit(-1.0).alias("far"), F.lit(-1).alias("cell"), zero.alias("lo"), zero.alias("hi"), zero.alias("norm"), "ids", "raw", "floors")
    dealt = heads.unionAll(near).repartition(n, "batch", "salt").sortWithinPartitions("batch", "salt", "far", "cell", "lo")
    part = dealt.mapInPandas(_search(p.index, k), "query_id long, vec_id long, score long")
    part = part.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
