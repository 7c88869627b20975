"""MinHash near-dedup with odd sketches.

1. Each whole text becomes its set of distinct word shingles (64-bit hashes),
   and that set a fingerprint: ``BANDS`` bands of ``ROWS`` MinHash samples, and
   an odd sketch: one-permutation samples (the least hash of each of ``BINS``
   bins) folded into a bitmap of parities. The number of bits in which two
   sketches differ tells how many samples do.
2. Texts of equal sets are one class, named by its least doc_id.
3. Classes that share a band meet in its bucket. A round holds each class
   against one head only: of its buckets' heads in another component the most
   popular, which is most often what the others were made from. Candidates
   whose sizes or sketches rule the similarity out go, by one rule for sets of
   every size (``most_differing``); the rest is confirmed on the full sets.
4. Confirmed links merge components, and rounds with other heads follow; last,
   whatever is still apart in a bucket is held against all its members, by
   sketch inside the join, so no class that shares a bucket is passed over.

What may be lost: two sets of similarity 0.8 share no band with probability
(1 - 0.8^4)^32, below 1e-7, and their sketches differ by more than the margin
of ``SIGMAS`` standard deviations with one below 1e-8. Sizes and links are
otherwise exact, but for collisions of 64-bit hashes.

Sets move through a sort, not into groups: a head's set comes first, its
members stream past it, and the members of one head are dealt out by salt.

Defined cases: a text of fewer words than a shingle is one shingle; a null or
wordless text has an empty set, links with nothing and stays; rows of a null
doc_id link with nothing and stay; repeated rows (equal doc_id) are one
document, whose rows stay or go together; an empty table gives an empty
result; a very long text is hashed whole, in parts, and needs 8 bytes a word;
other columns pass through ``drop_near`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordTable, fresh, materialise, mix64, q, release, words_in_parts
from .components import components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 4
#: One-permutation MinHash: the least hash of each bin is a sample; an odd sketch folds them.
BINS, SKETCH_BITS = 4096, 2048
#: Standard deviations that a pair of similar sets may lie beyond what their sketches should differ by.
SIGMAS = 6
#: Rounds against one head a class before the rest of a bucket is held against each other.
HEADS = ("popular", "popular", "other")
#: Words of a text that are hashed at once; bounds memory.
AT_ONCE = 1 << 18
#: Rows apart from a bucket's main component that make it worth dealing to one part more, when all its rows meet.
PART_ROWS = 4000
#: Parts that the members of one head are dealt to.
SALTS = 64

#: What classes are compared by before their sets are.
PROFILE = ("n", "empty", "root", "sketch", "bands")
_K = BANDS * ROWS
WORDS = SKETCH_BITS // 64
_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, _K, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix64(np.arange(1000, 1000 + BANDS, dtype=np.uint64))


class Hashes(WordTable):
    """Word -> 64-bit hash, kept in an array."""

    def __init__(self) -> None:
        import xxhash

        self.of = xxhash.xxh3_64_intdigest
        self.reset()
        super().__init__()

    def reset(self) -> None:
        self.values, self.used = np.zeros(1024, np.uint64), 0

    def grow(self) -> None:
        if self.fresh:
            n = self.used + len(self.fresh)
            if n > len(self.values):
                self.values = np.concatenate([self.values[: self.used], np.zeros(max(n, 2 * self.used) - self.used, np.uint64)])
            self.values[self.used : n] = np.fromiter(map(self.of, self.fresh), np.uint64, len(self.fresh))
            self.used, self.fresh = n, []

    def shingles(self, text: str | None, width: int) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles."""
        parts = []
        for words in words_in_parts(text, AT_ONCE, lower=True):
            self.start()
            ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            self.grow()
            parts.append(self.values[ids])
        if not parts:
            return np.zeros(0, np.uint64)
        h = np.concatenate(parts)
        with np.errstate(over="ignore"):
            if len(h) < width:
                return mix64(np.array([(h * _PLACE[: len(h)]).sum() + np.uint64(len(h))]))
            n = len(h) - width + 1
            out = np.full(n, width, np.uint64)
            for k in range(width):
                out += h[k : k + n] * _PLACE[k]
        return np.unique(mix64(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    least = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            least = np.minimum(least, (shingles[None, a : a + 2048] * _MULTIPLIERS[:, None] + _ADDENDS[:, None]).min(1))
    return least


def bands(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((samples.reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(1) + _BAND).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parities of a sorted set's samples, the least hash of each bin, on each bit; as 64-bit words."""
    bins = shingles >> np.uint64(64 - BINS.bit_length() + 1)
    samples = shingles[np.append(True, bins[1:] != bins[:-1])]
    at = (mix64(samples ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


_PROFILE = T.StructType([T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def profile_udf(width: int):
    @F.pandas_udf(_PROFILE)
    def profile(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Hashes()
        for texts in parts:
            out = []
            for text in texts:
                s = words.shingles(text, width)
                if not len(s):
                    out.append((0, 0, 0, [], []))
                    continue
                with np.errstate(over="ignore"):
                    f1 = mix64(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)
                    f2 = np.bitwise_xor.reduce(mix64(s + np.uint64(0x27D4EB2F))).view(np.int64)
                out.append((len(s), int(f1), int(f2), bands(signature(s)), odd_sketch(s)))
            yield pd.DataFrame(out, columns=["n", "f1", "f2", "bands", "sketch"])

    return profile


def sets_udf(width: int):
    @F.pandas_udf("binary")
    def sets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Hashes()
        for texts in parts:
            yield pd.Series([words.shingles(t, width).tobytes() for t in texts])

    return sets


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def confirm(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, head_sets = None, []
        for rows in parts:
            found = []
            for x, salt, y, raw in zip(rows["x"], rows["salt"], rows["y"], rows["set"], strict=True):
                own = np.frombuffer(raw, np.uint64)
                if y is None or y != y:
                    if (x, salt) != head:
                        head, head_sets = (x, salt), []
                    head_sets.append(own)
                elif (x, salt) == head and any(similar(h, own, percent) for h in head_sets):
                    found.append((x, int(y)))
            yield pd.DataFrame(found, columns=["x", "y"])

    return confirm


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (x, y) pairs whose full sets are similar. Members stream past their head in sorted order."""
    salted = pairs.select("x", "y", F.pmod(F.xxhash64("y"), F.lit(SALTS)).alias("salt"))
    members = salted.join(sets.withColumnRenamed("id", "y"), "y").select("x", "salt", F.col("y"), "set")
    heads = salted.select("x", "salt").distinct().join(sets.withColumnRenamed("id", "x"), "x").select("x", "salt", F.lit(None).cast("long").alias("y"), "set")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = heads.unionAll(members).repartition(n, "x", "salt").sortWithinPartitions("x", "salt", F.col("y").asc_nulls_first())
    return rows.mapInPandas(_confirm(percent), "x long, y long")


def _differing(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two sketches differ."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def near_in_size(a: str, b: str, percent: int) -> Column:
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def emptiness(n: Column, percent: int) -> tuple[Column, Column]:
    """The chance that a bin holds none of n shingles, and its root of degree 1 + J: what ``most_differing`` needs of each side."""
    return F.exp(n * (-1 / BINS)), F.exp(n * (-1 / BINS / (1 + percent / 100)))


def most_differing(a: str, b: str, percent: int) -> Column:
    """The bits in which sketches of similar sets differ at most, whatever the sets' sizes (columns n_, empty_, root_ with these endings).

    Of a union of N shingles m = BINS (1 - exp(-N / BINS)) bins hold any. The
    least hash of a bin lies in one set only in D bins. D can't exceed the
    shingles that one set alone has, (1 - J) / (1 + J) of both sizes; as bins
    draw m of N shingles, it is also m (1 - J) but for a variance of
    m (1 - J) (N - m) / N at most. Such a bin shifts a second sample where the
    other set has one there, which it has with probability p. Samples that
    differ toggle a bit each, two on one bit cancel: of t = x half toggles half
    (1 - exp(-x)) bits stay; (x + x^2 / 6) / (1 + 2 x / 3 + x^2 / 6) is a bound
    of 1 - exp(-x), as a join evaluates this for each pair.
    """
    j, half = percent / 100, SKETCH_BITS / 2
    both = (F.col(f"n_{a}") + F.col(f"n_{b}")).cast("double")
    bins = (F.lit(1.0) - F.col(f"root_{a}") * F.col(f"root_{b}")) * BINS
    thinned = F.greatest(F.lit(1.0) - bins * (1 + j) / both, F.lit(0.0))
    alone = F.least(both * ((1 - j) / (1 + j)) + 1e-6, bins * (1 - j) + F.sqrt(bins * (1 - j) * thinned) * SIGMAS)
    p = F.lit(1.0) - F.least(f"empty_{a}", f"empty_{b}")
    toggles = alone * (p + 1) + F.sqrt(alone * p * (F.lit(1.0) - p)) * SIGMAS
    spread = F.least(toggles * (SIGMAS * (2 / SKETCH_BITS) ** 0.5), F.lit(SIGMAS * SKETCH_BITS**0.5 / 2))
    x = toggles * (1 / half)
    return F.least(toggles, (x * (x * (1 / 6) + 1)) / (x * (x * (1 / 6) + 2 / 3) + 1) * half + spread)


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two classes (columns n_, empty_, root_, sketch_ with these endings) let them be similar."""
    differ = _differing([F.get(F.col(f"sketch_{a}"), i) for i in range(WORDS)], [F.get(F.col(f"sketch_{b}"), i) for i in range(WORDS)])
    return near_in_size(a, b, percent) & (differ <= most_differing(a, b, percent))


def near_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    kind = docs.schema["doc_id"].dataType
    p = docs.select(F.col("doc_id").cast("long").alias("doc_id"), profile_udf(width)(F.col("text")).alias("p"))
    p = materialise(p.select("doc_id", "p.*"), "profiles")
    full = p.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = materialise(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    own = full.select("doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).select("doc_id", "n", "rep")
    members = materialise(own, "members")
    empty, root = emptiness(F.col("n"), percent)
    reps = p.join(classes, ["f1", "f2", "n"]).where(F.col("doc_id") == F.col("rep")).withColumns({"empty": empty, "root": root}).select("rep", *PROFILE).dropDuplicates(["rep", "bands"])
    reps = materialise(reps, "reps")

    at = reps.select("rep", F.explode("bands").alias("bk"))
    crowded = materialise(at.groupBy("bk").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "crowded")
    met = materialise(at.join(crowded, "bk").select("bk", "rep", "size"), "met")
    # What many texts were made from shares the fullest bucket of nearly every band with them.
    popular = met.groupBy("rep").agg(F.sum("size").alias("popular"))
    buckets = materialise(met.join(popular, "rep").select("bk", "rep", "popular"), "buckets")
    ids = materialise(buckets.select("rep").distinct(), "candidates")
    sketches = materialise(reps.join(ids, "rep").select(F.col("rep").alias("id"), *PROFILE), "sketches")
    # Always by sorted merge: the texts move once, in proportion to the input at every size.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.withColumnRenamed("rep", "id").hint("merge"), "id")
    sets = materialise(texts.select("id", sets_udf(width)(F.col("text")).alias("set")), "sets")
    release(classes, reps, crowded, met)
    found = _merge(buckets, ids, sketches, sets, percent)
    release(buckets, ids, sketches, sets)

    joined = members.join(found, members["rep"] == found["id"], "left")
    linked = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    alone = p.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("doc_id").cast(kind), "n_shingles", F.col("component_id").cast(kind))


def _merge(buckets: DataFrame, ids: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of the classes that share a bucket."""
    comps = materialise(ids.select(F.col("rep").alias("id"), F.col("rep").alias("comp")), "comps")
    tested: DataFrame | None = None

    def sketched(df: DataFrame, key: str) -> DataFrame:
        return df.join(sketches.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in PROFILE]), key)

    for turn, head in enumerate((*HEADS, "all")):
        b = materialise(buckets.join(comps, buckets["rep"] == comps["id"]).select("bk", "rep", "popular", "comp"), "placed")
        mixed = materialise(_main_rows(b) if head == "all" else _heads(b, head), "mixed")
        if mixed.isEmpty():
            release(b, mixed)
            break
        rows = b.join(mixed, "bk")
        if head == "all":
            near = _apart(sketched(rows.withColumnRenamed("rep", "id"), "id"), percent)
        else:
            # One try for each class: against the best head of its buckets that is in another component.
            one = rows.where(F.col("main") != F.col("comp")).groupBy("rep").agg(F.max_by("head", "worth").alias("head"))
            near = sketched(sketched(one.select(F.col("head").alias("x"), F.col("rep").alias("y")), "x"), "y").where(may_be_similar("x", "y", percent)).select("x", "y")
        if tested is not None:
            done = tested.unionAll(tested.select(F.col("y").alias("x"), F.col("x").alias("y")))
            near = near.join(done, ["x", "y"], "left_anti")
        pairs = materialise(near.select("x", "y"), f"pairs{turn}")
        release(b, mixed)
        if not pairs.isEmpty():
            links = materialise(_links(pairs, sets, percent), "links")
            e = links.join(comps.select(F.col("id").alias("x"), F.col("comp").alias("a")), "x").join(comps.select(F.col("id").alias("y"), F.col("comp").alias("b")), "y")
            roots = components(e.select("a", "b"))
            merged = comps.join(roots, comps["comp"] == roots["node"], "left").select("id", F.coalesce("root", "comp").alias("comp"))
            merged = materialise(merged, "comps")
            release(comps, links, roots)
            every = pairs if tested is None else materialise(tested.unionAll(pairs), "tested")
            if tested is not None:
                release(tested, pairs)
            comps, tested = merged, every
        else:
            release(pairs)
    release(tested)
    return comps


def _heads(b: DataFrame, kind: str) -> DataFrame:
    """bk, head, worth, main (the head's component) of the buckets that hold several components."""
    # Larger is better; one number, so that a hash aggregate can hold it. Ties go to the least id.
    worth = F.col("popular").cast("decimal(19,0)") if kind == "popular" else F.xxhash64(F.lit(kind), "rep").cast("decimal(20,0)")
    worth = worth * F.lit("10000000000000000000").cast("decimal(20,0)") - F.col("rep")
    found = b.groupBy("bk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("rep", worth).alias("head"), F.max(worth).alias("worth"), F.max_by("comp", worth).alias("main"))
    return found.where(F.col("lo") < F.col("hi")).select("bk", "head", "worth", "main")


def _main_rows(b: DataFrame) -> DataFrame:
    """bk, main (its largest component), apart (rows of others) of the buckets that hold several components."""
    each = b.groupBy("bk", "comp").agg(F.count(F.lit(1)).alias("rows"))
    most = F.struct("rows", "comp")
    found = each.groupBy("bk").agg(F.max(most).alias("most"), F.sum("rows").alias("rows"))
    return found.select("bk", F.col("most.comp").alias("main"), (F.col("rows") - F.col("most.rows")).alias("apart")).where(F.col("apart") > 0)


def _apart(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y) of rows that share a bucket but no component, as far as their sketches let them be similar.

    Rows outside their bucket's main component meet all its rows, in parts of
    some ``PART_ROWS`` if there are more; the others are copied to each part.
    Sketches lie in columns of their own, which the join compares fastest. A
    pair comes out of the first bucket that it shares.
    """
    s = rows.select("bk", "id", "comp", "main", (F.col("apart") / PART_ROWS).cast("int").alias("parts"), *[f"{c}_id" for c in PROFILE])

    def side(frame: DataFrame, x: str, part: Column) -> DataFrame:
        return frame.select(F.col("bk").alias(f"bk_{x}"), part.alias(f"part_{x}"), F.col("id").alias(x), F.col("comp").alias(f"c{x}"), F.col("main").alias(f"main_{x}"), *[F.col(f"{c}_id").alias(f"{c}_{x}") for c in ("n", "empty", "root")], F.col("bands_id").alias(f"bands_{x}"), *[F.get("sketch_id", i).alias(f"w{i}_{x}") for i in range(WORDS)])

    once = (F.col("x") < F.col("y")) | (F.col("cy") == F.col("main_y"))
    met = (F.col("bk_x") == F.col("bk_y")) & (F.col("part_x") == F.col("part_y")) & (F.col("cx") != F.col("cy")) & once & near_in_size("x", "y", percent)
    first = F.get(F.array_intersect("bands_x", "bands_y"), F.lit(0)) == F.col("bk_x")
    differ = _differing([F.col(f"w{i}_x") for i in range(WORDS)], [F.col(f"w{i}_y") for i in range(WORDS)])
    left = side(s.where(F.col("comp") != F.col("main")), "x", F.pmod(F.xxhash64("id"), F.col("parts") + 1).cast("int"))
    right = side(s, "y", F.explode(F.sequence(F.lit(0), F.col("parts"))))
    near = left.hint("merge").join(right, met & (differ <= most_differing("x", "y", percent)) & first)
    return near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def mark(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    c = near_components(docs, width, percent)
    return c.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those near an earlier one: of each component the least doc_id stays."""
    (gone,) = fresh(docs, "gone")
    c = near_components(docs, width, percent)
    dropped = c.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct()
    dropped = materialise(dropped, "near-dropped")
    release(c)
    return docs.join(dropped.hint("merge"), F.col("doc_id") == q(gone), "left_anti").select([q(c) for c in docs.columns])
