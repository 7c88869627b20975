"""Connected components of a graph of long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root) of every node but the roots; a root is the least id it reaches.

    Each turn ties every node's larger neighbours to its least (large star),
    then its smaller ones (small star). Both only take minima by key, so hubs
    are combined before the shuffle. Written out each turn: lineage stays
    short and a lost executor costs one turn.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = materialise(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        tied = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = tied.select("a", F.col("m").alias("b")).unionAll(tied.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        small = materialise(small, "small-star")
        release(e, large)
        e, before = small, state
        state = _state(e)
        if state == before:
            break
    return _named(e)


def _named(e: DataFrame) -> DataFrame:
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._loglathe_path = e.__dict__.pop("_loglathe_path", None)
    return out
