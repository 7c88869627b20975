"""Mixing sources to target weights by capped water-filling (native).

Every source gets a weight by its rank in code-point order (null last), the
weights repeating. The words of all documents are shared out by weight; no
source may go beyond ``max_epochs`` times its own words, and what it cannot
take is shared again by weight among the rest until none is above.

A source of S words with target t takes ``floor(t / S)`` whole repetitions of
each document and one fractional repetition of the documents that come first
in a seeded order; the document at the cut gives the words still missing, so
the words taken differ from the target by rounding only. Documents that share
a place in the seeded order (repeated rows) share what the cut leaves them.

Defined cases: null text counts 0 words; a source without words has target 0;
an empty table gives an empty result; repeated rows are separate documents; a
very long text is counted whole within its row; other columns of the input,
whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, q, release, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Parts of a source in seeded order; only the part that holds the cut is sorted.
PARTS_BITS = 12
_HASH_BITS = 60


def seeded(doc_id: Column, seed: str) -> Column:
    """60 bits of a digest of seed and id: a reproducible shuffle."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with weight and target. One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("i", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("i") + 1)
    s = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    # In order of cap / weight the clamped sources are a prefix, so one pass finds the final level.
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    below = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.sum(F.col("source_size").cast("double")).over(every).alias("total"),
        F.coalesce(F.sum("cap").over(below), F.lit(0.0)).alias("cap_below"),
        F.sum("weight").over(above).alias("weight_above"),
    ).withColumn("level", (F.col("total") - F.col("cap_below")) / F.col("weight_above"))
    s = s.withColumn("clamped", F.col("cap") / F.col("weight") <= F.col("level"))
    final = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    s = s.withColumn("final", final.over(every)["level"])
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def plan(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size, h) rows -> per source: source_size, target, whole, cut_h, cut_words, cut_size.

    Rows with h below ``cut_h`` take a fractional repetition in full; those at
    it share ``cut_words`` by size.
    """
    shift = _HASH_BITS - PARTS_BITS
    parts = materialise(rows.groupBy("source", F.shiftright("h", shift).alias("part")).agg(F.sum("size").alias("part_size")), "mix-parts")
    targets = materialise(water_fill(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs), "mix-targets")
    size = F.greatest(F.col("source_size"), F.lit(1))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.floor(goal / size).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("extra", goal - F.col("whole") * F.col("source_size"))
    t = targets.select(F.col("source").alias("t_source"), "extra")
    in_order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut_part = (
        parts.withColumn("before", F.coalesce(F.sum("part_size").over(in_order), F.lit(0)))
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("part_size")))
        .select(F.col("source").alias("c_source"), F.col("part").alias("c_part"), (F.col("extra") - F.col("before")).alias("left"))
    )
    inside = rows.join(cut_part, F.col("source").eqNullSafe(F.col("c_source")) & (F.shiftright("h", shift) == F.col("c_part")))
    ties = inside.groupBy("source", "left", "h").agg(F.sum("size").alias("tie_size"))
    in_part = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        ties.withColumn("before", F.coalesce(F.sum("tie_size").over(in_part), F.lit(0)))
        .where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("tie_size")))
        .select(F.col("source").alias("c_source"), F.col("h").alias("cut_h"), (F.col("left") - F.col("before")).alias("cut_words"), F.col("tie_size").alias("cut_size"))
    )
    out = targets.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
    out = materialise(out.select("source", "source_size", "target", "whole", F.coalesce("cut_h", F.lit(-1)).alias("cut_h"), F.coalesce("cut_words", F.lit(0)).alias("cut_words"), F.coalesce("cut_size", F.lit(1)).alias("cut_size")), "mix-plan")
    release(parts, targets)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), seed).alias("h")), "mix-rows")
    p = plan(rows, weights, max_epochs).withColumnRenamed("source", "p_source")
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("p_source")))
    return joined.select("doc_id", "size", "source_size", "target", _taken(F.col("size"), F.col("h")).alias("taken"))


def _extra(size: Column, h: Column) -> Column:
    shared = F.floor(F.col("cut_words").cast("decimal(18,0)") * size / F.col("cut_size")).cast("long")
    return F.when(h < F.col("cut_h"), size).when(h == F.col("cut_h"), shared).otherwise(F.lit(0)).cast("long")


def _taken(size: Column, h: Column) -> Column:
    return (F.col("whole") * size + _extra(size, h)).cast("long")


def apply_mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: documents' columns, a row for each repetition.

    A fractional repetition of part of a document holds its first words, joined
    by blanks; ``n_chars`` follows where the column exists. Documents that take
    nothing go.
    """
    size, h, copies, part = fresh(docs, "size", "h", "copy", "part")
    sized = docs.withColumn(size, word_count(F.col("text"))).withColumn(h, seeded(F.col("doc_id"), seed))
    rows = materialise(sized.select("source", q(size).alias("size"), q(h).alias("h")), "mix-rows")
    p = plan(rows, weights, max_epochs)
    release(rows)
    names = {c: fresh(sized, "p_" + c)[0] for c in p.columns}
    p = p.select([F.col(c).alias(n) for c, n in names.items()])
    joined = sized.join(p, F.col("source").eqNullSafe(q(names["source"])))
    share = F.floor(q(names["cut_words"]).cast("decimal(18,0)") * q(size) / q(names["cut_size"])).cast("long")
    extra = F.when(q(h) < q(names["cut_h"]), q(size)).when(q(h) == q(names["cut_h"]), share).otherwise(F.lit(0))
    full = F.array_repeat(F.lit(-1).cast("long"), q(names["whole"]).cast("int"))
    tail = F.when((extra > 0) & (extra == q(size)), F.array(F.lit(-1).cast("long"))).when(extra > 0, F.array(extra.cast("long"))).otherwise(F.array().cast("array<long>"))
    # Documents without words take no words however often they are repeated.
    joined = joined.withColumn(copies, F.explode(F.when(q(size) > 0, F.concat(full, tail)).otherwise(F.array().cast("array<long>"))))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), 1, F.greatest(q(copies), F.lit(0)).cast("int")), " ")
    joined = joined.withColumn(part, F.when(q(copies) < 0, F.col("text")).otherwise(head))
    cols = [q(part).alias("text") if c == "text" else F.when(q(copies) < 0, q(c)).otherwise(F.length(q(part))).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else q(c) for c in docs.columns]
    return joined.select(cols)
