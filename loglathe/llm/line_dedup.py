"""Line dedup over overlapping three-line windows (native).

Every three consecutive lines that hold a word form a window (lines without a
word are passed over). A window whose three lines occurred before, in an
earlier document or earlier in its own, is a later occurrence; the lines from
its first to its last are covered, blank ones between them too. Overlapping
covered stretches are merged and removed. Documents come in order of doc_id
(null last). The earliest copy of any removed line always stays.

Lines are compared exactly, through two 64-bit hashes of the three lines.

Defined cases: null text stays null; texts of fewer than three lines with a
word stay as they are; repeated rows (equal doc_id) are one document and share
their fate; a very long text is split whole within its row; an empty table
gives an empty result; all other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HAS_WORD, fresh, materialise, q, release

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    """Positions of the lines that hold a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull())


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """A row for each window: doc_id, th (hash of the text), j (number of its first filled line), h1, h2."""
    text = F.col("text")
    hashed = F.filter(F.transform(_lines(text), lambda x: F.when(x.rlike(HAS_WORD), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))), lambda s: s.isNotNull())
    d = docs.select("doc_id", F.xxhash64(text).alias("th"), hashed.alias("s")).where(F.size("s") >= width)
    s = F.col("s")

    def at(j: Column) -> Column:
        three = [F.get(s, j + k) for k in range(width)]
        return F.struct(F.xxhash64(*[x["a"] for x in three]).alias("h1"), F.xxhash64(F.lit(11), *[x["b"] for x in three]).alias("h2"))

    return d.select("doc_id", "th", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(s) - width), at)).alias("j", "w")).select("doc_id", "th", "j", "w.h1", "w.h2")


def _place(doc_id: Column, j: Column) -> Column:
    """One number that orders windows by document and place; a hash aggregate can take its minimum."""
    wide = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    return (wide * F.lit(1 << 31).cast("decimal(11,0)") + j).cast("decimal(38,0)")


def later_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, th, js: per document the sorted windows that occurred before; written out."""
    w = windows(docs, width)
    first = w.groupBy("h1", "h2").agg(F.min(_place(F.col("doc_id"), F.col("j"))).alias("first"), F.count(F.lit(1)).alias("n"))
    # Written out, so that the join below reads both sides through exchanges whose hot keys Spark can split.
    first = materialise(first.where(F.col("n") > 1).select("h1", "h2", "first"), "line-firsts")
    later = w.join(first, ["h1", "h2"]).where(_place(F.col("doc_id"), F.col("j")) > F.col("first"))
    later = later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("j")).alias("js"))
    later = materialise(later, "line-later")
    release(first)
    return later


def dedup_lines(docs: DataFrame, width: int = WINDOW, counts: bool = False) -> DataFrame:
    """The documents without later occurrences. ``counts`` adds n_lines and n_removed (long)."""
    th, j_id, j_th, js, kept = fresh(docs, "th", "j_id", "j_th", "js", "kept")
    later = later_windows(docs, width).select(F.col("doc_id").alias(j_id), F.col("th").alias(j_th), F.col("js").alias(js))
    # Always by sorted merge: the texts move once, in proportion to the input at every size.
    d = docs.withColumn(th, F.xxhash64(F.col("text")))
    d = d.join(later.hint("merge"), F.col("doc_id").eqNullSafe(q(j_id)) & (q(th) == q(j_th)), "left")
    d = d.withColumn(kept, F.when(q(js).isNotNull(), _without(_lines(F.col("text")), q(js), width)))
    text = F.when(q(js).isNull(), F.col("text")).otherwise(F.array_join(q(kept), "\n"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias(c))
        elif c == "n_chars":
            cols.append(F.when(q(js).isNull(), q(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(q(c))
    if counts:
        n = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long")
        n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n)
        cols += [n.alias("n_lines"), F.when(q(js).isNull(), F.lit(0)).otherwise(n - F.size(q(kept))).cast("long").alias("n_removed")]
    return d.select(cols)


def _without(lines: Column, js: Column, width: int) -> Column:
    """Merge the covered stretches and join the slices between them; linear in the lines."""
    pos = _filled(lines)
    last = F.size(js) - 1
    starts = F.transform(F.filter(js, lambda j, k: (k == 0) | (F.get(js, k - 1) + (width - 1) < j)), lambda j: F.get(pos, j))
    ends = F.transform(F.filter(js, lambda j, k: (k == last) | (F.get(js, k + 1) > j + (width - 1))), lambda j: F.get(pos, j + (width - 1)))
    edges = F.transform(F.concat(starts, F.array(F.size(lines))), lambda e, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1).alias("a"), e.alias("b")))
    return F.flatten(F.transform(edges, lambda e: F.slice(lines, e["a"] + 1, F.greatest(e["b"] - e["a"], F.lit(0)))))
