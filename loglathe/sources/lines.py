"""Lines of text as (line_no, value)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, separator: str = "\n", dense: bool = True) -> DataFrame:
    """Lines of text files; only ``separator`` ends one.

    Dense numbers count from 1 in order of the files' names and of the places
    there, however the files are split; they need the sizes of the splits
    first, which is one narrow pass over the files. Others rise within a split
    only, leave gaps and cost nothing.
    """
    own = spark.read.option("lineSep", separator).text(path)
    own = own.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id"))
    if not dense:
        return own.select((F.col("id") + 1).alias("line_no"), "value")
    sizes = own.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("f", "b", "first", before.alias("before"))  # a row for each split of the files: lines stay where they are read
    return own.join(F.broadcast(starts), ["f", "b"]).select((F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def from_texts(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """Lines at hand, such as standard input's, numbered from 1."""
    return spark.createDataFrame([(i, t.removesuffix("\n")) for i, t in enumerate(texts, 1)], "line_no long, value string")


def stream_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """New text files of a folder as a stream; lines carry no number."""
    return spark.readStream.option("lineSep", separator).text(path).select(F.lit(None).cast("long").alias("line_no"), "value")
