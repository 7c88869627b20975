"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank and the five ASCII space controls.
WORD = r"[^\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent on a single machine (tests) one is made;
    on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
        path = f"file://{tempfile.mkdtemp(prefix='loglathe-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def new_path(spark: SparkSession, name: str) -> str:
    """A folder yet to be made, under one of this application that goes when it ends."""
    top = f"{shared_dir(spark)}/loglathe/{spark.sparkContext.applicationId}"
    system, at = _file_system(spark, top)
    if not system.exists(at):
        system.mkdirs(at)
        system.deleteOnExit(at)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors. ``release`` removes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loglathe_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove what ``materialise`` wrote for these frames, once nothing lazy reads it any more."""
    for df in frames:
        path = getattr(df, "__dict__", {}).pop("_loglathe_path", None)
        if path:
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system that nothing reads any more."""
    system, at = _file_system(spark, path)
    system.delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate += "_"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def q(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_in_parts(text: str | None, at_once: int, lower: bool = False) -> Iterator[list[bytes]]:
    """The words of a text, ``at_once`` at a time, so that a long text's aren't held together."""
    raw = text.encode("utf-8", "replace") if text else b""
    raw = raw.lower() if lower else raw
    while raw:
        words = raw.split(None, at_once)
        raw = words.pop() if len(words) > at_once else b""
        if words:
            yield words


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordTable(dict):
    """Word bytes -> row number of the arrays a subclass fills; bounded.

    ``start()`` empties it once it holds ``limit`` words, so call that between
    texts: numbers handed out before are void afterwards.
    """

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def start(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.fresh = []
            self.reset()

    def reset(self) -> None:
        raise NotImplementedError
