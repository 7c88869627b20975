"""Bounded-space online best-fit packing of tokenised documents.

Each document becomes the ids of a public byte-level BPE vocabulary and an end
id. Documents longer than a sequence are cut into full pieces, of which the
first may be shorter. Pieces go to packers in a seeded order; a packer holds a
fixed number of open bins, found through a bitset with one bit for each amount
of free space. A piece goes into the fullest bin that has room, which is the
lowest bit at or above its length; when too many bins are open, the fullest
closes first. The pieces in bins still open when a packer ends are packed once
more, longest first, by packers that each take over from several of the first.

Defined cases: null and empty texts are the end id alone; repeated rows are
separate documents; a very long text is encoded in parts that meet where no
ids merge, and cut, never shortened; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

CAPACITY = 1024
END_ID = 2
TOKENIZER_FILE = "byte_bpe_50k.json"
#: Open bins of a packer, at first and when what was left open is packed again.
OPEN, OPEN_AGAIN = 64, 4096
#: First packers whose open bins one second packer takes over.
FAN_IN = 32
#: Characters that are encoded at once; a longer text goes in parts, which bounds memory.
AT_ONCE = 2_000_000
#: How the vocabulary's pre-tokenizer cuts a text (fixed value of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def byte_ranks(tokenizer) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE whose ids rise in the order of its merges; None of any other."""
    spec = json.loads(tokenizer.to_str())
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or spec["normalizer"] or spec["post_processor"] or model["type"] != "BPE" or model.get("dropout"):
        return None
    # Bytes that print stand for themselves, the others for the code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [vocabulary[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if merges != sorted(merges) or len(merges) + 256 != len(vocabulary):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}


class Ids:
    """Text -> its ids as little-endian 32-bit bytes.

    Where ids rise in the order of merges, merging by rank gives the ids of
    the tokenizer itself (a test holds every merge to it), many times faster.
    Texts that hold an added token's string go to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = byte_ranks(self.tokenizer)
        self.by_rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        #: A single blank between other characters opens a stretch that merges never leave.
        self.seam = re.compile(r"(?<=\S) (?=\S)").search if ranks and not any(" " in t for t in added) else lambda text, at: None

    def part(self, text: str) -> bytes:
        if self.by_rank is None or self.added(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.by_rank(text)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > AT_ONCE and (seam := self.seam(text, at + AT_ONCE)):
            out.append(self.part(text[at : seam.start()]))
            at = seam.start()
        return b"".join([*out, self.part(text[at:] if at else text)])


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n ids: all are full but the first."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def pieces_udf(path: str, capacity: int = CAPACITY, end_id: int = END_ID):
    @F.pandas_udf(_PIECES)
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = Ids(path)
        end = end_id.to_bytes(4, "little")
        for texts in parts:
            out = []
            for text in texts:
                raw = (ids(text) if text else b"") + end
                n = len(raw) // 4
                starts = cut(n, capacity)
                out.append([{"start": a, "length": b - a, "ids_crc32": crc32(raw[4 * a : 4 * b])} for a, b in zip(starts, [*starts[1:], n], strict=True)])
            yield pd.Series(out)

    return pieces


class BestFit:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most_open: int, first_id: int) -> None:
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.bits, self.open = 0, 0
        #: By free space the open bins: their number and what they hold, as (offset, length).
        self.at: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own, holds = self._take(free)
        else:
            free, own, holds = self.capacity, self.next_id, []
            self.next_id += 1
        left, offset = free - length, self.capacity - free
        if left:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            holds.append((offset, length))
            self.at[left].append((own, holds))
            self.bits |= 1 << left
            self.open += 1
        return own, offset

    def _take(self, free: int) -> tuple[int, list]:
        out = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def still_open(self) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of all that open bins hold."""
        return [(own, *piece) for bins in self.at for own, holds in bins for piece in holds]


_FIRST = "doc_id {id}, piece int, start long, length long, ids_crc32 long, sequence long, offset long, still_open boolean"


def _first_id(level: int) -> int:
    return (level << 62) | (TaskContext.get().partitionId() << 36)


def _pack_first(capacity: int, most_open: int):
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFit(capacity, most_open, _first_id(0))
        for rows in parts:
            placed = [bins.place(n) for n in rows["length"].tolist()]
            yield rows.assign(sequence=[p[0] for p in placed], offset=[p[1] for p in placed], still_open=False)
        left = bins.still_open()
        if left:  # once more, for the second packers
            yield pd.DataFrame({"doc_id": None, "piece": 0, "start": 0, "length": [x[2] for x in left], "ids_crc32": 0, "sequence": [x[0] for x in left], "offset": [x[1] for x in left], "still_open": True})

    return pack


def _pack_again(capacity: int, most_open: int):
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFit(capacity, most_open, _first_id(1))
        for rows in parts:
            placed = [bins.place(n) for n in rows["length"].tolist()]
            yield pd.DataFrame({"was": rows["sequence"], "was_at": rows["offset"], "sequence_id": [p[0] for p in placed], "new_at": [p[1] for p in placed]})

    return pack


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, most_open: int = OPEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut_up = docs.select("doc_id", F.posexplode(pieces_udf(tokenizer or default_tokenizer(), capacity)(F.col("text"))).alias("piece", "p"))
    cut_up = cut_up.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut_up.withColumn("h", order).repartition(n, "h").sortWithinPartitions("h", "doc_id", "piece", "length", "ids_crc32").drop("h")
    # Parted, so that the second packers read no more than they pack.
    first = materialise(dealt.mapInPandas(_pack_first(capacity, most_open), _FIRST.format(id=kind)), "packed", "still_open")
    left = first.where(F.col("still_open")).select("sequence", "offset", "length")
    left = left.coalesce(max(1, n // FAN_IN)).sortWithinPartitions(F.col("length").desc(), "sequence", "offset")
    moved = materialise(left.mapInPandas(_pack_again(capacity, OPEN_AGAIN), "was long, was_at long, sequence_id long, new_at long"), "repacked")
    rows = first.where(~F.col("still_open")).join(moved, (F.col("sequence") == F.col("was")) & (F.col("offset") == F.col("was_at")), "left")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "sequence").alias("sequence_id"), F.coalesce("new_at", "offset").alias("offset"))
