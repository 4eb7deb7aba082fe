"""Helpers shared by the corpus operators: checkpoints, word scanning, n-gram hashes, link components."""

from __future__ import annotations

import tempfile
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this package.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, which all executors share.

    It is the one that ``spark.checkpoint.dir`` names; only where that is unset and all runs on one machine
    is a temporary one made. On a cluster an unset one is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text column, null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def key_of(id: str) -> Column:
    """An id to join by in which null equals null."""
    return F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit("null"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span of an ordered array, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


class Hashes(dict):
    """64-bit hashes of words, remembered; emptied when it holds ``most`` words, so its memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(42).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 19


def powers(n: int, of: int) -> np.ndarray:
    """of**0 ... of**(n - 1) modulo 2**64."""
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def scan_words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, memoryview]:
    """Words of an Arrow binary array: 64-bit hashes, first and last bytes (exclusive), the row of each, the bytes.

    The hash of a word is a polynomial of its bytes, taken from prefix sums; nothing is made for each word.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.frombuffer(whole, np.uint8)
    none = np.empty(0, np.int64)
    if not len(data):
        return none.view(np.uint64), none, none, none, whole
    space = (data == 32) | ((data - np.uint8(9)) <= 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= space
    edge[:-1] |= space
    word = ~space
    starts, ends = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:]) + 1
    hashes = np.empty(len(starts), np.uint64)
    room = int(max(_PIECE, (ends - starts).max(initial=0))) + 1
    up, down = powers(room, _ODD), powers(room, pow(_ODD, -1, 2**64))
    k = 0
    while k < len(starts):
        n = max(k + 1, int(np.searchsorted(ends, starts[k] + _PIECE, "right")))
        base = starts[k]
        sums = np.zeros(ends[n - 1] - base + 1, np.uint64)
        np.cumsum(_BYTES[data[base : ends[n - 1]]] * up[: len(sums) - 1], out=sums[1:])
        hashes[k:n] = (sums[ends[k:n] - base] - sums[starts[k:n] - base]) * down[starts[k:n] - base]
        k = n
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return hashes, starts, ends, np.searchsorted(offsets, starts, "right") - 1, whole


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive elements (none if there are fewer)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def shingle_hashes(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """XXH64 of every run of n words joined by a space; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[k:] for k in range(n)), strict=False) if len(words) >= n else [words]
    count = max(1, len(words) - n + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64, count)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that can be reached; one row for each node on an edge.

    Alternating large-star and small-star steps. Edges stay as many as nodes or fewer, a hub's edges are
    minimised before the shuffle, and joins on a hub are left to the adaptive skew join. Lineage is cut
    every round; rounds go on until one changes nothing, some log(n) squared of them. Null ends are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = checkpointed(e)
    before = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
