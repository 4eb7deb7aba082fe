"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are partitioned by their number of shingles, in powers of two. A document that holds the wanted
share of an item's shingles lacks few enough of them that one at least of the item's smallest hashes
occurs in it: the bottom-k MinHash sketch of a partition takes k from the partition's largest size, and so
loses no match. Documents stream past the sketches once for each block of items; a block's size is bounded
by ``block_items`` and ``block_chars``, which is what is broadcast, and any number of blocks works.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, rolled, table, text_of

WORDS = 5
LEAST = 0.8
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8_000_000
TOKEN = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Index:
    """A block of items: their shingles, and the sketches' hashes with the items they point to."""

    def __init__(self, items: list[tuple[object, str]], n: int = WORDS, least: float = LEAST):
        hashes, sketch = Hashes(), []
        self.n, self.least, self.ids, self.shingles, self.lengths, self.hashes = n, least, [], [], [], []
        for id, text in items:
            w = words(text or "")
            if not w:
                continue
            k = min(n, len(w))
            h, s = rolled(hashes.of(w), k), [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
            own = np.unique(h)
            upper = 1 << (len(own) - 1).bit_length()
            size = min(len(own), upper - math.ceil(least * upper - 1e-9) + 1)
            sketch += [(x, len(self.ids)) for x in own[:size]]
            self.ids.append(id)
            self.shingles.append(set(s))
            self.lengths.append(k)
            self.hashes.append(own)
        sketch.sort()
        self.keys = np.array([x for x, _ in sketch], np.uint64)
        self.items = np.array([i for _, i in sketch], np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.sizes = sorted(set(self.lengths))

    def search(self, text: str, hashes: Hashes) -> list[tuple[int, int]]:
        """(item, shingles shared) of each item of which the text holds the wanted share."""
        w = words(text)
        if not w or not len(self.keys):
            return []
        own, found = hashes.of(w), []
        for k in self.sizes:
            h = rolled(own, k)
            maybe = np.unique(h[self.seen[(h & np.uint64(0xFFFFF)).astype(np.int64)]])
            lo, hi = np.searchsorted(self.keys, maybe), np.searchsorted(self.keys, maybe, "right")
            for item in {int(i) for a, b in zip(lo[lo < hi], hi[lo < hi], strict=True) for i in self.items[a:b]}:
                if self.lengths[item] == k:
                    at = np.flatnonzero(np.isin(h, self.hashes[item]))
                    shared = len(self.shingles[item] & {" ".join(w[i : i + k]) for i in at})
                    if shared >= self.least * len(self.shingles[item]) - 1e-9:
                        found.append((item, shared))
        return found


def blocks(items: DataFrame, id: str, text: str, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    held, chars = [], 0
    for r in items.select(id, text_of(text).alias("_t")).toLocalIterator():
        if held and (len(held) >= block_items or chars + len(r[1]) > block_chars):
            yield held
            held, chars = [], 0
        held.append((r[0], r[1]))
        chars += len(r[1])
    if held:
        yield held


def contained(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, least: float = LEAST, **bounds) -> DataFrame:
    """(id, item, n_shingles, n_shared, containment) of each pair at or above ``least``.

    Words are runs of letters, digits and underscores, in lower case; shingles are distinct; an item of
    fewer than ``n`` words is one shingle, sought as it is; items and documents without words (null, empty)
    match nothing. Repeated rows are reported as often as they come. Empty tables give no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}, n_shingles long, n_shared long, containment double"
    out = None
    for block in blocks(items, item_id, item_text, **bounds):
        # Captured, not broadcast: functions travel by value, a broadcast's classes would not.
        def run(batches: Iterator[pa.RecordBatch], index=Index(block, n, least)) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                rows = [(d, index.ids[i], len(index.shingles[i]), k) for d, t in zip(batch.column(0), batch.column(1), strict=True) for i, k in index.search(t.as_py(), hashes)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.as_py() for x in cols[0]], batch.column(0).type), pa.array(cols[1], kind), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array([k / m for k, m in zip(cols[3], cols[2], strict=True)], pa.float64())],
                    [id, item_id, "n_shingles", "n_shared", "containment"],
                )

        kind = pa.int64() if items.schema[item_id].dataType.simpleString() == "bigint" else None
        part = docs.select(id, text_of(text).alias("_text")).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, least: float = LEAST, **bounds) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item: nothing is shuffled. The rules of ``contained`` hold."""
    at = docs.columns.index(text)
    for block in blocks(items, item_id, item_text, **bounds):

        def run(batches: Iterator[pa.RecordBatch], index=Index(block, n, least)) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t.as_py() or "", hashes) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op9_decontamination": r"""
        WITH words AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
            UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') FROM benchmark),
        items AS (SELECT id, w, least(5, len(w)) AS k FROM words WHERE side = 'b' AND len(w) > 0),
        b AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM items),
        d AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM words, (SELECT DISTINCT k FROM items) WHERE side = 'd' AND len(w) >= k),
        n AS (SELECT id, count(*) AS n_shingles FROM b GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_shared, count(*) / any_value(n_shingles) AS containment
        FROM b JOIN d USING (k, s) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9"""
}
QUERIES = {"op9_decontamination": op9_decontamination}
