"""Substring dedup with compressed FM-indexes.

Every window of ``window`` words is dealt to a shard by the smallest hash of its runs of ``gram`` words, so
equal windows always meet, whatever the number of shards. Consecutive windows with one such hash travel as
one segment of text; a Bloom filter of fixed size, made from the hashes that come twice in the corpus,
keeps most other segments at home (what it lets through needlessly costs time, never rows). Equal segments
are combined before the shuffle and keep their first occurrence. A shard concatenates whole groups of
segments, builds a Burrows-Wheeler transform in a wavelet matrix of packed bits, and finds the matching
statistic of each window, up to the threshold, by backward search; the interval of a window that occurs
twice gives its first occurrence. Segments of very common hashes are cut into single windows, which are
spread by their own hashes, so no shard's size depends on a passage's frequency.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, rolled, scan_words, table, text_of

WINDOW = 20
GRAM = 6
#: log2 of the Bloom filter's bits: 16 MB for the driver and each Python worker, at any input size.
BLOOM_BITS = 27
#: A hash with more segments than this is spread window by window.
COMMON = 50_000
PIECE = 31
CHUNK_WORDS = 400_000


class WaveletMatrix:
    """Rank over a sequence of small integers, one level of packed bits and sampled counts for each bit."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32))
            ones = bit.astype(bool)
            self.zeros.append(n - int(ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])
        self.starts = self.walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            w = i >> 6
            below = self.words[k][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][w] + np.bitwise_count(below)
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] comes before place i[k]."""
        return self.walk(c, i) - self.starts[c]


class FMIndex:
    """Of a text of integers (0 separates). Suffixes are sorted by 32 symbols, so patterns may have 31."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank = text.astype(np.int64)
        for k in (1, 2, 4, 8, 16):
            after = np.r_[rank[k:] + 1, np.zeros(min(k, n), np.int64)]
            kinds, rank = np.unique(rank * (n + symbols + 2) + after, return_inverse=True)
            if len(kinds) == n:
                break
        self.places = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(text[self.places - 1], symbols)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]

    def matches(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns text[at : at + length] those that occur twice at least: (which, interval from, to).

        Backward search; a pattern is left as soon as a suffix of it occurs once only.
        """
        which = np.arange(len(at))
        c = text[at + length - 1]
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(length - 2, -1, -1):
            more = hi - lo > 1
            which, lo, hi = which[more], lo[more], hi[more]
            c = text[at[which] + k]
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
        more = hi - lo > 1
        return which[more], lo[more], hi[more]


def repeats(segments: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each segment a bit for each window that also starts before the segment's own place (doc, start)."""
    ids: dict[bytes, int] = {}
    words = [s.split() for s in segments]
    lengths = np.array([len(w) for w in words])
    flat = np.fromiter((ids.setdefault(x, len(ids) + 1) for w in words for x in (*w, None)), np.int64, int(lengths.sum()) + len(words))
    ends = np.cumsum(lengths + 1) - 1
    flat[ends] = 0
    begins = ends - lengths
    index = FMIndex(flat, int(flat.max()) + 1)
    count = lengths - window + 1
    owner = np.repeat(np.arange(len(words)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    which, lo, hi = index.matches(flat, begins[owner] + offset, window)
    masks = np.zeros(len(words), np.int64)
    if not len(which):
        return masks
    left, of = np.unique(lo, return_inverse=True)
    right = np.zeros(len(left), np.int64)
    right[of] = hi
    own = np.repeat(np.arange(len(words)), lengths + 1)[index.places]
    doc, start = docs[own], starts[own] + index.places - begins[own]
    # Intervals do not overlap: reduce each from its start to the next one's, then only inside.
    size = right - left
    inside = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    bounds = np.cumsum(size) - size
    d = np.minimum.reduceat(doc[inside], bounds)
    s = np.minimum.reduceat(np.where(doc[inside] == np.repeat(d, size), start[inside], np.iinfo(np.int64).max), bounds)
    d, s, o, k = d[of], s[of], owner[which], offset[which]
    earlier = (d < docs[o]) | ((d == docs[o]) & (s < starts[o] + k))
    np.bitwise_or.at(masks, o[earlier], np.int64(1) << k[earlier])
    return masks


class Windows:
    """All windows of the texts of an Arrow binary array, and for each its mark: the smallest hash of its grams."""

    def __init__(self, texts, window: int = WINDOW, gram: int = GRAM):
        self.window, self.span = window, window - gram + 1
        self.hashes, self.starts, self.ends, self.row, self.bytes = scan_words(texts)
        self.grams = rolled(self.hashes, gram)
        n = max(0, len(self.hashes) - window + 1)
        #: Places where a window lies in one text.
        self.at = np.flatnonzero(self.row[:n] == self.row[window - 1 :]) if n else np.empty(0, np.int64)
        self.marks = sliding(np.minimum, self.grams, self.span) if n else np.empty(0, np.uint64)
        #: The number of words in the text before each word.
        self.place = np.arange(len(self.row)) - np.searchsorted(self.row, self.row)

    def anchors(self) -> np.ndarray:
        """The gram hashes that are some window's mark, once for each place: equal windows at two places give two."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        held = np.zeros(len(self.marks) + 2 * (self.span - 1), np.uint64)
        held[self.at + self.span - 1] = self.marks[self.at]
        return self.grams[sliding(np.maximum, held, self.span) == self.grams]

    def segments(self, kept: Filter) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(shard key, row, first window's place, windows, text) of what the filter lets through.

        A segment is a run of windows of one text with one mark, of PIECE windows at most; of a very
        common mark each window is a segment, its key its own hash.
        """
        at, marks = self.at, self.marks[self.at]
        new = np.ones(len(at), bool)
        new[1:] = (marks[1:] != marks[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        start = np.flatnonzero(since % PIECE == 0)
        count = np.diff(np.r_[start, len(at)])
        some = kept.has(marks[start])
        if kept.common.size:
            common = np.isin(marks[start], kept.common)
            yield from self._cut(at[start[some & ~common]], count[some & ~common], marks[start[some & ~common]])
            n = count[some & common]
            single = np.repeat(at[start[some & common]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield from self._cut(single, np.ones(len(single), np.int64), rolled(self.hashes, self.window)[single])
        else:
            yield from self._cut(at[start[some]], count[some], marks[start[some]])

    def _cut(self, at: np.ndarray, count: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
        a, b = self.starts[at], self.ends[at + count + self.window - 2]
        for key, row, place, n, x, y in zip(keys.tolist(), self.row[at].tolist(), self.place[at].tolist(), count.tolist(), a.tolist(), b.tolist(), strict=True):
            yield key, row, place, n, self.bytes[x:y].tobytes()


def sliding(best, x: np.ndarray, span: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``span`` consecutive elements."""
    width, out = 1, x
    while width * 2 <= span:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(out) - (span - width)], out[span - width :])


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made from it stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


class Filter:
    """The marks that come twice (never a miss), and those that are very common."""

    def __init__(self, bits: np.ndarray, common: np.ndarray):
        self.bits, self.common = bits, common

    def has(self, marks: np.ndarray) -> np.ndarray:
        return np.logical_and(*((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) for at in places(marks)))


def places(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BLOOM_BITS) - 1)
    return (marks & low).astype(np.int64), ((marks >> np.uint64(BLOOM_BITS)) & low).astype(np.int64)


def signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space).

    A word goes if a window over it also starts earlier (smaller id, or same document and earlier). Null
    and empty texts have no words; texts shorter than a window keep all. Ids are ordered as integers; null
    ids and those that are none come after all others;
    rows with one id are the same place: none removes from the other. An empty table gives no rows;
    other columns are ignored. Windows have up to 31 words.
    """
    base = docs.select(F.coalesce(F.expr(f"try_cast(`{id}` AS BIGINT)"), F.lit(2**63 - 1)).alias("_o"), F.xxhash64(text_of(text)).alias("_h"), F.col(id).alias("_id"), text_of(text).alias("_t"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = Windows(part.column(0).cast(pa.binary()), window).anchors()
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["mark"])

    counts = checkpointed(base.select("_t").mapInArrow(marks, "mark long").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"))
    at = F.explode(F.array(F.col("mark").bitwiseAND((1 << BLOOM_BITS) - 1), F.shiftrightunsigned("mark", BLOOM_BITS).bitwiseAND((1 << BLOOM_BITS) - 1)))
    cells = counts.select("mark", "n", at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell"))
    cells = cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"), F.max(F.when(F.col("n") > COMMON, F.col("n"))).alias("most"))
    found = cells.toArrow()  # one row for each 64-bit cell of the filter at most
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    common = np.empty(0, np.int64)
    if found["most"].null_count < len(found):
        common = counts.where(F.col("n") > COMMON).select("mark").toArrow()["mark"].to_numpy()  # 8 bytes for COMMON places at least
    # Captured, not broadcast: functions travel by value, a broadcast's classes would not.
    kept = Filter(bits, np.array(common, np.int64).view(np.uint64))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                own: dict[tuple[int, bytes], list] = {}
                for key, row, place, _, segment in Windows(part.column(1).cast(pa.binary()), window).segments(kept):
                    seen = own.setdefault((row, segment), [key, place, 0])
                    seen[1], seen[2] = min(seen[1], place), seen[2] + 1
                yield segment_batch([(key, segment, ids[row], place, n) for (row, segment), (key, place, n) in own.items()])

    def segment_batch(rows: list[tuple]) -> pa.RecordBatch:
        key, segment, o, start, n = zip(*rows, strict=True) if rows else ([],) * 5
        return pa.RecordBatch.from_arrays([signed(key), pa.array(segment, pa.binary()), pa.array(o, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], ["key", "segment", "o", "start", "n"])

    distinct = base.select("_o", "_t").mapInArrow(texts, "key long, segment binary, o long, start long, n long")
    distinct = distinct.groupBy("key", "segment").agg(F.min(F.struct("o", "start")).alias("first"), F.sum("n").alias("n")).select("key", "segment", "first.*", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def done(part: pa.Table) -> pa.RecordBatch:
            segs = part["segment"].to_pylist()
            o, start, n = (part[c].to_numpy() for c in ("o", "start", "n"))
            mask = repeats(segs, o, start, window) if segs else np.empty(0, np.int64)
            use = np.flatnonzero((n > 1) | (mask != 0))
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(segs[k]) for k in use], pa.binary()), pa.array(o[use]), pa.array(start[use]), pa.array(mask[use])], ["digest", "first_o", "first_start", "mask"])

        for batch in batches:
            held.append(batch)
            words += batch.num_rows * (window + 7)
            if words >= CHUNK_WORDS:
                # The last key's segments may go on; where it begins is sought in this batch, and before it only if it fills the batch.
                keys = batch.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut or len(held) > 1 and held[-2].column(0)[-1].as_py() != keys[-1]:
                    yield done(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                    held, words = [batch.slice(cut)], (len(keys) - cut) * (window + 7)
        if held:
            yield done(pa.Table.from_batches(held))

    judged = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(search, "digest binary, first_o long, first_start long, mask long")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, hs = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = Windows(part.column(2).cast(pa.binary()), window).segments(kept)
                yield member_batch([(xxhash.xxh3_128_digest(x), ids[row], hs[row], place, n) for _, row, place, n, x in found])

    def member_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else ([],) * 5
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "_o", "_h", "start", "windows"])

    every = base.select("_o", "_h", "_t").mapInArrow(members, "digest binary, _o long, _h long, start long, windows long")
    same = (F.col("_o") == F.col("first_o")) & (F.col("start") == F.col("first_start"))
    gone = every.join(judged.hint("merge"), "digest").select("_o", "_h", "start", F.when(same, F.col("mask")).otherwise(F.expr("shiftleft(1L, cast(windows AS int)) - 1")).alias("mask")).where("mask != 0")
    by_doc = gone.groupBy("_o", "_h").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, removed, kept = [], [], []
                for t, starts, masks in zip(part.column(1).cast(pa.binary()), part.column(2), part.column(3), strict=True):
                    words = t.as_py().split()
                    counts.append(len(words))
                    if starts.is_valid:
                        s, m = starts.values.to_numpy(), masks.values.to_numpy()
                        k, j = np.nonzero((m[:, None] >> np.arange(PIECE)) & 1)
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, s[k] + j, 1)
                        np.add.at(gone, s[k] + j + window, -1)
                        words = list(compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                shas = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), shas, texts], ["_id", "n_words", "n_removed", "kept_sha256", "kept"])

    both = base.join(by_doc.hint("merge"), ["_o", "_h"], "left").select("_id", "_t", "starts", "masks")
    out = both.mapInArrow(cut, f"_id {docs.schema[id].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.col("_id").alias(id), "n_words", "n_removed", "kept_sha256", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE = {
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)"""
}
