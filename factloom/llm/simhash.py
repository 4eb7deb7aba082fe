"""SimHash near-dedup by the generalised pigeonhole principle.

64-bit fingerprints of word shingles; the bits are grouped into parts so that correlated bits share one;
for each fingerprint a dynamic programme shares the threshold out to the parts, unequally, by the number
of candidates that each part would give (estimated from histograms of all fingerprints); the parts are
probed and each candidate is verified. Inside a bucket only a spanning forest of the verified links is
written, never all pairs of a group of copies. Links become components; a component's name is its
smallest id.

The statistics are of fixed size: 64 x 64 bit pairs and 2 x parts histograms of at most 2**16 values. The
number of parts follows from the number of fingerprints: wider parts cost more probes and give fewer
candidates. A bucket with more rows than ``SPLIT`` is dealt out again: two of its fingerprints within the
distance agree in one of distance + 1 groups of the other bits at least, so each row goes to the bucket's
parts by each group's value, and no link is lost. The same is done in memory with what a task compares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, key_of, shingle_hashes, table, text_of

BITS = 64
WORDS = 4
SEED = 42
DISTANCE = 4
#: Buckets with more indexed rows are split between tasks.
SPLIT = 20_000
#: Rows that the search of a large bucket takes before the rest is dealt out.
STEPS = 128
#: Buckets of at most so many rows are compared whole, larger ones by a search that drops what is linked.
SMALL = 64


def fingerprint(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """Unsigned SimHash; zero for a text without words."""
    h = shingle_hashes(text.lower().split(), n, seed)
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp as a signed long) of every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), n, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id, "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text_of(text).alias("_text")).mapInArrow(run, f"`{id}` {kind}, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def parted(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of near-equal width: each part grows from the most correlated free pair by the bit that agrees most."""
    corr = np.abs(corr) * (1 - np.eye(BITS))
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (len(free)) // (parts - k)
        left = sorted(free)
        sub = corr[np.ix_(left, left)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [left[int(i)], left[int(j)]] if i != j else left[:2]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(rest[int(corr[np.ix_(rest, group)].sum(axis=1).argmax())])
        group = sorted(group[:width])
        free -= set(group)
        out.append(group)
    return out


def best_parts(n: int, most: int = DISTANCE) -> int:
    """The number of parts that costs least for n evenly spread fingerprints: probes and candidates of each.

    Each part but those that take the rest gets a threshold of 0; parts as wide as BITS / parts.
    """

    def cost(parts: int) -> float:
        width, left = BITS // parts, most - parts + 1
        each = [left // parts + (k < left % parts) for k in range(parts)]
        balls = [sum(math.comb(width, r) for r in range(t + 1)) for t in each]
        return sum(balls) * (1 + n / 2.0**width)

    return min(range(2, most + 1), key=cost)


def values(bits: np.ndarray, at: list[int]) -> np.ndarray:
    return bits[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64))


def masks(width: int, most: int) -> list[np.ndarray]:
    """By number of flipped bits, the xor masks of a part."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(width), k)], np.int64) for k in range(most + 1)]


class Plan:
    """Parts, and per half part and value the share of fingerprints at each distance: what the programme estimates from."""

    def __init__(self, groups: list[list[int]], histograms: list[np.ndarray], distance: int = DISTANCE):
        self.groups, self.distance = groups, distance
        self.most = distance - len(groups) + 1
        self.n = max(1.0, float(histograms[0].sum())) if histograms else 1.0
        self.shares = []
        for h in histograms:
            v = np.arange(len(h))
            flips = masks(len(h).bit_length() - 1, min(self.most, len(h).bit_length() - 1))
            at = np.zeros((len(h), self.most + 1))
            for k, f in enumerate(flips):
                for m in f:
                    at[:, k] += h[v ^ m]
            self.shares.append(at / self.n)
        self.flips = [masks(len(g), min(self.most, len(g))) for g in groups]

    @staticmethod
    def halves(groups: list[list[int]]) -> list[list[int]]:
        return [h for g in groups for h in (g[: len(g) // 2], g[len(g) // 2 :])]

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """For each fingerprint and part a threshold of -1 or more; they add up to distance - parts + 1.

        Any two fingerprints within the distance agree within the threshold in some part: else they would
        differ in at least sum(threshold + 1) = distance + 1 bits.
        """
        parts, most = len(self.groups), self.most
        halves = self.halves(self.groups)
        cost = np.zeros((len(bits), parts, most + 2))
        for p in range(parts):
            a = self.shares[2 * p][values(bits, halves[2 * p])]
            b = self.shares[2 * p + 1][values(bits, halves[2 * p + 1])]
            exact = np.stack([sum(a[:, i] * b[:, k - i] for i in range(k + 1)) for k in range(most + 1)], axis=1)
            probes = np.cumsum([len(self.flips[p][k]) if k < len(self.flips[p]) else 0 for k in range(most + 1)])
            cost[:, p, 1:] = np.cumsum(exact, axis=1) * self.n + probes
        total = most + parts  # thresholds + 1, added up
        best = np.full((len(bits), total + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for p in range(parts):
            options = np.stack([np.pad(best, ((0, 0), (e, 0)), constant_values=np.inf)[:, : total + 1] + cost[:, p, e : e + 1] for e in range(most + 2)], axis=2)
            picks.append(options.argmin(axis=2))
            best = options.min(axis=2)
        left = np.full(len(bits), total)
        out = np.zeros((len(bits), parts), np.int64)
        for p in range(parts - 1, -1, -1):
            e = picks[p][np.arange(len(bits)), left]
            out[:, p] = e - 1
            left -= e
        return out

    def probes(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, fingerprint, kind): 0 for a probe, 1 for an indexed row that is one too, 2 for one that its threshold keeps from probing."""
        bits = bits_of(fps)
        limits = self.thresholds(bits)
        for p, group in enumerate(self.groups):
            own = values(bits, group) | (p << 56)
            yield own, fps, np.where(limits[:, p] >= 0, 1, 2).astype(np.int8)
            for k in range(1, self.most + 1):
                if k < len(self.flips[p]) and len(at := np.flatnonzero(limits[:, p] >= k)):
                    step = max(1, 1_000_000 // len(self.flips[p][k]))
                    for i in range(0, len(at), step):
                        some = at[i : i + step]
                        key = (own[some][:, None] ^ self.flips[p][k][None, :]).ravel()
                        yield key, np.repeat(fps[some], len(self.flips[p][k])), np.zeros(len(key), np.int8)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def by_groups(fps: np.ndarray, most: int, depth: int = 0) -> Iterator[np.ndarray]:
    """Values by each of most + 1 groups of bits; fingerprints within the distance agree in one at least.

    Each depth deals the bits to the groups in another way. A value tells its group and depth.
    """
    order = np.random.default_rng(depth).permutation(BITS)
    bits = bits_of(fps)
    for g in range(most + 1):
        yield values(bits, sorted(order[g :: most + 1].tolist())) | (g << 56)


def linked(index: np.ndarray, probes: np.ndarray, most: int, depth: int = 0) -> list[np.ndarray]:
    """Links of one large bucket that tell its components.

    A search that drops what is linked settles dense buckets in a few steps; what it leaves of a sparse one
    is dealt out by groups of bits, in which only few rows meet.
    """
    out, index, probes = forest(index, probes, most, None if depth > 8 else STEPS)
    if len(index):
        flags = np.r_[np.ones(len(index), np.int8), np.zeros(len(probes), np.int8)]
        fps = np.concatenate([index, probes])
        for key in by_groups(fps, most, depth):
            order = np.lexsort((-flags, key))
            out.append(bucket_links(key[order], fps[order], flags[order], most, depth + 1))
    return out


def forest(index: np.ndarray, probes: np.ndarray, most: int, steps: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Links of one bucket, only as many as tell its components: what has been linked is not compared again.

    Also the indexed rows and probes that are still to be compared after ``steps``.
    """
    out, free_i, free_p, stack, done = [], index, probes, [], 0
    while len(free_i) or stack:
        if done == steps:
            again = [np.array([x for x, indexed in stack if indexed == kind], np.uint64) for kind in (True, False)]
            return out, np.concatenate([free_i, again[0]]), np.concatenate([free_p, again[1]])
        if not stack:
            stack, free_i = [(free_i[0], True)], free_i[1:]
        done += 1
        at, indexed = stack.pop()
        near = distance(free_i, at) <= most
        found = free_i[near]
        free_i = free_i[~near]
        stack += [(x, True) for x in found]
        if indexed:
            near = distance(free_p, at) <= most
            more = free_p[near]
            free_p = free_p[~near]
            stack += [(x, False) for x in more]
            found = np.concatenate([found, more])
        if len(found):
            out.append(np.stack([np.full(len(found), at), found]))
    return out, free_i, np.empty(0, np.uint64)


def bucket_links(key: np.ndarray, fp: np.ndarray, indexed: np.ndarray, most: int, depth: int = 0) -> np.ndarray:
    """Links (2 x n) in whole buckets, sorted by bucket with indexed rows first; those without any probe need none."""
    if not len(key):
        return np.empty((2, 0), np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    use = (indexed[starts] >= 1) & (sizes > 1) & (indexed[starts + sizes - 1] < 2)
    out = []
    for s, n in zip(starts[use & (sizes > SMALL)], sizes[use & (sizes > SMALL)], strict=True):
        rows, flags = fp[s : s + n], indexed[s : s + n]
        out += linked(np.unique(rows[flags >= 1]), np.unique(rows[flags == 0]), most, depth)
    small = np.repeat(use & (sizes <= SMALL), sizes)
    key, fp, indexed = key[small], fp[small], indexed[small]
    for shift in range(1, int(sizes[use & (sizes <= SMALL)].max(initial=0))):
        at = np.flatnonzero((key[:-shift] == key[shift:]) & (indexed[:-shift] >= 1))
        at = at[(distance(fp[at], fp[at + shift]) <= most) & (fp[at] != fp[at + shift])]
        out.append(np.stack([fp[at], fp[at + shift]]))
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.uint64)


def links(fps: DataFrame, most: int = DISTANCE, parts: int | None = None, split: int = SPLIT) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column fp, distinct) within ``most`` differing bits."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            both += bits.T @ bits
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j].astype(np.int64))], ["i", "j", "n"])

    n = fps.count()
    parts = best_parts(n, most) if parts is None else parts
    counts = np.zeros((BITS, BITS))
    for i, j, c in fps.select("fp").mapInArrow(pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        counts[i, j] = counts[j, i] = c
    p = counts / max(1, n)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    groups = parted((p - np.outer(one, one)) / np.outer(spread, spread), parts)
    halves = Plan.halves(groups)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(1 << len(h), np.int64) for h in halves]
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy().view(np.uint64))
            for k, h in enumerate(halves):
                held[k] += np.bincount(values(bits, h), minlength=1 << len(h))
        for k, h in enumerate(held):
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(h[at])], ["k", "v", "n"])

    held = [np.zeros(1 << len(h), np.int64) for h in halves]
    for k, v, c in fps.select("fp").mapInArrow(histograms, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n")).collect():
        held[k][v] = c
    plan = Plan(groups, held, most)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy().view(np.uint64))
            for p, g in enumerate(groups):
                key, count = np.unique(values(bits, g) | (p << 56), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["key", "n"])

    # 8 bytes for each ``split`` fingerprints and part at most.
    hot = np.sort(fps.select("fp").mapInArrow(own, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > split).select("key").toArrow()["key"].to_numpy())

    def dealt(key: np.ndarray, fp: np.ndarray, indexed: np.ndarray) -> Iterator[tuple]:
        """Rows of hot buckets go to parts of them, the others stay."""
        at = np.searchsorted(hot, key)
        is_hot = (hot[np.minimum(at, len(hot) - 1)] == key) if len(hot) else np.zeros(len(key), bool)
        yield key[~is_hot], fp[~is_hot], indexed[~is_hot]
        if is_hot.any():
            for value in by_groups(fp[is_hot], most, 99):
                mixed = (key[is_hot].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (value.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                yield mixed.view(np.int64) | np.int64(-(2**63)), fp[is_hot], indexed[is_hot]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in plan.probes(batch.column(0).to_numpy().view(np.uint64)):
                for key, fp, indexed in dealt(*row):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(indexed)], ["key", "fp", "indexed"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def whole(last: bool):
            """Links of the buckets that have ended; the last one may go on in the next batch."""
            nonlocal held, rows
            key, fp, indexed = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            held, rows = [(key[cut:], fp[cut:], indexed[cut:])], len(key) - cut
            found = bucket_links(key[:cut], fp[:cut], indexed[:cut], most).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        limit = 100_000
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()))
            rows += batch.num_rows
            if rows >= limit:
                yield whole(False)
                limit = max(100_000, 2 * rows)
        if rows:
            yield whole(True)

    probes = fps.select("fp").mapInArrow(probe, "key long, fp long, indexed byte")
    return probes.repartition("key").sortWithinPartitions("key", F.desc("indexed")).mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, seed: int = SEED, most: int = DISTANCE, parts: int | None = None, split: int = SPLIT) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows are returned as
    often as they come. A null id is never a component's name unless it has no other; an empty table gives
    no rows; other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, id, text, n, seed))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(id).alias("low")))
    roots = connected_components(links(distinct, most, parts, split))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of, "fp").select(id, hexed.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that whose id names the component.

    Ids may be null or repeated: a row goes by id and text, and of a component's texts under its id that of
    the smallest MD5 stays. Rows alike in both leave one, the smallest by its other columns as JSON.
    """
    digest = F.md5(text_of(text))
    mark = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), digest.alias("digest"))
    found = near_duplicates(docs.select(mark.alias(id), text), id, text, **options)
    first = found.where(F.col(id).eqNullSafe(F.col("component_id"))).select(F.concat("component_id.digest", key_of("component_id.id")).alias("_key"))
    others = F.to_json(F.struct(F.col(text).isNull().alias("_null"), *[F.col(f"`{c}`") for c in docs.columns if c != text]))
    rows = docs.select(F.struct("*").alias("_row"), F.concat(digest, key_of(id)).alias("_key"), others.alias("_tie"))
    return rows.join(first.hint("merge"), "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", "_tie").alias("_row")).select("_row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLE: dict[str, str] = {}
