"""Phrase collocations with generalised suffix automata.

Each task builds, for every few megabytes of its texts, the suffix automaton of all their pieces (runs of words
that no punctuation parts) down to a bounded depth: a state for each substring, its transitions (parent, word),
its suffix link (the state of the substring without its first word) and the size of its endpos set. Languages are
told apart by the transitions from the root, so one automaton serves them all. Endpos counts are summed over all
shards. A phrase cannot be frequent unless its parent and its suffix link are: level by level, only substrings
whose two shorter ones may be frequent are counted, first by 64-bit hash, then, for those hashes that are frequent,
by their words, so what is returned is exact. A Bloom filter of fixed size carries the frequent hashes; what it
lets through needlessly costs time only. Places are tested by rolling hash before states are made, so from the second
scan on an automaton has states for what may be frequent only. Each shard's counts travel in ``BUCKETS`` rows by hash. A phrase hands its count along its suffix link and to its parent, which
are all the ways in which a phrase of one word less can lie in it; the largest count decides on subsumption.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, table, text_of
from .substring_dedup import BLOOM_BITS, Filter

#: Bytes of text of one automaton: its memory is some thirty times that, or that of one longer text.
SHARD_BYTES = 3_000_000
#: Each language's phrases are ranked in so many parts before the first of each part are ranked together.
PARTS = 64
ROWS = 100_000
#: Hashes and phrases are summed in so many groups; a task's counts are one row for each.
BUCKETS = 2048
#: Buckets are summed together up to so many counts.
GROUP = 2_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lexed(texts: pa.BinaryArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All words in lower case (A-Z), the text of each, and whether the next word stands in the same piece."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KIND[data]
    word = kind == WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= ~word
    edge[:-1] |= ~word
    starts, ends = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:]) + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    breaks = np.cumsum(kind == BREAK)[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[data[word]])])
    return words.dictionary_encode(), row, joined


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, each key's number among them, how often each comes."""
    if not len(keys):
        return keys, np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.flatnonzero(new)
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[starts], order[starts], number, np.diff(np.r_[starts, len(keys)])


def hashed(values: pa.Array) -> np.ndarray:
    """The hash of each string, from slices of the one buffer: a Python object for each Arrow value costs thrice as much."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    data = memoryview(values.buffers()[2] or b"")
    return np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(ends, ends[1:], strict=False)), np.uint64, len(values))


class Level:
    """The states of one depth: parent, last word, suffix link (states of the depth above), endpos count, a place, hash."""

    def __init__(self, parent: np.ndarray, last: np.ndarray, link: np.ndarray, count: np.ndarray, place: np.ndarray, hash: np.ndarray):
        self.parent, self.last, self.link, self.count, self.place, self.hash = parent, last, link, count, place, hash


class Automaton:
    """The suffix automaton of several texts' pieces, cut at a depth; substrings are kept apart by language.

    With a filter only places are gone on from whose ``of`` words it may have: depth ``of`` has the states of these,
    the next one those whose parent and suffix link are among them; depths from 2 to before it have what these need.
    """

    def __init__(self, texts: pa.BinaryArray, langs: pa.StringArray, depth: int, kept: Filter | None = None, of: int = 0):
        words, row, joined = lexed(texts)
        self.words, self.ids = words.dictionary, words.indices.to_numpy()
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        many = max(1, len(self.words))
        labels, place, one, count = numbered(coded.indices.to_numpy().astype(np.int64)[row] * many + self.ids)
        self.lang = labels // many
        of_word, of_lang = hashed(self.words), hashed(self.langs)
        root = np.zeros(len(labels), np.int64)
        hashes = mixed(of_word[labels % many] + of_lang[self.lang] * _ODD)
        self.levels = [Level(root, np.arange(len(labels)), root, count, place, hashes)]
        here = one
        for d, at in enumerate(self._places(joined, one, hashes, depth, kept, of), 2):
            upper = self.levels[-1]
            before = np.full(len(one), -1, np.int32)
            before[at_before if d > 2 else slice(None)] = here
            keys, place, here, count = numbered(before[at].astype(np.int64) * len(labels) + one[at + d - 1])
            parent, last = keys // max(1, len(labels)), keys % max(1, len(labels))
            self.levels.append(Level(parent, last, before[at[place] + 1], count, at[place], mixed(upper.hash[parent] * _ODD + hashes[last])))
            at_before = at

    @staticmethod
    def _places(joined: np.ndarray, one: np.ndarray, hashes: np.ndarray, depth: int, kept: Filter | None, of: int) -> list[np.ndarray]:
        """The places at which a substring of 2, 3 ... ``depth`` words begins that gets a state."""
        n, runs = len(one), [np.ones(len(one), bool)]
        for d in range(2, depth + 1):  # within a piece
            run = runs[-1].copy()
            run[: n - d + 2] &= joined[d - 2 :]
            runs.append(run)
        if kept is not None:
            at = np.flatnonzero(runs[of - 1])
            h = hashes[one[at]]
            for k in range(1, of):
                h = mixed(h * _ODD + hashes[one[at + k]])
            some = np.zeros(n, bool)
            some[at[kept.has(h)]] = True
            runs[of - 1] = some
            for d in range(of, depth):
                runs[d][:-1] &= runs[d - 1][:-1] & runs[d - 1][1:]
            for d in range(of - 1, 1, -1):
                runs[d - 1] = runs[d].copy()
                runs[d - 1][1:] |= runs[d][:-1]
        return [np.flatnonzero(r) for r in runs[1:]]

    def phrases(self, depth: int, some: np.ndarray) -> pa.Array:
        """The words of some states of a depth, joined by spaces."""
        place = self.levels[depth - 1].place[some]
        parts = [self.words.take(pa.array(self.ids[place + k])) for k in range(depth)]
        return pc.binary_join_element_wise(*parts, b" ").cast(pa.string())

    def languages(self, depth: int, some: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.lang[self.levels[depth - 1].last[some]]))


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[pa.Table]:
    """The rows of a task in runs of about so many bytes of text, a longer text alone."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            n = max(int(np.searchsorted(ends, base + most - size, "right")) - at, 0 if held else 1)
            if n:
                held.append(batch.slice(at, n))
                size += int(ends[at + n - 1]) - base
                at += n
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def frequent(hashes: DataFrame) -> Filter:
    """A filter of fixed size that has all hashes of the column ``h``."""
    low = (1 << BLOOM_BITS) - 1
    at = F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", BLOOM_BITS).bitwiseAND(low)))
    cells = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    found = cells.toArrow()  # one row for each 64-bit cell of the filter at most
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Filter(bits, np.empty(0, np.uint64))


def dealt(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts hashes into buckets, and where each bucket begins."""
    bucket = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int16)
    order = np.argsort(bucket, kind="stable")
    return order, np.r_[0, np.cumsum(np.bincount(bucket, minlength=BUCKETS))].astype(np.int32)


def lists(order: np.ndarray, starts: np.ndarray, *columns: pa.Array) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(starts), c.take(pa.array(order))) for c in columns]


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, h, n) of rows that come bucket by bucket; small buckets are summed together, none is parted."""
    held, size, last = [], 0, None
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        ends = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        entries = np.cumsum(sum(pc.list_value_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("h", "n")))
        at = 0
        for end in ends.tolist() if len(bucket) else ():
            if size >= GROUP and bucket[at] != last:
                yield from _summed(held)
                held, size = [], 0
            held.append(batch.slice(at, end - at))
            size += int(entries[end - 1] - (entries[at - 1] if at else 0))
            last, at = bucket[at], end
    if held:
        yield from _summed(held)


def _summed(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    flat = {c: pa.concat_arrays([r.column(c).flatten() for r in rows]) for c in ("h", "m", "lang", "phrase", "n")}
    h, order = flat["h"].to_numpy(), np.argsort(flat["h"].to_numpy())
    h = h[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    n = np.add.reduceat(flat["m"].to_numpy()[order], starts) if len(h) else h
    own = pa.table({c: flat[c] for c in ("lang", "phrase", "n")}).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).combine_chunks()
    none = pa.nulls(len(starts), pa.string())
    names = ["lang", "phrase", "h", "n"]
    out = [pa.RecordBatch.from_arrays([none, none, pa.array(h[starts]), pa.array(n)], names)]
    for b in own.to_batches():
        out.append(pa.RecordBatch.from_arrays([b["lang"], b["phrase"], pa.nulls(b.num_rows, pa.int64()), b["n_sum"]], names))
    return out


def level_counts(texts: DataFrame, depth: int, longest: int, kept: Filter | None, least: int) -> DataFrame:
    """(lang, phrase, h, n) with n >= ``least``: phrases of ``depth`` words by their words, those one longer by their hash.

    The first scan, which has no filter yet, counts words by their hash too, and each language's words under a null
    phrase; the second one also returns the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            text, lang = (shard[c].combine_chunks() for c in ("_t", "_lang"))
            a = Automaton(text.cast(pa.binary()), lang, min(longest, depth + 1), kept, depth if kept else 0)
            counted = a.levels[:2] if kept is None else a.levels[depth : depth + 1]
            hashes, m = (np.concatenate([x, *(getattr(level, k) for level in counted)]) for k, x in (("hash", np.empty(0, np.uint64)), ("count", np.empty(0, np.int64))))
            rows = lists(*dealt(hashes), pa.array(hashes.view(np.int64)), pa.array(m))
            if kept is None:
                n = np.bincount(a.lang, a.levels[0].count, len(a.langs)).astype(np.int64)
                rows += lists(*dealt(np.zeros(len(n), np.uint64)), a.langs, pa.nulls(len(n), pa.string()), pa.array(n))
            else:
                told = [(d, np.flatnonzero(kept.has(a.levels[d - 1].hash))) for d in ((1, 2) if depth == 2 else (depth,))]
                langs, phrases, n = (pa.concat_arrays(x) for x in zip(*((a.languages(d, some), a.phrases(d, some), pa.array(a.levels[d - 1].count[some])) for d, some in told), strict=True))
                rows += lists(*dealt(np.concatenate([a.levels[d - 1].hash[some] for d, some in told])), langs, phrases, n)
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), *rows], ["bucket", "h", "m", "lang", "phrase", "n"])
            step = max(1, ROWS * BUCKETS // max(1, len(hashes)))
            del a, counted, hashes, m, rows, text, lang, shard
            for k in range(0, BUCKETS, step):
                yield batch.slice(k, step)
            del batch
            pa.default_memory_pool().release_unused()  # else each worker keeps what its largest shard took

    counts = texts.mapInArrow(run, "bucket int, h array<long>, m array<long>, lang array<string>, phrase array<string>, n array<long>")
    counts = counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(summed, "lang string, phrase string, h long, n long")
    return checkpointed(counts.where((F.col("n") >= least) | F.col("phrase").isNull() & F.col("h").isNull()))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's phrases of 2 to ``longest`` words that occur ``least`` times.

    Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words ``[^\\x20\\x09]+``, A-Z in lower case. a is the
    number of occurrences within pieces, overlaps included; l and r those of the two parts of the cut with the lowest
    score floor(1000000 a a / (l r)), the first of equals; n all words of the language. A phrase goes if a longer one
    with ``least`` occurrences holds it and 100 times that one's count reaches ``share`` times its own. ``top`` phrases
    of a language stay (None: all), by score, a, then the phrase's bytes. Decimal arithmetic is exact up to counts of 10^15.

    A null text has no words, a null language is ``und``; an empty table gives no rows; repeated rows count as often as
    they come; other columns are ignored. ``least`` may be 1 at least.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("_lang"), text_of(text).alias("_t"))
    counts = level_counts(texts, 1, longest, None, least)
    total = counts.where("phrase IS NULL AND h IS NULL").select("lang", F.col("n").alias("total"))
    levels = [counts.where("phrase IS NOT NULL")]  # none yet
    for depth in range(2, longest + 1):
        counts = level_counts(texts, depth, longest, frequent(counts.where("h IS NOT NULL")), least)
        levels.append(counts.where("phrase IS NOT NULL"))
    every = reduce(DataFrame.union, levels).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n")
    long = every.where("words > 1").withColumn("w", F.split("phrase", " "))

    part = every.select("lang", F.col("phrase").alias("part"), "n")
    cut = long.select("lang", "phrase", "words", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "words", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("tail"))
    cut = cut.join(part.withColumnsRenamed({"part": "head", "n": "l"}), ["lang", "head"]).join(part.withColumnsRenamed({"part": "tail", "n": "r"}), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cut = cut.withColumn("up", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", wide("l") * wide("r"))
    scored = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("best"))

    # A phrase holds two phrases of one word less: that of its suffix link and its parent.
    inner = F.explode(F.array(F.array_join(F.expr("slice(w, 2, words - 1)"), " "), F.array_join(F.expr("slice(w, 1, words - 1)"), " ")))
    held = long.where("words > 2").select("lang", "n", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    out = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    out = out.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        out = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLE = {
    "op12_collocations": rf"""
        WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
        w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM piece),
        total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        cut AS (SELECT lang, phrase, k, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
        s AS (SELECT cut.lang, cut.phrase, cut.k, a, i, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a // (h.f::HUGEINT * t.f))::BIGINT AS score
            FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        held AS (SELECT lang, p AS phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM c WHERE k = 3) GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""
}
