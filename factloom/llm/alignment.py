"""Alignment of two tokenizers' tokens by bytes.

An Arrow batch's texts are concatenated; every token's bytes have a known number, so prefix sums give all tokens'
ends in the batch. Each tokenizer's ends are counted into one array of the batch's bytes (``bincount``); a group is
cut where both have one. Segmented prefix sums between the documents' byte offsets give each document's tokens,
groups and links. What a document holds is written once; the corpus-wide counts of linked pairs are summed from it
and looked up again: in one table that travels to the tasks if it is small enough, by a join otherwise.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, text_of
from .sentencepiece_codec import SPACE, UNKNOWN_TYPE, Vocabulary, groups

#: A byte-level tokenizer's words never reach over a place where a space follows another character that is no white space.
UNIT = re.compile(r"(?<=\S)(?= )")
#: A cache of more characters of units is emptied: its memory is bounded.
CACHE_CHARS = 6_000_000
#: More pairs than this (12 bytes each) are not sent to every task: they are joined.
TRAVEL_PAIRS = 4_000_000
#: Characters of the texts that are aligned at once.
BATCH_CHARS = 1_500_000


def byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Units:
    """Texts, a space before each, encoded unit by unit; what a unit gave is remembered.

    A unit begins with a space, which its key leaves out.
    """

    #: What a text has that can't be cut at every space.
    odd: re.Pattern
    bytes: list[bytes]

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.held = 0

    def cut(self, text: str) -> list[str]:
        """The keys of the units of an odd text."""
        raise NotImplementedError

    def fresh(self, keys: list[str]) -> list[bytes]:
        """The packed ids of units."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as unsigned 32-bit integers; an empty text has none."""
        parts = [() if not t else self.cut(f" {t}") if self.odd.search(f" {t}") else t.split(" ") for t in texts]
        new = set().union(*parts).difference(self.known)
        if self.held and self.held + sum(map(len, new)) > CACHE_CHARS:
            self.known.clear()
            self.held, new = 0, set().union(*parts)
        if new:
            new = list(new)
            self.held += sum(map(len, new))
            self.known.update(zip(new, self.fresh(new), strict=True))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


class ByteLevel(Units):
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    odd = re.compile(r"\s ")

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        whole = json.loads(file)
        pre = whole["pre_tokenizer"]
        if whole["normalizer"] is not None or (pre["type"], pre.get("use_regex", True), pre["add_prefix_space"]) != ("ByteLevel", True, False):
            raise ValueError("only byte-level vocabularies that cut texts into words and do not normalise them")
        self.library = Tokenizer.from_str(file)
        self.library.encode_special_tokens = True
        special = {t["content"] for t in whole["added_tokens"]}
        of = byte_of_char()
        self.bytes = [b""] * self.library.get_vocab_size()
        for piece, k in self.library.get_vocab().items():
            self.bytes[k] = piece.encode() if piece in special else bytes(of[c] for c in piece)

    def cut(self, text: str) -> list[str]:
        return [u[1:] for u in UNIT.split(text)]

    def fresh(self, keys: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch([f" {k}" for k in keys], add_special_tokens=False)]


class Pieces(Units):
    """A merge-type model of the sentencepiece library, which puts a space before each text by itself."""

    odd = re.compile(f"  |{SPACE}")

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        v = Vocabulary(model)
        if not (v.cuts and v.prefix):
            raise ValueError("only models that put a space before a text and have no pieces that reach over spaces")
        self.bytes = [b"" if kind == UNKNOWN_TYPE else x for kind, x in zip(v.kinds, v.spelled, strict=True)]
        self.library, self.unit = SentencePieceProcessor(model_proto=model), re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")

    def cut(self, text: str) -> list[str]:
        return [u[1:] for u in self.unit.findall(text)]

    def fresh(self, keys: list[str]) -> list[bytes]:
        one, two = self.library.encode("a"), self.library.encode("a ")  # a text may be empty, a unit is a space at least
        return [np.array(x if k else two[len(one) :], np.uint32).tobytes() for k, x in zip(keys, self.library.encode(keys, num_threads=1), strict=True)]


class Side:
    """One tokenizer's tokens of a batch: ids, the document of each, their ends in the batch's bytes."""

    def __init__(self, packed: list[bytes], lengths: np.ndarray):
        self.ids = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64)
        self.count = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        self.ends = np.cumsum(lengths[self.ids])
        self.row = np.repeat(np.arange(len(packed)), self.count)

    def only(self, rows: np.ndarray, lengths: np.ndarray) -> None:
        """Drop the tokens of the other rows."""
        keep = rows[self.row]
        self.ids, self.row, self.count = self.ids[keep], self.row[keep], np.where(rows, self.count, 0)
        self.ends = np.cumsum(lengths[self.ids])


def spelled(ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The joined bytes of tokens."""
    n = lengths[ids]
    at = np.repeat(starts[ids] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat[at]


class Aligner:
    """Two tokenizers, and what a batch of texts gives under both."""

    def __init__(self, a: Units, b: Units):
        self.a, self.b = a, b
        self.lengths = [np.array(list(map(len, x.bytes)), np.int64) for x in (a, b)]
        self.starts = [np.cumsum(n) - n for n in self.lengths]
        self.flat = [np.frombuffer(b"".join(x.bytes), np.uint8) for x in (a, b)]
        if len(a.bytes) * len(b.bytes) >= 1 << 33:
            raise ValueError("vocabularies of over 2^33 pairs")
        self.kind = np.int32 if len(a.bytes) * len(b.bytes) < 1 << 31 else np.int64
        #: The decimal id and what follows it: "," in a group, "|" after the group's A, ";" after its B; nothing at a document's end.
        self.texts = [t for k in range(max(len(a.bytes), len(b.bytes))) for t in (b"%d," % k, b"%d|" % k, b"%d;" % k)]

    def tokens(self, texts: list[str]) -> tuple[Side, Side]:
        """Both tokenizers' tokens of all texts whose bytes both give back; the others have none."""
        a, b = (Side(x.encode(texts), n) for x, n in zip((self.a, self.b), self.lengths, strict=True))
        want = [f" {t}".encode() if t else b"" for t in texts]
        size = np.fromiter(map(len, want), np.int64, len(want))
        good = size > 0
        whole = np.frombuffer(b"".join(want), np.uint8)
        owner = None
        for side, n, s, f in zip((a, b), self.lengths, self.starts, self.flat, strict=True):
            of = np.bincount(side.row, n[side.ids], len(want)).astype(np.int64)
            if (of != size).any():
                good &= of == size
                got, row = spelled(side.ids, n, s, f), np.repeat(side.row, n[side.ids])
                edges, from_ = np.searchsorted(row, np.arange(len(want) + 1)), np.r_[0, np.cumsum(size)]
                for k in np.flatnonzero(good):  # rare: a batch in which some text's bytes are not given back
                    good[k] = np.array_equal(got[edges[k] : edges[k + 1]], whole[from_[k] : from_[k + 1]])
            elif not np.array_equal(got := spelled(side.ids, n, s, f), whole):
                owner = np.repeat(np.arange(len(want)), size) if owner is None else owner
                good[owner[got != whole]] = False
        if not good.all():
            a.only(good, self.lengths[0])
            b.only(good, self.lengths[1])
        return a, b

    def align(self, texts: list[str], digest: bool = False) -> dict[str, pa.Array]:
        """Columns: n_a, n_b, n_groups, n_links, groups, pairs, times.

        pairs are a document's distinct linked pairs in order, as A id times the size of B and B id; times how often each.
        """
        a, b = self.tokens(texts)
        n, width = len(texts), len(self.b.bytes)
        total = int(a.ends[-1]) if len(a.ends) else 0
        marks = [np.bincount(x.ends, minlength=total + 1) for x in (a, b)]
        cuts = np.flatnonzero((marks[0] > 0) & (marks[1] > 0))
        doc_bytes = np.bincount(a.row, self.lengths[0][a.ids], n).astype(np.int64)
        doc_end = np.cumsum(doc_bytes)
        # The group of each token: the first cut at or after its end.
        ga, gb = np.searchsorted(cuts, a.ends), np.searchsorted(cuts, b.ends)
        na, nb = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        doc_of = np.searchsorted(doc_end, cuts)  # a document's end is a cut of both: no group reaches over it
        upto = np.r_[0, np.cumsum(na * nb)]
        edge = np.searchsorted(cuts, doc_end, "right")
        edge = np.maximum.accumulate(edge)
        n_groups = np.diff(np.r_[0, edge])
        n_links = np.diff(upto[np.r_[0, edge]])
        out = {"n_a": a.count, "n_b": b.count, "n_groups": n_groups, "n_links": n_links}

        # Every A token of a group beside every B token of it.
        first_b = np.cumsum(nb) - nb
        many = nb[ga]
        left = np.repeat(a.ids, many)
        step = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        right = b.ids[np.repeat(first_b[ga], many) + step]
        keys = np.repeat(doc_of[ga], many) * (1 << 33) + (left * width + right)
        kinds, times = np.unique(keys, return_counts=True)
        at = np.searchsorted(kinds, np.arange(n + 1) * (1 << 33))
        packed, often = kinds & ((1 << 33) - 1), times
        out["pairs"], out["times"] = lists(packed.astype(self.kind), at), lists(often.astype(np.int32), at)

        # a1,a2|b1;a3|b2,b3 - the A tokens of a group, then its B tokens, group by group.
        last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        last_a[np.cumsum(na) - 1] = True
        last_b[np.cumsum(nb) - 1] = True
        code = np.empty(len(a.ids) + len(b.ids), np.int64)
        shift_a, shift_b = first_b, np.cumsum(na)
        code[np.arange(len(a.ids)) + shift_a[ga]] = 3 * a.ids + last_a
        code[np.arange(len(b.ids)) + shift_b[gb]] = 3 * b.ids + 2 * last_b
        ends = np.r_[0, np.cumsum(a.count + b.count)]
        words = list(map(self.texts.__getitem__, code.tolist()))
        spans = (b"".join(words[x:y])[:-1] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        out["groups"] = pa.array([hashlib.sha256(g).hexdigest() if g and digest else g.decode() for g in spans], pa.string())
        return {k: v if isinstance(v, pa.Array) else pa.array(np.asarray(v, np.int64)) for k, v in out.items()}


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, byte_level: str, pieces: str, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, pairs, times (see ``Aligner.align``).

    A, the byte-level file, encodes a space and the text; B, the merge-type model, the text, before which it puts a
    space itself; none adds special tokens. ``groups`` is the text ``a1,a2|b1;a3|b2,b3``, or the hexadecimal SHA-256 of it.
    Null and empty texts, and those that either does not give back byte by byte, have no tokens: zeros, an empty string
    and empty lists. Rows that repeat give a row each, null ids stay null, an empty table gives no rows, other columns
    are ignored. The files' contents travel by value.
    """
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        a, b = f.read(), g.read()
    kind = "int" if Aligner(ByteLevel(a), Pieces(b)).kind is np.int32 else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner(ByteLevel(a), Pieces(b))
        for batch in batches:
            at = 0
            for part in groups(batch.column(1).to_pylist(), BATCH_CHARS):
                found = both.align(part, digest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *found.values()], ["_id", *found])
                at += len(part)

    schema = f"_id {docs.schema[id].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, pairs array<{kind}>, times array<int>, groups string"
    return docs.select(F.col(id).alias("_id"), text_of(text).alias("_t")).mapInArrow(run, schema).withColumnRenamed("_id", id)


def linked(docs: DataFrame, byte_level: str, pieces: str, id: str = "doc_id", text: str = "text", digest: bool = True, most: int = TRAVEL_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    A pair's count is the number of documents (rows) that hold it linked. n_best are the links whose count is the highest
    of their A id, ties included; count_sum adds the counts of all links. Up to ``most`` pairs the counts travel to the
    tasks (12 bytes each), beyond it they are joined. The rules of ``aligned`` hold.
    """
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    found = aligned(docs, byte_level, pieces, id, text, digest).withColumnRenamed(id, "_id")
    found.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/documents")
    held = spark.read.parquet(f"{folder}/documents")
    with open(pieces, "rb") as f:
        width = len(Vocabulary(f.read()).pieces)
    counts = held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    highest = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))
    counts.join(highest, F.expr(f"pair div {width} = a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")).write.parquet(f"{folder}/pairs")
    counts = spark.read.parquet(f"{folder}/pairs")
    if counts.count() <= most:
        out = held.mapInArrow(looked_up(counts), f"{held.drop('pairs', 'times', '_row').schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, n_best long, count_sum long")
    else:
        each = held.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
        sums = each.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = held.drop("pairs", "times").join(sums, "_row", "left").drop("_row").fillna(0, ["n_best", "count_sum"])
    return out.withColumnRenamed("_id", id)


def looked_up(counts: DataFrame):
    """The function that adds n_best and count_sum to batches, from pairs' counts that it holds in order."""
    found = counts.toArrow().sort_by("pair")  # as many as the caller has bounded
    keys, n, best = found["pair"].to_numpy(), found["n"].to_numpy(), found["best"].to_numpy().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, pairs)
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            sums = [np.diff(np.r_[0, np.cumsum(times * x[at])][ends]) for x in (best, n)]
            names = [c for c in batch.schema.names if c not in ("pairs", "times", "_row")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    return run


def op13_alignment(spark: SparkSession, sf_dir: str, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    out = linked(table(spark, sf_dir, "documents"), public_tokenizers.path(byte_level), public_tokenizers.path(pieces))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op13_alignment": op13_alignment}
#: SQL has no tokenizers; the tests compare with plain loops.
ORACLE: dict[str, str] = {}
