"""SentencePiece encoding and decoding with merge-type vocabularies.

A text is normalised (a leading space, spaces as U+2581) and cut before every run of spaces: if no piece of the
vocabulary goes on after a space that follows another character, no merge can cross such a place, so each unit is
encoded by itself and remembered. In a unit the adjacent symbol pairs that spell a piece stand in an agenda, best
score first, then leftmost; a merge enters the pairs with its new neighbours, and pairs that a merge has overtaken
are passed over. What no piece spells falls back to bytes. The units that an Arrow batch brings for the first time
are checked against the sentencepiece library, one call a batch.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

SPACE = "▁"
UNKNOWN = " ⁇ "
NORMAL, UNKNOWN_TYPE, CONTROL, BYTE = 1, 2, 3, 6
#: A cache of more characters of units is emptied: its memory is bounded.
CACHE_CHARS = 8_000_000
#: Units of more characters keep their agenda in a heap.
SHORT = 48
#: So many units are compared with the library as one text.
CHECKED = 500
#: No pair has this rank; symbols from CHARS on are characters without a piece; bits of a symbol.
NEVER = 2**31 - 1
CHARS = 900_000
BITS = 21


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces, their scores and what a model file says of normalisation; units encoded so far."""

    def __init__(self, model: bytes):
        self.model, self.pieces, self.kinds, scores = model, [], [], []
        flags = {3: 1, 4: 1, 5: 1}
        kind, fallback, suffix = 1, 0, 0
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(fields(value))
                kind, fallback, suffix = own.get(3, 1), own.get(35, 0), own.get(24, 0)
            elif number == 3:
                flags |= {k: v for k, v in fields(value) if k in (2, 3, 4, 5)}
        if kind != 2 or suffix or flags.get(2) or flags[4] or not flags[5] or {*self.kinds} - {NORMAL, UNKNOWN_TYPE, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies without character maps, space removal, unused and user-defined pieces")
        self.prefix = SPACE if flags[3] else ""
        normal = [k for k, x in enumerate(self.kinds) if x == NORMAL]
        self.ids = {self.pieces[k]: k for k in normal}
        self.ranks = {self.pieces[k]: -scores[k] for k in normal}
        self.unknown = self.kinds.index(UNKNOWN_TYPE)
        self.bytes = {int(self.pieces[k][1:-1], 16): k for k, x in enumerate(self.kinds) if x == BYTE} if fallback else {}
        self.silent = {k for k, x in enumerate(self.kinds) if x == CONTROL}
        self.begin, self.end = (self.pieces.index(x) if x in self.pieces else -1 for x in ("<s>", "</s>"))
        #: Whether no piece has a space after another character.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.unit = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.spelled = [self._spelled(k) for k in range(len(self.pieces))]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _spelled(self, k: int) -> bytes:
        kind, piece = self.kinds[k], self.pieces[k]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: "", UNKNOWN_TYPE: UNKNOWN}.get(kind, piece.replace(SPACE, " ")).encode()

    def units(self, text: str) -> list[str]:
        """The normalised text in units that are encoded apart; none for the empty text."""
        if not text:
            return []
        whole = self.prefix + text.replace(" ", SPACE)
        return self.unit.findall(whole) if self.cuts else [whole]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All splits of pieces into two symbols: sorted keys, the pieces' ranks, the pieces."""
        one = lambda x: self.ids.get(x, CHARS + ord(x) if len(x) == 1 else None)
        ordered = {score: k for k, score in enumerate(sorted(set(self.ranks.values())))}
        found = [((a << BITS) | b, ordered[self.ranks[p]], k) for p, k in self.ids.items() for i in range(1, len(p)) if (a := one(p[:i])) is not None and (b := one(p[i:])) is not None]
        keys, ranks, made = map(np.array, zip(*sorted(found), strict=True))
        return keys, ranks.astype(np.int32), made.astype(np.int32)

    @cached_property
    def chars(self) -> np.ndarray:
        """The symbol of each character: its piece, else a number above all pieces."""
        out = np.arange(0x110000, dtype=np.int32) + CHARS
        single = [(ord(p), k) for p, k in self.ids.items() if len(p) == 1]
        out[[c for c, _ in single]] = [k for _, k in single]
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, ranks, made = self.pairs
        want = (left.astype(np.int64) << BITS) | right
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, ranks[at], NEVER), made[at]

    def merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit, symbol) of all symbols after all merges, in order.

        All units keep their agendas side by side in one array, the ranks of adjacent pairs; in each round every
        unit takes its best pair, the leftmost of equals, and looks its two new pairs up. Finished units leave.
        """
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        sym = self.chars[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        rank, made = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        rank[inner], made[inner] = self.look_up(sym[inner], sym[inner + 1])
        out = []
        while len(sym):
            new = np.ones(len(unit), bool)
            new[1:] = unit[1:] != unit[:-1]
            starts = np.flatnonzero(new)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(unit)])
            if (best == NEVER).any():
                stay = np.repeat(best != NEVER, sizes)
                out.append((unit[~stay], sym[~stay]))
                unit, sym, rank, made = unit[stay], sym[stay], rank[stay], made[stay]
                best, sizes = best[best != NEVER], sizes[best != NEVER]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            at = hit[np.r_[True, unit[hit[1:]] != unit[hit[:-1]]]] if len(hit) else hit
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            unit, sym, rank, made = unit[stay], sym[stay], rank[stay], made[stay]
            at = at - np.arange(len(at))
            rank[at] = NEVER
            both = np.r_[at, at[at > 0] - 1]
            both = both[both + 1 < len(sym)]
            both = both[unit[both] == unit[both + 1]]
            rank[both], made[both] = self.look_up(sym[both], sym[both + 1])
        owner, sym = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int32),) * 2
        order = np.argsort(owner, kind="stable")
        return owner[order], sym[order]

    def merged_long(self, unit: str) -> np.ndarray:
        """The symbols of one long unit, its agenda a heap of ranks and places."""
        n, ranks = len(unit), self.ranks
        size, before = [1] * n, list(range(-1, n - 1))
        agenda = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(unit[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, length = heappop(agenda)
            j = i + size[i]
            if j >= n or not size[i] or size[i] + size[j] != length:
                continue  # overtaken by another merge
            size[i], size[j] = length, 0
            k, h = i + length, before[i]
            if k < n:
                before[k] = i
                more = length + size[k]
                if (rank := ranks.get(unit[i : i + more])) is not None:
                    heappush(agenda, (rank, i, more))
            if h >= 0:
                more = size[h] + length
                if (rank := ranks.get(unit[h : h + more])) is not None:
                    heappush(agenda, (rank, h, more))
        parts = (unit[i : i + m] for i, m in enumerate(size) if m)
        return np.array([self.ids.get(p, CHARS + ord(p[0])) for p in parts], np.int32)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The packed ids of each unit; characters without a piece fall back to bytes, or to one unknown id for a run."""
        short = [u for u in units if len(u) <= SHORT]
        parts = [self.merged(short), *((np.full(len(s), -1), s) for s in (self.merged_long(u) for u in units if len(u) > SHORT))]
        packed, long = [], []
        for owner, sym in parts:
            strange = np.flatnonzero(sym >= CHARS)
            count = np.ones(len(sym), np.int64)
            spelled = [[self.bytes[b] for b in chr(c - CHARS).encode()] if self.bytes else [self.unknown] for c in sym[strange].tolist()]
            count[strange] = list(map(len, spelled))
            if not self.bytes:
                count[strange[1:][(np.diff(strange) == 1) & (owner[strange[1:]] == owner[strange[:-1]])]] = 0
            ends = np.cumsum(count)
            ids = np.repeat(sym, count).astype("<u4")
            for k, own in zip(strange.tolist(), spelled, strict=True):
                ids[ends[k] - count[k] : ends[k]] = own[: count[k]]
            if owner is parts[0][0]:
                edges = np.r_[0, ends][np.searchsorted(owner, np.arange(len(short) + 1))] * 4
                data = ids.tobytes()
                packed = [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            else:
                long.append(ids.tobytes())
        a, b = iter(packed), iter(long)
        return [next(a) if len(u) <= SHORT else next(b) for u in units]

    def learn(self, units: set[str], library=None) -> None:
        """Encode units and remember them; with the library, compare each unit's ids with its own."""
        fresh = list(units)
        self.held += sum(map(len, fresh))
        if self.cuts:  # units in a row are a normalised text, but for those that end in spaces
            fresh.sort(key=lambda u: u.endswith(SPACE))
        alone = next((k for k, u in enumerate(fresh) if u.endswith(SPACE) or not self.cuts), len(fresh))
        packed = self.encode_units(fresh)
        k = step = 0
        while library is not None and (k := k + step) < len(fresh):
            step = min(CHECKED, alone - k) if k < alone else 1
            # The library puts the prefix before a text by itself; a first unit keeps "▁" from being the whole text.
            lead = [f"{SPACE}a"] if self.cuts else []
            theirs = library.encode("".join(lead + fresh[k : k + step]).removeprefix(self.prefix))
            if np.array(theirs, "<u4").tobytes() != b"".join(self.encode_units(lead) + packed[k : k + step]):
                raise ValueError(f"the library gives other ids for one of {fresh[k : k + step]!r}")
        self.known.update(zip(fresh, packed, strict=True))

    def encode(self, texts: list[str], begin: bool = False, end: bool = False, library=None) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        first = struct.pack("<I", self.begin) if begin else b""
        last = struct.pack("<I", self.end) if end else b""
        cut = [self.units(t) for t in texts]
        fresh = set().union(*cut).difference(self.known)
        if self.held and self.held + sum(map(len, fresh)) > CACHE_CHARS:
            self.known.clear()
            self.held, fresh = 0, set().union(*cut)
        if fresh:
            self.learn(fresh, library)
        get = self.known.__getitem__
        return [first + b"".join(map(get, c)) + last for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """As the library: control ids are silent, bytes that are no UTF-8 become U+FFFD one by one."""
        ids = ids.tolist()
        data = b"".join(map(self.spelled.__getitem__, ids))
        head = next((k for k in ids if self.kinds[k] != CONTROL), None)
        led = bool(self.prefix) and head is not None and self.kinds[head] == NORMAL and self.pieces[head].startswith(SPACE)
        try:
            if not self.silent.isdisjoint(ids[1:-1]):
                raise ValueError("bytes on both sides of a control id are no character")
            return (data[1:] if led else data).decode()
        except ValueError:
            codecs.register_error("bytewise", lambda e: ("�", e.start + 1))
            runs = (list(run) for _, run in groupby(ids, lambda k: self.kinds[k] == BYTE))
            whole = "".join(b"".join(self.spelled[k] for k in run).decode("utf-8", "bytewise") for run in runs)
            return whole[1:] if led else whole


def groups(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters together, a longer text alone: what is made from them stays small."""
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t) > most:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def coded(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", begin: bool = True, end: bool = True, check: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit integers, packed), decoded (of those ids).

    ``model`` is the path of a model file that the driver reads; it travels by value. Null and empty texts have no ids
    but the marks asked for. Repeated rows give a row each; null ids stay null; an empty table gives no rows; other
    columns are ignored, whatever their names. ``check`` compares every new unit with the library and raises where ids
    differ. A text of any length is one row; a unit without spaces takes n log n steps.
    """
    with open(model, "rb") as f:
        data = f.read()
    Vocabulary(data)  # refuse a model of another kind at once

    def run(batches: Iterator[pa.RecordBatch], check=check) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        words, library = Vocabulary(data), SentencePieceProcessor(model_proto=data) if check else None
        for batch in batches:
            at = 0
            for part in groups(batch.column(1).to_pylist()):
                packed = words.encode(part, begin, end, library)
                decoded = [words.decode(np.frombuffer(p, "<u4")) for p in packed]
                cols = [batch.column(0).slice(at, len(part)), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "n_tokens", "ids", "decoded"])
                at += len(part)

    out = docs.select(F.col(id).alias("_id"), text_of(text).alias("_t")).mapInArrow(run, f"_id {docs.schema[id].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("_id", id)


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def op11_sentencepiece(spark: SparkSession, sf_dir: str, file: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    out = coded(table(spark, sf_dir, "documents"), public_tokenizers.path(file))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_sentencepiece": op11_sentencepiece}
#: SQL has no merges; the tests compare with the library text by text.
ORACLE: dict[str, str] = {}
