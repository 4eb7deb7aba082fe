"""Large files in pieces: parsed side by side, with the rows that one parser of the whole file gives.

Spark reads a file's lines, block by block. Pieces begin with lines that look like the beginning of a cell or macro; a scan
of each piece tells whether a parser of the whole file would stand between two of them there. Where it would not (in a comment,
a string, an open group), the piece belongs to the one before, and the pieces are scanned again. A format is a module with

* ``CUT``, a pattern of such lines,
* ``scan_piece(source, line, first, last)``, what other pieces need of one, or None if the file can't be cut behind it,
* ``join_pieces(scans)``, the states in which a file's pieces begin, and
* ``parse_piece(source, path, line, state, last)``, its rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from importlib import import_module
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import written

#: Files from this size on are parsed in pieces.
LARGE = 4 << 20
#: Bytes of a piece, and of what is handed on at once where a file has no line to cut it at.
PIECE, HANDED = 1 << 20, 8 << 20
#: Formats whose files can be cut: modules of this package.
FORMATS = {"lef", "liberty"}
#: Endings of what Spark unpacks as it reads lines.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd")
#: The first bytes of a file that Spark leaves out as it reads lines.
MARK = b"\xef\xbb\xbf"
FRAGMENT = "file int, block long, n int, cut boolean, utf8 boolean, size long, lines long, body binary"


@dataclass
class Large:
    """A file: its place among the sources, its view, kind and format."""

    k: int
    view: str
    kind: str
    format: str
    path: str
    length: int


@dataclass
class Piece:
    file: Large
    line: int
    first: bool
    last: bool
    utf8: bool
    marked: bool
    ended: bool
    state: dict | None = None

    def text(self, parts: list[bytes]) -> str:
        data = b"".join(parts)
        if self.last and not self.ended:  # the file's last line has no end
            data = data[:-1]
        if self.utf8:
            return data.decode("utf-8-sig" if self.first else "utf-8")
        return (MARK * (self.first and self.marked) + data).decode("latin-1")


def cuttable(format: str, path: str) -> bool:
    return format in FORMATS and not path.lower().endswith(PACKED)


def fragments(spark: SparkSession, file: int, path: str, pattern: re.Pattern, piece: int) -> DataFrame:
    """The lines of a file by block, in order, from one cut to another; what stands before a block's first cut is by itself."""
    handed = max(HANDED, piece)

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        blocks, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(blocks):
            end = len(blocks) if blocks[-1] == blocks[start] else next(k for k in range(start, len(blocks)) if blocks[k] != blocks[start])
            yield blocks[start], b"\n".join(values[start:end]) + b"\n"
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, cut, seen, body = None, 0, False, 0, bytearray()

        def out(end: int) -> pa.RecordBatch:
            nonlocal n, seen
            part = bytes(body[:end])
            del body[:end]
            try:
                part.decode("utf-8")
                utf8 = True
            except UnicodeDecodeError:
                utf8 = False
            n, seen = n + 1, 0
            row = (file, block, n - 1, cut, utf8, len(part), part.count(b"\n"), part)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in FRAGMENT.split(", ")])

        for batch in batches:
            for at, lines in runs(batch):
                if at != block:
                    if body:
                        yield out(len(body))
                    block, n, cut, seen = at, 0, False, 0
                body += lines
                while True:
                    m = pattern.search(body, max(seen, piece if cut else 0))
                    if m is not None and m.start() == 0:
                        cut = True
                    elif m is not None:
                        yield out(m.start())
                        cut = True
                    elif len(body) >= handed:
                        yield out(len(body))
                        cut = False
                        break
                    else:
                        seen = len(body)
                        break
        if body:
            yield out(len(body))

    one = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    lines = spark.read.option("lineSep", "\n").text(one).select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, FRAGMENT)


def in_pieces(spark: SparkSession, files: list[Large]) -> DataFrame:
    """(family, row) of files; each piece also gives a row of its view."""
    from .reader import LARGEST, ROWS, problem, run_parser

    own = {f.format: import_module(f"{__package__}.{f.format}") for f in files}
    # Functions travel by value, modules may not be there.
    scans, parsers = {f: m.scan_piece for f, m in own.items()}, {f: m.parse_piece for f, m in own.items()}
    table, _ = written(reduce(DataFrame.unionAll, [fragments(spark, n, f.path, own[f.format].CUT, PIECE) for n, f in enumerate(files)]))
    found = sorted(table.drop("body").collect())  # a row for each MB or so
    starts = {(r.file, r.block, r.n) for r in found if r.cut}
    while True:
        pieces, place, sizes = cut_at(files, found, starts)
        large = {p.file.path for p, size in zip(pieces, sizes, strict=True) if size > LARGEST}
        kept = [(*key, p, n) for key, (p, n) in place.items() if pieces[p].file.path not in large]
        if not kept:
            whole = None
            break
        places = F.broadcast(spark.createDataFrame(kept, "file int, block long, n int, piece int, place int"))
        # Text that packs well would come to few tasks by its size.
        tasks = min(len(pieces), max(4 * spark.sparkContext.defaultParallelism, len(pieces) // 16))
        parts = F.array_sort(F.collect_list(F.struct("place", "body"))).alias("parts")
        whole, _ = written(table.join(places, ["file", "block", "n"]).select("piece", "place", "body").repartition(tasks, "piece").groupBy("piece").agg(parts))

        def scan(batches: Iterator[pa.RecordBatch], pieces=pieces) -> Iterator[pa.RecordBatch]:
            for k, p, text in texts(batches, pieces):
                told = json.dumps(scans[p.file.format](text, p.line, p.first, p.last))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([told], pa.string())], ["piece", "told"])

        told = {r.piece: json.loads(r.told) for r in whole.mapInArrow(scan, "piece int, told string").collect()}
        wrong = {k + 1 for k, t in told.items() if t is None}
        if not wrong:
            break
        starts -= {key for key, (p, n) in place.items() if p in wrong and n == 0}

    def refuse(*_):
        raise ValueError(f"a file is larger than {LARGEST} bytes where it can't be cut")

    refused = [(family, json.dumps({"k": f.k, "source": f.path} | row)) for f in files if f.path in large for family, row in run_parser(refuse, [], f.view, f.kind, {})]
    out = spark.createDataFrame(refused, "family string, row string")
    if whole is None:
        return out
    for f in files:
        mine = [k for k in sorted(told) if pieces[k].file is f]
        for k, state in zip(mine, own[f.format].join_pieces([told[k] for k in mine]), strict=True):
            pieces[k].state = state

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, p, text in texts(batches, pieces):

            def parser(*_, p=p, text=text):
                if p.first and not p.utf8:
                    yield problem("OC1102", "the file is not UTF-8", p.file.path, 0, "*")
                yield from parsers[p.file.format](text, p.file.path, p.line, p.state, p.last)

            made = run_parser(parser, [], p.file.view, p.file.kind, {})
            while rows := list(islice(made, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([json.dumps({"k": p.file.k} | x[1] if x[0] == "views" else x[1]) for x in rows], pa.string())], ["family", "row"])

    return written(whole.mapInArrow(parse, "family string, row string"))[0].unionAll(out)


def texts(batches: Iterator[pa.RecordBatch], pieces: list[Piece]) -> Iterator[tuple[int, Piece, str]]:
    for batch in batches:
        for k, parts in zip(*batch.columns, strict=True):
            p = pieces[k.as_py()]
            yield k.as_py(), p, p.text([x["body"] for x in parts.as_py()])


def cut_at(files: list[Large], found: list, starts: set) -> tuple[list[Piece], dict, list[int]]:
    """The pieces of files that begin at some fragments, each fragment's piece and its place there, and the pieces' bytes."""
    pieces, place, sizes, at = [], {}, [], 0
    for n, f in enumerate(files):
        own = [r for r in found if r.file == n]
        missing = f.length - sum(r.size for r in own)  # an end added to the last line, a mark left out
        if own and missing not in (-1, 0, 2, 3):
            raise RuntimeError(f"the lines of {f.path} are not as long as the file")
        utf8, line = all(r.utf8 for r in own), 1
        for j, r in enumerate(own):
            key = (r.file, r.block, r.n)
            if j == 0 or key in starts:
                if j:
                    pieces[-1].last = False
                pieces.append(Piece(f, line, j == 0, True, utf8, missing > 0, missing in (0, 3)))
                sizes.append(0)
                at = 0
            place[key] = (len(pieces) - 1, at)
            at += 1
            sizes[-1] += r.size
            line += r.lines
    return pieces, place, sizes
