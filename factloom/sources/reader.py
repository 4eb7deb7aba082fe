"""Views from files: Spark reads the bytes, one task parses a view, families come out as DataFrames; large
files of formats that can be cut are parsed in pieces (``pieces.py``) by many tasks.

A parser is a function of (files, view, kind, options) that yields (family, row). A view's files are
parsed together and in order, since later ones may depend on earlier ones; views are parsed in parallel.
What a parser does not understand it says in ``parser_diagnostics`` and in the view's tainted scopes; an
exception taints the whole view and never ends the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from importlib import import_module
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.model import SCHEMAS
from factloom.operators.shared import cut

from . import pieces

Parser = Callable[[list[tuple[str, bytes]], str, str, dict], Iterable[tuple[str, dict]]]
#: Bytes of one file: what Spark can hold in one value. Larger ones are refused with a finding.
LARGEST = (1 << 31) - 1024
#: Rows that a parser's task hands on at once.
ROWS = 10_000
#: Changes whenever a parser gives other rows for the same bytes.
ROWS_VERSION = "2"

# Formats, their other names, and the endings of their files.
FORMATS = {
    "verilog": ("rtl", "verilog", (".v", ".sv", ".vh", ".svh")),
    "liberty": ("liberty", "liberty", (".lib",)),
    "lef": ("lef", "lef", (".lef", ".tlef")),
    "csv": ("csv", "tables", (".csv", ".tsv")),
    "connectivity": ("connectivity", "tables", ()),
    "ipxact": ("ipxact", "registers", (".xml", ".ipxact")),
    "systemrdl": ("systemrdl", "registers", (".rdl",)),
    "header": ("header", "registers", (".h", ".hh", ".hpp")),
    "sdc": ("sdc", "tcl", (".sdc",)),
    "upf": ("upf", "tcl", (".upf",)),
    "cdl": ("cdl", "netlists", (".cdl", ".sp", ".spi", ".cir", ".ckt")),
    "def": ("def", "netlists", (".def",)),
    "gds": ("gds", "layout", (".gds", ".gds2", ".gdsii")),
}
ALIASES = {"rtl": "verilog", "sv": "verilog", "systemverilog": "verilog", "lib": "liberty", "c_header": "header", "spice": "cdl", "gdsii": "gds", "rdl": "systemrdl", "pinmap": "csv", "ip-xact": "ipxact"}
_PLUGINS: dict[str, Parser] = {}


@dataclass
class Source:
    """Files of one view. ``format`` may be left to the files' ending."""

    view: str
    paths: list[str]
    format: str = ""
    options: dict = field(default_factory=dict)


def register(format: str, parser: Parser) -> None:
    """A parser of the user; built-in formats cannot be replaced."""
    if format in FORMATS or format in ALIASES:
        raise ValueError(f"{format} is built in")
    _PLUGINS[format] = parser


def format_of(source: Source) -> str:
    name = source.format.strip().lower()
    if name:
        name = ALIASES.get(name, name)
        if name not in FORMATS and name not in _PLUGINS:
            raise ValueError(f"unknown format {source.format}")
        return name
    found = {f for p in source.paths for f, (_, _, ends) in FORMATS.items() if p.lower().endswith(ends or ("\0",))}
    if len(found) != 1:
        raise ValueError(f"the format of {source.view} can't be told from its files")
    return found.pop()


def parser_of(format: str) -> Parser:
    return _PLUGINS[format] if format in _PLUGINS else getattr(import_module(f"{__package__}.{FORMATS[format][1]}"), f"parse_{format}")


def run_parser(parser: Parser, files: list[tuple[str, bytes]], view: str, kind: str, options: dict) -> Iterator[tuple[str, dict]]:
    """The parser's rows and one row for the view, whatever happens."""
    tainted: list[str] = []
    complete = True
    try:
        big = [p for p, b in files if b is None or len(b) > LARGEST]
        if big:
            raise ValueError(f"{big[0]} is larger than {LARGEST} bytes")
        odd = [p for p, b in files if kind != "gds" and not _is_utf8(b)]
        for p in odd:  # read as Latin-1, so no name of the view is sure
            complete, tainted = False, ["*"]
            yield "parser_diagnostics", {"view": view, "code": "OC1102", "scope": "*", "message": "the file is not UTF-8", "source": p, "line": 0, "column": 0}
        for family, row in parser(files, view, kind, options):
            if family == "parser_diagnostics":
                complete = complete and row["code"] not in ("OC1101", "OC1104", "OC1102")
                if row.get("scope"):
                    tainted.append(row["scope"])
            yield family, {"view": view, "kind": kind, "status": "known", **row}
    except Exception as e:  # fail closed: any failure taints the view
        complete, tainted = False, ["*"]
        yield "parser_diagnostics", {"view": view, "code": "OC9001" if kind not in {k for k, _, _ in FORMATS.values()} else "OC1101", "scope": "*", "message": f"{type(e).__name__}: {e}"[:500]}
    yield "views", {"view": view, "kind": kind, "complete": complete, "tainted_scopes": sorted(set(tainted))}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def reused(spark: SparkSession, views: DataFrame, parsed: Callable[[DataFrame], DataFrame], cache: str) -> DataFrame:
    """The parsed rows of views, those whose content has been parsed before read from the cache.

    A view's key is the digest of its name, format, options and files (places, names, bytes) and of this
    package's version of the rows. Views of plug-ins are parsed always: their code is not in the key. A
    view is only in the cache once its write has succeeded.
    """
    content = F.transform("files", lambda f: F.concat_ws("\u0001", f["n"].cast("string"), f["path"], F.coalesce(F.sha2(f["content"], 256), F.lit("large"))))
    key = F.sha2(F.concat_ws("\u0002", F.lit(ROWS_VERSION), "view", "format", "options", F.concat_ws("\u0003", content)), 256)
    keyed = cut(views.withColumn("key", F.when(F.col("format").isin(*FORMATS), key)))
    keys = [r[0] for r in keyed.where("key IS NOT NULL").select("key").distinct().collect()]  # one for each view
    known = [k for k in keys if _exists(spark, f"{cache}/{k}/_SUCCESS")]
    fresh = cut(parsed(keyed.where(F.col("key").isNull() | ~F.col("key").isin(*known))))
    for k in set(keys) - set(known):
        fresh.where(F.col("key") == k).select("family", "row").write.mode("overwrite").parquet(f"{cache}/{k}")
    out = fresh.select("family", "row")
    return out.union(spark.read.schema("family string, row string").parquet(*[f"{cache}/{k}" for k in known])) if known else out


def observe(spark: SparkSession, sources: list[Source], cache: str | None = None) -> dict[str, DataFrame]:
    """Every family's rows of all sources. Files that do not exist give OC1002, patterns without files OC1003.

    ``cache`` is a shared folder in which parsed views are kept by their content; with it, each view is parsed in one task.
    """
    plan = [(k, s.view, format_of(s), json.dumps(s.options), n, p) for k, s in enumerate(sources) for n, p in enumerate(s.paths)]
    parts, lost, large = [], [], {}
    for k, view, format, options, n, path in plan:
        try:
            found = spark.read.format("binaryFile").load(path)
            if cache is None and format in pieces.FORMATS:
                big = found.where(F.col("length") >= pieces.LARGE).select("path", "length").collect()
                if all(pieces.cuttable(format, r.path) for r in big):
                    for r in big:
                        large.setdefault((k, r.path), pieces.Large(k, view, FORMATS[format][0], format, r.path, r.length))
                    found = found.where(F.col("length") < pieces.LARGE)  # by itself, so that Spark reads no larger file's bytes
            found = found.select("path", F.when(F.col("length") <= LARGEST, F.col("content")).alias("content"), F.lit(k).alias("k"), F.lit(view).alias("view"), F.lit(format).alias("format"), F.lit(options).alias("options"), F.lit(n).alias("n"))
            found.schema  # noqa: B018  resolves the path
            parts.append(found)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            lost.append((view, FORMATS.get(format, (format,))[0], "OC1003" if any(c in path for c in "*?[") else "OC1002", path))
    raw = None
    if parts:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        # A file that two patterns list is read once, at the first one's place; a pattern's files go by name.
        first = whole.groupBy("k", "view", "format", "options", "path").agg(F.min("n").alias("n"), F.first("content").alias("content"))
        views = first.groupBy("k", "view", "format", "options").agg(F.array_sort(F.collect_list(F.struct("n", "path", "content"))).alias("files"))
        # Functions travel by value, so executors need not have this package.
        own = {name: parser_of(name) for name in {p[2] for p in plan}}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    files = [(f["path"], None if f["content"] is None else bytes(f["content"])) for f in r["files"]]
                    parser = own[r["format"]]
                    kind = FORMATS.get(r["format"], (r["view"].split(".")[0],))[0]
                    made = ((family, json.dumps(row | {"k": r["k"]} if family == "views" else row)) for family, row in run_parser(parser, files, r["view"], kind, json.loads(r["options"])))
                    while rows := list(islice(made, ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array([r.get("key")] * len(rows), pa.string()), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string())], ["key", "family", "row"])

        parsed = lambda df: df.mapInArrow(run, "key string, family string, row string")
        raw = cut(parsed(views).select("family", "row")) if cache is None else reused(spark, views, parsed, cache)
    if large:
        cut_up = pieces.in_pieces(spark, list(large.values()))
        raw = (cut_up if raw is None else raw.unionAll(cut_up)).hint("merge")
    out = {}
    for family, schema in SCHEMAS.items():
        rows = spark.createDataFrame([], schema)
        if raw is not None:
            rows = raw.where(F.col("family") == family).select(F.from_json("row", schema + ", k int" * (family == "views")).alias("r")).select("r.*")
            if family == "views":  # a source has a row for each piece of its large files, and one for all others
                whole = [F.every("complete").alias("complete"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tainted_scopes")))).alias("tainted_scopes")]
                rows = rows.groupBy("k", "view", "kind").agg(*whole).drop("k") if large else rows.drop("k")
        out[family] = names.hinted(rows) if family == "ports" else rows
    if lost:
        told = spark.createDataFrame([(c, v, "*", f"{p} has no file", p, 0, 0) for v, _, c, p in lost], SCHEMAS["parser_diagnostics"])
        out["parser_diagnostics"] = out["parser_diagnostics"].union(told)
        out["views"] = out["views"].union(spark.createDataFrame([(v, k, False, ["*"]) for v, k, _, _ in lost], SCHEMAS["views"]))
    return out


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def text(data: bytes) -> str:
    """UTF-8 with or without its mark, else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def problem(code: str, message: str, source: str = "", line: int = 0, scope: str = "") -> tuple[str, dict]:
    return "parser_diagnostics", {"code": code, "message": message, "source": source, "line": line, "column": 0, "scope": scope}
