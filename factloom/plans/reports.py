"""Reports of diagnostics: JSON, text, Markdown, SARIF and HTML.

``render_*`` give a report as a text, which the driver holds. ``publish_parts`` writes the same bytes of JSON, SARIF and
Markdown without that: each partition of the ordered diagnostics writes its rows, the driver only the head, the tail
and what has one row for each severity or code; the file system joins the parts.
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import CATALOG
from factloom.operators.shared import shared_folder

LEVELS = {"fatal": "error", "error": "error", "warning": "warning", "info": "note"}


def told(r: dict) -> dict:
    """A diagnostic as a report has it."""
    evidence = [{k: v for k, v in e.items() if v is not None} for e in r["evidence"]]
    return {"code": r["code"], "rule": r["rule"], "severity": r["severity"], "message": r["message"], "object": {"kind": r["object_kind"], "id": r["object_id"]} if r["object_id"] else None, "property": r["property"], "fingerprint": r["fingerprint"], "evidence": evidence, "waiver": r["waiver"]}


def rows(diagnostics: DataFrame, include_waived: bool = True) -> list[dict]:
    return [told(r.asDict(True)) for r in diagnostics.toLocalIterator() if include_waived or r.waiver is None]


def exit_code(found: list[dict], deny_warnings: bool = False) -> int:
    live = {d["severity"] for d in found if d["waiver"] is None}
    return 2 if "fatal" in live else 1 if "error" in live or deny_warnings and "warning" in live else 0


def render_json(diagnostics: DataFrame, project: str = "", pretty: bool = False) -> str:
    found = rows(diagnostics)
    counts = Counter(d["severity"] for d in found if d["waiver"] is None)
    return json.dumps(_body(found, counts, sum(d["waiver"] is not None for d in found), project), indent=2 if pretty else None, sort_keys=True)


def _body(found: list, counts: dict[str, int], waived: int, project: str) -> dict:
    code = 2 if counts.get("fatal") else 1 if counts.get("error") else 0
    return {"schema_version": 1, "project": project, "status": "pass" if code == 0 else "fail", "exit_code": code, "summary": {s: counts.get(s, 0) for s in LEVELS} | {"waived": waived}, "diagnostics": found}


def render_text(diagnostics: DataFrame, verbose: bool = False) -> str:
    out = []
    for d in rows(diagnostics, verbose):
        out.append(f"{d['severity']}[{d['code']}] {d['message']}" + (f" (waiver {d['waiver']})" if d["waiver"] is not None else ""))
        if verbose:
            out += [f"    {e.get('view', '')}: {e.get('value', '')} {e.get('source', '')}:{e.get('line', '')}" for e in d["evidence"]]
    return "\n".join(out) + "\n"


HEAD = "| Severity | Code | Object | Message |\n|---|---|---|---|\n"


def markdown_row(d: dict) -> str:
    clean = lambda s: str(s or "").replace("|", "\\|").replace("\n", " ")
    return f"| {d['severity']} | {d['code']} | {clean((d['object'] or {}).get('id'))} | {clean(d['message'])} |"


def render_markdown(diagnostics: DataFrame) -> str:
    return HEAD + "".join(f"{markdown_row(d)}\n" for d in rows(diagnostics, False))


def sarif_result(d: dict, used: list[str]) -> dict:
    places = [{"physicalLocation": {"artifactLocation": {"uri": e["source"]}, "region": {"startLine": max(1, e.get("line") or 1)}}} for e in d["evidence"] if e.get("source")]
    return {"ruleId": d["code"], "ruleIndex": used.index(d["code"]), "level": LEVELS[d["severity"]], "message": {"text": d["message"]}, "locations": places[:1], "relatedLocations": places[1:], "partialFingerprints": {"finding/v1": d["fingerprint"]}} | ({"suppressions": [{"kind": "external"}]} if d["waiver"] is not None else {})


def render_sarif(diagnostics: DataFrame) -> str:
    found = rows(diagnostics)
    used = sorted({d["code"] for d in found})
    return _sarif([sarif_result(d, used) for d in found], used)


def _sarif(results: list, used: list[str]) -> str:
    rules = [{"id": c, "name": CATALOG[c][0], "defaultConfiguration": {"level": LEVELS[CATALOG[c][1]]}} for c in used if c in CATALOG]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "factloom", "rules": rules}}, "results": results}]}, sort_keys=True)


def render_html(diagnostics: DataFrame, title: str = "Findings") -> str:
    """One file without outside parts; its policy allows only its own style, by hash."""
    style = "body{font:14px sans-serif}td,th{padding:4px 8px;text-align:left}.fatal,.error{color:#a00}.warning{color:#850}"
    import base64

    allowed = base64.b64encode(hashlib.sha256(style.encode()).digest()).decode()
    e = lambda s: html.escape(str(s or ""))
    body = "".join(f"<tr class={d['severity']}><td>{d['severity']}<td>{e(d['code'])}<td>{e((d['object'] or {}).get('id'))}<td>{e(d['message'])}" for d in rows(diagnostics))
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src \'none\'; style-src \'sha256-{allowed}\'"><title>{e(title)}</title><style>{style}</style></head><body><h1>{e(title)}</h1><table><tr><th>Severity<th>Code<th>Object<th>Message{body}</table></body></html>'


#: Stands for the rows where head and tail are made; no report has it.
_HERE = "\u0001here\u0001"


def publish_parts(diagnostics: DataFrame, path: str, form: str, project: str = "") -> None:
    """Write the report ``form`` (json, sarif, markdown) of ordered diagnostics to one file of the file system of ``path``.

    The same bytes as the renderer's, at any number of diagnostics. The file takes its place when it is whole.
    """
    if form not in ("json", "sarif", "markdown"):
        raise ValueError(f"{form} is not written by parts")
    spark = diagnostics.sparkSession
    counts = {(r.severity, r.w): r.n for r in diagnostics.groupBy("severity", F.col("waiver").isNotNull().alias("w")).agg(F.count("*").alias("n")).collect()}  # eight rows at most
    used = sorted(r.code for r in diagnostics.select("code").distinct().collect()) if form == "sarif" else []  # one row a code
    live, waived = {s: n for (s, w), n in counts.items() if not w}, sum(n for (_, w), n in counts.items() if w)
    if form == "markdown":
        head, tail, end = HEAD, "", "\n"
    else:
        whole = _sarif([_HERE], used) if form == "sarif" else json.dumps(_body([_HERE], live, waived, project), sort_keys=True)
        (head, tail), end = whole.split(json.dumps(_HERE)), ", "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (told(r) for r in batch.to_pylist())
            if form == "markdown":
                lines = [markdown_row(d) for d in found if d["waiver"] is None]
            else:
                lines = [json.dumps(sarif_result(d, used) if form == "sarif" else d, sort_keys=True) for d in found]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    folder = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    diagnostics.mapInArrow(run, "value string").write.option("lineSep", end).text(folder)
    _join(spark, folder, path, head.encode(), tail.encode(), len(end) if form != "markdown" else 0)


def _join(spark: SparkSession, folder: str, path: str, head: bytes, tail: bytes, less: int) -> None:
    """One file of a head, the folder's parts in order without the last ``less`` bytes, and a tail; streams, never held."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    place, own = hadoop.fs.Path(path), hadoop.fs.Path(folder)
    fs, source = place.getFileSystem(conf), own.getFileSystem(conf)
    parts = sorted((int(f.getPath().getName().split("-")[1]), f.getPath(), f.getLen()) for f in source.listStatus(own) if f.getPath().getName().startswith("part-") and f.getLen())
    temp = hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(bytearray(head))
    for k, (_, part, size) in enumerate(parts):
        into = source.open(part)
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(into, out, 0, size - (less if k == len(parts) - 1 else 0))
        into.close()
    out.write(bytearray(tail))
    out.close()
    fs.delete(place, False)
    if not fs.rename(temp, place):
        raise OSError(f"{path} can't be written")
    source.delete(own, True)


def publish(path: str, text: str, overwrite: bool = True) -> None:
    """Write a report so that readers see the old file or the whole new one. A driver-side file."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".report-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(temp, path)
        else:  # a link fails where there is a file already, at whatever moment it came
            os.link(temp, path)
            os.unlink(temp)
    except BaseException:
        os.unlink(temp)
        raise
