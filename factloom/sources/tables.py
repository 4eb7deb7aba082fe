"""CSV files: pins of components, package maps, connectivity requirements."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

from .reader import problem, text

# Accepted spellings of the columns.
PIN_COLUMNS = {
    "signal": ("signal", "name", "pin", "pin_name", "signal_name", "port", "net"), "die_pad": ("die_pad", "pad", "die", "pad_name"), "package_ball": ("package_ball", "ball", "package_pin", "ball_name"),
    "component": ("component", "cell", "module", "block"), "direction": ("direction", "dir", "io"), "role": ("role", "type", "use"), "range": ("range", "bus"), "width": ("width",), "left": ("left", "msb"), "right": ("right", "lsb"), "bit": ("bit", "index"),
}
REQUIREMENT_COLUMNS = ("id", "source", "sink", "expect", "transform", "through", "exclude", "description")
SELECTOR = re.compile(r"^[^\[\]\s;]+(?:\[(?:\*|[+-]?\d+|[+-]?\d+\s*:\s*[+-]?\d+)\])?$")


def title_key(title: str) -> tuple[str, ...]:
    """The words of a column title; titles with the same words are the same column."""
    return tuple("".join(c if c.isascii() and c.isalnum() else " " for c in title.casefold()).split())


KNOWN_TITLES = {title_key(spelling): column for column, spellings in PIN_COLUMNS.items() for spelling in spellings}


def _rows(data: bytes, delimiter: str | None) -> Iterator[tuple[int, list[str]]]:
    body = text(data)
    if delimiter is None:
        head = body.split("\n", 1)[0]
        delimiter = max(",;\t|", key=head.count)
    reader = csv.reader(io.StringIO(body, newline=""), delimiter=delimiter, strict=True)
    for row in reader:
        if any(c.strip() for c in row) and not row[0].lstrip().startswith("#"):
            yield reader.line_num, [c.strip() for c in row]


def parse_csv(files, view, kind, options):
    """Profile ``component_pins`` gives ports, ``package_map`` pin mappings. Bits of one signal make one bus."""
    mapping = options.get("column_map", {})
    package = options.get("profile", "package_map" if view.endswith(".package") else "component_pins") == "package_map"
    ports: dict[tuple[str, str], dict] = {}
    for path, data in files:
        rows = _rows(data, options.get("delimiter"))
        try:
            _, head = next(rows)
        except StopIteration:
            yield problem("OC5006", "the table has no header", path)
            continue
        titles = KNOWN_TITLES | {title_key(v): k for k, v in mapping.items()}
        columns = [titles.get(title_key(h)) for h in head]
        if "signal" not in columns and not (package and "die_pad" in columns) or package and "package_ball" not in columns:
            yield problem("OC5006", "a required column is missing", path, 1, "*")
            continue
        for line, cells in rows:
            if len(cells) != len(head):
                yield problem("OC5006", f"{len(cells)} fields instead of {len(head)}", path, line, "*")
                continue
            r = {c: v for c, v in zip(columns, cells, strict=True) if c and v}
            component = r.get("component") or options.get("component_name")
            if package:
                yield "pin_mappings", {"die_pad": r.get("die_pad"), "package_ball": r.get("package_ball"), "signal": r.get("signal"), "component": component, "line": line}
                continue
            m = re.fullmatch(r"(.+?)\s*[\[<](-?\d+)(?::(-?\d+))?[\]>]", r.get("signal", ""))
            name = m[1] if m else r.get("signal")
            if not name or not component:
                yield problem("OC5006", "a row needs a signal and a component", path, line, "*")
                continue
            p = ports.setdefault((component, name), {"component": component, "native_name": name, "bits": [], "values": {}, "source": path, "line": line, "column": 1, "ordinal": len(ports)})
            span = re.fullmatch(r"\[?(-?\d+)\s*:\s*(-?\d+)\]?", r.get("range", ""))
            left, right = (m[2], m[3]) if m and m[3] else (span[1], span[2]) if span else (r.get("left"), r.get("right"))
            if left is not None and right is not None:
                p["left"], p["right"] = int(left), int(right)
            elif m or r.get("bit"):
                p["bits"].append(int(m[2] if m else r["bit"]))
            for c in ("direction", "role", "width"):
                if c in r:
                    p["values"].setdefault(c, set()).add(r[c].lower())
    for component in dict.fromkeys(c for c, _ in ports):
        yield "components", {"native_name": component, "ordinal": 0}
    for p in ports.values():
        values, bits = p.pop("values"), p.pop("bits")
        torn = {c for c, v in values.items() if len(v) > 1}  # rows of one port that disagree
        if torn:
            yield problem("OC5006", f"rows of {p['native_name']} disagree on {', '.join(sorted(torn))}", p["source"], p["line"])
        one = {c: next(iter(v)) for c, v in values.items() if len(v) == 1}
        width = abs(p["left"] - p["right"]) + 1 if "left" in p else len(set(bits)) or None
        if width is None:
            width = int(one["width"]) if one.get("width", "").isdigit() else 1
        shape = {"packed": [{"left": p["left"], "right": p["right"]}]} if "left" in p else {"bit_indices": bits} if bits else {}
        yield "ports", {**p, **shape, "width": width, "explicit_scalar": width == 1 and not shape, "bit_order_known": not bits, "direction": one.get("direction"), "role": one.get("role"), "field_states": dict.fromkeys(torn & {"direction", "role"}, "tainted")}


def parse_connectivity(files, view, kind, options):
    """Requirements; columns that aren't known make the file invalid."""
    ordinal = 0
    for path, data in files:
        rows = _rows(data, options.get("delimiter"))
        _, head = next(rows, (0, []))
        columns = ["_".join(title_key(h)) for h in head]
        if set(columns) - set(REQUIREMENT_COLUMNS) or not {"id", "source", "sink", "expect"} <= set(columns) or len(set(columns)) != len(columns):
            yield problem("OC1101", f"columns {', '.join(head)} are not those of a requirement table", path, 1, "*")
            continue
        for line, cells in rows:
            r = dict(zip(columns, cells, strict=False))
            through, exclude = ([x.strip() for x in r.get(c, "").split(";") if x.strip()] for c in ("through", "exclude"))
            transform = r.get("transform") or "identity"
            bad = len(cells) != len(columns) or not all(SELECTOR.match(x) for x in (r.get("source", ""), r.get("sink", ""), *through, *exclude)) or r.get("expect") not in ("reachable", "unreachable") or transform not in ("any", "identity", "inverted", "reverse")
            if bad or not r.get("id"):
                yield problem("OC1101", "the row is no requirement", path, line, r.get("id") or "*")
                continue
            yield "requirements", {"id": r["id"], "source": r["source"], "sink": r["sink"], "expectation": r["expect"], "transform": transform, "through": through, "exclude": exclude, "ordinal": ordinal}
            ordinal += 1
