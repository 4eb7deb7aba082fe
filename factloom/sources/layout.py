"""GDSII streams: structures as components, chosen text labels as their pins."""

from __future__ import annotations

import struct

from .reader import problem

# Record types of the stream format.
BGNSTR, STRNAME, ENDSTR, TEXT, SREF, AREF, LAYER, TEXTTYPE, STRING, SNAME, ENDEL, ENDLIB, HEADER = 0x05, 0x06, 0x07, 0x0C, 0x0A, 0x0B, 0x0D, 0x16, 0x19, 0x12, 0x11, 0x04, 0x00

#: All record types that the format defines.
KNOWN = frozenset(range(0x00, 0x3C))


def real8(b: bytes) -> float:
    """Excess-64 base-16 number."""
    sign = -1.0 if b[0] & 0x80 else 1.0
    return sign * int.from_bytes(b[1:8], "big") / 2.0**56 * 16.0 ** ((b[0] & 0x7F) - 64)


def records(data: bytes):
    """(offset, type, payload); stops with an error where the framing breaks."""
    at = 0
    while at + 4 <= len(data):
        size, kind, _ = struct.unpack_from(">HBB", data, at)
        if size < 4 or size % 2 or at + size > len(data):
            raise ValueError(f"the record at byte {at} has length {size}")
        yield at, kind, data[at + 4 : at + size]
        at += size
        if kind == ENDLIB:
            return
    raise ValueError("the stream ends before its library does")


def parse_gds(files, view, kind, options):
    """Labels on ``pin_text_layers`` and of ``pin_text_types`` are pins; without either there are none."""
    layers, types, tops = (options.get(k) for k in ("pin_text_layers", "pin_text_types", "top_cells"))
    wanted = lambda x: (layers or types) and (not layers or x.get("layer") in layers) and (not types or x.get("type") in types)
    for path, data in files:
        cell, element, seen, odd = None, None, set(), set()
        try:
            for at, t, body in records(data):
                name = body.rstrip(b"\0").decode("latin-1")
                if t == STRNAME:
                    cell = name
                    if not tops or cell in tops:
                        yield "components", {"native_name": cell, "ordinal": at, "source": path, "line": 0, "column": at}
                elif t in (TEXT, SREF, AREF):
                    element = {"kind": t}
                elif element is not None and t == LAYER:
                    element["layer"] = struct.unpack(">h", body)[0]
                elif element is not None and t == TEXTTYPE:
                    element["type"] = struct.unpack(">h", body)[0]
                elif element is not None and t in (STRING, SNAME):
                    element["name"] = name
                elif t == ENDEL and element is not None:
                    if element["kind"] == TEXT and cell and wanted(element) and (not tops or cell in tops) and (cell, element.get("name")) not in seen:
                        seen.add((cell, element["name"]))
                        yield "ports", {"component": cell, "native_name": element["name"], "width": None, "source": path, "line": 0, "column": at, "ordinal": at}
                    elif element["kind"] in (SREF, AREF) and cell:
                        yield "objects", {"object_kind": "cell", "relation": "reference", "native_name": element.get("name"), "scope": cell, "ordinal": at}
                    element = None
                elif t == ENDSTR:
                    cell = None
                elif t not in KNOWN and t not in odd:
                    odd.add(t)
                    yield problem("OC1102", f"records of type {t} are not read", path, at, cell or "*")
        except (ValueError, struct.error) as e:
            yield problem("OC1101", str(e), path, 0, cell or "*")
