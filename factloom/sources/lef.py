"""LEF abstracts: macros and their pins; geometry is skipped.

A large file is parsed in pieces that begin with a macro (``pieces.py``).
"""

from __future__ import annotations

import re

from .reader import problem, text

USES = {"signal": "signal", "analog": "analog", "power": "power", "ground": "ground", "clock": "clock"}
#: Lines before which a file may be cut, if the scan confirms it.
CUT = re.compile(rb"^[ \t]*MACRO[ \t]", re.M | re.I)


def scan_piece(source: str, line: int, first: bool, last: bool) -> dict | None:
    """The bus brackets that hold behind a piece, if it sets them. None if the file can't be cut behind it: a macro is open."""
    state = State()
    for _ in rows_of(source, "", line, state, last):
        pass
    return None if state.macro and not last else {"braces": state.braces}


def join_pieces(scans: list[dict]) -> list[dict]:
    """The brackets in which a file's pieces begin."""
    states, braces = [], None
    for s in scans:
        states.append({"braces": braces})
        braces = s["braces"] or braces
    return states


def parse_piece(source: str, path: str, line: int, state: dict, last: bool):
    return rows_of(source, path, line, State(state["braces"]), last)


def parse_lef(files, view, kind, options):
    for path, data in files:
        yield from rows_of(text(data), path, 1, State(), True)


class State:
    """What a parser keeps from line to line that other pieces ask for."""

    __slots__ = ("braces", "macro")

    def __init__(self, braces: list[str] | None = None):
        self.braces, self.macro = braces, None


def rows_of(source: str, path: str, first: int, state: State, last: bool):
    """The rows of a file, or of a piece that begins on a line."""
    macro = pin = None
    buses: dict[str, dict] = {}
    left_brace, right_brace = state.braces or "[]"
    body = re.sub(r"#[^\n]*", "", source)
    for number, raw in enumerate(body.split("\n"), first):
        words = raw.replace(";", " ; ").split()
        if not words:
            continue
        head = words[0].upper()
        if head == "BUSBITCHARS" and len(words) > 1 and len(words[1].strip('"')) == 2:
            left_brace, right_brace = state.braces = list(words[1].strip('"'))
        elif head == "MACRO" and len(words) > 1:
            if macro:
                yield problem("OC1101", f"macro {macro} is not closed", path, number, macro)
            macro, buses = words[1], {}
            yield "components", {"native_name": macro, "source": path, "line": number, "column": 1, "ordinal": number}
        elif head == "PIN" and len(words) > 1 and macro:
            bit = re.fullmatch(rf"(.+){re.escape(left_brace)}(\d+){re.escape(right_brace)}", words[1])
            pin = buses.setdefault(bit[1] if bit else words[1], {"name": words[1], "base": bit[1] if bit else words[1], "bits": [], "line": number})
            pin["name"] = words[1]
            if bit:
                pin["bits"].append(int(bit[2]))
        elif head == "DIRECTION" and pin is not None and len(words) > 1:
            pin.setdefault("direction", words[1].lower())
        elif head == "USE" and pin is not None and len(words) > 1:
            pin.setdefault("role", USES.get(words[1].lower()))
        elif head == "END" and len(words) > 1:
            if pin is not None and words[1] == pin["name"]:
                pin = None
            elif words[1] == macro:
                if pin is not None:
                    yield problem("OC1101", f"pin {pin['name']} is not closed", path, number, macro)
                for k, p in enumerate(buses.values()):
                    bits = p["bits"]
                    yield "ports", {
                        "component": macro, "native_name": p["base"], "ordinal": k, "direction": p.get("direction"), "role": p.get("role"), "width": len(set(bits)) or 1, "bit_indices": bits, "explicit_scalar": not bits, "bit_order_known": not bits,
                        "physical": True, "source": path, "line": p["line"], "column": 1,
                    }
                macro = pin = None
    state.macro = macro
    if macro and last:
        yield problem("OC1101", f"macro {macro} is not closed", path, 0, macro)
