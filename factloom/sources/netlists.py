"""CDL and SPICE subcircuits, and DEF designs."""

from __future__ import annotations

import re

from .reader import problem, text

CODES = {"i": "input", "o": "output", "b": "inout", "p": "inout", "g": "inout"}


def parse_cdl(files, view, kind, options):
    """.SUBCKT interfaces, .PININFO directions, X, M, R, C and L instances; other cards are told, not guessed."""
    for path, data in files:
        lines: list[tuple[int, str]] = []
        for number, raw in enumerate(text(data).splitlines(), 1):
            line = raw.split("$", 1)[0] if not raw.lstrip().startswith("*") else raw
            if line.startswith("+") and lines:
                lines[-1] = (lines[-1][0], lines[-1][1] + " " + line[1:])
            elif line.strip():
                lines.append((number, line.strip()))
        name, pins, told = None, {}, {}
        for number, line in lines:
            info = re.match(r"\*?\.PININFO\s+(.*)", line, re.I)
            if info and name:
                for item in info[1].split():
                    pin, _, code = item.partition(":")
                    told[pin.lower()] = code.lower()[:1]
                continue
            pin = re.match(r"\*\|P\s*\(\s*(\S+)\s+([A-Za-z])\b", line) or re.match(r"\.P(?:ORT|IN)\s+(\S+)\s+DIRECTION=([A-Za-z])", line, re.I)
            if pin and name:
                told[pin[1].lower()] = pin[2].lower()
                continue
            if line.startswith("*"):
                continue
            words = line.split()
            card = words[0].lower()
            if card == ".subckt" and len(words) > 1:
                if name:
                    yield problem("OC1101", f"subcircuit {name} is not closed", path, number, name)
                name, told = words[1], {}
                pins = {w: k for k, w in enumerate(words[2:]) if "=" not in w and w != "/"}
                yield "components", {"native_name": name, "source": path, "line": number, "column": 1, "ordinal": number}
            elif card == ".ends":
                for p, k in pins.items():
                    code = told.get(p.lower())
                    yield "ports", {"component": name, "native_name": p, "ordinal": k, "direction": CODES.get(code), "role": {"p": "power", "g": "ground"}.get(code), "width": 1, "explicit_scalar": True, "source": path, "line": number, "column": 1}
                name, pins = None, {}
            elif card[0] == "x" and name:
                nets = [w for w in words[1:] if "=" not in w and w != "/"]
                if len(nets) < 1:
                    yield problem("OC1101", f"instance {words[0]} has no cell", path, number, name)
                    continue
                yield "objects", {"object_kind": "instance", "relation": "definition", "native_name": words[0][1:] or words[0], "scope": name, "ordinal": number}
                yield "objects", {"object_kind": "cell", "relation": "reference", "native_name": nets[-1], "scope": name, "ordinal": number}
            elif card[0] in "mrcl" and name:
                yield "objects", {"object_kind": "instance", "relation": "definition", "native_name": words[0], "scope": name, "ordinal": number}
            elif card in (".param", ".global", ".model", ".end", ".option", ".options"):
                continue
            else:
                yield problem("OC1102", f"{words[0]} is not read", path, number, name or "")
        if name:
            yield problem("OC1101", f"subcircuit {name} is not closed", path, 0, name)


def parse_def(files, view, kind, options):
    """Components, pins and nets of the one design; nets' endpoints are references into the RTL."""
    for path, data in files:
        body = re.sub(r"#[^\n]*", "", text(data))
        design, section, ports, ended = None, None, {}, False
        line, counted = 1, 0
        for m in re.finditer(r"\s*(?:END\s+\w+|[^;]*;)", body):
            words = m[0].split()
            line += body.count("\n", counted, m.start())
            counted = m.start()
            if not words:
                continue
            head = words[0].upper()
            if head == "END":
                ended = ended or words[1:2] == ["DESIGN"]
                section = None
            elif head == "DESIGN" and len(words) > 1 and not section:
                design = words[1]
                yield "components", {"native_name": design, "source": path, "line": line, "column": 1, "ordinal": 0}
            elif head in ("COMPONENTS", "PINS", "NETS", "SPECIALNETS") and words[1:2] and words[1].isdigit():
                section = head
            elif head == "-" and section == "COMPONENTS" and len(words) > 2:
                yield "objects", {"object_kind": "instance", "relation": "reference", "native_name": words[1], "ordinal": line}
            elif head == "-" and section == "PINS" and len(words) > 1:
                clauses = {c.split()[0].upper(): c.split()[1:] for c in " ".join(words[2:]).rstrip("; ").split("+") if c.strip()}
                bit = re.fullmatch(r"(.+)\[(\d+)(?::(\d+))?\]", words[1].replace("\\", ""))
                p = ports.setdefault(bit[1] if bit else words[1], {"bits": [], "line": line, "direction": (clauses.get("DIRECTION") or [None])[0], "role": (clauses.get("USE") or [None])[0], "nets": set()})
                p["nets"].update(clauses.get("NET", []))
                if bit:
                    a, b = int(bit[2]), int(bit[3] or bit[2])
                    p["bits"] += range(a, b - 1, -1) if a >= b else range(a, b + 1)
            elif head == "-" and section in ("NETS", "SPECIALNETS") and len(words) > 1:
                yield "objects", {"object_kind": "net", "relation": "reference", "native_name": words[1], "ordinal": line}
                for inst, pin in re.findall(r"\(\s*(\S+)\s+(\S+)[^)]*\)", m[0]):
                    if inst == "PIN":
                        yield "objects", {"object_kind": "port", "relation": "reference", "native_name": pin, "ordinal": line}
                    elif inst != "*":
                        yield "objects", {"object_kind": "pin", "relation": "reference", "native_name": f"{inst}/{pin}", "ordinal": line}
        for k, (n, p) in enumerate(ports.items()):
            yield "ports", {"component": design or "", "native_name": n, "ordinal": k, "direction": (p["direction"] or "").lower() or None, "role": (p["role"] or "").lower() or None, "width": len(set(p["bits"])) or 1, "bit_indices": p["bits"], "explicit_scalar": not p["bits"], "bit_order_known": False, "physical": True, "source": path, "line": p["line"], "column": 1}
        if not ended or design is None:
            yield problem("OC1101", "the design is not complete", path, line, "*")
