"""Register descriptions: IP-XACT components, a subset of SystemRDL, C headers of macros."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
import xml.etree.ElementTree as ET

from .reader import problem, text


class Expression(ValueError):
    pass


class Unknown(Expression):
    """A name that has no value (yet)."""

    def __init__(self, name: str):
        super().__init__(f"{name} is not known")
        self.name = name


def _based(m: re.Match) -> str:
    try:
        return str(int(m[2].replace("_", ""), {"h": 16, "d": 10, "b": 2, "o": 8}[m[1].lower()]))
    except ValueError as e:
        raise Expression(f"{m[0]!r} is no number") from e


def integer(source: str, names: dict[str, int] | None = None, depth: int = 0) -> int:
    """A bounded integer expression: + - * / % << >> & | ^ ~, C and Verilog literals, known names.

    Division truncates towards zero; the remainder has the divisor's sign.
    """
    names = names or {}
    s = re.sub(r"(?:\b\d+\s*)?'\s*s?([hdbo])\s*([0-9a-fA-F_]+)", _based, source.strip(), flags=re.I)
    s = re.sub(r"\b(0[xX][0-9a-fA-F]+|\d+)[uUlL]+\b", r"\1", s)
    s = re.sub(r"\(\s*u?int(?:8|16|32|64)_t\s*\)|\(\s*(?:unsigned|signed|int|long|\s)+\)", "", s)
    s = re.sub(r"\b0+(\d)", r"\1", s) if re.fullmatch(r"\s*0+\d+\s*", s) else s
    if len(s) > 1000 or depth > 20:
        raise Expression("too long")
    try:
        tree = ast.parse(s, mode="eval").body
    except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
        raise Expression(f"{source!r} is no expression") from e

    def value(n) -> int:
        if isinstance(n, ast.Constant) and type(n.value) is int:
            return n.value
        if isinstance(n, ast.Name):
            if n.id not in names:
                raise Unknown(n.id)
            return names[n.id]
        if isinstance(n, ast.UnaryOp):
            v = value(n.operand)
            return {ast.USub: -v, ast.UAdd: v, ast.Invert: ~v}.get(type(n.op), v)
        if isinstance(n, ast.BinOp):
            a, b = value(n.left), value(n.right)
            if isinstance(n.op, (ast.Div, ast.FloorDiv, ast.Mod)) and not b:
                raise Expression("division by zero")
            if isinstance(n.op, (ast.LShift, ast.RShift)) and not 0 <= b <= 4096:
                raise Expression("shift out of bounds")
            made = {
                ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1), ast.Mod: lambda: a % b, ast.LShift: lambda: a << b, ast.RShift: lambda: a >> b,
                ast.BitAnd: lambda: a & b, ast.BitOr: lambda: a | b, ast.BitXor: lambda: a ^ b,
            }.get(type(n.op))
            if made is None:
                raise Expression("an operator that isn't read")
            v = made()
            if v.bit_length() > 4096:
                raise Expression("out of bounds")
            return v
        raise Expression("a form that isn't read")

    return value(tree)


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _child(e, *path: str):
    for name in path:
        e = next((c for c in e if _local(c) == name), None) if e is not None else None
    return e


def _all(e, name: str):
    return [] if e is None else [c for c in e if _local(c) == name]


def _said(e, *path: str) -> str | None:
    c = _child(e, *path)
    return c.text.strip() if c is not None and c.text and c.text.strip() else None


def parse_ipxact(files, view, kind, options):
    """Components of any of the schema's versions: ports, bus interfaces, memory maps, registers, fields; no DTD."""
    for path, data in files:
        if re.search(rb"<!(DOCTYPE|ENTITY)", data, re.I):
            yield problem("OC1101", "documents with a DTD or entities are refused", path, 1, "*")
            continue
        try:
            root = ET.fromstring(data)
        except ET.ParseError as e:
            yield problem("OC1101", str(e), path, e.position[0], "*")
            continue
        if _local(root) != "component":
            yield problem("OC1102", f"{_local(root)} is no component", path, 1, "")
            continue
        name = _said(root, "name") or ""
        names: dict[str, int] = {k: int(v) for k, v in options.get("parameter_values", {}).items()}
        for p in root.iter():
            if _local(p) == "parameter" and (_said(p, "name") or p.get("parameterId")):
                for key in {_said(p, "name"), p.get("parameterId")} - {None}:
                    try:
                        names.setdefault(key, integer(_said(p, "value") or "", names))
                    except Expression:
                        pass
        bad: list = []

        def number(s: str | None, what: str, bad=bad, names=names, path=path):
            if s is None:
                return None
            try:
                return integer(s, names)
            except Expression as e:
                bad.append(problem("OC1103", f"{what}: {e}", path, 0, ""))
                return None

        yield "components", {"native_name": name, "ordinal": 0, "source": path, "line": 1, "column": 1}
        for k, port in enumerate(_all(_child(root, "model", "ports"), "port")):
            wire = _child(port, "wire")
            vector = _child(wire, "vectors", "vector") if _child(wire, "vectors") is not None else _child(wire, "vector")
            left, right = number(_said(vector, "left"), "left"), number(_said(vector, "right"), "right")
            torn = vector is not None and (left is None or right is None)
            yield "ports", {"component": name, "native_name": _said(port, "name"), "ordinal": k, "direction": _said(wire, "direction"), "width": None if torn else abs(left - right) + 1 if left is not None else 1, "left": left, "right": right, "packed": [{"left": left, "right": right}] if left is not None and right is not None else [], "explicit_scalar": vector is None, "bit_order_known": True, "source": path, "line": 1, "column": 1}
        for bus in _all(_child(root, "busInterfaces"), "busInterface"):
            maps = {}
            for m in bus.iter():
                if _local(m) == "portMap" and _said(m, "logicalPort", "name") and _said(m, "physicalPort", "name"):
                    maps[_said(m, "logicalPort", "name")] = _said(m, "physicalPort", "name")
            yield "interfaces", {"component": name, "native_name": _said(bus, "name"), "port_maps": maps, "allow_many_to_one": False}

        def registers(at, base, unit, block, mmap, files_, order, number=number):
            for r in _all(at, "register"):
                offset = number(_said(r, "addressOffset"), "offset")
                size = number(_said(r, "size"), "size")
                dims = [number(d.text, "dim") for d in (*_all(r, "dim"), *_all(_child(r, "array"), "dim"))]
                count = 1
                for d in dims:
                    count = count * d if d and count else None
                fields = []
                for fl in _all(r, "field"):
                    reset = _said(fl, "resets", "reset", "value")
                    fields.append({"name": _said(fl, "name"), "bit_offset": number(_said(fl, "bitOffset"), "bit offset"), "bit_width": number(_said(fl, "bitWidth"), "bit width"), "access": _said(fl, "access") or _said(fl, "fieldAccessPolicies", "fieldAccessPolicy", "access"), "reset": number(reset, "reset"), "status": "known"})
                for k in range(count or 1):
                    o = None if offset is None else (offset + k * max(1, (size or 8) // (unit or 8))) * (unit or 8) // 8
                    yield "registers", {"native_name": _said(r, "name") + (f"[{k}]" if dims else ""), "component": name, "memory_map": mmap, "address_block": block, "register_files": files_, "address_offset": o, "absolute_address": None if o is None or base is None else base + o, "size_bits": size, "access": _said(r, "access"), "ordinal": next(order), "fields": fields, "status": "known" if count else "tainted"}
            for rf in _all(at, "registerFile"):
                yield from registers(rf, None if base is None else base + (number(_said(rf, "addressOffset"), "offset") or 0), unit, block, mmap, [*files_, _said(rf, "name")], order)

        order = iter(range(10**9))
        for mm in _all(_child(root, "memoryMaps"), "memoryMap"):
            unit = number(_said(mm, "addressUnitBits"), "unit") or 8
            for b in _all(mm, "addressBlock"):
                yield from registers(b, number(_said(b, "baseAddress"), "base"), unit, _said(b, "name"), _said(mm, "name"), [], order)
        yield from bad


def parse_systemrdl(files, view, kind, options):
    """addrmap, regfile, reg and field instances with offsets, widths, sw access and resets; Perl and includes are refused."""
    token = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|[A-Za-z_]\w*|0[xX][0-9a-fA-F]+|\d+(?:\'[hdb][0-9a-fA-F_]+)?|[@+%]=|[{}\[\];:=@,#.()]|.', re.S)
    for path, data in files:
        body = text(data)
        if "<%" in body or re.search(r"^\s*`", body, re.M):
            yield problem("OC1102", "embedded code and preprocessor lines are not read", path, 1, "*")
            continue
        breaks = [m.start() for m in re.finditer("\n", body)]
        tokens = [(m[0], bisect_left(breaks, m.start()) + 1) for m in token.finditer(body) if not m[0].isspace() and not m[0].startswith(("//", "/*"))]
        k = 0
        out: list = []

        def number(s: str):
            return int(s, 0) if re.fullmatch(r"0[xX][0-9a-fA-F]+|\d+", s) else integer(s)

        def block(kind: str, name: str | None, scope: dict) -> dict:
            """A definition's body: properties and instances."""
            nonlocal k
            made = {"kind": kind, "type": name, "props": {}, "items": [], "defaults": dict(scope)}
            while k < len(tokens) and tokens[k][0] != "}":
                t, line = tokens[k]
                if t in ("addrmap", "regfile", "reg", "field"):
                    k += 1
                    type_name = tokens[k][0] if tokens[k][0] != "{" else None
                    k += type_name is not None
                    if tokens[k][0] != "{":
                        raise ValueError(f"line {line}: {t} has no body")
                    k += 1
                    inner = block(t, type_name, made["defaults"])
                    k += 1
                    types[type_name or f"#{k}"] = inner
                    instances(inner, made)
                elif t in ("external", "internal", "alias"):
                    k += 1
                elif t == "default":
                    k += 1
                    key = tokens[k][0]
                    made["defaults"][key] = tokens[k + 2][0] if tokens[k + 1][0] == "=" else "true"
                    skip()
                elif t in types:
                    k += 1
                    instances(types[t], made)
                else:
                    end = next((i for i in range(k + 2, len(tokens)) if tokens[i][0] == ";"), k + 2)
                    made["props"][t] = "".join(x[0] for x in tokens[k + 2 : end]) if tokens[k + 1][0] == "=" else "true"
                    skip()
            if k >= len(tokens):
                raise ValueError("a body is not closed")
            return made

        def skip():
            nonlocal k
            while k < len(tokens) and tokens[k][0] not in (";", "}"):
                k += 1
            k += k < len(tokens) and tokens[k][0] == ";"

        def instances(inner: dict, owner: dict):
            nonlocal k
            while k < len(tokens) and tokens[k][0] not in (";", "}"):
                if tokens[k][0] == ",":
                    k += 1
                    continue
                item = {"name": tokens[k][0], "of": inner}
                k += 1
                while k < len(tokens) and tokens[k][0] not in (",", ";", "}"):
                    t = tokens[k][0]
                    if t == "[":
                        end = next(i for i in range(k, len(tokens)) if tokens[i][0] == "]")
                        item["range"] = "".join(x[0] for x in tokens[k + 1 : end])
                        k = end
                    elif t in ("@", "=", "+="):
                        item[t] = tokens[k + 1][0]
                        k += 1
                    k += 1
                owner["items"].append(item)
            if k >= len(tokens) or tokens[k][0] != ";":
                raise ValueError("a semicolon is missing")
            k += 1

        types: dict[str, dict] = {}
        try:
            root = {"kind": "root", "items": [], "props": {}, "defaults": {}}
            while k < len(tokens):
                t, line = tokens[k]
                if t in ("addrmap", "regfile", "reg", "field"):
                    name = tokens[k + 1][0] if tokens[k + 1][0] != "{" else None
                    k += 2 if name is None else 3
                    inner = block(t, name, {})
                    k += 1
                    types[name or f"#{k}"] = inner
                    instances(inner, root)
                elif t == ";":
                    k += 1
                else:
                    out.append(problem("OC1102", f"{t} is not read", path, line, "*"))
                    k += 1
                    skip()
            top = options.get("top")
            maps = [(i["name"], i["of"]) for i in root["items"] if i["of"]["kind"] == "addrmap"] or [(n, d) for n, d in types.items() if d["kind"] == "addrmap" and not n.startswith("#")][-1:]
            for name, d in maps:
                if top and name != top:
                    continue
                component = options.get("component_name") or name
                yield "components", {"native_name": component, "ordinal": 0, "source": path, "line": 1, "column": 1}
                yield from _rdl(d, component, name, [], 0, number, [0])
        except (ValueError, IndexError, StopIteration) as e:
            out.append(problem("OC1101", str(e) or "the file ends too soon", path, tokens[min(k, len(tokens) - 1)][1] if tokens else 0, "*"))
        yield from out


def _rdl(d: dict, component: str, mmap: str, files: list[str], base: int, number, order: list[int]):
    at = base
    for item in d["items"]:
        inner = item["of"]
        if inner["kind"] not in ("reg", "regfile", "addrmap"):
            continue
        width = number(inner["props"].get("regwidth", inner["defaults"].get("regwidth", "32")))
        count = number(item["range"]) if item.get("range", "").isdigit() else 1
        at = base + number(item["@"]) if "@" in item else at
        stride = number(item["+="]) if "+=" in item else width // 8
        for n in range(count):
            name = item["name"] + (f"[{n}]" if "range" in item else "")
            if inner["kind"] == "reg":
                fields, low = [], 0
                for x in inner["items"]:
                    r = x.get("range", "1")
                    hi, lo = (number(r.split(":")[0]), number(r.split(":")[1])) if ":" in r else (low + number(r) - 1, low)
                    low = max(hi, lo) + 1
                    sw = x["of"]["props"].get("sw", x["of"]["defaults"].get("sw", "rw"))
                    reset = x.get("=") or x["of"]["props"].get("reset")
                    fields.append({"name": x["name"], "bit_offset": min(hi, lo), "bit_width": abs(hi - lo) + 1, "access": {"r": "read-only", "w": "write-only", "rw": "read-write"}.get(sw, sw), "reset": number(reset) if reset else None, "status": "known"})
                yield "registers", {"native_name": name, "component": component, "memory_map": mmap, "address_block": None, "register_files": files, "address_offset": at, "absolute_address": None, "size_bits": width, "access": None, "ordinal": order[0], "fields": fields}
                order[0] += 1
            else:
                yield from _rdl(inner, component, mmap, [*files, name], at, number, order)
            at += stride


def _evaluated(bodies: dict[str, str]) -> tuple[dict[str, int], list[str]]:
    """The values of macros and the names of those without one.

    A macro waits for the first name that it lacks and is tried again once that has a value. Values come by level
    (one more than the highest macro that is used), then in the order of the macros.
    """
    values: dict[str, int] = {}
    level: dict[str, int] = {}
    lacking: dict[str, list[str]] = {}
    for first in bodies:
        todo = [first]
        while todo:
            name = todo.pop()
            try:
                values[name] = integer(bodies[name], values)
            except Unknown as e:
                lacking.setdefault(e.name, []).append(name)
                continue
            except Expression:
                continue
            level[name] = 1 + max((level[n] for n in re.findall(r"[A-Za-z_]\w*", bodies[name]) if n in level), default=0)
            todo += lacking.pop(name, [])
    place = {n: k for k, n in enumerate(bodies)}
    return dict(sorted(values.items(), key=lambda x: (level[x[0]], place[x[0]]))), [n for n in bodies if n not in values]


def parse_header(files, view, kind, options):
    """Macros X_OFFSET or X_ADDR give registers, REG_FIELD_MASK, _SHIFT, _POS and _WIDTH their fields."""
    component = options.get("component_name", "")
    prefix = options.get("macro_prefix", f"{component.upper()}_" if component else "")
    macros: dict[str, tuple[str, str, int]] = {}
    for path, data in files:
        body = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text(data).replace("\\\n", "  "), flags=re.S)
        for n, raw in enumerate(body.split("\n"), 1):
            m = re.match(r"\s*#\s*define\s+(\w+)(\()?\s*(.*)", raw.split("//", 1)[0])
            if m and not m[2] and m[3].strip():
                if m[1] in macros and macros[m[1]][0].strip() != m[3].strip():
                    yield problem("OC1101", f"{m[1]} is defined twice", path, n, m[1])
                macros[m[1]] = (m[3], path, n)
    values, waiting = _evaluated({n: body for n, (body, _, _) in macros.items()})
    bare = {n.removeprefix(prefix): v for n, v in values.items() if n.startswith(prefix)}
    regs = {}
    for n, v in bare.items():
        m = re.fullmatch(r"(\w+?)_(OFFSET|OFS|ADDR|ADDRESS)", n)
        if m:
            regs.setdefault(m[1], {})["absolute_address" if m[2].startswith("ADDR") else "address_offset"] = v
    if component:
        yield "components", {"native_name": component, "ordinal": 0}
    for n in waiting:
        body, path, line = macros[n]
        if n.startswith(prefix) and re.search(r"_(OFFSET|OFS|ADDR|ADDRESS|MASK|SHIFT|POS|WIDTH)$", n):
            yield problem("OC1103", f"{n} can't be evaluated: {body}", path, line, n)
    fields_of: dict[str, dict[str, dict]] = {}
    for n, v in bare.items():
        # A field's macro belongs to the longest register that its name begins with.
        owner = next((n[:i] for i in range(len(n) - 1, 0, -1) if n[i] == "_" and n[:i] in regs), None)
        m = owner and re.fullmatch(r"(\w+?)_(MASK|SHIFT|POS|LSB|WIDTH)", n[len(owner) + 1 :])
        if m:
            fields_of.setdefault(owner, {}).setdefault(m[1], {})[m[2]] = v
    for k, (r, where) in enumerate(regs.items()):
        fields = fields_of.get(r, {})
        made = []
        for f, x in fields.items():
            low = x.get("SHIFT", x.get("POS", x.get("LSB")))
            mask = x.get("MASK")
            if mask and low is None:
                low = (mask & -mask).bit_length() - 1
            width = x.get("WIDTH") or ((mask >> low if low and mask & ((1 << low) - 1) == 0 and mask >> low else mask).bit_length() if mask else None)
            made.append({"name": f, "bit_offset": low, "bit_width": width, "access": None, "reset": None, "status": "known"})
        yield "registers", {"native_name": r, "component": component, "memory_map": None, "address_block": None, "register_files": [], "size_bits": options.get("default_register_width"), "access": None, "ordinal": k, "fields": made or None, **where}
