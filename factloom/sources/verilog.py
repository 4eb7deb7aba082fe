"""A bounded structural subset of Verilog: ANSI and non-ANSI ports, instances, gates, aliases, assigns of names and inversions.

Parameters are integers, and whatever else a module has (processes, generate, functions, arrays) taints its
scope instead of being guessed. The graph is that of whole hierarchies: from every module that no other one
instantiates, ports of instances are joined to what they are connected with, bit by bit. Where that is not
known (unknown cells, expressions, gates) the edges are tainted, never left out.
"""

from __future__ import annotations

import re

from .reader import problem, text
from .registers import Expression, integer

KEYWORDS = frozenset("always always_comb always_ff always_latch initial generate function task for if case begin specify primitive table".split())
# Primitives by what they do to their terminals.
GATES = frozenset("and nand or nor xor xnor bufif0 bufif1 notif0 notif1 nmos pmos cmos rnmos rpmos rcmos pullup pulldown".split())
TRANS = frozenset("tran rtran tranif0 tranif1 rtranif0 rtranif1".split())
#: Edges and endpoints of one view at most; beyond them the view is refused, not cut.
MOST_EDGES = 4_000_000
NAME = r"(?:\\\S+\s|[A-Za-z_][\w$]*)"


def _range(s: str | None, names: dict[str, int]):
    if not s:
        return None, None
    left, right = s.split(":")
    return integer(left, names), integer(right, names)


GATE = rf"(?:^|;)\s*({'|'.join(sorted(GATES | TRANS | {'buf', 'not'}, key=len, reverse=True))})\b\s*(?:#\s*(?:\d+|\([^()]*\))\s*)?(?:{NAME}\s*)?\(([^()]*)\)\s*(?=;)"
#: Cell, parameters, name, connections.
INSTANCE = rf"(?:^|;|\bend\b)\s*({NAME})\s*(?:\s|(#\s*\((?:[^()]|\([^()]*\))*\)))\s*({NAME})\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)\s*(?=;)"


def parse_verilog(files, view, kind, options):
    defines = options.get("defines", {})
    modules: dict[str, Module] = {}
    for path, data in files:
        source = re.sub(r"/\*.*?\*/|//[^\n]*|\(\*.*?\*\)", lambda m: "\n" * m[0].count("\n"), text(data), flags=re.S)
        source = re.sub(r"`(\w+)", lambda m: str(defines.get(m[1], m[0])), source)
        if re.search(r"^\s*`(?!timescale|default_nettype|resetall|celldefine|endcelldefine)", source, re.M):
            yield problem("OC1102", "preprocessor lines are not read", path, 1, "*")
        ends = 0
        for m in re.finditer(rf"\bmodule\s+({NAME})(.*?)\bendmodule\b", source, re.S):
            ends = m.end()
            yield from _module(m[1].strip(), m[2], path, source.count("\n", 0, m.start()) + 1, options, modules)
        if re.search(r"\bmodule\b", source[ends:]):
            yield problem("OC1101", "a module is not closed", path, source.count("\n", 0, ends) + 1, "*")
    yield from _graph(modules)


class Module:
    """What the graph needs of a module: ports in order, widths of nets, edges between bits of nets, instances."""

    def __init__(self):
        self.ports: dict[str, str] = {}
        self.widths: dict[str, tuple] = {}
        self.edges: list[tuple[str, str, str, bool | None]] = []
        #: (cell, instance, [(port name or place, its bits, whether they are what is connected)], parameters given: None if not known); a bit is None where there is no net.
        self.instances: list[tuple[str, str, list, dict | None]] = []
        #: The values of its parameters, by which its widths are read.
        self.defaults: dict[str, int] = {}
        #: Whether it has anything that no pattern has read: its nets may have edges that are not here.
        self.unread = False

    def bits(self, net: str) -> list[str]:
        left, right = self.widths[net]
        if left is None:
            return [net]
        return [f"{net}[{k}]" for k in (range(left, right - 1, -1) if left >= right else range(left, right + 1))]


def _graph(modules: dict[str, Module]):
    """Endpoints and edges below every top module, named by the path of instances."""
    used = {cell for m in modules.values() for cell, *_ in m.instances}
    work = [(name, name, (name,)) for name in modules if name not in used] or [(name, name, (name,)) for name in modules]
    made = 0
    while work:
        at, name, above = work.pop()
        m = modules[name]
        if m.unread:
            yield problem("OC1102", f"parts of {at} are not read", "", 0, at)
        edge = lambda a, b, kind, inverted, sure=True: ("edges", {"source": a, "sink": b, "edge_kind": kind, "inverted": inverted, "status": "known" if sure else "tainted"})
        for n, (left, _) in m.widths.items():
            keys = m.bits(n)
            made += len(keys)
            for k, key in enumerate(keys):
                yield "endpoints", {"native_name": f"{at}/{n}", "bit_index": None if left is None else int(key[:-1].rsplit("[", 1)[1]), "ordinal": k, "width": len(keys)}
        for a, b, kind, inverted in m.edges:
            yield edge(f"{at}/{a}", f"{at}/{b}", kind, inverted, inverted is not None)
        made += len(m.edges)
        for cell, inst, wiring, given in m.instances:
            below = modules.get(cell)
            if below is None or cell in above:
                # An unknown cell may join anything that is connected with it.
                for _, bits, _ in wiring:
                    for x in filter(None, bits):
                        yield edge(f"{at}/{x}", f"{at}/{inst}", "cell", None, False)
                        yield edge(f"{at}/{inst}", f"{at}/{x}", "cell", None, False)
                continue
            work.append((f"{at}/{inst}", cell, (*above, cell)))
            order = list(below.ports)
            # Other parameters than the module's own may change its widths.
            same = given is not None and all(below.defaults.get(k) == v for k, v in given.items())
            for port, bits, plain in wiring:
                port = order[port] if isinstance(port, int) and port < len(order) else port
                if port not in below.ports:
                    yield problem("OC1102", f"{inst} connects {port}, which {cell} does not have", "", 0, above[0])
                    continue
                own = [f"{at}/{inst}/{x}" for x in below.bits(port)] if port in below.widths else []
                sure = plain and same and len(own) == len(bits)
                pairs = zip([f"{at}/{x}" if x else None for x in bits], own, strict=True) if sure else [(f"{at}/{x}", y) for x in bits if x for y in own]
                for x, y in pairs:
                    if x and below.ports[port] in ("input", "inout"):
                        yield edge(x, y, "port", False if sure else None, sure)
                    if x and below.ports[port] in ("output", "inout"):
                        yield edge(y, x, "port", False if sure else None, sure)
                made += len(own)
        if made > MOST_EDGES:
            raise ValueError(f"the hierarchy has more than {MOST_EDGES} bits and edges")


def _module(name: str, body: str, path: str, line: int, options: dict, modules: dict[str, Module]):
    own = modules[name] = Module()
    names: dict[str, int] = dict(options.get("parameters", {}))
    for p, v in re.findall(r"\b(?:parameter|localparam)\s+(?:integer\s+|int\s+|\[[^\]]*\]\s*)?(\w+)\s*=\s*([^,;)]+)", body):
        try:
            names.setdefault(p, integer(v, names))
        except Expression:
            pass
    own.defaults = names
    yield "components", {"native_name": name, "ordinal": line, "source": path, "line": line, "column": 1}
    head, _, rest = body.partition(";")
    ports: dict[str, dict] = {}
    unread = False
    header = re.sub(r"#\s*\((?:[^()]|\([^()]*\))*\)", "", head, count=1).strip()
    direction = span = None
    listed = header[1:-1] if header.startswith("(") else ""
    for item in (x.strip() for x in listed.split(",")):
        m = re.fullmatch(rf"(input|output|inout)?\s*(?:wire|reg|logic|tri|var)?\s*(?:signed)?\s*(?:\[([^\]]+)\])?\s*({NAME})\s*", item + " ")
        if m:
            direction, span = (m[1], m[2]) if m[1] else (direction, m[2] or span)
            ports[m[3].strip()] = {"direction": direction, "span": span}
        elif item:
            unread = True
    # A net's own assignment and several assignments in one statement are assignments.
    rest = re.sub(rf"\b((?:wire|tri)\b[^=;(]*?)({NAME})\s*=([^;,]+);", r"\1\2; assign \2 =\3;", rest)
    rest = re.sub(r"\bassign\b([^;]*);", lambda m: " ".join(f"assign {x};" for x in _split(m[1])), rest)
    for d, s, listing in re.findall(rf"\b(input|output|inout)\s+(?:wire|reg|logic)?\s*(?:signed)?\s*(?:\[([^\]]+)\])?\s*({NAME}(?:\s*,\s*{NAME})*)\s*;", rest):
        for n in listing.split(","):
            ports[n.strip()] = {"direction": d, "span": s}
    widths: dict[str, tuple] = {}
    for k, (n, p) in enumerate(ports.items()):
        try:
            left, right = _range(p["span"], names)
        except (Expression, ValueError):
            yield problem("OC1103", f"the width of {n} can't be evaluated", path, line, name)
            unread = True
            yield "ports", {"component": name, "native_name": n, "ordinal": k, "direction": p["direction"], "width": None, "source": path, "line": line, "column": 1}
            continue
        widths[n] = (left, right)
        yield "ports", {"component": name, "native_name": n, "ordinal": k, "direction": p["direction"], "width": 1 if left is None else abs(left - right) + 1, "left": left, "right": right, "packed": [] if left is None else [{"left": left, "right": right}], "explicit_scalar": left is None, "bit_order_known": True, "source": path, "line": line, "column": 1}
    for s, listing in re.findall(rf"\b(?:wire|logic|tri)\s*(?:signed)?\s*(?:\[([^\]]+)\])?\s*({NAME}(?:\s*,\s*{NAME})*)\s*;", rest):
        for n in listing.split(","):
            yield "objects", {"object_kind": "net", "relation": "definition", "native_name": n.strip(), "scope": name, "ordinal": line}
            try:
                widths[n.strip()] = _range(s, names)
            except (Expression, ValueError):
                unread = True

    own.ports, own.widths = {n: p["direction"] for n, p in ports.items()}, widths

    def bits(selector: str) -> list[str | None]:
        """Bits of a name, a bit or a part of it or several joined, most significant first; None for bits of constants."""
        selector = selector.strip()
        if selector.startswith("{") and selector.endswith("}"):
            return [x for part in _split(selector[1:-1]) for x in bits(part)]
        constant = re.fullmatch(r"(\d+)\s*'\s*s?[bodhBODH][\da-fA-FxXzZ_?]+", selector)
        if constant:
            return [None] * int(constant[1])
        m = re.fullmatch(rf"({NAME})\s*(?:\[\s*([^\]:]+?)\s*(?::\s*([^\]]+?)\s*)?\])?", selector + (" " if selector.startswith("\\") else ""))
        if not m or m[1].strip() not in widths:
            raise ValueError(selector)
        base, (left, right) = m[1].strip(), widths[m[1].strip()]
        if m[2]:
            left, right = integer(m[2], names), integer(m[3] or m[2], names)
        if left is None:
            return [base]
        return [f"{base}[{k}]" for k in (range(left, right - 1, -1) if left >= right else range(left, right + 1))]

    def known_bits(expression: str) -> list[str]:
        """All bits of all nets that an expression names."""
        return [x for n in dict.fromkeys(re.findall(NAME, expression)) if n.strip() in widths for x in own.bits(n.strip())]

    for target, expression in re.findall(r"\bassign\s+([^=;]+?)\s*=\s*([^;]+?)\s*;", rest):
        inverted = expression.startswith(("~", "!"))
        operand = expression[1:].strip() if inverted else expression
        while operand.startswith("(") and operand.endswith(")") and "(" not in operand[1:-1]:
            operand = operand[1:-1].strip()
        try:
            b = bits(target)
        except (Expression, ValueError):
            b = known_bits(target)
        try:
            a = bits(operand)
        except (Expression, ValueError):
            a = None
        if a and b and len(a) == len(b) and not (expression.startswith("!") and len(a) > 1):
            own.edges += [(x, y, "assign", inverted) for x, y in zip(a, b, strict=True) if x and y]
            continue
        scalar = re.fullmatch(r"[\w\s~!&|^()]+", expression)
        if scalar and b and len(b) == 1 and not re.search(r"&&|\|\|", expression):
            yield "functions", {"component": name, "output": target.strip(), "expression": expression}
        own.edges += [(x, y, "expression", None) for x in known_bits(expression) for y in b if y]
    for names_of in re.findall(r"\balias\s+([^;]+);", rest):
        sides = [s.strip() for s in names_of.split("=")]
        try:
            listed = [bits(x) for x in sides]
        except (Expression, ValueError):
            listed = []
        if listed and len({len(x) for x in listed}) == 1:
            own.edges += [(x, y, "alias", False) for one in listed for two in listed if one is not two for x, y in zip(one, two, strict=True) if x and y]
        else:
            own.edges += [(x, y, "alias", None) for one in sides for two in sides if one is not two for x in known_bits(one) for y in known_bits(two)]
    for gate, terminals in re.findall(GATE, rest):
        pins = _split(terminals)
        try:
            at = [bits(x) for x in pins]
        except (Expression, ValueError):
            at = [known_bits(x) for x in pins]
        ends = [[x for x in one if x] for one in at]
        if gate in ("buf", "not"):
            own.edges += [(x, y, gate, gate == "not") for one in ends[:-1] for x in ends[-1] for y in one]
        elif gate in TRANS:
            sure = gate in ("tran", "rtran")
            own.edges += [(x, y, gate, False if sure else None) for one, two in ((ends[0], ends[1]), (ends[1], ends[0])) for x in one for y in two] if len(ends) > 1 else []
        else:
            own.edges += [(x, y, gate, None) for one in ends[1:] for x in one for y in ends[0]]
    found = re.findall(INSTANCE, rest)
    for _, _, _, wiring in found:  # a name that nothing declares is a net of one bit
        for net in re.findall(rf"\(\s*({NAME})\s*\)", wiring) if "." in wiring else _split(wiring):
            if re.fullmatch(NAME, net.strip()) and net.strip() not in ports:
                widths.setdefault(net.strip(), (None, None))
    for cell, parameters, inst, wiring in found:
        cell, inst = cell.strip(), inst.strip()
        if cell in ("assign", "module", "alias", *KEYWORDS, *GATES, *TRANS, "buf", "not"):
            continue
        yield "objects", {"object_kind": "instance", "relation": "definition", "native_name": inst, "scope": name, "ordinal": line}
        pins = []
        named = re.findall(rf"\.\s*({NAME})\s*\(((?:[^()]|\([^()]*\))*)\)", wiring)
        unread = unread or bool(re.search(r"\.\s*\*", wiring))
        for pin, net in named or list(enumerate(_split(wiring))):
            if named:
                yield "objects", {"object_kind": "pin", "relation": "definition", "native_name": f"{inst}/{pin.strip()}", "scope": name, "ordinal": line}
            if net.strip():
                try:
                    pins.append((pin.strip() if named else pin, bits(net), True))
                except (Expression, ValueError):
                    pins.append((pin.strip() if named else pin, known_bits(net), False))
        given: dict | None = {}
        if parameters.strip():
            listed = re.findall(r"\.\s*(\w+)\s*\(([^()]*)\)", parameters)
            try:
                given = {p: integer(v, names) for p, v in listed} if listed else None
            except Expression:
                given = None
        own.instances.append((cell, inst, pins, given))
    # Whatever is left when all that has been read is taken out has not been read.
    left = rest
    for pattern in (r"\bassign\s+[^=;]+?\s*=\s*[^;]+?\s*;", r"\balias\s+[^;]+;", rf"\b(?:input|output|inout)\b[^;=]*;", rf"\b(?:wire|logic|tri)\s*(?:signed)?\s*(?:\[[^\]]+\])?\s*{NAME}(?:\s*,\s*{NAME})*\s*;", r"\b(?:parameter|localparam)\b[^;]*;", GATE, INSTANCE):
        left = re.sub(pattern, ";", left)
    own.unread = unread = unread or bool(re.search(r"[^\s;]", left)) or bool(KEYWORDS & set(re.findall(r"\b[a-z_]+\b", rest)))
    if unread:
        yield problem("OC1102", f"parts of {name} are not read", path, line, name)


def _split(listing: str) -> list[str]:
    """Parts between the commas that are not inside brackets."""
    out, depth = [""], 0
    for c in listing:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
