"""SDC constraints and UPF power intent: the static part of their Tcl.

Words, braces, quotes, ``set``/``unset``/``list`` and the listed commands are read. Anything else (loops,
conditions, procedures, unknown variables) is told and never executed; the scope it stands in is tainted.
"""

from __future__ import annotations

import re

from .reader import problem, text

GETTERS = {"get_ports": "port", "get_pins": "pin", "get_cells": "instance", "get_clocks": "clock", "get_nets": "net"}


class Unsupported(ValueError):
    """Tcl that isn't static, or a command that isn't listed."""


class Syntax(ValueError):
    """Text that is no Tcl."""


def commands(source: str):
    """(line, words) of each command; a word is (text, braced)."""
    at, line, words, n = 0, 1, [], len(source)
    begun = 1
    while at < n:
        c = source[at]
        if c in "\n;":
            if words:
                yield begun, words
            words = []
            line += c == "\n"
            at += 1
        elif c in " \t\r" or source.startswith("\\\n", at):
            line += source.startswith("\\\n", at)
            at += 2 if c == "\\" else 1
        elif c == "#" and not words:
            end = source.find("\n", at)
            at = n if end < 0 else end
        else:
            if not words:
                begun = line
            if c in "{[":
                depth, start = 0, at
                close = {"{": "}", "[": "]"}[c]
                while at < n:
                    depth += (source[at] == c) - (source[at] == close)
                    line += source[at] == "\n"
                    at += 1
                    if not depth:
                        break
                if depth:
                    raise Syntax(f"line {begun}: a {c} is not closed")
                words.append((source[start + 1 : at - 1], c))
            elif c == '"':
                end = at + 1
                while end < n and source[end] != '"':
                    end += 2 if source[end] == "\\" else 1
                if end >= n:
                    raise Syntax(f"line {begun}: a quote is not closed")
                words.append((source[at + 1 : end], '"'))
                at = end + 1
            else:
                m = re.compile(r"(?:\\.|\$\{[^}]*\}|[^\s;\[\"{]|\[[^\]\s]*\])+").match(source, at)
                end = m.end() if m else at + 1
                words.append((source[at:end], ""))
                at = end
    if words:
        yield begun, words


class Tcl:
    def __init__(self):
        self.variables: dict[str, list[str]] = {}
        self.found: list[tuple[str, str, dict]] = []

    def words(self, word: tuple[str, str]) -> list[str]:
        """A word's value as a list; queries become references."""
        value, quote = word
        if quote == "[":
            inner = next(commands(value), None)
            return self.call(inner[1]) if inner else []
        if quote == "{":
            return value.split() if " " in value.strip() or not value.strip() else [value.strip()]
        if "$" in value:
            whole = re.fullmatch(r"\$\{?([\w:]+)\}?", value)
            if whole:
                if whole[1] not in self.variables:
                    raise Unsupported(f"variable {whole[1]} is not known")
                return self.variables[whole[1]]

            def one(m):
                v = self.variables.get(m[1] or m[2])
                if v is None:
                    raise Unsupported(f"variable {m[1] or m[2]} is not known")
                return " ".join(v)

            value = re.sub(r"\$(?:\{([\w:]+)\}|([\w:]+))", one, value)
        if "[" in value and quote == '"':
            raise Unsupported("a command inside a string")
        return value.split() if quote == '"' else [re.sub(r"\\(.)", r"\1", value)]

    def call(self, words: list[tuple[str, str]]) -> list[str]:
        name = words[0][0]
        if name == "list":
            return [x for w in words[1:] for x in self.words(w)]
        if name in GETTERS:
            options, patterns = [], []
            for w in words[1:]:
                if w[0].startswith("-") and not w[1]:
                    if w[0] in ("-filter", "-of_objects"):
                        raise Unsupported(f"{w[0]} is dynamic")
                    options.append(w[0])
                else:
                    patterns += self.words(w)
            for p in patterns:
                self.found.append((GETTERS[name], p, {"match_mode": "regexp" if "-regexp" in options else "glob" if re.search(r"[*?]", p) else None, "nocase": "-nocase" in options}))
            return patterns
        raise Unsupported(f"{name} is not read")


def parse_sdc(files, view, kind, options):
    tcl = Tcl()
    ordinal = 0
    for path, data in files:
        try:
            listed = list(commands(text(data)))
        except ValueError as e:
            yield problem("OC1101", str(e), path, 0, "*")
            continue
        for line, words in listed:
            name = words[0][0]
            tcl.found = []
            try:
                if name == "set" and len(words) == 3:
                    tcl.variables[words[1][0]] = tcl.words(words[2])
                elif name == "unset":
                    for w in words[1:]:
                        tcl.variables.pop(w[0], None)
                elif name in ("create_clock", "create_generated_clock"):
                    flags, targets, k = {}, [], 1
                    while k < len(words):
                        if words[k][0].startswith("-") and not words[k][1]:
                            if words[k][0] in ("-add", "-invert", "-combinational"):
                                k += 1
                                continue
                            flags[words[k][0]] = tcl.words(words[k + 1]) if k + 1 < len(words) else []
                            k += 2
                        else:
                            targets += tcl.words(words[k])
                            k += 1
                    clock = " ".join(flags.get("-name", targets[:1]))
                    if not clock:
                        raise Unsupported("a clock without a name")
                    number = lambda x: float(x) if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+", x) else None
                    period = number(flags["-period"][0]) if flags.get("-period") else None
                    if "-period" in flags and (period is None or period <= 0):
                        raise ValueError("a period is no positive number")
                    yield "clocks", {"native_name": clock, "targets": targets, "period": period, "waveform": [number(x) for x in flags["-waveform"]] if "-waveform" in flags else None, "source": " ".join(flags.get("-source", [])) or None, "generated": name == "create_generated_clock"}
                elif name in ("set_input_delay", "set_output_delay", "set_false_path", "set_multicycle_path", "set_clock_groups", "set_clock_uncertainty"):
                    for w in words[1:]:
                        if w[1] == "[":
                            tcl.words(w)
                elif name in GETTERS:
                    tcl.call(words)
                elif name in ("current_design", "set_units"):
                    pass
                else:
                    raise Unsupported(f"{name} is not read")
            except Syntax as e:
                yield problem("OC1101", str(e), path, line, "*")
            except Unsupported as e:
                yield problem("OC1102", str(e), path, line, "")
            except ValueError as e:
                yield problem("OC1103", str(e), path, line, "")
            for object_kind, pattern, how in tcl.found:
                ordinal += 1
                yield "objects", {"object_kind": object_kind, "relation": "reference", "native_name": pattern, "ordinal": ordinal, **how}


# What each UPF command defines (if anything), and the options that name other objects.
UPF = {
    "create_power_domain": ("power_domain", {"-elements": "instance", "-supply": None}), "create_supply_port": ("supply_port", {"-domain": "power_domain"}), "create_supply_net": ("supply_net", {"-domain": "power_domain"}),
    "create_supply_set": ("supply_set", {}), "connect_supply_net": (None, {"-ports": "supply_port"}), "set_domain_supply_net": (None, {"-primary_power_net": "supply_net", "-primary_ground_net": "supply_net"}),
    "set_isolation": ("isolation", {"-domain": "power_domain", "-isolation_power_net": "supply_net", "-isolation_ground_net": "supply_net"}), "set_isolation_control": (None, {"-domain": "power_domain"}),
    "set_retention": ("retention", {"-domain": "power_domain"}), "set_retention_control": (None, {"-domain": "power_domain"}), "set_level_shifter": ("level_shifter", {"-domain": "power_domain"}),
    "create_power_switch": ("power_switch", {"-domain": "power_domain"}), "add_port_state": (None, {}), "add_power_state": (None, {}), "upf_version": (None, {}), "set_design_top": (None, {}), "set_scope": (None, {}),
}
FIRST_REFERS = {"connect_supply_net": "supply_net", "set_domain_supply_net": "power_domain", "add_port_state": "supply_port", "set_design_top": "instance"}


def parse_upf(files, view, kind, options):
    tcl, ordinal = Tcl(), 0
    for path, data in files:
        try:
            listed = list(commands(text(data)))
        except ValueError as e:
            yield problem("OC1101", str(e), path, 0, "*")
            continue
        for line, words in listed:
            name = words[0][0]
            try:
                if name == "set" and len(words) == 3:
                    tcl.variables[words[1][0]] = tcl.words(words[2])
                    continue
                if name not in UPF:
                    raise Unsupported(f"{name} is not read")
                defines, refers = UPF[name]
                flags, plain, k = {}, [], 1
                while k < len(words):
                    if words[k][0].startswith("-") and not words[k][1]:
                        value = k + 1 < len(words) and not (words[k + 1][0].startswith("-") and not words[k + 1][1])
                        flags.setdefault(words[k][0], []).extend(tcl.words(words[k + 1]) if value else [])
                        k += 1 + value
                    else:
                        plain += tcl.words(words[k])
                        k += 1
            except (Unsupported, Syntax) as e:
                yield problem("OC1102" if isinstance(e, Unsupported) else "OC1101", str(e), path, line, "*")
                continue
            ordinal += 1
            if defines and plain:
                yield "objects", {"object_kind": defines, "relation": "definition", "native_name": plain[0], "is_update": "-update" in flags, "ordinal": ordinal}
            elif name in FIRST_REFERS and plain:
                yield "objects", {"object_kind": FIRST_REFERS[name], "relation": "reference", "native_name": plain[0], "ordinal": ordinal}
            for flag, object_kind in refers.items():
                for x in flags.get(flag, []):
                    if object_kind and x != ".":
                        yield "objects", {"object_kind": object_kind, "relation": "reference", "native_name": x, "ordinal": ordinal}
