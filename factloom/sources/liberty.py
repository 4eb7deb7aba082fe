"""Liberty libraries: cells, pins, buses, power pins, functions.

A large file is parsed in pieces that begin with a cell (``pieces.py``): a scan of each tells whether it ends between two
statements of a library, and what later or earlier cells need of it.
"""

from __future__ import annotations

import re

from .reader import problem, text

TOKEN = re.compile(r'\s+|/\*.*?\*/|//[^\n]*|\\\r?\n|"((?:[^"\\]|\\.)*)"|([{}();:,])|([^\s{}();:,"]+)', re.S)
#: Lines before which a file may be cut, if the scan confirms it.
CUT = re.compile(rb"^[ \t]*cell[ \t]*\(", re.M)


class Group:
    __slots__ = ("kind", "args", "line", "values", "groups")

    def __init__(self, kind: str, args: list[str], line: int):
        self.kind, self.args, self.line, self.values, self.groups = kind, args, line, {}, []

    def named(self, *kinds: str) -> list[Group]:
        return [g for g in self.groups if g.kind in kinds]

    def get(self, name: str) -> str | None:
        v = self.values.get(name)
        return v[0] if v else None


def groups(source: str, path: str, problems: list, line: int = 1, within: Group | None = None, last: bool = True) -> tuple[Group, Group | None]:
    """The groups and attributes of a file, or of a piece of it that begins on a line and within a library; a broken statement is skipped to its end.

    Also the library that is open where a piece ends, if it ends between two of its statements.
    """
    unfinished = False

    def scanned():
        nonlocal unfinished
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() != at:
                break
            at = m.end()
            k = m.lastindex
            if k:
                unfinished = unfinished or (k == 3 and m[3].startswith("/*"))  # a comment that may be closed in a later piece
                yield m[2] if k == 2 else "w", m[k], m.start()
        if at < len(source):
            unfinished = True
            problems.append(problem("OC1101", "a string is not closed", path, line_of(at), "*"))

    counted, lines = 0, line

    def line_of(at: int) -> int:
        nonlocal counted, lines
        if at < counted:  # the token before the last one read
            return lines - source.count("\n", at, counted)
        lines += source.count("\n", counted, at)
        counted = at
        return lines

    # Tokens are read as they are needed: a large file's would not fit.
    tokens, end = scanned(), ("", "", 0)
    token, following = next(tokens, end), next(tokens, end)
    root = Group("", [], 1)
    stack = [root]
    if within is not None:
        root.groups.append(within)
        stack.append(within)
    while token is not end:
        kind, value, at = token
        if kind == "w" and following[0] == ":":
            token, following = next(tokens, end), next(tokens, end)
            parts = []
            while token is not end and token[0] not in (";", "}"):
                parts.append(token[1])
                token, following = following, next(tokens, end)
            stack[-1].values[value] = [" ".join(parts)]
            unfinished = unfinished or token is end
            if token[0] == ";":
                token, following = following, next(tokens, end)
        elif kind == "w" and following[0] == "(":
            token, following = next(tokens, end), next(tokens, end)
            args = []
            while token is not end and token[0] != ")":
                if token[0] == "w":
                    args.append(token[1])
                token, following = following, next(tokens, end)
            unfinished = unfinished or token is end
            token, following = following, next(tokens, end)
            if token[0] == "{":
                g = Group(value, args, line_of(at))
                stack[-1].groups.append(g)
                stack.append(g)
                token, following = following, next(tokens, end)
            else:
                stack[-1].values[value] = args
                if token[0] == ";":
                    token, following = following, next(tokens, end)
        else:
            if kind == "}":
                if len(stack) == 1:
                    problems.append(problem("OC1101", "a brace is not opened", path, line_of(at), "*"))
                else:
                    stack.pop()
            elif kind != ";":
                problems.append(problem("OC1101", f"unexpected {value}", path, line_of(at), "*"))
            token, following = following, next(tokens, end)
    if last and len(stack) > 1:
        problems.append(problem("OC1101", f"group {stack[-1].kind} is not closed", path, stack[-1].line, stack[-1].args[0] if stack[-1].args else "*"))
    return root, stack[1] if len(stack) == 2 and stack[1].kind == "library" and not unfinished else None


def types_of(group: Group) -> dict[str, list[str | None]]:
    """The first and last bit of each type, as they are written."""
    return {t.args[0]: [t.get("bit_from"), t.get("bit_to")] for t in group.named("type") if t.args}


def scan_piece(source: str, line: int, first: bool, last: bool) -> dict | None:
    """What other pieces need to know of a piece: cells and types of its libraries, and which one goes on. None if the file can't be cut behind it."""
    within = None if first else Group("library", [], 0)
    root, going_on = groups(source, "", [], line, within, last)
    if going_on is None and not last:
        return None
    libraries = [[sum(bool(c.args) for c in g.named("cell")), types_of(g)] for g in root.named("library")]
    # The library that goes on is the last one of the piece.
    return {"libraries": libraries, "open": None if going_on is None or going_on is within else [going_on.args, going_on.line]}


def join_pieces(scans: list[dict]) -> list[dict]:
    """The state in which each piece begins, from the scans of a file's pieces in order.

    Types hold in their whole library, the later one of the same name; each library's are one object.
    """
    states, seen, opened, types, cells = [], [], None, {}, 0
    for k, s in enumerate(scans):
        states.append(None if k == 0 else {"args": opened[0], "line": opened[1], "cells": cells})
        held = []
        for j, (n, found) in enumerate(s["libraries"]):
            if k == 0 or j > 0:
                types, cells = {}, 0
            types.update(found)
            cells += n
            held.append(types)
        seen.append(held)
        if s["open"]:
            opened = s["open"]
    return [{"entry": e, "types": t} for e, t in zip(states, seen, strict=True)]


def parse_piece(source: str, path: str, line: int, state: dict, last: bool):
    """The rows of a piece, as if the whole file were parsed."""
    entry, problems = state["entry"], []
    root, _ = groups(source, path, problems, line, None if entry is None else Group("library", entry["args"], entry["line"]), last)
    for j, (library, types) in enumerate(zip(root.named("library"), state["types"], strict=True)):
        yield from rows_of(library, types, entry["cells"] if entry and j == 0 else 0, path, problems)
    yield from problems


def parse_liberty(files, view, kind, options):
    problems: list = []
    for path, data in files:
        root, _ = groups(text(data), path, problems)
        for library in root.named("library"):
            yield from rows_of(library, types_of(library), 0, path, problems)
    yield from problems


def rows_of(library: Group, types: dict, first: int, path: str, problems: list):
    """The rows of a library's cells, counted from a number on."""
    for n, cell in enumerate((c for c in library.named("cell") if c.args), first):
        name = cell.args[0]
        yield "components", {"native_name": name, "ordinal": n, "source": path, "line": cell.line, "column": 1}
        for pin in cell.named("pin", "pg_pin", "bus", "bundle"):
            for p in pin.args:
                m = re.fullmatch(r"(.+)\[(-?\d+)(?::(-?\d+))?\]", p)
                left = right = None
                width: int | None = 1
                if pin.kind == "bus":
                    t = types.get(pin.get("bus_type") or "") or next(([x.get("bit_from"), x.get("bit_to")] for x in cell.named("type") if x.args[:1] == [pin.get("bus_type")]), None)
                    if t and all((b or "").lstrip("-").isdigit() for b in t):
                        left, right = int(t[0]), int(t[1])
                        width = abs(left - right) + 1
                    else:
                        width = None
                        problems.append(problem("OC1103", f"the type of bus {p} is not known", path, pin.line, name))
                elif pin.kind == "bundle":
                    width = len(pin.values.get("members", [])) or None
                elif m and m[3]:
                    left, right = int(m[2]), int(m[3])
                    width = abs(left - right) + 1
                power = pin.get("pg_type")
                yield "ports", {
                    "component": name, "native_name": m[1] if m and m[3] else p, "ordinal": pin.line, "direction": pin.get("direction") or ("inout" if pin.kind == "pg_pin" else None), "role": power or ("clock" if pin.get("clock") == "true" else None),
                    "width": width, "left": left, "right": right, "packed": [{"left": left, "right": right}] if left is not None else [], "explicit_scalar": pin.kind in ("pin", "pg_pin") and left is None, "bit_order_known": True, "source": path, "line": pin.line, "column": 1,
                }
                if pin.get("function"):
                    yield "functions", {"component": name, "output": p, "expression": pin.get("function")}
