"""Sequential properties of small circuits: simulation, symbolic search, bounded answers.

A circuit is data: inputs and registers with widths, a list of nodes in topological order, and for each
register its next node and reset value. Traces are simulated in groups, one task each. A property is
decided by forward search over decision diagrams of the state bits: a fixpoint proves it, a bad state
gives the shortest counterexample, a bound or a node budget is said to be one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .formal import Diagram, TooLarge


@dataclass
class Circuit:
    """``nodes``: (name, operation, arguments, width); arguments are names or integers."""

    inputs: dict[str, int]
    registers: dict[str, tuple[int, int, str]]  # width, reset value, next node
    nodes: list[tuple[str, str, tuple, int]] = field(default_factory=list)

    def width(self, x) -> int:
        if isinstance(x, int):
            return max(1, x.bit_length())
        return self.inputs[x] if x in self.inputs else self.registers[x][0] if x in self.registers else next(n[3] for n in self.nodes if n[0] == x)


def step(c: Circuit, state: dict[str, int], inputs: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """All values of one cycle, and the next state."""
    v = {k: inputs.get(k, 0) & ((1 << w) - 1) for k, w in c.inputs.items()} | dict(state)
    for name, op, args, width in c.nodes:
        a = [x if isinstance(x, int) else v[x] for x in args]
        full = (1 << width) - 1
        v[name] = {
            "and": lambda a=a: a[0] & a[1], "or": lambda a=a: a[0] | a[1], "xor": lambda a=a: a[0] ^ a[1], "not": lambda a=a: ~a[0], "add": lambda a=a: a[0] + a[1], "sub": lambda a=a: a[0] - a[1], "mul": lambda a=a: a[0] * a[1],
            "eq": lambda a=a: int(a[0] == a[1]), "lt": lambda a=a: int(a[0] < a[1]), "mux": lambda a=a: a[1] if a[0] else a[2], "slice": lambda a=a, w=width: a[0] >> a[1], "concat": lambda a=a, args=args: (a[0] << c.width(args[1])) | a[1], "const": lambda a=a: a[0],
        }[op]() & full
    return v, {r: v[nxt] & ((1 << w) - 1) for r, (w, _, nxt) in c.registers.items()}


def simulate(frames: DataFrame, circuit: Circuit, trace: str, cycle: str, outputs: list[str]) -> DataFrame:
    """Values of ``outputs`` in every cycle of every trace, from reset; inputs are columns. Wide values are decimal strings."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = f"`{trace}` {kinds[trace]}, `{cycle}` {kinds[cycle]}, " + ", ".join(f"`{o}` {'long' if circuit.width(o) < 64 else 'string'}" for o in outputs)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        state = {r: reset for r, (_, reset, _) in circuit.registers.items()}
        out = []
        for r in df.sort_values(cycle).to_dict("records"):
            v, state = step(circuit, state, {k: int(r[k]) for k in circuit.inputs})
            out.append([r[trace], r[cycle], *[v[o] if circuit.width(o) < 64 else str(v[o]) for o in outputs]])
        return pd.DataFrame(out, columns=[trace, cycle, *outputs])

    return frames.select(trace, cycle, *circuit.inputs).groupBy(trace).applyInPandas(run, schema)


def cone(c: Circuit, roots: list[str]) -> Circuit:
    """The part of a circuit that the roots depend on, over any number of cycles."""
    of = {n[0]: n for n in c.nodes}
    need, work = set(), list(roots)
    while work:
        x = work.pop()
        if isinstance(x, int) or x in need:
            continue
        need.add(x)
        work += [*of[x][2]] if x in of else [c.registers[x][2]] if x in c.registers else []
    return Circuit({k: w for k, w in c.inputs.items() if k in need}, {k: r for k, r in c.registers.items() if k in need}, [n for n in c.nodes if n[0] in need])


class _Symbols:
    """A circuit's values as diagrams over state bits (even variables), next state bits (odd ones) and input bits (last)."""

    def __init__(self, c: Circuit, budget: int):
        self.c, self.d = c, Diagram(budget)
        self.bits = [(r, k) for r, (w, _, _) in c.registers.items() for k in range(w)]
        self.now = {b: 2 * k for k, b in enumerate(self.bits)}
        base = 2 * len(self.bits)
        self.free = {(i, k): base + n for n, (i, k) in enumerate((i, k) for i, w in c.inputs.items() for k in range(w))}
        v: dict[str, list[int]] = {i: [self.d.node(self.free[i, k], 0, 1) for k in range(w)] for i, w in c.inputs.items()}
        v |= {r: [self.d.node(self.now[r, k], 0, 1) for k in range(w)] for r, (w, _, _) in c.registers.items()}
        for name, op, args, width in c.nodes:
            a = [self.number(x, c.width(x)) if isinstance(x, int) else v[x] for x in args]
            v[name] = self.apply(op, a, args, width)
        self.v = v

    def number(self, x: int, width: int) -> list[int]:
        return [x >> k & 1 for k in range(width)]

    def apply(self, op: str, a: list[list[int]], args: tuple, width: int) -> list[int]:
        d = self.d
        inv = lambda f: d.ite(f, 0, 1)
        xor = lambda f, g: d.ite(f, inv(g), g)
        fit = lambda x, n: (x + [0] * n)[:n]
        if op in ("and", "or", "xor"):
            f = {"and": lambda p, q: d.ite(p, q, 0), "or": lambda p, q: d.ite(p, 1, q), "xor": xor}[op]
            return [f(p, q) for p, q in zip(fit(a[0], width), fit(a[1], width), strict=True)]
        if op == "not":
            return [inv(p) for p in fit(a[0], width)]
        if op in ("add", "sub"):
            carry, out = int(op == "sub"), []
            for p, q in zip(fit(a[0], width), fit(a[1], width), strict=True):
                q = inv(q) if op == "sub" else q
                out.append(xor(xor(p, q), carry))
                carry = d.ite(p, d.ite(q, 1, carry), d.ite(q, carry, 0))
            return out
        if op == "mul":
            out = [0] * width
            for k, q in enumerate(a[1][:width]):
                out = self.apply("add", [out, [0] * k + [d.ite(q, p, 0) for p in fit(a[0], width - k)]], (), width)
            return out
        if op in ("eq", "lt"):
            n = max(map(len, a))
            same, less = 1, 0
            for p, q in zip(fit(a[0], n), fit(a[1], n), strict=True):
                less = d.ite(xor(p, q), q, less)
                same = d.ite(same, inv(xor(p, q)), 0)
            return fit([same if op == "eq" else less], width)
        if op == "mux":
            s = 0
            for p in a[0]:
                s = d.ite(s, 1, p)
            return [d.ite(s, p, q) for p, q in zip(fit(a[1], width), fit(a[2], width), strict=True)]
        if op == "slice":
            return fit(a[0][args[1] :], width)
        return fit(a[1] + a[0] if op == "concat" else a[0], width)

    def without(self, f: int, gone, memo: dict | None = None) -> int:
        """f with some variables quantified away."""
        memo = {} if memo is None else memo
        if f < 2:
            return f
        if f not in memo:
            v, low, high = self.d.nodes[f]
            a, b = self.without(low, gone, memo), self.without(high, gone, memo)
            memo[f] = self.d.ite(a, 1, b) if gone(v) else self.d.ite(self.d.node(v, 0, 1), b, a)
        return memo[f]

    def shifted(self, f: int, memo: dict | None = None) -> int:
        """Next state variables as those of the state."""
        memo = {} if memo is None else memo
        if f < 2:
            return f
        if f not in memo:
            v, low, high = self.d.nodes[f]
            memo[f] = self.d.node(v - 1, self.shifted(low, memo), self.shifted(high, memo))
        return memo[f]


def verify(circuit: Circuit, bad: str, enabled: str | None = None, depth: int = 64, budget: int = 400_000) -> dict:
    """Whether node ``bad`` can be 1 in some cycle.

    proven (the reachable states are closed), counterexample (with the cycle), bounded (``depth`` cycles
    are free of it), uncovered (proven, but ``enabled`` never is 1), inconclusive (the node budget).
    """
    c = cone(circuit, [bad, *([enabled] if enabled else [])])
    try:
        s = _Symbols(c, budget)
        d = s.d
        step_relation = 1
        for (r, k), v in s.now.items():
            nxt = s.v[c.registers[r][2]]
            f = nxt[k] if k < len(nxt) else 0
            nv = d.node(v + 1, 0, 1)
            step_relation = d.ite(d.ite(nv, f, d.ite(f, 0, 1)), step_relation, 0)
        last = 2 * len(s.bits)
        front = 1
        for (r, k), v in reversed(s.now.items()):
            front = d.ite(d.node(v, 0, 1), front if c.registers[r][1] >> k & 1 else 0, 0 if c.registers[r][1] >> k & 1 else front)
        seen, covered = front, False
        for cycle in range(depth + 1):
            if d.ite(front, s.v[bad][0], 0):
                return {"verdict": "counterexample", "cycle": cycle}
            covered = covered or not enabled or bool(d.ite(front, s.v[enabled][0], 0))
            image = s.shifted(s.without(d.ite(front, step_relation, 0), lambda v: v >= last or v % 2 == 0))
            new = d.ite(image, d.ite(seen, 0, 1), 0)
            if not new:
                return {"verdict": "proven" if covered else "uncovered", "cycle": cycle}
            seen, front = d.ite(seen, 1, new), new
        return {"verdict": "bounded", "cycle": depth}
    except TooLarge:
        return {"verdict": "inconclusive", "cycle": None}
