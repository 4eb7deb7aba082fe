"""Obligations, proofs and sequential properties against brute force."""

import itertools
import json
import random

import pytest

from factloom.functions import boolean
from factloom.operators import formal, sequential
from factloom.operators.sequential import Circuit


def expression(rnd, depth, names="abcd"):
    if depth == 0:
        return rnd.choice(names)
    x, y = expression(rnd, depth - 1, names), expression(rnd, depth - 1, names)
    return rnd.choice([f"({x} & {y})", f"({x} | {y})", f"({x} ^ {y})", f"!{x}"])


def test_obligations(spark):
    rnd = random.Random(3)
    rows = [(str(k), expression(rnd, 3), expression(rnd, 2), rnd.choice([None, expression(rnd, 2)])) for k in range(60)]
    rows += [("v", "a", "b", "a & !a"), ("bad", "a &", "b", None)]
    df = spark.createDataFrame(rows, "id string, left string, right string, assume string")
    got = {r.id: r for r in formal.run_obligations(df).collect()}
    for i, left, right, assume in rows[:-1]:
        le, ri, g = (boolean.postfix(x or "1") for x in (left, right, assume))
        names = sorted({n for t in (le, ri, g) for n in boolean.variables(t)})
        meets = [dict(zip(names, v, strict=True)) for v in itertools.product((False, True), repeat=len(names))]
        meets = [x for x in meets if boolean.evaluate(g, x)]
        bad = next((x for x in meets if boolean.evaluate(le, x) != boolean.evaluate(ri, x)), None)
        assert got[i].verdict == ("vacuous" if not meets else "different" if bad else "equivalent")
        assert (json.loads(got[i].witness) if got[i].witness else None) == bad
    assert got["bad"].verdict == "inconclusive" and formal.exit_code(formal.run_obligations(df)) == 2
    receipt = formal.receipts(df, formal.run_obligations(df))
    assert formal.replay(df, receipt).count() == 0
    assert {(r.id, r.problem) for r in formal.replay(df.where("id != 'v'"), receipt.where("id != '3'")).collect()} == {("v", "stray"), ("3", "missing")}
    wide = spark.createDataFrame([("w", " ^ ".join(f"x{k}" for k in range(60)), "0", None), ("m", " | ".join(f"(a{k} & b{k})" for k in range(30)), "0", None)], df.schema)
    assert {r.id: r.verdict for r in formal.run_obligations(wide, 20_000).collect()} == {"w": "different", "m": "inconclusive"}


@pytest.mark.parametrize("clauses,proof,good", [
    ([[1, 2], [1, -2], [-1, 2], [-1, -2]], [[1], []], True),
    ([[1, 2], [1, -2], [-1, 2]], [[1], []], False),
    ([[1, 2, 3], [-1, 2], [-2, 3]], [[3], []], False),
    ([[1], [-1]], [[]], True),
    ([[]], [[]], True),
    ([[1, 2], [-1, 3], [-2, 3], [-3, 4], [-3, -4]], [[3], []], True),
    ([[1, 2], [1, -2], [-1, 2], [-1, -2]], [[1]], False),
])
def test_proofs(clauses, proof, good):
    assert formal.check_rup(clauses, proof)[0] == good


def test_pigeonhole_proof_and_rows(spark):
    clauses = [[1, 2], [3, 4], [5, 6], [-1, -3], [-1, -5], [-3, -5], [-2, -4], [-2, -6], [-4, -6]]
    proof = [[-1], []]
    df = spark.createDataFrame([("a", json.dumps(clauses), json.dumps(proof)), ("b", json.dumps(clauses[:-1]), json.dumps(proof)), ("c", "x", "[]")], "id string, clauses string, proof string")
    assert {r.id: r.valid for r in formal.check_proofs(df).collect()} == {"a": True, "b": False, "c": False}


def counter(top, step=1, reset=0):
    return Circuit({"en": 1}, {"n": (4, reset, "nxt")}, [("inc", "add", ("n", step), 4), ("wrap", "eq", ("n", top), 1), ("up", "mux", ("wrap", 0, "inc"), 4), ("nxt", "mux", ("en", "up", "n"), 4), ("bad", "eq", ("n", 9), 1), ("hot", "eq", ("n", 15), 1)])


@pytest.mark.parametrize("top,step,depth,want", [(7, 1, 64, ("proven", 7)), (12, 1, 64, ("counterexample", 9)), (12, 1, 5, ("bounded", 5)), (12, 2, 64, ("proven", 6)), (7, 3, 64, ("counterexample", 3))])
def test_properties(top, step, depth, want):
    r = sequential.verify(counter(top, step), "bad", depth=depth)
    assert (r["verdict"], r["cycle"]) == want
    assert sequential.verify(counter(7), "bad", "hot")["verdict"] == "uncovered" and sequential.verify(counter(7), "bad", budget=20)["verdict"] == "inconclusive"


def test_verdicts_equal_explicit_search():
    rnd = random.Random(4)
    for _ in range(40):
        nodes, names = [], ["i", "r", "s"]
        for k in range(8):
            op = rnd.choice(["and", "or", "xor", "not", "add", "sub", "mul", "eq", "lt", "mux"])
            pick = lambda: rnd.choice([*names, rnd.randrange(4)])  # noqa: B023, E731
            args = {"not": 1, "mux": 3}.get(op, 2)
            nodes.append((f"n{k}", op, tuple(pick() for _ in range(args)), 1 if op in ("eq", "lt") else 3))
            names.append(f"n{k}")
        nodes.append(("bad", "eq", (rnd.choice(names[3:]), rnd.randrange(8)), 1))
        c = Circuit({"i": 2}, {"r": (3, rnd.randrange(8), rnd.choice(names)), "s": (3, 0, rnd.choice(names))}, nodes)
        front, seen, want = {(c.registers["r"][1], 0)}, set(), None
        for cycle in range(65):
            every = [sequential.step(c, {"r": r, "s": s}, {"i": i}) for r, s in front for i in range(4)]
            if any(v["bad"] for v, _ in every):
                want = ("counterexample", cycle)
                break
            seen |= front
            front = {(n["r"], n["s"]) for _, n in every} - seen
            if not front:
                want = ("proven",)
                break
        got = sequential.verify(c, "bad")
        assert (got["verdict"], got["cycle"])[: len(want)] == want


def test_simulation(spark):
    rnd = random.Random(5)
    c = counter(7)
    rows = [(t, k, rnd.randrange(2)) for t in range(3) for k in range(30)]
    got = {(r.t, r.k): (r.n, r.bad) for r in sequential.simulate(spark.createDataFrame(rows, "t long, k long, en int").repartition(3), c, "t", "k", ["n", "bad"]).collect()}
    for t in range(3):
        n = 0
        for _, k, en in rows[t * 30 : t * 30 + 30]:
            assert got[t, k] == (n, 0)
            n = (0 if n == 7 else n + 1) if en else n
    assert set(sequential.cone(c, ["hot"]).registers) == {"n"} and not sequential.cone(Circuit({"a": 1}, {"r": (1, 0, "a")}, [("z", "not", ("a",), 1)]), ["z"]).registers
