"""Rules on small hand-made designs; the driver's tables are compared with SQL in test_queries."""

import random
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from factloom.functions import boolean, names
from factloom.model import CATALOG, SCHEMAS, catalog
from factloom.operators import generic, graph, review, rules
from factloom.operators.rules import Facts, Policy
from factloom.plans import check as C


def rows(spark, family, *dicts):
    columns = [c.name for c in spark.createDataFrame([], SCHEMAS[family]).schema]
    return spark.createDataFrame([tuple(d.get(c) for c in columns) for d in dicts], SCHEMAS[family])


def view(name, complete=True, scopes=()):
    return {"view": name, "kind": name.split(".")[0], "complete": complete, "tainted_scopes": list(scopes)}


def of(v, **columns):
    return {"view": v, "kind": v.split(".")[0], "status": "known", "source": v, "line": 1, "column": 1, **columns}


def facts(spark, policy=None, **families):
    return Facts(spark, {k: rows(spark, k, *v) for k, v in families.items()}, policy or Policy())


def codes(df):
    return sorted((r.code, r.object_id) for r in df.collect())


UART = dict(
    views=[view("rtl.default"), view("liberty.tt"), view("lef.default")],
    components=[of(v, native_name="uart") for v in ("rtl.default", "liberty.tt", "lef.default")],
    ports=[
        of("rtl.default", component="uart", native_name="tx", direction="output", width=1, explicit_scalar=True),
        of("liberty.tt", component="uart", native_name="tx", direction="in", width=1, explicit_scalar=True),
        of("lef.default", component="uart", native_name="tx", direction="OUTPUT", role="signal", width=1, explicit_scalar=False),
        of("rtl.default", component="uart", native_name="data", direction="input", width=8, left=7, right=0),
        of("liberty.tt", component="uart", native_name="data", direction="input", width=8, left=0, right=7),
        of("lef.default", component="uart", native_name="data", direction="input", width=4),
        of("liberty.tt", component="uart", native_name="VDD", direction="inout", role="primary_power", width=1),
        of("lef.default", component="uart", native_name="VDD", direction="inout", role="ground", width=1, field_states={"direction": "tainted"}),
        of("rtl.default", component="uart", native_name="receive_data0", direction="unknown", width=1),
        of("lef.default", component="uart", native_name="receive_date0", direction="input", width=1),
    ],
)


def test_port_rules(spark):
    f = facts(spark, **UART)
    tx, data, vdd = (f"component:uart/port:{p}" for p in ("tx", "data", "VDD"))
    assert codes(rules.port_conflicts(f)) == [("OC4001", tx), ("OC4101", data), ("OC4106", tx), ("OC4203", vdd)]
    missing = codes(rules.pin_inventory(f))
    assert missing == [("OC3101", "component:uart/port:receive_data0"), ("OC3101", "component:uart/port:receive_date0")]
    assert ("OC3104", "component:uart/port:receive_data0") in codes(rules.likely_names(f))
    loose = facts(spark, Policy(scalar_vector_equivalent=True, rtl_power_pins="required"), **UART)
    assert ("OC4106", tx) not in codes(rules.port_conflicts(loose)) and ("OC4202", vdd) in codes(rules.pin_inventory(loose))


def test_unknown_facts_never_conflict(spark):
    changed = [dict(p, status="tainted") if p["view"] != "rtl.default" else p for p in UART["ports"]]
    assert codes(rules.port_conflicts(facts(spark, **{**UART, "ports": changed}))) == []
    tainted = facts(spark, **{**UART, "views": [view("rtl.default", False), view("liberty.tt", False, ["uart"]), view("lef.default", False, ["*"])]})
    assert codes(rules.pin_inventory(tainted)) == []


def test_contract(spark):
    f = facts(spark, **UART, contract_ports=[{"component": "uart", "port": "tx", "direction": "output"}, {"component": "uart", "port": "VSS", "role": "ground"}, {"component": "gone", "port": "a"}])
    assert ("OC3001", "component:gone") in codes(rules.component_inventory(f))
    got = codes(rules.pin_inventory(f))
    assert ("OC4202", "component:uart/port:VSS") in got and ("OC3102", "component:uart/port:data") in got and ("OC3102", "component:uart/port:tx") not in got
    built = review.build_contract(facts(spark, **UART))
    assert {(r.port, r.direction) for r in built.collect()} >= {("tx", None), ("data", "input")} and review.contract_diff(built, built).count() == 0


def test_aliases_and_collisions(spark):
    alias = lambda v, n, c, comp=None: {"alias_kind": "port" if comp else "component", "view_selector": v, "component": comp, "native": n, "canonical": c}
    f = facts(spark, **UART, aliases=[alias("lef", "receive_date0", "receive_data0", "uart"), alias("*", "receive_date0", "other", "uart"), alias("rtl.*", "data", "d1", "uart"), alias("rtl.d*", "data", "d2", "uart")])
    ports = {(r.view, r.native_name): r.port for r in f.ports.collect()}
    assert ports["lef.default", "receive_date0"] == "receive_data0" and ports["rtl.default", "data"] == "data"
    assert codes(rules.alias_collisions(f)) == [("OC2002", "component:uart/port:data")]


def test_duplicates(spark):
    ports = [*UART["ports"], of("rtl.default", component="uart", native_name=r"\tx ", ordinal=9, direction="output", width=1)]
    f = facts(spark, **{**UART, "ports": ports, "components": [*UART["components"], of("lef.default", native_name="uart", ordinal=2)]})
    assert ("OC3103", "component:uart/port:tx") in codes(rules.duplicate_pins(f))
    assert codes(rules.duplicate_components(f)) == [("OC2003", "component:uart")]


def test_functions(spark):
    fn = lambda v, o, e: {"view": v, "kind": v.split(".")[0], "component": "uart", "output": o, "expression": e}
    f = facts(spark, **UART, functions=[fn("liberty.tt", "tx", "!(data & VDD)"), fn("rtl.default", "tx", "!data | !VDD"), fn("liberty.tt", "y", "data ^ nothing"), fn("rtl.default", "y", "data"), fn("liberty.tt", "z", "data &"), fn("rtl.default", "z", "data")])
    got = codes(rules.functions(f))
    assert ("OC4301", "component:uart/port:y") in got and ("OC4302", "component:uart/port:z") in got and ("OC4303", "component:uart/port:y") in got and not any("tx" in i for _, i in got)


@pytest.mark.parametrize("seed", range(4))
def test_equivalence_equals_a_truth_table(spark, seed):
    rnd = random.Random(seed)

    def make(depth):
        if depth == 0:
            return rnd.choice(["a", "b", "c", "d", "0", "1"])
        x, y = make(depth - 1), make(depth - 1)
        return rnd.choice([f"({x} & {y})", f"({x} | {y})", f"({x} ^ {y})", f"!{x}", f"({x})'", f"{x} {y}", f"({x} + {y} * {x})"])

    pairs = [(k, make(3), make(2)) for k in range(12)]
    got = {r.id: r.counterexample for r in rules.equivalences(spark.createDataFrame(pairs, "id int, left string, right string")).collect()}
    for k, left, right in pairs:
        le, ri = boolean.postfix(left), boolean.postfix(right)
        v = sorted({*boolean.variables(le), *boolean.variables(ri)})
        at = [{n: bool(i >> (len(v) - 1 - p) & 1) for p, n in enumerate(v)} for i in range(2 ** len(v))]
        want = next((i for i, x in enumerate(at) if boolean.evaluate(le, x) != boolean.evaluate(ri, x)), None)
        assert got[k] == want, (left, right)


@pytest.mark.parametrize("bad", ["", "a &", "(a", "a)", "a | | b", "a # b", "& a"])
def test_expressions_that_are_none(bad):
    with pytest.raises(boolean.BooleanError):
        boolean.postfix(bad)


def test_references(spark):
    ref = lambda v, kind, n, **k: {"view": v, "kind": v.split(".")[0], "object_kind": kind, "relation": "reference", "native_name": n, **k}
    d = lambda v, kind, n, **k: ref(v, kind, n, **k) | {"relation": "definition"}
    f = facts(
        spark, **{**UART, "views": [*UART["views"], view("sdc.a"), view("upf.a"), view("def.a", False, ["lost"])]},
        objects=[
            ref("sdc.a", "ports", "tx"), ref("sdc.a", "port", "nope"), ref("sdc.a", "port", "dat*", match_mode="glob"), ref("sdc.a", "port", "xyz*"), ref("sdc.a", "port", "TX", nocase=True), ref("sdc.a", "clock", "clk"),
            ref("sdc.a", "port", "^d.t", match_mode="regexp"), ref("sdc.a", "port", "(a|b)", match_mode="regexp"), ref("sdc.a", "pin", "u1/q"), d("rtl.default", "pin", "u1.q"), ref("sdc.a", "port", "uart/tx"),
            ref("upf.a", "instance", "uart"), ref("upf.a", "instance", "ghost"), ref("upf.a", "supply_net", "vdd"), ref("upf.a", "supply_net", "vss"), d("upf.a", "supply_net", "vdd"), ref("upf.a", "port", "miss"), ref("def.a", "net", "lost"), ref("def.a", "net", "n2"),
        ],
        clocks=[{"view": "sdc.b", "kind": "sdc", "native_name": "clk"}],
    )
    got = {(c, i.split(":")[-1]) for c, i in codes(rules.references(f))}
    assert got == {("OC6001", "nope"), ("OC6001", "xyz*"), ("OC6001", "clk"), ("OC1105", "(a|b)"), ("OC6101", "ghost"), ("OC6103", "vss"), ("OC6102", "miss"), ("OC6401", "n2")}


def test_upf_definitions(spark):
    d = lambda n, k, u=False: {"view": "upf.a", "kind": "upf", "object_kind": "power_domain", "relation": "definition", "native_name": n, "is_update": u, "ordinal": k}
    f = facts(spark, objects=[d("one", 1), d("two", 1), d("two", 2), d("upd", 1), d("upd", 2, True), d("early", 1, True), d("early", 2), d("none", 1, True)])
    assert {i.split(":")[-1] for _, i in codes(rules.upf_definitions(f))} == {"two", "early", "none"}


def test_clocks_and_interfaces(spark):
    c = lambda v, **k: {"view": v, "kind": "sdc", "native_name": "clk", "targets": ["uart/tx"], "period": 10.0, **k}
    ports = [dict(p, role="signal") if p["native_name"] == "tx" else p for p in UART["ports"]]
    f = facts(
        spark, **{**UART, "ports": ports}, clocks=[c("sdc.a"), c("sdc.b", targets=["tx"]), c("sdc.c", period=None, targets=["uart.tx"])],
        interfaces=[{"view": "lef.default", "kind": "lef", "component": "uart", "native_name": "bus", "port_maps": {"A": "tx[0]", "B": "tx", "C": "zz"}}],
    )
    assert codes(rules.clock_rules(f)) == [("OC6003", "component:uart/port:tx")] * 3  # all three spellings name one port
    f.tables["clocks"] = f["clocks"].union(rows(spark, "clocks", c("sdc.d", period=5.0)))
    assert ("OC6002", "clock:clk") in codes(rules.clock_rules(f))
    assert codes(rules.interface_rules(f)) == [("OC6201", "component:uart/port:zz"), ("OC6202", "interface:uart/bus")]


def test_connectivity(spark):
    end = lambda n, b=None: {"view": "rtl.default", "native_name": n, "bit_index": b, "status": "known"}
    edge = lambda a, b, inv=False, s="known": {"view": "rtl.default", "source": a, "sink": b, "inverted": inv, "status": s}
    count = iter(range(99))
    req = lambda i, a, b, e="reachable", t="any": {"id": i, "source": a, "sink": b, "expectation": e, "transform": t, "through": [], "exclude": [], "ordinal": next(count)}
    f = facts(
        spark, views=[view("rtl.default")],
        endpoints=[*[end("a", k) for k in range(4)], *[end("b", k) for k in range(4)], end("x"), end("y"), end("z"), end("w")],
        edges=[*[edge(f"a[{k}]", f"b[{k}]") for k in range(3)], edge("x", "y", True), edge("y", "x"), edge("y", "z", False, "tainted")],
        requirements=[req("ok", "a[2:0]", "b[2:0]", t="identity"), req("miss", "a", "b", t="identity"), req("pol", "x", "y", t="identity"), req("inv", "x", "y", t="inverted"), req("maybe", "x", "z"), req("no", "y", "x", "unreachable"), req("fine", "w", "x", "unreachable"), req("gone", "q", "x"), req("wide", "a[1:0]", "x", t="identity"), req("dup1", "y", "z"), req("dup2", "y", "z"), req("against", "x", "x"), req("against2", "x", "x", "unreachable")],
    )
    got = {i.split(":")[1]: c for c, i in codes(rules.connectivity_rules(f))}
    assert got == {"miss": "OC6503", "pol": "OC6505", "inv": "OC6505", "maybe": "OC6505", "no": "OC6504", "gone": "OC6501", "wide": "OC6506", "dup2": "OC6509", "against2": "OC6509"}


def test_connectivity_by_view_with_vectors_witnesses_and_wrong_bits(spark):
    end = lambda v, n, b=None: {"view": v, "native_name": n, "bit_index": b, "status": "known"}
    edge = lambda v, a, b: {"view": v, "source": a, "sink": b, "inverted": False, "status": "known"}
    count = iter(range(99))
    req = lambda i, a, b, e="reachable", t="any", through=(), exclude=(): {"id": i, "source": a, "sink": b, "expectation": e, "transform": t, "through": list(through), "exclude": list(exclude), "ordinal": next(count)}
    named = ("a", "m", "z")
    f = facts(
        spark, views=[view("rtl.one"), view("rtl.two"), view("rtl.open", False, ["*"]), view("lef.bad", False, ["*"])],
        endpoints=[end(v, n, k) for v in ("rtl.one", "rtl.two", "rtl.open") for n in named for k in range(2)],
        edges=[*[edge("rtl.one", f"a[{k}]", f"m[{k}]") for k in range(2)], *[edge("rtl.one", f"m[{k}]", f"z[{1 - k}]") for k in range(2)], edge("rtl.two", "a[0]", "m[0]")],
        requirements=[req("crossed", "a", "z", t="reverse"), req("straight", "a", "z", t="identity"), req("via", "a[0]", "z[1]", through=["m"]), req("not", "a[1]", "z[0]", "unreachable"), req("around", "a[1]", "z[0]", "unreachable", exclude=["m[*]"]), req("nowhere", "a", "z", through=["q"])],
    )
    got = {}
    for r in rules.connectivity_rules(f).collect():
        got.setdefault(r.object_id.split(":")[1], {})[r.evidence[0].view] = (r.code, [e.value for e in r.evidence[1:]])
    one, two, dark = ({k: x.get(v) for k, x in got.items()} for v in ("rtl.one", "rtl.two", "rtl.open"))
    assert one == {"straight": ("OC6507", one["straight"][1]), "not": ("OC6504", ["a[1]", "m[1]", "z[0]"]), "nowhere": ("OC6501", []), "crossed": None, "via": None, "around": None}
    assert {k: x and x[0] for k, x in two.items()} == {"crossed": "OC6503", "straight": "OC6503", "via": "OC6503", "nowhere": "OC6501", "not": None, "around": None}
    assert two["via"][1] == ["m[0]"] and {k: x and x[0] for k, x in dark.items()} == {"crossed": "OC6505", "straight": "OC6505", "via": "OC6505", "not": "OC6505", "nowhere": "OC6501", "around": "OC6505"}


def test_requirements_that_come_into_a_tainted_scope_stay_open(spark):
    """Whatever is not read of top/u may join what it touches; what never comes there is judged."""
    end = lambda n: {"view": "rtl.a", "native_name": n, "status": "known"}
    edge = lambda a, b: {"view": "rtl.a", "source": a, "sink": b, "inverted": False, "status": "known"}
    req = lambda k, i, a, b, e: {"id": i, "source": a, "sink": b, "expectation": e, "transform": "any", "through": [], "exclude": [], "ordinal": k}
    ends = ("top/a", "top/u/q", "top/u/r", "top/y", "top/b", "top/z")
    reqs = [("r1", "top/a", "top/y", "reachable"), ("r2", "top/a", "top/z", "unreachable"), ("r3", "top/a", "top/u/q", "reachable"), ("r4", "top/b", "top/z", "unreachable"), ("r5", "top/b", "top/y", "reachable"), ("r6", "top/a", "top/u/r", "unreachable")]
    f = facts(spark, views=[view("rtl.a", False, ["top/u"])], endpoints=[end(n) for n in ends], edges=[edge("top/a", "top/u/q"), edge("top/u/r", "top/y")], requirements=[req(k, *r) for k, r in enumerate(reqs)])
    got = {r.object_id.split(":")[1]: r.code for r in rules.connectivity_rules(f).collect()}
    assert got == {"r1": "OC6505", "r2": "OC6505", "r5": "OC6503", "r6": "OC6505"}


def test_a_checker_that_raises_is_told(spark):
    def bad(f):
        raise KeyError("x")

    def late(f):
        return rules.finding(f["views"], F.raise_error(F.lit("late")).cast("string"), "x", F.lit("i"), None, F.lit("m"))

    f = facts(spark, views=[view("rtl.one")])
    assert sorted(codes(rules.all_findings(f, (bad, late)))) == [("OC9002", "checker:bad"), ("OC9002", "checker:late")]


def test_reach_equals_a_search(spark):
    rnd = random.Random(1)
    edges = [(str(rnd.randrange(25)), str(rnd.randrange(25)), rnd.random() < 0.4, "known" if rnd.random() < 0.9 else "tainted") for _ in range(60)]
    df = spark.createDataFrame(edges, "source string, sink string, inverted boolean, status string")
    starts = spark.createDataFrame([("r", "0", ["3", "7"], ["5"]), ("s", "1", [], [])], "id string, node string, through array<string>, exclude array<string>")
    states, hit = graph.reach(df, starts, True)
    got = {(r.id, r.node, r.passed, r.parity, r.uncertain): r.depth for r in states.collect()}
    want = {}
    for id, node, through, exclude in (("r", "0", ["3", "7"], ["5"]), ("s", "1", [], [])):
        front = {(id, node, int(through[:1] == [node]), 0, False)}
        depth = 0
        while front:
            want |= {s: depth for s in front}
            depth += 1
            front = {(id, b, p + (through[p : p + 1] == [b]), (q + i) % 2, u or s != "known") for (_, n, p, q, u) in front for a, b, i, s in edges if a == n and b not in exclude} - want.keys()
    assert got == want and not hit
    assert graph.reach(df, starts, True, max_states=3)[1]


def test_fingerprints_are_those_of_json(spark):
    import hashlib
    import json

    cases = [("OC4001", "component:a", "direction", ["rtl.b", "lef.a", "rtl.b"]), ("oc1 ", None, None, []), ("OC2", 'q"\\\n\t\x01', "é😀 ", ["ü.x"])]
    df = spark.createDataFrame(cases, "code string, object_id string, property string, views array<string>")
    got = [r[0] for r in df.select(generic.fingerprint(F.col("code"), F.col("object_id"), F.col("property"), F.col("views"))).collect()]
    want = [hashlib.sha256(json.dumps({"code": c.strip().upper(), "object": o, "property": p, "views": sorted(set(v))}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24] for c, o, p, v in cases]
    assert got == want


def test_globs_are_those_of_the_shell(spark):
    from fnmatch import fnmatchcase

    pats = ["*", "a*", "?b", "[ab]c", "[!a]c", "a.b", "a[b", "*]", "x-[a-c]*", "a+b(c)", "**", "a?*"]
    words = ["a", "ab", "ac", "bc", "cc", "a.b", "axb", "a[b", "]", "x-b1", "x-d", "a+b(c)", "", "abc"]
    df = spark.createDataFrame([(p, w) for p in pats for w in words], "p string, w string")
    assert all(r[2] == fnmatchcase(r[1], r[0]) for r in df.select("p", "w", names.glob(F.col("w"), F.col("p"))).collect())


@pytest.mark.parametrize("pattern,good", [("^a.*b$", True), ("a[bc]d", True), ("(a)", False), ("a|b", False), ("a+", False), ("a**", False), ("*a", False), ("a*b*c*", False), (r"\1", False), ("[[:digit:]]", False), (r"a\.b", True), ("a{2}", False)])
def test_safe_patterns(pattern, good):
    assert (names.safe_regexp(pattern) is not None) == good


@pytest.mark.parametrize("seed,least", [(2, 0.9), (3, 0.92), (4, 0.75)])
def test_similar_names_lose_no_pair(spark, seed, least):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcd_") for _ in range(rnd.randrange(4, 14))) for _ in range(60)]
    words = sorted({*words, *(w + "x" for w in words[:30]), *(w[:3] + "Z" + w[4:].upper() for w in words[:20]), *(w[1:] for w in words[30:]), "Straße_x", "strasse_x"})
    side = lambda s: spark.createDataFrame([(w, k % 2) for k, w in enumerate(words)], f"{s}_name string, {s}_kind int")
    got = {(r.l_name, r.r_name) for r in rules.similar(side("l"), side("r"), [], least).collect()}
    assert got == {(a, b) for k, a in enumerate(words) for j, b in enumerate(words) if a < b and k % 2 != j % 2 and SequenceMatcher(None, a.casefold(), b.casefold()).ratio() >= least}


def test_check_with_waivers_and_exit_codes(spark):
    w = lambda k, **c: {"waiver_index": k, "code": "*", "object_pattern": "*", "reason": f"r{k}", **c}
    f = facts(
        spark, **UART, overrides=[{"code": "OC4106", "severity": "info"}],
        waivers=[w(0, code="OC4001", object_pattern="component:uart/port:t?"), w(1, code="OC4*", expires=date(2020, 1, 1)), w(2, code="OC9*"), w(3, code="OC4*", views=["lef"])],
    )
    d = C.check(f, date(2026, 1, 1))
    got = {(r.code, r.object_id): (r.severity, r.waiver) for r in d.collect()}
    tx = "component:uart/port:tx"
    assert got["OC4001", tx] == ("error", 0) and got["OC4106", tx] == ("info", 3) and got["OC1004", "waiver:1"] == ("warning", None) and got["OC1005", "waiver:2"] == ("info", None)
    assert [r.rank for r in d.collect()] == sorted(r.rank for r in d.collect())
    assert C.exit_code(d) == 1 and C.exit_code(d.where("severity = 'warning'")) == 0 and C.exit_code(d.where("severity = 'warning'"), True) == 1
    assert review.report_diff(d, d).where("state != 'unchanged'").count() == 0 and catalog(spark).count() == len(CATALOG) == 74


def test_checkers_of_the_user(spark):
    own = lambda f: rules.finding(f["views"], "OC9002", "view", F.col("view"), None, F.lit("mine"))
    assert ("OC9002", "lef.default") in codes(rules.all_findings(facts(spark, **UART), (own,)))


def test_registers_are_shuffled_once(spark):
    """Findings are read off a row for each register: no shuffle of registers or fields for each rule."""
    from factloom.model import empty

    fields = "array(named_struct('name', 'f', 'bit_offset', {0}, 'bit_width', 4, 'access', 'rw', 'reset', cast(0 AS decimal(38,0)), 'status', 'known'), named_struct('name', 'F', 'bit_offset', 2, 'bit_width', 4, 'access', 'rw', 'reset', cast(0 AS decimal(38,0)), 'status', 'known'))"
    row = "SELECT '{0}' AS view, '{1}' AS kind, 'r' AS native_name, 'c' AS component, cast({2} AS decimal(38,0)) AS address_offset, 32 AS size_bits, 'rw' AS access, 'known' AS status, {3} AS fields"
    rows = [("ipxact.a", "ipxact", 0, fields.format(0)), ("systemrdl.b", "systemrdl", 4, fields.format(1)), ("systemrdl.b", "systemrdl", 8, "NULL")]
    sql = " UNION ALL ".join(row.format(*r) for r in rows) + " UNION ALL " + row.format("ipxact.a", "ipxact", 0, "NULL").replace("'r' AS", "'s' AS")
    r = empty(spark, "registers").unionByName(spark.sql(sql), allowMissingColumns=True)
    out = rules.register_rules(rules.Facts(spark, {"registers": r}))
    assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 0
    got = sorted((x.code, x.object_id, x.property, [e.view for e in x.evidence]) for x in out.collect())
    both, reg = ["ipxact.a", "systemrdl.b"], "register:c/r"
    assert ("OC6301", "register:c/s", "presence", ["ipxact.a"]) in got and ("OC6307", reg, "definition", ["systemrdl.b"] * 2) in got
    assert ("OC6309", reg, "fields.layout", ["ipxact.a"]) in got and ("OC6307", f"{reg}/field:f", "definition", ["ipxact.a"] * 2) in got
    assert [x for x in got if x[0] == "OC6302"] == [("OC6302", reg, "address", both)]
