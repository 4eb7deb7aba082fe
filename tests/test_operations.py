"""Operators on whole reports, contracts and graphs: queries against SQL, odd inputs against plain Python."""

import fnmatch
import os
import random
import re

import duckdb
import pytest

from factloom.model import SCHEMAS
from factloom.operators import digests, incremental, order, patterns
from factloom.operators.rules import Facts, Policy
from factloom.plans import operations as O

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF) if os.path.isdir(SF) else ():
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(O.ORACLE))
def test_query(spark, sql, name):
    got, want = O.QUERIES[name](spark, SF), sql.sql(O.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- patterns


def test_patterns_match_as_one_by_one(spark):
    rnd = random.Random(5)
    chars = "abAB1_[]*?.x-"
    names = {"".join(rnd.choice("abAB1_x.-") for _ in range(rnd.randrange(6))) for _ in range(150)} | {"", "a[b", "a*b"}
    globs = {"".join(rnd.choice(chars) for _ in range(rnd.randrange(6))) for _ in range(400)} | {"*", "?", "", "[ab]*", "[!a]b*", "a[", "**"}
    p = spark.createDataFrame([(g, "v") for g in globs] + [(None, "v"), ("*", "w")], "pattern string, kind string")
    n = spark.createDataFrame([(x, "v") for x in names] + [(None, "v"), ("other", "u")], "name string, kind string")
    found = patterns.matched(p, n, ["kind"])
    got = sorted((r.pattern, r.name) for r in found.collect())
    wild = re.compile(r"[*?\[]")
    want = sorted((g, x) for g in globs for x in names if (fnmatch.fnmatchcase(x, g) if wild.search(g) else x == g))
    assert got == want
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_regexps_and_case(spark):
    regexps = ["^ab", "b$", "a.c", "ab*c", "x?yz", "[ab]1", r"a\.b", "abc", "^abc$", r"\d1", "."]
    names = ["abc", "ABC", "ac", "abbc", "yz", "xyz", "a1", "b1", "a.b", "axb", "zab", "11", "ab"]
    p = spark.createDataFrame([(x, c) for x in regexps for c in (False, True)], "pattern string, nocase boolean")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = sorted((r.pattern, r.nocase, r.name) for r in patterns.matched(p, n, [], "regexp").collect())
    assert got == sorted((x, c, m) for x in regexps for c in (False, True) for m in names if re.search(x, m, re.I if c else 0))
    globs = spark.createDataFrame([("A*", True), ("A*", False)], "pattern string, nocase boolean")
    assert sorted((r.nocase, r.name) for r in patterns.matched(globs, n, []).collect()) == sorted([(True, m) for m in names if m.lower().startswith("a")] + [(False, "ABC")])
    assert patterns.matched(globs.limit(0), n, []).count() == patterns.matched(globs, n.limit(0), []).count() == 0


# ---------------------------------------------------------------- order


def plain_layers(edges, nodes):
    """Layers by recursion, components by reachability."""
    every = {x for e in edges for x in e} | set(nodes)
    out, into = {x: set() for x in every}, {x: set() for x in every}
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)
    reach = {}
    for x in every:
        seen, todo = set(), list(out[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += out[y]
        reach[x] = seen
    cycle = {x: min(y for y in reach[x] if x in reach[y]) for x in every if x in reach[x]}
    bad = {y for x in cycle for y in reach[x]} | set(cycle)
    layer = {}
    for x in sorted(every - bad, key=lambda x: sum(x in reach[y] for y in every)):
        layer[x] = max((layer[y] + 1 for y in into[x]), default=0)
    return {(x, layer.get(x), cycle.get(x)) for x in every}


@pytest.mark.parametrize("seed", range(4))
def test_layers_and_cycles(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range((30, 45, 60, 25)[seed])}
    edges |= {(100 + k, 101 + k) for k in range(50)} | {(100, 5)}  # a long chain
    edges |= {(200 + k, 200 + (k + 1) % 30) for k in range(30)}  # a ring
    edges |= {(300 + k, 300 + (k + 1) % 20) for k in range(20)} | {(0, 307), (311, 400), (400, 401), (500, 500), (500, 501)}
    rows = [*edges, *list(edges)[:5], (None, 1), (2, None)]
    got = order.layers(spark.createDataFrame(rows, "source long, sink long"), spark.createDataFrame([(900,), (5,), (None,)], "node long"))
    assert {tuple(r) for r in got.collect()} == plain_layers(edges, {900, 5})


def test_layers_of_nothing(spark):
    none = spark.createDataFrame([], "source string, sink string")
    assert order.layers(none).count() == 0
    assert [tuple(r) for r in order.layers(none, spark.createDataFrame([("a",)], "node string")).collect()] == [("a", 0, None)]


# ---------------------------------------------------------------- contracts


def some_tables(spark, rows, **more):
    named = spark.createDataFrame([(v, "rtl", True, []) for v in ("rtl.a", "rtl.b")], SCHEMAS["views"])
    comps = spark.createDataFrame(rows, "view string, native_name string")
    interfaces = spark.createDataFrame([("rtl.a", {"x": "1", "y": "2"} if more.get("maps") else {"y": "2", "x": "1"})], "view string, port_maps map<string,string>")
    return {"views": named, "components": comps, "interfaces": interfaces}


def test_digests_know_no_order_and_count_copies(spark):
    rows = [("rtl.a", f"c{k}") for k in range(300)] + [("rtl.a", None), ("rtl.b", "c1"), ("rtl.b", "c1")]
    one, two, less = some_tables(spark, rows), some_tables(spark, rows[::-1], maps=True), some_tables(spark, rows[:-1])
    two["components"] = two["components"].repartition(7)
    x, y, z = (digests.contract(t) for t in (one, two, less))
    assert sorted(map(tuple, x["families"].collect())) == sorted(map(tuple, y["families"].collect())) and x["whole"].first() == y["whole"].first()
    assert x["whole"].first().digest != z["whole"].first().digest and x["whole"].first().complete
    assert [tuple(r) for r in digests.contract_changes(x, z).collect()] == [("rtl.b", "components", "removed", 1)]
    assert digests.contract_changes(x, y).count() == 0


def test_saved_contracts_and_empty_tables(spark, tmp_path):
    x = digests.contract(some_tables(spark, [("rtl.a", "c")]))
    digests.save(x, f"{tmp_path}/frozen")
    back = digests.load(spark, f"{tmp_path}/frozen")
    assert digests.contract_changes(back, x).count() == 0
    none = {n: df.limit(0) for n, df in some_tables(spark, []).items()}
    empty = digests.contract(none)
    assert empty["whole"].first().rows is None and digests.contract_changes(empty, empty).count() == 0
    assert {(r.view, r.state) for r in digests.contract_changes(empty, x).collect()} == {("rtl.a", "view added"), ("rtl.b", "view added"), ("rtl.a", "added")}


# ---------------------------------------------------------------- incremental checks


def random_facts(spark, seed, change=False):
    """Components, ports and functions of four views; with ``change`` view rtl.b is another."""
    rnd, other = random.Random(seed), random.Random(seed + 99)
    comps, ports, functions = [], [], []
    for v in ("rtl.a", "rtl.b", "liberty.c", "lef.d"):
        r = other if change and v == "rtl.b" else rnd
        for c in range(12):
            if r.random() < 0.2:
                continue
            comps += [(v, v.split(".")[0], f"comp{c}", "known", "s", c, 1)] * r.choice((1, 1, 1, 2))
            for p in range(4):
                if r.random() < 0.85:
                    ports.append((v, v.split(".")[0], f"comp{c}", f"pin{p}", 1, r.choice(("input", "input", "output", None)), r.choice(("signal", "power", "clock")), "known", r.choice((1, 1, 2)), "s", p, 1))
            if v[:3] in ("rtl", "lib"):
                functions.append((v, v.split(".")[0], f"comp{c}", "y", r.choice(("a & b", "b & a", "a | b"))))
    make = lambda rows, names, family: spark.createDataFrame(rows, ", ".join(f"{n} {dict(x.strip().split(' ', 1) for x in re.split(r', (?=[a-z_]+ )', SCHEMAS[family]))[n]}" for n in names))
    full = lambda df, family: spark.createDataFrame([], SCHEMAS[family]).unionByName(df, allowMissingColumns=True)
    return Facts(spark, {
        "views": spark.createDataFrame([(v, v.split(".")[0], True, []) for v in ("rtl.a", "rtl.b", "liberty.c", "lef.d")], SCHEMAS["views"]),
        "components": full(make(comps, ("view", "kind", "native_name", "status", "source", "line", "column"), "components"), "components"),
        "ports": full(make(ports, ("view", "kind", "component", "native_name", "ordinal", "direction", "role", "status", "width", "source", "line", "column"), "ports"), "ports"),
        "functions": full(make(functions, ("view", "kind", "component", "output", "expression"), "functions"), "functions"),
    })


def told(df):
    return sorted(str((r.rule, r.entity, r.code, r.object_id, r.property, r.message, [(e.view, e.value) for e in r.evidence])) for r in df.collect())


def test_updated_findings_are_those_of_the_full_check(spark):
    before, after = random_facts(spark, 1), random_facts(spark, 1, True)
    for n in ("components", "ports", "functions"):  # what changed stays within three components
        few = f"{'native_name' if n == 'components' else 'component'} IN ('comp1', 'comp2', 'comp3')"
        after.tables[n] = before[n].where(f"NOT {few}").union(after[n].where(few))
    old, _ = incremental.saved(incremental.findings(before))
    got, want = told(incremental.updated(old, before, after, ["rtl.b"])), told(incremental.findings(after))
    assert got == want and got != told(old)
    some = incremental.touched(before, after, ["rtl.b"])
    assert {r.component for r in some.collect()} <= {"comp1", "comp2", "comp3"}
    less = incremental.restricted(after, some)
    assert 0 < less["ports"].count() <= 3 * 16 < after["ports"].count()  # only touched members are read on


def test_what_may_touch_anything_runs_in_full(spark):
    before, after = random_facts(spark, 2), random_facts(spark, 2)
    assert incremental.touched(before, after, []).count() == 0
    after.tables["views"] = after["views"].withColumn("complete", after["views"]["view"] != "rtl.b")
    assert incremental.touched(before, after, ["rtl.b"]) is None
    assert incremental.touched(before, Facts(spark, before.tables, Policy(strict_inventory=True)), []) is None


def test_ports_are_read_for_what_a_rule_finds_only(spark):
    """No pin twice, no component twice: nothing is gathered for them; empty families are known to be empty as joins are planned."""
    from factloom.model import empty
    from factloom.operators import rules

    before = random_facts(spark, 3)
    once = {"components": before["components"].dropDuplicates(["view", "native_name"]), "ports": before["ports"].dropDuplicates(["view", "component", "native_name"])}
    f = Facts(spark, before.tables | once)
    for rule in (rules.duplicate_components, rules.duplicate_pins):
        assert "Scan" not in plan_of(rule(f)).replace("LocalTableScan", "") and rule(f).count() == 0
        assert rule(before).count() > 0 or rule is rules.duplicate_pins
    assert "LocalTableScan <empty>" in plan_of(before["ports"].join(empty(spark, "aliases"), "component"))
    assert f.pins[1] == 0 and all(len(r.seen) >= 1 and not r.again for r in f.pins[0].collect())


# ---------------------------------------------------------------- reports by partition


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_reports_by_partition_have_the_renderers_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.plans import check, queries, reports

    d = queries.diagnosed(spark, SF)
    d = d.withColumn("message", F.concat("message", F.lit(' "é" | \n😀'))).withColumn("waiver", F.when(F.col("line") % 3 == 0, F.col("line")).cast("int"))
    for df in (check.ordered(d).repartition(1).sortWithinPartitions(*check.SORT), check.ordered(d.repartition(5)), check.ordered(d.limit(0))):
        for form, render in (("json", lambda x: reports.render_json(x, "p")), ("sarif", reports.render_sarif), ("markdown", reports.render_markdown)):
            path = str(tmp_path / f"report.{form}")
            reports.publish_parts(df, path, form, "p")
            with open(path, "rb") as f:
                assert f.read() == render(df).encode()


def test_probes_are_as_wide_as_literals(spark):
    """Numbers that share all short grams: what a pattern probes is hardly more than what it matches."""
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(f"p{k}?",) for k in (12345, 54321)] + [("*9876*",), ("*4321",), ("p777",)], "pattern string")
    kinds = {(r.k["kind"], r.k["width"]) for r in p.select(F.explode(patterns.keys(F.col("pattern"), F.lit("glob"))).alias("k")).collect()}
    assert kinds == {("^", 6), (".", 4), ("$", 4), ("=", 0)}
    n = spark.range(1000, 600_000).selectExpr("'p' || id AS name")
    got = sorted((r.pattern, r.name) for r in patterns.matched(p, n, []).collect())
    names = [f"p{k}" for k in range(1000, 600_000)]
    assert got == sorted([("p54321?", x) for x in names if x.startswith("p54321") and len(x) == 7] + [("p12345?", x) for x in names if x.startswith("p12345") and len(x) == 7] + [("*9876*", x) for x in names if "9876" in x] + [("*4321", x) for x in names if x.endswith("4321")])
