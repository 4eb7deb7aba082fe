"""Operators over whole inputs: nothing that a part of the input would hide."""

import os

import pytest

from factloom.operators import graph
from factloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_package_rules_see_every_line_item(spark):
    got = {r.object_id: r.n_evidence for r in Q.QUERIES["package_rules"](spark, SF).where("code = 'OC5003'").collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows = lines.select("l_suppkey", "l_partkey", "l_linenumber").distinct().groupBy("l_suppkey").count().where("count > 1").collect()
    assert rows and got == {f"package-ball:b{r.l_suppkey}": r["count"] for r in rows}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_register_rules_see_every_order(spark):
    """Every ninth order has no register in the second view."""
    got = {r.object_id for r in Q.QUERIES["register_rules"](spark, SF).where("code = 'OC6301'").collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    want = {f"register:chip/r{r.o_orderkey}" for r in orders.where("o_orderkey % 9 = 0").collect()}
    assert want and got == want and "o_orderkey % 4" not in Q.ORACLE["register_rules"]


def test_the_state_bound_is_each_requirements_own(spark):
    """Long chains stop; short ones beside them, together beyond the bound, are judged."""
    edges = [(f"{c}{k}", f"{c}{k + 1}", False, "known") for c, n in (("l", 30), *[(f"s{i}_", 4) for i in range(9)]) for k in range(n)]
    df = spark.createDataFrame(edges, "source string, sink string, inverted boolean, status string")
    req = lambda id, a, b, e="reachable", t="any": (id, a, b, e, t, [], [])
    reqs = [req("far", "l0", "l30"), req("near", "l0", "l3"), *[req(f"ok{i}", f"s{i}_0", f"s{i}_4") for i in range(5)], req("miss", "s5_0", "l0"), req("no", "s6_0", "s6_4", "unreachable"), req("apart", "s7_0", "l0", "unreachable"), req("odd", "s8_0", "s8_4", t="inverted")]
    q = spark.createDataFrame(reqs, "id string, source string, sink string, expectation string, transform string, through array<string>, exclude array<string>")
    got = {r.id: r.verdict for r in graph.judged(df, q, max_states=10).collect()}
    assert got == {"far": "inconclusive", "near": "pass", **{f"ok{i}": "pass" for i in range(5)}, "miss": "missing", "no": "forbidden", "apart": "pass", "odd": "polarity"}


def test_a_large_search_is_judged(spark):
    """A search of more than 500,000 states goes on to its end."""
    edges = spark.range(600_000).selectExpr("'s' AS source", "'n' || id AS sink", "false AS inverted", "'known' AS status").union(spark.sql("SELECT 'n7', 'far', false, 'known'"))
    q = spark.createDataFrame([("yes", "s", "far", "reachable", "any", [], []), ("no", "s", "gone", "reachable", "any", [], [])], "id string, source string, sink string, expectation string, transform string, through array<string>, exclude array<string>")
    assert {r.id: r.verdict for r in graph.judged(edges, q).collect()} == {"yes": "pass", "no": "missing"}


def test_a_pads_findings_are_read_off_its_row(spark):
    """Against plain Python, with blank, unknown and repeated values; pin mappings are shuffled by pad and by ball, once each."""
    import random

    from factloom.model import SCHEMAS
    from factloom.operators import rules

    rnd = random.Random(8)
    csv = [("csv.package", "csv", rnd.choice((None, "", *(f"d{k}" for k in range(9)))), rnd.choice((None, "", *(f"b{k}" for k in range(9)))), rnd.choice((None, "", "NC", "nc", "g1", "g2", "g3")), None, k) for k in range(60)]
    chip = [("def.chip", "def", pad, None, sig, None, 0) for pad, sig in (("d0", "g1"), ("d0", "g2"), ("d1", "NC"), ("d2", None), ("d3", "g3"), ("", "g1"), (None, "g1"), ("d9", "g1"))]
    df = spark.createDataFrame(csv + chip, SCHEMAS["pin_mappings"])
    for physical in (True, False):
        f = rules.Facts(spark, {"pin_mappings": df if physical else df.where("kind = 'csv'")})
        pads = {c[2] for c in chip if c[2]} if physical else set()
        used = lambda s: bool(s) and s.upper() not in rules.NO_CONNECT
        signals = {p: {c[4] for c in chip if c[2] == p and used(c[4])} for p in pads}
        good = [r for r in csv if r[3] and (r[2] or r[4])]
        want = [("OC5006", None, ())] * (len(csv) - len(good))
        want += [("OC5001", f"die-pad:{r[2]}", (r[4] if r[4] is not None else r[2],)) for r in good if pads and r[2] and r[2] not in pads]
        want += [("OC5005", f"die-pad:{r[2]}", (r[4],)) for r in good if used(r[4]) and signals.get(r[2]) and r[4] not in signals[r[2]]]
        for code, key, of, id in (("OC5003", 3, 2, "package-ball"), ("OC5004", 2, 3, "die-pad")):
            for k in {r[key] for r in good if r[key]}:
                own = [r[of] for r in good if r[key] == k]
                if len(own) > 1 and (code == "OC5003" or len(set(own)) > 1):
                    want.append((code, f"{id}:{k}", tuple(sorted(own, key=lambda x: (x is not None, x or "")))))
        out = rules.package_rules(f)
        assert sorted(map(str, want)) == sorted(str((r.code, r.object_id, tuple(e.value for e in r.evidence))) for r in out.collect())
        assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 2
