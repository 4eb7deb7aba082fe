"""Queries that apply each operator to projections of the driver's tables, and the same rows in SQL.

A projection makes views of one table: a second view with known changes, lists of bits, intervals, edges,
traces. Queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import bits, boolean, names
from factloom.model import EVIDENCE, catalog, empty
from factloom.operators import formal, generic, graph, review, rules, sequential, trace
from factloom.operators.rules import Facts, Policy

from . import check as checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def family(df: DataFrame, name: str, **columns) -> DataFrame:
    """Rows of an observation family; columns that aren't given are null."""
    fields = empty(df.sparkSession, name).schema.fields
    return df.select(*[(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def both(df: DataFrame, name: str, a: dict, b: dict, where=None) -> DataFrame:
    """Two observations of each row, the second one of those that a condition selects, in one pass over the table."""
    fields = empty(df.sparkSession, name).schema.fields
    one, two = (F.struct(*[(x[f.name] if f.name in x else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]) for x in (a, b))
    return df.select(F.explode(F.array_compact(F.array(one, two if where is None else F.when(where, two)))).alias("x")).select("x.*")


def pick(n, *values: str):
    """One of the values by a number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def found(df: DataFrame) -> DataFrame:
    """What of findings SQL compares: code, object, number of pieces of evidence."""
    return df.select("code", "object_id", F.size("evidence").cast("long").alias("n_evidence"))


def views(spark: SparkSession, *named: str) -> DataFrame:
    row = lambda v: F.struct(F.lit(v).alias("view"), F.lit(v.split(".")[0]).alias("kind"), F.lit(True).alias("complete"), F.array().cast("array<string>").alias("tainted_scopes"))
    return spark.range(1).select(F.inline(F.array(*map(row, named))))  # made by the JVM: no Python worker starts for a few rows


# ---------------------------------------------------------------- conflicts of values

PARTS = """SELECT p_partkey AS k, 'a' AS v, ['input', 'output', 'inout'][p_size % 3 + 1] AS d FROM part
    UNION ALL SELECT p_partkey, 'b', CASE WHEN p_partkey % 7 = 0 THEN 'internal' ELSE ['input', 'output', 'inout'][p_size % 3 + 1] END FROM part"""


def two_views(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), pick(F.col("p_size"), "input", "output", "inout").alias("d"))
    return p.withColumn("v", F.lit("a")).union(p.select("k", F.when(F.col("k") % 7 == 0, "internal").otherwise(F.col("d")), F.lit("b")))


@query(f"SELECT k, count(DISTINCT d) AS n_values, count(*) AS n_members FROM ({PARTS}) GROUP BY k HAVING count(DISTINCT d) > 1")
def value_conflict(spark, sf):
    return generic.conflict(two_views(spark, sf), ["k"], "d")


@query("""WITH v AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END AS m FROM orders)
    SELECT k, min(p) <> max(p) AS p_conflict, min(s) <> max(s) AS s_conflict, coalesce(min(m) <> max(m), false) AS m_conflict FROM v GROUP BY k
    HAVING min(p) <> max(p) OR min(s) <> max(s) OR coalesce(min(m) <> max(m), false)""")
def property_conflicts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 2).alias("m"))
    return generic.conflicts(o, ["k"], ["p", "s", "m"])


def customer_facts(spark, sf):
    """Each market segment stands for a role; view b changes some, view c knows few; directions follow the key."""
    c = table(spark, sf, "customer")
    k, seg = F.col("c_custkey"), F.array_position(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), F.col("c_mktsegment")).cast("int")
    role = pick(seg, "signal", "clock", "power", "ground", "reset", "analog")
    a = family(c, "ports", view=F.lit("rtl.a"), kind=F.lit("rtl"), component=F.lit("top"), native_name=F.concat(F.lit("p"), k), role=role, direction=pick(k, "in", "OUT", "bidir"), width=F.lit(1), status=F.lit("known"), source=F.lit("a"), line=k, column=F.lit(1))
    b = family(c, "ports", view=F.lit("lef.b"), kind=F.lit("lef"), component=F.lit("top"), native_name=F.concat(F.lit("p"), k), role=F.when(k % 5 == 0, pick(k / 5, "power", "ground", "clock", "tie")).otherwise(role), direction=F.when(k % 11 == 0, "internal").otherwise(pick(k, "input", "output", "inout")), width=F.when(k % 13 == 0, 2).otherwise(1), status=F.when(k % 4 == 0, "tainted").otherwise("known"), source=F.lit("b"), line=k, column=F.lit(1))
    comps = spark.createDataFrame([("rtl.a", "rtl", "top"), ("lef.b", "lef", "top")], "view string, kind string, native_name string")
    comps = family(comps, "components", view=F.col("view"), kind=F.col("kind"), native_name=F.col("native_name"))
    return Facts(spark, {"views": views(spark, "rtl.a", "lef.b"), "components": comps, "ports": a.union(b)})


CUSTOMER = """WITH c AS (SELECT c_custkey AS k, ['signal', 'clock', 'power', 'ground', 'reset', 'analog'][list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) % 6 + 1] AS r FROM customer),
    v AS (SELECT k, r, ['input', 'output', 'inout'][k % 3 + 1] AS d, 1 AS w FROM c
        UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN ['power', 'ground', 'clock', 'tie'][(k // 5) % 4 + 1] ELSE r END, CASE WHEN k % 11 = 0 THEN 'internal' ELSE ['input', 'output', 'inout'][k % 3 + 1] END, CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END FROM c WHERE k % 4 <> 0)"""


@query(f"""{CUSTOMER}, g AS (SELECT k, min(d) <> max(d) AS d, min(r) <> max(r) AS r, min(w) <> max(w) AS w, bool_or(r = 'power') AND bool_or(r = 'ground') AS pg, bool_or(r IN ('clock', 'reset')) AS cr, count(*) AS n FROM v GROUP BY k),
    x AS (SELECT 'OC4001' AS code, k, n FROM g WHERE d UNION ALL SELECT 'OC4101', k, n FROM g WHERE w
        UNION ALL SELECT CASE WHEN pg THEN 'OC4203' WHEN cr THEN 'OC4204' ELSE 'OC4201' END, k, n FROM g WHERE r)
    SELECT code, 'component:top/port:p' || k AS object_id, n AS n_evidence FROM x""")
def port_value_rules(spark, sf):
    return found(rules.port_conflicts(customer_facts(spark, sf)))


@query(f"""{CUSTOMER} SELECT 'p' || k AS port, coalesce(max(CASE WHEN r = 'power' THEN r END), max(CASE WHEN r = 'ground' THEN r END), any_value(b.r2)) AS dominant
    FROM v JOIN (SELECT k, CASE WHEN k % 4 = 0 THEN r WHEN k % 5 = 0 THEN ['power', 'ground', 'clock', 'tie'][(k // 5) % 4 + 1] ELSE r END AS r2 FROM c) b USING (k) GROUP BY k""")
def dominant_role(spark, sf):
    return rules.dominant_roles(customer_facts(spark, sf)).select("port", "dominant")


def order_facts(spark, sf):
    """Buses from orders: bits are line numbers in one view, reversed or with gaps in the other."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("all")).withColumn("bits", F.array_distinct("all"))
    k = F.col("k")
    base = dict(kind=F.lit("rtl"), component=F.lit("top"), native_name=F.concat(F.lit("b"), k), status=F.lit("known"), source=F.lit("s"), line=F.lit(1), column=F.lit(1))
    other = F.when(k % 3 == 0, F.reverse("bits")).when(k % 5 == 0, F.transform("bits", lambda b: b + 1)).otherwise(F.col("bits"))
    a = family(li, "ports", view=F.lit("rtl.a"), bit_indices=F.col("bits"), width=F.size("bits"), bit_order_known=F.lit(True), **base)
    b = family(li, "ports", view=F.lit("rtl.b"), bit_indices=other, width=F.size("bits"), bit_order_known=k % 7 != 0, **base)
    raw = family(li, "ports", view=F.lit("rtl.c"), bit_indices=F.filter("all", lambda b: b % 3 != 2), width=F.size("bits"), bit_order_known=F.lit(True), **base)
    comps = family(spark.createDataFrame([("rtl.a",), ("rtl.b",), ("rtl.c",)], "view string"), "components", view=F.col("view"), kind=F.lit("rtl"), native_name=F.lit("top"))
    return Facts(spark, {"views": views(spark, "rtl.a", "rtl.b", "rtl.c"), "components": comps, "ports": a.union(b)}), Facts(spark, {"views": views(spark, "rtl.c"), "components": comps, "ports": raw})


@query("""WITH o AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY k),
    x AS (SELECT CASE WHEN k % 3 = 0 THEN CASE WHEN n > 1 AND k % 7 <> 0 THEN 'OC4102' END WHEN k % 5 = 0 THEN 'OC4103' END AS code, k FROM o)
    SELECT code, 'component:top/port:b' || k AS object_id, 2::BIGINT AS n_evidence FROM x WHERE code IS NOT NULL""")
def bus_shape_rules(spark, sf):
    return found(rules.port_conflicts(order_facts(spark, sf)[0]))


@query("""WITH o AS (SELECT l_orderkey AS k, l_linenumber AS b FROM lineitem WHERE l_linenumber % 3 <> 2),
    g AS (SELECT k, count(*) AS n, count(DISTINCT b) AS d, max(b) - min(b) + 1 AS span FROM o GROUP BY k)
    SELECT code, 'component:top/port:b' || k AS object_id, 1::BIGINT AS n_evidence
    FROM (SELECT 'OC4105' AS code, k FROM g WHERE n <> d UNION ALL SELECT 'OC4104', k FROM g WHERE d <> span)""")
def bus_bit_rules(spark, sf):
    return found(rules.bus_integrity(order_facts(spark, sf)[1]))


# ---------------------------------------------------------------- absences, duplicates, references

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"""WITH r AS (SELECT c_custkey AS k, p FROM customer, (SELECT unnest({list(PRIORITIES)}) AS p))
    SELECT k, p FROM r WHERE k % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderpriority = p)""")
def absence(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    required = c.withColumn("p", F.explode(F.array(*map(F.lit, PRIORITIES))))
    present = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"))
    return generic.absence(required, present, ["k", "p"], c.where("k % 10 = 0"), ["k"])


@query("""SELECT 'extra' AS side, k FROM (SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)
    UNION ALL SELECT 'missing', k FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT l_partkey FROM lineitem WHERE l_partkey % 6 <> 0)""")
def contract_presence(spark, sf):
    li, frozen = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"))
    extra = generic.absence(li.distinct(), frozen, ["k"]).select(F.lit("extra").alias("side"), "k")
    return extra.union(generic.absence(frozen, li.where("k % 6 != 0"), ["k"]).select(F.lit("missing").alias("side"), "k"))


@query("""SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n, min(o_orderstatus) <> max(o_orderstatus) AS differs FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_definition(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_orderstatus")
    return generic.duplicate(o, ["k", "m"], "o_orderstatus")


@query("""SELECT user_id, event_id, k::INT AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k > 1""")
def later_occurrences(spark, sf):
    e = table(spark, sf, "events")
    return generic.repeated(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "occurrence")


@query("""WITH x AS (SELECT p_partkey AS ref_id, split_part(p_name, ' ', 1) AS w FROM part), d AS (SELECT DISTINCT w FROM x WHERE length(w) % 2 = 0) SELECT ref_id, w FROM x WHERE w NOT IN (SELECT w FROM d)""")
def reference_exact(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("ref_id"), F.substring_index("p_name", " ", 1).alias("w"))
    d = x.where(F.length("w") % 2 == 0).select(F.col("w").alias("variant")).distinct()
    return generic.unresolved(x.withColumn("variants", F.array("w")), d, []).select("ref_id", "w")


@query(r"""WITH n AS (SELECT DISTINCT n_name FROM nation), c AS (SELECT c_custkey AS k, substr(n_name, 1, 2) || CASE WHEN c_custkey % 3 = 0 THEN '[XYZ]*' ELSE '?*' END AS pattern FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT k, pattern FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE regexp_full_match(n_name, replace(replace(pattern, '?', '.'), '*', '.*')))""")
def reference_glob(spark, sf):
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.concat(F.substring("n_name", 1, 2), F.when(F.col("c_custkey") % 3 == 0, "[XYZ]*").otherwise("?*")).alias("pattern"))
    kinds = c.select("pattern").distinct()  # patterns are matched once each
    hit = kinds.join(n.select("n_name"), names.glob(F.col("n_name"), F.col("pattern")), "left_semi")
    return c.join(hit, "pattern", "left_anti").select("k", "pattern")


@query("""WITH r AS (SELECT 0 AS rank, 'n1' AS v, n_name AS native, 'exact_' || n_nationkey AS c FROM nation WHERE n_nationkey % 4 = 0
        UNION ALL SELECT 3, '*', n_name, 'any_' || n_regionkey FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 3, '*', n_name, 'again_' || n_nationkey FROM nation WHERE n_nationkey % 9 = 0),
    u AS (SELECT 'n' || v AS v, n_name FROM nation, (SELECT unnest([1, 2]) AS v)),
    h AS (SELECT u.v, u.n_name, rank, c, min(rank) OVER (PARTITION BY u.v, n_name) AS best FROM u JOIN r ON native = n_name AND (r.v = u.v OR r.v = '*')),
    g AS (SELECT v, n_name, count(DISTINCT c) AS n, min(c) AS c FROM h WHERE rank = best GROUP BY ALL)
    SELECT 'rtl.' || u.v AS view, u.n_name AS native_name, CASE WHEN n = 1 THEN c ELSE u.n_name END AS component, coalesce(n, 0)::BIGINT AS n_candidates FROM u LEFT JOIN g USING (v, n_name)""")
def alias_resolution(spark, sf):
    n = table(spark, sf, "nation")
    rule = lambda df, sel, c: family(df, "aliases", alias_kind=F.lit("component"), view_selector=F.lit(sel), native=F.col("n_name"), canonical=c)
    aliases = rule(n.where("n_nationkey % 4 = 0"), "rtl.n1", F.concat(F.lit("exact_"), "n_nationkey")).union(rule(n.where("n_nationkey % 3 = 0"), "*", F.concat(F.lit("any_"), "n_regionkey"))).union(rule(n.where("n_nationkey % 9 = 0"), "*", F.concat(F.lit("again_"), "n_nationkey")))
    used = n.withColumn("view", F.explode(F.array(F.lit("rtl.n1"), F.lit("rtl.n2"))))
    f = Facts(spark, {"aliases": aliases, "components": family(used, "components", view=F.col("view"), kind=F.lit("rtl"), native_name=F.col("n_name"))})
    return f.components.select("view", "native_name", "component", F.greatest(F.coalesce(F.size("candidates"), F.lit(0)), F.lit(0)).cast("long").alias("n_candidates"))


# ---------------------------------------------------------------- inventories


def inventory_facts(spark, sf):
    """Suppliers as components, parts as pins: the second view lacks some of either; some scopes are tainted."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 50).alias("p")).distinct()
    name, pin = F.concat(F.lit("s"), "s"), F.concat(F.lit("p"), "p")
    comps = [family(df, "components", view=F.lit(v), kind=F.lit(v.split(".")[0]), native_name=name) for df, v in ((s, "rtl.a"), (s.where("s % 5 != 0"), "lef.b"))]
    ports = [family(df, "ports", view=F.lit(v), kind=F.lit(v.split(".")[0]), component=name, native_name=pin, status=F.lit("known"), direction=F.lit("input"), role=F.when(F.col("p") % 10 == 0, "power").otherwise("signal"), width=F.lit(1)) for df, v in ((li, "rtl.a"), (li.where("s % 5 != 0 AND (s + p) % 7 != 0"), "lef.b"))]
    vs = s.agg(F.array_sort(F.collect_list(F.when(F.col("s") % 6 == 0, name))).alias("t")).select(F.lit("lef.b").alias("view"), F.lit("lef").alias("kind"), F.lit(False).alias("complete"), F.col("t").alias("tainted_scopes")).union(views(spark, "rtl.a"))
    return Facts(spark, {"views": vs, "components": comps[0].union(comps[1]), "ports": ports[0].union(ports[1])}, Policy(strict_inventory=True))


PINS = "li AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS p FROM lineitem)"


@query("SELECT 'OC3001' AS code, 'component:s' || s_suppkey AS object_id, 1::BIGINT AS n_evidence FROM supplier WHERE s_suppkey % 5 = 0")
def component_inventory(spark, sf):
    f = inventory_facts(spark, sf)
    return found(rules.component_inventory(f))


@query(f"""WITH {PINS} SELECT CASE WHEN p % 10 = 0 THEN 'OC4202' ELSE 'OC3101' END AS code, 'component:s' || s || '/port:p' || p AS object_id, 1::BIGINT AS n_evidence FROM li WHERE s % 5 <> 0 AND s % 6 <> 0 AND (s + p) % 7 = 0""")
def pin_inventory(spark, sf):
    return found(rules.pin_inventory(inventory_facts(spark, sf)))


@query("""WITH r AS (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 5 = 0), n AS (SELECT n_nationkey AS i, n_name AS w FROM nation)
    SELECT view, w, count(*) AS n FROM (SELECT CASE WHEN i % 2 = 0 THEN 'rtl.a' ELSE 'lef.b' END AS view, w FROM n UNION ALL SELECT 'rtl.a', w FROM n WHERE i % 3 = 0) GROUP BY ALL HAVING count(*) > 1""")
def duplicate_components(spark, sf):
    n = table(spark, sf, "nation")
    use = n.select(F.when(F.col("n_nationkey") % 2 == 0, "rtl.a").otherwise("lef.b").alias("view"), "n_name").union(n.where("n_nationkey % 3 = 0").select(F.lit("rtl.a"), "n_name"))
    f = Facts(spark, {"components": family(use, "components", view=F.col("view"), kind=F.substring_index("view", ".", 1), native_name=F.col("n_name"))})
    d = rules.duplicate_components(f)
    return d.select(F.col("evidence")[0]["view"].alias("view"), F.substring_index("object_id", ":", -1).alias("w"), F.size("evidence").cast("long").alias("n"))


# ---------------------------------------------------------------- package, clocks, interfaces, registers


@query("""WITH p AS (SELECT DISTINCT l_partkey AS pad, l_suppkey AS ball, l_linenumber AS sig FROM lineitem),
    x AS (SELECT 'OC5003' AS code, 'package-ball:b' || ball AS object_id, count(*) AS n_evidence FROM p GROUP BY ball HAVING count(*) > 1
        UNION ALL SELECT 'OC5004', 'die-pad:d' || pad, count(*) FROM p GROUP BY pad HAVING count(DISTINCT ball) > 1
        UNION ALL SELECT 'OC5001', 'die-pad:d' || pad, 1 FROM p WHERE pad % 4 = 3
        UNION ALL SELECT 'OC5005', 'die-pad:d' || pad, 1 FROM p WHERE pad % 4 <> 3 AND sig <> 4 AND sig <> pad % 4 + 1)
    SELECT code, object_id, n_evidence::BIGINT AS n_evidence FROM x""")
def package_rules(spark, sf):
    """Every line item: its part as the pad, its supplier as the ball, its line number as the signal (4: not connected)."""
    d = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pad"), F.col("l_suppkey").alias("ball"), F.col("l_linenumber").alias("sig")).distinct()
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = family(d, "pin_mappings", view=F.lit("csv.package"), kind=F.lit("csv"), die_pad=name("d", "pad"), package_ball=name("b", "ball"), signal=F.when(F.col("sig") == 4, "NC").otherwise(name("g", "sig")))
    pads = d.select("pad").distinct().where("pad % 4 != 3")
    physical = family(pads, "pin_mappings", view=F.lit("def.chip"), kind=F.lit("def"), die_pad=name("d", "pad"), signal=F.concat(F.lit("g"), (F.col("pad") % 4 + 1).cast("string")))
    return found(rules.package_rules(Facts(spark, {"views": views(spark, "csv.package", "def.chip"), "pin_mappings": rows.union(physical)})))


@query("""WITH e AS (SELECT event_type AS n, user_id % 5 AS v, 1.0 * (length(event_type) + CASE WHEN user_id % 5 = 3 AND event_type LIKE '%c%' THEN 1 ELSE 0 END) AS p FROM events),
    d AS (SELECT DISTINCT n, v, p FROM e) SELECT 'OC6002' AS code, 'clock:' || n AS object_id, count(*) AS n_evidence FROM d GROUP BY n HAVING count(DISTINCT p) > 1""")
def clock_definitions(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("n"), (F.col("user_id") % 5).alias("v")).distinct()
    c = family(e, "clocks", view=F.concat(F.lit("sdc.v"), "v"), kind=F.lit("sdc"), native_name=F.col("n"), period=F.length("n") + F.when((F.col("v") == 3) & F.col("n").contains("c"), 1).otherwise(0), targets=F.array(F.col("n")))
    return found(rules.clock_rules(Facts(spark, {"clocks": c})))


@query("""WITH m AS (SELECT DISTINCT user_id % 20 AS i, json_extract_string(props, '$.k') AS k FROM events), p AS (SELECT i, 'l' || k AS l, 'q' || (k::INT % 30) AS q FROM m)
    SELECT 'OC6202' AS code, 'interface:top/i' || i AS object_id, count(*)::BIGINT AS n_evidence FROM (SELECT i, q FROM p GROUP BY i, q HAVING count(*) > 1) GROUP BY i
    UNION ALL SELECT 'OC6201', 'component:top/port:' || q, count(*)::BIGINT FROM p WHERE substr(q, 2)::INT % 10 = 0 GROUP BY q""")
def interface_rules(spark, sf):
    m = table(spark, sf, "events").select((F.col("user_id") % 20).alias("i"), F.get_json_object("props", "$.k").alias("k")).distinct()
    maps = m.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("l"), "k"), F.concat(F.lit("q"), (F.col("k").cast("int") % 30).cast("string"), F.lit("[3:0]"))))).alias("maps"))
    i = family(maps, "interfaces", view=F.lit("ipxact.a"), kind=F.lit("ipxact"), component=F.lit("top"), native_name=F.concat(F.lit("i"), "i"), port_maps=F.col("maps"))
    ports = family(spark.range(30).where("id % 10 != 0"), "ports", view=F.lit("ipxact.a"), kind=F.lit("ipxact"), component=F.lit("top"), native_name=F.concat(F.lit("q"), "id"))
    comps = family(spark.range(1), "components", view=F.lit("ipxact.a"), kind=F.lit("ipxact"), native_name=F.lit("top"))
    out = found(rules.interface_rules(Facts(spark, {"components": comps, "ports": ports, "interfaces": i})))
    return out.groupBy("code", "object_id").agg(F.count("*").alias("n_evidence"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_quantity::INT AS first, l_quantity::INT + l_linenumber - 1 AS last, l_partkey AS name, l_linenumber AS ln FROM lineitem)
    SELECT k, name, ln, active_last FROM (SELECT *, max(last) OVER (PARTITION BY k ORDER BY first, last, name, ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active_last FROM f) WHERE first <= active_last""")
def interval_overlaps(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("int").alias("first"), (F.col("l_quantity").cast("int") + F.col("l_linenumber") - 1).alias("last"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("ln"))
    return generic.overlaps(f, ["k"], "first", "last", ["name", "ln"]).select("k", "name", "ln", "active_last")


def register_facts(spark, sf):
    """Orders as registers of two maps: name by customer, scope by priority; fields from line items."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("f"))
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")  # an order without line items is a register without fields
    k = F.col("o_orderkey")
    fields = F.transform("f", lambda x: F.struct(F.concat(F.lit("f"), x["l_linenumber"].cast("string")).alias("name"), (x["l_linenumber"].cast("int") * 4).alias("bit_offset"), F.lit(4).alias("bit_width"), F.lit("RW").alias("access"), F.lit(0).cast("decimal(38,0)").alias("reset"), F.lit("known").alias("status")))
    base = dict(component=F.lit("Chip"), native_name=F.concat(F.lit("R"), k.cast("string"), F.lit("_REG")), memory_map=F.lit("m"), status=F.lit("known"), ordinal=F.lit(1))
    a = dict(view=F.lit("ipxact.a"), kind=F.lit("ipxact"), address_offset=k * 4, size_bits=F.lit(32), access=F.lit("read-write"), fields=fields, **base)
    b = dict(view=F.lit("systemrdl.b"), kind=F.lit("systemrdl"), address_offset=k * 4 + F.when(k % 16 == 1, 4).otherwise(0), size_bits=F.when(k % 32 == 1, 16).otherwise(32), access=F.when(k % 20 == 0, "ro").otherwise("rw"), fields=F.when(k % 24 == 0, F.filter(fields, lambda x: x["name"] != "f1")).otherwise(fields), **base)
    return Facts(spark, {"registers": both(j, "registers", a, b, k % 9 != 0)})


@query("""WITH li AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), dup AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY ALL),
    o AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT k FROM o WHERE k % 9 <> 0),
    x AS (SELECT 'OC6301' AS code, k, NULL AS n FROM o WHERE k % 9 = 0 UNION ALL SELECT 'OC6302', k, NULL FROM b WHERE k % 16 = 1 UNION ALL SELECT 'OC6303', k, NULL FROM b WHERE k % 32 = 1
        UNION ALL SELECT 'OC6306', k, NULL FROM b WHERE k % 20 = 0 UNION ALL SELECT 'OC6304', k, 1 FROM b JOIN li USING (k) WHERE k % 24 = 0 AND n = 1
        UNION ALL SELECT 'OC6307', k, n FROM o JOIN dup USING (k) WHERE c > 1 UNION ALL SELECT 'OC6307', k, n FROM b JOIN dup USING (k) WHERE c > 1 AND NOT (k % 24 = 0 AND n = 1)
        UNION ALL SELECT 'OC6309', k, NULL FROM o WHERE k IN (SELECT k FROM dup WHERE c > 1) OR k IN (SELECT k FROM li WHERE n * 4 + 3 >= 32)
        UNION ALL SELECT 'OC6309', k, NULL FROM b WHERE k IN (SELECT k FROM dup WHERE c > 1 AND NOT (k % 24 = 0 AND n = 1)) OR k IN (SELECT k FROM li WHERE n * 4 + 3 >= CASE WHEN k % 32 = 1 THEN 16 ELSE 32 END))
    SELECT code, 'register:chip/r' || k || CASE WHEN n IS NULL THEN '' ELSE '/field:f' || n END AS object_id, count(*) AS n FROM x GROUP BY ALL""")
def register_rules(spark, sf):
    d = rules.register_rules(register_facts(spark, sf))
    return d.groupBy("code", "object_id").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey % 2 AS v, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL), a AS (SELECT DISTINCT k FROM s WHERE n > 1),
    u AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
    SELECT 'register:c/r' || k AS object_id, u.n AS unscoped FROM a JOIN u USING (k)""")
def register_scopes(spark, sf):
    o = table(spark, sf, "orders")
    r = family(o, "registers", view=F.concat(F.lit("ipxact.v"), (F.col("o_orderkey") % 2).cast("string")), kind=F.lit("ipxact"), component=F.lit("c"), native_name=F.concat(F.lit("r"), "o_custkey"), address_block=F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    m = rules.register_members(Facts(spark, {"registers": r})).where("needs_scope")
    return m.groupBy(F.concat(F.lit("register:c/"), "name").alias("object_id")).agg(F.count_if(F.col("scope") == "").alias("unscoped")).where("unscoped > 0")


# ---------------------------------------------------------------- graphs


def tree(spark, sf):
    """Edges k to 2k+1 and 2k+2 between customers; odd ones invert, every seventeenth is uncertain."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    top = c.agg(F.max("k").alias("m"))
    e = c.union(spark.range(1)).withColumn("to", F.explode(F.array(F.col("k") * 2 + 1, F.col("k") * 2 + 2))).join(F.broadcast(top)).where("to <= m")
    return e.select(F.col("k").cast("string").alias("source"), F.col("to").cast("string").alias("sink"), (F.col("to") % 2 == 1).alias("inverted"), F.when(F.col("to") % 17 == 0, "tainted").otherwise("known").alias("status"))


TREE = """m AS (SELECT max(c_custkey) AS m FROM customer), n AS (SELECT c_custkey AS k FROM customer UNION SELECT 0), e AS (SELECT k AS s, 2 * k + d AS t FROM n, (SELECT unnest([1, 2]) AS d), m WHERE 2 * k + d <= m)"""


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT 0::BIGINT AS t, 0 AS parity, 0 AS depth UNION SELECT e.t, (w.parity + e.t % 2) % 2, depth + 1 FROM w JOIN e ON e.s = w.t WHERE e.t % 17 <> 0 AND e.t <> 5)
    SELECT t::VARCHAR AS node, parity::INT AS parity, depth::INT AS depth FROM w""")
def reachable_with_parity(spark, sf):
    starts = spark.createDataFrame([("r", "0", [], ["5"])], "id string, node string, through array<string>, exclude array<string>")
    states, _ = graph.reach(tree(spark, sf), starts)
    return states.select("node", "parity", "depth")


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT 0::BIGINT AS t, 0 AS parity, false AS doubt, false AS via UNION SELECT e.t, (w.parity + e.t % 2) % 2, doubt OR e.t % 17 = 0, via OR e.t = 2 FROM w JOIN e ON e.s = w.t),
    q AS (SELECT c_custkey AS t, c_custkey % 3 AS kind FROM customer), h AS (SELECT t, kind, parity, doubt, via FROM q LEFT JOIN w USING (t))
    SELECT t::VARCHAR AS id, CASE WHEN kind = 0 THEN CASE WHEN NOT doubt THEN 'forbidden' ELSE 'inconclusive' END
        WHEN kind = 1 THEN CASE WHEN NOT via THEN 'missing' WHEN doubt THEN 'inconclusive' ELSE 'pass' END
        ELSE CASE WHEN doubt THEN 'inconclusive' WHEN parity = 0 THEN 'pass' ELSE 'polarity' END END AS verdict FROM h""")
def connectivity_verdicts(spark, sf):
    k = F.col("c_custkey")
    q = table(spark, sf, "customer").select(k.cast("string").alias("id"), F.lit("0").alias("source"), k.cast("string").alias("sink"), F.when(k % 3 == 0, "unreachable").otherwise("reachable").alias("expectation"), F.when(k % 3 == 2, "identity").otherwise("any").alias("transform"), F.when(k % 3 == 1, F.array(F.lit("2"))).otherwise(F.array().cast("array<string>")).alias("through"), F.array().cast("array<string>").alias("exclude"))
    return graph.judged(tree(spark, sf), q).select("id", "verdict")


@query(f"WITH {TREE} SELECT 'r' AS id, t::VARCHAR AS node FROM (SELECT t FROM e WHERE t NOT IN (SELECT s FROM e) AND NOT EXISTS (SELECT 1 FROM m WHERE t > m)) ORDER BY node LIMIT 32")
def frontier_cut(spark, sf):
    e = tree(spark, sf)
    return graph.frontier_cut(e.select(F.lit("r").alias("id"), F.col("sink").alias("node")), e)


# ---------------------------------------------------------------- Boolean functions, bit vectors, traces

#: Two expressions, their inputs, and what they are in SQL.
EXPRESSIONS = (
    ("a & b | c", "c | b a", "abc", "a AND b OR c", "c OR b AND a"),
    ("!(a & b)", "!a | !b", "ab", "NOT (a AND b)", "NOT a OR NOT b"),
    ("a ^ b ^ c", "a ^ (b & c)", "abc", "(a <> b) <> c", "a <> (b AND c)"),
    ("a' b + a b'", "a ^ b", "ab", "NOT a AND b OR a AND NOT b", "a <> b"),
    ("(a | b) & (c | d)", "a c | b d", "abcd", "(a OR b) AND (c OR d)", "a AND c OR b AND d"),
    ("a | b", "a & b", "ab", "a OR b", "a AND b"),
    ("a", "a & (b | !b)", "ab", "a", "a AND (b OR NOT b)"),
    ("1", "a", "a", "true", "a"),
    ("a ^ a", "0", "a", "a <> a", "false"),
    ("~a * b", "b & !a & c", "abc", "NOT a AND b", "b AND NOT a AND c"),
)


def _compared(k: int, names: str, left: str, right: str) -> str:
    of = ", ".join(f"(i >> {len(names) - 1 - p}) & 1 = 1 AS {n}" for p, n in enumerate(names))
    return f"SELECT {k} AS id, {2 ** len(names)} AS n_assignments, (min(i) FILTER (({left}) <> ({right})))::INT AS counterexample FROM (SELECT i, {of} FROM range({2 ** len(names)}) AS t(i))"


@query(" UNION ALL ".join(_compared(k, *e[2:]) for k, e in enumerate(EXPRESSIONS)))
def boolean_equivalence(spark, sf):
    pairs = spark.createDataFrame([(k, left, right) for k, (left, right, *_) in enumerate(EXPRESSIONS)], "id int, left string, right string")
    return rules.equivalences(pairs).select("id", F.pow(F.lit(2), "n_inputs").cast("int").alias("n_assignments"), "counterexample")


@query("""WITH v AS (SELECT p_partkey AS k, p_size % 16 AS a, p_partkey % 16 AS i FROM part), x AS (SELECT k, a, i, (i & 8) <> 0 AS w, (i & 4) <> 0 AS x, (i & 2) <> 0 AS y, (i & 1) <> 0 AS z FROM v)
    SELECT k, (w AND x) OR ((y <> z) AND NOT w) AS f FROM x""")
def boolean_columns(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("k"), boolean.value(boolean.postfix("w x | (y ^ z) !w"), boolean.bits(["w", "x", "y", "z"], k % 16)).alias("f"))


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderkey & 255 AS a, (o_custkey * 7) & 255 AS b FROM orders), s AS (SELECT *, CASE WHEN a > 127 THEN a - 256 ELSE a END AS sa, CASE WHEN b > 127 THEN b - 256 ELSE b END AS sb FROM v)
    SELECT k, (a + b) & 255 AS add, (a - b) & 255 AS subtract, (a * b) & 255 AS multiply, xor(a, b) AS xor, 255 - xor(a, b) AS xnor, (sa < sb)::BIGINT AS lt, (a >= b)::BIGINT AS ge, (a << (b & 7)) & 255 AS shl, a >> (b & 7) AS shr,
        (sa >> (b & 7)) & 255 AS ashr, (-a) & 255 AS minus, (bit_count(a) % 2)::BIGINT AS parity, (a = 255)::BIGINT AS all_ones, (a >> 2) & 15 AS cut, ((a & 15) << 4) | (b & 15) AS joined, CASE WHEN b & 1 <> 0 THEN a ELSE b END AS mux FROM s""")
def bit_vectors(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), bits.mask(F.col("o_orderkey"), 8).alias("a"), bits.mask(F.col("o_custkey") * 7, 8).alias("b"))
    a, b = F.col("a"), F.col("b")
    small = b.bitwiseAND(F.lit(7).cast("long"))
    two = {n: bits.binary(n, a, b, 8) for n in ("add", "subtract", "multiply", "xor", "xnor", "ge")} | {"lt": bits.binary("lt", a, b, 8, True)} | {n: bits.binary(n, a, small, 8) for n in ("shl", "shr", "ashr")}
    one = {"minus": bits.unary("minus", a, 8), "parity": bits.unary("reduce_xor", a, 8), "all_ones": bits.unary("reduce_and", a, 8), "cut": bits.cut(a, 5, 2), "joined": bits.joined([(bits.mask(a, 4), 4), (bits.mask(b, 4), 4)]), "mux": bits.mux(bits.mask(b, 1), a, b)}
    return o.select("k", *[c.cast("long").alias(n) for n, c in (two | one).items()])


LAGS = """WITH w AS (SELECT user_id AS u, event_id AS e, event_type AS t, row_number() OVER x - 1 AS n, lag(event_type, 1) OVER x AS t1, lag(event_type, 2) OVER x AS t2 FROM events WINDOW x AS (PARTITION BY user_id ORDER BY event_id)),
    j AS (SELECT u, e, coalesce(t2 = 'click', false) AS enabled, coalesce(t = t1, false) AS same FROM w WHERE n >= 2)"""


@query(f"{LAGS} SELECT u AS user_id, e AS event_id, enabled, (NOT enabled OR same) AS ok FROM j")
def lag_property(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return trace.holds(e, "user_id", "event_id", "event_type", [("event_type", "click", 2)], source="event_type", latency=1).select("user_id", "event_id", "enabled", "ok")


@query(f"""{LAGS} SELECT u AS user_id, count(*) AS n_cycles, count(*) FILTER (enabled) AS n_enabled, count(*) FILTER (enabled AND NOT same) AS n_failures, min(e) FILTER (enabled AND NOT same) AS first_failure,
    CASE WHEN count(*) FILTER (enabled AND NOT same) > 0 THEN 'fails' WHEN count(*) FILTER (enabled) = 0 THEN 'uncovered' ELSE 'holds' END AS verdict FROM j GROUP BY u""")
def trace_verdicts(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return trace.verdicts(trace.holds(e, "user_id", "event_id", "event_type", [("event_type", "click", 2)], source="event_type", latency=1), "user_id", "event_id")


@query("""WITH f AS (SELECT l_orderkey AS o, l_linenumber * 1000000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS c, l_quantity::BIGINT % 4 AS q, l_linenumber % 2 = 0 AS en FROM lineitem),
    g AS (SELECT *, lag(CASE WHEN en THEN (q + 1) % 4 ELSE q END) OVER (PARTITION BY o ORDER BY c) AS want FROM f) SELECT o, c FROM g WHERE want IS NOT NULL AND want <> q""")
def replay_errors(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    f = li.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") * 1000000 + n).alias("c"), (F.col("l_quantity").cast("long") % 4).alias("q"), (F.col("l_linenumber") % 2 == 0).alias("en"))
    return trace.replay_errors(f, "o", "c", {"q": F.when(F.col("en"), (F.col("q") + 1) % 4).otherwise(F.col("q"))}).select("o", F.col("c").cast("long").alias("c"))


#: Two expressions under a guard, and what they are in SQL.
OBLIGATIONS = (
    ("a & b", "a", "b", "ab", "a AND b", "a", "b"),
    ("a ^ b", "a | b", "!(a & b)", "ab", "a <> b", "a OR b", "NOT (a AND b)"),
    ("a ^ b", "a | b", "c", "abc", "a <> b", "a OR b", "c"),
    ("a", "b", "a & !a", "ab", "a", "b", "a AND NOT a"),
    ("a b | c d", "(a | c) & (b | d)", "a ^ d", "abcd", "a AND b OR c AND d", "(a OR c) AND (b OR d)", "a <> d"),
)


def _obliged(k: int, names: str, left: str, right: str, guard: str) -> str:
    of = ", ".join(f"(i >> {len(names) - 1 - p}) & 1 = 1 AS {n}" for p, n in enumerate(names))
    return f"SELECT '{k}' AS id, CASE WHEN count(*) FILTER ({guard}) = 0 THEN 'vacuous' WHEN count(*) FILTER (({guard}) AND ({left}) <> ({right})) > 0 THEN 'different' ELSE 'equivalent' END AS verdict FROM (SELECT {of} FROM range({2 ** len(names)}) AS t(i))"


@query(" UNION ALL ".join(_obliged(k, *e[3:]) for k, e in enumerate(OBLIGATIONS)))
def guarded_obligations(spark, sf):
    rows = spark.createDataFrame([(str(k), *e[:3]) for k, e in enumerate(OBLIGATIONS)], "id string, left string, right string, assume string")
    return formal.run_obligations(rows).select("id", "verdict")


@query("""SELECT user_id, event_id, (coalesce(sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 8)::BIGINT AS n FROM events""")
def simulated_counter(spark, sf):
    """A counter of clicks that wraps after seven, run over every user's events."""
    c = sequential.Circuit({"en": 1}, {"n": (3, 0, "nxt")}, [("inc", "add", ("n", 1), 3), ("nxt", "mux", ("en", "inc", "n"), 3)])
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "click").cast("int").alias("en"))
    return sequential.simulate(e, c, "user_id", "event_id", ["n"])


# ---------------------------------------------------------------- reviews, waivers, severities


@query("""WITH a AS (SELECT o_custkey AS f, o_orderpriority AS d FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_custkey AS f, CASE WHEN o_orderkey % 10 = 1 THEN 'x' ELSE o_orderpriority END AS d FROM orders WHERE o_orderkey % 3 <> 1),
    x AS (SELECT *, row_number() OVER (PARTITION BY f, d) AS k FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY f, d) AS k FROM b),
    s AS (SELECT x.f FROM x JOIN y USING (f, d, k)), l AS (SELECT f, count(*) AS n FROM x ANTI JOIN y USING (f, d, k) GROUP BY f), r AS (SELECT f, count(*) AS n FROM y ANTI JOIN x USING (f, d, k) GROUP BY f),
    z AS (SELECT f, coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn FROM l FULL JOIN r USING (f))
    SELECT f, 'unchanged' AS state, count(*)::BIGINT AS n FROM s GROUP BY f UNION ALL SELECT f, 'changed', least(ln, rn)::BIGINT FROM z WHERE least(ln, rn) > 0
    UNION ALL SELECT f, 'resolved', (ln - rn)::BIGINT FROM z WHERE ln > rn UNION ALL SELECT f, 'new', (rn - ln)::BIGINT FROM z WHERE rn > ln""")
def report_diff(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 != 0").select(F.col("o_custkey").alias("f"), F.col("o_orderpriority").alias("d"))
    b = o.where("o_orderkey % 3 != 1").select(F.col("o_custkey").alias("f"), F.when(F.col("o_orderkey") % 10 == 1, "x").otherwise(F.col("o_orderpriority")).alias("d"))
    return generic.paired_changes(a, b, "f", "d", ["d"]).groupBy("f", "state").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS r FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 11 = 0 THEN 'X' ELSE l_returnflag END AS r FROM lineitem WHERE l_suppkey % 13 <> 0),
    x AS (SELECT k, count(*) AS n_removed FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY k), y AS (SELECT k, count(*) AS n_added FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY k)
    SELECT k, coalesce(n_removed, 0) AS n_removed, coalesce(n_added, 0) AS n_added, CASE WHEN n_removed IS NULL THEN 'added' WHEN n_added IS NULL THEN 'removed' ELSE 'changed' END AS state FROM x FULL JOIN y USING (k)""")
def multiset_diff(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("r"))
    b = li.where("l_suppkey % 13 != 0").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 11 == 0, "X").otherwise(F.col("l_returnflag")).alias("r"))
    return generic.multiset_changes(a, b, ["k"])


def event_findings(spark, sf):
    """Events as findings: the type gives the code, the user the object."""
    e = table(spark, sf, "events")
    code = F.when(F.col("event_type").contains("c"), "OC4001").when(F.col("event_type").contains("u"), "OC6505").otherwise("OC2002")
    ev = F.array(F.struct(F.concat(F.lit("rtl.v"), (F.col("user_id") % 3).cast("string")).alias("view"), F.col("event_type").alias("value"), F.lit("s").alias("source"), F.col("event_id").cast("int").alias("line"), F.lit(1).alias("column"))).cast(EVIDENCE)
    return e.select(code.alias("code"), F.lit("port").alias("object_kind"), F.concat(F.lit("u"), "user_id").alias("object_id"), F.col("event_type").alias("property"), F.concat(F.lit("e"), "event_id").alias("message"), ev.alias("evidence"))


EVENTS = "e AS (SELECT event_id, user_id, event_type AS t, CASE WHEN contains(event_type, 'c') THEN 'OC4001' WHEN contains(event_type, 'u') THEN 'OC6505' ELSE 'OC2002' END AS code FROM events)"


def diagnosed(spark, sf):
    other = spark.createDataFrame([("OC4001", "warning"), ("OC2002", "info")], "code string, severity string")
    return checks.diagnosed(event_findings(spark, sf), catalog(spark), other)


@query(f"""WITH {EVENTS} SELECT 'e' || event_id AS message, CASE code WHEN 'OC4001' THEN 'warning' WHEN 'OC6505' THEN 'warning' ELSE 'fatal' END AS severity,
    substr(sha256('{{"code":"' || code || '","object":"u' || user_id || '","property":"' || t || '","views":["rtl.v' || user_id % 3 || '"]}}'), 1, 24) AS fingerprint FROM e""")
def severities_and_fingerprints(spark, sf):
    return diagnosed(spark, sf).select("message", "severity", "fingerprint")


@query(f"""WITH {EVENTS}, w AS (SELECT * FROM (VALUES (0, 'OC4*', 'u1?', NULL), (1, 'OC*', 'u*', 'rtl.v1'), (2, 'OC6505', '*', NULL), (3, 'OC7*', '*', NULL)) AS t(i, c, o, v)),
    m AS (SELECT event_id, min(i) AS waiver FROM e JOIN w ON code GLOB c AND ('u' || user_id) GLOB o AND (v IS NULL OR v = 'rtl.v' || user_id % 3) WHERE code <> 'OC2002' GROUP BY event_id)
    SELECT 'e' || event_id AS message, waiver::INT AS waiver FROM e LEFT JOIN m USING (event_id) UNION ALL SELECT 'Unmatched waiver: ', NULL""")
def waivers(spark, sf):
    w = spark.createDataFrame([(0, "OC4*", "u1?", None), (1, "OC*", "u*", ["rtl.v1"]), (2, "OC6505", "*", None), (3, "OC7*", "*", None)], "i int, c string, o string, v array<string>")
    w = family(w, "waivers", waiver_index=F.col("i"), code=F.col("c"), object_pattern=F.col("o"), views=F.col("v"))
    return checks.waived(diagnosed(spark, sf), w, date(2026, 1, 1)).select("message", "waiver")


@query(f"WITH {EVENTS} SELECT CASE code WHEN 'OC2002' THEN 'fatal' ELSE 'warning' END AS severity, count(*) AS n_active, 0::BIGINT AS n_waived FROM e GROUP BY 1")
def report_summary(spark, sf):
    return checks.summary(diagnosed(spark, sf).withColumn("waiver", F.lit(None).cast("int")))


@query("""WITH v AS (SELECT c_custkey AS k, ['signal', 'clock', 'power', 'ground', 'reset', 'analog'][list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) % 6 + 1] AS r FROM customer)
    SELECT 'added' AS state, count(*) AS n FROM v WHERE k % 7 = 0 UNION ALL SELECT 'removed', count(*) FROM v WHERE k % 5 = 0 AND k % 7 <> 0 UNION ALL SELECT 'changed', count(*) FROM v WHERE k % 7 <> 0 AND k % 5 <> 0 AND k % 3 = 0""")
def contract_diff(spark, sf):
    whole = review.build_contract(customer_facts(spark, sf)).withColumn("k", F.substring("port", 2, 20).cast("long"))
    before, after = whole.where("k % 7 != 0").drop("k"), whole.where("k % 5 != 0 OR k % 7 = 0").withColumn("digest", F.when((F.col("k") % 3 == 0) & (F.col("k") % 7 != 0), F.sha2("digest", 256)).otherwise(F.col("digest"))).drop("k")
    return review.contract_diff(before, after).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n, sha256(string_agg(c_name, ',' ORDER BY c_name)) AS digest FROM customer GROUP BY ALL""")
def snapshot_digest(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return c.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("c_name")), ","), 256).alias("digest"))


# ---------------------------------------------------------------- names and files


@query("""SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'inout' WHEN 2 THEN 'feedthrough' ELSE 'unknown' END AS direction, CASE p_size % 3 WHEN 0 THEN 'power' WHEN 1 THEN 'clock' ELSE 'unknown' END AS role,
    CASE p_size % 2 WHEN 0 THEN 'readonly' ELSE 'writeonce' END AS access, lower(split_part(p_name, ' ', 1)) AS register FROM part""")
def name_normalisation(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), names.direction(pick(s, " In ", "BI-DIR", "feed_thru", "sideways")).alias("direction"), names.role(pick(s, "Primary-Power", "CLK", "?")).alias("role"),
        names.access(pick(s, "R-O", "write_once")).alias("access"), names.register_name(F.concat(F.lit("\\"), F.substring_index("p_name", " ", 1), F.lit("_REG "))).alias("register"),
    )


@query("""SELECT n_nationkey AS k, unnest([n_name || '.x', n_name || '/x', 'top/' || n_name || '.x', 'top/' || n_name || '/x', 'top.' || n_name || '.x', 'top.' || n_name || '/x']) AS variant FROM nation WHERE false
    UNION ALL SELECT n_nationkey, unnest(['n' || n_nationkey || '/x', 'n' || n_nationkey || '.x', 'top/n' || n_nationkey || '/x', 'top/n' || n_nationkey || '.x', 'top.n' || n_nationkey || '.x']) FROM nation""")
def name_variants(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.explode(names.variants(F.concat(F.lit("n"), "n_nationkey", F.lit(".x")), F.lit("top"))).alias("variant"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ground' WHEN 1 THEN 'power' WHEN 2 THEN 'clock' WHEN 3 THEN 'reset' WHEN 4 THEN 'clock' ELSE 'unknown' END AS role FROM events""")
def role_hints(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", names.role_from_name(pick(F.col("event_id"), "VSS_core", "vdda", "core/CLK-in", "u_rstn", "clock", "data")).alias("role"))


@query("""WITH g AS (SELECT * FROM (VALUES (0, 'r2', 1), (1, 'r1', 1), (2, 'r2', 0)) AS t(o, p, m)), f AS (SELECT 'f' || n_nationkey || '.r' || n_regionkey AS path, n_regionkey AS r FROM nation),
    h AS (SELECT o, path FROM g JOIN f ON 'r' || r = p) SELECT path, min(o)::INT AS pattern FROM h GROUP BY path""")
def glob_order(spark, sf):
    """Files in the order of the patterns that list them, each once."""
    f = table(spark, sf, "nation").select(F.concat(F.lit("f"), "n_nationkey", F.lit(".r"), "n_regionkey").alias("path"))
    g = spark.createDataFrame([(0, "*.r2"), (1, "f*.r1"), (2, "f?*.r2")], "pattern int, glob string")
    return generic.first_match(f, g, names.glob(F.col("path"), F.col("glob")), "pattern", ["path"])


@query()
def similar_names(spark, sf):
    """Pairs of part names that nearly agree; tested against all pairs on a small table."""
    p = table(spark, sf, "part").select(F.lower("p_name").alias("n"), (F.col("p_partkey") % 2).alias("k")).distinct()
    sides = [p.select(F.col("n").alias(f"{s}_name"), F.col("k").alias(f"{s}_kind")) for s in "lr"]
    return rules.similar(*sides, [], 0.92).select("l_name", "r_name", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- further rules on whole tables


def part_ports(spark, sf, view: str, where: str = "true", **columns) -> DataFrame:
    p = table(spark, sf, "part").where(where)
    own = dict(view=F.lit(view), kind=F.lit(view.split(".")[0]), component=F.lit("top"), native_name=F.concat(F.lit("p"), "p_partkey"), status=F.lit("known"), direction=F.lit("input"), width=F.lit(1), source=F.lit(view), line=F.lit(1), column=F.lit(1))
    return family(p, "ports", **own | columns)


def one_top(spark, *named: str) -> DataFrame:
    return family(spark.createDataFrame([(v,) for v in named], "v string"), "components", view=F.col("v"), kind=F.substring_index("v", ".", 1), native_name=F.lit("top"))


@query("SELECT 'OC3103' AS code, 'component:top/port:p' || p_partkey AS object_id FROM part WHERE p_size % 10 = 0")
def duplicate_pin_rules(spark, sf):
    ports = part_ports(spark, sf, "rtl.a").union(part_ports(spark, sf, "rtl.a", "p_size % 10 = 0", line=F.lit(2)))
    return rules.duplicate_pins(Facts(spark, {"views": views(spark, "rtl.a"), "components": one_top(spark, "rtl.a"), "ports": ports})).select("code", "object_id")


@query("SELECT 'OC4106' AS code, 'component:top/port:p' || p_partkey AS object_id FROM part WHERE p_size % 4 = 1")
def scalar_vector_rules(spark, sf):
    a = part_ports(spark, sf, "rtl.a", explicit_scalar=F.lit(True))
    b = part_ports(spark, sf, "lef.b", explicit_scalar=F.col("p_size") % 4 != 1, packed=F.when(F.col("p_size") % 4 == 1, F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("right")))))
    found = rules.port_conflicts(Facts(spark, {"views": views(spark, "rtl.a", "lef.b"), "components": one_top(spark, "rtl.a", "lef.b"), "ports": a.union(b)}))
    return found.where("code = 'OC4106'").select("code", "object_id")


@query("SELECT 'OC3102' AS code, 'component:top/port:p' || p_partkey AS object_id FROM part WHERE p_size % 6 = 0")
def contract_pin_rules(spark, sf):
    """Every sixth part is a pin that the frozen contract does not have."""
    frozen = family(table(spark, sf, "part").where("p_size % 6 != 0"), "contract_ports", component=F.lit("top"), port=F.concat(F.lit("p"), "p_partkey"), direction=F.lit("input"), width=F.lit(1))
    f = Facts(spark, {"views": views(spark, "rtl.a"), "components": one_top(spark, "rtl.a"), "ports": part_ports(spark, sf, "rtl.a"), "contract_ports": frozen})
    return rules.pin_inventory(f).where("code = 'OC3102'").select("code", "object_id")


@query("SELECT 'OC3002' AS code, 'component:s' || s_suppkey AS object_id FROM supplier WHERE s_suppkey % 4 = 1")
def contract_component_rules(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("s"), "s_suppkey")
    frozen = family(s.where("s_suppkey % 4 != 1"), "contract_ports", component=name, port=F.lit("a"))
    comps = family(s, "components", view=F.lit("rtl.a"), kind=F.lit("rtl"), native_name=name)
    return rules.component_inventory(Facts(spark, {"views": views(spark, "rtl.a"), "components": comps, "contract_ports": frozen})).where("code = 'OC3002'").select("code", "object_id")


@query("""SELECT CASE WHEN p_size % 3 = 1 THEN 'OC4301' ELSE 'OC4303' END AS code, 'component:c' || p_partkey || CASE WHEN p_size % 3 = 1 THEN '/port:y' ELSE '/port:y' END AS object_id FROM part WHERE p_size % 3 > 0""")
def function_rules(spark, sf):
    """A library and the RTL of each part: equal but for the order, different, or with a pin that nobody has."""
    p, name = table(spark, sf, "part"), F.concat(F.lit("c"), "p_partkey")
    size = F.col("p_size") % 3
    expression = F.when(size == 2, "a & zz | a & !zz & b | a & !b").otherwise("a & b")
    lib = family(p, "functions", view=F.lit("liberty.tt"), kind=F.lit("liberty"), component=name, output=F.lit("y"), expression=expression)
    rtl = family(p, "functions", view=F.lit("rtl.a"), kind=F.lit("rtl"), component=name, output=F.lit("y"), expression=F.when(size == 0, "b & a").when(size == 1, "a | b").otherwise("a"))
    comps = [family(p, "components", view=F.lit(v), kind=F.lit(v.split(".")[0]), native_name=name) for v in ("liberty.tt", "rtl.a")]
    pins = p.withColumn("pin", F.explode(F.array(*map(F.lit, "aby"))))
    ports = [family(pins, "ports", view=F.lit(v), kind=F.lit(v.split(".")[0]), component=name, native_name=F.col("pin"), status=F.lit("known")) for v in ("liberty.tt", "rtl.a")]
    f = Facts(spark, {"views": views(spark, "liberty.tt", "rtl.a"), "components": comps[0].union(comps[1]), "ports": ports[0].union(ports[1]), "functions": lib.union(rtl)})
    return rules.functions(f).select("code", "object_id")


@query("""SELECT code, 'register:chip/r' || o_orderkey || '/field:f' AS object_id FROM orders, (VALUES ('OC6305', 5), ('OC6308', 3)) AS t(code, every) WHERE o_orderkey % every = 0""")
def register_field_rules(spark, sf):
    """Every fifth order's field lies elsewhere in the second view, every third one resets to something else."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")

    def side(view: str, offset, reset):
        f = F.array(F.struct(F.lit("F").alias("name"), offset.cast("int").alias("bit_offset"), F.lit(2).alias("bit_width"), F.lit("rw").alias("access"), reset.cast("decimal(38,0)").alias("reset"), F.lit("known").alias("status")))
        return dict(view=F.lit(view), kind=F.lit(view.split(".")[0]), component=F.lit("chip"), native_name=F.concat(F.lit("R"), k.cast("string")), memory_map=F.lit("m"), address_offset=k * 4, size_bits=F.lit(32), access=F.lit("rw"), status=F.lit("known"), ordinal=F.lit(1), fields=f)

    a, b = side("ipxact.a", F.lit(0), F.lit(0)), side("systemrdl.b", F.when(k % 5 == 0, 4).otherwise(0), F.when(k % 3 == 0, 1).otherwise(0))
    return rules.register_rules(Facts(spark, {"registers": both(o, "registers", a, b)})).select("code", "object_id")


@query("""SELECT DISTINCT 'OC5002' AS code, 'package-ball:b' || s_suppkey AS object_id FROM supplier WHERE s_suppkey % 3 = 0""")
def package_signal_rules(spark, sf):
    """Balls by supplier, each with a signal of its own; the chip lacks every third one."""
    s = table(spark, sf, "supplier")
    rows = family(s, "pin_mappings", view=F.lit("csv.package"), kind=F.lit("csv"), die_pad=F.concat(F.lit("d"), "s_suppkey"), package_ball=F.concat(F.lit("b"), "s_suppkey"), signal=F.concat(F.lit("s"), "s_suppkey"), component=F.lit("top"))
    ports = family(s.where("s_suppkey % 3 != 0"), "ports", view=F.lit("rtl.a"), kind=F.lit("rtl"), component=F.lit("top"), native_name=F.concat(F.lit("s"), "s_suppkey"), status=F.lit("known"), direction=F.lit("input"), width=F.lit(1))
    f = Facts(spark, {"views": views(spark, "csv.package", "rtl.a"), "components": one_top(spark, "rtl.a"), "ports": ports, "pin_mappings": rows})
    return rules.package_rules(f).where("code = 'OC5002'").select("code", "object_id")
