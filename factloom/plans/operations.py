"""Queries of the operators that work on whole reports, contracts and graphs, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import digests, incremental, order, patterns, rules
from factloom.operators.rules import Facts

from .queries import TREE, family, found, one_top, part_ports, pick, table, tree, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- patterns

#: Each order has a pattern made from a part's name, in one of seven ways.
PATTERNS = """n AS (SELECT p_partkey AS k, p_name AS name FROM part), top AS (SELECT max(p_partkey) AS m FROM part),
    p AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN substr(name, 1, 5) || '*' WHEN 1 THEN '*' || right(name, 5) WHEN 2 THEN '*' || substr(name, 3, 6) || '*'
        WHEN 3 THEN '?' || substr(name, 2, 4) || '*' || right(name, 2) WHEN 4 THEN '[abc]*' || right(name, 4) WHEN 5 THEN name ELSE '*' || substr(name, 2, 2) || '?' || substr(name, 5, 3) || '*' END AS pattern
        FROM orders, top JOIN n ON n.k = o_orderkey % m + 1)"""


def order_patterns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("name"))
    top = n.agg(F.max("n").alias("m"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).join(F.broadcast(top)).withColumn("n", F.col("k") % F.col("m") + 1).join(n, "n")
    cut = lambda a, b: F.substring("name", a, b)
    any = F.lit("*")
    made = [F.concat(cut(1, 5), any), F.concat(any, F.right("name", F.lit(5))), F.concat(any, cut(3, 6), any), F.concat(F.lit("?"), cut(2, 4), any, F.right("name", F.lit(2))), F.concat(F.lit("[abc]*"), F.right("name", F.lit(4))), F.col("name"), F.concat(any, cut(2, 2), F.lit("?"), cut(5, 3), any)]
    pattern = F.coalesce(*[F.when(F.col("k") % 7 == k, x) for k, x in enumerate(made)])
    return o.select("k", pattern.alias("pattern")), n.select("name")


@query(f"WITH {PATTERNS} SELECT p.k, p.pattern, count(DISTINCT n.name) AS n_names FROM p JOIN n ON n.name GLOB p.pattern GROUP BY ALL")
def pattern_index(spark: SparkSession, sf: str) -> DataFrame:
    """Of every order's pattern the number of part names that it matches."""
    p, n = order_patterns(spark, sf)
    hits = patterns.matched(p, n, []).groupBy("pattern").agg(F.count("*").alias("n_names"))
    return p.join(hits, "pattern").select("k", "pattern", "n_names")


# ---------------------------------------------------------------- order


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT s AS t, 0 AS layer FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT e.t, layer + 1 FROM w JOIN e ON e.s = w.t)
    SELECT t::VARCHAR AS node, max(layer)::BIGINT AS layer, NULL::VARCHAR AS cycle FROM w GROUP BY t""")
def tree_layers(spark: SparkSession, sf: str) -> DataFrame:
    return order.layers(tree(spark, sf))


#: Each customer leads to others with larger keys; some lead 30 back and are led to from there, which makes cycles.
GRAPH = """m AS (SELECT max(c_custkey) AS m FROM customer), k AS (SELECT c_custkey AS k FROM customer),
    e AS (SELECT DISTINCT s, t FROM (SELECT k AS s, 2 * k + k % 7 AS t FROM k UNION ALL SELECT k, 3 * k + 1 FROM k WHERE k % 3 = 0 UNION ALL SELECT k, k + 1 FROM k WHERE k % 500 BETWEEN 100 AND 108
        UNION ALL SELECT k, k - 30 FROM k WHERE k % 1131 = 120 UNION ALL SELECT k, k + 30 FROM k WHERE k % 1131 = 90), m WHERE t BETWEEN 1 AND m)"""


@query(f"""WITH RECURSIVE {GRAPH}, r AS (SELECT s AS a, t AS b FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b WHERE abs(e.t - r.a) <= 100),
    c AS (SELECT r.a, least(r.a, min(r.b)) AS cycle FROM r JOIN r q ON q.a = r.b AND q.b = r.a GROUP BY r.a),
    behind AS (SELECT a AS k FROM c UNION SELECT e.t FROM behind JOIN e ON e.s = behind.k),
    w AS (SELECT k, 0 AS layer FROM k WHERE k NOT IN (SELECT t FROM e) UNION SELECT e.t, layer + 1 FROM w JOIN e ON e.s = w.k WHERE e.t NOT IN (SELECT k FROM behind))
    SELECT k.k AS node, CASE WHEN k.k IN (SELECT k FROM behind) THEN NULL ELSE max(w.layer)::BIGINT END AS layer, any_value(c.cycle) AS cycle FROM k LEFT JOIN w ON w.k = k.k LEFT JOIN c ON c.a = k.k GROUP BY k.k""")
def graph_layers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    to = F.array(2 * k + k % 7, F.when(k % 3 == 0, 3 * k + 1), F.when((k % 500).between(100, 108), k + 1), F.when(k % 1131 == 120, k - 30), F.when(k % 1131 == 90, k + 30))
    e = c.select(k.alias("source"), F.explode(to).alias("sink")).join(F.broadcast(c.agg(F.max("k").alias("m")))).where("sink BETWEEN 1 AND m")
    return order.layers(e.select("source", "sink"), c.select(k.alias("node")))


# ---------------------------------------------------------------- contracts


def contract_tables(spark: SparkSession, sf: str, later: bool = False) -> dict[str, DataFrame]:
    """Customers as components of three views, orders as edges of two; later some edges have changed, and one view has gone for another."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    named = ("rtl.v0", "rtl.v1", "lef.v3") if later else ("rtl.v0", "rtl.v1", "lef.v2")
    of = F.element_at(F.array(*map(F.lit, named)), (n % 3).cast("int") + 1)
    comps = family(c, "components", view=of, kind=F.lit("x"), native_name=F.concat(F.lit("c"), n), status=F.lit("known"))
    flip = (k % 50 == 0) if later else F.lit(False)
    o = o.where("o_orderkey % 70 != 3") if later else o
    edges = family(o, "edges", view=F.when(k % 2 == 0, "rtl.v0").otherwise("rtl.v1"), source=F.concat(F.lit("c"), "o_custkey"), sink=F.col("o_orderpriority"), inverted=flip, status=F.lit("known"))
    return {"views": views(spark, *named), "components": comps, "edges": edges}


def contract_sql(later: bool) -> str:
    gone = "lef.v3" if later else "lef.v2"
    return f"""SELECT ['rtl.v0', 'rtl.v1', '{gone}'][c_custkey % 3 + 1] AS view, 'components' AS family,
        '{{"column":null,"kind":"x","line":null,"native_name":"c' || c_custkey || '","ordinal":null,"source":null,"status":"known"}}' AS j FROM customer
    UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'rtl.v0' ELSE 'rtl.v1' END, 'edges', '{{"edge_kind":null,"inverted":' || {"(o_orderkey % 50 = 0)" if later else "'false'"} || ',"sink":"' || o_orderpriority || '","source":"c' || o_custkey || '","status":"known"}}'
        FROM orders{" WHERE o_orderkey % 70 <> 3" if later else ""}"""


def _up(level: str, below: str, digits: int, child: str, prefix: str) -> str:
    return f"{level} AS (SELECT view, family, substr({prefix}, 1, {digits}) AS p, sha256(string_agg({child}, ',' ORDER BY {child})) AS x, sum(n)::BIGINT AS n FROM {below} GROUP BY view, family, substr({prefix}, 1, {digits}))"


@query(f"""WITH m AS (SELECT view, family, sha256(j) AS d, count(*) AS n FROM ({contract_sql(False)}) GROUP BY ALL),
    {_up("l6", "m", 6, "d || ':' || n", "d")}, {_up("l4", "l6", 4, "p || ':' || x", "p")}, {_up("l2", "l4", 2, "p || ':' || x", "p")}, {_up("l0", "l2", 0, "p || ':' || x", "p")}
    SELECT view, family, x AS digest, n AS n_rows FROM l0""")
def contract_digests(spark: SparkSession, sf: str) -> DataFrame:
    return digests.contract(contract_tables(spark, sf))["families"].withColumnRenamed("rows", "n_rows")


@query(f"""WITH b AS ({contract_sql(False)}), a AS ({contract_sql(True)})
    SELECT view, family, state, count(*) AS n FROM (SELECT *, 'removed' AS state FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) GROUP BY ALL
    UNION ALL SELECT 'lef.v2', NULL, 'view removed', 1 UNION ALL SELECT 'lef.v3', NULL, 'view added', 1""")
def contract_family_changes(spark: SparkSession, sf: str) -> DataFrame:
    return digests.contract_changes(*(digests.contract(contract_tables(spark, sf, later)) for later in (False, True)))


# ---------------------------------------------------------------- incremental checks


def order_ports(spark: SparkSession, sf: str, later: bool = False) -> Facts:
    """Customers as components of three views, their orders as ports; later the second view has other directions and lacks some."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k = F.col("o_orderkey")
    named = ("rtl.a", "lef.b", "csv.c")
    comps = [family(c, "components", view=F.lit(v), kind=F.lit(v[:3]), native_name=F.concat(F.lit("c"), "c_custkey")) for v in named]
    way = {"rtl.a": F.lit("input"), "lef.b": F.when(k % 40 == 0, "output").otherwise("input") if later else F.lit("input"), "csv.c": F.when(k % 100 == 7, "output").otherwise("input")}
    ports = [family(o.where("o_orderkey % 60 != 1") if later and v == "lef.b" else o, "ports", view=F.lit(v), kind=F.lit(v[:3]), component=F.concat(F.lit("c"), "o_custkey"), native_name=F.concat(F.lit("o"), k), direction=way[v], status=F.lit("known"), width=F.lit(1)) for v in named]
    return Facts(spark, {"views": views(spark, *named), "components": comps[0].union(comps[1]).union(comps[2]), "ports": ports[0].union(ports[1]).union(ports[2])})


@query("""SELECT 'OC4001' AS code, 'component:c' || o_custkey || '/port:o' || o_orderkey AS object_id, 3::BIGINT AS n_evidence FROM orders WHERE o_orderkey % 40 = 0 OR o_orderkey % 100 = 7
    UNION ALL SELECT 'OC3101', 'component:c' || o_custkey || '/port:o' || o_orderkey, 2::BIGINT FROM orders WHERE o_orderkey % 60 = 1""")
def incremental_check(spark: SparkSession, sf: str) -> DataFrame:
    """The findings after one of three views has changed, from those before and the components that it touches."""
    before, after = order_ports(spark, sf), order_ports(spark, sf, True)
    old, _ = incremental.saved(incremental.findings(before, incremental.LOCAL))
    return found(incremental.updated(old, before, after, ["lef.b"], incremental.LOCAL))


# ---------------------------------------------------------------- rules by patterns and aliases


@query("""WITH p AS (SELECT 'p' || p_partkey AS n FROM part), q AS (SELECT c_custkey AS k, 'p' || c_custkey || '*' AS g FROM customer),
    h AS (SELECT k, count(n) AS n FROM q LEFT JOIN p ON n GLOB g GROUP BY k)
    SELECT CASE WHEN n = 0 THEN 'OC6501' ELSE 'OC6502' END AS code, 'connectivity:r' || k AS object_id FROM h WHERE n <> 1""")
def ambiguous_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer forbids a way from the one part whose number begins with its own."""
    k = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("p"), "p_partkey")
    p = table(spark, sf, "part")
    ends = family(p, "endpoints", view=F.lit("rtl.a"), native_name=name, status=F.lit("known")).union(family(spark.range(1), "endpoints", view=F.lit("rtl.a"), native_name=F.lit("q"), status=F.lit("known")))
    edges = family(p, "edges", view=F.lit("rtl.a"), source=name, sink=F.lit("z"), inverted=F.lit(False), status=F.lit("known"))
    reqs = family(table(spark, sf, "customer"), "requirements", id=F.concat(F.lit("r"), k), source=F.concat(F.lit("p"), k, F.lit("*")), sink=F.lit("q"), expectation=F.lit("unreachable"), transform=F.lit("any"), through=F.array().cast("array<string>"), exclude=F.array().cast("array<string>"), ordinal=F.col("c_custkey"))
    return rules.connectivity_rules(Facts(spark, {"views": views(spark, "rtl.a"), "endpoints": ends, "edges": edges, "requirements": reqs})).select("code", "object_id")


@query("""WITH p AS (SELECT 'p' || p_partkey AS n FROM part), r AS (SELECT DISTINCT 'p' || (o_orderkey % 3000) || '*' AS g FROM orders)
    SELECT 'OC6001' AS code, 'reference:sdc.s:port:' || g AS object_id FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE n GLOB g)""")
def glob_reference_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Constraints name ports by patterns made from orders."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey") % 3000, F.lit("*")).alias("g")).distinct()
    objects = family(o, "objects", view=F.lit("sdc.s"), kind=F.lit("sdc"), object_kind=F.lit("ports"), relation=F.lit("reference"), native_name=F.col("g"), match_mode=F.lit("glob"))
    f = Facts(spark, {"views": views(spark, "rtl.a", "sdc.s"), "components": one_top(spark, "rtl.a"), "ports": part_ports(spark, sf, "rtl.a"), "objects": objects})
    return rules.references(f).select("code", "object_id")


@query("""WITH p AS (SELECT 'p' || p_partkey AS n, p_size % 3 AS r FROM part), c AS (SELECT 'p' || s_suppkey || '?' AS g FROM supplier)
    SELECT DISTINCT 'OC6003' AS code, 'component:top/port:' || n AS object_id FROM p JOIN c ON n GLOB g WHERE r <> 1""")
def clock_pattern_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Clocks on patterns of ports, two thirds of which are no clocks."""
    c = family(table(spark, sf, "supplier"), "clocks", view=F.lit("sdc.s"), kind=F.lit("sdc"), native_name=F.concat(F.lit("c"), "s_suppkey"), period=F.lit(1.0), targets=F.array(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit("?"))))
    ports = part_ports(spark, sf, "rtl.a", role=pick(F.col("p_size"), "signal", "clock", "reset"))
    f = Facts(spark, {"views": views(spark, "rtl.a", "sdc.s"), "components": one_top(spark, "rtl.a"), "ports": ports, "clocks": c})
    return rules.clock_rules(f).where("code = 'OC6003'").select("code", "object_id").distinct()


@query("SELECT 'OC4301' AS code, 'component:c' || p_partkey || '/port:y' AS object_id FROM part WHERE p_size % 3 = 1")
def aliased_function_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The library calls the pins A1 and A2; aliases make them the a and b of the RTL."""
    p, name = table(spark, sf, "part"), F.concat(F.lit("c"), "p_partkey")
    size = F.col("p_size") % 3
    named = ("liberty.tt", "rtl.a")
    lib = family(p, "functions", view=F.lit(named[0]), kind=F.lit("liberty"), component=name, output=F.lit("y"), expression=F.lit("A1 & !A2"))
    rtl = family(p, "functions", view=F.lit(named[1]), kind=F.lit("rtl"), component=name, output=F.lit("y"), expression=F.when(size == 1, "b & !a").when(size == 0, "!b & a").otherwise("a & !(a & b)"))
    comps = [family(p, "components", view=F.lit(v), kind=F.lit(v.split(".")[0]), native_name=name) for v in named]
    pins = [p.withColumn("pin", F.explode(F.array(*map(F.lit, x)))) for x in (("A1", "A2", "y"), ("a", "b", "y"))]
    ports = [family(x, "ports", view=F.lit(v), kind=F.lit(v.split(".")[0]), component=name, native_name=F.col("pin"), status=F.lit("known")) for x, v in zip(pins, named, strict=True)]
    aliases = [family(p, "aliases", alias_kind=F.lit("port"), view_selector=F.lit("liberty.*"), component=name, native=F.lit(x), canonical=F.lit(y)) for x, y in (("A1", "a"), ("A2", "b"))]
    f = Facts(spark, {"views": views(spark, *named), "components": comps[0].union(comps[1]), "ports": ports[0].union(ports[1]), "functions": lib.union(rtl), "aliases": aliases[0].union(aliases[1])})
    return rules.functions(f).select("code", "object_id")
