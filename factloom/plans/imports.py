"""Queries that read generated files through the importers: text made from the driver's tables, and the same rows in SQL.

A file is one design, so it is written as one; its text is made by Spark and its size follows the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import rules
from factloom.operators.rules import Facts
from factloom.operators.shared import shared_folder
from factloom.sources.reader import Source, observe

IMPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
IMPORTS_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        IMPORTS[f.__name__], IMPORTS_SQL[f.__name__] = f, sql
        return f

    return register


def written(spark: SparkSession, sf: str, table: str, line: str, head: str = "", tail: str = "") -> str:
    """A file of one line (an SQL expression) for each row of a table, in the order of its first column; its path."""
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    lines = rows.select(F.lit(1).alias("part"), F.col(rows.columns[0]).alias("key"), F.expr(line).alias("value")).where("value IS NOT NULL")
    ends = spark.createDataFrame([(0, head), (2, tail)], "part int, value string").select("part", F.lit(None).cast(lines.schema["key"].dataType).alias("key"), "value")
    path = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    # One task sorts, on disk where memory does not hold the rows, and writes row by row.
    lines.unionAll(ends).repartition(1).sortWithinPartitions("part", "key", "value").select("value").write.text(path)
    return f"{path}/*.txt"


CHIP = ("module chip(input zz", ");\nendmodule")


def chip_and(spark, sf, view: str, format: str, path: str) -> dict[str, DataFrame]:
    """A view beside the RTL of a chip with a port and an instance for two suppliers in three."""
    line = "CASE WHEN s_suppkey % 3 <> 0 THEN concat(', input p', s_suppkey) ELSE '' END"
    rtl = written(spark, sf, "supplier", line, *CHIP)
    cells = written(spark, sf, "supplier", "CASE WHEN s_suppkey % 3 <> 0 THEN concat('CELL u', s_suppkey, ' (.A(x));') ELSE '' END", "module core(input x);", "endmodule")
    return observe(spark, [Source("rtl.default", [rtl, cells], "verilog"), Source(view, [path], format)])


def read(spark: SparkSession, view: str, format: str, path: str, **options) -> dict[str, DataFrame]:
    return observe(spark, [Source(view, [path], format, options)])


PART_CELLS = """SELECT 'c' || p_partkey AS component, n AS native_name, d AS direction, w AS width FROM part, (VALUES ('a', 'input', 1, 1), ('y', 'output', 1, 1), ('d', 'input', 4, 3)) AS t(n, d, w, every) WHERE p_partkey % every = 0"""


@query(PART_CELLS)
def liberty_import(spark, sf):
    line = """concat('cell(c', p_partkey, ') { pin(a) { direction : input; } pin(y) { direction : output; function : "!a"; }', CASE WHEN p_partkey % 3 = 0 THEN ' bus(d) { bus_type : b4; direction : input; }' ELSE '' END, ' }')"""
    path = written(spark, sf, "part", line, "library(l) { type(b4) { base_type : array; bit_from : 3; bit_to : 0; }", "}")
    return read(spark, "liberty.tt", "liberty", path)["ports"].select("component", "native_name", "direction", "width")


@query("SELECT 'c' || p_partkey AS component, 'y' AS output, '!a' AS expression FROM part")
def liberty_functions(spark, sf):
    path = written(spark, sf, "part", """concat('cell(c', p_partkey, ') { pin(a) { direction : input; } pin(y) { direction : output; function : "!a"; } }')""", "library(l) {", "}")
    return read(spark, "liberty.tt", "liberty", path)["functions"].select("component", "output", "expression")


@query("""SELECT 'c' || p_partkey AS component, n AS native_name, d AS direction, w AS width FROM part, (VALUES ('clk', 'input', 1, 1), ('q', 'output', 2, 2), ('VDD', 'inout', 1, 1)) AS t(n, d, w, every) WHERE p_partkey % every = 0""")
def lef_import(spark, sf):
    bits = r"'  PIN q[0]\n    DIRECTION OUTPUT ;\n  END q[0]\n  PIN q[1]\n    DIRECTION OUTPUT ;\n  END q[1]\n'"
    line = rf"concat('MACRO c', p_partkey, '\n  PIN clk\n    DIRECTION INPUT ;\n    USE CLOCK ;\n  END clk\n', CASE WHEN p_partkey % 2 = 0 THEN {bits} ELSE '' END, '  PIN VDD\n    DIRECTION INOUT ;\n    USE POWER ;\n  END VDD\nEND c', p_partkey)"
    return read(spark, "lef.default", "lef", written(spark, sf, "part", line, "VERSION 5.8 ;", "END LIBRARY"))["ports"].select("component", "native_name", F.lower("direction").alias("direction"), "width")


@query("""SELECT 'm' || s_nationkey AS component, 's' || s_suppkey AS native_name, CASE s_suppkey % 2 WHEN 0 THEN 'in' ELSE 'out' END AS direction, 1 AS width FROM supplier""")
def csv_pins_import(spark, sf):
    path = written(spark, sf, "supplier", "concat_ws(';', concat('m', s_nationkey), concat('s', s_suppkey), CASE s_suppkey % 2 WHEN 0 THEN 'in' ELSE 'out' END)", "Cell;Pin Name;Dir")
    return read(spark, "csv.pins", "csv", path)["ports"].select("component", "native_name", "direction", "width")


@query("""SELECT 'P' || s_suppkey AS die_pad, 'B' || s_suppkey // 2 AS package_ball, CASE WHEN s_suppkey % 7 <> 0 THEN 's' || s_nationkey END AS signal FROM supplier""")
def csv_package_import(spark, sf):
    path = written(spark, sf, "supplier", "concat_ws(',', concat('P', s_suppkey), concat('B', s_suppkey div 2), CASE WHEN s_suppkey % 7 <> 0 THEN concat('s', s_nationkey) ELSE '' END)", "Pad,Ball,Signal")
    return read(spark, "csv.package", "csv", path)["pin_mappings"].select("die_pad", "package_ball", "signal")


@query("""SELECT 'r' || n_nationkey AS id, 'top/i' || n_nationkey AS source, 'top/o[' || n_regionkey || ':0]' AS sink, CASE WHEN n_nationkey % 2 = 0 THEN 'reachable' ELSE 'unreachable' END AS expectation, 'any' AS transform, len(['top/w', 'top/v']) AS n_through FROM nation""")
def connectivity_import(spark, sf):
    line = "concat_ws(',', concat('r', n_nationkey), concat('top/i', n_nationkey), concat('top/o[', n_regionkey, ':0]'), CASE WHEN n_nationkey % 2 = 0 THEN 'reachable' ELSE 'unreachable' END, 'any', 'top/w;top/v')"
    q = read(spark, "connectivity.default", "connectivity", written(spark, sf, "nation", line, "id,source,sink,expect,transform,through"))["requirements"]
    return q.select("id", "source", "sink", "expectation", "transform", F.size("through").cast("long").alias("n_through"))


REGISTERS = "SELECT 'R' || s_suppkey AS native_name, (256 + s_suppkey * 4)::BIGINT AS address, 32 AS size_bits, 'F' AS field, (s_suppkey % 8)::INT AS bit_offset, 2 AS bit_width FROM supplier"


def register_rows(df: DataFrame) -> DataFrame:
    f = F.explode("fields").alias("f")
    return df.select("native_name", F.coalesce("absolute_address", "address_offset").cast("long").alias("address"), "size_bits", f).select("native_name", "address", "size_bits", F.col("f.name").alias("field"), "f.bit_offset", "f.bit_width")


@query(REGISTERS)
def ipxact_import(spark, sf):
    line = "concat('<register><name>R', s_suppkey, \"</name><addressOffset>'h\", hex(s_suppkey * 4), '</addressOffset><size>32</size><field><name>F</name><bitOffset>', s_suppkey % 8, '</bitOffset><bitWidth>2</bitWidth></field></register>')"
    head = '<component xmlns="http://www.accellera.org/XMLSchema/IPXACT/1685-2014"><name>regs</name><memoryMaps><memoryMap><name>m</name><addressBlock><name>b</name><baseAddress>0x100</baseAddress>'
    return register_rows(read(spark, "ipxact.r", "ipxact", written(spark, sf, "supplier", line, head, "</addressBlock></memoryMap></memoryMaps></component>"))["registers"])


@query(REGISTERS)
def systemrdl_import(spark, sf):
    line = "concat('reg { field { sw = rw; } F[', s_suppkey % 8 + 1, ':', s_suppkey % 8, ']; } R', s_suppkey, ' @ 0x', hex(256 + s_suppkey * 4), ';')"
    return register_rows(read(spark, "systemrdl.r", "systemrdl", written(spark, sf, "supplier", line, "addrmap regs {", "};"))["registers"])


@query("SELECT 'R' || s_suppkey AS native_name, (256 + s_suppkey * 4)::BIGINT AS address, (s_suppkey % 8)::INT AS bit_offset, 2 AS bit_width FROM supplier")
def header_import(spark, sf):
    line = r"concat('#define REGS_R', s_suppkey, '_OFFSET (0x100 + ', s_suppkey, ' * 4)\n#define REGS_R', s_suppkey, '_F_SHIFT ', s_suppkey % 8, '\n#define REGS_R', s_suppkey, '_F_WIDTH 2')"
    r = read(spark, "header.r", "header", written(spark, sf, "supplier", line), component_name="regs")["registers"]
    return r.select(F.upper("native_name").alias("native_name"), F.coalesce("absolute_address", "address_offset").cast("long").alias("address"), F.explode("fields").alias("f")).select("native_name", "address", "f.bit_offset", "f.bit_width")


@query("SELECT 'c' || s_suppkey AS native_name, (s_suppkey % 9 + 1)::DOUBLE AS period, 'p' || s_suppkey AS target FROM supplier")
def sdc_clocks_import(spark, sf):
    path = written(spark, sf, "supplier", "concat('create_clock -name c', s_suppkey, ' -period ', s_suppkey % 9 + 1, ' [get_ports p', s_suppkey, ']')")
    return read(spark, "sdc.default", "sdc", path)["clocks"].select("native_name", "period", F.explode("targets").alias("target"))


@query("""SELECT 'power_domain' AS object_kind, 'PD' || n_nationkey AS native_name FROM nation UNION ALL SELECT 'supply_net', 'V' || n_nationkey FROM nation UNION ALL SELECT 'supply_net', 'V' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0""")
def upf_import(spark, sf):
    line = r"concat('create_power_domain PD', n_nationkey, '\ncreate_supply_net V', n_nationkey, ' -domain PD', n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN concat('\ncreate_supply_net V', n_nationkey, ' -domain PD', n_nationkey) ELSE '' END)"
    o = read(spark, "upf.default", "upf", written(spark, sf, "nation", line))["objects"]
    return o.where("relation = 'definition'").select("object_kind", "native_name")


@query("SELECT 'OC6104' AS code, 'upf:upf.default:supply_net:V' || n_nationkey AS object_id FROM nation WHERE n_nationkey % 5 = 0")
def upf_definition_rules(spark, sf):
    line = r"concat('create_power_domain PD', n_nationkey, '\ncreate_supply_net V', n_nationkey, ' -domain PD', n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN concat('\ncreate_supply_net V', n_nationkey, ' -domain PD', n_nationkey) ELSE '' END)"
    return rules.upf_definitions(Facts(spark, read(spark, "upf.default", "upf", written(spark, sf, "nation", line)))).where("code = 'OC6104'").select("code", "object_id")


@query("SELECT 's' || s_suppkey AS component, n AS native_name, d AS direction FROM supplier, (VALUES ('a', 'input'), ('y', 'output')) AS t(n, d)")
def cdl_import(spark, sf):
    line = r"concat('.SUBCKT s', s_suppkey, ' a\n+ y\n*.PININFO a:I y:O\nM1 y a 0 0 nch\n.ENDS')"
    return read(spark, "cdl.default", "cdl", written(spark, sf, "supplier", line, "* netlist"))["ports"].select("component", "native_name", F.lower("direction").alias("direction"))


@query("""SELECT 'instance' AS object_kind, 'u' || s_suppkey AS native_name FROM supplier""")
def def_components_import(spark, sf):
    path = written(spark, sf, "supplier", "concat('- u', s_suppkey, ' INV + PLACED ( 0 0 ) N ;')", "VERSION 5.8 ;\nDESIGN chip ;\nCOMPONENTS 1 ;", "END COMPONENTS\nEND DESIGN")
    return read(spark, "def.default", "def", path)["objects"].where("relation = 'reference'").select("object_kind", "native_name")


@query("""SELECT 'chip' AS component, 'p' || s_suppkey AS native_name, CASE s_suppkey % 2 WHEN 0 THEN 'input' ELSE 'output' END AS direction, 1 AS width FROM supplier""")
def def_pins_import(spark, sf):
    path = written(spark, sf, "supplier", "concat('- p', s_suppkey, ' + NET p', s_suppkey, ' + DIRECTION ', CASE s_suppkey % 2 WHEN 0 THEN 'INPUT' ELSE 'OUTPUT' END, ' ;')", "VERSION 5.8 ;\nDESIGN chip ;\nPINS 1 ;", "END PINS\nEND DESIGN")
    return read(spark, "def.default", "def", path)["ports"].select("component", "native_name", "direction", "width")


@query("""SELECT 'net' AS object_kind, 'n' || s_suppkey AS native_name FROM supplier UNION ALL SELECT 'pin', 'u' || s_suppkey || '/Y' FROM supplier UNION ALL SELECT 'port', 'n' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0""")
def def_nets_import(spark, sf):
    line = "concat('- n', s_suppkey, ' ( u', s_suppkey, ' Y )', CASE WHEN s_suppkey % 3 = 0 THEN concat(' ( PIN n', s_suppkey, ' )') ELSE '' END, ' ;')"
    path = written(spark, sf, "supplier", line, "VERSION 5.8 ;\nDESIGN chip ;\nSPECIALNETS 1 ;", "END SPECIALNETS\nEND DESIGN")
    return read(spark, "def.default", "def", path)["objects"].where("relation = 'reference'").select("object_kind", "native_name")


#: Each nation has a cell between its own ports: every second one inverts, every fifth is not connected, every seventh has a gate.
NETLIST_HEAD = "module cell1(input a, output y); wire t; buf (t, a); assign y = t; endmodule\nmodule cell2(input a, output y); wire t; not (t, a); cell1 u(.a(t), .y(y)); endmodule"
NETLIST_LINE = r"""concat('module block', n_nationkey, '(input [1:0] i, output [1:0] o, input e);\n', CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 7 = 0 THEN 'and (o[0], i[0], e);' WHEN n_nationkey % 2 = 0 THEN 'cell2 u0(.a(i[0]), .y(o[0]));' ELSE 'cell1 u0(i[0], o[0]);' END, '\nassign o[1] = i[1];\nendmodule')"""


def netlist(spark, sf):
    return read(spark, "rtl.default", "verilog", written(spark, sf, "nation", NETLIST_LINE, NETLIST_HEAD))


@query("SELECT 'block' || n_nationkey AS component, n AS native_name, d AS direction, w AS width FROM nation, (VALUES ('i', 'input', 2), ('o', 'output', 2), ('e', 'input', 1)) AS t(n, d, w)")
def rtl_ports_import(spark, sf):
    return netlist(spark, sf)["ports"].where("component LIKE 'block%'").select("component", "native_name", "direction", "width")


@query("""WITH n AS (SELECT n_nationkey AS k, 'block' || n_nationkey || '/' AS b, CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 7 = 0 THEN 3 WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS cell FROM nation),
    e AS (SELECT * FROM (VALUES (1, 'i[0]', 'u0/a', false), (1, 'u0/a', 'u0/t', false), (1, 'u0/t', 'u0/y', false), (1, 'u0/y', 'o[0]', false),
        (2, 'i[0]', 'u0/a', false), (2, 'u0/a', 'u0/t', true), (2, 'u0/t', 'u0/u/a', false), (2, 'u0/u/a', 'u0/u/t', false), (2, 'u0/u/t', 'u0/u/y', false), (2, 'u0/u/y', 'u0/y', false), (2, 'u0/y', 'o[0]', false),
        (3, 'i[0]', 'o[0]', NULL), (3, 'e', 'o[0]', NULL), (9, 'i[1]', 'o[1]', false)) AS t(cell, a, z, inverted))
    SELECT b || a AS source, b || z AS sink, inverted, CASE WHEN inverted IS NULL THEN 'tainted' ELSE 'known' END AS status FROM n JOIN e ON e.cell = n.cell OR e.cell = 9""")
def rtl_graph_import(spark, sf):
    return netlist(spark, sf)["edges"].select("source", "sink", "inverted", "status")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), x AS (SELECT 'path' || k AS id, CASE WHEN k % 5 = 0 THEN 'OC6503' WHEN k % 7 = 0 THEN 'OC6505' WHEN k % 2 = 0 THEN 'OC6508' END AS code FROM n
        UNION ALL SELECT 'cross' || k, 'OC6503' FROM n UNION ALL SELECT 'never' || k, 'OC6504' FROM n UNION ALL SELECT 'lost' || k, 'OC6501' FROM n WHERE k % 4 = 0
        UNION ALL SELECT 'turned' || k, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'OC6503' ELSE 'OC6507' END FROM n UNION ALL SELECT 'wide' || k, 'OC6506' FROM n WHERE k % 3 = 0)
    SELECT code, 'connectivity:' || id AS object_id FROM x WHERE code IS NOT NULL""")
def connectivity_rules(spark, sf):
    """Requirements on the generated hierarchy, judged with the rule's own bounds: missing, tainted, inverted, wrong bit, forbidden."""
    facts = netlist(spark, sf)
    k = F.col("n_nationkey").cast("string")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    port = lambda x: F.concat(F.lit("block"), k, F.lit("/" + x))
    kinds = [("path", "i[0]", "o[0]", "reachable", "identity", F.lit(True)), ("cross", "e", "o[1]", "reachable", "any", F.lit(True)), ("never", "i[1]", "o[1]", "unreachable", "any", F.lit(True)), ("lost", "i[0]", "nope", "reachable", "any", F.col("n_nationkey") % 4 == 0), ("turned", "i", "o", "reachable", "reverse", F.lit(True)), ("wide", "i", "e", "reachable", "identity", F.col("n_nationkey") % 3 == 0)]
    none = F.array().cast("array<string>")
    rows = [n.where(some).select(F.concat(F.lit(name), k).alias("id"), port(a).alias("source"), port(b).alias("sink"), F.lit(e).alias("expectation"), F.lit(t).alias("transform"), none.alias("through"), none.alias("exclude"), (F.col("n_nationkey") * 10 + j).alias("ordinal")) for j, (name, a, b, e, t, some) in enumerate(kinds)]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.union(r)
    return rules.connectivity_rules(Facts(spark, facts | {"requirements": whole})).select("code", "object_id")


# ---------------------------------------------------------------- references of constraints into the RTL


@query("SELECT 'OC6001' AS code, 'reference:sdc.default:port:p' || s_suppkey AS object_id FROM supplier WHERE s_suppkey % 3 = 0")
def sdc_reference_rules(spark, sf):
    path = written(spark, sf, "supplier", "concat('set_input_delay 1 [get_ports p', s_suppkey, ']')")
    return rules.references(Facts(spark, chip_and(spark, sf, "sdc.default", "sdc", path))).where("code != 'OC1105'").select("code", "object_id").distinct()


@query("SELECT 'OC6101' AS code, 'reference:upf.default:instance:u' || s_suppkey AS object_id FROM supplier WHERE s_suppkey % 3 = 0")
def upf_reference_rules(spark, sf):
    path = written(spark, sf, "supplier", "concat('create_power_domain PD', s_suppkey, ' -elements {u', s_suppkey, '}')")
    return rules.references(Facts(spark, chip_and(spark, sf, "upf.default", "upf", path))).where("code != 'OC1105'").select("code", "object_id").distinct()


@query("SELECT 'OC6401' AS code, 'reference:def.default:instance:u' || s_suppkey AS object_id FROM supplier WHERE s_suppkey % 3 = 0")
def def_reference_rules(spark, sf):
    path = written(spark, sf, "supplier", "concat('- u', s_suppkey, ' INV ;')", "VERSION 5.8 ;\nDESIGN chip ;\nCOMPONENTS 1 ;", "END COMPONENTS\nEND DESIGN")
    return rules.references(Facts(spark, chip_and(spark, sf, "def.default", "def", path))).where("code != 'OC1105'").select("code", "object_id").distinct()


@query("SELECT 'OC6003' AS code, 'component:chip/port:p' || s_suppkey AS object_id FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0")
def clock_target_rules(spark, sf):
    """Clocks on ports whose library says that they are signals; every second one says clock."""
    path = written(spark, sf, "supplier", "concat('create_clock -name c', s_suppkey, ' -period 2 [get_ports p', s_suppkey, ']')")
    lib = written(spark, sf, "supplier", "concat('pin(p', s_suppkey, ') { direction : input; ', CASE WHEN s_suppkey % 2 = 1 THEN 'clock : true; ' ELSE 'clock : false; ' END, '}')", "library(l) { cell(chip) {", "} }")
    facts = chip_and(spark, sf, "sdc.default", "sdc", path)
    lib_facts = read(spark, "liberty.tt", "liberty", lib)
    roles = lib_facts["ports"].withColumn("role", F.coalesce("role", F.lit("signal"))).join(facts["ports"].where("component = 'chip'").select("native_name"), "native_name", "left_semi")
    both = {n: facts[n].unionByName(roles.select(facts[n].columns) if n == "ports" else lib_facts[n]) for n in ("views", "components", "ports")}
    return rules.clock_rules(Facts(spark, facts | both)).where("code = 'OC6003'").select("code", "object_id").distinct()
