"""Importers on small files of each format, and a project from files to reports."""

import json
import struct
import time
from datetime import date

import pytest

from factloom.plans import check as C
from factloom.plans import reports
from factloom.plans.project import ConfigError, Project, changed_files
from factloom.sources import layout, registers, tcl
from factloom.sources.reader import FORMATS, Source, format_of, observe, parser_of, register, run_parser

FILES = {
    "top.sv": """module chip #(parameter W = 4) (input wire clk, input [W-1:0] d, output [3:0] q, output n, output y);
  wire [3:0] t; // comment
  assign t = d;
  assign q = t;
  assign n = ~clk;
  assign y = d & clk;
  inv u1 (.A(clk), .Y(n));
endmodule
""",
    "chip.lib": """library(l) { type(b4) { base_type : array; bit_from : 3; bit_to : 0; } /* c */
  cell(chip) { pin(clk) { direction : input; clock : true; } bus(d) { bus_type : b4; direction : input; }
    bus(q) { bus_type : b4; direction : input; } pin(n) { direction : output; function : "!clk"; } pin(y) { direction : output; function : "clk + zz"; }
    pg_pin(VDD) { pg_type : primary_power; } } }
""",
    "chip.lef": """VERSION 5.8 ;
MACRO chip
  PIN clk
    DIRECTION INPUT ;
    USE CLOCK ;
  END clk
  PIN d[0]
    DIRECTION INPUT ;
  END d[0]
  PIN d[2]
    DIRECTION INPUT ;
  END d[2]
  PIN VDD
    DIRECTION INOUT ;
    USE GROUND ;
  END VDD
END chip
""",
    "balls.csv": "Pad,Ball,Signal,Component\nP1,A1,clk,chip\nP1,A2,n,chip\nP2,A2,zz,chip\n,A3,,\n",
    "pins.csv": "cell;signal;dir\nchip;clk;in\nchip;d[1];in\nchip;d[0];in\nchip;d[0];out\nbad;row\n",
    "c.sdc": 'set P 10\ncreate_clock -name c -period $P [get_ports clk]\nset_input_delay 1 -clock [get_clocks c] [get_ports {d[0] nope}]\ncreate_clock -name c -period 5 [get_ports clk]\n',
    "u.sdc": "foreach x {a} { puts $x }\nset_false_path -from [get_ports lost]\n",
    "p.upf": "create_power_domain PD -elements {u1}\ncreate_supply_net VDD -domain PD\ncreate_supply_net VDD -domain PD\nset_isolation iso -domain GONE\n",
    "r.rdl": "addrmap regs { reg { field { sw = rw; reset = 0; } EN[0:0]; field { sw = r; } ST[5:4]; } CTRL @ 0x4; reg { field {} A[3:0]; } ARR[2] @ 0x10; };\n",
    "r.xml": """<component xmlns="http://x/1685-2014"><name>regs</name><memoryMaps><memoryMap><name>m</name><addressBlock><name>b</name><baseAddress>0x100</baseAddress>
 <register><name>CTRL</name><addressOffset>'h8</addressOffset><size>32</size><field><name>EN</name><bitOffset>0</bitOffset><bitWidth>1</bitWidth></field><field><name>ST</name><bitOffset>3</bitOffset><bitWidth>2</bitWidth></field></register>
 </addressBlock></memoryMap></memoryMaps></component>""",
    "r.h": "#define REGS_CTRL_OFFSET (1 << 2)\n#define REGS_CTRL_EN_MASK 0x1u\n#define REGS_CTRL_ST_SHIFT 4\n#define REGS_CTRL_ST_WIDTH 2\n#define REGS_X_OFFSET UNKNOWN\n",
    "c.csv": "id,source,sink,expect,transform\nr1,chip/d[3:0],chip/q[3:0],reachable,identity\nr2,chip/clk,chip/n,reachable,inverted\nr3,chip/clk,chip/q[0],reachable,any\nbad,a b,c,reachable,any\n",
    "n.cdl": ".SUBCKT chip clk n\n*.PININFO clk:I n:O\nXu1 clk n\n+ inv\nQ1 a b c\n.ENDS\n",
    "f.def": "VERSION 5.8 ;\nDESIGN chip ;\nPINS 1 ;\n- clk + NET clk + DIRECTION INPUT ;\nEND PINS\nNETS 1 ;\n- n ( u1 Y ) ( PIN n ) ;\nEND NETS\nEND DESIGN\n",
}


def parsed(fmt, *names, **options):
    return list(run_parser(parser_of(fmt), [(n, FILES[n].encode()) for n in names], f"{FORMATS[fmt][0]}.x", FORMATS[fmt][0], options))


def family(found, name):
    return [r for f, r in found if f == name]


HIERARCHY = """module buf1(input a, output y); wire t; buf (t, a); assign y = t; endmodule
module inv2 #(parameter W=2) (input [W-1:0] a, output [W-1:0] y); assign y = ~a; endmodule
module top(input i, input [1:0] d, output o, output [1:0] q, output g, output z, inout p, inout r, output [2:0] j);
 wire m; wire k;
 buf1 u1 (.a(i), .y(m));
 buf1 u2 (m, o);
 inv2 #(.W(2)) u3 (.a({d[0], d[1]}), .y(q));
 inv2 u5 (.a(d), .y(j));
 and (g, i, m);
 CELLX ux (.A(i), .B(z));
 tran (p, r);
 alias k = m;
 assign j = {d, 1'b0};
endmodule
"""


def test_the_graph_goes_through_instances_and_gates():
    found = list(run_parser(parser_of("verilog"), [("t.sv", HIERARCHY.encode())], "rtl.a", "rtl", {}))
    edges = {(e["source"], e["sink"]): (e["inverted"], e["status"]) for e in family(found, "edges")}
    known = {(a, b) for (a, b), (_, status) in edges.items() if status == "known"}
    want = "i u1/a;u1/a u1/t;u1/t u1/y;u1/y m;m u2/a;u2/y o;d[0] u3/a[1];d[1] u3/a[0];u3/y[1] q[1];p r;r p;k m;m k;d[1] j[2];d[0] j[1]"
    assert {tuple(f"top/{x}" for x in pair.split()) for pair in want.split(";")} <= known
    assert edges["top/u3/a[0]", "top/u3/y[0]"] == (True, "known")
    # Gates, unknown cells and ports of another width are told, not left out.
    assert all(edges[a, b][1] == "tainted" for a, b in (("top/i", "top/g"), ("top/i", "top/ux"), ("top/ux", "top/z"), ("top/u5/y[0]", "top/j[2]")))
    assert not any("/d" in o["native_name"] for o in family(found, "objects")) and not any(a.startswith("buf1/") for a, _ in edges)


def test_recursive_modules_and_missing_ports_end():
    source = "module a(input x); b u (.x(x), .nope(x)); endmodule module b(input x); a v (.x(x)); endmodule"
    found = list(run_parser(parser_of("verilog"), [("t.sv", source.encode())], "rtl.a", "rtl", {}))
    assert not family(found, "views")[0]["complete"] and family(found, "edges")


def test_files_that_are_not_utf8_taint_their_view():
    found = list(run_parser(parser_of("verilog"), [("t.sv", b"module a(input x); // \xff\nendmodule")], "rtl.a", "rtl", {}))
    assert family(found, "views")[0]["tainted_scopes"] == ["*"] and family(found, "ports")[0]["native_name"] == "x"


def test_verilog():
    found = parsed("verilog", "top.sv")
    ports = {p["native_name"]: (p["direction"], p["width"], p["left"]) for p in family(found, "ports")}
    assert ports == {"clk": ("input", 1, None), "d": ("input", 4, 3), "q": ("output", 4, 3), "n": ("output", 1, None), "y": ("output", 1, None)}
    edges = {(e["source"], e["sink"]): (e["inverted"], e["status"]) for e in family(found, "edges")}
    assert edges["chip/d[3]", "chip/t[3]"] == (False, "known") and edges["chip/clk", "chip/n"] == (True, "known") and edges["chip/clk", "chip/y"] == (None, "tainted")
    assert {"u1", "u1/A", "u1/Y", "t"} == {o["native_name"] for o in family(found, "objects")} and family(found, "views")[0]["complete"]


@pytest.mark.parametrize("fmt", sorted(set(FORMATS) - {"gds"}))
@pytest.mark.parametrize("data", [b"", b"\xff\xfe\x00", b"{[(\"", b"module m (input a);", b"END\n", b"<!DOCTYPE x [<!ENTITY e 'e'>]><x/>", b"cell(x) {", b"a,b\n\"c"])
def test_any_bytes_end_in_a_view(fmt, data):
    found = list(run_parser(parser_of(fmt), [("f", data)], "v.x", FORMATS[fmt][0], {}))
    assert [f for f, _ in found].count("views") == 1 and json.dumps(found)


def test_liberty_and_lef():
    lib, lef = parsed("liberty", "chip.lib"), parsed("lef", "chip.lef")
    ports = {p["native_name"]: (p["direction"], p["role"], p["width"]) for p in family(lib, "ports")}
    assert ports["d"] == ("input", None, 4) and ports["clk"] == ("input", "clock", 1) and ports["VDD"] == ("inout", "primary_power", 1)
    assert {(f["output"], f["expression"]) for f in family(lib, "functions")} == {("n", "!clk"), ("y", "clk + zz")}
    assert {p["native_name"]: p["bit_indices"] for p in family(lef, "ports")}["d"] == [0, 2]


def test_tables():
    pins = parsed("csv", "pins.csv")
    d = next(p for p in family(pins, "ports") if p["native_name"] == "d")
    assert d["bit_indices"] == [1, 0, 0] and d["direction"] is None and d["field_states"] == {"direction": "tainted"} and len(family(pins, "parser_diagnostics")) == 2
    assert [(m["die_pad"], m["package_ball"]) for m in family(parsed("csv", "balls.csv", profile="package_map"), "pin_mappings")] == [("P1", "A1"), ("P1", "A2"), ("P2", "A2"), (None, "A3")]
    assert [r["id"] for r in family(parsed("connectivity", "c.csv"), "requirements")] == ["r1", "r2", "r3"]


def test_tcl():
    sdc = parsed("sdc", "c.sdc")
    assert [(c["native_name"], c["period"], c["targets"]) for c in family(sdc, "clocks")] == [("c", 10.0, ["clk"]), ("c", 5.0, ["clk"])]
    assert {o["native_name"] for o in family(sdc, "objects")} == {"clk", "c", "d[0]", "nope"} and family(sdc, "views")[0]["complete"] and not family(parsed("sdc", "u.sdc"), "views")[0]["complete"]
    upf = family(parsed("upf", "p.upf"), "objects")
    assert ("isolation", "definition", "iso") in {(o["object_kind"], o["relation"], o["native_name"]) for o in upf} and sum(o["native_name"] == "VDD" for o in upf) == 2
    assert [w for _, w in tcl.commands('a {b {c}} "d e"; f \\\n g')] == [[("a", ""), ("b {c}", "{"), ("d e", '"')], [("f", ""), ("g", "")]]


def test_registers():
    rdl, xml, head = parsed("systemrdl", "r.rdl"), parsed("ipxact", "r.xml"), parsed("header", "r.h", component_name="regs")
    got = {r["native_name"]: (r["address_offset"], [(f["name"], f["bit_offset"], f["bit_width"], f["access"]) for f in r["fields"]]) for r in family(rdl, "registers")}
    assert got["CTRL"] == (4, [("EN", 0, 1, "read-write"), ("ST", 4, 2, "read-only")]) and got["ARR[0]"][0] == 16 and got["ARR[1]"][0] == 20
    x = family(xml, "registers")[0]
    assert (x["address_offset"], x["absolute_address"], x["fields"][1]["bit_offset"]) == (8, 264, 3)
    h = family(head, "registers")[0]
    assert h["address_offset"] == 4 and [(f["name"], f["bit_offset"], f["bit_width"]) for f in h["fields"]] == [("EN", 0, 1), ("ST", 4, 2)] and family(head, "parser_diagnostics")[0]["code"] == "OC1103"


@pytest.mark.parametrize("text,value", [("1 + 2 * 3", 7), ("(1 << 4) | 0x3", 19), ("-7 / 2", -3), ("-7 % 3", 2), ("8'hF0", 240), ("4'b1010 ^ 1", 11), ("~0 & 0xFFu", 255), ("(uint32_t)5", 5), ("010", 10)])
def test_integers(text, value):
    assert registers.integer(text) == value


@pytest.mark.parametrize("text", ["1 / 0", "x", "1 << 9999", "__import__('os')", "'a'", "1.5", "f(1)", "", "2 ** 9"])
def test_no_integers(text):
    with pytest.raises(registers.Expression):
        registers.integer(text)


def test_netlists():
    cdl, d = parsed("cdl", "n.cdl"), parsed("def", "f.def")
    assert [(p["native_name"], p["direction"]) for p in family(cdl, "ports")] == [("clk", "input"), ("n", "output")] and ("cell", "inv") in {(o["object_kind"], o["native_name"]) for o in family(cdl, "objects")}
    assert family(cdl, "parser_diagnostics")[0]["code"] == "OC1102"
    assert {(o["object_kind"], o["native_name"]) for o in family(d, "objects")} == {("net", "n"), ("pin", "u1/Y"), ("port", "n")} and family(d, "views")[0]["complete"]


def gds(*records):
    return b"".join(struct.pack(">HBB", len(b) + 4, t, 0) + b for t, b in records)


def test_gds():
    name = lambda s: s.encode() + b"\0" * (len(s) % 2)
    body = gds((0, b"\0\5"), (5, b""), (6, name("TOP")), (0x0C, b""), (0x0D, struct.pack(">h", 7)), (0x16, b"\0\0"), (0x19, name("clk")), (0x11, b""), (0x0A, b""), (0x12, name("inv")), (0x11, b""), (7, b""), (4, b""))
    run = lambda data, **o: list(run_parser(parser_of("gds"), [("g", data)], "gds.x", "gds", o))
    assert [p["native_name"] for p in family(run(body, pin_text_layers=[7]), "ports")] == ["clk"] and not family(run(body), "ports") and not family(run(body, pin_text_layers=[8]), "ports")
    assert not family(run(body[:-5]), "views")[0]["complete"] and family(run(body), "views")[0]["complete"]
    assert layout.real8(bytes.fromhex("4110000000000000")) == 1.0 and layout.real8(bytes.fromhex("c120000000000000")) == -2.0


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    d = tmp_path_factory.mktemp("project")
    for n, t in FILES.items():
        (d / n).write_text(t)
    (d / "p.toml").write_text("""
[policy]
rtl_power_pins = "optional"
[severity]
OC5003 = "warning"
[[waivers]]
code = "OC4203"
reason = "known"
""" + "".join(f'[[sources]]\nview = "{v}"\npaths = {p}\nformat = "{f}"\n' + (f"[sources.options]\n{o}\n" if o else "") for v, p, f, o in (
        ("rtl.default", '["top.sv"]', "rtl", ""), ("liberty.tt", '["*.lib", "chip.lib"]', "", ""), ("lef.default", '["chip.lef"]', "", ""), ("csv.package", '["balls.csv"]', "csv", 'column_map = {die_pad = "Pad"}'),
        ("sdc.f", '["c.sdc"]', "", ""), ("sdc.u", '["u.sdc"]', "", ""), ("upf.p", '["p.upf"]', "", ""), ("systemrdl.r", '["r.rdl"]', "", ""), ("ipxact.r", '["r.xml"]', "", ""), ("header.r", '["r.h"]', "", 'component_name = "regs"'),
        ("connectivity.c", '["c.csv"]', "connectivity", ""), ("def.f", '["f.def"]', "", ""), ("cdl.n", '["none*.cdl"]', "cdl", ""),
    )))
    return d


def test_project_from_files_to_reports(spark, project, tmp_path):
    p = Project.load(spark, str(project / "p.toml"))
    d = p.check(date(2026, 1, 1)).cache()
    got = {(r.code, r.object_id) for r in d.collect()}
    port = "component:chip/port:"
    for want in [("OC4001", port + "q"), ("OC4203", port + "VDD"), ("OC4104", port + "d"), ("OC4101", port + "d"), ("OC5003", "package-ball:A2"), ("OC5004", "die-pad:P1"), ("OC5002", "package-ball:A2"), ("OC4303", port + "y"), ("OC6002", "clock:c"), ("OC6001", "reference:sdc.f:port:nope"), ("OC6104", "upf:upf.p:supply_net:VDD"), ("OC6103", "reference:upf.p:power_domain:GONE"), ("OC6302", "register:regs/ctrl"), ("OC6305", "register:regs/ctrl/field:st"), ("OC6301", "register:regs/arr[0]"), ("OC1003", "view:cdl.n"), ("OC1102", "view:sdc.u")]:
        assert want in got, (want, sorted(got, key=str))
    assert ("OC6001", "reference:sdc.u:port:lost") not in got  # that view is not whole
    # The missing netlist leaves other views' verdicts alone: the clock does not reach q[0] in the RTL, which is whole.
    assert {(c, i) for c, i in got if c.startswith("OC65")} == {("OC6503", "connectivity:r3"), ("OC6505", "connectivity:r2")}  # an unknown cell also drives n
    body = json.loads(reports.render_json(d, "chip"))
    assert body["exit_code"] == 2 == C.exit_code(d) and body["summary"]["waived"] == 1 and len(body["diagnostics"]) == d.count()
    sarif = json.loads(reports.render_sarif(d))["runs"][0]
    assert len(sarif["results"]) == d.count() and sarif["results"][0]["ruleId"] == sarif["tool"]["driver"]["rules"][sarif["results"][0]["ruleIndex"]]["id"]
    assert "OC4001" in reports.render_text(d, True) and reports.render_markdown(d).count("\n") == 2 + d.where("waiver IS NULL").count() and "<script" not in reports.render_html(d)
    reports.publish(str(tmp_path / "r.json"), "x")
    reports.publish(str(tmp_path / "r.json"), "y")
    with pytest.raises(FileExistsError):
        reports.publish(str(tmp_path / "r.json"), "z", overwrite=False)
    assert (tmp_path / "r.json").read_text() == "y"
    d.unpersist()


def test_only_changed_views_are_parsed_again(spark, project, tmp_path):
    """Reports are the same with a cache, cold or warm; a changed file is seen; the cache holds one entry for each content."""
    said = lambda d: sorted((r.code, r.object_id, r.message, r.source, r.line) for r in d.collect())
    cache, p = f"{tmp_path}/cache", Project.load(spark, str(project / "p.toml"))
    p.sources = [s for s in p.sources if s.view.split(".")[0] in ("liberty", "lef", "csv")]
    fresh = said(p.check(date(2026, 1, 1)))
    assert said(p.check(date(2026, 1, 1), cache=cache)) == fresh
    entries = {e.name for e in (tmp_path / "cache").iterdir()}
    assert said(p.check(date(2026, 1, 1), cache=cache)) == fresh and {e.name for e in (tmp_path / "cache").iterdir()} == entries and len(entries) == 3
    lef = project / "chip.lef"
    before = lef.read_text()
    lef.write_text(before.replace("USE GROUND", "USE POWER"))
    try:
        changed = said(p.check(date(2026, 1, 1), cache=cache))
        assert changed != fresh and changed == said(p.check(date(2026, 1, 1))) and len(list((tmp_path / "cache").iterdir())) == 4
    finally:
        lef.write_text(before)


def test_a_recheck_tells_what_a_full_check_does(spark, project):
    """One of two files has changed since the facts and findings were kept."""
    said = lambda d: sorted((r.rule, r.code, str(r.object_id), r.message) for r in d.collect())
    p = Project.load(spark, str(project / "p.toml"))
    p.sources = [s for s in p.sources if s.view.split(".")[0] in ("liberty", "lef")]
    then = p.facts()
    old = p.findings(then)
    lef = project / "chip.lef"
    before = lef.read_text()
    lef.write_text(before.replace("USE GROUND", "USE POWER"))
    try:
        assert said(p.recheck(then, old)) == said(p.findings(p.facts())) != said(old)
    finally:
        lef.write_text(before)


def test_formats_plugins_and_errors(spark, project):
    assert format_of(Source("a.b", ["x.lib"])) == "liberty" and format_of(Source("a.b", ["x"], "SV")) == "verilog"
    for bad in (Source("a.b", ["x"]), Source("a.b", ["x.lib", "y.lef"]), Source("a.b", [], "nope")):
        with pytest.raises(ValueError):
            format_of(bad)
    with pytest.raises(ValueError):
        register("lef", None)
    register("mine", lambda files, view, kind, options: [("components", {"native_name": options["n"]})])
    register("broken", lambda files, view, kind, options: 1 / 0)
    out = observe(spark, [Source("mine.a", [str(project / "c.sdc")], "mine", {"n": "X"}), Source("mine.b", [str(project / "c.sdc")], "broken"), Source("lef.z", [str(project / "missing.lef")])])
    assert [r.native_name for r in out["components"].collect()] == ["X"]
    assert {(r.view, r.code) for r in out["parser_diagnostics"].collect()} == {("mine.b", "OC9001"), ("lef.z", "OC1002")}
    for bad in ({"nope": 1}, {"policy": {"x": 1}}, {"severity": {"OC4001": "loud"}}, {"sources": [{}]}, {"waivers": [{"cod": 1}]}):
        with pytest.raises(ConfigError):
            Project(spark, bad)


def test_changed_files(spark):
    before = spark.createDataFrame([("a", "x"), ("b", "4355a46b19d348dc2f57c046f8ef63d4538ebb936000f3c9ee954a27460dd865")], "path string, digest string")
    now = spark.createDataFrame([("a", b"1\n"), ("b", b"1\n"), ("c", b"")], "path string, content binary")
    assert sorted(r.path for r in changed_files(before, now).collect()) == ["a", "c"]


def test_roles_from_names_are_shown_and_never_judged(spark):
    from factloom.functions import names

    rows = [("VSS_IO", None, None), ("vdd_core", "unknown", {"role": "known", "shape": "known"}), ("core_clk_i", "signal", None), ("resetn", "", None), ("payload", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "native_name string, role string, field_states map<string,string>")
    got = [(r.role, r.field_states) for r in names.hinted(df).collect()]
    assert got == [("ground", {"role": "tainted"}), ("power", {"shape": "known", "role": "tainted"}), ("signal", None), ("reset", {"role": "tainted"}), (None, None), (None, None)]


CELL = "module c(input a, output y); assign y = a; endmodule\n"


@pytest.mark.parametrize(
    "body,edges,dark",
    [
        ("wire t = a; assign y = t;", {("top/a", "top/t"), ("top/t", "top/y")}, False),
        ("assign y = a, z = a;", {("top/a", "top/y"), ("top/a", "top/z")}, False),
        ("c u(.a(a), .y(n)); c v(.a(n), .y(y));", {("top/a", "top/u/a"), ("top/u/y", "top/n"), ("top/n", "top/v/a"), ("top/v/y", "top/y")}, False),
        ("c u[1:0](.a(a), .y(y));", set(), True),
        ("c u(.*);", set(), True),
        ("always @* q = a;", set(), True),
        ("generate if (1) assign y = a; endgenerate", None, True),
    ],
)
def test_verilog_edges_are_there_or_their_scope_is_tainted(body, edges, dark):
    found = list(run_parser(parser_of("verilog"), [("t.v", f"{CELL}module top(input a, output y, output z); {body} endmodule".encode())], "rtl.a", "rtl", {}))
    got = {(r["source"], r["sink"]) for f, r in found if f == "edges" and r["status"] == "known"}
    assert edges is None or edges <= got
    view = next(r for f, r in found if f == "views")
    assert ("top" in view["tainted_scopes"]) == dark and view["complete"] != dark


def test_parameters_of_instances_leave_their_edges_uncertain():
    """But for values that the module has anyway (see HIERARCHY)."""
    found = list(run_parser(parser_of("verilog"), [("t.v", f"{CELL}module top(input a, output y); c #(.W(2)) u(.a(a), .y(y)); endmodule".encode())], "rtl.a", "rtl", {}))
    assert {r["status"] for f, r in found if f == "edges" and "/u/" in r["sink"] + r["source"] and r["edge_kind"] == "port"} == {"tainted"}
    lost = list(run_parser(parser_of("verilog"), [("t.v", b"module top(input [W-1:0] a, output y); assign y = a; endmodule")], "rtl.a", "rtl", {}))
    assert "top" in next(r for f, r in lost if f == "views")["tainted_scopes"]


def header_of(n: int) -> bytes:
    return "\n".join(f"#define REGS_R{k}_OFFSET (0x100 + {k} * 4)\n#define REGS_R{k}_F_SHIFT {k % 8}\n#define REGS_R{k}_F_WIDTH 2" for k in range(n)).encode()


def rdl_of(n: int) -> bytes:
    return ("addrmap regs {\n" + "\n".join(f"reg {{ field {{ sw = rw; }} F[{k % 8 + 1}:{k % 8}]; }} R{k} @ 0x{256 + k * 4:x};" for k in range(n)) + "\n};").encode()


@pytest.mark.parametrize(("parser", "made", "options"), [(registers.parse_header, header_of, {"component_name": "regs"}), (registers.parse_systemrdl, rdl_of, {})])
def test_register_files_are_read_in_time_that_grows_with_them(parser, made, options):
    """Each register once looked at all macros, or at the rest of the file: 6,000 took minutes."""
    start = time.perf_counter()
    rows = [r for f, r in parser([("f", made(6000))], "v", "k", options) if f == "registers"]
    assert time.perf_counter() - start < 15
    assert [(r.get("address_offset"), r["fields"][0]["bit_offset"], r["fields"][0]["bit_width"]) for r in rows] == [(256 + k * 4, k % 8, 2) for k in range(6000)]


def test_macros_that_use_later_ones():
    """Values come by level; a field's macro belongs to the longest register's name; what has no value is told."""
    body = b"#define R_B_OFFSET A3\n#define R_B_C_OFFSET 8\n#define R_B_C_F_SHIFT 2\n#define R_B_D_MASK 0x30\n#define A3 A2 + 1\n#define A2 A1 + 1\n#define A1 1\n#define R_X_OFFSET NONE\n#define R_Y_OFFSET R_X_OFFSET"
    rows = list(registers.parse_header([("f", body)], "v", "k", {"component_name": "R"}))
    got = [(r["native_name"], r["address_offset"], [f["name"] for f in r["fields"] or []]) for f, r in rows if f == "registers"]
    assert got == [("B_C", 8, ["F"]), ("B", 3, ["D"])]
    assert [r["scope"] for f, r in rows if f == "parser_diagnostics"] == ["R_X_OFFSET", "R_Y_OFFSET"]


def test_files_of_more_than_64_mib_are_read(spark, tmp_path):
    """Such files were refused; rows of one view leave the task in several batches."""
    pad = ("# " + "x" * 1021 + "\n") * (66 << 10)
    (tmp_path / "big.lef").write_text(FILES["chip.lef"] + pad + "".join(f"MACRO m{k}\nEND m{k}\n" for k in range(25_000)))
    out = observe(spark, [Source("lef.default", [str(tmp_path / "big.lef")])])
    assert [r.complete for r in out["views"].collect()] == [True]
    assert out["components"].count() == 25_001 and out["parser_diagnostics"].count() == 0


CELLS = "".join(f'  cell(c{k}) {{ pin(a) {{ direction : input; }}\n    pin(y[{k % 5}:0]) {{ function : "!a"; }}\n    bus(d) {{ bus_type : b{k % 4}; }} bus(e) {{ bus_type : late; }} }}\n' for k in range(40))
LATE = "type(late) { bit_from : 0; bit_to : 7; }\n"
TYPES = "type(b1) { bit_from : 3; bit_to : 0; } type(b2) { bit_from : 1; bit_to : 0; }\n"
LIBERTY = {
    "whole": f"library(l) {{ {TYPES}{CELLS}{LATE}}}\n",
    "no_end": f"library(l) {{ {TYPES}{CELLS}{LATE}}}",
    "two": f"/* a */ library(l) {{ {TYPES}{CELLS}}}\nlibrary(m) {{ {CELLS}{LATE}{CELLS} }} cell(out) {{ }}\n",
    "comment": f"library(l) {{ {CELLS}/* closed later\n{CELLS}*/\n{LATE}{CELLS}}}",
    "string": f'library(l) {{ {CELLS} note : "\n{CELLS.replace(chr(34), "")}";\n{CELLS}}}',
    "open_string": f'library(l) {{ {CELLS} note : "\n{CELLS.replace(chr(34), "")}',
    "open_comment": f"library(l) {{ {CELLS}/* x\n{CELLS}}}",
    "open_cell": f"library(l) {{ {CELLS} cell(o) {{ pin(a) {{\n{CELLS}}} }}",
    "open_library": f"\n\nlibrary(l) {{ {CELLS}{TYPES}{CELLS}",
    "closed_twice": f"library(l) {{ {CELLS}}} }}\n{CELLS}",
    "values": f"library(l) {{ {CELLS} a : b\n{CELLS} x(1, 2)\n{CELLS} word\n{CELLS} y(\n{CELLS}) ; {CELLS}}}",
    "packed": "library(l) { " + CELLS.replace("\n", "\r\n") + "}\\",
    "none": "\n" * 300,
}


def both_ways(spark, monkeypatch, folder, format, files):
    """Rows of views parsed whole and in pieces of some hundred bytes."""
    from factloom.sources import pieces

    for name, body in files.items():
        (folder / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    sources = [Source(f"{format}.{name}", [str(folder / name)], format) for name in files]
    found = []
    for large in (1 << 40, 1):
        monkeypatch.setattr(pieces, "LARGE", large)
        monkeypatch.setattr(pieces, "PIECE", 300)
        monkeypatch.setattr(pieces, "HANDED", 1000)
        out = observe(spark, sources)
        found.append({f: sorted(map(str, out[f].collect())) for f in ("views", "components", "ports", "functions", "parser_diagnostics")})
    name = next(iter(files))
    cut = pieces.fragments(spark, 0, str(folder / name), __import__(f"factloom.sources.{format}", fromlist=["CUT"]).CUT, 300).count()
    return *found, cut


def test_large_libraries_are_parsed_in_pieces(spark, monkeypatch, tmp_path):
    """One task held a whole file's groups; cells, lines, numbers, types and findings are those of the whole file."""
    odd = {"latin": LIBERTY["whole"].replace("c7", "c\xe9").encode("latin-1"), "mark": b"\xef\xbb\xbf" + LIBERTY["no_end"].encode(), "latin_mark": b"\xef\xbb\xbf" + LIBERTY["no_end"].encode() + b"\xe9"}
    whole, pieces, cut = both_ways(spark, monkeypatch, tmp_path, "liberty", LIBERTY | odd)
    assert cut > 5 and whole == pieces and len(whole["components"]) > 400 and any("OC1103" in d for d in whole["parser_diagnostics"])


MACROS = "".join(f"MACRO m{k}\n  PIN clk\n    DIRECTION INPUT ;\n    USE CLOCK ;\n  END clk\n  PIN q<{k % 3}>\n  END q<{k % 3}>\n  PIN q[1]\n  END q[1]\nEND m{k}\n" for k in range(40))
LEF = {
    "whole": f"VERSION 5.8 ;\n{MACROS}END LIBRARY",
    "brackets": f'{MACROS}BUSBITCHARS "<>" ;\n{MACROS}{MACROS}BUSBITCHARS "[]" ;\n{MACROS}',
    "open": f"{MACROS}MACRO o\n  PIN a\n{MACROS}MACRO p\n  PIN b\n",
    "geometry": f"MACRO g\n{'  RECT 0 0 1 1 ;' * 9}\n" + "  RECT 0 0 1 1 ; # MACRO x\n" * 200 + f"END g\n  # c\r\n{MACROS.lower()}",
    "latin": MACROS.replace("m7\n", "\xe9\n").encode("latin-1"),
}


def test_large_abstracts_are_parsed_in_pieces(spark, monkeypatch, tmp_path):
    """Macros, their lines, bus brackets set anywhere, and macros that are not closed are those of the whole file."""
    whole, pieces, cut = both_ways(spark, monkeypatch, tmp_path, "lef", LEF)
    assert cut > 5 and whole == pieces and len(whole["components"]) > 240 and any("OC1101" in d for d in whole["parser_diagnostics"])


@pytest.mark.parametrize("name", ["liberty_functions", "lef_import"])
def test_imports_in_pieces_equal_their_sql(spark, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    from factloom.plans import imports
    from factloom.sources import pieces

    monkeypatch.setattr(pieces, "LARGE", 1)
    monkeypatch.setattr(pieces, "PIECE", 2000)
    sf = "/root/testdata/sf0.001"
    got = imports.IMPORTS[name](spark, sf)
    want = duckdb.sql(imports.IMPORTS_SQL[name].replace("FROM part", f"FROM '{sf}/part.parquet' AS part"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
