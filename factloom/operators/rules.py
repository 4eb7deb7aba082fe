"""The rules of the catalogue over the observation families.

``Facts`` holds one DataFrame for each family (a missing one is empty) and the policy. Every rule returns
findings (code, object, property, message, evidence); ``all_findings`` unites them. Names are resolved to
canonical ones once; the member tables that come of it are what the rules group and join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions import boolean, names
from factloom.model import EVIDENCE, FINDING, SCHEMAS, empty, without_rows

from . import generic, graph, patterns
from .shared import cut, written

NO_CONNECT = ("NC", "DNP", "N/C")
REGISTER_KINDS = ("ipxact", "header", "systemrdl")
REFERENCE_KINDS = {"cells": "instance", "cell": "instance", "instances": "instance", "ports": "port", "pins": "pin", "nets": "net", "clocks": "clock"}


@dataclass
class Policy:
    strict_inventory: bool = False
    scalar_vector_equivalent: bool = False
    rtl_power_pins: str = "optional"
    allow_multi_bond: bool = False
    max_boolean_inputs: int = 12
    report_unmatched_waivers: bool = True
    deny_warnings: bool = False


def evidence(view: Column | str, value: Column | None = None, located: bool = False) -> Column:
    """One piece of evidence of a row."""
    at = [F.col("source"), F.col("line"), F.col("column")] if located else [F.lit(None).cast(k) for k in ("string", "int", "int")]
    value = F.lit(None).cast("string") if value is None else value.cast("string")
    return F.struct((F.col(view) if isinstance(view, str) else view).alias("view"), value.alias("value"), at[0].alias("source"), at[1].alias("line"), at[2].alias("column"))


def gathered(e: Column) -> Column:
    """The evidence of a group, in a fixed order."""
    return F.sort_array(F.collect_list(e)).cast(EVIDENCE)


def proven(rows: DataFrame, keys: DataFrame, on: list[str], e: Column) -> DataFrame:
    """``keys`` with the evidence of their rows: gathered for them only, after the test."""
    found = rows.join(keys.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(gathered(e).alias("evidence"))
    return keys.join(found, on)


def no_findings(f: Facts) -> DataFrame:
    return without_rows(f.spark, FINDING)


def finding(df: DataFrame, code: str | Column, kind: str | Column, id: Column, property: str | None, message: Column, pieces: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return df.select(lit(code).alias("code"), lit(kind).alias("object_kind"), id.alias("object_id"), lit(property).alias("property"), message.alias("message"), (F.array().cast(EVIDENCE) if pieces is None else pieces).alias("evidence"))


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def views_in(pieces: str = "evidence") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(pieces, lambda e: e["view"]))), ", ")


@dataclass
class Facts:
    spark: SparkSession
    tables: dict[str, DataFrame]
    policy: Policy = field(default_factory=Policy)

    def __getitem__(self, family: str) -> DataFrame:
        """The family's rows; but for views, of which there are few, to be joined by a shuffle (see ``shared``)."""
        if family not in self.tables:
            return empty(self.spark, family)
        return self.tables[family] if family == "views" else self.tables[family].hint("merge")

    def _resolved(self, used: DataFrame, alias_kind: str) -> DataFrame:
        """Adds ``canonical`` and ``candidates`` (several at a collision) to rows with view, kind, component, native."""
        rules = self["aliases"].where(F.col("alias_kind") == alias_kind).select(names.decoded(F.col("native")).alias("_d"), F.col("component").alias("_c"), "view_selector", F.col("canonical").alias("_canonical"))
        keys = used.select("view", "kind", "component", "native").distinct()
        rank = names.selector_rank(F.col("view"), F.col("kind"), F.col("view_selector"))
        hits = keys.join(rules, (names.decoded(F.col("native")) == F.col("_d")) & F.col("component").eqNullSafe(F.col("_c"))).withColumn("rank", rank).where("rank IS NOT NULL")
        best = hits.groupBy("view", "kind", "component", "native").agg(F.array_sort(F.collect_set(F.struct("rank", "_canonical"))).alias("c"))
        best = best.withColumn("candidates", F.array_distinct(F.transform(F.filter("c", lambda x: x["rank"] == F.col("c")[0]["rank"]), lambda x: x["_canonical"]))).drop("c")
        on = [used[k].eqNullSafe(best[k]) for k in ("view", "kind", "component", "native")]
        out = used.join(best, on, "left").select(used["*"], "candidates")
        return out.withColumn("canonical", F.when(F.size("candidates") == 1, F.col("candidates")[0]).otherwise(names.decoded(F.col("native"))))

    @cached_property
    def components(self) -> DataFrame:
        """A row for each definition: view, kind, native_name, component (canonical), candidates."""
        used = self["components"].withColumn("native", F.col("native_name")).withColumn("component", F.lit(None).cast("string"))
        return written(self._resolved(used, "component").drop("component", "native").withColumnRenamed("canonical", "component"))[0]

    @cached_property
    def ports(self) -> DataFrame:
        """A row for each port of each definition: component and port (canonical) beside the observed columns."""
        of = self.components.select("view", F.col("native_name").alias("native_component"), "component").distinct()
        own = self["ports"].withColumnRenamed("component", "native_component")
        # What the joins do not need goes through them and to the disk as one value.
        named = ("view", "kind", "native_component", "native_name")
        own = own.select(*named, F.struct(*[c for c in own.columns if c not in named]).alias("seen")).join(of, ["view", "native_component"])
        resolved = self._resolved(own.withColumn("native", F.col("native_name")), "port").drop("native").withColumnRenamed("canonical", "port")
        return written(resolved)[0].select(*[c for c in resolved.columns if c != "seen"], "seen.*")

    @cached_property
    def pins(self) -> tuple[DataFrame, int]:
        """A row for each (component, port): ``seen``, the definitions with it (view, native_component), and ``again``, whether one of them has it twice; and how many have."""
        seen = F.collect_set(F.struct("view", "native_component"))
        g = self.ports.groupBy("component", "port").agg(seen.alias("seen"), (F.count("*") > F.size(seen)).alias("again"))
        df, told = written(g, again=F.count_if("again"))
        return df, told["again"]

    @cached_property
    def port_values(self) -> DataFrame:
        """Known values of ports, the contract's as those of one more view; none for package maps."""
        p = self.ports.where(~package_map())
        shape_known = names.state_for("shape") == "known"
        # Known unless the row or the field says otherwise; a value that is absent or not one of the known words is null by itself.
        told = lambda field: (F.coalesce("status", F.lit("known")) == "known") & F.coalesce(F.element_at("field_states", field) == "known", F.lit(True))

        def values(rows: DataFrame, bits: Column, shape: Column) -> DataFrame:
            return rows.select(
                "component", "port", "view", "source", "line", "column",
                F.when(told("direction"), names.direction(F.col("direction"), None)).alias("direction"),
                F.when(told("role"), names.role(F.col("role"), None)).alias("role"),
                F.when(told("shape"), F.col("width")).alias("width"),
                F.when(told("shape") & (F.col("width") == 1), F.col("explicit_scalar")).alias("scalar"),
                F.when(shape_known, bits).alias("bits"),
                F.when(shape_known, shape).alias("structure"),
                F.coalesce("bit_order_known", F.lit(True)).alias("bit_order_known"),
                F.to_json("unpacked").alias("unpacked"),
            )

        # Bits and structure are long expressions: too long for one compiled method, so they stand apart from the ports that have neither.
        plain = values(p.where(~laid_out()), F.lit(None).cast("array<int>"), F.lit(None).cast("string"))
        seen = plain.union(values(p.where(laid_out()), ordered_bits(), structure()))
        frozen = self["contract_ports"].select(
            "component", "port", F.lit("contract.frozen").alias("view"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"),
            *[F.when(c(F.col(n)) != "unknown", c(F.col(n))).alias(n) for n, c in (("direction", names.direction), ("role", names.role))], "width",
        )
        every = seen.unionByName(frozen.join(seen.select("component", "port").distinct(), ["component", "port"], "left_semi"), allowMissingColumns=True)
        return written(every)[0] if "contract_ports" in self.tables else every.hint("merge")  # ports are written already

    @cached_property
    def whole_tainted(self) -> DataFrame:
        bad = (~F.col("complete") & (F.size(F.coalesce("tainted_scopes", F.array().cast("array<string>"))) == 0)) | F.coalesce(F.array_contains("tainted_scopes", "*"), F.lit(False))
        return self["views"].where(bad).select("view")

    def expanded(self, selectors: DataFrame, views: DataFrame) -> DataFrame:
        """Selector rows (with ``selector``) by the views they name; exact names that no view has stay as they are."""
        matched = selectors.join(views.select("view", "kind"), names.selector_rank(F.col("view"), F.col("kind"), F.col("selector")).isNotNull()).drop("kind")
        literal = selectors.where(~F.col("selector").rlike(r"[*?\[]")).join(matched.select("selector").distinct(), "selector", "left_anti").withColumn("view", F.when(F.col("selector").contains("."), F.lower("selector")).otherwise(F.concat(F.lower("selector"), F.lit(".default"))))
        return matched.unionByName(literal)


def package_map() -> Column:
    """A CSV view whose name says that it maps a package's balls; its rows are no ports."""
    return F.col("view").endswith(".package") & (names.view_kind(F.col("kind")) == "csv")


def laid_out() -> Column:
    """Whether a port lists bits or dimensions; all others have no bits and no structure."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return some("bit_indices") | some("packed") | some("unpacked") | (F.col("left").isNotNull() & F.col("right").isNotNull())


def ordered_bits() -> Column:
    """The bits of a one-dimensional bus in their declared order."""
    only = F.when(F.size("packed") == 1, F.sequence(F.col("packed")[0]["left"], F.col("packed")[0]["right"]))
    span = F.when(F.col("left").isNotNull() & F.col("right").isNotNull() & (F.coalesce(F.size("packed"), F.lit(0)) <= 1), F.sequence("left", "right"))
    listed = F.when(F.size("bit_indices") > 0, F.col("bit_indices"))
    return F.coalesce(listed, only, span)


def structure() -> Column:
    """What two views' shapes are compared by; null where only a width is known."""
    dims = F.to_json("packed")
    outer = F.coalesce(F.to_json("unpacked"), F.lit("[]"))
    head = F.when(ordered_bits().isNotNull(), F.concat(F.lit("ordered"), F.array_join(ordered_bits(), ","))).when(F.size("packed") > 0, F.concat(F.lit("dimensions"), dims))
    head = head.when(F.size("unpacked") > 0, F.when(F.col("explicit_scalar"), "scalar").otherwise("unspecified"))
    return F.concat(head, F.lit("|"), outer)


def port_id() -> Column:
    return text("component:", F.col("component"), "/port:", F.col("port"))


def alias_collisions(f: Facts) -> DataFrame:
    """OC2002."""
    c = f.components.where(F.size("candidates") > 1)
    p = f.ports.where(F.size("candidates") > 1)
    told = text(F.col("native_name"), " has several canonical names: ", F.array_join("candidates", ", "), ".")
    return finding(c, "OC2002", "component", text("component:", F.col("component")), None, told, F.array(evidence("view", F.col("native_name"), True)).cast(EVIDENCE)).union(
        finding(p, "OC2002", "port", port_id(), None, told, F.array(evidence("view", F.col("native_name"), True)).cast(EVIDENCE))
    )


def duplicate_components(f: Facts) -> DataFrame:
    """OC2003 and OC2004: a view defines a component twice, alike or not."""
    sig = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "native_name", "direction", "role", F.col("width").cast("string")))), ";")
    twice, told = written(f.components.groupBy(F.col("view").alias("_v"), F.col("component").alias("_c")).agg(F.count("*").alias("_n")).where("_n > 1"))
    if not told["n"]:
        return no_findings(f)
    # Signatures are made of the components that come again only.
    of = f.components.join(twice, F.col("view").eqNullSafe(F.col("_v")) & F.col("component").eqNullSafe(F.col("_c")), "left_semi")
    own = f["ports"].join(of.select("view", F.col("native_name").alias("component")).distinct(), ["view", "component"], "left_semi")
    ports = own.groupBy("view", F.col("component").alias("native_name"), F.coalesce("ordinal", F.lit(0)).alias("_o")).agg(sig.alias("s")).groupBy("view", "native_name").agg(F.array_join(F.array_sort(F.collect_list("s")), "|").alias("signature"))
    of = of.join(ports, ["view", "native_name"], "left").withColumn("signature", F.coalesce("signature", F.lit("")))
    g = of.groupBy("view", "component").agg(F.count("*").alias("n"), (F.min("signature") != F.max("signature")).alias("differs"), gathered(evidence("view", F.col("native_name"), True)).alias("evidence")).where("n > 1")
    return finding(g, F.when(F.col("differs"), "OC2004").otherwise("OC2003"), "component", text("component:", F.col("component")), None, text(F.col("view"), " defines ", F.col("component"), " ", F.col("n").cast("string"), " times."), F.col("evidence"))


def duplicate_pins(f: Facts) -> DataFrame:
    """OC3103: one finding for each further occurrence, with the first one as evidence."""
    pins, n = f.pins
    if not n:
        return no_findings(f)
    w = Window.partitionBy("view", "native_component", "component", "port").orderBy(F.col("ordinal").asc_nulls_last(), "line", "native_name")
    one = evidence("view", F.col("native_name"), True)
    again = pins.where("again").select(F.col("component").alias("_c"), F.col("port").alias("_p"))
    rows = f.ports.join(again, F.col("component").eqNullSafe(F.col("_c")) & F.col("port").eqNullSafe(F.col("_p")), "left_semi")
    r = rows.withColumns({"n": F.row_number().over(w), "first": F.first(one).over(w)}).where("n > 1")
    return finding(r, "OC3103", "port", port_id(), None, text(F.col("view"), " has ", F.col("component"), "/", F.col("port"), " again."), F.array("first", one).cast(EVIDENCE))


def _required_views(f: Facts) -> DataFrame:
    """(component, view) that participation and the policy ask for, less the optional ones."""
    every = f.components.select("component").distinct()
    views = f["views"].where(~names.view_kind(F.col("kind")).isin("sdc", "upf", "header"))
    asked = f["participation"]
    hits = patterns.matched(asked.select(F.col("entity_pattern").alias("pattern")), every.select(F.col("component").alias("name")), [])
    rules = hits.select(F.col("pattern").alias("entity_pattern"), F.col("name").alias("component")).join(asked, "entity_pattern")
    pick = lambda c: rules.select("component", F.explode(c).alias("selector"))
    wanted = f.expanded(pick("required"), views).select("component", "view")
    if f.policy.strict_inventory:
        wanted = wanted.union(every.join(views.select("view"), F.lit(True)))
    spared = f.expanded(pick("optional"), views).select("component", "view")
    return wanted.distinct().join(spared, ["component", "view"], "left_anti")


def component_inventory(f: Facts) -> DataFrame:
    """OC3001: a required view lacks a component; OC3002: the contract lacks it."""
    missing = generic.absence(_required_views(f), f.components, ["component", "view"], f.whole_tainted, ["view"])
    missing = missing.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("view")), ", ").alias("missing"))
    own = f.components.groupBy("component").agg(gathered(evidence("view", F.col("native_name"), True)).alias("evidence"))
    found = finding(missing.join(own, "component"), "OC3001", "component", text("component:", F.col("component")), None, text(F.col("component"), " is missing from ", F.col("missing"), "."), F.col("evidence"))
    frozen = f["contract_ports"].select("component").distinct()
    extra = own.join(frozen, "component", "left_anti").join(F.broadcast(frozen.limit(1).select(F.lit(1).alias("_any")))) if "contract_ports" in f.tables else own.limit(0)
    found = found.union(finding(extra, "OC3002", "component", text("component:", F.col("component")), None, text(F.col("component"), " is not in the frozen contract."), F.col("evidence")))
    gone = frozen.join(own, "component", "left_anti")
    return found.union(finding(gone, "OC3001", "component", text("component:", F.col("component")), None, text(F.col("component"), " is required by the frozen contract but absent.")))


def dominant_roles(f: Facts) -> DataFrame:
    """(component, port, dominant): the contract's role, else power, else ground, else the first known one."""
    v = f.port_values.where("role IS NOT NULL")
    return v.groupBy("component", "port").agg(
        F.coalesce(F.max(F.when(F.col("view") == "contract.frozen", F.col("role"))), F.max(F.when(F.col("role") == "power", "power")), F.max(F.when(F.col("role") == "ground", "ground")), F.min_by("role", "view")).alias("dominant")
    )


def pin_inventory(f: Facts) -> DataFrame:
    """OC3101 and, for power and ground, OC4202: a view with the component lacks the pin. OC3102: the contract lacks it."""
    key = ["component", "port"]
    has = f.components.where(~names.view_kind(F.col("kind")).isin("sdc", "upf", "header")).select("component", "view", "kind", "native_name").distinct()
    scopes = f["views"].select("view", F.explode("tainted_scopes").alias("native_name"))
    has = has.join(scopes, ["view", "native_name"], "left_anti").join(F.broadcast(f.whole_tainted), "view", "left_anti")
    others = F.when(names.view_kind(F.col("kind")) != "rtl", F.col("view"))
    declared = has.groupBy("component").agg(F.collect_set("view").alias("every"), F.collect_set(others).alias("others"))
    pins, _ = f.pins
    own = pins.select(*key)
    # A pin lacks the views that declare its component and do not have it; roles are looked up for such pins only.
    lacks = lambda c: F.array_except(c, F.transform("seen", lambda x: x["view"]))
    lacking, told = written(pins.join(declared, "component").select(*key, lacks("every").alias("missing"), lacks("others").alias("_others")).where(F.size("missing") > 0))
    found = no_findings(f)
    here = evidence("view", F.lit("present"), True)
    pg = F.when(F.col("dominant").isin("power", "ground"), "OC4202").otherwise("OC3101")
    if told["n"]:
        missing = lacking.join(dominant_roles(f), key, "left")
        if f.policy.rtl_power_pins in ("optional", "ignore"):
            missing = missing.withColumn("missing", F.when(F.coalesce(F.col("dominant").isin("power", "ground"), F.lit(False)), F.col("_others")).otherwise(F.col("missing"))).where(F.size("missing") > 0)
        pieces = f.ports.join(lacking.select(*key), key, "left_semi").groupBy(*key).agg(gathered(here).alias("evidence"))
        missing = missing.withColumn("missing", F.array_join(F.array_sort("missing"), ", ")).join(pieces, key)
        found = finding(missing, pg, "port", port_id(), "presence", text(F.col("component"), "/", F.col("port"), " is missing from ", F.col("missing"), "."), F.col("evidence"))
    frozen = f["contract_ports"]
    known = own.join(frozen.select("component").distinct(), "component", "left_semi")
    extra = proven(f.ports, known.join(frozen, ["component", "port"], "left_anti"), ["component", "port"], here)
    found = found.union(finding(extra, "OC3102", "port", port_id(), None, text(F.col("component"), "/", F.col("port"), " is not in the frozen contract."), F.col("evidence")))
    gone = frozen.join(own.select("component").distinct(), "component", "left_semi").join(own, ["component", "port"], "left_anti").withColumn("dominant", names.role(F.col("role")))
    return found.union(finding(gone, pg, "port", port_id(), "presence", text(F.col("component"), "/", F.col("port"), " is required by the frozen contract but missing.")))


def port_conflicts(f: Facts) -> DataFrame:
    """OC4001, OC4101, OC4102, OC4103, OC4106, OC4201, OC4203, OC4204 in one grouping of the ports' values."""
    key = ["component", "port"]
    v = f.port_values
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    number = lambda c, of: F.array_position(F.array(*map(F.lit, sorted(set(of.values())))), F.col(c))
    some = lambda *roles: F.coalesce(F.bool_or(F.col("role").isin(*roles)), F.lit(False))
    proof = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), evidence("view", F.col(c), True)))).cast(EVIDENCE)
    # Numbers in place of names: a hash of numbers needs no sort. Text is compared for ports of a known structure only.
    g = v.groupBy(*key).agg(
        differ(number("direction", names.DIRECTIONS)).alias("d"), differ(number("role", names.ROLES)).alias("r"), (some("power") & some("ground")).alias("rails"), some("clock", "reset").alias("timed"),
        differ("width").alias("w"), differ("scalar").alias("s"),
    ).where("d OR r OR w OR s")
    shaped = v.where("structure IS NOT NULL").groupBy(*key).agg(
        differ("structure").alias("x"), F.bool_and(F.col("bits").isNotNull()).alias("all_bits"), differ(F.array_join("bits", ",")).alias("orders"), differ(F.array_join(F.array_sort(F.array_distinct("bits")), ",")).alias("sets"),
        differ(F.coalesce("unpacked", F.lit("[]"))).alias("outer"), F.bool_and("bit_order_known").alias("order_known"),
    ).where("x")
    g, measured = written(g.join(shaped, key, "full").fillna(False, ["d", "r", "rails", "timed", "w", "s", "x"]))
    if not measured["n"]:
        return no_findings(f)
    # Evidence is gathered for ports with a conflict only.
    told = v.join(g.select(*key), key, "left_semi").groupBy(*key).agg(*[proof(c).alias(f"{n}_e") for c, n in (("direction", "d"), ("role", "r"), ("width", "w"), ("scalar", "s"), ("structure", "x"))])
    g = g.join(told, key)
    only_order = F.col("all_bits") & F.col("orders") & ~F.col("sets") & ~F.col("outer")
    role_code = F.when(F.col("rails"), "OC4203").when(F.col("timed"), "OC4204").otherwise("OC4201")
    shape_code = F.when(only_order, F.when(F.col("order_known"), "OC4102")).otherwise("OC4103")
    row = lambda code, property, pieces: F.struct(code.alias("code"), property.alias("property"), F.col(pieces).alias("evidence"))
    rows = F.filter(
        F.array(
            row(F.when(F.col("d"), "OC4001"), F.lit("direction"), "d_e"),
            row(F.when(F.col("r"), role_code), F.lit("role"), "r_e"),
            row(F.when(F.col("w"), "OC4101"), F.lit("shape.width"), "w_e"),
            row(F.when(~F.col("w") & F.col("s") & F.lit(not f.policy.scalar_vector_equivalent), "OC4106"), F.lit("shape.scalar"), "s_e"),
            row(F.when(~F.col("w") & F.col("x"), shape_code), F.when(only_order, "shape.index_order").otherwise("shape.dimensions"), "x_e"),
        ),
        lambda x: x["code"].isNotNull(),
    )
    r = g.select(*key, F.explode(rows).alias("x")).select(*key, "x.*")
    told = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" = ", e["view"], e["value"])), "; ")
    return r.select(
        "code", F.lit("port").alias("object_kind"), port_id().alias("object_id"), "property", text(F.col("component"), "/", F.col("port"), " has conflicting values: ", told, ".").alias("message"), "evidence"
    )


def bus_integrity(f: Facts) -> DataFrame:
    """OC4105: a bus lists a bit twice; OC4104: it leaves one out."""
    b = f.ports.where((F.size("bit_indices") > 0) & (names.state_for("shape") == "known"))
    twice = F.size("bit_indices") != F.size(F.array_distinct("bit_indices"))
    gap = F.size(F.array_distinct("bit_indices")) != F.array_max("bit_indices") - F.array_min("bit_indices") + 1
    r = b.withColumn("code", F.explode(F.array_compact(F.array(F.when(twice, F.lit("OC4105")), F.when(gap, F.lit("OC4104"))))))
    return finding(r, F.col("code"), "port", port_id(), "shape.bits", text(F.col("view"), " lists bits ", F.array_join("bit_indices", ","), " of ", F.col("component"), "/", F.col("port"), "."), F.array(evidence("view", F.array_join("bit_indices", ","), True)).cast(EVIDENCE))


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two names; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, a.casefold(), b.casefold()).ratio() for a, b in zip(left, right, strict=True)])


@F.pandas_udf(T.StringType())
def folded(name: pd.Series) -> pd.Series:
    return name.str.casefold()


def similar(left: DataFrame, right: DataFrame, on: list[str], least: float) -> DataFrame:
    """Pairs of names (l_name < r_name, kinds differ) at or above ``least``, by an equality join on pieces.

    A ratio of t leaves at most (1 - t) of both names' characters unmatched. Each of those, or each place
    where the other name has more, breaks one piece at most; so if the left name is cut into one piece more
    than there can be breaks, some piece stands whole in the right name.
    """
    widest = (2 - least) / least  # of the longer name's length to the shorter one's
    breaks = lambda n: F.floor(n * (1 + widest) * (1 - least) + 1e-9).cast("int")
    size = lambda n: F.greatest(F.lit(1), F.floor(n / (breaks(n) + 1)).cast("int"))
    cuts = lambda s, q, starts: F.array_distinct(F.transform(starts, lambda k: s.substr(k, q)))
    l = left.withColumn("_f", folded("l_name")).where("_f != ''").withColumn("_q", size(F.length("_f")))
    l = l.withColumn("_piece", F.explode(cuts(F.col("_f"), F.col("_q"), F.sequence(F.lit(1), F.length("_f") - F.col("_q") + 1, F.col("_q")))))
    r = right.withColumn("_g", folded("r_name")).where("_g != ''").withColumn("_n", F.length("_g"))
    # The sizes that pieces of names of a fitting length can have.
    fitting = F.array_distinct(F.transform(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("_n") / widest - 1e-9).cast("int")), F.floor(F.col("_n") * widest + 1e-9).cast("int")), size))
    r = r.withColumn("_q", F.explode(fitting)).where("_q <= _n")
    r = r.withColumn("_piece", F.explode(cuts(F.col("_g"), F.col("_q"), F.sequence(F.lit(1), F.col("_n") - F.col("_q") + 1))))
    hits = l.join(r, [*on, "_q", "_piece"]).where((F.col("l_name") < F.col("r_name")) & (F.col("l_kind") != F.col("r_kind")))
    hits = hits.where(2 * F.least(F.length("_f"), F.length("_g")) >= least * (F.length("_f") + F.length("_g")) - 1e-9).drop("_q", "_piece", "_f", "_g", "_n").distinct()
    return hits.withColumn("score", similarity("l_name", "r_name")).where(F.col("score") >= least)


def likely_names(f: Facts) -> DataFrame:
    """OC2001 (each component's best match) and OC3104 (all pairs of pins of a component): names of one view each, alike."""
    def sides(df, keys, name):
        one = df.groupBy(*keys, F.col(name).alias("_n")).agg(F.countDistinct("view").alias("v"), F.min("kind").alias("k"), F.min("view").alias("view")).where("v = 1")
        return [one.select(*keys, F.col("_n").alias(f"{s}_name"), F.col("k").alias(f"{s}_kind"), F.col("view").alias(f"{s}_view")) for s in "lr"]

    both = F.array(evidence("l_view", F.col("l_name")), evidence("r_view", F.col("r_name"))).cast(EVIDENCE)
    c = similar(*sides(f.components, [], "component"), [], 0.92)
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy("l_name").orderBy(F.desc("score"), "r_name"))).where("_k = 1")
    p = similar(*sides(f.ports, ["component"], "port"), ["component"], 0.9)
    told = text(F.col("l_name"), " in ", F.col("l_view"), " resembles ", F.col("r_name"), " in ", F.col("r_view"), ".")
    return finding(c, "OC2001", "component", text("component:", F.col("l_name")), None, told, both).union(finding(p, "OC3104", "port", text("component:", F.col("component"), "/port:", F.col("l_name")), "name", told, both))


@F.udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def parsed(expression: str):
    """A Boolean expression's tokens and variables, or why it isn't one; called once for each distinct expression."""
    try:
        tokens = boolean.postfix(expression or "")
    except boolean.BooleanError as e:
        return None, None, str(e)
    return tokens, boolean.variables(tokens), None


def equivalences(pairs: DataFrame, most: int = 12) -> DataFrame:
    """Adds n_inputs, status (equivalent, different, too-wide, unparsed) and the first counterexample's number to (id, left, right).

    Both sides are run over all assignments of their variables together, False first, the first name as
    the most significant: a fold over tokens in the JVM, 2**most rows for a pair at most.
    """
    every = pairs.select(F.col("left").alias("e")).union(pairs.select("right")).distinct().withColumn("p", parsed("e"))
    j = pairs.join(every.select(F.col("e").alias("left"), F.col("p").alias("l")), "left").join(every.select(F.col("e").alias("right"), F.col("p").alias("r")), "right")
    return compared(j, pairs.columns, most)


def compared(j: DataFrame, columns: list[str], most: int = 12) -> DataFrame:
    """What ``equivalences`` adds, of rows with ``id`` and both sides' tokens, names and errors as ``l`` and ``r``."""
    j = j.withColumn("inputs", F.array_sort(F.array_union("l.names", "r.names")))
    good = F.col("l.error").isNull() & F.col("r.error").isNull() & (F.size("inputs") <= most)
    rows = j.where(good).withColumn("a", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("inputs")).cast("int") - 1)))
    value = lambda s: boolean.truth_table(F.col(f"{s}.tokens"), F.col("inputs"), F.col("a"))
    first = rows.groupBy("id").agg(F.min(F.when(value("l") != value("r"), F.col("a"))).alias("counterexample"))
    status = F.when(F.col("l.error").isNotNull() | F.col("r.error").isNotNull(), "unparsed").when(F.size("inputs") > most, "too-wide").when(F.col("counterexample").isNotNull(), "different").otherwise("equivalent")
    return j.join(first, "id", "left").select(*columns, F.size("inputs").alias("n_inputs"), status.alias("status"), "counterexample", "inputs")


def renamed(f: Facts, used: DataFrame) -> DataFrame:
    """(view, component, expression, p): tokens, names and errors, variables under the canonical names of their view's ports.

    Tokens are exploded with their places, joined to the names and put back in order; components are native.
    """
    at = ["view", "component", "expression"]
    distinct = used.select("expression").distinct().withColumn("p", parsed("expression"))
    u = used.select(*at).distinct().join(distinct, "expression")
    ports = f.ports.select("view", F.col("native_component").alias("component"), F.explode(F.array_distinct(F.array("native_name", names.decoded(F.col("native_name"))))).alias("token"), "port").where("token != port").distinct()
    t = u.select(*at, F.col("p.names").alias("names"), F.posexplode("p.tokens").alias("i", "token")).join(ports, ["view", "component", "token"], "left")
    # A name with several canonical ones keeps its own.
    one = t.groupBy(*at, "i", "token").agg(F.first("names").alias("names"), F.min("port").alias("port"), F.max("port").alias("_other"))
    new = F.when(F.array_contains("names", F.col("token")) & (F.col("port") == F.col("_other")), F.col("port")).otherwise(F.col("token"))
    back = one.withColumn("new", new).groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("tokens"), F.array_sort(F.collect_set(F.when(F.array_contains("names", F.col("token")), F.col("new")))).alias("names"))
    return u.join(back, at, "left").select(*at, F.struct("tokens", "names", F.col("p.error").alias("error")).alias("p"))


def functions(f: Facts) -> DataFrame:
    """OC4301: a view's function differs from the first one's; OC4302: it can't be told; OC4303: it names an unknown pin."""
    used = f["functions"].join(f.components.select("view", F.col("native_name").alias("component"), F.col("component").alias("canonical")).distinct(), ["view", "component"])
    w = Window.partitionBy("canonical", "output").orderBy(F.col("kind") != "liberty", "view")
    r = used.withColumns({"base": F.first("expression").over(w), "base_view": F.first("view").over(w), "base_component": F.first("component").over(w), "kinds": F.size(F.collect_set("kind").over(Window.partitionBy("canonical", "output")))})
    pairs = r.where((F.col("kinds") > 1) & (F.col("view") != F.col("base_view"))).select(F.concat_ws("|", "canonical", "output", "view").alias("id"), F.col("base").alias("left"), F.col("expression").alias("right"), "canonical", "output", "view", "base_view", "component", "base_component")
    named = renamed(f, used)
    left = named.select(F.col("view").alias("base_view"), F.col("component").alias("base_component"), F.col("expression").alias("left"), F.col("p").alias("l"))
    both = pairs.join(left, ["base_view", "base_component", "left"]).join(named.select("view", "component", F.col("expression").alias("right"), F.col("p").alias("r")), ["view", "component", "right"])
    e = compared(both, pairs.columns, f.policy.max_boolean_inputs)
    e = e.withColumn("code", F.when(F.col("status") == "different", "OC4301").when(F.col("status") != "equivalent", "OC4302")).where("code IS NOT NULL")
    id = text("component:", F.col("canonical"), "/port:", F.col("output"))
    found = finding(e, F.col("code"), "port", id, "function", text(F.col("output"), ": ", F.col("left"), " and ", F.col("right"), " are ", F.col("status"), "."), F.array(evidence("base_view", F.col("left")), evidence("view", F.col("right"))).cast(EVIDENCE))
    distinct = used.select("expression").distinct().withColumn("p", parsed("expression"))
    named = used.where(names.view_kind(F.col("kind")) == "liberty").join(distinct, "expression").withColumn("pin", F.explode("p.names"))
    unknown = named.join(f["ports"].select("view", "component", F.col("native_name").alias("pin")).distinct(), ["view", "component", "pin"], "left_anti")
    return found.union(finding(unknown, "OC4303", "port", id, "function", text(F.col("expression"), " names ", F.col("pin"), ", which is no pin."), F.array(evidence("view", F.col("expression"))).cast(EVIDENCE)))


def package_rules(f: Facts) -> DataFrame:
    """OC5001 to OC5006 over pin mappings: package rows are those of CSV views, all others are physical."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    package = F.coalesce(names.view_kind(F.col("kind")) == "csv", F.lit(False))
    physical = F.coalesce((names.view_kind(F.col("kind")) != "csv") & (F.col("die_pad") != ""), F.lit(False))
    used = ~F.upper(F.coalesce("signal", F.lit("NC"))).isin(*NO_CONNECT) & ~blank("signal")
    bad = blank("package_ball") | (blank("die_pad") & blank("signal"))
    m = f["pin_mappings"].select("view", "die_pad", "package_ball", "signal", "component", physical.alias("physical"), (package & bad).alias("bad"), used.alias("used")).where(package | F.col("physical"))
    m, told = written(m, physical=F.count_if("physical"))
    pad_id, ball_id = text("die-pad:", F.col("die_pad")), text("package-ball:", F.col("package_ball"))
    found = finding(m.where("bad"), "OC5006", F.lit(None).cast("string"), F.lit(None).cast("string"), None, text(F.col("view"), ": a row needs a ball and a pad or signal."))
    good = m.where("NOT physical AND NOT bad")
    found = found.union(pad_findings(m.where("NOT bad AND die_pad != ''"), told["physical"] > 0, f.policy.allow_multi_bond))
    if "components" in f.tables:  # without any there is no signal to know
        of = f.components.select(F.col("native_name").alias("component"), F.col("component").alias("canonical")).distinct()
        ports = f.ports.select(F.col("component").alias("canonical"), F.explode(F.array("port", "native_name")).alias("signal")).distinct()
        unknown = good.where("used").join(of, "component").join(ports, ["canonical", "signal"], "left_anti")
        own = F.array(evidence("view", F.coalesce("signal", "die_pad"))).cast(EVIDENCE)
        found = found.union(finding(unknown, "OC5002", "package_ball", ball_id, "signal", text("Ball ", F.col("package_ball"), " names unknown signal ", F.col("signal"), "."), own))
    if f.policy.allow_multi_bond:
        by = good.where("used").groupBy("package_ball").agg(F.countDistinct("signal").alias("n"), gathered(evidence("view", F.col("signal"))).alias("evidence")).where("n > 1")
        return found.union(finding(by, "OC5005", "package_ball", ball_id, "mapping", text("Ball ", F.col("package_ball"), " has several signals."), F.col("evidence")))
    # A ball's pads are sorted as pairs; they become evidence afterwards.
    pairs = F.sort_array(F.collect_list(F.struct("view", "die_pad")))
    balls = good.groupBy("package_ball").agg(pairs.alias("rows")).where(F.size("rows") > 1)
    pieces = F.transform("rows", lambda x: evidence(x["view"], x["die_pad"])).cast(EVIDENCE)
    return found.union(finding(balls, "OC5003", "package_ball", ball_id, "mapping", text("Ball ", F.col("package_ball"), " is mapped ", F.size("rows").cast("string"), " times."), pieces))


def pad_findings(rows: DataFrame, judged: bool, multi_bond: bool) -> DataFrame:
    """OC5001, OC5005 and OC5004 of die pads: all rows of a pad meet in one shuffle, and its findings are read off them.

    Without any physical pad (``judged``) none is missing.
    """
    here = F.when(~F.col("physical"), F.struct("view", "package_ball", "signal", "used"))
    signals = F.collect_set(F.when(F.col("physical") & F.col("used"), F.col("signal")))
    g = rows.groupBy("die_pad").agg(F.bool_or("physical").alias("known"), signals.alias("signals"), F.collect_list(here).alias("rows")).where(F.size("rows") > 0)
    id = text("die-pad:", F.col("die_pad"))
    own = lambda x: F.array(evidence(x["view"], F.coalesce(x["signal"], F.col("die_pad")))).cast(EVIDENCE)
    one = lambda code, property, message, pieces: struct_finding(code, "die_pad", id, property, message, pieces)
    lost = lambda x: one("OC5001", "presence", text("Ball ", x["package_ball"], " names pad ", F.col("die_pad"), ", which is not in the physical design."), own(x))
    other = lambda x: one("OC5005", "signal", text("Pad ", F.col("die_pad"), " has ", x["signal"], " but physically ", F.col("told"), "."), own(x))
    wrong = F.filter("rows", lambda x: x["used"] & ~F.array_contains("signals", x["signal"]))
    lost, other = F.transform("rows", lost), F.transform(F.when(F.size("signals") > 0, wrong).otherwise(F.slice("rows", 1, 0)), other)
    each = F.when(~F.col("known") & F.lit(judged), lost).otherwise(other)
    if not multi_bond:
        balls = F.size(F.array_distinct(F.transform("rows", lambda x: x["package_ball"])))
        many = one("OC5004", "mapping", text("Pad ", F.col("die_pad"), " has ", F.col("n").cast("string"), " balls."), sorted_evidence(F.col("rows"), lambda x: evidence(x["view"], x["package_ball"])))
        g = g.withColumn("n", balls)
        each = F.concat(each, F.when(F.col("n") > 1, F.array(many)).otherwise(F.slice(F.array(many), 1, 0)))
    g = g.withColumn("told", F.array_join(F.array_sort("signals"), ", "))
    return g.select(F.explode(each).alias("x")).select("x.*")


@F.udf(T.StringType())
def _regexp_or_null(pattern: str):
    return names.safe_regexp(pattern or "")


def references(f: Facts) -> DataFrame:
    """OC6001, OC6101 to OC6103, OC6401: no definition has the name; OC1105: a pattern that isn't judged.

    Exact names are an equality join on exploded variants. Patterns are matched against the distinct names
    of their kind only.
    """
    o = f["objects"].withColumn("kind", names.view_kind(F.col("kind"))).withColumn("object_kind", names.lookup(REFERENCE_KINDS, F.col("object_kind"), F.col("object_kind")))
    rtl = f.ports.where(names.view_kind(F.col("kind")) == "rtl")
    defined = [
        f.components.where(names.view_kind(F.col("kind")) == "rtl").select(F.lit("instance").alias("object_kind"), F.explode(F.array_union(names.variants(F.col("native_name")), names.variants(F.col("component")))).alias("variant")),
        rtl.select(F.lit("port").alias("object_kind"), F.explode(F.array_union(names.variants(F.col("native_name"), F.col("native_component")), names.variants(F.col("port"), F.col("component")))).alias("variant")),
        rtl.select(F.lit("port").alias("object_kind"), F.col("native_name"), F.col("native_component"), F.explode("bit_indices").alias("b")).select("object_kind", F.explode(names.variants(F.concat(F.col("native_name"), F.lit("["), F.col("b").cast("string"), F.lit("]")), F.col("native_component"))).alias("variant")),
        o.where((F.col("kind") == "rtl") & (F.col("relation") == "definition")).select("object_kind", F.explode(names.variants(F.col("native_name"), F.col("scope"))).alias("variant")),
    ]
    shared = reduce(DataFrame.union, defined).distinct().withColumn("in_view", F.lit("*"))
    clocks = f["clocks"].select(F.lit("clock").alias("object_kind"), F.explode(names.variants(F.col("native_name"))).alias("variant"), F.col("view").alias("in_view"))
    local = o.where(F.col("relation") == "definition").select("object_kind", F.explode(names.variants(F.col("native_name"), F.col("scope"))).alias("variant"), F.col("view").alias("in_view")).union(clocks).distinct()
    index = shared.union(local.where(~F.col("object_kind").isin("port", "pin", "net", "instance")))
    has_rtl = f["views"].where(names.view_kind(F.col("kind")) == "rtl").limit(1).select(F.lit(True).alias("has_rtl"))
    r = o.where((F.col("relation") == "reference") & F.col("kind").isin("sdc", "upf", "def")).withColumn("ref_id", F.monotonically_increasing_id())
    physical = F.col("object_kind").isin("port", "pin", "net", "instance")
    r = r.join(F.broadcast(has_rtl), how="left").where(~physical | F.coalesce("has_rtl", F.lit(False)))
    r = r.withColumn("in_view", F.when(physical, "*").otherwise(F.col("view")))
    scope = F.when(F.coalesce("scope", F.lit("")) != "", F.col("scope"))
    full = F.when(scope.isNull(), names.variants(F.col("native_name"))).otherwise(F.array_distinct(F.flatten(F.transform(names.variants(scope), lambda s: F.flatten(F.transform(names.variants(F.col("native_name")), lambda v: F.when(v.startswith(F.concat(s, F.lit("/"))) | v.startswith(F.concat(s, F.lit("."))) | (v == s), F.array(v)).otherwise(F.array(F.concat(s, F.lit("/"), v), F.concat(s, F.lit("."), v)))))))))
    r = r.withColumn("variants", full).withColumn("mode", F.when(F.col("match_mode") == "regexp", "regexp").when((F.col("match_mode") == "glob") | F.col("native_name").rlike(r"[*?]"), "glob").otherwise("exact"))
    r = cut(r)  # ref_id must stay as it is
    exact = r.where("mode = 'exact'").withColumn("v", F.explode("variants"))
    hit = exact.where(~F.coalesce("nocase", F.lit(False))).join(index.withColumnRenamed("variant", "v"), ["object_kind", "in_view", "v"], "left_semi").select("ref_id")
    hit = hit.union(exact.where(F.col("nocase")).withColumn("v", F.lower("v")).join(index.withColumn("v", F.lower("variant")), ["object_kind", "in_view", "v"], "left_semi").select("ref_id"))
    searched = index.withColumnRenamed("variant", "name")
    on = ["object_kind", "in_view"]
    globs = r.where("mode = 'glob'").withColumn("pattern", F.explode("variants")).withColumn("nocase", F.coalesce("nocase", F.lit(False)))
    some = patterns.matched(globs.select(*on, "pattern", "nocase"), searched, on).select(*on, "pattern", "nocase").distinct()
    hit = hit.union(globs.join(some, [*on, "pattern", "nocase"], "left_semi").select("ref_id"))
    regexps = r.where("mode = 'regexp'").withColumn("pattern", F.col("native_name")).withColumn("nocase", F.coalesce("nocase", F.lit(False)))
    judged = cut(regexps.select("pattern").distinct().withColumn("safe", _regexp_or_null("pattern")))  # each pattern once
    regexps = regexps.join(judged, "pattern", "left")
    safe = regexps.where("safe IS NOT NULL")
    some = patterns.matched(safe.select(*on, "pattern", "nocase"), searched, on, "regexp").select(*on, "pattern", "nocase").distinct()
    hit = hit.union(safe.join(some, [*on, "pattern", "nocase"], "left_semi").select("ref_id"))
    own = F.array(evidence("view", F.col("native_name"))).cast(EVIDENCE)
    id = text("reference:", F.col("view"), ":", F.col("object_kind"), ":", F.col("native_name"))
    unjudged = finding(regexps.where("safe IS NULL"), "OC1105", F.col("object_kind"), id, "reference", text(F.col("native_name"), " is not judged."), own)
    missing = r.join(hit.distinct(), "ref_id", "left_anti").join(regexps.where("safe IS NULL").select("ref_id"), "ref_id", "left_anti").join(f.whole_tainted, "view", "left_anti")
    scopes = f["views"].select("view", F.explode("tainted_scopes").alias("t"))
    missing = missing.join(scopes, (missing["view"] == scopes["view"]) & F.col("t").isin(F.col("scope"), F.col("native_name"), F.concat_ws("/", "scope", "native_name")), "left_anti")
    code = F.when(F.col("kind") == "sdc", "OC6001").when(F.col("kind") == "def", "OC6401").when(F.col("object_kind") == "instance", "OC6101").when(F.col("object_kind").isin("port", "pin"), "OC6102").otherwise("OC6103")
    return unjudged.union(finding(missing, code, F.col("object_kind"), id, "reference", text(F.upper("kind"), " ", F.col("object_kind"), " ", F.col("native_name"), " does not exist."), own))


def upf_definitions(f: Facts) -> DataFrame:
    """OC6104: a UPF object is defined twice, or updated before or without its one definition."""
    d = f["objects"].where((names.view_kind(F.col("kind")) == "upf") & (F.col("relation") == "definition"))
    update = F.coalesce("is_update", F.lit(False))
    g = d.groupBy("view", "object_kind", F.concat_ws("/", "scope", "native_name").alias("name")).agg(F.count_if(update).alias("u"), F.count_if(~update).alias("i"), F.min(F.when(update, F.col("ordinal"))).alias("first_u"), F.min(F.when(~update, F.col("ordinal"))).alias("first_i"), gathered(evidence("view", F.col("native_name"))).alias("evidence"))
    legal = ((F.col("u") > 0) & (F.col("i") == 1) & (F.col("first_i") < F.col("first_u"))) | ((F.col("u") == 0) & (F.col("i") < 2))
    return finding(g.where(~legal), "OC6104", F.col("object_kind"), text("upf:", F.col("view"), ":", F.col("object_kind"), ":", F.col("name")), "definition", text(F.col("name"), " has ", F.col("i").cast("string"), " definitions and ", F.col("u").cast("string"), " updates."), F.col("evidence"))


def clock_rules(f: Facts) -> DataFrame:
    """OC6002: declarations of one clock differ; OC6003: it targets a port with known roles, none of them clock."""
    c = f["clocks"].withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    spelled = f.ports.select("component", "port", F.explode(F.array_union(names.variants(F.col("port"), F.col("component")), names.variants(F.col("native_name"), F.col("native_component")))).alias("v")).distinct()
    t = c.select("view", "native_name", F.posexplode("targets").alias("k", "target")).withColumn("v", F.explode(names.variants(F.col("target"))))
    exact = t.where(~F.col("target").rlike(r"[*?\[]")).join(spelled, "v").select("view", "native_name", "target", "component", "port")
    wild = t.where(F.col("target").rlike(r"[*?\[]")).withColumnRenamed("v", "pattern")
    hits = patterns.matched(wild.select("pattern"), spelled.select(F.col("v").alias("name")), []).withColumnRenamed("name", "v")
    globbed = wild.join(hits, "pattern").join(spelled, "v").select("view", "native_name", "target", "component", "port")
    targets = cut(exact.union(globbed).distinct())
    named = t.select("view", "native_name", "target").distinct().join(targets, ["view", "native_name", "target"], "left").withColumn("to", F.coalesce(F.when(F.col("port").isNotNull(), F.concat("component", F.lit("/"), "port")), F.translate(names.decoded(F.col("target")), ".", "/")))
    resolved = named.groupBy("view", "native_name").agg(F.array_join(F.array_sort(F.collect_set("to")), ",").alias("to"))
    j = c.join(resolved, ["view", "native_name"], "left").withColumns({"to": F.coalesce("to", F.lit("")), "wave": F.array_join(F.transform("waveform", lambda x: x.cast("string")), ",")})
    differ = generic.conflicts(j, ["native_name"], ["period", "wave", "source", "generated", "to"])
    own = j.groupBy("native_name").agg(gathered(evidence("view", F.concat_ws(" ", F.col("period").cast("string"), "wave", "to"))).alias("evidence"))
    found = finding(differ.join(own, "native_name"), "OC6002", "clock", text("clock:", F.col("native_name")), "clock_definition", text("Clock ", F.col("native_name"), " has conflicting definitions."), F.col("evidence"))
    roles = f.port_values.where("role IS NOT NULL AND view != 'contract.frozen'").groupBy("component", "port").agg(F.collect_set("role").alias("roles"))
    wrong = targets.join(roles, ["component", "port"]).where(~F.array_contains("roles", "clock"))
    return found.union(finding(wrong, "OC6003", "port", port_id(), "role", text("Clock ", F.col("native_name"), " targets ", F.col("component"), "/", F.col("port"), ", which is ", F.array_join(F.array_sort("roles"), "/"), "."), F.array(evidence("view", F.col("target"))).cast(EVIDENCE)))


def interface_rules(f: Facts) -> DataFrame:
    """OC6201: a mapped port does not exist; OC6202: several logical ports map to one."""
    of = f.components.select("view", F.col("native_name").alias("component"), F.col("component").alias("canonical")).distinct()
    i = f["interfaces"].join(of, ["view", "component"]).select("view", "native_name", "canonical", "allow_many_to_one", F.explode("port_maps").alias("logical", "mapped")).withColumn("physical", F.regexp_replace("mapped", r"(?:\[[^\]]+\])+$", ""))
    ports = f.ports.select(F.col("component").alias("canonical"), F.explode(F.array("port", "native_name")).alias("physical")).distinct()
    lost = i.join(ports, ["canonical", "physical"], "left_anti")
    found = finding(lost, "OC6201", "port", text("component:", F.col("canonical"), "/port:", F.col("physical")), "interface.port_map", text(F.col("native_name"), " maps ", F.col("logical"), " to ", F.col("physical"), ", which does not exist."), F.array(evidence("view", F.col("mapped"))).cast(EVIDENCE))
    many = i.where(~F.coalesce("allow_many_to_one", F.lit(False))).groupBy("view", "native_name", "canonical", "physical").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("logical")), ", ").alias("logical")).where("n > 1")
    return found.union(finding(many, "OC6202", "interface", text("interface:", F.col("canonical"), "/", F.col("native_name")), "interface.port_map", text(F.col("logical"), " map to ", F.col("physical"), "."), F.array(evidence("view", F.col("logical"))).cast(EVIDENCE)))


def register_members(f: Facts) -> DataFrame:
    """A row for each register definition with its identity: scoped where some view has the name in several scopes.

    Rows are dealt by component and ``leaf``, the last part of the name, which is also that of the identity: so whatever
    is grouped by name or by identity (and these two) needs no further shuffle.
    """
    r = f["registers"].withColumns({"component": F.lower(names.decoded(F.coalesce("component", F.lit("")))), "name": names.register_name(F.col("native_name"))})
    parts = F.flatten(F.transform(F.array_compact(F.concat(F.array(F.coalesce(F.when(F.col("address_block") != "", F.col("address_block")), F.col("memory_map"))), F.coalesce("register_files", F.array().cast("array<string>")))), lambda p: F.split(p, "/")))
    scope = F.array_join(F.filter(F.transform(parts, lambda p: F.lower(F.trim(names.decoded(p)))), lambda p: p != ""), "/")
    r = r.withColumn("scope", F.when(names.view_kind(F.col("kind")) == "header", "").otherwise(scope)).withColumn("leaf", F.substring_index("name", "/", -1))
    of, scoped = ["component", "leaf", "name"], F.when(F.col("scope") != "", F.col("scope"))
    in_view = Window.partitionBy(*of, "view")
    r = r.repartition("component", "leaf").withColumn("_several", F.min(scoped).over(in_view) != F.max(scoped).over(in_view))
    r = r.withColumn("needs_scope", F.coalesce(F.max("_several").over(Window.partitionBy(*of)), F.lit(False)) & F.col("name").isNotNull()).drop("_several")
    return r.withColumn("register", F.when(F.col("needs_scope") & (F.col("scope") != ""), F.concat_ws("/", "scope", "name")).otherwise(F.col("name")))


#: (component, view) pairs up to which they are sent to all tasks; more are joined by a shuffle.
DECLARED = 100_000


def laid_wrong(fields: Column, size: Column) -> Column:
    """Names of a register's fields that begin within one before them, and of those that reach beyond the register."""
    last = lambda x: x["bit_offset"] + x["bit_width"] - 1
    laid = F.filter(fields, lambda x: (x["status"] == "known") & x["bit_offset"].isNotNull() & x["bit_width"].isNotNull())
    spans = F.array_sort(F.transform(laid, lambda x: F.struct(x["bit_offset"].alias("first"), last(x).alias("last"), x["field"].alias("field"))))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("int").alias("top"), none.alias("bad"))
    step = lambda a, x: F.struct(F.greatest(a["top"], x["last"]).alias("top"), F.when(x["first"] <= a["top"], F.concat(a["bad"], F.array(x["field"]))).otherwise(a["bad"]).alias("bad"))
    return F.concat(F.aggregate(spans, start, step, lambda a: a["bad"]), F.transform(F.filter(laid, lambda x: last(x) >= size), lambda x: x["field"]))


def sorted_evidence(c: Column, piece) -> Column:
    """What ``gathered`` makes of rows, of an array."""
    return F.sort_array(F.transform(c, piece)).cast(EVIDENCE)


def struct_finding(code: Column | str, kind: str, id: Column, property: Column | str, message: Column, pieces: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(code).alias("code"), F.lit(kind).alias("object_kind"), id.alias("object_id"), lit(property).alias("property"), message.alias("message"), pieces.alias("evidence"))


def differs(c: Column, name: str) -> Column:
    v = F.transform(c, lambda x: x[name])
    return F.coalesce(F.array_min(v) != F.array_max(v), F.lit(False))


def register_rules(f: Facts) -> DataFrame:
    """OC6301 to OC6310.

    A row for each register with its first definition in each view is made after one shuffle and written once;
    findings are read off it. Definitions that come again, or whose names need scopes, are kept beside them.
    """
    reg = ["component", "register"]
    fields = F.transform("fields", lambda x: F.struct(F.lower(F.trim(names.decoded(x["name"]))).alias("field"), x["bit_offset"].alias("bit_offset"), x["bit_width"].alias("bit_width"), names.access(x["access"]).alias("access"), x["reset"].alias("reset"), F.coalesce(x["status"], F.lit("known")).alias("status")))
    m = register_members(f)
    m = m.select(*reg, "leaf", "view", "native_name", "name", "scope", "needs_scope", "ordinal", "address_offset", "absolute_address", "size_bits", "access", (F.coalesce("status", F.lit("known")) == "known").alias("known"), "fields")
    each = F.struct("view", F.col("ordinal").isNull().alias("last"), "ordinal", "native_name", "known", "address_offset", "absolute_address", "size_bits", names.access(F.col("access")).alias("access"), F.when(F.col("known"), fields).alias("fields"), "name", "scope", "needs_scope")
    g = m.groupBy("component", "leaf", "register").agg(F.array_sort(F.collect_list(each)).alias("e"))
    same = lambda x, i: (i >= 0) & F.get("e", i)["view"].eqNullSafe(x["view"])
    g = g.select(
        *reg,
        F.filter("e", lambda x, i: ~F.coalesce(same(x, i - 1), F.lit(False))).alias("seen"),
        F.transform(F.filter("e", lambda x, i: x["needs_scope"] | F.coalesce(same(x, i - 1), F.lit(False)) | ((i + 1 < F.size("e")) & F.coalesce(same(x, i + 1), F.lit(False)))), lambda x: F.struct(*[x[c].alias(c) for c in ("view", "native_name", "name", "scope", "needs_scope")])).alias("told"),
    )
    g, measured = written(g, scoped=F.count_if(F.exists("told", lambda t: t["needs_scope"])))

    id = text("register:", F.col("component"), "/", F.col("register"))
    of_view = lambda x: evidence(x["view"], x["native_name"])
    known = F.filter("seen", lambda x: x["known"])
    own = lambda x: F.filter("told", lambda t: t["view"].eqNullSafe(x["view"]))
    again = F.filter(F.when(F.size("told") == 0, F.array().cast("array<struct<view:string,rows:array<string>>>")).otherwise(F.transform("seen", lambda x: F.struct(x["view"].alias("view"), F.transform(own(x), lambda t: t["native_name"]).alias("rows")))), lambda x: F.size(x["rows"]) > 1)
    twice = F.transform(again, lambda x: struct_finding("OC6307", "register", id, "definition", text(x["view"], " defines ", F.col("register"), " ", F.size(x["rows"]).cast("string"), " times."), sorted_evidence(x["rows"], lambda t: evidence(x["view"], t))))
    values = sorted_evidence(F.col("_known"), lambda x: evidence(x["view"], F.concat_ws(" ", x["address_offset"].cast("string"), x["absolute_address"].cast("string"), x["size_bits"].cast("string"), x["access"])))
    one = lambda code, property, test: F.when(test, struct_finding(code, "register", id, property, text(F.col("register"), " differs."), values))
    differ = lambda c: differs(F.col("_known"), c)
    changed = F.array_compact(F.array(one("OC6302", "address", differ("address_offset") | differ("absolute_address")), one("OC6303", "width", differ("size_bits")), one("OC6306", "access", differ("access"))))
    whole = F.when(F.col("register").isNotNull(), F.concat(twice, changed)).otherwise(F.array())
    laid = F.filter(F.transform(F.filter("_known", lambda x: x["fields"].isNotNull()), lambda x: F.struct(x["view"].alias("view"), laid_wrong(x["fields"], x["size_bits"]).alias("bad"))), lambda x: F.size(x["bad"]) > 0)
    wrong = F.transform(laid, lambda x: struct_finding("OC6309", "register", id, "fields.layout", text(F.col("register"), " has an invalid field layout in ", x["view"], "."), sorted_evidence(x["bad"], lambda b: evidence(x["view"], b))))
    found = g.withColumn("_known", known).select(F.explode(F.concat(whole, wrong)).alias("x")).select("x.*")
    found = found.union(missing_registers(f, g, reg, id, of_view, measured["scoped"])).union(field_rules(f, g.where("register IS NOT NULL").select(*reg, known.alias("known")), reg))
    if measured["scoped"]:
        t = scoped_definitions(g, reg)
        amb = t.groupBy("component", "name").agg(F.count_if(F.col("scope") == "").alias("unscoped"), gathered(evidence("view", F.col("native_name"))).alias("evidence")).where("unscoped > 0")
        found = found.union(finding(amb, "OC6310", "register", text("register:", F.col("component"), "/", F.col("name")), "identity", text(F.col("component"), "/", F.col("name"), " is in several scopes."), F.col("evidence")))
    return found


def scoped_definitions(g: DataFrame, reg: list[str]) -> DataFrame:
    return g.select(*reg, F.explode("told").alias("t")).select(*reg, "t.*").where("needs_scope")


def missing_registers(f: Facts, g: DataFrame, reg: list[str], id: Column, of_view, scoped: int) -> DataFrame:
    """OC6301: views that declare the component and lack the register; none for a view with the name under another identity."""
    listed = g.select("component", F.explode("seen.view").alias("view")).distinct()
    if "components" in f.tables:
        listed = listed.union(f["components"].where(names.view_kind(F.col("kind")).isin(*REGISTER_KINDS)).select(F.lower(names.decoded(F.col("native_name"))), "view")).distinct()
    listed, measured = written(listed)
    declared = listed.groupBy("component").agg(F.collect_set("view").alias("declared"))
    declared = F.broadcast(declared) if measured["n"] <= DECLARED else declared
    tainted = F.broadcast(f.whole_tainted.agg(F.collect_set("view").alias("tainted")))
    lacks = F.array_except(F.array_except("declared", F.transform("seen", lambda x: x["view"])), "tainted")
    r = g.where("register IS NOT NULL").join(declared, "component").crossJoin(tainted).withColumn("missing", lacks).where(F.size("missing") > 0)
    r = r.select(*reg, "missing", sorted_evidence(F.col("seen"), of_view).alias("evidence"))
    if scoped:
        t = scoped_definitions(g, reg).select(*reg, "name", "view", (F.col("scope") != "").alias("scoped")).distinct()
        other = t.select("component", F.col("name").alias("_name"), F.col("view").alias("_view"), F.col("scoped").alias("_s")).distinct()
        spared = t.select(*reg, "scoped").distinct().join(other, "component").where((F.col("scoped") != F.col("_s")) & F.substring_index("register", "/", -1).eqNullSafe(F.col("_name"))).groupBy(*reg).agg(F.collect_set("_view").alias("spared"))
        r = r.join(spared, reg, "left").withColumn("missing", F.when(F.col("spared").isNull(), F.col("missing")).otherwise(F.array_except("missing", "spared"))).where(F.size("missing") > 0)
    return finding(r, "OC6301", "register", id, "presence", text(F.col("register"), " is missing from ", F.array_join(F.array_sort("missing"), ", "), "."), F.col("evidence"))


def field_rules(f: Facts, known: DataFrame, reg: list[str]) -> DataFrame:
    """OC6304 to OC6308 of register fields.

    Registers whose views list the same fields, each once, have none. All fields of a register stand in its row, so
    those of the others are compared there: nothing is shuffled.
    """
    none = F.array().cast("array<struct<field:string,bit_offset:int,bit_width:int,access:string,reset:decimal(38,0),status:string>>")
    listed = lambda x: F.coalesce(x["fields"], none)
    unlike = F.exists("known", lambda x: ~listed(x).eqNullSafe(listed(F.col("known")[0])))
    odd = F.exists("known", lambda x: (F.size(F.array_distinct(F.transform(listed(x), lambda y: y["field"]))) != F.size(listed(x))) | F.exists(listed(x), lambda y: y["field"].isNull()))
    x = known.where((F.size("known") > 0) & (unlike | odd))
    x = x.select(*reg, "known", F.explode(F.array_distinct(F.flatten(F.transform("known", lambda x: F.transform(listed(x), lambda y: y["field"]))))).alias("field"))
    own = lambda x: F.filter(listed(x), lambda y: y["field"].eqNullSafe(F.col("field")))
    per_view = F.transform("known", lambda x: F.struct(x["view"].alias("view"), own(x).alias("rows")))
    g = x.select(*reg, "field", F.explode(F.array(per_view)).alias("each"))
    here = F.filter("each", lambda x: F.size(x["rows"]) > 0)
    told = lambda x: F.get(F.filter(x["rows"], lambda y: y["status"] == "known"), F.lit(0))
    seen = F.transform(here, lambda x: F.struct(x["view"].alias("view"), F.size(x["rows"]).alias("n"), told(x).alias("first")))
    tainted = F.broadcast(f.whole_tainted.agg(F.collect_set("view").alias("tainted")))
    g = g.select(*reg, "field", F.transform("each", lambda x: x["view"]).alias("views"), F.explode(F.array(seen)).alias("seen"))
    present = F.when(F.col("field").isNull(), F.array().cast("array<string>")).otherwise(F.transform("seen", lambda x: x["view"]))
    first = F.transform(F.filter("seen", lambda x: x["first"].isNotNull()), lambda x: F.struct(x["view"].alias("view"), *[x["first"][c].alias(c) for c in ("bit_offset", "bit_width", "access", "reset")]))
    g = g.crossJoin(tainted).select(*reg, "field", "seen", F.explode(F.array(first)).alias("first"), F.array_except(F.array_except("views", present), "tainted").alias("missing"))
    fid = text("register:", F.col("component"), "/", F.col("register"), "/field:", F.col("field"))
    twice = F.transform(F.filter("seen", lambda x: x["n"] > 1), lambda x: struct_finding("OC6307", "field", fid, "definition", text(x["view"], " defines ", F.col("field"), " ", x["n"].cast("string"), " times."), F.array_repeat(evidence(x["view"], F.col("field")), x["n"].cast("int")).cast(EVIDENCE)))
    gone = sorted_evidence(F.col("missing"), lambda v: evidence(v, F.lit("missing")))
    absent = F.when(F.size("missing") > 0, struct_finding("OC6304", "field", fid, "presence", text(F.col("field"), " is missing from ", F.array_join(F.array_sort("missing"), ", "), "."), gone))
    values = sorted_evidence(F.col("first"), lambda x: evidence(x["view"], F.concat_ws(" ", x["bit_offset"].cast("string"), x["bit_width"].cast("string"), x["access"], x["reset"].cast("string"))))
    changed = lambda code, property, *c: F.when(reduce(Column.__or__, [differs(F.col("first"), k) for k in c]), struct_finding(code, "field", fid, property, text(F.col("field"), " differs."), values))
    named = F.concat(twice, F.array_compact(F.array(changed("OC6305", "layout", "bit_offset", "bit_width"), changed("OC6306", "access", "access"), changed("OC6308", "reset", "reset"))))
    rows = F.concat(F.array_compact(F.array(absent)), F.when(F.col("field").isNotNull(), named).otherwise(F.array()))
    return g.select(F.explode(rows).alias("x")).select("x.*")


def connectivity_rules(f: Facts) -> DataFrame:
    """OC6501 to OC6509: requirements on whole selectors, bit by bit, in each view that has endpoints.

    Endpoints of both sides are paired by position (identity), from the other end (reverse) or all with all
    of one requirement (any); a requirement's verdict is its worst pair's. Waypoints and exclusions are
    selectors too: any bit of a waypoint will do, every bit of an exclusion counts. A missing pair whose
    source reaches another bit of the sink is OC6507. Views are judged apart; a view that is itself wholly tainted
    leaves its verdicts open, and a tainted scope those whose search comes into it. A selector's base may be a pattern that one signal of the view matches;
    if several do, it is ambiguous (OC6502).
    """
    q = f["requirements"]
    same = ["source", "sink", F.coalesce("through", F.array().cast("array<string>")), F.coalesce("exclude", F.array().cast("array<string>"))]
    groups = {"_i": Window.partitionBy("id").orderBy("ordinal"), "_r": Window.partitionBy(*same, F.coalesce("transform", F.lit("any"))).orderBy("ordinal"), "_o": Window.partitionBy(*same).orderBy("ordinal")}
    q = q.withColumns({n: F.first("ordinal").over(w) for n, w in groups.items()} | {"_e": F.first("expectation").over(groups["_o"])})
    again = [F.col("_i") != F.col("ordinal"), F.col("_r") != F.col("ordinal"), F.col("_e") != F.col("expectation")]
    q = q.withColumn("_earlier", F.array_compact(F.array(*[F.when(c, F.col(n)) for c, n in zip(again, groups, strict=True)])))
    twice = q.where(F.size("_earlier") > 0)
    own = lambda view: F.array(evidence(F.lit(view), F.col("id"))).cast(EVIDENCE)
    id = text("connectivity:", F.col("id"))
    found = finding(twice, "OC6509", "requirement", id, "requirement", text("Requirement ", F.col("id"), " repeats or contradicts an earlier one."), own("connectivity.default"))
    # Neither a conflicting requirement nor the earlier one is judged.
    void = twice.select(F.explode(F.concat("_earlier", F.array("ordinal"))).alias("ordinal")).distinct()
    q = q.join(void, "ordinal", "left_anti").drop("_earlier", "_e", *groups)
    own_view = lambda: F.array(evidence("view", F.col("id"))).cast(EVIDENCE)
    indexed = F.when(F.col("bit_index").isNotNull(), F.concat("native_name", F.lit("["), F.col("bit_index").cast("string"), F.lit("]"))).otherwise(F.col("native_name"))
    ends = f["endpoints"].select("view", F.col("native_name").alias("base"), "bit_index", indexed.alias("key")).distinct()
    # A requirement in a view is one of its own; views are few.
    seen = ends.select("view").distinct().join(f.whole_tainted.withColumn("open", F.lit(True)), "view", "left").fillna(False, ["open"])
    q = cut(q.join(seen).withColumn("rid", F.concat_ws("\u0001", "view", "id")))
    absent = f["requirements"].select("id", "ordinal").join(void, "ordinal", "left_anti").join(seen.select(F.lit(1).alias("_any")).limit(1), how="left_anti")
    found = found.union(finding(absent, "OC6501", "requirement", id, "endpoint", text("Requirement ", F.col("id"), " has no view with endpoints."), own("connectivity.default")))

    def matched(p: DataFrame) -> DataFrame:
        """Rows with view and selector ``x`` by the bits that it names: key (null without any), sel, bit_index, a, b."""
        pattern = r"^(.+?)(?:\[(\*|[+-]?\d+|[+-]?\d+\s*:\s*[+-]?\d+)\])?$"
        p = p.withColumns({"base": F.regexp_extract("x", pattern, 1), "sel": F.regexp_extract("x", pattern, 2)})
        lo, hi = (F.try_to_number(F.trim(F.substring_index("sel", ":", k)), F.lit("S999999999")).cast("int") for k in (1, -1))
        p = p.withColumns({"a": lo, "b": hi})
        inside = F.col("e.sel").isin("", "*") | F.col("n.bit_index").between(F.least("e.a", "e.b"), F.greatest("e.a", "e.b"))
        wild = p.where(F.col("base").rlike("[*?]")).select("view", F.col("base").alias("pattern")).distinct()
        bases = patterns.matched(wild, ends.select("view", F.col("base").alias("name")), ["view"]).groupBy("view", F.col("pattern").alias("base")).agg(F.min("name").alias("only"), (F.count("*") > 1).alias("several"))
        p = p.join(bases, ["view", "base"], "left").withColumns({"several": F.coalesce("several", F.lit(False)), "base": F.when(F.col("base").rlike("[*?]"), F.when(~F.col("several"), F.col("only"))).otherwise(F.col("base"))}).drop("only")
        on = (F.col("e.view") == F.col("n.view")) & (F.col("e.base") == F.col("n.base")) & inside
        return p.alias("e").join(ends.alias("n"), on, "left").select("e.*", "n.key", "n.bit_index")

    def side(name: str) -> DataFrame:
        hit = matched(q.select("rid", "view", F.col(name).alias("x")))
        down = F.col("a") > F.col("b")
        order = F.row_number().over(Window.partitionBy("rid").orderBy(F.when(F.coalesce(down, F.lit(True)), -F.coalesce("bit_index", F.lit(0))).otherwise(F.coalesce("bit_index", F.lit(0)))))
        return hit.select("rid", "key", "several", order.alias("place"), F.when(F.col("sel").contains(":"), F.abs(F.col("a") - F.col("b")) + 1).when(F.col("sel").isin("", "*"), None).otherwise(1).alias("wanted"))

    def listed(name: str) -> DataFrame:
        """By requirement the nodes of each selector of a list, in order, and how many selectors name nothing."""
        one = q.select("rid", "view", F.posexplode(name).alias("pos", "x"))
        bits = matched(one).groupBy("rid", "pos").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.max("several").alias("several"))
        return bits.groupBy("rid").agg(F.max("several").alias(f"{name}_several"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "keys"))), lambda p: p["keys"]).alias(f"{name}_keys"), F.count_if(F.size("keys") == 0).alias(f"{name}_lost"))

    s, t = cut(side("source")), cut(side("sink"))
    sizes = [x.groupBy("rid").agg(F.count("key").alias(f"{n}_n"), F.max("wanted").alias(f"{n}_w"), F.max("several").alias(f"{n}_several")) for x, n in ((s, "s"), (t, "t"))]
    z = q
    for x in (*sizes, listed("through"), listed("exclude")):
        z = z.join(x, "rid", "left")
    z = cut(z.fillna(0, ["s_n", "t_n", "through_lost", "exclude_lost"]))
    several = reduce(lambda x, y: x | y, [F.coalesce(f"{n}_several", F.lit(False)) for n in ("s", "t", "through", "exclude")])
    found = found.union(finding(z.where(several), "OC6502", "requirement", id, "endpoint", text("Requirement ", F.col("id"), " has a selector that matches several signals in ", F.col("view"), "."), own_view()))
    z = cut(z.where(~several))
    none = (F.col("s_n") == 0) | (F.col("t_n") == 0) | (F.col("s_n") < F.coalesce("s_w", F.lit(0))) | (F.col("t_n") < F.coalesce("t_w", F.lit(0))) | (F.col("through_lost") + F.col("exclude_lost") > 0)
    found = found.union(finding(z.where(none), "OC6501", "requirement", id, "endpoint", text("Requirement ", F.col("id"), " names endpoints that do not exist in ", F.col("view"), "."), own_view()))
    mapped = F.coalesce("transform", F.lit("any")) != "any"
    uneven = z.where(~none & mapped & (F.col("s_n") != F.col("t_n")))
    found = found.union(finding(uneven, "OC6506", "requirement", id, "width", text("Requirement ", F.col("id"), " has ", F.col("s_n").cast("string"), " sources and ", F.col("t_n").cast("string"), " sinks."), own_view()))
    good = z.where(~none & ~(mapped & (F.col("s_n") != F.col("t_n"))))
    pairs = good.join(s.select("rid", F.col("key").alias("from"), F.col("place").alias("i")), "rid").join(t.select("rid", F.col("key").alias("to"), F.col("place").alias("j")), "rid")
    rev = F.col("transform") == "reverse"
    paired = pairs.where(~mapped | F.when(rev, F.col("i") + F.col("j") == F.col("s_n") + 1).otherwise(F.col("i") == F.col("j")))
    # Nodes of different views are different nodes.
    node = lambda c: F.concat(F.col("view"), F.lit("\u0003"), c)
    waypoints = F.transform(F.coalesce("through_keys", F.array().cast("array<array<string>>")), lambda keys: F.array_join(F.transform(keys, node), graph.OR))
    barred = F.transform(F.flatten(F.coalesce("exclude_keys", F.array().cast("array<array<string>>"))), node)
    pid = F.concat_ws("\u0001", "rid", "from", "to").alias("id")
    asked = lambda transform: [pid, node(F.col("from")).alias("source"), node(F.col("to")).alias("sink"), "expectation", transform.alias("transform"), waypoints.alias("through"), barred.alias("exclude"), "open"]
    single = paired.select(*asked(F.when(F.col("transform") == "inverted", "inverted").when(mapped, "identity").otherwise("any")))
    edges = f["edges"].select(node(F.col("source")).alias("source"), node(F.col("sink")).alias("sink"), "inverted", "status")
    part = lambda k: F.get(F.split("id", "\u0001"), F.lit(k))
    single = cut(single)
    # Whatever lies in a scope that its view does not know whole may have edges that are not there.
    scopes = f["views"].select("view", F.explode("tainted_scopes").alias("scope")).where("scope != '*'").distinct()
    every = f["edges"].select("view", F.col("source").alias("key")).union(f["edges"].select("view", "sink")).union(ends.select("view", "key")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("key", "[/.]"))), lambda k: F.concat_ws("/", F.slice(F.split(F.regexp_replace("key", r"\[[^\]]*\]$", ""), "[/.]"), F.lit(1), k)))
    dark = cut(every.withColumn("scope", F.explode(above)).join(scopes.withColumn("scope", F.translate("scope", ".", "/")), ["view", "scope"]).select(node(F.col("key")).alias("node")).distinct())
    searched = graph.search(edges, single.withColumnRenamed("source", "node"), True)
    verdict = cut(graph.judged(edges, single, proofs=True, found=searched, dark=dark).select(F.concat_ws("\u0001", part(0), part(1)).alias("rid"), part(2).alias("from"), "verdict", "proof"))
    # Of mapped pairs that are missing: does the source reach another bit of the sink?
    lost = verdict.where("verdict = 'missing'").select("rid", "from")
    other = pairs.where(mapped & (F.col("expectation") == "reachable") & ~F.when(rev, F.col("i") + F.col("j") == F.col("s_n") + 1).otherwise(F.col("i") == F.col("j"))).join(lost, ["rid", "from"], "left_semi")
    again = other.select(pid, "rid", "from").join(single.select(F.concat_ws("\u0001", part(0), part(1)).alias("rid"), part(2).alias("from"), F.col("id").alias("of")), ["rid", "from"])
    astray = graph.judged(edges, other.select(*asked(F.lit("any"))), found=searched.like(again), dark=dark).where("verdict = 'pass'").select(F.concat_ws("\u0001", part(0), part(1)).alias("rid"), part(2).alias("from"), F.lit(True).alias("astray")).distinct()
    verdict = verdict.join(astray, ["rid", "from"], "left").withColumn("verdict", F.when(F.col("astray"), "bits").otherwise(F.col("verdict")))
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("pass", 0, "inconclusive", 1, "polarity", 2, "bits", 3, "missing", 4, "forbidden", 5)]), F.col("verdict"))
    worst = verdict.groupBy("rid").agg(F.max(F.struct(rank.alias("rank"), "verdict", F.coalesce("proof", F.array().cast("array<string>")).alias("proof"))).alias("m"))
    worst = worst.select(F.substring_index("rid", "\u0001", 1).alias("view"), F.substring_index("rid", "\u0001", -1).alias("id"), "m.verdict", "m.proof").where("verdict != 'pass'")
    code = F.element_at(F.create_map(*[F.lit(x) for x in ("inconclusive", "OC6505", "polarity", "OC6508", "bits", "OC6507", "missing", "OC6503", "forbidden", "OC6504")]), F.col("verdict"))
    # The witness of a path, or where what was reached ends, as evidence.
    shown = F.concat(own_view(), F.transform("proof", lambda n: F.struct(F.col("view").alias("view"), F.substring_index(n, "\u0003", -1).alias("value"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column")))).cast(EVIDENCE)
    return found.union(finding(worst, code, "requirement", id, "connectivity", text("Requirement ", F.col("id"), " in ", F.col("view"), ": ", F.col("verdict"), "."), shown))


def scope_taint(f: Facts) -> DataFrame:
    """OC1104: an incomplete view for which no parser has said why; and what the parsers have said."""
    silent = f["views"].where(~F.col("complete")).join(f["parser_diagnostics"].select("view"), "view", "left_anti")
    found = finding(silent, "OC1104", "view", text("view:", F.col("view")), "scope", text(F.col("view"), " is incomplete."), F.array(evidence("view")).cast(EVIDENCE))
    p = f["parser_diagnostics"]
    return found.union(finding(p, F.col("code"), "view", text("view:", F.col("view")), "parse", F.col("message"), F.array(evidence("view", F.col("scope"), True)).cast(EVIDENCE)))


ALL = (
    scope_taint, alias_collisions, duplicate_components, duplicate_pins, component_inventory, pin_inventory, port_conflicts, bus_integrity, likely_names, functions, package_rules,
    references, upf_definitions, clock_rules, interface_rules, register_rules, connectivity_rules,
)
#: The families without which a rule has nothing to say; its jobs are not planned then.
NEEDS = {functions: "functions", package_rules: "pin_mappings", references: "objects", upf_definitions: "objects", clock_rules: "clocks", interface_rules: "interfaces", register_rules: "registers", connectivity_rules: "requirements"}


def all_findings(f: Facts, checkers: tuple = ()) -> DataFrame:
    """Every rule's findings; ``checkers`` are further rules of the user, given the facts."""
    out = [rule(f) for rule in ALL if NEEDS.get(rule, "views") in f.tables]
    return reduce(DataFrame.unionByName, out + [checked(f, c) for c in checkers], f.spark.createDataFrame([], FINDING))


#: Findings of one user's rule at most; a rule with more has failed, as a whole.
MOST_FINDINGS = 10_000


def checked(f: Facts, checker) -> DataFrame:
    """A user's rule; OC9002 in place of its findings if it raises, also where Spark runs it, gives no findings table or too many."""
    name = getattr(checker, "__name__", type(checker).__name__)
    none = f.spark.createDataFrame([], FINDING)
    try:
        out, told = written(none.unionByName(checker(f)))  # counted as it is written
        if told["n"] > MOST_FINDINGS:
            raise ValueError(f"{told['n']} findings, {MOST_FINDINGS} are allowed")
        return out
    except Exception as e:  # fail closed: one checker never ends the check
        told = f.spark.createDataFrame([(name, f"{type(e).__name__}: {e}"[:500])], "n string, m string")
        return finding(told, "OC9002", "checker", text("checker:", F.col("n")), "plugin", text("The checker ", F.col("n"), " failed: ", F.col("m")))


assert set(NEEDS.values()) <= set(SCHEMAS)
