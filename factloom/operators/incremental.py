"""Checks that cost what has changed: findings kept by rule and entity, and renewed for touched entities only.

Most rules judge a component by its own rows. What a changed view adds or takes away names the components it
touches; the facts of those are found by semi joins, the rules run over them alone, and their findings take the place
of the old ones of the same components. A rule that looks across components runs again in full, but only if a family
that it reads has changed. A change of views' completeness, aliases, participation or policy may touch anything.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .digests import row_json
from .rules import Facts
from .shared import written

#: Rules that judge each component by its own rows.
LOCAL = (rules.alias_collisions, rules.duplicate_components, rules.duplicate_pins, rules.component_inventory, rules.pin_inventory, rules.port_conflicts, rules.bus_integrity, rules.functions)
#: The families that the other rules read, besides the views.
READS = {
    rules.scope_taint: ("parser_diagnostics",), rules.likely_names: ("components", "ports", "aliases"), rules.package_rules: ("pin_mappings", "components", "ports"),
    rules.references: ("objects", "clocks", "components", "ports"), rules.upf_definitions: ("objects",), rules.clock_rules: ("clocks", "components", "ports"), rules.interface_rules: ("interfaces", "components", "ports"),
    rules.register_rules: ("registers", "components"), rules.connectivity_rules: ("requirements", "endpoints", "edges"),
}
#: Families with rows of components, and the column that names them.
OWNED = {"components": "native_name", "ports": "component", "functions": "component"}
#: Whatever these say may concern any component.
GLOBAL = ("views", "aliases", "participation")


def entity() -> Column:
    """The component that a finding is about, null for others."""
    return F.when(F.col("object_id").startswith("component:"), F.regexp_replace(F.substring("object_id", 11, 1 << 30), r"/port:.*$", ""))


def findings(facts: Facts, of: tuple = rules.ALL) -> DataFrame:
    """All findings with ``rule`` and ``entity``: the table that ``updated`` keeps."""
    local = {r.__name__ for r in LOCAL}
    parts = [r(facts).withColumn("rule", F.lit(r.__name__)) for r in of if rules.NEEDS.get(r, "views") in facts.tables]
    return reduce(DataFrame.unionByName, parts).withColumn("entity", F.when(F.col("rule").isin(*local), entity()))


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of rows that one side has more often than the other."""
    a, b = (x.select(*keys, F.sha2(row_json(x), 256).alias("_d"), F.lit(s).alias("_s")) for x, s in ((before, -1), (after, 1)))
    return a.union(b).groupBy(*keys, "_d").agg(F.sum("_s").alias("_n")).where("_n != 0").select(*keys).distinct()


def touched(before: Facts, after: Facts, changed: list[str]) -> DataFrame | None:
    """(component): canonical components that rows of the changed views touch, before or after; None if anything may be touched."""
    if before.policy != after.policy or any(not changed_rows(before[f], after[f], []).isEmpty() for f in GLOBAL if f in before.tables or f in after.tables):
        return None
    some = F.col("view").isin(*changed) if changed else F.lit(False)
    native = [changed_rows(before[f].where(some), after[f].where(some), ["view", c]).select("view", F.col(c).alias("native_name")) for f, c in OWNED.items()]
    native = reduce(DataFrame.union, native).distinct()
    hit = [f.components.join(native, ["view", "native_name"], "left_semi").select("component") for f in (before, after)]
    frozen = changed_rows(before["contract_ports"], after["contract_ports"], ["component"])
    return written(reduce(DataFrame.union, [*hit, frozen]).distinct())[0]


def restricted(facts: Facts, components: DataFrame) -> Facts:
    """The facts of some components: rows of others are left out of the families that belong to components."""
    own = facts.components.join(components, "component", "left_semi").select("view", "native_name").distinct()
    own = written(own)[0]
    tables = dict(facts.tables)
    for family, column in OWNED.items():
        if family in tables:
            tables[family] = tables[family].join(own.withColumnRenamed("native_name", column), ["view", column], "left_semi")
    if "contract_ports" in tables:
        tables["contract_ports"] = tables["contract_ports"].join(components, "component", "left_semi")
    return replace(facts, tables=tables)


def updated(old: DataFrame, before: Facts, after: Facts, changed: list[str], of: tuple = rules.ALL) -> DataFrame:
    """The findings of ``after``, from those of ``before`` (with rule and entity) and what the changed views touch."""
    some = touched(before, after, changed)
    if some is None:
        return findings(after, of)
    local = [r for r in of if r in LOCAL]
    new = findings(restricted(after, some), tuple(local))
    kept = old.join(some.withColumnRenamed("component", "entity"), "entity", "left_anti").where(F.col("rule").isin(*[r.__name__ for r in local])).select(*old.columns)
    parts = [kept, new.select(*old.columns)]
    family: dict[str, bool] = {}
    for r in of:
        if r in LOCAL:
            continue
        for f in READS[r]:
            if f not in family:
                family[f] = not changed_rows(before[f], after[f], []).isEmpty()
        fresh = any(family[f] for f in READS[r])
        parts.append(findings(after, (r,)).select(*old.columns) if fresh and rules.NEEDS.get(r, "views") in after.tables else old.where(F.col("rule") == r.__name__))
    return reduce(DataFrame.union, parts)


def saved(found: DataFrame) -> tuple[DataFrame, int]:
    """The keyed findings written to the shared folder, and how many they are."""
    df, told = written(found)
    return df, told["n"]
