"""The check: rules, severities, waivers, order, exit code.

``check`` returns the diagnostics as a DataFrame; nothing is collected before ``exit_code`` or a report.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.model import EVIDENCE, SEVERITIES, catalog
from factloom.operators import generic
from factloom.operators.rules import Facts, all_findings
from factloom.operators.shared import cut

SORT = ("rank", "code", "object_id", "views", "source", "line", "column", "message")


def rank(severity):
    """0 for fatal to 3 for info."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def diagnosed(findings: DataFrame, rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings with severity (overridden where allowed: a fatal one stays), views, place and fingerprint."""
    told = findings.join(F.broadcast(rules), "code", "left").join(overrides.withColumnRenamed("severity", "_other"), "code", "left")
    told = told.withColumn("severity", F.when((F.col("severity") != "fatal") & F.col("_other").isNotNull(), F.col("_other")).otherwise(F.col("severity"))).drop("_other", "rank")
    views = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["view"])))
    first = F.get(F.filter("evidence", lambda e: e["source"].isNotNull()), F.lit(0))
    told = told.withColumns({"views": views, "source": F.coalesce(first["source"], F.lit("")), "line": F.coalesce(first["line"], F.lit(0)), "column": F.coalesce(first["column"], F.lit(0)), "rank": rank(F.col("severity"))})
    return told.withColumn("fingerprint", generic.fingerprint(F.col("code"), F.col("object_id"), F.col("property"), F.col("views")))


def waiver_matches():
    """Whether a waiver covers a diagnostic: code, object and property patterns, fingerprint, and every view selector."""
    view = lambda sel: F.exists("views", lambda v: names.selector_rank(v, F.substring_index(v, ".", 1), sel).isNotNull())
    return (
        names.glob(F.col("code"), F.col("w_code"))
        & names.glob(F.coalesce("object_id", F.lit("")), F.col("object_pattern"))
        & (F.col("property_pattern").isNull() | names.glob(F.coalesce("property", F.lit("")), F.col("property_pattern")))
        & (F.col("w_fingerprint").isNull() | (F.col("w_fingerprint") == F.col("fingerprint")))
        & F.forall(F.coalesce("w_views", F.array().cast("array<string>")), view)
    )


def waived(diagnostics: DataFrame, waivers: DataFrame, today: date, report_unmatched: bool = True) -> DataFrame:
    """Adds ``waiver`` (the first live one that matches; fatal findings have none) and the waivers' own findings."""
    d = cut(diagnostics.withColumn("_id", F.monotonically_increasing_id()))  # joined by _id, which must stay as it is
    w = waivers.select("waiver_index", F.col("code").alias("w_code"), "object_pattern", "property_pattern", F.col("fingerprint").alias("w_fingerprint"), F.col("views").alias("w_views"), "reason", "expires")
    old = F.coalesce(F.col("expires") < F.lit(today), F.lit(False))
    live = w.where(~old)
    hit = generic.first_match(d.where("severity != 'fatal'").select("_id", "code", "object_id", "property", "fingerprint", "views"), live, waiver_matches(), "waiver_index", ["_id"])
    out = d.join(hit, "_id", "left").withColumnRenamed("waiver_index", "waiver").drop("_id")
    none = F.array().cast(EVIDENCE)

    def own(rows: DataFrame, code: str, severity: str, what: str) -> DataFrame:
        id = F.concat(F.lit("waiver:"), F.col("waiver_index").cast("string"))
        made = rows.select(F.lit(code).alias("code"), F.lit("waiver").alias("object_kind"), id.alias("object_id"), F.lit(None).cast("string").alias("property"), F.concat(F.lit(what), F.coalesce("reason", F.lit(""))).alias("message"), none.alias("evidence"), F.lit({"OC1004": "waiver-expired", "OC1005": "waiver-unmatched"}[code]).alias("rule"), F.lit(severity).alias("severity"), F.array().cast("array<string>").alias("views"), F.lit("").alias("source"), F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit(SEVERITIES.index(severity)).alias("rank"))
        return made.withColumns({"fingerprint": generic.fingerprint(F.col("code"), F.col("object_id"), F.col("property"), F.col("views")), "waiver": F.lit(None).cast("int")})

    out = out.unionByName(own(w.where(old), "OC1004", "warning", "Expired waiver: "))
    if report_unmatched:
        out = out.unionByName(own(live.join(hit.select("waiver_index").distinct(), "waiver_index", "left_anti"), "OC1005", "info", "Unmatched waiver: "))
    return out


def ordered(diagnostics: DataFrame) -> DataFrame:
    """The total order of a report."""
    return diagnostics.orderBy(*[F.coalesce(c, F.lit("")) if c in ("object_id", "message") else F.col(c) for c in SORT])


def check(facts: Facts, today: date | None = None, checkers: tuple = ()) -> DataFrame:
    """All diagnostics of a project, in order."""
    found = diagnosed(all_findings(facts, checkers), catalog(facts.spark), facts["overrides"])
    return ordered(waived(found, facts["waivers"], today or date.today(), facts.policy.report_unmatched_waivers))


def exit_code(diagnostics: DataFrame, deny_warnings: bool = False) -> int:
    """2 with an active fatal finding, 1 with an error (or a warning if those are denied), else 0."""
    worst = diagnostics.where("waiver IS NULL").agg(F.min("rank")).first()[0]
    return 0 if worst is None else {0: 2, 1: 1}.get(worst, 1 if worst == 2 and deny_warnings else 0)


def summary(diagnostics: DataFrame) -> DataFrame:
    """By severity: active and waived findings."""
    return diagnostics.groupBy("severity").agg(F.count_if(F.col("waiver").isNull()).alias("n_active"), F.count_if(F.col("waiver").isNotNull()).alias("n_waived"))
