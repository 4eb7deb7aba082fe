"""Reviews: reports against a baseline, contracts built from observations, contracts against contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import generic
from .rules import Facts

STATES = ("new", "changed", "unchanged", "resolved")


def with_digest(diagnostics: DataFrame) -> DataFrame:
    """Adds ``digest``: SHA-256 of what a finding says, its waiver included."""
    body = F.struct("code", "severity", "object_id", "property", "message", "evidence", F.col("waiver").isNotNull().alias("waived"))
    return diagnostics.withColumn("digest", F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256))


def report_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """fingerprint, state, before_digest, after_digest of every occurrence in either report, in the review's order."""
    out = generic.paired_changes(with_digest(baseline), with_digest(current), "fingerprint", "digest", ["message"])
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return out.orderBy(place, "fingerprint", F.coalesce("after_digest", F.lit("")), F.coalesce("before_digest", F.lit("")))


def build_contract(facts: Facts) -> DataFrame:
    """The frozen ports of a design: component, port, direction, role, width, and the views that have it.

    A value is frozen if all known ones agree; the digest is that of the whole row.
    """
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    v = facts.port_values.where("view != 'contract.frozen'").groupBy("component", "port").agg(one("direction"), one("role"), one("width"), F.array_join(F.array_sort(F.collect_set("view")), ",").alias("views"))
    return v.withColumn("digest", F.sha2(F.to_json(F.struct(*v.columns), {"ignoreNullFields": "false"}), 256))


def contract_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """component, port, state (added, removed, changed) by the rows' digests."""
    a, b = (x.select("component", "port", F.col("digest").alias(n)) for x, n in ((before, "before_digest"), (after, "after_digest")))
    j = a.join(b, ["component", "port"], "full").where(~F.col("before_digest").eqNullSafe(F.col("after_digest")))
    return j.withColumn("state", F.when(F.col("before_digest").isNull(), "added").when(F.col("after_digest").isNull(), "removed").otherwise("changed"))
