"""Deadlines and bounds abort; nothing is cut."""

import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import rules
from factloom.plans import guard


def test_jobs_are_cancelled_at_the_deadline(spark):
    slow = spark.range(4, numPartitions=4).select(F.expr("reflect('java.lang.Thread', 'sleep', 60000L)"))
    start = time.monotonic()
    with pytest.raises(guard.LimitExceeded, match="more than 2 seconds"):
        guard.within(spark, 2, slow.collect)
    assert time.monotonic() - start < 40
    assert guard.within(spark, 60, lambda: spark.range(5).count()) == 5  # the session goes on
    with pytest.raises(ZeroDivisionError):
        guard.within(spark, 60, lambda: 1 / 0)


def test_bounds_raise_and_never_cut(spark):
    assert guard.bounded(spark.range(10), 10).count() == 10
    with pytest.raises(guard.LimitExceeded, match="11 rows"):
        guard.bounded(spark.range(11), 10)


def test_a_checker_with_too_many_findings_has_failed(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_FINDINGS", 3)
    f = rules.Facts(spark, {})
    many = lambda n: lambda facts: rules.finding(spark.range(n), "OC2001", "x", F.col("id").cast("string"), None, F.lit("m"))
    assert rules.checked(f, many(3)).count() == 3
    assert [r.code for r in rules.checked(f, many(4)).collect()] == ["OC9002"]
