"""Properties of traces: guards and latencies as lags over cycles, replay of registers, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def holds(frames: DataFrame, trace: str, cycle: str, sink: str, guards: list[tuple[str, object, int]] = (), source: str | None = None, equals: object = None, latency: int = 0, start: int = 0) -> DataFrame:
    """Adds ``enabled`` and ``ok`` to each frame from ``start`` on.

    A property holds in a cycle if some guard (signal, value, lag) doesn't, or the sink has the value that
    the source had ``latency`` cycles before (or a constant). One window, sorted once for all lags.
    """
    w = Window.partitionBy(trace).orderBy(cycle)
    back = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    enabled: Column = F.lit(True)
    for signal, value, lag in guards:
        enabled = enabled & F.coalesce(back(signal, lag) == F.lit(value), F.lit(False))
    expected = back(source, latency) if source else F.lit(equals)
    depth = max([latency, start, *(k for _, _, k in guards)])
    judged = frames.withColumns({"_n": F.row_number().over(w) - 1, "enabled": enabled, "_same": F.coalesce(F.col(sink) == expected, F.lit(False))})
    return judged.where(F.col("_n") >= depth).withColumn("ok", ~F.col("enabled") | F.col("_same")).drop("_n", "_same")


def verdicts(judged: DataFrame, trace: str, cycle: str) -> DataFrame:
    """By trace: cycles judged and enabled, failures, the first failing cycle, and holds, fails or uncovered."""
    out = judged.groupBy(trace).agg(
        F.count("*").alias("n_cycles"), F.count_if("enabled").alias("n_enabled"), F.count_if(~F.col("ok")).alias("n_failures"), F.min(F.when(~F.col("ok"), F.col(cycle))).alias("first_failure")
    )
    return out.withColumn("verdict", F.when(F.col("n_failures") > 0, "fails").when(F.col("n_enabled") == 0, "uncovered").otherwise("holds"))


def replay_errors(frames: DataFrame, trace: str, cycle: str, following: dict[str, Column]) -> DataFrame:
    """Frames whose registers are not what the frame before says: ``following`` gives each register's next value."""
    w = Window.partitionBy(trace).orderBy(cycle)
    nexts = {f"_next_{r}": c for r, c in following.items()}
    before = frames.withColumns(nexts)
    told = before.withColumns({f"_want_{r}": F.lag(f"_next_{r}").over(w) for r in following})
    wrong = [F.when(F.col(f"_want_{r}").isNotNull() & ~F.col(f"_want_{r}").eqNullSafe(F.col(r)), F.lit(r)) for r in following]
    return told.withColumn("registers", F.array_compact(F.array(*wrong))).where(F.size("registers") > 0).select(trace, cycle, "registers")
