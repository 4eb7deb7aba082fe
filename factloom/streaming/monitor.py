"""Monitors over streams; each equals its batch operator on the rows that have come in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def lag_monitor(stream: DataFrame, trace: str, cycle: str, sink: str, guards: list[tuple[str, str, int]], source: str, latency: int, wait: int = 0) -> DataFrame:
    """``trace.holds`` over a stream of frames: trace, cycle, enabled, ok, late.

    Frames of a trace may come in any order: each is held until one has come that is ``wait`` cycles beyond it, and they are
    judged in order of their cycles. A frame that comes when its place has been judged is told as late, with neither
    enabled nor ok, and takes part in nothing. The state of a trace is its last judged frames, as many as the longest
    lag, and the frames that wait; the last ``wait`` cycles stay there until others come.
    """
    depth = max([latency, *(k for _, _, k in guards)])
    signals = sorted({sink, source, *(s for s, _, _ in guards)})
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, last, newest, held, waiting = state.get if state.exists else (0, None, None, [], [])
        held, waiting = [list(h) for h in held], [(int(w[0]), list(w[1:])) for w in waiting]
        out = []
        for r in pd.concat(list(batches)).itertuples(index=False):
            at = int(getattr(r, cycle))
            newest = at if newest is None else max(newest, at)
            if last is not None and at <= last:
                out.append((key[0], at, None, None, True))
            else:
                waiting.append((at, [str(getattr(r, s)) for s in signals]))
        waiting.sort()
        while waiting and waiting[0][0] <= newest - wait:
            at, frame = waiting.pop(0)
            if last is not None and at <= last:  # the same cycle again
                out.append((key[0], at, None, None, True))
                continue
            held = [*held, frame][-(depth + 1) :]
            seen, last = seen + 1, at
            if seen > depth:
                back = lambda s, k: held[-1 - k][signals.index(s)]  # noqa: B023, E731
                enabled = all(back(s, k) == v for s, v, k in guards)
                out.append((key[0], at, enabled, not enabled or back(sink, 0) == back(source, latency), False))
        state.update((seen, last, newest, held, [[str(at), *frame] for at, frame in waiting]))
        yield pd.DataFrame(out, columns=[trace, cycle, "enabled", "ok", "late"])

    schema = f"`{trace}` {kinds[trace]}, `{cycle}` {kinds[cycle]}, enabled boolean, ok boolean, late boolean"
    kept = "seen long, last long, newest long, held array<array<string>>, waiting array<array<string>>"
    return stream.select(trace, cycle, *[s for s in signals if s not in (trace, cycle)]).groupBy(trace).applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.NoTimeout)


def findings_by_time(findings: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """By window and code the number of findings and of objects (approximate, as a stream's distinct count must be)."""
    return findings.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "code").agg(F.count("*").alias("n"), F.approx_count_distinct("object_id").alias("n_objects")).select(F.col("w.start").alias("start"), "code", "n", "n_objects")


def upsert_latest(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the latest row of each key: generation n + 1 replaces n as a whole.

    A batch that comes again after a failure writes its own generation again, so the result is the same.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        both = batch
        if n > 0:
            both = spark.read.parquet(f"{path}/generation={n - 1}").unionByName(batch)
        newest = both.groupBy(*keys).agg(F.max_by(F.struct("*"), version).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/generation={n}")

    return write
