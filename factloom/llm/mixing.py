"""Mixing sources to target weights by a min-cost flow.

Documents are added up by membership pattern (the set of sources that hold them); a flow routes each
pattern's words, once at cost 0 and again at rising cost, to the sources' quotas; then documents are chosen
in a seeded order until a pattern's flow is used up. Only pattern totals reach the driver. The order's
prefix sums come from 4096 hash buckets for each pattern and from the rows of the one bucket in which the
flow ends, so no task holds a whole source.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BUCKET_BITS = 12


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, total: int | None = None) -> dict[str | None, float]:
    """By source its words in the mix: weights in code point order (null last), capped, the excess shared again.

    ``total`` is all documents' size where sources overlap.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    left, free, out = share * (sum(sizes.values()) if total is None else total), list(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > repeats * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def flow(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, list[int]]:
    """By pattern, the words routed as first, second, ... copies, at the least total cost of repetition.

    A further copy costs more than the one before, alike for all patterns; so a shortest-path flow takes
    all that first copies can carry, rerouting, before any second copy.
    """
    used = {(p, s): 0 for p in patterns for s in p}
    left = {s: int(round(q)) for s, q in quotas.items()}
    of: dict = {}
    for p in patterns:
        for s in p:
            of.setdefault(s, []).append(p)
    out = {p: [] for p in patterns}
    for _ in range(repeats):
        sent = dict.fromkeys(patterns, 0)
        for start in patterns:
            while sent[start] < patterns[start]:
                came, queue, end = {("p", start): None}, deque([("p", start)]), None
                while queue and end is None:
                    kind, x = at = queue.popleft()
                    for y in x if kind == "p" else of[x]:
                        step = ("s" if kind == "p" else "p", y)
                        if step in came or kind == "s" and not used[y, x]:
                            continue
                        came[step] = at
                        if kind == "p" and left.get(y, 0) > 0:
                            end = step
                            break
                        queue.append(step)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min(patterns[start] - sent[start], left[end[1]], *(used[b[1], a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s"))
                for a, b in zip(path, path[1:], strict=False):
                    used[(a[1], b[1]) if a[0] == "p" else (b[1], a[1])] += amount if a[0] == "p" else -amount
                left[end[1]] -= amount
                sent[start] += amount
        for p in patterns:
            out[p].append(sent[p])
    return out


def mix(docs: DataFrame, members: Column, id: str = "doc_id", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """One row per document: id, size, members, source_size, target (of its first source), taken.

    ``members`` is an array of sources. Documents are taken whole but for the
    last one of a flow, which gives its first words: a flow is met to the word. Size is the number of words; a null text has none; a null
    source is a source of its own; null or empty ``members`` are no source, and the mix takes nothing of them. Repeated
    rows are separate documents in the order; ties are ordered by id and size. Without words everything is 0; an empty table gives no rows.
    """
    order = F.xxhash64(F.col(id).cast("string"), F.lit(seed))
    sizes = docs.select(F.col(id), F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))).alias("members"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"), order.alias("_h"))
    sizes = checkpointed(sizes.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - BUCKET_BITS)))
    sums = sizes.groupBy("members", "_bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("members").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = checkpointed(sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))))
    patterns = {tuple(r[0]): r[1] for r in ranges.groupBy("members").agg(F.sum("n")).collect()}
    by_source: dict = {}
    for p, n in patterns.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    wanted = targets(by_source, weights, share, repeats, sum(patterns.values()))
    routed = flow(patterns, wanted, repeats)
    rows = [(list(p), by_source[p[0]] if p else 0, wanted[p[0]] if p else 0.0, routed[p]) for p in patterns]
    plan = sizes.sparkSession.createDataFrame(rows, "members array<string>, source_size long, target double, quotas array<long>")
    # By pattern and copy, the bucket in which the quota ends and the words before it.
    ends = ranges.join(F.broadcast(plan), "members").select("members", "_bucket", "before", "n", F.posexplode("quotas").alias("copy", "quota"))
    ends = ends.where("before <= quota AND quota < before + n").select("members", "copy", "quota", F.col("_bucket").alias("end"), "before").collect()
    at = {(tuple(r["members"]), r["copy"]): (r["end"], r["before"]) for r in ends}
    rows = [(*r, [at.get((tuple(r[0]), k), (1 << BUCKET_BITS if q else -1, 0))[0] for k, q in enumerate(r[3])], [at.get((tuple(r[0]), k), (0, 0))[1] for k in range(len(r[3]))]) for r in rows]
    plan = sizes.sparkSession.createDataFrame(rows, "members array<string>, source_size long, target double, quotas array<long>, ends array<int>, before array<long>")
    # The plan has a row for each pattern: what the driver has just held.
    both = sizes.join(F.broadcast(plan), "members")
    whole = sum((F.when(F.col("_bucket") < F.col("ends")[k], F.col("size")).otherwise(0) for k in range(repeats)), F.lit(0))
    on_end = F.array_contains("ends", F.col("_bucket"))
    w = Window.partitionBy("members", "_bucket").orderBy("_h", id, "size").rowsBetween(Window.unboundedPreceding, -1)
    last = both.where(on_end).withColumn("_run", F.coalesce(F.sum("size").over(w), F.lit(0)))
    left = [F.col("quotas")[k] - F.col("before")[k] - F.col("_run") for k in range(repeats)]
    part = sum((F.when(F.col("_bucket") == F.col("ends")[k], F.greatest(F.lit(0), F.least("size", left[k]))).otherwise(0) for k in range(repeats)), F.lit(0))
    keep = [id, "size", "members", "source_size", "target"]
    return both.where(~on_end).select(*keep, whole.cast("long").alias("taken")).union(last.select(*keep, (whole + part).cast("long").alias("taken")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {}
