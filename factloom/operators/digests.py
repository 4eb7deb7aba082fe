"""Digests of tables that do not depend on the order of rows, and contracts made of them.

A row's digest is that of its JSON. Rows are counted by digest; the counts stand in a tree by the digests' first hex
digits, three levels of at most 256 children, each node the digest of its children in order. So no group is ever as
large as a table, equal tables have equal digests whatever their order and partitions, and a comparison goes down
only where digests differ. Families, views and the whole contract have digests above these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import SCHEMAS

#: The families that sources give; the others are configuration.
FAMILIES = ("components", "ports", "pin_mappings", "objects", "clocks", "interfaces", "registers", "functions", "endpoints", "edges")
#: Hex digits of a row's digest by which the levels of the tree group, from the leaves up.
LEVELS = (6, 4, 2, 0)


def row_json(df: DataFrame) -> Column:
    """A row's columns by name as JSON, nulls included; maps by sorted keys."""
    def plain(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        return F.array_sort(F.map_entries(c)).alias(c) if kind.startswith("map<") else F.col(c)

    return F.to_json(F.struct(*[plain(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def counted(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """(keys, digest, n): the multiset of rows by their digest."""
    return rows.select(*keys, F.sha2(content, 256).alias("digest")).groupBy(*keys, "digest").agg(F.count("*").alias("n"))


def tree(multiset: DataFrame, keys: list[str]) -> dict[int, DataFrame]:
    """Of every level, by its number of digits, (keys, prefix, node, rows): the digest of what lies below and how many rows do."""
    level = multiset.select(*keys, F.substring("digest", 1, LEVELS[0]).alias("prefix"), F.concat_ws(":", "digest", F.col("n").cast("string")).alias("child"), F.col("n").alias("rows"))
    out = {}
    for k, digits in enumerate(LEVELS):
        node = F.sha2(F.array_join(F.array_sort(F.collect_list("child")), ","), 256)
        out[digits] = level.groupBy(*keys, "prefix").agg(node.alias("node"), F.sum("rows").alias("rows"))
        if k + 1 < len(LEVELS):
            level = out[digits].select(*keys, F.substring("prefix", 1, LEVELS[k + 1]).alias("up"), F.concat_ws(":", "prefix", "node").alias("child"), "rows").withColumnRenamed("up", "prefix")
    return out


def digest(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """(keys, node, rows): one digest for each group of rows, of any size."""
    return tree(counted(rows, keys, content), keys)[0].drop("prefix")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(view, family, digest, n): the multiset of the rows of all families in ``tables``."""
    parts = [counted(tables[f], ["view"], row_json(tables[f].drop("view"))).select("view", F.lit(f).alias("family"), "digest", "n") for f in FAMILIES if f in tables]
    return reduce(DataFrame.union, parts)


def contract(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A frozen design: ``rows`` (view, family, digest, n), and digests of what is in them: ``leaves`` (by prefix), ``families``, ``views``, ``whole``.

    ``views`` has every view of the design, also without rows, and whether it is complete: a contract is complete if all are.
    """
    rows = snapshot(tables)
    levels = tree(rows, ["view", "family"])
    families = levels[0].select("view", "family", F.col("node").alias("digest"), "rows")
    listed = families.groupBy("view").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "family", "digest"))), ",").alias("l"), F.sum("rows").alias("rows"))
    known = tables["views"].select("view", F.coalesce("complete", F.lit(False)).alias("complete")).groupBy("view").agg(F.bool_and("complete").alias("complete"))
    views = known.join(listed, "view", "full").select("view", F.sha2(F.concat_ws("|", F.coalesce("l", F.lit("")), F.coalesce("complete", F.lit(False)).cast("string")), 256).alias("digest"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("complete", F.lit(False)).alias("complete"))
    whole = views.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "view", "digest"))), ","), 256).alias("digest"), F.sum("rows").alias("rows"), F.coalesce(F.bool_and("complete"), F.lit(False)).alias("complete"))
    return {"rows": rows, "leaves": levels[LEVELS[0]].select("view", "family", "prefix", "node"), "families": families, "views": views, "whole": whole}


def contract_changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(view, family, state, n): views that came or went (family null), and of families whose digests differ the rows added and removed.

    Rows are read only of families, and of those only under prefixes, whose digests differ: with saved contracts little else is read.
    """
    a, b = (x["views"].select("view", F.lit(True).alias(n)) for x, n in ((before, "_b"), (after, "_a")))
    sets = a.join(b, "view", "full").where("_a IS NULL OR _b IS NULL")
    out = sets.select("view", F.lit(None).cast("string").alias("family"), F.when(F.col("_b").isNull(), "view added").otherwise("view removed").alias("state"), F.lit(1).cast("long").alias("n"))
    keys = ["view", "family"]
    f, g = (x["families"].select(*keys, F.col("digest").alias(n)) for x, n in ((before, "_b"), (after, "_a")))
    open = f.join(g, keys, "full").where(~F.col("_b").eqNullSafe(F.col("_a"))).select(*keys)
    at = [*keys, "prefix"]
    f, g = (x["leaves"].join(open, keys, "left_semi").select(*at, F.col("node").alias(n)) for x, n in ((before, "_b"), (after, "_a")))
    differ = f.join(g, at, "full").where(~F.col("_b").eqNullSafe(F.col("_a"))).select(*at)
    sides = (x["rows"].withColumn("prefix", F.substring("digest", 1, LEVELS[0])).join(differ, at, "left_semi") for x in (before, after))
    l, r = (s.select(*keys, "digest", F.col("n").alias(n)) for s, n in zip(sides, ("_b", "_a"), strict=True))
    change = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    rows = l.join(r, [*keys, "digest"], "full").withColumn("change", change).where("change != 0")
    rows = rows.groupBy(*keys, F.when(F.col("change") > 0, "added").otherwise("removed").alias("state")).agg(F.sum(F.abs("change")).alias("n"))
    return out.union(rows)


def save(frozen: dict[str, DataFrame], folder: str) -> None:
    """Each table of a contract under its name in a new folder, rows and leaves by family."""
    for name, df in frozen.items():
        df.write.partitionBy(*(["family"] if name in ("rows", "leaves") else [])).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("rows", "leaves", "families", "views", "whole")}


assert set(FAMILIES) <= set(SCHEMAS)
