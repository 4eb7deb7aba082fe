"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside the groups.

Only DataFrame functions. The bytes are part of the grouping key beside the hash, so two texts that
collide never share a class; copies are combined before the shuffle, so a group with a third of all rows
sends one row for each task. Where a hash has two texts the classes are joined back by text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, key_of, table, text_of


def normalised(text: str = "text") -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def _classes(docs: DataFrame, id: str, text: str, digest) -> tuple[DataFrame, DataFrame, bool]:
    keyed = docs.select(F.col(id).alias("_id"), normalised(text).alias("_norm")).select("_id", "_norm", digest(F.col("_norm")).alias("_hash"))
    classes = keyed.groupBy("_hash", "_norm").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    sums = checkpointed(classes.select("_hash", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    collided = not sums.groupBy("_hash").count().where("count > 1").isEmpty()
    return keyed, (classes if collided else sums), collided


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", digest=F.md5) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. Of repeated rows with one id and text a single one is kept. A null id
    never is the smallest one unless all ids of the group are null; then keep_id is null and one row stays.
    An empty table gives no rows; other columns are ignored.
    """
    keyed, classes, collided = _classes(docs, id, text, digest)
    if collided:
        rows = keyed.groupBy("_id", "_hash", "_norm").agg(F.count("*").alias("_n")).join(classes, ["_hash", "_norm"])
        rows = rows.withColumn("text_sha256", F.sha2("_norm", 256))
    else:
        rows = keyed.select("_id", "_hash").groupBy("_id", "_hash").agg(F.count("*").alias("_n")).join(classes, "_hash")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))
    return rows.select("*", copy.alias("_copy")).select(
        F.col("_id").alias(id), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256"
    )


def keep_first_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", digest=F.md5) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; the same rules hold."""
    _, classes, collided = _classes(docs, id, text, digest)
    keys = ["_hash", "_norm"] if collided else ["_hash"]
    right = classes.select(key_of("keep_id").alias("_key"), *keys)
    left = docs.select(F.struct("*").alias("_row"), key_of(id).alias("_key"), normalised(text).alias("_norm")).withColumn("_hash", digest("_norm"))
    left = left if collided else left.drop("_norm")
    found = left.join(right.hint("merge"), ["_key", *keys], "left_semi")
    return found.dropDuplicates(["_key", *keys]).select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)"""
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
