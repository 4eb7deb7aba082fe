"""The operators that most rules are made of: conflict, absence, duplicate, reference, sweep, difference.

Facts that are not known are null: they never take part in an equality and never make a finding. All are
plain DataFrame plans. Grouped operators combine before their one shuffle; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def known(state: Column, value: Column) -> Column:
    """The value of a fact that is known, else null."""
    return F.when(state == "known", value)


def conflict(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one known value: keys, n_values, n_members.

    Minimum and maximum tell a conflict without a distinct count's second shuffle; the number of values is
    counted for the conflicting keys only.
    """
    some = members.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return some.groupBy(*keys).agg(F.count("*").alias("n_values"), F.sum("_n").alias("n_members")).where("n_values > 1")


def conflicts(members: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with a conflict in any of several values, and which: one pass for all of them."""
    flags = [(F.coalesce(F.min(v) != F.max(v), F.lit(False))).alias(f"{v}_conflict") for v in values]
    found = members.groupBy(*keys).agg(*flags)
    return found.where(F.exists(F.array(*[F.col(f"{v}_conflict") for v in values]), lambda x: x))


def absence(required: DataFrame, present: DataFrame, keys: list[str], tainted: DataFrame | None = None, tainted_keys: list[str] | None = None) -> DataFrame:
    """Required rows that are neither present nor within what is tainted."""
    missing = required.join(present.select(*keys), keys, "left_anti")
    return missing if tainted is None else missing.join(tainted.select(*(tainted_keys or keys)), tainted_keys or keys, "left_anti")


def duplicate(rows: DataFrame, keys: list[str], signature: str | None = None) -> DataFrame:
    """Keys that come more than once: n, and if a signature is given whether the copies differ."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *([(F.min(signature) != F.max(signature)).alias("differs")] if signature else []))
    return found.where("n > 1")


def repeated(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every occurrence after the first one of its key, with its number (from 2)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def unresolved(references: DataFrame, definitions: DataFrame, on: list[str], variants: str = "variants") -> DataFrame:
    """References none of whose variants (an array) is defined; ``definitions`` has ``on`` and a variant."""
    hits = references.withColumn("variant", F.explode(variants)).join(definitions.select(*on, "variant"), [*on, "variant"], "left_semi")
    return references.join(hits.select("ref_id").distinct(), "ref_id", "left_anti")


def overlaps(fields: DataFrame, keys: list[str], first: str, last: str, order: list[str]) -> DataFrame:
    """Intervals that begin within the widest one before them; ties keep the earlier one.

    ``active_last`` is the last position of that one. One sort for each key.
    """
    w = Window.partitionBy(*keys).orderBy(first, last, *order).rowsBetween(Window.unboundedPreceding, -1)
    return fields.withColumn("active_last", F.max(last).over(w)).where(F.col(first) <= F.col("active_last"))


def first_match(rows: DataFrame, rules: DataFrame, matches: Column, index: str, row_keys: list[str]) -> DataFrame:
    """For each row the smallest index of the rules that match it.

    ``rules`` come from a configuration file; the condition is a predicate, so the join is a nested loop
    over a table that is broadcast while it is small and shuffled otherwise, as the optimizer decides.
    """
    return rows.join(rules, matches).groupBy(*row_keys).agg(F.min(index).alias(index))


def multiset_changes(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """By identity the rows that only one side has, counted: n_removed, n_added, state."""
    both = before.exceptAll(after).groupBy(*identity).agg(F.count("*").alias("n_removed")).join(after.exceptAll(before).groupBy(*identity).agg(F.count("*").alias("n_added")), identity, "full")
    counts = both.select(*identity, F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_added", F.lit(0)).alias("n_added"))
    return counts.withColumn("state", F.when(F.col("n_removed") == 0, "added").when(F.col("n_added") == 0, "removed").otherwise("changed"))


def paired_changes(before: DataFrame, after: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
    """Occurrences of two reports paired as multisets: equal content first, then what is left of a key by order.

    Columns: key, state (new, changed, unchanged, resolved), before_digest, after_digest. Two full outer
    joins on ranks; both shuffle by the key alone.
    """

    def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    old, new = (ranked(df.select(key, digest, *[c for c in order if c not in (key, digest)]), [key, digest], "_k") for df in (before, after))
    exact = [key, digest, "_k"]
    same = old.join(new.select(*exact), exact, "left_semi").select(key, F.lit("unchanged").alias("state"), F.col(digest).alias("before_digest"), F.col(digest).alias("after_digest"))
    left = ranked(old.join(new.select(*exact), exact, "left_anti"), [key], "_r").select(key, "_r", F.col(digest).alias("before_digest"))
    right = ranked(new.join(old.select(*exact), exact, "left_anti"), [key], "_r").select(key, "_r", F.col(digest).alias("after_digest"))
    rest = left.join(right, [key, "_r"], "full")
    state = F.when(F.col("before_digest").isNull(), "new").when(F.col("after_digest").isNull(), "resolved").otherwise("changed")
    return same.union(rest.select(key, state.alias("state"), "before_digest", "after_digest"))


def json_text(c: Column) -> Column:
    """A JSON string as Python writes it for ASCII: quotes, backslashes and control characters escaped; null as null.

    Other characters are written as \\u escapes, two for those beyond the basic plane.
    """
    plain = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return F.when(c.isNull(), "null").when(~c.rlike(r"[^\x20-\x7e]"), plain).otherwise(_escaped(c))


def _escaped(c: Column) -> Column:
    def one(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))  # a surrogate pair beyond the basic plane
        named = F.element_at(F.create_map(*[F.lit(x) for x in ('"', '\\"', "\\", "\\\\", "\b", "\\b", "\t", "\\t", "\n", "\\n", "\f", "\\f", "\r", "\\r")]), ch)
        return F.coalesce(named, F.when(ch.rlike(r"^[\x20-\x7e]$"), ch), F.regexp_replace(units, "(.{4})", r"\\u$1"))

    return F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), ""), F.lit('"'))


def fingerprint(code: Column, object_id: Column, property: Column, views: Column) -> Column:
    """24 hex digits of the SHA-256 of the finding's identity; ``views`` is an array."""
    listed = F.array_join(F.transform(F.array_sort(F.array_distinct(views)), json_text), ",")
    text = F.concat(F.lit('{"code":'), json_text(F.upper(F.trim(code))), F.lit(',"object":'), json_text(object_id), F.lit(',"property":'), json_text(property), F.lit(',"views":['), listed, F.lit("]}"))
    return F.substring(F.sha2(text, 256), 1, 24)
