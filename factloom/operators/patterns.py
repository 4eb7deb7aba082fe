"""An inverted index of names for globs and regular expressions.

A pattern's literal runs give it keys: how a name begins or ends, what it is, or grams inside it, each as wide as the run
allows, in steps. A name that the pattern matches has them all, so each pattern probes with its rarest one only, and what
that finds is verified. Names are indexed by those kinds and widths of keys that some pattern has. A pattern without any
literal probes with the empty key, which all names have. So all patterns are one equality join, as large as the rarest
keys' postings; names, patterns and keys are shuffled, nothing is looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names

#: Marks of a name's ends: characters that no name has.
BEGIN, END = "\u0002", "\u0003"
#: Widths of keys: the widest one that a run has room for is used.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)


def _runs(text: Column, n: Column) -> Column:
    """All runs of n characters of a text that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, n))


def keys(pattern: Column, mode: Column) -> Column:
    """What each match of a pattern has: kind (= whole name, ^ beginning, $ end, . inside; empty: nothing is known), width, text."""
    def key(kind: str, width: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), width.cast("int").alias("width"), text.alias("text"))

    def of(run: Column) -> Column:
        bare, first, last = F.translate(run, BEGIN + END, ""), run.startswith(BEGIN), run.endswith(END)
        w = F.array_max(F.filter(F.array(*map(F.lit, WIDTHS)), lambda x: x <= F.length(bare)))
        return F.when(first & last, F.array(key("=", F.lit(0), bare))).when(first, F.array(key("^", w, F.substring(bare, F.lit(1), w)))).when(last, F.array(key("$", w, F.right(bare, w)))).otherwise(F.transform(_runs(bare, w), lambda g: key(".", w, g)))

    some = F.array_distinct(F.flatten(F.transform(literals(pattern, mode), of)))
    return F.when(F.size(some) > 0, some).otherwise(F.array(key("", F.lit(0), F.lit(""))))


def _keys_of(name: Column, used: Column) -> Column:
    """A name's keys of the kinds and widths that are used."""
    def of(u: Column) -> Column:
        kind, w = u["kind"], u["width"]
        some = F.when(kind == "=", F.array(name)).when(w > F.length(name), F.array().cast("array<string>")).when(kind == "^", F.array(F.substring(name, F.lit(1), w))).when(kind == "$", F.array(F.right(name, w))).when(kind == ".", _runs(name, w)).otherwise(F.array(F.lit("")))
        return F.transform(some, lambda x: F.concat(kind, x))

    return F.array_distinct(F.flatten(F.transform(used, of)))


def literals(pattern: Column, mode: Column) -> Column:
    """The runs of characters that each match of a pattern holds, the ends marked where they are fixed.

    ``mode`` is glob (``*``, ``?``, brackets; the whole name) or regexp (of the class of ``names.safe_regexp``, sought anywhere).
    """
    glob = F.concat(F.lit(BEGIN), F.regexp_replace(pattern, r"\[!?[^\]]+\]|[*?]", "\u0001"), F.lit(END))
    open = F.regexp_replace(pattern, r"\\.|\[(?:\\.|[^\[\]])+\]|\.", "\u0001")  # classes and escapes are no literals
    open = F.regexp_replace(open, r"(?s).[*?]", "\u0001")  # nor is what may be left out
    open = F.regexp_replace(F.regexp_replace(open, r"^\^", BEGIN), r"\$$", END)
    runs = F.split(F.when(mode == "regexp", open).otherwise(glob), "\u0001")
    return F.filter(runs, lambda r: (r != "") & (r != BEGIN) & (r != END))


def matched(patterns: DataFrame, named: DataFrame, on: list[str], mode: Column | str = "glob") -> DataFrame:
    """(on, pattern, name) of all distinct patterns and names with equal ``on`` columns that match, each pair once.

    ``patterns`` has ``on``, pattern and, for regexps, ``nocase``; ``named`` has ``on`` and name. Globs without any
    wildcard match the equal name. Nulls match nothing.
    """
    kind = F.lit(mode) if isinstance(mode, str) else mode
    extra = ["nocase"] if "nocase" in patterns.columns else []
    p = patterns.where("pattern IS NOT NULL").select(*on, "pattern", kind.alias("_mode"), *extra).distinct()
    n = named.where("name IS NOT NULL").select(*on, "name").distinct()
    fold = F.coalesce("nocase", F.lit(False)) if extra else F.lit(False)
    # Names are indexed in lower case, so patterns that ignore case find them too.
    p = p.withColumn("_key", F.explode(keys(F.lower("pattern"), F.col("_mode"))))
    used = p.agg(F.collect_set(F.struct("_key.kind", "_key.width"))).scalar()  # kinds and widths are few
    p = p.withColumn("_gram", F.concat("_key.kind", "_key.text"))
    n = n.withColumn("_used", used).withColumn("_gram", F.explode(_keys_of(F.lower("name"), F.col("_used")))).drop("_used")
    sizes = n.groupBy(*on, "_gram").agg(F.count("*").alias("_n"))
    # A key that no name has is the rarest: its pattern matches nothing.
    own = [*on, "pattern", "_mode", *extra]
    rarest = p.join(sizes, [*on, "_gram"], "left").groupBy(*own).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), -F.length("_gram"), "_gram")).alias("_r"))
    rarest = rarest.where("_r.n > 0").select(*own, F.col("_r._gram").alias("_gram"))
    hits = n.join(rarest, [*on, "_gram"])
    by_glob = names.glob(F.when(fold, F.lower("name")).otherwise(F.col("name")), F.when(fold, F.lower("pattern")).otherwise(F.col("pattern")))
    by_regexp = F.regexp_like("name", F.concat(F.when(fold, "(?i)").otherwise(""), F.col("pattern")))
    fits = by_glob if isinstance(mode, str) and mode == "glob" else F.when(F.col("_mode") == "regexp", by_regexp).otherwise(by_glob)
    return hits.where(fits).select(*on, "pattern", *extra, "name")
