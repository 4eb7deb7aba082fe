"""Personal data by bootstrapped contextual extraction.

Base patterns find seeds. The two and three words before an identifier-like token, and its neighbours on
both sides, are its lexical patterns. Over the whole corpus, patterns and tokens make a graph: a pattern is as sure as the
share of its tokens known to be of a kind, a token as sure as its patterns together; both are scored in
turn, and tokens that pass become known. Occurrences of tokens under sure patterns are added to the base
spans. Only DataFrame functions; positions are code points.

Regular expressions never look at a character more than a few times: a match begins at the start of a run
or where the last match ended (\\G), and quantifiers give nothing back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, checkpointed, span_list, table, text_of

# The kinds in their listed order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A piece without letters that has a digit, up to its end.
_PIECE = rf"[^{SPACE}\p{{L}}@0-9]*+[0-9][^{SPACE}\p{{L}}@]*+(?![^{SPACE}])"
#: Identifier-like: an address told in words, a run of pieces with digits, or a token with an at sign or four digits.
TOKEN = (
    rf"(?<![^{SPACE}])(?:[A-Za-z0-9._%+-]++\x20(?:at|[(\[]at[)\]])\x20[A-Za-z0-9-]++(?:\x20(?:dot|[(\[]dot[)\]])\x20[A-Za-z0-9-]++)++"
    rf"|{_PIECE}(?:\x20(?:[^{SPACE}\p{{L}}@0-9]{{1,3}}+\x20)?{_PIECE})*+|(?=[^{SPACE}@]*+@|(?:[^{SPACE}0-9]*+[0-9]){{4}})[^{SPACE}]++)"
)
IN_WORDS = r"\x20(?:at|[(\[]at[)\]])\x20"
FIRST_WORD = rf"^[{SPACE}]*+([^{SPACE}]++)"
LAST_WORDS = rf"(?<![^{SPACE}])((?:[^{SPACE}]++[{SPACE}]++){{0,2}}[^{SPACE}]++)[{SPACE}]*$"
#: Three whole words at the end.
THREE = rf"[{SPACE}][^{SPACE}]++[{SPACE}]++[^{SPACE}]++[{SPACE}]++[^{SPACE}]++[{SPACE}]*$"
#: A whole word at the beginning.
WHOLE = rf"^[{SPACE}]*+[^{SPACE}]++[{SPACE}]"
#: Matches of one pattern, without white space between them, over which a neighbouring word may reach.
REACH = 16
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
SUPPORT = 3
SURE_PATTERN = 0.6
SURE_TOKEN = 0.6


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The check sum of up to 19 digits; zeros in front add nothing."""
    d = F.lpad(d, 19, "0")
    one = [F.substring(d if k % 2 else F.translate(d, "0123456789", "0246813579"), k, 1).cast("int") for k in range(1, 20)]
    total = one[0]
    for x in one[1:]:
        total = total + x
    return total % 10 == 0


def passes(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(x)).between(14, 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(digits(x)).between(10, 15)
    return F.lit(True)


def pieces(rank: int, found: Column, gaps: Column) -> Column:
    """What pattern number ``rank`` has found, with the text between: (rank, i, match, length of the gap before, its last words, the first word after)."""
    def one(m: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        tail = F.when(before.rlike(THREE), F.regexp_extract(before, THREE, 0)).otherwise(before)
        head = F.when(after.rlike(WHOLE), F.regexp_extract(after, WHOLE, 0)).otherwise(after)
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), m.alias("match"), F.length(before).alias("gap"), tail.alias("tail"), head.alias("head"))

    return F.transform(found, one)


def _last(before: Column) -> Column:
    """Up to three words in front of an identifier, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(before, LAST_WORDS, 1), rf"[{SPACE}]+", " "))


def _next(after: Column) -> Column:
    return F.lower(F.regexp_extract(after, FIRST_WORD, 1))


def identifiers(found: DataFrame) -> DataFrame:
    """(row, start, end, match, kind, rank, last, next) of base spans and of other identifier-like tokens (kind null).

    ``found`` has a row number and the pieces of all patterns. Ends are running sums of lengths; the words beside a
    match come from the gaps next to it and, where those are short, from the matches and gaps beyond, up to ``REACH``
    of them: a word that is cut there does not count. Work grows with the number of matches, n log n.
    """
    p = found.select("row", F.explode("pieces").alias("p")).select("row", "p.*").repartition("row")
    here = Window.partitionBy("row", "rank").orderBy("i")
    size = F.length("match")
    before = F.concat(F.array_join(F.collect_list(F.concat("tail", "match")).over(here.rowsBetween(-REACH, -1)), ""), "tail")
    after = F.concat("head", F.array_join(F.collect_list(F.concat("match", "head")).over(here.rowsBetween(1, REACH)), ""))
    p = p.withColumns({"end": F.sum(F.col("gap") + size).over(here.rowsBetween(Window.unboundedPreceding, 0)).cast("int"), "before": before, "after": after})
    p = p.withColumn("start", F.col("end") - size)
    token = F.col("rank") == len(KINDS)
    good = F.when(token, F.col("match").contains("@") | (F.length(digits(F.col("match"))) >= 4) | F.col("match").rlike(IN_WORDS))
    for k, kind in enumerate(KINDS):
        good = good.when(F.col("rank") == k, passes(kind, F.col("match")))
    p = p.where(good)
    # A token goes if a base span begins before it and ends in or after it, or begins inside it.
    base = lambda c: F.when(~token, F.col(c))
    reach = F.max(base("end")).over(Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(base("start")).over(Window.partitionBy("row").orderBy(F.desc("start"), "rank").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumns({"reach": reach, "following": following})
    p = p.where(~token | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("following") < F.col("end"), F.lit(False))))
    last = _last(F.when(F.col("i") <= REACH, F.col("before")).otherwise(F.regexp_replace("before", rf"^[^{SPACE}]+", "")))
    # A token's place is that without the marks around it.
    front, back = F.regexp_extract("match", r"^[^\p{L}\p{N}+(]*+", 0), F.regexp_extract(F.reverse("match"), r"^[^\p{L}\p{N})]*+", 0)
    start, end = F.when(token, F.col("start") + F.length(front)).otherwise(F.col("start")), F.when(token, F.col("end") - F.length(back)).otherwise(F.col("end"))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("rank"))
    return p.select("row", start.alias("start"), end.alias("end"), "match", kind.alias("kind"), "rank", last.alias("last"), _next(F.col("after")).alias("next"))


def _occurrences(found: DataFrame) -> DataFrame:
    """A row for each pattern of each identifier: row, start, end, token, its base kind, pattern."""
    t = found.select("row", F.struct("start", "end", "match", "kind", "last", "next").alias("t"))
    token = F.lower(F.regexp_replace("t.match", r"^[^\p{L}\p{N}+]++|[^\p{L}\p{N}]+$", ""))
    two, last = F.substring_index("t.last", " ", -2), F.substring_index("t.last", " ", -1)
    patterns = F.array(
        F.when(two != "", F.concat(F.lit("before:"), two)),
        F.when(F.col("t.last") != two, F.concat(F.lit("before:"), "t.last")),
        F.when((last != "") & (F.col("t.next") != ""), F.concat(F.lit("around:"), last, F.lit(" "), "t.next")),
    )
    return t.select("row", "t.start", "t.end", "t.kind", token.alias("token"), F.explode(patterns).alias("pattern")).where("pattern IS NOT NULL AND token != ''")


def discovered(occurrences: DataFrame, support: int = SUPPORT, sure_pattern: float = SURE_PATTERN, sure_token: float = SURE_TOKEN) -> DataFrame:
    """(pattern, token, kind) of tokens without a base kind that the graph makes known.

    A pattern counts from ``support`` known tokens on; its score is their share of all its tokens; a
    token's is 1 - the product of (1 - score) over its patterns. Counts are of distinct tokens, so copies of
    a document add nothing. Rounds go on until none finds a new token: what is known only grows, so there
    is such a round.
    """
    edges = checkpointed(occurrences.groupBy("pattern", "token").agg(F.max("kind").alias("kind")))
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind IS NOT NULL").select("token", "kind").distinct()
    known, before = seeds, 0
    while True:
        hits = edges.drop("kind").join(known, "token").groupBy("pattern", "kind").agg(F.count("*").alias("k"))
        good = hits.where(F.col("k") >= support).join(totals, "pattern").withColumn("score", F.col("k") / F.col("n")).where(F.col("score") >= sure_pattern).select("pattern", F.col("kind").alias("as"), "score")
        open_edges = edges.where("kind IS NULL").drop("kind").join(good, "pattern")
        tokens = open_edges.groupBy("token", "as").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("score")).where(F.col("score") >= sure_token)
        accepted = checkpointed(open_edges.drop("score").join(tokens, ["token", "as"]).select("pattern", "token", F.col("as").alias("kind")))
        found = accepted.select("token", "kind").distinct()
        now = accepted.count()
        if now == before:
            return accepted.distinct()
        known, before = checkpointed(seeds.union(found).distinct()), now


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: id, ``base`` and ``spans``, ordered arrays of (start, rank, end, kind).

    ``spans`` has the base spans and those found by context, which take their pattern's kind. Null texts
    are empty; repeated rows are searched alike; null ids stay null; an empty table gives no rows; other
    columns are ignored.
    """
    # Without a digit, an at sign or an address told in words no pattern matches.
    t = docs.select(F.col(id), text_of(text).alias("_t")).withColumn("_t", F.when(F.col("_t").rlike(rf"[0-9@]|{IN_WORDS}"), F.col("_t")).otherwise(""))
    patterns = [*PATTERNS.values(), TOKEN]
    t = t.withColumns({f"_f{k}": F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for k, p in enumerate(patterns)} | {f"_g{k}": F.split("_t", p, -1) for k, p in enumerate(patterns)})
    found = t.select(id, F.concat(*[pieces(k, F.col(f"_f{k}"), F.col(f"_g{k}")) for k in range(len(patterns))]).alias("pieces"))
    found = checkpointed(found.withColumn("row", F.monotonically_increasing_id()))
    told = checkpointed(identifiers(found))
    occurrences = _occurrences(told)
    accepted = discovered(occurrences, **options)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    added = occurrences.where("kind IS NULL").drop("kind").join(accepted, ["pattern", "token"]).select("row", "start", rank.alias("rank"), "end", "kind", F.lit(False).alias("base")).distinct()
    spans = told.where("kind IS NOT NULL").select("row", "start", "rank", "end", "kind", F.lit(True).alias("base")).union(added)
    span = F.struct("start", "rank", "end", "kind")
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(SPANS)
    return found.select("row", id).join(by_row, "row", "left").select(id, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


QUERIES = {"op2_pii": op2_pii}
ORACLE: dict[str, str] = {}
