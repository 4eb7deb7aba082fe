"""Constrained reachability: breadth-first over states, all searches at once as bits of one number.

A state is (node, waypoints passed, parity of inversions, whether an uncertain edge was crossed); it carries a
bitmap of the searches that have reached it, 64 to a row. A search is a start with its waypoints and exclusions:
requirements that share these share it, whatever their sinks. A round joins the frontier with the edges once for
all of a row's searches, takes out the bits that a node excludes, moves those on for which it is a waypoint, unites
by ``bit_or`` and drops bits that have been seen. Uncertain edges are walked in the same search: what is reached
without any is told by the state. Each round is one job, whose rows are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, written

STATE = ["id", "node", "passed", "parity", "uncertain"]
#: Between the nodes of one waypoint, any of which will do.
OR = "\u0002"


def reach(edges: DataFrame, starts: DataFrame, with_uncertain: bool = False, max_states: int | None = None, every: int = 6) -> tuple[DataFrame, bool]:
    """The states of ``search`` by requirement, and whether any hit the bound."""
    found = search(edges, starts, with_uncertain, max_states, every)
    return found.states(), not found.stopped().isEmpty()


#: One bit of a state's bitmap.
ONE = "shiftleft(1L, cast(bit AS int))"
KEY = ["chunk", "node", "passed", "parity", "uncertain"]


class Found:
    """What a search has reached: ``rounds`` (KEY, bits, depth), ``numbers`` (id, chunk, bit) and what goes with it."""

    def __init__(self, numbers: DataFrame, edges: DataFrame, rounds: DataFrame, full: DataFrame | None):
        self.numbers, self.edges, self.rounds, self.full = numbers, edges, rounds, full

    def states(self) -> DataFrame:
        """id, node, passed, parity, uncertain, depth: a row for each bit."""
        hits = self.rounds.join(self.numbers.select("id", "chunk", "bit"), "chunk").where(F.expr(f"bits & {ONE} != 0"))
        return hits.select(*STATE, "depth")

    def stopped(self) -> DataFrame:
        """The ids whose search hit the bound."""
        if self.full is None:
            return self.numbers.select("id").limit(0)
        return self.numbers.join(self.full, "chunk").where(F.expr(f"full & {ONE} != 0")).select("id")

    def like(self, ids: DataFrame) -> Found:
        """The same search for other ids, each with the start of an id (``of``) that has been searched."""
        numbers = ids.select(F.col("id").alias("_id"), F.col("of").alias("id")).join(self.numbers, "id").drop("id").withColumnRenamed("_id", "id")
        return Found(numbers, self.edges, self.rounds, self.full)

    def touching(self, nodes: DataFrame) -> DataFrame:
        """The ids whose search has reached one of ``nodes``."""
        bits = self.rounds.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("chunk").agg(F.bit_or("bits").alias("bits"))
        return self.numbers.join(bits, "chunk").where(F.expr(f"bits & {ONE} != 0")).select("id")

    def at(self, wanted: DataFrame) -> DataFrame:
        """Of rows (id, sink, ...) the states in which the search of ``id`` is at its sink."""
        asked = wanted.join(self.numbers.select("id", "chunk", "bit"), "id")
        return asked.join(self.rounds.withColumnRenamed("node", "sink"), ["chunk", "sink"]).where(F.expr(f"bits & {ONE} != 0"))


def numbered(starts: DataFrame) -> DataFrame:
    """(id, node, through, exclude, chunk, bit): ids with equal starts, waypoints and exclusions share a number; neighbours share a chunk."""
    own = ["node", "through", "exclude"]
    none = F.array().cast("array<string>")
    s = starts.select("id", "node", F.coalesce("through", none).alias("through"), F.coalesce("exclude", none).alias("exclude"))
    kinds = s.select(*own).distinct().repartitionByRange("node").sortWithinPartitions("node").withColumn("k", F.monotonically_increasing_id())
    kinds = written(kinds.select(*own, F.shiftright("k", 6).alias("chunk"), F.col("k").bitwiseAND(63).alias("bit")))[0]
    return written(s.join(kinds, own))[0]


def search(edges: DataFrame, starts: DataFrame, with_uncertain: bool = False, max_states: int | None = None, every: int = 6) -> Found:
    """What each search reaches.

    ``edges``: source, sink, inverted (null: polarity not known), status. ``starts``: id, node, through
    (ordered waypoints to pass: a node or several joined by ``OR``), exclude. Without ``with_uncertain`` only known edges with a known polarity are
    walked. Searches end by themselves, as their states are finite. ``max_states``, if given, bounds each on its own: one beyond
    it goes no further, the others are searched to the end.
    """
    sure = (F.coalesce("status", F.lit("known")) == "known") & F.col("inverted").isNotNull()
    e = edges.select("source", "sink", F.coalesce(F.col("inverted").cast("int"), F.lit(0)).alias("flip"), (~sure).alias("doubt"))
    e = e if with_uncertain else e.where(~F.col("doubt"))
    e = written(e.groupBy("source", "sink", "flip").agg(F.min("doubt").alias("doubt")).repartition("source"))[0]
    numbers = numbered(starts)
    own = numbers.dropDuplicates(["chunk", "bit"])
    masks = own.select("chunk", F.explode("exclude").alias("node"), "bit").groupBy("chunk", "node").agg(F.bit_or(F.expr(ONE)).alias("barred"))
    barred, n = written(masks)
    barred = barred if n["n"] else None
    points = own.select("chunk", F.posexplode("through").alias("passed", "t"), "bit").withColumn("node", F.explode(F.split("t", OR)))
    points, n = written(points.groupBy("chunk", "passed", "node").agg(F.bit_or(F.expr(ONE)).alias("moving")))
    points = points if n["n"] else None

    def arrived(rows: DataFrame) -> DataFrame:
        """Rows of KEY and bits, after exclusions and waypoints, united."""
        if barred is not None:
            rows = rows.join(barred, ["chunk", "node"], "left").withColumn("bits", F.expr("bits & ~coalesce(barred, 0L)")).drop("barred")
        if points is not None:
            rows = rows.join(points, ["chunk", "passed", "node"], "left").withColumn("moving", F.expr("bits & coalesce(moving, 0L)"))
            both = F.array(F.struct("passed", F.expr("bits & ~moving").alias("bits")), F.struct((F.col("passed") + 1).alias("passed"), F.col("moving").alias("bits")))
            rows = rows.select("chunk", "node", "parity", "uncertain", F.explode(both).alias("x")).select("chunk", "node", "x.passed", "parity", "uncertain", "x.bits")
        return rows.where("bits != 0").groupBy(*KEY).agg(F.bit_or("bits").alias("bits"))

    first = own.select("chunk", "node", F.lit(0).alias("passed"), F.lit(0).alias("parity"), F.lit(False).alias("uncertain"), F.expr(ONE).alias("bits"))
    front, told = written(arrived(first).withColumn("depth", F.lit(0)), states=F.sum(F.bit_count("bits")))
    rounds, seen, waiting, depth, total, full = front, front.drop("depth"), 0, 0, told["states"] or 0, None
    while told["n"]:
        depth += 1
        if full is not None:
            front = front.join(full, "chunk", "left").withColumn("bits", F.expr("bits & ~coalesce(full, 0L)")).where("bits != 0").drop("full")
        step = front.join(e, F.col("node") == F.col("source"))
        step = step.select("chunk", F.col("sink").alias("node"), "passed", ((F.col("parity") + F.col("flip")) % 2).alias("parity"), (F.col("uncertain") | F.col("doubt")).alias("uncertain"), "bits")
        new = arrived(step).join(seen.groupBy(*KEY).agg(F.bit_or("bits").alias("_seen")), KEY, "left").withColumn("bits", F.expr("bits & ~coalesce(_seen, 0L)"))
        front, told = written(new.where("bits != 0").select(*KEY, "bits", F.lit(depth).alias("depth")), states=F.sum(F.bit_count("bits")))
        rounds, seen, waiting, total = rounds.union(front), seen.union(front.drop("depth")), waiting + 1, total + (told["states"] or 0)
        if waiting >= every:  # the plan stays short
            rounds, seen, waiting = written(rounds)[0], written(seen.groupBy(*KEY).agg(F.bit_or("bits").alias("bits")))[0], 0
        if max_states is not None and total > max_states:  # only now can a search have more
            each = rounds.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr(f"bits & {ONE} != 0")).groupBy("chunk", "bit").agg(F.count("*").alias("n"))
            full = written(each.where(F.col("n") > max_states).groupBy("chunk").agg(F.bit_or(F.expr(ONE)).alias("full")))[0]
    return Found(numbers, e, rounds, full)


def judged(edges: DataFrame, requirements: DataFrame, complete: bool = True, max_states: int | None = None, proofs: bool = False, found: Found | None = None, dark: DataFrame | None = None) -> DataFrame:
    """A verdict for each requirement on single nodes: id, verdict, path_length.

    ``requirements``: id, source, sink, expectation (reachable, unreachable), transform (any, identity:
    even inversions, inverted: odd), through, exclude. Verdicts: pass, missing, forbidden, polarity,
    inconclusive. An incomplete graph or an uncertain edge never makes a pass of an unreachable one, nor a
    failure of a reachable one; nor does a search beyond ``max_states``, of its own requirement only. A column
    ``open`` tells of single requirements that their graph is incomplete. With ``proofs`` there is a column
    ``proof``: the shortest path of a forbidden or inverted one, the first ends of what a missing one reaches.
    ``found`` is a search of all ids with uncertain edges, if there has been one. ``dark`` has nodes from which unknown
    edges may lead: the graph of a requirement that reaches one is incomplete.
    """
    own = F.col("open") if "open" in requirements.columns else F.lit(False)
    wanted = requirements.select("id", "sink", "expectation", "transform", own.alias("open"), F.size(F.coalesce("through", F.array().cast("array<string>"))).alias("need"))
    found = found or search(edges, requirements.withColumnRenamed("source", "node"), True, max_states)
    stopped = found.stopped()
    if dark is not None:
        stopped = stopped.union(found.touching(dark))
    stopped = stopped.distinct().withColumn("stopped", F.lit(True))
    at = written(found.at(wanted).where(F.col("passed") >= F.col("need")).select("id", "transform", F.col("sink").alias("node"), "passed", "parity", "uncertain", "depth"))[0]

    def hits(states: DataFrame, name: str) -> DataFrame:
        fits = (F.col("transform") == "any") | (F.col("parity") == F.when(F.col("transform") == "inverted", 1).otherwise(0))
        return states.groupBy("id").agg(F.min(F.when(fits, F.col("depth"))).alias(name), F.min(F.when(~fits, F.col("depth"))).alias(f"{name}_other"))

    sure = at.where(~F.col("uncertain"))
    j = wanted.join(hits(sure, "sure"), "id", "left").join(hits(at, "maybe"), "id", "left").join(stopped, "id", "left")
    open_end = F.lit(not complete) | F.col("open") | F.col("stopped").isNotNull()
    polar = F.col("transform") != "any"
    doubt = F.col("maybe").isNotNull() | open_end
    verdict = F.when(
        F.col("expectation") == "unreachable", F.when(F.col("sure").isNotNull(), "forbidden").when(doubt, "inconclusive").otherwise("pass")
    ).otherwise(
        F.when(F.col("sure").isNotNull() & polar & (F.col("sure_other").isNotNull() | F.col("maybe_other").isNotNull() | open_end), "inconclusive")
        .when(F.col("sure").isNotNull(), "pass")
        .when(polar & F.col("sure_other").isNotNull(), "polarity")
        .when(doubt | F.col("maybe_other").isNotNull(), "inconclusive")
        .otherwise("missing")
    )
    out = j.select("id", verdict.alias("verdict"), F.col("sure").alias("path_length"))
    if not proofs:
        return out
    out = cut(out)
    told = sure.join(out.where("verdict IN ('forbidden', 'polarity')").select("id"), "id", "left_semi")
    first = told.groupBy("id").agg(F.min(F.struct("depth", "node", "passed", "parity", "uncertain")).alias("m")).select("id", "m.*")
    paths = witnesses(found, first).select("id", F.col("path").alias("proof"))
    lost = found.numbers.join(out.where("verdict = 'missing'").select("id"), "id", "left_semi").select("id", "chunk", "bit")
    reached = found.rounds.where(~F.col("uncertain")).join(lost, "chunk").where(F.expr(f"bits & {ONE} != 0"))
    ends = frontier_cut(reached.select("id", "node"), edges).groupBy("id").agg(F.array_sort(F.collect_list("node")).alias("proof"))
    return out.join(paths.union(ends), "id", "left")


def frontier_cut(states: DataFrame, edges: DataFrame, most: int = 32) -> DataFrame:
    """The first ``most`` reached nodes of each id, by name, that no edge leaves: where a missing path ends. A report's top k."""
    ends = states.select("id", "node").distinct().join(edges.select(F.col("source").alias("node")), "node", "left_anti")
    return ends.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("node"))).where(F.col("_k") <= most).drop("_k")


def witnesses(found: Found, ends: DataFrame) -> DataFrame:
    """(id, path): the nodes from the start to each end, a state (id, node, passed, parity, uncertain) with its depth.

    All ids go back at once, one join with the edges for each step: to the smallest state of the round before
    that their search has reached and from which an edge leads here.
    """
    n = found.numbers.select("id", "chunk", "bit", "through")
    before = found.rounds.select("chunk", "bits", (F.col("depth") + 1).alias("depth"), F.col("node").alias("source"), *[F.col(c).alias(f"_{c}") for c in ("passed", "parity", "uncertain")])
    at, done = written(ends.join(n, "id").withColumn("path", F.array("node")))[0], None
    while True:
        ended = at.where("depth = 0").select("id", "path")
        done = ended if done is None else done.union(ended)
        counted = F.when(F.array_contains(F.split(F.get("through", F.col("_passed")), OR), F.col("node")), F.col("_passed") + 1).otherwise(F.col("_passed"))
        up = at.where("depth > 0").join(found.edges.withColumnRenamed("sink", "node"), "node").join(before, ["chunk", "depth", "source"]).where(F.expr(f"bits & {ONE} != 0"))
        up = up.where((counted == F.col("passed")) & ((F.col("_parity") + F.col("flip")) % 2 == F.col("parity")) & ((F.col("_uncertain") | F.col("doubt")) == F.col("uncertain")))
        back = up.groupBy("id", "chunk", "bit", "through", "path", "depth").agg(F.min(F.struct(F.col("source").alias("node"), "_passed", "_parity", "_uncertain")).alias("m"))
        at, told = written(back.select("id", "chunk", "bit", "through", F.concat(F.array("m.node"), "path").alias("path"), (F.col("depth") - 1).alias("depth"), "m.node", F.col("m._passed").alias("passed"), F.col("m._parity").alias("parity"), F.col("m._uncertain").alias("uncertain")))
        if not told["n"]:
            return done
