"""Topological order of large graphs: layers by peeling, long chains in one step, cycles told apart.

A node's layer is the number of edges of the longest way to it. Chains, nodes with one way in and one way out, are
folded first by pointer doubling, so a chain of n nodes takes log n rounds and not n. What is left is peeled: a
round gives the heads of chains without open edges their layer and takes their edges away. Nodes that never come
free lie on cycles or behind them; trimming from the other end and colouring tells the cycles' components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def chains(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, head, place) of every node, and (node, cycle) of rings of links, which have no head: their smallest node.

    A link is an edge that is the only one out of its source and the only one into its sink; a head is a node
    that no link leads to. Nothing else leads into a ring or out of it.
    """
    single = lambda c: edges.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
    links = edges.join(single("source"), "source", "left_semi").join(single("sink"), "sink", "left_semi").select(F.col("sink").alias("node"), F.col("source").alias("to"))
    p = nodes.join(links, "node", "left").select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("place"), F.least("node", F.coalesce("to", "node")).alias("low"))
    p, told = written(p, open=F.count_if(F.col("place") > 0))
    left = told["open"]
    while left:
        q = p.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("place").alias("_place"), F.col("low").alias("_low"))
        p, told = written(p.join(q, "to").select("node", F.col("_to").alias("to"), (F.col("place") + F.col("_place")).alias("place"), F.least("low", "_low").alias("low"), (F.col("_place") > 0).alias("moved")), open=F.count_if(F.col("moved")), widest=F.max("place"))
        p = p.drop("moved")
        # On a ring pointers move for ever, and by then farther than there are nodes.
        left = told["open"] if (told["widest"] or 0) <= told["n"] else 0
    heads = p.where("place = 0").select(F.col("node").alias("to"))
    return written(p.join(heads, "to", "left_semi").select("node", F.col("to").alias("head"), "place"))[0], written(p.join(heads, "to", "left_anti").select("node", F.col("low").alias("cycle")))[0]


def folded(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(from, to, far): the edges between chains by their heads, ``far`` the longest way from head to head."""
    a = of.select(F.col("node").alias("source"), F.col("head").alias("from"), "place")
    b = of.where("place = 0").select(F.col("node").alias("sink"), F.col("head").alias("to"))
    return edges.join(a, "source").join(b, "sink").groupBy("from", "to").agg((F.max("place") + 1).alias("far"))


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, layer, cycle): the layer of each node that is on no cycle and behind none, else null; the smallest node of its cycle's component.

    ``edges``: source, sink; null ends and repeated edges count for nothing. ``nodes`` (node) adds those without edges.
    """
    e = written(edges.where("source IS NOT NULL AND sink IS NOT NULL").select("source", "sink").distinct())[0]
    ends = e.select(F.col("source").alias("node")).union(e.select("sink"))
    every = written((ends if nodes is None else ends.union(nodes.where("node IS NOT NULL").select("node"))).distinct())[0]
    of, rings = chains(e, every)
    open, told = written(folded(e, of))
    front, n = written(of.where("place = 0").select("head").join(open.select(F.col("to").alias("head")), "head", "left_anti").select("head", F.lit(0).cast("long").alias("layer")))
    reached, best, rounds = front, None, 0
    while n["n"] and told["n"]:
        step = open.join(front.select(F.col("head").alias("from"), "layer"), "from").groupBy("to").agg(F.max(F.col("layer") + F.col("far")).alias("l"))
        best = written(step if best is None else best.union(step).groupBy("to").agg(F.max("l").alias("l")))[0]
        open, told = written(open.join(front.select(F.col("head").alias("from")), "from", "left_anti"))
        # What no open edge leads to any more is free; it leaves the table of best ways.
        free = best.join(open.select("to").distinct(), "to", "left_anti").select(F.col("to").alias("head"), F.col("l").alias("layer"))
        front, n = written(free)
        best, reached, rounds = best.join(front.select(F.col("head").alias("to")), "to", "left_anti"), reached.union(front), rounds + 1
        if rounds % 8 == 0:
            reached = written(reached)[0]
    placed = written(of.join(reached, "head").select("node", (F.col("layer") + F.col("place")).alias("layer")))[0]
    stuck = every.join(placed.select("node"), "node", "left_anti").join(rings.select("node"), "node", "left_anti")
    stuck = written(stuck)[0]
    both, n = written(e.join(stuck.withColumnRenamed("node", "source"), "source", "left_semi").join(stuck.withColumnRenamed("node", "sink"), "sink", "left_semi"))
    cycles = rings
    if n["n"]:
        inner, more = chains(both, stuck)
        found = inner.join(components(folded(both, inner).select(F.col("from").alias("source"), F.col("to").alias("sink"))).withColumnRenamed("node", "head"), "head")
        low = found.groupBy("cycle").agg(F.min("node").alias("low"))  # the smallest of all nodes, not of the heads
        cycles = rings.union(more).union(found.join(low, "cycle").select("node", F.col("low").alias("cycle")))
    return every.join(placed, "node", "left").join(cycles, "node", "left").select("node", "layer", "cycle")


def components(edges: DataFrame) -> DataFrame:
    """(node, cycle) of the nodes on cycles: strongly connected components by their smallest node, a loop counts as one.

    Each turn trims nodes without edges in or out, hands the smallest node forward along the edges until nothing
    changes, and takes what leads back to it within its colour as one component; the rest goes another turn.
    """
    loops = edges.where("source = sink").select(F.col("source").alias("node"), F.col("source").alias("cycle"))
    out, told = written(loops)
    e, n = written(edges.where("source != sink").select("source", "sink"))
    while n["n"]:
        size = n["n"]
        while True:  # trim
            e, n = written(e.join(e.select(F.col("sink").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("sink")).distinct(), "sink", "left_semi").select("source", "sink"))
            if n["n"] == size:
                break
            size = n["n"]
        if not size:
            break
        colour = written(e.select(F.col("source").alias("node"), F.col("source").alias("c")).distinct())[0]
        while True:
            new = e.join(colour.select(F.col("node").alias("source"), "c"), "source").groupBy(F.col("sink").alias("node")).agg(F.min("c").alias("_c"))
            colour, told = written(colour.join(new, "node", "left").select("node", F.least("c", "_c").alias("c"), F.coalesce(F.col("_c") < F.col("c"), F.lit(False)).alias("moved")), open=F.count_if(F.col("moved")))
            colour = colour.drop("moved")
            if not told["open"]:
                break
        inner = e.join(colour.select(F.col("node").alias("source"), "c"), "source").join(colour.select(F.col("node").alias("sink"), F.col("c").alias("_c")), "sink").where("c = _c").select("source", "sink")
        inner = written(inner)[0]
        back, told = written(colour.where("node = c"))
        whole = back
        while told["n"]:
            back, told = written(inner.join(back.select(F.col("node").alias("sink"), "c"), "sink").select(F.col("source").alias("node"), "c").distinct().join(whole.select("node"), "node", "left_anti"))
            whole = written(whole.union(back))[0]
        out = out.union(whole.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").join(whole, "c").select("node", F.col("c").alias("cycle")))
        gone = whole.select("node")
        e, n = written(e.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "sink"), "sink", "left_anti").select("source", "sink"))
    return out.groupBy("node").agg(F.min("cycle").alias("cycle"))
