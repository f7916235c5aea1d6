"""Graph fixpoints as rounds of joins on edge tables.

Every round's result is written to the shared folder, so lost executors cost a reread; a walk's plan names one table a
round until it is written anew. Rounds go by the graph's depth (or its logarithm where pointers are doubled), never by
its size. A walk from many roots lists (root, node): roots times what each reaches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.shared import cut, cut_any, cut_told

#: Hops of a colour between two writes.
HOPS = 3
#: Hops of a walk between two writes, and rounds after which what was seen is written anew as one table.
STRIDE, COMPACT = 2, 8
#: Rows up to which a table may be sent to every task; Spark's guess from the size of compressed files is too low by tens.
FEW = 1 << 17


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges (u, v) with u > v."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v), by alternating large-star and small-star rounds (Kiveris et al.,
    2014); root is the component's smallest node. Null ends and self-loops link nothing and are not listed.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "components")
    mark = _mark(edges)
    while mark[0]:
        edges = cut(_star(_star(edges, True), False), "components")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def reach(arcs: DataFrame, starts: DataFrame, radius: int | None = None, through: DataFrame | None = None) -> DataFrame:
    """(root, node, hop) of nodes that ``starts`` (root, node) reach over ``arcs`` (src, dst), all roots at once.

    ``through`` (node): only these nodes are passed on from, starts excepted; others are reached and end the walk. With more
    than FEW arcs every hop is written, so the rows to go on from are counted: few go to the arcs, many are met by shuffle.
    """
    seen, told = cut_told(starts.select("root", "node").distinct().withColumn("hop", F.lit(0)), "reach", rows=F.lit(True))
    edge, hop, rounds, n_seen, n_edge = seen, 0, 0, told["rows"], told["rows"]
    large = arcs.count() > FEW
    if through is not None:
        onward = arcs.join((through.hint("merge") if large else through).select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
        onward = cut(onward, "arcs") if large else onward
    while radius is None or hop < radius:
        stride = 1 if large else STRIDE
        last = hop + stride if radius is None else min(hop + stride, radius)
        step, steps = edge, []
        while hop < last:
            hop += 1
            over = arcs if through is None or hop == 1 else onward
            if large:
                step, over = (F.broadcast(step), over) if n_edge <= FEW else (step.hint("merge"), over.hint("merge"))
            step = step.join(over, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
            steps.append(step.withColumn("hop", F.lit(hop)))
        first = steps[0] if len(steps) == 1 else reduce(DataFrame.unionAll, steps).groupBy("root", "node").agg(F.min("hop").alias("hop"))
        known = seen.select("root", "node")
        left = first.join(known if n_seen <= FEW else known.hint("merge"), ["root", "node"], "left_anti")
        new, told = cut_told(left, "reach", rows=F.lit(True), edge=F.col("hop") == hop)
        seen, edge, rounds = seen.unionByName(new), new.where(F.col("hop") == hop), rounds + 1
        n_seen, n_edge = n_seen + told["rows"], told["edge"]
        if not n_edge:
            break
        if rounds % COMPACT == 0:
            seen = cut(seen, "reach")
    return seen


def neighbourhood(arcs: DataFrame, starts: DataFrame, radius: int) -> DataFrame:
    """``reach`` over arcs taken both ways."""
    both = arcs.select("src", "dst").unionAll(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return reach(both, starts, max(radius, 0))


def pointer_roots(parents: DataFrame) -> DataFrame:
    """(node, root, dist) by pointer doubling over ``parents`` (node, parent; null at a root). Rounds: log of the depth.

    Nodes on a cycle, or that lead into one, get a null root.
    """
    known = parents.select("node")
    inner = parents.where("parent IS NOT NULL").join(known.withColumnRenamed("node", "parent"), "parent", "left_semi")
    lone = parents.join(inner.select("node"), "node", "left_anti").select("node", F.coalesce("parent", "node").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(True).alias("done"))
    state = cut(lone.unionByName(inner.select("node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done"))), "pointers")
    n = state.count()
    for _ in range(n.bit_length() + 1):
        if state.where("NOT done").isEmpty():
            break
        to = state.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("dist").alias("more"), F.col("done").alias("ends"))
        open_ = state.where("NOT done").join(to, "at").select("node", F.col("far").alias("at"), F.least(F.col("dist") + F.col("more"), F.lit(1 << 60)).alias("dist"), F.col("ends").alias("done"))
        state = cut(state.where("done").unionByName(open_), "pointers")
    return state.select("node", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("dist")).alias("dist"))


def levels(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, level): 0 without incoming ``arcs`` (src, dst), else one more than the highest source; null on or behind a cycle."""
    nodes, arcs = nodes.select("node"), cut(arcs.select("src", "dst").distinct(), "arcs")
    waiting = cut(arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")).withColumn("top", F.lit(0)), "levels")
    done = edge = cut(nodes.distinct().join(waiting, "node", "left_anti").withColumn("level", F.lit(0)), "levels")
    more = True
    while more:
        # Only the newest level is passed on; what still waits keeps the count of its unmet sources.
        met = arcs.join(edge, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"), F.max("level").alias("high"))
        state = waiting.join(met, "node", "left").select("node", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), F.greatest("top", "high").alias("top"))
        state, more = cut_any(state, "levels", F.col("need") == 0)
        edge, waiting = state.where("need = 0").select("node", (F.col("top") + 1).alias("level")), state.where("need > 0")
        done = done.unionByName(edge)
    return nodes.join(done, "node", "left")


def chains(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, head, rank) of linear chains over ``links`` (node, parent).

    A chain starts at a node without a parent and goes on while there is exactly one child. Nodes that no chain reaches
    (children of a branch, and what follows them) are chains of their own.
    """
    single = links.groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("node", "parent")
    heads = nodes.select("node").join(links.select("node"), "node", "left_anti").select(F.col("node").alias("root"))
    found = pointer_roots(nodes.select("node").join(single, "node", "left"))
    tied = found.join(heads, "root", "left_semi").select("node", F.col("root").alias("head"), F.col("dist").alias("rank"))
    lone = nodes.select("node").join(tied, "node", "left_anti").select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("rank"))
    return tied.unionByName(lone)


def _tails(left: DataFrame, own: DataFrame) -> DataFrame:
    """(node) of ``left`` that the arcs ``own`` lead only to a node without an arc out, or by which only one without an arc in
    leads there: each is a component of its own. Runs of nodes with one arc are followed by doubling."""
    found = None
    for src, dst in (("src", "dst"), ("dst", "src")):
        out = own.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("n"), F.min(dst).alias("to"))
        parents = cut(left.join(out, "node", "left").select("node", F.when(F.col("n") == 1, F.col("to")).alias("parent"), F.col("n").isNull().alias("end")), "tails")
        if parents.where("end").isEmpty():
            continue
        roots = pointer_roots(parents.select("node", "parent")).join(parents.where("end").select(F.col("node").alias("root")), "root", "left_semi").select("node")
        found = roots if found is None else found.unionByName(roots)
    return left.where("false") if found is None else cut(found.distinct(), "tails")


def strongly_connected(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, component): first what lies before or behind all cycles is trimmed, then by colouring: each node takes the
    largest node that reaches it; the roots of colours take back what reaches them inside their colour; repeated on the
    rest. component is its largest node. Repeated arcs count once.
    """
    left = cut(nodes.select("node").distinct(), "scc")
    out, arcs = None, cut(arcs.select("src", "dst").distinct(), "scc")

    def within(rest: DataFrame) -> DataFrame:
        return cut(arcs.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc")

    while not left.isEmpty():
        own = within(left)
        tails = _tails(left, own)
        if not tails.isEmpty():
            lone = tails.select("node", F.col("node").alias("component"))
            out, left = lone if out is None else out.unionByName(lone), cut(left.join(tails, "node", "left_anti"), "scc")
            if left.isEmpty():
                break
            own = within(left)
        colour = cut(left.withColumn("colour", F.col("node")), "scc")
        while True:
            new = colour.withColumn("was", F.col("colour"))
            for _ in range(HOPS):
                sent = own.join(new.select("node", "colour"), F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("sent"))
                new = new.join(sent, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", "sent").alias("colour"), "was")
            new = cut(new, "scc")
            colour = new.select("node", "colour")
            if new.where("colour <> was").isEmpty():
                break
        back = own.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select(F.col("node").alias("root"), "node")
        found = cut(reach(back, roots).select("node", F.col("root").alias("component")), "scc")
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found, "node", "left_anti"), "scc")
    return out if out is not None else nodes.select("node", F.col("node").alias("component"))
