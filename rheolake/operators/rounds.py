"""Graph steps of any size as rounds of joins: components, chains by pointer doubling, spanning forests.

Tables are keyed by case_id, but no task holds a case: every join and grouping is by node, arc or component, and each
round's table is written to the shared folder and its predecessor deleted.  Results equal those of the kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rheolake.storage import discard, materialize

CASE = "case_id"


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 within the case in order: a range sort, then the counts of its partitions."""
    keys = [CASE, *order]
    kept = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    counts = kept.groupBy(CASE, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row a case and partition
    earlier = Window.partitionBy(CASE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(CASE, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return kept.select("*", part).join(shifts, [CASE, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def component_of(edges: DataFrame) -> DataFrame:
    """node, root for edges(case_id, a, b): the smallest node reached.  Alternating star contractions, written each round.

    Edges run from a larger to a smaller node.  Large stars hang every larger neighbour of a node on its smallest one, small
    stars every smaller one and the node itself; both keep components, and only stars are left when nothing changes.
    """
    down = edges.where("a != b").select(CASE, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links, before = materialize(down, "links"), None
    while True:
        both = links.select(CASE, F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(CASE, F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy(CASE, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, [CASE, "u"]).select(CASE, F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "links")
        smallest = large.groupBy(CASE, "hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, [CASE, "hi"])
        pairs = small.where("lo != m").select(CASE, F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(smallest.select(CASE, "hi", F.col("m").alias("lo")))
        now = materialize(pairs.distinct(), "links")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64(CASE, "hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        discard(large)
        discard(links)
        links = now
        if tuple(mark) == before:
            break
        before = tuple(mark)
    roots = links.select(CASE, F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return links.select(CASE, F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def trace_paths(edges: DataFrame) -> DataFrame:
    """path_nodes(case_id, path_id, seq, node_id) of edges(case_id, src, dst): kernels.trace_paths by list ranking.

    Every edge is two arcs.  An arc that leaves a node of degree 2 follows exactly one other arc; pointer doubling finds for
    each the arc at which its chain leaves a key node, and how far back that is, in as many rounds as the longest chain has
    binary digits.  Arcs of rings without a key node never get there and stay out.
    """
    arcs = edges.select(CASE, F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(CASE, F.col("dst").alias("a"), F.col("src").alias("b")))
    degree = arcs.groupBy(CASE, "a").agg(F.count("*").alias("degree"))
    arcs = materialize(arcs.join(degree, [CASE, "a"]), "arcs")
    # the arc before (a, b), where a has degree 2, comes from a's other neighbour
    into = arcs.select(CASE, F.col("a").alias("z"), F.col("b").alias("a"))
    inner = arcs.where("degree = 2").join(into, [CASE, "a"]).where("z != b").select(CASE, "a", "b", F.col("z").alias("pa"), F.col("a").alias("pb"), F.lit(1).cast("long").alias("back"))
    first = arcs.where("degree != 2").select(CASE, "a", "b", F.col("a").alias("pa"), F.col("b").alias("pb"), F.lit(0).cast("long").alias("back"), F.lit(True).alias("done"))
    state = materialize(first.unionByName(inner.withColumn("done", F.lit(False))), "ranks")
    left = state.where("NOT done").count()
    while left:
        ahead = state.select(CASE, F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("back").alias("more"), F.col("done").alias("ends"))
        jumped = state.where("NOT done").join(ahead, [CASE, "pa", "pb"]).select(CASE, "a", "b", F.col("qa").alias("pa"), F.col("qb").alias("pb"), (F.col("back") + F.col("more")).alias("back"), F.col("ends").alias("done"))
        now = materialize(state.where("done").unionByName(jumped), "ranks")
        discard(state)
        state = now
        still = state.where("NOT done").count()
        if still == left:  # only rings are left
            break
        left = still
    done = state.where("done")
    heads = degree.where("degree != 2").select(CASE, F.col("a").alias("b"))
    ends = done.join(heads, [CASE, "b"]).select(CASE, F.col("pa").alias("start"), F.col("pb").alias("step"), F.col("b").alias("end"), F.col("a").alias("last"))
    # the same chain from its other end leaves end towards last; the smaller of the two stands for both
    kept = ends.where("start < `end` OR start = `end` AND step <= last").select(CASE, "start", "step")
    paths = materialize(numbered(kept, ["start", "step"], "path_id"), "paths")
    points = done.select(CASE, F.col("pa").alias("start"), F.col("pb").alias("step"), (F.col("back") + 1).alias("seq"), F.col("b").alias("node_id")).join(paths, [CASE, "start", "step"])
    points = points.select(CASE, "path_id", "seq", "node_id").unionByName(paths.select(CASE, "path_id", F.lit(0).cast("long").alias("seq"), F.col("start").alias("node_id")))
    return points.select(CASE, F.col("path_id").cast("int").alias("path_id"), F.col("seq").cast("int").alias("seq"), "node_id")


def prune_triangles(edges: DataFrame) -> DataFrame:
    """edges(case_id, src, dst, in_triangle) without the triangles' edges that connectivity can spare: kernels.prune_triangles.

    What is kept of them is the spanning forest that prefers later edges, over the components of all other edges.  In a
    round each component takes its latest edge to another one (edges are in strict order, so these are in the forest), and
    what they join becomes one; the number of components that have such edges at least halves.
    """
    fixed = edges.where("NOT in_triangle").select(CASE, "src", "dst")
    roots = component_of(fixed.select(CASE, F.col("src").alias("a"), F.col("dst").alias("b")))

    def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """rows with u and v, the ends' components, replaced by those components' roots; inner edges go."""
        for end in ("u", "v"):
            own = labels.select(CASE, F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            rows = rows.join(own, [CASE, end], "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        return rows.where("u != v")

    spare = edges.where("in_triangle").select(CASE, "src", "dst", F.col("src").alias("u"), F.col("dst").alias("v"))
    spare = materialize(relabelled(spare, roots), "spare")
    kept = fixed
    while not spare.isEmpty():
        sides = spare.select(CASE, F.col("u").alias("c"), "src", "dst", "u", "v").unionByName(spare.select(CASE, F.col("v").alias("c"), "src", "dst", "u", "v"))
        best = sides.groupBy(CASE, "c").agg(F.max(F.struct("src", "dst", "u", "v")).alias("e"))
        taken = materialize(best.select(CASE, "e.*").distinct(), "taken")
        kept = kept.unionByName(taken.select(CASE, "src", "dst"))
        now = materialize(relabelled(spare, component_of(taken.select(CASE, F.col("u").alias("a"), F.col("v").alias("b")))), "spare")
        discard(spare)
        spare = now
    return kept
