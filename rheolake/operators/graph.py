"""Graphs of skeleton points: nodes(case_id, node_id, x, y, z), edges(case_id, src, dst) with src < dst; and path networks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rheolake.functions.vectors import direction_text, dot, minus, vec
from rheolake.operators.batches import complete_groups
from rheolake.operators.nearest import finite, first_of_place, may_be_nearest, point_box
from rheolake.operators.voxel import offsets
from rheolake.storage import materialize

#: One of each pair of opposite steps to the 26 neighbours.
HALF_STEPS = tuple(s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0))

#: Free points meet in bricks of so many radii a side, in leaves of so many (64 at most: a bit each); a task takes about so many
#: distances, and holds so many pairs, at once.
SIDE, LEAF, AT_ONCE = 2, 64, 1 << 18

#: Points within radius are looked for this much farther, for what rounding may do to a distance.
MARGIN = 1 + 1e-9

#: An edge is looked for by pieces of this share of its case's longest side.
PIECES = 32


def lattice_edges(mask: DataFrame, number: Column | None = None) -> DataFrame:
    """Pairs of 26-neighbours: an equi-join of each voxel's 13 forward neighbours.  number: node id of a voxel."""
    node = F.col("node_id") if number is None else number
    rows = mask.select("case_id", "i", "j", "k", node.alias("node"))
    ahead = rows.select("case_id", F.col("node").alias("a"), "i", "j", "k", F.explode(offsets(HALF_STEPS)).alias("s"))
    ahead = ahead.select("case_id", "a", *[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "ijk"])
    found = ahead.join(rows.withColumnRenamed("node", "b"), ["case_id", "i", "j", "k"])
    return found.select("case_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def meetings(nodes: DataFrame, radius: float) -> DataFrame:
    """Each point in its own brick (at_home) and in the bricks ahead that it may reach: two points within radius meet in one brick."""
    size, reach = SIDE * radius, radius * MARGIN
    brick = lambda c, by=0.0: F.floor((F.col(c) + by) / size)
    rows = nodes.select("case_id", "node_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna().where(finite(["x", "y", "z"]))
    rows = rows.withColumn("home", F.struct(*[brick(c).alias(f"b{c}") for c in "xyz"]))
    for c in "xyz":
        rows = rows.withColumn(f"b{c}", F.explode(F.sequence(brick(c, -reach), brick(c, reach))))
    here = F.struct("bx", "by", "bz")
    return rows.where(here >= F.col("home")).withColumn("at_home", here == F.col("home")).drop("home")


def leaves(at: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of at in boxes of at most so many points each, made by halving along the longest side; boxes beside each other follow."""
    found, todo = [], [np.arange(len(at))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            found.append(rows)
            continue
        side, half = at[rows][:, np.argmax(np.ptp(at[rows], axis=0))], -(-len(rows) // (2 * most)) * most
        part = rows[np.argpartition(side, half)]
        todo += [part[half:], part[:half]]
    return found


def _near_pairs(parts: Iterable[pa.RecordBatch], keys: list[str], radius: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows by brick: for one leaf of points at home after the other, pairs of its points and those of later leaves or of visitors.

    Points that have the same points of the leaf near follow each other, pairs whose src is in the leaf come first: so a few
    ids in one order come again and again in one column, the other column stays for a while, and files of pairs are small.
    """
    cases, counts, src, dst = [], [], [], []

    def made() -> pa.RecordBatch:
        case = pa.array(cases, schema.field("case_id").type).take(pa.array(np.repeat(np.arange(len(cases)), counts)))
        ends = [pa.array(np.concatenate(v)).cast(schema.field(n).type) for n, v in (("src", src), ("dst", dst))]
        for held in (cases, counts, src, dst):
            held.clear()
        return pa.RecordBatch.from_arrays([case, *ends], schema=schema)

    for pdf, starts in complete_groups((p.to_pandas() for p in parts), keys):
        at, node, home, case = pdf[["x", "y", "z"]].to_numpy(), pdf["node_id"].to_numpy(), pdf["at_home"].to_numpy(), pdf["case_id"].to_numpy()
        for lo, hi in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            there = lo + np.flatnonzero(home[lo:hi])
            own = leaves(at[there], LEAF) if len(there) else []
            if not own:
                continue
            rows = np.r_[there[np.concatenate(own)], lo + np.flatnonzero(~home[lo:hi])]
            x, y, z = (np.ascontiguousarray(v) for v in at[rows].T)
            ids, first = node[rows], 0
            for size in map(len, own):
                leaf = slice(first, first + size)
                gap = [np.maximum(np.maximum(v[leaf].min() - v[first:], v[first:] - v[leaf].max()), 0) for v in (x, y, z)]
                near = first + np.flatnonzero(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= radius * radius)
                step = max(1, AT_ONCE // size)
                for n in range(0, len(near), step):
                    some = near[n : n + step]
                    is_near = np.square(x[some, None] - x[leaf]) + np.square(y[some, None] - y[leaf]) + np.square(z[some, None] - z[leaf]) <= radius * radius
                    is_near &= some[:, None] > np.arange(first, first + size)  # once, where both are in the leaf
                    for is_src in (True, False):
                        which = is_near & (ids[leaf] < ids[some, None] if is_src else ids[leaf] > ids[some, None])
                        bits = np.zeros((len(some), 8), "u1")
                        bits[:, : -(-size // 8)] = np.packbits(which, axis=1)
                        order = np.argsort(bits.view(">u8").astype("u8").ravel(), kind="stable")
                        i, j = np.nonzero(which[order])
                        a, b = ids[first + j], ids[some[order[i]]]
                        cases.append(case[lo])
                        counts.append(len(a))
                        src.append(a if is_src else b)
                        dst.append(b if is_src else a)
                    if sum(counts) > AT_ONCE:
                        yield made()
                first += size
    if cases:
        yield made()


def near_edges(nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs of free points within radius, as many as there are: points meet in bricks, and pairs leave a task as they are found."""
    keys, case, node = ["case_id", "bx", "by", "bz"], nodes.schema["case_id"].dataType, nodes.schema["node_id"].dataType
    schema = StructType([StructField("case_id", case), StructField("src", node), StructField("dst", node)])
    arrow = to_arrow_schema(schema)
    # pairs are many more than points, so bricks are not put together by the points' bytes
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = meetings(nodes, radius).repartition(parts, *keys).sortWithinPartitions(*keys, "node_id")
    return ordered.mapInArrow(lambda batches: _near_pairs(batches, keys, radius, arrow), schema)


def triangles(edges: DataFrame) -> DataFrame:
    """Node triples a < b < c with all three edges."""
    ab = edges.select("case_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    bc = edges.select("case_id", F.col("src").alias("b"), F.col("dst").alias("c"))
    ac = edges.select("case_id", F.col("src").alias("a"), F.col("dst").alias("c"))
    return ab.join(bc, ["case_id", "b"]).join(ac, ["case_id", "a", "c"], "left_semi").select("case_id", "a", "b", "c")


def triangle_edges(edges: DataFrame) -> DataFrame:
    """Edges that lie in a triangle."""
    t = triangles(edges)
    sides = F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])
    return t.select("case_id", F.explode(sides).alias("e")).select("case_id", "e.*").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("case_id", F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("case_id", "node_id").agg(F.count("*").alias("degree"))


def key_nodes(edges: DataFrame) -> DataFrame:
    """Where chains end: end points (degree 1) and branchings (3 or more)."""
    kind = F.when(F.col("degree") == 1, "end").when(F.col("degree") >= 3, "branch")
    return degrees(edges).withColumn("kind", kind).where("kind IS NOT NULL")


def forks(paths: DataFrame) -> DataFrame:
    """paths(case_id, path_id, start_node, end_node): nodes where a path ends and another one ends or starts.

    incoming: paths that end there; outgoing: paths that start there.  Numbered by node.  A path that starts and ends
    at a node is in both lists.
    """
    ends = paths.select("case_id", "path_id", F.explode(F.array(
        F.struct(F.col("end_node").alias("node"), F.lit(True).alias("ends")), F.struct(F.col("start_node").alias("node"), F.lit(False).alias("ends"))
    )).alias("e")).select("case_id", "path_id", "e.*")
    side = lambda ending: F.array_sort(F.collect_set(F.when(F.col("ends") == ending, F.col("path_id"))))
    both = ends.groupBy("case_id", "node").agg(side(True).alias("incoming"), side(False).alias("outgoing"))
    return both.where((F.size("incoming") >= 1) & ((F.size("incoming") >= 2) | (F.size("outgoing") >= 1)))


#: Nodes are dealt into so many blocks by their remainder; a task holds the lists of two blocks.  Path numbers to a row of lists.
BLOCKS, CHUNK = 8, 256


def _merged(lists: list[np.ndarray]) -> np.ndarray:
    """The numbers of ascending lists, each once, ascending."""
    every = np.sort(np.concatenate(lists), kind="stable")  # merges what ascends already
    return every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every


def _neighbours(parts: Iterable[pa.RecordBatch], names: list[str], joined: str | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows by case and blocks: the lists of forks' paths (side not null), then paths by start and end.  Paths with their info."""
    block, lists, pair, both = None, {}, None, None
    rows: list[tuple] = []

    def whole(node: object) -> list[np.ndarray] | None:
        found = lists.get(node)
        if found is not None and any(isinstance(v, list) for v in found):
            found[:] = [_merged(v) if isinstance(v, list) and v else np.array([], "int64") if isinstance(v, list) else v for v in found]
        return found

    def made(batch: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
        paths = [batch.column(c).take(pa.array(at)) for c in names]
        sides = []
        for n in (1, 2):
            ends = np.cumsum([0, *[0 if r[n] is None else len(r[n]) for r in rows]])
            offsets = pa.array(ends, "int32", mask=np.r_[[r[n] is None for r in rows], False])
            values = pa.array(np.concatenate([r[n] for r in rows if r[n] is not None] or [np.array([], "int64")]))
            if joined is None:
                sides.append(pa.ListArray.from_arrays(offsets, values.cast(schema.field("incoming_paths").type.value_type)))
            else:
                sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, values.cast(pa.string())), joined))
        return pa.RecordBatch.from_arrays([*paths, pa.array([r[0] for r in rows], schema.field("fork_roles").type), *sides], names=[*names, "fork_roles", "incoming_paths", "outgoing_paths"])

    for batch in parts:
        cases, first, second, side, node = (batch.column(c).to_pylist() for c in ("case_id", "_first", "_second", "_side", "_node"))
        paths, starts, ends, ids = batch.column("path_id").to_pylist(), batch.column("start_node").to_pylist(), batch.column("end_node").to_pylist(), batch.column("_ids")
        at, held = [], 0
        for n in range(batch.num_rows):
            if (cases[n], first[n], second[n]) != block:
                block, lists, pair = (cases[n], first[n], second[n]), {}, None
            if side[n] is not None:
                lists.setdefault(node[n], [[], []])[side[n]].append(ids[n].values.to_numpy(zero_copy_only=False))
                continue
            if (starts[n], ends[n]) != pair:
                pair = starts[n], ends[n]
                here = {v: f for v in pair if v is not None and (f := whole(v)) is not None}
                roles = [{"node": v, "role": "incoming" if v == ends[n] else "outgoing"} for v in sorted(here)]
                both = (roles, *[_merged([f[m] for f in here.values()]) for m in (0, 1)]) if here else None
            if both is None:
                rows.append((None, None, None))
            else:
                others = []
                for v in both[1:]:
                    own = np.searchsorted(v, paths[n])
                    others.append(np.concatenate((v[:own], v[own + 1 :])) if own < len(v) and v[own] == paths[n] else v)
                rows.append((both[0], *others))
                held += len(others[0]) + len(others[1])
            at.append(n)
            if held > 2_000_000:
                yield made(batch, at)
                rows, at, held = [], [], 0
        if at:
            yield made(batch, at)
            rows = []


def path_info(paths: DataFrame, found: DataFrame, chords: DataFrame | None = None, joined: str | None = None) -> DataFrame:
    """Per path: its forks' nodes with its role there, and the paths before and behind it.

    paths(case_id, path_id, start_node, end_node, ...); found: their forks.  At a fork where a path both ends and starts it
    counts as incoming; so do its neighbours there.  The result names a neighbour in each path's row, so it grows with the square of a node's
    paths; what is shuffled is the forks' lists, a few times over, and never a path's.  joined: what stands between the
    neighbours of a path, which are then a text, made in the tasks that find them; else they are lists.
    """
    if chords is not None:
        paths = paths.join(chords.withColumn("direction_text", direction_text(vec("d"))), ["case_id", "path_id"], "left")
    names = paths.columns
    block = lambda c: F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(BLOCKS)).cast("int")
    chunks = lambda c, n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(CHUNK)), lambda m: m <= F.size(c)), lambda m: F.struct(F.lit(n).alias("side"), F.slice(c, m, F.lit(CHUNK)).alias("ids")))
    cut = found.select("case_id", F.col("node").alias("_node"), F.explode(F.concat(chunks("incoming", 0), chunks("outgoing", 1))).alias("_c"))
    every = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    places = F.array_distinct(F.concat(
        F.transform(every, lambda b: F.struct(block("_node").alias("a"), b.alias("b"))), F.transform(every, lambda b: F.struct(b.alias("a"), block("_node").alias("b")))
    ))
    lists = cut.select("case_id", F.explode(places).alias("_p"), "_node", "_c").select("case_id", F.col("_p.a").alias("_first"), F.col("_p.b").alias("_second"), "_node", F.col("_c.side").alias("_side"), F.col("_c.ids").alias("_ids"))
    asked = paths.select("*", block("start_node").alias("_first"), block("end_node").alias("_second"))
    # the result is far larger than what is shuffled, so blocks are not put together by their bytes
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.unionByName(lists, allowMissingColumns=True).repartition(parts, "case_id", "_first", "_second")
    rows = rows.sortWithinPartitions("case_id", "_first", "_second", F.col("_side").asc_nulls_last(), "start_node", "end_node")
    ids, node = StringType() if joined is not None else found.schema["incoming"].dataType, found.schema["node"].dataType
    roles = ArrayType(StructType([StructField("node", node), StructField("role", StringType())]))
    schema = StructType([*paths.schema.fields, StructField("fork_roles", roles), StructField("incoming_paths", ids), StructField("outgoing_paths", ids)])
    arrow = to_arrow_schema(schema)
    out = rows.mapInArrow(lambda batches: _neighbours(batches, names, joined, arrow), schema)
    extra = [] if chords is None else [c for c in [*chords.columns, "direction_text"] if c not in ("case_id", "path_id")]
    return out.select(*[c for c in names if c not in extra], "fork_roles", "incoming_paths", "outgoing_paths", *extra)


def nearest_path_labels(mask: DataFrame, samples: DataFrame, spacing=(1.0, 1.0, 1.0), bucket: int = 4, rings: int = 2) -> DataFrame:
    """Label (path + 1) of the path sample nearest to each voxel; the first path and sample at ties.

    samples(case_id, path_id, seq, x, y, z).  Voxels meet the samples of their cell and the cells around it, which
    settles those with a sample within ``rings`` cells; the others meet the samples of the cells that may be nearest.
    """
    size = bucket * max(spacing)
    place = lambda f: [F.floor(f(c) / size).cast("int").alias(f"b{c}") for c in "xyz"]
    voxels = mask.select("case_id", "i", "j", "k", *[(F.col(c) * s).alias(f"v{p}") for c, s, p in zip("ijk", spacing, "xyz", strict=True)])
    steps = offsets(tuple(product(range(-rings, rings + 1), repeat=3)))
    spread = samples.select("*", *place(F.col)).select("case_id", "path_id", "seq", "x", "y", "z", F.explode(steps).alias("s"), "bx", "by", "bz")
    spread = spread.select("case_id", "path_id", "seq", "x", "y", "z", *[(F.col(f"b{p}") + F.col(f"s.d{c}")).alias(f"b{p}") for p, c in zip("xyz", "ijk", strict=True)])
    d2 = sum((F.col(p) - F.col(f"v{p}")) * (F.col(p) - F.col(f"v{p}")) for p in "xyz")
    least = F.min(F.struct(d2.alias("d2"), "path_id", "seq")).alias("best")
    key = ["case_id", "i", "j", "k"]
    keyed = voxels.select("*", *place(lambda c: F.col(f"v{c}")))
    # a merge: what explode adds is not in Spark's estimate, which would send all samples through the driver
    near = keyed.hint("merge").join(spread.hint("merge"), ["case_id", "bx", "by", "bz"]).groupBy(*key).agg(least).where(F.col("best.d2") <= (rings * size) ** 2)
    left = voxels.join(near.select(*key).hint("merge"), key, "left_anti").select("case_id", F.struct("i", "j", "k").alias("query_id"), *[F.col(f"v{p}").alias(f"p{p}") for p in "xyz"])
    things = samples.select("case_id", *point_box(), F.struct("path_id", "seq", "x", "y", "z").alias("thing"))
    gap = minus(vec("thing."), vec("p"))
    far = F.min(F.struct(dot(gap, gap).alias("d2"), "thing.path_id", "thing.seq")).alias("best")
    rest = may_be_nearest(first_of_place(things), left).groupBy("case_id", "query_id").agg(far).select("case_id", "query_id.*", "best")
    return near.unionByName(rest).select(*key, (F.col("best.path_id") + 1).alias("label"))


def pick_edge_or_node(nodes: DataFrame, edges: DataFrame, queries: DataFrame, favour: float = 0.7) -> DataFrame:
    """queries(case_id, query_id, px, py, pz): the nearest node, or the nearest edge if that is nearer than favour times it."""
    spots = nodes.select("case_id", *point_box(), F.struct("node_id", "x", "y", "z").alias("thing"))
    gap = minus(vec("p"), vec("thing."))
    near = materialize(may_be_nearest(first_of_place(spots), queries).groupBy("case_id", "query_id").agg(F.min(F.struct(F.sqrt(dot(gap, gap)).alias("d"), "thing.node_id")).alias("n")), "nodes")
    end = lambda c, p: nodes.select("case_id", F.col("node_id").alias(c), *[F.col(x).alias(f"{p}{x}") for x in "xyz"])
    sides = edges.join(end("src", "a"), ["case_id", "src"]).join(end("dst", "b"), ["case_id", "dst"])
    ends = [f"{p}{c}" for p in "ab" for c in "xyz"]
    once = sides.where(finite(ends)).groupBy("case_id", *ends).agg(F.min(F.struct("src", "dst")).alias("e"))  # the first of those between the same places
    once = materialize(once, "edges")  # read for the sizes of cases and for the pieces
    # long edges lie in boxes that hold much else, so they are found by their pieces
    wide = once.groupBy("case_id").agg(F.greatest(*[F.max(F.greatest(f"a{c}", f"b{c}")) - F.min(F.least(f"a{c}", f"b{c}")) for c in "xyz"]).alias("wide"))
    length = F.sqrt(dot(minus(vec("b"), vec("a")), minus(vec("b"), vec("a"))))
    pieces = F.greatest(F.when(F.col("wide") > 0, F.ceil(length / F.col("wide") * PIECES)).otherwise(1), F.lit(1)).cast("int")
    cut = once.join(wide, "case_id").withColumn("pieces", pieces).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.select("case_id", "wide", "pieces", "n", F.struct("e.src", "e.dst", *[F.col(v).cast("double").alias(v) for v in ends]).alias("thing"))
    place = lambda c, n: F.col(f"thing.a{c}") + n / F.col("pieces") * (F.col(f"thing.b{c}") - F.col(f"thing.a{c}"))
    pad = F.col("wide") * 1e-12
    boxes = [(f(place(c, F.col("n")), place(c, F.col("n") + 1)) + s * pad).alias(f"{m}_{c}") for m, f, s in (("lo", F.least, -1.0), ("hi", F.greatest, 1.0)) for c in "xyz"]
    # an edge that is not nearer than favour times the nearest node is not asked for
    asked = queries.join(near.select("case_id", "query_id", (F.col("n.d") * F.col("n.d") * favour * favour).alias("reach")), ["case_id", "query_id"])
    lines = may_be_nearest(cut, asked, lines=True, boxes=boxes).select("case_id", "query_id", "px", "py", "pz", "thing.*")
    along = minus(vec("b"), vec("a"))
    size = dot(along, along)
    alpha = F.when(size > 1e-24, F.least(F.greatest(dot(minus(vec("p"), vec("a")), along) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    off = tuple(F.col(f"p{c}") - F.col(f"a{c}") - F.col("alpha") * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz")
    edge = lines.withColumn("alpha", alpha).groupBy("case_id", "query_id").agg(F.min(F.struct(F.sqrt(dot(off, off)).alias("d"), "src", "dst")).alias("e"))
    both = near.join(edge, ["case_id", "query_id"], "full")
    is_edge = F.coalesce(F.col("e.d") < favour * F.col("n.d"), F.col("n.d").isNull())
    return both.select(
        "case_id", "query_id", F.when(is_edge, "edge").otherwise("node").alias("picked"), F.when(~is_edge, F.col("n.node_id")).alias("node_id"),
        F.when(is_edge, F.col("e.src")).alias("src"), F.when(is_edge, F.col("e.dst")).alias("dst"),
    )
