"""Approximate nearest neighbours by inner product: navigable small-world graphs per shard, shard results merged.

Equal vectors are one node (its smallest ids answer for it).  Vectors of one dimension are put in order of length and cut
into shards of one size; a shard is cut into bands of nearly one length (longest over shortest at most BAND), and each
band is built once, in one task a shard, as a hierarchy of graphs in flat arrays: vectors, and per layer one row of
neighbour numbers per node.  These are written to the shared folder.  Points are added in blocks: a block searches the
graph so far in step, then links to the found neighbours by the diversity rule, and back.  Queries search every shard, in
blocks of bounded size; a task reads the graphs of a shard and answers queries as they stream in, the longest band first,
and leaves a band out where its length times the query's cannot reach the worst score that is kept.  The best of all
shards are merged by exact double-precision inner products and ties go to smaller ids.

To make the largest inner product a nearest neighbour, a coordinate is added in the index that gives all vectors of a
band the same length; queries get a zero there.  Bands keep that coordinate small: across widely varied lengths it would
drown the others, and searches would end in the wrong place.

Defined cases: vectors null, empty, zero, or with null or non-finite components take no part; candidates are vectors of
the query's length; null ids take no part; of a repeated row every copy but the query's own id is a candidate once per id;
equal query rows are one query; fewer candidates than asked for are all returned; vectors of any length are taken whole;
empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rheolake.llm.common import bound_batches, materialize, table
from rheolake.operators.rounds import numbered

NEAREST = 20
#: Distinct vectors per shard and queries per task, about; neighbours per node (twice that in the lowest layer); breadth of searches.
SHARD_ROWS, QUERY_ROWS = 8_192, 20_000
LINKS, BUILD_BREADTH, QUERY_BREADTH = 16, 96, 128
BLOCK = 128
#: Longest over shortest vector of a band, unless it has fewer rows than a search is broad (then all of them are looked at).
BAND = 1.1
#: Tasks that searches are dealt to, at most; pairs of a shard and a block of queries are numbered and dealt in turn.
MOST_TASKS = 10_000
SEED = 7


@dataclass
class Graph:
    """Flat arrays: vectors [node, dim]; layers[k][node, slot] holds node numbers, -1 where empty; layer 0 is the lowest."""

    vectors: np.ndarray
    layers: list[np.ndarray]
    top: np.ndarray
    entry: int = 0

    def distance(self, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return -np.einsum("qnd,qd->qn", self.vectors[nodes], queries)

    def descend(self, queries: np.ndarray, start: np.ndarray, layer: int) -> np.ndarray:
        """The greedy walk in one layer: each query moves to its best neighbour while that is better."""
        at = start.copy()
        best = self.distance(at[:, None], queries)[:, 0]
        moving = np.arange(len(queries))
        while len(moving):
            around = self.layers[layer][at[moving]]
            d = np.where(around >= 0, self.distance(around, queries[moving]), np.inf)
            k = d.argmin(1)
            found = d[np.arange(len(moving)), k]
            better = found < best[moving]
            moving = moving[better]
            at[moving], best[moving] = around[better, k[better]], found[better]
        return at

    def search(self, queries: np.ndarray, start: np.ndarray, layer: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search in one layer, all queries in step: nodes [query, breadth] (-1: none) and their distances."""
        q, n = len(queries), len(self.vectors)
        rows = np.arange(q)
        nodes = np.full((q, breadth), -1, np.int64)
        dist = np.full((q, breadth), np.inf, np.float32)
        done = np.ones((q, breadth), bool)
        nodes[:, 0] = start
        dist[:, 0] = self.distance(start[:, None], queries)[:, 0]
        done[:, 0] = False
        seen = np.zeros((q, n), bool)
        seen[rows, start] = True
        active = rows
        links = self.layers[layer]
        while len(active):
            open_ = np.where(done[active], np.inf, dist[active])
            k = open_.argmin(1)
            going = np.isfinite(open_[np.arange(len(active)), k])
            active, k = active[going], k[going]
            if not len(active):
                break
            done[active, k] = True
            around = links[nodes[active, k]]
            fresh = (around >= 0) & ~seen[active[:, None], around]
            seen[active[:, None], np.where(around >= 0, around, nodes[active, k][:, None])] = True
            # the worst kept one bounds what can enter
            d = np.where(fresh, self.distance(np.maximum(around, 0), queries[active]), np.inf).astype(np.float32)
            d[d >= dist[active, -1][:, None]] = np.inf
            entering = np.isfinite(d).any(1)
            if entering.any():
                act, d, around = active[entering], d[entering], around[entering]
                all_d = np.concatenate([dist[act], d], 1)
                order = np.argpartition(all_d, breadth - 1, axis=1)[:, :breadth]
                own = np.take_along_axis(all_d, order, 1)
                last = own.argmax(1)
                order[np.arange(len(act)), last], order[:, -1] = order[:, -1].copy(), order[np.arange(len(act)), last].copy()
                dist[act] = np.take_along_axis(all_d, order, 1)
                nodes[act] = np.take_along_axis(np.concatenate([nodes[act], around], 1), order, 1)
                done[act] = np.take_along_axis(np.concatenate([done[act], ~np.isfinite(d)], 1), order, 1)
        by = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(nodes, by, 1), np.take_along_axis(dist, by, 1)

    def nearest(self, queries: np.ndarray, breadth: int) -> np.ndarray:
        """Nodes [query, breadth], nearest first, -1 where there are no more."""
        at = np.full(len(queries), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.descend(queries, at, layer)
        return self.search(queries, at, 0, min(breadth, len(self.vectors)))[0]


def diverse(vectors: np.ndarray, own: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row's own node than to any one taken before."""
    n, width = found.shape
    v = vectors[np.maximum(found, 0)]
    to_own = ((v - vectors[own][:, None]) ** 2).sum(2)
    taken = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    nearest_taken = np.full((n, width), np.inf)
    for j in range(width):
        take = (found[:, j] >= 0) & (found[:, j] != own) & (to_own[:, j] < nearest_taken[:, j]) & (count < most)
        taken[:, j] = take
        count += take
        if take.any():
            d = ((v[take] - v[take, j][:, None]) ** 2).sum(2)
            nearest_taken[take] = np.minimum(nearest_taken[take], d)
    out = np.full((n, most), -1, np.int64)
    row, col = np.nonzero(taken)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = found[row, col]
    return out


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that makes all of them as long as the longest."""
    raw = vectors.astype(np.float32)
    norm = (raw.astype(np.float64) ** 2).sum(1)
    return np.c_[raw, np.sqrt(np.maximum(norm.max() - norm, 0)).astype(np.float32)]


def bands(vectors: np.ndarray, least: int, ratio: float = BAND) -> list[np.ndarray]:
    """Row numbers by bands of length, shortest first: within the ratio, but at least so many rows."""
    length = np.linalg.norm(vectors, axis=1)
    order = np.argsort(length, kind="stable")
    length, out, a = length[order], [], 0
    while a < len(order):
        b = max(int(np.searchsorted(length, length[a] * ratio, side="right")), a + least)
        out.append(order[a:b])
        a = b
    return out


def build(vectors: np.ndarray, links: int = LINKS, breadth: int = BUILD_BREADTH, seed: int = SEED) -> Graph:
    """The graph of a shard's vectors [n, dim] (as they are; see the module's text for the added coordinate)."""
    v = lifted(vectors)
    n = len(v)
    draw = np.random.default_rng(seed).random(n)
    top = np.minimum((-np.log(1 - draw) / np.log(links)).astype(np.int64), 6)
    top[0] = top.max()
    layers = [np.full((n, links * (2 if k == 0 else 1)), -1, np.int64) for k in range(int(top[0]) + 1)]
    graph = Graph(v, layers, top, 0)
    at = 1
    while at < n:
        block = np.arange(at, min(n, at + min(BLOCK, at)))  # small blocks first, so that early points see each other
        start = np.zeros(len(block), np.int64)
        new: list[tuple[int, np.ndarray, np.ndarray]] = []
        for layer in range(len(layers) - 1, -1, -1):
            here = top[block] >= layer
            if layer and (~here).any():
                start[~here] = graph.descend(v[block[~here]], start[~here], layer)
            if here.any():
                nodes, _ = graph.search(v[block[here]], start[here], layer, breadth)
                start[here] = nodes[:, 0]
                # points of the same block are candidates too
                mates = block[here]
                near = np.argsort(-(v[mates] @ v[mates].T), axis=1)[:, : links + 1]
                both = np.concatenate([nodes, mates[near]], 1)
                new.append((layer, mates, _nearest_first(v, mates, both)))
        for layer, own, found in new:
            width = layers[layer].shape[1]
            layers[layer][own] = np.pad(diverse(v, own, found, links), ((0, 0), (0, width - links)), constant_values=-1)
            _link_back(v, layers[layer], own)
        at = int(block[-1]) + 1
    return graph


def _nearest_first(v: np.ndarray, own: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Candidates without repeats, by distance to the row's own node, -1 last."""
    d = ((v[np.maximum(found, 0)] - v[own][:, None]) ** 2).sum(2)
    by_node = np.argsort(found, axis=1, kind="stable")
    sorted_ = np.take_along_axis(found, by_node, 1)
    again = np.zeros(found.shape, bool)
    np.put_along_axis(again, by_node, np.c_[np.zeros(len(found), bool), sorted_[:, 1:] == sorted_[:, :-1]], 1)
    bad = again | (found < 0) | (found == own[:, None])
    d[bad] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    return np.where(np.take_along_axis(bad, order, 1), -1, np.take_along_axis(found, order, 1))


def _link_back(v: np.ndarray, links: np.ndarray, own: np.ndarray) -> None:
    """Give each new link its opposite; a node with too many keeps the diverse ones."""
    row, col = np.nonzero(links[own] >= 0)
    target, source = links[own][row, col], own[row]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    extra = np.full((len(nodes), count.max() if len(nodes) else 0), -1, np.int64)
    extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    if not len(nodes):
        return
    every = _nearest_first(v, nodes, np.concatenate([links[nodes], extra], 1))
    width = links.shape[1]
    full = (every >= 0).sum(1) > width
    if (~full).any():
        part = every[~full][:, :width]
        links[nodes[~full]] = part
    if full.any():
        links[nodes[full]] = diverse(v, nodes[full], every[full], width)


# -------------------------------------------------------------------------------------------------------------- operator


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(good)


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int = NEAREST, shard_rows: int = SHARD_ROWS, breadth: int = QUERY_BREADTH, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries(vec_id, embedding) its k nearest rows(vec_id, embedding).

    A task has a shard and a block of queries at a time: a stated query set against all rows, in blocks.
    """
    spark = rows.sparkSession
    points = valid_vectors(rows).select("vec_id", "v", F.xxhash64(F.transform("v", lambda x: x + 0.0)).alias("h"))
    # The k + 1 smallest ids of each vector are all that any query can need of it.
    members = materialize(_smallest_ids(points, k + 1), "members")
    asked = valid_vectors(queries).select(F.size("v").alias("dim"), F.col("vec_id").alias("query_id"), "v").distinct()
    sizes = {r["dim"]: r["n"] for r in members.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    wanted = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect() if r["dim"] in sizes}
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sorted(wanted)
    shards, blocks = {d: -(-sizes[d] // shard_rows) for d in dims}, {d: -(-wanted[d] // query_rows) for d in dims}
    shard_base = dict(zip(dims, np.cumsum([0, *(shards[d] for d in dims)]).tolist(), strict=False))
    pair_base = dict(zip(dims, np.cumsum([0, *(shards[d] * blocks[d] for d in dims)]).tolist(), strict=False))
    of = lambda counts: F.coalesce(*[F.when(F.col("dim") == d, F.lit(counts[d])) for d in dims])
    among = lambda df: df.where(F.col("dim").isin(dims))
    # shards of one size, in order of length
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("length")
    placed = numbered(among(members).select(F.col("dim").alias("case_id"), length, "h", "v", "ids"), ["length", "h"], "place")
    shard = F.floor(F.col("place") / shard_rows).cast("int").alias("shard")
    nodes = placed.select(F.col("case_id").alias("dim"), shard, "v", "ids").withColumn("number", (of(shard_base) + F.col("shard")).cast("int"))
    graphs = bound_batches(nodes.select("number", "dim", "shard", "v", "ids").repartitionById(sum(shards.values()), "number").sortWithinPartitions("number"))
    graphs = materialize(graphs.mapInArrow(_builder(breadth), STORED), "graphs")
    # a pair of shard and block has the shard's graphs, then the block's queries
    pair = (of(pair_base) + F.col("shard") * of(blocks) + F.col("block")).cast("int").alias("pair")
    every = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    stored = [c.split()[0] for c in STORED.split(", ")][2:]
    loads = graphs.select("dim", "shard", every(blocks).alias("block"), *stored).select(pair, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), *stored)
    block = F.pmod(F.xxhash64("query_id", "v"), of(blocks)).cast("int").alias("block")
    asks = among(asked).select("dim", every(shards).alias("shard"), block, "query_id", "v").select(pair, "query_id", "v", *[F.lit(None).cast(graphs.schema[c].dataType).alias(c) for c in stored])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, loaded = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            is_query = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if numbers[i] != here:  # its graphs come before its queries
                    here, loaded = numbers[i], []
                part = batch.slice(i, j - i)
                if not is_query[i]:
                    loaded += [_load(row) for row in part.to_pylist()]
                elif loaded:
                    flat = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                    owners = part.column(1).to_numpy()
                    loaded.sort(key=lambda x: -x[3])
                    for at in range(0, len(flat), 512):
                        yield _answers(loaded, flat[at : at + 512], owners[at : at + 512], k, breadth)

    tasks = min(sum(shards[d] * blocks[d] for d in dims), MOST_TASKS)
    together = loads.unionByName(asks).repartitionById(tasks, F.pmod("pair", F.lit(tasks)))
    sorted_ = together.sortWithinPartitions("pair", F.col("query_id").isNotNull())
    found = bound_batches(sorted_).mapInArrow(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: A band: its vectors (doubles), the ids of each node and how many they are, the layers of links and their widths.
STORED = "dim int, shard int, size int, vectors binary, id_counts binary, id_values binary, widths array<int>, links array<binary>"


def _builder(breadth: int):
    """Rows (number, dim, shard, v, ids), sorted by number, to STORED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, ids = None, [], []

        def stored() -> Iterator[pa.RecordBatch]:
            base = np.concatenate(parts)
            for rows in bands(base, breadth):
                own = base[rows]
                layers = build(own).layers
                counts = np.array([len(ids[r]) for r in rows], "<i4")
                values = np.array([x for r in rows for x in ids[r]], "<i8")
                columns = [[here[1]], [here[2]], [len(rows)], [own.tobytes()], [counts.tobytes()], [values.tobytes()], [[x.shape[1] for x in layers]], [[x.astype("<i4").tobytes() for x in layers]]]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [c.split()[0] for c in STORED.split(", ")])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True) if len(numbers) else []:
                part = batch.slice(i, j - i)
                key = tuple(part.column(n)[0].as_py() for n in range(3))
                if key != here:
                    if parts:
                        yield from stored()
                    here, parts, ids = key, [], []
                parts.append(part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(j - i, key[1]))
                ids += part.column(4).to_pylist()
        if parts:
            yield from stored()

    return run


def _load(row: dict) -> tuple[Graph, np.ndarray, list[np.ndarray], float]:
    """A stored band: graph, vectors, ids of each node, length of the longest vector."""
    n = row["size"]
    base = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
    layers = [np.frombuffer(x, "<i4").reshape(n, w).astype(np.int64) for x, w in zip(row["links"], row["widths"], strict=True)]
    ids = np.split(np.frombuffer(row["id_values"], "<i8"), np.cumsum(np.frombuffer(row["id_counts"], "<i4"))[:-1])
    return Graph(lifted(base), layers, np.zeros(0, np.int64)), base, ids, float(np.linalg.norm(base, axis=1).max())


def _answers(loaded: list[tuple], ask: np.ndarray, owners: np.ndarray, k: int, breadth: int) -> pa.RecordBatch:
    """The k nearest rows of one shard: nodes by exact inner product, then their ids, without the query's own."""
    queries = np.c_[ask, np.zeros(len(ask))].astype(np.float32)
    reach = np.linalg.norm(ask, axis=1) * (1 + 1e-9)
    kept: list[list[tuple[float, int]]] = [[] for _ in owners]
    worst = np.full(len(ask), -np.inf)
    for graph, base, ids, longest in loaded:  # longest first
        open_ = np.flatnonzero(reach * longest >= worst)
        if not len(open_):
            break
        near = graph.nearest(queries[open_], max(breadth, k + 1))
        for row, i in zip(near, open_.tolist(), strict=True):
            nodes = row[row >= 0]
            exact = (base[nodes] * ask[i]).sum(1)
            pairs, bound = [], None
            for j in np.argsort(-exact, kind="stable").tolist():
                if exact[j] < worst[i] or bound is not None and exact[j] < bound:
                    break
                pairs += [(-float(exact[j]), int(x)) for x in ids[nodes[j]] if x != owners[i]]
                if bound is None and len(pairs) >= k:
                    bound = exact[j]  # equal scores may hold smaller ids
            kept[i] = sorted(kept[i] + pairs)[:k]
            if len(kept[i]) == k:
                worst[i] = -kept[i][-1][0]
    rows = [(owner, x, -s) for owner, own in zip(owners.tolist(), kept, strict=True) for s, x in own]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def _smallest_ids(points: DataFrame, most: int) -> DataFrame:
    """dim, h, v and the smallest ids of each distinct vector.  Copies are cut down in every input task before they meet."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, bytes], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(kept)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([len(v) // 8 for _, v in keys], pa.int32()),
                    pa.array([h for h, _ in keys], pa.int64()),
                    pa.array([np.frombuffer(v, np.float64) for _, v in keys], pa.list_(pa.float64())),
                    pa.array([sorted(set(kept[x]))[:most] for x in keys], pa.list_(pa.int64())),
                ],
                ["dim", "h", "v", "ids"],
            )
            kept.clear()
            return out

        for batch in batches:
            ids, hashes, vectors = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False) + 0.0
            for i, (x, h) in enumerate(zip(ids, hashes, strict=True)):
                own = kept.setdefault((h, flat[at[i] : at[i + 1]].tobytes()), [])
                own.append(x)
                if len(own) > 4 * most:
                    own[:] = sorted(set(own))[:most]
            if len(kept) > 50_000:
                yield flush()
        if kept:
            yield flush()

    parts = points.mapInArrow(combine, "dim int, h long, v array<double>, ids array<bigint>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    salted = parts.withColumn("salt", F.spark_partition_id() % 64)
    return salted.groupBy("dim", "h", "v", "salt").agg(ids).groupBy("dim", "h", "v").agg(ids)


def op3_hnsw(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 20 == 0))
