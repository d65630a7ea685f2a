"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set where over half of a document's word shingles have it set in their XXH64.  Fingerprints
within ``radius`` bits link.  Cut into ``radius + agree`` blocks, two linked fingerprints agree in at least ``agree``
of them, so each choice of that many blocks is a table whose buckets hold all links between them (exact, no caps).
Inside a bucket nothing is paired up: 64 fingerprints are stored as 64 bit planes, one word per bit, and a query adds
its differing planes into carry-save counters that hold 64 distances at once; a block is given up once all its
distances exceed the radius.  What leaves a task is a star per group found, not its pairs.

Equal fingerprints are one node from the start, so copies cost nothing; a bucket of over ``chunk`` fingerprints is
dealt out as pairs of chunks to many tasks.

``near_copies`` holds to a similarity instead: of pairs that share min-hashes of their shingles in a row, or a group of
linked fingerprints, those stay whose sets of shingles have the Jaccard similarity asked for, counted exactly.

Defined cases: a null text, or one without words, has fingerprint zero and links like any other; fewer words than a
shingle are one shingle; null document ids take part but never name a component, unless it has no other; repeated rows
and ties fall into one component; texts of any length are hashed whole; an empty table gives an empty result; other
columns are not looked at, and drop_near_duplicates passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rheolake.llm.common import bound_batches, fresh, materialize, table
from rheolake.llm.components import connected_components

SHINGLE, SEED, RADIUS, AGREE = 3, 42, 3, 2
CHUNK = 1024
#: Keys of three min-hashes each; a pair of similarity 0.8 shares none of them in one of 100,000 cases.
BANDS, BAND_ROWS = 16, 3
#: Shingles of a bucket's sets that a task compares with each other (or with as many others) at once.
CHUNK_SHINGLES = 1 << 20
#: Shingles of a text hashed at once.
SLAB_SHINGLES = 1 << 14
#: Rows of sorted buckets that a task looks at together.
SLAB_ROWS = 200_000
#: (query, block) comparisons held in arrays at once.
SLAB_PAIRS = 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------------------------------------------------- fingerprints


def shingle_digests(text: str | None, size: int, seed: int) -> list[bytes]:
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_digest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist() if size > 1 else starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint_texts(texts: list[str | None], size: int, seed: int, seen: Callable[[list[bytes]], None] | None = None) -> np.ndarray:
    """Fingerprints as unsigned numbers; each text's digests are shown to ``seen``."""
    out, todo, held = np.zeros(len(texts), np.uint64), [], 0
    digests: list[list[bytes]] = []

    def settle() -> None:
        nonlocal todo, digests, held
        if todo:
            counts = np.array([len(x) for x in digests])
            raw = np.frombuffer(b"".join(b for x in digests for b in x), np.uint8).reshape(-1, 8)
            # A byte per bit, eight of them added at once: no byte overflows within 255 rows.
            lanes = np.unpackbits(raw, axis=1).view(np.uint64)
            first = np.cumsum(counts) - counts
            pieces = (counts + 254) // 255
            of = np.repeat(np.arange(len(counts)), pieces)
            at = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
            total = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0)
            bits = (2 * total > counts[:, None]).astype(np.uint8)
            out[todo] = np.packbits(bits, axis=1).view(">u8")[:, 0]
        todo, digests, held = [], [], 0

    for i, text in enumerate(texts):
        found = shingle_digests(text, size, seed)
        if seen:
            seen(found)
        if found:
            todo.append(i)
            digests.append(found)
            held += len(found)
            if held > 100_000:
                settle()
    settle()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                fps = fingerprint_texts(batch.column(1).to_pylist(), shingle, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return bound_batches(docs).select("doc_id", "text").mapInArrow(compute, "doc_id long, fp long")


# ------------------------------------------------------------------------------------------------------- bit-sliced links


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """planes[b, k]: bit b of the fingerprints 64k to 64k+63, one per bit of the word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0].T)


def near_lanes(queries: np.ndarray, blocks: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For (query, block) pairs: the pairs with a lane within the radius, and those lanes as bits."""
    width = radius.bit_length()
    spare = (1 << width) - 1 - radius  # counters start here, so that they overflow beyond the radius
    alive = np.arange(len(queries))
    counters = [np.full(len(queries), ALL if spare >> j & 1 else 0, np.uint64) for j in range(width)]
    over = np.zeros(len(queries), np.uint64)
    for bit in range(64):
        carry = planes[bit][blocks] ^ (np.uint64(0) - (queries >> np.uint64(bit) & np.uint64(1)))
        for j in range(width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if bit % 8 == 7:
            left = over != ALL
            if np.count_nonzero(left) < 0.8 * len(left):
                alive, queries, blocks, over = alive[left], queries[left], blocks[left], over[left]
                counters = [c[left] for c in counters]
                if not len(alive):
                    break
    left = over != ALL
    return alive[left], ~over[left]


def stars(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets (equal numbers, adjacent), as (member, representative) of each group they form."""
    n = len(fps)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    size = np.diff(edge)
    stop = np.repeat(edge[1:], size)
    label, me = np.arange(n), np.flatnonzero(np.repeat(size, size) > 1)
    planes = bit_planes(fps)
    count = (stop[me] - 1) // 64 - me // 64 + 1
    ends = np.cumsum(count)
    at = 0
    while at < len(me):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB_PAIRS)))
        rows = np.repeat(me[at:upto], count[at:upto])
        block = rows // 64 + np.arange(len(rows)) - np.repeat(ends[at:upto] - count[at:upto] - (ends[at - 1] if at else 0), count[at:upto])
        at = upto
        which, lanes = near_lanes(fps[rows], block, planes, radius)
        for k in range(0, len(which), 1 << 14):
            part = slice(k, k + (1 << 14))
            bits = np.unpackbits(lanes[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lane = np.nonzero(bits)
            u, v = rows[which[part][pair]], block[which[part][pair]] * 64 + lane
            good = (v > u) & (v < n)
            label = _join(label, u[good], v[good])
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def block_masks(radius: int, agree: int) -> list[int]:
    """A mask per table, as signed longs."""
    edges = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    parts = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(radius + agree)]
    masks = [sum(chosen) for chosen in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS, agree: int = AGREE, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fingerprints fp."""
    tables = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("mask")) for i, m in enumerate(block_masks(radius, agree))])
    rows = distinct.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.no").alias("no"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    sizes = rows.groupBy("no", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        rows.join(sizes, ["no", "key"])
        .select("fp", "no", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("fp", "no", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    )
    bucket = ["no", "key", "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            if not len(columns[0]):
                return
            keys = columns[1:]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            cut = len(new) if last else int(np.flatnonzero(new)[-1])
            held = [tuple(c[cut:] for c in columns)]
            if cut:
                u, v = stars(columns[0][:cut].view(np.uint64), np.cumsum(new[:cut]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(5)))
            if sum(len(x[0]) for x in held) >= SLAB_ROWS:
                yield from settle(False)
        if held:
            yield from settle(True)

    return dealt.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(compare, "u long, v long")


# -------------------------------------------------------------------------------------------------------------- operator


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, agree: int = AGREE, seed: int = SEED, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of each row."""
    rows = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct.select("fp"), radius, agree, chunk))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(rooted.join(names, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingle_set(digests: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(digests), np.uint64))


def band_keys(found: np.ndarray, seed: int) -> list[int]:
    """A key per band of min-hashes of a set, as signed longs; none for an empty set."""
    import xxhash

    if not len(found):
        return []
    odd, flip = np.random.default_rng(seed).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1)).astype(np.uint64)
    odd = odd << np.uint64(1) | np.uint64(1)
    slabs = (found[k : k + SLAB_SHINGLES] for k in range(0, len(found), SLAB_SHINGLES))
    least = np.min([((slab ^ flip) * odd).min(axis=1) for slab in slabs], axis=0).reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), seed) for band in least], np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, text_hash, fp, and of the set of shingles: a hash (node), the size n and the keys of the bands."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch, nodes, sizes, keys = whole.slice(k, 1000), [], [], []

                def seen(digests: list[bytes], nodes=nodes, sizes=sizes, keys=keys) -> None:
                    found = shingle_set(digests)
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), seed))
                    sizes.append(len(found))
                    keys.append(band_keys(found, seed))

                fps = fingerprint_texts(batch.column(2).to_pylist(), shingle, seed, seen)
                columns = [pa.array(fps.view(np.int64)), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "fp", "node", "n", "bands"])

    rows = bound_batches(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long, node long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, seed: int) -> DataFrame:
    """node and its set of shingles, for the wanted (node, text_hash)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                batch = whole.slice(k, 100)
                sets = [shingle_set(shingle_digests(text, shingle, seed)).view(np.int64) for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    rows = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash").dropDuplicates(["node"])
    return bound_batches(rows.select("node", "text")).mapInArrow(compute, "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity, a fraction of whole numbers."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return both.where(least[1] * common >= least[0] * (F.size("u_set") + F.size("v_set") - common)).select("u", "v")


def set_links(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of sets of at least this similarity that join all those of different roots that can be joined by such pairs.

    side: only sets of different sides are compared.  Two sets that similar share one of any few elements of the one, so
    those that are rarest here name the candidates; the largest group of one root needs no search of its own.
    """
    size = np.array([len(x) for x in sets])
    stop = np.cumsum(size)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
    members = owner[np.argsort(element, kind="stable")]
    first = np.cumsum(count) - count
    label = np.unique(root, return_inverse=True)[1]
    largest = np.bincount(label).argmax()
    found: list[tuple[int, int]] = []
    for u in np.flatnonzero(label != largest).tolist():
        own = element[stop[u] - size[u] : stop[u]]
        rare = own[np.argsort(count[own], kind="stable")][: size[u] - (least[0] * size[u] + least[1] - 1) // least[1] + 1]
        near = members[np.repeat(first[rare] - np.cumsum(count[rare]) + count[rare], count[rare]) + np.arange(count[rare].sum())]
        near = np.unique(near)
        near = near[(label[near] != label[u]) & (least[1] * np.minimum(size[near], size[u]) >= least[0] * np.maximum(size[near], size[u]))]
        if side is not None:
            near = near[side[near] != side[u]]
        for v in near.tolist():
            if label[v] != label[u]:
                common = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                if least[1] * common >= least[0] * (size[u] + size[v] - common):
                    found.append((u, v))
                    label[label == label[v]] = label[u]
    return found


def bucket_links(rows: DataFrame, sets: DataFrame, least: tuple[int, int], chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """Edges (u, v) of at least the similarity between rows(no, key, node, n, root) of a bucket that join different roots.

    Buckets are compared inside tasks, so no pairs are made; one of over ``chunk`` shingles is dealt out as pairs of chunks.
    """
    parts = F.ceil(F.sum("n") / chunk).cast("int")
    sized = rows.groupBy("no", "key").agg(parts.alias("parts"))
    dealt = (
        rows.join(sized, ["no", "key"])
        .withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .select("no", "key", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("no", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "root", "own")
    )
    bucket = ["no", "key", "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def settle() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(held).combine_chunks()
            lists = whole["shingles"].combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            node, own, a, b = (whole[c].to_numpy() for c in ("node", "own", "a", "b"))
            pairs = set_links([flat[i:j] for i, j in zip(at, at[1:], strict=False)], whole["root"].to_numpy(), own if a[0] != b[0] else None, least)
            if pairs:
                u, v = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                part = pa.Table.from_batches([batch.slice(i, j - i)])
                if held and tuple(keys[i]) != last:
                    yield from settle()
                    held = []
                held.append(part)
                last = tuple(keys[i])
        if held:
            yield from settle()

    ready = dealt.join(sets, "node").select(*bucket, "node", "root", "own", "shingles")
    return bound_batches(ready.repartition(*bucket).sortWithinPartitions(*bucket)).mapInArrow(compare, "u long, v long")


def near_copies(
    docs: DataFrame, least: tuple[int, int], shingle: int = SHINGLE, radius: int = RADIUS, agree: int = AGREE, seed: int = SEED, chunk: int = CHUNK
) -> DataFrame:
    """doc_id and component_id over links of at least the Jaccard similarity ``least``, a fraction like (4, 5).

    Candidates share a bucket: a band, or a component of fingerprints within ``radius``.  First each is held against the
    first of its bucket; then buckets that hold several components still are compared inside tasks.  So no pairs of a
    bucket become rows, and every two of a bucket that matter are compared.
    """
    rows = materialize(sketches(docs, shingle, seed), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("fp", "n", "bands")], F.min("text_hash").alias("text_hash"))
    nodes = materialize(nodes, "nodes")
    groups = connected_components(links(nodes.select("fp").distinct(), radius, agree, chunk)).withColumnsRenamed({"node": "fp", "root": "key"})
    # buckets of equal fingerprints count as well as those of linked ones
    linked = nodes.where("n > 0").join(groups, "fp", "left").select(F.lit(-1).alias("no"), F.coalesce("key", "fp").alias("key"), "node", "n")
    every = nodes.select(F.posexplode("bands").alias("no", "key"), "node", "n").unionByName(linked)
    shared = every.groupBy("no", "key").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("head")).where("c > 1").drop("c")
    members = materialize(every.join(shared, ["no", "key"]), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "text_hash"), "node")
    sets = materialize(shingle_sets(docs, wanted, shingle, seed), "sets")
    # sets of too different sizes cannot be that similar
    fits = least[1] * F.least("n", "head.n") >= least[0] * F.greatest("n", "head.n")
    stars = members.where((F.col("node") > F.col("head.node")) & fits)
    near = materialize(similar(stars.select(F.col("node").alias("u"), F.col("head.node").alias("v")).distinct(), sets, least), "near")
    named = members.join(connected_components(near), "node", "left").select("no", "key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("no", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("no", "key")
    open_rows = named.join(mixed, ["no", "key"], "left_semi")
    more = materialize(bucket_links(open_rows, sets, least), "near")
    roots = connected_components(near.unionByName(more))
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(rooted.join(names, "root").select("node", "component_id"), "classes")
    return rows.join(classes, "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """docs without those whose component has a smaller doc_id.

    Components are those of near_copies where ``least`` is given, else of near_duplicates.  Rows without an id stay, and
    rows of one id stay or go together.  Up to ``broadcast_ids`` ids to drop are
    broadcast; more are joined by shuffling.
    """
    find = near_copies if "least" in options else near_duplicates
    found = find(docs.select("doc_id", "text"), **options)
    name = fresh(docs)("gone_id")
    gone = materialize(found.where("doc_id > component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    return docs.join(side, F.col("doc_id") == F.col(name), "left_anti")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
