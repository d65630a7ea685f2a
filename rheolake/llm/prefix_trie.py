"""Trie of the prefixes that conversations share: which turns are said again and again, and by how many.

A conversation is the array of its turns' keys (16 bytes of a SHA-256 over role and text) and text sizes; texts are not
shuffled.  Arrays are sorted globally (range partitions over keys, then conv_id, so equal conversations are split like
others).  A task sweeps its sorted arrays once: the longest common prefix of neighbours says how many open nodes of the
stack end, and what ends becomes a row.  Nodes on the path of a partition's first or last array may go on in its
neighbours; they leave the task as pieces (a count, a sum, a list of ending ids each), one summary a partition.  A last
sweep over the summaries, in order, stitches pieces into nodes; where a piece was needed to complete a row (its parent's
name, the ids that end in it), a join by (partition, side, depth) brings it.

Defined cases: rows without conv_id take no part; a null turn comes first; rows of one turn are ordered by their key;
null roles and texts are empty; repeated rows are turns of their own; a conversation without turns ends at the root;
no conversations, no root.  Texts of any length count whole.  A conversation's array (20 bytes a turn) is one row.  Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rheolake.llm.common import materialize, table
from rheolake.llm.crc import CRC_TABLE, crc32_sql

KEY = 16
#: Turns that the derived corpus takes over from another conversation, at most.
HEAD = 8

NODE = "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
PIECE = "struct<depth:int,first:boolean,last:boolean,conv_id:long,n_convs:long,n_children:long,n_leaves:long,saved_tokens:long,size:long>"
SWEPT = f"part int, side int, {NODE}, ends_sha256 string, first binary, last binary, pieces array<{PIECE}>, ids binary"
STITCHED = f"part int, side int, {NODE}"


def turn_arrays(conversations: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, conv_id, turns: each conversation's array of struct(key in hex, size), in order; placed by ``by``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    said = F.struct(F.col("turn").isNotNull().alias("known"), "turn", key.alias("key"), F.octet_length(text).alias("size")).alias("said")
    rows = conversations.where("conv_id IS NOT NULL").select(F.expr(by).alias("by"), "conv_id", said)
    ordered = F.transform(F.array_sort(F.collect_list("said")), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size")))
    return rows.repartition("by").groupBy("by", "conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9."""
    own = turn_arrays(conversations, "conv_id - conv_id % 5")
    heads = own.where("conv_id = `by`").select("by", F.slice("turns", 1, HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.expr("slice(turns, 1, 0)"))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.join(heads, "by", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two arrays of keys begin with."""
    if a == b:
        return len(a) // KEY
    d = 0
    while (x := a[d : d + KEY]) and x == b[d : d + KEY]:
        d += KEY
    return d // KEY


class Open:
    """A node whose members are not all seen yet."""

    __slots__ = ("conv", "convs", "children", "leaves", "saved", "size", "first", "ends", "waiting")

    def __init__(self, size: int, first: bool = False):
        self.conv, self.convs, self.children, self.leaves, self.saved, self.size, self.first = None, 0, 0, 0, 0, size, first
        self.ends: list[int] = []
        self.waiting: list[tuple] = []

    def add(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs

    def close(self, depth: int, parent: Open | None, *more: object) -> list[tuple]:
        """All members are seen: the node's row waits in its parent; the rows that waited here are returned."""
        if not self.children:
            self.leaves = 1
        self.saved += (self.convs - 1) * self.size
        row = (depth, self.conv, self.convs, self.children, self.leaves, self.saved, *more)
        if parent is None:
            return [(*x, self.conv) for x in self.waiting] + [(*row, None)]
        parent.children += 1
        parent.leaves += self.leaves
        parent.saved += self.saved
        parent.waiting.append(row)
        return [(*x, self.conv) for x in self.waiting]


def joined(ids: Iterable[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


class Sweep:
    """One pass over a partition's sorted arrays."""

    def __init__(self) -> None:
        self.stack: list[Open] = []
        self.begin: bytes | None = None
        self.before = b""
        self.rows: list[tuple] = []  # depth, conv, convs, children, leaves, saved, ends, parent, side of a piece that is the parent
        self.pieces: list[tuple] = []
        self.chunks: list[tuple] = []

    def take(self, conv: int, key: bytes, sizes: list[int]) -> None:
        first = self.begin is None
        if first:
            self.begin = key
            self.stack.append(Open(0, True))
            shared = 0
        else:
            shared = common(self.before, key)
            self.shut(shared, last=False)
        for size in sizes[shared:]:
            self.stack.append(Open(size, first))
        top = self.stack[-1]
        top.add(conv, 1)
        top.ends.append(conv)
        self.before = key

    def shut(self, down_to: int, last: bool) -> None:
        """Close the open nodes below a depth; last: at the partition's end, where all of them are pieces."""
        stack = self.stack
        while len(stack) > down_to + 1:
            node, depth = stack.pop(), len(stack)
            parent = stack[-1] if stack else None
            if parent is not None:
                parent.add(node.conv, node.convs)
            if last or node.first:
                side = 0 if node.first else 1
                self.rows += [(*x, None, side) for x in node.waiting]
                self.pieces.append((depth, node.first, last, node.conv, node.convs, node.children, node.leaves, node.saved, node.size))
                if node.ends:
                    self.chunks.append((side, depth, joined(node.ends)))
            else:
                self.rows += [(*x, None) for x in node.close(depth, parent, hashlib.sha256(joined(node.ends)).hexdigest())]

    def batch(self, part: int) -> pa.RecordBatch:
        """The rows so far, as SWEPT."""
        depth, conv, convs, children, leaves, saved, ends, parent, side = zip(*self.rows, strict=True)
        return _swept(len(depth), part=part, side=side, depth=depth, conv_id=conv, parent_conv_id=parent, n_convs=convs, n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=ends)


_LONG, _INT = pa.int64(), pa.int32()
_PIECE = pa.struct([("depth", _INT), ("first", pa.bool_()), ("last", pa.bool_())] + [(n, _LONG) for n in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")])
_KINDS = {"part": _INT, "side": _INT, "depth": _INT, "conv_id": _LONG, "parent_conv_id": _LONG, "n_convs": _LONG, "n_children": _LONG, "n_leaves": _LONG, "saved_tokens": _LONG}
_SWEPT = _KINDS | {"ends_sha256": pa.string(), "first": pa.binary(), "last": pa.binary(), "pieces": pa.list_(_PIECE), "ids": pa.binary()}


def _swept(rows: int, part: int, kinds: dict = _SWEPT, **columns: object) -> pa.RecordBatch:
    found = [pa.array([part] * rows, _INT) if n == "part" else pa.array(columns[n], kind) if n in columns else pa.nulls(rows, kind) for n, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(found, list(kinds))


def swept(arrays: DataFrame) -> DataFrame:
    """The sweep of arrays(conv_id, turns): node rows, ids of pieces, and one summary a partition (see SWEPT)."""
    hexed = F.array_join(F.transform("turns", lambda x: x["key"]), "")
    rows = arrays.select("conv_id", F.unhex(hexed).alias("key"), F.transform("turns", lambda x: x["size"]).alias("sizes"))
    rows = materialize(rows, "arrays")  # the range sort reads it twice

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, part = Sweep(), 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if len(batch) else part
            for conv, key, sizes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                sweep.take(conv, key, sizes)
            if len(sweep.rows) > 50_000:
                yield sweep.batch(part)
                sweep.rows = []
        if sweep.begin is None:
            return
        sweep.shut(-1, last=True)
        if sweep.rows:
            yield sweep.batch(part)
        if sweep.chunks:
            side, depth, ids = zip(*sweep.chunks, strict=True)
            yield _swept(len(ids), part=part, side=side, depth=depth, ids=ids)
        yield _swept(1, part=part, first=[sweep.begin], last=[sweep.before], pieces=[[dict(zip(_PIECE.names, x, strict=True)) for x in sweep.pieces]])

    sorted_ = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return materialize(sorted_.select(F.spark_partition_id().alias("part"), "conv_id", "key", "sizes").mapInArrow(work, SWEPT), "swept")


class Stitch:
    """The sweep over the partitions' summaries: pieces of the same node are added up, and names are given to them."""

    def __init__(self) -> None:
        self.stack: list[Open] = []
        self.before: bytes | None = None
        self.nodes: list[tuple] = []  # depth, conv, convs, children, leaves, saved, parent
        self.names: list[tuple] = []  # part, side, depth, conv

    def close(self, down_to: int) -> None:
        while len(self.stack) > down_to + 1:
            node, depth = self.stack.pop(), len(self.stack)
            self.names += [(*x, node.conv) for x in node.ends]  # ends holds the pieces here
            self.nodes += node.close(depth, self.stack[-1] if self.stack else None)

    def add(self, part: int, piece: dict) -> None:
        depth = piece["depth"]
        if depth == len(self.stack):
            self.stack.append(Open(piece["size"]))
        node = self.stack[depth]
        node.add(piece["conv_id"], piece["n_convs"])
        node.children += piece["n_children"]
        node.leaves += piece["n_leaves"]
        node.saved += piece["saved_tokens"]
        node.ends.append((part, 0 if piece["first"] else 1, depth))

    def take(self, part: int, first: bytes, last: bytes, pieces: list[dict]) -> None:
        self.close(common(self.before, first) if self.before is not None else -1)
        pieces = sorted(pieces, key=lambda x: x["depth"])
        for piece in pieces:
            if piece["first"]:
                self.add(part, piece)
        self.close(max(x["depth"] for x in pieces if x["first"] and x["last"]))  # the root is one of them
        for piece in pieces:
            if not piece["first"]:
                self.add(part, piece)
        self.before = last


def stitched(found: DataFrame) -> DataFrame:
    """Nodes made of pieces (part is null), and for each piece (part, side, depth) the conv_id of its node.

    One task takes the summaries in order: their number is that of the partitions, their size that of a path.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitch = Stitch()
        for batch in batches:
            for row in batch.to_pylist():
                stitch.take(**row)
        stitch.close(-1)
        if stitch.nodes:
            depth, conv, convs, children, leaves, saved, parent = zip(*stitch.nodes, strict=True)
            nodes = {"depth": depth, "conv_id": conv, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "parent_conv_id": parent}
            yield pa.RecordBatch.from_arrays([pa.array(nodes[n], k) if n in nodes else pa.nulls(len(depth), k) for n, k in _KINDS.items()], list(_KINDS))
            names = dict(zip(("part", "side", "depth", "conv_id"), zip(*stitch.names, strict=True), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(names[n], k) if n in names else pa.nulls(len(stitch.names), k) for n, k in _KINDS.items()], list(_KINDS))

    summaries = found.where("pieces IS NOT NULL").select("part", "first", "last", "pieces")
    return materialize(summaries.repartition(1).sortWithinPartitions("part").mapInArrow(work, STITCHED), "stitched")


def hashed_ends(chunks: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 for chunks(conv_id, depth, part, ids): the lists are hashed as they stream by, in order."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here[0]], _LONG), pa.array([here[1]], _INT), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(n) for n in ("conv_id", "depth", "ids")), strict=True):
                node = conv.as_py(), depth.as_py()
                if node != here:
                    if here:
                        yield row()
                    here, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py())
        if here:
            yield row()

    placed = chunks.select("conv_id", "depth", "part", "ids").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return placed.mapInArrow(work, "conv_id long, depth int, ends_sha256 string")


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes over arrays(conv_id, turns), conv_id being unique."""
    found = swept(arrays)
    pieces = stitched(found)
    names = pieces.where("part IS NOT NULL").select("part", "side", "depth", F.col("conv_id").alias("name"))
    nodes = found.where("conv_id IS NOT NULL")
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where("side IS NULL").select(columns)
    below = nodes.where("side IS NOT NULL").withColumn("at", F.col("depth") - 1).join(names.withColumnRenamed("depth", "at"), ["part", "side", "at"])
    below = below.withColumn("parent_conv_id", F.col("name")).select(columns)
    chunks = found.where("ids IS NOT NULL").select("part", "side", "depth", "ids").join(names, ["part", "side", "depth"])
    ends = hashed_ends(chunks.withColumn("conv_id", F.col("name")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    across = pieces.where("part IS NULL").join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(columns)
    return inner.unionByName(below).unionByName(across)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie(rebuilt(table(spark, sf_dir, "conversations")))
    whole = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return found.select(*(F.col(c).cast("long").alias(c) for c in whole), "ends_sha256")


SQL = f"""
WITH {CRC_TABLE},
arrays AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT arrays.*, ({crc32_sql("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM arrays, crc),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS said
  FROM cut c LEFT JOIN arrays b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (
  SELECT conv_id, depth, said[1:depth] AS prefix, depth = len(said) AS ends
  FROM (SELECT *, unnest(range(len(said) + 1)) AS depth FROM built)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(prefix[depth].text) END AS saved
  FROM members GROUP BY depth, prefix),
places AS (SELECT m.conv_id, m.depth, n.conv_id AS node FROM members m JOIN nodes n USING (depth, prefix)),
linked AS (
  SELECT n.conv_id, n.depth, p.node AS parent_conv_id, n.n_convs, n.saved, n.ends_sha256
  FROM nodes n LEFT JOIN places p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (conv_id, depth)),
sums AS (
  SELECT p.node AS conv_id, p.depth, sum(c.saved)::BIGINT AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
  FROM counted c JOIN places p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.node, p.depth)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums USING (conv_id, depth)
"""
