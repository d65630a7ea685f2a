"""Merkle manifest of a data set: every row a leaf, a tree per group, the groups' roots under one root, proofs per row.

All of it is DataFrame work.  A leaf is hashed where its row is read, so texts are never shuffled.  Rows are numbered by a
range sort on (group, order) and the row counts of its partitions, so that no window ever holds a group.  A level of the
tree is the level below grouped by (group, row number / fanout): at most ``fanout`` children meet, however large the group.
Levels are written to the shared folder.  Proofs are appended on the way down: a node's siblings go before what its parent
has, so a level's join has as many rows as that level has nodes, and only the last step makes a row per leaf, which is
hashed on the spot.  The root and the proof among the groups' roots join at the one top node of each group.

Defined cases: a null field is ``-`` and differs from an empty one; null groups come before all others, null order keys
before all others of their group; rows alike in group and order are ordered by their leaf; repeated rows are leaves of
their own; a group of one row is its leaf, and one group's root is the root; without rows there is no tree and the
result is empty; texts of any length are hashed whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rheolake.llm.common import materialize, quoted, table
from rheolake.llm.crc import CRC_TABLE, crc32_sql

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
#: A group's key: whether it is there, and its bytes (so nulls join and come first).
GROUP = ("grouped", "group")
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with idx (from 0, in order, within the group) and n (rows of the group)."""
    keys = [*GROUP, *order]
    at = F.monotonically_increasing_id().alias("at")
    kept = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", at), "leaves")
    part = F.shiftright("at", 33).alias("part")
    counts = kept.groupBy(*GROUP, part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))  # a row per partition and group
    whole = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*GROUP, "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    found = kept.select("*", part).join(shifts, [*GROUP, "part"])
    return found.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass
class Forest:
    """A tree per group.  levels[k] has the runs of the nodes of level k (0: leaves): kids, the run's own hash, and n, the
    nodes of the group at level k.  lone has the leaves of groups of one."""

    levels: list[DataFrame]
    lone: DataFrame

    def tops(self) -> DataFrame:
        """Each group's root: its key and hash."""
        found = self.lone.select(*GROUP, "hash")
        for runs in self.levels:
            found = found.unionByName(runs.where(F.col("n") <= F.col("fanout")).select(*GROUP, "hash"))
        return found


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """The forest over leaves(GROUP, idx, n, hash, own); own is whatever a leaf carries."""
    nodes, levels = leaves, []
    left = leaves.agg(F.max("n")).first()[0] or 0
    while left > 1:
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash", *(["own"] if not levels else []))))
        run = F.floor(F.col("idx") / fanout).alias("idx")
        runs = nodes.where("n > 1").groupBy(*GROUP, run, "n").agg(kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        runs = materialize(runs.select("*", F.sha2(joined, 256).alias("hash"), F.lit(fanout).alias("fanout")), "runs")
        levels.append(runs)
        nodes = runs.select(*GROUP, "idx", F.ceil(F.col("n") / fanout).alias("n"), "hash")
        left = -(-left // fanout)
    return Forest(levels, leaves.where("n = 1"))


def proofs(forest: Forest, above: DataFrame) -> DataFrame:
    """hash, own, subroot, root, steps of every leaf.

    above(GROUP, steps, root) is what follows each group's own root.  A step holds the hashes left and right of a node.
    """

    def under_top(df: DataFrame) -> DataFrame:
        return df.join(above, list(GROUP)).withColumn("subroot", F.col("hash"))

    found = under_top(forest.lone).select("hash", "own", "subroot", "root", "steps")
    upper = None
    for k in range(len(forest.levels) - 1, -1, -1):
        runs = forest.levels[k]
        open_ = under_top(runs.where("n <= fanout").drop("fanout", "n"))
        if upper is not None:
            inner = runs.where("n > fanout").drop("fanout", "n").join(upper, [*GROUP, "idx"])
            open_ = open_.unionByName(inner)
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "").alias("all")
        each = open_.select(*GROUP, "subroot", "root", "steps", joined, F.posexplode("kids").alias("pos", "kid"))
        left = F.substring(F.col("all"), F.lit(1), F.col("pos") * HEX)
        right = F.substring(F.col("all"), (F.col("pos") + 1) * HEX + 1, F.length("all"))
        steps = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("steps")).alias("steps")
        if k:
            upper = each.select(*GROUP, F.col("kid.idx").alias("idx"), "subroot", "root", steps)
        else:
            found = found.unionByName(each.select(F.col("kid.hash").alias("hash"), F.col("kid.own").alias("own"), "subroot", "root", steps))
    return found


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """hash, own, subroot, root, steps for leaves(group, order, hash, own): a tree per group, then one over the groups."""
    grouped = F.col("group").isNotNull().alias("grouped"), F.coalesce("group", F.lit("")).alias("group")
    forest = grow(numbered(leaves.select(*grouped, "order", "hash", "own"), ["order", "hash"]), fanout)
    one = F.lit(True).alias("grouped"), F.lit("").alias("group")
    subroots = forest.tops().select(*one, F.struct(*GROUP).alias("own"), "hash")
    crown = grow(numbered(subroots, ["own"]), fanout)
    root = crown.tops().select(*GROUP, F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps"))
    of_groups = proofs(crown, root).select("own.grouped", "own.group", "root", "steps")
    return proofs(forest, of_groups)


def tampered(doc_id: Column, text: Column) -> Column:
    """text in lower case (A-Z only) where 3 divides the checksum of the decimal doc_id; a null id tampers with nothing."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, lower).otherwise(text)


def document_leaves(docs: DataFrame) -> DataFrame:
    """group, order, hash and own (doc_id, the leaf of the text after tampering) of documents."""
    values = {c: F.col(quoted(c)) for c in FIELDS}
    changed = values | {"text": tampered(values["doc_id"], values["text"])}
    leaf, forged = leaf_hash(list(values.values())), leaf_hash(list(changed.values()))
    own = F.struct(values["doc_id"].alias("doc_id"), forged.alias("forged"))
    return docs.select(values["lang"].alias("group"), values["doc_id"].alias("order"), leaf.alias("hash"), own.alias("own"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(document_leaves(table(spark, sf_dir, "documents")))
    folded = fold(F.col("own.forged"), F.col("steps"))
    rows = found.select(
        F.col("own.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in FIELDS) + ")"


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_leaf_sql("text")} END AS forged
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
tree AS (
  SELECT lang, 0 AS level, idx, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM tree WHERE n > 1
  GROUP BY lang, level, idx // 8, n),
subroots AS (
  SELECT lang, level AS height, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, idx, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM crown WHERE n > 1
  GROUP BY level, idx // 8, n),
places AS (
  SELECT id, l.lang, l.idx, s.idx AS top, s.height FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT p.id, t.level AS depth,
    coalesce(string_agg(t.hash, '' ORDER BY t.idx) FILTER (t.idx < p.idx // (8 ** t.level)::BIGINT), '') AS lefts,
    coalesce(string_agg(t.hash, '' ORDER BY t.idx) FILTER (t.idx > p.idx // (8 ** t.level)::BIGINT), '') AS rights
  FROM places p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.idx // 8 = p.idx // (8 ** (t.level + 1))::BIGINT
  GROUP BY p.id, t.level
  UNION ALL
  SELECT p.id, p.height + c.level,
    coalesce(string_agg(c.hash, '' ORDER BY c.idx) FILTER (c.idx < p.top // (8 ** c.level)::BIGINT), ''),
    coalesce(string_agg(c.hash, '' ORDER BY c.idx) FILTER (c.idx > p.top // (8 ** c.level)::BIGINT), '')
  FROM places p JOIN crown c ON c.n > 1 AND c.idx // 8 = p.top // (8 ** (c.level + 1))::BIGINT
  GROUP BY p.id, p.height + c.level),
paths AS (
  SELECT l.id, sha256(coalesce(string_agg(lefts || rights, '' ORDER BY depth), '')) AS proof,
    coalesce(list([lefts, rights] ORDER BY depth) FILTER (depth IS NOT NULL), []) AS path
  FROM leaves l LEFT JOIN steps USING (id) GROUP BY l.id),
folds AS (
  SELECT id, 0 AS depth, forged AS hash FROM leaves
  UNION ALL
  SELECT f.id, f.depth + 1, sha256(path[f.depth + 1][1] || f.hash || path[f.depth + 1][2]) FROM folds f JOIN paths p USING (id) WHERE f.depth < len(path)),
folded AS (SELECT id, arg_max(hash, depth) AS folded_root FROM folds GROUP BY id)
SELECT doc_id, leaf, s.hash AS subroot, r.hash AS root, proof AS proof_sha256, folded_root, folded_root = r.hash AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN crown r ON r.n = 1 JOIN paths USING (id) JOIN folded USING (id)
"""
