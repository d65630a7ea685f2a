import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rheolake.llm import merkle

SCHEMA = "extra int, doc_id long, text string, lang string, source string, n_chars long, hash string, grouped string, own int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def tree(hashes):
    """Root, and each leaf's list of (left, right)."""
    steps, owners, level = [[] for _ in hashes], [[i] for i in range(len(hashes))], list(hashes)
    while len(level) > 1:
        up, up_owners = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for i, own in enumerate(owners[a : a + 8]):
                for x in own:
                    steps[x].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(sha(*run))
            up_owners.append(sum(owners[a : a + 8], []))
        level, owners = up, up_owners
    return level[0], steps


def brute(rows):
    found, groups = [], {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    if not langs:
        return []
    root, above = tree([trees[x][0] for x in langs])
    for lang, upper in zip(langs, above, strict=True):
        subroot, steps = trees[lang]
        for r, own in zip(groups[lang], steps, strict=True):
            path = own + upper
            changed = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                changed["text"] = "".join(c.lower() if c.isascii() else c for c in r["text"])
            folded = leaf(changed)
            for left, right in path:
                folded = sha(left, folded, right)
            found.append((r["doc_id"], leaf(r), subroot, root, sha(*(x + y for x, y in path)), folded, folded == root))
    return sorted(found, key=repr)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(1, r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y", 2) for r in rows], SCHEMA)
    found = merkle.manifest(merkle.document_leaves(docs.repartition(parts)))
    folded = merkle.fold(F.col("own.forged"), F.col("steps"))
    out = found.select("own.doc_id", "hash", "subroot", "root", merkle.proof_hash(F.col("steps")), folded, folded == F.col("root"))
    return sorted(map(tuple, out.collect()), key=repr)


def make(draw, ids, langs):
    text = lambda: draw.choice([None, "", "Ab", "ÄÖ b", "x" * 5000, "A" * 3])
    return [{"doc_id": i, "text": text(), "lang": draw.choice(langs), "source": draw.choice([None, "", "web"]), "n_chars": draw.choice([None, 0, 7])} for i in ids]


@pytest.mark.parametrize("case", ["mixed", "one row", "one group", "many groups", "repeats", "empty", "null ids"])
def test_manifest_equals_brute_force(spark, case):
    draw = random.Random(case)
    rows = {
        "mixed": lambda: make(draw, range(150), ["de", "en", None, "", "é"]),
        "one row": lambda: make(draw, [5], ["de"]),
        "one group": lambda: make(draw, range(65), ["de"]),
        "many groups": lambda: make(draw, range(100), [f"l{i}" for i in range(70)]),
        "repeats": lambda: make(draw, range(3), ["de"]) * 7,
        "empty": list,
        "null ids": lambda: make(draw, [None, None, 1, 2, None, -3], ["de", None]),
    }[case]()
    assert run(spark, rows) == brute(rows)


def test_groups_split_among_partitions(spark):
    """One group holds most rows; the range sort deals it to all partitions, and rows are numbered across them."""
    rows = make(random.Random(3), range(700), ["de"] * 9 + ["en"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert run(spark, rows, parts=8) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tampering_shows(spark):
    found = merkle.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    assert {r.verified for r in found} == {True, False}
    assert len({r.root for r in found}) == 1
