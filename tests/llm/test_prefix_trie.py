import hashlib
import random
import zlib

import pytest

from rheolake.llm import prefix_trie as trie

SCHEMA = "text string, depth int, conv_id long, turn long, key string, role string, part int"


def build(rows):
    """Rebuilt conversations by the definition."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(sequences):
    nodes = {}
    for c, said in sequences.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
    found = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        kids = lambda q: [p for p in nodes if len(p) == len(q) + 1 and p[: len(q)] == q]
        ends = sorted(c for c in members if len(sequences[c]) == len(prefix))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(nodes[prefix[:-1]]) if prefix else None
        found.append((min(members), len(prefix), parent, len(members), len(kids(prefix)), sum(not kids(p) for p in below), saved, digest))
    return sorted(found, key=repr)


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(text, 1, conv, turn, "k", role, 2) for conv, turn, role, text in rows], SCHEMA)


@pytest.fixture(params=[1, 5, 40])
def partitions(spark, request):
    """Nodes are stitched across this many range partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def talk(draw, convs, texts, longest=7):
    return [(c, t, draw.choice(["user", None]), draw.choice(texts)) for c in convs for t in range(draw.randrange(longest))]


@pytest.mark.parametrize("case", ["mixed", "copies", "nulls", "empty", "single", "no turns", "long"])
def test_trie_equals_brute_force(spark, case, partitions):
    draw = random.Random(case)
    rows = {
        "mixed": lambda: talk(draw, range(120), ["a", "é", "", None]),
        "copies": lambda: talk(draw, range(40), ["a", "b"]) + [(c, t, "user", "same") for c in range(100, 180) for t in range(9)],
        "nulls": lambda: [(None, 1, "user", "x"), (3, None, None, None), (3, 2, "user", "y"), (3, 2, "user", "y"), (4, None, None, ""), (7, 0, "user", "z")],
        "empty": list,
        "single": lambda: [(11, t, "user", "q" * t) for t in range(4)],
        "no turns": lambda: [(c, 0, "user", "a") for c in (1, 2, 3, 4, 6, 7, 8, 9)],
        "long": lambda: [(c, t, "user", "a" if t < 150 else f"{c}") for c in (0, 5, 10, 15, 20) for t in range(200)] + [(25, 0, "user", "w" * 70_000)],
    }[case]()
    assert result(trie.trie(trie.rebuilt(frame(spark, rows)))) == brute(build(rows))


def test_one_conversation_in_a_third_of_all(spark, partitions):
    """Equal arrays are split among partitions by conv_id, and their ids are hashed in order all the same."""
    rows = [(c, t, "user", "same") for c in range(0, 1500, 5) for t in range(2)] + [(c, 0, "user", f"{c}") for c in range(1, 600, 5)]
    assert result(trie.trie(trie.rebuilt(frame(spark, rows)))) == brute(build(rows))
