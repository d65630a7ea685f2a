import random

import numpy as np
import pytest
import xxhash

from rheolake.llm import simhash as s
from rheolake.llm.components import connected_components


def brute_fp(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


TEXTS = [None, "", " \n", "one", "ONE", "one two", "a b c d", "A b c É d", "x " * 30_000] + [" ".join(f"w{i % 90}" for i in range(k, k + 400)) for k in range(12)]


def test_fingerprints():
    assert s.fingerprint_texts(TEXTS, 3, 42).tolist() == [brute_fp(t) for t in TEXTS]
    assert s.fingerprint_texts(TEXTS, 1, 42).tolist() == [brute_fp(t, 1) for t in TEXTS]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_near_lanes(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 150).astype(np.uint64)
    for i in range(75, 150):
        fps[i] = fps[i - 75] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 11, replace=False)))
    planes = s.bit_planes(fps)
    rows, blocks = np.repeat(np.arange(150), 3), np.tile(np.arange(3), 150)
    which, lanes = s.near_lanes(fps[rows], blocks, planes, radius)
    got = {(int(rows[w]), int(blocks[w]) * 64 + k) for w, x in zip(which, lanes, strict=True) for k in range(64) if int(x) >> k & 1}
    got = {(i, j) for i, j in got if j < 150}
    assert got == {(i, j) for i in range(150) for j in range(150) if int(fps[i] ^ fps[j]).bit_count() <= radius}


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_are_whole(spark, chunk):
    rng = random.Random(chunk)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(rng.choice([1, 3, 60]))}
    fps = sorted({0, 1, 2**64 - 1} | fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius, agree in ((3, 2), (2, 1), (5, 2)):
        roots = {r.node: r.root for r in connected_components(s.links(df, radius, agree, chunk)).collect()}
        want = brute_components(signed, fps, radius)
        assert [roots.get(x, x) for x in signed] == want


def test_documents(spark):
    texts = TEXTS + TEXTS[6:9] + [None]
    ids = [None, *range(100, 99 + len(texts) - 1), 100]
    docs = spark.createDataFrame([(i, t, 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int").repartition(3)
    fps = [brute_fp(t) for t in texts]
    want = sorted((str(i), f, c) for i, f, c in zip(ids, fps, brute_components(ids, fps, 3), strict=True))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in s.near_duplicates(docs).collect())
    assert got == want
    assert s.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (9, "a b c d e f"), (7, "something else altogether"), (None, "a b c d e f"), (8, None), (6, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone_id long")
    for bound in (0, 10):
        left = s.drop_near_duplicates(docs.select("doc_id", "text"), bound, shingle=5)
        assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "6", "7", "None"]


def jaccard(a, b, size=5):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_copies_of_similarity_08(spark):
    """Planted copies of all similarities around the bound, chains and a hub, against all pairs compared."""
    rng = random.Random(8)
    texts = ["", "one two", "One  two", "one two three"]
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 1, 3])):
            base = list(base) if k % 2 else texts[-1].split()
            for i in rng.sample(range(len(base)), rng.randrange(1, 2 + len(base) // 40)):
                base[i] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(base))
    hub = [f"h{i}" for i in range(200)]
    texts += [" ".join(hub[:i] + ["x"] + hub[i + 1 :]) for i in range(0, 200, 5)]
    ids = list(range(len(texts)))
    root = list(ids)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for i in ids:
        for j in range(i):
            if texts[i].lower().split() == texts[j].lower().split() or jaccard(texts[i], texts[j]) >= 0.8:
                far += (brute_fp(texts[i], 5) ^ brute_fp(texts[j], 5)).bit_count() > 6
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert far > 20
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in s.near_copies(docs, (4, 5), shingle=5, radius=6).collect()}
    assert got == {i: find(i) for i in ids}
    left = s.drop_near_duplicates(docs, least=(4, 5), shingle=5, radius=6)
    assert sorted(r.doc_id for r in left.collect()) == sorted({find(i) for i in ids})
    assert s.near_copies(docs.limit(0), (4, 5)).count() == 0


def test_set_links_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = rng.choice(10_000, 60, replace=False)
        sets = []
        for _ in range(25):
            own = base.copy()
            at = rng.choice(60, rng.integers(0, 14), replace=False)
            own[at] = rng.integers(10_000, 10**6, len(at))
            sets.append(np.unique(own[: rng.integers(45, 61)]))
        root = rng.integers(0, 22, 25)
        jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))

        def joined(pairs, root=root):
            label = root.copy()
            for u, v in pairs:
                label[label == label[v]] = label[u]
            return [label.tolist().index(x) for x in label]

        every = [(u, v) for u in range(25) for v in range(25) if jaccard(sets[u], sets[v]) >= 0.8]
        got = s.set_links(sets, root, None, (4, 5))
        assert all(jaccard(sets[u], sets[v]) >= 0.8 for u, v in got)
        assert joined(got) == joined(every)
        side = rng.integers(0, 2, 25)
        assert joined(s.set_links(sets, root, side, (4, 5))) == joined([(u, v) for u, v in every if side[u] != side[v]])


def test_near_copies_in_one_large_bucket(spark, monkeypatch):
    """A group whose texts are chained, not all alike: components of all pairs, whatever the chunks."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for i in range(60):
        own = list(base)
        for k in range(rng.randrange(6)):
            own[rng.randrange(70)] = f"x{i}-{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    label = list(range(60))
    for u in range(60):
        for v in range(u):
            if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]):
                a, b = sorted((label[u], label[v]))
                label = [a if x == b else x for x in label]
    assert 3 < len(set(label)) < 50
    for chunk in (1 << 20, 500):
        monkeypatch.setattr(s.bucket_links, "__defaults__", (chunk,))
        got = {r.doc_id: r.component_id for r in s.near_copies(docs, (4, 5), 5, 6).collect()}
        assert [got[i] for i in range(60)] == label


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "x", "y")], ["doc_id", "text", "gone_id", "a.b"])
    got = s.drop_near_duplicates(docs, least=(4, 5), shingle=5)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", "x", "y")]
