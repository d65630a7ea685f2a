import math

import numpy as np
import pyarrow as pa
import pytest

from rheolake.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, queries, k):
    out = {}
    good = [(i, v) for i, v in rows if i is not None and usable(v)]
    for q, v in queries:
        if q is not None and usable(v):
            every = sorted((-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, w, strict=True)), i) for i, w in set((i, tuple(w)) for i, w in good if len(w) == len(v)) if i != q)
            out[q] = every[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.5) for i, v in rows], SCHEMA)


def test_small_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=4), 1).tolist()) for i in range(60)]
    rows += [(100 + i, [1, 0, 0, 0]) for i in range(40)] + [(200, [2, 0, 0, 0]), (201, [-1.0, -0.0, 0, 0]), (202, [-1.0, 0.0, 0, 0])]
    rows += [(300, None), (301, []), (302, [0, 0, 0, 0]), (303, [1, None, 0, 0]), (304, [float("nan"), 1, 1, 1]), (305, [float("inf"), 1, 1, 1]), (None, [1, 1, 1, 1])]
    rows += [(400, [1, 2]), (401, [2, 1]), (402, [3]), rows[0]]
    df = table(spark, rows).repartition(3)
    for k in (3, 20, 500):
        got = {}
        for r in hnsw.nearest_neighbours(df, df, k, shard_rows=50, query_rows=30).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        want = brute(rows, rows, k)
        assert set(got) == {q for q, w in want.items() if w}
        for q, found in got.items():
            found.sort()
            assert [x[0] for x in found] == list(range(1, len(found) + 1))
            assert [x[2] for x in found] == [i for _, i in want[q]], (k, q)
            assert np.allclose([x[1] for x in found], [-s for s, _ in want[q]])


def test_empty(spark):
    df = table(spark, [(1, [1.0, 2.0]), (2, None)])
    assert hnsw.nearest_neighbours(df.limit(0), df).count() == 0
    assert hnsw.nearest_neighbours(df, df.limit(0)).count() == 0
    assert hnsw.nearest_neighbours(df, df).count() == 0


@pytest.mark.parametrize("kind", ["normed", "lengths", "copies"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 24))
    if kind == "normed":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif kind == "copies":
        v[1000:2500] = v[7]
        v[2500:] = v[2500:] * 0.05 + v[9]
    v = v.astype(np.float32).astype(np.float64)
    df = table(spark, list(enumerate(v.tolist())))
    got = {}
    for r in hnsw.nearest_neighbours(df, df.where("vec_id % 20 = 0"), shard_rows=1_500, query_rows=90).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    product = v[::20] @ v.T
    right = 0
    for q, row in zip(range(0, 4000, 20), product, strict=True):
        row[q] = -np.inf
        least = np.sort(row)[-20] - 1e-9  # products of equal vectors may differ in their last bits
        right += sum(row[x] >= least for x in got[q])
    assert len(got) == 200 and all(len(x) == 20 for x in got.values())
    assert right / (200 * 20) > 0.95


def test_recall_in_a_shard_of_real_size():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(hnsw.SHARD_ROWS, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = hnsw.build(v)
    near = graph.nearest(np.c_[v[:200], np.zeros(200)].astype(np.float32), hnsw.QUERY_BREADTH)
    product = v[:200] @ v.T
    want = np.argsort(-product, axis=1)[:, :21]
    exact = np.take_along_axis(product, near, 1)
    got = np.take_along_axis(near, np.argsort(-exact, axis=1)[:, :21], 1)
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(got, want, strict=True)]) > 0.9


@pytest.mark.parametrize("spread", [None, 0.0, 0.25, 0.5, 1.0])
def test_recall_of_varied_lengths_in_a_shard_of_real_size(spread):
    """Plain Gaussian vectors, and directions with lengths varied by a log-normal factor: the stored bands of one shard."""
    rng = np.random.default_rng(8)
    n = hnsw.SHARD_ROWS
    v = rng.normal(size=(n, 64))
    if spread is not None:
        v *= np.exp(spread * rng.normal(size=(n, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    shard = pa.RecordBatch.from_arrays(
        [pa.array([0] * n, pa.int32()), pa.array([64] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array([[i] for i in range(n)], pa.list_(pa.int64()))],
        ["number", "dim", "shard", "v", "ids"],
    )
    stored = [row for batch in hnsw._builder(hnsw.QUERY_BREADTH)(iter([shard])) for row in batch.to_pylist()]
    assert sum(row["size"] for row in stored) == n
    loaded = sorted((hnsw._load(row) for row in stored), key=lambda x: -x[3])
    asked = np.arange(0, n, 40)
    got: dict[int, list[int]] = {}
    for q, x in zip(*(c.to_pylist() for c in hnsw._answers(loaded, v[asked], asked, 20, hnsw.QUERY_BREADTH).columns[:2]), strict=True):
        got.setdefault(q, []).append(x)
    product = v[asked] @ v.T
    product[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-product, axis=1)[:, :20]
    assert np.mean([len(set(got[q]) & set(row.tolist())) / 20 for q, row in zip(asked.tolist(), want, strict=True)]) > 0.95
