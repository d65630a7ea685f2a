"""Paths and their neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rheolake.operators import graph


@pytest.fixture
def ends(spark):
    rng = np.random.default_rng(4)
    rows = [(n % 2, n, int(a), int(b)) for n, (a, b) in enumerate(rng.integers(0, 9, (300, 2)))]
    alone = [(0, 1000, 500, 501), (0, 1001, None, None), (1, 1002, 600, 601), (1, 1003, 601, 602)]
    return spark.createDataFrame(rows + alone, "case_id int, path_id long, start_node long, end_node long")


def test_neighbours_as_text(ends):
    forks = graph.forks(ends)
    lists = {(r.case_id, r.path_id): (r.incoming_paths, r.outgoing_paths) for r in graph.path_info(ends, forks).collect()}
    texts = {(r.case_id, r.path_id): (r.incoming_paths, r.outgoing_paths) for r in graph.path_info(ends, forks, joined=",").collect()}
    assert len(lists) == 304
    assert texts == {k: tuple(None if v is None else ",".join(map(str, v)) for v in both) for k, both in lists.items()}
    assert lists[0, 1000] == lists[0, 1001] == (None, None)
    assert (texts[1, 1002], texts[1, 1003]) == (("", "1003"), ("1002", ""))
    rows = {(r.case_id, r.path_id): (r.start_node, r.end_node) for r in ends.collect()}
    for (case, path), found in lists.items():
        own = set(rows[case, path]) - {None}
        if found[0] is not None:
            others = [(p, *e) for (c, p), e in rows.items() if c == case and p != path]
            assert found == (sorted(p for p, _, e in others if e in own), sorted(p for p, s, _ in others if s in own))


def test_blocks_stay_apart(spark, ends):
    """A path's neighbours are far more than what is shuffled for it, so few bytes are no reason to put blocks into one task."""
    parts = graph.path_info(ends, graph.forks(ends)).select(F.spark_partition_id()).distinct().count()
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions"))
