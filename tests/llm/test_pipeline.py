"""The chain over the smallest tables, stage by stage, against plain versions of the operators."""

import os
import re
from pathlib import Path

import pytest

import corpus_pipeline as cp
from rheolake.llm import decontaminate, quality
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_line_dedup import brute as brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/t"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_columns(chain):
    assert all(df.columns == chain[0].columns for df in chain[1:-1])
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "sentencepieces"]


def test_quality(spark, chain):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(chain[0], labels)
    kept = {r[0] for r in rows(chain[1])}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & kept) > 0.97 * len(good & {r[0] for r in rows(chain[0])})
    want = []
    for r in rows(chain[0]):
        _, _, both = model.score(quality.views_of({"text": [r[1]], "lang": [r[2]], "source": [r[3]], "n_chars": [r[4]]}))
        if both[0] >= quality.THRESHOLD:
            want.append(r)
    assert rows(chain[1]) == want


def test_lines(chain):
    before = rows(chain[1])
    left = brute_lines([(r[0], r[1]) for r in before])
    want = [(r[0], left[r[0]], *r[2:4], len(left[r[0]]) if left[r[0]] != r[1] else r[4]) for r in before]
    want = [w for w, r in zip(want, before, strict=True) if w[1] == r[1] or re.search(r"\S", w[1])]
    assert rows(chain[2]) == want


def test_near_duplicates(chain):
    before = rows(chain[2])
    sets = [set(zip(*[(r[1] or "").lower().split()[k:] for k in range(cp.SHINGLE)], strict=False)) or {(r[1] or "").lower()} for r in before]
    label = list(range(len(before)))
    for u in range(len(before)):
        for v in range(u):
            if 5 * len(sets[u] & sets[v]) >= 4 * len(sets[u] | sets[v]):
                a, b = sorted((label[u], label[v]))
                label = [a if x == b else x for x in label]
    assert rows(chain[3]) == [r for i, r in enumerate(before) if label[i] == i]


def test_leaks(spark, chain):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(chain[3]), {r[0]: r for r in rows(chain[4])}
    for r, (n_words, n_hit, _) in zip(before, brute_leaks([r[1] for r in before], items), strict=True):
        if n_hit == 0:
            assert after[r[0]] == r
        elif r[0] in after:
            assert len(decontaminate.words_of(after[r[0]][1])) <= n_words - n_hit
            assert after[r[0]][4] == len(after[r[0]][1])
    assert not any(n for _, n, _ in brute_leaks([r[1] for r in after.values()], items))


def test_pieces(chain):
    got = chain[5].collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows(chain[4])]
    assert all(r.round_trip and r.n_best[0].score == r.score for r in got)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    names = ["accepted", "kept", "gone_id", "n_hit", "clean_text", "ids", "score", "row", "a.b"]
    words = "plain words of a text that is long enough to say something about nothing at all"
    rows = [(None, words), (None, None), (1, words + " one"), (1, words + " one"), (2, ""), (3, None), (4, "x " * 30_000), (5, words.upper())]
    docs = spark.createDataFrame([(*r, "en", "s", 5, *["x"] * 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("1", "about nothing at all")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in cp.STAGES:
            path = f"{folder}/{name}-{table is docs}"
            stage(spark, now, folder).write.parquet(path)
            now = spark.read.parquet(path)
            if name != "sentencepieces":
                assert now.columns == docs.columns
        found = now.collect()
        assert all(r.kept == r["a.b"] == "x" and r.round_trip for r in found)
        assert bool(found) == (table is docs)


def test_nothing_stays_but_the_result(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(os.listdir(shared))
    found = cp.run(spark, SF)
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-sentencepieces") and found.count() > 0
