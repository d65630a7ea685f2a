import zlib

import numpy as np
import pytest

from rheolake.llm import token_files as tf
from rheolake.llm.common import shared_path

ODD = ["", "  \n ", "It's 12a b", "Ünïcode é İ ΑΣ", "x<|endoftext|>y <|startoftext|>", "a\x1cb c", "nb\u00a0sp\u2003em\u3000q", "日本語 text", "e\u0301 \u0301x", "don't won't I'LL x's't \"'s ..'d a'1", "ß É÷x Àé² ½ a_b x<|y", "ÀÉ.é,«ñ»¿Qué?", "🙂🙂 ok"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tf.vocabulary_path(tf.VOCABULARY))


def test_word_by_word_is_the_library(plain):
    encoder = tf.WordEncoder(tf.vocabulary_path(tf.VOCABULARY), memo=5)
    texts = ODD + [" ".join(ODD), " ".join(f"w{i} " for i in range(200))]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_round_trip_through_files(spark, plain):
    rows = [(i * 7 % 11, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (3, None, "x"), (3, None, "x"), (50, "long words " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = shared_path(spark, "t")
    tf.write_token_files(docs, path)
    got = tf.token_digests(spark, path).orderBy("start").collect()
    at = 0
    want = sorted((-1 if d is None else d, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(x for x, _ in want)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = plain.encode("null id", add_special_tokens=False).ids + [1]
    assert next(r for r in got if r.doc_id is None).ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(len(r.ids) for r in tf.lookup(spark, path, [50]).collect()) == [max(n for _, n in want)]


def test_empty(spark):
    path = shared_path(spark, "t")
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tf.token_digests(spark, path).count() == 0


def test_files_in_order_of_tasks_and_repeated_ids_split(spark, plain):
    import os

    rows = [(7, "same words here")] * 400 + [(None, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = shared_path(spark, "t")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tf.write_token_files(docs, path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = path.removeprefix("file://")
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    assert len(names) > 2 and max(tf.read_token_files(spark, path).groupBy("file_name").count().toPandas()["count"]) < 700
    for n in os.listdir(folder):
        if n.startswith(".") and n.endswith(".crc"):
            os.remove(f"{folder}/{n}")
    for n, new in zip(names, range(99_999, 99_999 + len(names)), strict=True):  # six digits sort before five by name
        os.rename(f"{folder}/{n}", f"{folder}/part-{new}-{n.split('-', 2)[2]}")
    got = tf.token_digests(spark, path).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None] * 400 + [7] * 400
    with pytest.raises(ValueError):
        tf.write_token_files(docs, path, "other.json")


def test_lookup_skips_rows_it_does_not_need(spark):
    docs = spark.range(20_000).selectExpr("id * 2 AS doc_id", "'some text' AS text").coalesce(1)
    path = shared_path(spark, "t")
    tf.write_token_files(docs, path)

    def scanned(doc_id):
        df = tf.lookup(spark, path, [doc_id])
        found = df.count(), df._jdf.queryExecution().executedPlan()
        df = tf.lookup(spark, path, [doc_id])
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head() if not plan.getClass().getSimpleName().startswith("Adaptive") else plan.executedPlan().collectLeaves().head()
        return found[0], len(rows), leaf.metrics().apply("numOutputRows").value()

    there, missing = scanned(10_000), scanned(10_001)
    assert there[:2] == (1, 1) and 0 < there[2] <= 2_000
    assert missing[:2] == (0, 0) and missing[2] <= 2_000
