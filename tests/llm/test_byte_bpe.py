import hashlib
import random

import numpy as np
import pytest
import tiktoken

from rheolake.llm import byte_bpe as bpe
from rheolake.llm.common import table
from rheolake.llm.token_files import vocabulary_path

SIGNS = [" ", " ", "  ", "\n", "\n\n", "\t", "a", "b", "the", "'s", "'S", "é", "1", "23", "!", "...", " ", " ", "\x1c", "\u0085", "中", "😀", " the"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    ranks = bpe.read_ranks(vocabulary_path(request.param))
    library = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=ranks, special_tokens={})
    return bpe.ByteEncoder(ranks, bpe.pattern()), library


def wanted(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_random_texts_as_the_library(pair):
    own, library = pair
    draw = random.Random(5)
    texts = ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(60))) for _ in range(4000)]
    found = own.encode(texts)
    assert found == [wanted(library, t) for t in texts]
    assert [own.decode(x) for x in found] == [t.encode() for t in texts]


def test_every_letter_as_the_library(pair):
    own, library = pair
    texts = ["a" + chr(c) + "1 " + chr(c) + chr(c) + "!" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert own.encode(texts) == [wanted(library, t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 200_000, "abcab" * 40_000, "é中" * 30_000, " " * 50_000 + "x", "\n" * 30_000, "0123456789" * 10_000])
def test_long_pre_tokens(pair, text):
    own, library = pair
    assert own.encode([text])[0] == wanted(library, text)


def test_packed_arrays_give_the_same(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(bpe, "LISTED", 10)
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    assert own.encode([text])[0] == wanted(library, text)


def test_small_memory(pair):
    _, library = pair
    ranks = library._mergeable_ranks
    own = bpe.ByteEncoder(ranks, bpe.pattern(), memo=50)
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choice("abcde") for _ in range(6)) for _ in range(300)) for _ in range(5)]
    assert own.encode(texts) == [wanted(library, t) for t in texts]


def test_smaller_rank_that_comes_up_goes_first():
    """A merge that makes a pair of smaller rank: the rest of its bucket must wait."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abx": 256, b"ab": 257, b"xa": 258, b"abab": 259}
    library = tiktoken.Encoding("odd", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteEncoder(ranks, r"[^ ]+| ")
    draw = random.Random(9)
    for _ in range(500):
        text = "".join(draw.choice("abx") for _ in range(draw.randrange(1, 25)))
        assert own.encode([text])[0] == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_queue_holds_ranks_in_order():
    queue, draw = bpe.RankQueue(50_000), random.Random(4)
    pushed = sorted((draw.randrange(50_000), i) for i in range(3000))
    for rank, i in draw.sample(pushed, len(pushed)):
        queue.push(rank, i)
    found = []
    while (rank := queue.first()) >= 0:
        found += [(rank, i) for i in queue.pop(rank)]
    assert found == pushed and not any(map(any, queue.levels))


def test_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    library = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.read_ranks(vocabulary_path(bpe.VOCABULARY)), special_tokens={})
    want = {}
    for r in docs.collect():
        ids = wanted(library, r.text or "")
        want[r.doc_id] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    found = bpe.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want


def test_nulls_repeats_extra_columns_and_round_trip(spark):
    rows = [(1, None, 3, None), (None, "a b", 3, None), (1, "a b", 3, None), (1, "a b", 3, None), (2, "", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    found = bpe.with_text(bpe.with_ids(docs)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in found), key=key) == sorted(((d, (t or "").encode()) for d, t, *_ in rows), key=key)
    assert bpe.digests(docs.where("false")).count() == 0
    empty = [r for r in bpe.digests(docs).collect() if r.doc_id == 2]
    assert [(r.n_tokens, r.ids_sha256) for r in empty] == [(0, hashlib.sha256(b"").hexdigest())]
