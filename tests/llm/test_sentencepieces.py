import itertools
import random

import numpy as np
import pytest

from rheolake.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(sp.model_path(sp.MODEL))


def every_segmentation(pieces, text):
    """All segmentations (score, ids) of a short normalized text."""
    if not text:
        return [(0.0, [])]
    out = []
    for k in range(1, len(text) + 1):
        found = pieces.by_text.get(text[:k])
        if found or k == 1:
            own, ids = (found[1], [found[0]]) if found else (pieces.unknown_score, pieces._unknown(text[0]))
            out += [(own + s, ids + x) for s, x in every_segmentation(pieces, text[k:])]
    return out


def apply(ids, changes):
    out, at = [], 0
    for a, b, x in changes:
        out += list(ids[at:a]) + x
        at = b
    return out + list(ids[at:])


TEXTS = [None, "", " ", "a", "the cat", "  two  gaps ", "x\ny\n\nz", "naïve 日本🙂", "▁mark", "a b c d e", "ing\tion", "word.\nÉtoile"]


@pytest.mark.parametrize("short", [24, 2])
def test_n_best_against_all_segmentations(pieces, monkeypatch, short):
    monkeypatch.setattr(sp, "SHORT", short)
    pieces.forget()
    for text, (ids, score, best) in zip(TEXTS, pieces.encode(TEXTS, 5), strict=True):
        every = sorted(every_segmentation(pieces, pieces.normalize(text or "")), key=lambda x: -x[0])
        assert [s for s, _ in best] == [s for s, _ in every[:5]]
        known = {(s, tuple(x)) for s, x in every}
        got = [(s, tuple(apply(ids.tolist(), cs))) for s, cs in best]
        assert set(got) <= known and len(set(got)) == len(got)
        assert score == every[0][0] and tuple(ids.tolist()) == got[0][1]
        decoded = pieces.decode(ids.tolist())
        assert decoded == (text or "").replace(sp.MARK, " ")
        assert all(pieces.decode(apply(ids.tolist(), cs)) == decoded for _, cs in best)


def test_a_star_equals_viterbi_choice(pieces):
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choices("aeinrstéx日", k=rng.randrange(1, 14))) for _ in range(300)]
    score, loss, count, ids = [], [], [], []
    for w in words:
        s, l, c, i = pieces._solve([w], len(w))
        best = pieces.search(w, 2)
        assert s[0] == best[0][0] and i.tolist() == best[0][1]
        assert l[0] == best[0][0] - best[1][0] if len(best) > 1 else np.isinf(l[0])


def unigram(path, to):
    """The same vocabulary with the library's unigram search: trainer_spec.model_type (field 2, then 3) set to 1."""

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if not b[i - 1] & 128:
                return n, i

    raw = bytearray(open(path, "rb").read())
    i = 0
    while i < len(raw):
        tag, i = varint(raw, i)
        size, i = varint(raw, i)
        if tag >> 3 == 2:
            j = i
            while j < i + size:
                inner, j = varint(raw, j)
                if inner == 3 << 3:
                    assert raw[j] == 2
                    raw[j] = 1
                    break
                if inner & 7 == 2:
                    n, j = varint(raw, j)
                    j += n
                elif inner & 7 == 5:
                    j += 4
                else:
                    _, j = varint(raw, j)
        i += size
    open(to, "wb").write(raw)


def test_against_the_library(pieces, tmp_path):
    import sentencepiece

    unigram(sp.model_path(sp.MODEL), tmp_path / "u.model")
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["the cat sat", "whichever words are taken", "élan vital", "Of this and that, nothing remains."]
    for text, (ids, score, best) in zip(texts, pieces.encode(texts, 6), strict=True):
        wanted = library.nbest_encode_as_ids(text, 6)
        value = lambda x: sum(library.get_score(i) for i in x)
        assert [s for s, _ in best] == [value(x) for x in wanted]
        assert library.decode(ids.tolist()) == text == pieces.decode(ids.tolist())


def test_tables(spark, pieces):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (50, "long text here " * 20_000, "x"), (50, "long text here " * 20_000, "x"), (51, "y" * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = sp.encode_documents(docs, keep=("doc_id", "text"))
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.round_trip == (sp.MARK not in (r.text or ""))
        assert len(r.n_best) == len({tuple(apply(r.ids, [(c.start, c.stop, c.ids) for c in b.changes])) for b in r.n_best})
    back = {r.doc_id: r.text for r in sp.decode_documents(encoded).collect()}
    assert all(back[i] == (t or "").replace(sp.MARK, " ") for i, t, _ in rows)
    assert sp.encode_documents(docs.limit(0)).count() == 0
    assert list(itertools.chain(*[r.ids for r in got if r.doc_id == 0])) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", *["x"] * 6)], ["doc_id", "text", "ids", "score", "n_best", "piece_text", "row", "a.b"])
    got = sp.encode_documents(docs, keep=tuple(docs.columns))
    assert got.columns == ["doc_id", "text", "piece_text", "row", "a.b", *sp.RESULTS]
    assert got.first().round_trip
    back = sp.decode_documents(got, keep=("doc_id", "text", "piece_text")).first()
    assert tuple(back) == (1, "x", "some text")
