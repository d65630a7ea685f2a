import random
import tracemalloc

import numpy as np
import pytest

from rheolake.llm import langid as li


def brute_phrases(text, sample):
    """Longest-match phrases of text against all substrings of sample (tuples of numbers)."""
    n, at = 0, 0
    joined = "".join(chr(65 + c) for c in sample)
    whole = "".join(chr(65 + c) for c in text)
    while at < len(whole):
        size = 1
        while at + size < len(whole) and whole[at : at + size + 1] in joined:
            size += 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("block", [1, 3, 50, 4096])
def test_phrases_are_longest_matches_of_whole_texts(monkeypatch, block):
    rng = random.Random(4)
    monkeypatch.setattr(li, "BLOCK", block)
    monkeypatch.setattr(li, "LANES", 7)
    samples = {k: "".join(rng.choices("ab c"[: 2 + i], k=60 + i)) for i, k in enumerate(("x", "y", "z"))}
    samples["z"] += "abcabcabd" * 9  # long phrases that cross many blocks
    model = li.Model({k: [t] for k, t in samples.items()})
    texts = ["".join(rng.choices("abcé", k=rng.randrange(1, 170))) for _ in range(40)] + ["abcabcabd" * 15, "é", "a" * 400]
    codes = [model.alphabet.encode(t) for t in texts]
    got = model.phrases(codes)
    for i, c in enumerate(codes):
        for j, name in enumerate(model.names):
            assert got[i, j] == brute_phrases(c.tolist(), model.alphabet.encode(samples[name]).tolist())


def test_alphabet():
    alphabet = li.Alphabet(["a", "é", "𝒳"])
    assert alphabet.encode("Aé, \n a1b😀𝒳!𝒴").tolist() == [2, 3, 0, 2, 0, 1, 0, 4, 0, 1]
    assert not li.has_letter(alphabet.encode("12 _ …"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = {"aa": ["lorem", "ipsumo", "dolore"], "bb": ["zukunft", "wachs", "krx"], "ü": ["éàé", "êtrè", "çaç"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randrange(3, 60))), lang if i % 7 else None, lang))
    rows += [(200, None, "aa", "und"), (201, "123 !!", "bb", "und"), (202, "lorem " * 20_000, None, "aa"), (202, "lorem " * 20_000, None, "aa"), (None, "krx", None, "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy(docs):
    model = li.fit(docs.where(~li.is_held_out(docs.doc_id)))
    got = {r.doc_id: r for r in li.predict(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id].lang_pred == r.truth
        assert 0 <= got[r.doc_id].score <= 1


def test_nothing_to_learn_or_to_say(docs):
    none = li.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in li.predict(docs, none).collect()} == {"und"}
    one = li.fit(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in li.predict(docs, one).collect()} == {"und", "aa"}
    assert li.predict(docs.limit(0), one).count() == 0


def test_automaton_size():
    ways = li.suffix_automaton([0, 1, 0, 0, 1])
    assert len(ways) <= 10
    assert ways[0][0] > 0 and ways[0][1] > 0


def test_parser_has_the_automatons_ways():
    rng = random.Random(3)
    text = [rng.randrange(9) for _ in range(500)]
    ways, parser = li.suffix_automaton(text), li.Parser(text, 9)
    for state in range(1, len(ways)):
        to, starts = parser.step(np.full(9, state, np.int32), np.arange(9, dtype=np.int32))
        assert [None if s else int(t) for t, s in zip(to, starts, strict=True)] == [ways[state].get(c) for c in range(9)]


def test_scripts_beyond_the_alphabet(spark):
    """Seven scripts, one word length: rare ones are told apart by their letters."""
    rng = random.Random(6)
    first = {"latin": 0x61, "cyrillic": 0x430, "greek": 0x3B1, "thai": 0xE01, "chinese": 0x4E00, "korean": 0xAC00, "math": 0x1D4D0}
    size = {"latin": 26, "cyrillic": 32, "chinese": 800, "korean": 800}
    rows = []
    for lang, at in first.items():
        words = ["".join(chr(at + rng.randrange(size.get(lang, 16))) for _ in range(4)) for _ in range(60)]
        for k in range(160 if lang in ("latin", "cyrillic") else 25):
            rows.append((len(rows), " ".join(rng.choices(words, k=30)), lang if k % 5 else None, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    got = {r.doc_id: r.lang_pred for r in li.predict(docs, li.fit(docs)).collect()}
    assert [got[r[0]] for r in rows] == [r[3] for r in rows]


def test_three_hundred_languages(spark):
    rng = random.Random(8)
    names = [f"l{i:03d}" for i in range(300)]
    words = {n: ["".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(12)] for n in names}
    rows = [(k * 300 + i, " ".join(rng.choices(words[n], k=15)), n) for i, n in enumerate(names) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = li.fit(docs)
    assert sorted(texts) == names
    got = {r.doc_id: r.lang_pred for r in li.predict(docs, texts).collect()}
    assert [got[r[0]] for r in rows] == [r[2] for r in rows]


def test_ties_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(li, "SAMPLE_CHARS", 100)
    monkeypatch.setattr(li, "SAMPLE_DOC_CHARS", 40)
    same = [(7, "one text for both", "b"), (7, "one text for both", "a")] + [(7, "one text for both", "a")] * 50
    long = [(8, "wx yz " * 50, "long"), (9, "wx yz " * 40, "long"), (None, "qqq", "nobody")]
    many = [(100 + i, f"{'kl mn op'} {i}", "many") for i in range(90)]
    docs = spark.createDataFrame(same + long + many, "doc_id long, text string, lang string").repartition(5)
    texts = li.fit(docs)
    assert texts["a"] == texts["b"] == ["one text for both"]
    assert texts["long"] == ["wx yz " * 40]  # the shortest, whole
    assert len(texts["many"]) == 5 and "nobody" not in texts
    got = {(r.doc_id, r.lang_pred) for r in li.predict(docs, texts).collect()}
    assert (7, "a") in got and (7, "b") not in got and (8, "long") in got


def test_memory_does_not_grow_with_languages_nor_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    codes, most = None, []
    for languages in (4, 80):
        model = li.Model({f"l{k:02}": [letters(200)] for k in range(languages)})
        codes = [model.alphabet.encode(letters(300_000))]
        tracemalloc.start()
        model.phrases(codes)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 1.2 * most[0]
    monkeypatch.setattr(li, "SAMPLE_TEXT_CHARS", 500)
    docs = spark.createDataFrame([(1, letters(400), "a"), (2, letters(501), "a"), (3, letters(500), "b"), (4, letters(900), "c")], "doc_id long, text string, lang string")
    texts = li.fit(docs)
    assert {lang: [len(t) for t in own] for lang, own in texts.items()} == {"a": [400], "b": [500]}
    assert {r.lang_pred for r in li.predict(docs, texts).collect()} <= {"a", "b"}
