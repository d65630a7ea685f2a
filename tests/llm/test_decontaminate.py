import pickle
import random
import re
import time
import tracemalloc

import numpy as np

from rheolake.llm import decontaminate as d


def brute(texts, items, width=d.WIDTH):
    out = []
    for text in texts:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hit, found = set(), set()
        for item, item_text in items:
            own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), item_text or ""))
            size = min(width, len(own))
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1 if own else 0):
                if tuple(words[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found.add(item)
        out.append((len(words), len(hit), sorted(found)))
    return out


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    for n, symbols in ((1, 1), (40, 2), (700, 3), (900, 70)):
        text = rng.integers(0, symbols + 1, n)
        text[-1] = 0
        index = d.FMIndex(text, symbols)
        for size in (1, 2, 3, 5):
            rows = rng.integers(1, symbols + 1, (50, size))
            which, low, high = index.search(rows.ravel(), np.arange(len(rows)) * size, size)
            at = {int(w): sorted(index.locate(np.arange(lo, hi)).tolist()) for w, lo, hi in zip(which, low, high, strict=True)}
            for k, row in enumerate(rows):
                want = [i for i in range(n - size + 1) if (text[i : i + size] == row).all()]
                assert at.get(k, []) == want


def sample():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "日本"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(25)]
    items += [("7", "Repeated id, other TEXT"), ("99", None), ("98", "!!!"), ("3", items[3][1])]
    texts = [None, "", "...", "lonely words only"]
    for _ in range(60):
        parts = rng.choices(vocabulary, k=rng.randrange(60))
        if rng.random() < 0.6:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = (rng.choice(items)[1] or "").upper().split()
        texts.append(", ".join(parts))
    return texts + texts[-5:] + ["w1 " * 30_000], items


def test_against_brute_force(spark):
    texts, items = sample()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int").repartition(3)
    items_df = spark.createDataFrame(items, "item_id string, text string")
    want = brute(texts, items)
    for options in ({}, {"shard_bytes": 600}, {"block_bytes": 150}, {"block_bytes": 150, "piece_words": 4}):
        got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids)) for r in d.find_leaks(docs, items_df, **options).collect()}
        assert [got[i] for i in range(len(texts))] == want, options


def test_removal(spark):
    texts, items = sample()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    items_df = spark.createDataFrame(items, "item_id string, text string")
    cleaned = d.remove_leaks(docs, items_df)
    assert cleaned.columns == docs.columns
    assert d.find_leaks(cleaned, items_df).where("n_hit > 0").count() == 0
    got = {r.doc_id: r.text for r in cleaned.collect()}
    for i, (n_words, n_hit, _) in enumerate(brute(texts, items)):
        if not n_hit:
            assert got[i] == texts[i]
        elif n_hit == n_words:
            assert i not in got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in d.find_leaks(docs, none).collect()] == [0]
    assert d.find_leaks(docs.limit(0), none).count() == 0


def test_blocks_change_nothing(spark):
    phrase = "a b c d e f g h i j"
    filler = [(f"f{i}", " ".join(f"{i}x{k}" for k in range(12))) for i in range(40)]
    items = spark.createDataFrame([("1", phrase), ("2", "tail of two joined phrases that meet after a cut only"), *filler], "item_id string, text string")
    rows = [(1, f"a b c d e {phrase} f g h i j tail words"), (2, f"tail of two joined {phrase} phrases that meet after a cut only end"), (3, "0x0 " + filler[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (60, 300, 1000, 1 << 20):
        got = {r.doc_id: " ".join(r.text.split()) for r in d.remove_leaks(docs, items, block_bytes=block_bytes).collect()}
        assert got == {1: "tail words", 2: "end", 3: "0x0"}, block_bytes


def test_clashing_columns(spark):
    names = ["n_words", "n_hit", "item_ids", "spans", "clean_text", "leak_text", "row", "a.b"]
    docs = spark.createDataFrame([(1, "a b c", *["x"] * 8), (2, "z a b c", *["x"] * 8)], ["doc_id", "text", *names])
    items = spark.createDataFrame([("1", "a b c")], "item_id string, text string")
    got = d.remove_leaks(docs, items)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "z ", *["x"] * 8)]
    assert d.find_leaks(docs, items, keep=tuple(docs.columns)).columns == ["doc_id", "text", *names[4:], *names[:4]]


def test_phrases_of_a_whole_block():
    """As many random words as a block holds: each window is there once, with its owners, and little memory is taken."""
    rng = np.random.default_rng(8)
    letters = np.frombuffer(rng.integers(97, 123, 6 * 2_400_000, np.uint8).tobytes(), "S6").tolist()
    items = [(str(k), b" ".join(letters[k * 60_000 : (k + 1) * 60_000]).decode()) for k in range(40)]
    items += [("again", items[3][1][:7000]), (None, items[5][1][:700]), ("short", items[0][1][:20])]
    assert sum(len(t) for _, t in items) > d.BLOCK_BYTES
    tracemalloc.start()
    began = time.process_time()
    found = d.Phrases(items)
    seconds, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(f"{seconds:.1f} s, {most / 1e6:.0f} MB, pickled {len(pickle.dumps(found)) / 1e6:.0f} MB")
    assert most < 500e6
    (n, starts, first, owners), (width, starts_10, first_10, owners_10) = found.groups
    assert (n, len(starts), [found.item_ids[i] for i in owners]) == (3, 1, ["short"]) and width == d.WIDTH
    want = {}
    words = [(item, d.words_of(text)) for item, text in items]
    for item, own in words:
        for i in range(0, len(own) - d.WIDTH + 1, 1 if item in ("3", "again", None) else 997):
            want.setdefault(tuple(own[i : i + d.WIDTH]), set()).update({item} - {None})
    vocabulary = found.vocabulary.to_pylist()
    place = {w: i + 1 for i, w in enumerate(vocabulary)}
    assert len(place) == len(vocabulary) == len({w for _, own in words for w in own})
    number = {found.ids[s : s + d.WIDTH].tobytes(): k for k, s in enumerate(starts_10.tolist())}
    assert len(number) == len(starts_10)
    for window, owner in want.items():
        k = number[np.array([place[w] for w in window], np.int32).tobytes()]
        assert owner <= {found.item_ids[i] for i in owners_10[first_10[k] : first_10[k + 1]]}
    assert found.ids[starts_10[0]] and first_10[-1] == len(owners_10)
