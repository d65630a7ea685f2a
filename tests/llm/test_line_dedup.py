import random

from rheolake.llm import line_dedup as ld


def units(text):
    return [line + "\n" for line in text.split("\n")]


def near(a, b):
    if a == b:
        return True
    a, b = sorted((a.split(" "), b.split(" ")), key=len)
    if len(a) < ld.NEAR_WORDS or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """rows of (id, hash order, text) in order; the texts that are left."""
    seen, out = [], {}
    for key, text in rows:
        if text is None or key in out:
            out.setdefault(key, text)
            continue
        kept = []
        for unit in units(text):
            norm = unit.strip(" \t\r\n")
            if len(norm) < ld.MIN_CHARS:
                kept.append(unit)
                continue
            if not any(near(norm, x) for x in seen):
                kept.append(unit)
            seen.append(norm)
        whole = "".join(kept)
        out[key] = whole[:-1] if whole.endswith("\n") else whole
    return out


def sample():
    rng = random.Random(11)
    base = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta é".split(), k=k)) for k in (3, 4, 8, 9, 10, 10, 11, 12, 20, 40) for _ in range(2)]
    texts = [None, "", "\n\n", "short", "  \n short \n", "word " * 3000 + "\n" + "word " * 3000 + "tail"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                i, kind = rng.randrange(len(words)), rng.randrange(3)
                if kind == 0:
                    words[i] = f"w{rng.randrange(4)}"
                elif kind == 1:
                    words.insert(i, f"w{rng.randrange(4)}")
                elif len(words) > 1:
                    del words[i]
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(words) + rng.choice(["", "  ", "\r"]))
        texts.append("\n".join(lines))
    return texts


def test_against_brute_force(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, line_hash string")
    docs = docs.unionByName(docs.where("doc_id in (7, 20)")).repartition(3)
    got = ld.dedup_lines(docs).collect()
    assert all(r.line_hash == "x" for r in got)
    want = brute(list(enumerate(texts)))
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.text == want[r.doc_id], (r.doc_id, texts[r.doc_id])
        assert r.n_chars == len(r.text or "")
        assert r.n_units == (0 if texts[r.doc_id] is None else len(units(texts[r.doc_id])))
    assert sum(r.n_dropped for r in got) > 40


def test_null_ids_and_empty_table(spark):
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, line), (1, line), (2, line.replace("two", "2"))], "doc_id long, text string")
    assert {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()} == {None: line, 1: "", 2: ""}
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_word_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = rng.choices("xyz", k=rng.randrange(1, 6))
        rows.append((a, rng.choices("xyz", k=rng.randrange(1, 6)) if rng.random() < 0.6 else a[: rng.randrange(len(a))] + ["x"] + a[rng.randrange(len(a)) :]))
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", ld.within_one_word(F.col("a"), F.col("b")).alias("r")).collect()

    def true(a, b):
        a, b = sorted((a, b), key=len)
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert all(r.r == true(r.a, r.b) for r in got)


def test_long_lines_are_whole_units(spark):
    rng = random.Random(4)
    long = [str(rng.randrange(10**6)) for _ in range(9_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:4000] + ["x"] + long[4000:])), (3, " ".join(long[:-2])), (4, " ".join(long[1:])), (5, " ".join(long[:70])), (6, " ".join(long[:64] + long[65:70]))]
    got = {r.doc_id: r.n_dropped for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1}


def test_short_lines_and_emptied_documents(spark):
    docs = spark.createDataFrame([(1, "Les.\nan own line"), (2, "Les.\n\nLes."), (3, "Les.\nnew"), (4, ""), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in ld.drop_repeated(docs).collect()} == {1: "Les.\nan own line", 3: "new", 4: "", 5: None}
    spared = ld.dedup_lines(docs, min_chars=16).collect()
    assert all(r.n_dropped == 0 for r in spared)


def test_clashing_columns(spark):
    names = ["n_units", "n_dropped", "line_hash", "kept", "k_id", "row", "units", "line_text", "text_hash", "a.b"]
    docs = spark.createDataFrame([(1, "same", *["x"] * 10), (2, "same", *["x"] * 10)], ["doc_id", "text", *names])
    got = ld.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *names[2:], "n_units", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.kept, r.n_dropped) for r in got.collect()) == [(1, "same", "x", 0), (2, "", "x", 1)]
    left = ld.drop_repeated(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "same", *["x"] * 10)]
