import random

import numpy as np
import pytest

from rheolake.llm import quality as q


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        words = rng.choices("lorem ipsum dolor sit amet consetetur".split(), k=rng.randrange(5, 60))
        text = " ".join(words) if good else rng.choice([" ".join(w + "***" for w in words), " ".join(words[:1] * 40), " ".join(words).upper() + "!!"])
        source = ("blog" if good else "spam") if rng.random() < 0.8 else "any"
        rows.append((i, text, rng.choice(["en", "fr", None]), source, len(text), good))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    labels += [(1, 1, 0), (1, 0, 0), (3, None, 0), (5, 7, 0), (None, 1, 0), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, truth boolean")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_accuracy_on_unlabelled(tables):
    docs, labels = tables
    model = q.fit(docs, labels)
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    rows = [r for r in docs.collect() if r.doc_id % 2]
    assert np.mean([got[r.doc_id].accepted == r.truth for r in rows]) > 0.98
    assert all(0 <= got[r.doc_id].quality_score <= 1 for r in rows)
    meta = np.mean([(got[r.doc_id].metadata_score > 0.5) == r.truth for r in rows if r.source != "any"])
    assert meta > 0.9


def test_pool_teaches_the_other_view():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 600)
    a = (truth[:, None] + rng.normal(0, 0.1, (600, 2))).astype(np.float32)
    b = (np.eye(40)[np.where(truth == 1, rng.integers(0, 20, 600), rng.integers(20, 40, 600))]).astype(np.float32)
    label = np.where(np.arange(600) < 40, truth, -1)
    apart = np.arange(600) % 4 == 0
    alone = q.co_train([a, b], label, apart, rounds=0)
    together = q.co_train([a, b], label, apart, rounds=3)
    right = lambda m: ((m.views[1].logit(b) > 0) == truth).mean()
    assert right(together) > 0.95 > right(alone)


def test_edge_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(None, None, None, None, None, "x"), (1, "", "en", "", -5, "x"), (2, "  \n ", None, "s", 0, "x"), (3, "long word " * 50_000, "en", "blog", None, "x"), (3, "long word " * 50_000, "en", "blog", None, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, accepted string",
    )
    model = q.fit(docs, labels)
    got = q.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.quality_score <= 1 for r in got)
    assert q.score(odd.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("quality = 1"), labels.where("doc_id = 9999")):
        plain = q.fit(docs, none)
        assert all(r.accepted and r.quality_score == 1 for r in q.score(odd, plain).collect())
    assert all(r.accepted for r in q.score(odd, q.fit(docs.limit(0), labels)).collect())


def test_clashing_columns_and_repeated_ids(spark):
    names = ["accepted", "view_text", "quality_score", "row", "a.b"]
    rows = [(i % 40, "good words in a text." if i % 2 else "### !!! ###", "en", "s", 9, *["x"] * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    left = q.accepted(docs, model)
    assert left.columns == docs.columns and {r.accepted for r in left.collect()} == {"x"} and left.count() == 200
    assert q.score(docs, model, keep=tuple(docs.columns)).columns == ["doc_id", "text", "lang", "source", "n_chars", "view_text", "row", "a.b", *q.RESULTS]


def test_scores_are_those_of_plain_formulas(spark):
    """The whole chain against formulas written out again: features, logistic fits, calibration, combination."""
    rows = [(i, ("good words in a text. " * (1 + i % 5)) if i % 3 else "### !!! ###\n" * (1 + i % 4), ("en", None)[i % 2], f"s{i % 4}", i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    for r in rows:
        logits = []
        for view, calibration, x in zip(model.views, model.calibrations, q.views_of({"text": [r[1]], "lang": [r[2]], "source": [r[3]], "n_chars": [r[4]]}), strict=True):
            raw = sum(w * (float(v) - m) / s for w, v, m, s in zip(view.weights, x[0], view.mean, view.scale, strict=False)) + view.weights[-1]
            logits.append((raw - calibration.mean[0]) / calibration.scale[0] * calibration.weights[0] + calibration.weights[1])
        both = sum(w * (z - m) / s for w, z, m, s in zip(model.combination.weights, logits, model.combination.mean, model.combination.scale, strict=False)) + model.combination.weights[-1]
        for found, want in zip((got[r[0]].content_score, got[r[0]].metadata_score, got[r[0]].quality_score), (*logits, both), strict=True):
            assert abs(found - 1 / (1 + np.exp(-np.clip(want, -40, 40)))) < 1e-6
    assert all(got[i].accepted == (i % 3 > 0) for i in range(120))


def plain_logistic(x, y):
    """The minimum of the ridge loss, by a general method, on features scaled by their own mean and deviation."""
    n, mean = len(x), [sum(c) / len(x) for c in zip(*x)]
    scale = [(sum((v - m) ** 2 for v in c) / n) ** 0.5 + 1e-3 for c, m in zip(zip(*x), mean)]
    z = np.array([[*((v - m) / s for v, m, s in zip(r, mean, scale)), 1.0] for r in x])
    ridge = np.array([1.0] * len(mean) + [1e-6])
    signs, w = 2.0 * np.array(y) - 1, np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, -signs * (z @ w)).sum() + (ridge * w * w).sum() / 2
    slope = lambda w: -(z * (signs / (1 + np.exp(signs * (z @ w))))[:, None]).sum(0) + ridge * w
    inverse, g = np.eye(len(w)), slope(w)
    for _ in range(3000):  # BFGS with halved steps
        step = -inverse @ g
        size = 1.0
        while loss(w + size * step) > loss(w) + 1e-4 * size * (g @ step) and size > 1e-12:
            size /= 2
        new = w + size * step
        s, d = new - w, slope(new) - g
        if np.abs(d).max() < 1e-13 or s @ d <= 0:
            break
        r, e = 1 / (d @ s), np.eye(len(w))
        inverse = (e - r * np.outer(s, d)) @ inverse @ (e - r * np.outer(d, s)) + r * np.outer(s, s)
        w, g = new, slope(new)
    return lambda row: sum(a * (v - m) / s for a, v, m, s in zip(w, row, mean, scale)) + w[-1]


def test_co_training_against_a_plain_version():
    """Fits by another method, rounds, calibration and combination written out row by row."""
    rng = np.random.default_rng(21)
    truth = rng.integers(0, 2, 260)
    parts = [(truth[:, None] * 1.2 + rng.normal(0, 1, (260, k))).astype(np.float32) for k in (3, 2)]
    label = [int(truth[i]) if i < 90 else -1 for i in range(260)]
    apart = [i % 3 == 0 for i in range(260)]
    taught = [{i: label[i] for i in range(90) if not apart[i]} for _ in parts]
    rows = [[list(map(float, r)) for r in x] for x in parts]
    shared = 0
    for turn in range(4):
        views = [plain_logistic([x[i] for i in sorted(own)], [own[i] for i in sorted(own)]) for x, own in zip(rows, taught)]
        if turn == 3:
            break
        for teacher, pupil in ((0, 1), (1, 0)):
            for i in range(90, 260):
                p = 1 / (1 + np.exp(-views[teacher](rows[teacher][i])))
                if p >= 0.97 or p <= 0.03:
                    taught[pupil][i] = int(p >= 0.97)
                    shared += 1
    held = [i for i in range(90) if apart[i]]
    raw = [[view(r) for r in x] for view, x in zip(views, rows)]
    fits = [plain_logistic([[z[i]] for i in held], [label[i] for i in held]) for z in raw]
    both = [[fit([z[i]]) for fit, z in zip(fits, raw)] for i in range(260)]
    last = plain_logistic([both[i] for i in held], [label[i] for i in held])
    want = [*zip(*both), [last(b) for b in both]]
    got = q.co_train(parts, np.array(label), np.array(apart)).score(parts)
    assert shared > 50
    for found, logits in zip(got, want, strict=True):
        assert np.abs(found - 1 / (1 + np.exp(-np.array(logits)))).max() < 1e-4


def test_features_against_counts_by_hand():
    text = "ab ab c.\nab ab c.\nA longer line of this text that ends without a stop\n"
    words = text.split()
    raw = text.encode()
    row = q.content_features([text])[0]
    for byte in range(256):
        assert abs(row[byte] ** 2 - raw.count(bytes([byte])) / len(raw)) < 1e-6
    repeated = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    want = [np.log(1 + len(words)), (len(set(words)) / len(words)) ** 0.5, (4 / len(words)) ** 0.5, (repeated / len(words)) ** 0.5, np.log(1 + len(raw) / len(words))]
    assert words.count("ab") == 4 and repeated == 2 and np.allclose(row[256:], want, atol=1e-6)
    lengths = [8, 8, 51, 0]
    assert [len(x) for x in text.split("\n")] == lengths
    mean = sum(lengths) / 4
    layout = [np.log(5), np.log(1 + mean), np.log(1 + (sum((n - mean) ** 2 for n in lengths) / 4) ** 0.5), 3 / 4, 3 / 4, 2 / 4]
    got = q.metadata_features(["en"], [None], [len(text)], [text])[0]
    assert np.allclose(got[-6:], layout, atol=1e-6) and np.allclose(got[-9:-6], [np.log(1 + len(text)), np.log(1 + len(text)) ** 2, 0], atol=1e-5)
    assert got[:16].sum() == 1 and got[16:80].sum() == 1
