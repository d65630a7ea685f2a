"""Quality classifier by co-training.

Two views of a document: its content (byte frequencies and how much its words repeat, over the whole text) and its
page's metadata (language, source, length, and the layout: how many lines, how long, how often repeated, how they end).  Each view has a logistic classifier.  In every round both score a pool of
unlabelled documents, and what one is sure of becomes labelled for the other.  On labelled documents kept apart each
view is calibrated (Platt), and a logistic combination of the calibrated views scores all documents.

Fitting takes at most ``MAX_LABELLED`` labelled and ``MAX_POOL`` unlabelled documents, those of the smallest hashed ids;
scoring is one narrow pass over all documents.

Defined cases: null or empty texts have no bytes or words and are scored like others; null metadata is a value of its
own; rows with null ids are scored but teach nothing; labels other than 0 and 1 and ids labelled both ways teach
nothing; without labels of both kinds every score is the share of good labels (1 without any), and all are kept;
repeated rows are scored alike, and of rows of one id one teaches (the one of the smallest text hash); texts of any length
are measured whole; an empty table gives an empty result; kept columns pass whatever their names, and only one with the
name of a result gives way to it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rheolake.llm.common import bound_batches, packed, share, table, unpacked

MAX_LABELLED = 20_000
MAX_POOL = 10_000
ROUNDS = 3
#: A view is sure of a document at this probability of either class.
SURE = 0.97
RIDGE = 1.0
THRESHOLD = 0.5
_LANGS, _SOURCES = 16, 64
_EXTRA = 5
_LAYOUT = 6
RESULTS = ("content_score", "metadata_score", "quality_score", "accepted")


VIEWED = ("text", "lang", "source", "n_chars")


def content_features(texts: list[str | None]) -> np.ndarray:
    """Square roots of byte frequencies; then the log of the words, and shares of distinct, commonest and repeated words."""
    out = np.zeros((len(texts), 256 + _EXTRA), np.float32)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if not raw:
            continue
        out[i, :256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
        words = raw.split()
        if not words:
            continue
        counts = Counter(words)
        n = len(words)
        out[i, 256:] = (
            np.log1p(n),
            np.sqrt(len(counts) / n),
            np.sqrt(max(counts.values()) / n),
            np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n),
            np.log1p(len(raw) / n),
        )
    return out


def metadata_features(langs: list, sources: list, sizes: list, texts: list[str | None]) -> np.ndarray:
    """Language and source as places of a hashed list; length, its square, whether it is missing; the layout of the lines."""
    base = _LANGS + _SOURCES
    out = np.zeros((len(langs), base + 3 + _LAYOUT), np.float32)
    rows = np.arange(len(langs))
    place = lambda xs, n: np.array([zlib.crc32(repr(x).encode()) % n for x in xs], np.int64)
    out[rows, place(langs, _LANGS)] = 1
    out[rows, _LANGS + place(sources, _SOURCES)] = 1
    size = np.log1p(np.array([max(x or 0, 0) for x in sizes], np.float64))
    out[:, base], out[:, base + 1], out[:, base + 2] = size, size**2, [x is None for x in sizes]
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        out[i, base + 3 :] = (
            np.log1p(len(lines)),
            np.log1p(length.mean()),
            np.log1p(length.std()),
            len(set(lines)) / len(lines),
            np.mean(length < 30),
            sum(x.endswith((".", "!", "?")) for x in lines) / len(lines),
        )
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    ridge: float = RIDGE
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = self._prepared(x)
        self.weights = np.zeros(z.shape[1])
        penalty = np.r_[np.full(z.shape[1] - 1, self.ridge), 1e-6]
        for _ in range(25):
            p = expit(z @ self.weights)
            slope = z.T @ (p - y) + penalty * self.weights
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), slope)
            self.weights -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._prepared(x.astype(np.float64)) @ self.weights


def expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class CoTrained:
    """Both views, their calibrations and the combination.  Without views the score is ``prior``."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combination: Logistic | None
    prior: float

    def score(self, parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Probability of good quality by content, by metadata, and combined."""
        if self.combination is None:
            return (np.full(len(parts[0]), self.prior),) * 3
        calibrated = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, parts, strict=True)]
        return (*map(expit, calibrated), expit(self.combination.logit(np.stack(calibrated, 1))))


def co_train(parts: list[np.ndarray], label: np.ndarray, apart: np.ndarray, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """parts: features by view; label: 1, 0 or -1 (the pool); apart: rows kept for calibration."""
    known, pool = (label >= 0) & ~apart, np.flatnonzero(label < 0)
    held = (label >= 0) & apart
    good = float((label == 1).sum() / max(1, (label >= 0).sum())) if (label >= 0).any() else 1.0
    if len(set(label[known])) < 2:
        return CoTrained([], [], None, good)
    own = [np.where(known, label, -1) for _ in parts]  # what each view learns from
    views: list[Logistic] = []
    for turn in range(rounds + 1):
        views = [Logistic().fit(x[y >= 0], y[y >= 0]) for x, y in zip(parts, own, strict=True)]
        if turn == rounds or not len(pool):
            break
        for teacher, pupil in ((0, 1), (1, 0)):
            p = expit(views[teacher].logit(parts[teacher][pool]))
            own[pupil][pool[p >= sure]] = 1
            own[pupil][pool[p <= 1 - sure]] = 0
    if len(set(label[held])) < 2:
        held = label >= 0
    logits = [v.logit(x[held])[:, None] for v, x in zip(views, parts, strict=True)]
    calibrations = [Logistic().fit(z, label[held]) for z in logits]
    calibrated = np.stack([c.logit(z) for c, z in zip(calibrations, logits, strict=True)], 1)
    return CoTrained(views, calibrations, Logistic().fit(calibrated, label[held]), good)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> CoTrained:
    """Learn from docs(doc_id, text, lang, source, n_chars) and labels(doc_id, quality)."""
    order = F.xxhash64("doc_id")
    clear = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    taught = clear.where("lo = hi").select("doc_id", F.col("lo").cast("int").alias("label")).orderBy(order, "doc_id").limit(max_labelled)
    pool = docs.where("doc_id IS NOT NULL").select("doc_id", F.lit(-1).alias("label")).orderBy(order, "doc_id").limit(max_pool)
    # both lists are bounded by parameters, so they are broadcast
    chosen = taught.unionByName(pool).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = bound_batches(docs).select("doc_id", *VIEWED).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by(F.struct(*VIEWED), F.xxhash64("text")).alias("d")).select("doc_id", "label", "d.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                parts = views_of(batch.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(x.tobytes() for x in part) if len(part) else pa.array([], pa.binary()) for part in parts)],
                    ["doc_id", "label", "content", "metadata"],
                )

    found = rows.mapInArrow(features, "doc_id long, label int, content binary, metadata binary").toArrow().sort_by([("doc_id", "ascending")])
    if not found.num_rows:
        return CoTrained([], [], None, 1.0)
    matrix = lambda name: np.frombuffer(b"".join(found[name].to_pylist()), np.float32).reshape(found.num_rows, -1)
    apart = np.array([zlib.crc32(str(x).encode()) % 4 == 0 for x in found["doc_id"].to_pylist()])
    return co_train([matrix("content"), matrix("metadata")], found["label"].to_numpy(), apart)


def views_of(columns: dict) -> list[np.ndarray]:
    return [content_features(columns["text"]), metadata_features(*(columns[c] for c in ("lang", "source", "n_chars", "text")))]


def judge(docs: DataFrame, model: CoTrained, keep: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """row (the kept columns) and the results of every row."""
    shared = share(docs.sparkSession, model)
    rows = bound_batches(docs).select(packed(keep).alias("row"), *VIEWED)
    schema = StructType([rows.schema["row"], *StructType.fromDDL("content_score double, metadata_score double, quality_score double, accepted boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                found = own.score(views_of({c: batch.column(i + 1).to_pylist() for i, c in enumerate(VIEWED)}))
                accepted = (found[2] >= threshold) | (own.combination is None)
                columns = [batch.column(0), *(pa.array(x, pa.float64()) for x in found), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["row", *RESULTS])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: CoTrained, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of every row and content_score, metadata_score, quality_score, accepted."""
    return unpacked(judge(docs, model, keep, threshold), "row", keep, RESULTS)


def accepted(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts."""
    columns = docs.columns
    return unpacked(judge(docs, model, tuple(columns), threshold).where("accepted"), "row", columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
