"""Token-id files: documents are encoded once and kept as ORC.

ORC stores the ids with integer run-length encoding in stripes; row indexes and a Bloom filter on the document id let
readers skip stripes, and a file is read by several tasks, one per stripe range.  Rows lie in ascending order of
(document id, text hash); a row knows how many ids of its own file lie before it, so the global offset of a document is
that number plus the totals of the files before, which needs no pass over the ids.

Defined cases: a null text is empty and a document without ids still gets the end id; null document ids come first;
repeated document ids lie next to each other in the order of their text hash; other columns of the input are not
looked at; texts of any length are encoded whole; an empty table gives an empty result.  Rows equal in id and text are
alike, so they may be split among files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rheolake.llm.common import bound_batches, per_worker, shared_path, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words and parts of words that one Python worker remembers at most, twice over: a full memory becomes the old one.
MEMO = 550_000
FILE_SCHEMA = "doc_id long, in_file long, n_tokens long, ids array<int>"
WRITE_OPTIONS = {
    "compression": "none",  # run-length encoded ids hardly shrink further
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}
#: Python's split() also cuts at these, which the vocabulary's own pattern takes for symbols.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: Words of these characters are lower-cased and cut alike here and in the library (its pattern on plain letters).
PLAIN = re.compile("[!-~\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PLAIN_LINES = re.compile(PLAIN.pattern.replace("[", "[\n"))
PART = re.compile("\n|'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """A dictionary of two generations; what is used again outlives the older one."""

    def __init__(self, size: int):
        self.size = size
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of the keys that neither generation has; all others are in ``now`` afterwards."""
        new = keys.difference(self.now)
        if len(self.now) + len(new) > self.size:
            self.old, self.now, new = self.now, {}, keys
        again = {k for k in new if k in self.old}
        self.now.update((k, self.old[k]) for k in again)
        return list(new.difference(again))

    def learn(self, keys: list[str], values: list[bytes]) -> None:
        self.now.update(zip(keys, values, strict=True))

    def find(self, key: str) -> bytes:
        found = self.now.get(key)
        return self.old[key] if found is None else found


class WordEncoder:
    """The library's ids of a text, word by word.

    The vocabulary drops white space and no token spans it, so the ids of a text are those of its words, and those of a
    plain word are the ones of its parts (runs of letters, single digits, runs of symbols).  What is not remembered
    goes to the library: plain letters to its model, other parts many in a line, where the tokens that end a word tell
    them apart; odd words are told apart by the library's ``word_ids``.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(memo)
        self.tokenize = self.tokenizer.model.tokenize
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ask(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            out += _cut(np.array(found.ids, "<u4"), np.searchsorted(np.array(found.word_ids), np.arange(1, len(part) + 1)))
        return out

    def ask_parts(self, parts: list[str]) -> list[bytes]:
        """ASCII letters need no normalizing and are byte-level symbols as they are: they go to the model itself."""
        plain = [p for p in parts if p.isascii() and p.isalpha()]
        rest = list(set(parts).difference(plain))
        known: dict[str, bytes] = {}
        if plain:
            found = [[t.id for t in self.tokenize(p)] for p in plain]
            ids = np.array(list(chain.from_iterable(found)), "<u4")
            known.update(zip(plain, _cut(ids, np.cumsum([len(x) for x in found])), strict=True))
        if rest:
            lines = [" ".join(rest[k : k + 200]) for k in range(0, len(rest), 200)]
            ids = np.array([i for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in x.ids], "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            known.update(zip(rest, _cut(ids, stops) if len(stops) == len(rest) else self.ask(rest), strict=True))
        return [known[p] for p in parts]

    def learn(self, words: list[str]) -> None:
        joined = "\n".join(words)
        if "<|" in joined or not PLAIN_LINES.fullmatch(joined):
            odd = [w for w in words if "<|" in w or not PLAIN.fullmatch(w)]
            self.memory.learn(odd, self.ask(odd))
            words = list(set(words).difference(odd))
            joined = "\n".join(words)
        parts = PART.findall(joined.lower() + "\n")
        new = self.memory.missing(set(parts).difference("\n"))
        self.memory.learn(new, self.ask_parts(new))
        now = self.memory.now
        now["\n"] = b"\n"
        ids = list(map(now.__getitem__, parts))
        del now["\n"]
        at = 0
        for word in words:
            stop = ids.index(b"\n", at)
            now[word] = ids[at] if stop == at + 1 else b"".join(ids[at:stop])
            at = stop + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        for k in range(0, len(texts), 64):
            part = [t or "" for t in texts[k : k + 64]]
            split = [[] if has_odd_space(t) else t.split() for t in part]
            get = self.memory.now.get
            found = [list(map(get, words)) for words in split]
            gaps = [[] if all(ids) else list(compress(range(len(ids)), map(not_, ids))) for ids in found]  # ids are never empty
            unknown = {words[i] for words, gap in zip(split, gaps, strict=True) for i in gap}
            if new := self.memory.missing(unknown):
                self.learn(new)
            get = self.memory.find
            for text, words, ids, gap in zip(part, split, found, gaps, strict=True):
                for i in gap:
                    ids[i] = get(words[i])
                if not words and has_odd_space(text):
                    ids = [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
                out.append(b"".join(ids))
        return out


def has_odd_space(text: str) -> bool:
    return any(c in text for c in ODD_SPACES)


def _cut(ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
    raw, at = ids.tobytes(), [0, *(stops * 4).tolist()]
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode docs(doc_id, text) and write them to path, in ascending order over all files.

    The way words are cut here is that of ``VOCABULARY`` alone, so others are refused.
    """
    if vocabulary != VOCABULARY:
        raise ValueError(f"only {VOCABULARY} is cut into words like this, not {vocabulary}")
    where = vocabulary_path(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("tokens", where, lambda: WordEncoder(where))
        end, before = np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(before + ends - counts), pa.array(counts), lists],
                ["doc_id", "in_file", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    (
        bound_batches(docs)
        .select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange("doc_id", "h", "row")  # a repeated or null id, and even a repeated row, is split
        .sortWithinPartitions("doc_id", "h", "row")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.options(**WRITE_OPTIONS, maxRecordsPerFile=0)  # one file a task, whatever the session says
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows as written, with file_name."""
    return spark.read.schema(FILE_SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ids in the files before it, by the number of the task that wrote it.  Reads the counts only."""
    totals = read_token_files(spark, path).groupBy("file_name").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy(F.regexp_extract("file_name", r"^part-(\d+)", 1).cast("long")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file_name", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            raw = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").tobytes()
            crc = [zlib.crc32(raw[at[i] * 4 : at[i + 1] * 4]) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "in_file", "n_tokens", "file_name")] + [pa.array(crc, pa.int64())],
                ["doc_id", "in_file", "n_tokens", "file_name", "ids_crc32"],
            )

    rows = read_token_files(spark, path).mapInArrow(
        digest, "doc_id long, in_file long, n_tokens long, file_name string, ids_crc32 long"
    )
    return rows.join(file_offsets(spark, path), "file_name").select(
        "doc_id", (F.col("offset") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents: the filter reaches the files' statistics and Bloom filters, so other stripes stay unread."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
