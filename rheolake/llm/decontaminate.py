"""Benchmark decontamination with one FM-index per shard of the corpus.

Words are runs of ASCII digits, letters (A-Z lowered) and non-ASCII characters.  A test phrase is a window of ``width``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window.  Each task indexes its
documents shard by shard: the words are numbered by the benchmark's vocabulary, a suffix array gives the
Burrows-Wheeler transform, a wavelet matrix answers its ranks, all phrases are searched backwards at once, and their
occurrences are located by walking to sampled suffix positions.  Overlapping occurrences merge into spans.

A word outside the vocabulary ends every match, so only runs of vocabulary words at least as long as the shortest
phrase enter the index; nothing that could match is left out.  The pass is narrow: documents are not shuffled.  The
phrases go to every task as long as they are within ``BLOCK_BYTES``; a larger benchmark is cut into blocks (an item over
``PIECE_WORDS`` words into overlapping pieces first), of which a task has one in memory at a time.  Spans of all blocks
are merged before anything is cut out, and cut texts are searched again over all blocks until nothing is found, so the
size of a block changes no result.

Defined cases: a null text has no words and stays null; texts of any length are searched whole; a null item text gives
no phrase; a null item id still marks words but is not listed; repeated rows are answered alike; an empty benchmark hits
nothing; an empty table gives an empty result; further columns pass through untouched where they are asked for with
``keep``, whatever their names; only a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rheolake.llm.common import bound_batches, packed, share, table, unpacked

WIDTH = 10
#: Bytes of text per index.
SHARD_BYTES = 12 << 20
#: Words of a piece of a long benchmark item.
PIECE_WORDS = 100_000
#: Bytes of benchmark text whose phrases are shipped to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Every how many text positions the suffix array keeps its value.
SAMPLE = 8
LEAK_SCHEMA = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int>>, clean_text string"

#: Lower-cases A-Z and turns each byte that is in no word into a space; UTF-8 bytes keep their places.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


# ---------------------------------------------------------------------------------------------------------------- index


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the compared length among those still tied.

    rank: a number per symbol; the last one occurs once, so that no comparison runs over the end.
    """
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    values = rank[order]
    new = np.r_[True, values[1:] != values[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    step = 1
    while len(tied):
        suffixes = order[tied]
        key = rank[suffixes] * n + rank[suffixes + step]
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[tied] = suffixes
        new = np.r_[True, key[1:] != key[:-1]]
        rank[suffixes] = tied[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        tied = tied[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit plane per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.planes, self.before, self.zeros = [], [], []
        for level in range(bits):
            bit = (symbols >> (bits - 1 - level) & 1).astype(np.uint8)
            packed = np.packbits(np.r_[bit, np.zeros(64 - self.n % 64, np.uint8)], bitorder="little").view("<u8")
            self.planes.append(packed)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.r_[symbols[bit == 0], symbols[bit == 1]]
        every = np.arange(1 << bits)
        self.start = np.zeros(1 << bits, np.int64)
        self.start = self._down(every, np.zeros(1 << bits, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.planes[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self._ones(level, at)
            at = np.where(symbol >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._down(symbol, at) - self.start[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            symbol = symbol << 1 | bit
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Full-text index of a sequence of numbers from 1; zeros are ends that no phrase spans.  The last one is an end."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        n, ends = len(text), text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + np.int64(n))
        order = suffix_array(rank)
        self.n = n
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols + 1))]
        self.ranks = WaveletMatrix(text[order - 1].astype(np.int64), max(1, int(n_symbols).bit_length()))
        starts = np.r_[True, ends[:-1]]
        kept = starts | (np.arange(n) % sample == 0)
        self.sampled = kept[order]
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the phrases of size ids at starts: which of them occur, and their first and last row + 1."""
        which = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        for place in range(size - 1, -1, -1):
            symbol = ids[starts[which] + place]
            low = self.first[symbol] + self.ranks.rank(symbol, low)
            high = self.first[symbol] + self.ranks.rank(symbol, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each walks backwards to a sampled one."""
        found, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled[rows]
            found[open_[done]] = self.samples[self.sample_no[rows[done]]] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, before = self.ranks.access_rank(rows)
            rows = self.first[symbol] + before
            steps += 1
        return found


# --------------------------------------------------------------------------------------------------------------- phrases


def equal_runs(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of size ids; runs are equal where their numbers are.

    Runs of two, four, eight ... are numbered as pairs of shorter ones, so no run is ever spelled out.
    """
    numbers, have = ids.astype(np.int64), 1
    while have < size:
        step = min(have, size - have)
        pair = numbers[:-step] * (numbers.max() + 1) + numbers[step:]
        numbers, have = np.unique(pair, return_inverse=True)[1], have + step
    return numbers


class Phrases:
    """The windows of a benchmark (or a block of it), numbered by its vocabulary.

    Nothing is kept by window but where one of its occurrences starts in ``ids`` and whose it is.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], width: int = WIDTH):
        names, chunks, sizes = [], [], []
        for item, text in items:
            words = words_of(text)
            if words:
                names.append(item)
                chunks.append(pa.array(words, pa.binary()))
                sizes.append(len(words))
        coded = pa.concat_arrays(chunks or [pa.array([], pa.binary())]).dictionary_encode()
        self.vocabulary: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy() + np.int32(1)
        self.item_ids = sorted({x for x in names if x is not None})
        number = {x: i for i, x in enumerate(self.item_ids)}
        owner = np.array([number.get(x, -1) for x in names], np.int64)
        size = np.array(sizes, np.int64)
        first = np.cumsum(size) - size
        #: Words of a phrase, where phrases start in ids, first owner of each, owners.
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(size, width)).tolist():
            own = np.flatnonzero(size == n if n < width else size >= n)
            count = size[own] - n + 1
            starts = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            _, at, window = np.unique(equal_runs(self.ids, n)[starts], return_index=True, return_inverse=True)
            whose = np.repeat(owner[own], count)
            pairs = np.unique((window * np.int64(len(number) + 1) + whose)[whose >= 0])
            owned = np.bincount(pairs // (len(number) + 1), minlength=len(at))
            self.groups.append((n, starts[at], np.r_[0, np.cumsum(owned)], (pairs % (len(number) + 1)).astype(np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0


def number_texts(texts: Iterable[str | None], phrases: Phrases) -> list[np.ndarray]:
    """Numbers of each text's words in the benchmark's vocabulary, 0 for others."""
    words = [pa.array(words_of(t), pa.binary()) for t in texts]
    if not words:
        return []
    found = pc.index_in(pa.concat_arrays(words), value_set=phrases.vocabulary)
    numbers = pc.fill_null(pc.add(found, pa.scalar(1, pa.int32())), pa.scalar(0, pa.int32())).to_numpy()
    return np.split(numbers, np.cumsum([len(w) for w in words])[:-1])


def find_in_shard(texts: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Per document of the shard (numbered words): merged spans of hit words, and the numbers of the items found."""
    nothing: list[tuple[list[tuple[int, int]], list[int]]] = [([], []) for _ in texts]
    if not phrases.shortest:
        return nothing
    pieces, doc_no, word_no = [], [], []
    for doc, ids in enumerate(texts):
        edge = np.diff((ids > 0).view(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= phrases.shortest
        for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            pieces += [ids[b:e].astype(np.int64), np.zeros(1, np.int64)]
            doc_no += [doc]
            word_no += [(b, e)]
    if not pieces:
        return nothing
    text = np.concatenate(pieces)
    sizes = np.array([e - b + 1 for b, e in word_no])
    doc_of = np.repeat(np.array(doc_no), sizes)
    word_of = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat([b for b, _ in word_no], sizes)
    index = FMIndex(text, len(phrases.vocabulary))
    change, pairs = np.zeros(len(text) + 1, np.int64), []
    for width, starts, first, owners in phrases.groups:
        which, low, high = index.search(phrases.ids, starts, width)
        if not len(which):
            continue
        count = high - low
        at = index.locate(np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum()))
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        found = np.unique(np.stack([doc_of[at], np.repeat(which, count)], 1), axis=0)
        n_owners = first[found[:, 1] + 1] - first[found[:, 1]]
        owner = np.repeat(first[found[:, 1]] - np.cumsum(n_owners) + n_owners, n_owners) + np.arange(n_owners.sum())
        pairs.append(np.stack([np.repeat(found[:, 0], n_owners), owners[owner]], 1))
    hit = np.cumsum(change[:-1]) > 0
    edge = np.diff(hit.view(np.int8), prepend=0, append=0)
    for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        nothing[doc_of[b]][0].append((int(word_of[b]), int(word_of[e - 1]) + 1))
    for doc, item in np.unique(np.concatenate(pairs), axis=0) if pairs else []:
        nothing[doc][1].append(int(item))
    return nothing


def cut_out(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """Text without its spans of words, and the spans in bytes of its UTF-8 form."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    places = [(words[b][0], words[e - 1][1]) for b, e in spans]
    kept, at = [], 0
    for b, e in places:
        kept.append(raw[at:b])
        at = e
    return b"".join([*kept, raw[at:]]).decode(), places


# -------------------------------------------------------------------------------------------------------------- operator


RESULTS = ("n_words", "n_hit", "item_ids", "spans")


def benchmark_pieces(benchmark: DataFrame, width: int = WIDTH, piece_words: int = PIECE_WORDS) -> DataFrame:
    """item and text; long texts in pieces that overlap, so that each window of width words lies in one of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words) - width + 1), piece_words)
                parts = [b" ".join(words[k : k + piece_words + width - 1]).decode() for k in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], ["item", "text"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "item string, text string")


def _scan(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], clean: bool, width: int = WIDTH, shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES, piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """row (the kept columns) and the results, with clean_text."""
    items = benchmark_pieces(benchmark, width, piece_words)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    books = []
    for block in range(blocks):  # the driver has one block's phrases at a time
        chosen = items.where(part == block) if blocks > 1 else items
        books.append(share(docs.sparkSession, Phrases(((r["item"], r["text"]) for r in chosen.collect()), width)))
    rows = bound_batches(docs).select(packed(keep).alias("row"), F.col("text").alias("text"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL(LEAK_SCHEMA)])
    pair = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def search(texts: list[str | None], todo: list[int], blocks_: Iterator[Phrases]):
        """Words of each, merged spans of hit words, and the items found, over all blocks."""
        count, runs, names = [0] * len(todo), [[] for _ in todo], [set() for _ in todo]
        for book in blocks_:
            words = number_texts([texts[i] for i in todo], book)
            count = [len(w) for w in words]
            for k, (spans, numbers) in enumerate(find_in_shard(words, book)):
                runs[k] += spans
                names[k].update(book.item_ids[i] for i in numbers)
        return count, [_merge(r) if len(r) > 1 else r for r in runs], names

    def flush(batches: list[pa.RecordBatch], load) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        texts = whole.column(1).to_pylist()
        count, runs, names = search(texts, list(range(len(texts))), load())
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        cleaned: list[str | None] = [None] * len(texts)
        todo = [i for i, r in enumerate(runs) if r]
        for i in todo:
            left, spans[i] = cut_out(texts[i], runs[i])
            cleaned[i] = left if clean else None
        while clean and todo:
            _, more, _ = search(cleaned, todo, load())
            for i, again in zip(todo, more, strict=True):
                if again:
                    cleaned[i] = cut_out(cleaned[i], again)[0]
            todo = [i for i, again in zip(todo, more, strict=True) if again]
        return pa.RecordBatch.from_arrays(
            [
                whole.column(0),
                pa.array(count, pa.int64()),
                pa.array([sum(e - b for b, e in r) for r in runs], pa.int64()),
                pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                pa.array([[{"start": b, "stop": e} for b, e in x] for x in spans], pa.list_(pair)),
                pa.array(cleaned, pa.string()),
            ],
            ["row", *RESULTS, "clean_text"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = [books[0]()] if len(books) == 1 else None
        load = lambda: iter(only) if only else (book() for book in books)
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                held.append(whole.slice(k, 500))
                size += held[-1].column(1).nbytes
                if size >= shard_bytes:
                    yield flush(held, load)
                    held, size = [], 0
        if held:
            yield flush(held, load)

    return rows.mapInArrow(scan, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), clean: bool = False, **sizes) -> DataFrame:
    """The kept columns and n_words, n_hit, item_ids, spans (merged, in UTF-8 bytes) of each document.

    clean: also clean_text, the text without its spans, searched again until nothing is found; null where nothing was.
    """
    return unpacked(_scan(docs, benchmark, keep, clean, **sizes), "row", keep, (*RESULTS, "clean_text") if clean else RESULTS)


def _merge(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(places):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **sizes) -> DataFrame:
    """docs with the spans cut out of text; a document of which no word is left goes.  n_chars, if there, follows."""
    columns = docs.columns
    found = _scan(docs, benchmark, tuple(columns), True, **sizes)
    has_word = F.col("clean_text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")
    new = {"text": F.col("clean_text")}
    if "n_chars" in columns:
        new["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
    own = {c: F.col("row").getField(c) for c in columns}
    return found.where(F.col("clean_text").isNull() | has_word).select(*(F.coalesce(new[c], own[c]).alias(c) if c in new else own[c].alias(c) for c in columns))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_leaks(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = rf"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(coalesce(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), {WIDTH}) AS n, array_to_string(ws[i : i + {WIDTH} - 1], ' ') AS gram
  FROM bw, unnest(range(1, greatest(len(ws) - {WIDTH}, 0) + 2)) AS t(i) WHERE len(ws) > 0),
grams AS (
  SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram
  FROM dw, (SELECT DISTINCT n FROM win) AS sizes, unnest(range(1, len(ws) - n + 2)) AS t(i)),
occ AS (SELECT rid, i, n, item_id FROM grams JOIN win USING (n, gram)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS t(p) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
