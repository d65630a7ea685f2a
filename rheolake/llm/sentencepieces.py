"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The lattice of a text has an edge for each vocabulary piece it contains.  Forward Viterbi gives every position the best
score from the start; with these as exact heuristics an A-star search from the end meets complete segmentations in
order of their scores.  A piece starts at a blank mark or follows one inside its word, never spans one, and no piece
has a line end; so a text's lattice is a chain of its words' lattices: a word is solved once and remembered, its
runner-up's loss comes from forward and backward scores, and the N best of a text change only the N-1 words with the
smallest losses, which the A-star search then enumerates.  (A vocabulary with pieces across blanks is solved whole.)

Characters outside the vocabulary cost ten less than the worst piece and become byte pieces (or the unknown piece).  At
equal scores the longer last piece wins, and the earlier word changes first.

Defined cases: a null or empty text has no pieces, score 0 and one segmentation; null ids pass; repeated rows are
answered alike; texts of any length are encoded whole (a text without blanks is one long word a line, which takes
longer); kept columns pass through whatever their names, and only one with the name of a result gives way to it; others
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rheolake.llm.common import bound_batches, packed, table, unpacked

MODEL = "piece_bpe_32k.model"
N_BEST = 4
MARK = "▁"
#: Words of at most so many characters are solved many at once.
SHORT = 24
#: Characters of the words that a task remembers, and of those whose N best it remembers.
MEMO_CHARS, MEMO_BEST_CHARS = 2_000_000, 200_000
#: Pieces with such scores are there for symbols only; they do not count for the worst score.
NEVER = -1e8
UNKNOWN_LOSS = 10.0
CHANGES = "array<struct<score:double, changes:array<struct<start:int, stop:int, ids:array<int>>>>>"
ENCODED = f"ids array<int>, score double, n_best {CHANGES}, ids_crc32 long, round_trip boolean"


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Pieces by hash of their characters: a key lies in one of two places."""

    BASE, MIX = np.uint64(0x9E3779B97F4A7C15), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, pieces: list[str], bits: int = 17):
        self.shift = np.uint64(64 - bits)
        self.keys = [np.zeros(1 << bits, np.uint64) for _ in self.MIX]
        self.values = [np.full(1 << bits, -1, np.int32) for _ in self.MIX]
        hashes = []
        for p in pieces:
            h = 0
            for c in p:
                h = (h * int(self.BASE) + ord(c) + 1) & (1 << 64) - 1
            hashes.append(h)
        for n, key in enumerate(hashes):
            side, value = 0, n
            for _ in range(500):
                at = (key * self.MIX[side] & (1 << 64) - 1) >> 64 - bits
                old_key, old = int(self.keys[side][at]), int(self.values[side][at])
                self.keys[side][at], self.values[side][at] = key, value
                if old < 0:
                    break
                key, value, side = old_key, old, 1 - side
            else:
                raise ValueError("piece table is too full")

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, or -1."""
        out = np.full(len(key), -1, np.int32)
        for mix, keys, values in zip(self.MIX, self.keys, self.values, strict=True):
            at = (key * np.uint64(mix)) >> self.shift
            hit = keys[at] == key
            out[hit] = values[at[hit]]
        return out


class Pieces:
    """A SentencePiece vocabulary with its lattice search; one per task."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.processor
        every = range(sp.vocab_size())
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.texts = [sp.id_to_piece(i) for i in plain]
        self.ids = np.array(plain, np.int32)
        self.scores = np.array([sp.get_score(i) for i in plain], np.float64)
        self.by_text = {t: (i, s) for t, i, s in zip(self.texts, plain, self.scores.tolist(), strict=True)}
        self.longest = max(map(len, self.texts))
        self.unknown_score = float(self.scores[self.scores > NEVER].min()) - UNKNOWN_LOSS
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = bytes_ if all(sp.is_byte(i) for i in bytes_) else None
        self.decoded = [sp.id_to_piece(i).encode() for i in every]
        for i in every:
            if sp.is_control(i):
                self.decoded[i] = b""
        for b, i in enumerate(self.byte_ids or []):
            self.decoded[i] = bytes([b])
        self.table = PieceTable(self.texts)
        spans = any(MARK in t.lstrip(MARK) or "\n" in t for t in self.texts)
        self.words = re.compile("(?s).+" if spans else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.forget()
        self.best_chars = 0
        self.best_of: dict[str, list[tuple[float, list[int]]]] = {}

    # ------------------------------------------------------------------------------------------------- one word's lattice

    def _unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.processor.unk_id()]

    def edges(self, word: str) -> list[list[tuple[int, float, list[int]]]]:
        """For each end: (start, score, ids) of the pieces that end there, the shortest first."""
        out: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(len(word) + 1)]
        for stop in range(1, len(word) + 1):
            for start in range(stop - 1, max(-1, stop - 1 - self.longest), -1):
                found = self.by_text.get(word[start:stop])
                if found:
                    out[stop].append((start, found[1], [found[0]]))
                elif start == stop - 1:
                    out[stop].append((start, self.unknown_score, self._unknown(word[start])))
        return out

    def search(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids), best first: A-star from the end, guided by forward Viterbi scores."""
        edges = self.edges(word)
        forward = [0.0] + [-np.inf] * len(word)
        for stop in range(1, len(word) + 1):
            forward[stop] = max(forward[start] + score for start, score, _ in edges[stop])
        found: list[tuple[float, list[int]]] = []
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], 0, len(word), 0.0, None)]
        pushed = 0
        while agenda and len(found) < n:
            _, _, at, score, behind = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while behind:
                    ids += behind[0]
                    behind = behind[1]
                found.append((score, ids))
                continue
            for start, own, ids in edges[at]:
                pushed -= 1  # at equal priority the last pushed, the longest piece, is the first taken
                heapq.heappush(agenda, (-(forward[start] + own + score), pushed, start, own + score, (ids, behind)))
        return found

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        found = self.best_of.get(word)
        if found is None or len(found) < n:
            found = self.search(word, n)
            self.remember(word, found)
        return found[:n]

    def remember(self, word: str, found: list[tuple[float, list[int]]]) -> None:
        self.best_chars += len(word)
        if self.best_chars > MEMO_BEST_CHARS:
            self.best_of.clear()
            self.best_chars = len(word)
        self.best_of[word] = found

    # ------------------------------------------------------------------------------------------------ many words at once

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.solved = [np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

    def learn(self, words: list[str], n: int = 2) -> None:
        """Solve words: best score, the runner-up's loss (infinite without one), pieces, and where their ids lie."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(min(len(w), SHORT + 1), []).append(w)
        order: list[str] = []
        score, loss, count, ids = [], [], [], []
        for size, group in by_size.items():
            for k in range(0, len(group), 4096):
                part = group[k : k + 4096]
                got = self._solve(part, size) if size <= SHORT else self._solve_long(part, max(n, 2))
                order += part
                for into, x in zip((score, loss, count, ids), got, strict=True):
                    into.append(x)
        base, at = len(self.solved[0]), len(self.solved[4])
        self.number.update(zip(order, range(base, base + len(order)), strict=True))
        counts = np.concatenate(count)
        new = [np.concatenate(score), np.concatenate(loss), counts, at + np.cumsum(counts) - counts, np.concatenate(ids)]
        self.solved = [np.concatenate([a, b]) for a, b in zip(self.solved, new, strict=True)]

    def _solve_long(self, words: list[str], n: int) -> tuple[np.ndarray, ...]:
        best = [self.n_best(w, n) for w in words]
        ids = [b[0][1] for b in best]
        return (
            np.array([b[0][0] for b in best]),
            np.array([b[0][0] - b[1][0] if len(b) > 1 else np.inf for b in best]),
            np.array([len(i) for i in ids], np.int64),
            np.array([i for x in ids for i in x], np.int32),
        )

    def _solve(self, words: list[str], size: int) -> tuple[np.ndarray, ...]:
        """Forward and backward Viterbi over the lattices of words of one size, a lane per word."""
        n = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        piece: dict[tuple[int, int], np.ndarray] = {}
        value: dict[tuple[int, int], np.ndarray] = {}
        for start in range(size):
            key = np.zeros(n, np.uint64)
            for stop in range(start + 1, min(size, start + self.longest) + 1):
                key = key * PieceTable.BASE + chars[stop - 1]
                no = self.table.find(key)
                if stop == start + 1:
                    value[start, stop] = np.where(no >= 0, self.scores[no], self.unknown_score)
                elif (no >= 0).any():
                    value[start, stop] = np.where(no >= 0, self.scores[no], -np.inf)
                else:
                    continue
                piece[start, stop] = no
        forward = np.full((size + 1, n), -np.inf)
        came = np.zeros((size + 1, n), np.int8)
        forward[0] = 0
        for start, stop in sorted(value, key=lambda x: (x[1], x[0])):  # the longest first, and only a better one replaces it
            total = forward[start] + value[start, stop]
            better = total > forward[stop]
            forward[stop][better] = total[better]
            came[stop][better] = start
        backward = np.full((size + 1, n), -np.inf)
        backward[size] = 0
        for start, stop in sorted(value, reverse=True):
            np.maximum(backward[start], value[start, stop] + backward[stop], out=backward[start])
        on_path = np.zeros((size + 1, n), bool)
        on_path[size] = True
        runner_up = np.full(n, -np.inf)
        chosen = np.full((size, n), -2, np.int32)
        for start, stop in sorted(value, key=lambda x: -x[1]):
            taken = on_path[stop] & (came[stop] == start)
            chosen[start][taken] = piece[start, stop][taken]
            on_path[start] |= taken
            through = forward[start] + value[start, stop] + backward[stop]
            through[taken] = -np.inf
            np.maximum(runner_up, through, out=runner_up)
        used = chosen.T > -2
        counts = used.sum(1)
        numbers = chosen.T[used]
        ids = self.ids[numbers]
        if (numbers < 0).any():  # characters outside the vocabulary: a few ids each
            where = np.flatnonzero(numbers < 0)
            lane, place = np.nonzero(used)
            put = [self._unknown(words[lane[i]][place[i]]) for i in where]
            ids = np.insert(np.delete(ids, where), np.repeat(where - np.arange(len(where)), [len(x) for x in put]), [i for x in put for i in x])
            np.add.at(counts, lane[where], [len(x) - 1 for x in put])
        best = forward[size]
        return best, best - runner_up, counts.astype(np.int64), ids

    # -------------------------------------------------------------------------------------------------------------- texts

    def normalize(self, text: str) -> str:
        return self.processor.normalize(text) if text else ""

    def encode(self, texts: list[str | None], n: int) -> list[tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """Per text: ids, score, and up to n segmentations as (score, changes to the first: from, to, ids)."""
        split = [self.words.findall(self.normalize(t or "")) for t in texts]
        new = set().union(*split).difference(self.number)
        if self.chars + sum(map(len, new)) > MEMO_CHARS:
            self.forget()
            new = set().union(*split)
        if new:
            self.chars += sum(map(len, new))
            self.learn(list(new), n)
        scores, losses, counts, places, flat = self.solved
        return [self._text(words, n, scores, losses, counts, places, flat) for words in split]

    def _text(self, words, n, scores, losses, counts, places, flat):
        if not words:
            return np.zeros(0, np.int32), 0.0, [(0.0, [])]
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        count = counts[number]
        stop = np.cumsum(count)
        ids = flat[np.repeat(places[number] - stop + count, count) + np.arange(stop[-1])]
        score = float(scores[number].sum())
        loss = losses[number]
        most = min(n - 1, len(words))
        near = np.flatnonzero(loss <= np.partition(loss, most - 1)[most - 1]) if most else np.zeros(0, np.int64)
        near = near[np.isfinite(loss[near])]
        near = near[np.argsort(loss[near], kind="stable")][: n - 1]
        combined: list[tuple[float, list[tuple[int, int, list[int]]]]] = [(0.0, [])]
        for at in near.tolist():
            best = self.n_best(words[at], n)
            a, b = int(stop[at] - count[at]), int(stop[at])
            ways = [(best[0][0] - s, [] if k == 0 else [(a, b, x)]) for k, (s, x) in enumerate(best)]
            combined = sorted(((x + y, p + q) for x, p in combined for y, q in ways), key=lambda z: z[0])[:n]
        return ids, score, [(score - lost, sorted(changes)) for lost, changes in combined]

    def decode(self, ids) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


# -------------------------------------------------------------------------------------------------------------- operators


RESULTS = ("ids", "score", "n_best", "ids_crc32", "round_trip")


def encode_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """The kept columns and ids, score, n_best, the ids' crc32 and whether decoding gives the text again."""
    where = model_path(model)
    rows = bound_batches(docs).select(packed(keep).alias("row"), F.col("text").alias("text"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL(ENCODED)])
    change = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    ways = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(where)
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                texts = batch.column(1).to_pylist()
                found = pieces.encode(texts, n)
                ends = np.cumsum([len(ids) for ids, _, _ in found])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate([ids for ids, _, _ in found]).astype(np.int32)))
                best = [[{"score": s, "changes": [{"start": a, "stop": b, "ids": x} for a, b, x in cs]} for s, cs in w] for _, _, w in found]
                columns = [
                    batch.column(0),
                    lists,
                    pa.array([s for _, s, _ in found], pa.float64()),
                    pa.array(best, ways),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids, _, _ in found], pa.int64()),
                    pa.array([pieces.decode(ids.tolist()) == (t or "") for (ids, _, _), t in zip(found, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", *RESULTS])

    return unpacked(rows.mapInArrow(run, schema), "row", keep, RESULTS)


def decode_documents(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The kept columns and the text of ids."""
    where = model_path(model)
    rows = bound_batches(encoded).select(packed(keep).alias("row"), "ids")
    schema = StructType([rows.schema["row"], *StructType.fromDDL("text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(where)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return unpacked(rows.mapInArrow(run, schema), "row", keep, ("text",))


def op1_sentencepieces(spark, sf_dir: str) -> DataFrame:
    found = encode_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "score",
        "ids_crc32",
        F.transform("n_best", lambda b: b["score"]).alias("best_scores"),
        "round_trip",
    )
