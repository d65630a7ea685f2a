"""Byte-level BPE: texts to ids by the ranks of a vocabulary, and ids back to bytes.

A match of the pattern (a pre-token) is merged by rank: a bucket per rank holds the positions of pairs that would become
that rank's token, a hierarchical bitmap of 64-bit words says which buckets hold any, and its first set bit is the next
rank.  Tokens form a linked list over the bytes; a merge moves two links and puts the two pairs around it in their
buckets; entries whose pair has changed meanwhile are skipped when they come up.  A pre-token of n bytes takes at most n
merges of a few steps each, so pre-tokens of any length are merged whole.

A text is cut at single spaces between other characters, where no pre-token can go on; what lies between is remembered per
worker (a bounded number, twice over), so the pattern and the merges see each word once.

Defined cases: a null text is empty and has no ids; equal and repeated rows are encoded alike; texts of any length are
encoded whole; special tokens' strings are ordinary text; other columns, whatever their names, stay out; null ids of
documents are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice, pairwise, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rheolake.llm.common import bound_batches, per_worker, table
from rheolake.llm.token_files import Memory, vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Stretches between spaces that one Python worker remembers at most, twice over, and their longest.
MEMO, MEMO_CHARS = 400_000, 64
#: Words that are looked up together, about; bytes beyond which the merge keeps packed arrays.
PART, LISTED = 20_000, 1 << 20
#: The pattern's white space, as the Unicode property that the library's own engine takes it for.
SPACE = r"\p{White_Space}"


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class RankQueue:
    """Positions by rank: buckets, and a bitmap in words of 64 bits over them, over its words, and so on to one word."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        size = ranks
        while size > 1 or not self.levels:
            size = -(-size // 64)
            self.levels.append([0] * size)
        self.down = self.levels[::-1]
        self.buckets: dict[int, list[int]] = {}
        self.taken: Iterator[int] = iter(())

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        for words in self.levels:
            word = rank >> 6
            before = words[word]
            words[word] = before | 1 << (rank & 63)
            if before:
                return
            rank = word

    def first(self) -> int:
        """The smallest rank that has positions, -1 if none."""
        at = 0
        for words in self.down:
            word = words[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def pop(self, rank: int) -> Iterator[int]:
        """The positions of a rank in ascending order; its bucket is empty from now on."""
        bucket = self.buckets.pop(rank)
        for words in self.levels:
            word = rank >> 6
            words[word] &= ~(1 << (rank & 63))
            if words[word]:
                break
            rank = word
        bucket.sort()
        self.taken = iter(bucket)
        return self.taken

    def give_back(self, rank: int) -> None:
        """Return what was popped and not yet read."""
        for position in self.taken:
            self.push(rank, position)


class ByteEncoder:
    def __init__(self, ranks: dict[bytes, int], splitter: str, memo: int = MEMO):
        self.ranks = ranks
        self.split = regex.compile(splitter.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", SPACE))
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.memory, self.pieces = Memory(memo), Memory(memo)  # of words between spaces, of pre-tokens
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, which lie end to end and are merged through one queue; no pair goes over an end."""
        joined, n = b"".join(pieces), sum(map(len, pieces))
        store = list if n <= LISTED else (lambda values: array("q", values))  # packed where the lists would be large
        head = bytearray(n + 1)  # 1 where a pre-token starts, and at the end
        starts = [0, *accumulate(map(len, pieces))]
        for i in starts:
            head[i] = 1
        # after[i], before[i]: start of the next and of the last token; wanted[i]: rank of the pair that starts at i,
        # -1 for none and where no token starts any more
        after, before = store(range(1, n + 1)), store(range(-1, n))
        wanted, ids = store(repeat(-1, n)), store(map(self.byte_ids.__getitem__, joined))
        get, queue = self.ranks.get, self.queue
        push, buckets = queue.push, queue.buckets
        for i, rank in enumerate(map(get, map(bytes, zip(joined, joined[1:])))):
            if rank is not None and not head[i + 1]:
                wanted[i] = rank
                push(rank, i)
        while (rank := queue.first()) >= 0:
            for i in queue.pop(rank):
                if wanted[i] != rank:
                    continue
                gone = after[i]
                end = after[gone]
                after[i], wanted[gone], ids[i] = end, -1, rank
                lower = False
                found = None
                if not head[end]:
                    before[end] = i
                    found = get(joined[i : after[end]])
                if found is None:
                    wanted[i] = -1
                else:
                    wanted[i] = found
                    lower = found <= rank
                    if found in buckets:
                        buckets[found].append(i)
                    else:
                        push(found, i)
                if not head[i]:
                    left = before[i]
                    found = get(joined[left:end])
                    if found is None:
                        wanted[left] = -1
                    elif found != wanted[left]:
                        wanted[left] = found
                        lower |= found <= rank
                        if found in buckets:
                            buckets[found].append(left)
                        else:
                            push(found, left)
                if lower:  # a smaller rank, or this one again, has come up: what is left of the bucket waits
                    queue.give_back(rank)
                    break
        out = []
        for i, end in pairwise(starts):
            own = array("I")
            while i < end:
                own.append(ids[i])
                i = after[i]
            out.append(own.tobytes())
        return out

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens: those of the vocabulary as they are, others merged; short ones are remembered."""
        short = {p for p in pieces if len(p) <= MEMO_CHARS}
        found: dict[str, bytes] = {}
        new = self.pieces.missing(short)
        long = list({p for p in pieces if len(p) > MEMO_CHARS})
        for some in (new, long):
            rest = []
            for p in some:
                whole = self.ranks.get(p.encode())
                if whole is None:
                    rest.append(p)
                else:
                    found[p] = array("I", [whole]).tobytes()
            found.update(zip(rest, self.merge([p.encode() for p in rest]), strict=True))
        self.pieces.learn(new, [found[p] for p in new])
        now = self.pieces.now
        return [now[p] if p in short else found[p] for p in pieces]

    def direct(self, text: str) -> bytes:
        """Ids of a stretch of text by the pattern."""
        pieces, out = self.split.finditer(text), []
        while part := [x.group() for x in islice(pieces, PART)]:
            out += self.of_pieces(part)
        return b"".join(out)

    def learn(self, words: list[str]) -> None:
        """Remember words that a space precedes."""
        for k in range(0, len(words), PART):
            part = words[k : k + PART]
            pieces = [self.split.findall(" " + w) for w in part]
            ids = iter(self.of_pieces([p for x in pieces for p in x]))
            self.memory.learn(part, [b"".join(islice(ids, len(x))) for x in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        out: list[bytes] = []
        group: list[list[tuple[list[str], bool]]] = []
        words = 0
        for text in texts:
            group.append(list(stretches(text.split(" "))))
            words += len(group[-1][0][0]) + sum(len(w) for w, plain in group[-1] if plain)
            if words >= PART:
                out += self.assembled(group)
                group, words = [], 0
        return out + self.assembled(group)

    def assembled(self, group: list[list[tuple[list[str], bool]]]) -> list[bytes]:
        get = self.memory.now.get
        plain = [[list(map(get, words)) if plain else None for words, plain in text] for text in group]
        gaps = [(words, ids, [i for i, x in enumerate(ids) if x is None]) for text, found in zip(group, plain, strict=True) for (words, _), ids in zip(text, found, strict=True) if ids and None in ids]
        new = {words[i] for words, _, at in gaps for i in at}
        short = {w for w in new if len(w) <= MEMO_CHARS}
        self.learn(self.memory.missing(short))
        for words, ids, at in gaps:
            for i in at:
                ids[i] = self.memory.find(words[i]) if words[i] in short else self.direct(" " + words[i])
        return [b"".join(chain.from_iterable(ids if ids is not None else [self.direct(" ".join(words))] for (words, _), ids in zip(text, found, strict=True))) for text, found in zip(group, plain, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def stretches(words: list[str]) -> Iterator[tuple[list[str], bool]]:
    """Runs of the words of text.split(" "): plain ones (a space before, no white space at either end), and ones that are to
    be joined by spaces again, an empty first word standing for a space before.  Spaces cut between other characters only."""
    odd = [i for i, w in enumerate(words) if not w or not w.isalnum() and (w[0].isspace() or w[-1].isspace())]
    at = 0  # words before it are given out
    for i in [0, *odd]:
        if i < at or i == 0 and at:
            continue
        # the stretch that joins on to word i: back over a space that does not cut, and on while spaces do not cut
        first = i
        while first > at and not cuts(words[first - 1], words[first]):
            first -= 1
        last = i + 1
        while last < len(words) and not cuts(words[last - 1], words[last]):
            last += 1
        if first > at:
            yield words[at:first], True
        yield ([""] if first else []) + words[first:last], False
        at = last
    if at < len(words):
        yield words[at:], True


def cuts(a: str, b: str) -> bool:
    return bool(a and b) and not a[-1].isspace() and not b[0].isspace()


def encoder_of(path: str, splitter: str) -> ByteEncoder:
    return per_worker("byte-bpe", (path, splitter), lambda: ByteEncoder(read_ranks(path), splitter))


def with_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (little-endian 32-bit numbers in one binary) of docs(doc_id, text)."""
    where, splitter = vocabulary_path(vocabulary), pattern()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(where, splitter)
        for batch in batches:
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary())], ["doc_id", "ids"])

    rows = bound_batches(docs).select("doc_id", "text")
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def with_text(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded(doc_id, ids) and decoded, the bytes that the ids stand for."""
    where, splitter = vocabulary_path(vocabulary), pattern()

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(where, splitter)
        for batch in batches:
            decoded = [encoder.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = bound_batches(encoded).select("doc_id", "ids")
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts encoded, and their ids decoded, in one pass over docs."""
    where, splitter = vocabulary_path(vocabulary), pattern()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(where, splitter)
        for batch in batches:
            counts, ids_hash, decoded_hash = [], [], []
            for ids in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                decoded_hash.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = bound_batches(docs).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
