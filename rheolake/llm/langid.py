"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton.  A text is parsed against it into the
longest phrases that occur in the sample: a phrase ends where the automaton has no way on.  Few phrases mean a close
relative; the phrase count, times the log of the sample's length, over the text's length estimates the cross entropy,
and the smallest wins.

Automata are kept sparse: every state has a base, and the way for a symbol lies at base + symbol if that slot names the
state; so a symbol costs nothing where it does not occur, and all letters of all languages are symbols.  numpy advances
thousands of text blocks by one symbol at once.  Phrases do not end at block borders: a block after the first is parsed
again from the state in which its predecessor ended, until a phrase starts where one started before, from where both
parses are the same.  So the counts are those of whole texts.

The driver holds the teaching texts only (``SAMPLE_CHARS`` characters a language, about); each Python worker builds the
automata once, about half a second and 3 MB a language.

Characters are lower-cased; runs of other characters than letters are one space.

Defined cases: a text that is null or has no letter is ``und`` with score 0; labelled rows with a null id or text or
without letters do not teach; equal texts of a language teach once; of a language whose texts are all longer than
``SAMPLE_DOC_CHARS`` the shortest teach; ties between languages go to the first by name; without any labelled text every
text is ``und``; a single language has score 1; texts of any length are parsed whole; repeated rows are answered alike;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rheolake.llm.common import bound_batches, per_worker, share, table

#: Bounds of the labelled sample: texts and characters per language; whole texts of at most so many characters come
#: first, longer ones only where those do not suffice.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_DOC_CHARS = 400, 60_000, 2_000
#: Longer texts do not teach (they are predicted like all others), so a sample has at most SAMPLE_CHARS + SAMPLE_TEXT_CHARS
#: characters a language; a language of longer texts only is not learned.
SAMPLE_TEXT_CHARS = 200_000
BLOCK = 2_048
#: Blocks parsed in step with each other.
LANES = 4_096
SPACE, FOREIGN = 0, 1


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Ways (symbol to state) of each state of the automaton of all substrings; state 0 is the root."""
    ways: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(ways)
        ways.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(ways)
                ways.append(dict(ways[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = twin
                    p = link[p]
        last = new
    return ways


class Parser:
    """An automaton as a machine that never stops: without a way on, the next phrase starts.

    In the root no phrase is open; a symbol that the sample lacks is a phrase of its own and leads there.
    """

    def __init__(self, text: list[int], symbols: int):
        ways = suffix_automaton(text)
        self.first = np.zeros(symbols, np.int32)
        self.first[list(ways[0])] = list(ways[0].values())
        degree = np.array([0] + [len(w) for w in ways[1:]])
        size = 2 * int(degree.sum()) + symbols + 64
        self.base = np.zeros(len(ways), np.int32)
        self.owner = np.full(size + symbols, -1, np.int32)
        self.target = np.zeros(size + symbols, np.int32)
        taken, draw = bytearray(size + symbols), random.Random(len(ways)).random
        slots: list[int] = []
        many = np.flatnonzero(degree > 1)
        many = many[np.argsort(-degree[many], kind="stable")]
        for state in many.tolist():
            own = ways[state]
            while True:  # at most half of the slots are ever taken, so a few draws do
                at = int(draw() * size)
                if not any(taken[at + c] for c in own):
                    break
            self.base[state] = at
            for c in own:
                taken[at + c] = 1
                slots.append(at + c)
        self.owner[slots] = np.repeat(many, degree[many])
        self.target[slots] = [t for s in many.tolist() for t in ways[s].values()]
        single = np.flatnonzero(degree == 1)
        free = np.flatnonzero(np.frombuffer(taken, np.uint8)[symbols:] == 0)[: len(single)] + symbols
        symbol = np.array([next(iter(ways[s])) for s in single.tolist()], np.int64)
        self.base[single] = free - symbol
        self.owner[free] = single
        self.target[free] = [next(iter(ways[s].values())) for s in single.tolist()]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase starts."""
        at = self.base[state] + symbol
        goes_on = self.owner[at] == state
        return np.where(goes_on, self.target[at], self.first[symbol]), ~goes_on


class Alphabet:
    """Numbers of characters: 0 the space, 1 letters that no sample has, then the samples' letters."""

    def __init__(self, letters: list[str]):
        self.symbols = len(letters) + 2
        self.number = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)
        self.number[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)

    def encode(self, text: str) -> np.ndarray:
        codes = self.number[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = codes > SPACE
        keep[1:] |= codes[:-1] > SPACE
        return codes[keep]


def has_letter(codes: np.ndarray) -> bool:
    return bool((codes > SPACE).any())


class Model:
    """A parser per language, from the teaching texts of each."""

    def __init__(self, texts: dict[str, list[str]]):
        letters = sorted({c for own in texts.values() for t in own for c in t.lower() if c.isalpha()})
        self.alphabet = Alphabet(letters)
        samples = {n: np.concatenate([self.alphabet.encode(t) for t in own]) for n, own in texts.items() if own}
        self.names = sorted(n for n, x in samples.items() if has_letter(x))
        self.parsers = [Parser(samples[n].tolist(), self.alphabet.symbols) for n in self.names]
        self.logs = np.log2([max(2, len(samples[n])) for n in self.names])

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases [text, language] of encoded texts (none of them empty)."""
        size = np.array([len(c) for c in codes])
        whole, first = np.concatenate(codes), np.cumsum(size) - size
        counts = -(-size // BLOCK)
        no = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.repeat(first, counts) + BLOCK * no
        length = np.minimum(begin + BLOCK, np.repeat(first + size, counts)) - begin
        order = np.argsort(-length, kind="stable")  # long blocks first, so that those still running lie in front
        runs = []  # lanes that step together, their letters by step, how many still run at each step
        for k in range(0, len(order), LANES):
            lanes = order[k : k + LANES]
            steps = np.arange(int(length[lanes[0]]))
            grid = np.stack([whole[np.minimum(begin[lanes] + n, len(whole) - 1)] for n in steps]) if len(steps) else np.zeros((0, len(lanes)), np.int32)
            runs.append((lanes, grid, (len(lanes) - np.searchsorted(length[lanes][::-1], steps, side="right")).tolist()))
        out = np.zeros((len(codes), len(self.parsers)), np.int64)
        for j, parser in enumerate(self.parsers):  # one language's starts at a time, so memory does not grow with the languages
            starts, ended = np.zeros(len(whole), bool), np.zeros(len(begin), np.int32)
            for lanes, grid, running in runs:
                state, place = np.zeros(len(lanes), np.int32), begin[lanes].copy()
                for step, n in enumerate(running):
                    state[:n], starts[place[:n]] = parser.step(state[:n], grid[step, :n])
                    place += 1
                ended[lanes] = state
            _join_blocks(parser, whole, begin, length, no, starts, ended)
            out[:, j] = np.add.reduceat(starts, first, dtype=np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        codes = [self.alphabet.encode(t) if t else np.zeros(0, np.int32) for t in texts]
        known = [i for i, c in enumerate(codes) if self.names and has_letter(c)]
        if not known:
            return names, scores
        entropy = self.phrases([codes[i] for i in known]) * self.logs / np.array([len(codes[i]) for i in known])[:, None]
        best = entropy.argmin(1)
        ranked = np.sort(entropy, 1)
        score = 1 - ranked[:, 0] / (ranked[:, 0] + ranked[:, 1]) if ranked.shape[1] > 1 else np.ones(len(known))
        for i, b, s in zip(known, best.tolist(), score.tolist(), strict=True):
            names[i], scores[i] = self.names[b], s
        return names, scores


def _join_blocks(
    parser: Parser, whole: np.ndarray, begin: np.ndarray, length: np.ndarray, no: np.ndarray, starts: np.ndarray, ended: np.ndarray
) -> None:
    """Correct starts and ended, made as if each block were a text, to those of whole texts."""
    redo = np.flatnonzero(no > 0)
    while len(redo):
        lanes, state, step = redo, ended[redo - 1].copy(), 0
        changed: list[np.ndarray] = []
        lanes, state = lanes[state > 0], state[state > 0]  # with no phrase open, nothing differs
        while len(lanes):
            place = begin[lanes] + step
            state, started = parser.step(state, whole[place])
            apart = ~(started & starts[place])
            starts[place] = started
            lanes, state = lanes[apart], state[apart]
            step += 1
            done = length[lanes] == step
            if done.any():
                other = done & (ended[lanes] != state)
                ended[lanes[other]] = state[other]
                changed.append(lanes[other])
                lanes, state = lanes[~done], state[~done]
        after = np.concatenate(changed) + 1 if changed else np.zeros(0, np.int64)
        after = after[after < len(no)]
        redo = np.sort(after[no[after] > 0])


# -------------------------------------------------------------------------------------------------------------- operator


def teaching_rows(docs: DataFrame) -> DataFrame:
    """lang, h and text of the sample.  Ranks are made without texts; only the chosen rows' texts are read.

    Copies are reduced in every task first, and a hot language is cut down in many tasks before one ranks the rest.
    """
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    ranked = rows.select("lang", "h", F.length("text").alias("n")).where(F.col("n") <= SAMPLE_TEXT_CHARS).distinct()
    key = [F.greatest("n", F.lit(SAMPLE_DOC_CHARS)), "h", "n"]
    for part in (["lang", F.pmod("h", F.lit(16))], ["lang"]):
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(*key))).where(F.col("place") <= SAMPLE_DOCS)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    chosen = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_CHARS).select("lang", "h")
    return rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])


def fit(docs: DataFrame) -> dict[str, list[str]]:
    """The teaching texts of docs(doc_id, text, lang) by language; a Model is made of them in each worker."""
    texts: dict[str, list[str]] = {}
    for r in sorted(teaching_rows(docs).collect(), key=lambda r: (r["lang"], r["h"])):  # bounded by the parameters above
        texts.setdefault(r["lang"], []).append(r["text"])
    return texts


def predict(docs: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of each row; only doc_id and text are read."""
    shared, name = share(docs.sparkSession, texts), uuid.uuid4().hex

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_worker("languages", name, lambda: Model(shared()))
        for whole in batches:
            for k in range(0, whole.num_rows, 3000):
                batch = whole.slice(k, 3000)
                names, scores = model.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return bound_batches(docs).select("doc_id", "text").mapInArrow(apply, "doc_id long, lang_pred string, score double")


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = fit(docs.select("doc_id", "text", "lang").where(~is_held_out(F.col("doc_id"))))
    found = predict(docs, texts)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
