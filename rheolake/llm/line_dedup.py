"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

The unit is a line, whatever its length.  Lines are compared after trimming, word by word (words lie between single
spaces).  Two lines of at least ``NEAR_WORDS`` words match within one edited word (replaced, inserted or deleted), which
is nine words in ten; shorter ones only if equal.  Blank lines never match; ``min_chars`` can spare other short ones.  A
line goes if it matches one that comes earlier, by (doc_id, text hash, place in the text), whether that one stays or
not; so the earliest of all stays.

1. Equal units become one, with the first place of all (pre-aggregated, so a very common line costs nothing).
2. One edit leaves the first or the second half of a unit as it is.  Units that share no half with another one cannot
   match and go no further; this loses nothing and leaves few.
3. Those emit all variants with one word deleted, and themselves, as hashed keys.  Equal variants meet: units with the
   same word deleted differ in that word, and a unit equal to another one's variant lacks that word.  Of each set of
   equal variants only the earliest unit matters to the others, so no pairs are made within a set.
4. The edit distance of each found pair is verified on the words themselves.
5. The kept places go back to their documents, whose texts are put together again without the other units.

Defined cases: a null text stays null and an empty one stays empty; null document ids come first; rows equal in id and
text are one document, so they do not remove each other's lines; a text of which nothing is left becomes empty; texts and
lines of any length are compared whole; other columns pass through whatever their names, and only ones named n_units or
n_dropped give way to the results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rheolake.llm.common import materialize, packed, table

#: Lines with fewer characters never match; 1: all but blank lines take part.
MIN_CHARS = 1
NEAR_WORDS = 10
#: Words hashed by one running sum at least; a long line is cut into as many runs as a run has words.
RUN_WORDS = 64
#: So many candidate units (24 bytes each) at most are broadcast; more are joined by shuffling the documents.
BROADCAST_UNITS = 500_000
_PLACE = ("doc_id", "text_hash", "no")


def units_of(text: Column) -> Column:
    """The lines of a text, each with its end; put together they are the text and one line end."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.concat(line, F.lit("\n")))


def compared(unit: Column) -> Column:
    return F.btrim(unit, F.lit(" \t\r\n"))


def words_in(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "))) + 1


def _aligned(entries: Column, number, value, kind: str) -> Column:
    """An array with each entry's value at the entry's number, and nulls between; the entries are sorted."""
    gap = lambda e, j: number(e) - F.when(j == 0, -1).otherwise(number(F.get(entries, j - 1))) - 1
    fill = F.lit(None).cast(kind)
    return F.flatten(F.transform(entries, lambda e, j: F.concat(F.array_repeat(fill, gap(e, j)), F.array(value(e)))))


def _half_keys(norm: Column, n: Column) -> Column:
    """Hashes of the halves that a unit shares with another one within one edit: as the shorter, and as the longer."""

    def halves(size: Column) -> list[Column]:
        first = F.floor(size / 2).cast("int")
        head = F.call_function("substring_index", norm, F.lit(" "), first)
        tail = F.call_function("substring_index", norm, F.lit(" "), first - size)
        return [F.xxhash64(F.lit(1), size, head), F.xxhash64(F.lit(2), size, tail)]

    own, other = halves(n), halves(n - 1)
    return F.when(n > NEAR_WORDS, F.array(*own, *other)).when(n == NEAR_WORDS, F.array(*own))


def first_places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per distinct unit that can match: its hashes, words, halves and first place."""
    units = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(units_of(F.col("text"))).alias("no", "unit"))
    norms = units.select(*_PLACE, compared(F.col("unit")).alias("norm")).where(F.length("norm") >= max(1, min_chars))
    sized = norms.select(*_PLACE, "norm", words_in(F.col("norm")).alias("n"))
    keyed = sized.select(
        *_PLACE, F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2"), "n", _half_keys(F.col("norm"), F.col("n")).alias("halves")
    )
    first = keyed.groupBy("h1", "h2", "n").agg(F.min(F.struct(*_PLACE)).alias("at"), F.first("halves").alias("halves"))
    return materialize(first, "units")


def candidates(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Units that share a half with another one: place, hashes and words."""
    halves = units.where("halves IS NOT NULL").select("h1", "h2", "at", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    chosen = materialize(
        halves.join(shared, "half", "left_semi").select("at.*", "h1", "h2").distinct().groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_list(F.struct("no", F.struct("h1", "h2").alias("h")))).alias("wanted")),
        "candidates",
    )
    size = chosen.agg(F.sum(F.size("wanted"))).first()[0] or 0
    chosen = chosen.withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
    side = F.broadcast(chosen) if size <= BROADCAST_UNITS else chosen
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = rows.join(side, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")))
    hashes = _aligned(F.col("wanted"), lambda e: e["no"], lambda e: e["h"], "struct<h1:bigint,h2:int>")
    both = F.arrays_zip(units_of(F.col("text")).alias("unit"), hashes.alias("h"))
    unit = found.select("doc_id", "text_hash", F.posexplode(both).alias("no", "u")).select(*_PLACE, "u.*")
    # rows equal in id and text hold the same units: one of them is enough
    return materialize(
        unit.select(F.struct(*_PLACE).alias("at"), "h", compared(F.col("unit")).alias("norm"))
        .where("h IS NOT NULL").select("at", "h.h1", "h.h2", F.split("norm", " ", -1).alias("words"))
        .dropDuplicates(["h1", "h2"]),
        "texts",
    )


def near_pairs(texts: DataFrame) -> DataFrame:
    """(later, earlier): verified pairs within one edited word, from each later unit to the earliest of each variant it has."""
    n = F.size("words")
    at_place = lambda i, place: F.xxhash64(F.element_at("words", i), place)
    # Running hashes (exclusive or of hashed words and places) of the words up to i, at their places and one place before;
    # so a variant's hash takes three look-ups, however long the unit is.  They are made run by run and then joined, as
    # growing one array word by word would copy it each time.
    start = F.struct(F.array(F.lit(0).cast("long")).alias("own"), F.array(F.lit(0).cast("long")).alias("moved"))
    xor = lambda a, b: a.bitwiseXOR(b)
    step = lambda s, own, moved: F.struct(
        F.array_append(s["own"], xor(F.element_at(s["own"], -1), own)).alias("own"), F.array_append(s["moved"], xor(F.element_at(s["moved"], -1), moved)).alias("moved")
    )
    run = F.greatest(F.lit(RUN_WORDS), F.ceil(F.sqrt(n))).cast("int")
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")),
        lambda b: F.aggregate(F.sequence(b * run + 1, F.least((b + 1) * run, n)), start, lambda s, i: step(s, at_place(i, i), at_place(i, i - 1))),
    )
    once = lambda df, column, name: df.select(*[c for c in df.columns if c != "words"], F.explode(F.array(column)).alias(name))
    hashed = once(texts.select("h1", "h2", n.alias("n"), "words"), runs, "runs")
    last = lambda x, side: F.element_at(x[side], -1)
    hashed = once(hashed, F.aggregate("runs", start, lambda s, x: step(s, last(x, "own"), last(x, "moved"))), "before")

    def joined(side: str) -> Column:
        parts = F.zip_with("runs", F.slice(F.col("before")[side], 1, F.size("runs")), lambda x, o: F.transform(F.slice(x[side], 2, F.size(x[side]) - 1), lambda v: xor(v, o)))
        return F.concat(F.array(F.lit(0).cast("long")), F.flatten(parts))

    whole = once(hashed, F.struct(joined("own").alias("own"), joined("moved").alias("moved")), "s")
    running = whole.select("h1", "h2", "n", "s.own", "s.moved")
    n = F.col("n")
    variant = lambda i: F.get("own", i - 1).bitwiseXOR(F.get("moved", n)).bitwiseXOR(F.get("moved", i))
    itself = F.struct(F.lit(0).alias("i"), n.alias("left"), F.get("own", n).alias("key"))
    fewer = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), (n - 1).alias("left"), variant(i).alias("key")))
    every = running.select("h1", "h2", F.explode(F.concat(F.array(itself), fewer)).alias("v")).select("h1", "h2", "v.*")
    rows = materialize(every, "variants")
    met = rows.groupBy("key", "left").agg(F.count("*").alias("c")).where("c > 1").select("key", "left")
    unit = F.struct("at", "h1", "h2")
    shared = rows.join(met, ["key", "left"], "left_semi").join(texts.select("h1", "h2", "at"), ["h1", "h2"]).select("key", "left", "i", unit.alias("unit"))
    shared = materialize(shared, "shared-variants")
    least = shared.groupBy("key", "left", "i").agg(F.min("unit").alias("earliest"))
    replaced = shared.where("i > 0").join(least.where("i > 0"), ["key", "left", "i"]).select("unit", "earliest")
    # a unit that equals a variant (i = 0) against the earliest unit that has this variant, and the other way round
    whole = least.where("i = 0").select("key", "left", F.col("earliest").alias("whole")).where(F.col("left") >= NEAR_WORDS)
    longer = shared.where("i > 0").groupBy("key", "left").agg(F.min("unit").alias("earliest"))
    lacking = whole.join(longer, ["key", "left"]).select(F.col("whole").alias("unit"), "earliest")
    having = shared.where("i > 0").join(whole, ["key", "left"]).select("unit", F.col("whole").alias("earliest"))
    pairs = replaced.unionByName(lacking).unionByName(having).where("unit.at > earliest.at").distinct()
    words = lambda name: texts.select(F.col("h1").alias(f"{name}1"), F.col("h2").alias(f"{name}2"), F.col("words").alias(name))
    both = (
        pairs.select("unit", "earliest", F.col("unit.h1").alias("a1"), F.col("unit.h2").alias("a2"), F.col("earliest.h1").alias("b1"), F.col("earliest.h2").alias("b2"))
        .join(words("a"), ["a1", "a2"]).join(words("b"), ["b1", "b2"])
    )
    return both.where(within_one_word(F.col("a"), F.col("b"))).select(F.col("unit").alias("later"), "earliest")


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two lists of words are at most one replaced, inserted or deleted word apart."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    n = F.size(short)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.get(long, i - 1).eqNullSafe(F.get(short, i - 1)))
    p = F.coalesce(F.get(differ, F.lit(0)), n + 1)  # the first place where they differ
    rest = lambda x, start: F.slice(x, start, F.greatest(F.size(x) - start + 1, F.lit(0)))
    same_length = (F.size(long) == n) & (F.size(differ) <= 1)
    return same_length | ((F.size(long) == n + 1) & (rest(long, p + 1) == rest(short, p)))


def _deduped(docs: DataFrame, min_chars: int) -> DataFrame:
    """row (all columns of docs), n_units, n_dropped, and the new text."""
    places = docs.select("doc_id", "text")
    units = first_places(places, min_chars)
    later = near_pairs(candidates(places, units)).select("later.h1", "later.h2").distinct()
    kept = (
        units.join(later, ["h1", "h2"], "left_anti").select("at.*")
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("no")).alias("kept"))
        .withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_hash"})
    )
    rows = docs.select(packed(docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")), "left")
    flags = _aligned(F.coalesce("kept", F.array().cast("array<int>")), lambda no: no, lambda no: F.lit(True), "boolean")
    listed = F.zip_with(
        units_of(F.col("text")),
        flags,
        lambda unit, kept: F.struct(unit.alias("unit"), ((F.length(compared(unit)) < max(1, min_chars)) | F.coalesce(kept, F.lit(False))).alias("stays")),
    )
    parts = joined.select("row", "text", listed.alias("units"))
    left = F.filter("units", lambda u: u["stays"])
    text = F.regexp_replace(F.array_join(F.transform(left, lambda u: u["unit"]), ""), r"\n\z", "")
    unchanged = F.size(left) == F.size("units")
    return parts.select(
        "row",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("units")).cast("long").alias("n_units"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("units") - F.size(left)).cast("long").alias("n_dropped"),
        F.when(unchanged | F.col("text").isNull(), F.col("text")).otherwise(text).alias("line_text"),
    )


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of docs with the new text; n_chars, if there, follows it."""
    new = {"text": F.col("line_text")}
    if "n_chars" in docs.columns:
        length = F.length("line_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_dropped") > 0, length).otherwise(F.col("row").getField("n_chars"))
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text without the lines that match an earlier one, and n_units, n_dropped as further columns.

    n_chars, if there, follows the new text.
    """
    kept = [c for c, name in zip(_columns(docs), docs.columns, strict=True) if name.lower() not in ("n_units", "n_dropped")]
    return _deduped(docs, min_chars).select(*kept, "n_units", "n_dropped")


def drop_repeated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the new texts; a document of which every line that is not blank matched an earlier one goes."""
    emptied = (F.col("n_dropped") > 0) & ~F.col("line_text").rlike(r"\S")
    return _deduped(docs, min_chars).where(~F.coalesce(emptied, F.lit(False))).select(*_columns(docs))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_units", "n_dropped", F.md5("text").alias("text_md5"))


SQL = rf"""
WITH units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) || chr(10) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents),
norms AS (SELECT doc_id, no, unit, trim(unit, chr(32) || chr(9) || chr(13) || chr(10)) AS norm FROM units),
firsts AS (
  SELECT norm, string_split(norm, ' ') AS words, len(string_split(norm, ' ')) AS n, min((doc_id, no)) AS spot
  FROM norms WHERE length(norm) >= {MIN_CHARS} GROUP BY norm),
long AS (SELECT * FROM firsts WHERE n >= {NEAR_WORDS}),
pairs AS (
  SELECT a.norm AS x, b.norm AS y, a.words AS s, b.words AS l, a.spot AS sat, b.spot AS lat
  FROM long a JOIN long b ON b.n - a.n BETWEEN 0 AND 1 AND a.words[1 : a.n // 2] = b.words[1 : a.n // 2]
    AND a.words[1] = b.words[1] WHERE a.norm <> b.norm
  UNION
  SELECT a.norm, b.norm, a.words, b.words, a.spot, b.spot
  FROM long a JOIN long b ON a.words[-1] = b.words[-1] AND b.n - a.n BETWEEN 0 AND 1
    AND a.words[a.n // 2 + 1 :] = b.words[b.n - a.n + a.n // 2 + 1 :] WHERE a.norm <> b.norm),
near AS (
  SELECT * FROM pairs WHERE CASE WHEN len(s) = len(l)
    THEN len(list_filter(range(1, len(s) + 1), lambda i: s[i] <> l[i])) <= 1
    ELSE len(list_filter(range(1, len(l) + 1), lambda i: list_concat(l[1 : i - 1], l[i + 1 :]) = s)) > 0 END),
later AS (SELECT CASE WHEN sat > lat THEN x ELSE y END AS norm FROM near),
stays AS (
  SELECT doc_id, no, unit, length(norm) < {MIN_CHARS}
    OR ((doc_id, no) = spot AND norm NOT IN (SELECT norm FROM later)) AS stays
  FROM norms LEFT JOIN firsts USING (norm)),
texts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE NOT stays) AS n_dropped,
    coalesce(string_agg(unit, '' ORDER BY no) FILTER (WHERE stays), '') AS new
  FROM stays GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_dropped, 0) AS n_dropped,
  md5(CASE WHEN n_dropped > 0 THEN regexp_replace(new, '\n\z', '') ELSE text END) AS text_md5
FROM documents LEFT JOIN texts USING (doc_id)
"""
