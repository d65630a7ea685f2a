"""A corpus in, token pieces out: the stages of the documents' pipeline.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; run() writes every stage's
result to the shared folder and reads it back as the next one's docs, so a lost executor repeats one stage at most.  What
a stage wrote besides is deleted when its result is there.

Defined cases: rows with a null doc_id take part in every stage (they teach nothing, come first among lines, and are never
dropped as near-duplicates); null and empty texts are judged like others, and texts without words are copies of each other;
repeated rows keep their lines, and rows of one id go or stay together as near-duplicates; texts of any length are taken
whole; ties go to the smaller id or the earlier line; further columns pass through whatever their names (the last
stage's results take the place of columns of their names); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rheolake.llm import decontaminate, line_dedup, quality, sentencepieces, simhash
from rheolake.llm.common import discard, scratch, shared_path, table

#: Near-duplicate stage: five-word shingles; texts whose sets of them have a Jaccard similarity of LEAST link.  Groups of
#: fingerprints that agree in 58 of 64 bits are candidates besides those of min-hashes.
SHINGLE, RADIUS, LEAST = 5, 6, (4, 5)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; a document whose every line was one goes."""
    return line_dedup.drop_repeated(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return simhash.drop_near_duplicates(docs, least=LEAST, shingle=SHINGLE, radius=RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur in the benchmark; a document of which no word is left goes."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, the N best segmentations, and the proof that decoding gives the text again."""
    return sentencepieces.encode_documents(docs, keep=tuple(docs.columns))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("sentencepieces", encoding_stage),
]

#: A trained classifier and XXH64 fingerprints stand in the chain, so SQL cannot express its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
