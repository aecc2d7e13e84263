"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (session, documents, table folder); all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it
again, so a lost executor never costs more than its stage.

Edge cases, in every stage: a null text counts as empty and stays null; null ids are documents of their own;
repeated rows are judged alike, and of those with one text one is left by the fourth stage; further columns are
carried on, whatever their names; empty tables, of labels too, give empty results or, without labels, keep what no
model rejects; texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import line_dedup, ngram_join, packing, quality_classifier, toxicity
from lexiloom.llm.common import read_table, stored, tune
from lexiloom.llm.queries import tokenizer

#: Classifiers and edit joins can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Empty texts show no sign of toxicity and stay."""
    return toxicity.keep(docs, read_table(tune(spark), sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Empty texts are judged like all others, by their
    statistics, which are 0; without labels every score is 0.5 and all stay."""
    return quality_classifier.keep(docs, read_table(tune(spark), sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go. A document that had words and has none left goes
    too; one that never had any stays."""
    tune(spark)
    return line_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8. Documents without
    words are no copies of one another and all stay; the smallest id stays, a null id only where there is no other."""
    tune(spark)
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids. An empty text is its end id alone."""
    tune(spark)
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
