"""A training-data pipeline: the stages run one after another, each on all that the one before kept.

run(spark, sf_dir) applies STAGES to documents; what a stage returns is written as Parquet in the shared folder and
read again as the next one's input. All but the last stage return the columns of documents; the last returns
one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import cut, table
from factloom.llm.exact import drop_copies
from factloom.llm.near import drop_near
from factloom.llm.packing import pack
from factloom.llm.suffixes import without_repeats
from factloom.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model learned from the labels of these documents."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of smallest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row of smallest doc_id stays."""
    return drop_near(docs)


#: A passage goes if it is covered by repeated strings of so many bytes (51 words of the tables take 271 at least) and holds so many words.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand twice in what is left go from the texts; n_chars follows. Documents stay, if need be with empty text."""
    return without_repeats(docs, length=PASSAGE_BYTES, min_words=PASSAGE_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Learned scores, alignment and tokenising are beyond SQL; tests/llm/test_models.py holds run() against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Null and empty texts are kept as one document (they are equal); ties go to the smallest id; without documents there are no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
