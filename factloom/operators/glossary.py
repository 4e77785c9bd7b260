"""Names kept up to date while documents come and are replaced.

What each document defines is counted once and stored: abbreviations with their long forms, and what it calls itself. When
documents change, their old counts leave the corpus's totals and their new ones join them; only abbreviations among
these can get another long form. Names are rewritten where they hold a word whose long form has changed, or where
their document calls itself something else; all others stay. What is stored then equals a run over all texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import canonical_name

from . import canonical

DEFINITIONS = "document_id string, kind string, abbreviation string, long_form string, n bigint"
TOTALS = "abbreviation string, long_form string, n bigint"
MAP = "abbreviation string, long_form string"
SEEN = "document_id string, version string"
STAMPS = "fact_id string, stamp bigint"
FORM = ["abbreviation", "long_form"]


def changed(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that only one side has, or whose value differs."""
    both = now.select(key, F.col(value).alias("x"), F.lit(True).alias("here")).join(before.select(key, F.col(value).alias("y"), F.lit(True).alias("there")), key, "full")
    return both.where(F.col("here").isNull() | F.col("there").isNull() | ~F.col("x").eqNullSafe(F.col("y"))).select(key)


def definitions(texts: DataFrame) -> DataFrame:
    """texts: document_id, text. How often each document defines what: kind 'GENERAL' (an abbreviation) or 'SELF' (its own name, with an empty abbreviation)."""
    texts = texts.select("document_id", "text")
    general = canonical.alias_mentions(texts).select("document_id", F.lit("GENERAL").alias("kind"), *FORM)
    own = canonical.self_mentions(texts).select("document_id", F.lit("SELF").alias("kind"), F.lit("").alias("abbreviation"), F.col("name").alias("long_form"))
    return general.unionByName(own).groupBy("document_id", "kind", *FORM).agg(F.count("*").alias("n"))


def shifts(old: DataFrame, new: DataFrame) -> DataFrame:
    """abbreviation, long_form, n: by how much totals move when the definitions `old` are replaced by `new`; what stays isn't listed."""
    both = new.where("kind = 'GENERAL'").select(*FORM, "n").unionByName(old.where("kind = 'GENERAL'").select(*FORM, (-F.col("n")).alias("n")))
    return both.groupBy(FORM).agg(F.sum("n").alias("n")).where("n <> 0")


def totals(stored: DataFrame, moved: DataFrame) -> DataFrame:
    """New totals of all long forms of the abbreviations in `moved`; those that nothing defines any more are left out."""
    reached = stored.join(moved.select("abbreviation").distinct(), "abbreviation", "left_semi").select(*FORM, "n")
    return reached.unionByName(moved.select(*FORM, "n")).groupBy(FORM).agg(F.sum("n").alias("n")).where("n > 0")


def issuers(defined: DataFrame) -> DataFrame:
    """(document_id, issuer) from stored definitions."""
    return canonical.issuers(defined.where("kind = 'SELF'").select("document_id", F.col("long_form").alias("name"), "n"))


def words(facts: DataFrame) -> DataFrame:
    """fact_id, word: the words of a fact's names before any is replaced."""
    spoken = F.concat_ws(" ", canonical_name(F.col("subject")), canonical_name(F.col("predicate")))
    return facts.select("fact_id", F.explode(F.array_distinct(F.regexp_extract_all(spoken, F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))


def reached(facts: DataFrame, words_changed: DataFrame, documents_changed: DataFrame) -> DataFrame:
    """fact_id of facts that have one of these words (abbreviation) in a name, or that lie in one of these documents (document_id)."""
    by_word = words(facts).join(words_changed.select(F.col("abbreviation").alias("word")), "word", "left_semi").select("fact_id")
    return by_word.unionByName(facts.join(documents_changed, "document_id", "left_semi").select("fact_id")).distinct()


def stamped(facts: DataFrame) -> DataFrame:
    """fact_id, stamp: another one when anything in the row has changed."""
    return facts.select("fact_id", F.xxhash64(F.to_json(F.struct(*sorted(facts.columns)))).alias("stamp"))
