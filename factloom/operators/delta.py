"""Matching what has changed since the last run.

A run leaves a content hash of each fact beside its relationships. The next one compares hashes: facts that are new or
state something else meet all others by the usual blocking, pairs with a fact that has changed or gone lose their old
verdict, and all other verdicts stay as they are, judgments included. What is stored then equals a run from scratch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import candidates

#: What a verdict or its explanation reads of a fact.
STATED = (
    "document_id", "subject", "canonical_subject", "predicate", "canonical_predicate", "value_kind", "value_text", "unit", "normalized_number", "normalized_unit",
    "time_text", "time_kind", "time_start", "time_end", "scope_text", "estimate_status", "geography",
)
STATE = "fact_id string, fact_hash string"
PAIR = ["fact_a_id", "fact_b_id"]


def state(facts: DataFrame) -> DataFrame:
    """fact_id, fact_hash. Null and empty values differ; a column that isn't there counts as null."""
    have = [c for c in STATED if c in facts.columns]
    return facts.select("fact_id", F.sha2(F.to_json(F.struct(*have)), 256).alias("fact_hash"))


def difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """fact_id, change: NEW, CHANGED or GONE; facts that say what they said aren't listed."""
    both = now.join(before.select("fact_id", F.col("fact_hash").alias("old")), "fact_id", "full")
    change = F.when(F.col("old").isNull(), "NEW").when(F.col("fact_hash").isNull(), "GONE").when(F.col("old") != F.col("fact_hash"), "CHANGED")
    return both.select("fact_id", change.alias("change")).where("change is not null")


def untouched(relationships: DataFrame, changes: DataFrame) -> DataFrame:
    """Relationships without a fact that has changed or gone. Each join drops rows only, and can be split where one fact has many pairs."""
    ids = changes.select("fact_id")
    for side in PAIR:
        relationships = relationships.join(ids.withColumnRenamed("fact_id", side), side, "left_anti")
    return relationships


def pairs(facts: DataFrame, changes: DataFrame, stored: DataFrame, vectors: DataFrame | None = None, include_same_document: bool = False, up_to: int = candidates.EXHAUSTIVE_UP_TO, k: int = candidates.TOP_K, floor: float = candidates.FLOOR) -> tuple[DataFrame, DataFrame, str]:
    """(pairs to compare, relationships that stay, mode).

    While all pairs are compared ("exhaustive"), changed facts alone meet the others. Beyond `up_to` pairs the best candidates of
    each fact are chosen again, as a changed fact may push others out ("ranked"); of those, pairs are compared that a changed
    fact is part of or that aren't stored, and stored ones stay while they are among them."""
    kept = untouched(stored, changes)
    if candidates.space(facts, include_same_document).first().pairs <= up_to:
        return candidates.every_pair(up_to)(facts, include_same_document, touched=changes.where("change <> 'GONE'").select("fact_id")), kept, "exhaustive"
    ids = candidates.ranked(facts, facts, vectors, include_same_document, k, floor).select("a", "b")
    names = [F.col("a").alias("fact_a_id"), F.col("b").alias("fact_b_id")]
    kept = kept.join(ids.select(*names), PAIR, "left_semi")
    todo = ids.select("a", "b", *names).join(kept.select(*PAIR), PAIR, "left_anti").select("a", "b")
    return candidates.paired(facts, todo), kept, "ranked"


def counts(changes: DataFrame) -> Column:
    """For a report: how many facts are new, changed and gone."""
    return F.struct(*(F.count_if(F.col("change") == c).alias(c.lower()) for c in ("NEW", "CHANGED", "GONE")))
