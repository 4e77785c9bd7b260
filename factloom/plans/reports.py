"""Counts over facts, relationships and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.compare import comparability


def comparability_histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy(comparability().alias("comparability")).agg(F.count("*").alias("n"))


def verdict_histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy("relationship_type", "rule_id").agg(F.count("*").alias("n"))


def workspace(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """Facts, comparable facts and relationships of each document, and of all (document_id null); a relationship counts for each document it touches."""
    per = facts.groupBy("document_id").agg(F.count("*").alias("facts"), F.count_if(comparability() == "COMPARABLE").alias("comparable"))
    docs = facts.select(F.col("fact_id"), "document_id")
    ends = relationships.select("fact_a_id", "fact_b_id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id")).join(docs, "fact_id")
    rels = ends.groupBy("document_id").agg(F.countDistinct("fact_a_id", "fact_b_id").alias("relationships"))
    both = per.join(rels, "document_id", "left").select("document_id", "facts", "comparable", F.coalesce("relationships", F.lit(0)).alias("relationships"))
    return both.rollup("document_id").agg(*(F.sum(c).alias(c) for c in ("facts", "comparable", "relationships")))


def matching_report(evaluated: DataFrame, stored: DataFrame, found: DataFrame) -> DataFrame:
    """evaluated: one row, pairs. Pairs that were there already are skipped; unrelated ones are all that is left."""
    n = stored.agg(F.count("*").alias("skipped")), found.agg(F.count("*").alias("typed"))
    return evaluated.join(n[0], F.lit(True)).join(n[1], F.lit(True)).select((F.col("pairs") - F.col("skipped")).alias("evaluated"), "skipped", "typed", (F.col("pairs") - F.col("skipped") - F.col("typed")).alias("unrelated"))


def shown_number(number, unit) -> Column:
    """A number of ten significant digits with its unit."""
    return F.concat_ws(" ", F.format_string("%.10g", number), unit)


def badge(status: str = "status", metadata: str = "reasoning_metadata") -> Column:
    """Whether a verdict waits for review, and what was withheld and why."""
    withheld = F.concat(F.col(f"{metadata}.withheld_verdict"), F.lit(" withheld: "), F.col(f"{metadata}.withheld_reason"))
    return F.concat_ws("; ", F.when(F.col(status) == "NEEDS_REVIEW", "needs review"), withheld)


def flattened(metadata: str, fields: list[str]) -> Column:
    """Metadata as text by key; 'none' for empty lists and missing values."""
    def text(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))

    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(text(F.array_join(f"{metadata}.{f}", ", ") if f.endswith("dimensions") else F.col(f"{metadata}.{f}").cast("string")) for f in fields)))
