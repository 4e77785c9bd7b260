"""Prompts as columns: for drafting facts from a chunk, and for judging a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import rendered

EXCERPTS, EXCERPT_CHARS = 4, 500
RULES = (
    "State only what the evidence below says; never infer a value.",
    "Cite the ids of the evidence that states each fact, and no others.",
    "Copy the value, the unit and the period as they are written.",
    "Mark a fact as ambiguous rather than guess.",
    'Answer with JSON alone: {"drafts": [{"subject", "predicate", "value_text", "value_kind", "unit", "time_text", "scope_text", "estimate_status", "geography", "evidence_ids", "confidence", "ambiguous"}]}',
)
JUDGE = 'Decide how the two facts relate. Answer with JSON alone: {"relationship_type": CORROBORATES, CONTRADICTS, CONTEXTUAL_DIFFERENCE or RELATED, "confidence": 0 to 1, "explanation"}'


def extraction(units: DataFrame) -> DataFrame:
    """units: chunk_id, item, evidence_id, type, text and, for cells, table_index, row, col, row_header, column_header. One prompt a chunk."""
    line = rendered(F.col("evidence_id"), F.col("type"), F.col("text"), F.col("table_index"), F.col("row"), F.col("col"), F.col("row_header"), F.col("column_header"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", line.alias("line")))), lambda x: x["line"]), "\n")
    return units.groupBy("chunk_id").agg(F.concat(F.lit("\n".join(RULES) + "\n\nEvidence:\n"), body).alias("prompt"))


def fact_line(side: str) -> Column:
    """The fields that a side of a pair states, by name."""
    names = ("subject", "predicate", "value_text", "unit", "normalized_number", "normalized_unit", "time_text", "scope_text", "estimate_status", "geography")
    return F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{side}_{n}").isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"{side}_{n}").cast("string"))) for n in names))), "; ")


def excerpts(texts: Column) -> Column:
    return F.array_join(F.transform(F.slice(texts, 1, EXCERPTS), lambda t: F.substring(t, 1, EXCERPT_CHARS)), "\n")


def judgment(pairs: DataFrame) -> DataFrame:
    """pairs: classified, with a_texts and b_texts (evidence). Adds prompt."""
    dims = F.concat(F.lit("numeric: "), F.col("numeric_verdict"), F.lit("; incompatible: "), F.array_join("incompatible", ", "), F.lit("; unknown: "), F.array_join("unknown", ", "))
    parts = [F.lit(JUDGE), F.concat(F.lit("A: "), fact_line("a")), F.concat(F.lit("B: "), fact_line("b")), dims, F.concat(F.lit("Evidence of A:\n"), excerpts(F.col("a_texts"))), F.concat(F.lit("Evidence of B:\n"), excerpts(F.col("b_texts")))]
    return pairs.withColumn("prompt", F.concat_ws("\n", *parts))
