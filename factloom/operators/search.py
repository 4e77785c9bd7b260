"""Hybrid search over facts: a lexical pool and a vector pool, merged. Read only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import combine
from factloom.functions.text import jaccard, tokens
from factloom.functions.vectors import cosine

LIMIT, POOL, LEAST_POOL = 20, 5, 50


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case tokens in order."""
    if not query.strip():
        raise ValueError("the query is blank")
    return list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))


def pool_size(limit: int) -> int:
    return max(POOL * limit, LEAST_POOL)


def lexical_pool(facts: DataFrame, query: str, limit: int = LIMIT, document_id: str | None = None) -> DataFrame:
    """Facts that hold any token as a substring, the first of them by id, scored by shared tokens. The cut by id comes first."""
    q = query_tokens(query)
    base = facts if document_id is None else facts.where(F.col("document_id") == document_id)
    text = [F.lower(F.coalesce(c, F.lit(""))) for c in ("subject", "predicate", "value_text", "unit")]
    hit = F.lit(False)
    for t in q:
        for c in text:
            hit = hit | F.contains(c, F.lit(t))
    pool = base.where(hit).orderBy("fact_id").limit(pool_size(limit))
    words = tokens(F.concat_ws(" ", "subject", "predicate", "value_text", F.coalesce("unit", F.lit(""))))
    return pool.select("fact_id", jaccard(words, F.array(*map(F.lit, q)).cast("array<string>")).alias("lexical"))


def vector_pool(vectors: DataFrame, query: list[float], limit: int = LIMIT) -> DataFrame:
    """vectors: fact_id, v. The nearest by cosine, ties by id; scores below 0 count as 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("fact_id", cosine(F.col("v"), q).alias("cos"))
    return scored.orderBy(F.desc("cos"), "fact_id").limit(pool_size(limit)).select("fact_id", F.greatest(F.lit(0.0), "cos").alias("vector"))


def hits(lexical: DataFrame, vector: DataFrame | None, limit: int = LIMIT, min_score: float = 0.0) -> DataFrame:
    both = lexical.withColumn("vector", F.lit(None).cast("double")) if vector is None else lexical.join(vector, "fact_id", "full")
    scored = both.withColumn("s", combine(F.col("lexical"), F.col("vector"))).where(F.col("s").isNotNull() & (F.col("s.score") > 0) & (F.col("s.score") >= min_score))
    return scored.select("fact_id", F.col("s.score").alias("score"), F.col("s.match").alias("match_kind")).orderBy(F.desc("score"), "fact_id").limit(limit)


def hydrated(found: DataFrame, facts: DataFrame, evidence: DataFrame, relationships: DataFrame) -> DataFrame:
    """Hits with their document, evidence that exists, and the relationships that touch them, both by id."""
    own = found.join(facts.select("fact_id", "document_id", "evidence_ids"), "fact_id")
    seen = own.select("fact_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id").groupBy("fact_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence"))
    ends = relationships.select("relationship_id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id"))
    rels = ends.join(found.select("fact_id"), "fact_id").groupBy("fact_id").agg(F.array_sort(F.collect_list("relationship_id")).alias("relationships"))
    none = F.array().cast("array<string>")
    return own.join(seen, "fact_id", "left").join(rels, "fact_id", "left").select("fact_id", "score", "match_kind", "document_id", F.coalesce("evidence", none).alias("evidence"), F.coalesce("relationships", none).alias("relationships"))
