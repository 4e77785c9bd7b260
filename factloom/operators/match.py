"""Matching runs: classify candidates, merge judgments, and keep what is stored idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import blocked
from .compare import classified, explanation, metadata, side

REVIEW_CONFIDENCE = 0.5
JUDGED_TYPES = ("CORROBORATES", "CONTRADICTS", "CONTEXTUAL_DIFFERENCE", "RELATED")
JUDGMENT = "relationship_type string, confidence string, explanation string"
REVIEW_ORDER = {"CONTRADICTS": 0, "CORROBORATES": 1, "RELATED": 2}


def relationship_id() -> Column:
    """Stable: the same pair has the same id in every run."""
    return F.concat_ws("~", "fact_a_id", "fact_b_id")


def scoped(facts: DataFrame, document_id: str | None = None, compare_with: list[str] | None = None) -> DataFrame:
    """The facts of a run: with compare_with those of the listed documents and of the document that is matched."""
    if compare_with is None:
        return facts
    return facts.where(F.col("document_id").isin([*compare_with, *([document_id] if document_id is not None else [])]))


def verdicts(facts: DataFrame, include_same_document: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Relationships of all eligible pairs (or of given ones) but unrelated ones, without a judge: those that need one are left for review."""
    return verdict_columns(typed(blocked(facts, include_same_document) if pairs is None else pairs))


def typed(pairs: DataFrame) -> DataFrame:
    """Classified pairs, all columns, without unrelated ones."""
    return classified(pairs).where("relationship_type <> 'UNRELATED'")


def verdict_columns(out: DataFrame) -> DataFrame:
    ask = F.col("needs_llm")
    return out.select(
        F.col("a_fact_id").alias("fact_a_id"), F.col("b_fact_id").alias("fact_b_id"), "relationship_type", "rule_id",
        F.when(ask, F.least("confidence", F.lit(REVIEW_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(ask, "NEEDS_REVIEW").otherwise("RESOLVED").alias("status"), F.when(ask, "llm_unavailable").alias("needs_review_reason"),
        explanation().alias("explanation"), metadata().alias("reasoning_metadata"),
    ).withColumn("relationship_id", relationship_id())


def unstored(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs that no stored relationship holds, before anything is computed for them."""
    return pairs.join(stored.select(F.col("fact_a_id").alias("a_fact_id"), F.col("fact_b_id").alias("b_fact_id")), ["a_fact_id", "b_fact_id"], "left_anti")


def with_excerpts(pairs: DataFrame, facts: DataFrame, evidence: DataFrame, most: int = 4, chars: int = 500) -> DataFrame:
    """Adds a_texts and b_texts: the first texts of each side's evidence, cut, in the order the fact names them. evidence: evidence_id, text."""
    named = facts.select("fact_id", F.posexplode("evidence_ids").alias("i", "evidence_id"))
    texts = named.join(evidence.select("evidence_id", F.substring("text", 1, chars).alias("text")), "evidence_id")
    lists = texts.groupBy("fact_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), 1, most).alias("texts"))
    none = F.array().cast("array<string>")
    for at in ("a", "b"):
        pairs = pairs.join(lists.select(F.col("fact_id").alias(f"{at}_fact_id"), F.col("texts").alias(f"{at}_texts")), f"{at}_fact_id", "left").withColumn(f"{at}_texts", F.coalesce(f"{at}_texts", none))
    return pairs


def new_only(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.join(stored.select("fact_a_id", "fact_b_id"), ["fact_a_id", "fact_b_id"], "left_anti")


def merged(stored: DataFrame, found: DataFrame, recompute: bool = False, purge_unrelated: bool = False) -> DataFrame:
    """What is stored after a run. Without recompute stored pairs stay; with it they are replaced and keep their id.

    A stored pair that is now unrelated stays as it is, unless purge_unrelated is set."""
    columns = [c for c in found.columns if c in stored.columns]
    if not recompute:
        return stored.select(columns).unionByName(new_only(found, stored).select(columns))
    now = with_old_ids(found, stored).select(columns)
    key = ["fact_a_id", "fact_b_id"]
    return now if purge_unrelated else now.unionByName(stored.select(columns).join(found.select(*key), key, "left_anti"))


def with_old_ids(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found, with the id under which a pair is stored."""
    both = found.join(stored.select("fact_a_id", "fact_b_id", F.col("relationship_id").alias("old")), ["fact_a_id", "fact_b_id"], "left")
    return both.withColumn("relationship_id", F.coalesce("old", "relationship_id")).drop("old")


def parsed_judgment(raw: Column) -> Column:
    """struct(relationship_type, confidence, explanation, error) of a judge's JSON text; error is null when it is valid."""
    j = F.from_json(raw, JUDGMENT)
    number = j["confidence"].try_cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & number.between(0, 1)
    error = F.when(raw.isNull() | j["relationship_type"].isNull() & j["confidence"].isNull() & j["explanation"].isNull(), "not an object with the expected keys").when(~F.coalesce(j["relationship_type"].isin(*JUDGED_TYPES), F.lit(False)), "relationship_type not allowed").when(~F.coalesce(ok & ~j["confidence"].isin("true", "false"), F.lit(False)), "confidence not in 0..1").when(F.trim(F.coalesce(j["explanation"], F.lit(""))) == "", "explanation missing")
    return F.struct(j["relationship_type"].alias("relationship_type"), number.alias("confidence"), j["explanation"].alias("explanation"), error.alias("error"))


def judged(found: DataFrame, judgments: DataFrame) -> DataFrame:
    """found with judgments (fact_a_id, fact_b_id, raw, and maybe error: why there is none) applied to the pairs that wait for one.

    A pair whose judgment failed or can't be read keeps waiting, with the reason."""
    failure = F.col("error") if "error" in judgments.columns else F.lit(None).cast("string")
    j = judgments.select("fact_a_id", "fact_b_id", parsed_judgment(F.col("raw")).alias("j"), failure.alias("failure"))
    out = found.join(j, ["fact_a_id", "fact_b_id"], "left")
    wait = F.col("status") == "NEEDS_REVIEW"
    valid = wait & F.col("failure").isNull() & F.col("j.error").isNull() & F.col("j.relationship_type").isNotNull()
    withheld = F.coalesce(F.col("reasoning_metadata.withheld_verdict") == F.col("j.relationship_type"), F.lit(False))
    capped = F.when(F.col("reasoning_metadata.match_tier") == "weak", F.least("confidence", F.col("j.confidence"))).otherwise(F.col("j.confidence"))
    return out.withColumns({
        "llm_overruled": F.when(valid & withheld, F.col("j.relationship_type")),
        "relationship_type": F.when(valid & ~withheld, F.col("j.relationship_type")).otherwise(F.col("relationship_type")),
        "confidence": F.when(valid, capped).otherwise(F.col("confidence")),
        "explanation": F.when(valid, F.col("j.explanation")).otherwise(F.col("explanation")),
        "status": F.when(valid, "RESOLVED").otherwise(F.col("status")),
        "needs_review_reason": F.when(valid, None).when(wait & F.col("failure").isNotNull(), F.col("failure")).when(wait & F.col("j.error").isNotNull(), F.concat(F.lit("JudgmentError: "), F.col("j.error"))).otherwise(F.col("needs_review_reason")),
    }).drop("j", "failure")


def touching(relationships: DataFrame, facts: DataFrame, document_id: str, relationship_type: str | None = None, least: float = 0.0) -> DataFrame:
    """Relationships with a fact of the document on either side."""
    own = facts.where(F.col("document_id") == document_id).select(F.col("fact_id").alias("id"))
    a = relationships.join(own, F.col("fact_a_id") == F.col("id"), "left_semi")
    b = relationships.join(own, F.col("fact_b_id") == F.col("id"), "left_semi").join(own, F.col("fact_a_id") == F.col("id"), "left_anti")
    out = a.unionByName(b).where(F.col("confidence") >= least)
    return out if relationship_type is None else out.where(F.col("relationship_type") == relationship_type)


def detailed(relationships: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relationships with both facts (a_*, b_*) and the evidence that each names, as far as it is stored, in its order."""
    named = facts.select("fact_id", F.posexplode("evidence_ids").alias("i", "evidence_id")).join(evidence.select("evidence_id", "page", "type", "text"), "evidence_id")
    lists = named.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "evidence_id", "page", "type", "text"))), lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["page"].alias("page"), x["type"].alias("type"), x["text"].alias("text"))).alias("evidence"))
    out = relationships
    for at in ("a", "b"):
        own = facts.join(lists, "fact_id", "left")
        out = out.join(side(own, at), F.col(f"{at}_fact_id") == F.col(f"fact_{at}_id")).withColumn(f"{at}_evidence", F.coalesce(f"{at}_evidence", F.array().cast("array<struct<evidence_id:string,page:int,type:string,text:string>>")))
    return out


def review_order(relationships: DataFrame, page: int = 300) -> DataFrame:
    rank = F.coalesce(*(F.when(F.col("relationship_type") == t, r) for t, r in REVIEW_ORDER.items()), F.lit(3))
    return relationships.withColumn("review_rank", rank).orderBy("review_rank", F.desc("confidence"), "relationship_id").limit(page)
