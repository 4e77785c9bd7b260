"""From drafted claims to facts: provenance, kinds, numbers, periods, flags; normalisation; duplicates; JSON repair."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.numbers import normalized, parse_number, resolved_kind
from factloom.functions.periods import parse_time
from factloom.functions.text import canonical_name, present, strip, unfenced

from .compare import comparability, missing

IDENTITY = ("document_id", "subject", "predicate", "value_kind", "value_text", "unit", "time_text", "scope_text", "geography", "evidence_ids")
DRAFTS = "struct<drafts:array<struct<subject:string,predicate:string,value_text:string,value_kind:string,unit:string,time_text:string,scope_text:string,estimate_status:string,geography:string,evidence_ids:array<string>,confidence:double,ambiguous:boolean>>>"
LEAST_BUDGET = 500


def nonblank(c: str) -> Column:
    return F.when(present(F.col(c)), strip(F.col(c)))


def facts(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """drafts: draft_id, document_id, chunk_id and the drafted fields; known: chunk_id, ids. Adds a fact's columns and `rejected`.

    A draft is rejected for evidence outside its chunk, or a blank subject or predicate; all else is kept and flagged."""
    d = drafts.join(known, "chunk_id", "left").withColumn("outside", F.array_except("evidence_ids", F.coalesce("ids", F.array().cast("array<string>"))))
    d = d.withColumn("n", parse_number(F.col("value_text"))).withColumn("t", parse_time(F.col("time_text")))
    d = d.withColumn("k", resolved_kind(F.col("value_text"), F.col("value_kind"), F.col("n")))
    numeric = F.col("k.kind") != "TEXT"
    flags = F.concat(F.col("k.flags"), F.array_compact(F.array(
        F.when(numeric & strip(F.col("value_text")).rlike(r"^[A-Za-z] [0-9,.]"), "currency_symbol_suspect"), F.when(numeric & F.col("n").isNull(), "value_unparseable"),
        F.when(present(F.col("time_text")) & (F.col("t.kind") == "UNKNOWN"), "time_unparsed"), F.when(F.col("ambiguous"), "llm_flagged_ambiguous"),
    )))
    rejected = F.when(F.size("outside") > 0, F.concat(F.lit("unknown evidence IDs: "), F.array_join("outside", ", "))).when(~present(F.col("subject")) | ~present(F.col("predicate")), "blank subject or predicate")
    return d.select(
        "draft_id", "document_id", strip(F.col("subject")).alias("subject"), strip(F.col("predicate")).alias("predicate"), F.col("k.kind").alias("value_kind"), strip(F.col("value_text")).alias("value_text"),
        F.when(numeric, F.col("n")).alias("value_number"), nonblank("unit").alias("unit"), strip(F.col("time_text")).alias("time_text"), F.col("t.kind").alias("time_kind"), F.col("t.start").alias("time_start"), F.col("t.end").alias("time_end"),
        nonblank("scope_text").alias("scope_text"), F.coalesce("estimate_status", F.lit("UNKNOWN")).alias("estimate_status"), nonblank("geography").alias("geography"), F.array_distinct("evidence_ids").alias("evidence_ids"),
        F.col("confidence").alias("extraction_confidence"), flags.alias("ambiguity_flags"), F.when(F.size(flags) > 0, "AMBIGUOUS").otherwise("CONFIRMED").alias("status"), rejected.alias("rejected"),
    )


def distinct_facts(rows: DataFrame, key: str = "draft_id") -> DataFrame:
    """One row of each identity, that of the smallest key; the order of evidence doesn't matter, and null equals null."""
    identity = [F.array_sort(c) if c == "evidence_ids" else F.col(c) for c in IDENTITY if c in rows.columns]
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*identity).orderBy(key))).where("r = 1").drop("r")


def split_new(made: DataFrame, stored: DataFrame | None = None, key: str = "draft_id") -> DataFrame:
    """Valid facts of a run (key, IDENTITY, fact_id) with `kept_id` and `is_new`: the fact that stands for this identity, stored before or first in the run."""
    identity = [F.array_sort(c) if c == "evidence_ids" else F.col(c) for c in IDENTITY]
    marked = made.withColumn("identity", F.sha2(F.to_json(F.struct(*(c.alias(n) for c, n in zip(identity, IDENTITY))), {"ignoreNullFields": "false"}), 256))
    first = marked.groupBy("identity").agg(F.min_by("fact_id", key).alias("first_id"), F.min(key).alias("first_key"))
    out = marked.join(first, "identity")
    if stored is None:
        return out.select(made.columns + [F.col("first_id").alias("kept_id"), (F.col(key) == F.col("first_key")).alias("is_new")])
    old = stored.select(F.col("fact_id").alias("old_id"), F.sha2(F.to_json(F.struct(*(c.alias(n) for c, n in zip(identity, IDENTITY))), {"ignoreNullFields": "false"}), 256).alias("identity")).groupBy("identity").agg(F.min("old_id").alias("old_id"))
    out = out.join(old, "identity", "left")
    return out.select(made.columns + [F.coalesce("old_id", "first_id").alias("kept_id"), (F.col("old_id").isNull() & (F.col(key) == F.col("first_key"))).alias("is_new")])


def extraction_report(chunks: DataFrame, made: DataFrame) -> DataFrame:
    """Counts of a run by document. chunks: document_id, state (SKIPPED, CAPPED, FAILED, COMPLETED), error; made: document_id, rejected, is_new."""
    by_state = {"chunks_processed": "COMPLETED", "chunks_failed": "FAILED", "chunks_skipped": "SKIPPED", "chunks_capped": "CAPPED"}
    per = chunks.groupBy("document_id").agg(*(F.count_if(F.col("state") == v).alias(k) for k, v in by_state.items()), F.array_sort(F.collect_list("error")).alias("chunk_errors"))
    drafts = made.groupBy("document_id").agg(F.count_if(F.col("rejected").isNotNull()).alias("drafts_rejected"), F.count_if(F.col("rejected").isNull() & ~F.col("is_new")).alias("facts_skipped_duplicate"), F.count_if(F.col("rejected").isNull() & F.col("is_new")).alias("facts_saved"), F.array_sort(F.collect_list(F.concat(F.lit("rejected draft: "), F.col("rejected")))).alias("draft_errors"))
    none = F.array().cast("array<string>")
    out = per.join(drafts, "document_id", "left")
    return out.select("document_id", *by_state, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("drafts_rejected", "facts_skipped_duplicate", "facts_saved")), F.concat("chunk_errors", F.coalesce("draft_errors", none)).alias("errors"))


def replaced_flags(old: Column, fresh: Column) -> Column:
    """Flags of other origin in their order, then the fresh ones: running again changes nothing."""
    return F.concat(F.filter(F.coalesce(old, F.array().cast("array<string>")), lambda f: ~f.startswith("norm:")), fresh)


def normalise(rows: DataFrame) -> DataFrame:
    """Sets the five columns that normalisation owns: number, unit, both canonical names, and its flags."""
    out = rows.withColumn("z", normalized(F.col("value_kind"), F.col("value_number"), F.col("unit"), F.col("value_text")))
    return out.withColumns({"normalized_number": F.col("z.number"), "normalized_unit": F.col("z.unit"), "canonical_subject": canonical_name(F.col("subject")), "canonical_predicate": canonical_name(F.col("predicate")), "ambiguity_flags": replaced_flags(F.col("ambiguity_flags"), F.array_compact(F.array(F.col("z.flag"))))}).drop("z")


def normalization_report(rows: DataFrame) -> DataFrame:
    """Per document: processed, normalised and flagged facts, comparability, and what is missing how often."""
    r = rows.withColumns({"c": comparability(), "m": missing()})
    done = F.col("normalized_number").isNotNull() | F.col("canonical_subject").isNotNull() | F.col("canonical_predicate").isNotNull()
    counts = r.groupBy("document_id").agg(F.count("*").alias("facts_processed"), F.count_if(done).alias("facts_normalized"), F.count_if(F.exists("ambiguity_flags", lambda f: f.startswith("norm:"))).alias("facts_flagged"), F.count_if(F.col("c") == "COMPARABLE").alias("comparable"), F.count_if(F.col("c") == "PARTIAL").alias("partially_comparable"), F.count_if(F.col("c") == "NOT_COMPARABLE").alias("not_comparable"), *(F.count_if(F.array_contains("m", x)).alias(f"missing_{x}") for x in ("number", "unit", "period")))
    names = ("number", "unit", "period")
    return counts.withColumn("missing_counts", F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"missing_{n}")))), lambda _, n: n > 0))


def parsed_drafts(raw: Column) -> Column:
    """struct(drafts, error) of a model's answer. One bad draft fails the whole answer."""
    j = F.from_json(unfenced(raw), DRAFTS)
    bad = F.exists(j["drafts"], lambda d: ~F.coalesce((F.length(d["subject"]) > 0) & (F.length(d["predicate"]) > 0) & (F.length(d["value_text"]) > 0) & (F.size(d["evidence_ids"]) > 0) & d["confidence"].between(0, 1), F.lit(False)))
    error = F.when(j["drafts"].isNull(), "no drafts").when(bad, "invalid draft")
    return F.struct(F.when(error.isNull(), j["drafts"]).alias("drafts"), error.alias("error"))


def repair(text: str | None) -> str | None:
    """The longest part of cut-off JSON that parses once its containers are closed; as it is when there is none. Adds no values."""
    if text is None:
        return None
    text = text.strip()

    def good(candidate: str) -> bool:
        try:
            json.loads(candidate)
        except ValueError:
            return False
        return True

    if good(text):
        return text
    ends, closers, quoted, skip = [], "", False, False
    for i, c in enumerate(text):
        if quoted:
            if skip or c == "\\":
                skip = not skip
            elif c == '"':
                quoted = False
                ends.append((i + 1, closers))
        elif c == '"':
            quoted = True
        elif c in "{[":
            closers = "}]"[c == "["] + closers
        elif c in "}]":
            closers = closers[1:]
            ends.append((i + 1, closers))
    tries = [text + '"' + closers] if quoted else []
    tries += [text[:end] + rest for end, rest in reversed(ends)]
    return next((t for t in tries if good(t)), text)


@F.udf(T.StringType(), useArrow=True)
def repaired(text: str) -> str:
    return repair(text)


def token_budget(context: int, reserved: int, overhead: int, margin: int) -> int:
    """Tokens left for evidence in a request."""
    left = context - reserved - overhead - margin
    if left < LEAST_BUDGET:
        raise ValueError(f"only {left} tokens are left for evidence; {LEAST_BUDGET} are needed")
    return left


def embedding_text() -> Column:
    """A fact in one line for embedding; missing parts keep their slot."""
    parts = (F.coalesce(F.nullif(F.col("canonical_subject"), F.lit("")), "subject"), F.coalesce(F.nullif(F.col("canonical_predicate"), F.lit("")), "predicate"), F.coalesce("normalized_unit", "unit"), F.col("time_text"), F.col("scope_text"), F.col("value_text"))
    return F.concat_ws(" | ", *(F.coalesce(p, F.lit("")) for p in parts))
