"""Context comparison and the ordered classification of pairs of facts.

`prepared` computes, once for each fact, all that pairs need; `paired` puts two prepared sides next to each other
(columns a_* and b_*); `classified` adds the verdict. Dimensions are COMPATIBLE, INCOMPATIBLE or UNKNOWN; null never
stands for UNKNOWN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import TOLERANCE, relative_difference
from factloom.functions.periods import compare_time
from factloom.functions.text import content_tokens, folded, jaccard, present, strip, tokens

DIMENSIONS = ("entity", "predicate", "unit", "time", "estimate_status", "geography", "scope")
OVERLAP_FROM, CLAIM_FROM, SUBJECT_FROM = 0.2, 0.6, 0.5
#: Rule: (relationship type, needs judgment). Confidence is below.
RULES = {"R1": ("CORROBORATES", False), "R2": ("RELATED", True), "R3": ("CORROBORATES", True), "R4a": ("RELATED", True), "R4b": ("CONTRADICTS", False), "R5a": ("RELATED", True), "R5b": ("CONTRADICTS", True), "R6": ("CONTEXTUAL_DIFFERENCE", False), "R7": ("RELATED", True), "R8": ("RELATED", False), "R9": ("UNRELATED", False)}


def effective(canonical: str, raw: str) -> Column:
    """The canonical form, or the raw one where it is null or empty."""
    return F.coalesce(F.nullif(F.col(canonical), F.lit("")), F.nullif(F.col(raw), F.lit("")))


def effective_unit() -> Column:
    """The normalised unit wherever there is one, even an empty one."""
    return F.coalesce("normalized_unit", "unit")


def missing() -> Column:
    """What a fact lacks for numeric comparison: number, unit, period, in this order."""
    return F.array_compact(F.array(F.when(F.col("normalized_number").isNull(), "number"), F.when(~present(F.col("normalized_unit")), "unit"), F.when(F.col("time_kind") == "UNKNOWN", "period")))


def comparability() -> Column:
    number, rest = F.col("normalized_number").isNotNull(), present(F.col("normalized_unit")).cast("int") + (F.col("time_kind") != "UNKNOWN").cast("int")
    return F.when(number & (rest == 2), "COMPARABLE").when(number & (rest == 1), "PARTIAL").otherwise("NOT_COMPARABLE")


def prepared(facts: DataFrame) -> DataFrame:
    raw = F.concat_ws(" ", "subject", "predicate")
    out = settled(facts, {"entity": effective("canonical_subject", "subject"), "claim": effective("canonical_predicate", "predicate"), "eff_unit": effective_unit(), "comparability": comparability(), "missing": missing()})
    return settled(out, {"raw_tokens": tokens(raw), "raw_content": content_tokens(raw), "claim_content": content_tokens(F.concat_ws(" ", "entity", "claim")), "subject_content": content_tokens(F.col("entity"))})


def side(facts: DataFrame, name: str) -> DataFrame:
    return facts.select([F.col(c).alias(f"{name}_{c}") for c in facts.columns])


def same(a: Column, b: Column) -> Column:
    """Tri-state equality of two texts."""
    return F.when(~present(a) | ~present(b), "UNKNOWN").when(folded(a) == folded(b), "COMPATIBLE").otherwise("INCOMPATIBLE")


def both(name: str) -> tuple[Column, Column]:
    return F.col(f"a_{name}"), F.col(f"b_{name}")


def numeric_verdict(tolerance: float = TOLERANCE) -> Column:
    (x, y), (u, v) = both("normalized_number"), both("normalized_unit")
    usable = (F.col("a_value_kind") != "TEXT") & (F.col("b_value_kind") != "TEXT") & x.isNotNull() & y.isNotNull() & F.coalesce(u == v, F.lit(False))
    r = relative_difference(x, y)
    return F.when(~usable, "INCOMPARABLE").when(r == 0, "EXACT").when(r <= tolerance, "APPROXIMATE").otherwise("DIFFERENT")


def dimensions() -> dict[str, Column]:
    def period(s: str) -> dict[str, Column]:
        return {"kind": F.col(f"{s}_time_kind"), "text": F.col(f"{s}_time_text"), "start": F.col(f"{s}_time_start"), "end": F.col(f"{s}_time_end")}

    a, b = (F.coalesce(c, F.lit("UNKNOWN")) for c in both("estimate_status"))
    status = F.when((a == "UNKNOWN") | (b == "UNKNOWN"), "UNKNOWN").when(a == b, "COMPATIBLE").otherwise("INCOMPATIBLE")
    return {"entity": same(*both("entity")), "predicate": same(*both("claim")), "unit": same(*both("eff_unit")), "time": compare_time(period("a"), period("b")), "estimate_status": status, "geography": same(*both("geography")), "scope": same(*both("scope_text"))}


def of_verdict(verdict: str, names=DIMENSIONS) -> Column:
    return F.array_compact(F.array(*(F.when(F.col(f"d_{n}") == verdict, n) for n in names)))


def strong_match() -> Column:
    (s, t), (p, q), (k, m), (u, v) = both("canonical_subject"), both("canonical_predicate"), both("value_kind"), both("eff_unit")
    return F.coalesce((s == t) & (p == q) & (k == m), F.lit(False)) & u.eqNullSafe(v)


def weak_match() -> Column:
    """Needs strong_match and claim_similarity."""
    a, b = both("subject_content")
    kinds = F.col("a_value_kind").isin("NUMERIC", "PERCENTAGE") & F.col("b_value_kind").isin("NUMERIC", "PERCENTAGE")
    return ~F.col("strong_match") & kinds & F.col("a_eff_unit").eqNullSafe(F.col("b_eff_unit")) & (F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= SUBJECT_FROM) & (F.col("claim_similarity") >= CLAIM_FROM)


def semantic_overlap() -> Column:
    (s, t), (p, q) = both("canonical_subject"), both("canonical_predicate")
    return (jaccard(*both("raw_tokens")) >= OVERLAP_FROM) | (same(s, t) == "COMPATIBLE") | (same(p, q) == "COMPATIBLE")


def same_claim() -> Column:
    (s, t), (p, q) = both("canonical_subject"), both("canonical_predicate")
    return ((same(s, t) == "COMPATIBLE") & (same(p, q) == "COMPATIBLE")) | ((F.col("d_entity") == "COMPATIBLE") & (F.col("d_predicate") == "COMPATIBLE"))


def blocked_reason() -> Column:
    """Why a pair may not be called a contradiction; null where it may."""
    def lacks(s: str) -> Column:
        return F.when(F.col(f"{s}_comparability") != "COMPARABLE", F.concat(F.lit(f"fact {s.upper()} is not comparable (missing: "), F.array_join(f"{s}_missing", ", "), F.lit(")")))

    one_sided = present(F.col("a_scope_text")) != present(F.col("b_scope_text"))
    return F.coalesce(lacks("a"), lacks("b"), F.when(F.col("d_time") != "COMPATIBLE", "period not stated and equal on both sides"), F.when(one_sided, "scope stated on only one side"))


def rule() -> Column:
    """The first rule that holds; their order is what they mean."""
    v, strong, weak = F.col("numeric_verdict"), F.col("strong_match"), F.col("weak_match")
    equal, different = v.isin("EXACT", "APPROXIMATE"), v == "DIFFERENT"
    none, context_free = F.size("incompatible") == 0, F.size(F.array_except("incompatible", F.array(F.lit("entity"), F.lit("predicate")))) == 0
    blocked, grounded = F.col("blocked_reason").isNotNull(), F.col("claims_comparable") & F.col("grounded")
    return (
        F.when(equal & none & strong, "R1")
        .when(equal & none & F.col("semantic_overlap"), "R2")
        .when(equal & context_free & weak, "R3")
        .when(different & none & strong & blocked, "R4a")
        .when(different & none & strong, "R4b")
        .when(different & context_free & weak & blocked, "R5a")
        .when(different & context_free & weak, "R5b")
        .when(~none & grounded, "R6")
        .when((v == "INCOMPARABLE") & none & strong, "R7")
        .when(grounded, "R8")
        .otherwise("R9")
    )


def confidence() -> Column:
    r, some = F.col("rule_id"), F.size("unknown") > 0
    return (
        F.when(r == "R1", F.when(F.col("numeric_verdict") == "EXACT", 0.95).otherwise(0.9))
        .when(r.isin("R2", "R7", "R8"), 0.5)
        .when(r.isin("R3", "R5b"), F.when(some, 0.5).otherwise(0.6))
        .when(r.isin("R4a", "R5a"), 0.4)
        .when(r == "R4b", F.when(some, 0.7).otherwise(0.85))
        .when(r == "R6", 0.75)
        .otherwise(0.9)
    )


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once, however often later ones refer to them.

    Neighbouring projections are merged by the optimizer and their expressions copied into every use; a one-element
    explode between them stops that at no cost."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_s")).select(*df.columns, "_s.*")


def compared(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds all predicates of a pair: d_*, numeric_verdict, matches and the reason against a contradiction."""
    out = settled(pairs, {f"d_{n}": c for n, c in dimensions().items()} | {"numeric_verdict": numeric_verdict(tolerance), "strong_match": strong_match(), "claim_similarity": jaccard(*both("claim_content")), "semantic_overlap": semantic_overlap(), "claims_comparable": jaccard(*both("raw_content")) >= OVERLAP_FROM})
    return settled(out, {"incompatible": of_verdict("INCOMPATIBLE"), "unknown": of_verdict("UNKNOWN"), "weak_match": weak_match(), "grounded": (F.col("numeric_verdict") != "INCOMPARABLE") | same_claim(), "blocked_reason": blocked_reason()})


def classified(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds rule_id, relationship_type, confidence and needs_llm to compared pairs."""
    out = settled(compared(pairs, tolerance), {"rule_id": rule()})
    types = F.create_map(*(F.lit(x) for r, (t, _) in RULES.items() for x in (r, t)))
    asks = [r for r, (_, ask) in RULES.items() if ask]
    return out.withColumns({"relationship_type": F.try_element_at(types, F.col("rule_id")), "confidence": confidence(), "needs_llm": F.col("rule_id").isin(*asks)})


def metadata() -> Column:
    """Of a classified pair, as one struct."""
    weak, withheld = F.col("rule_id").isin("R3", "R5a", "R5b"), F.col("rule_id").isin("R4a", "R5a")
    difference = F.when(F.col("numeric_verdict") != "INCOMPARABLE", relative_difference(*both("normalized_number")))
    return F.struct(
        F.col("numeric_verdict"), F.col("incompatible").alias("incompatible_dimensions"), F.col("unknown").alias("unknown_dimensions"),
        F.array_sort(of_verdict("COMPATIBLE")).alias("compatible_dimensions"), F.col("strong_match"), F.col("semantic_overlap"), difference.alias("relative_difference"),
        F.when(weak, F.bround("claim_similarity", 4)).alias("claim_similarity"), F.when(weak, "weak").alias("match_tier"),
        F.when(withheld, "CONTRADICTS").alias("withheld_verdict"), F.when(withheld, F.col("blocked_reason")).alias("withheld_reason"),
    )


def shown(c: Column) -> Column:
    return F.when(present(c), F.concat(F.lit("'"), c, F.lit("'"))).otherwise("missing")


def explanation() -> Column:
    """What led to a classified pair's verdict, in words: what each outcome rests on."""
    def listed(c: Column) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")

    x, y = both("normalized_number")
    numbers = F.when(F.col("numeric_verdict") == "INCOMPARABLE", "no shared normalized number and unit").otherwise(F.format_string("normalized %.4f vs %.4f %s, %s, relative difference %.4f", x, y, "a_normalized_unit", "numeric_verdict", relative_difference(x, y)))
    values = F.format_string("value '%s' and value '%s'", "a_value_text", "b_value_text")
    dims = F.concat(F.lit("compatible: "), listed(F.array_sort(of_verdict("COMPATIBLE"))), F.lit("; incompatible: "), listed(F.col("incompatible")), F.lit("; unknown: "), listed(F.col("unknown")))
    sides = {"entity": "entity", "predicate": "claim", "unit": "eff_unit", "time": "time_text", "estimate_status": "estimate_status", "geography": "geography", "scope": "scope_text"}
    differs = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"d_{d}") == "INCOMPATIBLE", F.concat(F.lit(f"{d} ("), shown(F.col(f"a_{c}")), F.lit(" vs "), shown(F.col(f"b_{c}")), F.lit(")"))) for d, c in sides.items()))), ", ")
    t, said = F.col("relationship_type"), F.concat(F.lit(" ("), numbers, F.lit(")"))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    aligned = F.when(F.col("strong_match"), "; entity, claim and unit are aligned").otherwise("; entity and unit are aligned, claims are alike")
    story = (
        F.when(t == "CORROBORATES", F.concat(F.lit(" agree"), said, F.lit("; "), dims, aligned, F.lit(" and no context stands against it")))
        .when(t == "CONTRADICTS", F.concat(F.lit(" differ materially"), said, F.lit(" in a context that nothing sets apart; "), dims, aligned, F.when(F.size("unknown") > 0, "; confidence is held down by what is unknown").otherwise("")))
        .when(t == "CONTEXTUAL_DIFFERENCE", F.concat(F.lit(" aren't to be equated"), said, F.lit("; their context differs on "), differs, F.lit("; they mean the same (strong match: "), yes("strong_match"), F.lit(", words in common: "), yes("semantic_overlap"), F.lit("), so the gap is put down to context")))
        .when(t == "RELATED", F.concat(F.lit(" share part of their meaning, but neither agree nor contradict"), said, F.lit("; "), dims, F.when(F.col("needs_llm"), "; to be reviewed").otherwise("")))
        .otherwise(F.concat(F.lit(" aren't aligned"), said, F.lit("; "), dims, F.lit("; no entity or claim in common")))
    )
    return F.concat(t, F.lit(": "), values, story)
