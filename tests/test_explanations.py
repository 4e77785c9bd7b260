"""What each outcome of a pair says of itself."""

import re

from factloom.operators import compare as cmp
from factloom.operators.candidates import blocked
from factloom.plans.pairs import facts

VALUES = r"value '[^']*' and value '[^']*' "
NUMBERS = r"\((no shared normalized number and unit|normalized -?\d+\.\d{4} vs -?\d+\.\d{4} [^,]+, [A-Z_]+, relative difference \d+\.\d{4})\)"
DIMS = r"; compatible: [a-z_, ]+; incompatible: ([a-z_, ]+); unknown: ([a-z_, ]+)"
SHAPES = {
    "CORROBORATES": f"CORROBORATES: {VALUES}agree {NUMBERS}{DIMS}(; entity, claim and unit are aligned|; entity and unit are aligned, claims are alike) and no context stands against it",
    "CONTRADICTS": f"CONTRADICTS: {VALUES}differ materially {NUMBERS} in a context that nothing sets apart{DIMS}(; entity, claim and unit are aligned|; entity and unit are aligned, claims are alike)(; confidence is held down by what is unknown)?",
    "CONTEXTUAL_DIFFERENCE": f"CONTEXTUAL_DIFFERENCE: {VALUES}aren't to be equated {NUMBERS}; their context differs on (.+); they mean the same \\(strong match: (yes|no), words in common: (yes|no)\\), so the gap is put down to context",
    "RELATED": f"RELATED: {VALUES}share part of their meaning, but neither agree nor contradict {NUMBERS}{DIMS}(; to be reviewed)?",
    "UNRELATED": f"UNRELATED: {VALUES}aren't aligned {NUMBERS}{DIMS}; no entity or claim in common",
}


def test_each_outcome_says_what_it_rests_on(spark, sf):
    rows = cmp.classified(blocked(facts(spark, sf))).select("relationship_type", "needs_llm", "unknown", "incompatible", "strong_match", cmp.explanation().alias("x")).dropDuplicates(["relationship_type", "needs_llm", "unknown", "incompatible", "strong_match"]).collect()
    assert {r.relationship_type for r in rows} == set(SHAPES)
    for r in rows:
        said = re.fullmatch(SHAPES[r.relationship_type], r.x)
        assert said, r.x
        if r.relationship_type == "CONTRADICTS":
            assert said[2] in ("none", "predicate") and ("claims are alike" in said[4]) == (not r.strong_match)
            assert (said[5] is not None) == bool(r.unknown) == (said[3] != "none")
        if r.relationship_type == "CONTEXTUAL_DIFFERENCE":
            assert all(f"{d} (" in said[2] for d in r.incompatible) and said[3] == ("yes" if r.strong_match else "no")
        if r.relationship_type == "RELATED":
            assert (said[4] is not None) == r.needs_llm
