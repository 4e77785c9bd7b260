"""Pairs by rule against the full product, and words that all facts hold."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import fact, table

from factloom.operators import candidates, compare

WORDS = ["alpha", "beta", "gamma", "delta", "net", "gross", "income", "revenue", "growth", "of", "the", "total", "reported", "per", "share"]


def made(spark, rng, n):
    pick = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, k)))
    rows = []
    for i in range(n):
        subject, predicate = pick(4), pick(5)
        rows.append(fact(f"f{i:03d}", f"d{i % 3}", subject=rng.choice([subject, None, " "]) if rng.random() < 0.2 else subject, predicate=predicate, canonical_subject=rng.choice([subject, subject.upper(), None, "", "alpha"]), canonical_predicate=rng.choice([predicate, None, "", "income"]), normalized_number=rng.choice([1.0, 1.005, 2.0, None]), normalized_unit=rng.choice(["count", "count", None]), value_kind=rng.choice(["NUMERIC", "NUMERIC", "TEXT"]), time_text=rng.choice(["FY24", "FY23"]), geography=rng.choice(["x", None]), scope_text=rng.choice([None, "s"])))
    return table(spark, rows)


def verdicts(pairs):
    return sorted((r.a_fact_id, r.b_fact_id, r.rule_id) for r in compare.classified(pairs).where("rule_id <> 'R9'").select("a_fact_id", "b_fact_id", "rule_id").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_no_verdict_is_lost(spark, seed):
    facts = made(spark, random.Random(seed), 110).cache()
    p = compare.prepared(facts)
    for same in (False, True):
        every = compare.side(p, "a").join(compare.side(p, "b"), candidates.eligible(same))
        want = verdicts(every)
        assert verdicts(candidates.related(facts, same)) == want and len({r for *_, r in want}) >= 6
    own = facts.where("fact_id < 'f020'").select("fact_id")
    assert verdicts(candidates.related(facts, touched=own)) == [v for v in verdicts(every.where("a_document_id <> b_document_id")) if v[0] < "f020" or v[1] < "f020"]
    doc = {r.fact_id for r in facts.where("document_id = 'd1'").collect()}
    assert verdicts(candidates.related(facts, document_id="d1")) == [v for v in verdicts(every.where("a_document_id <> b_document_id")) if v[0] in doc or v[1] in doc]
    facts.unpersist()


def test_a_word_in_all_facts_brings_few_together(spark):
    names = [f"w{i}a w{i}b w{i}c w{i}d" for i in range(150)]
    rows = [fact(f"{s}{i:03d}", s, subject=f"{name} {x}", canonical_subject=f"{name} {x}", predicate="revenue", canonical_predicate=f"revenue {i}") for i, name in enumerate(names) for s, x in (("a", "north"), ("b", "south"))]
    facts = table(spark, rows).cache()
    hot = candidates.blocked(facts).count()
    few = candidates.related(facts)
    assert hot == 150 * 150 and few.count() <= 300
    assert verdicts(few) == verdicts(candidates.blocked(facts))
    facts.unpersist()


def test_nothing(spark):
    assert candidates.related(table(spark, [])).count() == 0 == candidates.related(table(spark, [fact("a", "d")])).count()


def test_prices_against_every_pair(spark, sf):
    import duckdb

    from factloom.plans.engine import PRICES_SQL, classify_prices

    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    columns = ["a_fact_id", "b_fact_id", "rule_id", "relationship_type", "confidence", "needs_llm"]
    want = sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({PRICES_SQL})").fetchall())
    assert sorted(map(tuple, classify_prices(spark, sf).select(columns).collect())) == want and len({w[2] for w in want}) >= 5


def test_facts_of_one_document_are_not_put_together(spark):
    """Words that a large document repeats make no pairs inside it, and none between documents are lost."""
    rows = [fact(f"b{i:03d}", "b", subject=f"paid ring x{i}", predicate="price") for i in range(60)] + [fact(f"a{i}", "a", subject=f"ring x{i}", predicate="price paid") for i in range(3)]
    sets = candidates.word_sets(table(spark, rows))
    sets = candidates.rarest_first(sets, sets)
    pair = lambda df: sorted(map(tuple, df.select("query_id", "candidate_id").collect()))
    want = pair(candidates.meeting(sets, sets, 0.2).where("qd <> cd"))
    found = candidates.meeting(sets, sets, 0.2, True)
    assert pair(found) == want and len(want) >= 6 and found.where("qd = cd").isEmpty()


def test_related_with_stored_steps(spark):
    facts, stored = made(spark, random.Random(5), 60), []
    store = lambda df: stored.append(df.localCheckpoint()) or stored[-1]
    assert verdicts(candidates.related(facts, store=store)) == verdicts(candidates.related(facts)) and len(stored) >= 8
