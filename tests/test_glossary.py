"""Names kept up to date while documents change, against a run over all texts."""

import random

from pyspark.sql import functions as F

from factloom.operators import canonical, glossary
from factloom.plans.api import Workspace
from tests.test_api import Reader

FORMS = ["Gross Domestic Product (GDP)", "Great Data Place (GDP)", "Net Asset Value (NAV)", "Consumer Price Index (CPI)", 'Alpha Works (the "Company")', 'Beta Works (the "Company")', "nothing is said here", "(", "New Alpha Venture (NAV)"]
CLAIMS = ["GDP | growth | 6.5 | % | FY24", "the Company | revenue | 5 | Rs crore | FY24", "NAV | CPI | 4 | % | FY23", "Gross Domestic Product GDP | share | 4 | % | FY23", "Delta | sales sales | 7 | % | FY24"]


def rows(df):
    return sorted(map(str, df.collect()))


def test_workspace_names_follow_their_documents(spark, tmp_path):
    rng = random.Random(5)
    w = Workspace(spark, str(tmp_path / "w"))
    said = lambda ids: spark.createDataFrame([(i, "\n".join([*rng.sample(FORMS, 3), *rng.sample(CLAIMS, 2)])) for i in ids], "doc_id long, text string")

    def named():
        return rows(w.table("facts").select("fact_id", "canonical_subject", "canonical_predicate", "normalized_number"))

    # one without definitions comes first, so that the first abbreviation changes how all names are looked at
    for ids in ([0], range(1, 7)):
        w.ingest(said(ids) if list(ids) != [0] else spark.createDataFrame([(0, CLAIMS[4])], "doc_id long, text string"))
        w.extract_facts(Reader())
        assert w.normalize_changes().first().documents == len(list(ids))
    got = named()
    assert rows(w.table("glossary")) == rows(canonical.alias_map(canonical.alias_pairs(w.table("evidence"))))
    w.normalize()
    assert got == named()


def test_only_what_is_reached_is_rewritten(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    texts = {1: "Gross Domestic Product (GDP)\nGDP | growth | 6.5 | % | FY24", 2: "Net Asset Value (NAV)\nNAV | level | 4 | % | FY24", 3: 'Alpha Works (the "Company")\nCompany | revenue | 4 | % | FY24'}
    w.ingest(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    w.extract_facts(Reader())
    assert tuple(w.normalize_changes().first()) == (3, 2, 3)
    w.ingest(spark.createDataFrame([(4, "Great Data Place (GDP) and Great Data Place (GDP)")], "doc_id long, text string"))
    assert tuple(w.normalize_changes().first()) == (1, 1, 1)
    assert {r.document_id: r.canonical_subject for r in w.table("facts").collect()} == {"1": "great data place", "2": "net asset value", "3": "alpha works"}
    w.ingest(spark.createDataFrame([(4, ""), (3, 'Beta Works (the "Company")')], "doc_id long, text string"))
    assert tuple(w.normalize_changes().first()) == (2, 1, 2)
    assert {r.document_id: r.canonical_subject for r in w.table("facts").collect()} == {"1": "gross domestic product", "2": "net asset value", "3": "beta works"}


def test_totals_follow_any_change(spark):
    rng = random.Random(3)
    texts = [(f"d{i}", "\n".join(rng.choices(FORMS, k=rng.randint(0, 6))) or None) for i in range(30)]
    later = [(d, "\n".join(rng.choices(FORMS, k=4))) if rng.random() < 0.4 else (d, t) for d, t in texts if rng.random() < 0.9] + [("new", FORMS[0])]
    before, after = (spark.createDataFrame(x, "document_id string, text string") for x in (texts, later))
    documents = glossary.changed(after, before, "document_id", "text")
    stored = glossary.definitions(before)
    old, new = stored.join(documents, "document_id", "left_semi"), glossary.definitions(after.join(documents, "document_id", "left_semi"))
    moved = glossary.shifts(old, new)
    pairs = canonical.alias_pairs(before)
    kept = pairs.join(moved.select("abbreviation").distinct(), "abbreviation", "left_anti")
    assert rows(kept.select("abbreviation", "long_form", "n").unionByName(glossary.totals(pairs, moved))) == rows(canonical.alias_pairs(after).select("abbreviation", "long_form", "n"))
    empty = before.limit(0)
    assert glossary.definitions(empty).count() == 0 and glossary.shifts(glossary.definitions(empty), stored).where(F.col("n") <= 0).count() == 0
    assert rows(glossary.issuers(stored)) == rows(canonical.self_references(before))
