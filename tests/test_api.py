"""A workspace from documents to relationships and search, with a provider that reads its own prompts."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.plans.api import Workspace
from factloom.sources.providers import HashEmbedder, KeepingJudge

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Reader:
    """Drafts one fact for each evidence line 'subject | predicate | value | unit | period'."""

    def run(self, rows):
        out = []
        for row in rows:
            drafts = []
            for i, text in re.findall(r"\[([0-9a-f-]{36})\] \(TEXT\) (.*)", row["prompt"]):
                parts = [p.strip() for p in text.split("|")]
                if len(parts) == 5:
                    drafts.append({"subject": parts[0], "predicate": parts[1], "value_text": parts[2], "unit": parts[3], "time_text": parts[4], "evidence_ids": [i], "confidence": 0.9})
            drafts.append({"subject": "made up", "predicate": "x", "value_text": "1", "evidence_ids": ["nowhere"], "confidence": 0.1})
            out.append({"raw": "```json\n" + json.dumps({"drafts": drafts}) + "\n```"})
        return out


TEXTS = {
    1: "Gross Domestic Product (GDP) is given below.\nAlpha Ltd | revenue | 5,000 | Rs crore | FY24\nGDP | growth | 6.5% | % | FY24\nAlpha Ltd | staff | 100 | people | FY24",
    2: "Alpha Limited | revenue | 6,000 | Rs crore | FY24\nGross Domestic Product | growth | 6.5 per cent |  | FY24\nBeta | staff | 40 | people | FY23",
}


def test_workspace(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    assert w.health()["status"] == "ok"
    status = {r.document_id: r.ingestion_status for r in w.ingest(spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")).collect()}
    assert status == {"1": "COMPLETED", "2": "COMPLETED"}
    reports = {r.document_id: r for r in w.extract_facts(Reader()).collect()}
    assert {e for r in reports.values() for e in r.errors} == {"rejected draft: unknown evidence IDs: nowhere"}
    assert (reports["1"].chunks_processed, reports["1"].facts_saved, reports["1"].drafts_rejected) == (1, 3, 1)
    again = {r.document_id: r for r in w.extract_facts(Reader()).collect()}
    assert all((r.chunks_skipped, r.chunks_processed, r.facts_saved) == (1, 0, 0) for r in again.values()) and w.table("facts").count() == 6
    report = {r.document_id: r for r in w.normalize().collect()}
    assert report["1"].facts_processed == 3 and report["1"].comparable == 3
    assert w.facts("1").count() == 3
    assert w.match().count() >= 2
    types = {(r.a_subject, r.b_subject): r.relationship_type for r in [w.relationship(r.relationship_id).first() for r in w.relationships("1").collect()]}
    assert {frozenset(k): v for k, v in types.items()}[frozenset(("Alpha Ltd", "Alpha Limited"))] == "CONTRADICTS"
    assert {frozenset(k): v for k, v in types.items()}[frozenset(("GDP", "Gross Domestic Product"))] == "CORROBORATES"
    before = sorted(map(str, w.table("relationships").collect()))
    detail = w.relationship(w.relationships("1").first().relationship_id).first()
    assert len(detail.a_evidence) == len(detail.b_evidence) == 1 and detail.a_subject in detail.a_evidence[0].text
    assert w.match().count() == 0  # stored pairs aren't compared again
    assert sorted(map(str, w.table("relationships").collect())) == before
    w.match(recompute=True, judge=KeepingJudge())
    assert w.relationships("2", "CONTRADICTS", 0.7).count() == 1
    w.embed(HashEmbedder(32))
    w.embed(HashEmbedder(32))
    assert w.table("fact_embeddings").count() == 6
    hits = w.search("alpha revenue", HashEmbedder(32)).collect()
    both = [h for h in hits if h.match_kind == "hybrid"]
    assert len(both) >= 2 and all(len(h.evidence) == 1 for h in hits) and any(h.relationships for h in both)
    with pytest.raises(ValueError):
        w.search("x", limit=0)
    before = w.versions()
    w.ingest(spark.createDataFrame([(2, "now other")], "doc_id long, text string"))
    assert {n for n, v in w.versions().items() if before.get(n) != v} == {"documents", "pages", "evidence"}
    assert [r.document_id for r in w.documents().collect()] == ["1", "2"]
    assert w.table("evidence").where("document_id = '2'").count() == 1 and w.table("evidence").where("document_id = '1'").count() == 4


class Failing(Reader):
    """Fails for prompts that hold a word, and answers no JSON for another."""

    def run(self, rows):
        if any("Beta" in r["prompt"] for r in rows):
            raise TimeoutError("no answer")
        return [{"raw": "no json"} if "staff" in r["prompt"] else x for r, x in zip(rows, super().run(rows))]


def test_extraction_resumes_after_failures(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.ingest(spark.createDataFrame([*TEXTS.items(), (3, "Gamma | revenue | 1 | USD | FY24")], "doc_id long, text string").repartition(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        first = {r.document_id: r for r in w.extract_facts(Failing()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {i: (r.chunks_failed, r.facts_saved) for i, r in first.items()} == {"1": (1, 0), "2": (1, 0), "3": (0, 1)}
    assert first["2"].errors == ["TimeoutError: no answer"] and first["1"].errors == ["no drafts"]
    then = {r.document_id: r for r in w.extract_facts(Reader(), document_id="2").collect()}
    assert list(then) == ["2"] and (then["2"].chunks_processed, then["2"].facts_saved) == (1, 3)
    last = {r.document_id: r for r in w.extract_facts(Reader()).collect()}
    assert {i: (r.chunks_processed, r.chunks_skipped) for i, r in last.items()} == {"1": (1, 0), "2": (0, 1), "3": (0, 1)}
    assert w.table("facts").count() == 7 and w.table("extraction_chunks").where("status = 'COMPLETED'").count() == 3
    # other content under the same place is sent again; its old facts stay, equal ones are linked
    w.ingest(spark.createDataFrame([(3, "Gamma | revenue | 2 | USD | FY24\nGamma | staff | 5 | people | FY24")], "doc_id long, text string"))
    new = {r.document_id: r for r in w.extract_facts(Reader(), limit=None).collect()}
    assert (new["3"].chunks_processed, new["3"].facts_saved) == (1, 2) and w.table("facts").count() == 9


class Pages:
    def run(self, rows):
        if any(r["document_id"] == "8" for r in rows):
            raise RuntimeError("blurred")
        return [{"texts": ["seen by OCR", " "]} for _ in rows]


def test_ingest_of_tables_pictures_and_bad_pages(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    docs = spark.createDataFrame([(1, "one short line"), (2, "x")], "doc_id long, text string")
    cells = spark.createDataFrame([("1", 0, 0, r, c, t) for r, line in enumerate([("Item", "FY24"), ("Revenue", "5,000"), ("", " ")]) for c, t in enumerate(line)], "document_id string, page int, table_index int, row int, col int, text string")
    errors = spark.createDataFrame([("2", 5, "unreadable")], "document_id string, page int, error string")
    status = {r.document_id: r.ingestion_status for r in w.ingest(docs, cells, errors, Pages()).collect()}
    assert status == {"1": "COMPLETED", "2": "PARTIAL"}
    units = w.table("evidence").where("document_id = '1'").orderBy("block_index").collect()
    assert [(u.type, u.text) for u in units] == [("TEXT", "one short line"), ("OCR_TEXT", "seen by OCR"), ("TABLE", "Item\tFY24\nRevenue\t5,000"), ("TABLE_CELL", "Revenue"), ("TABLE_CELL", "5,000")]
    assert units[4].column_header == "FY24" and units[4].row_header == "Revenue" and len({u.evidence_id for u in units}) == 5
    chunk = w.chunks(limit=1).where("document_id = '1'").collect()
    assert len({c.chunk_id for c in chunk}) == 1 and len(chunk) == 5 and all(c.selected for c in chunk)


class Judge:
    """Keeps prompts short of evidence from passing."""

    def run(self, rows):
        if any("Evidence of A:\n" not in r["prompt"] or "|" not in r["prompt"] for r in rows):
            raise ValueError("no evidence in the prompt")
        raise TimeoutError("busy")


def test_match_for_one_document(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    texts = [(i, f"Alpha Ltd | revenue | {v} | Rs crore | {t}") for i, v, t in ((1, "5,000", "FY24"), (2, "6,000", "FY24"), (3, "5,000", ""), (4, "7,000", "FY24"))]
    w.ingest(spark.createDataFrame(texts, "doc_id long, text string"))
    w.extract_facts(Reader())
    w.normalize()
    docs_of = {r.fact_id: r.document_id for r in w.table("facts").collect()}

    def pairs():
        return {frozenset((docs_of[r.fact_a_id], docs_of[r.fact_b_id])) for r in w.table("relationships").collect()}

    w.match("1", compare_with=["2"])
    assert pairs() == {frozenset("12")}  # the document itself is always part of the run
    w.match("3", judge=Judge())
    assert pairs() == {frozenset("12"), frozenset("13"), frozenset("23"), frozenset("34")}
    waiting = w.table("relationships").where("status = 'NEEDS_REVIEW'").collect()
    assert waiting and {r.needs_review_reason for r in waiting} == {"TimeoutError: busy"} and all(r.confidence <= 0.5 for r in waiting)
    assert [r.document_id for r in w.pairs().join(w.table("facts"), F.col("fact_a_id") == F.col("fact_id")).collect()] and [r.fact_a_id for r in w.pairs().collect()] == sorted(r.fact_a_id for r in w.pairs().collect())
    one = w.facts("1").first().fact_id
    assert w.fact(one).count() == 1 and w.fact("none").count() == 0 and w.evidence_of(one, 5).first().text == "Alpha"
    assert w.evidence("1").count() == w.pages("1").count() == w.progress("1").count() == 1 and w.vectors([one]).count() == 0
    w.put_files(spark.createDataFrame([("1", b"%PDF a")], "document_id string, content binary"))
    w.put_files(spark.createDataFrame([("1", b"%PDF b"), ("2", b"%PDF")], "document_id string, content binary"))
    assert bytes(w.file("1").first().content) == b"%PDF b" and w.file("9").count() == 0
    w.match("4", up_to=0)  # too many pairs: the best of each fact
    assert frozenset("14") in pairs() and frozenset("24") in pairs()
    assert w.match().count() == 0
