"""Pairs, stores, streams and providers on small made-up tables."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.operators import candidates, chunking, compare, evidence, match, search
from factloom.sources import extractor, providers, store
from factloom.streaming import progress

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests

FACT = "fact_id string, document_id string, subject string, canonical_subject string, predicate string, canonical_predicate string, value_kind string, value_text string, normalized_number double, unit string, normalized_unit string, time_text string, time_kind string, time_start date, time_end date, scope_text string, estimate_status string, geography string"


def fact(i, doc, **more):
    base = dict(fact_id=i, document_id=doc, subject="Alpha metric", canonical_subject="alpha metric", predicate="reported total", canonical_predicate="reported total", value_kind="NUMERIC", value_text="5000", normalized_number=5000.0, unit="count", normalized_unit="count", time_text="FY24", time_kind="FISCAL_YEAR", time_start=None, time_end=None, scope_text="Scope Alpha", estimate_status="ACTUAL", geography="Region Alpha")
    return base | more


def table(spark, rows):
    names = [c.split()[0] for c in FACT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FACT)


NONE = dict(canonical_subject=None, canonical_predicate=None)
CASES = [
    (dict(), dict(), "R1", 0.95), (dict(), dict(normalized_number=5020.0), "R1", 0.9), (NONE, NONE, "R2", 0.5), (dict(), dict(normalized_number=10000.0), "R4b", 0.85), (dict(), dict(normalized_number=10000.0, geography=None), "R4b", 0.7),
    (dict(), dict(normalized_number=10000.0, time_kind="UNKNOWN", time_text=None), "R4a", 0.4), (dict(), dict(normalized_number=10000.0, scope_text=None), "R4a", 0.4), (dict(), dict(normalized_number=6000.0, time_text="FY23"), "R6", 0.75),
    (dict(), dict(normalized_number=6000.0, geography="Region B"), "R6", 0.75), (dict(subject="Other", canonical_subject="other", predicate="thing", canonical_predicate="thing"), dict(), "R9", 0.9),
    (dict(normalized_unit=None, unit=None, time_text=None, time_kind="UNKNOWN"), dict(normalized_unit=None, unit=None, time_text=None, time_kind="UNKNOWN"), "R7", 0.5),
]


def test_rules(spark):
    rows = [fact(f"{i:02d}{s}", s, subject=f"{x.get('subject', 'Alpha metric')}", **{k: v for k, v in x.items() if k != "subject"}) for i, (a, b, _, _) in enumerate(CASES) for s, x in (("a", a), ("b", b))]
    f = compare.prepared(table(spark, rows))
    pairs = compare.side(f, "a").join(compare.side(f, "b"), (F.substring("a_fact_id", 1, 2) == F.substring("b_fact_id", 1, 2)) & (F.col("a_fact_id") < F.col("b_fact_id")))
    got = {r.a_fact_id: (r.rule_id, r.confidence) for r in compare.classified(pairs).collect()}
    assert [got[f"{i:02d}a"] for i in range(len(CASES))] == [c[2:] for c in CASES]


def test_blocking_loses_nothing_and_order_does_not_matter(spark):
    rng = random.Random(4)
    words = ["revenue", "total", "of", "alpha", "beta", "the", "value", "Ünal", "net"]

    def some():
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))

    rows = []
    for i in range(80):
        s, p = some(), some()
        rows.append(fact(f"{i:03d}", rng.choice("xyz"), subject=s, predicate=p, canonical_subject=rng.choice([None, s.lower()]), canonical_predicate=rng.choice([None, p.lower()]), normalized_number=rng.choice([None, 1.0, 1.005, 2.0]), normalized_unit=rng.choice([None, "u", "w"]), value_kind=rng.choice(["NUMERIC", "PERCENTAGE", "TEXT"]), time_text=rng.choice([None, "FY24", "FY23"]), scope_text=rng.choice([None, "s"])))
    facts = table(spark, rows)
    f = compare.prepared(facts)
    cross = compare.side(f, "a").join(compare.side(f, "b"), (F.col("a_document_id") != F.col("b_document_id")))
    every = {(r.a_fact_id, r.b_fact_id): (r.rule_id, r.confidence) for r in compare.classified(cross).select("a_fact_id", "b_fact_id", "rule_id", "confidence").collect()}
    assert all(every[b, a] == v for (a, b), v in every.items())
    found = {(r.a_fact_id, r.b_fact_id): (r.rule_id, r.confidence) for r in compare.classified(candidates.blocked(facts)).select("a_fact_id", "b_fact_id", "rule_id", "confidence").collect()}
    assert {k: v for k, v in found.items() if v[0] != "R9"} == {k: v for k, v in every.items() if v[0] != "R9" and k[0] < k[1]}
    assert candidates.space(facts).first().pairs == len(every) // 2


def test_rerun_adds_nothing(spark):
    facts = table(spark, [fact("a", "x"), fact("b", "y"), fact("c", "y", normalized_number=9000.0)])
    rels = match.verdicts(facts)
    again = match.merged(rels, rels)
    assert sorted(map(str, again.select("relationship_id", "confidence").collect())) == sorted(map(str, rels.select("relationship_id", "confidence").collect()))
    assert match.new_only(rels, rels).count() == 0


def test_judgments(spark):
    raws = ['{"relationship_type": "RELATED", "confidence": "0.7", "explanation": "x"}', "nope", '{"relationship_type": "UNRELATED", "confidence": 1, "explanation": "x"}', '{"relationship_type": "RELATED", "confidence": 2, "explanation": "x"}', '{"relationship_type": "RELATED", "confidence": 1, "explanation": " "}', '{"relationship_type": "RELATED", "confidence": true, "explanation": "x"}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    errors = [r.j["error"] for r in df.select("i", match.parsed_judgment(F.col("raw")).alias("j")).orderBy("i").collect()]
    assert errors[0] is None and all(errors[1:])


def test_packing_against_a_loop(spark):
    rng = random.Random(1)
    sizes = [(d, p, i, rng.randint(1, 120), rng.randint(1, 60)) for d in "ab" for p in range(2) for i in range(30)]
    units = spark.createDataFrame(sizes, "document_id string, page int, item int, chars int, tokens int")
    got = {(r.document_id, r.page, r.item): r.chunk for r in chunking.packed(units, 200, 90).collect()}
    for d in "ab":
        for p in range(2):
            chunk, chars, tokens, some = 0, 0, 0, False
            for _, _, i, c, t in (s for s in sizes if s[:2] == (d, p)):
                if some and (chars + c > 200 or tokens + t > 90):
                    chunk, chars, tokens, some = chunk + 1, 0, 0, False
                assert got[d, p, i] == chunk
                chars, tokens, some = chars + c, tokens + t, True
                if c > 200 or t > 90:
                    chunk, chars, tokens, some = chunk + 1, 0, 0, False


def test_selection_and_windows(spark):
    c = spark.createDataFrame([("d", 0, i, 0, 5) for i in range(20)], "document_id string, page int, chunk long, has_table int, digits int")
    assert [r.chunk for r in chunking.selected(c, 10).orderBy("chunk").collect()] == list(range(0, 20, 2))
    with pytest.raises(ValueError):
        chunking.ordinals(c, 3, 1)


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 3)], "k int, v string, n int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", 9), (3, "d", 3)]
    assert sorted(map(tuple, store.update_columns(old, new, ["k"], ["n"]).collect())) == [(1, "a", 1), (2, "b", 9)]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r.refused for r in store.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.pdf": "400: not a PDF"}
    assert store.health(spark)["engine"] == "ok"


def test_providers(spark):
    texts = spark.createDataFrame([("1", "alpha beta"), ("2", "alpha beta"), ("3", None)], "fact_id string, text string")
    v = {r.fact_id: r.v for r in providers.embedded(texts, "text", providers.HashEmbedder(16)).collect()}
    assert v["1"] == v["2"] and sum(x * x for x in v["1"]) == pytest.approx(1) and not any(v["3"])
    failed = providers.apply(texts, providers.NoProvider(), ["text"], "vector array<double>").collect()
    assert all(r.vector is None and r.error.startswith("RuntimeError") for r in failed)
    assert providers.resolve(None, {}) is None
    with pytest.raises(ValueError):
        providers.resolve("x", {})
    assert providers.backoff(3, 1, 60, draw=lambda: 1.0) == 4 and providers.backoff(9, 1, 60, draw=lambda: 0.0) == 30


def test_search_arguments(spark):
    with pytest.raises(ValueError):
        search.query_tokens("  ")
    assert search.query_tokens("B a, b A") == ["b", "a"]
    facts = table(spark, [fact("a", "x"), fact("b", "y", subject="Beta")])
    assert [r.fact_id for r in search.hits(search.lexical_pool(facts, "beta"), None).collect()] == ["b"]


class Answers:
    """Fails for one prompt."""

    def run(self, rows):
        if rows[0]["prompt"] == "bad":
            raise TimeoutError("busy")
        return [{"raw": "of " + r["prompt"]} for r in rows]


def test_stream_of_chunks_resumes(spark, tmp_path):
    kinds = progress.KINDS + ", prompt string"

    def put(name, rows):
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "in" / name))

    def once():
        chunks = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = progress.run(chunks, str(tmp_path / "out"), str(tmp_path / "check"), Answers())
        query.awaitTermination(120)
        state = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
        return sorted((r.chunk_index, r.evidence_hash, r.status, r.error or r.raw) for r in spark.read.parquet(str(tmp_path / "out")).collect()), state

    put("1", [("d", 0, 0, "x", "a"), ("d", 0, 1, "y", "bad")])
    first = [(0, "x", "COMPLETED", "of a"), (1, "y", "FAILED", "TimeoutError: busy")]
    assert once()[0] == first
    # the same content again, a failed chunk again, other content of a chunk, and rows that come twice
    put("2", [("d", 0, 0, "x", "a"), ("d", 0, 1, "y", "good"), ("d", 0, 0, "z", "c"), ("d", 0, 0, "z", "c"), ("e", 0, 0, "x", "d")])
    then, state = once()
    assert then == sorted([*first, (0, "z", "COMPLETED", "of c"), (1, "y", "COMPLETED", "of good"), (0, "x", "COMPLETED", "of d")])
    assert state[-1] == 3  # chunks, not runs
    put("3", [("d", 0, 0, "x", "a"), ("d", 0, 0, "z", "c"), ("d", 0, 1, "y", "bad")])
    assert once()[0] == then


def test_empty_tables(spark):
    none = spark.createDataFrame([], FACT)
    assert match.verdicts(none).count() == 0 and candidates.space(none).first().pairs == 0
    assert evidence.lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_take_their_cells_along(spark):
    rows = [("d", 0, 0, "t0", "TABLE", "grid", 1), ("d", 0, 1, "c1", "TABLE_CELL", "x", 1), ("d", 0, 2, "t1", "TABLE", "other", 1), ("d", 0, 3, "c2", "TABLE_CELL", "yy", 1), ("d", 0, 4, "c3", "TABLE_CELL", "z", 7), ("d", 0, 5, "p", "IMAGE", " ", None), ("d", 0, 6, "x", "TEXT", "text", None), ("d", 0, 7, "c4", "TABLE_CELL", "q", None)]
    got = {r.item: (r.members, r.chars) for r in chunking.items(spark.createDataFrame(rows, "document_id string, page int, seq int, evidence_id string, type string, text string, table_index int")).collect()}
    assert got == {0: (["t0", "c1", "c2"], 7), 2: (["t1"], 5), 4: (["c3"], 1), 6: (["x"], 4), 7: (["c4"], 1)}


def test_ocr_fills_bad_pages(spark):
    class Ocr:
        def run(self, rows):
            if any(r["document_id"] == "2" for r in rows):
                raise OSError("no scanner")
            return [{"texts": [" read ", " ", "more"]} for _ in rows]

    units = evidence.lines(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")).withColumn("type", F.lit("TEXT"))
    pages = evidence.page_quality(units).withColumn("error", F.lit(None).cast("string"))
    more, left = evidence.ocr_fallback(pages.where("document_id = '1'"), units, Ocr(), providers.apply)
    assert [(r.block_index, r.text, r.type) for r in more.where("document_id = '1'").orderBy("block_index").collect()] == [(0, "x", "TEXT"), (1, "read", "OCR_TEXT"), (2, "more", "OCR_TEXT")]
    _, left = evidence.ocr_fallback(pages.where("document_id = '2'"), units, Ocr(), providers.apply)
    assert left.first().error == "OSError: no scanner"
    assert evidence.page_numbers([2, 0, 2], 3) == [2, 0]
    for bad in (3, -1, True, "1"):
        with pytest.raises(ValueError):
            evidence.page_numbers([bad], 3)


def test_presentation(spark):
    from factloom.plans import reports

    facts = table(spark, [fact("a", "x"), fact("b", "y", normalized_number=9000.0, scope_text=None)])
    r = match.verdicts(facts).select(reports.badge().alias("b"), reports.flattened("reasoning_metadata", ["numeric_verdict", "incompatible_dimensions", "match_tier"]).alias("m")).first()
    assert r.b == "needs review; CONTRADICTS withheld: scope stated on only one side" and r.m == {"numeric_verdict": "DIFFERENT", "incompatible_dimensions": "none", "match_tier": "none"}
    assert spark.range(1).select(reports.shown_number(F.lit(8141.5), F.lit("INR crore")).alias("x")).first().x.endswith("INR crore")


class Book:
    """An extractor of 'pages' parted by form feeds; a page that says so has tables, found at the second try."""

    def pages(self, content):
        if not content.startswith(b"%"):
            raise ValueError("no such format")
        return [{"page": i, "label": "", "width": 600.0, "height": 800.0, "has_images": False, "candidates": t.count("table"), "blocks": [{"type": 0, "lines": [[w] for w in t.split()]}]} for i, t in enumerate(content[1:].decode().split("\f"))]

    def tables(self, content, pages, settings):
        text = content[1:].decode().split("\f")[pages[0]]
        if "broken" in text:
            raise RuntimeError("torn")
        if settings is None or "none" in text:
            return []
        return [{"page": pages[0], "table_index": 0, "cells": [{"row": r, "col": c, "text": f"{r}{c}"} for r in range(2) for c in range(2)]}]


def test_extractor_contains_failures(spark):
    files = spark.createDataFrame([("a", b"%one two\ftable\ftable none\ftable broken"), ("b", b"other")], "document_id string, content binary")
    pages = extractor.read_pages(files, Book())
    assert sorted((r.document_id, r.page, r.error) for r in pages.collect()) == [("a", 0, None), ("a", 1, None), ("a", 2, None), ("a", 3, None), ("b", 0, "ValueError: no such format")]
    assert {(r.page, r.text) for r in extractor.text_blocks(pages).collect()} == {(0, "one\ntwo"), (1, "table"), (2, "table\nnone"), (3, "table\nbroken")}
    assert all(r.source_page_number is None for r in extractor.labelled(pages).collect())
    tables = extractor.read_tables(files, pages, Book())
    assert {r.page: r.error for r in tables.collect()} == {1: None, 2: "page 2: no table found by either search", 3: "page 3: table search failed (RuntimeError: torn)"}
    assert sorted((r.page, r.text) for r in extractor.table_cells(tables).collect()) == [(1, "00"), (1, "01"), (1, "10"), (1, "11")]


def test_retries_and_pacing():
    class Service:
        def __init__(self, *answers):
            self.answers = list(answers)

        def run(self, rows):
            x = self.answers.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

    waits = []
    busy, good = providers.ProviderError("busy", 429, {"Retry-After": "7"}), [{"vector": [0.0, 1.0]}]
    tried = providers.Retrying(Service(busy, TimeoutError("slow"), [{"vector": [0.0]}], good), readable=providers.vectors_fit(2), sleep=waits.append, draw=lambda: 1.0)
    assert tried.run([{}]) == good and waits == [7.0, 2.0, 4.0]
    for error in (providers.ProviderError("no", 401), providers.ProviderError("limit on tokens per day (TPD)", 429), ValueError("context length exceeded")):
        with pytest.raises(type(error)):
            providers.Retrying(Service(error, good), sleep=waits.append).run([{}])
    with pytest.raises(TimeoutError):
        providers.Retrying(Service(*[TimeoutError("slow")] * 3), most=2, sleep=lambda s: None).run([{}])
    assert [providers.retry_after(h) for h in ({}, {"retry-after-ms": "1500"}, {"Retry-After": "-1"}, {"Retry-After": "soon"})] == [None, 1.5, None, None]
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    paced = providers.Paced(Service(good, good, good), 2.5, lambda: now[0], sleep)
    paced.run([{}, {}])
    now[0] += 1.0
    paced.run([{}])
    assert slept == [2.5, 1.5]


def test_word_candidates_against_all_pairs(spark):
    rng = random.Random(11)
    names = [" ".join(["revenue", *rng.sample("abcdefghijklmnop", rng.randint(0, 6)), *(["total"] if rng.random() < 0.7 else [])]) for _ in range(120)]
    rows = [fact(f"f{i:03}", f"d{i % 7}", canonical_subject=n, canonical_predicate="") | dict(predicate="x") for i, n in enumerate(names)]
    facts = table(spark, rows)
    sets = {r["fact_id"]: {*n.split(), "x"} for r, n in zip(rows, names)}
    doc = {r["fact_id"]: r["document_id"] for r in rows}
    for floor, same in ((0.25, False), (0.6, True)):
        want = {}
        for q, x in sets.items():
            scored = sorted((-len(x & y) / len(x | y), c) for c, y in sets.items() if c != q and (doc[c] != doc[q] or same and c > q))
            want |= {(q, c): -s for s, c in [p for p in scored if -p[0] >= floor][:5]}
        got = {(r.query_id, r.candidate_id): r.score for r in candidates.by_words(facts, k=5, floor=floor, include_same_document=same).collect()}
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in got)
