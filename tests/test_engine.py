"""Files to evidence, split tables, matching of changes and posting lists, through a workspace and against plain versions."""

import json
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.operators import chunking, delta, match, postings, search
from factloom.plans.api import Workspace
from factloom.plans.pairs import facts as report_facts
from factloom.sources import extractor

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


# Files

REPORT = "[page iii]\nAnnual report\nof Alpha Ltd\n\nRevenue rose.\n\f[page iv]\n| Item | FY24 |\n| Revenue | 5,000 |\n| Staff | 100 |\n\n[picture]\n\f" + "\f".join(f"Page {i} in words." for i in range(2, 9))


class Broken(extractor.PlainPages):
    """Fails for one page, and for every table search on another."""

    def pages(self, content, first, last):
        if first <= 4 <= last:
            raise RuntimeError("page 4 is torn")
        return super().pages(content, first, last)

    def tables(self, content, pages, settings):
        raise ValueError("no ruler")


class Seen:
    def run(self, rows):
        return [{"texts": [f"read from page {r['page']}"]} for r in rows]


def stored(spark, files, path):
    return spark.createDataFrame(files, "document_id string, content binary")


def test_files_to_evidence(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    files = [("a", REPORT.encode()), ("b", b"plain text of one page"), ("c", b"\xff\xfe"), ("d", b"")]
    status = {r.document_id: (r.ingestion_status, r.page_count, r.bad_pages) for r in w.ingest_files(stored(spark, files, tmp_path), extractor.PlainPages(), pages_of_a_task=2).collect()}
    assert status == {"a": ("COMPLETED", 9, 0), "b": ("COMPLETED", 1, 0), "c": ("FAILED", 1, 1), "d": ("COMPLETED", 1, 0)}
    units = w.table("evidence").where("document_id = 'a'").orderBy("page", "block_index").collect()
    assert [(u.page, u.type, u.text, u.source_page_number) for u in units[:2]] == [(0, "TEXT", "Annual report\nof Alpha Ltd", "iii"), (0, "TEXT", "Revenue rose.", "iii")]
    assert [u.type for u in units if u.page == 1][0] == "IMAGE"  # a picture on a page without text blocks
    table = [u for u in units if u.page == 1][1:]
    assert [u.type for u in table] == ["TABLE", *["TABLE_CELL"] * 4] and table[0].headers == ["Item", "FY24"] and table[-1].text == "100" and table[-1].row_header == "Staff" and {u.source_page_number for u in table} == {"iv"}
    assert [u.text for u in units if u.page > 1] == [f"Page {i} in words." for i in range(2, 9)] and {u.source_page_number for u in units if u.page > 1} == {None}
    assert w.table("pages").where("document_id = 'c'").first().error.startswith("UnicodeDecodeError")
    assert w.table("pages").where("document_id = 'a' and page = 1").first().has_images
    # once more with other content: replaced, the others stay; OCR reads what is bad
    w.ingest_files(stored(spark, [("b", b"x"), ("e", REPORT.encode())], tmp_path), extractor.PlainPages(), ocr=Seen())
    assert [(u.type, u.text) for u in w.table("evidence").where("document_id = 'b'").orderBy("block_index").collect()] == [("TEXT", "x"), ("OCR_TEXT", "read from page 0")]
    assert w.documents().count() == 5 and w.table("evidence").where("document_id = 'a'").count() == len(units)


def test_failures_stay_on_their_pages(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    got = w.ingest_files(stored(spark, [("a", REPORT.encode())], tmp_path), Broken(), pages_of_a_task=1).first()
    assert (got.ingestion_status, got.page_count, got.bad_pages) == ("PARTIAL", 9, 2)
    errors = {r.page: r.error for r in w.table("pages").where("error is not null").collect()}
    assert errors[4] == "RuntimeError: page 4 is torn" and "no ruler" in errors[1]
    assert {r.page for r in w.table("evidence").collect()} == {0, 1, 2, 3, 5, 6, 7, 8}
    assert [r.type for r in w.table("evidence").where("page = 1").collect()] == ["IMAGE"]  # its table is lost, the picture isn't


def test_files_are_read_in_stretches(spark):
    docs = spark.createDataFrame([("a", REPORT.encode()), ("b", b"one")], "document_id string, content binary")
    whole = sorted(map(str, extractor.read_ranges(docs, extractor.PlainPages(), 100).collect()))
    assert whole == sorted(map(str, extractor.read_ranges(docs, extractor.PlainPages(), 2).collect())) and len(whole) == 10
    assert extractor.read_ranges(docs.limit(0), extractor.PlainPages()).count() == 0


# Chunks


def plain_chunks(page, max_chars):
    """page: units in order as (id, kind, text, table, headers, row, col). Lists of (id, text) by chunk."""
    head = lambda t, names: f"Table {t} (columns: {' | '.join(names or [])}):"
    chunks, current, cost = [], [], 0
    claimed = set()

    def flush():
        nonlocal current, cost
        if current:
            chunks.append(current)
        current, cost = [], 0

    def place(units):
        nonlocal cost
        n = sum(len(t) for _, t in units)
        if current and cost + n > max_chars:
            flush()
        current.extend(units)
        cost += n
        if n > max_chars:
            flush()

    for i, kind, text, t, names, row, col in page:
        if kind == "IMAGE" and not text.strip() or i in claimed:
            continue
        if kind != "TABLE":
            place([(i, text)])
            continue
        cells = sorted((c for c in page if c[1] == "TABLE_CELL" and c[3] == t and c[0] not in claimed), key=lambda c: (c[5], c[6]))
        claimed |= {c[0] for c in cells}
        group = [(i, head(t, names) + ("\n" + text if text else "")), *((c[0], c[2]) for c in cells)]
        if sum(len(x) for _, x in group) <= max_chars or not cells:
            place(group)
            continue
        flush()
        rows, part = [], []
        for c in cells:
            if rows and rows[-1][-1][5] == c[5]:
                rows[-1].append(c)
            else:
                rows.append([c])

        def made(part):
            return [(i, "\n".join([head(t, names), *(" | ".join(c[2] for c in r) for r in part)])), *((c[0], c[2]) for r in part for c in r)]

        for r in rows:
            if part and sum(len(x) for _, x in made([*part, r])) > max_chars:
                place(made(part))
                part = []
            part.append(r)
        place(made(part))
    flush()
    return chunks


def made_page(rng):
    units, n = [], 0
    for _ in range(rng.randrange(1, 7)):
        kind = rng.choice(["TEXT", "TEXT", "TABLE", "IMAGE"])
        t = len([u for u in units if u[1] == "TABLE"])
        names = ["a", "b" * rng.randrange(1, 9)] if kind == "TABLE" else None
        units.append((f"u{n:04d}", kind, "" if kind == "IMAGE" else "x" * rng.randrange(1, 90), t if kind == "TABLE" else None, names, None, None))
        n += 1
        if kind == "TABLE":
            for row in range(rng.randrange(0, 12)):
                for col in range(2):
                    units.append((f"u{n:04d}", "TABLE_CELL", "y" * rng.choice([1, 5, 20, 130]), t, None, row, col))
                    n += 1
    return units


def test_tables_are_split_between_rows(spark):
    rng = random.Random(21)
    pages = [made_page(rng) for _ in range(60)]
    rows = [("d", p, seq, i, kind, text, t, names, row, col, None, None) for p, page in enumerate(pages) for seq, (i, kind, text, t, names, row, col) in enumerate(page)]
    units = spark.createDataFrame(rows, "document_id string, page int, seq int, evidence_id string, type string, text string, table_index int, headers array<string>, row int, col int, row_header string, column_header string")
    got = {}
    for r in sorted(chunking.placed(units, 200).collect(), key=lambda r: (r.page, r.chunk, tuple(r.item))):
        got.setdefault(r.page, {}).setdefault(r.chunk, []).append((r.evidence_id, r.text))
    for p, page in enumerate(pages):
        want = plain_chunks(page, 200)
        assert [sorted(c) for _, c in sorted(got.get(p, {}).items())] == [sorted(c) for c in want]
    tight = chunking.placed(units, 1 << 30, max_tokens=60).groupBy("page", "chunk").agg(F.count("*").alias("n"), F.sum(F.expr("cast(ceil(octet_length(text) / 2) as long)")).alias("t")).collect()
    assert all(r.t <= 60 or r.n <= 3 for r in tight)


class Asked:
    """Keeps nothing; answers with how long its prompts are."""

    def run(self, rows):
        return [{"raw": json.dumps({"drafts": [{"subject": "chunk", "predicate": "length", "value_text": str(len(r["prompt"])), "evidence_ids": re.findall(r"\[([0-9a-f-]{36})\] \(TABLE\)", r["prompt"]), "confidence": 0.5}]})} for r in rows]


def test_oversize_tables_in_a_workspace(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    body = "\n".join(f"| Item {i} | {i * 1000} | words about the item number {i} that go on | 7 | x |" for i in range(60))
    w.ingest_files(spark.createDataFrame([("t", f"Before the table.\n\n| Name | Value | Note | A | B |\n{body}\n\nAfter the table.".encode())], "document_id string, content binary"), extractor.PlainPages())
    chunks = w.chunks()
    sums = chunks.groupBy("chunk_id").agg(F.sum(F.length("text")).alias("n"), F.sum((F.col("type") == "TABLE").cast("int")).alias("tables")).collect()
    assert len(sums) > 4 and all(r.n <= chunking.MAX_CHARS for r in sums)
    assert chunks.where("type = 'TABLE_CELL'").count() == 300 == chunks.where("type = 'TABLE_CELL'").select("evidence_id").distinct().count()
    heads = [r.text.split("\n")[0] for r in chunks.where("type = 'TABLE'").collect()]
    assert set(heads) == {"Table 0 (columns: Name | Value | Note | A | B):"} and len(heads) == sum(r.tables for r in sums)
    report = w.extract_facts(Asked()).first()
    assert (report.chunks_processed, report.chunks_failed) == (len(heads), 1)  # the chunk before the table has nothing to cite
    assert w.extract_facts(Asked()).first().chunks_skipped == len(heads)


# Changes

COLUMNS = ["fact_a_id", "fact_b_id", "relationship_type", "rule_id", "confidence", "status", "explanation"]


def rows_of(df):
    return sorted(map(str, df.select(COLUMNS).collect()))


def test_changes_equal_a_run_from_scratch(spark, sf, tmp_path):
    every = report_facts(spark, sf).withColumn("evidence_ids", F.array(F.lit("e"))).where("cast(substr(fact_id, 3, 2) as int) < 9").cache()
    w = Workspace(spark, str(tmp_path / "w"))
    first = every.where("h <> 4").withColumn("normalized_number", F.when(F.col("h") == 0, F.lit(1.0)).otherwise(F.col("normalized_number"))).unionByName(every.where("h = 5").withColumn("fact_id", F.concat("fact_id", F.lit("-gone"))))
    w.put(facts=first)
    told = w.match_changes().first()
    assert told.new == first.count() and told.changed == told.gone == told.kept == 0 and told["mode"] == "exhaustive"
    assert rows_of(w.table("relationships")) == rows_of(match.verdicts(first))
    again = w.match_changes().first()
    assert (again.new, again.changed, again.gone, again.compared) == (0, 0, 0, 0) and again.kept == told.compared
    # a judgment on a pair that doesn't change stays
    judged = w.table("relationships").withColumn("explanation", F.when(F.col("rule_id") == "R6", F.lit("judged")).otherwise(F.col("explanation")))
    w.put(relationships=judged)
    w.put(facts=every)
    told = w.match_changes().first()
    assert told.new == every.where("h = 4").count() and told.changed == every.where("h = 0").count() and told.gone == every.where("h = 5").count() and told.kept > 0
    got, want = w.table("relationships"), match.verdicts(every)
    assert rows_of(got.withColumn("explanation", F.lit("")) ) == rows_of(want.withColumn("explanation", F.lit("")))
    assert 0 < got.where("explanation = 'judged'").count() < got.where("rule_id = 'R6'").count()
    # beyond the bound the best candidates of each fact are compared, also as from scratch
    told = w.match_changes(up_to=0).first()
    assert told["mode"] == "ranked" and told.new == 0
    ranked = rows_of(w.table("relationships").drop("explanation").withColumn("explanation", F.lit("")))
    other = Workspace(spark, str(tmp_path / "x"))
    other.put(facts=every)
    other.match_changes(up_to=0)
    assert ranked == rows_of(other.table("relationships").withColumn("explanation", F.lit("")))
    assert w.match_changes().first()["mode"] == "exhaustive" and rows_of(w.table("relationships")) == rows_of(want)
    every.unpersist()


def test_differences(spark):
    kinds = "fact_id string, document_id string, subject string, normalized_number double"
    now = spark.createDataFrame([("a", "d", "x", 1.0), ("b", "d", None, 2.0), ("c", "d", "z", None), ("n", "d", "", 1.0)], kinds)
    old = spark.createDataFrame([("a", "d", "x", 1.0), ("b", "d", "", 2.0), ("c", "e", "z", None), ("g", "d", "", 1.0)], kinds)
    found = {r.fact_id: r.change for r in delta.difference(delta.state(now), delta.state(old)).collect()}
    assert found == {"b": "CHANGED", "c": "CHANGED", "n": "NEW", "g": "GONE"}
    assert delta.difference(delta.state(now), delta.state(now)).count() == 0


def test_only_changed_facts_meet_the_others(spark, sf):
    every = report_facts(spark, sf)
    few = every.where("fact_id like 'A-03%'").select("fact_id")
    from factloom.operators.candidates import blocked

    got = blocked(every, touched=few).select("a_fact_id", "b_fact_id").collect()
    want = [r for r in blocked(every).select("a_fact_id", "b_fact_id").collect() if r.a_fact_id.startswith("A-03") or r.b_fact_id.startswith("A-03")]
    assert sorted(got) == sorted(want) and len(got) > 0


# Posting lists

WORDS = ["Alpha", "beta-7", "GDP", "gross", "K", "x", "réel", "net-net", "2024", "rs.", "crore", "alphabet", ""]


def made_facts(spark, rng, n):
    pick = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 4)))
    rows = [(f"f{i:03d}", f"d{i % 3}", pick(), pick(), pick(), rng.choice([None, pick()])) for i in range(n)]
    return spark.createDataFrame(rows, "fact_id string, document_id string, subject string, predicate string, value_text string, unit string")


@pytest.mark.parametrize("named", [0, 1000])
def test_postings_find_what_a_scan_finds(spark, monkeypatch, named):
    monkeypatch.setattr(postings, "NAMED", named)
    rng = random.Random(31)
    facts = made_facts(spark, rng, 120).cache()
    asked = [(1, "alpha", None), (2, "lph ET", None), (3, "k", "d1"), (4, "ta-7 unknownword", None), (5, "202", "d2"), (6, "zzz", None), (7, "ré net", None), (8, "a b c d e", None), (9, "alphabet alpha gross 2024 crore", "d0")]
    queries = spark.createDataFrame([*asked, (10, "...", None), (11, None, None)], "query_id int, text string, document_id string")
    lists = postings.index(facts)
    often = postings.frequencies(lists)
    got = {}
    keys = postings.asked(queries, often).join(queries.select("query_id", "document_id"), "query_id")
    assert {r.query_id for r in keys.collect()} <= set(range(1, 10))
    pools = postings.lexical_pools(queries, lists, often, facts, limit=2)
    for r in pools.collect():
        got.setdefault(r.query_id, set()).add((r.fact_id, round(r.lexical, 9)))
    for i, text, document in asked:
        want = {(r.fact_id, round(r.lexical, 9)) for r in search.lexical_pool(facts, text, 2, document).collect()}
        assert got.get(i, set()) == want, text
    best = postings.hits_of_each(pools, 2).collect()
    assert all(r["rank"] <= 2 and r.score > 0 for r in best)
    facts.unpersist()


def test_search_reads_postings(spark, tmp_path):
    rng = random.Random(32)
    w = Workspace(spark, str(tmp_path / "w"))
    facts = made_facts(spark, rng, 60).withColumn("evidence_ids", F.array().cast("array<string>"))
    w.put(facts=facts, evidence=spark.createDataFrame([], "document_id string, evidence_id string, page int, type string, text string"))
    scanned = sorted(map(str, w.search("alpha gdp").collect()))
    w.index_search()
    found = w.search("alpha gdp")
    assert sorted(map(str, found.collect())) == scanned and scanned
    plan = w.search_many(spark.createDataFrame([(1, "alpha gdp")], "query_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "postings/v-" in plan and "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "bucket" in plan
    many = w.search_many(spark.createDataFrame([(1, "alpha gdp"), (2, "crore")], "query_id int, text string")).collect()
    assert {r.fact_id for r in many if r.query_id == 1} == {r.fact_id for r in found.collect()}
    w.put(facts=facts.where("fact_id < 'f030'"))  # the lists are of other facts now
    assert all(r.fact_id < "f030" for r in w.search("alpha gdp").collect())
    assert all(r.fact_id < "f030" for r in w.search_many(spark.createDataFrame([(1, "alpha")], "query_id int, text string")).collect())
    with pytest.raises(ValueError):
        w.search("  ")
    with pytest.raises(ValueError):
        w.search_many(spark.createDataFrame([(1, "a")], "query_id int, text string"), limit=101)


def test_a_token_is_looked_up_once(spark, monkeypatch):
    """However many queries hold it; the pools are those of all hits."""
    facts = made_facts(spark, random.Random(33), 150)
    queries = spark.createDataFrame([(i, f"alpha gross q{i}", None) for i in range(30)], "query_id int, text string, document_id string")
    lists, seen, plain = postings.index(facts), [], postings.found
    monkeypatch.setattr(postings, "found", lambda keys, *a: seen.append(keys.count()) or plain(keys, *a))
    got = {}
    for r in postings.lexical_pools(queries, lists, postings.frequencies(lists), facts, limit=2).collect():
        got.setdefault(r.query_id, set()).add(r.fact_id)
    assert sum(seen) <= 2 + 30
    want = {r.fact_id for r in search.lexical_pool(facts, "alpha gross", 2).collect()}
    assert want and all(got[i] == want for i in (10, 20, 29) if i in got)
