"""The engine's surface: a workspace of tables under one path, and what can be done with it.

Tables are Parquet: documents, pages, evidence, files, facts, fact_embeddings, relationships, extraction_chunks, laid out in
buckets of a key (sources.buckets), and those of the last run. A call writes the buckets that it changes beside the
old ones; what belongs together counts from the same moment on. Reading calls return DataFrames.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import candidates, canonical, chunking, delta, evidence, extract, glossary, match, postings, prompts, search, stretches
from factloom.operators.compare import comparability, missing
from factloom.sources import buckets, extractor, providers, store

FILES = "document_id string, content binary"
VECTORS = "fact_id string, v array<double>"
PROGRESS = "document_id string, page int, chunk bigint, evidence_hash string, status string, error string, fact_ids array<string>"
UNITS = "document_id string, page int, block_index int, text string, type string, evidence_id string, table_index int, row int, col int, row_header string, column_header string, headers array<string>, source_page_number string"
RELATIONSHIPS = "fact_a_id string, fact_b_id string, relationship_id string, relationship_type string, rule_id string, confidence double, status string, needs_review_reason string, explanation string"
PAIR = ["fact_a_id", "fact_b_id"]
CHUNK = ["document_id", "page", "chunk"]
#: By which columns a table is dealt into buckets.
LAYOUT = {"documents": ["document_id"], "pages": ["document_id"], "evidence": ["document_id"], "files": ["document_id"], "facts": ["fact_id"], "fact_embeddings": ["fact_id"], "relationships": ["fact_a_id"], "extraction_chunks": ["document_id"], "definitions": ["document_id"], "glossary_totals": ["abbreviation"], "glossary_seen": ["document_id"], "name_stamps": ["fact_id"]}


class Workspace:
    """With compare_with, include_same_document and recompute as switches of match()."""

    def __init__(self, spark: SparkSession, path: str, lanes: providers.Lanes | None = None):
        """lanes: how calls of drafting, judging, reading and embedding providers are spaced over a whole job, and tried again."""
        self.spark, self.path, self.lanes = spark, path.rstrip("/"), lanes

    def _file(self, name: str):
        """(file system, path) of a file of the workspace."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> dict[str, str | dict]:
        """The snapshot of each table that counts now: a folder, or a description of its buckets."""
        fs, path = self._file("current")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _has(self, name: str) -> bool:
        return name in self.versions()

    def table(self, name: str) -> DataFrame:
        at = self.versions()[name]
        return buckets.read(self.spark, f"{self.path}/{name}", at) if isinstance(at, dict) else self.spark.read.parquet(f"{self.path}/{name}/{at}")

    def of(self, name: str, keys: list) -> DataFrame:
        """Rows of a table with one of the keys by which it is dealt; other buckets aren't read."""
        return buckets.look_up(self.spark, f"{self.path}/{name}", self.versions()[name], keys)

    def rows_of(self, name: str, keys: DataFrame, schema: str) -> DataFrame:
        """Rows of a table whose keys are among `keys`, from their buckets alone; none where there is no table."""
        return buckets.semi(f"{self.path}/{name}", self.versions()[name], keys) if self._has(name) else self.spark.createDataFrame([], schema)

    def _written(self, name: str, df: DataFrame | tuple[DataFrame, str]) -> str | dict:
        if name in LAYOUT:
            return buckets.write(df, f"{self.path}/{name}", LAYOUT[name])
        at = f"v-{uuid.uuid4().hex}"
        (df[0].write.partitionBy(df[1]) if isinstance(df, tuple) else df.write).parquet(f"{self.path}/{name}/{at}")
        return at

    def _commit(self, made: dict[str, str | dict]) -> None:
        """The one file that names what counts is replaced last, so that readers see all of it or nothing. One writer at a time."""
        fs, new = self._file(f"next-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.versions() | made).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, self._file("current")[1], how)

    def put(self, **tables: DataFrame | tuple[DataFrame, str]) -> None:
        """Whole tables, written beside the old ones. One that comes with the name of a column is written in a folder for each of its values."""
        self._commit({name: self._written(name, df) for name, df in tables.items()})

    def merge(self, **changes: DataFrame | tuple[DataFrame, DataFrame]) -> None:
        """(rows, keys): of a table's buckets, those that keys fall in are written anew, without the rows that have one of the keys, and with
        the given rows. Only rows: the whole table, as in put(). All count from the same moment on."""
        have, made = self.versions(), {}
        for name, change in changes.items():
            rows, keys = change if isinstance(change, tuple) else (change, None)
            whole = keys is None or not isinstance(have.get(name), dict)
            made[name] = self._written(name, rows) if whole else buckets.merge(f"{self.path}/{name}", have[name], rows, keys)
        self._commit(made)

    def vacuum(self, hours: float = 24) -> int:
        """Deletes folders that no table is made of any more and that nothing has changed for so long, as older readers may still use them. Returns how many."""
        have, gone = self.versions(), 0
        for name, _ in buckets._folders(self.spark, self.path):
            for folder in buckets.unread(self.spark, f"{self.path}/{name}", [have.get(name)], hours):
                buckets.delete(self.spark, f"{self.path}/{name}/{folder}")
                gone += 1
        return gone

    def health(self) -> dict[str, str]:
        return store.health(self.spark)

    def stored(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one."""
        return self.table(name) if self._has(name) else self.spark.createDataFrame([], schema)

    def ingest(self, documents: DataFrame, tables: DataFrame | None = None, page_errors: DataFrame | None = None, ocr: providers.Provider | None = None) -> DataFrame:
        """documents: doc_id, text. Adds their evidence and page quality; documents of the same id are replaced. Returns their status.

        tables: cells (document_id, page, table_index, row, col, text) that an extractor found; page_errors: document_id,
        page, error; ocr: reads the pages of bad quality. Pages of pictures alone get a marker; a failure stays on its page."""
        units = evidence.lines(documents).withColumn("type", F.lit("TEXT"))
        pages = evidence.page_quality(units).withColumn("error", F.lit(None).cast("string"))
        if page_errors is not None:
            pages = pages.join(page_errors.select("document_id", "page", F.col("error").alias("e")), ["document_id", "page"], "full").withColumn("error", F.col("e")).drop("e")
            pages = pages.withColumn("has_images", F.coalesce("has_images", F.lit(False)))
        ids = documents.select(F.col("doc_id").cast("string").alias("document_id")).distinct()
        return self._ingested(ids, units, pages.withColumn("source_page_number", F.lit(None).cast("string")), tables, ocr)

    def ingest_files(self, files: DataFrame, reader: extractor.RangeExtractor, ocr: providers.Provider | None = None, pages_of_a_task: int = extractor.PAGES_OF_A_TASK) -> DataFrame:
        """files: document_id, content (as the binaryFile source gives it). From bytes to evidence: text blocks, tables, pictures and
        printed page numbers, by an extractor that reads a file's pages in stretches, several at a time. Each is read once. Returns the documents' status."""
        files = files.select(F.col("document_id").cast("string").alias("document_id"), "content")
        self.put(run_pages=extractor.read_ranges(files, reader, pages_of_a_task))
        read = extractor.labelled(self.table("run_pages"))
        self.put(run_tables=extractor.read_tables(files, self.table("run_pages").where("error is null"), reader, pages_of_a_task))
        units = extractor.text_blocks(read).withColumn("type", F.lit("TEXT"))
        failed = self.table("run_tables").where("error is not null").groupBy("document_id", "page").agg(F.min("error").alias("table_error"))
        known = read.join(failed, ["document_id", "page"], "left").select("document_id", "page", "width", "height", "has_images", "source_page_number", F.coalesce("error", "table_error").alias("error"))
        return self._ingested(files.select("document_id").distinct(), units, evidence.page_quality(units, known), extractor.table_cells(self.table("run_tables")), ocr)

    def _ingested(self, ids: DataFrame, units: DataFrame, pages: DataFrame, tables: DataFrame | None, ocr: providers.Provider | None) -> DataFrame:
        """Stores what was read of the documents `ids` in place of what is stored of them."""
        if ocr is not None:
            def asked_once(*given):
                self.put(ocr_answers=providers.apply(*given, lanes=self.lanes))
                return self.table("ocr_answers")

            units, pages = evidence.ocr_fallback(pages, units, ocr, asked_once)
        units = evidence.union(units, evidence.image_markers(pages, units))
        if tables is not None:
            last = units.groupBy("document_id", "page").agg((F.max("block_index") + 1).alias("next"))
            found = evidence.table_units(tables).join(last, ["document_id", "page"], "left")
            units = evidence.union(units, found.withColumn("block_index", F.coalesce("next", F.lit(0)) + F.col("place")).drop("next", "place", "n_rows", "n_cols"))
        made = units.withColumn("evidence_id", evidence.evidence_id(F.col("document_id"), F.col("page"), F.col("block_index"), F.col("type")))
        made = made.join(pages.select("document_id", "page", "source_page_number"), ["document_id", "page"], "left")
        wanted = [part.split(" ") for part in UNITS.split(", ")]
        made = made.select(*((F.col(n) if n in made.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted))
        status = ids.join(evidence.ingestion(pages, made), "document_id", "left").withColumns({"ingestion_status": F.coalesce("ingestion_status", F.lit("FAILED")), "created_at": F.current_timestamp()})
        fresh = {"documents": status, "pages": pages, "evidence": made}
        self.merge(**{n: (new, ids) for n, new in fresh.items()})
        return self.table("documents").join(ids, "document_id", "left_semi")

    def documents(self) -> DataFrame:
        """Documents in the order of listings: as they came, then by id."""
        return self.table("documents").orderBy("created_at", "document_id")

    def chunks(self, max_chars: int = chunking.MAX_CHARS, max_tokens: int | None = None, limit: int | None = None, start_page: int | None = None, end_page: int | None = None) -> DataFrame:
        """Units of evidence with their chunk_id, and whether the chunk is `selected`: of `limit` chunks that represent each document (None: all).

        Text is as a chunk shows it. A table's cells go with their table; one over the budget is split between rows, its header line
        in every part. Chunks are numbered before the window of pages is taken, so they are the same in every run. Where a page has over
        chunking.FOLD_UP_TO units or FOLD_CHARS characters, pages are packed by stretches, with the same result; what that writes goes with vacuum()."""
        units = self.table("evidence").withColumn("seq", F.col("block_index"))
        most = units.groupBy("document_id", "page").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).agg(F.max("n"), F.max("chars")).first()
        long = (most[0] or 0) > chunking.FOLD_UP_TO or (most[1] or 0) > chunking.FOLD_CHARS
        pack = functools.partial(stretches.packed, path=f"{self.path}/stretches") if long else chunking.packed
        placed = chunking.placed(units, max_chars, max_tokens, pack)
        placed = placed if start_page is None else placed.where(F.col("page") >= start_page)
        placed = placed if end_page is None else placed.where(F.col("page") <= end_page)
        if limit is not None:
            sums = placed.groupBy("document_id", "page", "chunk").agg(F.max((F.col("type") == "TABLE").cast("int")).alias("has_table"), F.least(F.lit(chunking.MOST_DIGITS), F.sum(F.regexp_count("text", F.lit(r"\p{Nd}")))).alias("digits"))
            placed = placed.join(chunking.selected(sums, limit).select("document_id", "page", "chunk", F.lit(True).alias("selected")), ["document_id", "page", "chunk"], "left")
        else:
            placed = placed.withColumn("selected", F.lit(True))
        return placed.withColumn("selected", F.coalesce("selected", F.lit(False))).withColumn("chunk_id", F.concat_ws(":", "document_id", "page", "chunk"))

    def extract_facts(self, provider: providers.Provider, limit: int | None = chunking.CHUNK_LIMIT, document_id: str | None = None, start_page: int | None = None, end_page: int | None = None, commit_every: int | None = None) -> DataFrame:
        """Drafts of a provider ({prompt} -> {raw}) for chunks, validated and stored. Returns the run's report by document.

        Of a document, `limit` representative chunks at most are sent, as the model's time is the bound; limit=None sends
        all, and the report counts what was left out. Chunks that were completed with the same content are skipped; a
        chunk whose answer fails or can't be read is FAILED and is sent again by the next run. Facts are added to those
        that are stored; one of the same identity is linked, not stored twice. commit_every: facts and progress are stored
        after about so many chunks each time, so that a run that is stopped loses no more than that."""
        units = self.chunks(limit=limit, start_page=start_page, end_page=end_page)
        units = units if document_id is None else units.where(F.col("document_id") == document_id)
        every = units.groupBy(*CHUNK, "chunk_id", "selected").agg(chunking.chunk_hash(F.collect_list("evidence_id")).alias("evidence_hash"), F.collect_list("evidence_id").alias("ids"))
        done = self.stored("extraction_chunks", PROGRESS).where("status = 'COMPLETED'").select(*CHUNK, "evidence_hash", F.lit(True).alias("done"))
        state = F.when(~F.col("selected"), "CAPPED").when(F.col("done"), "SKIPPED").otherwise("ASKED")
        self.put(run_chunks=every.join(done, [*CHUNK, "evidence_hash"], "left").withColumn("state", state))
        every = self.table("run_chunks")
        n = every.where("state = 'ASKED'").count()
        turns = max(1, -(-n // commit_every)) if commit_every else 1
        turn = F.pmod(F.xxhash64("chunk_id"), F.lit(turns))
        self.put(run_prompts=prompts.extraction(units.join(every.where("state = 'ASKED'").select("chunk_id"), "chunk_id", "left_semi")).withColumn("turn", turn).sortWithinPartitions("turn"))
        asked = self.table("run_prompts")
        told, made = every.where("state <> 'ASKED'").select("document_id", "state", F.lit(None).cast("string").alias("error")), None
        for i in range(turns):
            status, judged = self._extracted(asked.where(F.col("turn") == i), every, provider)
            told = told.unionByName(status.select("document_id", F.col("status").alias("state"), "error"))
            made = judged if made is None else made.unionByName(judged)
        self.put(extraction_report=extract.extraction_report(told, made))
        return self.table("extraction_report")

    def _extracted(self, asked: DataFrame, every: DataFrame, provider: providers.Provider) -> tuple[DataFrame, DataFrame]:
        """Asks for some chunks, and stores their facts and progress together. Returns the chunks' status and what became of the drafts."""
        answered = providers.apply(asked.select("chunk_id", "prompt"), provider, ["prompt"], "raw string", lanes=self.lanes).withColumn("d", extract.parsed_drafts(extract.repaired(F.col("raw"))))
        self.put(answers=answered.select("chunk_id", "d.drafts", F.coalesce("error", "d.error").alias("error")))  # a provider is asked once
        answered = self.table("answers")
        drafts = answered.where("error is null").select("chunk_id", F.posexplode("drafts").alias("i", "x")).join(every.select("chunk_id", "document_id", "evidence_hash"), "chunk_id")
        # The same place with other content gives other drafts.
        drafts = drafts.select("chunk_id", "document_id", F.format_string("%s#%s#%06d", "chunk_id", "evidence_hash", "i").alias("draft_id"), "x.*")
        made = extract.facts(drafts, every.select("chunk_id", "ids")).withColumn("fact_id", F.sha2("draft_id", 256))
        valid = extract.split_new(made.where("rejected is null"), self.table("facts") if self._has("facts") else None)
        judged = valid.select("draft_id", "kept_id", "is_new", "document_id", F.lit(None).cast("string").alias("rejected")).unionByName(made.where("rejected is not null").select("draft_id", F.lit(None).cast("string").alias("kept_id"), F.lit(False).alias("is_new"), "document_id", "rejected"))
        fresh = extract.normalise(valid.where("is_new").drop("rejected", "draft_id", "kept_id", "is_new"))
        self.put(run_drafts=judged.withColumn("chunk_id", F.regexp_replace("draft_id", "#[^#]*#[^#]*$", "")), run_facts=fresh)
        judged, fresh = self.table("run_drafts"), self.table("run_facts")
        linked = judged.where("kept_id is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_set("kept_id")).alias("fact_ids"))
        status = every.join(answered.select("chunk_id", "error"), "chunk_id").join(linked, "chunk_id", "left")
        status = status.select(*CHUNK, "evidence_hash", F.when(F.col("error").isNull(), "COMPLETED").otherwise("FAILED").alias("status"), "error", F.coalesce("fact_ids", F.array().cast("array<string>")).alias("fact_ids"))
        self.merge(facts=(fresh, fresh.select("fact_id")), extraction_chunks=(status, status.select(CHUNK)))
        return status, judged

    def normalize(self) -> DataFrame:
        """Canonical values, and names by the abbreviations that the evidence defines and what each document calls itself. Returns the report."""
        facts = extract.normalise(self.table("facts"))
        self.put(facts=canonical.resolved_names(facts, self.table("evidence")))
        return extract.normalization_report(self.table("facts"))

    def normalize_changes(self) -> DataFrame:
        """What normalize() gives, at the cost of what has changed since the last such call: only documents that were ingested anew are
        searched for definitions, and only facts are rewritten that are new or changed, that hold a word whose long form has changed,
        or whose document calls itself something else. Returns one row: documents (searched), words (with another long form), facts (rewritten)."""
        now = self.table("documents").select("document_id", F.col("created_at").cast("string").alias("version"))
        self.put(run_documents=glossary.changed(now, self.stored("glossary_seen", glossary.SEEN), "document_id", "version"))
        documents = self.table("run_documents")
        self.put(run_definitions=glossary.definitions(self.rows_of("evidence", documents, UNITS)))
        new, old = self.table("run_definitions"), self.rows_of("definitions", documents, glossary.DEFINITIONS)
        self.put(run_shifts=glossary.shifts(old, new))
        moved = self.table("run_shifts")
        touched = moved.select("abbreviation").distinct()
        self.put(run_totals=glossary.totals(self.rows_of("glossary_totals", touched, glossary.TOTALS), moved))
        totals, before = self.table("run_totals"), self.stored("glossary", glossary.MAP)
        rest = self.stored("glossary_totals", glossary.TOTALS).join(touched, "abbreviation", "left_anti")
        self.put(run_glossary=canonical.alias_map(rest.select(totals.columns).unionByName(totals)))
        after = self.table("run_glossary")
        words, renamed = glossary.changed(after, before, "abbreviation", "long_form"), glossary.changed(glossary.issuers(new), glossary.issuers(old), "document_id", "issuer")

        facts = self.table("facts")
        # Without any alias names stay as they are written; with the first one, and with the last one gone, all are looked at again.
        if after.isEmpty() == before.isEmpty():
            fresh = glossary.changed(glossary.stamped(facts), self.stored("name_stamps", glossary.STAMPS), "fact_id", "stamp")
            ids = fresh.unionByName(glossary.reached(facts, words, renamed)).distinct()
        else:
            ids = facts.select("fact_id")
        self.put(run_ids=ids)
        ids = self.table("run_ids")
        asked = extract.normalise(self.rows_of("facts", ids, glossary.STAMPS))
        here = asked.select("document_id").distinct()
        kept = self.stored("definitions", glossary.DEFINITIONS).join(documents, "document_id", "left_anti").select(new.columns).unionByName(new)
        self.put(run_named=canonical.renamed(asked, after, glossary.issuers(kept.join(here, "document_id", "left_semi"))))
        named = self.table("run_named")
        self.merge(facts=(named, ids), name_stamps=(glossary.stamped(named), ids), definitions=(new, documents), glossary_totals=(totals, touched), glossary=after, glossary_seen=(now.join(documents, "document_id", "left_semi"), documents))
        return self.spark.createDataFrame([(documents.count(), words.count(), ids.count())], "documents bigint, words bigint, facts bigint")

    def facts(self, document_id: str | None = None) -> DataFrame:
        out = self.table("facts").withColumns({"comparability": comparability(), "missing": missing()})
        return out if document_id is None else out.where(F.col("document_id") == document_id)

    def fact(self, fact_id: str) -> DataFrame:
        """One fact with its evidence ids in order; no row where there is none."""
        return self.of("facts", [fact_id]).withColumn("evidence_ids", F.array_sort("evidence_ids"))

    def evidence_of(self, fact_id: str, chars: int = 2000) -> DataFrame:
        """The stored evidence that a fact names, its text cut for display."""
        one = self.fact(fact_id)
        named = one.select(F.explode("evidence_ids").alias("evidence_id"))
        return self.of("evidence", [r.document_id for r in one.select("document_id").collect()]).join(named, "evidence_id", "left_semi").withColumn("text", F.substring("text", 1, chars)).orderBy("page", "evidence_id")

    def evidence(self, document_id: str) -> DataFrame:
        """Evidence of a document in the order of listings: by page, then id."""
        return self.of("evidence", [document_id]).orderBy("page", "evidence_id")

    def pages(self, document_id: str) -> DataFrame:
        return self.of("pages", [document_id]).orderBy("page")

    def pairs(self) -> DataFrame:
        """Relationships in the order of listings: by both facts."""
        return self.table("relationships").orderBy("fact_a_id", "fact_b_id")

    def vectors(self, fact_ids: list[str]) -> DataFrame:
        """Vectors of the facts that have one."""
        return self.of("fact_embeddings", fact_ids) if self._has("fact_embeddings") else self.spark.createDataFrame([], VECTORS)

    def progress(self, document_id: str) -> DataFrame:
        found = self.of("extraction_chunks", [document_id]) if self._has("extraction_chunks") else self.spark.createDataFrame([], PROGRESS)
        return found.orderBy("page", "chunk")

    def put_files(self, files: DataFrame) -> None:
        """files: document_id, content. Replaces the files of the same documents."""
        self.merge(files=(files.select("document_id", "content"), files.select("document_id")))

    def file(self, document_id: str) -> DataFrame:
        return self.of("files", [document_id]) if self._has("files") else self.spark.createDataFrame([], FILES)

    def embed(self, provider: providers.Provider) -> None:
        """Vectors for facts that have none."""
        old = self.table("fact_embeddings") if self._has("fact_embeddings") else self.spark.createDataFrame([], VECTORS)
        texts = store.missing_vectors(self.table("facts"), old).withColumn("t", extract.embedding_text())
        self.put(run_vectors=providers.embedded(texts, "t", provider, self.lanes))  # a provider is asked once
        new = self.table("run_vectors")
        self.merge(fact_embeddings=(new, new.select("fact_id")))

    def match(self, document_id: str | None = None, compare_with: list[str] | None = None, include_same_document: bool = False, recompute: bool = False, judge: providers.Provider | None = None, up_to: int = candidates.EXHAUSTIVE_UP_TO) -> DataFrame:
        """Relationships of eligible pairs, merged into those that are stored. Returns the counts of the run by type.

        document_id: pairs with a fact of this document, against all others or those in compare_with (without it, all
        pairs of the documents in compare_with). Beyond `up_to` pairs only the best candidates of each fact are compared.
        Pairs that are stored are left out before they are compared, unless recompute is set. judge: decides pairs that
        need it, by their prompt; where it fails, the pair waits for review with the reason."""
        facts = match.scoped(self.table("facts"), document_id, compare_with)
        pairs, _ = candidates.chosen(facts, document_id, self._fact_vectors(), include_same_document, up_to)
        stored = self.stored("relationships", RELATIONSHIPS)
        found = self._compared(facts, pairs if recompute else match.unstored(pairs, stored), judge)
        new = match.with_old_ids(found, stored) if recompute else found
        self.merge(relationships=(new.select(found.columns), found.select(PAIR)))
        return found.groupBy("relationship_type").count()

    def _fact_vectors(self) -> DataFrame | None:
        return self.table("fact_embeddings") if self._has("fact_embeddings") else None

    def _compared(self, facts: DataFrame, pairs: DataFrame, judge: providers.Provider | None) -> DataFrame:
        """Relationships of the pairs, written out, as a judge is asked once."""
        typed = match.typed(pairs)
        found = match.verdict_columns(typed)
        if judge is not None:
            asked = prompts.judgment(match.with_excerpts(typed.where("needs_llm"), facts, self.table("evidence")))
            raw = providers.apply(asked.select(F.col("a_fact_id").alias("fact_a_id"), F.col("b_fact_id").alias("fact_b_id"), "prompt"), judge, ["prompt"], "raw string", lanes=self.lanes)
            found = match.judged(found, raw.select("fact_a_id", "fact_b_id", "raw", "error"))
        self.put(run_pairs=found.select([c.split()[0] for c in RELATIONSHIPS.split(", ")]))
        return self.table("run_pairs")

    def match_changes(self, include_same_document: bool = False, judge: providers.Provider | None = None, up_to: int = candidates.EXHAUSTIVE_UP_TO) -> DataFrame:
        """Relationships of the whole workspace after facts were added, changed or removed: what a run from scratch gives, at the cost of what has changed.

        Only facts whose content differs from the last such run meet the others; pairs of facts that say what they said keep
        their verdicts and judgments. The first run, and one with other switches, compares everything. Returns one row: new,
        changed, gone (facts), compared (relationships made anew), kept and mode."""
        facts, stored = self.table("facts"), self.stored("relationships", RELATIONSHIPS)
        settings = f"same_document={include_same_document}"
        now = delta.state(facts)
        last = self.table("match_run").first() if self._has("match_run") else None
        all_pairs = candidates.space(facts, include_same_document).first().pairs <= up_to
        # After a ranked run, pairs that were never compared are missing from a run over all pairs.
        usable = last is not None and last.settings == settings and (last.mode == "exhaustive" or not all_pairs)
        before = self.table("match_state") if usable else self.spark.createDataFrame([], delta.STATE)
        self.put(match_changes=delta.difference(now, before))
        changes = self.table("match_changes")
        pairs, kept, mode = delta.pairs(facts, changes, stored if usable else stored.limit(0), self._fact_vectors(), include_same_document, up_to)
        found = self._compared(facts, pairs, judge)
        run = self.spark.createDataFrame([(settings, mode)], "settings string, mode string")
        if usable:
            # Pairs that lose their verdict, and those that get one.
            self.put(run_keys=stored.select(PAIR).join(kept.select(PAIR), PAIR, "left_anti").unionByName(found.select(PAIR)))
            self.merge(relationships=(found, self.table("run_keys")), match_state=now, match_run=run)
        else:
            self.put(relationships=found, match_state=now, match_run=run)
        sums = changes.agg(delta.counts(changes).alias("c")).select("c.*")
        made, all_now = found.count(), self.table("relationships").count()
        return sums.withColumns({"compared": F.lit(made), "kept": F.lit(all_now - made), "mode": F.lit(mode)})

    def relationships(self, document_id: str, relationship_type: str | None = None, min_confidence: float = 0.0) -> DataFrame:
        return match.touching(self.table("relationships"), self.table("facts"), document_id, relationship_type, min_confidence)

    def relationship(self, relationship_id: str) -> DataFrame:
        """One relationship with both facts, and the evidence of each: a_evidence and b_evidence."""
        one = self.table("relationships").where(F.col("relationship_id") == relationship_id)
        return match.detailed(one, self.table("facts"), self.table("evidence"))

    def index_search(self) -> None:
        """Posting lists for the facts as they are now; search() and search_many() read them until the facts change."""
        facts = self.table("facts")
        self.put(postings=(postings.laid_out(postings.index(facts)), "bucket"))
        often = postings.frequencies(self.table("postings"))
        self.put(grams=often, postings_of=self.spark.createDataFrame([(self._stamp("facts"),)], "facts string"))

    def _indexed(self) -> bool:
        return self._has("postings_of") and self.table("postings_of").first().facts == self._stamp("facts")

    def _stamp(self, name: str) -> str:
        """Another one whenever a table has changed."""
        return json.dumps(self.versions()[name], sort_keys=True)

    def search_many(self, queries: DataFrame, limit: int = search.LIMIT, min_score: float = 0.0) -> DataFrame:
        """queries: query_id, text, and maybe document_id. Hits of each query by words: query_id, fact_id, score, rank."""
        if not 1 <= limit <= 100:
            raise ValueError("limit is from 1 to 100")
        if not self._indexed():
            self.index_search()
        pools = postings.lexical_pools(queries, self.table("postings"), self.table("grams"), self.table("facts"), limit)
        return postings.hits_of_each(pools, limit, min_score)

    def search(self, query: str, provider: providers.Provider | None = None, document_id: str | None = None, limit: int = search.LIMIT, min_score: float = 0.0) -> DataFrame:
        """Hits by words and, with a provider, by vector. Words are looked up in the posting lists where there are some of the facts as they are, else facts are scanned."""
        if not 1 <= limit <= 100:
            raise ValueError("limit is from 1 to 100")
        facts, vector, asked = self.table("facts"), None, search.query_tokens(query)
        if provider is not None and self._has("fact_embeddings"):
            v = self.table("fact_embeddings")
            own = v if document_id is None else v.join(facts.where(F.col("document_id") == document_id), "fact_id", "left_semi")
            vector = search.vector_pool(own, provider.run([{"text": " ".join(asked)}])[0]["vector"], limit)
        if self._indexed():
            one = self.spark.createDataFrame([(0, query, document_id)], "query_id int, text string, document_id string")
            lexical = postings.lexical_pools(one, self.table("postings"), self.table("grams"), facts, limit).drop("query_id")
        else:
            lexical = search.lexical_pool(facts, query, limit, document_id)
        hits = search.hits(lexical, vector, limit, min_score)
        return search.hydrated(hits, facts, self.table("evidence"), self.table("relationships") if self._has("relationships") else self.spark.createDataFrame([], RELATIONSHIPS))
