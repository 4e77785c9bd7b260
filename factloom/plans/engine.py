"""Queries over the engine's larger operators: nearest-neighbour joins, matching of changes, posting lists, files, and a workspace's chunks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import candidates as cand
from factloom.operators import canonical, chunking, delta, evidence, glossary, match, nearest, postings, stretches
from factloom.operators import compare as cmp
from factloom.plans.pairs import _ID, _PAIRS, _REL, REL_COLUMNS, facts
from factloom.plans.values import _SAID
from factloom.plans.values import ORACLES as VALUES_SQL
from factloom.sources import buckets, extractor
from factloom.sources.views import DEFINITIONS, FACTS, duck, read, view

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is set, a session of one machine gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder, so that what is used several times is made once."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def deleted(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more, and lets go of shuffles that nothing uses."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    spark.sparkContext._jvm.System.gc()  # files of unreachable shuffles are cleaned after a collection


# --- nearest neighbours ----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.label <> c.label)
SELECT query_id, candidate_id, row_number() OVER w AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, candidate_id) QUALIFY rank <= 5""")
def nearest_join(spark, sf_dir):
    """Every vector asks for the five nearest of other labels, however far."""
    e = read(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"), F.col("embedding").alias("v"))  # as given: half of what doubles take
    return nearest.neighbours(v, v, 5, store=written, drop=deleted).select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# --- changes ---------------------------------------------------------------------------------------------------


def earlier(now: DataFrame) -> DataFrame:
    """The facts as an earlier run saw them: some weren't there, some had other values or names, and some have gone since."""
    k = F.substring("fact_id", 3, 2).cast("int")
    old = now.where("h <> 4").withColumn("normalized_number", F.when(k % 5 == 0, F.col("normalized_number") * 1.5).otherwise(F.col("normalized_number")))
    old = old.withColumn("canonical_subject", F.when(k % 7 == 3, "somewhere else").otherwise(F.col("canonical_subject")))
    gone = now.where(k % 6 == 1).withColumn("fact_id", F.concat("fact_id", F.lit("-old")))
    return old.unionByName(gone)


@query(_REL + "SELECT " + ", ".join(REL_COLUMNS) + " FROM rel")
def match_delta(spark, sf_dir):
    """A run over an earlier state of the facts, then one over what has changed since: as one run from scratch."""
    now = facts(spark, sf_dir)
    before = earlier(now)
    stored = match.verdicts(before).select(REL_COLUMNS)
    pairs, kept, _ = delta.pairs(now, delta.difference(delta.state(now), delta.state(before)), stored)
    return kept.unionByName(match.verdicts(now, pairs=pairs).select(REL_COLUMNS))


@query(_REL.replace("WITH ", "WITH ", 1) + """SELECT CASE WHEN h = 4 THEN 'NEW' ELSE 'CHANGED' END AS change, count(*) AS n FROM f WHERE h = 4 OR (CAST(substr(fact_id, 3, 2) AS INT) % 5 = 0 AND normalized_number * 1.5 <> normalized_number) OR (CAST(substr(fact_id, 3, 2) AS INT) % 7 = 3 AND canonical_subject IS DISTINCT FROM 'somewhere else') GROUP BY 1
UNION ALL SELECT 'GONE', count(*) FROM f WHERE CAST(substr(fact_id, 3, 2) AS INT) % 6 = 1""")
def fact_changes(spark, sf_dir):
    """How many facts are new, changed and gone since the earlier state."""
    now = facts(spark, sf_dir)
    return delta.difference(delta.state(now), delta.state(earlier(now))).groupBy("change").agg(F.count("*").alias("n"))


@query(VALUES_SQL["normalize_names"])
def names_delta(spark, sf_dir):
    """Names as an earlier state of the documents gave them, then rewritten where the documents that have changed since reach them: as one run over all."""
    now, said = view(spark, sf_dir, DEFINITIONS), view(spark, sf_dir, _SAID)
    changed = F.col("document_id").isin("doc-3", "doc-7", "doc-11")
    before = now.where("document_id <> 'doc-11'").withColumn("text", F.when(changed, F.regexp_replace("text", "Gross Fixed|Alpha", "Great Former")).otherwise(F.col("text")))
    stored, new = written(glossary.definitions(before)), written(glossary.definitions(now.where(changed)))
    pairs = stored.where("kind = 'GENERAL'").groupBy(glossary.FORM).agg(F.sum("n").alias("n"))
    moved = written(glossary.shifts(stored.where(changed), new))
    totals = pairs.join(moved.select("abbreviation").distinct(), "abbreviation", "left_anti").select(*glossary.FORM, "n").unionByName(glossary.totals(pairs, moved))
    maps = written(canonical.alias_map(pairs)), written(canonical.alias_map(totals))
    own = written(glossary.issuers(stored)), written(glossary.issuers(stored.where(~changed).unionByName(new)))
    old = canonical.renamed(said, maps[0], own[0])
    spoken = said.select("fact_id", "document_id", F.col("canonical_subject").alias("subject"), F.col("canonical_predicate").alias("predicate"))
    ids = written(glossary.reached(spoken, glossary.changed(maps[1], maps[0], "abbreviation", "long_form"), glossary.changed(own[1], own[0], "document_id", "issuer")))
    return old.join(ids, "fact_id", "left_anti").select(said.columns).unionByName(canonical.renamed(said.join(ids, "fact_id", "left_semi").select(said.columns), maps[1], own[1]))


# --- posting lists ---------------------------------------------------------------------------------------------

#: Parts as facts, and every fiftieth part's name, cut, as a query with its brand.
_PART_QUERIES = "SELECT p_partkey AS query_id, substr(p_name, 2, 4) || ' ' || substr(p_brand, 4) || ' ' || p_size::VARCHAR AS text FROM part WHERE p_partkey % 50 = 0"


def part_facts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("fact_id"), F.lit("catalogue").alias("document_id"), F.col("p_name").alias("subject"), F.col("p_brand").alias("predicate"), F.col("p_size").cast("string").alias("value_text"), F.col("p_type").alias("unit"))


@query(f"""WITH f AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS fact_id, lower(p_name || chr(10) || p_brand || chr(10) || p_size::VARCHAR || chr(10) || p_type) AS text, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_size::VARCHAR || ' ' || p_type), '[a-z0-9]+')) AS words FROM part),
q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM ({_PART_QUERIES}) x), t AS (SELECT query_id, unnest(words) AS token FROM q),
h AS (SELECT DISTINCT query_id, fact_id FROM t JOIN f ON contains(f.text, t.token)), p AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fact_id) <= 100),
s AS (SELECT query_id, fact_id, len(list_intersect(f.words, q.words))::DOUBLE / len(list_distinct(list_concat(f.words, q.words))) AS score FROM p JOIN f USING (fact_id) JOIN q USING (query_id))
SELECT query_id, fact_id, round(score, 9) AS score, row_number() OVER w AS rank FROM s WHERE score > 0 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, fact_id) QUALIFY rank <= 20""")
def search_postings(spark, sf_dir):
    """A batch of searches over parts by their posting lists."""
    f = part_facts(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fact_id")  # a small file with much to do for each row
    p = read(spark, sf_dir, "part")
    queries = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", F.substring("p_name", 2, 4), F.substring("p_brand", 4, 99), F.col("p_size").cast("string")).alias("text"))
    lists = written(postings.index(f))
    pools = postings.lexical_pools(queries, lists, written(postings.frequencies(lists)), f)
    return postings.hits_of_each(pools).select("query_id", "fact_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- files -----------------------------------------------------------------------------------------------------

#: Lines that hold a letter or digit.
_LINE = "[A-Za-z0-9]"


def files(spark, sf_dir) -> DataFrame:
    """Documents as files of pages: twenty lines each, parted by form feeds; every third document prints page numbers, every seventh can't be read."""
    lines = F.filter(F.split(F.translate("text", "\f\r\x0b", "   "), "\n", -1), lambda x: F.rlike(x, F.lit(_LINE)))
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines.alias("lines")).withColumn("n", F.ceil(F.size("lines") / 20).cast("int"))
    label = lambda i: F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[page "), (i + 5).cast("string"), F.lit("]\n"))).otherwise("")
    pages = F.transform(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1), lambda i: F.concat(label(i), F.array_join(F.slice("lines", i * 20 + 1, F.lit(20)), "\n")))
    content = F.when(F.col("doc_id") % 7 == 6, F.unhex(F.lit("FFFE"))).when(F.col("n") == 0, F.lit(b"")).otherwise(F.encode(F.array_join(pages, "\f"), "utf-8"))
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), content.alias("content"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_LINE}')) AS lines FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 6),
x AS (SELECT doc_id, unnest(generate_series(0, len(lines) - 1)) // 20 AS page FROM l WHERE len(lines) > 0)
SELECT doc_id::VARCHAR AS document_id, page::INTEGER AS page, count(*) AS n_lines, CASE WHEN doc_id % 3 = 0 THEN (page + 5)::VARCHAR END AS source_page_number, NULL::VARCHAR AS error FROM x GROUP BY doc_id, page
UNION ALL SELECT doc_id::VARCHAR, 0, 0, NULL, 'UnicodeDecodeError' FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 6 UNION ALL SELECT doc_id::VARCHAR, 0, 0, NULL, NULL FROM l WHERE len(lines) = 0""")
def ingest_files(spark, sf_dir):
    """Files in, lines with printed page numbers out; a file that can't be read says why."""
    pages = extractor.labelled(extractor.read_ranges(files(spark, sf_dir), extractor.PlainPages(), pages_of_a_task=4))
    lines = extractor.text_blocks(pages).groupBy("document_id", "page").agg(F.sum(F.size(F.split("text", "\n", -1))).alias("n"))
    out = pages.join(lines, ["document_id", "page"], "left")
    return out.select("document_id", "page", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), "source_page_number", F.substring_index("error", ":", 1).alias("error"))


# --- chunks ----------------------------------------------------------------------------------------------------


def order_tables(spark, sf_dir) -> DataFrame:
    """Lines of orders as tables, one page for each 40 orders: cells (document_id, page, table_index, row, col, text)."""
    k = F.col("l_orderkey")
    place = [F.floor(k / 4000).cast("string").alias("document_id"), F.floor(k / 40).cast("int").alias("page")]
    found = read(spark, sf_dir, "lineitem").select(*place, "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey").repartition("document_id", "page")
    l = found.groupBy("document_id", "page", "l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_quantity").cast("int").alias("quantity"), F.min("l_partkey").alias("part"))
    body = F.array(F.col("flag"), F.col("quantity").cast("string"), F.concat(F.lit("part number "), F.col("part").cast("string")))
    head = F.array(F.lit("Flag"), F.lit("Quantity"), F.lit("Part"))
    row = lambda at, cells: F.struct(at.cast("int").alias("row"), cells.alias("cells"))
    own, first = row(k % 40 * 8 + F.col("l_linenumber"), body), F.row_number().over(Window.partitionBy("document_id", "page").orderBy("l_orderkey", "l_linenumber")) == 1
    # A page's first line brings the header along.
    rows = l.withColumn("rows", F.when(first, F.array(row(F.lit(-1), head), own)).otherwise(F.array(own))).select("document_id", "page", F.explode_outer("rows").alias("x"))
    each = rows.select("document_id", "page", "x.row", F.posexplode_outer("x.cells").alias("col", "text"))
    return each.select("document_id", "page", F.lit(0).alias("table_index"), "row", "col", "text")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_returnflag) AS flag, min(l_quantity)::INTEGER::VARCHAR AS q, 'part number ' || min(l_partkey)::VARCHAR AS part FROM lineitem GROUP BY ALL),
r AS (SELECT k // 40 AS page, row_number() OVER (PARTITION BY k // 40 ORDER BY k, n) - 1 AS row, length(flag) + length(q) + length(part) AS cells FROM l),
t AS (SELECT page, count(*) AS rows, sum(cells) AS cells, sum(cells + 7) + 18 AS whole FROM r GROUP BY page)
SELECT page::INTEGER AS page, rows::BIGINT AS n_rows, (3 * rows)::BIGINT AS n_cells, true AS within, (cells + whole + 38 > 2500) AS split FROM t""")
def workspace_chunks(spark, sf_dir):
    """Tables cut between rows under their budget: every row and cell once, the header line in every part, no part over the budget."""
    units = evidence.table_units(order_tables(spark, sf_dir)).select("document_id", "page", F.col("place").alias("seq"), "type", "text", "table_index", "headers", "row", "col")
    placed = chunking.placed(units)
    cell = F.col("type") == "TABLE_CELL"
    page, sums = ["document_id", "page"], ("chars", "tables", "heads", "n_cells")
    lines = placed.groupBy(*page, "chunk", F.when(cell, F.col("row")).alias("row")).agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("type") == "TABLE").alias("tables"), F.count_if(F.col("text").startswith("Table 0 (columns: Flag | Quantity | Part):")).alias("heads"), F.count_if(cell).alias("n_cells"))
    chunks = lines.groupBy(*page, "chunk").agg(*(F.sum(n).alias(n) for n in sums), F.collect_list("row").alias("rows"))
    pages = chunks.groupBy(*page).agg((F.max("chars") <= chunking.MAX_CHARS).alias("fits"), F.count_if((F.col("tables") != 1) | (F.col("heads") != 1)).alias("odd"), (F.count("*") > 1).alias("split"), F.size(F.array_distinct(F.flatten(F.collect_list("rows")))).cast("long").alias("n_rows"), F.sum("n_cells").alias("n_cells"))
    return pages.where("n_cells > 0").select("page", "n_rows", "n_cells", (F.col("fits") & (F.col("odd") == 0)).alias("within"), "split")


@query("""WITH RECURSIVE i AS (SELECT supplier, row_number() OVER (PARTITION BY supplier ORDER BY k, n) AS i, k, n, quantity AS c, part % 7 AS t, k % 97 = 0 AS opens
  FROM (SELECT l_orderkey AS k, l_linenumber AS n, min(l_suppkey) AS supplier, min(l_quantity)::BIGINT AS quantity, min(l_partkey) AS part FROM lineitem GROUP BY ALL) l),
r AS (SELECT *, 0::BIGINT AS chunk, c AS sc, t AS st FROM i WHERE i = 1 UNION ALL
  SELECT i.*, CASE WHEN i.opens OR sc + i.c > 180 OR st + i.t > 25 OR r.c > 180 OR r.t > 25 THEN chunk + 1 ELSE chunk END, CASE WHEN i.opens OR sc + i.c > 180 OR st + i.t > 25 OR r.c > 180 OR r.t > 25 THEN i.c ELSE sc + i.c END, CASE WHEN i.opens OR sc + i.c > 180 OR st + i.t > 25 OR r.c > 180 OR r.t > 25 THEN i.t ELSE st + i.t END
  FROM r JOIN i ON i.supplier = r.supplier AND i.i = r.i + 1)
SELECT supplier, k AS order_id, n::INTEGER AS line, chunk FROM r""")
def long_pages(spark, sf_dir):
    """A supplier's lines as one page, packed by stretches of 64 lines; some lines begin a chunk."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("page"), F.min("l_quantity").cast("long").alias("chars"), (F.min("l_partkey") % 7).alias("tokens"))
    units = l.select(F.lit("lines").alias("document_id"), "page", F.struct("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber")).alias("item"), "chars", "tokens", (F.col("l_orderkey") % 97 == 0).alias("opens"))
    packed = stretches.packed(units, 180, 25, path=scratch(spark), stretch=64)
    return packed.select(F.col("page").alias("supplier"), F.col("item.l_orderkey").alias("order_id"), F.col("item.l_linenumber").alias("line"), "chunk")


# --- pairs of many facts ---------------------------------------------------------------------------------------

#: Claims of two catalogues on each part's price. They grow with the parts; a part's own words outweigh those that many names share.
PRICES = """
WITH n AS (SELECT *, CAST(p_partkey AS STRING) AS t FROM {part}),
p AS (SELECT p_partkey AS k, p_name || ' Item' || t || ' Lot' || t || ' Ref' || t || ' Box' || t || ' Bin' || t || ' Tag' || t || ' Row' || t AS name, p_type, p_retailprice AS v, CAST(p_partkey % 10 AS INT) AS h FROM n),
s AS (SELECT 'A' AS side, p.*, v AS x FROM p UNION ALL SELECT 'B', p.*, CASE WHEN h IN (1, 2) THEN v * 1.005e0 WHEN h > 6 THEN v * 1.4e0 ELSE v END FROM p)
SELECT side || '-' || lpad(CAST(k AS STRING), 9, '0') AS fact_id, 'catalogue-' || side AS document_id, name AS subject,
  CASE WHEN h = 3 THEN NULL ELSE lower(name) END AS canonical_subject, CASE WHEN side = 'B' AND h IN (4, 8) THEN 'price paid' ELSE 'price' END AS predicate,
  CASE WHEN h = 3 THEN NULL WHEN side = 'B' AND h IN (4, 8) THEN 'price paid' ELSE 'price' END AS canonical_predicate, 'NUMERIC' AS value_kind, CAST(CAST(x AS DECIMAL(18,2)) AS STRING) AS value_text, x AS value_number,
  'USD' AS unit, x AS normalized_number, CASE WHEN h = 5 THEN NULL ELSE 'USD' END AS normalized_unit, CASE WHEN h = 6 AND side = 'B' THEN 'FY2023' WHEN h = 7 THEN NULL ELSE 'FY2024' END AS time_text,
  CASE WHEN h = 7 THEN 'UNKNOWN' ELSE 'FISCAL_YEAR' END AS time_kind, CAST(NULL AS DATE) AS time_start, CAST(NULL AS DATE) AS time_end, CASE WHEN h = 9 AND side = 'B' THEN NULL ELSE 'list' END AS scope_text, 'ACTUAL' AS estimate_status, p_type AS geography, h
FROM s
"""


def prices(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, PRICES)


#: Every pair of facts, one by one: hours for many parts, so it is held against the query on few.
PRICES_SQL = _PAIRS.replace(duck(FACTS), duck(PRICES)) + f"SELECT {_ID}, rule AS rule_id, kind AS relationship_type, conf AS confidence, ask AS needs_llm FROM t WHERE rule <> 'R9'"


@query()
def classify_prices(spark, sf_dir):
    """Pairs of facts that grow with the parts, by rule: each verdict needs words, names or a claim in common."""
    return cmp.classified(cand.related(prices(spark, sf_dir), store=written)).where("rule_id <> 'R9'").select("a_fact_id", "b_fact_id", "rule_id", "relationship_type", "confidence", "needs_llm")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 40 = 3 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 40 <> 5 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 100 = 9""")
def bucket_merge(spark, sf_dir):
    """Customers in buckets: some change, some go, some come."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    path = f"{scratch(spark)}/customers-{uuid.uuid4().hex}"
    table = buckets.write(c, path, ["c_custkey"])
    new = c.where("c_custkey % 40 = 3").withColumn("segment", F.lit("changed")).unionByName(c.where("c_custkey % 100 = 9").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("segment")))
    keys = new.select("c_custkey").union(c.where("c_custkey % 40 = 5").select("c_custkey"))
    return buckets.read(spark, path, buckets.merge(path, table, new, keys))
