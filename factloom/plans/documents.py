"""Queries over evidence, chunks, drafts, search and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import chunking, evidence, extract, search
from factloom.plans.pairs import _FACTS, _REL, _tok, facts, relationships
from factloom.sources import extractor, store
from factloom.sources.views import EVIDENCE_SQL, read
from factloom.streaming import progress

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def units(spark, sf_dir) -> DataFrame:
    return evidence.lines(read(spark, sf_dir, "documents"))


# --- evidence --------------------------------------------------------------------------------------------------

_E = f"e AS ({EVIDENCE_SQL})"
_ODD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]"
_STATS = rf"""{_E}, s AS (SELECT document_id, page, sum(length(text))::BIGINT AS char_count, sum(len(list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda w: w <> '')))::BIGINT AS word_count,
sum(length(text) - length(regexp_replace(text, '{_ODD}', '', 'g')))::BIGINT AS odd FROM e GROUP BY document_id, page), stats AS (SELECT *, coalesce(odd::DOUBLE / nullif(char_count, 0), 0) AS suspicious_ratio FROM s)"""
_QUALITY = f"""{_STATS}, q AS (SELECT *, (document_id::BIGINT * 3 + page) % 7 = 0 AS has_images FROM stats),
quality AS (SELECT *, greatest(0e0, least(1e0, (0.6e0 * least(char_count / 500e0, 1e0) + 0.4e0 * least(word_count / 100e0, 1e0)) * (1 - suspicious_ratio) * (1 - suspicious_ratio) * CASE WHEN has_images AND char_count < 50 THEN 0.5e0 ELSE 1e0 END)) AS score FROM q)"""


@query(f"WITH {_STATS} SELECT document_id, page, char_count, word_count, round(suspicious_ratio, 9) AS suspicious_ratio FROM stats")
def page_stats(spark, sf_dir):
    return evidence.page_stats(units(spark, sf_dir)).withColumn("suspicious_ratio", F.round("suspicious_ratio", 9))


@query(f"WITH {_QUALITY} SELECT document_id, page, has_images, round(score, 9) AS extraction_quality, CASE WHEN score >= 0.35e0 THEN 'GOOD' ELSE 'BAD' END AS quality_verdict FROM quality")
def page_quality(spark, sf_dir):
    return evidence.page_quality(units(spark, sf_dir), pictured=evidence.has_images(F.col("document_id"), F.col("page"))).select("document_id", "page", "has_images", F.round("extraction_quality", 9).alias("extraction_quality"), "quality_verdict")


_ERROR = "CASE WHEN (CAST(document_id AS BIGINT) * 5 + page) % 11 = 0 THEN 'unreadable' END"


@query(f"""WITH {_E}, p AS (SELECT DISTINCT document_id, page, {_ERROR} AS error FROM e), u AS (SELECT document_id, count(*) AS n FROM e WHERE {_ERROR} IS NULL GROUP BY document_id),
d AS (SELECT document_id, count(*) AS page_count, count(error) AS bad_pages FROM p GROUP BY document_id)
SELECT document_id, page_count, bad_pages, coalesce(n, 0) AS evidence_count, CASE WHEN bad_pages = 0 THEN 'COMPLETED' WHEN n > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS ingestion_status FROM d LEFT JOIN u USING (document_id)""")
def ingest_status(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("error", F.expr(_ERROR))
    return evidence.ingestion(u.select("document_id", "page", "error").distinct(), u.where("error is null"))


@query(f"""WITH {_E}, p AS (SELECT document_id, unnest(range(max(page) + 2)) AS page FROM e GROUP BY document_id)
SELECT document_id, page::INT AS page, block_index, 'TEXT' AS type, text FROM e UNION ALL SELECT document_id, page::INT, 0, 'IMAGE', '' FROM p WHERE (document_id::BIGINT * 3 + page) % 7 = 0 AND (document_id, page) NOT IN (SELECT document_id, page FROM e)""")
def evidence_union(spark, sf_dir):
    """Every document gets a last page without text, so that pages of pictures alone occur."""
    u = units(spark, sf_dir)
    pages = u.groupBy("document_id").agg(F.max("page").alias("m")).select("document_id", F.explode(F.sequence(F.lit(0), F.col("m") + 1)).alias("page"))
    pages = pages.withColumn("has_images", evidence.has_images(F.col("document_id"), F.col("page")))
    return evidence.union(u.withColumn("type", F.lit("TEXT")), evidence.image_markers(pages, u)).select("document_id", "page", "block_index", "type", "text")


@query(f"""WITH {_E}, h AS (SELECT document_id, page, block_index, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(document_id || ':' || page || ':' || block_index || ':TEXT')) AS h FROM e)
SELECT document_id, page, block_index, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS evidence_id FROM h""")
def evidence_id(spark, sf_dir):
    return units(spark, sf_dir).select("document_id", "page", "block_index", evidence.evidence_id(F.col("document_id"), F.col("page"), F.col("block_index"), F.lit("TEXT")).alias("evidence_id"))


#: An order as a table: gaps between rows and columns, blank prices.
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS price FROM {lineitem} GROUP BY l_orderkey, l_linenumber) i"
_CELLS = f"""SELECT DISTINCT l_orderkey AS table_id, 0 AS row, c AS col, t AS text FROM {_LINES} CROSS JOIN (VALUES (0, 'line'), (2, 'part'), (3, 'price'), (5, ' ')) AS v(c, t)
UNION ALL SELECT l_orderkey, 2 * l_linenumber, 0, 'line ' || CAST(l_linenumber AS STRING) FROM {_LINES} UNION ALL SELECT l_orderkey, 2 * l_linenumber, 2, CAST(l_partkey AS STRING) FROM {_LINES}
UNION ALL SELECT l_orderkey, 2 * l_linenumber, 3, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE CAST(price AS STRING) END FROM {_LINES}"""


def cells(spark, sf_dir) -> DataFrame:
    return spark.sql(_CELLS, lineitem=read(spark, sf_dir, "lineitem"))


@query(f"""WITH c AS ({_CELLS.replace("{lineitem}", "lineitem")}), f AS (SELECT table_id, row, col, trim(text) AS text FROM c WHERE trim(text) <> ''),
rr AS (SELECT table_id, row, row_number() OVER (PARTITION BY table_id ORDER BY row) - 1 AS r FROM (SELECT DISTINCT table_id, row FROM f) x), cc AS (SELECT table_id, col, row_number() OVER (PARTITION BY table_id ORDER BY col) - 1 AS k FROM (SELECT DISTINCT table_id, col FROM f) x),
g AS (SELECT f.table_id, r, k, text FROM f JOIN rr USING (table_id, row) JOIN cc USING (table_id, col)), s AS (SELECT table_id, max(r) AS n_rows, max(k) + 1 AS n_cols FROM g GROUP BY table_id)
SELECT g.table_id, (g.r - 1)::INT AS "row", g.k::INT AS "col", g.text, h.text AS column_header, CASE WHEN g.k > 0 THEN x.text END AS row_header, n_rows::INT AS n_rows, n_cols::INT AS n_cols FROM g JOIN s USING (table_id)
LEFT JOIN g h ON h.table_id = g.table_id AND h.r = 0 AND h.k = g.k LEFT JOIN g x ON x.table_id = g.table_id AND x.r = g.r AND x.k = 0 WHERE g.r > 0""")
def table_grid(spark, sf_dir):
    return evidence.cleaned_grid(cells(spark, sf_dir)).where("not is_header").drop("is_header")


@query(f"""WITH c AS ({_CELLS.replace("{lineitem}", "lineitem")}), f AS (SELECT table_id, row, col, trim(text) AS text FROM c WHERE trim(text) <> ''), l AS (SELECT table_id, row, string_agg(text, chr(9) ORDER BY col) AS line FROM f GROUP BY table_id, row)
SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY table_id""")
def table_text(spark, sf_dir):
    return evidence.grid_text(evidence.cleaned_grid(cells(spark, sf_dir)))


_SPLIT = f"""WITH RECURSIVE c AS ({_CELLS.replace("{lineitem}", "lineitem")}), f AS (SELECT table_id, row, col, trim(text) AS text FROM c WHERE trim(text) <> ''),
h AS (SELECT table_id, 'Table ' || table_id || ' (columns: ' || string_agg(text, ' | ' ORDER BY col) || '):' AS header FROM f WHERE row = 0 GROUP BY table_id),
b AS (SELECT table_id, row, row_number() OVER (PARTITION BY table_id ORDER BY row) AS i, string_agg(text, ' | ' ORDER BY col) AS line, sum(length(text)) AS own FROM f WHERE row > 0 GROUP BY table_id, row),
r AS (SELECT b.table_id, row, i, 0::BIGINT AS part, length(header || chr(10) || line) + own AS cost, length(header || chr(10) || line) + own > 100 AS big, header FROM b JOIN h USING (table_id) WHERE i = 1 UNION ALL
  SELECT b.table_id, b.row, b.i, CASE WHEN r.big OR cost + length(chr(10) || line) + own > 100 THEN part + 1 ELSE part END, CASE WHEN r.big OR cost + length(chr(10) || line) + own > 100 THEN length(header || chr(10) || line) + own ELSE cost + length(chr(10) || line) + own END,
  length(header || chr(10) || line) + own > 100, header FROM r JOIN b ON b.table_id = r.table_id AND b.i = r.i + 1)
SELECT table_id, (i - 1)::INT AS "row", part FROM r"""


@query(_SPLIT)
def table_split(spark, sf_dir):
    """Orders as tables, split between rows at 100 characters."""
    grid = evidence.cleaned_grid(cells(spark, sf_dir))
    heads = grid.where("is_header").groupBy("table_id").agg(evidence.header_line(F.col("table_id"), F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"])).alias("header"))
    return chunking.table_rows(grid.where("not is_header").join(heads, "table_id"), 100)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k AS id, i, CASE i WHEN 0 THEN 'text ' || k WHEN 1 THEN '  ' ELSE ' x ' END AS text, CASE i WHEN 0 THEN (k % 13) / 10e0 WHEN 1 THEN 0.5e0 END AS score,
CASE WHEN i < 2 AND k % 5 <> 0 THEN [k % 100, k % 100 + 10 * (i + k % 2), k % 100 + 5, k % 100] END AS xs, CASE WHEN i < 2 AND k % 5 <> 0 THEN [20, 30, 20 + k % 3, 25] END AS ys FROM o CROSS JOIN range(3) r(i))
SELECT id, i::INT AS index, trim(text) AS text, CASE WHEN score BETWEEN 0 AND 1 THEN score END AS score, CASE WHEN list_max(xs) > list_min(xs) AND list_max(ys) > list_min(ys) THEN round(list_min(xs) / 2e0, 6) END AS x0,
CASE WHEN list_max(xs) > list_min(xs) AND list_max(ys) > list_min(ys) THEN round(list_max(ys) / 2e0, 6) END AS y1 FROM t WHERE trim(text) <> ''""")
def ocr_boxes(spark, sf_dir):
    """Texts, scores and boxes of different lengths; scores above 1, blank texts, boxes without an area."""
    k = F.col("o_orderkey")

    def doubles(*c):
        return F.array(*(x.cast("double") if not isinstance(x, (int, float)) else F.lit(float(x)) for x in c))

    def quad(i):
        return F.struct(doubles(k % 100, k % 100 + 10 * (i + k % 2), k % 100 + 5, k % 100).alias("xs"), doubles(20, 30, 20 + k % 3, 25).alias("ys"))

    boxes = F.when(k % 5 != 0, F.array(quad(0), quad(1))).otherwise(F.array().cast("array<struct<xs:array<double>,ys:array<double>>>"))
    results = read(spark, sf_dir, "orders").select(k.alias("id"), F.array(F.concat(F.lit("text "), k.cast("string")), F.lit("  "), F.lit(" x ")).alias("texts"), F.array((k % 13) / 10.0, F.lit(0.5)).alias("scores"), boxes.alias("boxes"))
    b = evidence.ocr_blocks(results).withColumn("b", evidence.box(F.col("box.xs"), F.col("box.ys"), F.lit(144.0)))
    return b.select("id", "index", "text", "score", F.round("b.x0", 6).alias("x0"), F.round("b.y1", 6).alias("y1"))


# --- chunks ----------------------------------------------------------------------------------------------------

_PACK = f"""{_E}, i AS (SELECT document_id, page, block_index AS item, length(text) AS c, greatest(1, (octet_length(encode(text)) + 1) // 2) AS t, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS digits FROM e),
r AS (SELECT document_id, page, item, c, t, 0::BIGINT AS chunk, c AS sc, t AS st, c > 700 OR t > 400 AS big FROM i WHERE item = 0 UNION ALL
  SELECT i.document_id, i.page, i.item, i.c, i.t, CASE WHEN r.big OR r.sc + i.c > 700 OR r.st + i.t > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN r.big OR r.sc + i.c > 700 OR r.st + i.t > 400 THEN i.c ELSE r.sc + i.c END,
  CASE WHEN r.big OR r.sc + i.c > 700 OR r.st + i.t > 400 THEN i.t ELSE r.st + i.t END, i.c > 700 OR i.t > 400 FROM r JOIN i ON i.document_id = r.document_id AND i.page = r.page AND i.item = r.item + 1)"""


def chunked(spark, sf_dir) -> DataFrame:
    """Items with their chunk: 700 characters or 400 tokens at most."""
    items = chunking.text_items(units(spark, sf_dir))
    return items.join(chunking.packed(items, 700, 400), ["document_id", "page", "item"])


@query(f"WITH RECURSIVE {_PACK} SELECT document_id, page, item, chunk FROM r")
def chunk_packing(spark, sf_dir):
    return chunked(spark, sf_dir).select("document_id", "page", "item", "chunk")


@query(f"WITH RECURSIVE {_PACK}, c AS (SELECT document_id, page, chunk, sum(c)::BIGINT AS chars, sum(t)::BIGINT AS tokens FROM r GROUP BY document_id, page, chunk) SELECT document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY chunk) - 1 AS chunk_index, chars, tokens FROM c WHERE page BETWEEN 0 AND 1")
def chunk_ordinals(spark, sf_dir):
    c = chunked(spark, sf_dir).groupBy("document_id", "page", "chunk").agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    return chunking.ordinals(c, 0, 1).select("document_id", "page", "chunk_index", "chars", "tokens")


@query(f"""WITH RECURSIVE {_PACK}, c AS (SELECT document_id, page, chunk, least(50, sum(digits))::BIGINT AS digits FROM r JOIN i USING (document_id, page, item) GROUP BY document_id, page, chunk),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, chunk) - 1 AS p, count(*) OVER (PARTITION BY document_id) AS n FROM c),
s AS (SELECT p.*, CASE WHEN n <= 3 THEN p ELSE (SELECT max(k) FROM range(3) x(k) WHERE k * n // 3 <= p.p) END AS stratum FROM p)
SELECT document_id, page, chunk, digits FROM (SELECT *, row_number() OVER (PARTITION BY document_id, stratum ORDER BY digits DESC, p) AS b FROM s) q WHERE b = 1""")
def chunk_selection(spark, sf_dir):
    c = chunked(spark, sf_dir).groupBy("document_id", "page", "chunk").agg(F.least(F.lit(50), F.sum("digits")).alias("digits")).withColumn("has_table", F.lit(0))
    return chunking.selected(c, 3).select("document_id", "page", "chunk", "digits")


_HASH = f"{_PACK}, ids AS (SELECT document_id, page, chunk, item, document_id || ':' || page || ':' || item AS id FROM r), ch AS (SELECT document_id, page, chunk AS chunk_index, sha256(string_agg(id || '|', '' ORDER BY id)) AS evidence_hash FROM ids GROUP BY document_id, page, chunk)"


def hashed(spark, sf_dir) -> DataFrame:
    ids = chunked(spark, sf_dir).groupBy("document_id", "page", F.col("chunk").alias("chunk_index")).agg(F.collect_list(F.concat_ws(":", "document_id", "page", "item")).alias("ids"))
    return ids.select("document_id", "page", "chunk_index", chunking.chunk_hash(F.col("ids")).alias("evidence_hash"))


@query(f"WITH RECURSIVE {_HASH} SELECT * FROM ch")
def chunk_hash(spark, sf_dir):
    return hashed(spark, sf_dir)


@query(f"WITH RECURSIVE {_HASH} SELECT * FROM ch WHERE NOT (document_id::BIGINT % 3 = 0 AND chunk_index % 2 = 0)")
def resume_skip(spark, sf_dir):
    """Done before: even chunks of every third document; others failed, or had other content."""
    h = hashed(spark, sf_dir)
    third, even = F.col("document_id").cast("long") % 3, F.col("chunk_index") % 2 == 0
    done = h.withColumn("status", F.when((third == 0) & even, "COMPLETED").when(third == 1, "FAILED").otherwise("COMPLETED")).withColumn("evidence_hash", F.when(third == 2, "old").when((third == 0) & ~even, "old").otherwise(F.col("evidence_hash")))
    return chunking.remaining(h, done)


# --- drafts and facts ------------------------------------------------------------------------------------------

#: Drafts of orders: some cite evidence outside their chunk, some repeat others, some are vague.
_DRAFTS = """SELECT o_orderkey AS draft_id, 'doc-' || CAST(o_custkey % 50 AS STRING) AS document_id, o_orderkey % 40 AS chunk_id, CASE WHEN o_orderkey % 37 = 0 THEN ' ' ELSE ' order ' || o_orderstatus || ' ' END AS subject, 'total price' AS predicate,
CASE o_orderkey % 6 WHEN 0 THEN 'A 12' WHEN 1 THEN CAST(o_orderkey % 9 AS STRING) || '%' WHEN 2 THEN 'about ten' ELSE CAST(o_orderkey % 9 AS STRING) || ' mn' END AS value_text, CASE o_orderkey % 4 WHEN 0 THEN 'NUMERIC' WHEN 1 THEN 'TEXT' WHEN 2 THEN NULL ELSE 'PERCENTAGE' END AS value_kind,
CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'USD' END AS unit, CASE o_orderkey % 3 WHEN 0 THEN 'FY24' WHEN 1 THEN 'someday' ELSE NULL END AS time_text, CAST(NULL AS STRING) AS scope_text, CASE WHEN o_orderkey % 2 = 0 THEN 'ACTUAL' END AS estimate_status,
' ' || o_orderpriority AS geography, 0.9e0 AS confidence, o_orderkey % 8 = 0 AS ambiguous FROM {orders}"""


def drafts(spark, sf_dir) -> DataFrame:
    d = spark.sql(_DRAFTS, orders=read(spark, sf_dir, "orders"))
    e = F.concat(F.lit("e"), F.col("chunk_id").cast("string"))
    return d.withColumn("evidence_ids", F.when(F.col("draft_id") % 29 == 0, F.array(e, F.lit("elsewhere"))).otherwise(F.array(e, e)))


def known(spark) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("chunk_id"), F.array(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("ids"))


_BUILT = f"""d AS ({_DRAFTS.replace("{orders}", "orders")}), k AS (SELECT *, trim(value_text) AS v, draft_id % 6 AS m FROM d),
b AS (SELECT *, CASE WHEN m = 1 THEN 'PERCENTAGE' WHEN m IN (0, 2) THEN CASE WHEN value_kind IN ('NUMERIC', 'PERCENTAGE') THEN value_kind ELSE 'TEXT' END ELSE 'NUMERIC' END AS kind, CASE WHEN m = 1 THEN (draft_id % 9)::DOUBLE WHEN m > 2 THEN (draft_id % 9) * 1e6 END AS num FROM k),
built AS (SELECT *, concat_ws(',', CASE WHEN m = 1 AND value_kind <> 'PERCENTAGE' THEN 'kind_corrected:' || value_kind || '->PERCENTAGE' WHEN m > 2 AND value_kind = 'TEXT' THEN 'kind_corrected:TEXT->NUMERIC' WHEN m IN (0, 2) AND kind <> 'TEXT' THEN 'value_unparseable' END,
CASE WHEN m = 0 AND kind <> 'TEXT' THEN 'currency_symbol_suspect' END, CASE WHEN kind <> 'TEXT' AND num IS NULL THEN 'value_unparseable' END, CASE WHEN time_text = 'someday' THEN 'time_unparsed' END, CASE WHEN ambiguous THEN 'llm_flagged_ambiguous' END) AS flags,
CASE WHEN draft_id % 29 = 0 THEN 'unknown evidence IDs: elsewhere' WHEN trim(subject) = '' THEN 'blank subject or predicate' END AS rejected FROM b)"""


@query(f"WITH {_BUILT} SELECT draft_id, trim(subject) AS subject, kind AS value_kind, num AS value_number, nullif(trim(unit), '') AS unit, CASE WHEN time_text = 'FY24' THEN 'FISCAL_YEAR' ELSE 'UNKNOWN' END AS time_kind, coalesce(estimate_status, 'UNKNOWN') AS estimate_status, trim(geography) AS geography, flags, CASE WHEN flags = '' THEN 'CONFIRMED' ELSE 'AMBIGUOUS' END AS status, rejected FROM built")
def build_fact(spark, sf_dir):
    f = extract.facts(drafts(spark, sf_dir), known(spark))
    return f.select("draft_id", "subject", "value_kind", "value_number", "unit", "time_kind", "estimate_status", "geography", F.array_join("ambiguity_flags", ",").alias("flags"), "status", "rejected")


@query(f"WITH {_BUILT} SELECT min(draft_id) AS draft_id FROM built WHERE rejected IS NULL GROUP BY document_id, trim(subject), predicate, kind, v, nullif(trim(unit), ''), time_text, scope_text, trim(geography), chunk_id")
def fact_dedupe(spark, sf_dir):
    f = extract.facts(drafts(spark, sf_dir), known(spark)).where("rejected is null")
    return extract.distinct_facts(f).select("draft_id")


#: Chunks of the drafts: some answered before, some failed, some left out.
_STATES = "SELECT document_id, chunk_id, CASE WHEN chunk_id % 7 = 0 THEN 'SKIPPED' WHEN chunk_id % 11 = 3 THEN 'CAPPED' WHEN chunk_id % 5 = 1 THEN 'FAILED' ELSE 'COMPLETED' END AS state FROM (SELECT DISTINCT document_id, chunk_id FROM {0}) c"
_IDENTITY = "document_id, trim(subject), predicate, kind, v, nullif(trim(unit), ''), time_text, scope_text, trim(geography), chunk_id"


@query(f"""WITH {_BUILT}, st AS ({_STATES.format("built")}), m AS (SELECT built.* FROM built JOIN st USING (document_id, chunk_id) WHERE state = 'COMPLETED'),
g AS (SELECT *, row_number() OVER (PARTITION BY {_IDENTITY} ORDER BY draft_id) AS r, (min(draft_id) OVER (PARTITION BY {_IDENTITY})) % 6 = 1 AS stored FROM m WHERE rejected IS NULL),
p AS (SELECT document_id, count(*) FILTER (state = 'COMPLETED') AS chunks_processed, count(*) FILTER (state = 'FAILED') AS chunks_failed, count(*) FILTER (state = 'SKIPPED') AS chunks_skipped, count(*) FILTER (state = 'CAPPED') AS chunks_capped FROM st GROUP BY 1),
q AS (SELECT document_id, count(*) FILTER (r = 1 AND NOT stored) AS saved, count(*) FILTER (r > 1 OR stored) AS same FROM g GROUP BY 1), x AS (SELECT document_id, count(*) AS rejected FROM m WHERE rejected IS NOT NULL GROUP BY 1)
SELECT document_id, chunks_processed, chunks_failed, chunks_skipped, chunks_capped, coalesce(rejected, 0) AS drafts_rejected, coalesce(same, 0) AS facts_skipped_duplicate, coalesce(saved, 0) AS facts_saved, chunks_failed + coalesce(rejected, 0) AS errors FROM p LEFT JOIN q USING (document_id) LEFT JOIN x USING (document_id)""")
def extraction_report(spark, sf_dir):
    """A run over chunks that were partly done before; facts whose first draft is 1 modulo 6 are stored already."""
    d = drafts(spark, sf_dir)
    states = spark.sql(_STATES.format("{drafts}"), drafts=d).withColumn("error", F.when(F.col("state") == "FAILED", "TimeoutError: no answer"))
    asked = d.join(states.where("state = 'COMPLETED'").select("document_id", "chunk_id"), ["document_id", "chunk_id"], "left_semi")
    made = extract.facts(asked, known(spark)).withColumn("fact_id", F.col("draft_id").cast("string"))
    valid = made.where("rejected is null")
    stored = extract.distinct_facts(valid).where("draft_id % 6 = 1").withColumn("fact_id", F.concat(F.lit("old-"), "fact_id"))
    judged = extract.split_new(valid, stored).select("document_id", "rejected", "is_new").unionByName(made.where("rejected is not null").select("document_id", "rejected", F.lit(False).alias("is_new")))
    return extract.extraction_report(states, judged).withColumn("errors", F.size("errors").cast("long"))


@query(f"""WITH c AS ({_CELLS.replace("{lineitem}", "lineitem")}), f AS (SELECT table_id, row, col, trim(text) AS text FROM c WHERE trim(text) <> ''),
rr AS (SELECT table_id, row, row_number() OVER (PARTITION BY table_id ORDER BY row) - 1 AS r FROM (SELECT DISTINCT table_id, row FROM f) x), cc AS (SELECT table_id, col, row_number() OVER (PARTITION BY table_id ORDER BY col) - 1 AS k FROM (SELECT DISTINCT table_id, col FROM f) x),
g AS (SELECT f.table_id, r, k, text FROM f JOIN rr USING (table_id, row) JOIN cc USING (table_id, col)), l AS (SELECT table_id, r, string_agg(text, chr(9) ORDER BY k) AS line FROM g GROUP BY table_id, r),
u AS (SELECT table_id, 'TABLE' AS type, NULL::INT AS r, NULL::INT AS k, string_agg(line, chr(10) ORDER BY r) AS text, NULL AS column_header, NULL AS row_header FROM l GROUP BY table_id
  UNION ALL SELECT g.table_id, 'TABLE_CELL', g.r - 1, g.k, g.text, h.text, CASE WHEN g.k > 0 THEN x.text END FROM g LEFT JOIN g h ON h.table_id = g.table_id AND h.r = 0 AND h.k = g.k LEFT JOIN g x ON x.table_id = g.table_id AND x.r = g.r AND x.k = 0 WHERE g.r > 0)
SELECT (table_id % 50)::VARCHAR AS document_id, (table_id % 4)::INT AS page, type, r AS "row", k AS "col", text, column_header, row_header, (row_number() OVER (PARTITION BY table_id % 50, table_id % 4 ORDER BY table_id, type <> 'TABLE', r, k) - 1)::INT AS place FROM u""")
def table_evidence(spark, sf_dir):
    """Orders as tables on pages: a unit for each whole table and for each filled cell, in order on the page."""
    t = F.col("table_id")
    placed = cells(spark, sf_dir).select((t % 50).cast("string").alias("document_id"), (t % 4).cast("int").alias("page"), t.alias("table_index"), "row", "col", "text")
    return evidence.table_units(placed).select("document_id", "page", "type", "row", "col", "text", "column_header", "row_header", "place")


class PageReader:
    """Reads three lines of each page, of which the second is blank."""

    def run(self, rows):
        return [{"texts": [f"page {r['page']}", "  ", "end"]} for r in rows]


@query(f"""WITH {_QUALITY}, b AS (SELECT document_id, page FROM quality WHERE score < 0.35e0), m AS (SELECT document_id, page, max(block_index) AS last FROM e GROUP BY 1, 2)
SELECT document_id, page, block_index, 'TEXT' AS type, text FROM e UNION ALL SELECT document_id, page, (last + i)::INT, 'OCR_TEXT', CASE i WHEN 1 THEN 'page ' || page ELSE 'end' END FROM b JOIN m USING (document_id, page), (VALUES (1), (2)) v(i)""")
def ocr_union(spark, sf_dir):
    """Pages of bad quality are read again; what is read stands after the page's own text."""
    from factloom.sources import providers

    u = units(spark, sf_dir)
    pages = evidence.page_quality(u, pictured=evidence.has_images(F.col("document_id"), F.col("page"))).withColumn("error", F.lit(None).cast("string"))
    read_again, _ = evidence.ocr_fallback(pages, u.withColumn("type", F.lit("TEXT")), PageReader(), providers.apply)
    return read_again.select("document_id", "page", "block_index", "type", "text")


@query()
def json_repair(spark, sf_dir):
    """Answers cut off after each of their characters, made whole where a part of them is."""
    whole = F.concat(F.lit('```json {"drafts": [{"subject": "'), F.col("p_name"), F.lit('", "evidence_ids": ["a", "b"], "confidence": 0.5}, {"subject": "'), F.col("p_brand"), F.lit('"}]}'))
    cut = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.substring(whole, F.lit(1), (20 + F.col("p_partkey") % 110).cast("int")).alias("answer"))
    clean = F.regexp_replace("answer", r"^```json\s*", "")
    return cut.select("id", extract.repaired(clean).alias("json")).withColumn("valid", F.try_parse_json("json").isNotNull())


# --- page content by an extractor ------------------------------------------------------------------------------


def _extracted(spark, sf_dir) -> DataFrame:
    """Orders as pages: text in spans and lines, a picture, a blank block; printed numbers in two documents of three."""
    k = F.col("o_orderkey")
    line = lambda *spans: F.array(*(x if not isinstance(x, str) else F.lit(x) for x in spans))
    block = lambda kind, *lines: F.struct(F.lit(kind).alias("type"), F.array(*lines).alias("lines"))
    blocks = F.array(block(0, line("  order ", F.col("o_orderstatus")), line(F.col("o_orderpriority"))), block(1, line("picture")), block(0, line(" ", " ")), block(0, line(k.cast("string"))))
    label = F.when(F.col("o_custkey") % 3 == 0, F.lit(None)).when(k % 5 == 0, "").otherwise(F.concat(F.lit("p. "), (k % 40).cast("string")))
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).cast("string").alias("document_id"), k.cast("int").alias("page"), label.alias("label"), blocks.alias("blocks"))


@query("SELECT (o_custkey % 30)::VARCHAR AS document_id, o_orderkey::INT AS page, 0 AS block_index, 'order ' || o_orderstatus || chr(10) || trim(o_orderpriority) AS text FROM orders UNION ALL SELECT (o_custkey % 30)::VARCHAR, o_orderkey::INT, 1, o_orderkey::VARCHAR FROM orders")
def text_blocks(spark, sf_dir):
    return extractor.text_blocks(_extracted(spark, sf_dir))


@query("SELECT (o_custkey % 30)::VARCHAR AS document_id, o_orderkey::INT AS page, CASE WHEN o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 'p. ' || o_orderkey % 40 END AS source_page_number FROM orders")
def page_labels(spark, sf_dir):
    return extractor.labelled(_extracted(spark, sf_dir)).select("document_id", "page", "source_page_number")


@query("""WITH q AS (SELECT o_orderkey AS k, o_custkey % 5 AS c, 20 + (o_orderkey * 7) % 300 AS dpi FROM orders),
r AS (SELECT *, CASE WHEN dpi < 40 OR dpi > 300 THEN 422 WHEN k % 11 = 0 THEN 404 WHEN c = 0 THEN 200 WHEN c = 1 THEN 404 WHEN c = 2 THEN 400 ELSE 200 END AS status FROM q)
SELECT k AS request_id, status, CASE WHEN status = 200 AND c > 2 AND k % 4 <> 0 THEN round(greatest(0, k % 50 - 10) * dpi / 72e0, 6) END AS x0, CASE WHEN status = 200 AND c > 2 AND k % 4 <> 0 THEN round(least(600, k % 50 + 600 * (k % 2) + 20) * dpi / 72e0, 6) END AS x1 FROM r""")
def highlight_checks(spark, sf_dir):
    """Page views: no such page, no evidence asked, unknown, of another page, and boxes that leave the page."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 5
    o = read(spark, sf_dir, "orders")
    asked = o.select(k.alias("request_id"), F.lit("d").alias("document_id"), k.cast("int").alias("page"), F.when(c > 0, F.concat(F.lit("e"), k.cast("string"))).alias("evidence_id"), (20 + (k * 7) % 300).cast("int").alias("dpi"))
    pages = o.where("o_orderkey % 11 <> 0").select(F.lit("d").alias("document_id"), k.cast("int").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    left = (k % 50 - 10).cast("double")
    box = F.struct(left.alias("x0"), F.when(k % 4 == 0, 900.0).otherwise(10.0).alias("y0"), (left + 30 + 600 * (k % 2)).cast("double").alias("x1"), F.lit(1000.0).alias("y1"))
    units = o.where(c > 1).select(F.lit("d").alias("document_id"), F.concat(F.lit("e"), k.cast("string")).alias("evidence_id"), (k + F.when(c == 2, 1).otherwise(0)).cast("int").alias("page"), box.alias("bbox"))
    return extractor.highlights(asked, units, pages).select("request_id", "status", F.round("box.x0", 6).alias("x0"), F.round("box.x1", 6).alias("x1"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'TABLE_CELL' ELSE 'TEXT' END AS type,
CASE WHEN l_linenumber % 3 = 0 THEN 'Table ' || CASE WHEN l_orderkey % 2 = 0 THEN '?' ELSE (l_orderkey % 9)::VARCHAR END || ' (columns: ' || CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'a | ' || l_linestatus END || '):' || CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE chr(10) || l_returnflag END WHEN l_orderkey % 7 = 0 THEN '' ELSE l_returnflag END AS text,
CASE WHEN l_linenumber % 3 < 2 AND l_orderkey % 2 = 1 THEN l_orderkey % 9 END AS table_index, CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END AS row FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) l""")
def chunk_units(spark, sf_dir):
    """Lines as units of each kind: tables without an index, without headers, without cells."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("mode"), F.min("l_linestatus").alias("status"))
    kind = F.when(n % 3 == 0, "TABLE").when(n % 3 == 1, "TABLE_CELL").otherwise("TEXT")
    units = l.select(F.struct(k, n).alias("evidence_id"), kind.alias("type"), F.when(k % 7 == 0, "").otherwise(F.col("mode")).alias("text"), F.when(k % 2 == 1, k % 9).alias("table_index"), F.when(k % 5 != 0, F.array(F.lit("a"), "status")).alias("headers"), n.alias("row"), n.alias("col"), F.lit("r").alias("row_header"), F.lit("c").alias("column_header"))
    return chunking.projected(units).select("evidence_id.l_orderkey", "evidence_id.l_linenumber", "type", "text", "table_index", "row").toDF("id", "line", "type", "text", "table_index", "row")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 3 THEN 'unavailable' WHEN c_custkey % 7 > 3 THEN 'runtime' WHEN c_custkey % 3 = 0 THEN 'malformed' END AS kind FROM customer")
def provider_errors(spark, sf_dir):
    """What calls to a service come to: not reached, not ready, other HTTP errors, answers that can't be read."""
    from factloom.sources import providers

    k = F.col("c_custkey")
    status = F.get(F.array(*map(F.lit, (200, 200, 201, 503, 500, 404, 422))), (k % 7).cast("int"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), providers.error_kind(status, k % 4 != 0, k % 3 != 0).alias("kind"))


# --- search ----------------------------------------------------------------------------------------------------

QUERY = "Revenue of FRANCE nation"
_TOKENS = "['revenue', 'of', 'france', 'nation']"
_LEX = f"""WITH {_FACTS}, s AS (SELECT *, {_tok("subject || ' ' || predicate || ' ' || value_text || ' ' || coalesce(unit, '')")} AS words, lower(subject || chr(1) || predicate || chr(1) || value_text || chr(1) || coalesce(unit, '')) AS text FROM f),
pool AS (SELECT fact_id, len(list_intersect(words, {_TOKENS}))::DOUBLE / len(list_distinct(list_concat(words, {_TOKENS}))) AS lexical FROM s WHERE contains(text, 'revenue') OR contains(text, 'of') OR contains(text, 'france') OR contains(text, 'nation') ORDER BY fact_id LIMIT 100)"""
_VEC = """n AS (SELECT fact_id, row_number() OVER (ORDER BY fact_id) - 1 AS i FROM f), v AS (SELECT fact_id, embedding::DOUBLE[] AS e FROM n JOIN embeddings ON vec_id = i), q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7),
near AS (SELECT fact_id, greatest(0e0, c) AS vector FROM (SELECT fact_id, list_cosine_similarity(v.e, q.e) AS c FROM v, q) x ORDER BY c DESC, fact_id LIMIT 100)"""
_HITS = f"""{_LEX}, {_VEC}, b AS (SELECT fact_id, lexical, vector FROM pool FULL JOIN near USING (fact_id)),
h AS (SELECT fact_id, CASE WHEN lexical > 0 AND vector > 0 THEN (lexical + vector) / 2 WHEN lexical > 0 THEN lexical ELSE vector END AS score, CASE WHEN lexical > 0 AND vector > 0 THEN 'hybrid' WHEN lexical > 0 THEN 'lexical' ELSE 'vector' END AS match_kind FROM b WHERE lexical > 0 OR vector > 0),
hits AS (SELECT * FROM h ORDER BY score DESC, fact_id LIMIT 20)"""


def fact_vectors(spark, sf_dir, f: DataFrame) -> DataFrame:
    """The n-th fact by id has the embedding of vec_id n. The window is bounded: facts are nations by years of two reports, at any scale."""
    from pyspark.sql import Window

    i = f.select("fact_id", (F.row_number().over(Window.orderBy("fact_id")) - 1).alias("vec_id"))
    return i.join(read(spark, sf_dir, "embeddings"), "vec_id").select("fact_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def query_vector(spark, sf_dir) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0])


@query(_LEX + " SELECT fact_id, round(lexical, 9) AS score FROM pool WHERE lexical > 0 ORDER BY lexical DESC, fact_id LIMIT 20")
def search_lexical(spark, sf_dir):
    return search.hits(search.lexical_pool(facts(spark, sf_dir), QUERY), None).select("fact_id", F.round("score", 9).alias("score"))


@query(f"WITH {_FACTS}, {_VEC} SELECT fact_id, round(vector, 6) AS score FROM near")
def search_vector(spark, sf_dir):
    return search.vector_pool(fact_vectors(spark, sf_dir, facts(spark, sf_dir)), query_vector(spark, sf_dir)).select("fact_id", F.round("vector", 6).alias("score"))


def _hits(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir)
    return search.hits(search.lexical_pool(f, QUERY), search.vector_pool(fact_vectors(spark, sf_dir, f), query_vector(spark, sf_dir)))


@query(_HITS + " SELECT fact_id, round(score, 6) AS score, match_kind FROM hits")
def search_hybrid(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("score", F.round("score", 6))


#: Evidence of facts: one unit each, and one that is nowhere stored.
def _evidence_ids():
    return F.array(F.concat(F.lit("ev-"), F.col("fact_id")), F.lit("ev-nowhere"))


@query(_REL + ", " + _HITS.removeprefix("WITH ").removeprefix(_FACTS).lstrip(",") + """, e AS (SELECT relationship_id, fact_a_id AS fact_id FROM rel UNION ALL SELECT relationship_id, fact_b_id FROM rel), g AS (SELECT fact_id, string_agg(relationship_id, ',' ORDER BY relationship_id) AS r FROM e GROUP BY fact_id)
SELECT hits.fact_id, round(score, 6) AS score, match_kind, document_id, 'ev-' || hits.fact_id AS evidence, coalesce(r, '') AS relationships FROM hits JOIN f ON f.fact_id = hits.fact_id LEFT JOIN g ON g.fact_id = hits.fact_id""")
def search_hydrated(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("evidence_ids", _evidence_ids())
    stored = f.select(F.concat(F.lit("ev-"), F.col("fact_id")).alias("evidence_id"))
    out = search.hydrated(_hits(spark, sf_dir), f, stored, relationships(spark, sf_dir))
    return out.select("fact_id", F.round("score", 6).alias("score"), "match_kind", "document_id", F.array_join("evidence", ",").alias("evidence"), F.array_join("relationships", ",").alias("relationships"))


# --- store -----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey AS fact_id, 'p' || lpad(l_partkey::VARCHAR, 9, '0') AS e FROM lineitem WHERE l_quantity > 25) SELECT o_orderkey AS fact_id, o_orderstatus AS status, coalesce(string_agg(e, ',' ORDER BY e), '') AS evidence_ids FROM orders LEFT JOIN l ON fact_id = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def hydrate_facts(spark, sf_dir):
    """Orders as facts, their parts of over 25 as evidence; those without any keep an empty list."""
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderstatus").alias("status"))
    links = read(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("fact_id"), F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("evidence_id"))
    return store.hydrated(f, links).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(f"WITH {_FACTS}, n AS (SELECT fact_id, row_number() OVER (ORDER BY fact_id) - 1 AS i FROM f) SELECT fact_id FROM n WHERE i NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0)")
def missing_embeddings(spark, sf_dir):
    f = facts(spark, sf_dir)
    have = fact_vectors(spark, sf_dir, f)
    some = read(spark, sf_dir, "embeddings").where("vec_id % 4 = 0").select(F.col("embedding").cast("array<double>").alias("v"))
    return store.missing_vectors(f, have.join(some, "v", "left_anti")).select("fact_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN -1 WHEN c_custkey % 6 = 1 THEN c_nationkey + 100 ELSE c_nationkey END AS nation FROM customer UNION ALL SELECT -c_custkey, 'new', -1 FROM customer WHERE c_custkey % 9 = 0""")
def store_merge(spark, sf_dir):
    """Upserts replace whole rows and add others; an update changes one column of rows that are there."""
    stored = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    changed = store.update_columns(stored, stored.where("c_custkey % 6 = 1 or c_custkey < 0").withColumn("nation", F.col("nation") + 100), ["c_custkey"], ["nation"])
    fresh = stored.where("c_custkey % 4 = 0").select("c_custkey").union(stored.where("c_custkey % 9 = 0").select(-F.col("c_custkey"))).withColumn("segment", F.lit("new"))
    return store.upsert(changed, fresh, ["c_custkey"]).withColumn("nation", F.coalesce("nation", F.lit(-1)))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return progress.event_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


