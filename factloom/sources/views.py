"""Facts, evidence and hostile strings built from the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES_OF_A_PAGE = 20

#: Claims of two reports: order revenue by nation and year, from orders (A) and from their lines (B), with differences by case h. Case 0 has dates, whose periods overlap or not.
FACTS = """
WITH o AS (
  SELECT n_nationkey AS k, n_name, r_name, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0e0 AS v
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  GROUP BY n_nationkey, n_name, r_name, year(o_orderdate)),
l AS (
  SELECT c_nationkey AS lk, year(o_orderdate) AS ly, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0e0 AS w
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)),
p AS (SELECT o.*, coalesce(w, 2 * v) AS w, (k * 7 + y) % 12 AS h FROM o LEFT JOIN l ON k = lk AND y = ly),
s AS (
  SELECT 'A' AS side, p.*, v AS x, 'order revenue' AS pred, h = 99 AS no_time, y AS fy, h = 99 AS no_scope FROM p UNION ALL
  SELECT 'B' AS side, p.*, CASE WHEN h = 1 THEN v * 1.005e0 WHEN h IN (4, 5, 6, 7, 8, 11) THEN w ELSE v END AS x,
    CASE WHEN h IN (3, 7, 8) THEN 'order revenue total' ELSE 'order revenue' END AS pred, h IN (5, 8) AS no_time,
    CASE WHEN h = 11 THEN y - 1 ELSE y END AS fy, h = 6 AS no_scope FROM p)
SELECT side || '-' || lpad(CAST(k AS STRING), 2, '0') || '-' || CAST(y AS STRING) AS fact_id, 'report-' || side AS document_id, n_name AS subject,
  CASE WHEN h = 2 THEN NULL ELSE lower(replace(n_name, '_', ' ')) END AS canonical_subject, pred AS predicate,
  CASE WHEN h IN (2, 10) THEN NULL ELSE pred END AS canonical_predicate, CASE WHEN h = 10 THEN 'TEXT' ELSE 'NUMERIC' END AS value_kind,
  CAST(CAST(x * 1000000 AS DECIMAL(18,2)) AS STRING) AS value_text, CASE WHEN h = 10 THEN NULL ELSE x * 1000000 END AS value_number,
  CASE WHEN h IN (9, 10) THEN NULL ELSE 'USD' END AS unit, CASE WHEN h = 10 THEN NULL ELSE x END AS normalized_number,
  CASE WHEN h IN (9, 10) THEN NULL ELSE 'USD million' END AS normalized_unit,
  CASE WHEN no_time THEN NULL WHEN h = 0 THEN 'from ' || side || ' in ' || CAST(fy AS STRING) ELSE 'FY' || CAST(fy AS STRING) END AS time_text,
  CASE WHEN no_time THEN 'UNKNOWN' WHEN h = 0 THEN 'DATE' ELSE 'FISCAL_YEAR' END AS time_kind,
  CASE WHEN h = 0 THEN make_date(CAST(fy AS INT), CASE WHEN side = 'A' THEN 1 ELSE 3 END, 1) END AS time_start,
  CASE WHEN h = 0 THEN make_date(CAST(fy AS INT), CASE WHEN side = 'A' THEN 2 + CAST(k % 3 AS INT) ELSE 5 END, 20) END AS time_end, CASE WHEN no_scope THEN NULL ELSE 'all orders' END AS scope_text,
  'ACTUAL' AS estimate_status, r_name AS geography, h
FROM s
"""

#: Value texts: one for each customer and form, and the hostile ones below.
VALUE_TEXTS = """
SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 0 THEN 'Rs ' || a WHEN 1 THEN a || ' Cr' WHEN 2 THEN '(' || a || ')' WHEN 3 THEN '$' || a || ' mn' WHEN 4 THEN a || '%'
  WHEN 5 THEN '-₹' || a WHEN 6 THEN a || ' tonnes' WHEN 7 THEN 'n/a' WHEN 8 THEN a || 'K' ELSE a END AS value_text,
  CASE c_custkey % 7 WHEN 0 THEN 'US$ billion' WHEN 1 THEN 'units' WHEN 2 THEN 'Rs Mn' WHEN 3 THEN 'K tonnes' WHEN 4 THEN '% of GDP' WHEN 5 THEN 'JPY' ELSE NULL END AS unit,
  CASE c_custkey % 5 WHEN 0 THEN 'NUMERIC' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'PERCENTAGE' ELSE NULL END AS drafted
FROM (SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS a FROM {customer}) x
UNION ALL SELECT -id, value_text, unit, drafted FROM (VALUES HOSTILE) AS v(id, value_text, unit, drafted)
"""
HOSTILE_VALUES = [
    ("81,415", "units", "NUMERIC"), ("1,429K", "K tonnes", None), ("1.6%", "%", "NUMERIC"), ("(1,234)", "Rs Mn", "TEXT"), ("6.4 per cent", None, "TEXT"), ("13.6 percent", None, None),
    ("-2,500 Cr", "Cr", "NUMERIC"), ("-1.5 Mn", "USD", None), ("₹-5", "₹", None), ("-₹5", None, "TEXT"), ("(₹5)", "", None), ("--3", "t", None), ("n/a", "units", "NUMERIC"), ("", None, "PERCENTAGE"),
    ("-", None, None), ("(2.3)%", "%", None), ("(2.3%)", "pp", "PERCENTAGE"), ("1,429K tonnes", "tonnes", None), ("5 crores", "INR", None), ("10 t", "tons", None), ("1 234", "furlongs", None), ("$-5", "$", None),
    ("€1.2bn", "EUR", None), ("5d", None, "NUMERIC"), ("1_000", "lakh people", None), ("1e5", "kg", None), ("nan", None, None), ("inf", "GBP", None), (".5", "bps", None), ("5.", "basis points", None),
    ("+7", "per cent", None), ("usd 12", "percentage points", None), ("rs. 12 lakh", None, None), ("8142 Cr", "", None), ("8142 Cr", "people", None), ("14.0", "US$ billion", None), ("740", "Mn express parcels", None),
    ("1.7", "bps", "PERCENTAGE"), ("1.2", "% of GDP", None), ("3", "millions", None), ("5 million", "$", None), ("1__0", None, None), ("(", "m", None), ("()", "b", None), ("5 yen", None, None), ("12 dollars", None, None), (None, None, "NUMERIC"),
]
PERIODS = (
    "FY24|H1 FY25|H1 of FY25|Fiscal 2021|FY2023-24|fy 24|Q1|Q4 FY24|Q1 FY2025/26|Q1:2024-25|Q2 2024-25|Q2 of FY25|2024-05-17|13 January 2022|January 13, 2022|As of December 31, 2021|May 2024|2024|2023-24|"
    "2023/2024|year ended March 31, 2024|three months ended 30 June 2024|for the year ended March 31, 2023|nine months period ended December 31, 2021|Quarterly|Q5 FY24|Q|ended|period|ended 2024|year|End-December 2024|"
    "30 February 2024|2024-13-01|February 30, 2024|Smarch 2024|31 April 2023|29 February 2024|0000-01-01|  FY24  || |Sep 2024|12 Dec 2024|2024-5-17"
).split("|")


def literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


VALUE_TEXTS = VALUE_TEXTS.replace("HOSTILE", ", ".join(f"({i}, {literal(t)}, {literal(u)}, {literal(k)})" for i, (t, u, k) in enumerate(HOSTILE_VALUES)))

#: Period texts: hostile ones, and three forms of every order's date.
PERIOD_TEXTS = """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10)
  WHEN 1 THEN 'FY' || CAST(year(o_orderdate) AS STRING) WHEN 2 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(year(o_orderdate) % 100 + 1 AS STRING)
  ELSE 'As of March ' || CAST(1 + o_orderkey % 33 AS STRING) || ', ' || CAST(year(o_orderdate) AS STRING) END AS time_text FROM {orders}
UNION ALL SELECT -id, time_text FROM (VALUES PERIODS) AS v(id, time_text)
""".replace("PERIODS", ", ".join(f"({i}, {literal(t)})" for i, t in enumerate([*PERIODS, None])))


#: Company-like names with endings and articles, by supplier and part.
NAMES = """
SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'The ' || n || ' Pvt. Ltd.' WHEN 1 THEN n || ', Inc' WHEN 2 THEN 'the The ' || n || ' Limited Corporation' WHEN 3 THEN upper(n) WHEN 4 THEN 'Private ' || n ELSE '  ' || n || '  PLC ' END AS name
FROM (SELECT s_suppkey, replace(s_name, '#', ' ') AS n FROM {supplier}) x
UNION ALL SELECT -p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' (' || p_brand || ')' ELSE p_brand || ' & ' || p_name || ' LLC' END FROM {part}
UNION ALL SELECT -1000000000 - id, name FROM (VALUES (1, 'The Ltd'), (2, 'Société Générale'), (3, 'Ltd'), (4, ''), (5, NULL), (6, 'the'), (7, 'A/S Ltd Inc the'), (8, 'Theatre Limited')) AS v(id, name)
"""

#: Sentences that define abbreviations and issuers, from parts and suppliers.
DEFINITIONS = """
SELECT 'doc-' || CAST(p_partkey % 20 AS STRING) AS document_id, CASE p_partkey % 6
  WHEN 0 THEN 'Growth of Gross Fixed Capital Formation (GFCF) in ' || p_brand WHEN 1 THEN 'the Consumer Price Index ("CPI") rose for ' || p_name
  WHEN 2 THEN 'a Central Product Ion (CPI) near ' || p_brand WHEN 3 THEN 'Total Value Added (GVA) does not align' WHEN 4 THEN 'Real Gross Value Added (GVA) and Net Asset Value (NAV)' ELSE p_name END AS text FROM {part}
UNION ALL SELECT 'doc-' || CAST(s_suppkey % 20 AS STRING), CASE s_suppkey % 3 WHEN 0 THEN 'approved by shareholders of Alpha ' || CASE WHEN s_suppkey % 20 < 10 THEN 'Beta' ELSE 'Gamma' END || ' Limited (the "Company") today'
  WHEN 1 THEN 'Delta Holdings ("Issuer") and others' ELSE s_name END FROM {supplier}
"""

#: Lines of documents as text evidence: twenty lines a page, blank ones left out.
EVIDENCE_SQL = r"""
SELECT document_id, page, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY line) - 1 AS INT) AS block_index, text FROM (
  SELECT CAST(doc_id AS STRING) AS document_id, CAST(line // 20 AS INT) AS page, line, trim(text, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) l) e WHERE text <> ''
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a view above."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same view for DuckDB, where tables are views of their own names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
