"""Operator 5: repeated multi-line chunks, by DataFrame functions only.

A chunk ends after a line when a rolling hash over its own and the line before's hash is 0 modulo DIVISOR, so
that chunks inside a passage are the same wherever the passage stands. Chunks of MIN_LINES lines or more meet by
128-bit hash; those of hashes that occur twice are compared byte by byte with the first (smallest id, then
place). The first stays, the others are removed with their line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

DIVISOR, MIN_LINES = 3, 2


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later lambdas can refer to without computing them again for each element."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def chunked(docs: DataFrame) -> DataFrame:
    """docs: key, t. Adds lines and chunks: (s, n) of each, places from 0."""
    d = held(docs, lines=F.split("t", "\n", -1))
    d = held(d, h=F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))
    ends = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == F.size("lines") - 1) | ((F.coalesce(F.get("h", i - 1), F.lit(0)) * 31 + F.get("h", i)) % DIVISOR == 0))
    d = held(d, ends=ends).drop("h")
    spans = F.transform("ends", lambda e, j: F.struct((F.coalesce(F.get("ends", j - 1), F.lit(-1)) + 1).alias("s"), (e - F.coalesce(F.get("ends", j - 1), F.lit(-1))).alias("n")))
    return held(d, chunks=spans).drop("ends")


def text_of(s, n) -> Column:
    return F.array_join(F.slice("lines", s + 1, n), "\n")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, n_spans (chunks removed), kept_sha256; with_text also kept_text.

    Null counts as empty: one empty line. Only line feeds end lines. A chunk that repeats inside a document is removed
    there too, but for its first place. Rows of the same id and text are documents that repeat each other: the
    same chunks go from both, as an id stands for its text. Null ids come first. Other columns aren't read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    parts = held(chunked(base), long=F.transform(F.filter("chunks", lambda c: c.n >= MIN_LINES), lambda c: F.struct(c.s.alias("s"), c.n.alias("n"), F.unhex(F.md5(text_of(c.s, c.n))).alias("h"))))
    start = cut(parts.select("id", "th", F.size("lines").alias("n_lines"), F.sha2("t", 256).alias("sha"), "long"), "chunks")
    each = start.select("id", "th", F.explode("long").alias("c")).select("id", "th", "c.*")
    twice = each.groupBy("h").agg(F.count("*").alias("c"), F.min(F.struct("id", "s", "th")).alias("first")).where("c > 1").drop("c")
    members = cut(each.join(twice.hint("merge"), "h").dropDuplicates(["id", "th", "s"]), "members")  # rows of the same id and text are one here
    # One text shuffle: documents that hold such chunks, with their places.
    lists = members.groupBy("id", "th").agg(F.collect_list(F.struct("s", "n", "h", "first")).alias("m"))
    same = (base["id"].eqNullSafe(lists["id"])) & (base["th"] == lists["th"])
    texts = cut(base.join(lists.hint("merge"), same).select(base["id"], base["th"], "t", "m").dropDuplicates(["id", "th"]), "texts")
    lined = held(texts, lines=F.split("t", "\n", -1))
    found = lined.select("id", "th", F.explode(F.transform("m", lambda c: F.struct(c.s.alias("s"), c.n.alias("n"), c.h.alias("h"), c.first.alias("first"), text_of(c.s, c.n).alias("x")))).alias("c")).select("id", "th", "c.*")
    at = F.struct("id", "s", "th")
    firsts = cut(found.where(at.eqNullSafe(F.col("first"))).select("h", F.col("x").alias("fx")), "firsts")
    compared = cut(found.join(firsts.hint("merge"), "h").select("id", "th", "s", "n", "h", "first", (F.col("x") == F.col("fx")).alias("same"), F.when(F.col("x") != F.col("fx"), F.col("x")).alias("x")), "compared")
    # Chunks of the same hash that differ from their first (collisions) are compared among themselves.
    others = compared.where("not same")
    own = others.groupBy("h", "x").agg(F.min(at).alias("first"))
    again = others.drop("first").join(own.hint("merge"), ["h", "x"])
    gone = compared.where("same").select("id", "th", "s", "n", "first").union(again.select("id", "th", "s", "n", "first")).where(~at.eqNullSafe(F.col("first")))
    drops = gone.groupBy("id", "th").agg(F.collect_list(F.struct("s", "n")).alias("g"))
    same = (lined["id"].eqNullSafe(drops["id"])) & (lined["th"] == drops["th"])
    hit = lined.drop("m").join(drops.hint("merge"), same).select(lined["id"], lined["th"], "lines", "g")
    # What stands between removed chunks, up to the end of the text.
    hit = held(hit, cuts=F.concat(F.array_sort("g"), F.array(F.struct(F.size("lines").alias("s"), F.lit(0).alias("n")))))
    before = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("cuts", j - 1).s + F.get("cuts", j - 1).n)
    hit = held(hit, kept=F.array_join(F.flatten(F.transform("cuts", lambda c, j: F.slice("lines", before(j) + 1, c.s - before(j)))), "\n"))
    hit = hit.select("id", "th", F.aggregate("g", F.lit(0), lambda n, c: n + c.n).alias("n_removed"), F.size("g").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    same = (start["id"].eqNullSafe(hit["id"])) & (start["th"] == hit["th"])
    out = start.join(hit.hint("merge"), same, "left")
    columns = [start["id"].alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*columns, *([F.col("kept").alias("kept_text")] if with_text else []))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n_lines FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS x FROM l),
e AS (SELECT *, (coalesce(lag(x) OVER w, 0) * 31 + x) % {DIVISOR} = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, chunk, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS x FROM k GROUP BY doc_id, chunk),
r AS (SELECT doc_id, chunk, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY x, n >= {MIN_LINES} ORDER BY doc_id, s) > 1 AS gone FROM c),
m AS (SELECT k.*, r.gone FROM k JOIN r USING (doc_id, chunk))
SELECT doc_id, max(n_lines)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_removed, count(DISTINCT chunk) FILTER (gone) AS n_spans,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
