"""Substring search by an inverted index of short character runs, for batches of queries.

A query's tokens are runs of a-z and 0-9, so a text that holds one holds it inside a run of its own. The index lists, for
every run of one to GRAM characters in there, the rows that hold it. A token of up to GRAM characters is looked up as it is;
of a longer one the rarest gram is, and the rows found are compared with the token. There are at most 36 + 36**2 +
36**3 = 47,988 grams, so their frequencies are small at any size; the lists grow with the rows, lie in buckets sorted by
gram, and are joined with what is asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import jaccard, tokens

from .search import LIMIT, pool_size

GRAM, BUCKETS, RUN = 3, 64, "[a-z0-9]+"
#: Fields of a fact that are searched.
FIELDS = ("subject", "predicate", "value_text", "unit")
#: So many asked grams, at most, are named to the scan itself, which then skips files and row groups.
NAMED = 1000


def grams(text: Column) -> Column:
    """Distinct grams inside the runs of a text."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUN), F.lit(0))
    cut = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substr(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(runs), lambda r: F.flatten(F.array(*(cut(r, n) for n in range(1, GRAM + 1)))))))


def bucket(gram: str = "gram") -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def index(facts: DataFrame, fields=FIELDS) -> DataFrame:
    """bucket, gram, fact_id, document_id: a row for each gram of a fact."""
    text = F.concat_ws("\n", *fields)
    return facts.select("fact_id", "document_id", F.explode(grams(text)).alias("gram")).select(bucket().alias("bucket"), "gram", "fact_id", "document_id")


def laid_out(postings: DataFrame) -> DataFrame:
    """For writing by bucket: sorted by gram, and a long list in several files."""
    return postings.repartitionByRange("bucket", "gram", "fact_id").sortWithinPartitions("bucket", "gram", "fact_id")


def frequencies(postings: DataFrame) -> DataFrame:
    """gram, n: 47,988 rows at most."""
    return postings.groupBy("gram").agg(F.count("*").alias("n"))


def asked(queries: DataFrame, often: DataFrame) -> DataFrame:
    """queries: query_id, text. query_id, token, gram: the gram by which each distinct token is looked up; tokens with a gram that occurs nowhere are left out."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(0)))).alias("token"))
    n = F.least(F.length("token"), F.lit(GRAM))
    each = words.select("query_id", "token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: F.substr(F.col("token"), i, n))).alias("gram"))
    known = each.join(F.broadcast(often), "gram", "left")
    key = known.groupBy("query_id", "token").agg(F.min(F.struct("n", "gram")).alias("k"), F.count_if(F.col("n").isNull()).alias("lacking"))
    return key.where("lacking = 0").select("query_id", "token", "k.gram")


def found(keys: DataFrame, postings: DataFrame, facts: DataFrame, fields=FIELDS, named: int = NAMED) -> DataFrame:
    """query_id, fact_id of all facts that hold a token of the query in one of their fields. keys: asked(), and maybe document_id (null: any)."""
    keys = keys.withColumn("bucket", bucket())
    few = [r.gram for r in keys.select("gram").distinct().limit(named + 1).collect()]  # grams, of which there are a bounded number
    if len(few) <= named:
        hashes = [r[0] for r in keys.select("bucket").distinct().collect()]  # BUCKETS at most
        postings = postings.where(F.col("bucket").isin(hashes) & F.col("gram").isin(few))
    own = F.lit(True)
    if "document_id" in keys.columns:
        keys = keys.withColumnRenamed("document_id", "only")
        own = F.col("only").isNull() | (F.col("only") == F.col("document_id"))
    may = keys.join(postings, ["bucket", "gram"]).where(own)
    sure = may.where(F.length("token") <= GRAM).select("query_id", "fact_id")
    text = F.array(*(F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields))
    long = may.where(F.length("token") > GRAM).select("query_id", "token", "fact_id").join(facts.select("fact_id", text.alias("texts")), "fact_id")
    return sure.union(long.where(F.exists("texts", lambda t: F.contains(t, F.col("token")))).select("query_id", "fact_id")).distinct()


def first_of(hits: DataFrame, most: int) -> DataFrame:
    """The first `most` of each query by id."""
    first = Window.partitionBy("query_id").orderBy("fact_id")
    return hits.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).drop("place")


def lexical_pools(queries: DataFrame, postings: DataFrame, often: DataFrame, facts: DataFrame, limit: int = LIMIT, fields=FIELDS) -> DataFrame:
    """queries: query_id, text, and maybe document_id (null: any). For each query its first hits by id, scored by shared words: query_id, fact_id, lexical.

    The same pools as one scan of the facts for each query gives. Queries without a token, and null ones, have no hits."""
    keys, own = asked(queries, often), ["token"]
    if "document_id" in queries.columns:
        keys, own = keys.join(queries.select("query_id", "document_id"), "query_id"), ["token", "document_id"]
    # A token is looked up once, however many queries hold it. The first of a query's hits are among the first of each of its tokens.
    keys = keys.withColumn("ask", F.concat_ws("\n", *own))
    each = found(keys.select(F.col("ask").alias("query_id"), "gram", *own).distinct(), postings, facts, fields)
    of_token = first_of(each, pool_size(limit)).withColumnRenamed("query_id", "ask")
    pool = first_of(keys.select("query_id", "ask").join(of_token, "ask").select("query_id", "fact_id").distinct(), pool_size(limit))
    words = facts.select("fact_id", tokens(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))).alias("words"))
    q = queries.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(0))).alias("q"))
    return pool.join(words, "fact_id").join(q, "query_id").select("query_id", "fact_id", jaccard(F.col("words"), F.col("q")).alias("lexical"))


def hits_of_each(pools: DataFrame, limit: int = LIMIT, min_score: float = 0.0) -> DataFrame:
    """query_id, fact_id, score, rank: the best of each query, ties by id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("lexical"), "fact_id")
    kept = pools.where((F.col("lexical") > 0) & (F.col("lexical") >= min_score))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "fact_id", F.col("lexical").alias("score"), "rank")
