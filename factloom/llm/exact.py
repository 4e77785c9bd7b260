"""Operator 3: exact deduplication, by DataFrame functions only.

Rows meet by the 128-bit hash of their normalised text. Hashes that occur once need nothing more. Rows of the
others are compared, byte by byte, with the text of their group's smallest id; rows that differ from it although
their hash is the same (a collision) form groups by their text itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, row_key, table

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, and the columns named in `more`.

    Null text counts as empty. A group's smallest id stays; null ids come after all others. Rows that have the
    same id and equal text are copies as well: group_size counts them all, and kept is true for the id that stays.
    Other columns aren't read.
    """
    norm = normalised(text_col)
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("t")).withColumn("h", F.unhex(F.md5("t")))
    light = cut(docs.select(F.col(id_col).alias("id"), norm.alias("t"), *(F.col(c).alias(f"more_{c}") for c in more)).select("id", F.unhex(F.md5("t")).alias("h"), F.sha2("t", 256).alias("text_sha256"), *(f"more_{c}" for c in more)), "hashes")
    groups = cut(light.groupBy("h").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1"), "groups")
    # Sort-merge at any size: the groups grow with the data, so they are never broadcast.
    members = cut(texts.join(groups.hint("merge"), "h").select("id", "h", "t", "keep_id"), "members")
    # The text of a group's first row: one of the rows that have the smallest id.
    # Written out, so that the join after it stands alone and a large group's rows can be split.
    first = cut(members.where(F.col("id") == F.col("keep_id")).groupBy("h").agg(F.min("t").alias("first")), "first")
    compared = cut(members.join(first.hint("merge"), "h", "left").select("id", "h", "keep_id", F.coalesce(F.col("t") == F.col("first"), F.lit(False)).alias("same"), F.when(F.coalesce(F.col("t") != F.col("first"), F.lit(True)), F.col("t")).alias("other")), "compared")
    drop(groups, members, first)
    equal = compared.where("same").groupBy("h").agg(F.min("keep_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("other", F.lit(None).cast("string"))
    others = compared.where("not same").groupBy("h", "other").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    found = equal.unionByName(others.select(equal.columns))
    digest = F.when(F.col("other").isNotNull(), F.sha2("other", 256))
    # Equal hash and equal second digest: only rows of one text share both, as the comparison has told them apart.
    apart = found.where("other is not null").select("h", digest.alias("text_sha256"), F.col("keep_id").alias("o_keep"), F.col("group_size").alias("o_size"))
    out = light.join(equal.select("h", "keep_id", "group_size"), "h", "left").join(apart, ["h", "text_sha256"], "left")
    keep, size = F.coalesce("o_keep", "keep_id", "id"), F.coalesce("o_size", "group_size", F.lit(1).cast("long"))
    out = out.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256", *(F.col(f"more_{c}").alias(c) for c in more))
    out.reads = (light, compared)
    return out


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each text: of smallest id (null ids last), any one of equal ids.

    Rows are told apart by a number, so that other texts of the same or no id stay.
    """
    keyed = row_key(docs)
    found = classes(keyed, id_col, text_col, more=("__row",))
    stay = cut(found.where("kept").groupBy("text_sha256").agg(F.min("__row").alias("__row")).select("__row"), "stay")
    drop(*found.reads)
    return keyed.join(stay.hint("merge"), "__row", "left_semi").select(docs.columns)


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
