"""Tables as immutable snapshots: merge by key, point reads, and the order that listings have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD = 50 << 20


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace stored ones of the same key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_columns(stored: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Only the named columns change, and only where the key is there."""
    fresh = new.select(*key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    out = stored.join(fresh, key, "left")
    return out.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns))


def hydrated(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts with their evidence ids in order; an empty list for those without."""
    ids = links.groupBy("fact_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    return facts.drop("evidence_ids").join(ids, "fact_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def missing_vectors(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    return facts.join(vectors.select("fact_id"), "fact_id", "left_anti")


def uploads(spark: SparkSession, path: str, most: int = MAX_UPLOAD) -> DataFrame:
    """Files with their content, and why each is refused (null: accepted): too large, or no PDF by its first bytes."""
    files = spark.read.format("binaryFile").load(path)
    refused = F.when(F.col("length") > most, "413: too large").when(F.coalesce(F.substring("content", 1, 4) != F.lit(b"%PDF"), F.lit(True)), "400: not a PDF")
    return files.select("path", "length", "content", F.sha2("content", 256).alias("file_sha256"), refused.alias("refused"))


def health(spark: SparkSession) -> dict[str, str]:
    try:
        spark.range(1).count()
    except Exception as e:  # a health probe never raises
        return {"status": "ok", "engine": f"unavailable: {type(e).__name__}"}
    return {"status": "ok", "engine": "ok"}
