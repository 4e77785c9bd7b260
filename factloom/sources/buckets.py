"""Tables laid out by buckets of a key, so that a change writes only the buckets that it touches, and a look-up reads one.

A table is a description: its columns, how many buckets it has, by which columns, and in which folder each bucket's rows lie.
Folders are written once and never changed; a merge writes the touched buckets to a new folder and describes a table
that takes those from there and the others from where they were. Inside a bucket rows lie in order of the key, and files
have Bloom filters on it, so that a look-up skips what can't hold the key.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32
#: So many keys, at most, are named to the scan; more are joined.
NAMED = 1000


def bucket(by: list[str], n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names of the folders in there, and when each was last changed (milliseconds)."""
    fs, at = _file_system(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def write(rows: DataFrame, path: str, by: list[str], n: int = BUCKETS) -> dict:
    """Writes rows to a new folder under path, and describes them as a table. A bucket that is much larger than others gets several files."""
    name = f"v-{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", bucket(by, n)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *by)
    writer = dealt.write.partitionBy("bucket")
    for c in by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(f"{path}/{name}")
    found = [int(f.removeprefix("bucket=")) for f, _ in _folders(rows.sparkSession, f"{path}/{name}") if f.startswith("bucket=")]
    return {"schema": rows.schema.json(), "by": by, "n": n, "at": {str(b): name for b in sorted(found)}}


def read(spark: SparkSession, path: str, table: dict, only: list[int] | None = None) -> DataFrame:
    """The table's rows, or those of some buckets."""
    schema = T.StructType.fromJson(json.loads(table["schema"]))
    paths = [f"{path}/{name}/bucket={b}" for b, name in table["at"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(path: str, table: dict, new: DataFrame, keys: DataFrame) -> dict:
    """The table without rows that have one of `keys` (their columns are part of the table's, and hold those it is dealt by), and with `new`.

    new: rows whose keys are among them. Only buckets of the keys are read and written; columns that only one side has are null in the other."""
    spark, by, n = new.sparkSession, table["by"], table["n"]
    touched = [r[0] for r in keys.select(bucket(by, n).alias("b")).distinct().collect()]  # n at most
    stored = read(spark, path, table, touched)
    rows = stored.join(keys.distinct(), keys.columns, "left_anti").select(stored.columns).unionByName(new, allowMissingColumns=True)
    made = write(rows, path, by, n)
    rest = {b: name for b, name in table["at"].items() if int(b) not in touched}
    return made | {"at": {b: name for b, name in sorted((rest | made["at"]).items(), key=lambda x: int(x[0]))}}


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the table's columns, in its order; those it lacks are null."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def look_up(spark: SparkSession, path: str, table: dict, keys: list) -> DataFrame:
    """Rows with one of the keys, of a table that is dealt by one column. Reads the keys' buckets alone."""
    (by,) = table["by"]
    kind = T.StructType.fromJson(json.loads(table["schema"]))[by].dataType
    asked = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(by, kind)]))
    found = read(spark, path, table, [r[0] for r in asked.select(bucket([by], table["n"])).distinct().collect()])
    return found.where(F.col(by).isin(list(keys))) if len(keys) <= NAMED else found.join(asked.distinct(), by, "left_semi")


def semi(path: str, table: dict, keys: DataFrame) -> DataFrame:
    """Rows whose keys (the columns that the table is dealt by) are among `keys`. Reads their buckets alone."""
    touched = [r[0] for r in keys.select(bucket(table["by"], table["n"]).alias("b")).distinct().collect()]  # n at most
    return read(keys.sparkSession, path, table, touched).join(keys.select(table["by"]).distinct(), table["by"], "left_semi")


def unread(spark: SparkSession, path: str, tables: list[dict | str | None], hours: float) -> list[str]:
    """Folders under path that none of these descriptions names and that are older than so many hours."""
    used = {name for t in tables if t is not None for name in (t["at"].values() if isinstance(t, dict) else [t])}
    before = (time.time() - hours * 3600) * 1000
    return [name for name, changed in _folders(spark, path) if name not in used and changed <= before]


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)
