"""What the operators of this package share: reading, shared storage, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Folders that cut() has written and nobody has dropped.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's checkpoint folder.

    Where none is set, a session of one machine (a local master, as in tests) gets a folder of its own; on a cluster that
    is an error, as executors wouldn't see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_by_context.get() if set_by_context.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "cut", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder, in a folder for each value of `by`, and reads it again: a short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*cuts: DataFrame, kinds: tuple[str, ...] = ()) -> None:
    """Deletes what cut() has written, once nothing that is still to run reads it, and lets go of the shuffles made of it.

    kinds: only the folders of these values of a column "kind" by which it was written."""
    spark = cuts[0].sparkSession
    for df in cuts:
        for kind in kinds:
            _delete(f"{df.cut_path}/kind={kind}", spark)
        if not kinds:
            _written.pop(df.cut_path, None)
            _delete(df.cut_path, spark)
    spark.sparkContext._jvm.System.gc()  # files of unreachable shuffles are cleaned after a collection


@atexit.register
def _drop_all() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path, spark)


def row_key(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs, written out with a number for each row, so that rows of equal or null ids can be told apart."""
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, plans that start send at most so many rows to Python at once: for rows that may each be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Smaller pieces of Arrow batches, so that few long texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trim() -> None:
    """Gives memory that has been freed back to the machine, as workers stay after their task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def buckets_for(docs: DataFrame, text_col: str, size: int) -> int:
    """How many buckets to deal what comes of the texts to: two for each shuffle partition, more where texts hold over `size` bytes a bucket."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Alternating large-star and small-star contraction (public: Kiveris et al., 2014): every round points nodes
    to the smallest neighbour; the rounds needed grow with the logarithm of the longest path. Minima are
    taken by partial aggregates, so a hub is never gathered in one task. Each round is written out, and the one
    before it deleted.
    """
    links = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def check(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.when(F.col("u") == F.col("v"), 1).otherwise(0))).first())

    seen = check(links)
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        # Minima are written out, so that the joins after them stand alone and a hub's rows can be split.
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        before, links = links, cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        drop(before, low, large, least)
        now = check(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    stars = links.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
