"""Operator 2: near-duplicates among embeddings by a pivot-permutation index.

A vector is described by its nearest reference points in order of nearness. Inverted lists, one for each two
pivots that a description holds, bring together the vectors that share at least these two; inside a list, the
vectors are compared in double precision. Each pair is judged in the list of its two smallest shared pivots alone,
so that counts add up without listing pairs. Long lists are dealt out in blocks. Of a list's links, what goes on
are sums by vector and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop, table

THRESHOLD = 0.9
#: Pivots: PER_ROOT times the square root of the vectors, within these bounds; they are drawn from the data by hash.
PER_ROOT, LEAST, MOST = 1.0, 64, 2048
#: Pivots of a description, and vectors of a block.
NEAREST, BLOCK = 8, 1024


def usable(v: str):
    """Finite in all components, and not all zero."""
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists(v, lambda x: x != 0)


def given(vectors: DataFrame) -> str:
    """Single or double precision, as the components come."""
    return "f4" if vectors.schema["v"].dataType.elementType.simpleString() == "float" else "f8"


def unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = raw.astype("f8")
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def described(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors: id, v, w. Adds near (pivots by nearness) and x (the components' bytes, as they are given)."""
    kind = given(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # MOST pivots at most

    def work(batches):
        for batch in batches:
            rows = batch.column("v").to_pylist()
            near, bytes_of = [], []
            for d in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == d]
                raw = np.array([rows[i] for i in at], dtype=kind)
                x = unit(raw)
                p = shared.value.get(d)
                k = min(NEAREST, len(p)) if p is not None else 0
                order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :k] if k else np.zeros((len(at), 0), int)
                near += zip(at, order.tolist())
                bytes_of += zip(at, (row.tobytes() for row in raw))
            near.sort(key=lambda p: p[0]), bytes_of.sort(key=lambda p: p[0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("w"), pa.array([n for _, n in near], pa.list_(pa.int16())), pa.array([u for _, u in bytes_of], pa.binary())], ["id", "w", "near", "x"])

    return vectors.select("id", "v", "w").mapInArrow(work, "id long, w long, near array<smallint>, x binary")


def compared(rows: DataFrame, threshold: float, kind: str = "f8") -> DataFrame:
    """kind: of the components in x. rows: cell, p, q, lo, hi, blk, id, w, near, x, sorted by cell. Gives (a, b, n): links of a forest (n null) and sums (b null)."""

    def judge(p, q, lo, hi, blk, ids, w, near, xs):
        for size in {len(x) for x in xs}:
            at = [i for i, x in enumerate(xs) if len(x) == size]
            if len(at) < 2:
                continue
            x = unit(np.frombuffer(b"".join(xs[i] for i in at), kind).reshape(len(at), -1))
            i_d, i_w, side = np.array([ids[i] for i in at]), np.array([w[i] for i in at]), np.array([blk[i] for i in at])
            small = sorted({n for i in at for n in near[i] if n < q and n != p})
            place = {n: k for k, n in enumerate(small)}
            has = np.zeros((len(at), max(1, len(small))), "f4")
            for r, i in enumerate(at):
                for n in near[i]:
                    if n in place:
                        has[r, place[n]] = 1
            a, b = (np.flatnonzero(side == lo), np.flatnonzero(side == hi)) if lo != hi else (np.arange(len(at)),) * 2
            linked = ((x[a] @ x[b].T) >= threshold) & ((has[a] @ has[b].T) == 0)
            if lo == hi:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            sums = np.zeros(len(at), "i8")
            np.add.at(sums, a, linked @ i_w[b])
            if lo != hi:
                np.add.at(sums, b, linked.T @ i_w[a])
            parent = list(range(len(at)))

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            forest = []
            for r in np.flatnonzero(linked.any(1)):
                for c in np.flatnonzero(linked[r]):
                    m, n = root(a[r]), root(b[c])
                    if m != n:
                        parent[m] = n
                        forest.append((int(i_d[a[r]]), int(i_d[b[c]])))
            yield from ((u, v, None) for u, v in forest)
            yield from ((int(i_d[i]), None, int(sums[i])) for i in np.flatnonzero(sums))

    def work(batches):
        held, out = None, []

        def flush():
            if held and len(held[1]) > 1:
                c = held[1]
                out.extend(judge(*held[0][1:], [r[0] for r in c], [r[1] for r in c], [r[2] for r in c], [r[3] for r in c], [r[4] for r in c]))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "n"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("cell", "p", "q", "lo", "hi", "blk", "id", "w", "near", "x")]
            for row in zip(*columns):
                key = row[:5]
                if held is None or held[0] != key:
                    flush()
                    held = (key, [])
                held[1].append(row[5:])
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        flush()
        yield batch_of(out)

    return rows.mapInArrow(work, "a long, b long, n long")


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay; so do vectors
    of different lengths to each other. Equal vectors are compared once and counted as often as they occur.
    Rows of equal or null ids are vectors each; component_id is null where no vector of a component has an id.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vector_col), F.col(vector_col)).alias("v"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ","))))
    known = rows.where("v is not null").groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("w"), F.first("v").alias("v"))
    ones = cut(known.select(F.monotonically_increasing_id().alias("id"), "h", "least", "w", "v"), "ones")
    n = ones.count()
    wanted = int(min(MOST, max(LEAST, PER_ROOT * math.sqrt(n))))
    pivots: dict[int, list] = {}
    for r in ones.orderBy(F.xxhash64(F.lit(7), "h"), "h").limit(wanted).select("v").collect():
        pivots.setdefault(len(r.v), []).append(unit(np.array([r.v], given(ones)))[0])
    index = cut(described(ones, {d: np.array(p) for d, p in pivots.items()}), "index")
    both = "filter(flatten(transform(array_sort(near), p -> transform(filter(near, q -> q > p), q -> struct(p, q)))), x -> true)"
    listed = index.select("id", "w", "near", "x", F.explode(F.expr(both)).alias("k")).select("id", "w", "near", "x", F.col("k.p").alias("p"), F.col("k.q").alias("q"))
    sizes = listed.groupBy("p", "q").agg(F.count("*").alias("size")).where("size > 1").withColumn("s", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = listed.join(sizes, ["p", "q"]).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    dealt = dealt.withColumn("cell", F.xxhash64("p", "q", "lo", "hi")).select("cell", "p", "q", "lo", "hi", "blk", "id", "w", "near", "x")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = cut(compared(dealt.repartition(parts, "cell").sortWithinPartitions("cell", "p", "q", "lo", "hi"), threshold, given(ones)), "links")
    drop(index)
    groups = components(found.where("b is not null"))
    sums = found.where("n is not null").groupBy(F.col("a").alias("one")).agg(F.sum("n").alias("n"))
    per_one = ones.select("h", F.col("id").alias("one"), "least", "w").join(sums, "one", "left").join(groups, F.col("one") == F.col("node"), "left")
    per_one = cut(per_one.select("h", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "one").alias("component")), "ones")
    # Written out, so that the join with it stands alone and a large component's rows can be split.
    named = cut(per_one.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    per_one = cut(per_one.join(named.hint("merge"), "component").select("h", "n_links", "component_id"), "ones")
    out = rows.select("id", "h").join(per_one, "h", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))
