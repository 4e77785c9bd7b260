"""Operator 13: hard negatives by a vector-approximation file.

Each component is quantised into one of CELLS cells of its dimension; the file of cell numbers stands beside the
exact components. Anchors and rows meet in a grid of blocks. In a block, each cell number is looked up in a table of
its cell's middle m and half width w, which bounds the score with anchor a by a.m -+ |a|.w. Only rows whose bounds may
enter the first places (positives) or the first places inside a window (negatives) are scored exactly, in integers. A
block gives its first places alone; those of all blocks meet by anchor.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Cells of a dimension; their edges are quantiles of SAMPLE rows (of the smallest hashes).
CELLS, SAMPLE = 64, 4000
#: Rows of a block (at least and at most), anchors of a block, and numbers held at once while a block is bounded.
LEAST, MOST, ANCHORS, AT_ONCE = 1024, 131_072, 4096, 1 << 20
FOUND = "anchor_row long, win long, row long, id long, score long"


def whole(v: str) -> Column:
    """floor(256 * x) of each component; beyond a long the nearest long."""
    return F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def takes_part(label: str, v: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) != math.inf))
    return F.col(label).isNotNull() & F.col(v).isNotNull() & finite


def edges_of(q: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """For each dimension its cells' first values, and at the end the value after the last cell. Outer cells reach a quarter of the range further."""
    out = []
    for x in q.astype("f8").T:
        lo, hi = x.min(), x.max()
        more = (hi - lo) / 4 + 1
        out.append(np.unique(np.floor(np.r_[lo - more, np.quantile(x, np.linspace(0, 1, cells + 1)[1:-1]), hi + more])))
    return out


def approximated(rows: DataFrame, edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """The file: row, id, label, dim, q (integers of 2 or 8 bytes), code (a byte a component, null where a component is outside all cells or no row of its length was in the sample)."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)  # of SAMPLE rows' lengths

    def work(batches):
        for batch in batches:
            q, code = [None] * batch.num_rows, [None] * batch.num_rows
            vs = batch.column("q")
            sizes = np.diff(vs.offsets.to_numpy())
            flat = vs.flatten().to_numpy(zero_copy_only=False)
            begin = np.r_[0, np.cumsum(sizes)]
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[(begin[at][:, None] + np.arange(d)[None]).astype(int)].reshape(len(at), d)
                small = (np.abs(np.clip(x, -(1 << 40), 1 << 40)) < 1 << 15).all(1)
                known = shared.value.get(int(d))
                inside, codes = np.zeros(len(at), bool), np.zeros((len(at), d), "u1")
                if known is not None and d:
                    inside[:] = True
                    for j, e in enumerate(known):
                        place = np.searchsorted(e, x[:, j].astype("f8"), side="right") - 1
                        inside &= (place >= 0) & (place < len(e) - 1)
                        codes[:, j] = np.clip(place, 0, 255)
                for k, i in enumerate(at):
                    q[i] = x[k].astype("<i2" if small[k] else "<i8").tobytes()
                    code[i] = codes[k].tobytes() if inside[k] else None
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(q, pa.binary()), pa.array(code, pa.binary())], ["row", "id", "label", "dim", "q", "code"])

    return rows.select("row", "id", "label", "q").mapInArrow(work, "row long, id long, label long, dim int, q binary, code binary")


def components_of(column: list[bytes], d: int) -> np.ndarray:
    return np.array([np.frombuffer(x, "<i2" if len(x) == 2 * d else "<i8") for x in column], dtype="i8").reshape(len(column), d)


def bounds(codes: list[bytes | None], anchors: np.ndarray, edges: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each anchor's score with each row; infinite for rows without cells."""
    low = np.full((len(anchors), len(codes)), -np.inf)
    high = -low
    has = np.array([i for i, c in enumerate(codes) if c is not None], int)
    if len(has) and edges is not None:
        code = np.frombuffer(b"".join(codes[i] for i in has), "u1").reshape(len(has), -1)
        middle, half = np.empty(code.shape), np.empty(code.shape)
        for j, e in enumerate(edges):
            middle[:, j] = ((e[:-1] + e[1:] - 1) / 2)[code[:, j]]
            half[:, j] = ((e[1:] - e[:-1] - 1) / 2)[code[:, j]]
        a = anchors.astype("f8")
        mid, reach = a @ middle.T, np.abs(a) @ half.T
        slack = (np.abs(a) @ (np.abs(middle) + half).T) * 2.0**-40  # of doubles, for large components
        slack[slack < 0.25] = 0  # sums below 2**38 are exact
        low[:, has], high[:, has] = mid - reach - slack, mid + reach + slack
    return low, high


def scores(q: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products, as Python's integers where a long might not hold them."""
    if not q.size:
        return np.zeros(len(q), "i8")
    most = max(abs(int(q.min())), abs(int(q.max()))) * max(abs(int(a.min())), abs(int(a.max()))) * len(a)
    return q @ a if most < 1 << 62 else q.astype(object) @ a.astype(object)


class Places:
    """The first `most` of what is offered: by score, higher first, then smaller id (null last), then row."""

    def __init__(self, most: int):
        self.most, self.held = most, []

    def offer(self, score, ids, rows) -> None:
        self.held = sorted([*self.held, *((-int(s), i is None, i or 0, r) for s, i, r in zip(score, ids, rows))])[: self.most]

    def least(self) -> float:
        """A row of a lower score can't enter."""
        return -self.held[-1][0] if len(self.held) == self.most else -math.inf


def enter(low: np.ndarray, high: np.ndarray, most: int, places: Places, lo: float = -math.inf, hi: float = math.inf) -> np.ndarray:
    """Which rows may be among the first `most` of those with a score from lo to hi: all others are certain not to be."""
    may = (high >= lo) & (low <= hi)
    least = places.least()
    sure = low[may & (low >= lo) & (high <= hi)]
    if len(sure) >= most:
        least = max(least, np.partition(sure, len(sure) - most)[len(sure) - most])
    return np.flatnonzero(may & (high >= least))


def block(rows: dict, anchors: dict, d: int, edges, most: int, windows: bool) -> tuple[list[tuple], int]:
    """Of one block (anchor_row, win, row, id, score) of the first places by anchor and window, and how many scores were exact.

    rows, anchors: columns as lists. Positives are other rows of the anchor's label, in one window of all scores; negatives are
    rows of other labels with LOW % to HIGH % of the score of a positive (anchors' column "wins")."""
    a, la = components_of(anchors["q"], d), np.array(anchors["label"], "i8")
    wins = anchors["wins"] if windows else [[0]] * len(a)
    held = {(i, w): Places(most) for i in range(len(a)) for w in wins[i]}
    exact, size = 0, max(256, AT_ONCE // max(1, d))
    for at in range(0, len(rows["row"]), size):
        part = slice(at, at + size)
        q, ids, row, labels = components_of(rows["q"][part], d), rows["id"][part], rows["row"][part], np.array(rows["label"][part], "i8")
        numbers, step = np.array(row), max(1, AT_ONCE // len(row))
        for first in range(0, len(a), step):
            low, high = bounds(rows["code"][part], a[first : first + step], edges)
            for i in range(first, min(len(a), first + step)):
                fits = np.flatnonzero(labels != la[i]) if windows else np.flatnonzero((labels == la[i]) & (numbers != anchors["row"][i]))
                lb, ub = low[i - first, fits], high[i - first, fits]
                for w in wins[i]:
                    lo, hi = (-((-LOW * w) // 100), (HIGH * w) // 100) if windows else (-math.inf, math.inf)
                    keep = fits[enter(lb, ub, most, held[i, w], lo, hi)]
                    exact += len(keep)
                    s = scores(q[keep], a[i])
                    good = np.flatnonzero((s >= lo) & (s <= hi)) if windows else np.arange(len(s))
                    if len(good) > most:  # ties of the last place stay
                        good = good[s[good] >= np.sort(s[good])[len(good) - most]]
                    held[i, w].offer(s[good], [ids[k] for k in keep[good]], [row[k] for k in keep[good]])
    long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    return [(anchors["row"][i], w, r, None if none else n, long(-s)) for (i, w), p in held.items() for s, none, n, r in p.held], exact


def met(file: DataFrame, anchors: DataFrame, edges: dict, n: int, n_anchors: int, windows: bool) -> DataFrame:
    """The first places of all blocks of the grid. Rows are dealt by their number, so no label or vector gathers rows in a block."""
    spark, most = file.sparkSession, NEGATIVES if windows else POSITIVES
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    across, down = max(1, -(-n // min(MOST, max(LEAST, -(-n // tasks))))), max(1, -(-n_anchors // ANCHORS))
    shared = spark.sparkContext.broadcast(edges)
    own = F.pmod(F.xxhash64("row"), F.lit(across)).alias("g")
    left = file.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("a"), own, F.lit(False).alias("anchor"), "row", "id", "label", "dim", "q", "code", F.lit(None).cast("array<long>").alias("wins"))
    right = anchors.select(F.pmod(F.xxhash64("row"), F.lit(down)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("g"), F.lit(True).alias("anchor"), "row", "id", "label", "dim", "q", "code", "wins")

    def work(key, part):
        d = key[2].as_py()
        side = lambda yes: part.filter(pc.equal(part["anchor"], yes)).select(["row", "id", "label", "q", "code", "wins"]).to_pydict()
        rows, asked = side(False), side(True)
        found = block(rows, asked, d, shared.value.get(d), most, windows)[0] if rows["row"] and asked["row"] else []
        return pa.Table.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(5)], ["anchor_row", "win", "row", "id", "score"])

    found = left.unionByName(right).groupBy("a", "g", "dim").applyInArrow(work, FOUND)
    by = Window.partitionBy("anchor_row", "win").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def smallest(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The `most` rows of the smallest hashes `key`. Each task offers as many to the driver, so rows of hashes too large for the first places stay out."""
    n = rows.count()
    if n > 4 * most:
        rows = rows.where(key < F.lit(-(1 << 63) + (4 * most << 64) // n))
    return rows.orderBy(key).limit(most)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor: Column | None = None) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows ask (the contract's: ids divisible by 100). Rows with a null label or vector, or with a component that is null
    or not finite (also after scaling) take no part; an empty vector does, with scores of 0. Vectors of different lengths have no score with
    each other. A row without an id is no anchor, but may be found; it comes after all ids at equal scores. Rows of equal ids are rows
    each. Anchors without positives, and positives without negatives in their window, give no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).where(takes_part("label", "v"))
    rows = rows.select("id", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), whole("v").alias("q"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "whole")
    sample: dict[int, list] = {}
    for r in smallest(rows, F.xxhash64(F.lit(13), "row"), SAMPLE).select("q").collect():
        sample.setdefault(len(r.q), []).append(r.q)
    edges = {d: edges_of(np.array(q, "f8")) for d, q in sample.items() if d}
    file = cut(approximated(rows, edges), "file")
    asks = F.coalesce(F.col("id") % 100 == 0 if anchor is None else anchor, F.lit(False))
    n, n_anchors = (int(x or 0) for x in file.agg(F.count("*"), F.sum(asks.cast("long"))).first())
    asked = file.where(asks)
    same = met(file, asked.withColumn("wins", F.array(F.lit(0).cast("long"))), edges, n, n_anchors, False)
    names = asked.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    positives = cut(same.join(names, "anchor_row").select("anchor_row", "anchor_id", F.col("id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("win")), "positives")
    wins = positives.groupBy("anchor_row").agg(F.collect_set("win").alias("wins"))  # POSITIVES at most
    other = cut(met(file, asked.join(wins, F.col("row") == F.col("anchor_row")).drop("anchor_row"), edges, n, n_anchors, True), "negatives")
    drop(rows, file)
    out = positives.join(other, ["anchor_row", "win"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("win").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
