"""The exact k nearest vectors of other documents, for any number of queries, by pivots and the triangle inequality.

Vectors are taken to the unit sphere, where nearness by cosine is nearness by distance. Each belongs to its nearest
pivot's cell. A query first meets its own cell; its k-th distance there bounds the rest, and of the other cells it
only visits those that may hold something nearer: by the cell's radii and by the plane between both pivots. Inside a
cell, vectors lie in order of their distance to the pivot, so that a query reads one stretch of them. Cells are dealt
in blocks of vectors and blocks of queries; a block passes on k a query. Vectors are scanned and shuffled once for
all queries; the driver holds pivots and sums by cell alone.

Where all queries' visits together might be too many rows to lie on disk at once, cells are bundled and met in rounds: a query is copied once for a
bundle, each round passes on the k best so far, which bound the next one, and what a round has shuffled goes with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pivots: one for so many vectors, up to a bound. They are vectors of the smallest hashes, beside the origin, which is the only pivot of lengths that have no other.
PER_PIVOT, MOST = 2048, 512
#: Vectors and queries of a block, and numbers held at once.
BLOCK, ASKED, AT_ONCE = 8192, 8192, 1 << 21
#: Rows of queries by visited cells that may be made at once; with more, cells are met in rounds: vectors of a bundle of cells, and queries of its blocks.
ONCE, BUNDLE, BUNDLE_ASKED = 1 << 22, 1 << 15, 1 << 16
#: What rounding may add to a distance.
SLACK = 1e-7


def usable(v: str = "v") -> Column:
    """Finite, and not all zero."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between rows; y may hold the origin."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def matrix(column: pa.ListArray, at, d: int) -> np.ndarray:
    flat, begin = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.diff(column.offsets.to_numpy()))]
    return flat[(begin[at][:, None] + np.arange(d)[None]).astype(int)].astype("f8")


def pivots_of(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By length: the origin, then pivots. MOST vectors at most come to the driver."""
    found = {}
    for r in vectors.orderBy(F.xxhash64(F.lit(3), "v"), "v").limit(min(MOST, n // PER_PIVOT)).select("v").collect():
        found.setdefault(len(r.v), []).append(r.v)
    return {d: np.unique(np.r_[np.zeros((1, d)), unit(np.array(rows, "f8"))], axis=0)[::-1] if d else np.zeros((1, 0)) for d, rows in found.items()}


def celled(rows: DataFrame, pivots: dict[int, np.ndarray], kinds: str) -> DataFrame:
    """rows: id, document_id, v. Adds dim, cell (the nearest pivot) and r (the distance to it)."""
    if not pivots:
        return rows.select("*", F.size("v").alias("dim"), F.lit(0).alias("cell"), F.lit(1.0).alias("r"))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def work(batches):
        for batch in batches:
            vs = batch.column("v")
            sizes = np.diff(vs.offsets.to_numpy())
            cell, r = np.zeros(len(sizes), "i4"), np.ones(len(sizes))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if int(d) in shared.value:
                    away = distances(unit(matrix(vs, at, int(d))), shared.value[int(d)])
                    cell[at] = away.argmin(1)
                    r[at] = away[np.arange(len(at)), cell[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cell), pa.array(r)], [*batch.schema.names, "dim", "cell", "r"])

    return rows.mapInArrow(work, f"{kinds}, dim int, cell int, r double")


def reach(floor: float) -> float:
    """The distance at a cosine of `floor`."""
    return math.sqrt(max(0.0, 2 - 2 * floor)) + SLACK


def _least(vs: pa.ListArray, at, d: int, p: np.ndarray, home: np.ndarray, own: np.ndarray, radii: dict[tuple[int, int], tuple[float, float]], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances of vectors to the pivots of the cells `of`, and how near what these cells hold may be at least)."""
    dq = distances(unit(matrix(vs, at, d)), p[of])
    between = distances(p, p[of])[home]
    low, high = (np.array([radii.get((d, int(c)), (math.inf, -math.inf))[k] for c in of]) for k in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(between > 0, (dq * dq - (own**2)[:, None]) / (2 * between), 0)
    return dq, np.maximum(np.maximum(dq - high[None], low[None] - dq), plane)


def visited(asked: DataFrame, pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], tuple[float, float]], kinds: str) -> DataFrame:
    """asked: id, document_id, v, dim, cell, r, far (nothing farther is needed). A row for each other cell that may hold something as near; cell and r are that cell's and the query's distance to its pivot."""
    shared = asked.sparkSession.sparkContext.broadcast((pivots, radii))  # MOST pivots, and two numbers for each

    def work(batches):
        pivots, radii = shared.value
        for batch in batches:
            vs = batch.column("v")
            dims, home, own, far = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "r", "far"))
            rows, cells, away = [np.zeros(0, int)], [np.zeros(0, "i4")], [np.zeros(0)]
            for d in np.unique(dims):
                at, p = np.flatnonzero(dims == d), pivots.get(int(d))
                if p is None:
                    continue
                dq, least = _least(vs, at, int(d), p, home[at], own[at], radii, np.arange(len(p)))
                i, c = np.nonzero((least <= far[at][:, None] + SLACK) & (np.arange(len(p))[None] != home[at][:, None]))
                rows.append(at[i]), cells.append(c.astype("i4")), away.append(dq[i, c])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in ("id", "document_id", "v", "dim", "far")), pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(away))], ["id", "document_id", "v", "dim", "far", "cell", "r"])

    return asked.mapInArrow(work, f"{kinds}, dim int, far double, cell int, r double")


def _block(k: int, floor: float, same: bool):
    """(vectors, queries of one cell) -> k of each query at most, and a row for each query with how many it was compared with."""

    def work(left, right):
        n = right.num_rows
        d = left["dim"][0].as_py() if left.num_rows else 0
        out_q, out_c, out_s = [], [], []
        compared = np.zeros(n, "i8")
        if left.num_rows and n:
            left, right = left.combine_chunks(), right.combine_chunks()
            r = left["r"].to_numpy()
            order = np.argsort(r, kind="stable")
            left, r = left.take(pa.array(order)), r[order]
            x, q = (unit(matrix(t["v"].combine_chunks(), np.arange(t.num_rows), d)) for t in (left, right))
            docs = pa.concat_arrays([left["document_id"].combine_chunks(), right["document_id"].combine_chunks()]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            xd, qd = docs[: len(x)], docs[len(x) :]
            ids, asks = left["id"].to_pylist(), right["id"].to_pylist()
            names = right["name"].to_pylist() if "name" in right.column_names else asks
            rq, far = right["r"].to_numpy(), right["far"].to_numpy()
            by = np.argsort(rq, kind="stable")
            step = max(1, AT_ONCE // len(x))
            for at in range(0, n, step):
                part = by[at : at + step]
                lo, hi = np.searchsorted(r, rq[part] - far[part] - SLACK), np.searchsorted(r, rq[part] + far[part] + SLACK, side="right")
                first, last = lo.min(), hi.max()
                compared[part] = np.maximum(hi - lo, 0)
                if first >= last:
                    continue
                score = np.clip(q[part] @ x[first:last].T, -1, 1)
                place = np.arange(first, last)[None]
                need = np.maximum(floor, 1 - (far[part] + SLACK) ** 2 / 2 - SLACK)
                fits = (score >= need[:, None]) & (place >= lo[:, None]) & (place < hi[:, None])
                other = (qd[part][:, None] != xd[first:last][None]) | (qd[part] < 0)[:, None] | (xd[first:last] < 0)[None]
                good = fits & other
                if same:  # of the same document, later ones alone
                    j, g = np.nonzero(fits & ~other)
                    good[j, g] = [ids[first + b] > names[part[a]] for a, b in zip(j, g)]
                more = np.flatnonzero(good.sum(1) > k)
                if len(more):  # ties with the k-th stay, ids decide later
                    good[more] &= score[more] >= np.partition(np.where(good[more], score[more], -2), -k, axis=1)[:, -k, None]
                j, g = np.nonzero(good)
                out_q += [asks[i] for i in part[j]]
                out_c += [ids[first + b] for b in g]
                out_s += score[j, g].tolist()
        kind = right.schema.field("id").type
        asked = right["id"].combine_chunks() if n else pa.array([], kind)
        blank = pa.nulls(n, kind)
        return pa.Table.from_arrays([pa.chunked_array([pa.array(out_q, kind), asked], kind), pa.chunked_array([pa.array(out_c, kind), blank], kind), pa.chunked_array([pa.array(out_s, pa.float64()), pa.nulls(n, pa.float64())]), pa.chunked_array([pa.nulls(len(out_q), pa.int64()), pa.array(compared)])], ["query_id", "candidate_id", "score", "compared"])

    return work


def _met(left: DataFrame, right: DataFrame, sizes: DataFrame, k: int, floor: float, same: bool, id_kind: str) -> DataFrame:
    """sizes: for each dim and cell, into how many blocks its vectors (x) and its queries (y) are dealt. Both are copied to each block of the other side."""

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        both = rows.join(F.broadcast(sizes), ["dim", "cell"])  # a row for each cell
        return both.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1))).drop("n_x", "n_y")

    key = ["dim", "cell", "x", "y"]
    left, right = dealt(left, "x", "y"), dealt(right, "y", "x")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # queries may be rows of the vectors
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block(k, floor, same), f"query_id {id_kind}, candidate_id {id_kind}, score double, compared long")


def _bundle(k: int, floor: float, same: bool, shared):
    """(vectors of a bundle's cells, queries) -> what each query finds in those of the cells that it visits: k at most, and ties."""
    one = _block(k, floor, same)

    def work(left, right):
        out = []
        if left.num_rows and right.num_rows:
            pivots, radii = shared.value
            left, right = left.combine_chunks(), right.combine_chunks()
            d = left["dim"][0].as_py()
            cell, home, own, far = left["cell"].to_numpy(), right["cell"].to_numpy(), right["r"].to_numpy(), right["far"].to_numpy().copy()
            of = np.unique(cell)
            dq, least = _least(right["v"].combine_chunks(), np.arange(right.num_rows), d, pivots[d], home, own, radii, of)
            top = np.full((right.num_rows, k), -2.0)  # the best scores so far bound the cells that follow
            place = pa.array(np.arange(right.num_rows))
            for at in np.argsort(least.min(0), kind="stable"):
                asks = np.flatnonzero((least[:, at] <= far + SLACK) & (home != of[at]))
                if not len(asks):
                    continue
                some = pa.table({"id": place.take(pa.array(asks)), "v": right["v"].take(pa.array(asks)), "document_id": right["document_id"].take(pa.array(asks)), "r": dq[asks, at], "far": far[asks], "name": right["id"].take(pa.array(asks))})
                found = one(left.filter(pa.array(cell == of[at])), some)
                found = found.slice(0, found.num_rows - len(asks))
                out.append(found)
                q, score = found["query_id"].to_numpy(), found["score"].to_numpy()
                by = np.lexsort((-score, q))
                q, score = q[by], score[by]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                first = nth < k
                new = np.full((right.num_rows, k), -2.0)
                new[q[first], nth[first]] = score[first]
                touched = np.unique(q)
                top[touched] = np.sort(np.c_[top[touched], new[touched]], axis=1)[:, -k:]
                far[touched] = np.minimum(far[touched], np.sqrt(np.maximum(0, 2 - 2 * np.maximum(top[touched, 0], -1))) + SLACK)
        kind = right.schema.field("id").type
        if not out:
            return pa.table({"query_id": pa.array([], kind), "candidate_id": pa.array([], kind), "score": pa.array([], pa.float64())})
        found = pa.concat_tables(out)
        q, score = found["query_id"].to_numpy(), found["score"].to_numpy()
        stay = pa.array(np.flatnonzero(score >= top[q, 0]))
        found = found.take(stay)
        return pa.table({"query_id": right["id"].take(found["query_id"].combine_chunks()), "candidate_id": found["candidate_id"], "score": found["score"]})

    return work


def bundles(cells: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """cells: how many vectors each has. (bundle, blocks that its vectors are dealt into) of each cell; a cell of more than BUNDLE vectors is a bundle of its own."""
    groups: list[list] = []
    size, dim = 0, None
    for c, n in sorted(cells.items()):
        if dim != c[0] or size + n > BUNDLE:
            groups.append([])
            size, dim = 0, c[0]
        groups[-1].append(c)
        size += n
    return {c: (i, -(-sum(cells[o] for o in g) // BUNDLE)) for i, g in enumerate(groups) for c in g}


def _in_rounds(own: DataFrame, asked: DataFrame, home: DataFrame, pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, float]], sizes: dict[tuple[int, int], int], n_asked: int, k: int, floor: float, same: bool, store: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None]) -> DataFrame:
    """The k best of each query, other cells than its own met in rounds. A round makes about as many rows as there are vectors and queries, of one bundle at least."""
    spark, id_kind = own.sparkSession, own.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((pivots, cells))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    of, n_y = bundles(sizes), max(1, -(-n_asked // BUNDLE_ASKED))
    last, blocks = max(b for b, _ in of.values()), dict(of.values())
    made = {b: n_asked * blocks[b] + n_y * sum(sizes[c] for c in of if of[c][0] == b) for b in blocks}
    rounds, room = [[]], 0
    for b in range(last + 1):
        if rounds[-1] and made[b] > room:
            rounds.append([])
        if not rounds[-1]:
            room = sum(sizes.values()) + n_asked
        rounds[-1].append(b)
        room -= made[b]

    def met_in(wanted: list[int], found: DataFrame) -> DataFrame:
        dims = {d for d, c in of if of[d, c][0] in wanted}
        reached = {b: np.array([c for d, c in of if of[d, c][0] == b]) for b in wanted}
        dim_of = {of[d, c][0]: d for d, c in of}

        def going(batches, reached=reached, dim_of=dim_of):
            pivots, radii = shared.value
            for batch in batches:
                dims, home, own, far = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "r", "far"))
                for b, some in reached.items():
                    at = np.flatnonzero(dims == dim_of[b])
                    if len(at):
                        _, least = _least(batch.column("v"), at, dim_of[b], pivots[dim_of[b]], home[at], own[at], radii, some)
                        at = at[((least <= far[at][:, None] + SLACK) & (home[at][:, None] != some[None])).any(1)]
                        out = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(at), b, "i4"))], [*out.schema.names, "bundle"])

        near = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))) + SLACK).alias("near"))
        bound = asked.where(F.col("dim").isin(*dims)).join(near.hint("merge"), "id", "left").withColumn("far", F.least("far", F.coalesce("near", "far"))).select(*asked.columns)
        table = spark.createDataFrame([(d, c, *of[d, c]) for d, c in of if of[d, c][0] in wanted], "dim int, cell int, bundle int, n_x long")
        n_x = F.broadcast(table.select("bundle", "n_x").distinct())
        left = own.join(F.broadcast(table), ["dim", "cell"]).withColumn("x", F.pmod(F.xxhash64("id"), F.col("n_x"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n_y - 1)))).drop("n_x")
        right = bound.mapInArrow(going, f"{kinds}, bundle int").join(n_x, "bundle").withColumn("y", F.pmod(F.xxhash64("id"), F.lit(n_y)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_x") - 1))).drop("n_x")
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # queries may be rows of the vectors
        key = ["bundle", "x", "y"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_bundle(k, floor, same, shared), f"query_id {id_kind}, candidate_id {id_kind}, score double")

    found = store(best(home.select("query_id", "candidate_id", "score"), k).drop("rank"))
    for wanted in rounds:
        # nothing here holds on to a round's plan, so that what it has shuffled can go
        before, found = found, store(best(found.unionByName(met_in(wanted, found)), k).drop("rank"))
        drop(before)
    return found


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return found.where("candidate_id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def searched(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -1.0, same_document: bool = False, pivots: dict[int, np.ndarray] | None = None, store: Callable[[DataFrame], DataFrame] | None = None, drop: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """What all blocks found: query_id, candidate_id, score, and rows without a candidate that say how many vectors a query was `compared` with.

    vectors and queries: id, document_id, v (double); a candidate has another document, with same_document also the same one and a
    greater id, and a cosine of `floor` at least. Vectors that are null, zero, or hold null or non-finite components are left
    out; vectors of different lengths don't meet. Rows without a document are of no common one. Ids are unique.

    store: writes rows to a folder that driver and executors share, and reads them; drop: deletes what it wrote, with shuffles that nothing
    uses any more. With them, visits beyond ONCE rows are made in rounds, and there are no rows without a candidate then."""
    kinds = ", ".join(f"{n} {vectors.schema[n].dataType.simpleString()}" for n in ("id", "document_id", "v"))
    id_kind = vectors.schema["id"].dataType.simpleString()
    vectors, queries = (df.select("id", "document_id", "v").where(usable()) for df in (vectors, queries))
    if pivots is None:
        pivots = pivots_of(vectors, vectors.count())
    own, asked = celled(vectors, pivots, kinds), celled(queries, pivots, kinds).withColumn("far", F.lit(reach(floor)))
    # A row for each cell comes to the driver.
    cells = {(r.dim, r.cell): r for r in own.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    many = {(r.dim, r.cell): r.n for r in asked.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    blocks = vectors.sparkSession.createDataFrame([(*c, -(-r.n // BLOCK)) for c, r in cells.items()], "dim int, cell int, n_x long")
    at_home = vectors.sparkSession.createDataFrame([(*c, -(-r.n // BLOCK), -(-many[c] // ASKED)) for c, r in cells.items() if c in many], "dim int, cell int, n_x long, n_y long")
    home = _met(own, asked, at_home, k, floor, same_document, id_kind)
    if not pivots:
        return home
    if store is not None and sum(many.values()) * max(map(len, pivots.values())) > ONCE:
        radii, counts = {c: (r.low, r.high) for c, r in cells.items()}, {c: r.n for c, r in cells.items() if c[0] in pivots}  # lengths without pivots have one cell
        return _in_rounds(own, asked, home, pivots, radii, counts, sum(many.values()), k, floor, same_document, store, drop or (lambda _: None))
    # The k-th place at home bounds what is still needed.
    kth = best(home, k).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))) + SLACK).alias("near"))
    bound = asked.join(kth, "id", "left").withColumn("far", F.least("far", F.coalesce("near", "far"))).drop("near").select(*asked.columns)
    going = visited(bound, pivots, {c: (r.low, r.high) for c, r in cells.items()}, kinds)
    sizes = going.groupBy("dim", "cell").agg(F.ceil(F.count("*") / ASKED).alias("n_y")).join(F.broadcast(blocks), ["dim", "cell"])
    return home.unionByName(_met(own, going, sizes, k, floor, same_document, id_kind))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -1.0, same_document: bool = False, store: Callable[[DataFrame], DataFrame] | None = None, drop: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """query_id, candidate_id, score, rank: the k best of each query by score, then id. store, drop: as in searched()."""
    return best(searched(vectors, queries, k, floor, same_document, store=store, drop=drop), k).select("query_id", "candidate_id", "score", "rank")


def effort(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -1.0, same_document: bool = False) -> DataFrame:
    """query_id, compared, pruned: of all usable vectors, how many each query was compared with, and how many bounds left out."""
    found = searched(vectors, queries, k, floor, same_document).where("compared is not null").groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return found.withColumn("pruned", F.lit(vectors.where(usable()).count()) - F.col("compared"))
