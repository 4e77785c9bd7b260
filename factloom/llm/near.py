"""Operator 6: near-duplicate documents by Order MinHash, verified by banded alignment.

A document's five-word k-mers are labelled with their occurrence (the second of equal ones differs from the first).
Each sketch takes the two k-mers of smallest hash and keeps them in text order, so that sharing a sketch tells of
edit similarity, not of shared words alone. Documents meet their group's leaders (its first and its last row) for every
sketch and for every two neighbouring sketches; the latter tell apart what one common passage has brought together.
Candidates are verified by alignment of words inside a band of 1 - SIMILARITY of the longer text. Of what leaders leave in
several classes, all other pairs of a group meet, in a grid of blocks: counts of words by hash say which pairs can't be
similar, and the others are verified too, unless links have put them in one class before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, components, cut, drop, row_key, slices, table, trim

WORDS, SIMILARITY = 5, 0.8
SKETCHES, MINIMA = 16, 2
#: Hashes that a block counts a text's words by; rows and words of a group that one side of a block holds.
COUNTS, BLOCK, WORDS_OF_BLOCK = 4096, 1024, 1_000_000
_rng = np.random.default_rng(20_240_607)
FACTORS = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64)
LETTERS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, LABEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Bytes whose words are hashed at once; powers of the hash of a word's bytes, longer words have their own.
STRETCH = 1 << 18
POWERS = np.cumprod(np.full(64, STEP, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * LABEL
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def codes_of(joined: bytes) -> np.ndarray:
    """Hashes of words that single spaces part."""
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined + b" ", np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    longest = int(sizes.max())
    powers = POWERS if longest <= len(POWERS) else np.cumprod(np.full(longest, STEP, np.uint64))
    out = []
    # a stretch of words at a time
    edges = np.unique(np.r_[np.searchsorted(starts, np.arange(0, len(data), STRETCH)), len(starts)])
    for x, y in zip(edges, edges[1:]):
        own = data[starts[x] : ends[y - 1]]
        place = np.arange(len(own)) - np.repeat(starts[x:y] - starts[x], sizes[x:y])
        out.append(np.add.reduceat(LETTERS[own] * powers[place], starts[x:y] - starts[x]))
    return mixed(np.concatenate(out))


def word_codes(text: str, _kept: dict | None = None) -> np.ndarray:
    return codes_of(" ".join(text.lower().split()).encode())


def labelled(codes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the k-mers in text order, occurrences labelled; a text of fewer words is one k-mer."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    w = mixed(codes)
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(words, len(w))):
        h = h * STEP + w[j : j + n]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
    if len(start) < n:
        runs = np.diff(np.r_[start, n])
        nth = np.arange(n) - np.repeat(start, runs)
        h[order] = mixed(s + nth.astype(np.uint64) * LABEL)
    return h


def sketch_places(h: np.ndarray) -> np.ndarray:
    """For each sketch, the places of the k-mers of smallest hash, in text order."""
    keys = h[None, :] * FACTORS[:, None] + SHIFTS[:, None]
    keys = (keys ^ (keys >> np.uint64(31))) * STEP
    m, row = min(MINIMA, len(h)), np.arange(SKETCHES)
    least = np.empty((SKETCHES, m), np.int64)
    for j in range(m):
        least[:, j] = keys.argmin(axis=1)
        keys[row, least[:, j]] = np.iinfo(np.uint64).max
    return np.sort(least, axis=1)


def sketch(codes: np.ndarray) -> np.ndarray:
    h = labelled(codes)
    if not len(h):
        return np.zeros(0, np.uint64)
    least = sketch_places(h)
    out = np.arange(SKETCHES, dtype=np.uint64) * LABEL
    for j in range(least.shape[1]):
        out = mixed(out * STEP + h[least[:, j]])
    return out


#: Cells of a band that are held at once; wider bands are filled row by row.
CELLS = 12_000_000


def _diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """For 0, 1, 2, ... edits, the furthest place in `a` reached on each diagonal of the band (Landau and Vishkin)."""
    n, m = len(a), len(b)
    k = np.arange(-most, most + 1)
    # b shifted by each diagonal, in strides over one padded copy; 0 and 1 number the padding and never equal a word of `a`
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[:n].astype(np.int32) + 2, codes[n:].astype(np.int32) + 2
    padded = np.zeros(most + n + 1 + most + max(0, m - n), np.int32)
    padded[most : most + m] = y[: len(padded) - most]
    shifted = np.lib.stride_tricks.sliding_window_view(padded, n + 1)[: len(k)]
    # from each place of a diagonal, the next one whose words differ
    places = np.arange(n + 1, dtype=np.int32)[None, :]
    stop = np.minimum.accumulate(np.where(shifted == np.append(x, np.int32(1))[None, :], np.int32(n), places)[:, ::-1], axis=1)[:, ::-1]
    low, high, row = np.maximum(0, -k), np.minimum(n, m - k), np.arange(len(k))
    goal, none = most + m - n, np.int64(-(1 << 40))
    reached, up, down = (np.full(len(k), none) for _ in range(3))
    reached[most] = stop[most, 0]
    for e in range(most + 1):
        if e:
            up[1:], down[:-1] = reached[:-1], reached[1:] + 1
            i = np.minimum(np.maximum(np.maximum(reached + 1, up), down), high)
            ok = (i >= low) & (i >= 0)
            reached = np.where(ok, stop[row, np.where(ok, i, 0)], none)
        if reached[goal] >= n:
            return e
    return None


def _rows(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The band of the edit matrix, one row after the other."""
    n, m = len(a), len(b)
    k = np.arange(-most, most + 1)
    far = 1 << 40
    row, down = np.where(k >= 0, k, far), np.full(len(k), far)
    row[k > m] = far
    for i in range(1, n + 1):
        j = i + k
        inside = (j >= 1) & (j <= m)
        cost = a[i - 1] != b[np.minimum(np.maximum(j - 1, 0), m - 1)]
        down[:-1] = row[1:] + 1
        new = np.minimum(np.where(inside, row + cost, far), down)
        new[j == 0] = i
        new[(j < 0) | (j > m)] = far
        row = np.minimum.accumulate(new - k) + k
        row[(j < 0) | (j > m)] = far
        if row.min() > most:
            return None
    found = int(row[most + m - n])
    return found if found <= most else None


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences; None if above `most`. Only diagonals at most `most` apart are looked at, fewer first."""
    if abs(len(a) - len(b)) > most:
        return None
    # equal ends need no alignment
    both = min(len(a), len(b))
    differ = np.flatnonzero(a[:both] != b[:both])
    head = int(differ[0]) if len(differ) else both
    a, b = a[head:], b[head:]
    both -= head
    differ = np.flatnonzero(a[::-1][:both] != b[::-1][:both])
    tail = int(differ[0]) if len(differ) else both
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    band = max(8, abs(len(a) - len(b)))
    while True:
        band = min(band, most)
        found = (_diagonals if (2 * band + 1) * len(a) <= CELLS else _rows)(a, b, band)
        if found is not None or band == most:
            return found
        band = most if most <= 128 else band * 3


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements the two have in common, each as often as in both."""
    s, t = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(s[0], t[0], assume_unique=True, return_indices=True)
    return int(np.minimum(s[1][i], t[1][j]).sum())


def pairs(a: np.ndarray) -> np.ndarray:
    return mixed(a[:-1] * STEP + a[1:])


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = int(np.floor(longest * (1 - threshold) + 1e-9))
    if abs(len(a) - len(b)) > most:
        return False
    # What is in common bounds the distance from below: an edit touches one word, and two pairs of neighbours.
    if longest - shared(a, b) > most:
        return False
    if longest > 1 and longest - 1 - shared(pairs(a), pairs(b)) > 2 * most:
        return False
    return distance(a, b, most) is not None


def counts(codes: np.ndarray) -> np.ndarray:
    """How often each hash stands; what two texts have in common is no more than by hash."""
    return np.bincount((mixed(codes) & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS).astype(np.int32)


def met(part: pa.Table, number: int, across: bool, threshold: float = SIMILARITY) -> pa.Table:
    """part: one, n, class, own, s, t of a block's rows. Classes that similar texts of the block join; what they join isn't compared again.

    across: pairs of different `own` alone. A pair that shares several sketches is compared where the first of these, `number`, is."""
    n, group, own, texts = (part[c].to_numpy() for c in ("n", "class", "own", "t"))
    codes = [word_codes(t) for t in texts]
    bags = [(np.array([counts(c) for c in codes]), 0, 1), (np.array([counts(pairs(c)) for c in codes]), 1, 2)]
    sketches = np.array(part["s"].to_pylist(), np.int64)
    order = np.argsort(n, kind="stable")
    most = np.floor(n * (1 - threshold) + 1e-9)
    now, links = group.copy(), []
    for place, i in enumerate(order):
        # texts that are longer, up to the longest that may be similar
        j = order[place + 1 :]
        j = j[n[j] - most[j] <= n[i]]
        if across:
            j = j[own[j] != own[i]]
        j = j[now[j] != now[i]]
        j = j[(sketches[j] == sketches[i]).argmax(1) == number]
        for bag, fewer, edits in bags:  # as in similar()
            at = np.flatnonzero(bag[i])
            j = j[n[j] - fewer - np.minimum(bag[np.ix_(j, at)], bag[i, at]).sum(1) <= edits * most[j]]
        for k in j:
            if now[k] != now[i] and similar(codes[i], codes[k], threshold):
                links.append((group[i], group[k]))
                now[now == now[k]] = now[i]
    return pa.table({"class_a": pa.array([a for a, _ in links], pa.int64()), "class_b": pa.array([b for _, b in links], pa.int64())})


def rest(ones: DataFrame, texts: DataFrame, found: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Links (class_a, class_b) of similar texts that share a sketch and stand in different classes. Two neighbouring sketches bring no pair that one doesn't.

    A group is dealt into parts of about BLOCK rows, and each two parts meet in a block of their own; the first three rows of a group have met."""
    keyed = ones.join(found.hint("merge"), F.col("one") == F.col("node"), "left").select("one", "m", "n", F.coalesce("component", "one").alias("class"), "s")
    keyed = cut(keyed, "members")
    rows = keyed.select("one", "n", "class", F.posexplode("s").alias("number", "k"))
    sums = rows.groupBy("k").agg(F.count("*").alias("c"), F.sum("n").alias("words"), F.min("class").alias("x"), F.max("class").alias("y"), F.min("one").alias("first"), F.max("one").alias("last"))
    groups = cut(sums.where("c > 3 and x <> y").select("k", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("words") / WORDS_OF_BLOCK)).alias("parts"), "first", "last"), "groups")
    many = cut(rows.join(groups.hint("merge"), "k").select("one", "k", "number", "parts", "first", "last").where("one not in (first, last)").drop("first", "last"), "many")  # these two have met all
    # A text is found again by its 128-bit hash, whatever row it stands in.
    wanted = cut(keyed.join(many.select("one").distinct().hint("merge"), "one"), "asked")
    full = cut(texts.select("m", "t").join(wanted.hint("merge"), "m").dropDuplicates(["one"]).drop("m"), "texts")
    dealt = many.join(full.hint("merge"), "one").withColumn("own", F.pmod(F.xxhash64("one"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("n", "class", "s", "t", "own", "k", "number", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def work(key, part):
        return met(part, key[1].as_py(), key[2].as_py() != key[3].as_py(), threshold)

    out = cut(dealt.groupBy("k", "number", "i", "j").applyInArrow(work, "class_a long, class_b long").distinct(), "rest")
    drop(keyed, groups, many, wanted, full)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, row: str | None = None) -> DataFrame:
    """One row per row of docs: id, class_id (smallest id of its near-duplicates), class_size, kept; with row (a column that numbers the rows), it too.

    Words are lower-cased and parted by white space. Texts of equal words are one class, and are compared once. Null,
    empty and blank texts are equal to each other. Texts under five words are near-duplicates of equal ones only.
    Rows of the same id, or of none, are documents each; class_id is null where no row of a class has an id. kept is
    true for one row of each class, of its smallest id. Other columns aren't read.
    """

    def sketched(batches):
        for batch in slices(batches):
            hashes, sizes, values = [], [], []
            for text in batch.column(3).to_pylist():
                words = " ".join(text.lower().split()).encode()
                codes = codes_of(words)
                hashes.append(hashlib.md5(words).digest())
                sizes.append(len(codes))
                values.append(sketch(codes).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["id", "row", "m", "h", "n", "s"])
        trim()

    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.col(row) if row else F.monotonically_increasing_id()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), number.alias("row"), F.unhex(F.md5(text)).alias("m"), text.alias("t"))
    with arrow_rows(docs.sparkSession, 512):  # long texts
        light = cut(texts.mapInArrow(sketched, "id long, row long, m binary, h binary, n long, s array<long>"), "sketches")
    # Equal words: one row stands for them.
    same = cut(light.groupBy("h").agg(F.min("row").alias("one"), F.min("id").alias("least")), "same")
    ones = cut(light.join(same.hint("merge"), "h").where("row = one").select("one", "m", "n", "s").where("n >= 1"), "ones")
    neighbours = "transform(sequence(0, size(s) - 1), i -> xxhash64(s[i], s[(i + 1) % size(s)], i))"
    keyed = ones.select("one", "n", F.explode(F.concat("s", F.expr(neighbours))).alias("k"))
    ends = F.array(*(F.struct(f(F.col("one")).alias("leader"), by("n", "one").alias("leader_n")) for f, by in ((F.min, F.min_by), (F.max, F.max_by))))
    leaders = keyed.groupBy("k").agg(ends.alias("l"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = keyed.join(leaders.hint("merge"), "k").select("one", "n", F.explode("l").alias("l")).select("one", "n", "l.*")
    near = near.where(f"one <> leader and abs(n - leader_n) <= {1 - threshold + 1e-9} * greatest(n, leader_n)")
    edges = cut(near.select(F.least("one", "leader").alias("a"), F.greatest("one", "leader").alias("b")).distinct(), "candidates")

    def verified(batches):
        for batch in slices(batches, 64):
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([similar(word_codes(x), word_codes(y), threshold) for x, y in zip(xs, ys)], pa.bool_()))
            del xs, ys
        trim()

    asked = edges.select(F.col("a").alias("one")).union(edges.select("b")).distinct()
    # A text is found again by its 128-bit hash, whatever row it stands in.
    wanted = cut(ones.select("one", "m").join(asked.hint("merge"), "one"), "asked")
    words = cut(texts.select("m", "t").join(wanted.hint("merge"), "m").select("one", "t").dropDuplicates(["one"]), "texts")
    both = edges.join(words.select(F.col("one").alias("a"), F.col("t").alias("x")).hint("merge"), "a").join(words.select(F.col("one").alias("b"), F.col("t").alias("y")).hint("merge"), "b")
    with arrow_rows(docs.sparkSession, 128):  # a leader's text comes with each of its rows
        links = cut(both.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"), "links")
    found = cut(components(links), "found")
    drop(edges, wanted, words, links)
    links = rest(ones, texts, found, threshold)
    drop(ones)
    if not links.isEmpty():
        joined = cut(components(links, "class_a", "class_b").select(F.col("node").alias("class"), F.col("component").alias("whole")), "joined")
        own = links.select(F.col("class_a").alias("node")).union(links.select("class_b")).distinct()  # also classes of one text
        singles = own.join(found.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component"))
        both, before = found.union(singles), found
        found = cut(both.join(joined.hint("merge"), F.col("component") == F.col("class"), "left").select("node", F.coalesce("whole", "component").alias("component")), "found")
        drop(before, joined)
    of_one = same.join(found.hint("merge"), F.col("one") == F.col("node"), "left").select("h", F.coalesce("component", "one").alias("class"))
    out = cut(light.select("id", "row", "h").join(of_one.hint("merge"), "h"), "classes")
    drop(light, same, links, found)
    # Written out, so that the join after it stands alone and a large class's rows can be split.
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    sizes = cut(out.groupBy("class").agg(F.min("id").alias("class_id"), first, F.count("*").alias("class_size")), "sizes")
    reads = (out, sizes)
    out = out.join(sizes.hint("merge"), "class")
    out = out.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("row") == F.col("first.row")).alias("kept"), *([F.col("row").alias(row)] if row else []))
    out.reads = reads
    return out


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each class: of smallest id (null ids last). Rows are told apart by a number."""
    keyed = row_key(docs)
    found = classes(keyed, id_col, text_col, row="__row")
    stay = cut(found.where("kept").select("__row"), "stay")
    drop(*found.reads)
    return keyed.join(stay.hint("merge"), "__row", "left_semi").select(docs.columns)


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
