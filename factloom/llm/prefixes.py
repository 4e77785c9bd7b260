"""Operator 12: the prefix trie of conversations, by polynomial rolling fingerprints.

The fingerprint of a conversation's first d turns is the sum of t_i * B**i modulo two primes, t_i a turn's hash. numpy
scans give all prefixes' sums of a conversation in one pass; as sums add up, a conversation may lie across tasks, and
a conversation rebuilt from two others has its sums from theirs. Prefixes of equal depth and fingerprint are candidates for
one node: each turn in such a group is compared with its representative's role and text. Turns that differ (a
collision) get a label by their text, and the labels on the way from the root become part of a node's key, which tells
nodes apart exactly. Sums over subtrees are sums over members: a node's value counts for one conversation, its smallest
member, which passes through all nodes above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, row_key, table

#: Primes and bases of the two sums.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 214013)
#: The first h = crc32 % HEAD turns come from the conversation that is c - c % FAMILY.
FAMILY, HEAD = 20, 4
#: Depths of a block when sums along a conversation are taken, and ids that are joined to a string at once.
STRETCH, IDS = 4096, 65536
KEY = ["depth", "g", "dev"]


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, e = np.ones(len(exponents), "i8"), base % prime, exponents.copy()
    while e.any():
        out = np.where(e & 1, out * square % prime, out)
        square, e = square * square % prime, e >> 1
    return out


def scanned(rows: DataFrame, primes, bases) -> DataFrame:
    """rows: row, c, t0, t1, words, sorted by c and place inside each partition. Adds pid, place, and the sums with (p0, p1) and without (q0, q1) the row, inside the partition."""

    def work(batches):
        pid, conv, n, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("c").to_numpy()
            new = np.r_[conv is None or c[0] != conv, c[1:] != c[:-1]]
            at = np.arange(len(c))
            start, carried = np.maximum.accumulate(np.where(new, at, 0)), np.cumsum(new) == 0
            place = at - start + np.where(carried, n, 0)
            columns = []
            for k, (p, b) in enumerate(zip(primes, bases)):
                term = batch.column(f"t{k}").to_numpy() % p * powers(b, place + 1, p) % p
                total = np.cumsum(term)
                with_it = (total - (total - term)[start] + np.where(carried, sums[k], 0)) % p
                columns += [pa.array(with_it), pa.array((with_it - term) % p)]
                sums[k] = int(with_it[-1])
            conv, n = int(c[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("c"), pa.array(np.full(len(c), pid), pa.int32()), pa.array(place), columns[0], columns[2], columns[1], columns[3], batch.column("words")], ["row", "c", "pid", "place", "p0", "p1", "q0", "q1", "words"])

    return rows.select("row", "c", "t0", "t1", "words").mapInArrow(work, "row long, c long, pid int, place long, p0 long, p1 long, q0 long, q1 long, words long")


def joined(parts: DataFrame, primes, bases) -> DataFrame:
    """parts, of scanned(): with conversations that lie across partitions continued. Two rows a partition, at most, come to the driver."""
    seen: dict[int, list] = {}
    for r in parts.groupBy("pid").agg(F.min("c").alias("first"), F.max("c").alias("last")).collect():
        for c in {r.first, r.last}:
            seen.setdefault(c, []).append(r.pid)
    across = [c for c, pids in seen.items() if len(pids) > 1]
    plus = lambda k: F.col(f"{k}")
    if not across:
        return parts.select("row", "c", "place", "p0", "p1", "q0", "q1", "words")
    spark = parts.sparkSession
    asked = F.broadcast(spark.createDataFrame([(c,) for c in across], "c long"))  # a conversation for each border at most
    shifts, state = [], {}
    for r in parts.join(asked, "c", "left_semi").groupBy("c", "pid").agg(F.count("*").alias("n"), F.max_by(F.struct("p0", "p1"), "place").alias("s")).orderBy("c", "pid").collect():
        n, sums = state.get(r.c, (0, (0, 0)))
        b = [pow(base, n, p) for p, base in zip(primes, bases)]
        shifts.append((r.c, r.pid, n, *sums, *b))
        state[r.c] = (n + r.n, tuple((s + x * y) % p for s, x, y, p in zip(sums, r.s, b, primes)))
    moved = spark.createDataFrame(shifts, "c long, pid int, n long, s0 long, s1 long, b0 long, b1 long")
    out = parts.join(F.broadcast(moved), ["c", "pid"], "left")
    sums = [F.when(F.col("n").isNull(), plus(f"{x}{k}")).otherwise((F.col(f"s{k}") + F.col(f"b{k}") * F.col(f"{x}{k}")) % primes[k]).alias(f"{x}{k}") for x in "pq" for k in (0, 1)]
    return out.select("row", "c", (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"), *sums, "words")


def fingerprints(turns: DataFrame, primes, bases) -> DataFrame:
    """turns: row, c, turn, role, text. Gives row, c, place (from 0), the sums p0, p1 with and q0, q1 without the turn, words."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Turns of equal number come by role, then text; ranges are told by the beginning of both, which is in the same order.
    tie = F.concat("role", F.lit("\0"), "text")
    hashes = [F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(1 << 31)).alias(f"t{k}") for k in (0, 1)]
    light = turns.select("row", "c", "turn", F.left(tie, F.lit(64)).alias("tie"), "role", "text", *hashes, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    dealt = light.repartitionByRange(parts, F.col("c"), F.asc_nulls_first("turn"), "tie").sortWithinPartitions("c", F.asc_nulls_first("turn"), "tie", "role", "text", "row")
    return joined(cut(scanned(dealt, primes, bases), "scan"), primes, bases)


def one(x: Column, y: Column) -> Column:
    """Both sums as one number."""
    return F.shiftleft(x, 31).bitwiseOR(y)


def different(entries: DataFrame, turns: DataFrame) -> DataFrame:
    """row, label of turns that differ from their group's representative: the first row that has the same role and text there."""
    shared = cut(entries.groupBy("depth", "g").agg(F.min(F.struct("c", "row")).alias("rep"), F.count("*").alias("n")).where("n > 1").select("depth", "g", F.col("rep.row").alias("rep")), "shared")
    asked = cut(entries.select("row", "depth", "g").join(shared.hint("merge"), ["depth", "g"]), "asked")
    members = cut(asked.join(turns.select("row", "role", "text").hint("merge"), "row"), "members")
    firsts = cut(members.where("row = rep").select("depth", "g", F.col("role").alias("first_role"), F.col("text").alias("first_text")), "firsts")
    other = members.join(firsts.hint("merge"), ["depth", "g"]).where("role <> first_role or text <> first_text")
    other = cut(other.select("row", "depth", "g", "role", "text"), "other")
    drop(shared, asked, members, firsts)
    labels = other.groupBy("depth", "g", "role", "text").agg(F.min("row").alias("label"))
    out = cut(other.join(labels, ["depth", "g", "role", "text"]).select("row", "label"), "labels")
    drop(other)
    return out


def digests(ends: DataFrame) -> DataFrame:
    """ends: depth, g, dev, c. For each node the SHA-256 of its conversations' ids in order. Ids are joined where their range lies; a node's pieces are then read one after another, never held together."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches):
        held, ids = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([held[2]]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], [*KEY, "first", "ids"])
        for batch in batches:
            for *key, c in zip(*(batch.column(k).to_pylist() for k in (*KEY, "c"))):
                if held != key or len(ids) == IDS:
                    if held:
                        yield out()
                    held, ids = key, []
                ids.append(c)
        if held:
            yield out()

    def hashed(batches):
        held, sha = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([held[2]]), pa.array([sha.hexdigest()])], [*KEY, "ends_sha256"])
        for batch in batches:
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in (*KEY, "ids"))):
                if held != key:
                    if held:
                        yield out()
                    held, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if held:
            yield out()

    pieces = ends.repartitionByRange(parts, *KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(runs, "depth long, g long, dev string, first long, ids string")
    return pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, g long, dev string, ends_sha256 string")


def trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns come by number, null first, those of equal number by role, then text; equal rows are turns each. Null role or text is empty.
    Rows without a conversation's id take no part; without conversations there are no nodes, not even the root. The remainder by FAMILY
    has its id's sign, as in SQL. Other columns aren't read.
    """
    spark = conversations.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = row_key(conversations.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).where("c is not null"), "row")
    rows = cut(fingerprints(turns, primes, bases), "prefixes")

    # A record for each conversation: its length, its first sums, and how it is rebuilt.
    at = lambda i: F.max(F.when(F.col("place") == i, F.struct("p0", "p1", "words"))).alias(f"f{i}")
    own = cut(rows.groupBy("c").agg((F.max("place") + 1).alias("n"), *(at(i) for i in range(HEAD - 1))), "records")
    base = own.select(F.col("c").alias("base"), F.col("n").alias("base_n"), *(F.col(f"f{i}").alias(f"b{i}") for i in range(HEAD - 1)))
    rec = own.withColumn("base", F.col("c") - F.col("c") % FAMILY).join(base.hint("merge"), "base", "left")
    rec = rec.withColumn("h", (F.crc32(F.encode(F.col("c").cast("string"), "utf-8")) % HEAD).cast("long")).withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))

    def pick(n: str, f: str, x: str) -> Column:
        """The sum of the first n turns of f."""
        out = F.lit(0).cast("long")
        for i in range(HEAD - 1):
            out = F.when(F.col(n) == i + 1, F.col(f"{f}{i}.{x}")).otherwise(out)
        return out

    rec = rec.select("c", "n", "base", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"), *(pick("k", "b", f"p{i}").alias(f"head{i}") for i in (0, 1)), *(pick("h", "f", f"p{i}").alias(f"skip{i}") for i in (0, 1)), "b0", "b1", "b2")
    rec = cut(rec, "rebuilt")

    def moved(x: str, i: int) -> Column:
        """The sum of the rebuilt conversation: what comes after the head moves by as many places as the head is shorter than what it replaces."""
        back = F.lit(1).cast("long")
        for less in range(1, HEAD):
            back = F.when(F.col("h") - F.col("k") == less, F.lit(pow(pow(bases[i], -1, primes[i]), less, primes[i]))).otherwise(back)
        moved_to = (F.col(f"head{i}") + back * F.pmod(F.col(f"{x}{i}") - F.col(f"skip{i}"), F.lit(primes[i]))) % primes[i]
        return F.when(F.col("c") == F.col("base"), F.col(f"{x}{i}")).otherwise(moved_to)

    whole = F.col("c") == F.col("base")  # its head is its own
    entries = rows.join(rec.drop("n", "b0", "b1", "b2").hint("merge"), "c").where((F.col("place") >= F.col("h")) | whole)
    entries = entries.select("row", "c", "length", "words", (F.col("place") >= F.col("h")).alias("own"), F.when(whole, F.col("place")).otherwise(F.col("place") - F.col("h") + F.col("k")).alias("depth"), one(moved("p", 0), moved("p", 1)).alias("g"), one(moved("q", 0), moved("q", 1)).alias("above")).withColumn("depth", F.col("depth") + 1)
    entries = cut(entries, "entries")
    labels = different(entries, turns)
    drop(turns, rows, own)

    heads = rec.where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1))).withColumn("b", F.array("b0", "b1", "b2"))
    sums = F.get("b", F.col("i"))
    before = F.when(F.col("i") > 0, one(F.get("b", F.col("i") - 1).p0, F.get("b", F.col("i") - 1).p1)).otherwise(F.lit(0).cast("long"))
    heads = heads.select("c", "base", "k", "length", sums.words.alias("words"), (F.col("i") + 1).cast("long").alias("depth"), one(sums.p0, sums.p1).alias("g"), before.alias("above"))
    columns = ["c", "length", "words", "depth", "g", "above"]
    through = entries.where("own").select(columns).union(heads.select(columns))
    if labels.isEmpty():
        through = through.withColumn("dev", F.lit("")).withColumn("above_dev", F.lit(""))
    else:
        odd = entries.join(labels, "row").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("depth", "own", "label"))).alias("odd"))
        lists = rec.select("c", "base", "k").join(odd, "c", "left").join(odd.select(F.col("c").alias("base"), F.col("odd").alias("base_odd")), "base", "left")
        none = F.array().cast("array<struct<depth:bigint,own:boolean,label:bigint>>")
        lists = lists.select("c", F.concat(F.filter(F.coalesce("base_odd", none), lambda x: x.depth <= F.col("k")), F.filter(F.coalesce("odd", none), lambda x: x.own)).alias("odd"))
        written = lambda most: F.array_join(F.transform(F.filter("odd", lambda x: x.depth <= most), lambda x: F.concat_ws(":", x.depth, x.label)), ",")
        through = through.join(lists, "c").withColumn("dev", written(F.col("depth"))).withColumn("above_dev", written(F.col("depth") - 1)).drop("odd")
    through = cut(through, "through")
    drop(entries, labels)

    end = (F.col("depth") == F.col("length")).cast("long")
    nodes = cut(through.groupBy(KEY).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(end).alias("n_ends"), F.max("words").alias("words"), F.min("above").alias("above"), F.min("above_dev").alias("above_dev")), "nodes")
    # A node of one conversation is trivial: one child or none, one leaf, nothing saved. The others are counted.
    shared = cut(nodes.where("n_convs > 1").withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "shared")

    parent = shared.select((F.col("depth") + 1).alias("depth"), F.col("g").alias("above"), F.col("dev").alias("above_dev"), F.col("conv_id").alias("parent"))
    nodes_up = cut(nodes.join(parent.hint("merge"), ["depth", "above", "above_dev"], "left"), "up")
    children = nodes_up.where("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("g"), F.col("above_dev").alias("dev")).agg(F.count("*").alias("n_children"))

    stretch = F.floor(F.col("depth") / STRETCH).alias("stretch")
    values = shared.select(*KEY, F.col("conv_id").alias("c"), "saved", stretch)
    inside = F.sum("saved").over(Window.partitionBy("c", "stretch").orderBy(F.desc("depth")))
    later = values.groupBy("c", "stretch").agg(F.sum("saved").alias("all")).withColumn("later", F.coalesce(F.sum("all").over(Window.partitionBy("c").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = values.withColumn("inside", inside).join(later, ["c", "stretch"]).select(*KEY, "c", (F.col("inside") + F.col("later")).alias("below"))
    totals = shared.groupBy(F.col("conv_id").alias("c")).agg(F.sum("saved").alias("total"))
    leaves = nodes.where("n_ends = n_convs").select(F.col("conv_id").alias("c"), F.lit(1).alias("leaf"))
    counted = cut(leaves.join(totals, "c", "full").select("c", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("total", F.lit(0)).alias("total")), "counted")
    members = cut(through.select(*KEY, "c").join(shared.select(KEY).hint("merge"), KEY), "members")
    summed = members.join(counted.hint("merge"), "c", "left").groupBy(KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("total").alias("all_saved"))
    below = below.join(totals.withColumnRenamed("total", "own_saved"), "c").select(*KEY, "below", "own_saved")

    ends = through.where("depth = length").select(*KEY, "c").join(shared.where("n_ends > 0").select(KEY).hint("merge"), KEY)
    rootless = rec.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("g"), F.lit("").alias("dev"), "c")
    hashes = cut(digests(ends.union(rootless)), "digests")

    top = rec.agg(F.min("c").alias("c"), F.count("*").alias("n")).first()
    firsts, leaf_nodes = nodes.agg(F.sum((F.col("depth") == 1).cast("long")), F.sum((F.col("n_ends") == F.col("n_convs")).cast("long"))).first()
    saved = shared.agg(F.sum("saved")).first()[0]
    none, single = hashlib.sha256(b"").hexdigest(), F.sha2(F.col("conv_id").cast("string"), 256)
    out = nodes_up.join(children, KEY, "left").join(summed, KEY, "left").join(below, KEY, "left").join(hashes, KEY, "left")
    alone = F.col("n_convs") == 1
    out = out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 1, F.lit(top.c)).otherwise(F.coalesce("parent", "conv_id")).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.when(alone, 1 - F.col("n_ends")).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"),
        F.when(alone, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        F.when(alone, 0).otherwise(F.col("below") + F.col("all_saved") - F.col("own_saved")).cast("long").alias("saved_tokens"),
        F.when(F.col("n_ends") == 0, none).when(alone, single).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )
    if not top.n:
        return out
    long = lambda x, name: F.lit(x).cast("long").alias(name)
    turnless = hashes.where("depth = 0").agg(F.max("ends_sha256").alias("s"))
    root = turnless.select(long(top.c, "conv_id"), long(0, "depth"), long(None, "parent_conv_id"), long(top.n, "n_convs"), long(firsts or 0, "n_children"), long(leaf_nodes or 1, "n_leaves"), long(saved or 0, "saved_tokens"), F.coalesce("s", F.lit(none)).alias("ends_sha256"))
    return out.union(root)


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT DISTINCT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1))))) % 4 AS h FROM t),
u AS (SELECT v.c, 0 AS part, pos, r, x FROM v JOIN t ON t.c = v.c - v.c % 20 AND pos < h UNION ALL SELECT v.c, 1, pos, r, x FROM v JOIN t ON t.c = v.c AND pos >= h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, r, x FROM u),
k AS (SELECT c, d, string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d) AS p, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words FROM o),
m AS (SELECT c, 0 AS d, '' AS p, 0 AS words FROM v UNION ALL SELECT * FROM k),
e AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS pp, d = max(d) OVER (PARTITION BY c) AS ends FROM m),
n AS (SELECT d, p, any_value(pp) AS pp, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY d, p),
s AS (SELECT d - 1 AS d, pp AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN s ON s.d = n.d AND s.p = n.p),
b AS (SELECT m.d, m.p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * a.words) AS saved FROM m JOIN a ON a.conv_id = m.c AND a.d >= m.d GROUP BY m.d, m.p)
SELECT a.conv_id, a.d::BIGINT AS depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children::BIGINT AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN b ON b.d = a.d AND b.p = a.p LEFT JOIN a q ON q.d = a.d - 1 AND q.p = a.pp
"""
