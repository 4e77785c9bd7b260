"""Operator 4: language-model scores by prediction by partial matching.

A text is its lower-cased words, parted by single spaces, and an end symbol. Each byte is predicted from the up to
ORDER bytes before it, whatever words they belong to. The trie of byte contexts is learned from the training
documents. A byte is coded by the longest context that has been seen; where it hasn't followed that one, an escape
(method D) leads to the next shorter context, and there the bytes that followed the longer one are excluded.

Nothing is gathered in one place. Blocks of documents send their distinct words and grams (a context with the byte
after it), with counts, to buckets; all contexts that end in the same three bytes meet in one bucket, so it holds
whole branches of the trie. What a bucket needs of the trie's top, contexts of two bytes, it gets from buckets of
these; contexts of one byte and none (2**16 counts at most) go to all. Counts and code lengths go back the same way.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, buckets_for, cut, drop, slices, table, trim

#: Bytes of a context, at most; with the byte after them they fit into a 64-bit number.
ORDER = 6
#: Bytes of text in a block, of those whose grams are sorted at once, and for which there is a bucket.
BLOCK, PIECE, BUCKET = 12 << 20, 1 << 20, 64 << 20
#: Buckets of two-byte contexts: what they hold is bounded by the alphabet, not by the corpus.
LOWS = 32
#: Code lengths travel as multiples of 1 / FINE decimal digits.
FINE = float(1 << 36)
END = b"\n"
#: A NUL byte becomes 0xFF, which no UTF-8 text holds, so that 0 can stand for what is before a text.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\0", b"abcdefghijklmnopqrstuvwxyz\xff")


def coded_text(text: str | None) -> bytes:
    """Lower-cased words, parted by single spaces, and the end."""
    return b" ".join((text or "").encode().translate(LOWER).split()) + END


class Places(dict):
    """Numbers what is asked for, in the order of first asking."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """A number for every byte: its context's bytes, the nearest lowest, and below them the byte itself. No byte is 0 but before a text's start."""
    gap = b"\0" * order
    data = np.frombuffer(gap + gap.join(texts), np.uint8)
    key = data.astype(np.uint64)
    for j in range(1, order + 1):
        key[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
    return key[data != 0]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of counts of each."""
    order = np.argsort(keys)
    k = keys[order]
    if not len(k):
        return k, counts
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(counts[order], first)


class Trie:
    """Counts by context of one order after another: level j holds context bytes 1 to j and the byte they precede."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: Trie | None = None):
        seen = counts > 0
        keys, counts = keys[seen], counts[seen]
        self.levels = dict(low.levels) if low else {}
        lowest = max(self.levels, default=-1) + 1
        for j in range(lowest, order + 1):
            k, n = summed(keys & np.uint64((1 << 8 * (j + 1)) - 1), counts)
            # contexts in order: the key without its lowest byte
            c = k >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
            total = np.add.reduceat(n, first) if len(c) else np.zeros(0, np.int64)
            kinds = np.diff(np.r_[first, len(c)])
            below = np.zeros(len(first), np.int64)
            if j and len(c):
                # counts, in the next shorter context, of what follows this one
                low_k, low_n = self.levels[j - 1][0], self.levels[j - 1][1]
                below = np.add.reduceat(low_n[np.searchsorted(low_k, k & np.uint64((1 << 8 * j) - 1))], first)
            self.levels[j] = (k, n, c[first] if len(c) else c, total, kinds, below)
        self.order = order

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte after its context."""
        out, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
        n_above, d_above = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded: by counts here, by kinds
        for j in range(self.order, -1, -1):
            k, n, contexts, total, kinds, below = self.levels[j]
            key = keys & np.uint64((1 << 8 * (j + 1)) - 1)
            context = key >> np.uint64(8)
            if not len(k):
                continue
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            here = (contexts[at] == context) & ~done
            n_left, d_left = np.where(here, total[at] - n_above, 0), np.where(here, kinds[at] - d_above, 0)
            place = np.minimum(np.searchsorted(k, key), len(k) - 1)
            count = np.where(here & (k[place] == key), n[place], 0)
            hit = count > 0
            out[hit] += np.log10((2 * count[hit] - 1) / (2 * n_left[hit]))
            done |= hit
            miss = here & ~hit & (d_left > 0)
            out[miss] += np.log10(d_left[miss] / (2 * n_left[miss]))
            n_above, d_above = np.where(here, below[at], 0), np.where(here, kinds[at], 0)
        out[~done] -= np.log10(np.maximum(1, 256 - d_above[~done]))
        return out


def packed(x: np.ndarray) -> bytes:
    """Compressed, with the bytes of equal weight side by side."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) if len(x) else b""


def unpacked(x: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not x:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Of keys in order: their differences."""
    return packed(np.diff(keys, prepend=keys.dtype.type(0)))


def unpacked_keys(x: bytes, kind: str = "u8") -> np.ndarray:
    return np.cumsum(unpacked(x, kind), dtype=kind)


def squeezed(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text)


def expanded(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places by bucket, else in order; where each bucket begins in them)."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def spread(x: np.ndarray, buckets: int) -> np.ndarray:
    return (((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def by_context(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the context's last three bytes."""
    return spread((keys >> np.uint64(8)) & np.uint64(0xFFFFFF), buckets)


def pieces(texts: list[bytes]):
    """Runs of texts of about PIECE bytes each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= PIECE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def numbered(texts: list[bytes], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's words (an end as a NUL byte); the number of each token's word; the words' places by bucket, and where each begins; sizes by text."""
    places = Places()
    end = places[b"\0"]
    numbers = []
    for low, high in pieces(texts):
        found = b"".join(texts[low:high]).replace(END, b" \0 ").split()
        numbers.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
    numbers, words = np.concatenate(numbers), list(places)
    order, edges = dealt(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets, buckets)
    return words, numbers, order, edges, np.diff(np.flatnonzero(numbers == end), prepend=-1)


def counted(texts: list[bytes], trains: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct grams in order, and how often each is in its training texts."""
    keys, counts = [], []
    for low, high in pieces(texts):
        trained = np.repeat(trains[low:high], [len(t) for t in texts[low:high]])
        key = np.sort(grams(texts[low:high], order) << np.uint64(1) | trained.astype(np.uint64))
        weight, key = (key & np.uint64(1)).astype(np.int64), key >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        keys.append(key[first])
        counts.append(np.add.reduceat(weight, first))
        if sum(map(len, keys[1:])) > max(len(keys[0]), PIECE):
            merged = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [merged[0]], [merged[1]]
    return summed(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 1 else (keys[0], counts[0])


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place among them of each."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.empty(len(keys), np.uint32)
    at[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return k[new], at


PARTS = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("low", pa.int32()), ("data", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64()))])
PARTS_SQL = "kind string, block long, bucket int, low int, data binary, counts binary, ids array<long>"


def one(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _split(order: int, buckets: int):
    """Blocks of documents: their texts; to buckets their words, grams, and the sums of these by two-byte context."""

    def sent(block: int, ids: list, texts: list[bytes]):
        yield one(PARTS, "doc", block, -1, -1, squeezed(b"".join(texts)), None, ids)
        trains = np.array([not held_out(i) for i in ids])
        words, numbers, by, edges, sizes = numbered(texts, buckets)
        counts = np.bincount(numbers[np.repeat(trains, sizes)], minlength=len(words))
        for b in range(buckets):
            own = by[edges[b] : edges[b + 1]]
            if len(own):
                yield one(PARTS, "words", block, b, -1, squeezed(b" ".join(words[i] for i in own)), packed(counts[own].astype("u4")), None)
        del words, numbers
        keys, counts = counted(texts, trains, order)
        by, edges = dealt(by_context(keys, buckets), buckets)
        for b in range(buckets):
            own = by[edges[b] : edges[b + 1]]
            if len(own):
                yield one(PARTS, "grams", block, b, -1, packed_keys(keys[own]), packed(counts[own].astype("u4")), None)
                low, n = summed((keys[own] & np.uint64(0xFFFFFF)).astype("u4"), counts[own])
                yield one(PARTS, "lows", block, b, -1, packed_keys(low), packed(n.astype("u4")), None)

    def work(batches):
        base, n_blocks, ids, texts, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24, 0, [], [], 0
        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(name)
                texts.append(coded_text(text))
                size += len(texts[-1]) + 16
                if size >= BLOCK:
                    yield from sent(base | n_blocks, ids, texts)
                    n_blocks, ids, texts, size = n_blocks + 1, [], [], 0
                    trim()
        if ids:
            yield from sent(base | n_blocks, ids, texts)
        trim()

    return work

def _worded(rows: pa.Table) -> pa.Table:
    """Training counts of words, to each block; once for a bucket, the sum and how many there are."""
    lists = [expanded(x).split(b" ") for x in rows.column("data").to_pylist()]
    total: dict[bytes, int] = {}
    for words, counts in zip(lists, rows.column("counts").to_pylist()):
        for word, n in zip(words, unpacked(counts, "u4").tolist()):
            total[word] = total.get(word, 0) + n
    answers = [packed(np.fromiter(map(total.__getitem__, words), np.int64, len(words))) for words in lists]
    told = [[v] + [None] * (len(lists) - 1) for v in (sum(total.values()), sum(n > 0 for n in total.values()))]
    return pa.Table.from_arrays([rows.column("block"), rows.column("bucket"), pa.nulls(len(lists), pa.binary()), pa.array(answers, pa.binary()), *(pa.array(t, pa.int64()) for t in told)], schema=ANSWERS)


ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("logs", pa.binary()), ("data", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
ANSWERS_SQL = "block long, bucket int, logs binary, data binary, tokens long, distinct long"
LOWERS = pa.schema([("bucket", pa.int32()), ("low", pa.int32()), ("data", pa.binary()), ("counts", pa.binary()), ("pair", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
LOWERS_SQL = "bucket int, low int, data binary, counts binary, pair array<int>, n array<long>"


def _all(rows: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all rows and the sums of their counts."""
    keys = [unpacked_keys(x, kind) for x in rows.column("data").to_pylist()]
    counts = [unpacked(x, "u4").astype("i8") for x in rows.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, kind), np.zeros(0, "i8"))


def _asked(rows: pa.Table) -> pa.Table:
    """A bucket's sums by two-byte context, to the buckets of these."""
    low, n = _all(rows, "u4")
    by, edges = dealt(spread((low >> np.uint32(8)).astype(np.uint64), LOWS), LOWS)
    bucket = rows.column("bucket")[0].as_py()
    out = [(bucket, to, packed_keys(low[by[a:b]]), packed(n[by[a:b]])) for to, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
    return pa.Table.from_arrays([*(pa.array([r[i] for r in out], LOWERS.field(i).type) for i in range(4)), *(pa.nulls(len(out), LOWERS.field(i).type) for i in (4, 5))], schema=LOWERS)


def _lowered(rows: pa.Table) -> pa.Table:
    """For each asking bucket, all that follows its two-byte contexts; once, the sums by contexts of one byte."""
    asked = [unpacked_keys(x, "u4") for x in rows.column("data").to_pylist()]
    low, n = summed(np.concatenate(asked), np.concatenate([unpacked(x, "i8") for x in rows.column("counts").to_pylist()]))
    out = []
    for a in asked:
        own = np.isin(low >> np.uint32(8), a >> np.uint32(8)) & (n > 0)
        out.append((packed_keys(low[own]), packed(n[own])))
    pair, pair_n = summed(low & np.uint32(0xFFFF), n)
    told = [pa.array([v.tolist()] + [None] * (len(out) - 1), t) for v, t in ((pair, pa.list_(pa.int32())), (pair_n, pa.list_(pa.int64())))]
    return pa.Table.from_arrays([rows.column("bucket"), rows.column("low"), *(pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)), *told], schema=LOWERS)


def _coded(order: int, top):
    """Code lengths of a bucket's grams, to the blocks that sent them; top: the trie of contexts of one byte at most."""

    def work(rows: pa.Table, lows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return ANSWERS.empty_table()
        asked = [unpacked_keys(x) for x in rows.column("data").to_pylist()]
        keys, n = summed(np.concatenate(asked), np.concatenate([unpacked(x, "u4").astype("i8") for x in rows.column("counts").to_pylist()]))
        low = [unpacked_keys(x, "u4").astype("u8") for x in lows.column("data").to_pylist()]
        low_n = [unpacked(x, "i8") for x in lows.column("counts").to_pylist()]
        second = Trie(np.concatenate(low), np.concatenate(low_n), 2, top.value)
        logs = Trie(keys, n, order, second).logs(keys)
        logs = np.rint(logs * -FINE).astype("u8")
        found = [packed(logs[np.searchsorted(keys, a)]) for a in asked]
        return pa.Table.from_arrays([rows.column("block"), rows.column("bucket"), pa.array(found, pa.binary()), *(pa.nulls(len(asked), t) for t in (pa.binary(), pa.int64(), pa.int64()))], schema=ANSWERS)

    return work


def _scored(order: int, buckets: int, n_all: int, distinct: int, id_col: str):
    schema = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        ids = docs.column("ids")[0].as_py()
        texts = [t + END for t in expanded(docs.column("data")[0].as_py()).split(END)[:-1]]
        counts_of, logs_of = {}, {}
        for bucket, logs, data in zip(answers.column("bucket").to_pylist(), answers.column("logs").to_pylist(), answers.column("data").to_pylist()):
            if logs is None:
                counts_of[bucket] = unpacked(data, "i8")
            else:
                logs_of[bucket] = unpacked(logs, "u8") / -FINE
        words, numbers, by, _, sizes = numbered(texts, buckets)
        counts = np.empty(len(words), np.int64)
        counts[by] = np.concatenate([counts_of[b] for b in sorted(counts_of)])
        del words
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        base = np.add.reduceat(np.log10((counts + 0.5) / (n_all + 0.5 * (distinct + 1)))[numbers], starts)
        known = np.add.reduceat((counts > 0)[numbers].astype(np.int64), starts)
        parts = [placed(grams(texts[a:b], order)) for a, b in pieces(texts)]
        keys = np.sort(np.concatenate([u for u, _ in parts]))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        by, _ = dealt(by_context(keys, buckets), buckets)
        logs = np.empty(len(keys))
        logs[by] = np.concatenate([logs_of[b] for b in sorted(logs_of)])
        score = []
        for (a, b), (u, at) in zip(pieces(texts), parts):
            score.append(np.add.reduceat(logs[np.searchsorted(keys, u)][at], np.r_[0, np.cumsum([len(t) for t in texts[a:b]])[:-1]]))
        columns = (ids, [held_out(i) for i in ids], sizes, known, np.full(len(ids), n_all), base, np.concatenate(score))
        del texts, parts, keys, logs, numbers, counts, logs_of, counts_of
        trim()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return work


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    order: 3 to 6. Null, empty and blank texts are an end alone. Rows with the same id are documents each. A null id
    counts as the text 'None' for the split. Without training documents, counts are 0 and bytes are equally likely.
    Other columns aren't read.
    """
    if not 3 <= order <= ORDER:
        raise ValueError("order must be from 3 to 6")
    spark = docs.sparkSession
    buckets = buckets_for(docs, text_col, BUCKET)
    with arrow_rows(spark, 512):  # long texts
        parts = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_split(order, buckets), PARTS_SQL), "parts", by="kind")
    words = parts.where("kind = 'words'").select("block", "bucket", "data", "counts")
    worded = cut(words.groupBy("bucket").applyInArrow(_worded, ANSWERS_SQL), "worded")
    n_all, distinct = worded.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    asked = parts.where("kind = 'lows'").select("bucket", "data", "counts").groupBy("bucket").applyInArrow(_asked, LOWERS_SQL)
    lowered = cut(asked.groupBy("low").applyInArrow(_lowered, LOWERS_SQL), "lowered")
    # 2**16 rows at most
    top = lowered.where("pair is not null").select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n")).toArrow()
    top = spark.sparkContext.broadcast(Trie(top.column("pair").to_numpy().astype("u8"), top.column("n").to_numpy().astype("i8"), 1))
    of_grams = parts.where("kind = 'grams'").select("block", "bucket", "data", "counts").groupBy("bucket")
    coded = cut(of_grams.cogroup(lowered.select("bucket", "data", "counts").groupBy("bucket")).applyInArrow(_coded(order, top), ANSWERS_SQL), "codes")
    # What is used up goes, so that disk holds little more than the texts and the answers to them.
    drop(lowered)
    drop(parts, kinds=("words", "lows", "grams"))
    texts = parts.where("kind = 'doc'").select("block", "data", "ids")
    return texts.groupBy("block").cogroup(worded.union(coded).groupBy("block")).applyInArrow(_scored(order, buckets, n_all, distinct, id_col), f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
