"""Operator 9: removal of passages that occur twice, by merging the Burrows-Wheeler transforms of shards.

Texts are parsed into phrases that begin where a window of w k-mers has its smallest hash (leftmost of equals), so that equal
passages are parsed alike, but for their edges. Over phrases, a passage of LENGTH bytes is a dozen symbols long.

* A shard sorts the suffixes of its parse once, by prefix doubling. That gives its transform: the suffixes' order, the
  phrase before each (a step to the left in the text), and the common prefixes of neighbours.
* The merge refines the interleave of all shards' suffixes. A block holds the suffixes of all shards that begin with the
  same phrases; in each shard it is one interval. Steps to the left double the settled prefix: a suffix whose block at
  depth k is x, and whose suffix k phrases on is in block y, is in block (x, y) at depth 2k. Shards send one row for each
  of their intervals, buckets number the blocks, and blocks of one suffix are settled and leave. No suffix is sorted again.
* Common prefixes follow: a run of m phrases is repeated if its two overlapping runs of the largest power of two make a
  block of several suffixes. What such runs cover is repeated as a whole; that settles all but the edges of passages.
* At the edges, windows of LENGTH bytes are told by the run of phrases inside and the bytes on both sides of it. Of what
  covers settle, one place (the witness) answers for windows that are the same as one at an edge.

Nothing rests on digests: those of phrases and of windows only choose which of them are sent; phrases of equal digest are
compared byte by byte, blocks are pairs of exact numbers, and bytes at edges are compared as they are.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, buckets_for, cut, drop, slices, table, trim
from .ppm import dealt, expanded, packed, spread, squeezed, unpacked

LENGTH = 400
#: Bytes of text of a shard, and for which there is a bucket.
SHARD, BUCKET = 2 << 20, 32 << 20
#: Bytes that are hashed at once, and texts that are sent to a worker at once.
STRETCH, TEXTS = 1 << 18, 512
#: Low bits of a window's minimum that hold its place in the shard: documents are below 2 GB.
PLACE = np.uint64(31)
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(19_970_303)
LETTERS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROWS = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
ROWS_SQL = "kind string, shard long, bucket int, data binary"


def sampling(length: int) -> tuple[int, int]:
    """(bytes of a k-mer, k-mers of a window): a passage of `length` bytes holds at least five windows side by side."""
    k = max(1, min(32, length // 8))
    return k, max(1, (length - k + 1) // 5)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * FACTOR
    return x ^ (x >> np.uint64(32))


def kmers(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers, from those of the powers of two that make up k."""
    part, size, out, done = LETTERS[data], 1, None, 0
    while True:
        if k & size:
            out, done = (part, size) if out is None else (out[: len(data) - done - size + 1] * FACTOR ** np.uint64(size % 64 + 1) + part[done : len(data) - size + 1], done + size)
        if 2 * size > k:
            return mixed(out)
        part = part[:-size] * (MIX + np.uint64(2 * size)) + part[size:]
        size *= 2


def minima(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def parsed(data: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of phrases, and the total; first window that chose each start, -1 for a text's start that none chose). base: the texts' starts, and the total."""
    k, w = sampling(length)
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    open_ = np.ones(len(data), bool)  # windows that end in their text
    for end in base[1:].tolist():
        open_[max(0, end - (w + k - 1) + 1) : end] = False
    firsts, starts, before = [], [], -1
    for begin in range(0, len(data) - (w + k - 1) + 1, STRETCH):
        hashes = kmers(data[begin : begin + STRETCH + w + k - 2], k)
        places = (hashes << PLACE >> PLACE << PLACE) | np.arange(begin, begin + len(hashes), dtype=np.uint64)
        chosen = (minima(places, w) & np.uint64((1 << 31) - 1)).astype(np.int64)
        at = begin + np.flatnonzero(open_[begin : begin + len(chosen)])
        chosen = chosen[at - begin]
        new = np.flatnonzero(np.r_[chosen[:1] != before, chosen[1:] != chosen[:-1]])
        firsts.append(at[new])
        starts.append(chosen[new])
        before = chosen[-1] if len(chosen) else before
    first, chosen = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, starts))
    start = np.union1d(chosen, base)
    low = np.full(len(start) - 1, -1, np.int64)
    low[np.searchsorted(start, chosen)] = first
    return start, low


def digests(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of the phrases; equal for equal phrases."""
    if len(start) < 2:
        return np.zeros(0, np.uint64)
    sizes = np.diff(start)
    powers = np.cumprod(np.full(int(sizes.max()), FACTOR, np.uint64))
    out = []
    # a stretch of phrases at a time
    edges = np.unique(np.r_[np.searchsorted(start, np.arange(0, len(data), STRETCH)), len(sizes)])
    for x, y in zip(edges, edges[1:]):
        own, place = data[start[x] : start[y]], np.arange(start[y] - start[x]) - np.repeat(start[x:y] - start[x], sizes[x:y])
        out.append(np.add.reduceat(LETTERS[own] * powers[place], start[x:y] - start[x]))
    return mixed(np.concatenate(out) + sizes.astype(np.uint64))


def blob(*arrays: np.ndarray) -> bytes:
    return pickle.dumps([(x.dtype.str, packed(x)) for x in arrays])


def unblob(data: bytes) -> list[np.ndarray]:
    return [unpacked(x, kind) for kind, x in pickle.loads(data)]


class Shard:
    """The parse of a shard's texts, its suffix order and the blocks found so far."""

    def __init__(self, length: int, docs: np.ndarray, base: np.ndarray, start: np.ndarray, low: np.ndarray, names: list[np.ndarray], order: np.ndarray, common: np.ndarray, settled: np.ndarray, witness: np.ndarray):
        #: Numbers of the texts among the shard's documents; their starts; of phrases, the starts and the first windows.
        self.length, self.docs, self.base, self.start, self.low = length, docs, base, start, low
        #: Block of each suffix at depths 1, 2, 4 ...; -1: of one suffix, or none.
        self.names = names
        #: Suffixes that begin with a repeated phrase, in order, and how many phrases each shares with the one before.
        self.order, self.common = order, common
        #: Phrases in which all windows are repeated; those of them that stand for equal ones.
        self.settled, self.witness = settled, witness

    def pack(self) -> bytes:
        steps = [np.diff(x, prepend=0).astype("i4") for x in (self.docs, self.base, self.start, self.low)]
        places = [np.flatnonzero(n >= 0) for n in self.names]
        return pickle.dumps((self.length, blob(*steps, self.order.astype("i4"), self.common.astype("i4"), self.settled, self.witness), [blob(np.diff(p, prepend=0).astype("i4"), n[p]) for p, n in zip(places, self.names)]))

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        length, arrays, levels = pickle.loads(data)
        *steps, order, common, settled, witness = unblob(arrays)
        docs, base, start, low = (np.cumsum(x, dtype=np.int64) for x in steps)
        names = []
        for level in levels:
            places, values = unblob(level)
            full = np.full(len(low), -1, np.int64)
            full[np.cumsum(places, dtype=np.int64)] = values
            names.append(full)
        return cls(length, docs, base, start, low, names, order.astype(np.int64), common.astype(np.int64), settled, witness)

    def ends(self) -> np.ndarray:
        """End of the text that each phrase is in."""
        return self.base[np.searchsorted(self.base, self.start[:-1], "right")]

    def runs(self) -> np.ndarray:
        """How many repeated phrases follow each other from each phrase on, in its text."""
        n = len(self.low)
        stop = (self.names[0] < 0) | np.isin(np.arange(n), np.searchsorted(self.start, self.base[:-1]))
        # the next phrase that isn't repeated, or that begins a text
        after = np.r_[np.where(stop, np.arange(n), n), n]
        after = np.minimum.accumulate(after[::-1])[::-1]
        return np.where(self.names[0] >= 0, after[1:] - np.arange(n), 0)

    def covers(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrases in which windows start, how many phrases hold all these windows)."""
        end = self.ends()
        own = np.flatnonzero(self.start[:-1] + self.length <= end)
        last = np.minimum(self.start[own + 1] - 1, end[own] - self.length)
        return own, np.searchsorted(self.start, last + self.length) - own

    def deepest(self) -> int:
        """The most phrases of a run that may be asked for: of repeated phrases, and within reach of a window."""
        reach = np.searchsorted(self.start, np.minimum(self.start[1:] - 1 + self.length, self.ends())) - np.arange(len(self.low))
        return int(np.minimum(reach, self.runs()).max(initial=0))

    def sort(self) -> None:
        """The suffix order by doubling, as deep as the longest run that may be asked for; common prefixes."""
        runs, depth = self.runs(), self.deepest()
        at = np.flatnonzero(self.names[0] >= 0)
        rank = np.zeros(len(self.low) + 1, np.int64)
        rank[at] = np.unique(self.names[0][at], return_inverse=True)[1] + 1
        levels, k = [rank], 1
        while k < depth:
            # beyond a run's end nothing follows
            second = np.where(runs[at] > k, rank[np.minimum(at + k, len(self.low))], 0)
            key = rank[at] * (len(at) + 2) + second
            rank = np.zeros(len(self.low) + 1, np.int64)
            rank[at] = np.unique(key, return_inverse=True)[1] + 1
            levels.append(rank)
            k *= 2
        self.order = at[np.argsort(rank[at], kind="stable")]
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(max(0, len(self.order) - 1), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(a + common, len(self.low)), np.minimum(b + common, len(self.low))
            same = (runs[a] - common >= 1 << j) & (runs[b] - common >= 1 << j) & (levels[j][x] == levels[j][y])
            common += np.where(same, 1 << j, 0)
        self.common = np.r_[np.zeros(min(1, len(self.order)), np.int64), common]

    def run_blocks(self, at: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the two overlapping runs that make up the run of m phrases from each place; -1 where one isn't repeated."""
        level = np.frexp(m)[1] - 1
        a, b = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        for j in np.unique(level).tolist():
            if j < len(self.names):
                own = np.flatnonzero(level == j)
                a[own], b[own] = self.names[j][at[own]], self.names[j][at[own] + m[own] - (1 << j)]
        return a, b

    def deeper(self) -> tuple[np.ndarray, ...] | None:
        """The next refinement: of each interval of the shard, (block, block k phrases on, whether it holds several, its place in the order); None if not needed."""
        k = 1 << len(self.names) - 1
        if self.deepest() < 2 * k:
            return None
        name, at = self.names[-1], self.order
        on = np.minimum(at + k, len(name) - 1)
        full = (self.runs()[at] >= 2 * k) & (name[at] >= 0) & (name[on] >= 0)
        head = np.flatnonzero((self.common < 2 * k) & full)
        interval = np.cumsum(self.common < 2 * k) - 1
        size = np.bincount(interval[full], minlength=int(interval[-1]) + 1 if len(interval) else 0)
        return (name[at[head]], name[on[head]], size[interval[head]] > 1, head) if len(head) else None

    def deepen(self, head: np.ndarray, found: np.ndarray) -> None:
        k = 1 << len(self.names) - 1
        of_head = np.full(len(self.order), -1, np.int64)
        of_head[head] = found
        starts = np.flatnonzero(self.common < 2 * k)
        name = np.full(len(self.low), -1, np.int64)
        if len(starts):
            name[self.order] = of_head[starts][np.cumsum(self.common < 2 * k) - 1]
        name[self.runs() < 2 * k] = -1
        self.names.append(name)

    def windows(self) -> tuple[np.ndarray, ...]:
        """Windows that hold a possibly repeated run, at edges or at witnesses: (start, first and last phrase start inside, its blocks, whether at an edge)."""
        k, w = sampling(self.length)
        anchors = np.flatnonzero(self.low >= 0)
        low = self.low[anchors]
        end = self.ends()[anchors]
        # windows choose the same start up to the next one's first, in the same text
        stop = np.minimum(np.r_[low[1:], self.start[-1]], end - self.length + 1)
        some = np.flatnonzero((self.names[0][anchors] >= 0) & (stop > low))
        sizes = (stop - low)[some]
        s = np.repeat(low[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(some) else np.zeros(0, np.int64)
        first = np.repeat(anchors[some], sizes)
        phrase = np.searchsorted(self.start, s, "right") - 1
        own = ~self.settled[phrase] | self.witness[phrase]
        s, first, open_ = s[own], first[own], ~self.settled[phrase[own]]
        last = anchors[np.searchsorted(low, s + self.length - w - k + 1, "right") - 1]
        a, b = self.run_blocks(first, last - first)
        found = (a >= 0) & (b >= 0)
        return s[found], first[found], last[found], a[found], b[found], open_[found]


def row(kind: str, shard: int, bucket: int, data: bytes) -> tuple:
    return kind, shard, bucket, data


def rows_of(found: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(ROWS)], schema=ROWS)


def trimmed(work):
    """work on a group of rows; memory goes back after each."""

    def done(rows: pa.Table) -> pa.Table:
        out = work(rows)
        trim()
        return out

    return done


def by_kind(rows: pa.Table) -> dict[str, list[tuple[int, bytes]]]:
    out: dict[str, list] = {}
    for kind, bucket, data in zip(rows.column("kind").to_pylist(), rows.column("bucket").to_pylist(), rows.column("data").to_pylist()):
        out.setdefault(kind, []).append((bucket, data))
    return out


def shares(a: np.ndarray, b: np.ndarray, m: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return dealt(spread(mixed(a.astype(np.uint64) + FACTOR * b.astype(np.uint64) + MIX * m.astype(np.uint64)), buckets), buckets)


def ask_numbers(shard: int, a: np.ndarray, b: np.ndarray, m: np.ndarray, more: np.ndarray, buckets: int) -> list[tuple]:
    """A row for each bucket, with its share of the keys (a, b, m) and what is told of each."""
    by, edges = shares(a, b, m, buckets)
    return [row("asks", shard, i, blob(a[by[x:y]], b[by[x:y]], m[by[x:y]], more[by[x:y]])) for i, (x, y) in enumerate(zip(edges, edges[1:])) if x < y]


def answered(a: np.ndarray, b: np.ndarray, m: np.ndarray, answers: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
    by, _ = shares(a, b, m, buckets)
    out = np.full(len(a), -1, np.int64)
    if len(by):
        out[by] = np.concatenate([unblob(data)[0] for _, data in sorted(answers)])
    return out


def distinct(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places by key, first places first; where a key is new among them)."""
    order = np.lexsort((np.arange(len(a)), m, b, a))
    x, y, z = a[order], b[order], m[order]
    return order, np.r_[np.ones(min(1, len(a)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]


def _merged(judge):
    """judge: of the keys' rows, sorted, what is told of them and where keys begin; gives the answer of each row."""

    def work(rows: pa.Table) -> pa.Table:
        parts = [unblob(x) for x in rows.column("data").to_pylist()]
        a, b, m, more = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order, new = distinct(a, b, m)
        bucket = rows.column("bucket")[0].as_py()
        found = np.empty(len(a), np.int64)
        found[order] = judge(more[order].astype(np.int64), new, bucket)
        edges = np.cumsum([0, *(len(p[0]) for p in parts)])
        return rows_of([row("answers", s, bucket, blob(found[x:y])) for s, x, y in zip(rows.column("shard").to_pylist(), edges, edges[1:])])

    return work


def numbered(several: np.ndarray, new: np.ndarray, bucket: int) -> np.ndarray:
    """The number of the key's block, if it has several suffixes; else -1."""
    many = np.add.reduceat(1 + several, np.flatnonzero(new)) > 1
    return np.where(many, (bucket << 40) + np.cumsum(many) - 1, -1)[np.cumsum(new) - 1]


def witnessed(several: np.ndarray, new: np.ndarray, bucket: int) -> np.ndarray:
    """-1 if there is one place, else 0; 1 for the key's first row."""
    many = np.add.reduceat(1 + several, np.flatnonzero(new)) > 1
    return np.where(many[np.cumsum(new) - 1], new.astype(np.int64), -1)


#: Of a run of phrases in a shard: it is inside a window at an edge; inside several of them, or inside a witness's window.
AT_EDGE, MORE = 1, 2


def asked_for(flags: np.ndarray, new: np.ndarray, bucket: int) -> np.ndarray:
    """0 if the run is inside a window at an edge and inside another; else -1."""
    first = np.flatnonzero(new)
    edge = np.maximum.reduceat(flags & AT_EDGE, first) > 0
    places = np.add.reduceat(1 + (flags & MORE), first)
    return np.where(edge & (places > 1), 0, -1)[np.cumsum(new) - 1]


def ask_bytes(shard: int, keys: dict[bytes, int], buckets: int) -> list[tuple]:
    """keys: how often each is in the shard."""
    dealt_out: dict[int, list[bytes]] = {}
    for key in keys:
        dealt_out.setdefault(zlib.crc32(key) % buckets, []).append(key)
    return [row("asks", shard, i, pickle.dumps((squeezed(b"".join(own)), blob(np.array([len(x) for x in own], "u4"), np.array([keys[x] > 1 for x in own]))))) for i, own in dealt_out.items()]


def answered_bytes(keys: dict[bytes, int], answers: list[tuple[int, bytes]], buckets: int) -> dict[bytes, int]:
    given = {bucket: iter(unblob(data)[0].tolist()) for bucket, data in answers}
    return {key: next(given[zlib.crc32(key) % buckets]) for key in keys}


def _merged_bytes(rows: pa.Table) -> pa.Table:
    """Numbers the keys that occur several times, -1 for others; keys are bytes, and compared as such."""
    lists, seen = [], {}
    for data in rows.column("data").to_pylist():
        joined, more = pickle.loads(data)
        text, (sizes, several) = expanded(joined), unblob(more)
        edges = np.r_[0, np.cumsum(sizes, dtype=np.int64)].tolist()
        own = [text[x:y] for x, y in zip(edges, edges[1:])]
        for key, n in zip(own, several.tolist()):
            seen[key] = seen.get(key, 0) + 1 + n
        lists.append(own)
    bucket = rows.column("bucket")[0].as_py()
    numbers = {key: (bucket << 40) + i for i, (key, n) in enumerate(seen.items()) if n > 1}
    return rows_of([row("answers", s, bucket, blob(np.array([numbers.get(k, -1) for k in own], np.int64))) for s, own in zip(rows.column("shard").to_pylist(), lists)])


def _parse(length: int, buckets: int):
    """Shards of documents: what is told of each, the long ones' texts, and the digests of phrases."""

    def sent(shard: int, ids: list, texts: list[bytes]):
        told = [ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts]]
        found = [row("docs", shard, -1, pickle.dumps(told))]
        docs = np.array([i for i, t in enumerate(texts) if len(t) >= length], np.int64)
        if len(docs):
            text = b"".join(texts[i] for i in docs)
            base = np.r_[0, np.cumsum([len(texts[i]) for i in docs])].astype(np.int64)
            data = np.frombuffer(text, np.uint8)
            start, low = parsed(data, base, length)
            found.append(row("text", shard, -1, squeezed(text)))
            none = np.zeros(0, np.int64)
            found.append(row("state", shard, -1, Shard(length, docs, base, start, low, [], none, none, none, none).pack()))
            digest, n = np.unique(digests(data, start), return_counts=True)
            zero = np.zeros(len(digest), np.int64)
            found += ask_numbers(shard, digest.view(np.int64), zero, zero, n > 1, buckets)
        yield from rows_of(found).to_batches()

    def work(batches):
        base, n_shards, ids, texts, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0, [], [], 0
        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(name)
                texts.append((text or "").encode())
                size += len(texts[-1]) + 64
                if size >= SHARD:
                    yield from sent(base | n_shards, ids, texts)
                    n_shards, ids, texts, size = n_shards + 1, [], [], 0
        if ids:
            yield from sent(base | n_shards, ids, texts)
        trim()

    return work


def phrases_of(text: bytes, start: np.ndarray, which: np.ndarray) -> list[bytes]:
    return [text[x:y] for x, y in zip(start[which].tolist(), start[which + 1].tolist())]


def counts_of(keys: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for key in keys:
        out[key] = out.get(key, 0) + 1
    return out


def _phrases(buckets: int):
    """After the digests: texts that can hold a repeat go on; their phrases whose digest repeats are sent."""

    def work(rows: pa.Table) -> pa.Table:
        got, shard = by_kind(rows), rows.column("shard")[0].as_py()
        state, text = Shard.unpack(got["state"][0][1]), expanded(got["text"][0][1])
        data = np.frombuffer(text, np.uint8)
        digest, at = np.unique(digests(data, state.start), return_inverse=True)
        zero = np.zeros(len(digest), np.int64)
        state.names = [answered(digest.view(np.int64), zero, zero, got["answers"], buckets)[at]]
        # A repeat holds a run of phrases that is at most two windows and a k-mer shorter.
        k, w = sampling(state.length)
        runs = state.runs()
        held = state.start[np.arange(len(runs)) + runs] - state.start[:-1]
        text_of = np.searchsorted(state.base, state.start[:-1], "right") - 1
        keep = np.zeros(len(state.docs), bool)
        keep[text_of[held >= state.length - 2 * w - k]] = True
        if not keep.any():
            return ROWS.empty_table()
        sizes = np.diff(state.base)[keep]
        shift = np.r_[0, np.cumsum(sizes)]
        moved = np.zeros(len(keep), np.int64)
        moved[keep] = shift[:-1] - state.base[:-1][keep]
        own = keep[text_of]
        low = state.low[own]
        low = np.where(low >= 0, low + moved[text_of[own]], -1)
        text = b"".join(text[state.base[i] : state.base[i + 1]] for i in np.flatnonzero(keep))
        none = np.zeros(0, np.int64)
        new = Shard(state.length, state.docs[keep], shift, np.r_[state.start[:-1][own] + moved[text_of[own]], shift[-1]], low, [state.names[0][own]], none, none, none, none)
        sent = phrases_of(text, new.start, np.flatnonzero(new.names[0] >= 0))
        return rows_of([row("state", shard, -1, new.pack()), row("text", shard, -1, squeezed(text)), *ask_bytes(shard, counts_of(sent), buckets)])

    return work


def _sorted(buckets: int):
    """After the phrases: they are numbered; the shard's suffixes are sorted, and its first intervals sent."""

    def work(rows: pa.Table) -> pa.Table:
        got, shard = by_kind(rows), rows.column("shard")[0].as_py()
        state, text = Shard.unpack(got["state"][0][1]), expanded(got["text"][0][1])
        which = np.flatnonzero(state.names[0] >= 0)
        sent = phrases_of(text, state.start, which)
        numbers = answered_bytes(counts_of(sent), got["answers"], buckets)
        state.names[0][which] = np.fromiter(map(numbers.__getitem__, sent), np.int64, len(sent))
        state.sort()
        return refined(shard, state, buckets)

    return work


def refined(shard: int, state: Shard, buckets: int) -> pa.Table:
    found = [row("state", shard, -1, state.pack())]
    if (more := state.deeper()) is not None:
        a, b, several, _ = more
        found += ask_numbers(shard, a, b, np.zeros(len(a), np.int64), several, buckets)
    return rows_of(found)


def _refine(buckets: int):
    """One pass of the merge: blocks of twice the depth."""

    def work(rows: pa.Table) -> pa.Table:
        got, shard = by_kind(rows), rows.column("shard")[0].as_py()
        state = Shard.unpack(got["state"][0][1])
        if "answers" in got:
            a, b, _, head = state.deeper()
            state.deepen(head, answered(a, b, np.zeros(len(a), np.int64), got["answers"], buckets))
            return refined(shard, state, buckets)
        return rows_of([row("state", shard, -1, got["state"][0][1])])

    return work


def covering(state: Shard) -> tuple[np.ndarray, ...]:
    """(phrases whose windows' cover may be repeated; distinct covers as (blocks, length in phrases); which each phrase has; the first phrase of each)."""
    own, m = state.covers()
    a, b = state.run_blocks(own, m)
    some = (a >= 0) & (b >= 0)
    own, m, a, b = own[some], m[some], a[some], b[some]
    order, new = distinct(a, b, m)
    at = np.empty(len(own), np.int64)
    at[order] = np.cumsum(new) - 1
    first = order[new]
    return own, a[first], b[first], m[first], at, own[first]


def _covers(buckets: int):
    """After the merge: covers of all windows that start in a phrase are sent."""

    def work(rows: pa.Table) -> pa.Table:
        got, shard = by_kind(rows), rows.column("shard")[0].as_py()
        _, a, b, m, at, _ = covering(Shard.unpack(got["state"][0][1]))
        return rows_of([row("state", shard, -1, got["state"][0][1]), *ask_numbers(shard, a, b, m, np.bincount(at, minlength=len(a)) > 1, buckets)])

    return work


def inner_runs(state: Shard) -> tuple[np.ndarray, ...]:
    """(windows as in Shard.windows(); distinct runs inside them as (blocks, length), which each window has, and flags)."""
    found = s, first, last, a, b, open_ = state.windows()
    if not len(s):
        return found, a, b, a, a, a
    # windows of the same place side by side
    heads = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])])
    place = np.cumsum(np.r_[False, (first[1:] != first[:-1]) | (last[1:] != last[:-1])])
    edge, settled = np.logical_or.reduceat(open_, heads), np.logical_or.reduceat(~open_, heads)
    a, b, m = a[heads], b[heads], (last - first)[heads]
    order, new = distinct(a, b, m)
    starts = np.flatnonzero(new)
    flags = np.where(np.logical_or.reduceat(edge[order], starts), AT_EDGE, 0)
    more = np.logical_or.reduceat(settled[order], starts) | (np.diff(np.r_[starts, len(order)]) > 1)
    at = np.empty(len(heads), np.int64)
    at[order] = np.cumsum(new) - 1
    own = order[new]
    return found, a[own], b[own], m[own], at[place], flags | np.where(more, MORE, 0)


def _edges(buckets: int):
    """After the covers: the runs inside windows at edges and at witnesses are sent."""

    def work(rows: pa.Table) -> pa.Table:
        got, shard = by_kind(rows), rows.column("shard")[0].as_py()
        state = Shard.unpack(got["state"][0][1])
        own, a, b, m, at, first = covering(state)
        state.settled, state.witness = np.zeros(len(state.low), bool), np.zeros(len(state.low), bool)
        found = answered(a, b, m, got.get("answers", []), buckets)
        state.settled[own] = found[at] >= 0
        state.witness[first[found == 1]] = True
        _, a, b, m, _, flags = inner_runs(state)
        return rows_of([row("state", shard, -1, state.pack()), *ask_numbers(shard, a, b, m, flags, buckets)])

    return work


def window_keys(state: Shard, text: bytes, windows: list[np.ndarray]) -> list[bytes]:
    """Of windows as in Shard.windows(): the run of phrases inside, and the bytes beside it."""
    s, first, last, a, b, *_ = windows
    inner = np.stack([a, b, last - first, state.start[first] - s], axis=1).astype("<i8").tobytes() if len(s) else b""
    sides = zip(s.tolist(), state.start[first].tolist(), state.start[last].tolist())
    return [inner[32 * i : 32 * i + 32] + text[x:y] + text[z : x + state.length] for i, (x, y, z) in enumerate(sides)]


def asked_windows(state: Shard, runs: list[tuple[int, bytes]], buckets: int) -> list[np.ndarray]:
    """The windows whose inner run is asked for, by the answers to inner_runs()."""
    windows, a, b, m, at, _ = inner_runs(state)
    own = answered(a, b, m, runs, buckets)[at] >= 0 if len(a) else np.zeros(0, bool)
    return [x[own] for x in windows]


def sums_of(data: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the bytes' numbers times the base's powers, inverse powers): the hash of any stretch is a difference times an inverse."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), x, np.uint64))]) for x in (base, inverse))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * up[:-1], dtype=np.uint64)]), down


def hashed_windows(state: Shard, text: bytes, windows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of windows as in Shard.windows(): distinct 128-bit hashes of what window_keys() gives (two columns), which each window has, and flags as of runs."""
    s, first, last, a, b, open_ = windows
    if not len(s):
        return a, a, a, a
    data, x, z, e = np.frombuffer(text, np.uint8), state.start[first], state.start[last], s + state.length
    inner = mixed(mixed(a.astype(np.uint64)) * FACTOR + mixed(b.astype(np.uint64) + MIX) + ((last - first) << 32 | (x - s)).astype(np.uint64))
    both = []
    for base in (FACTOR, MIX):
        sums, down = sums_of(data, base)
        both.append(mixed(mixed((sums[x] - sums[s]) * down[s]) * base + mixed((sums[e] - sums[z]) * down[z]) + inner).view(np.int64))
    order, new = distinct(both[0], both[1], np.zeros(len(s), np.int64))
    starts = np.flatnonzero(new)
    edge, settled = np.logical_or.reduceat(open_[order], starts), np.logical_or.reduceat(~open_[order], starts)
    flags = np.where(edge, AT_EDGE, 0) | np.where(settled | (np.diff(np.r_[starts, len(order)]) > 1), MORE, 0)
    at = np.empty(len(s), np.int64)
    at[order] = np.cumsum(new) - 1
    return both[0][order[new]], both[1][order[new]], at, flags


def window_counts(open_: np.ndarray, keys: list[bytes]) -> dict[bytes, int]:
    """How often each is there; a witness's window is repeated as it is."""
    out: dict[bytes, int] = {}
    for key, edge in zip(keys, open_.tolist()):
        out[key] = out.get(key, 0) + (1 if edge else 2)
    return out


def _windows(buckets: int):
    """After the runs inside: windows whose run is asked for are sent, by hash."""

    def work(rows: pa.Table) -> pa.Table:
        got, shard = by_kind(rows), rows.column("shard")[0].as_py()
        state, text = Shard.unpack(got["state"][0][1]), expanded(got["text"][0][1])
        windows = asked_windows(state, got.get("answers", []), buckets)
        g, h, _, flags = hashed_windows(state, text, windows)
        return rows_of([row("state", shard, -1, got["state"][0][1]), row("windows", shard, -1, blob(*windows)), *ask_numbers(shard, g, h, np.zeros(len(g), np.int64), flags, buckets)])

    return work


def _same_windows(buckets: int):
    """After the hashes: windows whose hash stands at an edge and again are sent as they are, the run inside and the bytes beside it."""

    def work(rows: pa.Table) -> pa.Table:
        got, shard = by_kind(rows), rows.column("shard")[0].as_py()
        state, text = Shard.unpack(got["state"][0][1]), expanded(got["text"][0][1])
        windows = unblob(got["windows"][0][1])
        g, h, at, _ = hashed_windows(state, text, windows)
        again = answered(g, h, np.zeros(len(g), np.int64), got.get("answers", []), buckets)[at] >= 0 if len(g) else np.zeros(0, bool)
        windows = [x[again] for x in windows]
        return rows_of([row("state", shard, -1, got["state"][0][1]), row("windows", shard, -1, blob(*windows)), *ask_bytes(shard, window_counts(windows[-1], window_keys(state, text, windows)), buckets)])

    return work


#: Characters of scripts that are written without spaces: Thai to Myanmar, Khmer, East Asian symbols to ideographs, and their compatibility forms.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def n_words(run: bytes) -> int:
    """Words parted by white space; in scripts that are written without spaces, each character is one."""
    spaced = len(run.split())
    return spaced if run.isascii() else spaced + len(UNSPACED.findall(run.decode("utf-8", "ignore")))


def _removed(length: int, min_words: int, with_text: bool, buckets: int):
    """Each document with what goes from it."""

    def work(rows: pa.Table) -> pa.Table:
        got = by_kind(rows)
        ids, sizes, shas = pickle.loads(got["docs"][0][1])
        n_removed, n_spans, kept, texts = [0] * len(ids), [0] * len(ids), list(shas), [None] * len(ids)
        if "state" in got:
            state, text = Shard.unpack(got["state"][0][1]), expanded(got["text"][0][1])
            data = np.frombuffer(text, np.uint8)
            windows = unblob(got["windows"][0][1])
            keys = window_keys(state, text, windows)
            numbers = answered_bytes(window_counts(windows[-1], keys), got.get("answers", []), buckets)
            s = windows[0][np.fromiter((numbers[k] >= 0 for k in keys), bool, len(keys))]
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, s, 1)
            np.add.at(mark, s + length, -1)
            whole = np.flatnonzero(state.settled)
            np.add.at(mark, state.start[whole], 1)
            np.add.at(mark, np.minimum(state.start[whole + 1] - 1, state.ends()[whole] - length) + length, -1)
            gone = np.cumsum(mark[:-1]) > 0
            # runs end with their text
            starts = np.zeros(len(data), bool)
            starts[state.base[:-1]] = True
            x = np.flatnonzero(gone & (starts | ~np.r_[False, gone[:-1]]))
            y = np.flatnonzero(gone & np.r_[starts[1:] | ~gone[1:], True]) + 1
            if min_words:
                enough = np.fromiter((n_words(text[a:b]) >= min_words for a, b in zip(x.tolist(), y.tolist())), bool, len(x))
                x, y = x[enough], y[enough]
            text_of = np.searchsorted(state.base, x, "right") - 1
            for i in np.unique(text_of).tolist():
                spans = [(a, b) for a, b in zip(x[text_of == i].tolist(), y[text_of == i].tolist())]
                edges = [int(state.base[i]), *(e for span in spans for e in span), int(state.base[i + 1])]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                doc = int(state.docs[i])
                n_removed[doc], n_spans[doc], kept[doc] = sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest()
                texts[doc] = left.decode("utf-8", "ignore") if with_text else None
        columns = (ids, sizes, n_removed, n_spans, kept, shas, texts)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    return work


FOUND = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("sha", pa.string()), ("kept_text", pa.string())])
FOUND_SQL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, sha string, kept_text string"


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, min_words: int = 0, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; with_text also sha (of the whole text) and kept_text.

    A byte goes if a string of `length` bytes (8 at least) that covers it also starts elsewhere, in the same document or
    another; with min_words, only runs of such bytes that hold so many words (n_words) go. Null counts as empty; texts under
    `length` bytes stay whole. Rows of equal or null ids are documents each. kept_text is null where nothing was
    removed; bytes of characters that were cut in two are left out of it. Other columns aren't read.
    """
    if length < 8:
        raise ValueError("length must be 8 at least")
    buckets = buckets_for(docs, text_col, BUCKET)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def of(rows: DataFrame, *kinds: str) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds)).select("kind", "shard", "bucket", "data")

    def merged(rows: DataFrame, merge) -> DataFrame:
        out = cut(of(rows, "asks").groupBy("bucket").applyInArrow(trimmed(merge), ROWS_SQL), "answers")
        drop(rows, kinds=("asks",))
        return out

    def step(work, *inputs: DataFrame) -> DataFrame:
        every = inputs[0]
        for more in inputs[1:]:
            every = every.unionByName(more)
        return cut(every.groupBy("shard").applyInArrow(trimmed(work(buckets)), ROWS_SQL), "shards", by="kind")

    with arrow_rows(docs.sparkSession, TEXTS):
        first = cut(texts.mapInArrow(_parse(length, buckets), ROWS_SQL), "shards", by="kind")
    told = cut(of(first, "docs"), "docs")
    answers = merged(first, _merged(numbered))
    second = step(_phrases, of(first, "state", "text"), answers)
    drop(first, answers)
    held = cut(of(second, "text"), "texts")
    answers = merged(second, _merged_bytes)
    rows = step(_sorted, of(second, "state", "text"), answers)
    drop(second, answers)

    def next_step(work, merge, *more: DataFrame) -> DataFrame:
        answers = merged(rows, merge)
        out = step(work, rows.where("kind in ('state', 'windows')").select("kind", "shard", "bucket", "data"), answers, *more)
        drop(rows, answers)
        return out

    while not of(rows, "asks").isEmpty():
        rows = next_step(_refine, _merged(numbered))
    before, rows = rows, step(_covers, of(rows, "state"))
    drop(before)
    rows = next_step(_edges, _merged(witnessed))
    rows = next_step(_windows, _merged(asked_for), held)
    rows = next_step(_same_windows, _merged(asked_for), held)
    answers = merged(rows, _merged_bytes)
    every = told.unionByName(held).unionByName(of(rows, "state", "windows")).unionByName(answers)
    found = every.groupBy("shard").applyInArrow(trimmed(_removed(length, min_words, with_text, buckets)), FOUND_SQL)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["sha", "kept_text"] if with_text else []))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", length: int = LENGTH, min_words: int = 0) -> DataFrame:
    """docs with its columns and rows, repeated passages removed from the text and length_col (if there) set to what is left.

    As in repeats(). Rows of the same id and text lose the same passages.
    """
    gone = repeats(docs, id_col, text_col, length, min_words, with_text=True).where("n_removed > 0").select(F.col(id_col).alias("__id"), F.col("sha").alias("__sha"), F.col("kept_text").alias("__left")).dropDuplicates(["__id", "__sha"])
    out = docs.join(gone.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.sha2(text_col, 256) == F.col("__sha")), "left")
    text = F.coalesce("__left", text_col)
    columns = [text.alias(c) if c == text_col else F.when(F.col("__left").isNotNull(), F.length("__left")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return out.select(columns)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
