"""Greedy packing of pages and tables of any length: stretches of a page are packed side by side, then joined.

Where a chunk begins depends on all items before it, but a stretch's share of that is small: whatever item a chunk begins at, the
next beginnings follow from the stretch alone, until a chunk is still open at its end. The sums of such open chunks are few, as
no more than the budget holds fits into one. So each stretch says which open chunks it may leave; sums over whole stretches say
in which later stretch each of them ends; that stretch says where, and what it leaves open in turn; and following the page's
first chunk through these answers, one step a stretch, gives every stretch its first beginning and how many came before."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Items of a stretch, which one task holds at a time.
STRETCH = 1 << 14
#: An open chunk that nothing more fits into: before a page's first item, and behind an item that is too large.
CLOSED = 1 << 60


class Stretch:
    """Consecutive items: for each, where the chunk after one that begins there begins, n if that lies beyond the stretch."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["g"].to_numpy(), kind="stable")
        chars, tokens, opens = (rows[c].to_numpy()[order] for c in ("chars", "tokens", "opens"))
        self.order, self.n = order, len(order)
        self.room, self.limit = rows["room"][0].as_py(), rows["token_room"][0].as_py()
        self.large = (chars > self.room) | (tokens > self.limit)
        self.forced = opens.astype(bool) | self.large
        self.forced[1:] |= self.large[:-1]
        self.chars, self.tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (chars, tokens))
        fits = np.minimum(np.searchsorted(self.chars, self.chars[:-1] + self.room, "right"), np.searchsorted(self.tokens, self.tokens[:-1] + self.limit, "right")) - 1
        at = np.where(self.forced, np.arange(self.n), self.n)
        later = np.append(np.minimum.accumulate(at[::-1])[::-1][1:], self.n)
        self.next = np.minimum(np.maximum(fits, np.arange(self.n) + 1), later)

    def left(self, start: int) -> tuple[int, int]:
        """The open chunk at the end, of one that begins at `start` and has no end here."""
        if self.large[start]:
            return CLOSED, CLOSED
        return int(self.chars[-1] - self.chars[start]), int(self.tokens[-1] - self.tokens[start])

    def first(self, chars: int, tokens: int) -> int:
        """Where the chunk after an open one begins; n if that one goes on beyond the stretch."""
        fits = min(np.searchsorted(self.chars, self.room - chars, "right"), np.searchsorted(self.tokens, self.limit - tokens, "right")) - 1
        forced = int(self.forced.argmax()) if self.forced.any() else self.n
        return max(0, min(int(fits), forced))


def _open(rows: pa.Table) -> pa.Table:
    """A stretch's sums, and the open chunks that it may leave (distinct sums)."""
    s = Stretch(rows)
    some = {s.left(int(i)) for i in np.flatnonzero(s.next == s.n)}
    chars, tokens = zip(*sorted(some), strict=True)
    n = len(some)
    whole = {"all_chars": int(s.chars[-1]), "all_tokens": int(s.tokens[-1]), "forced": bool(s.forced.any()), "room": s.room, "token_room": s.limit}
    same = {k: [v] * n for k, v in ({"name": rows["name"][0].as_py(), "block": rows["block"][0].as_py()} | whole).items()}
    return pa.table(same | {"chars": list(chars), "tokens": list(tokens)}).select(OPEN_COLUMNS).cast(OPEN_ARROW)


OPEN_COLUMNS = ["name", "block", "all_chars", "all_tokens", "forced", "room", "token_room", "chars", "tokens"]
OPEN = "name string, block long, all_chars long, all_tokens long, forced boolean, room long, token_room long, chars long, tokens long"
OPEN_ARROW = pa.schema([("name", pa.string()), *((c, pa.bool_() if c == "forced" else pa.int64()) for c in OPEN_COLUMNS[1:])])
#: Open chunks as they reach the stretch that ends them, with the sums they have by then; `source` is the stretch that left them (-1: before the page).
REACH = "name string, block long, source long, chars long, tokens long, here_chars long, here_tokens long"
#: What follows: how many chunks begin in that stretch, and the open one that it leaves.
STEP = f"{REACH}, begins long, left_chars long, left_tokens long"
#: The open chunk that does come to a stretch, and the number of chunks that begin before and up to its end.
MET = "name string, block long, here_chars long, here_tokens long, before long, after long"


def _arrow(schema: str, columns: list[list]) -> pa.Table:
    kinds = [tuple(f.split()) for f in schema.split(", ")]
    return pa.table([pa.array(x, pa.string() if k == "string" else pa.int64()) for (_, k), x in zip(kinds, columns, strict=True)], names=[c for c, _ in kinds])


def _reach(rows: pa.Table) -> pa.Table:
    """For a page's open chunks, the first later stretch that they don't hold as a whole."""
    block = rows["block"].to_numpy()
    blocks, at = np.unique(block, return_index=True)
    place = np.searchsorted(blocks, block)
    room, limit = rows["room"][0].as_py(), rows["token_room"][0].as_py()
    chars, tokens = rows["chars"].to_numpy(), rows["tokens"].to_numpy()
    sums = {c: np.concatenate([[0], np.cumsum(rows[c].to_numpy()[at])]) for c in ("all_chars", "all_tokens")}
    forced = np.where(rows["forced"].to_numpy(zero_copy_only=False)[at], np.arange(len(blocks)), len(blocks))
    forced = np.append(np.minimum.accumulate(forced[::-1])[::-1], len(blocks))
    # sums[k + 1] - sums[place + 1] is what the stretches after the source, up to the k-th, hold
    hold = [np.searchsorted(sums[c], sums[c][place + 1] + most - used, "right") - 1 for c, most, used in (("all_chars", room, chars), ("all_tokens", limit, tokens))]
    to = np.maximum(place + 1, np.minimum(np.minimum(*hold), forced[place + 1]))
    on = np.flatnonzero(to < len(blocks))
    k = to[on]
    here = [used[on] + sums[c][k] - sums[c][place[on] + 1] for c, used in (("all_chars", chars), ("all_tokens", tokens))]
    columns = [[blocks[0], *blocks[k]], [-1, *block[on]], [CLOSED, *chars[on]], [CLOSED, *tokens[on]], [CLOSED, *here[0]], [CLOSED, *here[1]]]
    return _arrow(REACH, [[rows["name"][0].as_py()] * (len(on) + 1), *([int(x) for x in c] for c in columns)])


def _steps(rows: pa.Table, reached: pa.Table) -> pa.Table:
    """For each open chunk that reaches a stretch, how many chunks begin in it and what it leaves open in turn."""
    out = []
    if reached.num_rows:
        s = Stretch(rows)
        begins, last = [1] * s.n, list(range(s.n))
        for i in range(s.n - 1, -1, -1):
            if (j := int(s.next[i])) < s.n:
                begins[i], last[i] = begins[j] + 1, last[j]
        for r in reached.to_pylist():
            i = s.first(r["here_chars"], r["here_tokens"])
            out.append((*r.values(), begins[i], *s.left(last[i])))
    return _arrow(STEP, list(zip(*out, strict=True)) if out else [[]] * 10)


def _met(rows: pa.Table) -> pa.Table:
    """Follows a page's chunks from stretch to stretch; those without a beginning are passed over."""
    steps = {(r["source"], r["chars"], r["tokens"]): r for r in rows.to_pylist()}
    out, at, before = [], (-1, CLOSED, CLOSED), 0
    while r := steps.get(at):
        out.append((r["name"], r["block"], r["here_chars"], r["here_tokens"], before, before + r["begins"]))
        before += r["begins"]
        at = (r["block"], r["left_chars"], r["left_tokens"])
    return _arrow(MET, list(zip(*out, strict=True)))


def _chunks(rows: pa.Table, met: pa.Table) -> pa.Table:
    """Each item's chunk."""
    s, r = Stretch(rows), met.to_pylist()[0]
    begins, chunk = np.zeros(s.n, dtype=np.int64), np.empty(s.n, dtype=np.int64)
    i = s.n if r["here_chars"] is None else s.first(r["here_chars"], r["here_tokens"])
    while i < s.n:
        begins[i] = 1
        i = int(s.next[i])
    chunk[s.order] = r["before"] - 1 + np.cumsum(begins)
    return rows.select(["document_id", "page", "item"]).append_column("chunk", pa.array(chunk))


def packed(units: DataFrame, max_chars: int, max_tokens: int | None = None, *, path: str, stretch: int = STRETCH) -> DataFrame:
    """As chunking.packed, of which it takes the columns and gives the rows; room and token_room are the same for all items of a page.

    The items are written once to `path`, a folder that driver and executors share, in their order. Null sizes count as 0; items of the
    same place are taken by size; without items there are no rows."""
    given = lambda name, otherwise: (F.col(name) if name in units.columns else F.lit(otherwise)).alias(name)
    size = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(name)
    sized = units.select("document_id", "page", "item", size("chars"), size("tokens"), given("room", max_chars).cast("long").alias("room"), given("token_room", max_tokens if max_tokens is not None else 1 << 40).cast("long").alias("token_room"), given("opens", False))
    place = ["document_id", "page", "item"]
    # Ranges in order and a number that rises inside and across them: a stretch is a run of it.
    order = sized.repartitionByRange(*place).sortWithinPartitions(*place, "chars", "tokens", "opens").withColumn("g", F.monotonically_increasing_id())
    # A page's name as text, in which nulls are told apart from all else. No flag: no chunk is asked to begin.
    named = order.withColumns({"opens": F.coalesce("opens", F.lit(False)), "name": F.to_json(F.struct("document_id", "page")), "block": F.expr(f"g div {stretch}")})
    at = f"{path.rstrip('/')}/stretches-{uuid.uuid4().hex}"
    named.write.parquet(at)
    rows = lambda: units.sparkSession.read.schema(named.schema).parquet(at)
    sizes = lambda: rows().select("name", "block", "g", "chars", "tokens", "room", "token_room", "opens")

    key = ["name", "block"]
    left = sizes().groupBy(*key).applyInArrow(_open, OPEN)
    reach = left.groupBy("name").applyInArrow(_reach, REACH)
    steps = sizes().groupBy(*key).cogroup(reach.groupBy(*key)).applyInArrow(_steps, STEP)
    met = steps.groupBy("name").applyInArrow(_met, MET)
    # A stretch inside a chunk goes on with the number of the last one before it.
    so_far = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows().select(*key).distinct().join(met, key, "left").select(*key, "here_chars", "here_tokens", F.coalesce("before", F.last("after", ignorenulls=True).over(so_far)).alias("before"))
    kinds = {f.name: f.dataType for f in units.schema}
    out = StructType([StructField(c, kinds[c]) for c in place] + [StructField("chunk", LongType())])
    return rows().groupBy(*key).cogroup(stretches.groupBy(*key)).applyInArrow(_chunks, out)
