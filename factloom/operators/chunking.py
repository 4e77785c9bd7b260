"""Chunks of evidence: rendering, greedy packing under two budgets, ordinals, selection and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import digits, estimate_tokens

from .evidence import header_line

MAX_CHARS, MOST_DIGITS, CHUNK_LIMIT = 2500, 50, 60
#: Units of a page, and characters of theirs, that one row may hold; with more, pages are packed by stretches.
FOLD_UP_TO, FOLD_CHARS = 50_000, 1 << 24


def rendered(unit_id: Column, kind: Column, text: Column, table: Column, row: Column, col: Column, row_header: Column, column_header: Column) -> Column:
    """A unit as a prompt shows it; cells say where they stand, '?' for what is missing."""
    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("?"))

    cell = F.concat(F.lit(" [table "), shown(table), F.lit(", row "), shown(row), F.lit(", col "), shown(col), F.lit(", row header "), shown(row_header), F.lit(", column header "), shown(column_header), F.lit("]"))
    return F.concat(F.lit("["), unit_id, F.lit("] ("), kind, F.lit(")"), F.when(kind == "TABLE_CELL", cell).otherwise(""), F.lit(" "), text)


def breaks(items: Column) -> Column:
    """Where chunks begin in an array of sized items (structs with chars, tokens, room, limit and opens), in order."""
    long = lambda c: c.cast("long")
    start = F.struct(long(F.lit(0)).alias("i"), long(F.lit(0)).alias("chars"), long(F.lit(0)).alias("tokens"), F.lit(False).alias("some"), F.array().cast("array<bigint>").alias("breaks"))

    def place(acc: Column, x: Column) -> Column:
        large = (x["chars"] > x["room"]) | (x["tokens"] > x["limit"])
        # an item that follows a large one, or the first one, finds nothing open
        opens = ~acc["some"] | x["opens"] | (acc["chars"] + x["chars"] > x["room"]) | (acc["tokens"] + x["tokens"] > x["limit"])
        chars, tokens = (F.when(opens, long(F.lit(0))).otherwise(acc[n]) + x[n] for n in ("chars", "tokens"))
        return F.struct((acc["i"] + 1).alias("i"), chars.alias("chars"), tokens.alias("tokens"), (~large).alias("some"), F.when(opens, F.concat(acc["breaks"], F.array(acc["i"]))).otherwise(acc["breaks"]).alias("breaks"))

    return F.aggregate(items, start, place, lambda acc: acc["breaks"])


def _slices(df: DataFrame, arrays: list[str], number: str, others: list[str]) -> DataFrame:
    """A row for each of `breaks`, with what the arrays hold from there to the next. Only where chunks begin is collected; each is then a slice."""
    # Not one of the arrays that are exploded here is empty. The outer forms don't filter for that, which would compute an array once more.
    each = df.select(*others, *arrays, "breaks", F.posexplode_outer("breaks").alias(number, "begin"))
    end = F.coalesce(F.get("breaks", F.col(number) + 1), F.size(arrays[0]).cast("long"))
    return each.select(*others, F.col(number).cast("long").alias(number), *(F.slice(a, (F.col("begin") + 1).cast("int"), (end - F.col("begin")).cast("int")).alias(a) for a in arrays))


def packed(units: DataFrame, max_chars: int = MAX_CHARS, max_tokens: int | None = None) -> DataFrame:
    """units: document_id, page, item (place on the page), chars, tokens, and maybe room and token_room (instead of max_chars and max_tokens) and opens (a new chunk begins here). Adds chunk, from 0 on each page.

    Items are taken in order; one that would overflow starts a new chunk, and one that is too large by itself stands
    alone. The running sum starts anew with each chunk, so this is a fold over a page's items, for pages that fit into a row
    (stretches.packed takes pages of any length). Null sizes count as 0."""
    given = lambda name, otherwise: (F.col(name) if name in units.columns else F.lit(otherwise)).alias(name)
    room, limit = given("room", max_chars).cast("long").alias("room"), given("token_room", max_tokens if max_tokens is not None else 1 << 40).cast("long").alias("limit")
    items = F.array_sort(F.collect_list(F.struct("item", F.coalesce(F.col("chars").cast("long"), F.lit(0).cast("long")).alias("chars"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"), room, limit, given("opens", False))))
    pages = units.groupBy("document_id", "page").agg(items.alias("items"))
    done = pages.withColumn("breaks", breaks(F.col("items")))
    each = _slices(done, ["items"], "chunk", ["document_id", "page"]).select("document_id", "page", "chunk", F.explode_outer("items").alias("x"))
    return each.select("document_id", "page", F.col("x.item").alias("item"), "chunk")


def table_rows(cells: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """cells: table_id, header (its line of text), row, col, text. (table_id, row, part): a large table split between rows only.

    A part costs its header line, each row's line and each cell's text; the header comes again in every part, so rows have
    the room that it leaves."""
    rows = cells.groupBy("table_id", "row").agg((2 * F.sum(F.length("text")) + 3 * (F.count("*") - 1) + 1).alias("chars"), F.max(F.length("header")).alias("h"))
    placed = packed(rows.select(F.col("table_id").alias("document_id"), F.lit(0).alias("page"), F.col("row").alias("item"), "chars", F.lit(0).alias("tokens"), (max_chars - F.col("h")).alias("room")))
    return placed.select(F.col("document_id").alias("table_id"), F.col("item").alias("row"), F.col("chunk").alias("part"))


def items(units: DataFrame) -> DataFrame:
    """units: document_id, page, seq, evidence_id, type, text, table_index. What packing places: item, chars, tokens, members (evidence ids).

    A page's first table of an index takes that index's cells along; cells without a table, and all other units, stand for
    themselves. Pictures without text are left out."""
    kept = units.where(~((F.col("type") == "IMAGE") & (F.trim("text") == "")))
    first = kept.where("type = 'TABLE'").groupBy("document_id", "page", "table_index").agg(F.min("seq").alias("table_seq"))
    keyed = kept.join(first, (kept["document_id"] == first["document_id"]) & (kept["page"] == first["page"]) & kept["table_index"].eqNullSafe(first["table_index"]) & (F.col("type") == "TABLE_CELL"), "left").select(kept["*"], "table_seq")
    item = F.coalesce("table_seq", "seq")
    lead = F.struct((F.col("type") != "TABLE").alias("rest"), "seq", "evidence_id")
    return keyed.withColumn("item", item).groupBy("document_id", "page", "item").agg(F.sum(F.length("text")).alias("chars"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"), F.transform(F.array_sort(F.collect_list(lead)), lambda x: x["evidence_id"]).alias("members"))


def projected(units: DataFrame) -> DataFrame:
    """Units as a chunk shows them: a TABLE as its header line above its grid, a cell with its place and headers, others as they are.

    units: evidence_id, type, text, table_index, headers (array), row, col, row_header, column_header."""
    table, cell = F.col("type") == "TABLE", F.col("type") == "TABLE_CELL"
    head = header_line(F.col("table_index"), F.col("headers"))
    shown = F.when(table, F.when(F.coalesce(F.col("text"), F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n"), "text"))).otherwise(F.col("text"))
    only = {c: F.when(cell, F.col(c)).alias(c) for c in ("row", "col", "row_header", "column_header")}
    return units.select("evidence_id", "type", shown.alias("text"), F.when(table | cell, F.col("table_index")).alias("table_index"), *only.values())


#: Where a unit stands in its chunk: its item on the page, the part of a split table, the table before its cells.
KEY = ["document_id", "page", "item_seq"]
#: Tasks that a table's cells are dealt to.
DEALT = 16


def dealt(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """many, with the columns of the one row of `few` that has the same keys, if any; a table's cells are dealt to several tasks, so that none meets all of them."""
    others = [c for c in few.columns if c not in keys]
    copies = few.select(*(F.col(k).alias(f"{k}_of") for k in keys), *others, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("hand"))
    held = many.withColumn("dealt_to", F.pmod(F.xxhash64("seq", "evidence_id"), F.lit(DEALT)).cast("int"))
    same = F.col("dealt_to") == F.col("hand")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return held.join(copies, same, "left").select(*many.columns, *others)


def _by_sums(units: DataFrame) -> DataFrame:
    """With the item of each unit (a page's first table of an index takes that index's cells along), and the item's sums, header line and
    number of cells, for pages of any length: sums are combined before they move, and come back to a table's cells in several tasks."""
    table, cell = F.col("type") == "TABLE", F.col("type") == "TABLE_CELL"
    firsts = units.where(table).groupBy("document_id", "page", "index").agg(F.min("seq").alias("item_seq"))
    cells = dealt(units.where(cell), firsts, ["document_id", "page", "index"]).withColumn("item_seq", F.coalesce("item_seq", "seq"))
    grouped = units.where(table).withColumn("item_seq", F.col("seq")).unionByName(cells)
    sums = grouped.groupBy(*KEY).agg(F.sum(F.length("text")).alias("chars"), F.sum("cost").alias("tokens"), F.max("head").alias("item_head"), F.count_if(cell).alias("cells"))
    alone = units.where(~(table | cell)).select("*", F.col("seq").alias("item_seq"), F.length("text").cast("long").alias("chars"), F.col("cost").cast("long").alias("tokens"), F.lit(None).cast("string").alias("item_head"), F.lit(0).cast("long").alias("cells"))
    return dealt(grouped, sums, KEY).unionByName(alone).withColumn("head", F.col("item_head")).drop("item_head")


def _in_rows(units: DataFrame, columns: list[str], max_chars: int, limit: int) -> DataFrame:
    """placed() for pages that fit into a row: units move once, to their page, and are put together to rows of tables, items and pages there."""
    page, key = ["document_id", "page"], ["document_id", "page", "item_seq"]
    cell = F.col("type") == "TABLE_CELL"
    long = lambda c: c.cast("long")
    sums = lambda: (long(F.sum("chars")).alias("chars"), long(F.sum("tokens")).alias("tokens"))
    at = ["col", "seq", "text"]
    member = F.struct(F.struct(*at).alias("at"), *(c for c in columns if c not in [*page, *at]), "cost")
    sized = units.repartition(*page).withColumns({"chars": long(F.length("text")), "tokens": F.col("cost"), "alone": F.when(~cell, F.col("seq")), "of_row": F.when(cell, F.col("row_key")), "member": member})
    lines = sized.groupBy(*page, "index", "alone", "of_row").agg(F.collect_list("member").alias("members"), *sums(), F.max("head").alias("head"))

    # A page's first table of an index takes that index's cells along; cells without a table stand for themselves.
    first = F.min(F.when(F.col("head").isNotNull(), F.col("alone"))).over(Window.partitionBy(*page, "index"))
    item = lambda seq, chars, tokens, members: F.struct(seq.alias("item_seq"), long(chars).alias("chars"), long(tokens).alias("tokens"), members.alias("members"))
    own = F.transform("members", lambda m: item(m["at"]["seq"], F.length(m["at"]["text"]), m["cost"], F.array(m)))
    seq = F.coalesce("alone", "first")
    each = F.when(seq.isNull(), own).otherwise(F.array(item(seq, F.col("chars"), F.col("tokens"), F.col("members"))))
    lines = lines.withColumn("first", first).select(*page, "of_row", "head", each.alias("each")).select(*page, "of_row", "head", F.explode_outer("each").alias("x")).select(*page, "of_row", "head", "x.*")
    whole, line = F.col("head").isNotNull(), F.struct("of_row", "chars", "tokens", "members")
    lines = lines.withColumns({"table": F.when(whole, F.col("members")), "line": F.when(~whole, line)})
    items = lines.groupBy(*key).agg(F.flatten(F.collect_list("table")).alias("tables"), F.array_sort(F.collect_list("line")).alias("lines"), *sums(), F.max("head").alias("head"), F.count_if(F.col("of_row").isNotNull()).alias("cells"))
    large = F.coalesce(((F.col("chars") > max_chars) | (F.col("tokens") > limit)) & F.col("head").isNotNull() & (F.col("cells") > 0), F.lit(False))
    items = items.withColumn("large", large)

    # A large table is packed row by row. The tokens of a part are those of its text (half its bytes, rounded up) and of its cells: bytes and twice the cells' add up.
    told = F.transform("lines", lambda x: F.array_join(F.array_sort(x["members"]["at"])["text"], " | "))
    items = items.withColumn("told", F.when(F.col("large"), told))
    room, token_room = long(F.lit(max_chars) - F.length("head")), long(F.lit(2 * limit) - F.octet_length("head"))

    def cost(x: Column, i: Column) -> Column:
        line = F.get("told", i)
        return F.struct(long(F.length(line) + 1 + x["chars"]).alias("chars"), long(F.octet_length(line) + 1 + 2 * x["tokens"]).alias("tokens"), room.alias("room"), token_room.alias("limit"), F.lit(False).alias("opens"))

    items = items.withColumn("breaks", F.when(F.col("large"), breaks(F.transform("lines", cost))).otherwise(F.array(long(F.lit(0)))))
    parts = _slices(items, ["lines", "told"], "part", [*key, "tables", "chars", "tokens", "head", "large"])
    parts = parts.withColumn("body", F.when(F.col("large"), F.concat("head", F.lit("\n"), F.array_join("told", "\n"))))
    total = lambda name: F.aggregate(F.col(f"lines.{name}"), long(F.lit(0)), lambda a, x: a + x)
    chars = F.when(F.col("large"), F.length("body") + total("chars")).otherwise(F.col("chars"))
    tokens = F.when(F.col("large"), estimate_tokens(F.col("body")) + total("tokens")).otherwise(F.col("tokens"))
    tables = F.when(F.col("large"), F.transform("tables", lambda t: t.withField("at.text", F.col("body")))).otherwise(F.col("tables"))
    sizes = [F.coalesce(long(chars), long(F.lit(0))).alias("chars"), F.coalesce(long(tokens), long(F.lit(0))).alias("tokens"), long(F.lit(max_chars)).alias("room"), long(F.lit(limit)).alias("limit"), (F.col("large") & (F.col("part") == 0)).alias("opens")]
    packable = parts.select(*page, F.struct("item_seq", "part", *sizes, F.concat(tables, F.flatten("lines.members")).alias("members")).alias("x"))

    pages = packable.groupBy(*page).agg(F.array_sort(F.collect_list("x")).alias("items"))
    chunks = _slices(pages.withColumn("breaks", breaks(F.col("items"))), ["items"], "chunk", page)
    each = chunks.select(*page, "chunk", F.explode_outer("items").alias("x")).select(*page, "chunk", "x.item_seq", "x.part", F.explode_outer("x.members").alias("m"))
    names = [F.col(c) if c in page else F.col(f"m.at.{c}" if c in at else f"m.{c}").alias(c) for c in columns]
    return each.select(*names, "chunk", F.struct("item_seq", "part", (F.col("m.type") != "TABLE").alias("rest"), F.col("m.at.seq").alias("seq")).alias("item"))


def placed(units: DataFrame, max_chars: int = MAX_CHARS, max_tokens: int | None = None, pack: Callable[..., DataFrame] = packed) -> DataFrame:
    """units: document_id, page, seq, evidence_id, type, text, table_index, headers, row, col, row_header, column_header. The units of each chunk as
    it shows them: these columns with chunk and item (the order inside it).

    A table over the budget is split between rows: each part has the table's id, its header line and its own rows' lines,
    then their cells; the first part opens a chunk. A row that is too large by itself stands alone, and so does a table without
    cells. Without max_tokens nothing is rendered, and packed needs no evidence_id, row_header or column_header. Every unit is in one chunk, but for split tables themselves, which are in one for each part. pack: packed, or another with its
    columns for pages of any length, for which nothing else here holds a whole page or table in one task either."""
    kept = units.where(~((F.col("type") == "IMAGE") & (F.trim("text") == "")))
    table, cell = F.col("type") == "TABLE", F.col("type") == "TABLE_CELL"
    head = header_line(F.col("table_index"), F.col("headers"))
    shown = F.when(table, F.when(F.coalesce(F.col("text"), F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n"), "text"))).otherwise(F.col("text"))
    told = F.lit(0).cast("long") if max_tokens is None else estimate_tokens(rendered(*(F.col(c) for c in ("evidence_id", "type", "text", "table_index", "row", "col", "row_header", "column_header"))))
    shaped = kept.withColumns({"head": F.when(table, head), "text": shown, "row_key": F.coalesce("row", F.lit((1 << 31) - 1)), "index": F.when(table | cell, F.coalesce("table_index", F.lit(-1)))}).withColumn("cost", told)
    limit = max_tokens if max_tokens is not None else 1 << 40
    if pack is packed:
        return _in_rows(shaped, units.columns, max_chars, limit)
    keyed = _by_sums(shaped).withColumn("large", ((F.col("chars") > max_chars) | (F.col("tokens") > limit)) & F.col("head").isNotNull() & (F.col("cells") > 0))
    small, large = keyed.where(~F.col("large")), keyed.where("large")

    # The tokens of a part are those of its text (half its bytes, rounded up) and of its cells: bytes and twice the cells' add up.
    lines = large.where(cell).groupBy(*KEY, "row_key").agg(F.first("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "seq", "text"))), lambda x: x["text"]), " | ").alias("line"), F.sum(F.length("text")).alias("chars"), F.sum("cost").alias("tokens"))
    sized = lines.select(F.struct(*KEY).alias("document_id"), F.lit(0).alias("page"), F.col("row_key").alias("item"), (F.length("line") + 1 + F.col("chars")).alias("chars"), (F.octet_length("line") + 1 + 2 * F.col("tokens")).alias("tokens"), (max_chars - F.length("head")).alias("room"), (2 * limit - F.octet_length("head")).alias("token_room"))
    parts = pack(sized, max_chars).select("document_id.*", F.col("item").alias("row_key"), F.col("chunk").alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_key", "line"))), lambda x: x["line"]), "\n")
    texts = lines.join(parts, [*KEY, "row_key"]).groupBy(*KEY, "part").agg(F.concat(F.first("head"), F.lit("\n"), body).alias("body"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))

    whole = small.groupBy(KEY).agg(F.sum(F.length("text")).alias("chars"), F.sum("cost").alias("tokens")).select("document_id", "page", F.struct("item_seq", F.lit(0).cast("long").alias("part")).alias("item"), "chars", "tokens", F.lit(False).alias("opens"))
    split = texts.select("document_id", "page", F.struct("item_seq", "part").alias("item"), F.length("body") + F.col("chars"), estimate_tokens(F.col("body")) + F.col("tokens"), F.col("part") == 0)
    chunks = pack(whole.union(split), max_chars, max_tokens).select("document_id", "page", "item.item_seq", "item.part", "chunk")

    columns = [c for c in units.columns if c != "text"]
    rest = small.select(*columns, "text", "item_seq", F.lit(0).cast("long").alias("part"))
    cells = large.where(cell).join(parts, [*KEY, "row_key"]).select(*columns, "text", "item_seq", "part")
    tables = large.where(table).join(texts.select(*KEY, "part", "body"), KEY).select(*columns, F.col("body").alias("text"), "item_seq", "part")
    every = rest.unionByName(cells).unionByName(tables).join(chunks, [*KEY, "part"])
    return every.select(*units.columns, "chunk", F.struct("item_seq", "part", (F.col("type") != "TABLE").alias("rest"), "seq").alias("item"))


def ordinals(chunks: DataFrame, start_page: int | None = None, end_page: int | None = None) -> DataFrame:
    """chunks: document_id, page, chunk. chunk_index counts over the whole page; the page window comes after and is inclusive."""
    if start_page is not None and start_page < 0 or None not in (start_page, end_page) and end_page < start_page:
        raise ValueError(f"no pages from {start_page} to {end_page}")
    w = Window.partitionBy("document_id", "page").orderBy("chunk")
    out = chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long"))
    out = out if start_page is None else out.where(F.col("page") >= start_page)
    return out if end_page is None else out.where(F.col("page") <= end_page)


def selected(chunks: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """chunks: document_id, page, chunk, has_table, digits. At most `limit` chunks of a document: of each stratum of its order, the best."""
    doc = Window.partitionBy("document_id")
    placed = chunks.withColumn("p", F.row_number().over(doc.orderBy("page", "chunk")) - 1).withColumn("n", F.count("*").over(doc))
    stratum = F.when(F.col("n") <= limit, F.col("p")).otherwise(F.floor(((F.col("p") + 1) * limit - 1) / F.col("n")))
    best = Window.partitionBy("document_id", "stratum").orderBy(F.desc("has_table"), F.desc("digits"), "p")
    return placed.withColumn("stratum", stratum).withColumn("best", F.row_number().over(best)).where("best = 1").drop("best", "n")


def chunk_hash(ids: Column) -> Column:
    """SHA-256 of the sorted ids, each followed by a bar."""
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(ids), lambda x: F.concat(x, F.lit("|")))), 256)


def remaining(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """Chunks without a completed progress row of the same content. chunks and progress: document_id, page, chunk_index, evidence_hash; progress: status."""
    done = progress.where("status = 'COMPLETED'").select("document_id", "page", "chunk_index", "evidence_hash")
    return chunks.join(done, ["document_id", "page", "chunk_index", "evidence_hash"], "left_anti")


def text_items(units: DataFrame) -> DataFrame:
    """Text units as items to be packed."""
    return units.select("document_id", "page", F.col("block_index").alias("item"), F.length("text").alias("chars"), estimate_tokens(F.col("text")).alias("tokens"), digits(F.col("text"), 1 << 30).alias("digits"))
