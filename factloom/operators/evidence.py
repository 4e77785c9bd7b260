"""Evidence: lines of text, pages with their quality, tables as grids, OCR boxes, and ingestion status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import GOOD_FROM, quality, suspicious, uuid5, words
from factloom.sources.views import LINES_OF_A_PAGE

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def lines(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text. One unit for each line that isn't blank, LINES_OF_A_PAGE lines a page, numbered densely on it."""
    each = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    kept = each.select("document_id", F.floor(F.col("line") / LINES_OF_A_PAGE).cast("int").alias("page"), "line", F.regexp_replace("text", r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$", "").alias("text")).where("text <> ''")
    w = Window.partitionBy("document_id", "page").orderBy("line")
    return kept.select("document_id", "page", (F.row_number().over(w) - 1).alias("block_index"), "text")


def evidence_id(document: Column, page: Column, index: Column, kind: Column) -> Column:
    """The same place has the same id in every run."""
    return uuid5(NAMESPACE, F.concat_ws(":", document, page.cast("string"), index.cast("string"), kind))


def has_images(document: Column, page: Column) -> Column:
    """No pictures come with the given tables; every seventh page counts as having one."""
    return (document.cast("long") * 3 + page) % 7 == 0


def page_stats(units: DataFrame) -> DataFrame:
    """Characters, words, and the share of suspicious characters of each page; 0 where there are no characters."""
    out = units.groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("char_count"), F.sum(words(F.col("text"))).alias("word_count"), F.sum(suspicious(F.col("text"))).alias("odd"))
    return out.select("document_id", "page", "char_count", "word_count", F.coalesce(F.try_divide("odd", "char_count"), F.lit(0.0)).alias("suspicious_ratio"))


def page_quality(units: DataFrame, pages: DataFrame | None = None, pictured: Column | None = None) -> DataFrame:
    """pages: document_id, page, has_images and what else is known of them; those without text count as empty. Without it, the pages that have
    text, with pictures where `pictured` is true (by default nowhere, as text alone shows none)."""
    if pages is None:
        stats = page_stats(units).withColumn("has_images", F.lit(False) if pictured is None else pictured)
    else:
        stats = pages.withColumn("has_images", F.coalesce("has_images", F.lit(False))).join(page_stats(units), ["document_id", "page"], "left").fillna(0, ["char_count", "word_count", "suspicious_ratio"])
    score = quality(F.col("char_count"), F.col("word_count"), F.col("suspicious_ratio"), F.col("has_images"))
    out = stats.withColumn("extraction_quality", score)
    return out.withColumn("quality_verdict", F.when((F.col("char_count") > 0) & (F.col("extraction_quality") >= GOOD_FROM), "GOOD").otherwise("BAD"))


def needs_ocr(pages: DataFrame) -> DataFrame:
    return pages.where("quality_verdict = 'BAD'")


def image_markers(pages: DataFrame, units: DataFrame) -> DataFrame:
    """An IMAGE unit of empty text for pages that have pictures and no text unit. pages: document_id, page, has_images."""
    return pages.where("has_images").join(units.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti").select("document_id", "page", F.lit(0).alias("block_index"), F.lit("IMAGE").alias("type"), F.lit("").alias("text"))


def union(*parts: DataFrame) -> DataFrame:
    """All evidence, nothing dropped; columns are matched by name."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def ingestion(pages: DataFrame, units: DataFrame) -> DataFrame:
    """Status of each document: COMPLETED without page errors, PARTIAL with some and any evidence, else FAILED. bad_pages counts errors."""
    per = pages.groupBy("document_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("error").isNotNull()).alias("bad_pages"))
    some = units.groupBy("document_id").agg(F.count("*").alias("evidence_count"))
    n = F.coalesce("evidence_count", F.lit(0))
    status = F.when(F.col("bad_pages") == 0, "COMPLETED").when(n > 0, "PARTIAL").otherwise("FAILED")
    return per.join(some, "document_id", "left").select("document_id", "page_count", "bad_pages", n.alias("evidence_count"), status.alias("ingestion_status"))


def cleaned_grid(cells: DataFrame) -> DataFrame:
    """cells: table_id, row, col, text. Without empty rows and columns, numbered densely; the first row left is the header.

    Gives table_id, row, col, text, is_header, column_header, row_header, n_rows, n_cols; empty cells are left out."""
    filled = cells.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")
    t = Window.partitionBy("table_id")
    numbered = filled.withColumn("r", F.dense_rank().over(t.orderBy("row")) - 1).withColumn("c", F.dense_rank().over(t.orderBy("col")) - 1)
    head = F.max(F.when(F.col("r") == 0, F.col("text"))).over(Window.partitionBy("table_id", "c"))
    first = F.max(F.when(F.col("c") == 0, F.col("text"))).over(Window.partitionBy("table_id", "r"))
    return numbered.select("table_id", (F.col("r") - 1).alias("row"), F.col("c").alias("col"), "text", (F.col("r") == 0).alias("is_header"), head.alias("column_header"), F.when(F.col("c") > 0, first).alias("row_header"), F.max("r").over(t).alias("n_rows"), (F.max("c").over(t) + 1).alias("n_cols"))


def grid_text(grid: DataFrame) -> DataFrame:
    """A table as text: rows by line, cells parted by tabs, the header first."""
    row = grid.groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), "\t").alias("line"))
    return row.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def table_units(cells: DataFrame) -> DataFrame:
    """Evidence of tables: a TABLE unit with the whole grid, and a TABLE_CELL unit for each filled cell below the header.

    cells: document_id, page, table_index, row, col, text. Grids are cleaned as by cleaned_grid; indices of units on a page follow its
    table, row and column. A page's cells move once and are put together row by row, then table by table, as a TABLE unit is one row anyway."""
    table = ["document_id", "page", "table_index"]
    filled = cells.withColumns({"text": F.trim(F.coalesce("text", F.lit(""))), "col": F.coalesce("col", F.lit(-(1 << 31)))}).where("text <> ''").repartition("document_id", "page")
    rows = filled.withColumn("x", F.struct("col", "text")).groupBy(*table, "row").agg(F.array_sort(F.collect_list("x")).alias("cells"))
    tables = rows.withColumn("x", F.struct("row", "cells")).groupBy(*table).agg(F.array_sort(F.collect_list("x")).alias("rows"))
    tables = tables.select(*table, "rows", F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda x: x["cells"]["col"])))).alias("cols"))

    def joined(row: Column) -> Column:
        return F.array_join(row["cells"]["text"], "\t")

    def name(col: Column) -> Column:
        return F.coalesce(F.array_max(F.filter(F.get("rows", F.lit(0))["cells"], lambda x: x["col"] == col)["text"]), F.lit(""))

    # The whole grid stays with its first row, so that it isn't copied to all others.
    tables = tables.select(*table, "rows", "cols", F.transform("cols", name).alias("headers"), F.array_join(F.transform("rows", joined), "\n").alias("grid"))
    tables = tables.select(*table, "cols", "headers", F.transform("rows", lambda x, i: F.struct(x["cells"].alias("cells"), F.when(i == 0, F.col("grid")).alias("grid"), F.when(i == 0, F.size("rows") - 1).alias("n_rows"))).alias("rows"))
    # No array here is empty; the outer form of explode doesn't filter for that, which would compute the array once more.
    lines = tables.select(*table, "cols", "headers", F.posexplode_outer("rows").alias("r", "line")).select(*table, "cols", "headers", "r", "line.*")
    before = Window.partitionBy("document_id", "page").orderBy("table_index", "r").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("r") == 0
    leads = F.array_max(F.filter("cells", lambda x: x["col"] == F.get("cols", F.lit(0)))["text"])
    lines = lines.withColumns({"before": F.coalesce(F.sum(F.when(head, 1).otherwise(F.size("cells"))).over(before), F.lit(0)), "leads": leads}).withColumn("cells", F.when(head, F.slice("cells", 1, 1)).otherwise(F.col("cells")))
    each = lines.select(*table, "cols", "headers", "r", "grid", "n_rows", "before", "leads", F.posexplode_outer("cells").alias("i", "x"))
    each = each.withColumn("c", (F.array_position("cols", F.col("x.col")) - 1).cast("int"))
    of_cell = {"row": F.col("r") - 1, "col": F.col("c"), "column_header": F.nullif(F.get("headers", F.col("c")), F.lit("")), "row_header": F.when(F.col("c") > 0, F.col("leads"))}
    return each.select(*table, F.when(head, "TABLE").otherwise("TABLE_CELL").alias("type"), F.when(head, F.col("grid")).otherwise(F.col("x.text")).alias("text"), "n_rows", F.when(head, F.size("cols")).alias("n_cols"), F.when(head, F.col("headers")).alias("headers"), *(F.when(~head, v).alias(k) for k, v in of_cell.items()), (F.col("before") + F.col("i")).cast("int").alias("place"))


def header_line(index: Column, headers: Column) -> Column:
    return F.concat(F.lit("Table "), F.coalesce(index.cast("string"), F.lit("?")), F.lit(" (columns: "), F.array_join(F.coalesce(headers, F.array().cast("array<string>")), " | "), F.lit("):"))


def box(xs: Column, ys: Column, dpi: Column) -> Column:
    """Corner points in pixels to an ordered box in points; null when it has no area or a value that isn't finite."""
    scale = dpi / 72.0
    bad = F.exists(F.concat(xs, ys), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = F.struct((F.array_min(xs) / scale).alias("x0"), (F.array_min(ys) / scale).alias("y0"), (F.array_max(xs) / scale).alias("x1"), (F.array_max(ys) / scale).alias("y1"))
    return F.when(~bad & (F.array_max(xs) > F.array_min(xs)) & (F.array_max(ys) > F.array_min(ys)), out)


def ocr_blocks(results: DataFrame) -> DataFrame:
    """results: id, texts, scores, boxes (arrays that may differ in length). One row for each text that isn't blank; scores outside 0..1 are null."""
    each = results.select("id", F.posexplode("texts").alias("index", "text"), "scores", "boxes")
    score = F.get("scores", F.col("index"))
    return each.where(F.trim("text") != "").select("id", "index", F.trim("text").alias("text"), F.when(score.between(0, 1), score).alias("score"), F.get("boxes", F.col("index")).alias("box"))


def page_numbers(asked: list, pages: int) -> list[int]:
    """Distinct valid page numbers in the order they came; anything but an integer in range is an error."""
    for n in asked:
        if not isinstance(n, int) or isinstance(n, bool) or not 0 <= n < pages:
            raise ValueError(f"no page {n!r} of {pages}")
    return list(dict.fromkeys(asked))


def ocr_fallback(pages: DataFrame, units: DataFrame, provider, apply) -> tuple[DataFrame, DataFrame]:
    """(units with OCR_TEXT added, pages with error): BAD pages go through a provider ({document_id, page} -> {texts}); a failure stays on its page."""
    read = apply(needs_ocr(pages).select("document_id", "page"), provider, ["document_id", "page"], "texts array<string>")
    last = units.groupBy("document_id", "page").agg(F.max("block_index").alias("last"))
    found = read.where("error is null").join(last, ["document_id", "page"], "left").select("document_id", "page", "last", F.posexplode("texts").alias("i", "text")).where("trim(text) <> ''")
    w = Window.partitionBy("document_id", "page").orderBy("i")
    added = found.select("document_id", "page", (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).alias("block_index"), F.trim("text").alias("text"), F.lit("OCR_TEXT").alias("type"))
    failed = read.where("error is not null").select("document_id", "page", F.col("error").alias("ocr_error"))
    return union(units, added), pages.join(failed, ["document_id", "page"], "left").withColumn("error", F.coalesce("error", "ocr_error")).drop("ocr_error")
