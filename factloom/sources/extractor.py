"""Page content by a plug-in: text blocks, printed page numbers, tables, and the box that a highlight shows.

An extractor is any object with `pages(content)` and `tables(content, pages, settings)`; it is called on the executors. It
gives dicts: of a page its number, label, size, text blocks as lines of spans, whether it has pictures, and how many tables
it may hold; of a table its page, index and cells. What the dicts mean is worked out by column expressions here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES = "document_id string, page int, label string, width double, height double, has_images boolean, candidates int, blocks array<struct<type:int,lines:array<array<string>>>>, error string"
TABLES = "document_id string, page int, table_index int, cells array<struct<row:int,col:int,text:string>>, error string"
#: Settings of the second search, where the first finds no table.
RETRY = {"vertical_strategy": "text", "horizontal_strategy": "text"}
LEAST_DPI, MOST_DPI, DPI = 40, 300, 110


class Extractor(Protocol):
    def pages(self, content: bytes) -> list[dict]: ...

    def tables(self, content: bytes, pages: list[int], settings: dict | None) -> list[dict]: ...


class RangeExtractor(Protocol):
    """Reads stretches of a file's pages, so that one file's pages can be read by several tasks."""

    def count(self, content: bytes) -> int: ...

    def pages(self, content: bytes, first: int, last: int) -> list[dict]: ...

    def tables(self, content: bytes, pages: list[int], settings: dict | None) -> list[dict]: ...


class PlainPages:
    """Files of UTF-8 text whose pages are parted by form feeds.

    A first line "[page iv]" is a page's printed number, a line "[picture]" a picture; neighbouring lines that begin and
    end with a bar are a table's rows; paragraphs are blocks."""

    def _page(self, content: bytes, number: int) -> list[str]:
        return content.decode("utf-8").split("\f")[number].split("\n")

    def count(self, content: bytes) -> int:
        return content.decode("utf-8").count("\f") + 1

    def _parts(self, lines: list[str]) -> list[tuple[bool, list[str]]]:
        """(is it a table, lines) of each stretch."""
        found: list[tuple[bool, list[str]]] = []
        for line in [*lines, ""]:
            row = len(line.strip()) > 1 and line.strip()[0] == line.strip()[-1] == "|"
            if not line.strip() or line.strip() == "[picture]":
                found.append((False, []))
            elif found and found[-1][0] == row and found[-1][1]:
                found[-1][1].append(line)
            else:
                found.append((row, [line]))
        return [x for x in found if x[1]]

    def pages(self, content: bytes, first: int, last: int) -> list[dict]:
        out = []
        for number in range(first, last + 1):
            lines, label = self._page(content, number), None
            if lines[0].startswith("[page ") and lines[0].rstrip().endswith("]"):
                label, lines = lines[0].rstrip()[6:-1], lines[1:]
            parts = self._parts(lines)
            blocks = [{"type": 0, "lines": [[line] for line in part]} for table, part in parts if not table]
            out.append({"page": number, "label": label, "width": 612.0, "height": 792.0, "has_images": any(line.strip() == "[picture]" for line in lines), "candidates": sum(table for table, _ in parts), "blocks": blocks})
        return out

    def tables(self, content: bytes, pages: list[int], settings: dict | None) -> list[dict]:
        out = []
        for number in pages:
            grids = [part for table, part in self._parts(self._page(content, number)) if table]
            for i, part in enumerate(grids):
                cells = [{"row": r, "col": c, "text": text.strip()} for r, line in enumerate(part) for c, text in enumerate(line.strip()[1:-1].split("|"))]
                out.append({"page": number, "table_index": i, "cells": cells})
        return out


def _schema(ddl: str, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _each(files: DataFrame, ddl: str, rows_of) -> DataFrame:
    schema = _schema(ddl, files)

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, content, *more in zip(*(c.to_pylist() for c in batch.columns)):
                found = [{"document_id": document} | r for r in rows_of(content, *more)]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in found], schema)

    return files.mapInArrow(work, ddl)


def read_pages(files: DataFrame, extractor: Extractor) -> DataFrame:
    """files: document_id, content. A row for each page; a file that can't be read is one row with its error."""

    def rows(content):
        try:
            return extractor.pages(content)
        except Exception as e:  # one bad file leaves the others alone
            return [{"page": 0, "error": f"{type(e).__name__}: {e}"}]

    return _each(files.select("document_id", "content"), PAGES, rows)


#: Into so many stretches, at most, is one file read, as its bytes go to each.
MOST_STRETCHES, PAGES_OF_A_TASK = 64, 32


def read_ranges(files: DataFrame, extractor: RangeExtractor, pages_of_a_task: int = PAGES_OF_A_TASK) -> DataFrame:
    """As read_pages, a file's pages dealt out in stretches. A stretch that can't be read is one row with its error, at its first page."""

    def told(e: Exception) -> str:
        return f"{type(e).__name__}: {e}"

    def counted(content):
        try:
            return [{"n": extractor.count(content)}]
        except Exception as e:  # one bad file leaves the others alone
            return [{"error": told(e)}]

    def rows(content, first, last, error):
        if error is not None:
            return [{"page": 0, "error": error}]
        try:
            return extractor.pages(content, first, last)
        except Exception as e:  # and one bad stretch the file's others
            return [{"page": first, "error": told(e)}]

    files = files.select("document_id", "content")
    n = F.greatest("n", F.lit(1))
    step = F.greatest(F.lit(pages_of_a_task), F.ceil(n / MOST_STRETCHES)).cast("int")
    counts = _each(files, "document_id string, n int, error string", counted)
    dealt = counts.select("document_id", "error", n.alias("n"), step.alias("step")).withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.col("step"))))
    dealt = dealt.select("document_id", "first", (F.least(F.col("first") + F.col("step"), "n") - 1).alias("last"), "error")
    return _each(files.join(dealt, "document_id").repartition("document_id", "first").select("document_id", "content", "first", "last", "error"), PAGES, rows)


def block_text(lines: Column) -> Column:
    """Spans of a line side by side, lines one below the other, without white space at the ends."""
    return F.regexp_replace(F.array_join(F.transform(lines, lambda spans: F.array_join(spans, "")), "\n"), r"(?U)^\s+|\s+$", "")


def text_blocks(pages: DataFrame) -> DataFrame:
    """document_id, page, block_index, text: blocks of text (type 0) that aren't blank, numbered densely on their page."""
    texts = F.filter(F.transform(F.filter("blocks", lambda b: b["type"] == 0), lambda b: block_text(b["lines"])), lambda t: t != "")
    return pages.select("document_id", "page", F.posexplode(texts).alias("block_index", "text"))


def labelled(pages: DataFrame) -> DataFrame:
    """pages with source_page_number: the printed number, only where the document has any; never made up."""
    some = pages.groupBy("document_id").agg(F.max(F.coalesce(F.col("label") != "", F.lit(False))).alias("labels"))
    return pages.join(some, "document_id").withColumn("source_page_number", F.when(F.col("labels"), F.nullif("label", F.lit("")))).drop("labels")


def read_tables(files: DataFrame, pages: DataFrame, extractor: Extractor | RangeExtractor, pages_of_a_task: int = PAGES_OF_A_TASK) -> DataFrame:
    """Tables of pages that may hold one: searched once, and once more with RETRY where nothing is found. A page on which nothing is found, or the search fails, gives one row with its error."""
    last = pages.groupBy("document_id").agg(F.max("page").alias("last"))
    step = F.greatest(F.lit(pages_of_a_task), F.ceil((F.col("last") + 1) / MOST_STRETCHES))
    wanted = pages.where("candidates > 0").join(last, "document_id").groupBy("document_id", F.floor(F.col("page") / step).alias("stretch")).agg(F.array_sort(F.collect_set("page")).alias("pages"))

    def rows(content, numbers):
        out = []
        for page in numbers:
            try:
                found = extractor.tables(content, [page], None) or extractor.tables(content, [page], RETRY)
                out += found or [{"page": page, "table_index": 0, "error": f"page {page}: no table found by either search"}]
            except Exception as e:  # a failure stays on its page
                out.append({"page": page, "table_index": 0, "error": f"page {page}: table search failed ({type(e).__name__}: {e})"})
        return out

    return _each(files.select("document_id", "content").join(wanted, "document_id").repartition("document_id", "stretch").select("document_id", "content", "pages"), TABLES, rows)


def table_cells(tables: DataFrame) -> DataFrame:
    """Cells of tables without an error, as ingest takes them."""
    return tables.where("error is null").select("document_id", "page", "table_index", F.explode("cells").alias("c")).select("document_id", "page", "table_index", "c.*")


def highlights(asked: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """asked: request_id, document_id, page, evidence_id (null: none), dpi (null: DPI). What a page view with a highlight is answered.

    status: 200, 404 (no such page or evidence), 400 (evidence of another page), 422 (dpi out of range). box: the evidence's
    box in pixels where it touches the page. evidence: document_id, evidence_id, page, bbox (x0, y0, x1, y1 in points)."""
    e = evidence.select("document_id", "evidence_id", F.col("page").alias("on_page"), "bbox")
    p = pages.select("document_id", "page", "width", "height")
    out = asked.withColumn("dpi", F.coalesce("dpi", F.lit(DPI))).join(p, ["document_id", "page"], "left").join(e, ["document_id", "evidence_id"], "left")
    status = F.when(~F.col("dpi").between(LEAST_DPI, MOST_DPI), 422).when(F.col("width").isNull(), 404).when(F.col("evidence_id").isNull(), 200).when(F.col("on_page").isNull(), 404).when(F.col("on_page") != F.col("page"), 400).otherwise(200)
    scale = F.col("dpi") / 72.0
    x0, y0 = F.greatest("bbox.x0", F.lit(0.0)), F.greatest("bbox.y0", F.lit(0.0))
    x1, y1 = F.least("bbox.x1", "width"), F.least("bbox.y1", "height")
    box = F.when((F.col("status") == 200) & F.col("bbox").isNotNull() & (x0 < x1) & (y0 < y1), F.struct(*((c * scale).alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1")))))
    return out.withColumn("status", status).withColumn("box", box).select("request_id", "status", "box")
