"""Line items of tables: headers, rows across pages, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Scratch
from .extract import anchors, group_rows

#: How far a word's left edge may lie from its column's.
COLUMN = 0.055


def header(anchor: DataFrame, columns: int | None) -> DataFrame:
    """The first page of each document that has all captions (`columns`, if given); its columns from left to right, and where rows begin."""
    pages = anchor.groupBy("document", "page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("left", "field"))).alias("columns"), F.max(F.col("top") + F.col("height")).alias("below")).where(F.lit(True) if columns is None else F.col("n") == columns)
    return pages.groupBy("document").agg(F.min_by(F.struct("page", "columns", "below"), "page").alias("h")).select("document", "h.*")


def with_columns(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Each page from the header on, with the header's columns carried forward; later pages begin at the top."""
    own = headers.select("document", "page", "columns", "below")
    order = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = pages.select("document", "page").distinct().join(own, ["document", "page"], "left")
    return met.withColumns({"columns": F.last("columns", True).over(order), "below": F.coalesce("below", F.lit(0.0))}).where("columns is not null")


def is_row(value: Column) -> Column:
    """At least two digits, and digits for at least half of what is not space."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.coalesce((digits >= 2) & (2 * digits >= F.length(F.regexp_replace(value, r"\s", ""))), F.lit(False))


def cells(words: DataFrame, pages: DataFrame) -> DataFrame:
    """document, page, row, field, value of the words below the header, each in the column it is nearest to."""
    met = group_rows(words).join(pages, ["document", "page"]).where(F.col("top") > F.col("below"))
    near = F.filter(F.transform("columns", lambda c: F.struct(F.abs(c["left"] - F.col("left")).alias("gap"), c["field"].alias("field"))), lambda c: c["gap"] <= COLUMN)
    placed = met.withColumn("field", F.array_min(near)["field"]).where("field is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    return placed.groupBy("document", "page", "row", "field").agg(text.alias("value"))


def rows(cell: DataFrame, value_field: str) -> DataFrame:
    """One row per line item with a map of its cells; rows whose value cell is no amount are left out."""
    whole = cell.groupBy("document", "page", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("cells"))
    return whole.where(is_row(F.try_element_at("cells", F.lit(value_field))))


def read_table(words: DataFrame, captions: DataFrame, value_field: str, documents: DataFrame | None = None) -> DataFrame:
    """The line items of each document whose table has all captions (field, caption; by language or document type with `documents`): document, page, row, cells.

    Pages after the header's go on with its columns, from their tops. Captions are a contract's, so their number is counted once.
    """
    scope = [c for c in ("document_type", "language") if c in captions.columns]
    sizes = captions.groupBy(*scope).agg(F.countDistinct("field").alias("columns"))
    scratch = Scratch(words.sparkSession, "table")
    words = scratch.keep(words, "words")
    found = scratch.keep(anchors(words, captions, documents=documents), "anchors")
    if scope:
        found = found.join(documents.select("document", *scope).distinct(), "document").join(F.broadcast(sizes), scope)
    else:
        found = found.join(F.broadcast(sizes))
    whole = found.groupBy("document", "page").agg(F.count("*").alias("n"), F.min("columns").alias("all")).where("n = all").select("document", "page")
    pages = with_columns(words.select("document", "page"), header(found.join(whole, ["document", "page"], "left_semi"), None))
    return rows(cells(words, pages), value_field)
