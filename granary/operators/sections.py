"""Sections of a page from its lines, as windows over the lines of one page.

A page's lines are a bounded group, so every window is partitioned by page.
Headings carry forward within the stretch that a first-level heading opens: the
first heading of the stretch is the section, the latest later one the subsection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import extract as x
from granary.functions import text as t

DEFAULT_SECTION, DEFAULT_SUBSECTION = "General", "-"


def page_lines(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, line): the lines of each page that aren't blank, stripped."""
    rows = pages.select(*keys, F.posexplode(t.lines(F.col(text))).alias("pos", "line"))
    return rows.withColumn("line", t.strip(F.col("line"))).where("line <> ''")


def sections(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, index (from 0 on the page), section, subsection, heading, heading_level, text of every section with content."""
    rows = page_lines(pages, keys, text).withColumn("bare", t.heading_text(F.col("line")))
    rows = rows.withColumn("split", x.heading_and_rest(F.col("line"), F.col("bare")))
    rows = rows.withColumn("embedded", F.col("split.heading").isNotNull() & (F.col("split.rest") != ""))
    rows = rows.withColumn("pure", ~F.col("embedded") & x.heading(F.col("line"), F.col("bare")))
    embedded, pure = F.col("embedded"), F.col("pure")
    head = F.when(embedded, F.col("split.heading")).when(pure, F.col("bare"))
    rows = rows.withColumn("is_head", embedded | pure).withColumn("head", head)
    rows = rows.withColumn("level", F.when(embedded, x.level(F.col("split.heading"))).when(pure, x.level(F.col("line"))))
    rows = rows.withColumn("content", F.when(embedded, F.col("split.rest")).when(~pure, F.col("line"))).drop("split", "bare", "embedded", "pure")
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stretch", F.sum((F.col("is_head") & (F.col("level") == 1)).cast("int")).over(so_far)).withColumn("segment", F.sum(F.col("is_head").cast("int")).over(so_far))
    inside = Window.partitionBy(*keys, "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.first("head", ignorenulls=True).over(inside)).withColumn("nth", F.sum(F.col("is_head").cast("int")).over(inside))
    later = F.last(F.when(F.col("is_head") & (F.col("nth") > 1), F.col("head")), ignorenulls=True).over(inside)
    rows = rows.withColumn("subsection", later).withColumn("heading", F.last("head", ignorenulls=True).over(so_far)).withColumn("heading_level", F.coalesce(F.last("level", ignorenulls=True).over(so_far), F.lit(1)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda s: s["content"]), "\n")
    grouped = rows.where(F.col("content").isNotNull()).groupBy(*keys, "segment").agg(
        F.coalesce(F.nullif(F.first("section", ignorenulls=True), F.lit("")), F.lit(DEFAULT_SECTION)).alias("section"),
        F.coalesce(F.nullif(F.first("subsection", ignorenulls=True), F.lit("")), F.lit(DEFAULT_SUBSECTION)).alias("subsection"),
        F.first("heading", ignorenulls=True).alias("heading"),
        F.max("heading_level").alias("heading_level"),
        t.strip(body).alias("text"),
    )
    order = Window.partitionBy(*keys).orderBy("segment")
    return grouped.where("text <> ''").select(*keys, (F.row_number().over(order) - 1).alias("index"), "section", "subsection", "heading", "heading_level", "text")


def parents(pages: DataFrame, document: str = "document_id", page: str = "page_number", text: str = "text", tables: DataFrame | None = None) -> DataFrame:
    """One parent chunk per section, with its id and section lines in front. tables: (document, page, index, rag_text) to append."""
    rows = sections(pages, [document, page], text)
    ident = F.concat_ws("_", F.col(document), F.col(page).cast("string"), F.col("index").cast("string"), "section", "subsection")
    parts = [F.concat(F.lit("Section: "), F.col("section")), F.concat(F.lit("Subsection: "), F.col("subsection")), F.col("text")]
    if tables is not None:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_number", "rag_text"))), lambda s: s["rag_text"]), "\n\n")
        rows = rows.join(tables.groupBy(document, page, "index").agg(joined.alias("tables")), [document, page, "index"], "left")
        parts.append(F.concat(F.lit("\nNormalized table data:\n"), F.col("tables")))
    return rows.select(document, page, "index", "section", "subsection", t.short_id(ident).alias("parent_id"), F.lit("parent").alias("chunk_type"), F.concat_ws("\n\n", *parts).alias("page_content"))
