"""Documents out of reconstructed annex tables, their text form and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as t

DEFAULTS = {"parser": "ocr_table_reconstructor", "extraction_method": "structured_ocr_reconstruction", "language": "en", "version": "1.0"}


def base(document_type: str) -> list:
    name = F.regexp_extract(F.col("document"), r"([^/\\]*)$", 1)
    return [
        F.col("document").alias("source"), name.alias("file_name"), F.col("page_number").alias("page"), F.col("page_number"), F.lit(document_type).alias("document_type"),
        F.col("confidence").cast("double").alias("ocr_confidence"), (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0).alias("has_ocr_warning"), *(F.lit(v).alias(k) for k, v in DEFAULTS.items()),
    ]


def activity_documents(rows: DataFrame, document_type: str = "scheme_annex", order: str = "activity_number") -> DataFrame:
    """One document an activity; numbered from 1 within its table."""
    number = F.row_number().over(Window.partitionBy("document", "page_number", "table_no").orderBy(order, "activity_id"))
    content = F.concat(F.lit("Eligible Activity\n"), t.text(F.col("marker")), F.lit(" "), t.text(F.col("text")))
    return rows.select(content.alias("page_content"), *base(document_type), "table_no", F.lit("Eligible Activities").alias("section"), F.lit("activity").alias("content_type"), number.alias("activity_number"), F.col("marker").alias("activity_marker"))


def cost_documents(rows: DataFrame, document_type: str = "scheme_annex") -> DataFrame:
    """One document a row of a cost table."""
    value = lambda c: t.text(F.col(c).cast("string"))
    content = F.concat(F.lit("Cost Norm\nItem "), value("item_number"), F.lit("\nDescription: "), value("description"), F.lit("\nCost Norm: "), value("cost"))
    return rows.select(content.alias("page_content"), *base(document_type), "table_no", F.lit("Cost Norms").alias("section"), F.lit("cost_norm").alias("content_type"), "item_number", "raw_description", "raw_cost")


def documents(activities: DataFrame, costs: DataFrame, document_type: str = "scheme_annex") -> DataFrame:
    """Activities first, then costs; part orders the two."""
    return activity_documents(activities, document_type).withColumn("part", F.lit(0)).unionByName(cost_documents(costs, document_type).withColumn("part", F.lit(1)), allowMissingColumns=True)


def final_text(activities: DataFrame, costs: DataFrame) -> DataFrame:
    """(document, page_number, table_no, text): the whole table as one text."""
    keys = ["document", "page_number", "table_no"]
    listed = lambda order, line: F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda s: s["line"])
    a = activities.groupBy(*keys).agg(listed(["activity_number", "activity_id"], F.concat(t.text(F.col("marker")), F.lit(" "), t.text(F.col("text")))).alias("a"))
    cost = F.concat(F.lit("Item "), F.col("item_number").cast("string"), F.lit(": "), t.text(F.col("description")), F.lit("\nCost Norm: "), t.text(F.col("cost")))
    c = costs.groupBy(*keys).agg(listed(["item_number"], cost).alias("c"))
    empty = F.array().cast("array<string>")
    head = F.array(F.concat(F.lit("DOCUMENT: "), F.col("document")), F.concat(F.lit("PAGE: "), F.col("page_number").cast("string")), F.lit(""), F.lit("SECTION: Eligible Activities"))
    parts = F.concat(head, F.coalesce("a", empty), F.array(F.lit(""), F.lit("SECTION: Cost Norms")), F.coalesce("c", empty))
    return a.join(c, keys, "left").select(*keys, F.array_join(parts, "\n").alias("text"))


def differences(actual: DataFrame, expected: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """Positions where a table differs from what is expected of it: missing, additional or other values. Texts are compared with single spaces."""
    own, goal = (d.select(*keys, ordinal, t.squeezed(F.col(value)).alias(n)) for d, n in ((actual, "actual"), (expected, "expected")))
    return own.join(goal, [*keys, ordinal], "full").where(~F.col("actual").eqNullSafe(F.col("expected")))
