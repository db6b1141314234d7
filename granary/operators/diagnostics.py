"""Checks of indexes, pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as t


def inconsistencies(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("bm25", "vector")) -> DataFrame:
    """(key, problem): keys of one index only, and keys that an index holds more than once."""
    a, b = left.select(key), right.select(key)
    only = lambda p, q, n: p.join(q, key, "left_anti").distinct().select(key, F.lit(f"{n}_only").alias("problem"))
    twice = lambda p, n: p.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit(f"{n}_duplicate").alias("problem"))
    return only(a, b, names[0]).unionByName(only(b, a, names[1])).unionByName(twice(a, names[0])).unionByName(twice(b, names[1]))


def missing_pages(produced: DataFrame, document: str, page: str, totals: DataFrame | None = None) -> DataFrame:
    """(document, page): pages from 1 to the last (or to totals) that nothing was produced for."""
    whole = totals or produced.groupBy(document).agg(F.max(page).alias("pages"))
    expected = whole.where("pages >= 1").select(document, F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias(page))
    return expected.join(produced.select(document, F.col(page).cast("int").alias(page)), [document, page], "left_anti")


def chunk_statistics(df: DataFrame, document: str = "document_id", parent: str = "parent_id") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(t.filled(F.col(document))).alias("documents"), F.count_distinct(t.filled(F.col(parent))).alias("parents"))


def methods(df: DataFrame, document: str = "document_id", method: str = "extraction_method") -> DataFrame:
    """Pages of each document by the way they were read, and those that are empty or short."""
    size = F.length(t.strip(t.text(F.col("page_content"))))
    return df.groupBy(document).agg(
        F.count_if(F.col(method) == "ocr").alias("ocr"), F.count_if(F.col(method) == "pymupdf").alias("pymupdf"), F.count_if(~F.coalesce(F.col(method), F.lit("")).isin("ocr", "pymupdf")).alias("other"),
        F.count_if(size == 0).alias("empty"), F.count_if((size > 0) & (size < 80)).alias("short"),
    )


def report(by_document: DataFrame) -> DataFrame:
    """One row: the sums over all documents."""
    return by_document.agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(c) for c in ("ocr", "pymupdf", "other", "empty", "short")))
