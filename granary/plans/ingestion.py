"""From files to pages, parents, children and index tables, as one plan.

file -> native text -> gate -> readings of the image -> retry of poor ones -> choice
-> method label -> page lists -> sections -> parents -> children -> index. Parser,
renderer and reader are passed in. Only pages without enough text of their own are
rendered and read, and only poor ones of them a second time. Each stage's rows are
pages, so no task holds more than one file's pages at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import quality as q
from granary.functions import text as t
from granary.operators import chunking, images, lexical, ocr, sections
from granary.sources import io

#: Page segmentations of the first round and of the second, which reads every variant of the image.
FIRST, SECOND = ("--psm 6", "--psm 11"), ("--psm 6", "--psm 11", "--psm 4")
PRIMARY = [("original", c) for c in FIRST]
RETRY = [(v, c) for v in images.VARIANTS for c in SECOND]
KEYS = ["path", "page_number"]
DPI = 250

Parse = Callable[[bytes], list[tuple[int, str, str, int]]]
Render = Callable[[bytes, int, int], bytes]
Read = Callable[[bytes, str], tuple[str, float]]


@dataclass
class Extracted:
    """pages: path, page_number, text, confidence, issues, extraction_method of each page with text. report: path, page_number and status (successful, low, empty, failed) and whether it was read again."""

    pages: DataFrame
    report: DataFrame


def reader(read: Read) -> Callable[[bytes, str, str], tuple[str, float]]:
    """A reading of one variant of an image."""
    return lambda image, kind, config: read(images.preprocessed(image, kind), config)


def rendered(files: DataFrame, wanted: DataFrame, render: Render, dpi: int = DPI) -> DataFrame:
    """(path, page_number, image, error) of the wanted pages of files. A page that can't be rendered, or that the file doesn't have, has a null image and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, numbers in zip(b["path"], b["content"], b["numbers"]):
                for n in sorted(int(x) for x in numbers):
                    try:
                        if n < 1:
                            raise IndexError(f"no page {n}")
                        rows.append((path, n, bytes(render(bytes(content), n, dpi)), None))
                    except Exception as e:  # noqa: BLE001 - whatever a renderer raises is about this page
                        rows.append((path, n, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "image", "error"])

    numbers = wanted.groupBy("path").agg(F.collect_set("page_number").alias("numbers"))  # those of one file
    return files.select("path", "content").join(numbers, "path").mapInPandas(run, "path string, page_number int, image binary, error string")


def extracted(files: DataFrame, parse: Parse, render: Render, read: Read, keep: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> Extracted:
    """Text of every page of files (path, content): its own where there is enough, else the best reading of its image.

    keep: what writes a table and reads it back; readings are costly, so the rounds are
    kept where it is given. A file that can't be parsed has one page of status failed.
    """
    parsed = keep(io.parsed(files, parse), "parsed")
    failed = parsed.where(F.col("extraction_method") == "failed").select("path", "page_number", F.lit("failed").alias("status"), F.lit(False).alias("retried"))
    rows = parsed.where(~F.col("extraction_method").eqNullSafe(F.lit("failed"))).withColumn("clean", t.cleaned(F.col("text"))).withColumn("good", ocr.native_sufficient(F.col("text")))
    native = rows.where("good").select(*KEYS, F.col("clean").alias("text"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("issues"), F.lit(ocr.METHODS[0]).alias("extraction_method"), F.lit(False).alias("retried"))
    drawn = keep(rendered(files, rows.where("not good").select(*KEYS), render), "rendered")
    first = keep(ocr.attempts(drawn.where("image is not null"), reader(read), PRIMARY, KEYS), "first")
    found = ocr.best(first, KEYS)
    poor = found.where((F.col("confidence") < q.LOW_CONFIDENCE) | (F.length("text") < q.MIN_CHARS)).select(*KEYS)
    second = keep(ocr.attempts(drawn.join(poor, KEYS, "left_semi"), reader(read), RETRY, KEYS), "second")
    chosen = ocr.chosen(first, second, KEYS).select(*native.columns)
    unseen = drawn.where("image is null").select(*KEYS, F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.array(F.lit("ocr_failed")).alias("issues"), F.lit(ocr.METHODS[1]).alias("extraction_method"), F.lit(False).alias("retried"))
    every = native.unionByName(chosen).unionByName(unseen)
    status = F.when(F.col("text") == "", "empty").when(F.col("confidence") < q.LOW_CONFIDENCE, "low").otherwise("successful")
    report = every.select(*KEYS, status.alias("status"), "retried").unionByName(failed)
    final = F.when(F.col("extraction_method") == ocr.METHODS[0], F.col("text")).otherwise(t.cleaned(t.ocr_normalized(F.col("text"))))
    return Extracted(every.withColumn("text", final).where("text <> ''").drop("retried"), report)


def page_lists(report: DataFrame) -> DataFrame:
    """(path, low, empty, retried, missing): the page numbers of each file, in order; missing are those between 1 and the last that have no page."""
    numbers = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("page_number"))))
    out = report.groupBy("path").agg(numbers(F.col("status") == "low").alias("low"), numbers(F.col("status") == "empty").alias("empty"), numbers(F.col("retried")).alias("retried"), numbers(F.col("page_number").isNotNull()).alias("all"))
    last = F.coalesce(F.array_max("all"), F.lit(0))
    missing = F.when(last > 0, F.array_except(F.sequence(F.lit(1), last), "all")).otherwise(F.array().cast("array<int>"))
    return out.select("path", "low", "empty", "retried", missing.alias("missing"))


def stem(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def chunked(pages: DataFrame, metadata: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """(parents, children) of pages (path, page_number, text, extraction_method) whose files have metadata of the same stem."""
    rows = pages.withColumn(key, stem(F.col("path"))).join(metadata.select(key, "document_id"), key)
    parents = sections.parents(rows.select("document_id", "page_number", "text"))
    return parents, chunking.children(parents)


def ingested(files: DataFrame, metadata: DataFrame, parse: Parse, render: Render, read: Read, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[Extracted, DataFrame, DataFrame, lexical.Index]:
    """(pages and report, parents, children, lexical index of the children) of all files with metadata."""
    found = extracted(files, parse, render, read, keep)
    parents, children = (keep(d, n) for d, n in zip(chunked(found.pages, metadata), ("parents", "children")))
    return found, parents, children, lexical.index(children, "chunk_id", "page_content", keep)
