"""Tables in the text of a page: runs of table-like lines, their rows, confidence and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import extract as x
from granary.functions import text as t

LONG_LINE, LOW, MEDIUM = 300, 0.6, 0.8
# The wording of notes.
NO_LINES = "No raw table lines detected."
NO_ROWS = "No semantic rows could be reconstructed."
ONE_LINE = "Only one table-like OCR line detected; table structure may be incomplete."
DETECTED = {
    "markers": "Detected {n} numbered table-row markers.", "money": "Detected {n} financial value(s).",
    "percent": "Detected {n} percentage value(s).", "capacity": "Detected {n} capacity value(s).",
}
LONG_LINES = "One or more OCR lines are very long. Possible multi-column OCR interleaving detected."
LOW_NOTE = "Low normalization confidence. Do not rely on reconstructed column relationships without validation."
MEDIUM_NOTE = "Medium normalization confidence. Review reconstructed rows before production ingestion."
HIGH_NOTE = "High heuristic confidence."


def blocks(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, table_number, raw_lines): runs of at least two table-like lines. Any other line, a blank one too, ends a run."""
    rows = pages.select(*keys, F.posexplode(t.lines(F.col(text))).alias("pos", "raw")).withColumn("line", t.table_line(F.col("raw")))
    rows = rows.withColumn("tabular", (F.col("line") != "") & x.table_like(F.col("line")))
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("island", F.sum((~F.col("tabular")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("tabular")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"])
    runs = rows.groupBy(*keys, "island").agg(lines.alias("raw_lines")).where(F.size("raw_lines") >= 2)
    return runs.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("island")).alias("table_number"), "raw_lines")


def reconstructed(lines: Column) -> Column:
    """Semantic rows of raw lines; a line with several markers holds several rows."""
    parts = F.flatten(F.transform(lines, lambda s: x.roman_rows(t.squeezed(s))))
    return F.filter(F.transform(F.filter(F.transform(parts, t.squeezed), lambda s: s != ""), x.semantic_row), lambda s: s != "")


def total(lines: Column, count) -> Column:  # noqa: ANN001
    return F.aggregate(lines, F.lit(0), lambda acc, s: acc + count(s))


def counts(lines: Column) -> dict[str, Column]:
    return {
        "markers": total(lines, lambda s: F.regexp_count(s, F.lit(x.MARKER))),
        "money": total(lines, lambda s: F.size(x.money(s))),
        "percent": total(lines, lambda s: F.size(x.percentages(s))),
        "capacity": total(lines, lambda s: F.size(x.capacities(s))),
    }


def confidence(lines: Column, rows: Column, n: dict[str, Column]) -> Column:
    """Sum of the signs of a table, at most 1."""
    points = [
        (F.size(lines) >= 2, 0.20), (F.size(rows) > 0, 0.20), (n["markers"] >= 2, 0.20), (n["money"] >= 1, 0.15),
        (n["percent"] >= 1, 0.10), (n["capacity"] >= 1, 0.10), (F.exists(lines, lambda s: s.rlike(r"[|\t]")), 0.05),
    ]
    score = sum((F.when(c, F.lit(p)).otherwise(0.0) for c, p in points), F.lit(0.0))
    return F.when(F.size(lines) > 0, F.round(F.least(score, F.lit(1.0)), 2)).otherwise(0.0)


def notes(lines: Column, rows: Column, score: Column, n: dict[str, Column]) -> Column:
    said = (F.when(n[k] >= (2 if k == "markers" else 1), F.replace(F.lit(note), F.lit("{n}"), n[k].cast("string"))) for k, note in DETECTED.items())
    return F.array_compact(F.array(
        F.when(F.size(lines) == 0, NO_LINES), F.when(F.size(rows) == 0, NO_ROWS), F.when(F.size(lines) == 1, ONE_LINE), *said,
        F.when(F.exists(lines, lambda s: F.length(s) > LONG_LINE), LONG_LINES), F.when(score < LOW, LOW_NOTE).when(score < MEDIUM, MEDIUM_NOTE).otherwise(HIGH_NOTE),
    ))


def tables(pages: DataFrame, keys: list[str], page: str = "page_number", text: str = "text") -> DataFrame:
    """keys, table_number, table_id, raw_lines, rows, confidence, notes and rag_text of every table of every page."""
    found = blocks(pages, keys, text).withColumn("rows", reconstructed(F.col("raw_lines")))
    n = counts(F.col("raw_lines"))
    found = found.withColumns({f"__{k}": v for k, v in n.items()})
    n = {k: F.col(f"__{k}") for k in n}
    found = found.withColumn("confidence", confidence(F.col("raw_lines"), F.col("rows"), n))
    found = found.withColumn("notes", notes(F.col("raw_lines"), F.col("rows"), F.col("confidence"), n))
    ident = F.concat(F.lit("page_"), F.col(page).cast("string"), F.lit("_table_"), F.col("table_number").cast("string"))
    numbered = F.transform("rows", lambda s, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), s))
    body = F.when(F.size("rows") > 0, F.concat(F.array(F.lit("Rows:")), numbered)).otherwise(F.concat(F.array(F.lit("Original OCR:")), F.col("raw_lines")))
    head = F.array(F.concat(F.lit("Table: "), F.col("table_id")), F.concat(F.lit("Page: "), F.col(page).cast("string")))
    return found.withColumn("table_id", ident).withColumn("rag_text", F.array_join(F.concat(head, body), "\n")).select(*keys, "table_number", "table_id", "raw_lines", "rows", "confidence", "notes", "rag_text")
