"""Chunks of documents and children of parents.

Only the recursive split is iterative and runs in an Arrow UDF, on the rows that
need it; everything else is expressions. A row's chunks are one array, so order
and numbering need no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as t

CHUNK_SIZE, CHUNK_OVERLAP, WHOLE = 800, 120, 900
CHILD_SIZE, CHILD_OVERLAP = 1800, 250
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")
CHILD_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# Kinds of content that are never split.
INTACT = ("activity", "cost_norm", "heading")


def merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts in order, packed up to size; the end of one chunk within overlap begins the next."""
    out, held, length = [], [], 0
    for p in parts:
        if held and length + len(p) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    out.append("".join(held).strip())
    return [c for c in out if c]


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Cut at the first separator that occurs, which stays at the start of a part; parts above size are cut at the next ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        first, *others = text.split(sep)
        parts = [p for p in (first, *(sep + o for o in others)) if p]
    else:
        parts = list(text)
    out, small = [], []
    for p in parts:
        if len(p) < size:
            small.append(p)
            continue
        if small:
            out += merged(small, size, overlap)
            small = []
        out += recursive_split(p, size, overlap, rest) if rest else [p]
    return out + (merged(small, size, overlap) if small else [])


@lru_cache
def splitter(size: int, overlap: int, separators: tuple[str, ...]):  # noqa: ANN201
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda s: recursive_split(s, size, overlap, separators) if s else [])

    return run


def packed_lines(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Lines packed in order; each counts one more for its break."""
    lines = F.filter(F.transform(t.lines(text), t.strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + F.length(s) + 1 > size)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["held"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), s).otherwise(F.concat(acc["held"], F.lit("\n"), s)).alias("held"),
            (F.when(full, 0).otherwise(acc["n"]) + F.length(s) + 1).alias("n"),
        )

    return F.aggregate(lines, start, add, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["held"])).otherwise(acc["done"]))


def chunks(df: DataFrame, text: str = "page_content", kind: str = "content_type") -> DataFrame:
    """df with text replaced by its chunks, chunk_index and total_chunks; one row a chunk.

    Atomic kinds stay whole, tables are packed by lines, lists and the rest are split
    recursively when long. Blank texts of a kind that can be split have no chunks.
    """
    body, kinds = t.strip(F.col(text)), F.coalesce(F.col(kind), F.lit("other"))
    whole = F.array(body)
    blank = F.array().cast("array<string>")
    split = splitter(CHUNK_SIZE, CHUNK_OVERLAP, SEPARATORS)(F.when(F.length(body) > WHOLE, body))
    by_text = F.when(F.coalesce(body, F.lit("")) == "", blank).when((F.length(body) <= WHOLE) | (F.size(split) <= 0), whole).otherwise(split)
    lines = packed_lines(body)
    by_line = F.when(F.coalesce(body, F.lit("")) == "", blank).when(F.length(body) <= CHUNK_SIZE, whole).when(F.size(lines) > 1, lines).otherwise(by_text)
    chosen = F.when(kinds.isin(*INTACT) | ((kinds == "list") & (F.length(text) <= CHUNK_SIZE)), whole).when(kinds == "table", by_line).otherwise(by_text)
    rows = df.withColumn("__chunks", chosen)
    return rows.select(*[c for c in df.columns if c != text], F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("chunk_index", text))


def children(parents: DataFrame, text: str = "page_content", parent: str = "parent_id", size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Child chunks of parents with their ids; the parents' other columns are kept."""
    rows = parents.withColumn("__children", splitter(size, overlap, CHILD_SEPARATORS)(F.col(text)))
    kept = [c for c in parents.columns if c not in (text, "chunk_type", "chunk_id", "chunk_index")]
    rows = rows.select(*kept, F.posexplode("__children").alias("chunk_index", text))
    return rows.withColumn("chunk_id", t.short_id(F.concat_ws("_child_", F.col(parent), F.col("chunk_index").cast("string")))).withColumn("chunk_type", F.lit("child"))


def histogram(df: DataFrame, kind: str = "content_type") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias(kind)).agg(F.count(F.lit(1)).alias("n"))


def lengths(df: DataFrame, text: str = "page_content") -> DataFrame:
    size = F.length(text)
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.round(F.avg(size), 6).alias("mean"))


def unmatched(inputs: DataFrame, made: DataFrame, keys: list[str], text: str = "page_content") -> DataFrame:
    """Atomic inputs that don't have exactly one chunk equal on keys and trimmed text, with the number they have."""
    left = inputs.select(*keys, t.strip(F.col(text)).alias("body"))
    found = made.select(*keys, t.strip(F.col(text)).alias("body")).groupBy(*keys, "body").agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "body"]]
    rows = left.alias("l").join(found.alias("r"), same, "left")
    return rows.select(*(F.col(f"l.{k}") for k in [*keys, "body"]), F.coalesce("r.n", F.lit(0)).alias("n")).where("n <> 1")
