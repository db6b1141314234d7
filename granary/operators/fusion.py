"""Fusion of ranked lists, expansion to parents, and removal of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import quality as q
from granary.functions import text as t

RRF_K, TOP = 60, 20


def reciprocal_rank(lists: list[DataFrame], top: int = TOP, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(query, key, score, rank) of lists (query, key, rank): the sum of 1 / (60 + rank). Rows without a key count in no list but keep their rank; ties go to the earlier list, then the better rank."""
    rows = None
    for n, one in enumerate(lists):
        part = one.select(query, key, "rank", F.lit(n).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.nullif(F.col(key).cast("string"), F.lit("")).isNotNull())
    fused = rows.groupBy(query, key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    best = Window.partitionBy(query).orderBy(F.round("score", 12).desc(), "first", key)
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("first")


def expanded(hits: DataFrame, parents: DataFrame, query: str = "query_id", parent: str = "parent_id", rank: str = "rank") -> DataFrame:
    """Distinct parents of each query's hits with the position of their first child. Hits without a parent id are skipped; of a parent given twice the last content wins."""
    first = hits.where(F.col(parent).isNotNull()).groupBy(query, parent).agg(F.min(rank).alias("first"))
    order = Window.partitionBy(query).orderBy("first", parent)
    return first.join(parents, parent).withColumn("position", F.row_number().over(order)).drop("first")


def parent_of(df: DataFrame, parent: Column | str, key: str = "parent_id") -> DataFrame:
    """The rows of one parent id, or none. The filter reaches the files where df is read from them."""
    return df.where(F.col(key) == parent)


def first_of(df: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """The first row, in order, of each group of equal keys. Each task keeps only its own first of a group before the shuffle, so no group is gathered."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(best)).where("__at = 1").drop("__at")


def identity(c: Column) -> list[Column]:
    """128 bits that stand for a text, so that texts needn't move to be compared."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def without_duplicates(df: DataFrame, order: str, file: str = "file_name", page: str = "page", content: str = "page_content", within: list[str] | None = None) -> DataFrame:
    """The first of rows with equal file, page and normalised content."""
    return first_of(df, [*(F.col(c) for c in within or []), F.coalesce(F.col(file), F.lit("")), F.coalesce(F.col(page).cast("string"), F.lit("")), *identity(t.normalized(F.col(content)))], [order])


def controlled(df: DataFrame, order: str, content: str = "page_content", within: list[str] | None = None) -> DataFrame:
    """Rows with enough content, the first of each normalised content. Texts without a letter a to z or digit are all the same to this rule, as none of them is left of them."""
    kept = df.where(F.length(t.strip(t.text(F.col(content)))) >= q.MIN_CONTENT_CHARS)
    return first_of(kept, [*(F.col(c) for c in within or []), *identity(t.normalized(F.col(content)))], [order])


def combined(chunks: DataFrame, parents: DataFrame, most: int = 15, query: str = "query_id", position: str = "position") -> DataFrame:
    """Chunks and then parents, the first of each kind and id, by their fused score; parents have none and come last."""
    kinds = [d.withColumn("__kind", F.lit(n)).withColumn("__ord", F.col(position)) for n, d in enumerate((chunks, parents))]
    rows = kinds[0].unionByName(kinds[1], allowMissingColumns=True)
    content = F.substring(t.text(F.col("page_content")), 1, 200)
    own = [t.filled(F.col(c)) for c in ("chunk_id", "parent_id") if c in rows.columns]
    ident = F.when(F.col("__kind") == 0, F.coalesce(*own, content)).otherwise(F.coalesce(*reversed(own), content))
    rows = first_of(rows, [F.col(query), F.col("__kind"), ident], ["__ord"])
    score = F.coalesce(F.col("score"), F.lit(0.0)) if "score" in rows.columns else F.lit(0.0)
    order = Window.partitionBy(query).orderBy(score.desc(), "__kind", "__ord")
    return rows.withColumn(position, F.row_number().over(order)).where(F.col(position) <= most).drop("__kind", "__ord")
