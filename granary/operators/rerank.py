"""Reranking with a scorer that is passed in, boosts for questions after facts, and the cut."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as t
from granary.operators import router
from granary.operators.fusion import first_of

TOP, CANDIDATES, LEGACY_TOP = 5, 15, 8
SCHEME_BOOST, YEAR_BOOST, KEYWORD_BOOST = 0.2, 0.1, 0.05
Scorer = Callable[[Column, Column], Column]


def overlap(question: Column, content: Column) -> Column:
    """The scorer used where no model is passed in: the share of the question's words in the content."""
    asked = F.array_distinct(t.tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, t.tokens(content))) / F.size(asked)).otherwise(0.0)


def modelled(score: Callable[[list[tuple[str, str]]], list[float]]) -> Scorer:
    """A scorer out of a model that scores pairs of question and text, a batch at a time."""

    @F.pandas_udf(T.DoubleType())
    def run(question: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(question.fillna(""), content.fillna("")))), dtype="float64")

    return run


def reranked(df: DataFrame, scorer: Scorer = overlap, top: int = TOP, query: str = "query_id", question: str = "question", content: str = "page_content", position: str = "position") -> DataFrame:
    """The top rows of each query by score; ties keep their order."""
    if top <= 0:
        raise ValueError("top must be positive")
    scored = df.withColumn("rerank_score", scorer(F.col(question), F.col(content)))
    best = Window.partitionBy(query).orderBy(F.col("rerank_score").desc(), position)
    return scored.withColumn(position, F.row_number().over(best)).where(F.col(position) <= top)


def reranked_candidates(df: DataFrame, scorer: Scorer = overlap, top: int = LEGACY_TOP, candidates: int = CANDIDATES, query: str = "query_id", position: str = "position", **names: str) -> DataFrame:
    """The same on the first candidates only, after removing repeated chunks, parents or beginnings."""
    content = names.get("content", "page_content")
    ident = F.coalesce(t.filled(F.col("chunk_id")), t.filled(F.col("parent_id")), F.substring(F.col(content), 1, 200))
    rows = first_of(df, [F.col(query), ident], [position])
    order = Window.partitionBy(query).orderBy(position)
    rows = rows.withColumn(position, F.row_number().over(order)).where(F.col(position) <= candidates)
    return reranked(rows, scorer, top, query, position=position, **names)


def boosted(df: DataFrame, query: str = "query_id", question: str = "question", content: str = "page_content", position: str = "position", years: str = "actual") -> DataFrame:
    """effective_rerank_score of each row and the order by it. Only questions after facts are boosted: for the scheme's documents, for a year asked for, and for words of facts."""
    asks, body = router.fact(F.col(question)), t.normalized(F.col(content))
    wanted = F.regexp_extract_all(t.normalized(F.col(question)), F.lit(router.YEARS[years]), 1)
    packed = F.replace(body, F.lit(" "), F.lit(""))
    dated = F.exists(wanted, lambda y: F.contains(body, y) | F.contains(packed, F.replace(y, F.lit(" "), F.lit(""))))
    terms = F.size(F.filter(F.array(*map(F.lit, router.CONTENT_TERMS)), lambda w: F.contains(body, w)))
    base = F.coalesce(F.col("rerank_score").try_cast("double"), F.lit(0.0))
    boost = F.when(F.coalesce(F.col("scheme_match"), F.lit(False)), SCHEME_BOOST).otherwise(0.0) + F.when(dated, YEAR_BOOST).otherwise(0.0) + F.when(terms > 0, KEYWORD_BOOST).otherwise(0.0)
    rows = df.withColumns({
        "fact_year_boost": F.when(asks, F.round(boost, 6)), "year_match": F.when(asks, dated), "fact_keyword_matches": F.when(asks, terms),
        "effective_rerank_score": F.when(asks, F.round(base + boost, 6)),
    })
    order = Window.partitionBy(query).orderBy(F.coalesce("effective_rerank_score", F.lit(0.0)).desc(), position)
    return rows.withColumn(position, F.when(F.col("effective_rerank_score").isNull(), F.col(position)).otherwise(F.row_number().over(order)))
