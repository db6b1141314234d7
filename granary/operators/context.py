"""Context blocks, citations, prompts and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as t
from granary.operators import router

MAX_DOCUMENTS, MAX_SOURCES = 5, 5
UNKNOWN = "unknown"
NO_HISTORY = "No previous conversation."
FILE_NAMES, PAGES, TYPES = ("file_name", "source", "filename", "file"), ("page", "page_number", "page_no"), ("content_type", "type")

REWRITE_TEMPLATE = """Make the last question understandable without the conversation. Put names in place of pronouns, keep scheme names as they are, add nothing and don't answer. Reply with the question only.

Conversation:
{history}

Question: {question}
Standalone question:"""
ANSWER_TEMPLATE = """Answer from the sources below and from nothing else. If they don't hold the answer, say so. Be brief, keep units, and don't mention how the sources were found.
{facts}
Sources:
{context}

Question: {question}
Answer:"""
FACT_NOTE = """The question asks for a value. Give it only if one source states it for the very thing and period that the question names; never join a number of one statement with the subject of another.
"""


def chain(columns: list[str], names: tuple[str, ...]) -> Column:
    """The first of the named columns that is there and has a value; zero and empty count as none."""
    own = [F.nullif(F.nullif(F.col(n).cast("string"), F.lit("")), F.lit("0")) for n in names if n in columns]
    return F.coalesce(*own, F.lit(UNKNOWN))


def formatted(columns: list[str], position: Column, content: str = "page_content") -> Column:
    """A document as a numbered block of the context."""
    match = F.coalesce(F.col("scheme_match"), F.lit(False)) if "scheme_match" in columns else F.lit(False)
    score = F.when(F.col("rerank_score").isNotNull(), F.concat(F.lit("Rerank Score: "), F.col("rerank_score").cast("string"), F.lit("\n"))) if "rerank_score" in columns else F.lit(None)
    return F.concat(
        F.lit("[SOURCE "), position.cast("string"), F.lit("]\nFile: "), chain(columns, FILE_NAMES), F.lit("\nPage: "), chain(columns, PAGES),
        F.lit("\nContent Type: "), chain(columns, TYPES), F.lit("\nScheme Match: "), F.initcap(match.cast("string")), F.lit("\n"), t.text(score.cast("string")), F.lit("\nContent:\n"), t.text(F.col(content)),
    )


def contexts(df: DataFrame, query: str = "query_id", position: str = "position", most: int = MAX_DOCUMENTS) -> DataFrame:
    """(query, context): the first documents of each query as one text."""
    block = F.struct(F.col(position).alias("at"), formatted(df.columns, F.col(position)).alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n\n")
    return df.where(F.col(position) <= most).groupBy(query).agg(F.concat(F.lit("\n\n"), joined).alias("context"))


def references(df: DataFrame, query: str = "query_id", position: str = "position", most: int = MAX_SOURCES) -> DataFrame:
    """Citations: of each query's first documents, the first of each file and page."""
    rows = df.where(F.col(position) <= most).select(query, position, chain(df.columns, FILE_NAMES).alias("file_name"), chain(df.columns, PAGES).alias("page"), chain(df.columns, TYPES).alias("content_type"), *(["rerank_score"] if "rerank_score" in df.columns else []))
    first = Window.partitionBy(query, "file_name", "page").orderBy(position)
    return rows.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")


def role_line(message: Column, unknown: bool) -> Column:
    other = F.concat(message["role"], F.lit(": "), message["content"])
    return F.when(message["role"] == "user", F.concat(F.lit("User: "), message["content"])).when(message["role"] == "assistant", F.concat(F.lit("Assistant: "), message["content"])).when(F.lit(unknown), other)


def history(messages: Column, unknown: bool = True) -> Column:
    """Messages (role, content) as lines; other roles are named, or left out without unknown."""
    return F.array_join(F.array_compact(F.transform(messages, lambda m: role_line(m, unknown))), "\n")


def filled_in(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), t.text(value))
    return out


def rewrite_prompt(question: Column, past: Column, template: str = REWRITE_TEMPLATE) -> Column:
    return filled_in(template, history=past, question=question)


def answer_prompt(question: Column, context: Column, template: str = ANSWER_TEMPLATE) -> Column:
    return filled_in(template, facts=F.when(router.fact_prompt(question), F.lit(FACT_NOTE)), question=question, context=context)
