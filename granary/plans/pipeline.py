"""From questions to grounded answers, many questions in one plan.

rewrite -> scheme -> variants -> retrieval -> deduplication -> scheme first ->
rerank -> boost -> threshold -> control -> context -> answer. Every window is
partitioned by query. Models are passed in: a scorer as a function of columns, the
embedder as one of a column of texts, the language model as a function of prompts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import quality as q
from granary.functions import text as t
from granary.operators import context, fusion, lexical, memory, rerank, router, vector
from granary.runtime import stored

Model = Callable[[list[str]], list[str]]
Embed = Callable[[Column], Column]
NO_QUESTION = "Please enter a question."
NOT_FOUND = "The available documents hold nothing that answers this question."
NO_ANSWER = "The available documents don't allow a reliable answer."


@dataclass
class Settings:
    """How a question is answered. from_environment() reads the numbers of results from TOP_K_DENSE and TOP_K_RERANK."""

    retrieved: int = 20
    variants: int = 3
    reranked: int = 5
    least_documents: int = 1
    years: str = "actual"
    scorer: rerank.Scorer = rerank.overlap
    extra_variants: dict[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def from_environment(cls, environ: Mapping[str, str] = os.environ, **other: object) -> Settings:
        names = {"retrieved": "TOP_K_DENSE", "reranked": "TOP_K_RERANK"}
        return cls(**{k: int(environ[n]) for k, n in names.items() if environ.get(n)}, **other)


def single(model: Model, prompt: str) -> str | None:
    try:
        return list(model([prompt]))[0]
    except Exception:  # noqa: BLE001 - the question goes on without this reply
        return None


def called(df: DataFrame, model: Model, prompt: str, out: str) -> DataFrame:
    """df with the model's replies to a column of prompts, a batch at a time. A batch that fails is asked again row by row; a reply that fails is null."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b[prompt].tolist()
            try:
                replies = list(model(asked))
                if len(replies) != len(asked):
                    raise ValueError("a reply for each prompt")
            except Exception:  # noqa: BLE001 - whatever the model raises is about some prompt of the batch
                replies = [single(model, p) for p in asked]
            b[out] = pd.Series(replies, index=b.index, dtype="object")
            yield b

    return df.mapInPandas(run, schema)


def standalone(questions: DataFrame, model: Model | None, text: str = "question", past: str = "history") -> DataFrame:
    """questions with standalone_question: the model's rewriting where there is a history and a reply, else the question."""
    if model is None or past not in questions.columns:
        return questions.withColumn("standalone_question", F.col(text))
    asked = questions.withColumn("__prompt", context.rewrite_prompt(F.col(text), F.col(past)))
    need = t.text(F.col(past)) != ""
    made = called(asked.where(need), model, "__prompt", "__reply").unionByName(asked.where(~need).withColumn("__reply", F.lit(None).cast("string")))
    return made.withColumn("standalone_question", F.coalesce(F.nullif(t.strip(F.col("__reply")), F.lit("")), F.col(text))).drop("__prompt", "__reply")


def retrieved(questions: DataFrame, documents: DataFrame, index: lexical.Index | None, registry: DataFrame, s: Settings, vectors: DataFrame | None = None, embed: Embed | None = None) -> DataFrame:
    """(query_id, position, doc, scheme_match, ...): base and variant results, the first of each duplicate, the scheme's documents first.

    With vectors (doc, embedding) and embed both kinds of results are the nearest vectors of the question and its variants, else the best by BM25.
    """
    asked = router.detected(questions.select("query_id", F.col("standalone_question").alias("question")), registry)
    every = router.variants(F.col("question"), F.col("scheme_key"), F.col("scheme_name"), s.years, s.extra_variants)
    several = F.when(router.fact(F.col("question")), F.slice(every, 1, s.variants + 1)).otherwise(F.array("question"))
    single = asked.select("query_id", F.posexplode(several).alias("branch", "question")).withColumn("part", F.concat_ws("/", F.col("query_id").cast("string"), F.col("branch").cast("string")))
    if vectors is None:
        hits = lexical.search(index, single, s.retrieved, query="part")
    else:
        hits = vector.nearest(vectors, stored(single.select("part", embed(F.col("question")).alias("embedding")), "asked"), s.retrieved, key="doc", query="part")
    hits = hits.join(single.select("part", "query_id", "branch"), "part")
    order = Window.partitionBy("query_id").orderBy("branch", "rank")
    hits = hits.withColumn("position", F.row_number().over(order))
    rows = hits.select("query_id", "doc", "position").join(documents, "doc")
    rows = fusion.without_duplicates(rows, "position", within=["query_id"])
    rows = rows.join(asked.select("query_id", "question", "scheme_key", "scheme_name", F.col("file_name").alias("scheme_file")), "query_id")
    rows = rows.withColumn("scheme_match", router.of_scheme(F.col("scheme_file"), F.col("file_name"), F.col("source")))
    return router.prioritized(rows)


def selected(rows: DataFrame, s: Settings) -> DataFrame:
    """The documents that an answer may use: reranked, boosted, relevant, distinct, and numbered anew."""
    rows = rerank.boosted(rerank.reranked(rows, s.scorer, s.reranked), years=s.years)
    rows = rows.where(q.relevant(F.col("rerank_score"), F.col("effective_rerank_score")))
    rows = fusion.controlled(rows, "position", within=["query_id"])
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))


def ask(questions: DataFrame, documents: DataFrame, registry: DataFrame, model: Model | None = None, settings: Settings | None = None, index: lexical.Index | None = None, vectors: DataFrame | None = None, embed: Embed | None = None) -> DataFrame:
    """(query_id, question, standalone_question, answer, context, sources, scheme, documents) of each question.

    scheme: the scheme that was found, or null. documents: the ids and scores of what the answer may use, in order.

    questions: query_id, question and perhaps history. documents: doc, page_content,
    file_name, source, page, content_type. Without a model the answer is the context's
    prompt. Empty questions and those without documents get a fixed answer. vectors
    (doc, embedding) with embed, by which they were made: documents are retrieved by
    them; without both they are retrieved by BM25.
    """
    if (vectors is None) != (embed is None):
        raise ValueError("vectors and embed belong together")
    s = settings or Settings()
    index = index or (lexical.index(documents, "doc", "page_content") if vectors is None else None)
    questions = standalone(questions.withColumn("question", t.strip(t.text(F.col("question")))), model)
    rows = selected(retrieved(questions.where("standalone_question <> ''"), documents, index, registry, s, vectors, embed), s)
    cited = rows.select("query_id", F.struct(
        "position", context.formatted(rows.columns, F.col("position")).alias("block"), context.chain(rows.columns, context.FILE_NAMES).alias("file_name"),
        context.chain(rows.columns, context.PAGES).alias("page"), context.chain(rows.columns, context.TYPES).alias("content_type"), "rerank_score", "doc",
    ).alias("item"))
    # One group holds the few documents of one answer.
    items = cited.groupBy("query_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    most = F.slice("items", 1, context.MAX_DOCUMENTS)
    again = lambda x: F.exists("items", lambda y: (y["position"] < x["position"]) & (y["file_name"] == x["file_name"]) & (y["page"] == x["page"]))
    items = items.select(
        "query_id", F.size("items").alias("documents"), F.concat(F.lit("\n\n"), F.array_join(F.transform(most, lambda x: x["block"]), "\n\n")).alias("context"),
        F.transform(F.filter(F.slice("items", 1, context.MAX_SOURCES), lambda x: ~again(x)), lambda x: x.dropFields("position", "block", "doc")).alias("sources"),
        F.transform("items", lambda x: F.struct(x["doc"].alias("doc"), x["rerank_score"].alias("rerank_score"))).alias("found"),
    )
    schemes = router.detected(questions.select("query_id", F.col("standalone_question").alias("question")), registry)
    schemes = schemes.select("query_id", F.when(F.col("scheme_key").isNotNull(), F.struct(F.col("scheme_key").alias("key"), F.col("scheme_name").alias("name"), "file_name", "matched_alias")).alias("scheme"))
    out = questions.join(items, "query_id", "left").join(schemes, "query_id", "left")
    enough = F.coalesce("documents", F.lit(0)) >= s.least_documents
    out = out.withColumn("prompt", F.when(enough, context.answer_prompt(F.col("question"), F.col("context"))))
    if model is None:
        out = out.withColumn("reply", F.col("prompt"))
    else:
        out = called(out.where("prompt is not null"), model, "prompt", "reply").unionByName(out.where("prompt is null").withColumn("reply", F.lit(None).cast("string")))
    reply = F.coalesce(F.nullif(t.strip(F.col("reply")), F.lit("")), F.lit(NO_ANSWER))
    answer = F.when(F.col("question") == "", NO_QUESTION).when(F.col("prompt").isNull(), NOT_FOUND).otherwise(reply)
    return out.select("query_id", "question", "standalone_question", answer.alias("answer"), "context", "sources", "scheme", F.col("found").alias("documents"))


def remembered(messages: DataFrame, answers: DataFrame, sessions: DataFrame, turns: int = memory.MAX_TURNS) -> DataFrame:
    """messages after each answered question was saved as a turn of its session. sessions: query_id, session_id. Empty questions are not saved."""
    kept = answers.where("question <> ''").join(sessions.select("query_id", "session_id"), "query_id")
    return memory.with_turn(messages, kept.select("session_id", "question", "answer"), turns)


def hybrid(queries: DataFrame, index: lexical.Index, vectors: DataFrame, asked: DataFrame, k: int = 30, top: int = fusion.TOP, allowed: lexical.Scope | None = None) -> DataFrame:
    """(query_id, doc, score, rank): lexical and vector results fused. The state filter comes before the cut of the lexical list and after that of the vectors."""
    dense = vector.nearest(vectors, asked, k).select("query_id", F.col("vec_id").alias("doc"), "rank")
    words = lexical.search(index, queries, k, allowed=allowed).select("query_id", "doc", "rank")
    if allowed is not None:
        dense = allowed.kept(dense, "query_id")
        dense = dense.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return fusion.reciprocal_rank([dense, words], top, key="doc")
