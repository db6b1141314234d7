"""One query for each operator or small group of operators, over the whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import extract as x
from granary.functions import quality as q
from granary.functions import text as t
from granary.operators import chunking, context, diagnostics, documents, fusion, images, lexical, memory, ocr, rerank, router, sections, tables, vector
from granary.plans import ingestion, pipeline
from granary.plans.oracle import ORACLES
from granary.runtime import fingerprint, shared_dir, ship, stored, table
from granary.sources import io

Query = Callable[[SparkSession, str], DataFrame]
NAMES: dict[str, Query] = {}
K = 10


def query(run: Query) -> Query:
    NAMES[run.__name__] = run
    return run


def joined(c: str | F.Column) -> F.Column:
    """Arrays as text, so that results compare alike everywhere."""
    return F.array_join(c, " ; ")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without the rows that were loaded twice. Keyed by chunk, so columns that a query doesn't use are neither read nor moved."""
    return table(spark, d, "scheme_chunks").drop("loaded_at").dropDuplicates(["chunk_id"])


def activities(spark: SparkSession, d: str) -> DataFrame:
    """The latest reading of each activity."""
    return fusion.first_of(table(spark, d, "aif_activities"), [F.col("activity_id")], [F.col("extracted_at").desc()])


def questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for each alias of the registry, of several kinds, and one about no scheme."""
    kind = F.col("ord") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("What is "), "alias", F.lit("?")))
        .when(kind == 1, F.concat(F.lit("How many farmers were covered under "), "alias", F.lit("?")))
        .when(kind == 2, F.concat(F.lit("Who may apply to "), "alias", F.lit(" in 2019-20?")))
        .when(kind == 3, F.concat(F.lit("Where is the desk of "), "alias", F.lit(" and which records are needed?")))
        .otherwise(F.lit("Which crops need a drying yard?"))
    )
    return table(spark, d, "scheme_registry").select(F.col("ord").cast("bigint").alias("query_id"), text.alias("question"))


def name_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scheme_registry").groupBy("scheme_key").agg(F.min("name").alias("question")).withColumnRenamed("scheme_key", "query_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.lit(1).alias("page_number"), "text")


_indexes: dict[tuple[str, str], lexical.Index] = {}


def index(spark: SparkSession, d: str) -> lexical.Index:
    """The stored index of the documents: made once in a session, and anew when their files change."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, f"{d}/documents.parquet"))
    if key not in _indexes:
        _indexes[key] = lexical.index(docs(spark, d), "doc_id", "text", stored)
    return _indexes[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"


LETTERS = ("abc", "def", "ghi", "jkl", "mno", "pqr", "stu", "vwxyz")


def letter_vector(c: F.Column) -> F.Column:
    """A stand-in for an embedder: how often each group of letters occurs."""
    return F.array(*(F.length(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{g}]", "")).cast("double") for g in LETTERS))


# Text


@query
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", t.normalized(F.col("text")).alias("normalized"))


@query
def token_stats(spark, d):
    words = t.tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(words).cast("bigint").alias("tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("distinct_tokens"))


@query
def term_statistics(spark, d):
    ix = lexical.index(docs(spark, d), "doc_id", "text")
    return ix.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@query
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", t.cleaned(F.col("text")).alias("cleaned"))


@query
def page_steps(spark, d):
    """Steps of page cleaning that are expressions: controls, spaces, hyphens, punctuation."""
    out = t.page_spaces(t.unhyphenated(t.page_spaces(t.without_controls(F.col("page_content")))))
    return chunks(spark, d).select("chunk_id", t.single_punctuation(t.punctuation_spacing(out)).alias("cleaned"))


@query
def page_cleaned(spark, d):
    return chunks(spark, d).select("chunk_id", t.page_cleaned(F.col("page_content")).alias("cleaned"))


@query
def ocr_normalized(spark, d):
    return table(spark, d, "aif_activities").select("activity_id", "extracted_at", t.ocr_normalized(F.col("text")).alias("normalized"))


@query
def line_cleaning(spark, d):
    c = F.col("text")
    return activities(spark, d).select("activity_id", t.table_line(c).alias("line"), t.squeezed(c).alias("squeezed"), t.roman_marker(F.concat(F.lit("| (("), F.coalesce("marker", F.lit("")), F.lit(") "), c)).alias("marked"))


@query
def type_names(spark, d):
    return table(spark, d, "scheme_metadata").select(t.type_name(F.col("source_organization")).alias("type_name")).where("type_name is not null").groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))


@query
def chunk_ids(spark, d):
    return chunks(spark, d).select("chunk_id", t.short_id(F.concat_ws("_", "document_id", F.col("page_number").cast("string"), "section")).alias("made_id"), t.short_id(F.concat("parent_id", F.lit("_child_0"))).alias("child_id"))


# Gates


@query
def text_quality_gate(spark, d):
    return docs(spark, d).select("doc_id", q.sufficient(t.squeezed(F.col("text"))).alias("sufficient"))


@query
def text_quality(spark, d):
    row = q.text_quality(F.col("text"), F.col("confidence"))
    return activities(spark, d).withColumn("q", row).select("activity_id", F.col("q.word_count").cast("bigint").alias("word_count"), F.col("q.text_length").cast("bigint").alias("text_length"), joined("q.issues").alias("issues"))


@query
def ocr_quality(spark, d):
    row = q.ocr_quality(F.col("text"), F.col("confidence"))
    return activities(spark, d).withColumn("q", row).select(
        "activity_id", F.col("q.character_count").cast("bigint").alias("characters"), F.col("q.word_count").cast("bigint").alias("words"), F.col("q.line_count").cast("bigint").alias("lines"),
        F.col("q.has_meaningful_text").alias("meaningful"), F.col("q.warning").alias("warning"), joined("q.issues").alias("issues"),
    )


@query
def valid_documents(spark, d):
    return chunks(spark, d).groupBy(q.long_enough(F.col("page_content")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query
def metadata_filter(spark, d):
    wanted = q.matches({"document_type": "circular", "extraction_method": "ocr", "state": None})
    return spark.read.parquet(f"{d}/scheme_chunks.parquet").where(wanted).select("chunk_id", "document_id").distinct()  # the filter reaches the files


@query
def scope_filter(spark, d):
    rows = table(spark, d, "scheme_metadata").select(F.concat_ws("@", "document_id", F.col("loaded_at").cast("string")).alias("doc"), "document_id", "applicable_scope", F.col("state").alias("own_state"))
    asked = table(spark, d, "scheme_metadata").select("state").where("state is not null").distinct().withColumn("query_id", F.lower("state"))
    return lexical.Scope(rows, asked).counts()


@query
def metadata_errors(spark, d):
    rows = chunks(spark, d).select("chunk_id", F.col("source_url").alias("source"), F.col("document_name").alias("file_name"), "document_type", F.col("image_count").alias("page"), "page_number", "section", F.lit("paragraph").alias("content_type"), F.lit("1.2").alias("ocr_confidence"), "extraction_method", "language", "version")
    return rows.select("chunk_id", joined(q.metadata_errors(rows.columns)).alias("errors"))


@query
def document_errors(spark, d):
    rows = chunks(spark, d).select("chunk_id", "page_content", F.col("source_url").alias("source"), F.col("document_name").alias("file_name"), F.col("page_number").alias("page"), "document_type", "section", F.lit("paragraph").alias("content_type"), F.lit("p").alias("parser"), "extraction_method", F.lit(1.0).alias("ocr_confidence"))
    return rows.select("chunk_id", joined(q.missing(rows.columns, q.DOCUMENT_FIELDS, F.col("page_content"))).alias("errors")).where("errors <> ''")


@query
def embedding_validation(spark, d):
    return q.embedding_report(table(spark, d, "embeddings"), "embedding")


# Extraction


@query
def extract_values(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", joined(x.money(c)).alias("money"), joined(x.percentages(c)).alias("percentages"), joined(x.capacities(c)).alias("capacities"))


@query
def semantic_rows(spark, d):
    return table(spark, d, "aif_cost_rows").select("document", "page_number", "table_no", "item_number", "extracted_at", x.activity_name(F.concat(F.lit("(i) "), "raw_description")).alias("activity"), x.semantic_row(F.concat_ws(" ", "raw_description", "raw_cost")).alias("row"))


@query
def roman_values(spark, d):
    return activities(spark, d).select("activity_id", x.roman_value(F.regexp_replace("marker", "[()]", "")).alias("value"), joined(x.roman_rows(F.concat("text", F.lit(" (iv) and (v)"), "text"))).alias("rows"))


@query
def heading_properties(spark, d):
    rows = chunks(spark, d).select("section").union(chunks(spark, d).select("subsection")).where("section is not null").distinct()
    c = F.col("section")
    return rows.select(
        c.alias("line"), t.heading_text(c).alias("heading_text"), x.level(c).alias("level"), x.words(c).cast("int").alias("words"), x.mostly_upper(c).alias("upper"), x.bullet(c).alias("bullet"), x.sentence_like(c).alias("sentence"),
        x.heading(c).alias("heading"), x.heading_words(c).alias("known"), x.heading_and_rest(c)["rest"].alias("rest"), x.common_heading(c).alias("common"), F.round(x.letter_share(c), 6).alias("letters"),
    )


@query
def activity_documents(spark, d):
    return documents.activity_documents(activities(spark, d)).select("file_name", "page", "table_no", "activity_number", "page_content", "has_ocr_warning")


@query
def cost_documents(spark, d):
    return documents.cost_documents(table(spark, d, "aif_cost_rows")).select("file_name", "page", "table_no", "item_number", "page_content", "has_ocr_warning")


@query
def annex_text(spark, d):
    return documents.final_text(activities(spark, d), table(spark, d, "aif_cost_rows").dropDuplicates(["document", "page_number", "table_no", "item_number"]))


@query
def reading_differences(spark, d):
    """Activities whose first and last readings differ."""
    rows = table(spark, d, "aif_activities").withColumn("ord", F.lit(1))
    last = fusion.first_of(rows, [F.col("activity_id")], [F.col("extracted_at").desc()])
    first = fusion.first_of(rows, [F.col("activity_id")], [F.col("extracted_at").asc()])
    return documents.differences(last, first.withColumn("text", F.lower("text")), ["activity_id"], "ord", "text").select("activity_id", "actual", "expected")


# Sections, tables, chunks


@query
def page_sections(spark, d):
    return sections.sections(pages(spark, d), ["doc_id", "page_number"]).select("doc_id", F.col("index").cast("bigint").alias("index"), "section", "subsection", "heading", "heading_level", "text")


@query
def table_blocks(spark, d):
    return tables.blocks(pages(spark, d), ["doc_id"]).select("doc_id", F.col("table_number").cast("bigint").alias("table_number"), F.size("raw_lines").cast("bigint").alias("lines"), joined("raw_lines").alias("raw"))


@query
def page_tables(spark, d):
    rows = tables.tables(pages(spark, d), ["doc_id", "page_number"])
    return rows.select("doc_id", "table_id", joined("rows").alias("rows"), "confidence", joined("notes").alias("notes"), "rag_text")


@query
def parent_chunks(spark, d):
    return sections.parents(pages(spark, d).withColumnRenamed("doc_id", "document_id"))


@query
def child_chunks(spark, d):
    made = sections.parents(pages(spark, d).withColumnRenamed("doc_id", "document_id"))
    return chunking.children(made).select("parent_id", "chunk_id", "chunk_index", "page_content")


@query
def document_chunks(spark, d):
    kind = F.when(F.col("genre") == "note", "table").when(F.col("genre") == "faq", "list").otherwise("paragraph")
    return chunking.chunks(docs(spark, d).select("doc_id", kind.alias("content_type"), F.col("text").alias("page_content")))


@query
def chunk_errors(spark, d):
    """Chunks of annex documents that lack a field, by what they lack and whether their kind is known."""
    made = documents.documents(activities(spark, d), table(spark, d, "aif_cost_rows"))
    rows = chunking.chunks(made)
    return rows.groupBy(joined(q.missing(rows.columns, q.CHUNK_FIELDS, F.col("page_content"))).alias("errors"), q.known_type(F.col("content_type")).alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query
def annex_chunks(spark, d):
    """Atomic documents stay whole: readings of activities whose text is that of more than one chunk, as it was read again."""
    made = documents.documents(table(spark, d, "aif_activities"), table(spark, d, "aif_cost_rows"))
    keys = ["file_name", "page", "table_no", "content_type"]
    return chunking.unmatched(made.select(*keys, "page_content").distinct(), chunking.chunks(made.select(*keys, "page_content")), keys)


@query
def chunk_checks(spark, d):
    """Whether the chunks of each document keep the limit, are parts of its text in order, and hold all its words."""
    rows = docs(spark, d).select("doc_id", F.lit("paragraph").alias("content_type"), F.col("text").alias("page_content"))
    made = chunking.chunks(rows).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "page_content"))).alias("c"), F.max(F.length("page_content")).alias("longest"), F.max("total_chunks").alias("total"))
    return checked(rows, made, "doc_id", chunking.WHOLE)


@query
def child_checks(spark, d):
    """The same of the children of each parent."""
    parents = sections.parents(pages(spark, d).withColumnRenamed("doc_id", "document_id"))
    made = chunking.children(parents).groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "page_content"))).alias("c"), F.max(F.length("page_content")).alias("longest"), F.count(F.lit(1)).alias("total"))
    return checked(parents, made, "parent_id", chunking.CHILD_SIZE)


def checked(whole: DataFrame, made: DataFrame, key: str, limit: int) -> DataFrame:
    tokens = lambda c: F.array_distinct(t.tokens(c))  # noqa: E731 - a cut may part a word and the sign behind it
    held = F.array_join(F.transform("c", lambda x: x["page_content"]), " ")
    rows = whole.select(key, "page_content").join(made, key)
    return rows.select(
        key, (F.col("longest") <= limit).alias("within"), F.forall("c", lambda x: F.contains(t.strip(F.col("page_content")), x["page_content"])).alias("parts"),
        (F.size(F.array_except(tokens(F.col("page_content")), tokens(held))) == 0).alias("complete"), (F.size("c") == F.col("total")).alias("numbered"),
    )


@query
def content_histogram(spark, d):
    return chunking.histogram(chunks(spark, d), "document_type")


@query
def chunk_lengths(spark, d):
    return chunking.lengths(chunks(spark, d))


@query
def chunk_statistics(spark, d):
    return diagnostics.chunk_statistics(table(spark, d, "scheme_chunks"))


@query
def document_types(spark, d):
    return chunks(spark, d).agg(joined(F.array_sort(F.collect_set("document_type"))).alias("types"))


@query
def page_methods(spark, d):
    return diagnostics.methods(chunks(spark, d))


@query
def quality_report(spark, d):
    return diagnostics.report(diagnostics.methods(chunks(spark, d)))


@query
def full_text(spark, d):
    rows = chunks(spark, d).groupBy("document_id", "page_number").agg(F.array_join(F.array_sort(F.collect_list("page_content")), "\n").alias("text"))
    return io.full_text(rows)


@query
def page_coverage(spark, d):
    """Pages of each document that have no chunk read by OCR."""
    rows = chunks(spark, d)
    totals = rows.groupBy("document_id").agg(F.max("page_number").alias("pages"))
    return diagnostics.missing_pages(rows.where("extraction_method = 'ocr'"), "document_id", "page_number", totals)


@query
def index_consistency(spark, d):
    left = docs(spark, d).select("doc_id")
    return diagnostics.inconsistencies(left, table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("doc_id")), "doc_id")


# Readings


@query
def best_reading(spark, d):
    rows = table(spark, d, "aif_activities").withColumn("attempt", F.unix_micros(F.col("extracted_at").cast("timestamp"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    measured = ocr.measured(rows.select("activity_id", "attempt", "text", "confidence"))
    return ocr.best(measured, ["activity_id"]).select("activity_id", "text", "confidence", F.col("text_length").cast("bigint").alias("text_length"))


@query
def chosen_reading(spark, d):
    rows = table(spark, d, "aif_activities").withColumn("attempt", F.unix_micros(F.col("extracted_at").cast("timestamp"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    measured = ocr.measured(rows.select("activity_id", "attempt", "text", "confidence"))
    late = F.col("attempt") % 2 == 1
    return ocr.chosen(measured.where(~late), measured.where(late), ["activity_id"]).select("activity_id", "text", "confidence", "retried", "extraction_method")


@query
def reading_confidence(spark, d):
    words = activities(spark, d).select("activity_id", F.posexplode(F.split("text", r"\s+")).alias("seq", "word"), (F.coalesce(F.col("confidence"), F.lit(-0.01)) * 100).alias("confidence"))
    return ocr.page_text(words, ["activity_id"]).select("activity_id", "text", F.round("confidence", 6).alias("confidence"))


@query
def native_pages(spark, d):
    return docs(spark, d).select("doc_id", ocr.native_sufficient(F.col("text")).alias("native"))


# Retrieval


@query
def bm25_topk(spark, d):
    hits = lexical.search(index(spark, d), name_queries(spark, d), K)
    return hits.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def bm25_documents(spark, d):
    """The best documents for the whole text of every hundredth one."""
    texts = docs(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    hits = lexical.search(index(spark, d), texts, K)
    return hits.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def bm25_topk_language(spark, d):
    """The same among documents that a filter lets through before the cut: those of the query's language, or countrywide ones."""
    asked = name_queries(spark, d).withColumn("state", F.when(F.length("question") % 2 == 0, "hi").otherwise("en"))
    scope = docs(spark, d).select(F.col("doc_id").alias("doc"), F.when(F.col("genre") == "note", "India").otherwise("State").alias("applicable_scope"), F.col("lang").alias("own_state"))
    hits = lexical.search(index(spark, d), asked, K, allowed=lexical.Scope(scope, asked))
    return hits.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def dense_topk(spark, d):
    hits = vector.nearest(table(spark, d, "embeddings"), vector_queries(spark, d), K)
    return hits.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query
def dense_postfilter(spark, d):
    """Filtered after the cut: a query may keep fewer than k."""
    rows = table(spark, d, "embeddings")
    hits = vector.nearest(rows, vector_queries(spark, d), 20).join(rows.select("vec_id", "label"), "vec_id").where(q.matches({"label": 3}))
    return hits.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@query
def hybrid_topk(spark, d):
    """BM25 and vectors fused: the whole text of every hundredth vector's document is its query."""
    texts = docs(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    hits = pipeline.hybrid(texts, index(spark, d), table(spark, d, "embeddings"), vector_queries(spark, d).join(texts.select("query_id"), "query_id", "left_semi"))
    return hits.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def reciprocal_rank(spark, d):
    rows = docs(spark, d).where("source is not null").withColumn("query_id", F.lower(F.trim("source")))
    ranked = lambda *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("rank <= 30").select("query_id", F.col("doc_id").alias("chunk_id"), "rank")
    fused = fusion.reciprocal_rank([ranked(F.col("n_tokens").desc(), "doc_id"), ranked(F.col("n_chars"), "doc_id")])
    return fused.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def parent_expand(spark, d):
    hits = chunks(spark, d).select(F.col("scheme_id").alias("query_id"), F.col("document_id").alias("parent_id"), F.row_number().over(Window.partitionBy("scheme_id").orderBy("chunk_id")).alias("rank"))
    names = io.last_parents(table(spark, d, "scheme_metadata").select(F.col("document_id").alias("parent_id"), "document_name", "loaded_at"), "loaded_at")
    return fusion.expanded(hits, names).select("query_id", "parent_id", "document_name", F.col("position").cast("bigint").alias("position"))


@query
def get_parent(spark, d):
    """The chunks of the parent with the largest id."""
    path = f"{d}/scheme_chunks.parquet"
    wanted = spark.read.parquet(path).agg(F.max("parent_id")).first()[0]
    return fusion.parent_of(spark.read.parquet(path), wanted).select("chunk_id", "parent_id", "document_id").distinct()


@query
def metadata_json(spark, d):
    return chunks(spark, d).select("chunk_id", io.metadata_json("document_type", "state", "district").alias("metadata"))


@query
def combined_candidates(spark, d):
    """The fused documents and the schemes that they belong to, as candidates for reranking."""
    rows = docs(spark, d).where("source is not null").withColumn("query_id", F.lower(F.trim("source")))
    best = rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_tokens").desc(), "doc_id"))).where("position <= 12")
    own = best.select("query_id", "position", F.col("doc_id").cast("string").alias("chunk_id"), F.col("scheme_key").alias("parent_id"), F.col("text").alias("page_content"), (1.0 / (60 + F.col("position"))).alias("score"))
    parents = best.where("scheme_key is not null").select("query_id", "position", F.lit(None).cast("string").alias("chunk_id"), F.col("scheme_key").alias("parent_id"), F.col("scheme_key").alias("page_content"))
    return fusion.combined(own, parents).select("query_id", "chunk_id", "parent_id", F.col("position").cast("bigint").alias("position"))


@query
def dense_filtered(spark, d):
    hits = vector.filtered(table(spark, d, "embeddings"), vector_queries(spark, d), 15, {"label": 1})
    return hits.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query
def exact_dedup(spark, d):
    rows = fusion.without_duplicates(docs(spark, d), "doc_id", file="source", page="lang", content="text")
    return rows.select("doc_id")


@query
def quality_control(spark, d):
    return fusion.controlled(docs(spark, d), "doc_id", "text").select("doc_id")


# Routing


@query
def scheme_detect(spark, d):
    return router.detected(questions(spark, d), table(spark, d, "scheme_registry")).select("query_id", "question", "scheme_key", "matched_alias")


@query
def fact_questions(spark, d):
    return questions(spark, d).select("query_id", router.fact(F.col("question")).alias("fact"), router.fact_prompt(F.col("question")).alias("fact_prompt"))


@query
def query_variants(spark, d):
    rows = router.detected(questions(spark, d), table(spark, d, "scheme_registry"))
    each = router.variants(F.col("question"), F.col("scheme_key"), F.col("scheme_name"), years="intended")
    return rows.select("query_id", F.posexplode(each).alias("position", "variant"))


@query
def scheme_documents(spark, d):
    """Documents by the scheme in their name, and whether the scheme's name is in their file name."""
    rows = table(spark, d, "scheme_metadata").select(F.col("document_id").alias("query_id"), F.col("document_name").alias("question")).distinct()
    found = router.detected(rows, table(spark, d, "scheme_registry"))
    match = router.of_scheme(F.col("scheme_name"), F.concat("question", F.lit(".pdf")), F.lit(None).cast("string"))
    return found.select(F.col("query_id").alias("document_id"), "scheme_key", match.alias("scheme_match"))


# Reranking and answers


def hits(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of each scheme's name with their text, as candidates for reranking."""
    asked = name_queries(spark, d)
    found = lexical.search(index(spark, d), asked, 20).withColumnRenamed("rank", "position")
    rows = found.join(docs(spark, d).select(F.col("doc_id").alias("doc"), F.col("text").alias("page_content"), "source", "scheme_key", F.col("genre").alias("content_type")), "doc").join(asked, "query_id")
    return rows.withColumn("scheme_match", F.col("scheme_key").eqNullSafe(F.col("query_id"))).withColumn("question", F.concat(F.lit("How many farmers were covered under "), "question", F.lit("?")))


@query
def scheme_first(spark, d):
    return router.prioritized(hits(spark, d)).select("query_id", F.col("doc").alias("doc_id"), "scheme_match", F.col("position").cast("bigint").alias("position"))


@query
def lexical_rerank(spark, d):
    rows = rerank.reranked(hits(spark, d))
    return rows.select("query_id", F.col("doc").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), F.col("position").cast("bigint").alias("position"))


@query
def candidate_rerank(spark, d):
    rows = hits(spark, d).withColumns({"chunk_id": F.col("doc").cast("string"), "parent_id": F.lit(None).cast("string")})
    rows = rerank.reranked_candidates(rows)
    return rows.select("query_id", F.col("doc").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), F.col("position").cast("bigint").alias("position"))


@query
def fact_boost(spark, d):
    rows = rerank.boosted(rerank.reranked(hits(spark, d), top=20))
    rows = rows.where(q.relevant(F.col("rerank_score"), F.col("effective_rerank_score")))
    return rows.select("query_id", F.col("doc").alias("doc_id"), F.round("fact_year_boost", 6).alias("boost"), F.col("fact_keyword_matches").cast("bigint").alias("matches"), F.round("effective_rerank_score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


@query
def context_build(spark, d):
    rows = docs(spark, d).where("source is not null").withColumn("query_id", F.lower(F.trim("source")))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).select("query_id", "position", F.col("source"), F.col("doc_id").alias("page"), F.col("genre").alias("content_type"), F.col("text").alias("page_content"))
    return context.contexts(rows)


@query
def source_references(spark, d):
    rows = chunks(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("scheme_id").orderBy("chunk_id"))).select(F.col("scheme_id").alias("query_id"), "position", F.col("document_name").alias("source"), F.lit("").alias("file_name"), "page_number", F.col("chunk_type").alias("content_type"))
    return context.references(rows).select("query_id", F.col("position").cast("bigint").alias("position"), "file_name", "page", "content_type")


@query
def prompts(spark, d):
    rows = questions(spark, d)
    return rows.select("query_id", context.rewrite_prompt(F.col("question"), F.lit("User: hello")).alias("rewrite"), context.answer_prompt(F.col("question"), F.lit("none")).alias("answer"))


@query
def ask(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("doc"), F.col("text").alias("page_content"), "source", F.col("scheme_key").alias("file_name"), F.lit(1).alias("page"), F.col("genre").alias("content_type"))
    out = pipeline.ask(questions(spark, d), rows, table(spark, d, "scheme_registry"), index=index(spark, d))
    return out.select("query_id", "question", F.size("sources").alias("sources"), "answer")


@query
def model_rerank(spark, d):
    """Reranking by a model that scores pairs a batch at a time; here the shared share of two sets of words stands in for it."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        sets = [tuple(set(re.findall("[a-z0-9]+", x.lower())) for x in p) for p in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]

    rows = rerank.reranked(hits(spark, d), rerank.modelled(score))
    return rows.select("query_id", F.col("doc").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), F.col("position").cast("bigint").alias("position"))


@query
def retrieved_by_vectors(spark, d):
    """The retrieval stage of a question: base and variant results by vectors, first of each duplicate, the scheme's documents first."""
    rows = docs(spark, d).select(F.col("doc_id").alias("doc"), F.col("text").alias("page_content"), "source", F.col("scheme_key").alias("file_name"), F.lit(1).alias("page"))
    asked = questions(spark, d).withColumn("standalone_question", F.col("question"))
    vectors = rows.select("doc", letter_vector(F.col("page_content")).alias("embedding"))
    found = pipeline.retrieved(asked, rows, None, table(spark, d, "scheme_registry"), pipeline.Settings(), vectors, letter_vector)
    return found.select("query_id", F.col("doc").alias("doc_id"), "scheme_match", F.col("position").cast("bigint").alias("position"))


@query
def ask_by_vectors(spark, d):
    """Questions answered from what vectors retrieve: the scheme, and the documents that the answer may use."""
    rows = docs(spark, d).select(F.col("doc_id").alias("doc"), F.col("text").alias("page_content"), "source", F.col("scheme_key").alias("file_name"), F.lit(1).alias("page"), F.col("genre").alias("content_type"))
    vectors = rows.select("doc", letter_vector(F.col("page_content")).alias("embedding"))
    out = pipeline.ask(questions(spark, d), rows, table(spark, d, "scheme_registry"), vectors=vectors, embed=letter_vector)
    return out.select("query_id", "question", F.col("scheme.key").alias("scheme"), joined(F.transform("documents", lambda x: x["doc"].cast("string"))).alias("documents"))


def annex_rows(spark: SparkSession, d: str) -> DataFrame:
    """Annex documents with an id and a vector."""
    made = documents.documents(activities(spark, d), table(spark, d, "aif_cost_rows"))
    rows = made.select("content_type", F.col("file_name").alias("source"), "page", "activity_number", "item_number", "page_content", letter_vector(F.col("page_content")).alias("embedding"))
    return stored(rows.withColumn("doc", F.concat_ws("|", "content_type", "source", "page", "activity_number", "item_number", "page_content")).dropDuplicates(["doc"]), "annex")


def by_field(field: str, value: Callable[[DataFrame], object]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = annex_rows(spark, d)
        asked = name_queries(spark, d).select("query_id", letter_vector(F.col("question")).alias("embedding"))
        found = vector.filtered(rows, asked, 200, {field: value(rows)}, key="doc")
        return found.select("query_id", F.col("distance").cast("bigint").alias("distance"), field).groupBy("query_id", field).agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("nearest"))

    run.__name__, run.__doc__ = f"retrieve_by_{field}", f"The nearest 200 annex documents of each scheme's name that have one {field}, filtered after the cut."
    return run


for _field, _value in {
    "content_type": lambda _: "activity", "source": lambda r: r.agg(F.mode("source", True)).first()[0], "page": lambda r: r.agg(F.min("page")).first()[0],
    "activity_number": lambda _: 3, "item_number": lambda _: 2,
}.items():
    query(by_field(_field, _value))


@query
def expected_activities(spark, d):
    """For each activity of a table the reading of any of them that agrees best with its last text."""
    group = F.concat_ws("|", "document", F.col("page_number").cast("string"), F.col("table_no").cast("string"))
    last = activities(spark, d).select(group.alias("g"), F.col("activity_id").alias("ord"), F.coalesce("text", F.lit("")).alias("expected"))
    read = table(spark, d, "aif_activities").select(group.alias("g"), "text")
    return ocr.best_expected(read, last, "g").select("g", "ord", F.round("score", 6).alias("score"))


# Sources and sinks


@query
def documents_stored(spark, d):
    path = io.write_documents(chunks(spark, d), scratch(spark, "documents"))
    return io.read_documents(spark, path).select("chunk_id", "page_content", "document_id", "page_number", "subsection", "image_count")


@query
def dumps_stored(spark, d):
    """Children of the dumps of all documents."""
    rows = chunks(spark, d)
    path = io.write_dumps(rows.where("chunk_type = 'parent'"), rows.where("chunk_type = 'child'"), scratch(spark, "dumps"))
    return io.read_chunk_dumps(spark, f"{path}/*/*.json").select("chunk_id", "parent_id", "page_content", "chunk_index")


@query
def pages_stored(spark, d):
    """Page texts under their banners, read again."""
    rows = chunks(spark, d).where("chunk_type = 'parent'").groupBy("document_id", "page_number").agg(F.array_join(F.array_sort(F.collect_list("page_content")), "\n").alias("text"), F.max("extraction_method").alias("extraction_method"))
    found = io.read_pages(spark, f"{io.write_texts(rows, scratch(spark, 'pages'))}/*/*.txt")
    return found.select(F.regexp_extract("path", "document_id=([^/]+)/", 1).alias("document_id"), "page_number", "extraction_method", F.md5(F.encode("text", "UTF-8")).alias("text"))


@query
def tables_stored(spark, d):
    """Nested JSON of annex tables, read again: activities, costs and their texts of each page."""
    path = io.write_nested(io.nested_tables(activities(spark, d), table(spark, d, "aif_cost_rows")), scratch(spark, "tables"))
    schema = "struct<document:string,page_number:int,activities:array<struct<marker:string,text:string>>,cost_table:struct<rows:array<struct<item_number:int,cost:string>>>>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("v")).select("v.*")
    return rows.select("document", "page_number", F.size(F.coalesce("activities", F.array())).cast("bigint").alias("activities"), F.size(F.coalesce("cost_table.rows", F.array())).cast("bigint").alias("costs"), joined(F.transform("activities", lambda x: t.text(x["text"]))).alias("texts"), joined(F.transform("cost_table.rows", lambda x: t.text(x["cost"]))).alias("values"))


@query
def metadata_joined(spark, d):
    """Documents of which no metadata of the wanted kind is there, and those that have it."""
    files = chunks(spark, d).select(F.col("document_id").alias("stem")).distinct()
    rows = io.last_parents(table(spark, d, "scheme_metadata"), "loaded_at", "document_id").where(F.lower(F.trim("language")) == "english")
    found, missing = io.with_metadata(files, rows.withColumnRenamed("document_id", "stem"))
    return found.select("stem", "document_name").unionByName(missing.withColumn("document_name", F.lit(None).cast("string")))


@query
def vectors_stored(spark, d):
    path = io.write_vectors(docs(spark, d).select("doc_id", "text"), letter_vector, scratch(spark, "vectors"), "text")
    return io.read_vectors(spark, path).select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("letters"), F.element_at("embedding", 1).cast("bigint").alias("first"))


@query
def bm25_stored(spark, d):
    """The search on an index that was written, its postings in order of the terms, and read again."""
    ix = io.read_index(spark, io.write_index(index(spark, d), scratch(spark, "index"), 8))
    found = lexical.search(ix, name_queries(spark, d), K)
    return found.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def files_discovered(spark, d):
    """Files and bytes of each scheme's folder."""
    path = scratch(spark, "files")
    docs(spark, d).where("scheme_key is not null and text is not null").select("scheme_key", "text").write.partitionBy("scheme_key").text(path)
    found = io.discover(spark, path, "*.txt", recursive=True)
    return found.groupBy(F.regexp_extract("path", "scheme_key=([^/]+)/", 1).alias("scheme_key")).agg(F.sum("length").alias("bytes"))


def as_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: their paragraphs are pages."""
    return docs(spark, d).where("text <> ''").select(F.format_string("files/%d.pdf", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))


def extracted(spark: SparkSession, d: str) -> ingestion.Extracted:
    """Pages of such files. Stand-ins: every third page has no text of its own; an image holds the bytes of the page; the sureness of a reading depends on its mode and the page's length."""

    def paragraphs(content: bytes) -> list[str]:
        return [p for p in content.decode().split("\n\n") if p.strip(" \t\n\r")]

    def parse(content: bytes) -> list[tuple[int, str, str, int]]:
        return [(n, "" if n % 3 == 0 else p, "native", 0) for n, p in enumerate(paragraphs(content), 1)]

    def render(content: bytes, n: int, dpi: int) -> bytes:
        page = paragraphs(content)[n - 1].encode()
        return f"P5\n{len(page) + 2} 1\n255\n".encode() + page + b"\x00\xff"

    def read(image: bytes, config: str) -> tuple[str, float]:
        text = image.split(b"255\n", 1)[1][:-2].decode("utf-8", "ignore")
        sure = {"--psm 6": 0.9 if len(text) % 2 == 0 else 0.6, "--psm 11": 0.5, "--psm 4": 0.7}[config]
        return text, sure

    return ingestion.extracted(as_files(spark, d), parse, render, read, stored)


@query
def extracted_pages(spark, d):
    """How each page's text was won, and how it ended."""
    found = extracted(spark, d)
    rows = found.report.join(found.pages.select(*ingestion.KEYS, "extraction_method", "confidence"), ingestion.KEYS, "left")
    return rows.select("path", "page_number", "status", "retried", "extraction_method", F.round("confidence", 6).alias("confidence"))


@query
def extracted_lists(spark, d):
    """Pages of each file that are poor, empty, read again or missing."""
    rows = ingestion.page_lists(extracted(spark, d).report)
    return rows.select("path", *(F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("low", "empty", "retried", "missing")))


@query
def ingested_parents(spark, d):
    """Parents of the pages of files that have metadata."""
    rows = docs(spark, d).select(F.format_string("files/%d.pdf", "doc_id").alias("path"), F.lit(1).alias("page_number"), "text")
    metadata = docs(spark, d).where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("stem"), F.col("doc_id").alias("document_id"))
    return ingestion.chunked(rows, metadata)[0]


@query
def image_variants(spark, d):
    """Bytes and light of the variants of an image of each supplier: its name as grey pixels in three rows."""
    kinds = ("original", *images.VARIANTS)

    @F.pandas_udf("array<bigint>")
    def light(names):  # noqa: ANN001, ANN202
        return names.map(lambda n: [int(images.decoded(images.preprocessed(images.encoded(np.frombuffer((n * 3).encode(), np.uint8).reshape(3, -1)), k)).sum()) for k in kinds])

    rows = table(spark, d, "supplier").select("s_suppkey", light(F.col("s_name")).alias("v"))
    return rows.select("s_suppkey", *(F.get("v", i).alias(k) for i, k in enumerate(kinds)))


# Conversations


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages of sessions."""
    role = F.when(F.col("event_id") % 7 == 0, "system").when(F.col("event_id") % 2 == 0, "user").otherwise("assistant")
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), role.alias("role"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("content"))


@query
def memory_trim(spark, d):
    return memory.recent(messages(spark, d), 3).select("session_id", "seq", "role", "content")


@query
def history_format(spark, d):
    return memory.formatted(messages(spark, d), 3)


@query
def history_lines(spark, d):
    rows = messages(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("m"))
    return rows.select("session_id", context.history(F.col("m")).alias("history"))


@query
def memory_sessions(spark, d):
    return memory.sessions(messages(spark, d)).select("session_id", "messages", "has_history")


@query
def memory_turns(spark, d):
    rows = messages(spark, d)
    turns = rows.select("session_id").distinct().select("session_id", F.lit("q").alias("question"), F.lit("a").alias("answer"))
    return memory.cleared(memory.with_turn(rows, turns, 2), rows.where("session_id % 2 = 0").select("session_id")).select("session_id", "seq", "role", "content")


@query
def memory_stream(spark, d):
    """The batch result once more, from a stream with keyed state."""
    from granary.streaming.memory import histories

    schema = table(spark, d, "events").schema
    source = f"{d}/events.parquet"
    reader = spark.readStream.schema(schema)
    raw = reader.parquet(source) if io.exists(spark, f"{source}/*") else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    role = F.when(F.col("event_id") % 7 == 0, "system").when(F.col("event_id") % 2 == 0, "user").otherwise("assistant")
    rows = raw.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), role.alias("role"), F.col("event_type").alias("content"))
    path = f"{shared_dir(spark)}/granary-stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/part={number}")

    stream = histories(rows, 3).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    out = spark.read.parquet(f"{path}/rows").drop("part")
    last = fusion.first_of(out, [F.col("session_id")], [F.col("batch").desc()])
    return last.select(F.col("session_id").cast("bigint").alias("session_id"), "history")


def shipped(run: Query) -> Query:
    def call(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return run(spark, d)

    return call


def queries() -> dict[str, Query]:
    return {n: shipped(f) for n, f in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, s in ORACLES.items() if n in NAMES}
