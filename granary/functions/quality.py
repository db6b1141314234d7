"""Quality gates and validation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as t

MIN_CHARS, MIN_WORDS, LOW_CONFIDENCE = 80, 15, 0.65
MIN_PAGE_CHARS, MIN_PAGE_WORDS, MIN_DISTINCT, MIN_LETTERS = 100, 20, 5, 40
MIN_DOCUMENT_CHARS, MIN_CONTENT_CHARS, THRESHOLD = 30, 20, 0.1
# Field lists, the kinds of content, and the wording of errors.
MISSING_FIELD, EMPTY_FIELD = "Missing required metadata field: {}", "Metadata '{}' cannot be empty."
NOT_INTEGER, TOO_SMALL = "Metadata '{}' must be an integer.", "Metadata '{}' must be >= 1."
NOT_SHARE, NOT_NUMERIC, NOT_BOOLEAN = "Metadata '{}' must be between 0.0 and 1.0.", "Metadata '{}' must be numeric.", "Metadata '{}' must be boolean."
CONTENT_TYPES = ("activity", "cost_norm", "paragraph", "table", "heading", "list", "other")
METADATA_FIELDS = ("source", "file_name", "document_type", "page", "page_number", "section", "content_type", "ocr_confidence", "has_ocr_warning", "parser", "extraction_method", "language", "version")
CHUNK_FIELDS = (*METADATA_FIELDS, "chunk_index", "total_chunks")
DOCUMENT_FIELDS = ("source", "file_name", "page", "document_type", "section", "content_type", "parser", "extraction_method", "ocr_confidence")


def errors(*found: tuple[Column, str]) -> Column:
    """Messages of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in found)))


def sufficient(c: Column) -> Column:
    """A page has text worth keeping; c is its cleaned text."""
    words = F.regexp_extract_all(t.text(c), F.lit(f"({t.WORD}+)"), 1)
    distinct = F.size(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower)))
    letters = F.length(F.regexp_replace(t.text(c), r"\P{L}", ""))
    address = c.rlike(r"^(?:https?://)?(?:www\.)?[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}/?$")
    return F.coalesce((F.length(c) >= MIN_PAGE_CHARS) & (F.size(words) >= MIN_PAGE_WORDS) & (distinct >= MIN_DISTINCT) & (letters >= MIN_LETTERS) & ~address, F.lit(False))


def text_quality(c: Column, confidence: Column) -> Column:
    """Struct of the cleaned text, its counts and its issues."""
    clean = t.cleaned(c)
    words = F.regexp_count(clean, F.lit(t.ASCII_WORD))
    found = errors((F.length(clean) == 0, "empty_text"), (F.length(clean) < MIN_CHARS, "very_short_text"), (words < MIN_WORDS, "low_word_count"), (confidence < LOW_CONFIDENCE, "low_ocr_confidence"))
    return F.struct(clean.alias("text"), confidence.alias("confidence"), words.alias("word_count"), F.length(clean).alias("text_length"), found.alias("issues"))


def word_split(c: Column) -> Column:
    return F.filter(F.split(t.text(c), r"(?U)\s+"), lambda w: w != "")


def artifacts(c: Column) -> Column:
    """Signs of damage in scanned text."""
    size, words = F.length(t.text(c)), word_split(c)
    unusual = F.length(F.regexp_replace(t.text(c), r"[A-Za-z0-9\s.,;:!?%()\-/'\"&+*=₹$€£]", ""))
    found = errors(
        (size < MIN_CHARS, "very_short_text"), (F.size(words) < MIN_WORDS, "low_word_count"), (unusual > F.greatest(F.lit(10.0), size * 0.03), "many_unusual_characters"),
        (F.exists(words, lambda w: F.length(w) >= 35), "possible_word_joining"), (t.text(c).rlike(r"(?U)[^\p{L}\p{N}_\s]{6,}"), "symbol_sequence"),
    )
    return F.when(size == 0, F.array(F.lit("empty_text"))).otherwise(found)


def ocr_quality(c: Column, confidence: Column) -> Column:
    """Struct of counts, whether the text means something, and whether it needs a warning."""
    words = F.size(word_split(c))
    meaningful = (F.length(t.text(c)) >= MIN_CHARS) & (words >= MIN_WORDS)
    issues = F.concat(artifacts(c), errors((confidence < LOW_CONFIDENCE, "low_ocr_confidence")))
    count = F.when(t.text(c) == "", F.lit(0)).otherwise(F.size(t.lines(c)))
    warning = F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False)) | ~meaningful | (F.size(issues) >= 3)
    return F.struct(
        confidence.alias("confidence"), F.length(t.text(c)).alias("character_count"), words.alias("word_count"), count.alias("line_count"),
        meaningful.alias("has_meaningful_text"), warning.alias("warning"), issues.alias("issues"),
    )


def long_enough(c: Column) -> Column:
    return F.coalesce(F.length(t.strip(c)) >= MIN_DOCUMENT_CHARS, F.lit(False))


def relevant(score: Column, effective: Column | None = None, least: float = THRESHOLD) -> Column:
    """Kept by the relevance threshold; a row without a numeric score is kept."""
    own = score.try_cast("double")
    used = own if effective is None else F.coalesce(effective.try_cast("double"), own)
    return own.isNull() | (used >= least)


def matches(filters: Mapping[str, object]) -> Column:
    """All given fields equal their values; a null value asks for a missing field."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items()), F.lit(True))


def in_scope(scope: Column, own: Column, state: Column) -> Column:
    """Countrywide rows are in scope everywhere, those of a state only there; a missing scope is none."""
    scope, asked = F.lower(t.text(scope)), F.lower(t.text(state))
    return (asked == "") | (scope == "india") | ((scope == "state") & (F.lower(t.text(own)) == asked))


def metadata_errors(columns: list[str]) -> Column:
    """Everything wrong with a row's metadata. A missing column counts as a null field."""
    def get(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None)

    found = [(get(f).isNull(), MISSING_FIELD.format(f)) for f in METADATA_FIELDS]
    found += [(get(f).isNotNull() & (t.strip(get(f).cast("string")) == ""), EMPTY_FIELD.format(f)) for f in ("source", "file_name")]
    for f in ("page", "page_number"):
        whole = get(f).cast("string").rlike(r"^-?\d+$")
        found += [(get(f).isNotNull() & ~whole, NOT_INTEGER.format(f)), (whole & (get(f).try_cast("int") < 1), TOO_SMALL.format(f))]
    number = get("ocr_confidence").cast("string").try_cast("double")
    found += [(number.isNotNull() & ~number.between(0.0, 1.0), NOT_SHARE.format("ocr_confidence")), (get("ocr_confidence").isNotNull() & number.isNull(), NOT_NUMERIC.format("ocr_confidence"))]
    found += [(get("has_ocr_warning").isNotNull() & ~get("has_ocr_warning").cast("string").isin("true", "false"), NOT_BOOLEAN.format("has_ocr_warning"))]
    return errors(*found)


def known_type(c: Column) -> Column:
    return F.coalesce(c.isin(*CONTENT_TYPES), F.lit(False))


def missing(columns: list[str], needed: tuple[str, ...], content: Column) -> Column:
    """Missing fields of a row, and blank content."""
    get = lambda n: F.col(n) if n in columns else F.lit(None)
    return errors((t.strip(t.text(content)) == "", "Empty content."), *((get(n).isNull(), f"Missing field: {n}") for n in needed))


def embedding_report(df: DataFrame, embedding: str, documents: int | None = None) -> DataFrame:
    """One row: number and dimensions of the embeddings, and whether they fit each other and the documents."""
    size = F.size(embedding)
    odd = F.exists(F.coalesce(F.col(embedding), F.array().cast("array<float>")), lambda x: x.isNull() | F.isnan(x))
    out = df.agg(F.count(F.lit(1)).alias("embeddings"), F.min(size).alias("least_dimension"), F.max(size).alias("most_dimension"), F.count_if(F.col(embedding).isNull() | odd).alias("not_numeric"))
    fits = F.lit(True) if documents is None else F.col("embeddings") == documents
    return out.withColumn("valid", fits & (F.col("least_dimension") > 0) & (F.col("least_dimension") == F.col("most_dimension")) & (F.col("not_numeric") == 0))
