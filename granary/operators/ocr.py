"""Several attempts at reading a page, as rows: the best one, and whether a second round beats the first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import quality as q
from granary.functions import text as t
from granary.runtime import BROADCAST_ROWS

METHODS = ("pymupdf_text", "tesseract_ocr", "tesseract_ocr_retry")


def score(confidence: Column, length: Column, words: Column, text: Column) -> Column:
    return confidence * 0.55 + F.least(length / 1000.0, F.lit(1.0)) * 0.25 + F.least(words / 150.0, F.lit(1.0)) * 0.20 - F.when(t.text(text) == "", 1.0).otherwise(0.0)


def best(candidates: DataFrame, keys: list[str], order: str = "attempt") -> DataFrame:
    """The best candidate of each page; ties go to the earlier attempt. candidates: keys, attempt, text, confidence, word_count, text_length."""
    value = F.round(score(F.col("confidence"), F.col("text_length"), F.col("word_count"), F.col("text")), 12)
    row = F.struct(*[c for c in candidates.columns if c not in keys])
    found = candidates.groupBy(*keys).agg(F.max_by(row, F.struct(value, -F.col(order))).alias("b"))
    return found.select(*keys, "b.*")


def measured(df: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """df with its text cleaned and the counts and issues that score() and the gates need."""
    rows = df.withColumn("__q", q.text_quality(F.col(text), F.col(confidence)))
    return rows.withColumns({text: F.col("__q.text"), "word_count": F.col("__q.word_count"), "text_length": F.col("__q.text_length"), "issues": F.col("__q.issues")}).drop("__q")


def chosen(primary: DataFrame, retry: DataFrame, keys: list[str]) -> DataFrame:
    """The reading of each page to keep. The second round counts only where the first was poor: if it is longer with as many words, or surer by more than 0.05. Pages without any candidate come out with the issue ocr_failed."""
    p, r = best(primary, keys).alias("p"), best(retry, keys).alias("r")
    rows = p.join(r, keys, "full")
    poor = F.col("p.text").isNull() | (F.col("p.confidence") < q.LOW_CONFIDENCE) | (F.col("p.text") == "") | (F.length("p.text") < q.MIN_CHARS)
    longer = (F.col("r.text_length") > F.coalesce("p.text_length", F.lit(0))) & (F.col("r.word_count") >= F.coalesce("p.word_count", F.lit(0)))
    surer = F.col("r.confidence") > F.coalesce("p.confidence", F.lit(0.0)) + 0.05
    second = F.coalesce(poor & (longer | surer), F.lit(False))
    pick = lambda c: F.when(second, F.col(f"r.{c}")).otherwise(F.col(f"p.{c}"))
    out = rows.select(*keys, *(pick(c).alias(c) for c in ("text", "confidence", "word_count", "text_length", "issues")), poor.alias("retried"), F.when(second, METHODS[2]).otherwise(METHODS[1]).alias("extraction_method"))
    return out.withColumns({
        "text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "word_count": F.coalesce("word_count", F.lit(0)),
        "text_length": F.coalesce("text_length", F.lit(0)), "issues": F.coalesce("issues", F.array(F.lit("ocr_failed"))),
    })


def attempts(pages: DataFrame, read: Callable[[bytes, str, str], tuple[str, float]], modes: list[tuple[str, str]], keys: list[str], image: str = "image") -> DataFrame:
    """Readings of each page's image, one a mode (preprocessing, configuration). read is passed in and gives text and confidence; a reading that fails is empty with confidence 0."""
    each = F.array(*(F.struct(F.lit(i).alias("attempt"), F.lit(p).alias("preprocessing"), F.lit(c).alias("config")) for i, (p, c) in enumerate(modes)))
    rows = pages.select(*keys, image, F.inline(each))
    schema = T.StructType([*(rows.schema[k] for k in (*keys, "attempt", "preprocessing", "config")), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for content, p, c in zip(b[image], b["preprocessing"], b["config"]):
                try:
                    found.append(read(bytes(content), p, c))
                except Exception:  # noqa: BLE001 - whatever a reader raises is about this image
                    found.append(("", 0.0))
            out = b.drop(columns=[image])
            out["text"], out["confidence"] = [f[0] for f in found], [float(f[1]) for f in found]
            yield out

    return measured(rows.mapInPandas(run, schema))


def native_sufficient(text: Column) -> Column:
    """A page's own text makes reading its image unnecessary."""
    clean = t.cleaned(text)
    return (F.length(clean) >= q.MIN_CHARS) & (F.regexp_count(clean, F.lit(t.ASCII_WORD)) >= q.MIN_WORDS)


def page_text(words: DataFrame, keys: list[str], order: str = "seq", word: str = "word", confidence: str = "confidence") -> DataFrame:
    """(keys, text, confidence): words read with a confidence of 0 or more, and its mean as a share; (empty, 0) without any."""
    ok = (F.col(confidence) >= 0) & (t.strip(t.text(F.col(word))) != "")
    kept = F.array_sort(F.collect_list(F.when(ok, F.struct(F.col(order), t.strip(F.col(word)).alias("w")))))
    return words.groupBy(*keys).agg(F.array_join(F.transform(kept, lambda s: s["w"]), " ").alias("text"), F.coalesce(F.round(F.avg(F.when(ok, F.col(confidence) / 100.0)), 9), F.lit(0.0)).alias("confidence"))


def best_expected(candidates: DataFrame, expected: DataFrame, group: str, text: str = "text", goal: str = "expected", ordinal: str = "ord") -> DataFrame:
    """For each expected text of a group the candidate that agrees best: containment counts 0.95, else the share of its words. Candidates meet only those of their group."""
    goals = expected.select(group, ordinal, goal, F.lower(F.col(goal)).alias("__e"))
    goals = F.broadcast(goals) if expected.count() <= BROADCAST_ROWS else goals
    pairs = candidates.select(group, F.lower(t.squeezed(F.col(text))).alias("__c")).where("__c <> ''").join(goals, group)
    own, other = (F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("([a-z]+)"), 1)) for c in ("__e", "__c"))
    value = F.when(F.contains(F.col("__e"), F.col("__c")) | F.contains(F.col("__c"), F.col("__e")), 0.95).when(F.size(own) > 0, F.size(F.array_intersect(own, other)) / F.size(own)).otherwise(0.0)
    scored = pairs.withColumn("score", F.round(value, 9))
    top = Window.partitionBy(group, ordinal).orderBy(F.col("score").desc(), "__c")
    return scored.withColumn("__at", F.row_number().over(top)).where("__at = 1").select(group, ordinal, goal, F.col("__c").alias("candidate"), "score")
