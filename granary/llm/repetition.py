"""Repetition inside a single document (problem 9).

The share of repeated content is measured directly: runs of words that occurred
before in the same text. Beside it stands the distribution's divergence: the
Jensen-Shannon distance of a document's character classes and function words from
those of all documents of its language, which repetition pulls away from the
reference. The distance alone can't tell a share, so it is reported and not the
criterion; texts too short to compare have neither.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.runtime import stored

MIN_WORDS, RUN, MIN_SHARE = 20, 5, 0.25
CLASSES = (("lower", r"[a-z]"), ("upper", r"[A-Z]"), ("digit", r"\d"), ("space", r"[ \t]"), ("line", r"\n"), ("stop", r"[.!?।]"), ("sign", r"[^\w\s.!?।]"), ("devanagari", r"[ऀ-ॿ]"))
CLASS = [re.compile(p) for _, p in CLASSES]
SENTENCE = re.compile(r"[^.!?।\n]+")
UNKNOWN = "und"
ALPHABET = 128

RESULT = "doc_id bigint, words int, repeated_run_share double, repeated_sentence_share double, repeated_paragraph_share double, char_distance double, word_distance double, repetitive boolean"


def language(c: F.Column) -> F.Column:
    """Languages in lower case; null and empty count as unknown."""
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(UNKNOWN))


def run_share(words: list[str], n: int = RUN) -> float:
    """1 - distinct runs / all runs of n words; 0 without a run."""
    runs = len(words) - n + 1
    return 0.0 if runs < 1 else 1.0 - len(set(zip(*(words[i:] for i in range(n))))) / runs


def repeated(parts: list[str]) -> float:
    """Share of the characters in parts that occurred before."""
    total = sum(map(len, parts))
    return 1.0 - sum(map(len, set(parts))) / total if total else 0.0


def table_of_classes() -> np.ndarray:
    out = np.full(ALPHABET, len(CLASSES), dtype=np.int64)
    for c in range(ALPHABET):
        out[c] = next((i for i, p in enumerate(CLASS) if p.match(chr(c))), len(CLASSES))
    return out


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    """Characters of each class; the last holds all else."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = codes < ALPHABET
    out = np.bincount(table[codes[low]], minlength=len(CLASSES) + 1).astype(np.float64)
    high = codes[~low]
    if len(high):
        deva = int(((high >= 0x900) & (high <= 0x97F) & (high != 0x964)).sum())
        stops = int((high == 0x964).sum())
        out[7] += deva
        out[5] += stops
        out[-1] += len(high) - deva - stops
    return out


def distance(p: np.ndarray, q: np.ndarray) -> float | None:
    """Jensen-Shannon distance, base 2, of two histograms; None if one is empty."""
    if p.sum() <= 0 or q.sum() <= 0:
        return None
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def references(df: DataFrame, text: str, lang: str, common: list[str]) -> DataFrame:
    """(lang, slot, n): for each language, counts of character classes and of function words over all its documents. Summed in each task first."""
    index = {w: i for i, w in enumerate(common)}
    width = len(CLASSES) + 1 + len(common) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = table_of_classes(), {}
        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    sums.setdefault(g, np.zeros(width))
                    sums[g] += histogram(t, t.lower().split(), table, index)
        flat = [(g, i, float(v)) for g, row in sums.items() for i, v in enumerate(row) if v]
        columns = list(zip(*flat)) if flat else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], names=["lang", "slot", "n"])

    rows = df.select(F.col(text), language(F.col(lang)).alias("lang")).mapInArrow(run, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return stored(rows, "references")


#: Languages up to which every task holds all references; with more each document is joined with that of its language.
HELD_LANGUAGES = 1000


def histogram(text: str, words: list[str], table: np.ndarray, index: dict[str, int]) -> np.ndarray:
    found = np.zeros(len(index) + 1)
    counts = Counter(words)
    rest = len(words)
    for w in counts.keys() & index.keys():
        found[index[w]] = counts[w]
        rest -= counts[w]
    found[-1] = rest
    return np.concatenate([class_counts(text, table), found])


def measured(df: DataFrame, common: list[str], text: str = "text", key: str = "doc_id", lang: str = "lang", min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Shares of repeated content and distances from the language's reference, one row per row of df.

    repetitive: at least min_words words and min_share of the runs of RUN words
    occurred before. Texts of fewer words have null distances and aren't repetitive;
    null counts as empty. Languages are compared trimmed and in lower case; null is
    unknown. Other columns of df are ignored, whatever their names.
    """
    index = {w: i for i, w in enumerate(sorted({w.lower() for w in common}))}
    width = len(CLASSES) + 1 + len(index) + 1
    found = references(df, text, lang, list(index))
    rows = df.select(key, text, language(F.col(lang)).alias("__lang"))
    held: dict[str, np.ndarray] = {}
    if found.select("lang").distinct().count() <= HELD_LANGUAGES:
        for r in found.collect():
            held.setdefault(r.lang, np.zeros(width))[r.slot] = r.n
        rows = rows.withColumn("__slots", F.lit(None).cast("array<struct<slot:int,n:double>>"))
    else:
        own = found.groupBy(F.col("lang").alias("__lang")).agg(F.collect_list(F.struct("slot", "n")).alias("__slots"))
        rows = rows.join(own, "__lang", "left")
    shared = df.sparkSession.sparkContext.broadcast(held)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(RESULT).fields[1:]])
    kinds = [pa.int32(), *[pa.float64()] * 5, pa.bool_()]
    split = len(CLASSES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, refs = table_of_classes(), shared.value
        for b in batches:
            rows = []
            for t, g, slots in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                t = t or ""
                words = t.lower().split()
                share = run_share(words)
                ref = refs.get(g)
                if slots:
                    ref = np.zeros(width)
                    ref[[x["slot"] for x in slots]] = [x["n"] for x in slots]
                chars = common_words = None
                if len(words) >= min_words and ref is not None:
                    own = histogram(t, words, table, index)
                    chars, common_words = distance(own[:split], ref[:split]), distance(own[split:], ref[split:])
                parts = [s for s in (x.strip().lower() for x in SENTENCE.findall(t)) if s]
                rows.append((len(words), share, repeated(parts), repeated([p.strip() for p in t.split("\n\n") if p.strip()]), chars, common_words, len(words) >= min_words and share >= min_share))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return rows.select(key, text, "__lang", "__slots").mapInArrow(run, schema)
