"""Statistics of each text and its kind: prose, list, table or junk (problem 3).

Every line is sorted by its form: a row of cells, a list item, unreadable, or
running text. Running text must hold function words; a line of four words
without any counts as unreadable. The kind comes from these forms and from the
repetition statistics together: running text that was said before in the same text
is boilerplate and counts for no kind, so a list under lines that return again and
again is a list; and a text that is boilerplate for the most part, by repeated
lines and paragraphs or by one n-gram that covers it, is of the kind `boilerplate`.
Lines repeated over the documents of a site are found first (problem 4); then rows
are independent, and the plan is one pass over the text without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import sitelines

VOWEL = re.compile(r"[aeiouyAEIOUY]")
ENUMERATED = re.compile(r"(?:\((?:[ivxl]{1,7}|[a-z]|\d{1,3})\)|(?:[ivxl]{1,7}|[a-z]|\d{1,3})[.)])\s+\S", re.I)
#: A bullet is any lone sign, or a letter that scanning makes of one; or a sign stuck to the item.
BULLET = re.compile(r"(?:(?:[^\w\s(\[\"'“‘₹]|[eoP¢©])\s+\S|[^\w\s(\[\]\"'“‘₹<>{}|\\/]\w)")
CELL = re.compile(r"(?:[\d,.]+|Rs\.? ?[\d,]+|\d+ ?%|NA|N/A|-?do-?|-|S\. ?No\.?|Unit \(\d+\)|[^\W\d_]+(?: [^\W\d_]+){0,2})$")
CELL_TOKEN = re.compile(r"-?do-?$|-$|\d+[^\W\d_]+$|S\.No|\(\d+\)$")
TOKEN = re.compile(r"[(\"“‘'\[]*(?:[^\W\d_]+(?:[-’'/][^\W\d_]+)*|[^\W_]*[ऀ-෿][ऀ-෿‌‍]*|Rs\.?|₹?\d[\d,.]*%?|\d+[A-Z]{0,2}|m²)[)\"”’'\],.;:!?%]*$")
NUMBERED_ROW = re.compile(r"(?:S\.No|\d+); ")
GAPS = re.compile(r"\S {3,}\S")
WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
SIGN = re.compile(r"[^\w\s]")
#: The same for text of ASCII characters alone.
PLAIN_WORD = re.compile(r"[a-z0-9]+(?:[-'][a-z0-9]+)*")
BLANKS = bytes(c for c in range(128) if chr(c).isspace())
NO_SIGNS = bytes(c for c in range(128) if chr(c).isspace() or chr(c).isalnum() or chr(c) == "_")
EDGE = "(\"“‘'[)”’],.;:!?%"
ENDINGS = (".", "!", "?", ":", ";", "”", '"', "।")
SECTION_LINE = ("Section:", "Subsection:")
NGRAMS = (2, 3, 4)
#: A text of so many words is boilerplate if this share of it is repeated running text, or one 4-gram covers it.
MIN_WORDS, BOILERPLATE = 20, 0.6
CACHE, LONGEST = 200_000, 100

KIND = T.StructType([
    T.StructField("word_count", T.IntegerType()),
    T.StructField("mean_word_length", T.DoubleType()),
    T.StructField("symbol_ratio", T.DoubleType()),
    T.StructField("punctuated_line_share", T.DoubleType()),
    T.StructField("common_word_share", T.DoubleType()),
    T.StructField("duplicate_line_share", T.DoubleType()),
    T.StructField("duplicate_paragraph_share", T.DoubleType()),
    *(T.StructField(f"top_{n}gram_share", T.DoubleType()) for n in NGRAMS),
    T.StructField("list_share", T.DoubleType()),
    T.StructField("table_share", T.DoubleType()),
    T.StructField("junk_share", T.DoubleType()),
    T.StructField("boilerplate_share", T.DoubleType()),
    T.StructField("kind", T.StringType()),
])


class Lines:
    """Sorts lines by form. common: lower-case function words of all languages."""

    def __init__(self, common: Iterable[str]):
        self.common = frozenset(common)
        self.seen: dict[str, tuple[int, bool]] = {}

    def token(self, tok: str) -> tuple[int, bool]:
        """(its length if it is unreadable, else 0; a function word)."""
        known = self.seen.get(tok)
        if known is None:
            word = tok.strip(EDGE)
            clean = TOKEN.match(tok) is not None
            if clean and word.isascii() and word.isalpha():
                clean = not (len(word) >= 3 and not VOWEL.search(word)) and not (len(word) == 1 and word not in "aAeI")
            known = 0 if clean else len(tok), word.lower() in self.common
            if len(tok) <= LONGEST:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                self.seen[tok] = known
        return known

    @staticmethod
    def cells(line: str, words: int) -> list[str] | None:
        bars = line.count("|")
        if bars >= 2 or "\t" in line or (bars and words < 10):
            return [c for c in (x.strip() for x in re.split(r"[|\t]", line)) if c]
        if "   " in line and GAPS.search(line):
            return [c.strip() for c in re.split(r" {3,}", line)]
        if ";" in line and NUMBERED_ROW.match(line):
            return [c for c in (x.strip() for x in line.split(";")) if c]
        if "  " in line:
            parts = re.split(r" {2,}", line)
            if len(parts) >= 3 and re.fullmatch(r"\d+|S\.No", parts[0]) and max(map(len, parts)) <= 30:
                return parts
        return None

    def form(self, line: str) -> str:
        """list, table, junk or prose, of one stripped line."""
        tokens = line.split()
        cells = self.cells(line, len(tokens))
        size = sum(map(len, tokens))
        get, token = self.seen.get, self.token
        if cells is not None:
            odd = 0
            for c in cells:
                parts = c.split()
                bad = sum([(get(x) or token(x))[0] > 0 and not CELL_TOKEN.match(x) for x in parts])
                odd += len(c) * (bad > len(parts) / 2)
            return "table" if odd <= 0.5 * size else "junk"
        flags = [get(x) or token(x) for x in tokens]
        odd = sum([f[0] for f in flags])
        single = len(line) <= 28 and CELL.match(line) is not None
        if odd > 0.5 * size and not (single and len(tokens) == 1):
            return "junk"
        if ENUMERATED.match(line) or BULLET.match(line):
            return "list"
        semicolons = line.count("; ")
        if semicolons >= 3 and semicolons * 100 > len(line):
            return "list"
        if single and line[-1] not in ".,":
            return "table"
        if len(tokens) >= 4 and True not in [f[1] for f in flags]:
            return "junk"
        return "prose"

    def kind(self, text: str, title: str | None = None, coverage: float = 0.0, site: Collection[int] = ()) -> tuple[str, dict[str, int]]:
        """Kind of the text, and the characters of each form. Section and site lines and the title count for nothing, repeated running text only as boilerplate. coverage: of the dominant n-gram; site: numbers from 1 of site lines."""
        sizes = {"prose": 0, "list": 0, "table": 0, "junk": 0, "boilerplate": 0}
        said: set[str] = set()
        for number, raw in enumerate(text.split("\n"), 1):
            line = raw.strip()
            if line and number not in site and not line.startswith(SECTION_LINE) and line != title:
                form = self.form(line)
                if form == "prose":
                    if line in said:
                        form = "boilerplate"
                    said.add(line)
                sizes[form] += len(line) + 1
        total = sum(sizes.values())
        if not total:
            return ("prose" if text.strip() else "empty"), sizes
        content = {k: n for k, n in sizes.items() if k != "boilerplate"}
        best = max(content, key=content.__getitem__)
        if len(text.split(None, MIN_WORDS)) > MIN_WORDS and (sizes["boilerplate"] >= BOILERPLATE * total or best == "prose" and coverage >= BOILERPLATE):
            best = "boilerplate"
        return best, sizes


def shares(items: list[str]) -> float:
    """Share of the characters of items that stand in items seen before."""
    total = sum(map(len, items))
    return 0.0 if not total else 1.0 - sum(map(len, set(items))) / total


def dominant(words: list[str]) -> list[int]:
    """For each of NGRAMS, characters in all occurrences of the run of so many words that occurs most often, the longest of several; 0 if none occurs twice."""
    out, at = [], range(len(words) - NGRAMS[0] + 1)
    for n in NGRAMS:
        if n > NGRAMS[0]:  # a run is repeated only where both shorter runs in it are
            at = [i for i, j in zip(at, at[1:]) if j == i + 1]
        runs = list(zip(words, words[1:])) if n == 2 else [tuple(words[i : i + n]) for i in at]
        counts = Counter(runs)
        times = max(counts.values(), default=0)
        out.append(times * max([sum(map(len, g)) for g, k in counts.items() if k == times]) if times > 1 else 0)
        at = [i for i, g in zip(at, runs) if counts[g] > 1]
    return out


def statistics(text: str | None, lines: Lines, title: str | None = None, site: Collection[int] = ()) -> tuple:
    text = text or ""
    if text.isascii():
        plain = text.encode()
        words, dense, signs = PLAIN_WORD.findall(text.lower()), len(plain.translate(None, BLANKS)), len(plain.translate(None, NO_SIGNS))
    else:
        words, dense, signs = WORD.findall(text.lower()), sum(map(len, text.split())), len(SIGN.findall(text))
    rows = [x for x in (r.strip() for r in text.split("\n")) if x]
    count, chars = len(words), sum(map(len, words))
    top = [min(1.0, size / chars) if chars else 0.0 for size in dominant(words)]
    kind, sizes = lines.kind(text, title, top[-1], site)
    total = max(1, sum(sizes.values()))
    return (
        count, chars / count if count else 0.0, signs / dense if dense else 0.0,
        sum([r.endswith(ENDINGS) for r in rows]) / len(rows) if rows else 0.0,
        sum(map(lines.common.__contains__, words)) / count if count else 0.0,
        shares(rows), shares([p.strip() for p in text.split("\n\n") if p.strip()]), *top,
        sizes["list"] / total, sizes["table"] / total, sizes["junk"] / total, sizes["boilerplate"] / total, kind,
    )


def common_words(words: DataFrame) -> list[str]:
    """The function-word table is fixed and small; it goes to every task."""
    return sorted({r.word.lower() for r in words.select("word").dropna().collect()})


def text_statistics(df: DataFrame, common: Iterable[str], text: str = "page_content", key: str = "chunk_id", title: str | None = "document_name", site: str | None = None, document: str | None = None) -> DataFrame:
    """One row per row of df: key and the fields of KIND. With site and document (columns), lines that are repeated too often over a site's documents count for no kind.

    Null and empty texts have zero statistics and the kind `empty`. Other columns
    of df are ignored, whatever their names. Whole texts are read.
    """
    common = frozenset(common)
    title_of = F.col(title) if title and title in df.columns else F.lit(None).cast("string")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *KIND.fields])
    nowhere = [F.lit(None).cast(t).alias(n) for n, t in (("site", "string"), ("container", "int"), ("place", "int"), ("removed", "array<int>"))]
    held: dict | None = {}
    rows = df.select(F.col(key).alias("__key"), title_of.alias("__title"), F.col(text).alias("text"), *nowhere)
    if site and document:
        own = df.select(F.col(key).alias("__key"), title_of.alias("__title"), F.col(text).alias("__text"), F.col(site).alias("__site"), F.col(document).alias("__document"))
        placed, lines = sitelines.excessive(own, "__text", "__site", "__document")
        held = sitelines.held_lines(lines)
        rows = placed.select("__key", "__title", "text", "site", "container", "place", nowhere[3])
        if held is None:  # too many for every task: marked by joins first
            marked = sitelines.cleaned(own.withColumn("__row", F.struct("__key", "__title")), "__text", "__site", "__document", "__row", delete=False)
            rows = marked.select("__row.*", F.col("__text").alias("text"), *nowhere[:3], "removed")
    shared = df.sparkSession.sparkContext.broadcast(held or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, lines, finder = to_arrow_schema(schema), Lines(common), sitelines.Finder(shared.value)
        for b in batches:
            each = zip(*(b.column(i).to_pylist() for i in range(1, 7)))
            rows = [statistics(t, lines, n, gone or (finder.found(t, s, c, p) if c is not None else ())) for n, t, s, c, p, gone in each]
            columns = list(zip(*rows)) if rows else [[]] * len(KIND)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:]))], schema=out)

    return rows.select("__key", "__title", "text", "site", "container", "place", "removed").mapInArrow(run, schema)
