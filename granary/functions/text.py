"""Text normalisation as column expressions; a pandas UDF only where a fold over lines or NFKC is needed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Replacements and patterns that define the results.
NOISE_HOSTS = ("vikaspedia.in",)
PAGE_REPLACEMENTS = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " ", "\u2026": "...", "\u2022": "-", "\u00ad": "",
}
JOINED_WORDS = {
    "Infrastructurefor": "Infrastructure for", "financingfacility": "financing facility", "post-harvestmanagement": "post-harvest management",
    "farm-gateand": "farm-gate and", "Eligibleprojects": "Eligible projects", "beneficiariesA": "beneficiaries A", "smartand": "smart and",
    "precisionagriculture": "precision agriculture", "Howto": "How to", "Relatedresources": "Related resources",
}
#: Word characters are letters, numbers of any kind and the underscore; marks are none.
WORD = r"[\p{L}\p{N}_]"
ASCII_WORD = rf"(?<!{WORD})[A-Za-z0-9]+(?!{WORD})"
HEADING_BULLETS = r"[*•°◦▪▫‣⁃·\-]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def normalized(c: Column) -> Column:
    """The identity of a text for matching: lower case, letters a to z and digits, single spaces."""
    spaced = F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; an accented letter ends a run."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)"), 1)


def lines(c: Column) -> Column:
    """Lines as by every line break there is; a break at the end starts no line."""
    return F.split(F.regexp_replace(text(c), f"(?:{LINE_BREAKS})$", ""), LINE_BREAKS, -1)


def cleaned(c: Column, hosts: tuple[str, ...] = NOISE_HOSTS) -> Column:
    """Page text without addresses; straight quotes and hyphens; at most one blank line in a row."""
    out = F.translate(text(c), "\x00", " ")
    for host in hosts:
        out = F.regexp_replace(out, f"(?i){re.escape(host)}", " ")
        out = F.regexp_replace(out, f"(?i)www\\.{re.escape(host)}", " ")
    out = F.regexp_replace(out, r"(?i)http[s]?://\S+", " ")
    out = F.translate(out, "–—“”‘’", "--\"\"''")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n"))


# Scanned text


def ocr_unicode(c: Column) -> Column:
    return F.translate(c, "\u2018\u2019\u201c\u201d\u00a0\u200b\u200c\u200d", "''\"\" ")


def ocr_whitespace(c: Column) -> Column:
    out = F.translate(c, "\t", " ")
    out = F.regexp_replace(out, r"\s+([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(out, " {2,}", " "), r"\n{3,}", "\n\n")


def word_spacing(c: Column) -> Column:
    for joined, apart in JOINED_WORDS.items():
        c = F.replace(c, F.lit(joined), F.lit(apart))
    return c


def bullets(c: Column) -> Column:
    return F.translate(c, "•▪●·", "****")


def without_noise_lines(c: Column, hosts: tuple[str, ...] = NOISE_HOSTS) -> Column:
    """Lines that hold only a host's name go; blank lines become empty."""
    names = "|".join(re.escape(h) for h in hosts)
    kept = F.filter(lines(c), lambda x: ~x.rlike(rf"(?i)^\s*(?:www\.)?(?:{names})\s*$"))
    return F.array_join(F.transform(kept, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(x)), "\n")


def ocr_normalized(c: Column) -> Column:
    return F.when(text(c) == "", F.lit("")).otherwise(strip(ocr_whitespace(word_spacing(bullets(without_noise_lines(ocr_unicode(c)))))))


# Text of pages


def without_controls(c: Column) -> Column:
    """Control, format and unassigned characters as spaces, but for line breaks and tabs."""
    return F.regexp_replace(text(c), r"[\p{C}&&[^\n\r\t]]", " ")


def page_spaces(c: Column) -> Column:
    out = F.regexp_replace(F.translate(text(c), "\t", " "), " {2,}", " ")
    return F.regexp_replace(F.regexp_replace(out, r" +\n", "\n"), r"\n +", "\n")


def unhyphenated(c: Column) -> Column:
    """Words cut at a line end are joined, whatever they are."""
    return F.regexp_replace(text(c), r"([A-Za-z])-\n([A-Za-z])", "$1$2")


def punctuation_spacing(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"\s+([,.;:!?])", "$1"), r"([,;:])([A-Za-z])", "$1 $2")


def single_punctuation(c: Column) -> Column:
    out = F.regexp_replace(text(c), r"\.{4,}", "...")
    return F.regexp_replace(F.regexp_replace(out, "!{2,}", "!"), r"\?{2,}", "?")


# What starts a line of its own, and what ends a sentence.
NEW_HEADING = re.compile(r"\d+(?:\.\d+)*[.)]?\s+|[A-Z][A-Z\s&/\-]{3,}")
NEW_ITEM = re.compile(r"(?:[-*•]|\(?\d+[.)]|\(?[a-zA-Z][.)])\s+")
SENTENCE_ENDS = (".", "!", "?", ":", ";")


def unwrap(page: str) -> str:
    """Lines of one sentence as one line. Headings and items start a line; a lower-case line never does, unless it looks like a heading."""
    out: list[str] = []
    open_line = ""
    for line in (x.strip() for x in page.splitlines()):
        if line and open_line:
            heading = NEW_HEADING.match(line)
            goes_on = not heading and (line[0] in "abcdefghijklmnopqrstuvwxyz" or not (NEW_ITEM.match(line) or open_line.endswith(SENTENCE_ENDS)))
            if goes_on:
                open_line = f"{open_line} {line}"
                continue
        if open_line:
            out.append(open_line)
        open_line = line
        if not line:
            out.append("")
    return "\n".join([*out, open_line] if open_line else out)


def page_unicode(s: str) -> str:
    return unicodedata.normalize("NFKC", s).translate(str.maketrans(PAGE_REPLACEMENTS))


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """NFKC and plain quotes, hyphens and dots; ASCII text is left alone."""
    return c.map(lambda s: "" if s is None else s if s.isascii() else page_unicode(s))


@F.pandas_udf(StringType())
def unwrapped(c: pd.Series) -> pd.Series:
    return c.map(lambda s: unwrap(s) if s else "")


def page_cleaned(c: Column) -> Column:
    """All steps for the text of a page, in their order."""
    out = page_spaces(unhyphenated(page_spaces(without_controls(nfkc(text(c))))))
    out = single_punctuation(punctuation_spacing(unwrapped(out)))
    return strip(F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n"))


# Tables and headings


def table_line(c: Column) -> Column:
    out = F.regexp_replace(F.translate(text(c), "\x00\t", "  "), r" {2,}", " ")
    return strip(F.regexp_replace(out, r"\s+([,.;:])", "$1"))


def roman_marker(c: Column) -> Column:
    """The marker at the start in one pair of parentheses; strokes before it go."""
    out = F.regexp_replace(squeezed(c), r"^[|lI\s]*", "")
    out = F.regexp_replace(out, r"^\(+\s*", "(")
    return squeezed(F.regexp_replace(out, r"^([^)]*)\)+\s*", "$1) "))


def type_name(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), "- ", "__")


def heading_text(c: Column) -> Column:
    """A heading without number, letter or bullet in front."""
    out = F.regexp_replace(strip(text(c)), r"^\s*\d+(?:\.\d+)*[.)]?\s*", "")
    out = F.regexp_replace(out, r"^\s*[A-Za-z][.)]\s*", "")
    return squeezed(F.regexp_replace(out, rf"^{HEADING_BULLETS}\s*", ""))


def short_id(c: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 16)


def filled(*names: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in names))
