"""Values and structure out of lines: money, shares, capacities, numbered rows, headings, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as t

# Word lists and patterns that define the results.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi")
MONEY = r"(?i)(₹?\s*[0-9]+(?:\.[0-9]+)?\s*(?:crore|crores|lakh|lakhs|lac|lacs|rs\.?|rupees)?)"
PERCENT = r"(?i)(\b\d+(?:\.\d+)?\s*%)"
CAPACITY = r"(?i)(\b\d+(?:\.\d+)?\s*(?:MT|MTPD|KG|KGS|TON|TONS|LITRE|LITRES|L|KL|MW|KW)\b)"
TABLE_KEYWORDS = (
    "item", "items", "activity", "activities", "cost norms", "cost norm", "financial assistance", "assistance", "amount", "subsidy", "percentage", "project",
    "per unit", "per project", "warehouse", "warehouses", "silos", "pack house", "pack houses", "cold storage", "cold chain", "logistics", "processing",
    "ripening", "assaying", "sorting", "grading",
)
COMMON_HEADINGS = (
    "application procedure", "application process", "assistance", "background", "beneficiaries", "benefits", "checklist of documents", "conclusion",
    "conditions", "coverage", "credit facility", "documents", "documents required", "duration", "eligibility", "eligibility criteria", "eligible activities",
    "eligible beneficiaries", "eligible projects", "eligible projects for all beneficiaries", "eligible projects for building community farming assets",
    "financial assistance", "financial support", "funding", "funding pattern", "guidelines", "how to apply", "implementation", "implementation mechanism",
    "intended beneficiaries", "interest subsidy", "interest subvention", "introduction", "loan assistance", "monitoring", "monitoring mechanism", "objective",
    "objectives", "overview", "project activities", "project components", "project cost", "related resources", "scheme duration", "scheme objective",
    "scheme period", "scope", "support", "target beneficiaries", "terms and conditions",
)
NUMBERED = r"^\s*\d+[.)]\s+[A-Za-z]"
SUBNUMBERED = r"^\s*\d+(?:\.\d+)+[.)]?\s+[A-Za-z]"
LETTERED = r"^\s*[A-Z][.)]\s+[A-Za-z]"
LOWER_LETTERED = r"^\s*[a-z][.)]\s+[A-Za-z]"
MARKER = r"(?i)(?<!\w)\((?:" + "|".join(ROMAN) + r")\)\s*"
#: The longest first, as alternatives are tried in order.
HEADING_CHOICE = "|".join(sorted(map(re.escape, COMMON_HEADINGS), key=len, reverse=True)).replace(r"\ ", " ")


def found(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(t.text(c), F.lit(pattern), 1), t.squeezed), lambda x: x != "")


def money(c: Column) -> Column:
    return found(c, MONEY)


def percentages(c: Column) -> Column:
    return found(c, PERCENT)


def capacities(c: Column) -> Column:
    return found(c, CAPACITY)


def roman_value(c: Column) -> Column:
    """1 to 16; null for anything else."""
    at = F.array_position(F.array(*map(F.lit, ROMAN)), F.lower(t.strip(c)))
    return F.when(at > 0, at.cast("int"))


def roman_rows(c: Column) -> Column:
    """Parts that begin with a marker, and what stands before the first. Without a marker the whole text is one."""
    parts = F.split(t.text(c), r"(?i)(?=(?<!\w)\((?:" + "|".join(ROMAN) + r")\))", -1)
    return F.when(t.text(c) == "", F.array().cast("array<string>")).otherwise(F.filter(F.transform(parts, t.strip), lambda x: x != ""))


def activity_name(c: Column) -> Column:
    """What stands before the first amount, without the marker; 25 words at most."""
    text = t.strip(F.regexp_replace(t.squeezed(c), r"^((?:(?!" + MARKER.replace("(?i)", "(?i:") + r")).)*?)" + MARKER.replace("(?i)", "(?i:") + ")", "$1"))
    name = F.regexp_replace(F.regexp_replace(text, "^(.*?)" + MONEY.replace("(?i)(", "(?i:") + ".*$", "$1"), r"^[ :|\-]+|[ :|\-]+$", "")
    words = F.filter(F.split(name, " "), lambda w: w != "")
    return F.when(F.size(words) > 25, F.concat(F.array_join(F.slice(words, 1, 25), " "), F.lit("..."))).otherwise(name)


def semantic_row(c: Column) -> Column:
    """A table row as labelled values; the raw text follows if much of it is in none."""
    text = t.squeezed(c)
    name, costs, shares, sizes = activity_name(text), money(text), percentages(text), capacities(text)
    labelled = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))
    parts = F.array_compact(F.array(F.when(name != "", F.concat(F.lit("Activity: "), name)), labelled("Cost/Financial values: ", costs), labelled("Percentages: ", shares), labelled("Capacity: ", sizes)))
    held = F.length(F.array_join(F.concat(F.array(name), costs, shares, sizes), " "))
    parts = F.when(F.length(text) > held + 40, F.array_append(parts, F.concat(F.lit("OCR text: "), text))).otherwise(parts)
    return F.when(text == "", F.lit("")).when(F.size(parts) == 0, F.concat(F.lit("Original OCR: "), text)).otherwise(F.array_join(parts, " | "))


def table_like(c: Column) -> Column:
    """A line looks like a row of a table. Any number counts as money."""
    text = F.lower(t.squeezed(c))
    words = sum(((F.instr(text, k) > 0).cast("int") for k in TABLE_KEYWORDS), F.lit(0))
    cost, share, size = (t.text(c).rlike(p) for p in (MONEY, PERCENT, CAPACITY))
    out = t.text(c).rlike(r"[|\t]") | t.text(c).rlike(MARKER) | (words >= 2) | ((words >= 1) & (cost | share | size)) | (cost & size)
    return (t.text(c) != "") & out


# Headings


def page_marker(c: Column) -> Column:
    s = F.lower(t.strip(t.text(c)))
    return s.rlike(r"^page\s+\d+$") | s.startswith("extraction method:") | s.startswith("image count:") | s.rlike(r"^[#=_\-]{5,}$")


def bullet(c: Column) -> Column:
    return t.strip(t.text(c)).rlike(f"^{t.HEADING_BULLETS}")


def words(c: Column) -> Column:
    return F.regexp_count(t.text(c), F.lit(f"{t.WORD}+"))


def letter_share(c: Column) -> Column:
    return F.when(F.length(t.text(c)) > 0, F.length(F.regexp_replace(t.text(c), r"\P{L}", "")) / F.length(t.text(c))).otherwise(0.0)


def mostly_upper(c: Column) -> Column:
    letters, upper = (F.length(F.regexp_replace(t.text(c), p, "")) for p in (r"\P{L}", r"\P{Lu}"))
    return (letters >= 4) & (upper >= letters * 0.8)


def sentence_like(c: Column) -> Column:
    return (words(c) > 15) | t.text(c).rlike("[.,;:]$")


def heading_words(c: Column) -> Column:
    return F.lower(t.heading_text(c)).rlike(f"^(?:{HEADING_CHOICE})(?:$|:)")


def common_heading(c: Column) -> Column:
    """The known heading at the start of a line; null if there is none."""
    whole = t.heading_text(c)
    start = F.regexp_extract(F.lower(whole), f"^({HEADING_CHOICE}) ", 1)
    return F.when(F.lower(whole).isin(*COMMON_HEADINGS), whole).when(start != "", t.strip(F.substring(t.text(c), F.lit(1), F.length(start))))


def heading_and_rest(c: Column, whole: Column | None = None) -> Column:
    """Struct of a known heading at the start and what follows it on the line; a null heading if there is none. whole: the line without number and bullet, if it is at hand."""
    whole = t.heading_text(c) if whole is None else whole
    start = F.regexp_extract(F.lower(whole), f"^({HEADING_CHOICE}) ", 1)
    exact, begins = F.lower(whole).isin(*COMMON_HEADINGS), start != ""
    rest = t.strip(F.substr(whole, F.length(start) + 1))
    return F.struct(F.when(exact, whole).when(begins, start).alias("heading"), F.when(exact, F.lit("")).when(begins, rest).otherwise(t.text(c)).alias("rest"))


def heading(c: Column, whole: Column | None = None) -> Column:
    """A line is a heading and nothing else. The first rule that applies decides."""
    s = t.strip(t.text(c))
    parts = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    titled = F.size(F.filter(parts, lambda w: F.regexp_replace(w, "[^A-Za-z]", "").rlike("^[A-Z]")))
    known = F.lower(t.heading_text(s) if whole is None else whole)
    return (
        F.when((s == "") | page_marker(s) | bullet(s) | (F.length(s) < 3), False)
        .when(s.rlike(SUBNUMBERED) | s.rlike(NUMBERED) | s.rlike(LETTERED) | s.rlike(LOWER_LETTERED) | known.isin(*COMMON_HEADINGS), True)
        .when(known.rlike(f"^(?:{HEADING_CHOICE}) "), False)
        .when(mostly_upper(s) & (words(s) <= 12), True)
        .when(sentence_like(s), False)
        .otherwise(F.size(parts).between(1, 10) & (titled >= F.greatest(F.lit(1.0), F.size(parts) * 0.5)))
    )


def level(c: Column) -> Column:
    depth = F.length(F.regexp_replace(F.regexp_extract(t.text(c), r"^\s*(\d+(?:\.\d+)+)", 1), r"[^.]", ""))
    return F.when(t.text(c).rlike(SUBNUMBERED), F.when(depth >= 2, 3).otherwise(2)).when(t.text(c).rlike(NUMBERED), 1).when(t.text(c).rlike(LETTERED), 2).when(t.text(c).rlike(LOWER_LETTERED), 3).otherwise(1)
