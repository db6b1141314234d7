"""Which scheme a question is about, whether it asks for a fact, and what to ask beside it.

The registry is a small table (scheme_key, name, file_name, alias, ord), one row an
alias; it is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as t
from granary.runtime import BROADCAST_ROWS

# Words and patterns of questions for facts.
FACT_KEYWORDS = (
    "achieved", "allocated", "amount", "approved", "beneficiaries", "beneficiary", "cost", "coverage", "covered", "financial year", "fund", "funding", "fy",
    "how many", "how much", "insurance", "insured", "number", "percent", "percentage", "quantity", "rate", "sanctioned", "spent", "target", "total", "year",
)
PROMPT_KEYWORDS = (
    "how much", "how many", "what percentage", "what percent", "what is the amount", "what was the amount", "what is the number", "what was the number",
    "total number", "total amount", "number of", "amount of", "percentage of", "in financial year", "financial year", "fy ", "year ", "during 2024",
    "during 2025", "during 2026", "insured", "beneficiaries", "beneficiaries covered", "coverage",
)
CONTENT_TERMS = (
    "how much", "how many", "number", "total", "amount", "quantity", "percentage", "percent", "rate", "insured", "insurance", "coverage", "covered",
    "beneficiaries", "beneficiary", "financial year",
)
# The wording of further questions, with a scheme's name or years asked for or both.
BOTH_KNOWN = ("{name} financial year {years} total number beneficiaries insured covered amount percentage", "{name} {years} total insured number quantity coverage")
NAME_KNOWN = ("{name} total number amount percentage beneficiaries insured coverage",)
YEARS_KNOWN = ("financial year {years} total number amount percentage beneficiaries insured coverage",)
FACT_PATTERN = r"\bfy\s*20\d{2}\b|\bfinancial year\b|\b\d+(?:\.\d+)?\s*(?:lakh|crore|million|billion|percent)?\b"
#: Years as they are written, which normalisation makes unfindable, and as they look after it.
YEARS = {"actual": r"(\b20\d{2}\s*[-/]\s*(?:20)?\d{2}\b)", "intended": r"(\b20\d{2}\s+(?:20)?\d{2}\b)"}


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def fact(question: Column) -> Column:
    """The question asks for a number, an amount or a year. Words count as parts of others."""
    c = t.normalized(question)
    return (c != "") & (c.rlike(FACT_PATTERN) | contains_any(c, FACT_KEYWORDS))


def fact_prompt(question: Column) -> Column:
    return contains_any(F.lower(t.text(question)), PROMPT_KEYWORDS)


def detected(questions: DataFrame, registry: DataFrame, query: str = "query_id", text: str = "question") -> DataFrame:
    """questions with scheme_key, scheme_name, file_name and matched_alias: the longest alias that stands in the question as whole words; ties go to the earlier entry. All null without one.

    Aliases that begin with the same word meet the questions by that word, so the
    join is on a key and not on every pair.
    """
    aliases = registry.select("scheme_key", F.col("name").alias("scheme_name"), "file_name", F.col("alias").alias("matched_alias"), "ord", t.normalized(F.col("alias")).alias("__alias")).where("__alias <> ''")
    aliases = aliases.withColumn("__word", F.split("__alias", " ")[0])
    asked = questions.select(query, t.normalized(F.col(text)).alias("__question"))
    words = asked.select(query, "__question", F.explode(F.array_distinct(F.split("__question", " "))).alias("__word"))
    inside = F.contains(F.concat(F.lit(" "), "__question", F.lit(" ")), F.concat(F.lit(" "), "__alias", F.lit(" ")))
    hits = words.join(F.broadcast(aliases) if registry.count() <= BROADCAST_ROWS else aliases, "__word").where(inside)
    best = Window.partitionBy(query).orderBy(F.length("__alias").desc(), "ord")
    hits = hits.withColumn("__at", F.row_number().over(best)).where("__at = 1")
    return questions.join(hits.select(query, "scheme_key", "scheme_name", "file_name", "matched_alias"), query, "left")


def of_scheme(target: Column, *files: Column) -> Column:
    """Any of a document's file names equals or contains the scheme's, both normalised."""
    goal = t.normalized(target)
    return F.coalesce((goal != "") & F.exists(F.array(*files), lambda f: F.coalesce(F.contains(t.normalized(f), goal), F.lit(False))), F.lit(False))


def prioritized(df: DataFrame, match: str = "scheme_match", position: str = "position", query: str = "query_id") -> DataFrame:
    """A new position: rows of the scheme first, either group in its order."""
    order = Window.partitionBy(query).orderBy(F.col(match).desc(), position)
    return df.withColumn(position, F.row_number().over(order))


def variants(question: Column, key: Column, name: Column, years: str = "actual", extra: dict[str, tuple[str, str]] | None = None) -> Column:
    """The question and further ones that ask for the same fact, without repetitions.

    extra: for the key of a scheme, two more templates of its own.
    """
    found = F.array_join(F.regexp_extract_all(t.normalized(question), F.lit(YEARS[years]), 1), " ")
    known, dated = t.text(name) != "", found != ""
    both, own, when = (F.array(*(F.replace(F.replace(F.lit(x), F.lit("{name}"), t.text(name)), F.lit("{years}"), found) for x in templates)) for templates in (BOTH_KNOWN, NAME_KNOWN, YEARS_KNOWN))
    none = F.array().cast("array<string>")
    more = F.when(known & dated, both).when(known, own).when(dated, when).otherwise(none)
    for k, templates in (extra or {}).items():
        more = F.when(key.eqNullSafe(F.lit(k)), F.concat(more, F.array(*map(F.lit, templates)))).otherwise(more)
    every = F.concat(F.array(question), more)
    keyed = F.transform(every, lambda s, i: F.struct(t.normalized(s).alias("k"), s.alias("s"), i.alias("i")))
    firsts = F.filter(keyed, lambda e: (e["k"] != "") & ~F.exists(keyed, lambda o: (o["k"] == e["k"]) & (o["i"] < e["i"])))
    return F.transform(firsts, lambda e: e["s"])
