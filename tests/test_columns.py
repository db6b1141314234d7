"""Column expressions against plain Python on small rows."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import extract as x
from granary.functions import quality as q
from granary.functions import text as t
from granary.operators.chunking import merged, recursive_split


def one(spark, expression, value):
    """The value of an expression over one column c of one row."""
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("v")).first().v


TEXTS = [None, "", "  ", "PM-KISAN (2024-25)", "A\tb\n\n\n\nc — “x” http://a.b/c d", "Résumé x_y 12", "line\r\nnext\x0cthird ", "a" * 300, "1.2) Scheme Objective", "(ii) 12.5 lakh 30 % 6MT"]


def test_golden(spark):
    assert one(spark, t.normalized, "PM-KISAN (2024-25)") == "pm kisan 2024 25"
    assert one(spark, t.tokens, "PM-KISAN 2024 é1") == ["pm", "kisan", "2024", "1"]
    assert one(spark, t.short_id, "abc") == "a9993e364706816a"
    assert one(spark, t.type_name, " Agriculture Infra-Fund ") == "agriculture_infra_fund"
    assert one(spark, t.roman_marker, "| ((ii)) Warehouses") == "(ii) Warehouses"
    assert one(spark, t.heading_text, " 1.2) A. • Scheme   period ") == "Scheme period"
    assert one(spark, t.ocr_normalized, "• Howto apply ,now\nwww.vikaspedia.in\n\n\n\nx") == "* How to apply,now\n\nx"
    assert one(spark, t.cleaned, "see www.vikaspedia.in or https://x.y/z –ok’s") == "see www. or -ok's"  # the bare name goes first
    assert one(spark, t.unhyphenated, "infrastruc-\nture 1-\n2") == "infrastructure 1-\n2"
    assert one(spark, t.single_punctuation, "a..... b!! c???") == "a... b! c?"


@pytest.mark.parametrize("value", TEXTS)
def test_normalized_against_python(spark, value):
    def plain(s):
        s = re.sub(r"[-_/]+", " ", (s or "").lower())
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s)).strip()

    assert one(spark, t.normalized, value) == plain(value)
    assert one(spark, t.tokens, value) == re.findall("[a-z0-9]+", (value or "").lower())
    assert one(spark, x.words, value) == len(re.findall(r"\b\w+\b", value or ""))
    assert one(spark, lambda c: F.size(t.lines(c)), value) == max(1, len((value or "").splitlines()))
    kept = "".join(" " if unicodedata.category(ch).startswith("C") and ch not in "\n\r\t" else ch for ch in value or "")
    assert one(spark, t.without_controls, value) == kept


def test_page_cleaning(spark):
    raw = "THE FUND\nThe Agriculture Infrastruc-\nture  fund gives\nhelp .It is\n\n• first item\n2. second\nand more..... ﬁn"
    assert one(spark, t.page_cleaned, raw) == "THE FUND The Agriculture Infrastructure fund gives help.It is\n\n- first item\n2. second and more... fin"
    assert t.unwrap("a\n\nB.\nC") == "a\n\nB.\nC" and t.unwrap("") == ""


def test_values(spark):
    line = "(ii) Pack house 145.00 lakh 30 % subsidy 6 MT"
    assert one(spark, x.money, line) == ["145.00 lakh", "30", "6"]
    assert one(spark, x.percentages, line) == ["30 %"] and one(spark, x.capacities, line) == ["6 MT"]
    assert one(spark, x.activity_name, line) == "Pack house"
    assert one(spark, x.semantic_row, line) == "Activity: Pack house | Cost/Financial values: 145.00 lakh, 30, 6 | Percentages: 30 % | Capacity: 6 MT"
    assert one(spark, x.semantic_row, "") == "" and one(spark, x.money, None) == []
    assert one(spark, x.roman_rows, "Items (i) a (ii) b") == ["Items", "(i) a", "(ii) b"] and one(spark, x.roman_rows, "plain ") == ["plain"]
    assert one(spark, x.roman_value, " XII ") == 12 and one(spark, x.roman_value, "xx") is None
    assert one(spark, x.table_like, "a | b") and one(spark, x.table_like, "cold storage and pack house") and not one(spark, x.table_like, "We met in May") and not one(spark, x.table_like, "")


@pytest.mark.parametrize("line,found,level", [
    ("1. Objectives of it", True, 1), ("1.2 Scope", True, 2), ("1.2.3 Scope", True, 3), ("A. Part", True, 2), ("b) part", True, 3), ("eligibility", True, 1), ("Eligibility for all", False, 1), ("PAGE 4", False, 1), ("• item", False, 1),
    ("GENERAL RULES OF IT", True, 1), ("This is a sentence.", False, 1), ("Main Rules of Award", True, 1), ("ab", False, 1), ("====== ", False, 1), ("the main rules", False, 1),
])
def test_headings(spark, line, found, level):
    assert one(spark, x.heading, line) == found and one(spark, x.level, line) == level


def test_heading_with_rest(spark):
    got = one(spark, x.heading_and_rest, "Eligible projects for all beneficiaries A pack house")
    assert (got.heading, got.rest) == ("eligible projects for all beneficiaries", "A pack house")
    got = one(spark, x.heading_and_rest, "Something else")
    assert (got.heading, got.rest) == (None, "Something else")
    assert one(spark, x.common_heading, "Coverage") == "Coverage" and one(spark, x.common_heading, "Nothing") is None and one(spark, x.heading_words, "Scope: all")


def test_gates(spark):
    long = "The farmers of the block may apply for pumps and seeds at the branch office before the end of the month of May in each year."
    assert one(spark, q.sufficient, long) and not one(spark, q.sufficient, "short") and not one(spark, q.sufficient, None) and not one(spark, q.sufficient, "word " * 40)
    assert one(spark, q.artifacts, "") == ["empty_text"] and "possible_word_joining" in one(spark, q.artifacts, "x" * 40) and "symbol_sequence" in one(spark, q.artifacts, "a ######## b")
    row = one(spark, lambda c: q.ocr_quality(c, F.lit(0.5)), long)
    assert row.warning and row.has_meaningful_text and row.issues == ["low_ocr_confidence"] and row.line_count == 1
    row = one(spark, lambda c: q.text_quality(c, F.lit(0.9)), "few words")
    assert row.issues == ["very_short_text", "low_word_count"] and row.word_count == 2


def test_relevance_scope_and_filters(spark):
    rows = spark.createDataFrame([(1, "0.05", None), (2, None, None), (3, "x", None), (4, "0.05", "0.2"), (5, "0.1", None)], "k int, s string, e string")
    assert [r.k for r in rows.where(q.relevant(F.col("s"), F.col("e"))).collect()] == [2, 3, 4, 5]
    rows = spark.createDataFrame([(1, "India", None), (2, "State", "Goa"), (3, "State", "goa"), (4, None, "Goa"), (5, "", None)], "k int, scope string, own string")
    keep = lambda state: [r.k for r in rows.where(q.in_scope(F.col("scope"), F.col("own"), F.lit(state))).collect()]
    assert keep("GOA") == [1, 2, 3] and keep(None) == [1, 2, 3, 4, 5] and keep("Bihar") == [1]
    assert [r.k for r in rows.where(q.matches({"scope": "State", "own": "goa"})).collect()] == [3] and rows.where(q.matches({})).count() == 5 and rows.where(q.matches({"own": None})).count() == 2


def test_metadata_errors(spark):
    good = dict(source="s", file_name="f", document_type="d", page=1, page_number=1, section="x", content_type="list", ocr_confidence=0.5, has_ocr_warning=False, parser="p", extraction_method="e", language="en", version="1")
    bad = {**good, "source": " ", "page": 0, "ocr_confidence": 1.5, "version": None}
    schema = "source string, file_name string, document_type string, page int, page_number int, section string, content_type string, ocr_confidence double, has_ocr_warning boolean, parser string, extraction_method string, language string, version string"
    df = spark.createDataFrame([tuple(good.values()), tuple(bad.values())], schema)
    first, second = (r.e for r in df.select(q.metadata_errors(df.columns).alias("e")).collect())
    assert first == [] and second == ["Missing required metadata field: version", "Metadata 'source' cannot be empty.", "Metadata 'page' must be >= 1.", "Metadata 'ocr_confidence' must be between 0.0 and 1.0."]
    assert "Missing field: parser" in df.drop("parser").select(q.missing(df.drop("parser").columns, q.DOCUMENT_FIELDS, F.lit("x")).alias("e")).first().e


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.,;", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_recursive_split_keeps_the_limit_and_the_text(text, size, overlap):
    parts = recursive_split(text, size, min(overlap, size - 1), ("\n\n", "\n", ". ", "; ", ", ", " ", ""))
    assert all(0 < len(p) <= size for p in parts)
    if overlap == 0:
        assert "".join("".join(parts).split()) == "".join(text.split())


def test_merged():
    assert merged(["aa", " bb", " cc", " dd"], 6, 3) == ["aa bb", "bb cc", "cc dd"]
