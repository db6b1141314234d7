import random
from types import SimpleNamespace

import pytest

from granary.llm import lookalike, quality, repetition, sitelines, split

COMMON = ["the", "of", "and", "for", "in", "to", "at", "are", "by"]


# look-alikes


@pytest.fixture(scope="module")
def rewriter():
    return lookalike.Rewriter(lookalike.classes({"a": 9, "é": 5}))


@pytest.mark.parametrize("text,to,kinds", [
    ("ｌｅｎｔｉｌ", "lentil", ["width"]), ("𝚖𝚒𝚗𝚒𝚔𝚒𝚝 ﬁnish", "minikit finish", ["width"]), ("café", "café", ["combining"]), ("co​op­", "coop", ["invisible"]),
    ("a b　c", "a b c", ["space"]), ("sоlаr", "solar", ["lookalike"]), ("модель α β", "модель α β", []), ("क्‍षेत्र", "क्‍षेत्र", []), ("m² ½ № 5°C “as” – …", "m² ½ № 5°C “as” – …", []),
    ("Ａ​рple x", "Apple x", ["width", "invisible", "space", "lookalike"]), ("", "", []), (None, None, []),
])
def test_consistent_form(rewriter, text, to, kinds):
    assert rewriter.text(text) == (to, kinds)


def test_rewriting_twice_changes_nothing(rewriter):
    rng = random.Random(1)
    pool = list("abcé ") + list(lookalike.variants())[:400] + ["́"]
    for _ in range(200):
        once = rewriter.text("".join(rng.choices(pool, k=30)))[0]
        assert rewriter.text(once)[0] == once


def test_classes_are_transitive():
    to = lookalike.classes({"a": 3})
    assert to["ａ"] == to["а"] == to["𝚊"] == "a"


def test_long_runs_of_invisible_characters(rewriter):
    assert rewriter.text("a" + "​" * 200_000 + "b")[0] == "ab"


def test_marks_in_any_order_are_one_letter(rewriter):
    assert {rewriter.text(s)[0] for s in ("a\u0323\u0302", "a\u0302\u0323", "\u00e2\u0323", "\u1ea1\u0302")} == {"\u1ead"}
    assert rewriter.text("a" + "\u0301" * 8)[0] == "\u00e1" + "\u0301" * 7


def test_counts_choose_between_letters_of_one_class(spark):
    """The palochka looks like I and l: the pairs of letters of all texts choose."""
    rows = [("1", "Indian lentil fields. India and lentils " * 50, ""), ("2", "\u04c0ndia \u04c0entil", ""), ("3", "fie\u04cfd", "")]
    out = {r.chunk_id: r.page_content for r in lookalike.consistent_form(spark.createDataFrame(rows, "chunk_id string, page_content string, x string")).collect()}
    assert out["2"] == "India lentil" and out["3"] == "field"


def test_counts_decide_in_which_script_a_mixed_word_is(spark):
    """Cyrillic with Latin look-alikes stays Cyrillic where such words are frequent, and isn't reported as a Latin word."""
    odd = ("odd", "\u0422e\u0441\u0442", "")  # the second letter is Latin
    latin, cyrillic = ("1", "Tecton and other plain Latin text for the tests", ""), ("2", "\u0442\u0435\u0441\u0442 \u0422\u0435\u0441\u0442 \u043f\u0440\u043e\u0442\u0435\u0441\u0442 " * 200, "")
    schema = "chunk_id string, page_content string, x string"
    for rows, to, kind in (([latin, cyrillic, odd], "\u0422\u0435\u0441\u0442", "foreign"), ([latin, odd], "Tect", "lookalike")):
        found = {r.chunk_id: r for r in lookalike.consistent_form(spark.createDataFrame(rows, schema)).collect()}["odd"]
        assert found.page_content == to and found.deviations == [kind]


def test_letters_of_the_public_table(spark):
    more = lookalike.confusables(spark)
    assert more["\u0430"] == ("a",) and set(more["\u04c0"]) == {"I", "l"} and len(more) > 200


@pytest.mark.parametrize("answer", [None, "a\nb"])
def test_no_result_without_the_public_table(answer):
    """Without an answer, or with one that is too short, letters would stay unlinked and the rows look like any others."""

    class Jvm:
        def __getattr__(self, name):
            return self

        def __call__(self, *given):
            if answer is None:
                raise ConnectionError("no answer")
            return answer if given else self

    with pytest.raises(RuntimeError, match="table of confusable characters"):
        lookalike.confusables(SimpleNamespace(_jvm=Jvm()))


def test_consistent_form_of_a_table(spark):
    df = spark.createDataFrame([("1", "sоlar", "x"), ("1", "sоlar", "x"), ("2", None, None), ("3", "", "")], "chunk_id string, page_content string, deviations string")
    out = lookalike.consistent_form(df).collect()
    assert sorted((r.chunk_id, r.page_content or "", tuple(r.deviations)) for r in out) == [("1", "solar", ("lookalike",)), ("1", "solar", ("lookalike",)), ("2", "", ()), ("3", "", ())]
    assert lookalike.consistent_form(df.limit(0)).count() == 0


# kinds


@pytest.mark.parametrize("text,kind", [
    ("Section: A\n\nThe farmers of the block are to apply for pumps in the\nmonth of May and wait for the branch.", "prose"),
    ("• Pumps of the farm\n• Seeds for all\n* Bags of rice\n•Loans", "list"), ("a) bags of rice\nb) seeds for all\nc) pumps", "list"), ("one thing of a kind; two more; three; four of them; five; six", "list"),
    ("S.No | Item | Cost\n1 | pump | 40\n2 | seed | 12%", "table"), ("1\tpump\t40\n2\tseed\t50", "table"), ("S.No\nItem\n1\npump\n2\nseed bank\n3\nfarm", "table"), ("10pump|20seed|30rice|40bag", "table"),
    ("xkcd qwrt zzz\nbrr grr tsk pfft", "junk"), ("~~ {_[+ }~[)[ [ }]{{\n|\\ /# (@", "junk"), ("Skowex rhagix quebru vanwex\nTelvan noldri quetel brudri", "junk"), ("", "empty"), ("  \n ", "empty"),
])
def test_kind(text, kind):
    assert quality.Lines(COMMON).kind(text)[0] == kind


def test_repetition_decides_the_kind(spark):
    """A list under a line that returns again and again is a list; a text that says one thing over and over is boilerplate."""
    said = "The notice of the office is for all of the farmers in the block."
    items = "\n".join(f"{i}) bags of rice and {w} pumps" for i, w in enumerate("few many old new red cheap".split(), 1))
    rows = {"list": "\n".join([items, *[said] * 4]), "prose": "\n".join([items, *[said.replace("notice", w) for w in ("notice", "letter", "order", "word")]]), "over": "\n".join([said] * 200), "line": "pay the fee to the office " * 60}
    df = spark.createDataFrame([(k, t, None) for k, t in rows.items()], "chunk_id string, page_content string, document_name string")
    found = {r.chunk_id: r for r in quality.text_statistics(df, COMMON).collect()}
    assert {k: r.kind for k, r in found.items()} == {"list": "list", "prose": "prose", "over": "boilerplate", "line": "boilerplate"}
    assert found["over"].boilerplate_share > 0.99 and found["list"].boilerplate_share > 0.4 and found["line"].top_4gram_share > 0.6


def test_statistics_of_a_table(spark):
    df = spark.createDataFrame([("1", "The farm of the farm.\nThe farm of the farm.", None, "x"), ("2", None, None, None), ("3", "", "t", ""), ("4", "word " * 100_000, "t", "")], "chunk_id string, page_content string, document_name string, kind string")
    rows = {r.chunk_id: r for r in quality.text_statistics(df, COMMON).collect()}
    assert rows["1"].word_count == 10 and rows["1"].duplicate_line_share == 0.5 and rows["1"].common_word_share == 0.6 and rows["1"].punctuated_line_share == 1.0
    assert rows["2"].kind == rows["3"].kind == "empty" and rows["2"].word_count == 0 and rows["4"].top_2gram_share == 1.0
    assert quality.text_statistics(df.limit(0), COMMON).count() == 0


# site lines


def site_rows(n=60):
    rows = []
    for i in range(n):
        rows.append((f"c{i}", f"Section: all the same in every single document\nOwn line number {chr(97 + i % 26) * 22}{chr(97 + i // 26) * 3}\nShare  this page with your friends, {i} times\nshort", "a.example", f"d{i}", "x"))
    rows += [("c0", rows[0][1], "a.example", "d0", "y"), ("n1", "Share this page with your friends, times", None, "d1", ""), ("n2", None, "a.example", "d2", ""), ("n3", "", "a.example", "d3", ""), ("n4", "Share this page with your friends, times", "a.example", None, "")]
    rows += [(f"b{i}", "Share this page with your friends, times", "b.example", f"e{i}", "") for i in range(4)]
    return rows


SITE = "chunk_id string, page_content string, source_url string, document_id string, site string"


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_site_lines(spark, most_bytes):
    out = sitelines.cleaned(spark.createDataFrame(site_rows(), SITE), most_bytes=most_bytes).collect()
    assert len(out) == len(site_rows())
    by = {r.chunk_id: r for r in out}
    assert all(by[f"c{i}"].removed == [3] and "Share" not in by[f"c{i}"].page_content for i in range(60))
    assert by["c1"].page_content.split("\n")[0].startswith("Section") and len(by["c1"].page_content.split("\n")) == 3
    assert by["n1"].removed == [] and by["n2"].page_content is None and by["n3"].page_content == "" and by["n4"].removed == [] and by["b0"].removed == []


def test_site_lines_of_more_documents_than_tasks_hold(spark, monkeypatch):
    df = spark.createDataFrame(site_rows(), SITE)
    few = sorted((r.chunk_id, r.page_content or "", r.removed) for r in sitelines.cleaned(df).collect())
    monkeypatch.setattr(sitelines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sitelines, "MOST_LINES", 0)
    assert sorted((r.chunk_id, r.page_content or "", r.removed) for r in sitelines.cleaned(df).collect()) == few


def test_site_lines_in_dense_containers(spark, monkeypatch):
    monkeypatch.setattr(sitelines, "SPARSE", 8)
    for most in (1 << 20, 0):
        out = {r.chunk_id: r.removed for r in sitelines.cleaned(spark.createDataFrame(site_rows(), SITE), most_bytes=most).collect()}
        assert all(out[f"c{i}"] == [3] for i in range(60))


def test_variants_of_a_line_are_united_from_bitmaps(spark):
    facts = [("a", 1, 2, v, 0, p) for v, places in ((1, (3, 5, 32767)), (2, (5, 8))) for p in places] + [("a", 1, 2, 1, 4, 0)]
    maps = sitelines.bitmaps(spark.createDataFrame(facts, "site string, k1 bigint, k2 bigint, variant int, container int, place int"))
    assert {r.container: r.cardinality for r in maps.collect()} == {0: 4, 4: 1}
    packed = {r.container: bytes(r.data) for r in sitelines.compressed(maps).collect()}
    assert [p for p in range(32768) if sitelines.has(packed[0], p)] == [3, 5, 8, 32767] and len(packed[0]) == 8
    full = bytes(range(256)) * 16
    assert [sitelines.has(full, p) for p in range(64)] == [bool(full[p >> 3] >> (p & 7) & 1) for p in range(64)] and not sitelines.has(None, 3)


def test_lines_of_other_scripts(spark):
    line = "यह सूचना केवल सामान्य जानकारी के लिए है और कोई दायित्व नहीं है"
    rows = [(f"c{i}", f"{line}\n{'अलग ' * (i + 1)}", "a", f"d{i}", "") for i in range(8)]
    for every, gone in ((False, []), (True, [1])):
        assert {tuple(r.removed) for r in sitelines.cleaned(spark.createDataFrame(rows, SITE), every_script=every).collect()} == {tuple(gone)}


def test_no_site_lines(spark):
    df = spark.createDataFrame([], SITE)
    assert sitelines.cleaned(df).collect() == []


# pieces


def brute_boundary(text, limit):
    for name, seps in (("paragraph", ["\n\n"]), ("line", ["\n"]), ("sentence", ["\n", ". "]), ("word", ["\n", " "])):
        parts = [text]
        for s in seps:
            parts = [q for p in parts for q in p.split(s)]
        if max(map(len, parts)) <= limit:
            return name
    return "none"


def random_text(rng, n):
    return "".join(rng.choice(["word", "a", "longerword" * rng.randint(1, 4), ". ", "\n", "\n\n", " ", " ", "é", "क"]) for _ in range(n))


def test_pieces_cover_the_text_under_the_limit():
    rng = random.Random(3)
    for _ in range(150):
        text, limit = random_text(rng, rng.randint(1, 400)), rng.randint(5, 200)
        overlap = rng.randint(0, limit)
        assert split.boundary(text, limit) == brute_boundary(text, limit)
        found = split.pieces(text, limit, overlap)
        assert "".join(text[p[2] : p[3]] for p in found) == text
        kept = max(0, min(overlap, limit - 1))
        assert all(0 < len(p[5]) <= limit for p in found) and all(p[2] - p[1] == min(kept, p[2]) for p in found[1:])


def test_an_edit_changes_neighbouring_pieces_only():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(3000))
    edited = text[:9000] + "inserted words " + text[9000:]
    bodies = lambda t: {t[p[2] : p[3]] for p in split.pieces(t, 900, 90)}
    assert len(bodies(text) - bodies(edited)) <= 4


def test_split_table(spark):
    rules = spark.createDataFrame([("n", 50, 10, "x"), ("z", None, 3, "x"), ("n", 50, 10, "again")], "document_type string, max_chars int, overlap_chars int, boundary string")
    rows = [("1", "one two three. " * 20, "n", 1), ("2", "short", "n", 1), ("3", None, "n", 1), ("4", "", "n", 1), ("5", "x" * 100_000, "n", 1), ("6", "y" * 99, "other", 1), ("7", "y" * 99, None, 1), ("8", "y" * 99, "z", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, page_content string, document_type string, piece int")
    out = split.split(df, rules).collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_id, []).append(r)
    assert {k: len(v) for k, v in by.items() if k in "26 78"} == {"2": 1, "6": 1, "7": 1, "8": 1} and "3" not in by and "4" not in by
    assert {r.boundary for r in by["1"]} == {"sentence"} and {r.boundary for r in by["5"]} == {"none"} and by["2"][0].boundary is None
    assert max(len(r.piece) for r in by["5"]) == 50
    assert {r.chunk_id for r in split.split(df, rules, keep=False).collect()} == {"1", "5"}
    assert split.split(df.limit(0), rules).count() == 0


# repetition


def test_repetition(spark):
    spam = "buy cheap seed now today " * 30
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(1, spam, "en", 0.1), (2, own, " EN ", 0.1), (3, "few words only", "en", 0.1), (4, None, None, None), (5, "", "und", 0.0), (6, spam, None, 0.0), (7, "long text of the farm " * 50_000, "en", 0.0)]
    out = {r.doc_id: r for r in repetition.measured(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, words double"), COMMON).collect()}
    assert [k for k, r in out.items() if r.repetitive] == [1, 6, 7]
    assert out[2].repeated_run_share == 0.0 and out[3].char_distance is None and out[4].words == 0 and out[1].word_distance is not None
    assert repetition.measured(spark.createDataFrame([], "doc_id bigint, text string, lang string"), COMMON).count() == 0


def test_more_languages_than_tasks_hold(spark, monkeypatch):
    """References of any number of languages count, by a join where they are many."""
    rows = [(i, " ".join(f"{w}{i % 7} the" for w in "abcdefghijkl"), f"l{i % 5}" if i % 6 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    few = sorted(map(tuple, repetition.measured(df, COMMON).collect()))
    monkeypatch.setattr(repetition, "HELD_LANGUAGES", 2)
    many = sorted(map(tuple, repetition.measured(df, COMMON).collect()))
    assert few == many and all(r[5] is not None and r[6] is not None for r in few)


def test_run_share_and_distance():
    import numpy as np

    words = "a b c d e a b c d e".split()
    assert repetition.run_share(words) == pytest.approx(1 - 5 / 6) and repetition.run_share(["a"]) == 0.0
    p = np.array([1.0, 0.0])
    assert repetition.distance(p, p) == 0.0 and repetition.distance(p, np.array([0.0, 1.0])) == pytest.approx(1.0) and repetition.distance(p, np.zeros(2)) is None
