import numpy as np
import pytest

from granary.llm import noise
from granary.llm.noise import Model, Scanner, near, skip_gram, strokes

COMMON = frozenset(["the", "of", "and", "for", "in", "to", "at"])
WORDS = {w: 5000 for w in "farmers tenant growers committee solar pumps support claim storage from under branch field the of and for in to at cotton may".split()}
FIELDS = "record_id string, text string, name string, issuer string, page int, chunk boolean, extra string"


@pytest.fixture(scope="module")
def scanner():
    return Scanner(Model({**WORDS, "geo-tag": 900, "farm-gate": 800, "velanpura": 300, "5hp": 100}, 2_000_000), COMMON)


def test_strokes_make_confused_glyphs_equal():
    for a, b in [("so1ar", "solar"), ("committcc", "committee"), ("cottori", "cotton"), ("brancli", "branch"), ("purnps", "pumps"), ("fie1cl", "field"), ("gr0wers", "growers"), ("c°tton", "cotton")]:
        assert strokes(a) == strokes(b)


@pytest.mark.parametrize("token,to", [("so1ar", "solar"), ("sol@r", "solar"), ("pu{mps", "pumps"), ("tenantgrowers", "tenant growers"), ("tenant,growers", "tenant growers"), ("tenantjgrowers", "tenant growers"), ("2O16", "2016"), ("48,5O0", "48,500"), ("Velanpur@", "velanpura")])
def test_misread_words(scanner, token, to):
    assert scanner.word(token, []) == to


@pytest.mark.parametrize("token", ["solar", "Solar.", "12,500", "448A", "99B.", "5HP", "Śilpā", "(पशु", "geo-tag", "farmers!", "unheard", "m²", "x" * 5000])
def test_sound_words(scanner, token):
    assert scanner.word(token, []) is None


def test_lines_of_each_noise(scanner):
    text = "Section: General\n\nHarit Mission - Velanpura Norms 2015  ....  3\nThe commit-\n3 |\ntee may geo-\ntag the so1ar pumps of the farmers\n\nof Velanpura."
    found, fixed = scanner.scan(text, "Harit Mission - Velanpura Norms 2015", "Board of Fields", 3)
    assert sorted(found) == [(3, "header"), (4, "hyphen"), (5, "pageno"), (7, "misread")]
    assert fixed == "Section: General\n\nThe committee may geo-tag the solar pumps of the farmers of Velanpura."


def test_title_on_the_first_page_is_no_head(scanner):
    text = "Section: General\n\nHarit Mission - Velanpura Norms 2015\n\nThe committee of the farmers"
    assert scanner.scan(text, "Harit Mission - Velanpura Norms 2015", None, 1)[0] == []
    assert scanner.scan(text, "Harit Mission - Velanpura Norms 2015", None, 4)[0] == [(3, "header")]


def test_cells_are_no_page_numbers(scanner):
    table = "S.No\nfield\n1\ncotton\n2\nstorage\n3\nbranch\n4\nsolar"
    assert scanner.scan(table, "x", None, 3)[0] == []


def test_near():
    assert near("klsankoshdigest", "kisankoshdigest") and not near("abcdefgh", "hgfedcba") and not near("", "abc")


def test_skip_gram_puts_words_of_like_contexts_together(spark):
    rng, rows = np.random.default_rng(0), []
    for w in range(20):  # two words for each of ten groups of contexts
        found, n = np.unique(w // 2 * 6 + rng.integers(0, 6, 400), return_counts=True)
        rows.append((w, found.tolist(), n.tolist()))
    v, _ = skip_gram(spark.createDataFrame(rows, "word int, contexts array<int>, numbers array<bigint>"), 20, 60)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    likeness = unit @ unit.T
    assert all(likeness[w, w ^ 1] > 0.6 for w in range(20)) and abs(likeness[0, 2:]).max() < 0.3


def test_skip_gram_agrees_with_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 60, (150, 24)) * (rng.random((150, 24)) < 0.5)
    rows = [(w, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for w, r in enumerate(counts)]
    v, c = skip_gram(spark.createDataFrame(rows, "word int, contexts array<int>, numbers array<bigint>").repartition(3), 150, 24)
    with np.errstate(divide="ignore"):
        goal = np.maximum(0, np.log(counts * counts.sum() / np.outer(counts.sum(1), counts.sum(0))) - np.log(noise.NEGATIVES))
    assert np.abs(v @ c.T - goal).max() < 0.02


def corpus():
    """A word for dry land that has the strokes of `and`, and a building that scanning shortens to a rare word."""
    rng, rows = np.random.default_rng(2), []
    lands, things = "zones tracts soils belts regions".split(), "seeds pumps loans tools goats ponds carts hens".split()
    for i in range(900):
        a, b = rng.choice(things, 2)
        rows.append(f"farmers buy {a} and {b} from traders here every season")
    for i in range(30):
        rows.append(f"rainfall stays low across arid {lands[i % 5]} where millet survives drought")
        rows += [f"rainfall stays low across {x} {lands[i % 5]} where millet survives drought" for x in ("semidry", "parched")]
    for i in range(200):
        rows.append("store harvested grain inside barn lofts behind village granary")
    return rows


def test_vectors_decide_which_rare_words_are_misread(spark):
    extra = [("odd", "store harvested grain inside bam lofts behind village granary"), ("other", "farmers buy bam from traders here every season")]
    rows = [(f"r{i}", t, None, None, None, False, None) for i, t in enumerate(corpus())] + [(k, t, None, None, None, False, None) for k, t in extra]
    df = spark.createDataFrame(rows, FIELDS)
    model = noise.learn(df)
    assert "arid" in model.known and model.closeness("arid", "and") < 0.1
    with_vectors = {r.record_id for r in noise.repaired(df, list(COMMON), model).where("size(noise) > 0").collect()}
    blind = Model(model.counts, model.total)
    without = {r.record_id for r in noise.repaired(df, list(COMMON), blind).where("size(noise) > 0").collect()}
    assert with_vectors == {"odd"} and without == set()  # `arid` is a word of its own; `bam` is misread in the barn's place alone


def test_closeness_decides_which_vocabulary_words_are_linked():
    counts, near = {"and": 9000, "arid": 40}, np.eye(2, dtype=np.float32)
    assert Model(counts, 2_000_000, near[[0, 0]], {"and": 0, "arid": 1}).misread and not Model(counts, 2_000_000, near, {"and": 0, "arid": 1}).misread


def test_the_place_decides_between_frequent_words():
    ids = {"modern": 0, "modem": 1, "tools": 2, "router": 3}
    unit = np.eye(2, dtype=np.float32)
    m = Model({"modern": 5000, "modem": 5000, "tools": 9000, "router": 9000}, 2_000_000, np.stack([unit[0], unit[1], unit[0], unit[1]]), ids, np.stack([unit[0], unit[1]]), {"tools": 0, "router": 1})
    for order in (1, -1):  # whatever was asked before
        s = Scanner(m, COMMON)
        asked = [(["tools"], "modern"), (["router"], "modem")][::order]
        assert [s.word("modcrn", near) for near, _ in asked] == [to for _, to in asked]


def test_heads_are_learned_from_most_pages_of_a_document(spark, scanner):
    body = "The farmers of the committee\nmay claim storage of cotton\nfrom the branch of the field"
    rows = [(f"c{p}", f"Handbook for Field Staff\n{body}\n{p}" if p != 9 else body, "Harit Mission", None, p, True, None) for p in range(1, 10)]
    rows += [(f"d{p}", f"Handbook for Field Staff\n{body}" if p == 1 else body, "Other Mission", None, p, True, None) for p in range(1, 10)]
    df = spark.createDataFrame(rows, FIELDS)
    learned = {r.name: r.learned for r in noise.heads(df).collect()}
    found = scanner.scan(f"Handbook for Field Staff\n{body}", "Harit Mission", None, 4, True, learned["Harit Mission"])[0]
    assert (1, "repeated") in found
    assert (1, "repeated") not in scanner.scan(f"Handbook for Field Staff\n{body}", "Other Mission", None, 4, True, learned.get("Other Mission"))[0]


def test_whole_tables_and_hard_rows(spark):
    clean = "The committee of farmers may claim support for solar pumps in the field"
    rows = [(f"r{i}", clean, "Harit Mission Annex 1.pdf", None, 7, False, None) for i in range(120)]
    rows += [("bad", "The commlttee of farrners may claim supp0rt\n7", "Harit Mission Annex 1.pdf", None, 7, False, "e"), ("null", None, None, None, None, None, None), ("empty", "", "", "", 0, True, ""), ("long", "x" * 300_000 + "-\n" + "y " * 100_000, "n", "o", 1, True, ""), ("bad", "The commlttee of farrners may claim supp0rt\n7", "Harit Mission Annex 1.pdf", None, 7, False, "e")]
    out = noise.repaired(spark.createDataFrame(rows, FIELDS), list(COMMON)).collect()
    assert len(out) == len(rows)
    by = {r.record_id: r for r in out}
    assert [(n.line_no, n.noise) for n in by["bad"].noise] == [(1, "misread"), (2, "pageno")]
    assert by["bad"].text == "The committee of farmers may claim support"
    assert by["null"].text is None and by["empty"].text == "" and by["r1"].noise == []


def test_empty_table(spark):
    assert noise.repaired(spark.createDataFrame([], FIELDS), list(COMMON)).collect() == []


def test_heads_with_an_unknown_issuer(scanner):
    for line in ("Office of Dairy Affairs * Harit Mission Annex 8", "Harlt Mission Annex 8 | Mission Cell for Soil Health"):
        assert scanner.scan(f"{line}\nThe farmers of the field", "Harit Mission Annex 8.pdf", None, 2, False)[0] == [(1, "header")]
    assert scanner.scan("a farm under the Harit Mission Annex 8 - and storage of cotton", "Harit Mission Annex 8.pdf", None, 2, False)[0] == []


def test_rest_of_a_cut_word_behind_other_lines(scanner):
    text = "The farmers of the com-\nClick Here For More\n\nmittee of storage and the com-\nŚilpā mittee of cotton"
    assert scanner.scan(text, "n", None, 2)[0] == [(1, "hyphen"), (4, "hyphen")]
    assert scanner.scan("The farmers of the com-\nClick Here For More", "n", None, 2)[0] == []


def test_wrapped_paragraphs_become_one_line(scanner):
    text = "The farmers of the committee may claim the storage for Rs.\n276,500 and the tenant growers of the field may claim it.\nThe committee of the branch may claim pumps.\n\nThe growers may claim support.\nThe growers may claim storage."
    assert scanner.scan(text, "n", None, 2)[1] == text.replace("Rs.\n", "Rs. ").replace("it.\nThe", "it. The")
