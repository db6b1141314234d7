"""Operators over DataFrames on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from granary.operators import chunking, context, diagnostics, documents, fusion, lexical, memory, ocr, rerank, router, sections, tables, vector
from granary.plans import pipeline
from granary.sources import io

DOCS = ["pumps for farms", "seeds for farms and farms", "", "cold storage", "pumps pumps pumps"]


def corpus(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc int, page_content string")


def plain_bm25(query):
    tokens = [d.split() for d in DOCS]
    n, mean = len(DOCS), sum(map(len, tokens)) / len(DOCS)
    df = {w: sum(w in d for d in tokens) for d in tokens for w in d}
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    out = []
    for i, d in enumerate(tokens):
        s = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in query.split())
        out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out)]


@pytest.mark.parametrize("query", ["pumps", "farms farms seeds", "unknown", "for storage"])
def test_bm25(spark, query):
    ix = lexical.index(corpus(spark), "doc", "page_content")
    asked = spark.createDataFrame([("q", query), ("e", "?!")], "query_id string, question string")
    rows = lexical.search(ix, asked, 4).orderBy("rank").collect()
    assert [(r.doc, pytest.approx(r.score)) for r in rows] == [(i, pytest.approx(s)) for i, s in plain_bm25(query)[:4]]
    own = spark.createDataFrame([(1, "State", "x"), (2, "India", None), (3, "state", "S"), (4, "STATE", "s"), (5, None, "s")], "doc int, applicable_scope string, own_state string")
    allowed = lexical.Scope(own, asked.withColumn("state", F.lit("s")))
    rows = lexical.search(ix, asked, 2, allowed=allowed).orderBy("rank").collect()
    assert [r.doc for r in rows] == [i for i, _ in plain_bm25(query) if i in (2, 3, 4)][:2]
    assert lexical.search(ix, asked, 4, pad=False).count() == sum(s != 0 for _, s in plain_bm25(query)[:4])


@pytest.mark.parametrize("small", [1, 1000])
def test_bm25_by_document(spark, monkeypatch, small):
    ix = lexical.index(corpus(spark), "doc", "page_content")
    texts = [*DOCS, "farms farms seeds unknown", "for storage", "?!"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")
    plain = {tuple(r) for r in lexical.search(ix, asked, 3).collect()}
    for name, value in (("MANY", 0), ("POSTINGS", small), ("BLOCK", small), ("PASS_WORDS", 3 * small)):
        monkeypatch.setattr(lexical, name, value)
    assert {tuple(r) for r in lexical.search(ix, asked, 3).collect()} == plain and len(plain) == 18


def test_hybrid_asks_whole_texts(spark, tmp_path):
    from granary.plans import queries

    words = [f"w{i}" for i in range(20)]
    rows = [(0, " ".join(words)), *((i, f"x{i} y{i}") for i in range(1, 59)), (59, "w19 w19 w18 other")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [0.0]), (7, [1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.doc_id: r.rank for r in queries.NAMES["hybrid_topk"](spark, str(tmp_path)).collect()}
    assert found[0] == 1 and found.get(59) == 3  # document 59 shares only words behind the twelfth


def test_index_round_trip(spark, tmp_path):
    ix = lexical.index(corpus(spark), "doc", "page_content")
    back = io.read_index(spark, io.write_index(ix, str(tmp_path / "ix"), 2))
    asked = spark.createDataFrame([("q", "pumps")], "query_id string, question string")
    assert lexical.search(ix, asked, 3).collect() == lexical.search(back, asked, 3).collect()


def test_empty_corpus(spark):
    ix = lexical.index(corpus(spark).limit(0), "doc", "page_content")
    assert lexical.search(ix, spark.createDataFrame([("q", "pumps")], "query_id string, question string"), 3).count() == 0


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(10, [0.0, 1.0]), (11, [1.0, 0.0])], "query_id int, embedding array<float>")
    for block in (1, 4096):
        out = vector.nearest(rows, asked, 2, block=block).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.vec_id, r.distance) for r in out] == [(10, 1, 0.0), (10, 3, 0.0), (11, 2, 0.0), (11, 1, 2.0)]
    with pytest.raises(ValueError):
        vector.nearest(rows, asked, 0)


def test_reciprocal_rank(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", None, 2), ("q", "y", 3)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "x", 1), ("q", "z", 2)], "query_id string, chunk_id string, rank int")
    out = {r.chunk_id: (r.score, r["rank"]) for r in fusion.reciprocal_rank([a, b]).collect()}
    assert out == {"x": (pytest.approx(2 / 61), 1), "z": (pytest.approx(1 / 62), 2), "y": (pytest.approx(1 / 63), 3)}
    swapped = {r.chunk_id: r.score for r in fusion.reciprocal_rank([b, a]).collect()}
    assert swapped == {k: pytest.approx(v[0]) for k, v in out.items()}


def test_expansion_and_duplicates(spark):
    hits = spark.createDataFrame([("q", "p2", 1), ("q", "p1", 2), ("q", "p2", 3), ("q", None, 4), ("q", "gone", 5)], "query_id string, parent_id string, rank int")
    parents = spark.createDataFrame([("p1", "a"), ("p2", "b")], "parent_id string, page_content string")
    assert [(r.parent_id, r.position) for r in fusion.expanded(hits, parents).orderBy("position").collect()] == [("p2", 1), ("p1", 2)]
    rows = spark.createDataFrame([(1, "f", 1, "A b!"), (2, "f", 1, "a B"), (3, "f", 2, "a b"), (4, None, None, "")], "pos int, file_name string, page int, page_content string")
    once = fusion.without_duplicates(rows, "pos")
    assert sorted(r.pos for r in once.collect()) == [1, 3, 4] and fusion.without_duplicates(once, "pos").count() == 3
    rows = spark.createDataFrame([(1, "a long enough content, indeed"), (2, "A long enough content indeed"), (3, "short"), (4, None)], "pos int, page_content string")
    assert [r.pos for r in fusion.controlled(rows, "pos").collect()] == [1]


REGISTRY = [("kisan", "PM Kisan", "PM Kisan.pdf", "pm-kisan", 1), ("kisan", "PM Kisan", "PM Kisan.pdf", "pm kisan", 2), ("maan", "Maan Dhan", "Maan Dhan.pdf", "pm kisan maan dhan", 3), ("dup", "Dup", "Dup.pdf", "pm kisan", 4), ("stock", "Stock", "Stock.pdf", "!!", 5)]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "scheme_key string, name string, file_name string, alias string, ord int")


def test_routing(spark):
    asked = spark.createDataFrame([(1, "What is PM-KISAN?"), (2, "pm kisan maan dhan rules"), (3, "What is the weather today?"), (4, None), (5, "pm kisanx")], "query_id int, question string")
    out = {r.query_id: (r.scheme_key, r.matched_alias) for r in router.detected(asked, registry(spark)).collect()}
    assert out == {1: ("kisan", "pm-kisan"), 2: ("maan", "pm kisan maan dhan"), 3: (None, None), 4: (None, None), 5: (None, None)}
    facts = spark.createDataFrame([("How many farms?", True), ("the integrated plan", True), ("who may apply", False), ("in fy 2024", True), (None, False), ("3 of them", True)], "q string, want boolean")
    assert all(r.got == r.want for r in facts.select(router.fact(F.col("q")).alias("got"), "want").collect())


def test_variants(spark):
    df = spark.createDataFrame([("How many in 2024-25?", "stock", "Stock"), ("How many?", None, None), ("Total?", "kisan", "PM Kisan")], "q string, k string, n string")
    get = lambda years, extra=None: [r.v for r in df.select(router.variants(F.col("q"), F.col("k"), F.col("n"), years, extra).alias("v")).collect()]
    assert [len(v) for v in get("actual")] == [2, 1, 2] and [len(v) for v in get("intended")] == [3, 1, 2]
    assert [len(v) for v in get("actual", {"stock": ("Stock total", "how MANY in 2024/25")})] == [3, 1, 2]


def test_boost_and_rerank(spark):
    schema = "query_id int, question string, page_content string, position int, scheme_match boolean"
    df = spark.createDataFrame([(1, "how many farms in 2019-20", "farms total of 2019-20", 2, False), (1, "how many farms in 2019-20", "farms", 1, True), (2, "who", "who", 1, True)], schema)
    ranked = rerank.reranked(df)
    out = {(r.query_id, r.page_content): r for r in rerank.boosted(ranked).collect()}
    assert out[1, "farms"].fact_year_boost == 0.2 and out[1, "farms total of 2019-20"].fact_year_boost == 0.05 and not out[1, "farms total of 2019-20"].year_match and out[2, "who"].effective_rerank_score is None
    meant = {r.page_content: r for r in rerank.boosted(ranked, years="intended").collect()}
    assert meant["farms total of 2019-20"].fact_year_boost == pytest.approx(0.15) and meant["farms total of 2019-20"].year_match
    with pytest.raises(ValueError):
        rerank.reranked(df, top=0)
    scored = rerank.reranked(df, scorer=lambda q, c: F.length(c), top=1)
    assert [r.page_content for r in scored.where("query_id = 1").collect()] == ["farms total of 2019-20"]


def test_context_and_citations(spark):
    schema = "query_id int, position int, source string, file_name string, page_number int, content_type string, page_content string, rerank_score double"
    rows = [(1, i, "s.pdf", "", i % 2, "list", f"text {i}", 0.5) for i in range(1, 8)]
    df = spark.createDataFrame(rows, schema)
    text = context.contexts(df).first().context
    assert text.startswith("\n\n[SOURCE 1]\nFile: s.pdf\nPage: 1\nContent Type: list\nScheme Match: False\nRerank Score: 0.5\n\nContent:\ntext 1\n\n[SOURCE 2]") and "[SOURCE 6]" not in text and "Page: unknown" in text
    assert [(r.position, r.page) for r in context.references(df).orderBy("position").collect()] == [(1, "1"), (2, "unknown")]
    made = spark.createDataFrame([([("user", "a"), ("system", "b"), ("assistant", "c")],)], "m array<struct<role:string,content:string>>").select(context.history(F.col("m")).alias("x"), context.history(F.col("m"), False).alias("y")).first()
    assert made.x == "User: a\nsystem: b\nAssistant: c" and made.y == "User: a\nAssistant: c"


def test_memory(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", f" m{i} ") for i in range(1, 9)] + [("t", 1, "system", "x")]
    df = spark.createDataFrame(rows, "session_id string, seq int, role string, content string")
    assert [r.seq for r in memory.recent(df.where("session_id = 's'"), 3).orderBy("seq").collect()] == [3, 4, 5, 6, 7, 8] and memory.recent(df, 0).count() == 9
    out = {r.session_id: r.history for r in memory.formatted(df, 1).collect()}
    assert out == {"s": "User: m7\nAssistant: m8", "t": "No previous conversation."}
    turns = spark.createDataFrame([("s", "q", "a"), ("new", "q2", "a2")], "session_id string, question string, answer string")
    added = memory.with_turn(df, turns, 1).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.content) for r in added if r.session_id != "t"] == [("new", 1, "q2"), ("new", 2, "a2"), ("s", 9, "q"), ("s", 10, "a")]
    assert memory.sessions(memory.cleared(df, turns)).count() == 1




def test_sections(spark):
    text = "intro line of it here\n1. First Part\n1.1 Sub Part\nbody one\n\nbody two\nA. Letter Part\nmore text is here,\n2. Second Part\nEligibility all small farmers of it\nend of the page is this,"
    rows = sections.sections(spark.createDataFrame([("d", 3, text), ("e", 1, ""), ("f", 1, None)], "doc string, page int, text string"), ["doc", "page"]).orderBy("index").collect()
    assert [(r["index"], r.section, r.subsection, r.text) for r in rows] == [
        (0, "General", "-", "intro line of it here"), (1, "First Part", "Sub Part", "body one\nbody two"), (2, "First Part", "Letter Part", "more text is here,"), (3, "eligibility", "-", "all small farmers of it\nend of the page is this,"),
    ]
    made = sections.parents(spark.createDataFrame([("d", 3, "body of the page is here,")], "document_id string, page_number int, text string")).first()
    assert made.page_content == "Section: General\n\nSubsection: -\n\nbody of the page is here," and len(made.parent_id) == 16


def test_tables(spark):
    text = "no table here\n(i) Pack house 10 lakh\n(ii) Silos | 30% 5 MT\n\nlone | row\nplain words only"
    rows = tables.tables(spark.createDataFrame([(1, 7, text), (2, 1, None)], "doc int, page_number int, text string"), ["doc", "page_number"]).collect()
    assert len(rows) == 1 and rows[0].table_id == "page_7_table_1" and rows[0].confidence == 1.0 and len(rows[0].rows) == 2
    assert rows[0].notes == ["Detected 2 numbered table-row markers.", "Detected 3 financial value(s).", "Detected 1 percentage value(s).", "Detected 1 capacity value(s).", "High heuristic confidence."]
    assert rows[0].rag_text.split("\n")[:4] == ["Table: page_7_table_1", "Page: 7", "Rows:", "Row 1: Activity: Pack house | Cost/Financial values: 10 lakh"]


def test_chunks(spark):
    long = "Sentence number one is here. " * 60
    lines = "\n".join(f"row {i} " + "x" * 90 for i in range(20))
    rows = [(1, "activity", long), (2, "table", lines), (3, "list", "short"), (4, None, long), (5, "paragraph", "  "), (6, "paragraph", None), (7, "table", "tiny"), (8, "heading", "")]
    out = chunking.chunks(spark.createDataFrame(rows, "k int, content_type string, page_content string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.k, []).append(r)
    assert len(by[1]) == 1 and len(by[3]) == 1 and len(by[7]) == 1 and 5 not in by and 6 not in by and [r.page_content for r in by[8]] == [""]
    assert all(len(r.page_content) <= 800 for r in by[2] + by[4]) and "\n".join(r.page_content for r in sorted(by[2], key=lambda r: r.chunk_index)) == lines and by[4][0].total_chunks == len(by[4])
    parents = spark.createDataFrame([("p", "parent", "word " * 1000)], "parent_id string, chunk_type string, page_content string")
    made = chunking.children(parents).orderBy("chunk_index").collect()
    assert all(len(r.page_content) <= 1800 for r in made) and made[0].chunk_type == "child" and len({r.chunk_id for r in made}) == len(made) > 2
    inputs = spark.createDataFrame([("s", "activity", " a "), ("s", "activity", "b"), (None, "activity", "c")], "source string, content_type string, page_content string")
    bad = chunking.unmatched(inputs, chunking.chunks(inputs).where("page_content <> 'b'"), ["source", "content_type"])
    assert [(r.body, r.n) for r in bad.collect()] == [("b", 0)]


def test_readings(spark):
    schema = "page int, attempt int, text string, confidence double"
    first = ocr.measured(spark.createDataFrame([(1, 1, "good text " * 20, 0.9), (2, 1, "bad", 0.3), (2, 2, "bad", 0.3), (3, 1, "poor", 0.6)], schema))
    again = ocr.measured(spark.createDataFrame([(1, 3, "other " * 90, 0.99), (2, 3, "much longer text " * 9, 0.4), (3, 3, "poo", 0.62), (4, 3, "only here " * 10, 0.8)], schema))
    out = {r.page: r for r in ocr.chosen(first, again, ["page"]).collect()}
    assert [out[p].extraction_method for p in (1, 2, 3, 4)] == ["tesseract_ocr", "tesseract_ocr_retry", "tesseract_ocr", "tesseract_ocr_retry"] and out[2].text.startswith("much")
    assert ocr.best(first, ["page"]).where("page = 2").first().attempt == 1
    words = spark.createDataFrame([(1, 2, "b", 50.0), (1, 1, " a ", 90.0), (1, 3, "c", -1.0), (2, 1, "", 70.0)], "page int, seq int, word string, confidence double")
    assert {r.page: (r.text, r.confidence) for r in ocr.page_text(words, ["page"]).collect()} == {1: ("a b", pytest.approx(0.7)), 2: ("", 0.0)}
    goal = spark.createDataFrame([("g", 1, "(i) Pack houses"), ("g", 2, "(ii) Cold chains and vans")], "g string, ord int, expected string")
    seen = spark.createDataFrame([("g", "ogistics cold vans"), ("g", "pack houses"), ("g", None)], "g string, text string")
    assert {r.ord: (r.candidate, r.score) for r in ocr.best_expected(seen, goal, "g").collect()} == {1: ("pack houses", 0.95), 2: ("ogistics cold vans", pytest.approx(0.4))}


def test_annex_documents(spark):
    a = spark.createDataFrame([("x/d.pdf", 2, 1, 1, "(i)", "Silos", 0.9, [], "a1"), ("x/d.pdf", 2, 1, 2, None, "Vans", None, ["w"], "a2")], "document string, page_number int, table_no int, activity_number int, marker string, text string, confidence double, warnings array<string>, activity_id string")
    c = spark.createDataFrame([("x/d.pdf", 2, 1, 1, "House", "10 lakh", 0.8, None, "raw", "c")], "document string, page_number int, table_no int, item_number int, description string, cost string, confidence double, warnings array<string>, raw_description string, raw_cost string")
    rows = documents.documents(a, c).orderBy("part", "activity_number").collect()
    assert [r.page_content for r in rows] == ["Eligible Activity\n(i) Silos", "Eligible Activity\n Vans", "Cost Norm\nItem 1\nDescription: House\nCost Norm: 10 lakh"] and rows[0].file_name == "d.pdf" and [r.has_ocr_warning for r in rows] == [False, True, False]
    assert documents.final_text(a, c).first().text == "DOCUMENT: x/d.pdf\nPAGE: 2\n\nSECTION: Eligible Activities\n(i) Silos\n Vans\n\nSECTION: Cost Norms\nItem 1: House\nCost Norm: 10 lakh"
    goal = spark.createDataFrame([("x/d.pdf", 1, "Silos "), ("x/d.pdf", 2, "Cars"), ("x/d.pdf", 3, "More")], "document string, activity_number int, text string")
    assert {(r.activity_number, r.actual, r.expected) for r in documents.differences(a, goal, ["document"], "activity_number", "text").collect()} == {(2, "Vans", "Cars"), (3, None, "More")}


def test_diagnostics(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in diagnostics.inconsistencies(a, b, "k").collect()} == {(1, "bm25_only"), (3, "vector_only"), (1, "bm25_duplicate")}
    pages = spark.createDataFrame([("d", 1), ("d", 4), ("e", 1)], "doc string, page int")
    assert {tuple(r) for r in diagnostics.missing_pages(pages, "doc", "page").collect()} == {("d", 2), ("d", 3)}


def test_ask(spark):
    docs = spark.createDataFrame([(1, "Solar pumps help many small farmers of the block", "PM Kisan.pdf", "s", 1, "paragraph"), (2, "The cold storage of the village holds seeds", "b.pdf", "s", 2, "paragraph"), (3, "Solar pumps help many small farmers, of the block", "PM Kisan.pdf", "s", 1, "paragraph")], "doc int, page_content string, file_name string, source string, page int, content_type string")
    asked = spark.createDataFrame([(1, "Which solar pumps help?", ""), (2, " ", ""), (3, "zzz", ""), (4, "and those?", "User: solar pumps of pm kisan")], "query_id int, question string, history string")

    def model(prompts):
        return ["solar pumps of pm kisan" if "Standalone" in p else "From the sources." for p in prompts]

    out = {r.query_id: r for r in pipeline.ask(asked, docs, registry(spark), model).collect()}
    assert out[1].answer == "From the sources." and [s.file_name for s in out[1].sources] == ["PM Kisan.pdf"] and out[2].answer == pipeline.NO_QUESTION and out[3].answer == pipeline.NOT_FOUND and out[4].standalone_question == "solar pumps of pm kisan"

    def broken(prompts):
        raise RuntimeError

    assert {r.query_id: r.answer for r in pipeline.ask(asked, docs, registry(spark), broken).collect()}[1] == pipeline.NO_ANSWER


def test_ask_by_vectors(spark):
    rows = [(i, f"Text {i} of the village office", f"{i}.pdf", "s", i, "paragraph") for i in range(1, 31)]
    docs = spark.createDataFrame(rows, "doc int, page_content string, file_name string, source string, page int, content_type string")
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(1, 31)], "doc int, embedding array<double>")
    asked = spark.createDataFrame([(1, "Tractors?"), (2, "How many tractors were insured?")], "query_id int, question string")
    embed = lambda c: F.when(F.length(c) < 20, F.array(F.lit(30.0), F.lit(0.0))).when(F.length(c) < 40, F.array(F.lit(25.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    s = pipeline.Settings(retrieved=3, scorer=lambda *_: F.lit(0.9))
    out = {r.query_id: {int(x.page) for x in r.sources} for r in pipeline.ask(asked, docs, registry(spark), settings=s, vectors=vectors, embed=embed).collect()}
    assert out == {1: {28, 29, 30}, 2: {24, 25, 26}}  # no question shares a word with its documents
    with pytest.raises(ValueError):
        pipeline.ask(asked, docs, registry(spark), vectors=vectors)


def test_one_bad_prompt_costs_one_reply(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(6)], "k int, prompt string").coalesce(1)
    assert [r.reply for r in pipeline.called(df, model, "prompt", "reply").orderBy("k").collect()] == ["P0", "P1", "P2", None, "P4", "P5"]


def test_answers_are_remembered(spark):
    messages = spark.createDataFrame([("s", 1, "user", "a"), ("s", 2, "assistant", "b")], "session_id string, seq bigint, role string, content string")
    answers = spark.createDataFrame([(1, "q1", "r1"), (2, "", "none"), (3, "q3", "r3")], "query_id int, question string, answer string")
    sessions = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "query_id int, session_id string")
    out = pipeline.remembered(messages, answers, sessions, 1).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.role, r.content) for r in out] == [("s", "user", "q1"), ("s", "assistant", "r1"), ("t", "user", "q3"), ("t", "assistant", "r3")]


def test_settings_from_the_environment():
    s = pipeline.Settings.from_environment({"TOP_K_DENSE": "7", "TOP_K_RERANK": ""}, years="intended")
    assert (s.retrieved, s.reranked, s.years) == (7, 5, "intended")


def test_nearest_with_ties_over_batches(spark, monkeypatch):
    """Each task keeps the best k of all its batches; of equal distances the smaller keys."""
    monkeypatch.setattr(vector, "PRODUCT", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"k{(i * 37) % 100:02}", [float(i % 5), 0.0]) for i in range(100)]
        asked = spark.createDataFrame([(q, [float(q), 0.0]) for q in range(5)], "query_id int, embedding array<double>")
        found = vector.nearest(spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3), asked, 25).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(5):
        goal = sorted(((v[0] - q) ** 2, k) for k, v in rows)[:25]
        assert [(r.distance, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == goal


def test_scope_counts_without_pairs(spark):
    own = spark.createDataFrame([(1, "State", "x"), (2, "India", None), (3, "state", "S"), (4, None, "s")], "doc int, applicable_scope string, own_state string")
    asked = spark.createDataFrame([("a", "s"), ("b", ""), ("c", "y"), ("d", None)], "query_id string, state string")
    assert {tuple(r) for r in lexical.Scope(own, asked).counts().collect()} == {("a", 2), ("b", 4), ("c", 1), ("d", 4)}


def test_models_are_passed_in(spark):
    df = spark.createDataFrame([(1, "q", "a", 1), (1, "q", "bbb", 2), (1, None, None, 3)], "query_id int, question string, page_content string, position int")
    rows = rerank.reranked(df, scorer=rerank.modelled(lambda pairs: [len(c) for _, c in pairs]), top=2).orderBy("position").collect()
    assert [(r.page_content, r.rerank_score) for r in rows] == [("bbb", 3.0), ("a", 1.0)]
    pages = spark.createDataFrame([(1, bytearray(b"clear")), (2, bytearray(b"torn"))], "page int, image binary")

    def read(image, preprocessing, config):
        if image == b"torn" and config == "6":
            raise ValueError
        return image.decode() * (2 if preprocessing == "sharp" else 1), 0.5

    tried = ocr.attempts(pages, read, [("plain", "6"), ("sharp", "11")], ["page"])
    assert {(r.page, r.attempt): r.text for r in tried.collect()} == {(1, 0): "clear", (1, 1): "clearclear", (2, 0): "", (2, 1): "torntorn"}
    files = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"!"))], "path string, content binary")
    assert [(r.path, r.page_number) for r in io.rendered(files, lambda c, dpi: [bytes([x]) for x in c] if c != b"!" else 1 / 0).orderBy("path", "page_number").collect()] == [("a", 1), ("a", 2), ("b", None)]


def test_combined_and_filtered(spark):
    chunks = spark.createDataFrame([("q", "c1", "p1", "x", 0.1, 1), ("q", "c2", "p1", "y", 0.3, 2), ("q", "c1", "p1", "x", 0.1, 3)], "query_id string, chunk_id string, parent_id string, page_content string, score double, position int")
    parents = spark.createDataFrame([("q", "p1", "P", 1), ("q", "p1", "P", 2)], "query_id string, parent_id string, page_content string, position int")
    assert [(r.chunk_id, r.parent_id, r.position) for r in fusion.combined(chunks, parents).orderBy("position").collect()] == [("c2", "p1", 1), ("c1", "p1", 2), (None, "p1", 3)]
    rows = spark.createDataFrame([(1, [0.0], "a"), (2, [0.1], "b"), (3, [0.2], None)], "vec_id int, embedding array<float>, source string")
    asked = spark.createDataFrame([(9, [0.0])], "query_id int, embedding array<float>")
    assert [r.vec_id for r in vector.filtered(rows, asked, 2, {"source": "b"}).collect()] == [2] and vector.filtered(rows, asked, 2, {"source": None}).count() == 0
