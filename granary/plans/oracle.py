"""SQL for DuckDB that gives the results of the queries independently."""

from __future__ import annotations

from granary.plans import expected


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def squeezed(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def cleaned(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), 'vikaspedia\.in', ' ', 'gi'), 'www\.vikaspedia\.in', ' ', 'gi'), 'https?://\S+', ' ', 'gi')"
    out = rf"regexp_replace(translate({out}, '–—“”‘’', '--' || chr(34) || chr(34) || chr(39) || chr(39)), '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({out}, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')")


def listed(values: str) -> str:
    return f"coalesce(array_to_string({values}, ' ; '), '')"


def errors(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {literal(m)} END" for c, m in pairs)
    return listed(f"list_filter([{items}], lambda e: e IS NOT NULL)")


def extracted(c: str, pattern: str) -> str:
    return listed(rf"list_filter([trim(regexp_replace(m, '\s+', ' ', 'g')) FOR m IN regexp_extract_all(coalesce({c}, ''), {literal(pattern)})], lambda e: e <> '')")


CHUNKS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM scheme_chunks)"
ACTIVITIES = "(SELECT * FROM aif_activities QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY extracted_at DESC) = 1)"
NAME_QUERIES = "(SELECT scheme_key AS query_id, min(name) AS question FROM scheme_registry GROUP BY 1)"
QUESTIONS = """(SELECT CAST(ord AS BIGINT) AS query_id, CASE ord % 5
    WHEN 0 THEN 'What is ' || alias || '?' WHEN 1 THEN 'How many farmers were covered under ' || alias || '?'
    WHEN 2 THEN 'Who may apply to ' || alias || ' in 2019-20?' WHEN 3 THEN 'Where is the desk of ' || alias || ' and which records are needed?'
    ELSE 'Which crops need a drying yard?' END AS question FROM scheme_registry)"""
DETECTED = f"""(SELECT q.query_id, q.question, scheme_key, scheme_name, alias AS matched_alias FROM {QUESTIONS} q LEFT JOIN (
    SELECT query_id, r.scheme_key, r.name AS scheme_name, alias FROM {QUESTIONS} q JOIN scheme_registry r
    ON {norm('alias')} <> '' AND contains(' ' || {norm('question')} || ' ', ' ' || {norm('alias')} || ' ')
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length({norm('alias')}) DESC, ord) = 1) USING (query_id))"""
HEADINGS = "|".join(sorted(expected.COMMON_HEADINGS, key=len, reverse=True))
WORD = r"[\p{L}\p{N}_]"
STATES = "(SELECT DISTINCT state FROM scheme_metadata WHERE state IS NOT NULL)"
PAIRS = f"""(SELECT lower(s.state) AS query_id, m.document_id FROM {STATES} s JOIN scheme_metadata m
    ON lower(m.applicable_scope) = 'india' OR (lower(m.applicable_scope) = 'state' AND lower(m.state) = lower(s.state)))"""
MESSAGES = """(SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'system' WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, event_type AS content FROM events)"""


def bm25(queries: str, k: int, allowed: str | None = None) -> str:
    """CTEs that end in hits (query_id, doc_id, score, rank)."""
    inside = f"SEMI JOIN {allowed} al ON al.query_id = s.query_id AND al.doc_id = s.doc_id" if allowed else ""
    pool = allowed or f"(SELECT query_id, doc_id FROM {queries} q, documents)"
    return f"""
        toks AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents),
        posts AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY 1, 2),
        lens AS (SELECT doc_id, len({tokens('text')}) AS length FROM documents),
        st AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
        terms AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, st GROUP BY term, n),
        idfs AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM terms) ELSE raw END AS idf FROM terms),
        asked AS (SELECT query_id, unnest({tokens('question')}) AS term FROM {queries} q),
        scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
            FROM asked JOIN idfs USING (term) JOIN posts USING (term) JOIN lens USING (doc_id), st GROUP BY 1, 2),
        kept AS (SELECT s.* FROM scored s {inside}),
        padded AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM {pool} p LEFT JOIN kept USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM asked)),
        hits AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM padded QUALIFY rank <= {k})
    """


VECTORS = "(SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)"


def dense(k: int) -> str:
    return f"""(SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank
        FROM (SELECT query_id, vec_id, list_distance(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) ** 2 AS distance FROM embeddings, {VECTORS})
        QUALIFY rank <= {k})"""


CANDIDATES = f"""WITH {bm25(NAME_QUERIES, 20)},
    rows AS (SELECT h.query_id, h.doc_id, h.rank AS position, d.text, coalesce(d.scheme_key = h.query_id, false) AS scheme_match, 'How many farmers were covered under ' || q.question || '?' AS question
        FROM hits h JOIN documents d USING (doc_id) JOIN {NAME_QUERIES} q USING (query_id)),
    scores AS (SELECT *, len(list_intersect(list_distinct({tokens('question')}), {tokens('text')})) / len(list_distinct({tokens('question')})) AS rerank_score FROM rows)"""
PERCENT_TERMS = ", ".join(literal(w) for w in expected.CONTENT_TERMS)
RECORDS = "CASE WHEN confidence IS NULL THEN 0.0 ELSE confidence END"


def heading(c: str) -> str:
    own = f"(len(list_filter(string_split_regex({c}, '\\s+'), lambda w: regexp_matches(regexp_replace(w, '[^A-Za-z]', '', 'g'), '^[A-Z]'))))"
    many = f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
    known = f"lower({heading_text(c)})"
    return f"""CASE WHEN {c} = '' OR regexp_matches(lower({c}), '^page\\s+\\d+$|^extraction method:|^image count:|^[#=_\\-]{{5,}}$') OR regexp_matches({c}, '^[*•°◦▪▫‣⁃·\\-]') OR length({c}) < 3 THEN false
        WHEN regexp_matches({c}, '{expected.SUBNUMBERED}') OR regexp_matches({c}, '{expected.NUMBERED}') OR regexp_matches({c}, '{expected.LETTERED}') OR regexp_matches({c}, '{expected.LOWER_LETTERED}') OR regexp_matches({known}, '^({HEADINGS})$') THEN true
        WHEN regexp_matches({known}, '^({HEADINGS}) ') THEN false
        WHEN {upper(c)} AND {words(c)} <= 12 THEN true
        WHEN {words(c)} > 15 OR regexp_matches({c}, '[.,;:]$') THEN false
        ELSE {many} BETWEEN 1 AND 10 AND {own} >= greatest(1.0, {many} * 0.5) END"""


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{WORD}+'))"


def upper(c: str) -> str:
    letters, capital = (f"length(regexp_replace({c}, '{p}', '', 'g'))" for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    return f"({letters} >= 4 AND {capital} >= {letters} * 0.8)"


def heading_text(c: str) -> str:
    out = rf"regexp_replace({strip(c)}, '^\s*\d+(?:\.\d+)*[.)]?\s*', '')"
    out = rf"regexp_replace({out}, '^\s*[A-Za-z][.)]\s*', '')"
    return squeezed(rf"regexp_replace({out}, '^[*•°◦▪▫‣⁃·\-]\s*', '')")


def level(c: str) -> str:
    return rf"""CASE WHEN regexp_matches({c}, '{expected.SUBNUMBERED}') THEN CASE WHEN length(regexp_replace(regexp_extract({c}, '^\s*(\d+(?:\.\d+)+)', 1), '[^.]', '', 'g')) >= 2 THEN 3 ELSE 2 END
        WHEN regexp_matches({c}, '{expected.NUMBERED}') THEN 1 WHEN regexp_matches({c}, '{expected.LETTERED}') THEN 2 WHEN regexp_matches({c}, '{expected.LOWER_LETTERED}') THEN 3 ELSE 1 END"""


def table_line(c: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(translate(coalesce({c}, ''), chr(9), ' '), ' {{2,}}', ' ', 'g'), '\s+([,.;:])', '\1', 'g')")


ROMAN = "|".join(expected.ROMAN)
MONEY, PERCENT, CAPACITY = expected.MONEY, expected.PERCENT, expected.CAPACITY


def table_like(c: str) -> str:
    low = f"lower({squeezed(c)})"
    count = " + ".join(f"CAST(contains({low}, {literal(k)}) AS INTEGER)" for k in expected.TABLE_KEYWORDS)
    cost, share, size = (f"regexp_matches({c}, {literal(p)})" for p in (MONEY, PERCENT, CAPACITY))
    return rf"({c} <> '' AND (regexp_matches({c}, '[|\t]') OR regexp_matches({c}, '(?i)(^|\W)\(({ROMAN})\)') OR ({count}) >= 2 OR (({count}) >= 1 AND ({cost} OR {share} OR {size})) OR ({cost} AND {size})))"


FACT = rf"regexp_matches({norm('question')}, {literal(expected.FACT_PATTERN)}) OR " + " OR ".join(f"contains({norm('question')}, {literal(w)})" for w in expected.FACT_KEYWORDS)
FACT_PROMPT = " OR ".join(f"contains(lower(question), {literal(w)})" for w in expected.PROMPT_KEYWORDS)


def template(text: str, **values: str) -> str:
    out = literal(text)
    for k, v in values.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


ORACLES = {
    "normalize_text": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "token_stats": f"SELECT doc_id, len({tokens('text')}) AS tokens, len(list_distinct({tokens('text')})) AS distinct_tokens FROM documents",
    "term_statistics": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY 1",
    "clean_text": f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents",
    "page_steps": rf"""
        WITH a AS (SELECT chunk_id, regexp_replace(coalesce(page_content, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', ' ', 'g') AS s FROM {CHUNKS}),
        b AS (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(translate(s, chr(9), ' '), ' {{2,}}', ' ', 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g') AS s FROM a),
        c AS (SELECT chunk_id, regexp_replace(s, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g') AS s FROM b),
        d AS (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(s, ' {{2,}}', ' ', 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g') AS s FROM c),
        e AS (SELECT chunk_id, regexp_replace(regexp_replace(s, '\s+([,.;:!?])', '\1', 'g'), '([,;:])([A-Za-z])', '\1 \2', 'g') AS s FROM d)
        SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(s, '\.{{4,}}', '...', 'g'), '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g') AS cleaned FROM e
    """,
    "ocr_normalized": rf"""
        SELECT activity_id, extracted_at, {strip(r"regexp_replace(regexp_replace(regexp_replace(translate(translate(coalesce(text, ''), '‘’“”•▪●·', '''''" + '""' + r"****'), chr(9), ' '), '\s+([,.;:!?])', '\1', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS normalized FROM aif_activities
    """,
    "line_cleaning": rf"""
        SELECT activity_id, {table_line('text')} AS line, {squeezed('text')} AS squeezed,
            trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({squeezed("'| ((' || coalesce(marker, '') || ') ' || text")}, '^[|lI\s]*', ''), '^\(+\s*', '('), '^([^)]*)\)+\s*', '\1) '), '\s+', ' ', 'g')) AS marked
        FROM {ACTIVITIES}
    """,
    "type_names": "SELECT translate(lower(trim(source_organization)), '- ', '__') AS type_name, count(*) AS n FROM scheme_metadata WHERE source_organization IS NOT NULL GROUP BY 1",
    "chunk_ids": f"SELECT chunk_id, substr(sha1(document_id || '_' || page_number || '_' || section), 1, 16) AS made_id, substr(sha1(parent_id || '_child_0'), 1, 16) AS child_id FROM {CHUNKS}",
    "text_quality_gate": rf"""
        WITH a AS (SELECT doc_id, {squeezed('text')} AS s FROM documents),
        b AS (SELECT doc_id, s, regexp_extract_all(s, '{WORD}+') AS w FROM a)
        SELECT doc_id, length(s) >= 100 AND len(w) >= 20 AND len(list_distinct([lower(e) FOR e IN w IF length(e) > 1])) >= 5 AND length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) >= 40
            AND NOT regexp_matches(s, '^(https?://)?(www\.)?[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}/?$') AS sufficient FROM b
    """,
    "text_quality": rf"""
        WITH a AS (SELECT activity_id, confidence, {cleaned('text')} AS s FROM {ACTIVITIES}), b AS (SELECT *, len(list_filter(regexp_extract_all(s, '{WORD}+'), lambda e: regexp_matches(e, '^[A-Za-z0-9]+$'))) AS w FROM a)
        SELECT activity_id, w AS word_count, length(s) AS text_length, {errors(("length(s) = 0", "empty_text"), ("length(s) < 80", "very_short_text"), ("w < 15", "low_word_count"), ("confidence < 0.65", "low_ocr_confidence"))} AS issues FROM b
    """,
    "ocr_quality": rf"""
        WITH a AS (SELECT activity_id, confidence, coalesce(text, '') AS s FROM {ACTIVITIES}),
        b AS (SELECT *, [e FOR e IN string_split_regex(s, '\s+') IF e <> ''] AS w, length(regexp_replace(s, '[A-Za-z0-9\s.,;:!?%()\-/''"&+*=₹$€£]', '', 'g')) AS odd FROM a),
        c AS (SELECT *, length(s) >= 80 AND len(w) >= 15 AS meaningful, CASE WHEN s = '' THEN ['empty_text'] ELSE list_filter([
                CASE WHEN length(s) < 80 THEN 'very_short_text' END, CASE WHEN len(w) < 15 THEN 'low_word_count' END, CASE WHEN odd > greatest(10.0, length(s) * 0.03) THEN 'many_unusual_characters' END,
                CASE WHEN len([e FOR e IN w IF length(e) >= 35]) > 0 THEN 'possible_word_joining' END, CASE WHEN regexp_matches(s, '[^\p{{L}}\p{{N}}_\s]{{6,}}') THEN 'symbol_sequence' END], lambda e: e IS NOT NULL) END
            || CASE WHEN confidence < 0.65 THEN ['low_ocr_confidence'] ELSE [] END AS issues FROM b)
        SELECT activity_id, length(s) AS characters, len(w) AS words, CASE WHEN s = '' THEN 0 ELSE len(string_split(regexp_replace(s, '\n$', ''), chr(10))) END AS lines, meaningful,
            coalesce(confidence < 0.65, false) OR NOT meaningful OR len(issues) >= 3 AS warning, {listed('issues')} AS issues FROM c
    """,
    "valid_documents": f"SELECT coalesce(length({strip('page_content')}) >= {expected.MIN_DOCUMENT_CHARS}, false) AS valid, count(*) AS n FROM {CHUNKS} GROUP BY 1",
    "metadata_filter": f"SELECT chunk_id, document_id FROM {CHUNKS} WHERE document_type = 'circular' AND extraction_method = 'ocr' AND state IS NULL",
    "scope_filter": f"SELECT query_id, count(*) AS documents FROM {PAIRS} GROUP BY 1",
    "metadata_errors": "SELECT chunk_id, " + errors(
        ("source_url IS NULL", "Missing required metadata field: source"), ("image_count IS NULL", "Missing required metadata field: page"),
        ("true", "Missing required metadata field: has_ocr_warning"), ("true", "Missing required metadata field: parser"),
        ("image_count < 1", "Metadata 'page' must be >= 1."), ("page_number < 1", "Metadata 'page_number' must be >= 1."), ("true", "Metadata 'ocr_confidence' must be between 0.0 and 1.0."),
    ) + f" AS errors FROM {CHUNKS}",
    "document_errors": f"SELECT * FROM (SELECT chunk_id, {errors((strip('''coalesce(page_content, '')''') + " = ''", 'Empty content.'), ('source_url IS NULL', 'Missing field: source'))} AS errors FROM {CHUNKS}) WHERE errors <> ''",
    "embedding_validation": "SELECT count(*) AS embeddings, min(len(embedding)) AS least_dimension, max(len(embedding)) AS most_dimension, count(*) FILTER (embedding IS NULL) AS not_numeric, min(len(embedding)) = max(len(embedding)) AS valid FROM embeddings",
    "extract_values": f"SELECT doc_id, {extracted('text', MONEY)} AS money, {extracted('text', PERCENT)} AS percentages, {extracted('text', CAPACITY)} AS capacities FROM documents",
    "heading_properties": rf"""
        WITH a AS (SELECT section AS line FROM scheme_chunks UNION SELECT subsection FROM scheme_chunks WHERE subsection IS NOT NULL), b AS (SELECT line, {heading_text('line')} AS h FROM a)
        SELECT line, h AS heading_text, {level('line')} AS level, {words('line')} AS words, {upper('line')} AS upper, regexp_matches({strip('line')}, '^[*•°◦▪▫‣⁃·\-]') AS bullet,
            {words('line')} > 15 OR regexp_matches(line, '[.,;:]$') AS sentence, {heading(strip('line'))} AS heading, regexp_matches(lower(h), '^({HEADINGS})($|:)') AS known,
            CASE WHEN regexp_matches(lower(h), '^({HEADINGS})$') THEN '' WHEN regexp_matches(lower(h), '^({HEADINGS}) ') THEN {strip(f"substr(h, length(regexp_extract(lower(h), '^({HEADINGS}) ', 1)) + 1)")} ELSE line END AS rest,
            CASE WHEN regexp_matches(lower(h), '^({HEADINGS})$') THEN h WHEN regexp_matches(lower(h), '^({HEADINGS}) ') THEN {strip(f"substr(line, 1, length(regexp_extract(lower(h), '^({HEADINGS}) ', 1)))")} END AS common,
            round(length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) / length(line), 6) AS letters
        FROM b
    """,
    "activity_documents": f"""
        SELECT regexp_extract(document, '([^/\\\\]*)$', 1) AS file_name, page_number AS page, table_no, row_number() OVER (PARTITION BY document, page_number, table_no ORDER BY activity_number, activity_id) AS activity_number,
            'Eligible Activity' || chr(10) || coalesce(marker, '') || ' ' || coalesce(text, '') AS page_content, coalesce(len(warnings), 0) > 0 AS has_ocr_warning FROM {ACTIVITIES}
    """,
    "cost_documents": """
        SELECT regexp_extract(document, '([^/\\\\]*)$', 1) AS file_name, page_number AS page, table_no, item_number,
            'Cost Norm' || chr(10) || 'Item ' || coalesce(CAST(item_number AS VARCHAR), '') || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || 'Cost Norm: ' || coalesce(cost, '') AS page_content,
            coalesce(len(warnings), 0) > 0 AS has_ocr_warning FROM aif_cost_rows
    """,
    "reading_differences": f"""
        WITH l AS (SELECT activity_id, text FROM {ACTIVITIES}), f AS (SELECT activity_id, lower(text) AS text FROM aif_activities QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY extracted_at) = 1)
        SELECT activity_id, {squeezed('l.text')} AS actual, {squeezed('f.text')} AS expected FROM l JOIN f USING (activity_id) WHERE {squeezed('l.text')} <> {squeezed('f.text')}
    """,
    "page_sections": rf"""
        WITH raw AS (SELECT doc_id, {strip('unnest(string_split(text, chr(10)))')} AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
        l AS (SELECT *, {heading_text('line')} AS h FROM raw WHERE line <> ''),
        m AS (SELECT *, CASE WHEN NOT regexp_matches(lower(h), '^({HEADINGS})$') THEN regexp_extract(lower(h), '^({HEADINGS}) ', 1) ELSE '' END AS start FROM l),
        n AS (SELECT *, start <> '' AS embedded, start = '' AND ({heading('line')}) AS pure FROM m),
        o AS (SELECT doc_id, pos, embedded OR pure AS head, CASE WHEN embedded THEN {heading_text('start')} WHEN pure THEN h END AS name, CASE WHEN embedded THEN 1 WHEN pure THEN {level('line')} END AS lv,
                CASE WHEN embedded THEN {strip('substr(h, length(start) + 1)')} WHEN NOT pure THEN line END AS content FROM n),
        p AS (SELECT *, coalesce(sum(CAST(head AND lv = 1 AS INTEGER)) OVER w, 0) AS stretch, sum(CAST(head AS INTEGER)) OVER w AS segment, last_value(name IGNORE NULLS) OVER w AS heading, coalesce(last_value(lv IGNORE NULLS) OVER w, 1) AS heading_level FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        q AS (SELECT *, first_value(name IGNORE NULLS) OVER v AS section, sum(CAST(head AS INTEGER)) OVER v AS nth FROM p WINDOW v AS (PARTITION BY doc_id, stretch ORDER BY pos)),
        r AS (SELECT *, last_value(CASE WHEN head AND nth > 1 THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id, stretch ORDER BY pos) AS subsection FROM q),
        s AS (SELECT doc_id, segment, coalesce(nullif(first(section), ''), 'General') AS section, coalesce(nullif(first(subsection), ''), '-') AS subsection, first(heading) AS heading, max(heading_level) AS heading_level, {strip('string_agg(content, chr(10) ORDER BY pos)')} AS text
            FROM r WHERE content IS NOT NULL GROUP BY 1, 2)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY segment) - 1 AS index, section, subsection, heading, heading_level, text FROM s WHERE text <> ''
    """,
    "table_blocks": f"""
        WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, pos, {table_line('r')} AS line FROM raw), m AS (SELECT *, {table_like('line')} AS tabular FROM l),
        n AS (SELECT *, sum(CAST(NOT tabular AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m),
        o AS (SELECT doc_id, island, count(*) AS lines, string_agg(line, ' ; ' ORDER BY pos) AS raw FROM n WHERE tabular GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS table_number, lines, raw FROM o
    """,
    "content_histogram": f"SELECT coalesce(document_type, 'unknown') AS document_type, count(*) AS n FROM {CHUNKS} GROUP BY 1",
    "chunk_lengths": f"SELECT count(*) AS n, min(length(page_content)) AS shortest, max(length(page_content)) AS longest, round(avg(length(page_content)), 6) AS mean FROM {CHUNKS}",
    "chunk_statistics": "SELECT count(*) AS chunks, count(DISTINCT nullif(document_id, '')) AS documents, count(DISTINCT nullif(parent_id, '')) AS parents FROM scheme_chunks",
    "document_types": "SELECT string_agg(t, ' ; ' ORDER BY t) AS types FROM (SELECT DISTINCT document_type AS t FROM scheme_chunks WHERE document_type IS NOT NULL)",
    "page_methods": f"""
        SELECT document_id, count(*) FILTER (extraction_method = 'ocr') AS ocr, count(*) FILTER (extraction_method = 'pymupdf') AS pymupdf, count(*) FILTER (coalesce(extraction_method, '') NOT IN ('ocr', 'pymupdf')) AS other,
            count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND n < 80) AS short FROM (SELECT *, length({strip("coalesce(page_content, '')")}) AS n FROM {CHUNKS}) GROUP BY 1
    """,
    "quality_report": f"""
        SELECT count(DISTINCT document_id) AS documents, count(*) FILTER (extraction_method = 'ocr') AS ocr, count(*) FILTER (extraction_method = 'pymupdf') AS pymupdf, count(*) FILTER (coalesce(extraction_method, '') NOT IN ('ocr', 'pymupdf')) AS other,
            count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND n < 80) AS short FROM (SELECT *, length({strip("coalesce(page_content, '')")}) AS n FROM {CHUNKS})
    """,
    "full_text": f"""
        WITH p AS (SELECT document_id, page_number, string_agg(page_content, chr(10) ORDER BY page_content) AS text FROM {CHUNKS} WHERE page_content IS NOT NULL GROUP BY 1, 2)
        SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM p WHERE {strip('text')} <> '' GROUP BY 1
    """,
    "page_coverage": f"""
        WITH t AS (SELECT document_id, max(page_number) AS pages FROM {CHUNKS} GROUP BY 1)
        SELECT document_id, CAST(p AS INTEGER) AS page_number FROM (SELECT document_id, unnest(range(1, pages + 1)) AS p FROM t) e WHERE NOT EXISTS (SELECT 1 FROM scheme_chunks c WHERE c.document_id = e.document_id AND c.page_number = e.p)
    """,
    "index_consistency": """
        WITH v AS (SELECT vec_id * 2 AS doc_id FROM embeddings)
        SELECT DISTINCT doc_id, 'bm25_only' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v) UNION ALL SELECT DISTINCT doc_id, 'vector_only' FROM v WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT doc_id, 'bm25_duplicate' FROM documents GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT doc_id, 'vector_duplicate' FROM v GROUP BY 1 HAVING count(*) > 1
    """,
    "best_reading": rf"""
        WITH a AS (SELECT activity_id, extracted_at, {RECORDS} AS confidence, {cleaned('text')} AS s FROM aif_activities), b AS (SELECT *, len(list_filter(regexp_extract_all(s, '{WORD}+'), lambda e: regexp_matches(e, '^[A-Za-z0-9]+$'))) AS w FROM a)
        SELECT activity_id, s AS text, confidence, length(s) AS text_length FROM b QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY round(confidence * 0.55 + least(length(s) / 1000.0, 1) * 0.25 + least(w / 150.0, 1) * 0.2 - CASE WHEN s = '' THEN 1 ELSE 0 END, 12) DESC, extracted_at) = 1
    """,
    "reading_confidence": rf"""
        WITH a AS (SELECT activity_id, coalesce(confidence, -0.01) AS c, unnest(string_split_regex(text, '\s+')) AS w, generate_subscripts(string_split_regex(text, '\s+'), 1) AS i FROM {ACTIVITIES})
        SELECT activity_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (c >= 0 AND w <> ''), '') AS text, round(coalesce(avg(c) FILTER (c >= 0 AND w <> ''), 0.0), 6) AS confidence FROM a GROUP BY 1
    """,
    "native_pages": rf"SELECT doc_id, length({cleaned('text')}) >= 80 AND len(list_filter(regexp_extract_all({cleaned('text')}, '{WORD}+'), lambda e: regexp_matches(e, '^[A-Za-z0-9]+$'))) >= 15 AS native FROM documents",
    "bm25_topk": f"WITH {bm25(NAME_QUERIES, 10)} SELECT query_id, doc_id, score, rank FROM hits",
    "bm25_topk_language": "WITH " + bm25(NAME_QUERIES, 10, f"(SELECT query_id, doc_id FROM {NAME_QUERIES} qq, documents dd WHERE genre = 'note' OR lower(lang) = CASE WHEN length(question) % 2 = 0 THEN 'hi' ELSE 'en' END)") + " SELECT query_id, doc_id, score, rank FROM hits",
    "dense_topk": f"SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM {dense(10)}",
    "dense_postfilter": f"SELECT query_id, d.vec_id, rank FROM {dense(20)} d JOIN embeddings e ON e.vec_id = d.vec_id WHERE label = 3",
    "hybrid_topk": "WITH " + bm25(f"(SELECT doc_id AS query_id, array_to_string({tokens('text')}[1:12], ' ') AS question FROM documents WHERE doc_id % 100 = 0)", 30) + f""",
        lists AS (SELECT query_id, vec_id AS doc_id, rank, 0 AS l FROM {dense(30)} WHERE query_id IN (SELECT doc_id FROM documents) UNION ALL SELECT query_id, doc_id, rank, 1 FROM hits),
        fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS s, min(l * 1000 + rank) AS f FROM lists GROUP BY 1, 2)
        SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, f, doc_id) AS rank FROM fused QUALIFY rank <= 20
    """,
    "reciprocal_rank": """
        WITH r AS (SELECT lower(trim(source)) AS query_id, doc_id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY n_tokens DESC, doc_id) AS a, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY n_chars, doc_id) AS b FROM documents WHERE source IS NOT NULL),
        l AS (SELECT query_id, doc_id, a AS rank, 0 AS l FROM r WHERE a <= 30 UNION ALL SELECT query_id, doc_id, b, 1 FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars NULLS FIRST) AS b FROM (SELECT *, lower(trim(source)) AS query_id FROM documents WHERE false)) UNION ALL SELECT query_id, doc_id, b, 1 FROM r WHERE b <= 30),
        f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS s, min(l * 1000 + rank) AS f FROM l GROUP BY 1, 2)
        SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, f, doc_id) AS rank FROM f QUALIFY rank <= 20
    """,
    "parent_expand": f"""
        WITH h AS (SELECT scheme_id AS query_id, document_id AS parent_id, row_number() OVER (PARTITION BY scheme_id ORDER BY chunk_id) AS rank FROM {CHUNKS}), f AS (SELECT query_id, parent_id, min(rank) AS first FROM h GROUP BY 1, 2),
        m AS (SELECT document_id, document_name FROM scheme_metadata QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC) = 1)
        SELECT query_id, parent_id, document_name, row_number() OVER (PARTITION BY query_id ORDER BY first, parent_id) AS position FROM f JOIN m ON document_id = parent_id
    """,
    "metadata_json": f"""
        SELECT chunk_id, '{{' || array_to_string(list_filter(['"document_type":"' || document_type || '"', '"state":"' || state || '"', '"district":"' || district || '"'], lambda e: e IS NOT NULL), ',') || '}}' AS metadata FROM {CHUNKS}
    """,
    "combined_candidates": """
        WITH r AS (SELECT lower(trim(source)) AS query_id, doc_id, scheme_key, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY n_tokens DESC, doc_id) AS position FROM documents WHERE source IS NOT NULL QUALIFY position <= 12),
        p AS (SELECT query_id, scheme_key, min(position) AS position FROM r WHERE scheme_key IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, scheme_key AS parent_id, 0 AS k, position FROM r UNION ALL SELECT query_id, NULL, scheme_key, 1, position FROM p)
        SELECT query_id, chunk_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY k, a.position) AS position FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k, a.position) <= 15
    """,
    "dense_filtered": f"SELECT query_id, d.vec_id, round(distance, 6) AS distance FROM {dense(15)} d JOIN embeddings e ON e.vec_id = d.vec_id WHERE label = 1",
    "get_parent": f"SELECT chunk_id, document_id FROM {CHUNKS} WHERE document_id = (SELECT max(document_id) FROM scheme_metadata)",
    "exact_dedup": f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(source, ''), coalesce(lang, ''), {norm('text')} ORDER BY doc_id) = 1",
    "quality_control": f"SELECT doc_id FROM documents WHERE length({strip('''coalesce(text, '')''')}) >= 20 QUALIFY row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) = 1",
    "scheme_detect": f"SELECT query_id, question, scheme_key, matched_alias FROM {DETECTED}",
    "fact_questions": f"SELECT query_id, {FACT} AS fact, {FACT_PROMPT} AS fact_prompt FROM {QUESTIONS}",
    "query_variants": rf"""
        WITH a AS (SELECT *, regexp_extract({norm('question')}, '\b20\d{{2}}\s+(?:20)?\d{{2}}\b') AS y FROM {DETECTED}),
        b AS (SELECT query_id, [question] || CASE WHEN scheme_name IS NOT NULL AND y <> '' THEN [scheme_name || ' financial year ' || y || ' total number beneficiaries insured covered amount percentage', scheme_name || ' ' || y || ' total insured number quantity coverage']
            WHEN scheme_name IS NOT NULL THEN [scheme_name || ' total number amount percentage beneficiaries insured coverage'] WHEN y <> '' THEN ['financial year ' || y || ' total number amount percentage beneficiaries insured coverage'] ELSE [] END AS v FROM a)
        SELECT query_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS position, unnest(v) AS variant FROM b
    """,
    "scheme_documents": f"""
        WITH d AS (SELECT DISTINCT document_id, document_name FROM scheme_metadata),
        f AS (SELECT document_id, r.scheme_key, r.name FROM d JOIN scheme_registry r ON {norm('alias')} <> '' AND contains(' ' || {norm('document_name')} || ' ', ' ' || {norm('alias')} || ' ')
            QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY length({norm('alias')}) DESC, ord) = 1)
        SELECT document_id, scheme_key, name IS NOT NULL AND contains({norm("document_name || '.pdf'")}, {norm('name')}) AS scheme_match FROM d LEFT JOIN f USING (document_id)
    """,
    "scheme_first": f"{CANDIDATES} SELECT query_id, doc_id, scheme_match, row_number() OVER (PARTITION BY query_id ORDER BY scheme_match DESC, position) AS position FROM scores",
    "lexical_rerank": f"{CANDIDATES} SELECT query_id, doc_id, round(rerank_score, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS position FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, scores.position) <= 5",
    "candidate_rerank": f"{CANDIDATES} SELECT query_id, doc_id, round(rerank_score, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, scores.position) AS position FROM scores WHERE scores.position <= 15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, scores.position) <= 8",
    "fact_boost": f"""{CANDIDATES},
        a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS nth, len([w FOR w IN [{PERCENT_TERMS}] IF contains({norm('text')}, w)]) AS matches FROM scores),
        b AS (SELECT *, round(CASE WHEN scheme_match THEN 0.2 ELSE 0 END + CASE WHEN matches > 0 THEN 0.05 ELSE 0 END, 6) AS boost FROM a),
        c AS (SELECT *, round(rerank_score + boost, 6) AS score FROM b)
        SELECT * FROM (SELECT query_id, doc_id, boost, matches, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, nth) AS position FROM c) WHERE score >= 0.1
    """,
    "context_build": """
        WITH r AS (SELECT lower(trim(source)) AS query_id, *, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id) AS position FROM documents WHERE source IS NOT NULL)
        SELECT query_id, chr(10) || chr(10) || string_agg('[SOURCE ' || position || ']' || chr(10) || 'File: ' || coalesce(nullif(source, ''), 'unknown') || chr(10) || 'Page: ' || doc_id || chr(10) || 'Content Type: ' || coalesce(genre, 'unknown') || chr(10) || 'Scheme Match: False' || chr(10) || chr(10) || 'Content:' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY position) AS context
        FROM r WHERE position <= 5 GROUP BY 1
    """,
    "source_references": f"""
        WITH r AS (SELECT scheme_id AS query_id, document_name AS file_name, CAST(page_number AS VARCHAR) AS page, chunk_type AS content_type, row_number() OVER (PARTITION BY scheme_id ORDER BY chunk_id) AS position FROM {CHUNKS})
        SELECT query_id, position, file_name, page, content_type FROM r WHERE position <= 5 QUALIFY row_number() OVER (PARTITION BY query_id, file_name, page ORDER BY position) = 1
    """,
    "prompts": f"SELECT query_id, {template(expected.REWRITE_TEMPLATE, history=literal('User: hello'), question='question')} AS rewrite, {template(expected.ANSWER_TEMPLATE, facts=f'CASE WHEN {FACT_PROMPT} THEN {literal(expected.FACT_NOTE)} ELSE {literal('')} END', question='question', context=literal('none'))} AS answer FROM {QUESTIONS}",
    "memory_trim": f"SELECT session_id, seq, role, content FROM {MESSAGES} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 6",
    "history_format": f"""
        WITH r AS (SELECT * FROM {MESSAGES} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 6)
        SELECT session_id, coalesce(string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' END || content, chr(10) ORDER BY seq) FILTER (role <> 'system'), 'No previous conversation.') AS history FROM r GROUP BY 1
    """,
    "history_lines": f"SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE role || ': ' END || ' ' || content || ' ', chr(10) ORDER BY seq) AS history FROM {MESSAGES} GROUP BY 1",
    "memory_sessions": f"SELECT session_id, count(*) AS messages, true AS has_history FROM {MESSAGES} GROUP BY 1",
    "memory_turns": f"""
        WITH l AS (SELECT session_id, max(seq) AS m FROM {MESSAGES} GROUP BY 1),
        a AS (SELECT * FROM {MESSAGES} UNION ALL SELECT session_id, m + 1, 'user', 'q' FROM l UNION ALL SELECT session_id, m + 2, 'assistant', 'a' FROM l)
        SELECT session_id, seq, role, content FROM a WHERE session_id % 2 <> 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4
    """,
}
ORACLES["memory_stream"] = ORACLES["history_format"]
ORACLES["parent_chunks"] = f"""
    WITH s AS ({ORACLES['page_sections']})
    SELECT doc_id AS document_id, 1 AS page_number, index, section, subsection, substr(sha1(doc_id || '_1_' || index || '_' || section || '_' || subsection), 1, 16) AS parent_id, 'parent' AS chunk_type,
        'Section: ' || section || chr(10) || chr(10) || 'Subsection: ' || subsection || chr(10) || chr(10) || text AS page_content FROM s
"""
ORACLES["annex_text"] = f"""
    WITH a AS (SELECT document, page_number, table_no, string_agg(coalesce(marker, '') || ' ' || coalesce(text, ''), chr(10) ORDER BY activity_number, activity_id) AS t FROM {ACTIVITIES} GROUP BY 1, 2, 3),
    c AS (SELECT document, page_number, table_no, string_agg('Item ' || item_number || ': ' || coalesce(description, '') || chr(10) || 'Cost Norm: ' || coalesce(cost, ''), chr(10) ORDER BY item_number) AS t
        FROM (SELECT DISTINCT document, page_number, table_no, item_number, description, cost FROM aif_cost_rows) GROUP BY 1, 2, 3)
    SELECT document, page_number, table_no, 'DOCUMENT: ' || document || chr(10) || 'PAGE: ' || page_number || chr(10) || chr(10) || 'SECTION: Eligible Activities' || chr(10) || a.t || chr(10) || chr(10) || 'SECTION: Cost Norms' || coalesce(chr(10) || c.t, '') AS text
    FROM a LEFT JOIN c USING (document, page_number, table_no)
"""
ORACLES["roman_values"] = rf"""
    SELECT activity_id, CAST(nullif(list_position([{", ".join(map(literal, expected.ROMAN))}], lower(trim(regexp_replace(marker, '[()]', '', 'g')))), 0) AS INTEGER) AS value,
        coalesce({listed(rf"list_filter([{strip('e')} FOR e IN string_split(regexp_replace(text || ' (iv) and (v)' || text, '(^|[^\w])(\((?i:{ROMAN})\))', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda e: e <> '')")}, '') AS rows FROM {ACTIVITIES}
"""
ORACLES["chosen_reading"] = rf"""
    WITH a AS (SELECT activity_id, extracted_at, epoch_us(extracted_at) % 2 = 1 AS late, {RECORDS} AS confidence, {cleaned('text')} AS s FROM aif_activities),
    b AS (SELECT *, len(list_filter(regexp_extract_all(s, '{WORD}+'), lambda e: regexp_matches(e, '^[A-Za-z0-9]+$'))) AS w FROM a),
    p AS (SELECT * FROM b WHERE NOT late QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY round(confidence * 0.55 + least(length(s) / 1000.0, 1) * 0.25 + least(w / 150.0, 1) * 0.2 - CASE WHEN s = '' THEN 1 ELSE 0 END, 12) DESC, extracted_at) = 1)
    SELECT activity_id, s AS text, confidence, confidence < 0.65 OR length(s) < 80 AS retried, 'tesseract_ocr' AS extraction_method FROM p
"""

ORACLES["chunk_errors"] = f"""
    SELECT CASE WHEN c IS NULL THEN 'Missing field: ocr_confidence' ELSE '' END AS errors, true AS known, count(*) AS n
    FROM (SELECT confidence AS c FROM {ACTIVITIES} UNION ALL SELECT confidence FROM aif_cost_rows) GROUP BY 1
"""


def activity_name(c: str) -> str:
    """An activity's name of a text with single spaces, of at most 25 words."""
    bare = rf"trim(regexp_replace({c}, '(^|\W)\((?i:{ROMAN})\)\s*', '\1'))"
    name = rf"regexp_replace(CASE WHEN regexp_matches({bare}, '[0-9]') THEN regexp_extract({bare}, '^(.*?)₹?\s*[0-9]', 1) ELSE {bare} END, '^[ :|\-]+|[ :|\-]+$', '', 'g')"
    words = f"string_split({name}, ' ')"
    return f"CASE WHEN len({words}) > 25 THEN array_to_string({words}[1:25], ' ') || '...' ELSE {name} END"


def values(c: str, pattern: str) -> str:
    return rf"list_filter([trim(regexp_replace(m, '\s+', ' ', 'g')) FOR m IN regexp_extract_all({c}, {literal(pattern)})], lambda e: e <> '')"


ORACLES["semantic_rows"] = f"""
    WITH a AS (SELECT document, page_number, table_no, item_number, extracted_at, {squeezed("concat_ws(' ', raw_description, raw_cost)")} AS s, {squeezed("'(i) ' || raw_description")} AS d FROM aif_cost_rows),
    b AS (SELECT *, {activity_name('s')} AS name, {values('s', MONEY)} AS m, {values('s', PERCENT)} AS p, {values('s', CAPACITY)} AS c FROM a),
    e AS (SELECT *, list_filter([CASE WHEN name <> '' THEN 'Activity: ' || name END, CASE WHEN len(m) > 0 THEN 'Cost/Financial values: ' || array_to_string(m, ', ') END,
        CASE WHEN len(p) > 0 THEN 'Percentages: ' || array_to_string(p, ', ') END, CASE WHEN len(c) > 0 THEN 'Capacity: ' || array_to_string(c, ', ') END,
        CASE WHEN length(s) > length(array_to_string([name] || m || p || c, ' ')) + 40 THEN 'OCR text: ' || s END], lambda x: x IS NOT NULL) AS parts FROM b)
    SELECT document, page_number, table_no, item_number, extracted_at, {activity_name('d')} AS activity, CASE WHEN s = '' THEN '' WHEN len(parts) = 0 THEN 'Original OCR: ' || s ELSE array_to_string(parts, ' | ') END AS row FROM e
"""


def letter_vector(c: str) -> str:
    groups = ("abc", "def", "ghi", "jkl", "mno", "pqr", "stu", "vwxyz")
    return "[" + ", ".join(f"length(regexp_replace(lower(coalesce({c}, '')), '[^{g}]', '', 'g'))" for g in groups) + "]"


def squared(a: str, b: str) -> str:
    return f"list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_transform(list_zip({a}, {b}), lambda z: [z[1], z[2]])])"


ORACLES["hybrid_topk"] = ORACLES["hybrid_topk"].replace(f"array_to_string({tokens('text')}[1:12], ' ')", "text")  # questions are whole texts
ORACLES["bm25_stored"] = ORACLES["bm25_topk"]
ORACLES["bm25_documents"] = "WITH " + bm25("(SELECT doc_id AS query_id, text AS question FROM documents WHERE doc_id % 100 = 0)", 10) + " SELECT query_id, doc_id, score, rank FROM hits"
ORACLES["get_parent"] = f"SELECT chunk_id, parent_id, document_id FROM {CHUNKS} WHERE parent_id = (SELECT max(parent_id) FROM scheme_chunks)"
ORACLES["page_coverage"] = f"""
    WITH t AS (SELECT document_id, max(page_number) AS pages FROM {CHUNKS} GROUP BY 1)
    SELECT document_id, CAST(p AS INTEGER) AS page_number FROM (SELECT document_id, unnest(range(1, pages + 1)) AS p FROM t) e
    WHERE NOT EXISTS (SELECT 1 FROM scheme_chunks c WHERE c.document_id = e.document_id AND c.page_number = e.p AND c.extraction_method = 'ocr')
"""
ORACLES["annex_chunks"] = rf"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY document, page_number, table_no ORDER BY activity_number, activity_id) AS nth FROM aif_activities),
    a AS (SELECT regexp_extract(document, '([^/\\]*)$', 1) AS file_name, page_number AS page, table_no, 'activity' AS content_type, {strip("'Eligible Activity' || chr(10) || coalesce(marker, '') || ' ' || coalesce(text, '')")} AS body FROM n
        UNION ALL SELECT regexp_extract(document, '([^/\\]*)$', 1), page_number, table_no, 'cost_norm',
            {strip("'Cost Norm' || chr(10) || 'Item ' || coalesce(CAST(item_number AS VARCHAR), '') || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || 'Cost Norm: ' || coalesce(cost, '')")} FROM aif_cost_rows)
    SELECT file_name, page, table_no, content_type, body, count(*) AS n FROM a GROUP BY ALL HAVING count(*) <> 1
"""
ORACLES["chunk_checks"] = f"SELECT doc_id, true AS within, true AS parts, true AS complete, true AS numbered FROM documents WHERE {strip('''coalesce(text, '')''')} <> ''"
ORACLES["child_checks"] = f"SELECT parent_id, true AS within, true AS parts, true AS complete, true AS numbered FROM ({ORACLES['parent_chunks']})"
ORACLES["model_rerank"] = f"""{CANDIDATES},
    w AS (SELECT query_id, doc_id, position, list_distinct({tokens('question')}) AS a, list_distinct({tokens('text')}) AS b FROM rows),
    m AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(a || b)) AS score FROM w)
    SELECT query_id, doc_id, round(score, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m.position) AS position FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m.position) <= 5
"""
RETRIEVED = f"""
    asked AS (SELECT d.*, r.file_name AS scheme_file FROM {DETECTED} d LEFT JOIN (SELECT scheme_key, any_value(file_name) AS file_name FROM scheme_registry GROUP BY 1) r USING (scheme_key)),
    several AS (SELECT query_id, CASE WHEN {FACT} THEN ([question] || CASE WHEN scheme_name IS NOT NULL THEN [scheme_name || ' total number amount percentage beneficiaries insured coverage'] ELSE [] END) ELSE [question] END AS v FROM asked),
    single AS (SELECT query_id, unnest(v) AS q, generate_subscripts(v, 1) AS branch FROM several),
    texts AS (SELECT doc_id, {letter_vector('text')} AS e FROM documents),
    near AS (SELECT query_id, branch, doc_id, {squared('e', letter_vector('q'))} AS distance FROM single, texts),
    cut AS (SELECT query_id, branch, doc_id, row_number() OVER (PARTITION BY query_id, branch ORDER BY distance, doc_id) AS rank FROM near QUALIFY rank <= 20),
    placed AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY branch, rank) AS position FROM cut),
    firsts AS (SELECT p.query_id, p.doc_id, p.position, d.text, d.source, d.scheme_key AS file_name, d.genre FROM placed p JOIN documents d USING (doc_id)
        QUALIFY row_number() OVER (PARTITION BY p.query_id, coalesce(d.scheme_key, ''), {norm('d.text')} ORDER BY p.position) = 1),
    matched AS (SELECT f.*, a.question, coalesce({norm('a.scheme_file')} <> '' AND (contains({norm('f.file_name')}, {norm('a.scheme_file')}) OR contains({norm('f.source')}, {norm('a.scheme_file')})), false) AS scheme_match FROM firsts f JOIN asked a USING (query_id)),
    retrieved AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY scheme_match DESC, position) AS position) FROM matched)
"""
ORACLES["retrieved_by_vectors"] = f"WITH {RETRIEVED} SELECT query_id, doc_id, scheme_match, position FROM retrieved"
ORACLES["ask_by_vectors"] = f"""
    WITH {RETRIEVED},
    scored AS (SELECT *, len(list_intersect(list_distinct({tokens('question')}), {tokens('text')})) / len(list_distinct({tokens('question')})) AS score FROM retrieved),
    best AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS position) FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scored.position) <= 5),
    boosts AS (SELECT *, CASE WHEN {FACT} THEN round(score + round(CASE WHEN scheme_match THEN 0.2 ELSE 0 END + CASE WHEN len([w FOR w IN [{PERCENT_TERMS}] IF contains({norm('text')}, w)]) > 0 THEN 0.05 ELSE 0 END, 6), 6) END AS effective FROM best),
    ordered AS (SELECT *, CASE WHEN effective IS NULL THEN position ELSE row_number() OVER (PARTITION BY query_id ORDER BY coalesce(effective, 0) DESC, position) END AS place FROM boosts),
    kept AS (SELECT * FROM ordered WHERE coalesce(effective, score) >= 0.1 AND length({strip('''coalesce(text, '')''')}) >= 20),
    controlled AS (SELECT query_id, doc_id, place FROM kept QUALIFY row_number() OVER (PARTITION BY query_id, {norm('text')} ORDER BY place) = 1),
    listed AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ; ' ORDER BY place) AS documents FROM controlled GROUP BY 1)
    SELECT query_id, question, scheme_key AS scheme, documents FROM asked LEFT JOIN listed USING (query_id)
"""
ANNEX = f"""(
    SELECT DISTINCT content_type, source, page, activity_number, item_number, page_content FROM (
        SELECT 'activity' AS content_type, file_name AS source, page, activity_number, CAST(NULL AS INTEGER) AS item_number, page_content FROM ({ORACLES['activity_documents']})
        UNION ALL SELECT 'cost_norm', file_name, page, NULL, item_number, page_content FROM ({ORACLES['cost_documents']})))"""


def by_field(field: str, value: str) -> str:
    return f"""
        WITH r AS (SELECT *, {letter_vector('page_content')} AS e FROM {ANNEX}), q AS (SELECT query_id, {letter_vector('question')} AS v FROM {NAME_QUERIES}),
        n AS (SELECT query_id, r.*, {squared('e', 'v')} AS distance FROM q, r),
        c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, concat_ws('|', content_type, source, page, activity_number, item_number, page_content)) AS rank FROM n)
        SELECT query_id, {field}, count(*) AS n, CAST(min(distance) AS BIGINT) AS nearest FROM c WHERE rank <= 200 AND {field} = {value} GROUP BY 1, 2
    """


for _field, _value in {
    "content_type": "'activity'", "source": f"(SELECT source FROM {ANNEX} GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 1)", "page": f"(SELECT min(page) FROM {ANNEX})", "activity_number": "3", "item_number": "2",
}.items():
    ORACLES[f"retrieve_by_{_field}"] = by_field(_field, _value)
ORACLES["expected_activities"] = rf"""
    WITH r AS (SELECT DISTINCT document || '|' || page_number || '|' || table_no AS g, lower({squeezed('text')}) AS c FROM aif_activities),
    e AS (SELECT document || '|' || page_number || '|' || table_no AS g, activity_id AS ord, lower(coalesce(text, '')) AS e FROM {ACTIVITIES}),
    p AS (SELECT g, ord, c, CASE WHEN contains(e, c) OR contains(c, e) THEN 0.95 WHEN len(list_distinct(regexp_extract_all(e, '[a-z]+'))) > 0
        THEN len(list_intersect(list_distinct(regexp_extract_all(e, '[a-z]+')), regexp_extract_all(c, '[a-z]+'))) / len(list_distinct(regexp_extract_all(e, '[a-z]+'))) ELSE 0.0 END AS score FROM r JOIN e USING (g) WHERE c <> '')
    SELECT g, ord, round(max(score), 6) AS score FROM p GROUP BY 1, 2
"""
ORACLES["documents_stored"] = f"SELECT chunk_id, coalesce(page_content, '') AS page_content, document_id, page_number, subsection, image_count FROM {CHUNKS}"
ORACLES["dumps_stored"] = f"SELECT chunk_id, parent_id, coalesce(page_content, '') AS page_content, chunk_index FROM {CHUNKS} WHERE chunk_type = 'child'"
ORACLES["pages_stored"] = f"""
    SELECT document_id, page_number, max(extraction_method) AS extraction_method, md5(regexp_replace(coalesce(string_agg(page_content, chr(10) ORDER BY page_content), ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS text
    FROM {CHUNKS} WHERE chunk_type = 'parent' GROUP BY 1, 2
"""
ORACLES["tables_stored"] = f"""
    WITH a AS (SELECT document, page_number, count(*) AS activities, string_agg(coalesce(text, ''), ' ; ' ORDER BY table_no, activity_number, activity_id) AS texts FROM {ACTIVITIES} GROUP BY 1, 2),
    c AS (SELECT document, page_number, count(*) AS costs, string_agg(coalesce(cost, ''), ' ; ' ORDER BY table_no, item_number, extracted_at) AS "values" FROM aif_cost_rows GROUP BY 1, 2)
    SELECT document, page_number, coalesce(activities, 0) AS activities, coalesce(costs, 0) AS costs, texts, "values" FROM a FULL JOIN c USING (document, page_number)
"""
ORACLES["metadata_joined"] = f"""
    WITH m AS (SELECT document_id, document_name, language FROM scheme_metadata QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC) = 1)
    SELECT stem, document_name FROM (SELECT DISTINCT document_id AS stem FROM scheme_chunks) LEFT JOIN (SELECT * FROM m WHERE lower(trim(language)) = 'english') ON document_id = stem
"""
ORACLES["vectors_stored"] = f"SELECT doc_id, CAST(list_sum({letter_vector('text')}) AS BIGINT) AS letters, CAST({letter_vector('text')}[1] AS BIGINT) AS first FROM documents"
ORACLES["files_discovered"] = "SELECT scheme_key, sum(strlen(text) + 1) AS bytes FROM documents WHERE scheme_key IS NOT NULL AND text IS NOT NULL GROUP BY 1"
PAGES_READ = f"""
    parts AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda e: trim(e, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS p FROM documents WHERE text <> ''),
    numbered AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS n FROM parts),
    clean AS (SELECT format('files/{{}}.pdf', doc_id) AS path, CAST(n AS INTEGER) AS page_number, {cleaned('p')} AS s, length(p) AS size, n % 3 = 0 AS blank FROM numbered),
    counted AS (SELECT *, len(list_filter(regexp_extract_all(s, '{WORD}+'), lambda e: regexp_matches(e, '^[A-Za-z0-9]+$'))) AS w FROM clean),
    judged AS (SELECT *, NOT blank AND length(s) >= 80 AND w >= 15 AS native, CASE WHEN size % 2 = 0 THEN 0.9 ELSE 0.6 END AS sure FROM counted),
    read AS (SELECT *, NOT native AND (sure < 0.65 OR length(s) < 80) AS retried, CASE WHEN native THEN 1.0 WHEN sure < 0.65 THEN 0.7 ELSE sure END AS confidence FROM judged)
"""
ORACLES["extracted_pages"] = f"""
    WITH {PAGES_READ}
    SELECT path, page_number, CASE WHEN s = '' THEN 'empty' WHEN confidence < 0.65 THEN 'low' ELSE 'successful' END AS status, retried,
        CASE WHEN s = '' THEN NULL WHEN native THEN 'pymupdf_text' WHEN sure < 0.65 THEN 'tesseract_ocr_retry' ELSE 'tesseract_ocr' END AS extraction_method, CASE WHEN s <> '' THEN confidence END AS confidence FROM read
"""
ORACLES["extracted_lists"] = f"""
    WITH {PAGES_READ}
    SELECT path, coalesce(string_agg(page_number, ' ' ORDER BY page_number) FILTER (s <> '' AND confidence < 0.65), '') AS low, coalesce(string_agg(page_number, ' ' ORDER BY page_number) FILTER (s = ''), '') AS empty,
        coalesce(string_agg(page_number, ' ' ORDER BY page_number) FILTER (retried), '') AS retried, '' AS missing FROM read GROUP BY 1
"""
ORACLES["ingested_parents"] = f"SELECT * FROM ({ORACLES['parent_chunks']}) WHERE document_id % 2 = 0"
ORACLES["image_variants"] = """
    WITH p AS (SELECT s_suppkey, length(s_name) AS w, [ord(c) FOR c IN string_split(s_name, '')] AS a FROM supplier),
    s AS (SELECT *, list_min(a) AS lo, list_max(a) AS hi FROM p),
    t AS (SELECT *, [CAST(round_even((x - lo) * 255.0 / (hi - lo), 0) AS INTEGER) FOR x IN a] AS b FROM s),
    e AS (SELECT *, [CASE WHEN i = 1 OR i = w THEN b[i] ELSE CAST(least(255, greatest(0, round_even((28 * b[i] - 6 * b[i - 1] - 6 * b[i + 1]) / 16.0, 0))) AS INTEGER) END FOR i IN range(1, w + 1)] AS c FROM t)
    SELECT s_suppkey, 3 * list_sum(a) AS original, 3 * list_sum(a) AS grayscale, 2 * list_sum(b) + list_sum(c) AS enhanced,
        255 * (2 * len([x FOR x IN b IF x > 170]) + len([x FOR x IN c IF x > 170])) AS threshold FROM e
"""


def compatible(c: str) -> str:
    """NFKC for what Latin text holds of it: composition, full-width forms, styled letters and digits, ligatures, raised digits, fractions, spaces."""
    out = f"nfc_normalize(coalesce({c}, ''))"
    wide = "(SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) t(i))", "(SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) t(i))"
    styled = "(SELECT string_agg(chr(CAST(119808 + i AS INTEGER)), '' ORDER BY i) FROM range(676) t(i))", "(SELECT string_agg(chr(CAST(CASE WHEN i % 52 < 26 THEN 65 + i % 52 ELSE 71 + i % 52 END AS INTEGER)), '' ORDER BY i) FROM range(676) t(i))"
    digits = "(SELECT string_agg(chr(CAST(120782 + i AS INTEGER)), '' ORDER BY i) FROM range(50) t(i))", "(SELECT string_agg(chr(CAST(48 + i % 10 AS INTEGER)), '' ORDER BY i) FROM range(50) t(i))"
    for a, b in (wide, styled, digits, (literal("²³¹⁰⁴⁵⁶⁷⁸⁹"), literal("2310456789")), (literal("              　"), literal(" " * 15))):
        out = f"translate({out}, {a}, {b})"
    for a, b in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "…": "...", "№": "No", "­": ""}.items():
        out = f"replace({out}, {literal(a)}, {literal(b)})"
    return f"translate({out}, {literal('‘’‚‛“”„‟–—−•')}, {literal(chr(39) * 4 + chr(34) * 4 + '----')})"


def spaced(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(translate({c}, chr(9), ' '), ' {{2,}}', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n +', chr(10), 'g')".replace("{{2,}}", "{2,}")


ORACLES["page_cleaned"] = rf"""
    WITH a AS (SELECT chunk_id, regexp_replace({compatible('page_content')}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', ' ', 'g') AS s FROM {CHUNKS}),
    b AS (SELECT chunk_id, {spaced('s')} AS s FROM a), c AS (SELECT chunk_id, regexp_replace(s, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g') AS s FROM b), d AS (SELECT chunk_id, {spaced('s')} AS s FROM c),
    l AS (SELECT chunk_id, {strip('unnest(string_split(s, chr(10)))')} AS line, generate_subscripts(string_split(s, chr(10)), 1) AS pos FROM d),
    p AS (SELECT *, lag(line, 1, '') OVER (PARTITION BY chunk_id ORDER BY pos) AS before FROM l),
    g AS (SELECT *, line <> '' AND before <> '' AND NOT regexp_matches(line, '^(?:\p{{Nd}}+(?:\.\p{{Nd}}+)*[.)]?\s+|[A-Z][A-Z\s&/\-]{{3,}})')
        AND (regexp_matches(line, '^[a-z]') OR NOT (regexp_matches(line, '^(?:[-*•]|\(?\p{{Nd}}+[.)]|\(?[a-zA-Z][.)])\s+') OR regexp_matches(before, '[.!?:;]$'))) AS goes_on FROM p),
    n AS (SELECT *, sum(CAST(NOT goes_on AS INTEGER)) OVER (PARTITION BY chunk_id ORDER BY pos) AS grp FROM g),
    j AS (SELECT chunk_id, grp, string_agg(line, ' ' ORDER BY pos) AS line FROM n GROUP BY 1, 2),
    u AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY grp) AS s FROM j GROUP BY 1),
    e AS (SELECT chunk_id, regexp_replace(regexp_replace(s, '\s+([,.;:!?])', '\1', 'g'), '([,;:])([A-Za-z])', '\1 \2', 'g') AS s FROM u),
    f AS (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(s, '\.{{4,}}', '...', 'g'), '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g') AS s FROM e)
    SELECT chunk_id, {strip(r"regexp_replace(s, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')")} AS cleaned FROM f
"""
ORACLES["page_tables"] = rf"""
    WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, pos, {table_line('r')} AS line FROM raw), m AS (SELECT *, {table_like('line')} AS tabular FROM l),
    n AS (SELECT *, sum(CAST(NOT tabular AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m),
    o AS (SELECT doc_id, island, list(line ORDER BY pos) AS lines FROM n WHERE tabular GROUP BY 1, 2 HAVING count(*) >= 2),
    t AS (SELECT doc_id, lines, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS table_number FROM o),
    each AS (SELECT doc_id, table_number, unnest(lines) AS line, generate_subscripts(lines, 1) AS li FROM t),
    split AS (SELECT *, list_filter([{squeezed('e')} FOR e IN string_split(regexp_replace({squeezed('line')}, '(^|[^\w])(\((?i:{ROMAN})\))', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda e: e <> '') AS v FROM each),
    parts AS (SELECT doc_id, table_number, li, unnest(v) AS s, generate_subscripts(v, 1) AS pi FROM split),
    b AS (SELECT *, {activity_name('s')} AS name, {values('s', MONEY)} AS m, {values('s', PERCENT)} AS p, {values('s', CAPACITY)} AS c FROM parts),
    e AS (SELECT *, list_filter([CASE WHEN name <> '' THEN 'Activity: ' || name END, CASE WHEN len(m) > 0 THEN 'Cost/Financial values: ' || array_to_string(m, ', ') END,
        CASE WHEN len(p) > 0 THEN 'Percentages: ' || array_to_string(p, ', ') END, CASE WHEN len(c) > 0 THEN 'Capacity: ' || array_to_string(c, ', ') END,
        CASE WHEN length(s) > length(array_to_string([name] || m || p || c, ' ')) + 40 THEN 'OCR text: ' || s END], lambda x: x IS NOT NULL) AS labels FROM b),
    made AS (SELECT doc_id, table_number, list(CASE WHEN len(labels) = 0 THEN 'Original OCR: ' || s ELSE array_to_string(labels, ' | ') END ORDER BY li, pi) AS rows FROM e GROUP BY 1, 2),
    counted AS (SELECT t.*, coalesce(rows, []) AS rows, list_sum([len(regexp_extract_all(x, '(?i)(?:^|\W)\((?:{ROMAN})\)')) FOR x IN lines]) AS k,
        list_sum([len({values('x', MONEY)}) FOR x IN lines]) AS money, list_sum([len({values('x', PERCENT)}) FOR x IN lines]) AS share, list_sum([len({values('x', CAPACITY)}) FOR x IN lines]) AS size FROM t LEFT JOIN made USING (doc_id, table_number)),
    scored AS (SELECT *, round(least(1.0, 0.2 + CASE WHEN len(rows) > 0 THEN 0.2 ELSE 0 END + CASE WHEN k >= 2 THEN 0.2 ELSE 0 END + CASE WHEN money >= 1 THEN 0.15 ELSE 0 END + CASE WHEN share >= 1 THEN 0.1 ELSE 0 END
        + CASE WHEN size >= 1 THEN 0.1 ELSE 0 END + CASE WHEN len([x FOR x IN lines IF regexp_matches(x, '[|\t]')]) > 0 THEN 0.05 ELSE 0 END), 2) AS confidence, 'page_1_table_' || table_number AS table_id FROM counted)
    SELECT doc_id, table_id, array_to_string(rows, ' ; ') AS rows, CAST(confidence AS DOUBLE) AS confidence,
        array_to_string(list_filter([CASE WHEN len(rows) = 0 THEN 'No semantic rows could be reconstructed.' END, CASE WHEN k >= 2 THEN 'Detected ' || k || ' numbered table-row markers.' END, CASE WHEN money >= 1 THEN 'Detected ' || money || ' financial value(s).' END,
            CASE WHEN share >= 1 THEN 'Detected ' || share || ' percentage value(s).' END, CASE WHEN size >= 1 THEN 'Detected ' || size || ' capacity value(s).' END,
            CASE WHEN len([x FOR x IN lines IF length(x) > 300]) > 0 THEN 'One or more OCR lines are very long. Possible multi-column OCR interleaving detected.' END,
            CASE WHEN confidence < 0.6 THEN 'Low normalization confidence. Do not rely on reconstructed column relationships without validation.' WHEN confidence < 0.8 THEN 'Medium normalization confidence. Review reconstructed rows before production ingestion.' ELSE 'High heuristic confidence.' END],
            lambda e: e IS NOT NULL), ' ; ') AS notes,
        'Table: ' || table_id || chr(10) || 'Page: 1' || chr(10) || CASE WHEN len(rows) > 0 THEN 'Rows:' || chr(10) || array_to_string([('Row ' || i || ': ' || rows[i]) FOR i IN range(1, len(rows) + 1)], chr(10)) ELSE 'Original OCR:' || chr(10) || array_to_string(lines, chr(10)) END AS rag_text
    FROM scored
"""
