"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import lookalike, mixing, noise, packing, quality, repetition, simjoin, sitelines, split
from granary.runtime import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def common(spark: SparkSession, sf_dir: str) -> list[str]:
    return quality.common_words(table(spark, sf_dir, "common_words"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.records(table(spark, sf_dir, "scheme_chunks"), table(spark, sf_dir, "aif_activities"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = noise.repaired(records(spark, sf_dir), common(spark, sf_dir), repair=False)
    each = found.select("record_id", F.explode("noise").alias("n")).select("record_id", "n.line_no", "n.noise")
    return each.where(F.col("noise").isin("hyphen", "misread", "header", "pageno")).distinct()  # other repeated lines have no kind there


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.repaired(records(spark, sf_dir), common(spark, sf_dir)).select("record_id", "text", F.size("noise").alias("repairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookalike.consistent_form(table(spark, sf_dir, "scheme_chunks"))
    return found.select("chunk_id", F.explode("deviations").alias("deviation")).where(F.col("deviation").isin(*lookalike.DEVIATIONS)).distinct()


def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, sf_dir, "scheme_chunks")).select("chunk_id", "page_content")


def p2_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second rewriting of each text changes nothing, and plain texts were left alone."""
    once = lookalike.consistent_form(table(spark, sf_dir, "scheme_chunks")).select("chunk_id", "page_content", F.size("deviations").alias("n"))
    rows = once.withColumn("key", F.struct("chunk_id", "page_content", "n"))
    twice = lookalike.consistent_form(rows.drop("chunk_id"), key="key")
    return twice.select("key.chunk_id", (F.col("key.page_content").eqNullSafe(F.col("page_content")) & (F.size("deviations") == 0)).alias("stable")).distinct()


def p3_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds found of the chunks that were labelled by hand."""
    rows = text_statistics(spark, sf_dir)
    return rows.join(table(spark, sf_dir, "quality_labels").select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "kind").distinct()


def p3_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics without what the forms of lines say."""
    rows = text_statistics(spark, sf_dir)
    shares = ("mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share", "duplicate_line_share", "duplicate_paragraph_share", "top_2gram_share", "top_3gram_share", "top_4gram_share")
    return rows.select("chunk_id", "word_count", *(F.round(c, 9).alias(c) for c in shares)).distinct()


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kinds of all chunks, site lines left out of the kinds."""
    return quality.text_statistics(table(spark, sf_dir, "scheme_chunks"), common(spark, sf_dir), site="source_url", document="document_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_statistics(spark, sf_dir)
    return rows.where(F.col("kind").isin("list", "table", "junk")).select("chunk_id", "kind").distinct()


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.cleaned(table(spark, sf_dir, "scheme_chunks")).select("chunk_id", F.explode("removed").alias("line_no")).distinct()


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.cleaned(table(spark, sf_dir, "scheme_chunks")).select("chunk_id", "page_content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.expanded(*simjoin.joined(table(spark, sf_dir, "scheme_chunks")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.groups(*simjoin.joined(table(spark, sf_dir, "scheme_chunks")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = split.split(table(spark, sf_dir, "scheme_chunks"), table(spark, sf_dir, "split_rules"), keep=False)
    return cut.where(F.col("boundary").isNotNull()).select("chunk_id", "boundary").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split(table(spark, sf_dir, "scheme_chunks"), table(spark, sf_dir, "split_rules"))


def p6_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text put together from its pieces, whether all keep the limit, and whether each repeats the stated end of the one before."""
    chunks, rules = table(spark, sf_dir, "scheme_chunks"), table(spark, sf_dir, "split_rules")
    limits = chunks.select("chunk_id", "document_type").distinct().join(F.broadcast(rules), "document_type", "left")
    cut = split.split(chunks, rules).distinct().join(limits, "chunk_id")
    within = F.coalesce(F.length("piece") <= F.col("max_chars"), F.lit(True))
    overlapped = (F.col("piece_no") == 0) | (F.col("body_start") - F.col("start") == F.least("body_start", "overlap_chars"))
    body = F.struct("piece_no", F.substring(F.col("piece"), F.col("body_start") - F.col("start") + 1, F.col("end") - F.col("body_start")).alias("t"))
    rows = cut.groupBy("chunk_id").agg(F.array_sort(F.collect_list(body)).alias("b"), F.min(within).alias("within"), F.min(overlapped).alias("overlapped"))
    return rows.select("chunk_id", F.array_join(F.transform("b", lambda x: x["t"]), "").alias("page_content"), "within", "overlapped")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.divided(assignment(spark, sf_dir))


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment(spark, sf_dir).drop("capacity")


def p7_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.certificate(assignment(spark, sf_dir))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and documents of each kind of container, pieces that don't follow each other, containers above their capacity, and whether the bound holds."""
    rows = assignment(spark, sf_dir)
    per_bin = rows.groupBy("container_id", "bin", "capacity").agg(F.sum("tokens").alias("t")).groupBy("container_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    own = F.struct("piece_no", "token_from", "tokens")
    follows = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["token_from"] == F.get("p", i - 1)["token_from"] + F.get("p", i - 1)["tokens"])
    several = rows.where("pieces > 1").groupBy("container_id", "doc_id").agg(F.array_sort(F.collect_list(own)).alias("p")).groupBy("container_id").agg(F.count_if(~follows).alias("torn"))
    totals = rows.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"))
    bound = packing.certificate(rows).select("container_id", (F.col("bins") >= F.col("bound")).alias("bounded"))
    out = totals.join(per_bin, "container_id").join(bound, "container_id").join(several, "container_id", "left")
    return out.select("container_id", "tokens", "documents", "overfull", F.coalesce("torn", F.lit(0)).alias("torn"), "bounded")


def mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, sf_dir)[1].where("chosen_tokens < target_tokens and not reachable").select("mix_name", "source_name").distinct()


def p8_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, sf_dir)[1]


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each source of a mix, whether what was chosen keeps to the target or to all that the source has, and whether any document was used too often."""
    chosen, report = mix(spark, sf_dir)
    uses = chosen.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("mix_name", "source").agg(F.max("n").alias("most"))
    rows = report.withColumn("source", mixing.source_name(F.col("source_name"))).join(uses, ["mix_name", "source"], "left")
    goal = F.least(F.col("target_tokens"), F.col("tokens") * F.col("max_repeats"))
    near = F.abs(F.col("chosen_tokens") - goal) <= F.greatest(F.lit(8 * mixing.BLOCK_TOKENS), 0.02 * goal)
    return rows.select("mix_name", "source_name", "tokens", "mix_tokens", "reachable", near.alias("near_target"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of repeated runs, sentences and paragraphs of each document."""
    rows = repetition.measured(table(spark, sf_dir, "documents"), common(spark, sf_dir))
    return rows.select("doc_id", "words", *(F.round(f"repeated_{c}_share", 9).alias(f"repeated_{c}_share") for c in ("run", "sentence", "paragraph")), "repetitive")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measured(table(spark, sf_dir, "documents"), common(spark, sf_dir)).where("repetitive").select("doc_id").distinct()


def p9_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measured(table(spark, sf_dir, "documents"), common(spark, sf_dir))


NAMES = (
    p1_found, p1_repaired, p2_found, p2_consistent, p2_stable, p3_found, p3_statistics, p3_labelled, p3_measures, p4_found, p4_cleaned, p5_found, p5_groups,
    p6_found, p6_pieces, p6_reassembled, p7_found, p7_assignment, p7_certificate, p7_checked, p8_found, p8_chosen, p8_report, p8_checked, p9_found, p9_measured, p9_shares,
)


def shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {q.__name__: shipped(q) for q in NAMES}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            WITH lines AS (
                SELECT chunk_id, source_url, document_id, unnest(string_split(page_content, chr(10))) AS line, generate_subscripts(string_split(page_content, chr(10)), 1) AS line_no
                FROM (SELECT DISTINCT chunk_id, source_url, document_id, page_content FROM scheme_chunks WHERE source_url IS NOT NULL AND page_content IS NOT NULL)),
            keyed AS (
                SELECT *, regexp_replace(lower(line), '[^a-z]', '', 'g') AS k FROM lines
                WHERE NOT starts_with(line, 'Section:') AND NOT starts_with(line, 'Subsection:')),
            counted AS (SELECT source_url, k, count(DISTINCT document_id) AS n FROM keyed WHERE length(k) >= 20 GROUP BY 1, 2),
            sites AS (SELECT source_url, count(DISTINCT document_id) AS n FROM scheme_chunks WHERE source_url IS NOT NULL GROUP BY 1)
            SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no
            FROM keyed JOIN counted USING (source_url, k) JOIN sites USING (source_url)
            WHERE counted.n >= 5 AND counted.n >= 0.02 * sites.n
        """,
        "p4_cleaned": """
            WITH texts AS (SELECT page_content, source_url, document_id, chunk_id, row_number() OVER () AS n FROM scheme_chunks),
            lines AS (SELECT n, source_url, document_id, unnest(string_split(page_content, chr(10))) AS line, generate_subscripts(string_split(page_content, chr(10)), 1) AS i FROM texts WHERE page_content IS NOT NULL),
            keyed AS (SELECT *, CASE WHEN starts_with(line, 'Section:') OR starts_with(line, 'Subsection:') THEN '' ELSE regexp_replace(lower(line), '[^a-z]', '', 'g') END AS k FROM lines),
            counted AS (SELECT source_url, k FROM keyed WHERE length(k) >= 20 AND source_url IS NOT NULL GROUP BY 1, 2
                HAVING count(DISTINCT document_id) >= 5 AND count(DISTINCT document_id) >= 0.02 * (SELECT count(DISTINCT s.document_id) FROM scheme_chunks s WHERE s.source_url = keyed.source_url)),
            kept AS (SELECT n, string_agg(line, chr(10) ORDER BY i) AS t FROM keyed LEFT JOIN counted c ON c.source_url = keyed.source_url AND c.k = keyed.k WHERE c.k IS NULL GROUP BY n)
            SELECT chunk_id, CASE WHEN page_content IS NULL THEN NULL ELSE coalesce(t, '') END AS page_content FROM texts LEFT JOIN kept USING (n)
        """,
        "p5_found": """
            WITH texts AS (
                SELECT DISTINCT chunk_id, regexp_extract_all(lower(page_content), '[a-z0-9]+') AS w FROM scheme_chunks WHERE page_content IS NOT NULL),
            runs AS (
                SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS r
                FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 40)),
            sizes AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY 1),
            shared AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS s FROM runs a JOIN runs b ON a.r = b.r AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
            SELECT x AS chunk_id_a, y AS chunk_id_b
            FROM shared JOIN sizes p ON p.chunk_id = x JOIN sizes q ON q.chunk_id = y
            WHERE s >= 0.5 * (p.n + q.n - s)
        """,
        "p6_found": """
            WITH long AS (
                SELECT DISTINCT chunk_id, page_content AS t, max_chars AS m FROM scheme_chunks JOIN split_rules USING (document_type) WHERE length(page_content) > max_chars),
            cut AS (
                SELECT chunk_id, m,
                    list_max([length(x) FOR x IN string_split(t, chr(10) || chr(10))]) AS p,
                    list_max([length(x) FOR x IN string_split(t, chr(10))]) AS l,
                    list_max([length(x) FOR x IN string_split_regex(t, '\n|\\. ')]) AS s,
                    list_max([length(x) FOR x IN string_split_regex(t, '\n| ')]) AS w
                FROM long)
            SELECT DISTINCT chunk_id, CASE WHEN p <= m THEN 'paragraph' WHEN l <= m THEN 'line' WHEN s <= m THEN 'sentence' WHEN w <= m THEN 'word' ELSE 'none' END AS boundary FROM cut
        """,
        "p7_found": """
            SELECT DISTINCT CAST(container_id AS INTEGER) AS container_id, doc_id FROM documents JOIN container_specs ON n_tokens > capacity_tokens
        """,
        "p8_found": """
            WITH sizes AS (SELECT lower(trim(source)) AS source, sum(n_tokens) AS tokens FROM documents GROUP BY 1),
            rows AS (SELECT m.*, coalesce(tokens, 0) AS tokens FROM mix_targets m LEFT JOIN sizes ON source = lower(trim(source_name))),
            wholes AS (SELECT *, sum(tokens) OVER (PARTITION BY mix_name) AS whole FROM rows)
            SELECT DISTINCT mix_name, source_name FROM wholes WHERE tokens * max_repeats < target_share * whole
        """,
        "p2_stable": "SELECT DISTINCT chunk_id, true AS stable FROM scheme_chunks",
        "p3_labelled": "SELECT DISTINCT chunk_id, label AS kind FROM quality_labels",
        "p3_measures": r"""
            WITH texts AS (SELECT DISTINCT chunk_id, coalesce(page_content, '') AS t FROM scheme_chunks),
            w AS (SELECT chunk_id, t, regexp_extract_all(lower(t), '[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*') AS w, [trim(x, chr(32) || chr(9) || chr(160) || '    　') FOR x IN string_split(t, chr(10))] AS r, string_split(t, chr(10) || chr(10)) AS p FROM texts),
            x AS (SELECT chunk_id, t, w, len(w) AS n, list_sum([length(e) FOR e IN w]) AS chars, [e FOR e IN r IF e <> ''] AS r,
                [e FOR e IN [regexp_replace(e, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') FOR e IN p] IF e <> ''] AS p FROM w),
            grams AS (
                SELECT chunk_id, g, array_to_string(w[i:i + g - 1], ' ') AS s, list_sum([length(e) FOR e IN w[i:i + g - 1]]) AS size
                FROM (SELECT chunk_id, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM x, (SELECT unnest([2, 3, 4]) AS g))),
            counted AS (SELECT chunk_id, g, s, any_value(size) AS size, count(*) AS k FROM grams GROUP BY 1, 2, 3),
            most AS (SELECT chunk_id, g, max(k) AS k, arg_max(size, k * 1000000 + size) AS size FROM counted GROUP BY 1, 2),
            tops AS (SELECT chunk_id, max(CASE WHEN g = 2 AND k > 1 THEN size * k END) AS a, max(CASE WHEN g = 3 AND k > 1 THEN size * k END) AS b, max(CASE WHEN g = 4 AND k > 1 THEN size * k END) AS c FROM most GROUP BY 1)
            SELECT chunk_id, n AS word_count, round(coalesce(chars / n, 0), 9) AS mean_word_length,
                round(coalesce(length(regexp_replace(t, '[\p{L}\p{N}_\s\p{Z}]', '', 'g')) / nullif(length(regexp_replace(t, '[\s\p{Z}]', '', 'g')), 0), 0), 9) AS symbol_ratio,
                round(coalesce(len([e FOR e IN r IF regexp_matches(e, '[.!?:;”"।]$')]) / nullif(len(r), 0), 0), 9) AS punctuated_line_share,
                round(coalesce(len([e FOR e IN w IF list_contains(known, e)]) / nullif(n, 0), 0), 9) AS common_word_share,
                round(coalesce(1 - list_sum([length(e) FOR e IN list_distinct(r)]) / list_sum([length(e) FOR e IN r]), 0), 9) AS duplicate_line_share,
                round(coalesce(1 - list_sum([length(e) FOR e IN list_distinct(p)]) / list_sum([length(e) FOR e IN p]), 0), 9) AS duplicate_paragraph_share,
                round(CASE WHEN a IS NULL THEN 0 ELSE least(1.0, a / chars) END, 9) AS top_2gram_share, round(CASE WHEN b IS NULL THEN 0 ELSE least(1.0, b / chars) END, 9) AS top_3gram_share, round(CASE WHEN c IS NULL THEN 0 ELSE least(1.0, c / chars) END, 9) AS top_4gram_share
            FROM x LEFT JOIN tops USING (chunk_id), (SELECT list(lower(word)) AS known FROM common_words WHERE word IS NOT NULL)
        """,
        "p5_groups": """
            WITH RECURSIVE texts AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(page_content), '[a-z0-9]+') AS w FROM scheme_chunks WHERE page_content IS NOT NULL AND chunk_id IS NOT NULL),
            members AS (SELECT chunk_id, w, min(chunk_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM texts WHERE len(w) >= 40),
            runs AS (SELECT DISTINCT class_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS r FROM (SELECT class_id, w, unnest(range(1, len(w) - 1)) AS i FROM members WHERE chunk_id = class_id)),
            sizes AS (SELECT class_id, count(*) AS n FROM runs GROUP BY 1),
            shared AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS s FROM runs a JOIN runs b ON a.r = b.r AND a.class_id < b.class_id GROUP BY 1, 2),
            links AS (SELECT x, y FROM shared JOIN sizes p ON p.class_id = x JOIN sizes q ON q.class_id = y WHERE s >= 0.5 * (p.n + q.n - s)),
            sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
            reached AS (SELECT DISTINCT class_id AS a, class_id AS b FROM members UNION SELECT a, y FROM reached JOIN sides ON b = x),
            groups AS (SELECT a AS class_id, min(b) AS group_id FROM reached GROUP BY 1),
            degrees AS (SELECT x AS class_id, count(*) AS links FROM sides GROUP BY 1)
            SELECT chunk_id, class_id, group_id, coalesce(links, 0) AS links FROM members JOIN groups USING (class_id) LEFT JOIN degrees USING (class_id)
        """,
        "p6_reassembled": "SELECT DISTINCT chunk_id, page_content, true AS within, true AS overlapped FROM scheme_chunks WHERE length(page_content) > 0",
        "p7_checked": """
            SELECT CAST(container_id AS INTEGER) AS container_id, sum(n_tokens) AS tokens, count(DISTINCT doc_id) AS documents, 0 AS overfull, 0 AS torn, true AS bounded FROM documents, container_specs GROUP BY 1
        """,
        "p8_checked": """
            WITH sizes AS (SELECT lower(trim(source)) AS source, sum(n_tokens) AS tokens FROM documents GROUP BY 1),
            rows AS (SELECT m.*, coalesce(tokens, 0) AS tokens FROM mix_targets m LEFT JOIN sizes ON source = lower(trim(source_name)))
            SELECT mix_name, source_name, tokens, sum(tokens) OVER (PARTITION BY mix_name) AS mix_tokens, tokens * max_repeats >= target_share * sum(tokens) OVER (PARTITION BY mix_name) AS reachable, true AS near_target, true AS within_repeats FROM rows
        """,
        "p9_shares": r"""
            WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, [w FOR w IN string_split_regex(lower(coalesce(text, '')), '\s+') IF w <> ''] AS w FROM documents),
            parts AS (SELECT doc_id, w, [e FOR e IN [lower(regexp_replace(e, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) FOR e IN regexp_extract_all(t, '[^.!?।\n]+')] IF e <> ''] AS s,
                [e FOR e IN [regexp_replace(e, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') FOR e IN string_split(t, chr(10) || chr(10))] IF e <> ''] AS p FROM texts),
            runs AS (SELECT doc_id, 1 - count(DISTINCT r) / count(*) AS share FROM (SELECT doc_id, w[i:i + 4] AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM parts)) GROUP BY 1)
            SELECT doc_id, len(w) AS words, round(coalesce(share, 0), 9) AS repeated_run_share, round(coalesce(1 - list_sum([length(e) FOR e IN list_distinct(s)]) / list_sum([length(e) FOR e IN s]), 0), 9) AS repeated_sentence_share,
                round(coalesce(1 - list_sum([length(e) FOR e IN list_distinct(p)]) / list_sum([length(e) FOR e IN p]), 0), 9) AS repeated_paragraph_share, len(w) >= 20 AND coalesce(share, 0) >= 0.25 AS repetitive
            FROM parts LEFT JOIN runs USING (doc_id)
        """,
        "p9_found": """
            WITH texts AS (SELECT doc_id, [w FOR w IN string_split_regex(lower(text), '\\s+') IF w <> ''] AS w FROM documents WHERE text IS NOT NULL),
            runs AS (SELECT doc_id, w[i:i + 4] AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 20))
            SELECT doc_id FROM runs GROUP BY doc_id HAVING 1 - count(DISTINCT r) / count(*) >= 0.25
        """,
    }
