"""Lexical index and BM25 top-k for many queries in one plan.

The index is three tables: postings (term, doc, length, tf), lengths (doc, length)
and terms (term, df). A search joins the queries' few terms with the postings, so
only postings of asked terms move; they hold their document's length, so scores
are summed map-side before the one shuffle, and each query keeps its best k in a
window over its own matches. Many or long queries, whose words match most documents,
are scored document by document instead: the asked postings meet by document, the
queries' weights go to every task, and each task passes on only its best k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import quality as q
from granary.functions import text as t
from granary.runtime import BROADCAST_ROWS, stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words of all queries from which a search goes by document; the results are the same.
MANY = 2_000
#: Words and queries of a pass by document, and postings and queries scored at once.
PASS_WORDS, PASS_QUERIES, POSTINGS, BLOCK = 500_000, 4096, 1 << 16, 1024


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame

    @cached_property
    def statistics(self) -> tuple[int, float, float]:
        """Documents, mean length, and the mean inverse document frequency of the whole vocabulary: three numbers."""
        n, mean = self.lengths.agg(F.count(F.lit(1)), F.avg("length")).first()
        idf = self.terms.agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0]
        return n, mean or 0.0, idf or 0.0


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def index(df: DataFrame, key: str, text: str, keep: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> Index:
    """Index of df's texts. keep: what writes a table and reads it back, for an index that is used more than once."""
    words = df.select(F.col(key).alias("doc"), t.tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))
    postings = keep(words.select("doc", "length", F.explode("tokens").alias("term")).groupBy("term", "doc", "length").agg(F.count(F.lit(1)).cast("int").alias("tf")), "postings")
    return Index(postings, keep(words.select("doc", "length"), "lengths"), keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms"))


@dataclass
class Scope:
    """Which documents a query may see, by state. documents: doc, scope and own state; queries: query and state. Pairs of both are never made: matches are filtered."""

    documents: DataFrame
    queries: DataFrame
    query: str = "query_id"
    state: str = "state"
    scope: str = "applicable_scope"
    own: str = "own_state"

    def _documents(self) -> DataFrame:
        return self.documents.select("doc", F.col(self.scope).alias("__scope"), F.col(self.own).alias("__own"))

    def _queries(self, name: str) -> DataFrame:
        asked = self.queries.select(F.col(self.query).alias(name), F.col(self.state).alias("__state"))
        return F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked

    def kept(self, matches: DataFrame, name: str) -> DataFrame:
        """The matches (name, doc, ...) that are in scope."""
        rows = matches.join(self._queries(name), name).join(self._documents(), "doc")
        return rows.where(q.in_scope(F.col("__scope"), F.col("__own"), F.col("__state"))).select(*matches.columns)

    def first(self, queries: DataFrame, name: str, n: int) -> DataFrame:
        """(name, doc): documents in scope of each query, the first n of each kind of them among these. Kinds are countrywide ones, those of each state, and all."""
        scope, own = F.lower(t.text(F.col("__scope"))), F.lower(t.text(F.col("__own")))
        kinds = F.array_compact(F.array(F.lit("all"), F.when(scope == "india", F.lit("india")), F.when(scope == "state", F.concat(F.lit("state "), own))))
        each = self._documents().select("doc", F.explode(kinds).alias("__kind"))
        best = each.withColumn("__at", F.row_number().over(Window.partitionBy("__kind").orderBy("doc"))).where(F.col("__at") <= n).select("doc", "__kind")
        asked = queries.join(self._queries(name), name)
        state = F.lower(t.text(F.col("__state")))
        wanted = F.when(state == "", F.array(F.lit("all"))).otherwise(F.array(F.lit("india"), F.concat(F.lit("state "), state)))
        return asked.select(name, F.explode(wanted).alias("__kind")).join(best, "__kind").select(name, "doc").distinct()

    def counts(self) -> DataFrame:
        """(query, documents): how many documents are in scope of each query. Documents are counted by kind first."""
        kinds = self._documents().groupBy(F.lower(t.text(F.col("__scope"))).alias("__scope"), F.lower(t.text(F.col("__own"))).alias("__own")).agg(F.count(F.lit(1)).alias("n"))
        kind = F.when(F.col("__scope") == "india", "india").when(F.col("__scope") == "state", F.concat(F.lit("state "), "__own")).otherwise("none")
        kinds = kinds.groupBy(kind.alias("__kind")).agg(F.sum("n").alias("n"))
        kinds = kinds.unionByName(kinds.agg(F.lit("all").alias("__kind"), F.sum("n").alias("n")))
        state = F.lower(t.text(F.col("__state")))
        wanted = F.when(state == "", F.array(F.lit("all"))).otherwise(F.array(F.lit("india"), F.concat(F.lit("state "), state)))
        asked = self._queries(self.query).select(self.query, F.explode(wanted).alias("__kind"))
        return asked.join(kinds, "__kind").groupBy(self.query).agg(F.sum("n").alias("documents"))


def search(ix: Index, queries: DataFrame, k: int, query: str = "query_id", text: str = "question", allowed: Scope | None = None, pad: bool = True) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query; ties go to the smaller doc.

    A token that a query repeats counts again. allowed: the scope to which the
    search is limited before the cut. With pad, queries with fewer matches are
    filled up with documents of score 0 in their order. Queries without a token
    have no result.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(t.tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    number = asked.count()
    few = number <= BROADCAST_ROWS
    documents, mean_length, mean_idf = ix.statistics
    raw = raw_idf(F.lit(documents), F.col("df"))
    weights = ix.terms.join(F.broadcast(asked) if few else asked, "term").select("term", "query", "times", F.when(raw < 0, EPSILON * mean_idf).otherwise(raw).alias("idf"))
    if allowed is None and number > MANY:
        scores = by_document(ix, weights, k, mean_length, number)
    else:
        hits = ix.postings.join(F.broadcast(weights) if few else weights, "term")
        norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / (mean_length or 1.0))
        scores = hits.groupBy("query", "doc").agg(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))
        if allowed is not None:
            scores = allowed.kept(scores, "query")
    ranked = best_of(scores.withColumn("score", F.round("score", 9)), k)
    if pad:
        ranked = padded(ix, asked, stored(ranked, "ranked"), k, allowed)
    return ranked.select(F.col("query").alias(query), "doc", "score", "rank")


def best_of(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; each task passes on no more than k."""
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc())
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def by_document(ix: Index, weights: DataFrame, k: int, mean_length: float, number: int) -> DataFrame:
    """(query, doc, score) of the best k matches of each query in each task, of whole queries: weights has a row for each of their number words."""
    weights = weights.select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))
    passes = max(-(-number // PASS_WORDS), -(-weights.select("query").distinct().count() // PASS_QUERIES), 1)
    parts = [scored(ix, weights.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p) if passes > 1 else weights, k, mean_length) for p in range(passes)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def scored(ix: Index, weights: DataFrame, k: int, mean_length: float) -> DataFrame:
    """One pass over the postings of the words of weights (query, term, weight)."""
    held = weights.orderBy("query", "term").toArrow()
    names, terms = (held.column(c).combine_chunks().dictionary_encode() for c in ("query", "term"))
    order = np.argsort(at := terms.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(terms.dictionary) + 1))
    queries, values = names.indices.to_numpy()[order], held.column("weight").to_numpy()[order]
    spark = ix.postings.sparkSession
    shared = spark.sparkContext.broadcast((names.dictionary.to_pylist(), starts, queries, values))
    numbers = spark.createDataFrame(pa.table({"term": terms.dictionary, "number": pa.array(np.arange(len(terms.dictionary), dtype=np.int32))}))
    schema = T.StructType([T.StructField("query", weights.schema["query"].dataType), T.StructField("doc", ix.postings.schema["doc"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, (ids, starts, queries, values) = to_arrow_schema(schema), shared.value
        best, where = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        docs, seen = [], 0

        def add(rows: pa.Table) -> None:
            """Score whole documents; documents come in order, so the first of equal scores is the smaller."""
            nonlocal seen
            code = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            used, term = np.unique(rows.column(1).to_numpy(), return_inverse=True)
            tf, length = rows.column(3).to_numpy().astype(float), rows.column(2).to_numpy()
            own = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean_length or 1.0)))
            sizes = starts[used + 1] - starts[used]
            line = np.repeat(np.arange(len(used)), sizes)
            cell = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[used], sizes)
            ends = np.r_[begin[1:], len(code)]
            for first in range(0, len(ids), BLOCK):
                last = min(first + BLOCK, len(ids))
                inside = (queries[cell] >= first) & (queries[cell] < last)
                table = np.zeros((len(used), last - first))
                table[line[inside], queries[cell[inside]] - first] = values[cell[inside]]
                new = np.stack([own[i:j] @ table[term[i:j]] for i, j in zip(begin, ends)], axis=1).round(9)
                new[new == 0] = -np.inf
                both = np.concatenate([best[first:last], new], axis=1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :k]
                place = np.concatenate([where[first:last], np.broadcast_to(seen + np.arange(len(begin)), new.shape)], axis=1)
                best[first:last], where[first:last] = np.take_along_axis(both, top, 1), np.take_along_axis(place, top, 1)
            docs.append(rows.column(0).combine_chunks().take(pa.array(begin)))
            seen += len(begin)

        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < POSTINGS:
                continue
            rows = pa.Table.from_batches(waiting)
            code = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            whole = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0  # the last document may go on in the next batch
            if whole:
                add(rows.slice(0, whole))
            waiting = rows.slice(whole).to_batches()
            n = sum(b.num_rows for b in waiting)
        if n:
            add(pa.Table.from_batches(waiting))
        if seen:
            query, column = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids, out.field(0).type).take(pa.array(query)), pa.concat_arrays(docs).take(pa.array(where[query, column])), pa.array(best[query, column])], schema=out)

    asked = ix.postings.join(F.broadcast(numbers) if len(terms.dictionary) <= BROADCAST_ROWS else numbers, "term").select("doc", "number", "length", "tf")
    return asked.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, schema)


def padded(ix: Index, asked: DataFrame, ranked: DataFrame, k: int, allowed: Scope | None) -> DataFrame:
    """ranked with documents of score 0 for queries of fewer than k matches. All matches of such a query are in ranked; of the first 2k documents enough don't match."""
    matches = asked.select("query").distinct().join(ranked.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "query", "left")
    short = stored(matches.where(F.coalesce("n", F.lit(0)) < k).select("query"), "short")
    if short.isEmpty():
        return ranked
    if allowed is None:
        first = [r.doc for r in ix.lengths.select("doc").orderBy("doc").limit(2 * k).collect()]
        pool = short.withColumn("doc", F.explode(F.array(*(F.lit(d).cast(ix.lengths.schema["doc"].dataType) for d in first)))) if first else ranked.select("query", "doc").limit(0)
    else:
        pool = allowed.first(short, "query", 2 * k)
    more = pool.join(ranked, ["query", "doc"], "left_anti").select("query", "doc", F.lit(0.0).alias("score"))
    return best_of(ranked.drop("rank").unionByName(more), k)
