"""Exact vector search of many queries against all rows.

Queries go to every task in blocks of a checked size; rows and queries meet in
matrix products, and each task keeps a running best k of each query and passes on
only that. Rows are never paired with queries in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import quality as q

#: Queries that go to the tasks at once, one pass over the rows each; queries of one matrix product.
BLOCK, PRODUCT = 1 << 16, 512


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", block: int = BLOCK) -> DataFrame:
    """(query, key, distance, rank): the k nearest rows of each query by squared distance; ties go to the smaller key.

    Null vectors, and vectors of another dimension than the first query's, are in no
    result. Rows beside the key and the vector are ignored.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    numbered = queries.where(F.col(vector).isNotNull()).select(query, vector)
    n = numbered.count()
    blocks = max(1, -(-n // block))
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    parts = []
    for b in range(blocks):  # one pass over the rows for each block of queries
        own = numbered.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) if blocks > 1 else numbered
        held = own.orderBy(query).toPandas()
        if len(held):
            parts.append(pass_over(rows, held[query].tolist(), np.stack([np.asarray(v, np.float64) for v in held[vector]]), k, key, vector, schema))
    spark = rows.sparkSession
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy(query).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pass_over(rows: DataFrame, ids: list, asked: np.ndarray, k: int, key: str, vector: str, schema: T.StructType) -> DataFrame:
    dimension = asked.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, (ids, asked) = to_arrow_schema(schema), shared.value
        lengths = (asked**2).sum(axis=1)
        worst = np.full(len(ids), np.inf)  # of the best k so far
        query, distance, key_of = np.zeros(0, np.int64), np.zeros(0), None
        for b in batches:
            if not b.num_rows:
                continue
            own = matrix(b.column(1), dimension)
            keys = np.array(b.column(0).to_pylist())
            squares = (own**2).sum(axis=1)
            found = [(query, distance, key_of)] if key_of is not None else []
            for first in range(0, len(ids), PRODUCT):
                part = asked[first : first + PRODUCT]
                d = np.maximum(0, squares[None, :] + lengths[first : first + PRODUCT, None] - 2 * part @ own.T).round(9)
                bound = worst[first : first + PRODUCT]
                if d.shape[1] > k:
                    bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(d <= bound[:, None])  # all ties at the bound
                found.append((i + first, d[i, j], keys[j]))
            query, distance, key_of = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((key_of, distance, query))
            query, distance, key_of = query[order], distance[order], key_of[order]
            begin = np.searchsorted(query, query)
            kept = np.arange(len(query)) - begin < k
            query, distance, key_of = query[kept], distance[kept], key_of[kept]
            full = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
            worst[query[full]] = distance[full]
        if key_of is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids, out.field(0).type).take(pa.array(query)), pa.array(key_of.tolist(), out.field(1).type), pa.array(distance)], schema=out)

    return rows.where(F.size(vector) == dimension).select(key, vector).mapInArrow(run, schema)


def filtered(rows: DataFrame, queries: DataFrame, k: int, filters: dict[str, object], key: str = "vec_id", **names: str) -> DataFrame:
    """The nearest rows that match all filters, by content type, source, page, activity or item: filtered after the cut, so a query may keep fewer than k, or none."""
    hits = nearest(rows, queries, k, key, **names)
    return hits.join(rows.select(key, *[f for f in filters if f != key]), key).where(q.matches(filters))
