"""Lines repeated across one site's documents (problem 4).

Documents get ordinals within their site: a container of bounded size and a place
in it. A first pass bounds each line's documents from above, summed before the
shuffle; only lines that may reach the thresholds go on. Each variant of such a
line has a bitmap of its documents per container; the bitmaps of a line's variants
are united, exact cardinalities meet the thresholds, and a line of a document is
deleted if its line's bitmap has the document. For the lookup bitmaps are compressed
(an array while a container is sparse, bits once it is dense).

No shuffled group exceeds a container, however many documents share a line. The
excessive lines are few whatever the input: each holds at least MIN_SHARE of its
site's documents, so a site has at most 1 / MIN_SHARE times the lines of a mean
document. Their number is still counted before they are sent to the tasks; above
the bounds they are joined instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.runtime import BROADCAST_ROWS, stored

MIN_DOCUMENTS, MIN_SHARE, MIN_LETTERS = 5, 0.02, 20
#: Places of a container: as many as Spark's bitmaps have bits.
CONTAINER = 32_768
#: Bytes of a bitmap, and places up to which an array is smaller.
DENSE, SPARSE = CONTAINER // 8, CONTAINER // 16
#: What a bitmap takes in Python's memory beside its bytes.
OVERHEAD = 256
#: Lines, and bytes of bitmaps, up to which they go to every task.
MOST_LINES, MOST_BYTES = 200_000, 128 << 20
SKIPPED = ("Section:", "Subsection:")
DROP = bytes(c for c in range(256) if not (97 <= c <= 122 or c == 10))
NO_LETTER = re.compile(r"[\W\d_]+")


def keys(text: str, every: bool = False, min_letters: int = MIN_LETTERS) -> list[bytes]:
    """Letters a to z of each line, lower-cased; empty where the line doesn't count. every: the letters of all scripts instead."""
    low, rows = text.lower(), text.split("\n")
    kept = [NO_LETTER.sub("", r) for r in low.split("\n")] if every and not text.isascii() else None
    if kept is None or len(kept) != len(rows):
        kept = low.encode("ascii", "ignore").translate(None, DROP).split(b"\n")
    return [(k if isinstance(k, bytes) else k.encode()) if len(k) >= min_letters and not r.startswith(SKIPPED) else b"" for k, r in zip(kept, rows)]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def halves(key: bytes) -> tuple[int, int]:
    """128 bits of a line's letters as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(key)
    return signed(d >> 64), signed(d & ((1 << 64) - 1))


def ordinals(df: DataFrame, site: str, document: str) -> DataFrame:
    """(site, document, container, place): exact ordinals without a global sort. A hash bucket fills half a container on average."""
    documents = df.select(site, document).where(F.col(site).isNotNull() & F.col(document).isNotNull()).distinct()
    most = documents.groupBy(site).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-2 * most // CONTAINER))
    order = Window.partitionBy(site, "bucket").orderBy(document)
    rank = F.row_number().over(order) - 1
    return (
        documents.withColumn("bucket", F.pmod(F.xxhash64(document), F.lit(buckets)).cast("int"))
        .withColumn("rank", rank)
        .select(site, document, (F.col("bucket") + buckets * F.floor(F.col("rank") / CONTAINER)).cast("int").alias("container"), (F.col("rank") % CONTAINER).cast("int").alias("place"))
    )


def bounds(rows: DataFrame, every: bool) -> DataFrame:
    """(site, k1, k2, most): a line's documents, bounded from above by the sum of those in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["site", "k1", "k2", "n"]
        for b in batches:
            seen: set[tuple[str, bytes, int, int]] = set()
            for t, s, c, p in zip(*(b.column(i).to_pylist() for i in range(4))):
                seen.update([(s, key, c, p) for key in keys(t, every) if key])
            found = Counter([(s, key) for s, key, _, _ in seen])
            hashed = [halves(k) for _, k in found]
            arrays = [pa.array([s for s, _ in found], pa.string()), pa.array([h[0] for h in hashed], pa.int64()), pa.array([h[1] for h in hashed], pa.int64()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    lines = rows.select("text", "site", "container", "place").mapInArrow(run, "site string, k1 bigint, k2 bigint, n bigint")
    return lines.groupBy("site", "k1", "k2").agg(F.sum("n").alias("most"))


def variants(rows: DataFrame, candidates: DataFrame, every: bool) -> DataFrame:
    """(site, k1, k2, variant, container, place) of every line that is a candidate."""
    few = candidates.count() <= MOST_LINES
    shared = rows.sparkSession.sparkContext.broadcast({(r.site, r.k1, r.k2) for r in candidates.collect()} if few else None)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = ["site", "k1", "k2", "variant", "container", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            found, cache = set(), {}
            for t, s, c, p in zip(*(b.column(i).to_pylist() for i in range(4))):
                for key, row in zip(keys(t, every), t.split("\n")):
                    if key:
                        at = cache.get(key) or cache.setdefault(key, halves(key))
                        if wanted is None or (s, *at) in wanted:
                            found.add((s, *at, xxhash.xxh32_intdigest(row.strip()) - (1 << 31), c, p))
            columns = list(zip(*found)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    out = rows.select("text", "site", "container", "place").mapInArrow(run, "site string, k1 bigint, k2 bigint, variant int, container int, place int")
    return out if few else out.join(candidates, ["site", "k1", "k2"], "left_semi")


def bitmaps(facts: DataFrame) -> DataFrame:
    """(site, k1, k2, container, bits, cardinality): a bitmap of documents for each variant and container, united over the variants of a line."""
    line = ["site", "k1", "k2", "container"]
    by_variant = facts.groupBy(*line, "variant").agg(F.bitmap_construct_agg(F.col("place").cast("bigint")).alias("bits"))
    return by_variant.groupBy(*line).agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("cardinality", F.bitmap_count("bits"))


def compressed(maps: DataFrame) -> DataFrame:
    """The same with the places of sparse bitmaps as an array of two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [pack(x, n) for x, n in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], names=["site", "k1", "k2", "container", "data"])

    return maps.select("site", "k1", "k2", "container", "bits", "cardinality").mapInArrow(run, "site string, k1 bigint, k2 bigint, container int, data binary")


def pack(bits: bytes, cardinality: int) -> bytes:
    if cardinality >= SPARSE:
        return bits
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.uint16).tobytes()


def placed(rows: DataFrame, at: DataFrame) -> DataFrame:
    """rows with the container and place of their documents. Up to BROADCAST_ROWS documents go to the tasks as a hash and two numbers each, as long as no two share a hash."""
    hashed = F.when(F.col("site").isNotNull() & F.col("document").isNotNull(), F.xxhash64("site", "document"))
    short = at.select(hashed.alias("__hash"), "container", "place")
    number, distinct = short.agg(F.count(F.lit(1)), F.count_distinct("__hash")).first()
    if number > BROADCAST_ROWS or distinct < number:
        return rows.join(at, ["site", "document"], "left")
    return rows.withColumn("__hash", hashed).join(F.broadcast(short), "__hash", "left").drop("__hash")


def excessive(df: DataFrame, text: str, site: str, document: str, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of df with the ordinals of their documents, bitmaps of the excessive lines)."""
    at = stored(ordinals(df.select(F.col(site).alias("site"), F.col(document).alias("document")), "site", "document"), "ordinals")
    sizes = at.groupBy("site").agg(F.count(F.lit(1)).alias("documents"))
    keyed = df.select(F.col(text).alias("text"), F.col(site).alias("site"), F.col(document).alias("document"), *[c for c in df.columns if c.startswith("__")])
    rows = placed(keyed, at)
    counted = rows.where(F.col("container").isNotNull() & F.col("text").isNotNull())
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    enough = (F.col("most") >= min_documents) & (F.col("most") >= F.col("documents") * min_share)
    candidates = stored(bounds(counted, every).where(F.col("most") >= min_documents).join(sizes, "site").where(enough).select("site", "k1", "k2"), "candidates")
    maps = stored(bitmaps(variants(counted, candidates, every)), "bitmaps")
    lines = maps.groupBy("site", "k1", "k2").agg(F.sum("cardinality").alias("cardinality")).join(sizes, "site")
    lines = lines.where((F.col("cardinality") >= min_documents) & (F.col("cardinality") >= F.col("documents") * min_share)).select("site", "k1", "k2")
    return rows, maps.join(lines, ["site", "k1", "k2"], "left_semi")


def has(data: bytes | None, place: int) -> bool:
    if data is None:
        return False
    if len(data) == DENSE:
        return bool(data[place >> 3] >> (place & 7) & 1)
    places = np.frombuffer(data, np.uint16)
    at = int(places.searchsorted(place))
    return at < len(places) and int(places[at]) == place


def cleaned(df: DataFrame, text: str = "page_content", site: str = "source_url", document: str = "document_id", key: str = "chunk_id", min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, most_bytes: int = MOST_BYTES, every_script: bool = False, delete: bool = True) -> DataFrame:
    """key, the text without lines repeated too often within its site, and the numbers (from 1) of the lines removed.

    A row whose site or document is null belongs to no site: nothing is counted or
    removed. Null and empty texts stay as they are. Documents count once per line,
    so repeated rows add nothing; they come out as often as they came in. Lines are
    compared by their letters a to z, with every_script by those of all scripts. Without
    delete the texts stay whole and only the numbers are given. key may be a struct. Other
    columns of df are ignored, whatever their names. An empty df gives no rows.
    """
    rows, lines = excessive(df.select(F.col(key).alias("__key"), text, site, document), text, site, document, min_documents, min_share, every_script)
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(text, T.StringType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])
    held = held_lines(lines, most_bytes)
    if held is None:
        return joined(rows, lines, out, every_script, delete)
    shared = df.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, every_script)
        for b in batches:
            texts, gone = [], []
            for t, s, c, p in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                found = finder.found(t, s, c, p)
                if found and delete:
                    drop = set(found)
                    t = "\n".join(r for i, r in enumerate(t.split("\n"), 1) if i not in drop)
                texts.append(t)
                gone.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.list_(pa.int32()))], names=out.names)

    return rows.select("__key", "text", "site", "container", "place").mapInArrow(run, out)


def held_lines(lines: DataFrame, most_bytes: int = MOST_BYTES) -> dict[tuple, dict[int, bytes]] | None:
    """Bitmaps of the excessive lines by line and container for every task, or None if they take more than most_bytes."""
    size = lines.agg(F.sum(F.least(2 * F.col("cardinality"), F.lit(DENSE)) + OVERHEAD)).first()[0] or 0
    if size > most_bytes:
        return None
    held: dict[tuple, dict[int, bytes]] = {}
    for r in compressed(lines).toLocalIterator():
        held.setdefault((r.site, r.k1, r.k2), {})[r.container] = bytes(r.data)
    return held


class Finder:
    """Finds the excessive lines of one text after another."""

    def __init__(self, held: dict[tuple, dict[int, bytes]], every: bool = False):
        self.held, self.every = held, every
        self.cache: dict[tuple, tuple] = {}

    def found(self, text: str | None, site: str | None, container: int | None, place: int | None) -> list[int]:
        """Numbers from 1 of the lines of a document's text that are excessive in its site."""
        out: list[int] = []
        if text and container is not None:
            cache, held = self.cache, self.held
            for i, k in enumerate(keys(text, self.every), 1):
                if k:
                    at = cache.get((site, k))
                    if at is None:
                        if len(cache) > MOST_LINES:
                            cache.clear()
                        at = cache[site, k] = (site, *halves(k))
                    if at in held and has(held[at].get(container), place):
                        out.append(i)
        return out


def joined(rows: DataFrame, lines: DataFrame, out: T.StructType, every: bool = False, delete: bool = True) -> DataFrame:
    """The same by joins, where the bitmaps are too large for every task to hold."""
    key, text, _ = out.names
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r, i, *halves(k)) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, k in enumerate(keys(t, every), 1) if k]
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "line_no", "k1", "k2"])

    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = rows.select("row", "text").mapInArrow(run, "row bigint, line_no int, k1 bigint, k2 bigint").join(rows.select("row", "site", "container", "place"), "row")
    bit = F.expr("shiftright(conv(hex(substring(bits, cast(place / 8 as int) + 1, 1)), 16, 10), place % 8) & 1") == 1
    gone = found.join(lines.drop("cardinality"), ["site", "k1", "k2", "container"]).where(bit).groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("removed", (i + 1).cast("int")))
    empty = F.array().cast("array<int>")
    return rows.join(gone, "row", "left").select(F.col("__key").alias(key), F.when(F.col("removed").isNull() | F.lit(not delete), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text), F.coalesce("removed", empty).alias("removed"))
