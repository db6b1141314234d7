"""Splitting oversized texts at natural boundaries (problem 6).

A rolling hash over the characters marks landmarks that depend on the content
alone. From the last cut on, the first landmark beyond the minimum size snaps to
the nearest natural boundary between minimum and maximum; so an edit alters the
neighbouring pieces only. The kind of boundary at which a text can be cut is found
by the same cutting, with boundaries of one kind after the other. Rows are
independent: one pass, no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundaries from the best to the worst, with the separators at which each cuts.
BOUNDARIES = {"paragraph": r"\n\n", "line": r"\n", "sentence": r"\n|\. ", "word": r"\n| "}
PATTERNS = {k: re.compile(p) for k, p in BOUNDARIES.items()}
WINDOW = 32
#: A landmark every so many characters on average, as a share of the largest piece.
LANDMARK_SHARE = 0.25
MIN_SHARE = 0.35
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PIECES = T.StructType([
    T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("body_start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("cut", T.StringType()), T.StructField("piece", T.StringType()),
])


def landmarks(text: str, spacing: int) -> np.ndarray:
    """Positions after which the hash of the last WINDOW characters hits; about one in spacing."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    powers = np.cumprod(np.full(WINDOW, BASE))
    with np.errstate(over="ignore"):
        hashed = np.zeros(len(codes) - WINDOW + 1, dtype=np.uint64)
        for i in range(WINDOW):
            hashed += mixed[i : i + len(hashed)] * powers[WINDOW - 1 - i]
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((hashed >> np.uint64(33)) % np.uint64(max(1, spacing)) == 0) + WINDOW


def cuts(text: str, limit: int, overlap: int, kinds: Iterable[str] = BOUNDARIES, share: float = MIN_SHARE) -> list[tuple[int, str]]:
    """(position, kind) of every cut, at boundaries of these kinds where there are any. Pieces after the first have room for the overlap before them."""
    overlap = max(0, min(overlap, limit - 1))
    room = limit - overlap
    at = landmarks(text, max(16, int(room * LANDMARK_SHARE)))
    places = {k: np.array([m.span() for m in PATTERNS[k].finditer(text)], dtype=np.int64).reshape(-1, 2) for k in kinds}
    # The separator at a cut is left out of the length where there is no minimum size.
    ends = {k: (p[:, 1], p[:, 0] if not share else p[:, 1]) for k, p in places.items()}
    out, last, size = [], 0, len(text)
    while size - last > (limit if last == 0 else room):
        most = last + (limit if last == 0 else room)
        least = last + max(1, int((most - last) * share))
        i = int(np.searchsorted(at, least))
        aim = int(at[i]) if i < len(at) and at[i] <= most else most
        cut, kind = 0, "none"
        for kind, (where, length) in ends.items():
            a, b = np.searchsorted(where, least), np.searchsorted(length, most, side="right")
            if b > a:
                near = where[a:b]
                cut = int(near[np.argmin(np.abs(near - aim))])
                break
        else:
            # No boundary anywhere: at the landmark, but never before a mark that belongs to the letter.
            cut, kind = aim, "none"
            while cut > least and (unicodedata.combining(text[cut]) or text[cut] in "‌‍" or text[cut - 1] in "‌‍"):
                cut -= 1
        out.append((cut, kind))
        last = cut
    return out


def boundary(text: str, limit: int) -> str:
    """The first kind of boundary at which alone every cut can be made, separators left out; else none."""
    for kind in BOUNDARIES:
        if all(k == kind for _, k in cuts(text, limit, 0, (kind,), 0.0)):
            return kind
    return "none"


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str, str]]:
    """Pieces of at most limit characters; those after the first begin with the overlap characters before them."""
    overlap = max(0, min(overlap, limit - 1))
    marks = [*cuts(text, limit, overlap), (len(text), "end")]
    out, last = [], 0
    for n, (cut, kind) in enumerate(marks):
        start = max(0, last - overlap)
        out.append((n, start, last, cut, kind, text[start:cut]))
        last = cut
    return out


def split(df: DataFrame, rules: DataFrame, text: str = "page_content", key: str = "chunk_id", kind: str = "document_type", limit: str = "max_chars", overlap: str = "overlap_chars", keep: bool = True) -> DataFrame:
    """Pieces of each row of df under the limit of its kind, with the boundary at which the text can be cut.

    rules is fixed and small. Rows within the limit, and rows of a kind without a
    rule, come out as one piece with a null boundary, or not at all without keep.
    Null and empty texts have no pieces. A limit below 1 counts as 1; an overlap must
    leave room and is cut to limit - 1; null rules mean no limit, null overlaps none.
    Repeated rows come out twice.
    """
    small = F.broadcast(rules.select(F.col(kind).alias("__kind"), F.col(limit).cast("int").alias("__limit"), F.col(overlap).cast("int").alias("__overlap")).dropDuplicates(["__kind"]))
    rows = df.select(key, text, F.col(kind).alias("__kind")).join(small, "__kind", "left").where(F.length(text) > 0)
    if not keep:
        rows = rows.where(F.col("__limit").isNotNull() & (F.length(text) > F.greatest(F.col("__limit"), F.lit(1))))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("boundary", T.StringType()), *PIECES.fields])
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for k, t, m, o in zip(*(b.column(i).to_pylist() for i in range(4))):
                most = None if m is None else max(1, m)
                if most is None or len(t) <= most:
                    found = [(None, 0, 0, 0, len(t), "end", t)]
                else:
                    at = boundary(t, most)
                    found = [(at, *p) for p in pieces(t, most, o or 0)]
                ids += [k] * len(found)
                out += found
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *(pa.array(c, x) for c, x in zip(columns, kinds))], names=schema.names)

    return rows.select(key, text, "__limit", "__overlap").mapInArrow(run, schema)
