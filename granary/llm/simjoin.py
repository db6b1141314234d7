"""Near-duplicate texts with small edits: a chosen-path set similarity join (problem 5).

Texts become sets of runs of WIDTH words, with a signature of minwise tokens.
In each of several independent trees a record branches, at the root and at every
node that is too large, into BRANCHES children: the node chooses positions of the
signature that no node above it chose, and the record goes where its tokens at
them lead. Records of small nodes are compared exhaustively by a sketch of the signature, and pairs that pass
are checked exactly on their whole sets. Branching a node on 1 / threshold tokens
keeps a similar pair together somewhere with a chance that falls with the depth.
Trees are repeated until a pair at the threshold is met with the chance RECALL: the
first ones suffice down to some depth, and the records of nodes that went on beyond
it go through further trees, each record through as many as its own depth needs.

Exact copies are one record from the start. Node sizes are counted with partial
sums, so no large node is ever gathered. A node that hasn't shrunk over two levels
holds texts that are all alike (over one, texts that share a notice, which the next
position parts); it is compared in blocks, in bounded groups, without loss. What is
to be compared is shuffled in passes over parts of the nodes, each bounded by the
number of records and removed from the disk before the next.
The driver sees counts, and the numbers of large nodes (not of records) as long as
they are few enough to go to every task; beyond HELD_NODES they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.runtime import BROADCAST_ROWS, checkpointed, release, stored

WIDTH, MIN_WORDS, THRESHOLD = 3, 40, 0.5
TREES, BRANCHES, SIGNATURE, RECALL = 8, 2, 64, 0.999
#: A node up to this size is compared exhaustively; a node must be SHRINK times its parent's parent or less to go on.
SMALL, SHRINK, MAX_DEPTH = 256, 0.5, 12
#: Small nodes that make up a pair of blocks. Rows for each record, and at least, that are shuffled at once to be compared.
BLOCK, PASS_ROWS, LEAST_ROWS = 32, 16, 1 << 22
#: Pairs for each record, and at least, that meet their sets at once.
PASS_PAIRS, LEAST_PAIRS = 0.5, 1 << 18
#: Spark's setting to remove what a query shuffled as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SKETCHED, SKETCH_BITS, PER_NUMBER = 64, 4, 16
#: Equal nibbles of the sketch that a pair must have. At similarity 0.5 34 of 64 are expected, with a deviation of 4.
SKETCH_MATCHES = 22
#: Bytes of texts handled at once, and of a shingle's hash in a set; large nodes that go to every task.
SLICE, HASH_BYTES, HELD_NODES = 1 << 19, 5, BROADCAST_ROWS

U = np.uint64
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(97, 123)]] = True
RANDOM = np.random.default_rng(20240229)
BYTES = RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
STEP = U(0x9E3779B97F4A7C15)
MULTIPLIERS = RANDOM.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * U(2) + U(1)
MASKS = RANDOM.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in order, in lists of about SLICE characters; (index of the first, texts)."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of a to z and 0 to 9 in the lower-cased texts."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\x00".join(parts) + b"\x00", dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    inside = ALNUM[data]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    stops = np.flatnonzero(inside[:-1] & ~inside[1:])
    length = stops - starts + 1
    where = np.flatnonzero(inside)
    offset = np.arange(len(where)) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[U(1), np.full(int(length.max()), STEP)])
        hashed = np.add.reduceat(BYTES[data[where]] * powers[offset], np.cumsum(length) - length)
    return mix(hashed), np.searchsorted(ends, starts, side="right")


def shingles(hashed: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of width words within one text."""
    n = len(hashed) - width + 1
    if n < 1:
        return hashed[:0], owner[:0]
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix(out * STEP + hashed[i : i + n])
    ok = owner[:n] == owner[width - 1 :]
    return out[ok], owner[:n][ok]


def signatures(texts: list[str | None], width: int, min_words: int, size: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, identity of the word sequence, minwise tokens) of the texts that are long enough."""
    numbers, identities, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros((0, size), np.uint16)]
    for first, part in slices(texts):
        hashed, owner = words(part)
        counts = np.bincount(owner, minlength=len(part)) if len(owner) else np.zeros(len(part), int)
        keep = counts >= max(min_words, width)
        chosen = keep[owner] if len(owner) else np.zeros(0, bool)
        hashed, owner = hashed[chosen], owner[chosen]
        if not len(hashed):
            continue
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
        with np.errstate(over="ignore"):
            identity = mix(np.add.reduceat(mix(hashed + place.astype(np.uint64) * STEP), begin))
        least = np.empty((len(begin), size), dtype=np.uint32)
        if size:
            runs, of = shingles(hashed, owner, width)
            at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            with np.errstate(over="ignore"):
                for k in range(size):
                    least[:, k] = np.minimum.reduceat((runs ^ MASKS[k]) * MULTIPLIERS[k], at) >> U(32)
        numbers.append(owner[begin] + first)
        identities.append(identity)
        rows.append(least.astype(np.uint16))  # their lowest bits
    return np.concatenate(numbers), np.concatenate(identities), np.concatenate(rows)


def signed(df: DataFrame, text: str, key: str, width: int, min_words: int, size: int = SIGNATURE) -> DataFrame:
    """(key, id, copy, signature) of each text of at least min_words words; exact copies have the same copy, the signature has size tokens."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("id", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, identity, rows = signatures(b.column(1).to_pylist(), width, min_words, size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(numbers)), pa.array(identity.view(np.int64)), b.column(2).take(pa.array(numbers)), pa.array([r.tobytes() for r in rows], pa.binary())], names=schema.names)

    return df.where(F.col(key).isNotNull()).select(key, text, F.xxhash64(text).alias("copy")).mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SIGNATURE)


def sketch(rows: np.ndarray) -> list[np.ndarray]:
    """The lowest bits of the first tokens, in a few numbers."""
    low = (rows[:, :SKETCHED] & np.uint16((1 << SKETCH_BITS) - 1)).astype(np.uint64)
    shifts = (np.arange(PER_NUMBER, dtype=np.uint64) * U(SKETCH_BITS))[None, :]
    return [(low[:, i : i + PER_NUMBER] << shifts).sum(axis=1, dtype=np.uint64).view(np.int64) for i in range(0, SKETCHED, PER_NUMBER)]


def children(node: np.ndarray, rows: np.ndarray, depth: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BRANCHES child nodes of each record, and the positions used on the way to them as bits: the node picks positions that are new on its path, the record's tokens the child."""
    out, bits, taken = np.empty((len(node), BRANCHES), dtype=np.uint64), np.empty((len(node), BRANCHES), dtype=np.uint64), used.copy()
    with np.errstate(over="ignore"):
        picked = mix(node + U(depth + 1) * STEP)
        at, stride = picked % U(SIGNATURE), (picked >> U(32)) | U(1)
        for j in range(BRANCHES):
            again = np.flatnonzero((taken >> at) & U(1))
            while len(again):  # an odd stride comes to every position
                at[again] = (at[again] + stride[again]) % U(SIGNATURE)
                again = again[((taken[again] >> at[again]) & U(1)).astype(bool)]
            taken |= U(1) << at
            bits[:, j] = used | (U(1) << at)
            out[:, j] = mix(mix(node ^ at * STEP) + rows[np.arange(len(node)), at.astype(np.int64)])
    return out.ravel(), bits.ravel()


SKETCH = [f"s{i}" for i in range(1, SKETCHED // PER_NUMBER + 1)]
BRANCHED = "node bigint, id bigint, used bigint, parent bigint, past bigint, " + ", ".join(f"{s} bigint" for s in SKETCH)
#: For a level, its large nodes in order, their sizes, and whether they stopped shrinking.
Large = tuple[np.ndarray, np.ndarray, np.ndarray]


class Level(NamedTuple):
    """Every record in every node of a level: the record's place, the positions used, the sizes of the parent and of its parent (0: the root), the node's own; size 0 stands for small nodes, and for all of the last level."""

    node: np.ndarray
    at: np.ndarray
    used: np.ndarray
    parent: np.ndarray
    past: np.ndarray
    size: np.ndarray
    stuck: np.ndarray


def walked(rows: np.ndarray, trees: range, held: list[Large]) -> Iterator[Level]:
    """The levels of these trees, down to the one below those held."""
    with np.errstate(over="ignore"):
        start = mix(np.arange(trees.start + 1, trees.stop + 1, dtype=np.uint64))
    at = np.repeat(np.arange(len(rows)), len(trees))
    node, used = np.tile(start, len(rows)), np.zeros(len(at), np.uint64)
    parent = past = np.zeros(len(at), np.int64)
    for depth in range(len(held) + 1):
        node, used = children(node, rows[at], depth, used)
        at, parent, past = (np.repeat(x, BRANCHES) for x in (at, parent, past))
        size, stuck = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        if depth < len(held) and len(held[depth][0]):
            nodes, sizes, no_more = held[depth]
            where = np.minimum(np.searchsorted(nodes, node.view(np.int64)), len(nodes) - 1)
            inside = nodes[where] == node.view(np.int64)
            size, stuck = np.where(inside, sizes[where], 0), inside & no_more[where]
        yield Level(node, at, used, parent, past, size, stuck)
        on = (size > 0) & ~stuck
        node, at, used, parent, past = node[on], at[on], used[on], size[on], parent[on]


def met(depth: int, threshold: float = THRESHOLD) -> float:
    """Chance that a pair at the threshold is still together at some node of a tree after so many branchings."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - threshold * p) ** BRANCHES
    return p


def trees_needed(depth: int, recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Independent trees of this depth that meet a pair at the threshold with the chance recall."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - met(depth, threshold)))))


def node_counts(records: DataFrame, held: list[Large], trees: range) -> DataFrame:
    """(node, n, past) of the next level of these trees; counted in each batch before the shuffle."""
    shared = records.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for last in walked(matrix(b.column(0)), trees, shared.value):
                pass
            found, first, n = np.unique(last.node.view(np.int64), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64)), pa.array(last.past[first])], names=["node", "n", "past"])

    return records.select("signature").mapInArrow(run, "node bigint, n bigint, past bigint").groupBy("node").agg(F.sum("n").alias("n"), F.max("past").alias("past"))


def level(records: DataFrame, held: list[Large], trees: range) -> DataFrame:
    """The next level of these trees, record by record."""
    shared = records.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column(1))
            own = sketch(rows)
            for last in walked(rows, trees, shared.value):
                pass
            arrays = [last.node.view(np.int64), b.column(0).to_numpy()[last.at], last.used.view(np.int64), last.parent, last.past, *(s[last.at] for s in own)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["node", "id", "used", "parent", "past", *SKETCH])

    return records.select("id", "signature").mapInArrow(run, BRANCHED)


def parts_of(size: np.ndarray) -> np.ndarray:
    """Blocks of nodes that stopped shrinking."""
    return -(-size // (BLOCK * SMALL // 2))


def comparable(records: DataFrame, held: list[Large], trees: range, part: int = 0, parts: int = 1) -> DataFrame:
    """(node, id, sketch) of the records in all small nodes of all levels, and of those in nodes that stopped shrinking once for each pair of blocks that they are in; of one part of the nodes."""
    shared = records.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids = matrix(b.column(1)), b.column(0).to_numpy()
            own = sketch(rows)
            for depth, (node, at, _, _, _, size, stuck) in enumerate(walked(rows, trees, shared.value)):
                if depth == len(shared.value):
                    break  # the level below the last one that has large nodes is empty
                small = size == 0
                groups, places = [node[small]], [at[small]]
                if stuck.any():
                    number = parts_of(size[stuck])
                    place, block = at[stuck], mix(ids[at[stuck]].view(np.uint64)) % number.astype(np.uint64)
                    other = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
                    low, high = (f(np.repeat(block, number), other.astype(np.uint64)) for f in (np.minimum, np.maximum))
                    with np.errstate(over="ignore"):
                        groups.append(mix(np.repeat(node[stuck], number) ^ mix(low * STEP + high + U(1))))
                    places.append(np.repeat(place, number))
                node, at = np.concatenate(groups), np.concatenate(places)
                if parts > 1:
                    now = (node >> U(20)) % U(parts) == U(part)
                    node, at = node[now], at[now]
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node.view(np.int64), ids[at], *(s[at] for s in own))], names=["node", "id", *SKETCH])

    return records.select("id", "signature").mapInArrow(run, "node bigint, id bigint, " + ", ".join(f"{s} bigint" for s in SKETCH))


def comparable_rows(held: list[Large], first: int) -> int:
    """Rows of comparable(); first: those of the first level."""
    total, rows = 0, first
    for _, sizes, stuck in held:
        total += rows - int(sizes.sum()) + int((sizes[stuck] * parts_of(sizes[stuck])).sum())
        rows = BRANCHES * int(sizes[~stuck].sum())
    return total


def depths(records: DataFrame, held: list[Large], trees: range) -> DataFrame:
    """(id, depth) of the records in nodes that went on, with the depth of the deepest."""
    shared = records.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deepest = np.zeros(b.num_rows, np.int32)
            for depth, x in enumerate(walked(matrix(b.column(1)), trees, shared.value)):
                deepest[x.at[(x.size > 0) & ~x.stuck]] = depth + 1
            on = np.flatnonzero(deepest)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on)), pa.array(deepest[on])], names=["id", "depth"])

    return records.select("id", "signature").mapInArrow(run, "id bigint, depth int")


def grown(frontier: DataFrame, records: DataFrame, depth: int) -> DataFrame:
    """The next level below the nodes of the frontier (node, id, used, n, parent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column(5))
            nodes, used = children(b.column(0).to_numpy().view(np.uint64), rows, depth, b.column(2).to_numpy().view(np.uint64))
            ids, *others = [np.repeat(x, BRANCHES) for x in (b.column(1).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(), *sketch(rows))]
            arrays = [nodes.view(np.int64), ids, used.view(np.int64), *others]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["node", "id", "used", "parent", "past", *SKETCH])

    return frontier.join(records, "id").select("node", "id", "used", "n", "parent", "signature").mapInArrow(run, BRANCHED)


def blocks(alike: DataFrame) -> DataFrame:
    """Records of nodes that stopped shrinking, once for each pair of blocks that they are in; blocks are bounded."""
    number = F.ceil(F.col("n") / (BLOCK * SMALL // 2)).cast("int")
    own = F.pmod(F.xxhash64("id"), number)
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return alike.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), number - 1))).select(pair.alias("node"), "id", *SKETCH)


def matching(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Equal nibbles of two sketches."""
    total = np.full(len(a[0]), SKETCHED, dtype=np.int64)
    for p, q in zip(a, b):
        x = (p ^ q).view(np.uint64)
        x = x | (x >> U(1))
        total -= np.bitwise_count((x | (x >> U(2))) & U(0x1111111111111111))  # one bit for each nibble that differs
    return total


def compared(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of small nodes whose sketches agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * (2 + len(SKETCH))

        def pairs(node, ids, *own) -> pa.RecordBatch:
            left, right = [], []
            at = np.arange(len(node))
            d = 1
            while len(at := at[(at + d < len(node))]) and len(at := at[node[at] == node[at + d]]):
                ok = at[(matching([s[at] for s in own], [s[at + d] for s in own]) >= SKETCH_MATCHES) & (ids[at] != ids[at + d])]
                left.append(np.minimum(ids[ok], ids[ok + d]))
                right.append(np.maximum(ids[ok], ids[ok + d]))
                d += 1
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1) if left else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            columns = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            node = columns[0]
            if not len(node):
                continue
            keep = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            yield pairs(*(c[:keep] for c in columns))
            rest = [c[keep:] for c in columns]
        yield pairs(*rest)

    return rows.repartition("node").sortWithinPartitions("node").select("node", "id", *SKETCH).mapInArrow(run, "a bigint, b bigint")


def once(df: DataFrame, name: str) -> DataFrame:
    """df stored; what was shuffled for it leaves the disk at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def passes(rows: int, records: int) -> int:
    """Passes in which so many rows are compared."""
    return max(1, -(-rows // max(LEAST_ROWS, PASS_ROWS * records)))


def candidates(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs of ids, stored, that share a small node of some tree and agree in their sketches. Records in deep nodes go through more trees, as many as their depth needs."""
    depth, total = 0, records.count()
    while trees_needed(depth + 1, RECALL, threshold) <= TREES:
        depth += 1
    out, reached = grove(records, range(TREES), total)
    done = TREES
    while not (deep := united(reached).where(F.col("depth") >= depth)).isEmpty():
        depth += 1
        if (need := trees_needed(depth, RECALL, threshold)) > done:
            some = once(records.join(deep, "id", "left_semi"), "deep")
            more, further = grove(some, range(done, need), total)
            release(some)
            out, done, reached = out + more, need, reached + further
    pairs = once(united(out).distinct(), "pairs")
    release(*out, *reached)
    return pairs


def united(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, with the columns of the first."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more.select(out.columns))
    return out


def grove(records: DataFrame, trees: range, total: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of pairs, tables with id and depth of the nodes that records went on from) of some trees; total: the records of the whole join.

    Levels are counted one after the other; as long as their large nodes are few enough
    for every task, passes over the records then bring all that is to be compared.
    """
    held: list[Large] = []
    while True:
        depth = len(held) + 1
        large = once(large_nodes(node_counts(records, held, trees), depth), f"large{depth}")
        number = large.count()
        if number > HELD_NODES:
            break
        found = large.toArrow().sort_by("node")
        release(large)
        held.append((found["node"].to_numpy(), found["n"].to_numpy(), found["stuck"].to_numpy(zero_copy_only=False)))
        if not number or held[-1][2].all():
            break
    parts = passes(comparable_rows(held, BRANCHES * len(trees) * records.count()), total)
    out = [once(compared(comparable(records, held, trees, p, parts)), "found") for p in range(parts if held else 0)]
    reached = [once(depths(records, held, trees), "depths")]
    if number <= HELD_NODES:
        return out, reached
    more, further = joined_levels(records, trees, held, total)
    return out + more, reached + further


def large_nodes(counts: DataFrame, depth: int) -> DataFrame:
    """(node, n, stuck) of the nodes that are too large to be compared."""
    stuck = (F.col("n") > SHRINK * F.col("past")) & (F.col("past") > 0) if depth < MAX_DEPTH else F.lit(True)
    return counts.where(F.col("n") > SMALL).select("node", "n", stuck.alias("stuck"))


def joined_levels(records: DataFrame, trees: range, held: list[Large], total: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of pairs, tables with id and depth of the nodes that records went on from) of the levels below those held, by joins."""
    out, reached, depth = [], [], len(held)
    rows = level(records, held, trees)
    number = BRANCHES * (int(held[-1][1][~held[-1][2]].sum()) if held else len(trees) * records.count())
    while True:
        depth += 1
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("past").alias("past"))
        large = once(large_nodes(counts, depth), f"large{depth}")
        block = F.col("n") * F.ceil(F.col("n") / (BLOCK * SMALL // 2))
        kinds = {r.stuck: r for r in large.groupBy("stuck").agg(F.sum("n").alias("n"), F.sum(block).alias("rows")).collect()}
        parts = passes(number, total)
        for p in range(parts):
            some = rows.where(F.pmod(F.shiftright("node", 20), F.lit(parts)) == p)
            out.append(once(compared(some.join(large.select("node"), "node", "left_anti").select("node", "id", *SKETCH)), "found"))
        if True in kinds:
            alike, parts = blocks(rows.join(large.where("stuck"), "node")), passes(kinds[True].rows, total)
            out += [once(compared(alike.where(F.pmod(F.shiftright("node", 20), F.lit(parts)) == p)), "found") for p in range(parts)]
        if False not in kinds:
            release(large)
            return out, reached
        number = BRANCHES * kinds[False].n
        frontier = once(rows.select("node", "id", "used", "parent").join(large.where("not stuck"), "node").select("node", "id", "used", "n", "parent", F.lit(depth).alias("depth")), f"frontier{depth}")
        reached.append(frontier)
        release(large)
        rows = grown(frontier, records, depth)


def packed(hashes: np.ndarray) -> bytes:
    """The highest HASH_BYTES bytes of sorted hashes. Two sets of 1,000 runs share a hash by chance once in a million pairs."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def sets(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(key, set): sorted distinct hashes of the runs of each text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                out.append(packed(np.unique(shingles(*words([t or ""]), width)[0])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def exact(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of pairs (a, b, set_a, set_b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                both = np.concatenate([unpacked(x), unpacked(y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                value[i] = shared / max(1, len(both) - shared)
            ok = np.flatnonzero(value >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(value[ok])], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def joined(df: DataFrame, text: str = "page_content", key: str = "chunk_id", width: int = WIDTH, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(classes, links): key, id, copy and representative of each text that takes part; a, b and similarity of each pair of classes.

    A class holds the texts of the same words in the same order; its id stands for
    it in the links, which reach the threshold exactly. Null and short texts, and
    rows without a key, take no part. Rows that occur twice are one text. Other columns of df are ignored.
    """
    texts = once(signed(df, text, key, width, min_words), "texts")  # the one pass over all texts
    members = once(texts.groupBy(key, "id").agg(F.min("copy").alias("copy")), "members")
    firsts = members.groupBy("id").agg(F.min(F.struct(key, "copy")).alias("f")).select("id", F.col(f"f.{key}").alias("representative"), "f.copy")
    classes = firsts.select("id", "representative")
    records = once(texts.groupBy("id").agg(F.first("signature").alias("signature")), "records")
    release(texts)
    pairs, most = candidates(records, threshold), max(LEAST_PAIRS, int(PASS_PAIRS * records.count()))
    release(records)
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    chosen = once(firsts.join(wanted, "id", "left_semi"), "chosen")
    # The sets of the few texts that are in a pair: their keys go to the texts, not the texts to the keys, while they are few.
    few = chosen.count() <= BROADCAST_ROWS
    rows = df.select(F.col(key).alias("representative"), F.col(text).alias("text"), F.xxhash64(text).alias("copy")).join(F.broadcast(chosen) if few else chosen, ["representative", "copy"])
    held = once(sets(rows, "text", "id", width).dropDuplicates(["id"]), "sets")
    # Pairs move with one set only: they meet the first text's set by its id, then go with it to the second's.
    first, second = (held.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    parts = max(1, -(-pairs.count() // most))
    links = united([once(exact(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == p).join(first, "a").join(second, "b"), threshold), "links") for p in range(parts)])
    release(pairs, chosen, held)
    return members.join(classes, "id"), links


def expanded(classes: DataFrame, links: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Pairs of keys, the smaller first: those of which at least one stands for all exact copies of its text.

    Of a text's exact copies the smallest key stands for all; it is paired with each
    of them. Of two texts that differ and are linked, or hold the same words, each
    copy of one is paired with the representative of the other. So every link
    between different texts is there for every copy, in pairs that grow with the
    copies and not with their square; pairs of two others follow from them.
    """
    texts = classes.groupBy("id", "copy").agg(F.min(key).alias("r"))
    ends = [texts.select(F.col("id").alias(e), F.col("copy").alias(f"copy_{e}"), F.col("r").alias(f"r_{e}")) for e in "ab"]
    mixed = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    between = links.select("a", "b").unionByName(mixed).join(ends[0], "a").join(ends[1], "b").where("a <> b or copy_a < copy_b")
    rows = classes.select("id", "copy", F.col(key).alias("x"))
    copies = rows.join(texts, ["id", "copy"]).where("x <> r").select("id", "copy", "x", "r")  # those that don't stand for their text
    direct = between.select(F.col("r_a").alias("x"), F.col("r_b").alias("y"))
    left = copies.select(F.col("id").alias("a"), F.col("copy").alias("copy_a"), "x").join(between, ["a", "copy_a"]).select("x", F.col("r_b").alias("y"))
    right = copies.select(F.col("id").alias("b"), F.col("copy").alias("copy_b"), "x").join(between, ["b", "copy_b"]).select("x", F.col("r_a").alias("y"))
    pairs = direct.unionByName(left).unionByName(right).unionByName(copies.select("x", F.col("r").alias("y")))
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component of edges (a, b). Alternating large and small stars."""
    current = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("p"), "m").where("p != m").select(F.col("m").alias("a"), F.col("p").alias("b"))
        new = checkpointed(small.unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct())
        if new.count() == current.count() and new.exceptAll(current).isEmpty():
            break
        current = new
    return current.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionByName(current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))


def groups(classes: DataFrame, links: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, class id (its representative), group id (smallest representative linked to it) and the class's number of links."""
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    names = classes.select("id", "representative").distinct()
    found = components(links.select("a", "b")).join(names, "id")
    group = found.groupBy("component").agg(F.min("representative").alias("group_id"))
    by_id = found.join(group, "component").select("id", "group_id")
    return classes.join(by_id, "id", "left").join(degree, "id", "left").select(
        key, F.col("representative").alias("class_id"), F.coalesce("group_id", "representative").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )


__all__ = ["components", "expanded", "groups", "joined"]
