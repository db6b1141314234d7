"""Filling containers of fixed capacity with documents (problem 7).

Documents are dealt to partitions of bounded size and packed best-fit decreasing.
Dual-feasible functions give a lower bound on the containers that a partition
needs; one that meets its bound is certified and stays. The others give up their
loosest containers, exchange the documents in them, and pack again, until nothing
is gained. Only documents above the capacity are split: into full containers and
a rest that is packed like any other document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.runtime import stored

#: Documents of a partition on average, and containers that a partition gives up in a round of exchange.
PARTITION, LOOSEST = 20_000, 24
#: Sizes of phi functions that are evaluated at once.
BAND = 64
ASSIGNED = "container_id int, bin bigint, doc_id bigint, piece_no int, pieces int, tokens int, token_from int, capacity int, part int, gap int, fill double"


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Containers that sizes (each so many times) need at least: the best of several dual-feasible functions, over all their parameters."""
    if times is None:
        if not len(sizes):
            return 0
        sizes, times = np.unique(sizes.astype(np.int64), return_counts=True)
    size, times = sizes[sizes > 0], times[sizes > 0]
    if not len(size):
        return 1 if len(sizes) else 0
    best = -(-int((size * times).sum()) // capacity)
    for k in range(1, 21):  # u(k): x if (k+1)x is whole, else floor((k+1)x)/k; in units of 1/(k * capacity)
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((value * times).sum()) // (k * capacity)))
    small = np.unique(np.r_[size[size * 2 <= capacity], 1])
    for first in range(0, len(small), BAND):  # U(e): 1 above 1 - e, 0 below e, else x
        e = small[first : first + BAND, None]
        value = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
        best = max(best, -(-int((value * times).sum(axis=1).max()) // capacity))
    small = small[small * 2 < capacity]
    for first in range(0, len(small), BAND):  # phi(e), by multiples of e
        e = small[first : first + BAND, None]
        whole = capacity // e
        value = np.where(size * 2 > capacity, 2 * (whole - (capacity - size) // e), np.where(size * 2 == capacity, whole, 2 * (size // e)))
        best = max(best, int((-(-(value * times).sum(axis=1) // (2 * whole[:, 0]))).max()))
    return int(best)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size, packed in the order of decreasing size into the fullest one with room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins = 0, 0  # bit r of free: some container has room for exactly r
    for i in order.tolist():
        s = int(sizes[i])
        above = free >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                free ^= 1 << r
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        with_room[r - s].append(b)
        free |= 1 << (r - s)
    return out


def packer(turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True]).reset_index(drop=True)
        capacity, part = int(group["capacity"][0]), int(group["part"][0])
        sizes = group["tokens"].to_numpy()
        at = best_fit(sizes, capacity)
        used = int(at.max()) + 1
        fill = np.bincount(at, weights=sizes, minlength=used) / capacity
        group["bin"] = (np.int64(turn) << 56) + (np.int64(part) << 28) + at
        group["gap"] = used - lower_bound(sizes, capacity)
        group["fill"] = fill[at]
        return group

    return run


def pieces(documents: DataFrame, specs: DataFrame, size: str, key: str) -> DataFrame:
    """Every document for every kind of container; those above its capacity in pieces."""
    kinds = {r.container_id: max(1, r.capacity_tokens or 1) for r in specs.where("container_id is not null").select(F.col("container_id").cast("int"), F.col("capacity_tokens").cast("int")).orderBy(F.desc("capacity_tokens")).collect()}
    each = F.array(*(F.struct(F.lit(i).alias("container_id"), F.lit(c).alias("capacity")) for i, c in sorted(kinds.items())))
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / F.col("capacity")).cast("int"), F.lit(1))
    none = F.array().cast("array<struct<container_id:int,capacity:int>>")
    rows = rows.select("doc_id", "n", F.inline(each if kinds else none)).withColumn("pieces", pieces).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    start = F.col("piece_no") * F.col("capacity")
    return rows.select("container_id", "capacity", "doc_id", "piece_no", "pieces", start.alias("token_from"), F.least(F.col("n") - start, "capacity").alias("tokens"))


def packed(documents: DataFrame, specs: DataFrame, size: str = "n_tokens", key: str = "doc_id") -> DataFrame:
    """container_id, bin, doc_id, piece_no, pieces, tokens, token_from of every document (piece) for every kind of container.

    specs is fixed and small. Null and negative sizes count as 0; such documents are
    assigned like others. A capacity below 1 counts as 1; kinds given twice count
    once. Documents of the same key in several rows are all packed. No documents or
    no kinds give no rows. Other columns are ignored, whatever their names.
    """
    dealt = pieces(documents, specs, size, key)
    number = documents.count()
    parts = max(1, -(-number // PARTITION))
    blank = dealt.select("container_id", F.lit(0).cast("bigint").alias("bin"), "doc_id", "piece_no", "pieces", "tokens", "token_from", "capacity", F.lit(0).alias("part"), F.lit(0).alias("gap"), F.lit(0.0).alias("fill"))
    full = blank.where(F.col("tokens") == F.col("capacity")).withColumn("bin", (F.lit(1).cast("bigint") * -1) - F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(1 << 62))).withColumn("fill", F.lit(1.0))
    # Groups are split by hash: however skewed the sizes, no group exceeds a partition by much.
    rest = blank.where(F.col("tokens") < F.col("capacity")).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    done = stored(full.unionByName(rest.groupBy("container_id", "part").applyInPandas(packer(0), ASSIGNED)), "packed0")
    turn = 0
    while True:  # each round saves a container at least, or is the last
        turn += 1
        open_bins = done.where("gap > 0 and fill < 1").select("container_id", "part", "gap", "bin", "fill").distinct()
        loose = open_bins.groupBy("container_id", "part", "gap").agg(F.slice(F.array_sort(F.collect_list(F.struct("fill", "bin"))), 1, LOOSEST).alias("b"))
        loose = stored(loose.select("container_id", F.explode("b.bin").alias("bin")), f"loose{turn}")
        groups = done.where("gap > 0").agg(F.count_distinct("container_id", "part")).first()[0]
        if groups < 2 or loose.isEmpty():
            break
        given = done.join(loose, ["container_id", "bin"], "left_semi")
        share = max(1, -(-given.count() // PARTITION))
        given = given.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(turn)), F.lit(share)).cast("int"))
        again = stored(given.groupBy("container_id", "part").applyInPandas(packer(turn), ASSIGNED), f"again{turn}")
        before, after = loose.groupBy("container_id").agg(F.count_distinct("bin").alias("before")), again.groupBy("container_id").agg(F.count_distinct("bin").alias("after"))
        gained = [r.container_id for r in before.join(after, "container_id").where("after < before").collect()]  # a few kinds
        if not gained:
            break
        kept = done.join(loose.where(F.col("container_id").isin(gained)), ["container_id", "bin"], "left_anti")
        done = stored(kept.unionByName(again.where(F.col("container_id").isin(gained))), f"packed{turn}")
    return done.select("container_id", "bin", "doc_id", "piece_no", "pieces", "tokens", "token_from", "capacity")


def divided(assigned: DataFrame) -> DataFrame:
    """(container_id, doc_id) of the documents whose pieces lie in several containers. Only pieces are counted, and summed before the shuffle."""
    return assigned.where("pieces > 1").groupBy("container_id", "doc_id").agg(F.min("bin").alias("least"), F.max("bin").alias("most")).where("least < most").select("container_id", "doc_id")


def certificate(assigned: DataFrame) -> DataFrame:
    """container_id, bins, the bound that no packing beats, and the unused share of the capacity. Sizes come as a histogram bounded by the capacity."""
    used = assigned.groupBy("container_id", "capacity").agg(F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    sizes = assigned.groupBy("container_id", "capacity", "tokens").agg(F.count(F.lit(1)).alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(group["tokens"], group["n"]))
        capacity = int(group["capacity"].iloc[0])
        whole = int(counts.pop(capacity, 0))
        sizes, times = (np.fromiter(x, np.int64, len(counts)) for x in (counts.keys(), counts.values()))
        order = np.argsort(sizes)
        return pd.DataFrame({"container_id": [group["container_id"].iloc[0]], "bound": [whole + lower_bound(sizes[order], capacity, times[order])]})

    bounds = sizes.groupBy("container_id").applyInPandas(run, "container_id int, bound bigint")
    return used.join(bounds, "container_id").select("container_id", "bins", "bound", (1 - F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("unused_share"))
