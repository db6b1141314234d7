import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import mixing, packing, simjoin

# near duplicates


def corpus(seed=5, groups=25, alone=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(400)]
    notice = "this page is meant for general guidance and nobody accepts liability for losses of any kind"
    texts = []
    for _ in range(alone):
        texts.append(rng.choices(vocabulary, k=rng.randint(40, 120)))
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(60, 140))
        for _ in range(rng.randint(2, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(own)
    return [" ".join(t) + " " + notice for t in texts]


def brute(rows, width=3, least=40, threshold=0.5):
    sets = {}
    for k, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= least:
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {(min(a, b), max(a, b)) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def represented(rows):
    """The pairs of brute() of which one at least stands for all copies of its text."""
    first = {}
    for k, t in sorted(rows):
        first.setdefault(t, k)
    stands = set(first.values())
    return {(a, b) for a, b in brute(rows) if a in stands or b in stands}


@pytest.mark.parametrize("small", [256, 8])
def test_join_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(simjoin, "SMALL", small)  # 8: trees of several levels, and blocks for nodes that don't shrink
    rows = [(f"k{i:03}", t) for i, t in enumerate(corpus())]
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper()), ("none", None), ("empty", ""), ("short", "a few words")]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, *rows[:3], (None, rows[0][1])]], "chunk_id string, page_content string, id string")
    classes, links = simjoin.joined(df)
    found = {tuple(r) for r in simjoin.expanded(classes, links).collect()}
    assert found == represented(rows)
    groups = {r.chunk_id: r for r in simjoin.groups(classes, links).collect()}
    parent = {k: k for k in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {k: root(k) for k in groups} == {k: r.group_id for k, r in groups.items()}


def test_large_nodes_by_joins(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "SMALL", 8)
    for name in ("BROADCAST_ROWS", "HELD_NODES"):
        monkeypatch.setattr(simjoin, name, 0)
    rows = [(f"k{i:03}", t) for i, t in enumerate(corpus(6, 10, 30))]
    assert {tuple(r) for r in simjoin.expanded(*simjoin.joined(spark.createDataFrame(rows, "chunk_id string, page_content string"))).collect()} == represented(rows)


def shuffled(monkeypatch):
    """Rows of each call of compared(), which shuffles them."""
    seen, real = [], simjoin.compared

    def compared(rows):
        seen.append(rows.count())
        return real(rows)

    monkeypatch.setattr(simjoin, "compared", compared)
    return seen


def test_texts_that_share_a_notice_are_not_all_compared(spark, monkeypatch):
    """A notice brings all texts into one node, again on the next level; rows must grow with the texts, not with their square."""
    monkeypatch.setattr(simjoin, "SMALL", 8)
    a_text = {}
    for n in (200, 1600):
        rows = np.random.default_rng(n).integers(0, 1 << 16, (n, simjoin.SIGNATURE), dtype=np.uint16)
        rows[:, ::4] = 7
        seen = shuffled(monkeypatch)
        records = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(rows)], "id bigint, signature binary")
        simjoin.candidates(records).count()
        a_text[n] = sum(seen) / n
    assert a_text[1600] < 3 * a_text[200]


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_passes_are_bounded_and_whole(spark, monkeypatch, held):
    for name, value in (("SMALL", 8), ("BLOCK", 2), ("HELD_NODES", held), ("PASS_ROWS", 4), ("LEAST_ROWS", 1), ("PASS_PAIRS", 0), ("LEAST_PAIRS", 5)):
        monkeypatch.setattr(simjoin, name, value)
    seen = shuffled(monkeypatch)
    rows = [(f"k{i:03}", t) for i, t in enumerate(corpus(8, 12, 40))]
    found = {tuple(r) for r in simjoin.expanded(*simjoin.joined(spark.createDataFrame(rows, "chunk_id string, page_content string"))).collect()}
    assert found == represented(rows)
    assert len(seen) > 3 and max(seen) <= 2 * 4 * len(rows)  # parts of nodes are about equal


def test_no_position_is_used_twice_on_a_path():
    rows = np.random.default_rng(3).integers(0, 1 << 16, (50, simjoin.SIGNATURE), dtype=np.uint16)
    node, at, used = np.arange(50, dtype=np.uint64), np.arange(50), np.zeros(50, np.uint64)
    for depth in range(simjoin.MAX_DEPTH):
        node, used = simjoin.children(node, rows[at], depth, used)
        at = np.repeat(at, simjoin.BRANCHES)
        assert (np.bitwise_count(used) == depth + 1).all()
        pairs = node.reshape(-1, simjoin.BRANCHES)
        assert (pairs[:, 0] != pairs[:, 1]).all()
        node, at, used = node[:200], at[:200], used[:200]


def test_trees_are_added_with_the_depth():
    assert simjoin.met(0) == 1.0 and simjoin.met(1) == 0.75
    for depth in (1, 2, 3, 6, 12):
        n = simjoin.trees_needed(depth)
        assert (1 - simjoin.met(depth)) ** n <= 1 - simjoin.RECALL + 1e-12 < (1 - simjoin.met(depth)) ** (n - 1)


@pytest.mark.parametrize("copies", [2, 6, 60])
def test_copies_are_paired_with_the_one_that_stands_for_them(spark, copies):
    """One form whatever the number of copies: a pair holds at least one representative."""
    text = corpus()[0]
    keys = [f"k{i:02}" for i in range(copies)]
    rows = [(k, text) for k in keys] + [("z1", text + " more"), ("z2", text + " more")]
    found = {tuple(r) for r in simjoin.expanded(*simjoin.joined(spark.createDataFrame(rows, "chunk_id string, page_content string"))).collect()}
    assert found == {("k00", k) for k in keys[1:]} | {("z1", "z2"), ("k00", "z2")} | {(k, "z1") for k in keys}


def test_texts_of_the_same_words_are_no_copies(spark):
    text = corpus()[0]
    rows = [(f"k{i}", text + "." * i) for i in range(5)] + [("l0", text.upper()), ("z1", text + " more"), ("z2", text + " more")]
    found = {tuple(r) for r in simjoin.expanded(*simjoin.joined(spark.createDataFrame(rows, "chunk_id string, page_content string"))).collect()}
    assert found == brute(rows) and len(found) == 28


def test_a_key_of_two_texts(spark):
    texts = corpus(7, 4, 4)
    rows = [("a", texts[0]), ("a", texts[4]), ("b", texts[0] + " more"), ("c", texts[4] + " more")]
    found = {tuple(r) for r in simjoin.expanded(*simjoin.joined(spark.createDataFrame(rows, "chunk_id string, page_content string"))).collect()}
    assert {("a", "b"), ("a", "c")} <= found


def test_join_of_an_empty_table(spark):
    df = spark.createDataFrame([], "chunk_id string, page_content string")
    classes, links = simjoin.joined(df)
    assert simjoin.expanded(classes, links).count() == 0 and simjoin.groups(classes, links).count() == 0


def test_words_are_runs_of_letters_and_digits():
    texts = ["Ab-c 12é3", "", "ab C 12 3\n", "É K"]
    hashed, owner = simjoin.words(texts)
    assert np.bincount(owner, minlength=4).tolist() == [4, 0, 4, 1]
    assert hashed[:4].tolist() == hashed[4:8].tolist()


def test_long_texts(spark):
    text = "one two three four five " * 60_000
    df = spark.createDataFrame([("a", text), ("b", text + "six")], "chunk_id string, page_content string")
    assert {tuple(r) for r in simjoin.expanded(*simjoin.joined(df)).collect()} == {("a", "b")}


# packing


def test_bounds_and_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(60):
        capacity = int(rng.integers(10, 200))
        sizes = rng.integers(1, capacity, int(rng.integers(1, 80)))
        at = packing.best_fit(sizes, capacity)
        fill = np.bincount(at, weights=sizes)
        bound = packing.lower_bound(sizes, capacity)
        assert fill.max() <= capacity and bound <= len(fill) <= 1.25 * bound + 1
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4, 4, 4, 4]), 10) == 2 and packing.lower_bound(np.array([]), 5) == 0


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(3)

    def optimum(sizes, capacity):
        best = len(sizes)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + sizes[i] <= capacity:
                    bins[j] += sizes[i]
                    place(i + 1, bins)
                    bins[j] -= sizes[i]
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best

    for _ in range(80):
        sizes = sorted(rng.integers(1, 20, 7).tolist(), reverse=True)
        assert packing.lower_bound(np.array(sizes), 20) <= optimum(sizes, 20)


def test_bounds_of_a_histogram_are_those_of_the_sizes():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(0, 300, 500)
        size, times = np.unique(sizes, return_counts=True)
        assert packing.lower_bound(sizes, 320) == packing.lower_bound(size, 320, times)


def test_documents_in_several_containers(spark):
    rows = [(1, 7, 0, 2), (1, 8, 0, 3), (1, 7, 1, 2), (1, 9, 1, 3), (2, 5, 0, 1)]
    df = spark.createDataFrame(rows, "container_id int, bin bigint, doc_id bigint, pieces int").withColumn("x", F.lit(1))
    assert [(r.container_id, r.doc_id) for r in packing.divided(df).orderBy("doc_id").collect()] == [(1, 0), (1, 1)]


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION", 60)
    rng = random.Random(8)
    sizes = [rng.randint(1, 90) for _ in range(400)] + [250, 100, 0, 0]
    rows = [(i, s, "x") for i, s in enumerate(sizes)] + [(900, None, "y"), (901, -5, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, bin string")
    specs = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (2, "b", 64), (None, "c", 9)], "container_id int, container_name string, capacity_tokens int")
    out = packing.packed(df, specs).toPandas()
    assert out.groupby(["container_id", "bin"]).agg(t=("tokens", "sum"), c=("capacity", "first")).query("t > c").empty
    for c, capacity in ((1, 100), (2, 64)):
        own = out[out.container_id == c]
        want = {i: max(s or 0, 0) for i, s, _ in rows}
        assert own.groupby("doc_id").tokens.sum().to_dict() == want
        assert set(own[own.pieces > 1].doc_id) == {i for i, s in want.items() if s > capacity}
        assert not own.duplicated(["doc_id", "piece_no"]).any()
    report = packing.certificate(packing.packed(df, specs)).toPandas()
    assert (report.bins >= report.bound).all() and (report.bins <= 1.1 * report.bound + 1).all()
    assert packing.packed(df.limit(0), specs).count() == 0 and packing.packed(df, specs.limit(0)).count() == 0


# mixing


def test_mixed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 64)
    monkeypatch.setattr(mixing, "BUCKET", 100)
    rng = random.Random(9)
    rows = [(i, s, rng.randint(1, 30)) for i, s in enumerate([" Big", "big", "mid ", "SMALL"] * 200 + ["small"] * 5)] + [(2000, None, 5), (2001, "", 5), (2002, "tiny", 9), (2003, "big", None)]
    df = spark.createDataFrame([(i, n, s, 0.5) for i, s, n in rows], "doc_id bigint, n_tokens int, source string, target_share double")
    mixes = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "Mid", 0.3, 3), ("m", "tiny", 0.2, 2), ("m", "none", 0.0, 1), ("e", "none", 0.5, 1), (None, "big", 1.0, 1)], "mix_name string, source_name string, target_share double, max_repeats int")
    chosen, report = mixing.mixed(df, mixes)
    uses = chosen.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n")).toPandas()
    limits = {"big": 1, "mid": 3, "tiny": 2}
    assert all(r.n <= limits[r.source] for r in uses.itertuples())
    rep = {(r.mix_name, r.source_name): r for r in report.collect()}
    assert not rep["m", "tiny"].reachable and rep["m", "tiny"].chosen_tokens == 18 and rep["m", "big"].reachable
    for name in ("big", "Mid"):
        r = rep["m", name]
        assert abs(r.chosen_tokens - r.target_tokens) <= 2 * 64 + 30
    assert rep["m", "none"].chosen_tokens == 0 and rep["m", "none"].reachable and rep["e", "none"].tokens == 0
    chosen, report = mixing.mixed(df.limit(0), mixes)
    assert chosen.count() == 0 and report.count() == 5


def test_every_stretch_of_the_schedule_has_the_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 10)
    monkeypatch.setattr(mixing, "BUCKET", 64)
    df = spark.createDataFrame([("m", "a", 0.7, 1, 7000, 10000), ("m", "b", 0.3, 1, 3000, 10000)], "mix_name string, source string, target_share double, max_repeats int, tokens bigint, mix_tokens bigint")
    rows = mixing.slots(df).orderBy("slot").toPandas()
    assert len(rows) == 1000 and (rows.groupby("source")["rank"].max() + 1 == rows.groupby("source").size()).all()
    share = (rows.source == "a").rolling(50).mean().dropna()
    assert share.min() > 0.62 and share.max() < 0.78
