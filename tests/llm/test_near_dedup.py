"""Near-duplicates against every pair."""

import random

import numpy as np
import pytest

from quarrygraph.llm import near_dedup as N
from quarrygraph.llm.components import connected_components


def brute(rows, k, percent):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def texts(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(5, 90))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        t = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_same_components_as_all_pairs(spark, k, percent):
    rows = texts(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_awkward_rows(awkward, clashing, empty):
    out = N.near_duplicates(awkward, 3, 85).collect()
    assert len(out) == awkward.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].kept and by[2].component_id == 1 and not by[2].kept
    assert [by[i].n_shingles for i in (3, 4, 5)] == [0, 0, 0] and all(by[i].kept and by[i].component_id == i for i in (3, 4, 5))
    assert by[6].n_shingles == 1 and by[7].n_shingles == 1 and by[9].n_shingles == 10
    assert not any(r.kept for r in out if r.doc_id is None)
    assert sorted(map(tuple, N.near_duplicates(clashing, 3, 85).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert N.near_duplicates(empty).count() == 0


def test_shingles_of_words_between_ascii_white_space_only():
    assert len(N.shingle_set("a\x1cb c d e".encode(), 2)) == 2
    assert (N.shingle_set(b"A b C", 3) == N.shingle_set(b"a B c", 3)).all()
    assert len(N.shingle_set(b"x y", 3)) == 1 and len(N.shingle_set(None, 3)) == 0
    assert (np.diff(N.shingle_set(b"a b a b a b", 2).astype(object)) > 0).all()


def test_long_chains_settle(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


@pytest.mark.parametrize("held", [1, 7, 60, 10_000])
def test_components_with_any_number_of_edges_held(spark, held):
    rnd = random.Random(held)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(None, 3), (3, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b and (p := find(a)) != (q := find(b)):
            root[max(p, q)] = min(p, q)
    want = {x: find(x) for x in list(root)}
    for kind, name in (("long", lambda x: x), ("binary", lambda x: None if x is None else x.to_bytes(2, "big")), ("string", lambda x: None if x is None else f"{x:04}")):
        if kind == "long" or held == 60:
            table = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"u {kind}, v {kind}").repartition(5)
            got = [(r.node, r.root) for r in connected_components(table, held=held).collect()]
            assert len(got) == len(want) and {(bytes(a), bytes(b)) if kind == "binary" else (a, b) for a, b in got} == {(name(a), name(b)) for a, b in want.items()}


def test_components_of_few_edges_take_few_jobs(spark):
    """Every job costs the driver memory; few links need no rounds over all tasks."""
    spark.sparkContext.setJobGroup("components", "")
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert connected_components(edges).count() == 201
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8
