"""Dense groups of near copies around the threshold against every pair."""

import random

import numpy as np
import pytest

from quarrygraph.llm import near_dedup as N


def dense(groups, copies, words=200, seed=3):
    """Texts of each group are copies of one text with edits in runs, so that similarities lie around 0.85."""
    rnd, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randint(3, 7)):
                t[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
            out.append((len(out), " ".join(t)))
    return out


def exact(rows, k, percent, groups):
    """Components by exact counts within each group; texts of different groups have nothing in common."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = len(rows) // groups
    for g in range(groups):
        sets = [N.shingle_set(t.encode(), k) for _, t in rows[g * size : (g + 1) * size]]
        keys = np.unique(np.concatenate(sets))
        wide = np.zeros((size, len(keys)), np.float32)
        for i, s in enumerate(sets):
            wide[i, np.searchsorted(keys, s)] = 1
        both = (wide @ wide.T).round().astype(int)
        n = both.diagonal()
        for i, j in zip(*np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))):
            p, q = find(g * size + int(i)), find(g * size + int(j))
            root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("groups", "copies"), [(6, 400), (1, 1200)])
def test_dense_groups_near_the_threshold(spark, groups, copies):
    rows = dense(groups, copies)
    want = exact(rows, 3, 85, groups)
    assert len(set(want)) > 20 * groups  # many stay alone, by a little
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs.repartition(3), 3, 85).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_same_rows_for_any_partitions_and_batches(spark):
    rows = dense(2, 150, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for parts, batch in (("2", "10000"), ("7", "50")):
        old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        seen.append(sorted(map(tuple, N.near_duplicates(docs.repartition(int(parts)), 3, 85).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old[1])
    assert seen[0] == seen[1]


def test_one_row_of_each_group(spark, awkward, clashing, empty):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (1, "quite another text that shares its id with others here", "b"), (2, text, "c"), (None, text, "d"), (None, "a text of a row without id that is nowhere else", "e"), (1, text, "a"), (3, None, "f"), (3, None, "f"), (4, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.node) for r in N.unique(docs).collect()), key=str)
    assert got == [(1, "a"), (1, "b"), (3, "f"), (4, "g"), (None, "e")]
    assert N.unique(clashing).columns == clashing.columns and N.unique(clashing).count() == N.unique(awkward).count() == 12
    assert N.unique(empty).count() == 0
