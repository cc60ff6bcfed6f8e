"""Mixing against the contract worked by hand."""

from quarrygraph.llm import mixing as M


def by_hand(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(keys)}
    total, free, target = share * sum(sizes.values()), set(keys), {}
    while free:
        left = total - sum(cap * sizes[s] for s in keys if s not in free)
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        target |= {s: level * w[s] for s in free}
        if not over:
            break
        free -= over
        target |= {s: cap * sizes[s] for s in over}
    return target


def rows(n=600):
    return [(i, "w " * (i * 37 % 23), ["hot", "b", "c", None, "e"][0 if i % 3 else i % 5]) for i in range(n)]


def test_targets_and_takings(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    out = M.mix(docs).collect()
    assert len(out) == 600
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = by_hand(sizes)
    for source, total in sizes.items():
        own = [r for r in out if r.source == source]
        assert {r.source_size for r in own} == {total}
        assert abs(own[0].target - want[source]) < 1e-5
        taken = sum(r.taken for r in own)
        assert taken <= own[0].target + 1e-6 and own[0].target - taken <= 2 * max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    again = M.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_awkward_rows(awkward, clashing, empty):
    out = M.mix(awkward).collect()
    assert len(out) == awkward.count() and all(r.taken <= 2 * r.size for r in out)
    assert len({r.taken for r in out if r.doc_id == 2}) == 1
    assert M.mix(clashing).count() == len(out) and M.mix(empty).count() == 0
    assert M.mixed(clashing).columns == clashing.columns
