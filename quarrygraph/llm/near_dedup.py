"""Near-duplicate detection: MinHash signatures in an LSH forest of sorted orders.

Every text becomes the set of its distinct word shingles; equal sets form one class, named by a 128-bit
digest of the sorted set. A class has a signature of one-byte MinHash labels. The forest keeps several
orders (trees); a tree sorts the permuted signatures, and classes that share a longest common prefix of a depth or more
are a region of it. The depth adapts to the region: it starts at five labels and grows while more than REGION
classes share the prefix. In a region of the first depth every two members are candidates; in one that had
to go deeper, the neighbours in the sorted order are. Candidate links are confirmed on the full shingle sets.

Regions that are crowded at the first depth come together as zones, and there an exact way finishes the work: in
blocks of bounded size, stated query sets (some hubs of each zone, then all classes that are not yet with their zone's
largest component) are held against every member of the zone by counting common shingles in an inverted
index. So no cap on neighbours or candidates decides, results don't depend on partitions or batch sizes, and
only a pair that shares no first-depth prefix in any tree is missed: with 16 trees one in 10,000 at a similarity of
0.85 and one in 500 at 0.8, where nothing else joins the two.

Links within a zone are counted for queries times members in blocks over all tasks; copies of one text that are
alike enough join by the hubs, so few queries are left.

Defined cases: null or word-less text has no shingles and is linked with nothing; fewer words than a
shingle make one shingle of the whole sequence; repeated rows share a component; rows whose doc_id is null link texts as
others do, get the component of a linked row with an id, or a null one, and are never `kept`; an empty table gives an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, partitions, read, tidy
from .components import connected_components

LABELS = 128
TREES = 16
#: Labels of the common prefix that makes a region, from level to level, and the classes that a region may have before it goes deeper.
DEPTHS = (5, 10, 20, 40, 80)
REGION = 32
#: About so many hubs of each zone are held against all of it; a block has so many shingles of members and so many queries.
HUBS = 12
BLOCK_SHINGLES = 1 << 17
BLOCK_QUERIES = 2000
#: Candidates whose signatures agree on less than the threshold minus this are not confirmed: four standard errors.
SLACK = 0.125
_RNG = np.random.default_rng(20240229)
_MULT = _RNG.integers(1, 2**32, LABELS, dtype=np.uint32) | np.uint32(1)
_ORDERS = [_RNG.permutation(LABELS) for _ in range(TREES)]
_P, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    """64-bit hashes of words, kept while they are few; a task that ends forgets them, so that later stages have the memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text; bytes.lower and bytes.split know ASCII only."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(k, len(h))
    last = len(h) - width + 1
    g = h[:last].copy()
    for j in range(1, width):
        g = g * _P + h[j : j + last]
    if width < k:
        g += np.full(1, width, np.uint64) * _C
    g ^= g >> np.uint64(32)
    g *= _C
    g ^= g >> np.uint64(29)
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g


def signature(shingles: np.ndarray) -> bytes:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(LABELS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (low[i : i + 2048, None] * _MULT[None, :]).min(0), out=least)
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(24)).astype(np.uint8).tobytes()


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, marks = [], [], []
            for text in batch.column(0).cast(pa.binary()):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                nodes.append(_digest(s) if len(s) else None)
                marks.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(marks, pa.binary())], names=[*batch.schema.names[1:], "n", "node", "mark"])
        _HASHES.clear()

    return run


def sketches(docs: DataFrame, k: int, digests: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the row digests named, n, node, mark): shingle count, class digest and signature of every row."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *digests)
    return rows.mapInArrow(tidy(_sketcher(k)), ", ".join(["doc_id long", *[f"{c} long" for c in digests], "n long, node binary, mark binary"]))


def _prefixes(marks: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit hash of the tree and the first labels in its order, for each row."""
    h = (tree.astype(np.uint64) + np.uint64(1)) * _P
    for place in range(depth):
        at = np.array([order[place] for order in _ORDERS])[tree]
        h = (h ^ marks[np.arange(len(marks)), at]) * _C
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), LABELS)


def _planter(depth: int):
    """Input (node, mark): a row for each tree. Input (node, mark, tree): the row of that tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            marks, given = _marks(batch.column(1)), batch.num_columns > 2
            for tree in [np.asarray(batch.column(2))] if given else (np.full(len(batch), t, np.int32) for t in range(TREES)):
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(_prefixes(marks, tree, depth)), batch.column(0)], names=["tree", "region", "node"])

    return run


_PLANTED = "tree int, region long, node binary"


def regions(classes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Regions of two classes or more: for each level its settled ones (tree, region, node), and the crowded ones of the first depth (region, node)."""
    leaves, crowded = [], None
    rows = durable(classes.select("node", "mark").mapInArrow(tidy(_planter(DEPTHS[0])), _PLANTED))
    for level, depth in enumerate(DEPTHS):
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = durable(rows.join(sizes, "region"))
        leaves.append(sized.where(F.col("size") <= REGION).select("tree", "region", "node"))
        many = sized.where(F.col("size") > REGION)
        if many.isEmpty():
            break
        if level == 0:
            crowded = many.select("region", "node")
        if level + 1 < len(DEPTHS):
            deeper = many.select("node", "tree").join(classes.select("node", "mark"), "node").select("node", "mark", "tree")
            rows = durable(deeper.mapInArrow(tidy(_planter(DEPTHS[level + 1])), _PLANTED))
    return leaves, crowded


def _orderer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's signature in the order of its tree."""
    orders = np.array(_ORDERS)
    for batch in batches:
        if len(batch):
            key = np.take_along_axis(_marks(batch.column(4)), orders[np.asarray(batch.column(1))], 1)
            keys = pa.Array.from_buffers(pa.binary(LABELS), len(batch), [None, pa.py_buffer(np.ascontiguousarray(key).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), keys, batch.column(3), batch.column(5)], names=["region", "deep", "key", "node", "n"])


def _neighbours(threshold: float):
    """Candidates of whole regions, which arrive sorted by key: every two members, or in deep regions those next to each other."""
    least, ratio = (threshold - SLACK) * LABELS, threshold

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        region, deep = np.asarray(rows.column(0)), np.asarray(rows.column(1))
        keys, nodes, n = _marks(rows.column(2)), rows.column(3), np.asarray(rows.column(4))
        left, right, agreed = [], [], []
        for step in range(1, REGION):
            i = np.flatnonzero((region[:-step] == region[step:]) & ((step == 1) | ~deep[:-step]))
            if not len(i):
                break
            j = i + step
            same = (keys[i] == keys[j]).sum(1)
            good = (same >= least) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]))
            left.append(i[good]), right.append(j[good]), agreed.append(same[good])
        if left:
            pair = nodes.take(pa.array(np.concatenate(left))).to_pylist(), nodes.take(pa.array(np.concatenate(right))).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(map(min, *pair)), pa.binary()), pa.array(list(map(max, *pair)), pa.binary()), pa.array(np.concatenate(agreed), pa.int32())], names=["a", "b", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])]).combine_chunks()
            if len(rows):
                region = np.asarray(rows.column(0))
                cut = int(np.flatnonzero(region != region[-1])[-1]) + 1 if region[0] != region[-1] else 0  # the last region may go on
                if cut:
                    yield from found(rows.slice(0, cut))
                kept = rows.slice(cut)
        if kept is not None and len(kept):
            yield from found(kept)

    return run


def candidates(leaves: list[DataFrame], classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, same): the candidate pairs of settled regions and how many labels agree."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("deep", F.lit(level > 0)) for level, x in enumerate(leaves)])
    marked = rows.join(classes.select("node", "mark", "n"), "node").select("region", "tree", "deep", "node", "mark", "n")
    keyed = marked.mapInArrow(tidy(_orderer), "region long, deep boolean, key binary, node binary, n long")
    ordered = keyed.repartition(partitions(classes.sparkSession), "region").sortWithinPartitions("region", "key", "node")
    return ordered.mapInArrow(tidy(_neighbours(threshold)), "a binary, b binary, same int").groupBy("a", "b").agg(F.max("same").alias("same"))


def zones(crowded: DataFrame) -> DataFrame:
    """(node, zone): classes whose crowded regions hang together. Zones only group work, so 64-bit names do."""
    named = crowded.select("node", F.xxhash64("node").alias("_u"), F.col("region").alias("_v"))
    roots = connected_components(named.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    return named.select(F.col("node").alias("of"), "_u").distinct().join(roots, F.col("_u") == F.col("node")).select(F.col("of").alias("node"), F.col("root").alias("zone"))


def _overlaps(percent: int):
    """Links of queries to members of their block that are in another component, at most one for each two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, index, parent = None, [], None, {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            u, v = [], []
            zone, chunk, part, role = (batch.column(k).to_pylist() for k in range(4))
            for k in range(len(batch)):
                here = zone[k], chunk[k], part[k]
                if here != block:
                    block, members, index, parent = here, [], None, {}
                node, top, bits = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                own = np.frombuffer(bits, np.uint64)
                if not role[k]:
                    members.append((node, top, own))
                    continue
                if index is None:
                    if not members:
                        continue
                    sizes = np.array([len(m[2]) for m in members])
                    every = np.concatenate([m[2] for m in members])
                    order = np.argsort(every, kind="stable")
                    keys, starts, counts = np.unique(every[order], return_index=True, return_counts=True)
                    index = sizes, np.repeat(np.arange(len(members)), sizes)[order], keys, starts, counts
                sizes, owner, keys, starts, counts = index
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                at = at[keys[at] == own]
                if not len(at):
                    continue
                ends = np.cumsum(counts[at])
                places = np.arange(ends[-1]) + np.repeat(starts[at] - ends + counts[at], counts[at])
                both = np.bincount(owner[places], minlength=len(members))
                for m in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
                    if (p := root(top)) != (q := root(members[m][1])):
                        parent[p] = q
                        u.append(node), v.append(members[m][0])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def zone_links(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between queries and members (node, zone, top, n) of their zone that join different components, by exact counts.

    A zone may be large, so its rows meet the zone's shape while they are narrow, and their sets by node.
    """
    stats = members.groupBy("zone").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("chunks"))
    asked = queries.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("parts"))
    shape = stats.join(asked, "zone")
    place = lambda salt, many: F.pmod(F.xxhash64("node", F.lit(salt)), many)
    each = lambda many: F.sequence(F.lit(0).cast("long"), many - 1)
    first = members.join(shape, "zone").select("zone", F.array(place(5, F.col("chunks"))).alias("_chunks"), each(F.col("parts")).alias("_parts"), F.lit(0).alias("role"), "node", "top")
    second = queries.join(shape, "zone").select("zone", each(F.col("chunks")).alias("_chunks"), F.array(place(6, F.col("parts"))).alias("_parts"), F.lit(1).alias("role"), "node", "top")
    wide = first.unionByName(second).join(sets, "node").withColumn("chunk", F.explode("_chunks")).withColumn("part", F.explode("_parts"))
    dealt = wide.select("zone", "chunk", "part", "role", "node", "top", "bits").repartition(partitions(members.sparkSession), "zone", "chunk", "part").sortWithinPartitions("zone", "chunk", "part", "role", "node")
    return dealt.mapInArrow(tidy(_overlaps(percent)), "u binary, v binary")


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "bits"])
        _HASHES.clear()

    return run


def _judge(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs (a, b) whose full sets overlap enough."""
    first = sets.select(F.col("node").alias("a"), F.col("bits").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("bits").alias("y"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(tidy(_judge(percent)), "u binary, v binary")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links."""
    chains = roots.where(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v"))
    return connected_components(chains.unionByName(durable(links)))  # links come from Python: no second worker beside it


def _topped(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select("node", F.col("root").alias("_root")), "node", "left").withColumn("top", F.coalesce("_root", "node")).drop("_root")


def components(classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the classes that have a link; classes has node, doc (a row's id), n and mark, texts has doc_id and text."""
    leaves, crowded = regions(classes)
    pairs = durable(candidates(leaves, classes, percent / 100))
    zoned = None if crowded is None else durable(zones(crowded))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = durable((ends if zoned is None else ends.unionByName(zoned.select("node"))).distinct())
    named = classes.select("node", "doc").join(wanted, "node", "left_semi").select(F.col("doc").alias("named")).distinct()
    picked = texts.join(named, texts["doc_id"].eqNullSafe(named["named"]), "left_semi").select("doc_id", "text").mapInArrow(tidy(_setter(k)), "node binary, bits binary")
    sets = durable(picked.dropDuplicates(["node"]).join(wanted, "node", "left_semi"))
    # First each class with its likeliest partner, then what still lies between different components.
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "same"))
    best = sides.groupBy("a").agg(F.max(F.struct("same", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()
    roots = connected_components(durable(confirm(best, sets, percent)))
    at = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    bt = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(at, "a", "left").join(bt, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    further = confirm(apart, sets, percent)
    if zoned is None:
        return _joined(roots, further)
    members = durable(zoned.join(classes.select("node", "n"), "node"))
    sizes = members.groupBy("zone").agg(F.count(F.lit(1)).alias("_rows"))
    now = durable(_topped(members.join(sizes, "zone"), roots))
    hubs = now.where(F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("_rows") / HUBS)) == 0)
    roots = _joined(roots, further.unionByName(zone_links(now, hubs, sets, percent)))
    now = durable(_topped(members, roots))
    largest = now.groupBy("zone", "top").agg(F.count(F.lit(1)).alias("_rows")).groupBy("zone").agg(F.max(F.struct("_rows", "top")).alias("m")).select("zone", F.col("m.top").alias("_main"))
    outside = now.join(largest, "zone").where(F.col("top") != F.col("_main")).select(*now.columns)
    return _joined(roots, zone_links(now, outside, sets, percent))


def _grouped(docs: DataFrame, k: int, percent: int, digests: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (of, root): the component of every class."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = durable(sketches(docs, k, digests))
    classes = durable(marked.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("mark").alias("mark")))
    linked = components(classes, texts, k, percent)
    return marked, classes.select(F.col("node").alias("of"), "doc").join(linked.select(F.col("node").alias("of"), "root"), "of", "left").select("of", "doc", F.coalesce("root", "of").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: links are Jaccard >= percent / 100 of k-word shingle sets."""
    marked, grouped = _grouped(docs, k, percent)
    owners = grouped.groupBy("root").agg(F.min("doc").alias("owner"))
    owner = durable(grouped.join(owners, "root").select("of", "owner"))  # a plain table, so that the join below can split a class with many rows
    joined = marked.select("doc_id", "n", "node").join(owner, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("owner"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def unique(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each group of near-duplicates: the one with the least doc_id (no id last), of several the one with the least row digest.

    Rows are told apart by all of their columns, so different texts under one doc_id, or without one, are judged each on its own; of rows
    that are equal in every column one stays. Rows without shingles are linked with nothing; equal ones count as one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64(F.to_json(row), F.lit(1)).alias("__row_a"), F.xxhash64(F.to_json(row), F.lit(2)).alias("__row_b"))
    marked, grouped = _grouped(keyed.select("row.doc_id", "row.text", "__row_a", "__row_b"), k, percent, ("__row_a", "__row_b"))
    ranked = marked.select("node", F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), "__row_a", "__row_b").alias("m"))
    of_class = durable(ranked.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("m").alias("m")))
    firsts = of_class.join(grouped.select(F.col("of").alias("node"), "root"), "node").groupBy("root").agg(F.min("m").alias("m")).select("m.__row_a", "m.__row_b")
    bare = ranked.where(F.col("node").isNull()).select("m.__row_a", "m.__row_b")
    kept = durable(firsts.unionByName(bare).distinct())
    return keyed.join(kept, ["__row_a", "__row_b"], "left_semi").dropDuplicates(["__row_a", "__row_b"]).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)
