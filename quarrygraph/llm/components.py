"""Connected components of an edge table: spanning forests task by task, alternating large-star and small-star steps where those don't suffice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import durable, tidy

#: Edges that a task holds at once; as many or fewer are settled by one task, without a round over all of them.
HELD = 100_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _forest(held: int | None, names: list[str]):
    """(node, least node of its component) by the edges that a task holds; without a limit for the roots as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, size, kind = {}, 0, None

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def trees() -> Iterator[pa.RecordBatch]:
            nodes = [x for x in parent if held is None or parent[x] != x]
            for k in range(0, len(nodes), 10_000):
                part = nodes[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
            size += len(batch)
            if held is not None and size >= held:
                yield from trees()
                parent.clear()
                size = 0
        yield from trees()

    return run


def _forests(edges: DataFrame, held: int | None, names: list[str]) -> DataFrame:
    kind = edges.schema["u"].dataType
    return edges.select("u", "v").mapInArrow(tidy(_forest(held, names)), StructType([StructField(n, kind) for n in names]))


def connected_components(edges: DataFrame, max_rounds: int = 60, held: int = HELD) -> DataFrame:
    """edges(u, v) of integers, strings or binaries -> (node, root) for every node that has an edge; root is the least node.

    Every task replaces the edges it holds by a spanning forest, which loses no connection; edges are dealt by node and replaced again
    while that halves them. At most `held` edges are settled by one task; more of them by star rounds, until they are that few or a round
    changes nothing. Each step writes a table, so lineage stays short. Self loops and null ends are ignored; an empty edge table gives an
    empty result.
    """
    one = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    current = durable(_forests(one, held, ["u", "v"]))
    n, before = current.count(), None
    while n > held and (before is None or 2 * n <= before):
        current = durable(_forests(current.repartition(-(-n // held), "u"), held, ["u", "v"]))
        before, n = n, current.count()
    mark = (n, None)
    for _ in range(max_rounds):
        if mark[0] <= held:
            return durable(_forests(current.coalesce(1), None, ["node", "root"]))
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(least.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        before, mark = mark, _mark(after)
        current = after
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return durable(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct())
