"""Shared folder, checkpoints and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakefold.session import checkpoint, scratch_folder as new_folder, shared_dir

__all__ = ["checkpoint", "components", "most_frequent", "new_folder", "row_hash", "shared_dir"]


def row_hash(*cols: str) -> Column:
    """With doc_id, tells rows apart that share an id; rows equal in id and text count as one document."""
    return F.xxhash64(*cols)


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of counts with the largest n, at most `most` of them, those of one sixteenth of a power of two together.

    What comes to the driver is a histogram of a thousand rows at most, then no more than `most` rows,
    whatever the number of partitions. counts is read twice.
    """
    step = F.floor(F.log2(n) * 16).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > most:
            break
        least = r["s"]
    return counts.where(F.lit(False) if least is None else step >= least)


#: Edges that a task contracts at once.
BLOCK_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars: each node but the least of its component, with that least node."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for records in batches:
        for a, b in zip(records["a"].to_pylist(), records["b"].to_pylist(), strict=True):
            x, y = root(a) if parent.setdefault(a, a) != a else a, root(b) if parent.setdefault(b, b) != b else b
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if parent[x] != x]
    for k in range(0, len(nodes), 50_000):
        some = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_pydict({"a": some, "b": [root(x) for x in some]})


def components(edges: DataFrame, rounds: int = 60, block: int = BLOCK_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root being the smallest node reachable.

    Blocks of edges are contracted to stars, a task each, which holds `block` edges and no more whatever
    their number. Then large-star and small-star steps alternate until the stars stay the same; a
    single block is one component's stars at once and needs none. Minima are combined before each
    shuffle and hot nodes are joined, not gathered, so no task holds a node's neighbours. Loops and
    repeated edges are allowed, rows with a null end are ignored, and an empty input gives an empty
    result. Nodes without an edge to another node do not appear.
    """
    kind = edges.schema["a"].dataType.simpleString()
    plain = checkpoint(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = plain.count()
    blocks = max(1, math.ceil(n / block))
    # few files and map tasks where there are few edges
    dealt = plain.coalesce(blocks) if plain.rdd.getNumPartitions() > blocks else plain.repartition(blocks)
    now = checkpoint(dealt.mapInArrow(_contract, f"a {kind}, b {kind}"))
    state = _state(now)
    for _ in range(rounds if blocks > 1 else 0):
        if not state[0]:
            break
        tasks = max(1, math.ceil(state[0] / block))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = checkpoint(small.coalesce(tasks))
        state, before = _state(now), state
        if state == before:
            break
    else:
        if blocks > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
