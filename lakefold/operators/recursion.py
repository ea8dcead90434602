"""Recursive queries that remove duplicates, and closures of graphs.

Each round is written once to the folder that all executors share, so plans stay small and a lost
executor costs one round; the result is the union of the rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakefold.session import checkpoint


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows of seed and of step over new rows, each once, until none is new. Ends on cycles; fails after `most` rounds."""
    rounds = [checkpoint(seed.distinct())]
    for _ in range(most):
        new = checkpoint(step(rounds[-1]).toDF(*seed.columns).subtract(_all(rounds)))
        if new.isEmpty():
            return _all(rounds)
        rounds.append(new)
    raise RuntimeError(f"no end after {most} rounds")


def _all(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, rounds)


def recursive_queue(seed: DataFrame, step: Callable[[DataFrame], DataFrame], order: list[Column], limit: int, offset: int = 0, distinct: bool = False) -> DataFrame:
    """WITH RECURSIVE ... ORDER BY ... LIMIT: the first rows that leave the queue, with column _at telling when (0 first).

    In each round the least row by `order` leaves; step sees that row alone. Ties leave in the order of
    all columns. As each row depends on the one before, there are offset + limit rounds; the queue
    itself stays distributed. With `distinct` (UNION) a row enters the queue once.
    """
    key = [*order, *[F.col(c) for c in seed.columns]]
    queue = checkpoint(seed.distinct() if distinct else seed)
    seen, out = queue, []
    for at in range(offset + limit):
        head = queue.orderBy(*key).limit(1)
        rows = head.collect()
        if not rows:
            break
        one = seed.sparkSession.createDataFrame(rows, seed.schema)
        if at >= offset:
            out.append(one.withColumn("_at", F.lit(at - offset)))
        fresh = step(one).toDF(*seed.columns)
        if distinct:
            fresh = checkpoint(fresh.subtract(seen))
            seen = checkpoint(seen.unionByName(fresh))
        queue = checkpoint(queue.exceptAll(one).unionByName(fresh))
    return _all(out) if out else seed.limit(0).withColumn("_at", F.lit(0))


def closure(edges: DataFrame, roots: DataFrame, source: str, target: str, most_depth: int = 1000) -> DataFrame:
    """Rows (root, id, depth): what is reached from each root, with the least number of edges; roots at depth 0. Fails if there is more beyond most_depth. Null ends lead nowhere."""
    links = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_s is not null and _t is not null").distinct()
    start = roots.toDF("root")
    rounds = [checkpoint(start.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct())]
    for depth in range(1, most_depth + 2):
        new = rounds[-1]
        step = new.join(links, new["id"] == links["_s"]).select("root", F.col("_t").alias("id")).distinct()
        found = checkpoint(step.join(_all(rounds).select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if found.isEmpty():
            return _all(rounds)
        rounds.append(found)
    raise RuntimeError(f"no end after {most_depth} edges")
