"""Near-duplicate vectors by p-stable hashing and exact cosine checks.

Vectors are divided by their length, where a cosine is a Euclidean distance. A table's key is a row
of Gaussian projections, shifted and quantised in steps of WIDTH; near vectors share it
more often than far ones. The number of projections follows the logarithm of the number of vectors, so
that vectors in random directions meet in a bucket about once a table at any size; the number of tables
follows from it, so that a pair at the threshold fails to meet with a probability of at most MISS,
nearer pairs less often. Keys hold the label, as only vectors
with equal labels are compared. The cosine of each pair that meets is then computed in double precision.

Equal vectors form a class that is hashed once and counts with its size. A bucket of more than
BLOCK classes is cut into blocks, and each pair of blocks is a group of its own, so no task holds a
bucket whatever its size. A pair is counted in the first table in which it meets: every class carries
its keys, so this needs no list of pairs. From a group leave only counts per class and, for the
components, a forest of its links.

Vectors that are null, of zero length or with null or non-finite components, and those without a label,
link with nothing. Vectors of different dimensions are not compared. Rows may repeat, also in id;
ids may be null. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._cluster import checkpoint, components

THRESHOLD, MISS, WIDTH, BLOCK, SEED = 0.98, 0.002, 1.0, 1024, 5


def share_a_step(cosine: float, width: float) -> float:
    """Probability that unit vectors of this cosine fall into the same step of one projection."""
    r = width / math.sqrt(2 - 2 * cosine)
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """Tables and projections for n vectors."""
    projections = max(4, math.ceil(math.log(max(n, 2)) / -math.log(share_a_step(0.0, width))))
    return math.ceil(math.log(miss) / math.log1p(-(share_a_step(threshold, width) ** projections))), projections


def _keys(batches: Iterator[pa.RecordBatch], tables: int, projections: int, width: float) -> Iterator[pa.RecordBatch]:
    """Per class: the keys of all tables, as 64-bit hashes of the quantised projections."""
    planes: dict[int, tuple] = {}
    for records in batches:
        raw, labels = records["x"].to_pylist(), records["label"].to_numpy(zero_copy_only=False)
        keys: list = [None] * len(raw)
        size = np.array([len(r) for r in raw])
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            if d not in planes:
                rnd = np.random.default_rng((SEED, d))
                planes[d] = rnd.normal(size=(d // 8, tables * projections)), rnd.uniform(0, width, tables * projections), rnd.integers(1, 1 << 62, projections, np.int64) | 1
            plane, shift, odd = planes[d]
            x = np.frombuffer(b"".join([raw[k] for k in at]), "<f8").reshape(len(at), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            q = np.floor((x @ plane + shift) / width).astype(np.int64).reshape(len(at), tables, projections)
            h = ((q * odd).sum(2) ^ labels[at, None]) * 0x2545F4914F6CDD1D + np.arange(tables) * 0x632BE59BD9B4E019 + d
            for k, row in zip(at.tolist(), (h ^ (h >> 29)).tolist(), strict=True):
                keys[k] = row
        yield pa.RecordBatch.from_arrays([records["v"], pa.array(keys, pa.list_(pa.int64()))], ["v", "keys"])


def _double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles' bytes; null for those that link with nothing."""
    for records in batches:
        out = []
        for x in records["x"].to_pylist():
            v = None
            if x and None not in x:
                v = np.array(x, np.float64)
                big = np.abs(v).max()
                v = v if np.isfinite(v).all() and big > 0 else None
            out.append(None if v is None else (v + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([records["id"], records["label"], pa.array(out, pa.binary())], ["id", "label", "x"])


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes as all pairs do."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _check(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside a block, or between two blocks, of one bucket of one table."""
    table, i, j = (int(group[c].iloc[0]) for c in ("t", "i", "j"))
    x = np.stack([np.frombuffer(r, "<f8") for r in group["x"]]) if group["x"].map(len).nunique() == 1 else None
    if x is None:  # one key for vectors of different dimensions
        return pd.concat([_check(part, threshold) for _, part in group.groupby(group["x"].map(len))])
    v, weight, block, label = (group[c].to_numpy() for c in ("v", "w", "block", "label"))
    keys = np.stack(group["keys"].to_numpy())
    by = np.argsort(v)
    x, v, weight, keys, block, label = x[by], v[by], weight[by], keys[by], block[by], label[by]
    # scaled first: lengths neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    length = np.sqrt((x * x).sum(1))
    left, right = (np.flatnonzero(block == k) for k in (i, j))
    near = (x[left] @ x[right].T) / np.outer(length[left], length[right]) >= threshold
    near &= label[left][:, None] == label[right]
    if i == j:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    fresh = ~(keys[a, :table] == keys[b, :table]).any(1)
    a, b = a[fresh], b[fresh]
    links = np.bincount(a, weight[b], len(v)) + np.bincount(b, weight[a], len(v))
    some = np.flatnonzero(links)
    forest = np.array(_forest(len(v), np.column_stack([a, b])), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": np.r_[v[some], v[forest[:, 0]]], "b": np.r_[np.full(len(some), -1), v[forest[:, 1]]], "n": np.r_[links[some].astype(np.int64), np.zeros(len(forest), np.int64)]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each row of vectors."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = checkpoint(rows.mapInArrow(_double, "id long, label long, x binary"))
    classes = rows.where("x is not null and label is not null").groupBy("label", "x").agg(F.count("*").alias("w"), F.min("id").alias("first_id"))
    classes = checkpoint(classes.withColumn("v", F.monotonically_increasing_id()))
    tables, projections = plan(classes.count(), threshold, width, miss)
    keyed = checkpoint(classes.mapInArrow(lambda it: _keys(it, tables, projections, width), "v long, keys array<long>"))
    entries = keyed.select("v", F.posexplode("keys").alias("t", "key"))
    full = entries.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    entries = entries.join(full, ["t", "key"]).withColumn("blocks", F.ceil(F.col("c") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    # each block meets itself and all others
    pairs = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, block) as i, greatest(k, block) as j))")
    groups = entries.select("v", "t", "key", "block", F.explode(pairs).alias("p")).select("v", "t", "key", "block", "p.*")
    data = keyed.join(classes.select("v", "w", "x", "label"), "v")
    checked = groups.join(data, "v").groupBy("t", "key", "i", "j").applyInPandas(lambda g: _check(g, threshold), "a long, b long, n long")
    found = checkpoint(checked)
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "v")
    roots = components(found.where("b >= 0").select("a", "b")).withColumnRenamed("node", "v")
    owned = classes.join(roots, "v", "left").join(counts, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = owned.groupBy("root").agg(F.min("first_id").alias("least"))
    of = owned.join(least, "root").select("label", "x", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    # rows that link with nothing stay where they are; copies of one vector are a skewed join that Spark can split
    whole = F.col("x").isNotNull() & F.col("label").isNotNull()
    out = rows.where(whole).join(of, ["label", "x"]).select("id", F.col("n").alias("n_links"), F.col("least").alias("component_id"))
    out = out.unionByName(rows.where(~whole).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"))
