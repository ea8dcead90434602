"""Joins and set operations that Spark spells differently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On all common columns, which appear once; without any, a product."""
    common = [c for c in left.columns if c.lower() in {x.lower() for x in right.columns}]
    return left.join(right, common, how) if common else left.crossJoin(right)


def row_equals(left: list[Column], right: list[Column]) -> Column:
    """(a, b) = (c, d): null if a member is null and no other pair differs."""
    return reduce(lambda x, y: x & y, [a == b for a, b in zip(left, right, strict=True)])


def row_less(left: list[Column], right: list[Column]) -> Column:
    """(a, b) < (c, d) by first difference."""
    out = left[-1] < right[-1]
    for a, b in list(zip(left, right, strict=True))[-2::-1]:
        out = (a < b) | ((a == b) & out)
    return out


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with, for each value column, the latest right row of the same key at or before left_time (null if none).

    One union, one shuffle by the keys and a running last value: the cost does not depend on how many
    right rows come before, and nothing is multiplied. Null keys and times match nothing, and such rows
    are not shuffled. Of right rows of one key and time, the greatest values count.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, left_time]])
    alone = left.where(~whole).select(*left.columns, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    mine = left.where(whole).withColumn("_left", F.struct(*left.columns)).select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), "_left", F.lit(None).cast(_struct(right, values)).alias("_right"))
    other = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, right_time]])).select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", *[F.col("_right")[v].asc_nulls_first() for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    joined = mine.unionByName(other).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return joined.select("_left.*", *[F.col("_right")[v].alias(v) for v in values]).union(alone)


def _struct(df: DataFrame, names: list[str]):
    return df.select(F.struct(*names).alias("s")).schema["s"].dataType


def interval_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_at: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Rows of both with left_start <= right_at < left_end (numbers). Null ends, points and keys match nothing.

    Points and intervals meet in cells: an equi-join, so it is hashed and shuffled, not compared row by
    row. Cells have widths of `width` times powers of two; an interval goes to those of the least width
    that is not shorter than itself, two at most, and a point to one cell of each width in use. So
    neither is copied more than some sixty times, however long an interval is.
    """
    by = by or []
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(left_end) - F.col(left_start)) / width))).cast("int")
    a = left.where(F.col(left_start) < F.col(left_end)).withColumn("_level", level)
    levels = [r[0] for r in a.select("_level").distinct().collect()]  # exponents: some two thousand at the very most
    size = lambda k: F.lit(float(width)) * F.pow(F.lit(2.0), k)
    cells = F.array_distinct(F.array(F.floor(F.col(left_start) / size(F.col("_level"))), F.floor(F.col(left_end) / size(F.col("_level")))))
    a = a.withColumn("_cell", F.explode(cells))
    b = right.where(F.col(right_at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("_cell", F.floor(F.col(right_at) / size(F.col("_level"))))
    return a.join(b, [*by, "_level", "_cell"]).where((F.col(right_at) >= F.col(left_start)) & (F.col(right_at) < F.col(left_end))).drop("_level", "_cell")


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, most: int) -> DataFrame:
    """Rows of both whose whole numbers left_at and right_at differ by `most` at most. Null matches nothing.

    They meet in cells of a power of two that is longer than the band: a right row goes to the one or two
    cells that its band touches, a left row to its own. So it is an equi-join, and what is compared grows
    with the rows of a cell, not with the table.
    """
    bits = (2 * most).bit_length()
    band = [F.col(right_at) - most, F.col(right_at) + most]
    a = left.withColumn("_cell", F.shiftright(left_at, bits))
    b = right.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.shiftright(x, bits) for x in band]))))
    return a.join(b, "_cell").where(F.col(left_at).between(*band)).drop("_cell")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """Inner join for keys with very many left rows: these are dealt over salts, and right rows copied to each."""
    # by the row's number in its partition, so repeated rows are dealt out too
    a = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"]).drop("_salt")


def compound(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """Set operations strictly from left to right: union, union all, intersect, except."""
    out = first
    for name, other in steps:
        out = {"union all": out.union, "union": lambda o, x=out: x.union(o).distinct(), "intersect": out.intersect, "except": out.subtract}[name](other)
    return out


def slice_rows(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET; a negative limit is none, a negative offset 0."""
    out = df.offset(offset) if offset > 0 else df
    return out if limit < 0 else out.limit(limit)
