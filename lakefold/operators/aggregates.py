"""Aggregates with the dialect's rules, usable in groupBy().agg() and, but for the ordered ones, over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def total(x: Column) -> Column:
    """Sum as a double, 0.0 for no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def avg(x: Column) -> Column:
    return F.avg(x.cast("double"))


def group_concat(x: Column, separator: str = ",", order: list[Column] | None = None, descending: bool = False) -> Column:
    """Non-null values joined in the order of keys (the values themselves by default)."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order or [x])]
    rows = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(*keys, x.cast("string").alias("x")))), asc=not descending)
    return F.when(F.count(x) > 0, F.array_join(F.transform(rows, lambda r: r["x"]), separator))


def median(x: Column) -> Column:
    return F.median(x)


def percentile(x: Column, p: float) -> Column:
    """p from 0 to 100, with linear interpolation."""
    return F.percentile(x, p / 100)


def percentile_cont(x: Column, f: float) -> Column:
    return F.percentile(x, f)


def percentile_disc(x: Column, f: float) -> Column:
    """The value at floor(f * (n - 1)) of the sorted ones: never one between two. It holds a group's values; percentile_disc_by does not."""
    n = F.count(x)
    return F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.lit(f) * (n - 1)) + 1).cast("int"))


def percentile_disc_by(df: DataFrame, by: list[str], x: Column, f: float, name: str) -> DataFrame:
    """Rows (by, name) with percentile_disc of x per group, for groups of any size; null for a group without values.

    Equal values are counted before the shuffle; then counts run up in order of the values, which spills.
    """
    counts = df.select(*by, x.alias("_x")).groupBy(*by, "_x").agg(F.count("_x").alias("_c"))
    w = Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_first())
    up = counts.withColumn("_up", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    place = F.floor(F.lit(f) * (F.col("_n") - 1))
    return up.groupBy(*by).agg(F.min(F.when(F.col("_up") > place, F.col("_x"))).alias(name))


def first_by(x: Column, key: Column) -> Column:
    """x of the row with the least key: a bare column beside min(key)."""
    return F.min_by(x, key)


def last_by(x: Column, key: Column) -> Column:
    return F.max_by(x, key)


def decimal_sum(x: Column, scale: int = 10) -> Column:
    return F.sum(x.cast(f"decimal(38,{scale})"))


def json_group_array(x: Column, order: list[Column] | None = None) -> Column:
    """JSON array of all values, nulls too, in the order of keys."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order or [])]
    rows = F.collect_list(F.struct(*keys, x.alias("x")))
    rows = F.sort_array(rows) if keys else rows
    return F.to_json(F.transform(rows, lambda r: r["x"]))


def json_group_object(key: Column, value: Column) -> Column:
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))), {"ignoreNullFields": "false"})


def filtered(agg, x: Column, condition: Column) -> Column:
    """agg(x) FILTER (WHERE condition), also over windows."""
    return agg(F.when(condition, x))
