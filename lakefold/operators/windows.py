"""Window frames beyond ROWS and RANGE, and chained window definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def over(partition: list, order: list) -> WindowSpec:
    """Base definition; extend it with orderBy, rowsBetween or rangeBetween (chaining)."""
    return Window.partitionBy(*partition).orderBy(*order)


def groups_frame(df: DataFrame, partition: list, order: list, start: int, end: int) -> tuple[DataFrame, WindowSpec]:
    """GROUPS BETWEEN start AND end: numbers the peer groups, then ranges over their numbers. The number is in column _group."""
    ranked = df.withColumn("_group", F.dense_rank().over(over(partition, order)))
    return ranked, Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)


def sum_excluding(x: Column, frame: WindowSpec, partition: list, order: list, exclude: str, inside: Column | None = None) -> Column:
    """sum(x) over frame EXCLUDE current | group | ties; null when nothing is left.

    The frame's sum less what is excluded, so the cost does not grow with the frame. The current row
    and its peers must be in the frame; `inside` says whether they are where that may vary.
    """
    peers = Window.partitionBy(*partition, *order)
    inside = F.lit(True) if inside is None else inside
    s, n = F.coalesce(F.sum(x).over(frame), F.lit(0)), F.count(x).over(frame)
    own, one = F.coalesce(x, F.lit(0)), x.isNotNull().cast("long")
    group, many = F.coalesce(F.sum(x).over(peers), F.lit(0)), F.count(x).over(peers)
    less, fewer = {"current": (own, one), "group": (group, many), "ties": (group - own, many - one)}[exclude]
    left = n - F.when(inside, fewer).otherwise(0)
    return F.when(left > 0, s - F.when(inside, less).otherwise(0))


def extreme_excluding(df: DataFrame, fn, x: Column, name: str, partition: list, order: list, start: int, end: int, exclude: str, row: list) -> DataFrame:
    """df with column `name`: fn (F.max or F.min) of x OVER (... GROUPS BETWEEN start AND end EXCLUDE exclude).

    The frame is taken apart: peer groups before, peer groups after, and what stays of the own group, so
    the cost does not grow with the square of a frame. row names columns that tell a group's rows apart.
    With an unbounded start and end 0 this is also RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW.
    """
    ranked = df.withColumn("_g", F.dense_rank().over(over(partition, order)))
    groups = Window.partitionBy(*partition).orderBy("_g")
    pick = F.greatest if fn is F.max else F.least
    parts = []
    if start < 0:
        parts.append(fn(x).over(groups.rangeBetween(start, min(end, -1))))
    if end > 0:
        parts.append(fn(x).over(groups.rangeBetween(max(start, 1), end)))
    if start <= 0 <= end:
        peers = over([*partition, *order], row)
        if exclude == "current":
            parts += [fn(x).over(peers.rowsBetween(Window.unboundedPreceding, -1)), fn(x).over(peers.rowsBetween(1, Window.unboundedFollowing))]
        elif exclude == "ties":
            parts.append(x)
        elif exclude == "none":
            parts.append(fn(x).over(Window.partitionBy(*partition, *order)))
    value = pick(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None).cast(df.select(x.alias("x")).schema["x"].dataType)
    return ranked.withColumn(name, value).drop("_g")


def list_excluding(x: Column, key: Column, frame: WindowSpec, exclude: str, row: Column) -> Column:
    """Values of the frame without the excluded, for any aggregate of arrays (array_max, array_min, size).

    key tells peers, row the current row; both must be columns of the frame's rows.
    """
    rows = F.collect_list(F.struct(x.alias("x"), key.alias("k"), row.alias("r"))).over(frame)
    keep = {"current": lambda r: r["r"] != row, "group": lambda r: r["k"] != key, "ties": lambda r: (r["k"] != key) | (r["r"] == row)}[exclude]
    return F.transform(F.filter(rows, keep), lambda r: r["x"])


def top_n(df: DataFrame, partition: list, order: list, n: int) -> DataFrame:
    """First n rows of each partition."""
    return df.withColumn("_n", F.row_number().over(over(partition, order))).where(F.col("_n") <= n).drop("_n")
