"""Changes of tables as DataFrames: inserts with conflicts, updates, deletes, differences and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _whole(key: list[str]) -> Column:
    """Whether a key has no null: only such keys can be equal to another."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])


def _one_per_key(rows: DataFrame, key: list[str], order: Column | None, last: bool) -> DataFrame:
    """The first or last row of each key by `order`, ties and a missing order by all columns; keys with a null all stay."""
    by = [*([order] if order is not None else []), *[F.col(c) for c in rows.columns]]
    ranked = rows.where(_whole(key)).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() if last else c.asc() for c in by])))
    return ranked.where("_n = 1").drop("_n").unionByName(rows.where(~_whole(key)))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Column] | None = None, order: Column | None = None) -> DataFrame:
    """target after inserting rows: on a known key, columns in `update` change (none: the row is ignored).

    Expressions see the old row as `old.*` and the new one as `new.*`. Of several new rows of a key the
    last by `order` counts (without `update` the first); without an order, and for ties, all columns
    decide. A key with a null equals no other, so such rows are always inserted and old ones stay.
    """
    old = target.withColumn("_is_old", F.lit(True)).alias("old")
    new = _one_per_key(rows, key, order, update is not None).withColumn("_is_new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key]
    both = old.join(new, reduce(lambda a, b: a & b, on), "full")
    is_old, is_new = F.col("_is_old").isNotNull(), F.col("_is_new").isNotNull()
    out = []
    for c in target.columns:
        change = (update or {}).get(c, F.col(f"old.{c}"))
        out.append(F.when(is_old & is_new, change).when(is_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c))
    return both.select(*out)


def replace_into(target: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """INSERT OR REPLACE: new rows stand for old ones of their key; of several new rows of a key the last by `order`, else by all columns. Keys with a null never conflict."""
    new = _one_per_key(rows, key, order, True).select(*target.columns)
    return target.join(new.select(*key), key, "left_anti").select(*target.columns).unionByName(new)


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """INSERT OR IGNORE: of several new rows of a key the first by `order`, else by all columns, and none whose key is there. Keys with a null never conflict."""
    new = _one_per_key(rows, key, order, False)
    return target.unionByName(new.join(target.select(*key).distinct(), key, "left_anti").select(*target.columns))


def insert_or_fail(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR ABORT (ROLLBACK and FAIL alike, as there is no transaction to keep a part of): fails when the result is computed if a key repeats."""
    both = target.select(*target.columns).unionByName(rows.select(*target.columns))
    bad = repeated_keys(both, key).where(F.raise_error(F.lit("UNIQUE constraint failed: " + ", ".join(key))).cast("boolean"))
    return both.unionByName(bad.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in both.schema]))


def update(target: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, key: list[str], changes: dict[str, Column], order: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: rows of target whose key is in source change; expressions see `old.*` and `src.*`.

    Of several source rows of a key one counts, the first by `order`, else by all columns. Keys with a
    null match nothing.
    """
    some = _one_per_key(source.where(_whole(key)), key, order, False).withColumn("_hit", F.lit(True)).alias("src")
    both = target.alias("old").join(some, reduce(lambda a, b: a & b, [F.col(f"old.{k}") == F.col(f"src.{k}") for k in key]), "left")
    return both.select(*[F.when(F.col("_hit").isNotNull(), changes[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in changes else F.col(f"old.{c}") for c in target.columns])


def returning(before: DataFrame, after: DataFrame, key: list[str], of: str) -> DataFrame:
    """RETURNING *: the rows that a statement inserted, updated or deleted (`of`), as the statement leaves them, deleted ones as they were."""
    side = "old" if of == "delete" else "new"
    found = diff(before, after, key).where(F.col("op") == of)
    return found.select(*[F.col(c) if c in key else F.col(f"{side}_{c}").alias(c) for c in before.columns])


def generated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """GENERATED ALWAYS AS: columns computed from the others, in the order given, so that one may use those before it."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def violations(df: DataFrame, checks: dict[str, Column] | None = None, not_null: list[str] | None = None) -> DataFrame:
    """Rows that break CHECK or NOT NULL constraints, one row for each broken one, with its name in _broken. A null check is kept."""
    broken = [F.when(F.coalesce(c, F.lit(True)), F.lit(None)).otherwise(F.lit(n)) for n, c in (checks or {}).items()]
    broken += [F.when(F.col(c).isNull(), F.lit(f"NOT NULL {c}")) for c in not_null or []]
    return df.withColumn("_broken", F.explode(F.array_compact(F.array(*broken)))) if broken else df.withColumn("_broken", F.lit("")).where("false")


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows (op, key, old_*, new_*) with op insert, delete or update."""
    values = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*values).alias("_old"))
    b = after.select(*key, F.struct(*values).alias("_new"))
    both = a.join(b, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    return both.select(op.alias("op"), *key, *[F.col(f"_old.{c}").alias(f"old_{c}") for c in values], *[F.col(f"_new.{c}").alias(f"new_{c}") for c in values])


def apply_changes(target: DataFrame, changes: DataFrame, key: list[str], policy: str = "replace") -> DataFrame:
    """target after the changes of diff(), by a conflict policy.

    A change conflicts when the row it finds is not the one it was made from: an update or delete whose
    row has other old values (DATA) or is gone (NOTFOUND), an insert whose key is there (CONFLICT).
    replace: the change counts where there is a row, or for an insert; an update or delete of a row that
    is gone is left out. omit: conflicting changes are left out. abort: computing the result fails.
    """
    values = [c for c in target.columns if c not in key]
    now = target.select(*key, F.struct(*values).alias("_now"), F.lit(True).alias("_there"))
    both = now.join(changes, key, "full")
    there, op = F.col("_there").isNotNull(), F.col("op")
    patch = not any(f"old_{c}" in changes.columns for c in values)
    same = F.lit(True) if patch else F.col("_now").eqNullSafe(F.struct(*[F.col(f"old_{c}").alias(c) for c in values]))
    conflict = F.when(op == "insert", there).otherwise(~there | ~same)
    if policy == "abort":
        both = both.where(F.when(op.isNotNull() & conflict, F.raise_error(F.lit("the changes conflict with the table")).cast("boolean")).otherwise(True))
    # no change, or one that may not count
    skip = op.isNull() | ((~there & (op != "insert")) if policy == "replace" else conflict)
    left = both.where(F.when(skip, there).otherwise(op != "delete"))
    return left.select(*[F.col(c) if c in key else F.when(skip, F.col(f"_now.{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in target.columns])


def patchset(changes: DataFrame, key: list[str]) -> DataFrame:
    """The changes without old values: smaller, but they can't be inverted and find no DATA conflicts."""
    return changes.select(*[c for c in changes.columns if not c.startswith("old_") or c in key])


def concat_changes(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """One change a key that does what first and then second do; what cancels out is left out."""
    values = [c[4:] for c in first.columns if c.startswith("new_")]
    a = first.select(*key, F.col("op").alias("_a"), *[F.col(f"{s}_{c}").alias(f"_a_{s}_{c}") for s in ("old", "new") for c in values])
    b = second.select(*key, F.col("op").alias("_b"), *[F.col(f"{s}_{c}").alias(f"_b_{s}_{c}") for s in ("old", "new") for c in values])
    both = a.join(b, key, "full")
    x, y = F.col("_a"), F.col("_b")
    was, stays = F.coalesce(x, y) != "insert", F.coalesce(y, x) != "delete"
    op = F.when(was & stays, "update").when(stays, "insert").when(was, "delete")
    old = {c: F.when(x.isNotNull(), F.col(f"_a_old_{c}")).otherwise(F.col(f"_b_old_{c}")) for c in values}
    new = {c: F.when(y.isNotNull(), F.col(f"_b_new_{c}")).otherwise(F.col(f"_a_new_{c}")) for c in values}
    out = both.select(op.alias("op"), *key, *[v.alias(f"old_{c}") for c, v in old.items()], *[v.alias(f"new_{c}") for c, v in new.items()]).where("op is not null")
    same = reduce(lambda p, q: p & q, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in values], F.lit(True))
    return out.where(~((F.col("op") == "update") & same)).select(*first.columns)


def invert(changes: DataFrame) -> DataFrame:
    """The changes that undo these."""
    names = {c: ("new_" if c.startswith("old_") else "old_") + c[4:] for c in changes.columns if c[:4] in ("old_", "new_")}
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    flipped = changes.select(*[F.col(c).alias(names.get(c, c)) for c in changes.columns]).withColumn("op", op)
    return flipped.select(*changes.columns)


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; keys with a null are never repeated."""
    return df.where(_whole(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
