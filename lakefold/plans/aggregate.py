"""Aggregates and windows over the test tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lakefold.operators import aggregates as A, windows as W
from lakefold.sources.tables import load

from .registry import query, sql

sql("agg_basic", "select o_orderstatus, count(*) as n, count(nullif(o_orderpriority, '1-URGENT')) as n2, min(o_totalprice) as lo, max(o_orderdate) as hi, round(avg(o_totalprice), 6) as mean from orders group by o_orderstatus")
sql("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
sql("agg_distinct", "select l_returnflag, count(distinct l_partkey) as parts, sum(distinct l_linenumber) as lines from lineitem group by l_returnflag",
    "select l_returnflag, count(distinct l_partkey) as parts, cast(sum(distinct l_linenumber) as bigint) as lines from lineitem group by l_returnflag")
sql("agg_filter", "select l_linestatus, count(*) filter (where l_quantity > 25) as big, round(sum(l_tax) filter (where l_returnflag = 'R'), 4) as tax from lineitem group by l_linestatus")
sql("agg_ordinal_alias", "select l_returnflag as flag, l_linestatus, count(*) as n from lineitem group by 1, 2 order by 1, 2")
sql("agg_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
sql("agg_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")


@query("select o_orderpriority, coalesce(round(sum(case when o_orderstatus = 'X' then o_totalprice end), 2), 0.0) as none, round(avg(o_custkey), 7) as mean, round(coalesce(sum(o_custkey), 0)::double, 2) as total from orders group by o_orderpriority")
def agg_total_avg(spark, d):
    o, = load(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.round(A.total(F.when(F.col("o_orderstatus") == "X", F.col("o_totalprice"))), 2).alias("none"), F.round(A.avg(F.col("o_custkey")), 7).alias("mean"), F.round(A.total(F.col("o_custkey")), 2).alias("total"))


@query("select o_custkey, min(o_totalprice) as low, arg_min(o_orderkey, o_totalprice) as at_low, arg_max(o_orderkey, o_totalprice) as at_high from orders group by o_custkey")
def agg_minmax_bare(spark, d):
    o, = load(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), A.first_by(F.col("o_orderkey"), F.col("o_totalprice")).alias("at_low"), A.last_by(F.col("o_orderkey"), F.col("o_totalprice")).alias("at_high"))


@query("select n_regionkey, string_agg(n_name, '|' order by n_name) as names, string_agg(nullif(n_name, 'FRANCE'), ',' order by n_nationkey) as by_key from nation group by n_regionkey")
def agg_group_concat_ordered(spark, d):
    n, = load(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(A.group_concat(F.col("n_name"), "|").alias("names"), A.group_concat(F.nullif(F.col("n_name"), F.lit("FRANCE")), ",", [F.col("n_nationkey")]).alias("by_key"))


@query("select o_orderstatus, round(median(o_totalprice), 6) as mid, round(quantile_cont(o_totalprice, 0.9), 6) as p90, round(quantile_cont(o_totalprice, 0.25), 6) as p25 from orders group by o_orderstatus")
def agg_percentile(spark, d):
    x = F.col("o_totalprice")
    return load(spark, d, "orders")[0].groupBy("o_orderstatus").agg(F.round(A.median(x), 6).alias("mid"), F.round(A.percentile(x, 90), 6).alias("p90"), F.round(A.percentile_cont(x, 0.25), 6).alias("p25"))


@query("select o_orderpriority, list_sort(list(o_totalprice))[cast(floor(0.8 * (count(*) - 1)) as int) + 1] as p80 from orders group by o_orderpriority")
def agg_percentile_disc_ref(spark, d):
    return A.percentile_disc_by(load(spark, d, "orders")[0], ["o_orderpriority"], F.col("o_totalprice"), 0.8, "p80")


@query("select o_orderstatus, cast(sum(cast(o_totalprice as decimal(18, 2))) as varchar) as exact from orders group by o_orderstatus")
def agg_decimal_sum(spark, d):
    return load(spark, d, "orders")[0].groupBy("o_orderstatus").agg(A.decimal_sum(F.col("o_totalprice"), 2).cast("string").alias("exact"))


@query("select n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' order by n_nationkey) || ']' as names, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_name) || '}' as keys from nation group by n_regionkey")
def agg_json_group(spark, d):
    n, = load(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(A.json_group_array(F.col("n_name"), [F.col("n_nationkey")]).alias("names"), A.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("keys"))


_W = "over (partition by o_custkey order by o_orderdate, o_orderkey)"
for _name, _expr in {
    "row_number": "row_number()", "ntile": "ntile(4)", "lag": "lag(o_orderkey)", "lead": "lead(o_orderkey, 2, cast(-1 as bigint))",
    "first_value": "first_value(o_orderkey)", "last_value": "last_value(o_orderkey)", "nth_value": "nth_value(o_orderkey, 2)",
    "cume_dist": "round(cume_dist() OVER_, 9)", "percent_rank": "round(percent_rank() OVER_, 9)", "count": "count(*)", "max": "max(o_totalprice)", "min": "min(o_totalprice)",
}.items():
    _text = _expr.replace("OVER_", _W) if "OVER_" in _expr else f"{_expr} {_W}"
    _int = _name in ("row_number", "ntile")
    sql(f"win_{_name}", f"select o_orderkey, {_text} as x from orders", f"select o_orderkey, {f'cast({_text} as int)' if _int else _text} as x from orders")
for _name in ("rank", "dense_rank"):
    _text = f"{_name}() over (partition by o_custkey order by o_orderstatus)"
    sql(f"win_{_name}", f"select o_orderkey, {_text} as x from orders", f"select o_orderkey, cast({_text} as int) as x from orders")
sql("win_rows", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and 1 following), 2) as s from orders")
sql("win_range", "select o_orderkey, count(*) over (partition by o_orderstatus order by o_custkey range between 5 preceding and current row) as n from orders")
sql("win_avg_default", "select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate), 7) as a from orders")
sql("win_named", "select o_orderkey, count(*) over w as n, max(o_totalprice) over w as m from orders window w as (partition by o_custkey order by o_orderkey)")
sql("win_percentile_cont", "select o_orderkey, percentile_cont(0.5) within group (order by o_totalprice) over (partition by o_orderstatus) as mid from orders", "select o_orderkey, quantile_cont(o_totalprice, 0.5) over (partition by o_orderstatus) as mid from orders")


@query("select o_orderkey, count(*) over (partition by o_custkey order by o_orderpriority groups between 1 preceding and 1 following) as n, max(o_totalprice) over (partition by o_custkey order by o_orderpriority groups between 1 preceding and 1 following) as m from orders")
def win_groups(spark, d):
    o, frame = W.groups_frame(load(spark, d, "orders")[0], ["o_custkey"], ["o_orderpriority"], -1, 1)
    return o.select("o_orderkey", F.count("*").over(frame).alias("n"), F.max("o_totalprice").over(frame).alias("m"))


def _excluding(kind: str):
    text = {"current": "current row", "group": "group", "ties": "ties"}[kind]
    over = f"over (partition by o_custkey order by o_orderpriority range between unbounded preceding and current row exclude {text})"

    @query(f"select o_orderkey, cast(sum(o_orderkey) {over} as bigint) as s, max(o_orderkey) {over} as m from orders")
    def run(spark, d):
        o, = load(spark, d, "orders")
        frame = W.over(["o_custkey"], ["o_orderpriority"]).rangeBetween(Window.unboundedPreceding, 0)
        total = W.sum_excluding(F.col("o_orderkey"), frame, ["o_custkey"], ["o_orderpriority"], kind)
        o = o.withColumn("s", total)
        return W.extreme_excluding(o, F.max, F.col("o_orderkey"), "m", ["o_custkey"], ["o_orderpriority"], Window.unboundedPreceding, 0, kind, ["o_orderkey"]).select("o_orderkey", "s", "m")

    from .registry import ORACLE, QUERIES

    QUERIES[f"win_exclude_{kind}"], ORACLE[f"win_exclude_{kind}"] = QUERIES.pop("run"), ORACLE.pop("run")


for _kind in ("current", "group", "ties"):
    _excluding(_kind)


@query("select o_orderkey, count(*) filter (where o_orderstatus = 'O') over (partition by o_custkey order by o_orderkey) as n, max(o_totalprice) filter (where o_orderstatus = 'F') over (partition by o_custkey order by o_orderkey) as m from orders")
def win_filter_over(spark, d):
    w = W.over(["o_custkey"], ["o_orderkey"])
    return load(spark, d, "orders")[0].select("o_orderkey", A.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "O").over(w).alias("n"), A.filtered(F.max, F.col("o_totalprice"), F.col("o_orderstatus") == "F").over(w).alias("m"))


@query("select o_orderkey, count(*) over (partition by o_custkey) as n, row_number() over (partition by o_custkey order by o_orderkey)::int as k from orders")
def win_named_chain(spark, d):
    base = Window.partitionBy("o_custkey")
    return load(spark, d, "orders")[0].select("o_orderkey", F.count("*").over(base).alias("n"), F.row_number().over(base.orderBy("o_orderkey")).alias("k"))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")
def win_topn(spark, d):
    return W.top_n(load(spark, d, "orders")[0], ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("select n_nationkey, string_agg(n_name, ',') over (partition by n_regionkey order by n_nationkey) as names from nation")
def win_group_concat(spark, d):
    w = W.over(["n_regionkey"], ["n_nationkey"])
    return load(spark, d, "nation")[0].select("n_nationkey", F.array_join(F.collect_list("n_name").over(w), ",").alias("names"))
