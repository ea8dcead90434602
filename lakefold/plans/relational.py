"""Scans, filters, joins, set operations, subqueries and recursion over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefold.functions import strings as S
from lakefold.operators import changes, recursion, relational as R, tvf
from lakefold.sources.tables import load, union_tables

from .registry import query, sql

sql("pricing_summary", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 4) as sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc, round(avg(l_quantity), 6) as avg_qty, count(*) as n
from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""")
sql("scan_projection", "select l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem")
sql("filter_between_in", "select o_orderkey, o_orderstatus from orders where o_totalprice between 1000 and 100000 and o_orderstatus in ('O', 'P')")
sql("filter_or_null_logic", "select o_orderkey from orders where (o_custkey < 100 or o_totalprice > 300000) and nullif(o_orderstatus, 'F') is not null")
sql("null_logic", """
select o_orderkey, x is null as is_null, x is not distinct from 'O' as same, x is distinct from 'O' as other, coalesce(x, 'none') as filled
from (select o_orderkey, nullif(o_orderstatus, 'F') as x from orders) t""")
sql("in_list_with_null", "select o_orderkey, o_custkey in (1, 2, null) as hit from orders")
sql("case_expr", """
select l_orderkey, l_linenumber, l_quantity, case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end as band,
    case l_returnflag when 'R' then 1 when 'A' then 2 end as code from lineitem""")
sql("values_inline", "select column1, column2 from (values (1, 'a'), (2, 'b'), (3, null)) as t(column1, column2)")
sql("rowid_lookup", "select o_orderkey, o_totalprice from orders where o_orderkey = 42 or o_orderkey between 100 and 110 or o_orderkey in (7, 8)")


@query("select p_partkey, p_name from part where p_name ilike '%a%e%' and p_brand like 'Brand#_2%' and regexp_matches(p_type, '^[A-M].*')")
def filter_like_glob(spark, d):
    part, = load(spark, d, "part")
    return part.where(S.like(F.col("p_name"), "%A%e%") & S.glob(F.col("p_brand"), "Brand#?2*") & S.glob(F.col("p_type"), "[A-M]*")).select("p_partkey", "p_name")


sql("inner_3way", """
select c.c_custkey, o.o_orderkey, l.l_linenumber, l.l_extendedprice
from customer c join orders o on c.c_custkey = o.o_custkey join lineitem l on o.o_orderkey = l.l_orderkey where c.c_mktsegment = 'BUILDING'""")
sql("left_join_unmatched", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey")
sql("right_join", "select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey + 3")
sql("full_join", "select n_nationkey, s_suppkey from nation full join supplier on n_nationkey + 5 = s_nationkey")
sql("using_join", "select o_orderkey, a.o_custkey as custkey, b.n from orders a join (select o_orderkey, count(*) as n from orders group by o_orderkey) b using (o_orderkey)")
sql("cross_join", "select r_name, n_name from region cross join nation")


@query("select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_size < b.p_size and a.p_partkey between b.p_partkey - 2 and b.p_partkey + 2")
def theta_join(spark, d):
    part, = load(spark, d, "part")
    a, b = (part.select(F.col("p_partkey").alias(x), F.col("p_size").alias(f"{x}_size")) for x in "ab")
    return R.band_join(a, b, "a", "b", 2).where("a_size < b_size").select("a", "b")


sql("self_join", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
sql("semi_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
sql("anti_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
sql("in_subquery", "select count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
sql("not_in_null", "select count(*) as n from orders where o_custkey not in (select nullif(c_custkey, 1) from customer)")


@query("select r_regionkey as k, r_name, n_name from region join nation on r_regionkey = n_regionkey")
def natural_join(spark, d):
    region, nation = load(spark, d, "region", "nation")
    return R.natural_join(region.withColumnRenamed("r_regionkey", "k"), nation.select(F.col("n_regionkey").alias("k"), "n_name"))


@query("""
with k as (select *, nullif(user_id, (select min(user_id) from events)) as u from events)
select e.event_id, e.u as user_id, max(p.ts) as last_ts, arg_max(p.event_id, (p.ts, p.event_id)) as last_id
from (select * from k where event_type = 'purchase') e left join (select * from k where event_type = 'view') p
on p.u = e.u and p.ts <= e.ts group by e.event_id, e.u""")
def asof_last_event(spark, d):
    events, = load(spark, d, "events")
    least = events.agg(F.min("user_id")).first()[0]
    events = events.withColumn("user_id", F.nullif("user_id", F.lit(least)))  # null keys match nothing
    views_ = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("last_ts"), F.col("event_id").alias("last_id"))
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_join(buys, views_, ["user_id"], "ts", "last_ts", ["last_ts", "last_id"]).drop("ts")


@query("""
select a.event_id as a, b.event_id as b from (select * from events where event_type = 'error') a join (select * from events where event_type = 'click') b
on epoch(b.ts) >= epoch(a.ts) and epoch(b.ts) < epoch(a.ts) + 600""")
def interval_join(spark, d):
    events, = load(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("a"), at.alias("t0"), (at + 600).alias("t1"))
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("b"), at.alias("t"))
    return R.interval_join(errors, clicks, "t0", "t1", "t", 600.0).select("a", "b")


@query("select user_id, count(*) as n from events a join (select distinct user_id as u from events where event_type = 'error') b on a.user_id = b.u group by user_id")
def salted_join(spark, d):
    events, = load(spark, d, "events")
    return R.salted_join(events, events.where("event_type = 'error'").select("user_id").distinct(), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


sql("union_distinct", "select o_custkey as k from orders where o_totalprice > 200000 union select c_custkey from customer where c_acctbal < 0")
sql("union_all", "select n_nationkey as k from nation union all select s_nationkey from supplier")
sql("intersect_rows", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
sql("except_rows", "select c_custkey as k from customer except select o_custkey from orders")


@query("(select n_nationkey as k from nation union select r_regionkey from region) intersect select s_nationkey from supplier")
def compound_left_assoc(spark, d):
    nation, region, supplier = load(spark, d, "nation", "region", "supplier")
    return R.compound(nation.select(F.col("n_nationkey").alias("k")), ("union", region.select("r_regionkey")), ("intersect", supplier.select("s_nationkey")))


sql("order_nulls", "select k, o_orderkey from (select nullif(o_orderstatus, 'F') as k, o_orderkey from orders) t order by k desc nulls last, o_orderkey")
sql("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
sql("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")


@query("select o_orderkey from orders order by o_orderkey limit 20 offset 15")
def limit_offset(spark, d):
    return R.slice_rows(load(spark, d, "orders")[0].select("o_orderkey").orderBy("o_orderkey"), 20, 15)


@query("select r_regionkey as id, r_name as name from region union all select n_nationkey + 100, n_name from nation")
def union_tables_view(spark, d):
    region, nation = load(spark, d, "region", "nation")
    return union_tables([region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), nation.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name"))])


sql("scalar_subquery", "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
sql("correlated_max", "select o_orderkey, o_custkey from orders o where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
sql("lateral_top1", "select c_custkey, t.o_orderkey from customer, lateral (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) t")
sql("row_value_in", "select l_orderkey, l_linenumber, l_partkey from lineitem where (l_returnflag, l_linestatus) in (select 'R', 'F' union all select 'N', 'F')")


@query("select o_orderkey from orders where (o_custkey < 500 or (o_custkey = 500 and o_orderkey < 3000)) and o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
def row_value_compare(spark, d):
    o, = load(spark, d, "orders")
    less = R.row_less([F.col("o_custkey"), F.col("o_orderkey")], [F.lit(500), F.lit(3000)])
    same = R.row_equals([F.col("o_orderstatus"), F.col("o_orderpriority")], [F.lit("O"), F.lit("1-URGENT")])
    return o.where(less & same).select("o_orderkey")


sql("cte_chain", """
with big as (select o_custkey, sum(o_totalprice) as spent from orders group by o_custkey), top as (select o_custkey from big where spent > 500000)
select c_custkey, c_name from customer join top on c_custkey = o_custkey""")
sql("recursive_counter", "with recursive t(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f + n from t where n < 200) select n, f from t")


@query("""
with recursive t(a, b) as (select n_nationkey, (n_nationkey * 7 + 3) % 25 from nation union select t.a, (t.b * 7 + 3) % 25 from t) select cast(a as bigint) as a, cast(b as bigint) as b from t""")
def recursive_union_closure(spark, d):
    n = load(spark, d, "nation")[0]
    seed = n.select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("b"))
    return recursion.recursive_union(seed, lambda new: new.select("a", ((F.col("b") * 7 + 3) % 25).alias("b")))


@query("""
with recursive e(s, t) as (select n_nationkey, (n_nationkey * 2 + 1) % 25 from nation union select n_nationkey, (n_nationkey + 9) % 25 from nation),
w(root, id, depth) as (select 0, 0, 0 union select w.root, e.t, w.depth + 1 from w join e on w.id = e.s where w.depth < 12)
select root, id, min(depth) as depth from w group by root, id""")
def transitive_closure(spark, d):
    n = load(spark, d, "nation")[0].select(F.col("n_nationkey").alias("s"))
    edges = n.withColumn("t", (F.col("s") * 2 + 1) % 25).union(n.withColumn("t", (F.col("s") + 9) % 25))
    return recursion.closure(edges, n.where("s = 0"), "s", "t")


@query("select unnest(generate_series(0, 100, 5)) as value union all select unnest(generate_series(0, -100, -5))")
def series(spark, d):
    return tvf.generate_series(spark, 0, 100, 5).union(tvf.generate_series(spark, 0, -100, -5)).union(tvf.generate_series(spark, 0, -1))


@query("select unnest(generate_series(1, 50)) as value")
def wholenumber(spark, d):
    return tvf.wholenumber(spark, 50)


@query("select unnest([3, 1, 2])::bigint as value")
def carray(spark, d):
    return tvf.carray(spark, [3, 1, 2])


@query("select n_name, left(n_name, i::int) as prefix from nation, unnest(range(0, length(n_name) + 1)) as t(i)")
def prefixes(spark, d):
    return tvf.prefixes(load(spark, d, "nation")[0].select("n_name"), "n_name")


@query("select distinct substr(p_name, 2, 1) as next from part where starts_with(p_name, 'b') and length(p_name) > 1")
def next_char(spark, d):
    return tvf.next_char(load(spark, d, "part")[0], "p_name", "b")


def _keyed(spark, d):
    """Nations, those of region 4 without a key."""
    return load(spark, d, "nation")[0].select(F.nullif(F.col("n_nationkey"), F.when(F.col("n_regionkey") == 4, F.col("n_nationkey"))).alias("n_nationkey"), "n_name")


_KEYED = "(select case when n_regionkey <> 4 then n_nationkey end as n_nationkey, n_name from nation)"


@query(f"""
select n_nationkey, case when n_nationkey % 2 = 1 then 'y' || n_name else n_name end as n_name from {_KEYED} union all
select n_nationkey + 1000, 'new' from {_KEYED} where n_nationkey % 5 = 0 union all select null, 'none' from nation where n_nationkey < 2""")
def upsert_merge(spark, d):
    n = _keyed(spark, d)
    odd = n.where("n_nationkey % 2 = 1")
    rows = odd.select("n_nationkey", F.concat(F.lit("x"), "n_name").alias("n_name"), F.lit(1).alias("at")).union(odd.select("n_nationkey", F.concat(F.lit("y"), "n_name"), F.lit(2)))
    rows = rows.union(n.where("n_nationkey % 5 = 0").select(F.col("n_nationkey") + 1000, F.lit("new"), F.lit(1))).union(spark.range(2).select(F.lit(None).cast("int"), F.lit("none"), F.lit(1)))
    return changes.upsert(n, rows, ["n_nationkey"], {"n_name": F.col("new.n_name")}, F.col("at"))


@query(f"select n_nationkey, case when n_nationkey % 3 = 0 then 'r2' else n_name end as n_name from {_KEYED} union all select null, 'none' from nation where n_nationkey < 2")
def replace_into(spark, d):
    n = _keyed(spark, d)
    third = n.where("n_nationkey % 3 = 0")
    rows = third.select("n_nationkey", F.lit("r2").alias("n_name"), F.lit(2).alias("at")).union(third.select("n_nationkey", F.lit("r1"), F.lit(1))).union(spark.range(2).select(F.lit(None).cast("int"), F.lit("none"), F.lit(0)))
    return changes.replace_into(n, rows, ["n_nationkey"], F.col("at"))


@query(f"select n_nationkey, n_name from {_KEYED} union all select 500, 'extra' union all select null, 'none' from nation where n_nationkey < 2")
def insert_or_ignore(spark, d):
    n = _keyed(spark, d)
    rows = n.where("n_nationkey is not null").select("n_nationkey", F.lit("lost").alias("n_name"), F.lit(1).alias("at"))
    rows = rows.union(spark.range(2).select(F.lit(500), F.when(F.col("id") == 0, "extra").otherwise("later"), F.col("id").cast("int"))).union(spark.range(2).select(F.lit(None).cast("int"), F.lit("none"), F.lit(0)))
    return changes.insert_or_ignore(n, rows, ["n_nationkey"], F.col("at"))


@query("select c_custkey, case when c_acctbal < 0 then 0.0 else c_acctbal end as c_acctbal from customer where not (c_nationkey = 3)")
def update_delete(spark, d):
    c = load(spark, d, "customer")[0]
    done = changes.delete(changes.update(c, {"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0), F.col("c_nationkey") == 3)
    return done.select("c_custkey", "c_acctbal")


def _versions(spark, d):
    n = load(spark, d, "nation")[0].select("n_nationkey", "n_name", "n_regionkey")
    after = n.where("n_nationkey <> 4").withColumn("n_name", F.when(F.col("n_nationkey") % 6 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return n, after.union(n.limit(1).select(F.lit(77), F.lit("new"), F.lit(1)))


@query("""
with a as (select n_nationkey, n_name, n_regionkey from nation), b as (
    select n_nationkey, case when n_nationkey % 6 = 0 then lower(n_name) else n_name end as n_name, n_regionkey from nation where n_nationkey <> 4 union all select 77, 'new', 1)
select case when a.n_nationkey is null then 'insert' when b.n_nationkey is null then 'delete' else 'update' end as op, coalesce(a.n_nationkey, b.n_nationkey) as n_nationkey,
    a.n_name as old_n_name, a.n_regionkey as old_n_regionkey, b.n_name as new_n_name, b.n_regionkey as new_n_regionkey
from a full join b on a.n_nationkey = b.n_nationkey where (a.n_name, a.n_regionkey) is distinct from (b.n_name, b.n_regionkey) or a.n_nationkey is null or b.n_nationkey is null""")
def table_diff(spark, d):
    return changes.diff(*_versions(spark, d), ["n_nationkey"])


@query("select n_nationkey, n_name, n_regionkey from nation")
def changeset_apply_invert(spark, d):
    before, after = _versions(spark, d)
    found = changes.diff(before, after, ["n_nationkey"])
    return changes.apply_changes(changes.apply_changes(before, found, ["n_nationkey"]), changes.invert(found), ["n_nationkey"])


@query("select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size > 3)")
def fk_check(spark, d):
    lineitem, part = load(spark, d, "lineitem", "part")
    return changes.missing_parents(lineitem, part.where("p_size > 3"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def unique_check(spark, d):
    return changes.repeated_keys(load(spark, d, "lineitem")[0], ["l_orderkey", "l_linenumber"])


_REVENUE = "sum(l_extendedprice * (1 - l_discount))"
sql("q3", f"""
select o_orderkey, round({_REVENUE}, 4) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15' group by o_orderkey, o_orderdate""")
sql("q4", """
select o_orderpriority, count(*) as n from orders where o_orderdate >= date '1997-07-01' and o_orderdate < date '1998-07-01'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate) group by o_orderpriority""")
sql("q5", f"""
select n_name, round({_REVENUE}, 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' group by n_name""")
sql("q6", "select round(sum(l_extendedprice * l_discount), 4) as revenue from lineitem where l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-01-01' and l_discount between 0.02 and 0.09 and l_quantity < 24")
sql("q10", f"""
select c_custkey, c_name, round({_REVENUE}, 4) as revenue, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join nation on c_nationkey = n_nationkey where l_returnflag = 'R' and o_orderdate >= date '1996-01-01' group by c_custkey, c_name, n_name""")
sql("q12", """
select o_orderpriority, l_linestatus, sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then cast(1 as bigint) else 0 end) as high from orders join lineitem on o_orderkey = l_orderkey
where l_shipdate >= date '1997-01-01' group by o_orderpriority, l_linestatus""",
    """
select o_orderpriority, l_linestatus, cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as high from orders join lineitem on o_orderkey = l_orderkey
where l_shipdate >= date '1997-01-01' group by o_orderpriority, l_linestatus""")
sql("q14", f"select round(100 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / {_REVENUE}, 6) as promo from lineitem join part on l_partkey = p_partkey")
sql("q18", """
select c_name, o_orderkey, round(sum(l_quantity), 2) as qty from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 180) group by c_name, o_orderkey""")
