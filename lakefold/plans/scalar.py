"""Scalar functions, dates, JSON, text search and boxes over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefold.functions import blob as B, datetimes as D, json as J, math as M, strings as S
from lakefold.operators import spatial, text as T, tvf
from lakefold.sources.tables import load

from .registry import query


def _orders(spark, d):
    return load(spark, d, "orders")[0]


@query("select o_orderkey, abs(o_custkey - 700) as a, greatest(o_custkey, 100) as hi, least(o_custkey, 100) as lo, cast(null as bigint) as none, cast(sign(o_custkey - 700) as int) as s from orders")
def fn_math(spark, d):
    k = F.col("o_custkey")
    return _orders(spark, d).select("o_orderkey", F.abs(k - 700).alias("a"), M.max_of(k, F.lit(100).cast("long")).alias("hi"), M.min_of(k, F.lit(100).cast("long")).alias("lo"), M.max_of(k, F.lit(None).cast("long")).alias("none"), M.sign(k - 700).alias("s"))


@query("select o_orderkey, round(sin(o_custkey), 8) as si, round(cos(o_custkey), 8) as co, round(tan(o_custkey), 6) as ta, round(case when o_custkey <= 1 then acos(o_custkey) end, 8) as ac, round(atan2(o_custkey, 3), 8) as at, round(degrees(o_custkey), 6) as de, round(radians(o_custkey), 8) as ra, round(tanh(o_custkey), 8) as th, round(pi(), 8) as p from orders")
def fn_trig(spark, d):
    k = F.col("o_custkey")
    return _orders(spark, d).select("o_orderkey", F.round(M.guarded(F.sin, k), 8).alias("si"), F.round(M.guarded(F.cos, k), 8).alias("co"), F.round(M.guarded(F.tan, k), 6).alias("ta"), F.round(M.guarded(F.acos, k), 8).alias("ac"), F.round(F.atan2(k.cast("double"), F.lit(3.0)), 8).alias("at"), F.round(F.degrees(k), 6).alias("de"), F.round(F.radians(k), 8).alias("ra"), F.round(M.guarded(F.tanh, k), 8).alias("th"), F.round(F.pi(), 8).alias("p"))


@query("select c_custkey, round(case when c_acctbal > 0 then ln(c_acctbal) end, 8) as l, round(case when c_acctbal > 0 then log10(c_acctbal) end, 8) as l10, round(case when c_acctbal > 0 then log2(c_acctbal) end, 8) as l2, round(case when c_acctbal > 0 then ln(c_acctbal) / ln(7) end, 8) as l7, round(case when c_acctbal >= 0 then sqrt(c_acctbal) end, 8) as s, round(exp(c_acctbal / 10000), 8) as e, round(pow(c_acctbal, 2) / 1000, 2) as p from customer")
def fn_log(spark, d):
    x = F.col("c_acctbal")
    return load(spark, d, "customer")[0].select("c_custkey", F.round(M.ln(x), 8).alias("l"), F.round(M.log(x), 8).alias("l10"), F.round(M.log2(x), 8).alias("l2"), F.round(M.log(x, F.lit(7.0)), 8).alias("l7"), F.round(M.sqrt(x), 8).alias("s"), F.round(F.exp(x / 10000), 8).alias("e"), F.round(F.pow(x, F.lit(2.0)) / 1000, 2).alias("p"))


@query("select o_orderkey, round(o_totalprice) as r0, round(o_totalprice, 1) as r1, ceil(o_totalprice)::bigint as c, floor(o_totalprice)::bigint as f, trunc(-o_totalprice) as t from orders")
def fn_round(spark, d):
    x = F.col("o_totalprice")
    return _orders(spark, d).select("o_orderkey", M.round_half_up(x, -2).alias("r0"), M.round_half_up(x, 1).alias("r1"), F.ceil(x).alias("c"), F.floor(x).alias("f"), M.trunc(-x).alias("t"))


@query("select o_orderkey, o_custkey // 7 as q, (-o_custkey) // 7 as nq, (-o_custkey) % 7 as m, case when o_custkey % 3 <> 0 then o_orderkey // (o_custkey % 3) end as z, case when o_custkey % 3 <> 0 then o_orderkey % (o_custkey % 3) end as zm, case when o_custkey % 3 <> 0 then o_totalprice / (o_custkey % 3) end as zd, fmod(o_totalprice, 7) as fm from orders")
def fn_intdiv_mod(spark, d):
    k, z = F.col("o_custkey"), F.col("o_custkey") % 3
    seven = F.lit(7)
    return _orders(spark, d).select("o_orderkey", M.int_div(k, seven).alias("q"), M.int_div(-k, seven).alias("nq"), M.int_mod(-k, seven).alias("m"), M.int_div(F.col("o_orderkey"), z).alias("z"), M.int_mod(F.col("o_orderkey"), z).alias("zm"), M.divide(F.col("o_totalprice"), z).alias("zd"), M.fmod(F.col("o_totalprice"), seven).alias("fm"))


@query("select o_orderkey, o_custkey & 12 as a, o_custkey | 3 as o, ~o_custkey as n, o_custkey << 3 as l, o_custkey >> 2 as r, o_custkey >> 1 as neg, cast(0 as bigint) as far from orders")
def fn_bitops(spark, d):
    k = F.col("o_custkey")
    return _orders(spark, d).select("o_orderkey", k.bitwiseAND(F.lit(12)).alias("a"), k.bitwiseOR(F.lit(3)).alias("o"), F.bitwise_not(k).alias("n"), M.shift_left(k, F.lit(3)).alias("l"), M.shift_right(k, F.lit(2)).alias("r"), M.shift_left(k, F.lit(-1)).alias("neg"), M.shift_left(k, F.lit(64)).alias("far"))


@query("select p_partkey, substr(p_name, 2, 3) as a, substr(p_name, -3) as b, substr(p_name, 0, 3) as c, substr(p_name, 4, -2) as d, substr(p_name, -5, 2) as e, substr(p_name, 100, 2) as f from part")
def fn_substr(spark, d):
    n = F.col("p_name")
    return load(spark, d, "part")[0].select("p_partkey", S.substr(n, 2, 3).alias("a"), S.substr(n, -3).alias("b"), S.substr(n, 0, 3).alias("c"), S.substr(n, 4, -2).alias("d"), S.substr(n, -5, 2).alias("e"), S.substr(n, 100, 2).alias("f"))


@query("select p_partkey, instr(p_name, 'e')::int as i, replace(p_name, 'a', 'XY') as r, p_name as same, trim('  ' || p_name || ' ') as t, ltrim(p_brand, 'Brand') as l, rtrim(p_brand, '0123456789') as rt, reverse(p_name) as rev from part")
def fn_instr_replace_trim(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return load(spark, d, "part")[0].select("p_partkey", S.instr(n, F.lit("e")).alias("i"), S.replace(n, F.lit("a"), F.lit("XY")).alias("r"), S.replace(n, F.lit(""), F.lit("z")).alias("same"), S.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), S.ltrim(b, "Brand").alias("l"), S.rtrim(b, "0123456789").alias("rt"), F.reverse(n).alias("rev"))


@query("select doc_id, sha256(upper(replace(text, 'ß', 'ss'))) as u, sha256(lower(text)) as l, length(text)::int as n, octet_length(encode(text))::int as o, unicode(text)::int as c, chr(unicode(text)) as h from documents where length(text) > 0")
def fn_case_len(spark, d):
    t = F.col("text")
    return load(spark, d, "documents")[0].where("length(text) > 0").select("doc_id", F.sha2(F.upper(F.replace(t, F.lit("ß"), F.lit("ss"))), 256).alias("u"), F.sha2(F.lower(t), 256).alias("l"), F.char_length(t).alias("n"), F.octet_length(t).alias("o"), S.unicode(t).alias("c"), S.char(S.unicode(t)).alias("h"))


@query("select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'none') as c, ifnull(nullif(o_orderstatus, 'F'), '-') as i, case when o_custkey > 50 then 'big' else 'small' end as w from orders")
def fn_coalesce_iif(spark, d):
    s = F.col("o_orderstatus")
    return _orders(spark, d).select("o_orderkey", F.coalesce(F.nullif(s, F.lit("O")), F.lit("none")).alias("c"), F.ifnull(F.nullif(s, F.lit("F")), F.lit("-")).alias("i"), F.when(F.col("o_custkey") > 50, "big").otherwise("small").alias("w"))


@query("select n_nationkey, hex(n_name) as h, decode(unhex(hex(n_name))) as back, '''' || replace(n_name || '''s', '''', '''''') || '''' as q, case when n_nationkey = 3 then 'NULL' else '''' || n_name || '''' end as qn, n_nationkey::varchar as qi from nation")
def fn_hex_quote(spark, d):
    n = F.col("n_name")
    return load(spark, d, "nation")[0].select("n_nationkey", F.hex(n).alias("h"), F.decode(B.unhex(F.hex(n)), "UTF-8").alias("back"), S.quote(F.concat(n, F.lit("'s"))).alias("q"), S.quote(F.when(F.col("n_nationkey") != 3, n)).alias("qn"), S.quote(F.col("n_nationkey"), "number").alias("qi"))


@query("select o_orderkey, printf('%05d|%-8s|%.2f', o_custkey, o_orderstatus, o_totalprice) as p, printf('%x %X %o', o_custkey, o_custkey, o_custkey) as h, printf('%+d%%', o_custkey) as s, '''' || o_orderstatus || '''' as q from orders")
def fn_printf(spark, d):
    k = F.col("o_custkey")
    return _orders(spark, d).select("o_orderkey", S.printf("%05d|%-8s|%.2f", k, F.col("o_orderstatus"), F.col("o_totalprice")).alias("p"), S.printf("%x %X %o", k, k, k).alias("h"), S.printf("%+d%%", k).alias("s"), S.printf("%Q", F.col("o_orderstatus")).alias("q"))


@query("select n_nationkey, concat(n_name, null, n_regionkey) as c, concat_ws('-', n_name, null, n_regionkey) as w, cast(null as int) as p from nation")
def fn_concat_ws(spark, d):
    n, r = F.col("n_name"), F.col("n_regionkey").cast("string")
    return load(spark, d, "nation")[0].select("n_nationkey", S.concat(n, F.lit(None).cast("string"), r).alias("c"), F.concat_ws("-", n, F.lit(None).cast("string"), r).alias("w"), F.concat(n, F.lit(None).cast("string")).cast("int").alias("p"))


@query("select o_orderkey, 'integer' as a, 'real' as b, case when o_orderstatus = 'F' then 'null' else 'text' end as c from orders")
def fn_typeof(spark, d):
    return _orders(spark, d).select("o_orderkey", S.typeof(F.col("o_orderkey"), "bigint").alias("a"), S.typeof(F.col("o_totalprice"), "double").alias("b"), S.typeof(F.nullif(F.col("o_orderstatus"), F.lit("F")), "string").alias("c"))


@query("select p_partkey, coalesce(try_cast(regexp_extract(p_size || 'abc', '^[0-9]+') as bigint), 0) as a, cast(0 as bigint) as b, p_size + 0.5 as c, case when p_partkey % 2 = 0 then p_partkey end as s from part".replace("p_size + 0.5", "cast(p_size + 0.5 as double)"))
def fn_lenient_cast(spark, d):
    n = F.col("p_size").cast("string")
    strict = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("1x")
    return load(spark, d, "part")[0].select("p_partkey", M.lenient_int(F.concat(n, F.lit("abc"))).alias("a"), M.lenient_int(F.col("p_name")).alias("b"), M.lenient_real(F.concat(n, F.lit(".5e0zz"))).alias("c"), M.to_integer(strict).alias("s"))


@query("select n_nationkey, sha1(n_name) as s, n_name as z, n_name as e from nation")
def fn_blob_codecs(spark, d):
    n = F.col("n_name")
    return load(spark, d, "nation")[0].select("n_nationkey", B.sha1(n).alias("s"), F.decode(B.uncompress(B.compress(n)), "UTF-8").alias("z"), F.decode(B.unbase85(B.base85(n)), "UTF-8").alias("e"))


@query("select n_nationkey, n_nationkey::bigint as a, n_regionkey::bigint as b from nation")
def fn_zorder(spark, d):
    z = M.zorder(F.col("n_nationkey"), F.col("n_regionkey"))
    return load(spark, d, "nation")[0].select("n_nationkey", M.unzorder(z, 2, 0).alias("a"), M.unzorder(z, 2, 1).alias("b"))


_CODES = "translate(upper(x), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
for _k in "0123456":
    _CODES = f"regexp_replace({_CODES}, '{_k}+', '{_k}', 'g')"


@query(f"""
with t as (select p_partkey, regexp_replace(regexp_replace(p_name, '^[^A-Za-z]+', ''), '[^A-Za-z]', '0', 'g') as x from part)
select p_partkey, case when x = '' then '?000' else upper(left(x, 1)) || left(replace(substr({_CODES}, 2), '0', '') || '000', 3) end as s from t""")
def soundex(spark, d):
    return load(spark, d, "part")[0].select("p_partkey", S.soundex(F.col("p_name")).alias("s"))


def _t():
    return D.moment(F.col("ts"), "timestamp")


def _events(spark, d):
    return load(spark, d, "events")[0]


@query("select event_id, strftime(ts, '%Y-%m-%d') as d, strftime(ts, '%H:%M:%S') as t, strftime(ts, '%Y-%m-%d %H:%M:%S') as dt, epoch(ts)::bigint as u from events".replace("epoch(ts)::bigint", "floor(epoch(ts))::bigint"))
def dt_parts(spark, d):
    return _events(spark, d).select("event_id", D.date(_t()).alias("d"), D.time(_t()).alias("t"), D.datetime(_t()).alias("dt"), D.unixepoch(_t()).alias("u"))


@query("select event_id, date_trunc('month', ts) + interval 1 month - interval 1 day as last_day, ts + interval 90 minute as later, date_trunc('day', ts) as day, date_trunc('year', ts) as year from events")
def dt_modifiers(spark, d):
    return _events(spark, d).select("event_id", D.modify(_t(), "start of month", "+1 month", "-1 day").alias("last_day"), D.modify(_t(), "+01:30").alias("later"), D.modify(_t(), "start of day").alias("day"), D.modify(_t(), "start of year").alias("year"))


@query("""
select o_orderkey, (make_date(year(o_orderdate + interval 1 month), month(date_trunc('month', o_orderdate) + interval 1 month), 1) + (day(o_orderdate) - 1)::int)::timestamp as rolled,
    o_orderdate + interval 1 month as clamped from orders""".replace("year(o_orderdate + interval 1 month)", "year(date_trunc('month', o_orderdate) + interval 1 month)"))
def dt_month_overflow(spark, d):
    t = D.moment(F.col("o_orderdate"), "timestamp")
    return _orders(spark, d).select("o_orderkey", D.modify(t, "+1 month").alias("rolled"), D.modify(t, "floor", "+1 month").alias("clamped"))


@query("select event_id, strftime(ts, '%Y|%m|%d|%H|%M|%S|%j|%w|%u|%V|%G|%U|%W|%p|%I') as s from events")
def dt_strftime(spark, d):
    return _events(spark, d).select("event_id", D.strftime("%Y|%m|%d|%H|%M|%S|%j|%w|%u|%V|%G|%U|%W|%p|%I", _t()).alias("s"))


@query("select event_id, round(epoch_us(ts) / 86400e6 + 2440587.5, 3) as j, date_trunc('second', ts) as back from events")
def dt_julian(spark, d):
    at = D.moment(D.unixepoch(_t()), "unix")
    return _events(spark, d).select("event_id", F.round(D.julianday(_t()), 3).alias("j"), at.alias("back"))


@query("select event_id, date_trunc('day', ts) + to_days((((1 - dayofweek(ts)) % 7) + 7)::int % 7) as monday from events")
def dt_weekday(spark, d):
    return _events(spark, d).select("event_id", D.modify(_t(), "start of day", "weekday 1").alias("monday"))


@query("""
with m as (select o_orderkey, o_orderdate as t, datesub('month', timestamp '1992-02-01 06:30:00', o_orderdate) as n from orders),
r as (select *, timestamp '1992-02-01 06:30:00' + to_months(n::int) as b from m)
select o_orderkey, printf('+%04d-%02d-%02d ', n // 12, n % 12, datesub('day', b, t)) || strftime(timestamp '2000-01-01' + (t - b - to_days(datesub('day', b, t)::int)), '%H:%M:%S.%g') as x from r""")
def dt_timediff(spark, d):
    return _orders(spark, d).select("o_orderkey", D.timediff(D.moment(F.col("o_orderdate"), "timestamp"), F.lit("1992-02-01 06:30:00").cast("timestamp_ntz")).alias("x"))


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none') as none, true as ok, 'object' as kind from events")
def json_extract(spark, d):
    p = F.col("props")
    return _events(spark, d).select("event_id", J.extract(p, "$.k").alias("k"), J.extract(p, "$.none").alias("none"), J.valid(p).alias("ok"), J.type_(p).alias("kind"))


@query("select event_id, json_extract(props, '$.k')::varchar as a, props->>'$.k' as t from events")
def json_arrow(spark, d):
    return _events(spark, d).select("event_id", J.arrow(F.col("props"), "k").alias("a"), J.arrow_text(F.col("props"), "k").alias("t"))


_DEEP = """'{"e":' || event_id || ',"t":["' || event_type || '",' || props || ',null,true,' || (event_id % 7) || '.5,[],{"x y":{}}]}'"""
_KIND = "case type when 'VARCHAR' then 'text' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'real' when 'BOOLEAN' then atom::varchar else lower(type) end"
_TEXT = "case type when 'VARCHAR' then {0} ->> '$' when 'NULL' then null else {0}::varchar end"


@query(f"""
select event_id, key, {_TEXT.format("value")} as value, {_KIND} as type, fullkey
from (select event_id, {_DEEP} as doc from events) e, json_each(e.doc)""")
def json_each(spark, d):
    docs = _events(spark, d).select("event_id", F.expr(_DEEP).alias("doc"))
    return tvf.each(docs, "doc").select("event_id", "key", "value", "type", "fullkey")


@query(f"""
select event_id, key, {_TEXT.format("value")} as value, {_KIND} as type, {_TEXT.format("atom")} as atom, fullkey, path
from (select event_id, {_DEEP} as doc from events) e, json_tree(e.doc)""")
def json_tree(spark, d):
    docs = _events(spark, d).select("event_id", F.expr(_DEEP).alias("doc"))
    return tvf.tree(docs, "doc").select("event_id", "key", "value", "type", "atom", "fullkey", "path")


@query("""select event_id, '[' || event_id || ',"' || event_type || '",null]' as a, '{"id":' || event_id || ',"type":"' || event_type || '"}' as o, 3 as n from events""")
def json_build(spark, d):
    a = J.array(F.col("event_id"), F.col("event_type"), F.lit(None).cast("string"))
    return _events(spark, d).select("event_id", a.alias("a"), J.object_(id=F.col("event_id"), type=F.col("event_type")).alias("o"), J.array_length(a).alias("n"))


@query("""select event_id, '{"k":0}' as s, '{"k":' || (props->>'$.k') || ',"new":[1]}' as i, '{}' as r, '{"k":' || (props->>'$.k') || ',"x":{"y":1}}' as p from events""")
def json_edit(spark, d):
    p = F.col("props")
    return _events(spark, d).select("event_id", J.set_(p, "$.k", 0).alias("s"), J.insert(p, "$.new", [1]).alias("i"), J.remove(p, "$.k").alias("r"), J.patch(p, F.lit('{"x":{"y":1,"z":null}}')).alias("p"))


_DOCS = "(select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda t: t <> '') as w from documents)"


def _post(spark, d, only=None):
    return T.postings(load(spark, d, "documents")[0], "doc_id", "text", only=only)


def _fts(name: str, question: str, oracle: str) -> None:
    def run(spark, d):
        return T.search_texts(load(spark, d, "documents")[0], "doc_id", "text", question).select(F.col("id").alias("doc_id"))

    run.__name__ = name
    query(oracle)(run)


_fts("fts_term", "this", f"select doc_id from {_DOCS} where list_contains(w, 'this')")
_fts("fts_prefix", "fro*", f"select doc_id from {_DOCS} where len(list_filter(w, lambda t: starts_with(t, 'fro'))) > 0")
_fts("fts_and_or_not", "(this OR that) NOT with", f"select doc_id from {_DOCS} where (list_contains(w, 'this') or list_contains(w, 'that')) and not list_contains(w, 'with')")
_fts("fts_phrase", '"of the"', f"select doc_id from {_DOCS} where contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
_fts("fts_near", "NEAR(this for, 3)", f"select distinct doc_id from (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as p from {_DOCS}) a join (select doc_id, unnest(w) as t2, generate_subscripts(w, 1) as p2 from {_DOCS}) b using (doc_id) where t = 'this' and t2 = 'for' and abs(p - p2) <= 4")

_TERMS = f"(select doc_id as id, unnest(w) as term from {_DOCS})"


@query(f"select doc_id, term, pos from (select doc_id, unnest(w) as term, (generate_subscripts(w, 1) - 1)::int as pos from {_DOCS}) where term in ('this', 'from')")
def fts_offsets(spark, d):
    return T.offsets(_post(spark, d, ["this", "from"]), ["this", "from"]).select(F.col("id").alias("doc_id"), "term", "pos")


@query(f"""
with t as (select id, term from {_TERMS}), l as (select id, count(*) as len from t group by id), s as (select count(*) as docs, avg(len) as a from l),
f as (select id, term, count(*) as tf from t where term in ('this', 'from') group by id, term), df as (select term, count(*) as df from f group by term)
select id as doc_id, round(-sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 8) as score
from f join df using (term) join l using (id) cross join s group by id""")
def fts_bm25(spark, d):
    return T.bm25(_post(spark, d), ["this", "from"]).select(F.col("id").alias("doc_id"), F.round("score", 8).alias("score"))


@query("select term, count(distinct doc_id) as doc, count(*) as cnt from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x80-\\x{10FFFF}]+'), lambda t: t <> '')) as term from documents) group by term")
def fts_vocab(spark, d):
    return T.vocabulary(T.postings(load(spark, d, "documents")[0], "doc_id", "text", "simple"))


@query()
def fts_snippet(spark, d):
    t = F.col("text")
    return load(spark, d, "documents")[0].select("doc_id", T.snippet(t, ["this", "from"]).alias("snippet"), T.highlight(t, ["the"]).alias("marked"))


# published examples of the stemming algorithm
_WORDS = "caresses ponies cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing filing happy sky relational conditional vietnamization triplicate formative electrical goodness revival adoption controlling psychology possibly"
_STEMS = "caress poni cat feed agre plaster motor sing conflat troubl size hop fall hiss file happi sky relat condit vietnam triplic form electr good reviv adopt control psycholog possibl"


@query(f"select unnest(string_split('{_WORDS}', ' ')) as word, unnest(string_split('{_STEMS}', ' ')) as stem, n from (select count(*) as n from documents)")
def fts_porter(spark, d):
    n = load(spark, d, "documents")[0].agg(F.count(T.tokens(F.col("text"), "porter")).alias("n"))
    words = n.select("n", F.explode(F.split(F.lit(_WORDS), " ")).alias("word"))
    return words.select("word", T.tokens(F.col("word"), "porter")[0].alias("stem"), "n")


_MARK = "regexp_replace({0}, '(?i)(^|[^\\p{{L}}\\p{{N}}])(the)($|[^\\p{{L}}\\p{{N}}])', '\\1\u2460\\2\u2460\\3', 'g')"


@query("select doc_id, sha256(regexp_replace(" + _MARK.format(_MARK.format("text")) + ", '\u2460(.{3})\u2460', '[\\1]', 'g')) as marked from documents")
def fts_highlight(spark, d):
    return load(spark, d, "documents")[0].select("doc_id", F.sha2(T.highlight(F.col("text"), ["the"]), 256).alias("marked"))


@query("select c_custkey, levenshtein(c_mktsegment, 'BUILDINGS')::int as e from customer")
def edit_distance(spark, d):
    return load(spark, d, "customer")[0].select("c_custkey", T.edit_distance(F.col("c_mktsegment"), F.lit("BUILDINGS")).alias("e"))


@query("select vec_id from embeddings where embedding[1] between -0.1 and 0.1 and embedding[2] between 0 and 0.2")
def rtree_overlap(spark, d):
    e = load(spark, d, "embeddings")[0].select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return e.where(spatial.contains_point([("x", "x"), ("y", "y")], [0.0, 0.1]) | spatial.within([("x", "x"), ("y", "y")], [-0.1, 0.0], [0.1, 0.2])).select("vec_id")


@query("""
with b as (select vec_id as id, embedding[1]::double as x0, embedding[1]::double + 0.02 as x1, embedding[2]::double as y0, embedding[2]::double + 0.02 as y1 from embeddings)
select l.id as left_id, r.id as right_id from b l join b r on l.x0 <= r.x1 and l.x1 >= r.x0 and l.y0 <= r.y1 and l.y1 >= r.y0""")
def rtree_box_join(spark, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    b = load(spark, d, "embeddings")[0].select(F.col("vec_id").alias("id"), x.alias("x0"), (x + 0.02).alias("x1"), y.alias("y0"), (y + 0.02).alias("y1"))
    return spatial.box_join(b, b, 0.05)


@query("select n_nationkey, round(6 * (n_regionkey + 1) * (n_regionkey + 1) * sqrt(3) / 4, 6) as area, true as inside, false as outside, round(n_nationkey + n_regionkey + 1.0, 6)::double as x1 from nation")
def geopoly(spark, d):
    r = (F.col("n_regionkey") + 1).cast("double")
    poly = spatial.regular_polygon(F.col("n_nationkey").cast("double"), F.lit(0.0), r, 6)
    n = load(spark, d, "nation")[0].withColumn("p", poly)
    at = F.col("n_nationkey").cast("double")
    return n.select("n_nationkey", F.round(spatial.polygon_area(F.col("p")), 6).alias("area"), spatial.polygon_contains(F.col("p"), at + 0.1, F.lit(0.2)).alias("inside"), spatial.polygon_contains(F.col("p"), at + 100, F.lit(0.2)).alias("outside"), F.round(spatial.polygon_bbox(F.col("p"))["x1"], 6).alias("x1"))
