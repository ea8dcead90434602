"""Values of single functions and operators on inline rows."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import Row, functions as F

from lakefold.functions import datetimes as D, json as J, math as M, strings as S
from lakefold.operators import aggregates as A, changes as C, recursion, relational as R, text as T, tvf, windows as W
from lakefold.sources import tables
from lakefold.streaming import events as E
from tables_dir import DATA


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    assert value(spark, M.int_div(F.lit(-5), F.lit(2))) == -2
    assert value(spark, M.int_div(F.lit(1), F.lit(0))) is None
    assert value(spark, M.int_mod(F.lit(-5), F.lit(3))) == -2
    assert value(spark, M.shift_left(F.lit(1), F.lit(64))) == 0
    assert value(spark, M.shift_right(F.lit(-1), F.lit(70))) == -1
    assert value(spark, M.max_of(F.lit(1), F.lit(None).cast("int"))) is None
    assert value(spark, M.lenient_int(F.lit(" 12abc"))) == 12
    assert value(spark, M.lenient_real(F.lit("-1.5e2x"))) == -150.0
    assert value(spark, M.log(F.lit(100))) == pytest.approx(2)
    assert value(spark, M.ieee754(F.lit(45.25))) == Row(mantissa=181, exponent=-2)
    assert value(spark, M.ieee754(F.lit(0.0)))["mantissa"] == 0


def test_text(spark):
    x = F.lit("abcdef")
    assert value(spark, S.substr(x, 0, 3)) == "ab"
    assert value(spark, S.substr(x, 4, -2)) == "bc"
    assert value(spark, S.substr(x, -2)) == "ef"
    assert value(spark, S.like(F.lit("A_c"), "a\\_C", "\\"))
    assert value(spark, S.glob(F.lit("a]b"), "a[]]b"))
    assert not value(spark, S.glob(F.lit("abc"), "A*"))
    assert value(spark, S.char(F.lit(8364), F.lit(128512))) == "€😀"
    assert value(spark, S.printf("%5.2f|%-4d|%04d|%g|%q", F.lit(3.14159), F.lit(7), F.lit(-5), F.lit(0.0001), F.lit("it's"))) == " 3.14|7   |-005|0.0001|it''s"
    assert value(spark, S.printf("%d %s", F.lit(1))) == "1 "
    assert value(spark, S.printf("%g %g %G", F.lit(1e10), F.lit(100.0), F.lit(1e-9))) == "1e+10 100 1E-09"


def test_dates(spark):
    t = D.moment(F.lit("2024-01-31 10:00:00"))
    assert value(spark, D.date(D.modify(t, "+1 month"))) == "2024-03-02"
    assert value(spark, D.date(D.modify(t, "floor", "+1 month"))) == "2024-02-29"
    assert value(spark, D.date(D.modify(t, "weekday 0"))) == "2024-02-04"
    assert value(spark, D.datetime(D.moment(F.lit(2440587.5), "julian"))) == "1970-01-01 00:00:00"
    assert value(spark, D.date(D.moment(F.lit("nonsense")))) is None
    assert value(spark, D.strftime("%Q", t)) is None
    assert value(spark, D.timediff(D.moment(F.lit("2024-03-15")), D.moment(F.lit("2024-01-31")))) == "+0000-01-13 00:00:00.000"
    assert value(spark, D.timediff(D.moment(F.lit("2024-01-01")), D.moment(F.lit("2024-01-02 12:00")))) == "-0000-00-01 12:00:00.000"


def test_json(spark):
    x = F.lit('{"a": {"b": [1, 2.5, null]}, "c": "é"}')
    assert value(spark, J.extract(x, "$.a.b[#-2]")) == "2.5"
    assert value(spark, J.extract(x, "$.c", "$.a.b[0]")) == '["é",1]'
    assert value(spark, J.type_(x, "$.a.b[2]")) == "null"
    assert value(spark, J.set_(x, "$.a.b[3]", "new")) == '{"a":{"b":[1,2.5,null,"new"]},"c":"é"}'
    assert value(spark, J.replace(x, "$.none", 1)) == '{"a":{"b":[1,2.5,null]},"c":"é"}'
    assert value(spark, J.remove(x, "$.a", "$.x")) == '{"c":"é"}'
    assert value(spark, J.valid(F.lit("{"))) is False
    assert value(spark, J.error_position(F.lit("[1,]"))) > 0
    assert value(spark, J.array_length(x, "$.a.b")) == 3


def test_table_functions(spark):
    assert [r[0] for r in tvf.generate_series(spark, 5, 1, -2).collect()] == [5, 3, 1]
    tvf.register(spark)
    rows = spark.sql("""select fullkey, type, atom from json_tree('{"a":[1,{"b c":null}]}')""").collect()
    assert [r["fullkey"] for r in rows] == ["$", "$.a", "$.a[0]", "$.a[1]", '$.a[1]."b c"']
    assert [r["type"] for r in rows] == ["object", "array", "integer", "object", "null"]


def test_json_tree_rows_come_in_batches(spark, monkeypatch):
    docs = ['{"a":[1,{"b c":null}],"z":"é","f":[1.50,1e3,true]}', None, "7", "[]", "[" * 40 + "]" * 40] * 50
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    tree = tvf.tree(df, "doc")
    assert "MapInArrow" in tree._jdf.queryExecution().executedPlan().toString()
    names = ["i", "key", "value", "type", "atom", "id", "parent", "fullkey", "path"]
    tvf.register(spark)
    df.createOrReplaceTempView("tree_docs")
    one_by_one = spark.sql("select i, t.* from tree_docs, lateral json_tree(doc) t")
    got = sorted(map(tuple, tree.select(*names).collect()), key=lambda r: (r[0], r[5]))
    assert got == sorted(map(tuple, one_by_one.select(*names).collect()), key=lambda r: (r[0], r[5]))
    assert [r[2] for r in got if r[0] == 0] == ['{"a":[1,{"b c":null}],"z":"é","f":[1.5,1000.0,true]}', '[1,{"b c":null}]', "1", '{"b c":null}', None, "é", "[1.5,1000.0,true]", "1.5", "1000.0", "true"]
    monkeypatch.setattr(tvf, "ROWS", 7)
    parts = list(tvf._tree_batches(docs))
    assert max(len(at) for at, _ in parts) == 7
    assert [(k, *r.values()) for at, b in parts for k, r in zip(at.to_pylist(), b.to_pylist(), strict=True)] == got
    assert tvf.tree(df.where("doc is null"), "doc").count() == 0


def test_sales_top_two(spark):
    rows = [("Alice", "North", 34), ("Frank", "South", 22), ("Grant", "South", 14), ("Heidi", "South", 35), ("Chris", "North", 43), ("Edith", "South", 30)]
    df = spark.createDataFrame(rows, "emp string, region string, total int")
    from lakefold.operators.windows import top_n

    assert {r["emp"] for r in top_n(df, ["region"], [F.desc("total")], 2).collect()} == {"Chris", "Alice", "Heidi", "Edith"}


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "s int, t int")
    found = recursion.closure(edges, spark.createDataFrame([(1,)], "id int"), "s", "t").collect()
    assert {(r["id"], r["depth"]) for r in found} == {(1, 0), (2, 1), (3, 2)}


def test_closure_says_when_it_is_not_whole(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(4)], "s int, t int")
    roots = spark.createDataFrame([(0,)], "id int")
    assert {r["id"] for r in recursion.closure(chain, roots, "s", "t", 4).collect()} == set(range(5))
    with pytest.raises(RuntimeError):
        recursion.closure(chain, roots, "s", "t", 3)


def test_asof_join_by_brute_force(spark):
    left = [(k % 3, k * 7 % 50, k) for k in range(60)]
    right = [(k % 3, k * 11 % 50, k) for k in range(40)]
    a, b = spark.createDataFrame(left, "g int, t int, i int"), spark.createDataFrame(right, "g int, u int, v int")
    found = {(r["i"]): r["u"] for r in R.asof_join(a, b, ["g"], "t", "u", ["u", "v"]).collect()}
    assert found == {i: max((u for h, u, _ in right if h == g and u <= t), default=None) for g, t, i in left}


def test_compound_is_left_associative(spark):
    one = lambda k: spark.createDataFrame([(k,)], "x int")
    assert R.compound(one(1), ("union", one(2)), ("intersect", one(3))).count() == 0


def test_aggregates(spark):
    df = spark.createDataFrame([(10,), (20,), (30,), (40,), (None,)], "x int")
    row = df.agg(A.percentile_disc(F.col("x"), 0.8).alias("d"), A.total(F.col("x")).alias("t"), A.group_concat(F.col("x"), "-").alias("g"), A.json_group_array(F.col("x"), [F.col("x")]).alias("j")).first()
    assert (row["d"], row["t"], row["g"]) == (30, 100.0, "10-20-30-40")
    assert df.where("x > 99").agg(A.total(F.col("x")).alias("t"), A.group_concat(F.col("x")).alias("g")).first()[:] == (0.0, None)


def test_stems():
    words = "caresses ponies cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing filing happy sky relational conditional vietnamization triplicate formative electrical goodness revival adoption controlling psychology possibly"
    stems = "caress poni cat feed agre plaster motor sing conflat troubl size hop fall hiss file happi sky relat condit vietnam triplic form electr good reviv adopt control psycholog possibl"
    assert [T.stem(w) for w in words.split()] == stems.split()


def test_each_word_of_a_batch_is_stemmed_once(spark, monkeypatch):
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(T, "_remembered", lambda w: calls.append(w) or T.stem(w))
    rows = [["running", "cats", "running"], None, [], ["ponies", "x", "cats"], ["r" * 50 + "ing"]] * 300
    wanted = [r and [T.stem(w) for w in r] for r in rows]
    assert T._stemmed_lists(pa.array(rows, pa.list_(pa.string()))).to_pylist() == wanted
    assert sorted(calls) == ["cats", "ponies", "running", "x"]
    assert T._stemmed_lists(pa.array(rows, pa.list_(pa.string()))[3:8]).to_pylist() == wanted[3:8]
    docs = spark.createDataFrame([(k, " ".join(r) if r is not None else None) for k, r in enumerate(rows[:5])], "i int, text string")
    assert [r["t"] for r in docs.orderBy("i").select(T.tokens(F.col("text"), "porter").alias("t")).collect()] == wanted[:5]


def test_search_and_excerpts(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "a quick, lazy dog and a fox"), (3, None)], "id int, text string")
    post = T.postings(docs, "id", "text")
    ids = lambda q: sorted(r["id"] for r in T.search(post, q).collect())
    assert ids('"quick brown"') == [1] and ids("quick fox NOT dog") == [1] and ids("NEAR(quick fox, 1)") == [1] and ids("la* OR brown") == [1, 2]
    assert value(spark, T.highlight(F.lit("The cat, the end"), ["the"])) == "[The] cat, [the] end"
    assert value(spark, T.snippet(F.lit("a b c d e f g"), ["e", "f"], 3)) == "...d [e] [f]..."


def _window(text, wanted, size):
    """By brute force: each window of size words, or all of a shorter text."""
    import re

    words = list(re.finditer(r"\w+", text))
    if not words:
        return text
    starts = range(max(1, len(words) - size + 1))
    low = [w.group().lower() for w in words]
    at = max(starts, key=lambda k: (len(wanted & set(low[k : k + size])), -k))
    some = words[at : at + size]
    out = text[some[0].start() : some[-1].end()]
    for w in reversed(some):
        a, b = w.start() - some[0].start(), w.end() - some[0].start()
        out = out[:a] + (f"[{out[a:b]}]" if out[a:b].lower() in wanted else out[a:b]) + out[b:]
    return "..." * (at > 0) + out + "..." * (at + size < len(words))


def test_snippets_by_brute_force_without_python_workers(spark):
    import random

    pick = random.Random(5)
    texts = ["".join(pick.choice(["a", "This", "from", "FROM", "fromm", "é_1", "zß", "𝒳", "日本"]) + pick.choice([" ", ", ", "\n-- ", ".", "\u0301 "]) for _ in range(pick.randint(0, 60))) for _ in range(300)]
    texts += ["", "...", "  from", "a " * 40 + "this  from.", "x"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string")
    for wanted, size in ((["this", "from"], 16), (["from", "from", "zß"], 3), (["a"], 1), ([], 4)):
        made = df.select("i", T.snippet(F.col("text"), wanted, size).alias("s"))
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
        assert {r["i"]: r["s"] for r in made.collect()} == {-1: None} | {k: _window(t, set(wanted), size) for k, t in enumerate(texts)}


def test_fts_snippet_marks_whole_texts(spark, tmp_path):
    import re

    from lakefold.plans import catalog

    rows = [(1, "x " * 40 + "the end. The other, then THE"), (2, "the" + " y" * 50 + " the"), (3, "none " * 30), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["marked"] for r in catalog.QUERIES["fts_snippet"](spark, str(tmp_path)).collect()}
    assert found == {d: re.sub(r"(?i)\b(the)\b", r"[\1]", t) for d, t in rows}


def test_query_words_go_through_the_tokenizer(spark):
    docs = spark.createDataFrame([(1, "She runs to the café", "Running late"), (2, "the run", "of the mill, naïve psychology"), (3, "", None), (4, "a b x c", "c b a")], "id int, text string, title string")
    ids = lambda post, q, **k: sorted(r["id"] for r in T.search(post, q, **k).collect())
    plain, porter = (T.postings(docs, "id", ["text", "title"], kind) for kind in ("unicode", "porter"))
    names = {"columns": ["text", "title"]}
    assert ids(plain, "Café") == [1] and ids(plain, "NAIVE") == [2] and ids(plain, "running") == [1]
    assert ids(porter, "running", kind="porter") == [1, 2] and ids(porter, "psychological OR café", kind="porter") == [1, 2]
    assert ids(plain, "title: run*", **names) == [1] and ids(plain, "-title: run*", **names) == [1, 2] and ids(plain, "{text title}: mill", **names) == [2]
    assert ids(plain, "NEAR(a b c, 1)", **names) == [4] and ids(plain, "text: NEAR(a b c, 1)", **names) == [] and ids(plain, "text: NEAR(a b c, 2)", **names) == [4]
    assert ids(plain, 'NEAR("a b" c, 1)') == [4] and ids(plain, 'NEAR("a b" c, 0)') == [] and ids(plain, "a + b + x*") == [4]
    assert ids(plain, "late AND the NOT mill") == [1] and ids(plain, "^the") == [2] and ids(plain, "text: ^she", **names) == [1]
    assert [r["id"] for r in T.search_texts(docs, "id", ["text", "title"], '"to the" title: late').collect()] == [1]
    for wrong in ("(a", "a OR", "none: a", ""):
        with pytest.raises(ValueError):
            T.search(plain, wrong)
    both = spark.createDataFrame([(1, "x y", "z"), (2, "z", "x"), (3, "q", "q")], "id int, a string, b string")
    score = lambda w: {r["id"]: r["score"] for r in T.bm25(T.postings(both, "id", ["a", "b"]), ["x"], weights=w).collect()}
    assert set(score(None)) == {1, 2} and score([10.0, 1.0])[1] < score(None)[1] and score([10.0, 1.0])[2] == score(None)[2]
    assert [r["term"] for r in T.postings(spark.createDataFrame([(1, "c++ a_b")], "id int, t string"), "id", "t", tokenchars="+", separators="").collect()] == ["c++", "a", "b"]


def test_excluding_by_brute_force(spark):
    rows = [(g, k * 5 % 7, k) for g in range(3) for k in range(20)]
    df = spark.createDataFrame(rows, "g int, o int, x int")
    for start, end in ((-2, 1), (-1, 0), (1, 2), (0, 0)):
        for kind in ("none", "current", "group", "ties"):
            got = {(r["g"], r["x"]): r["m"] for r in W.extreme_excluding(df, F.min, F.col("x"), "m", ["g"], ["o"], start, end, kind, ["x"]).collect()}
            for g, o, x in rows:
                peers = sorted({p for h, p, _ in rows if h == g})
                frame = [(p, y) for h, p, y in rows if h == g and start <= peers.index(p) - peers.index(o) <= end]
                left = [y for p, y in frame if kind == "none" or kind == "current" and y != x or kind == "group" and p != o or kind == "ties" and (p != o or y == x)]
                assert got[g, x] == min(left, default=None), (kind, start, end)


def test_changes_with_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "keep"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (5, "p", 1), (5, "q", 2), (None, "n", 1), (None, "n", 1)], "k int, v string, at int")
    rows = lambda df: sorted(((r["k"] or 0, r["v"]) for r in df.collect()))
    nulls = [(0, "keep"), (0, "n"), (0, "n")]
    assert rows(C.upsert(old, new, ["k"], {"v": F.concat("old.v", "new.v")}, F.col("at"))) == sorted([*nulls, (1, "a"), (2, "by"), (5, "q")])
    assert rows(C.upsert(old, new, ["k"])) == sorted([*nulls, (1, "a"), (2, "b"), (5, "p")])
    assert rows(C.replace_into(old, new, ["k"], F.col("at"))) == sorted([*nulls, (1, "a"), (2, "y"), (5, "q")])
    assert rows(C.insert_or_ignore(old, new, ["k"], F.col("at"))) == sorted([*nulls, (1, "a"), (2, "b"), (5, "p")])
    assert C.insert_or_fail(old, new.where("k is null"), ["k"]).count() == 5
    with pytest.raises(Exception, match="UNIQUE"):
        C.insert_or_fail(old, new, ["k"]).collect()
    assert rows(C.update_from(old, new, ["k"], {"v": F.col("src.v")}, F.col("at"))) == [(0, "keep"), (1, "a"), (2, "x")]


def test_changesets(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    a, b, c = make([(1, "a"), (2, "b"), (3, "c")]), make([(1, "A"), (3, "c"), (4, "d")]), make([(1, "a"), (2, "B"), (4, "D")])
    rows = lambda df: sorted(map(tuple, df.select("k", "v").collect()))
    one, two = C.diff(a, b, ["k"]), C.diff(b, c, ["k"])
    joint = C.concat_changes(one, two, ["k"])
    assert rows(C.apply_changes(a, joint, ["k"])) == rows(c) and rows(C.apply_changes(c, C.invert(joint), ["k"])) == rows(a)
    assert {r["k"]: r["op"] for r in joint.collect()} == {2: "update", 3: "delete", 4: "insert"}
    assert rows(C.apply_changes(a, C.patchset(one, ["k"]), ["k"])) == rows(b)
    other = make([(1, "changed"), (4, "there")])
    assert rows(C.apply_changes(other, one, ["k"], "omit")) == [(1, "changed"), (4, "there")]
    assert rows(C.apply_changes(other, one, ["k"], "replace")) == [(1, "A"), (4, "d")]
    with pytest.raises(Exception, match="conflict"):
        C.apply_changes(other, one, ["k"], "abort").collect()
    assert rows(C.returning(a, b, ["k"], "delete")) == [(2, "b")] and rows(C.returning(a, b, ["k"], "update")) == [(1, "A")]


def test_recursive_queue(spark):
    seed = spark.createDataFrame([(0, 1), (0, 1)], "level int, x int")
    step = lambda r: r.where("x < 8").select(F.explode(F.array(F.struct((F.col("level") + 1).alias("level"), (F.col("x") * 2).alias("x")), F.struct((F.col("level") + 1).alias("level"), (F.col("x") * 2 + 1).alias("x")))).alias("s")).select("s.*")
    deep = recursion.recursive_queue(seed, step, [F.desc("level"), F.col("x")], 6, distinct=True).orderBy("_at").collect()
    assert [r["x"] for r in deep] == [1, 2, 4, 8, 9, 5]
    wide = recursion.recursive_queue(seed, step, [F.col("level"), F.col("x")], 4, offset=1).orderBy("_at").collect()
    assert [r["x"] for r in wide] == [1, 2, 2, 3]
    assert recursion.recursive_queue(seed.limit(0), step, [F.col("x")], 3).count() == 0


def test_joins_with_null_keys_and_long_intervals(spark):
    left = spark.createDataFrame([(None, 5, 1), (1, 5, 2), (1, None, 3)], "g int, t int, i int")
    right = spark.createDataFrame([(None, 3, 9), (1, 4, 7), (1, None, 8)], "g int, u int, v int")
    assert {r["i"]: r["v"] for r in R.asof_join(left, right, ["g"], "t", "u", ["v"]).collect()} == {1: None, 2: 7, 3: None}
    spans = [(k, float(k * 3), float(k * 3 + w)) for k, w in enumerate((1, 0, 5000, 40, -3, 2))] + [(9, None, 4.0)]
    points = [(k, float(k) / 2) for k in range(200)] + [(999, None)]
    got = R.interval_join(spark.createDataFrame(spans, "a int, s double, e double"), spark.createDataFrame(points, "b int, p double"), "s", "e", "p", 2.0).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a, s, e in spans for b, p in points if s is not None and p is not None and s <= p < e)
    none = spark.createDataFrame([], "a int, s double, e double")
    assert R.interval_join(none, spark.createDataFrame(points, "b int, p double"), "s", "e", "p", 2.0).count() == 0


def test_percentile_disc_by(spark):
    df = spark.createDataFrame([(g, (k * 7) % 13 if k else None) for g in (1, None) for k in range(30)] + [(3, None)], "g int, x int")
    for f in (0.0, 0.3, 0.8, 1.0):
        got = {r["g"]: r["p"] for r in A.percentile_disc_by(df, ["g"], F.col("x"), f, "p").collect()}
        values = sorted((k * 7) % 13 for k in range(1, 30))
        assert got == {1: values[int(f * 28)], None: values[int(f * 28)], 3: None}


def test_json_members(spark):
    rows = spark.createDataFrame([(1, '{"a":[1,2],"b c":"x"}'), (2, "[1.5,null,true]"), (3, "7"), (4, "{"), (5, None), (6, "[]")], "i int, doc string")
    got = [tuple(r) for r in tvf.each(rows, "doc").select("i", "key", "value", "type", "fullkey").collect()]
    assert sorted(got, key=str) == sorted([(1, "a", "[1,2]", "array", "$.a"), (1, "b c", "x", "text", '$."b c"'), (2, "0", "1.5", "real", "$[0]"), (2, "1", None, "null", "$[1]"), (2, "2", "true", "true", "$[2]"), (3, None, "7", "integer", "$")], key=str)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"say ""hi"""\n2,\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), {"x": "INTEGER", "y": "TEXT"}).collect()] == [(1, 'say "hi"'), (2, None)]
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips/a.zip", "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("two.txt", "22")
    assert sorted((r["name"], bytes(r["data"])) for r in tables.read_zip(spark, str(tmp_path / "zips")).collect()) == [("one.txt", b"1"), ("two.txt", b"22")]
    made = tables.create_table_as(spark.range(5), str(tmp_path / "t"))
    tables.insert_into(spark.range(5, 7), str(tmp_path / "t"))
    assert made.sparkSession.read.parquet(str(tmp_path / "t")).count() == 7


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    stream = E.tumbling(E.read_events(spark, str(tmp_path / "in"), 10))
    stream.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("tumbling").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in E.tumbling(events).collect()}


def test_band_join_by_brute_force(spark):
    numbers = [k * 37 % 101 - 50 for k in range(101)] + [7, 7, None, 2**53 + 1, 2**53 + 4, -(2**62) - 1, -(2**62) + 1]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x long")
    for most in (0, 1, 2, 5, 8):
        found = R.band_join(df.toDF("i", "a"), df.toDF("j", "b"), "a", "b", most).select("i", "j").collect()
        assert sorted(map(tuple, found)) == sorted((i, j) for i, x in enumerate(numbers) for j, y in enumerate(numbers) if x is not None and y is not None and abs(x - y) <= most)


def test_theta_join_compares_no_table_with_a_table(spark):
    from lakefold.plans import catalog

    plan = catalog.QUERIES["theta_join"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
