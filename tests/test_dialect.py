from __future__ import annotations

import pytest

from lakefold.plans.dialect import query, rewrite


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("select 1 == 1 as x", [(True,)]),
        ("select 'ABC' like 'a%' as x, 'abc' glob 'a[bx]?' as y, 'abc' regexp 'b' as z", [(True, True, True)]),
        ("select \"x y\" from (values (1), (2), (3)) as t(\"x y\") order by 1 limit 1, 5", [(2,), (3,)]),
        ("select x from (values (1), (null)) as t(x) where x notnull limit -1", [(1,)]),
        ("select x is 1 as a, x is not 1 as b from (values (null)) as t(x)", [(False, True)]),
        ("select iif(1 < 2, 'it''s == ?', 'n') as x -- comment\n", [("it's == ?",)]),
        ("select total(x) as t from (values (1), (2)) as t(x) where x > 9", [(0.0,)]),
    ],
)
def test_rewrites(spark, text, expected):
    assert [tuple(r) for r in query(spark, text).collect()] == expected


def test_parameters(spark):
    assert query(spark, "select ?2 + ?1 * 10 as x", [1, 2]).first()["x"] == 12
    assert query(spark, "select @a + $b as x", {"a": 1, "b": 2}).first()["x"] == 3
    assert query(spark, "select ? as x", [7]).first()["x"] == 7
    assert "indexed" not in rewrite("select * from t indexed by i where a = 'indexed by'").replace("'indexed by'", "")
