from datetime import datetime
from decimal import Decimal

import pytest

from conjunx.plans.builder import Select, Value
from conjunx.plans.dialect import DialectError, parse, statements
from conjunx.plans.model import Cmp, Col, Interval, Item, Lit, Table


def test_parse_all_parts():
    q = parse("select distinct a.x AS y, b.* from R a, S as b where a.x >= -5 and 3 < b.z and a.x != b.z order by a.x asc, b.z;")
    assert q.tables == (Table("R", "a"), Table("S", "b"))
    assert q.items == (Item(Col("a", "x"), "y"), Item(Col("b", "*")))
    assert q.where == (Cmp(Col("a", "x"), ">=", Lit(-5)), Cmp(Col("b", "z"), ">", Lit(3)), Cmp(Col("a", "x"), "<>", Col("b", "z")))
    assert q.order == (Col("a", "x"), Col("b", "z"))
    assert q.distinct


def test_literals():
    q = parse("SELECT x FROM t WHERE a = 'it''s' AND b < 1.50 AND c >= TIMESTAMP '2020-01-02 03:04:05' AND d = TRUE AND e > +7")
    assert [c.right.value for c in q.where] == ["it's", Decimal("1.50"), datetime(2020, 1, 2, 3, 4, 5), True, 7]


def test_identifiers_that_hold_keywords():
    q = parse('SELECT BRAND, "order" FROM ANDES WHERE BRAND = 1')
    assert q.items == (Item(Col(None, "BRAND")), Item(Col(None, "order")))


@pytest.mark.parametrize(
    "text",
    [
        "SELECT x FROM t WHERE a = 1 OR b = 2",
        "SELECT x FROM t WHERE NOT a = 1",
        "SELECT x FROM t WHERE a IN (1, 2)",
        "SELECT x FROM t WHERE a BETWEEN 1 AND 2",
        "SELECT x FROM t WHERE a LIKE 'x%'",
        "SELECT x FROM t WHERE a IS NULL",
        "SELECT x FROM t WHERE a + 1 = 2",
        "SELECT x FROM t WHERE (a = 1)",
        "SELECT x FROM t GROUP BY x",
        "SELECT x FROM t LIMIT 3",
        "SELECT x FROM t ORDER BY x DESC",
        "SELECT x FROM t JOIN u ON t.a = u.a",
        "SELECT x FROM t LEFT JOIN u ON t.a = u.a",
        "SELECT count(x) FROM t",
        "SELECT x FROM (SELECT x FROM t)",
        "SELECT x FROM t UNION SELECT x FROM u",
        "INSERT INTO t VALUES (1)",
        "SELECT FROM t",
        "SELECT x",
        "SELECT x FROM t WHERE",
        "SELECT x FROM t; SELECT y FROM t",
        "SELECT x FROM t WHERE a = #",
        "SELECT x FROM t WHERE d = DATE 'never'",
        "",
    ],
)
def test_refused(text):
    with pytest.raises(DialectError):
        parse(text)


def test_statements():
    assert statements("SELECT ';' FROM t; -- one; two\n /* ; */ SELECT 1;;\n") == ["SELECT ';' FROM t", "-- one; two\n /* ; */ SELECT 1"]


def test_builder_equals_text():
    built = Select("o.k", n="c.name").from_("orders", "o").join("customer", "c", ("o.ck", "c.k")).where("c.name", "<>", Value("x")).where(5, ">", "o.k").order_by("o.k").distinct()
    assert built.query == parse("SELECT DISTINCT o.k, c.name AS n FROM orders o, customer c WHERE o.ck = c.k AND c.name <> 'x' AND o.k < 5 ORDER BY o.k")
    with pytest.raises(DialectError):
        Select("x").where("x", "~", 1)


def test_interval():
    i = Interval().narrowed(">", 5).narrowed(">=", 9).narrowed("<", 20)
    assert (i.low, i.low_open, i.high, i.high_open) == (9, False, 20, True)
    assert i.narrowed("<=", 9).point and not i.empty
    assert i.narrowed("<", 9).empty
    assert Interval().narrowed("=", 3).narrowed(">", 5).empty
    assert Interval().narrowed(">", 5).narrowed("<=", 5).empty
