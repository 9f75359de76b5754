import datetime as dt
from decimal import Decimal

import pytest

from knotwork.errors import QueryError
from knotwork.plans.parser import parse
from knotwork.schema import Catalog
from knotwork.session import query
from knotwork.sources.store import EdgeStore


def value(spark, expr):
    c = Catalog()
    df = query(spark, c, EdgeStore(spark, c, {}), f"match let $x = {expr};")
    out = df.first()[0]
    return tuple(out) if hasattr(out, "asDict") else out


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("1 + 2 * 3", 7), ("7 / 2", 3.5), ("-7 % 3", 2), ("-7 % -3", 2), ("2 ^ 10", 1024.0), ("7.5 % 2.0", 1.5), ("1 + 0.5", 1.5),
        ("round(2.5)", 2), ("round(3.5)", 4), ("ceil(1.2)", 2), ("floor(-1.2)", -2), ("abs(-3)", 3), ('len("añb")', 3), ("min(1, 2)", 1), ("max(1.5, 2.5)", 2.5), ('"a" + "b"', "ab"),
        ("0.1dec + 0.2dec", Decimal("0.3000000000000000000")), ("1.5dec * 1.5dec", Decimal("2.2500000000000000000")), ("2 * 0.0000000000000000001dec", Decimal("0.0000000000000000002")),
        ("0.0000000001dec * 0.0000000005dec", Decimal("0.0000000000000000001")), ("1.0dec / 4", 0.25), ("3dec - 1", Decimal("2.0000000000000000000")),
        ("[1, 2, 3][0]", 1), ("[1, 2, 3][1..3]", [2, 3]), ("(1 + 2) * 3", 9),
        ("2024-01-31 - 2023-12-31", (1, 0, 0)), ("2024-03-15 - 2024-01-31", (1, 15, 0)), ("2024-01-31T00:00:00 + P1M", dt.datetime(2024, 2, 29)), ("2024-02-29T10:00:00 - P1DT1H", dt.datetime(2024, 2, 28, 9)),
        ("2024-03-01T12:00:00 - 2024-01-31T13:30:00", (1, 0, 22 * 3600 * 10**9 + 30 * 60 * 10**9)), ("P1M + P2DT3S", (1, 2, 3 * 10**9)), ("P3M - P1M", (2, 0, 0)),
    ],
)
def test_expressions(spark, expr, want):
    assert value(spark, expr) == want


@pytest.mark.parametrize("expr", ["true + 1", "2024-01-01 + P1D", '"a" - "b"', "P1M * 2", "len(1)", "round(1)", "min(1, 2.0)", '[1, "a"]', "nothing(1)"])
def test_type_errors(spark, expr):
    with pytest.raises(QueryError):
        value(spark, expr)


@pytest.mark.parametrize("expr", ["9223372036854775807 + 1", "1 / 0", "2023-01-01 - 2024-01-01", "P1M - P2M", "[1][3]"])
def test_run_time_errors(spark, expr):
    with pytest.raises(Exception):  # noqa: B017
        value(spark, expr)


def test_zoned_arithmetic_follows_the_calendar():
    from knotwork.functions.values import shift_zoned

    spring = dt.datetime(2024, 3, 30, 1, 30)  # 02:30 in Paris; a day later that time is skipped
    assert shift_zoned(spring, "Europe/Paris", 0, 1, 0) == dt.datetime(2024, 3, 31, 1, 30)
    assert shift_zoned(spring, "Europe/Paris", 0, 0, 24 * 3600 * 10**9) == dt.datetime(2024, 3, 31, 1, 30)
    assert shift_zoned(dt.datetime(2024, 1, 31, 12), "+0200", 1, 0, 0) == dt.datetime(2024, 2, 29, 12)


def test_comparisons_of_different_kinds_are_false(spark):
    c = Catalog()
    s = EdgeStore(spark, c, {})
    for cond, n in (('1 == "a"', 0), ('1 != "a"', 0), ("1 == 1.0", 1), ("2024-01-01 == 2024-01-01T00:00:00", 1), ("P1M == P1M", 1), ('"abc" contains "B"', 1), ('"abc" like "^a.c$"', 1), ('"abc" like "x"', 0)):
        assert query(spark, c, s, f"match let $x = 1; {cond};").count() == n, cond
    with pytest.raises(QueryError):
        query(spark, c, s, "match let $x = 1; P1M < P2M;")


def test_reducers_on_nothing(spark):
    c = Catalog.of("define attribute v value integer; entity e, owns v @card(0..);")
    s = EdgeStore(spark, c, {})
    assert tuple(query(spark, c, s, "match $e isa e, has v $v; reduce $n = count, $s = sum($v), $m = min($v), $a = mean($v), $d = median($v), $t = std($v);").first()) == (0, 0, None, None, None, None)
    assert query(spark, c, s, "match $e isa e, has v $v; reduce $n = count groupby $e;").count() == 0


def test_decimal_reducers(spark):
    c = Catalog.of("define attribute v value decimal; entity e, owns v @card(0..);")
    s = EdgeStore(spark, c, {"has/v": spark.createDataFrame([("e", k, Decimal(x)) for k, x in enumerate(("0.1", "0.2", "0.4"))], "owner_type string, owner bigint, value decimal(38,19)"), "thing/e": spark.createDataFrame([(k,) for k in range(3)], "iid bigint")})
    got = query(spark, c, s, "match $e isa e, has v $v; reduce $s = sum($v), $m = mean($v), $d = median($v), $lo = min($v);").first()
    assert (got.s, got.d, got.lo) == (Decimal("0.7"), Decimal("0.2"), Decimal("0.1")) and abs(got.m - Decimal("0.2333333333333333333")) < Decimal("1e-18")


def test_parse_is_cached():
    from knotwork.session import parsed

    assert parsed("match $x isa a;") is parsed("match $x isa a;")
    assert parse("match $x isa a;") == parsed("match $x isa a;")
