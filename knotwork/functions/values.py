"""Values as typed columns: literals, casts, comparison, calendar and decimal arithmetic."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.errors import QueryError

DURATION = "struct<months:int,days:int,nanos:bigint>"
ZONED = "struct<ts:timestamp,zone:string>"
DECIMAL = "decimal(38,19)"
SPARK_TYPE = {
    "boolean": "boolean", "integer": "bigint", "double": "double", "decimal": DECIMAL, "string": "string",
    "date": "date", "datetime": "timestamp_ntz", "datetime-tz": ZONED, "duration": DURATION,
}
NUMERIC = ("integer", "decimal", "double")
_DAY = 86_400_000_000_000


@dataclass
class Value:
    """A column and its value type."""

    col: Column
    kind: str


def spark_type(kind: str) -> str:
    return SPARK_TYPE.get(kind, "string")


def literal(value, kind: str) -> Value:
    if kind == "duration":
        m, d, n = value
        return Value(F.struct(F.lit(m).cast("int").alias("months"), F.lit(d).cast("int").alias("days"), F.lit(n).cast("bigint").alias("nanos")), kind)
    if kind == "datetime-tz":
        when, zone = value
        return Value(F.struct(F.to_utc_timestamp(F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp"), zone_name(zone)).alias("ts"), F.lit(zone).alias("zone")), kind)
    if kind == "datetime":
        return Value(F.lit(when_text(value)).cast("timestamp_ntz"), kind)
    return Value(F.lit(value).cast(spark_type(kind)), kind)


def when_text(value) -> str:
    return value.isoformat(sep=" ")


def zone_name(zone: str) -> str:
    return zone if ":" in zone or "/" in zone else f"{zone[:3]}:{zone[3:]}" if re.fullmatch(r"[+-]\d{4}", zone) else zone


def cast(v: Value, kind: str) -> Value:
    """The implicit casts: integer to decimal or double, decimal to double, date to datetime."""
    if v.kind == kind:
        return v
    if (v.kind, kind) in (("integer", "double"), ("integer", "decimal"), ("decimal", "double"), ("date", "datetime")):
        return Value(v.col.cast(spark_type(kind)), kind)
    raise QueryError(f"{v.kind} cannot become {kind}")


def together(kinds: list[str]) -> str | None:
    """The kind that all can be compared in, or None."""
    kinds = set(kinds)
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= set(NUMERIC):
        return "double" if "double" in kinds else "decimal"
    if kinds == {"date", "datetime"}:
        return "datetime"
    return None


def compare(op: str, a: Value, b: Value) -> Column:
    """Kinds that cannot be compared give false, also for !=."""
    if op in ("like", "contains"):
        if a.kind != "string" or b.kind != "string":
            raise QueryError(f"{op} needs strings")
        return F.contains(F.lower(a.col), F.lower(b.col))
    kind = together([a.kind, b.kind])
    if kind is None:
        return F.lit(False)
    x, y = cast(a, kind).col, cast(b, kind).col
    if kind == "duration" and op not in ("==", "!="):
        raise QueryError("durations have no order")
    if kind == "datetime-tz":
        x, y = x["ts"], y["ts"]
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def like(a: Value, pattern: str) -> Column:
    """Unanchored regular expression with Unicode classes; look-around and back references are not part of the dialect."""
    if a.kind != "string":
        raise QueryError("like needs a string")
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise QueryError("look-around and back references are not supported in like")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"like: {e}") from e
    return a.col.rlike("(?U)" + pattern)


def finite(col: Column, what: str) -> Column:
    bad = F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{what} is not a finite number")).cast("double")).otherwise(col)


# ------------------------------------------------------------------ decimals


@F.pandas_udf(T.DecimalType(38, 19))
def decimal_product(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact product, rounded half up at the 19th digit. Spark's own gives up digits of the scale."""
    q = Decimal(1).scaleb(-19)
    with localcontext() as c:
        c.prec = 80
        return pd.Series([None if x is None or y is None else (x * y).quantize(q, ROUND_HALF_UP) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.DecimalType(38, 19))
def decimal_quotient(a: pd.Series, n: pd.Series) -> pd.Series:
    q = Decimal(1).scaleb(-19)
    with localcontext() as c:
        c.prec = 80
        return pd.Series([None if x is None or not k else (x / Decimal(int(k))).quantize(q) for x, k in zip(a, n)], dtype=object)


def decimal_sum(op: str, a: Column, b: Column) -> Column:
    # of 18 digits before the point each, the sum keeps scale 19
    x, y = a.cast("decimal(37,19)"), b.cast("decimal(37,19)")
    return (x + y if op == "+" else x - y).cast(DECIMAL)


# ------------------------------------------------------------------ calendar


def duration(months: Column, days: Column, nanos: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), nanos.cast("bigint").alias("nanos"))


def plus_duration(when: Column, d: Column, sign: int) -> Column:
    """Months first (to the last day of the month at most), then days, then time."""
    months = F.make_ym_interval(F.lit(0), d["months"] * sign)
    days = F.make_dt_interval(d["days"] * sign)
    time = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (d["nanos"] * sign / F.lit(1_000_000_000)).cast("decimal(18,6)"))
    return when + months + days + time


def between(start: Column, end: Column, dates: bool) -> Column:
    """Whole months, then days, then nanoseconds from start to end; an error if end is earlier."""
    raw = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    months = F.when(start + F.make_ym_interval(F.lit(0), raw) > end, raw - 1).otherwise(raw)
    rest = start + F.make_ym_interval(F.lit(0), months)
    if dates:
        days, nanos = F.date_diff(end, rest.cast("date")), F.lit(0)
    else:
        span = end - rest
        days = F.extract(F.lit("DAY"), span)
        nanos = ((F.extract(F.lit("HOUR"), span) * 3600 + F.extract(F.lit("MINUTE"), span) * 60).cast("bigint") * 1_000_000_000 + (F.extract(F.lit("SECOND"), span) * 1_000_000_000).cast("bigint")).cast("bigint")
    early = F.raise_error(F.lit("a difference of times cannot be negative")).cast(DURATION)
    return F.when(end < start, early).otherwise(duration(months, days, nanos))


def _zone(name: str):
    from datetime import timedelta, timezone
    from zoneinfo import ZoneInfo

    m = re.fullmatch(r"([+-])(\d\d):?(\d\d)", name)
    if m:
        d = timedelta(hours=int(m[2]), minutes=int(m[3]))
        return timezone(d if m[1] == "+" else -d)
    return ZoneInfo(name)


def shift_zoned(ts, zone: str, months: int, days: int, nanos: int):
    """Calendar parts move the local time, the rest the instant. A local time that is skipped moves on by the gap; of one that comes twice the earlier counts."""
    from datetime import timedelta, timezone

    tz = _zone(zone)
    local = ts.replace(tzinfo=timezone.utc).astimezone(tz).replace(tzinfo=None)
    if months or days:
        k = local.year * 12 + local.month - 1 + months
        y, m = divmod(k, 12)
        day = local.day
        while True:
            try:
                local = local.replace(year=y, month=m + 1, day=day)
                break
            except ValueError:
                day -= 1
        local += timedelta(days=days)
        at = local.replace(tzinfo=tz).astimezone(timezone.utc)
    else:
        at = ts.replace(tzinfo=timezone.utc)
    return (at + timedelta(microseconds=nanos // 1000)).replace(tzinfo=None)


def zoned_shift(sign: int):
    @F.pandas_udf(T.TimestampType())
    def run(ts: pd.Series, zone: pd.Series, months: pd.Series, days: pd.Series, nanos: pd.Series) -> pd.Series:
        out = []
        for t, z, m, d, n in zip(ts, zone, months, days, nanos):
            out.append(None if t is None or z is None or pd.isna(t) or pd.isna(m) else shift_zoned(t.to_pydatetime().replace(tzinfo=None), z, sign * int(m), sign * int(d), sign * int(n)))
        return pd.Series(pd.to_datetime(out))

    return run
