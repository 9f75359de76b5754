"""Scalar expressions: syntax to typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from knotwork.errors import QueryError, Unsupported
from knotwork.functions import values as V
from knotwork.functions.values import Value
from knotwork.plans import ast as A

SCALARS = {"abs", "ceil", "floor", "round", "len", "min", "max"}


def variables(e) -> set[str]:
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, A.Bin):
        return variables(e.left) | variables(e.right)
    if isinstance(e, A.Call):
        return set().union(*map(variables, e.args)) if e.args else set()
    if isinstance(e, A.ListOf):
        return set().union(*map(variables, e.items)) if e.items else set()
    if isinstance(e, A.Index):
        return variables(e.of) | variables(e.at)
    if isinstance(e, A.Slice):
        return variables(e.of) | variables(e.low) | variables(e.high)
    return set()


def compile(e, lookup: Callable[[str], Value]) -> Value:
    """lookup gives the value of a variable."""
    if isinstance(e, A.Var):
        return lookup(e.name)
    if isinstance(e, A.Lit):
        return V.literal(e.value, e.kind)
    if isinstance(e, A.Bin):
        return binary(e.op, compile(e.left, lookup), compile(e.right, lookup))
    if isinstance(e, A.Call):
        return call(e.name, [compile(a, lookup) for a in e.args])
    if isinstance(e, A.ListOf):
        items = [compile(x, lookup) for x in e.items]
        kind = V.together([i.kind for i in items]) if items else None
        if kind is None:
            raise QueryError("a list needs items of one kind")
        return Value(F.array(*(V.cast(i, kind).col for i in items)), f"list {kind}")
    if isinstance(e, A.Index):
        of, at = compile(e.of, lookup), compile(e.at, lookup)
        return Value(F.get(of.col, _in_range(at.col, of.col, False).cast("int")), _item(of))
    if isinstance(e, A.Slice):
        of, low, high = (compile(x, lookup) for x in (e.of, e.low, e.high))
        a, b = _in_range(low.col, of.col, True), _in_range(high.col, of.col, True)
        return Value(F.slice(of.col, (a + 1).cast("int"), (b - a).cast("int")), of.kind)
    raise Unsupported(f"expression {e}")


def _item(v: Value) -> str:
    if not v.kind.startswith("list "):
        raise QueryError("only lists have items")
    return v.kind[5:]


def _in_range(at, of, end: bool):
    top = F.size(of) + (1 if end else 0)
    return F.when((at < 0) | (at >= top), F.raise_error(F.lit("list index out of range")).cast("bigint")).otherwise(at)


def binary(op: str, a: Value, b: Value) -> Value:
    kinds = (a.kind, b.kind)
    if kinds == ("string", "string") and op == "+":
        return Value(F.concat(a.col, b.col), "string")
    if all(k in V.NUMERIC for k in kinds):
        return _numeric(op, a, b)
    if op == "-" and all(k in ("date", "datetime") for k in kinds):
        if kinds == ("date", "date"):
            return Value(V.between(b.col, a.col, True), "duration")
        return Value(V.between(V.cast(b, "datetime").col, V.cast(a, "datetime").col, False), "duration")
    if op in "+-" and kinds == ("datetime", "duration"):
        return Value(V.plus_duration(a.col, b.col, 1 if op == "+" else -1), "datetime")
    if op in "+-" and kinds == ("datetime-tz", "duration"):
        moved = V.zoned_shift(1 if op == "+" else -1)(a.col["ts"], a.col["zone"], b.col["months"], b.col["days"], b.col["nanos"])
        return Value(F.struct(moved.alias("ts"), a.col["zone"].alias("zone")), "datetime-tz")
    if op == "-" and kinds == ("datetime-tz", "datetime-tz"):
        local = [F.from_utc_timestamp(x.col["ts"], a.col["zone"]).cast("timestamp_ntz") for x in (b, a)]
        return Value(V.between(local[0], local[1], False), "duration")
    if op in "+-" and kinds == ("duration", "duration"):
        parts = [a.col[f] + b.col[f] if op == "+" else a.col[f] - b.col[f] for f in ("months", "days", "nanos")]
        out = V.duration(*parts)
        if op == "-":
            low = F.least(*(p.cast("bigint") for p in parts)) < 0
            out = F.when(low, F.raise_error(F.lit("a duration cannot be negative")).cast(V.DURATION)).otherwise(out)
        return Value(out, "duration")
    raise QueryError(f"{a.kind} {op} {b.kind} has no meaning")


def _numeric(op: str, a: Value, b: Value) -> Value:
    kind = V.together([a.kind, b.kind])
    if op in "/^" or op == "%" and kind == "decimal":
        x, y = V.cast(a, "double").col, V.cast(b, "double").col
        if op == "/":
            return Value(V.finite(x / y, "quotient"), "double")
        if op == "^":
            return Value(F.power(x, y), "double")
        return Value(F.pmod(x, F.abs(y)), "double")
    x, y = V.cast(a, kind).col, V.cast(b, kind).col
    if op == "%":
        return Value(F.pmod(x, F.abs(y)), kind)
    if kind == "decimal":
        return Value(V.decimal_product(x, y) if op == "*" else V.decimal_sum(op, x, y), kind)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], kind)


def call(name: str, args: list[Value]) -> Value:
    if name not in SCALARS:
        raise QueryError(f"no function {name}")
    if len(args) != (2 if name in ("min", "max") else 1):
        raise QueryError(f"{name} has another number of arguments")
    a = args[0]
    if name == "len":
        if a.kind != "string":
            raise QueryError("len needs a string")
        return Value(F.length(a.col).cast("bigint"), "integer")
    if any(x.kind not in V.NUMERIC for x in args):
        raise QueryError(f"{name} needs numbers")
    if name == "abs":
        return Value(F.abs(a.col), a.kind)
    if name in ("ceil", "floor", "round"):
        if a.kind == "integer":
            raise QueryError(f"{name} of an integer")
        f = {"ceil": F.ceil, "floor": F.floor, "round": lambda c: F.bround(c, 0)}[name]
        return Value(f(a.col).cast("bigint"), "integer")
    if args[0].kind != args[1].kind:
        raise QueryError(f"{name} needs two numbers of one kind")
    x, y = args[0].col, args[1].col
    if a.kind == "double":  # a number beats NaN
        x, y = F.when(F.isnan(x), y).otherwise(x), F.when(F.isnan(y), x).otherwise(y)
    return Value((F.least if name == "min" else F.greatest)(x, y), a.kind)
