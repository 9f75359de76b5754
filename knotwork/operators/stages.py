"""Pipeline stages on rows: select, sort, offset, limit, require, distinct, reduce. Inside a function each works by call."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions import values as V
from knotwork.plans import ast as A
from knotwork.plans.plan import Info, Plan

_ORDERED = {"integer", "double", "decimal", "string", "date", "datetime", "datetime-tz"}


def _check(plan: Plan, names) -> None:
    for v in names:
        if v not in plan.vars:
            raise QueryError(f"${v} is not bound")


def select(plan: Plan, s: A.Select) -> Plan:
    _check(plan, [v.name for v in s.vars])
    out = plan.only([v.name for v in s.vars])
    out.vars = {v.name: plan.vars[v.name] for v in s.vars}
    out.order = [k for k in plan.order if k[0] in out.vars]
    return out


def sort_columns(plan: Plan, keys) -> list:
    out = []
    for v, down in keys:
        col = F.col(f"`{v}`")
        if plan.vars[v].value == "datetime-tz":
            col = col["ts"]
        out.append(col.desc_nulls_last() if down else col.asc_nulls_first())
    return out


def sort(plan: Plan, s: A.Sort) -> Plan:
    keys = [(v.name, down) for v, down in s.keys]
    _check(plan, [v for v, _ in keys])
    for v, _ in keys:
        i = plan.vars[v]
        if i.value == "duration" or i.kind == "list":
            raise QueryError(f"${v} has no order")
    out = plan if plan.hidden else plan.with_df(plan.df.orderBy(*sort_columns(plan, keys)))
    return Plan(out.df, out.vars, out.hidden, keys, plan.unique)


def _ranked(plan: Plan):
    cols = sort_columns(plan, plan.order) + [F.col(f"`{c}`") for c in plan.columns() if c not in [k for k, _ in plan.order]]
    return F.row_number().over(Window.partitionBy(*(F.col(f"`{h}`") for h in plan.hidden)).orderBy(*cols))


def offset(plan: Plan, s: A.Offset) -> Plan:
    if plan.hidden:
        return plan.with_df(plan.df.withColumn("#n", _ranked(plan)).where(F.col("#n") > s.n).drop("#n"))
    return plan.with_df(plan.df.offset(s.n))


def limit(plan: Plan, s: A.Limit) -> Plan:
    if plan.hidden:
        return plan.with_df(plan.df.withColumn("#n", _ranked(plan)).where(F.col("#n") <= s.n).drop("#n"))
    return plan.with_df(plan.df.limit(s.n))


def require(plan: Plan, s: A.Require) -> Plan:
    names = [v.name for v in s.vars]
    _check(plan, names)
    vars = {v: Info(i.kind, i.types, i.value, False) if v in names else i for v, i in plan.vars.items()}
    return Plan(plan.df.where(" AND ".join(f"`{v}` IS NOT NULL" for v in names)), vars, plan.hidden, plan.order)


def distinct(plan: Plan, _: A.Distinct) -> Plan:
    return Plan(plan.df.distinct(), plan.vars, plan.hidden, plan.order, True)


def aggregate(plan: Plan, name: str, v: str | None):
    """(column, value type) of a reducer."""
    if name == "count":
        return (F.count(F.lit(1)) if v is None else F.count(F.col(f"`{v}`"))), "integer"
    _check(plan, [v])
    i = plan.vars[v]
    kind = i.value
    numeric = kind in V.NUMERIC
    if i.kind in ("object", "type", "list") or kind not in _ORDERED or name in ("sum", "mean", "median", "std") and not numeric:
        raise QueryError(f"{name} of ${v} ({kind or i.kind}) has no meaning")
    col = F.col(f"`{v}`")
    if name == "sum":
        zero = F.lit(0).cast(V.spark_type(kind))
        return F.coalesce(F.sum(col.cast("decimal(28,19)") if kind == "decimal" else col).cast(V.spark_type(kind)), zero), kind
    if name in ("min", "max"):
        f = F.min if name == "min" else F.max
        if kind == "datetime-tz":
            f = F.min_by if name == "min" else F.max_by
            return f(col, col["ts"]), kind
        return f(col), kind
    if name == "mean":
        if kind == "decimal":
            return V.decimal_quotient(F.sum(col.cast("decimal(28,19)")).cast(V.DECIMAL), F.count(col)), kind
        return F.avg(col.cast("double")), "double"
    if name == "median":
        if kind == "decimal":  # exact: the middle of the sorted values
            values = F.sort_array(F.collect_list(col))
            n = F.count(col)
            pair = F.get(values, ((n - 1) / 2).cast("int")) + F.get(values, (n / 2).cast("int"))
            return V.decimal_quotient(pair.cast(V.DECIMAL), F.lit(2)), kind
        return F.median(col.cast("double")), "double"
    if name == "std":
        return F.stddev_samp(col.cast("double")), "double"
    raise QueryError(f"no reducer {name}")


def reduce(plan: Plan, s: A.Reduce) -> Plan:
    by = [v.name for v in s.by]
    _check(plan, by)
    aggs, vars = [], {v: plan.vars[v] for v in by}
    for out, name, v in s.assign:
        col, kind = aggregate(plan, name, v.name if v else None)
        aggs.append(col.alias(out.name))
        vars[out.name] = Info("value", value=kind, optional=name not in ("count", "sum"))
    groups = [F.col(f"`{c}`") for c in [*(plan.columns(*by) if by else []), *plan.hidden]]
    return Plan(plan.df.groupBy(*groups).agg(*aggs) if groups else plan.df.agg(*aggs), vars, plan.hidden, unique=True)


STAGES = {A.Select: select, A.Sort: sort, A.Offset: offset, A.Limit: limit, A.Require: require, A.Distinct: distinct, A.Reduce: reduce}
MOST = 1000


def run(compiler, plan: Plan | None, stages) -> Plan:
    """Read stages, one after the other."""
    if len(stages) > MOST:
        raise QueryError(f"more than {MOST} stages")
    for s in stages:
        if isinstance(s, A.Match):
            plan = compiler.match(plan, s.pattern)
        elif type(s) in STAGES:
            plan = STAGES[type(s)](plan if plan is not None else Plan(compiler.spark.range(1).select(), {}), s)
        else:
            raise QueryError(f"{type(s).__name__.lower()} cannot stand here")
    return plan if plan is not None else Plan(compiler.spark.range(1).select(), {})
