"""Documents: every key of a fetch becomes a column, nested objects and lists become structs and arrays.

Subqueries and functions run once for the distinct values of the variables that they take from
outside, and are joined back to the rows.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions import expressions as E
from knotwork.functions import values as V
from knotwork.operators import calls, stages
from knotwork.plans import ast as A
from knotwork.plans.plan import Plan, tag


def fetch(c, plan: Plan, fields, carry: bool = False) -> DataFrame:
    """One column for each key; with carry the plan's hidden columns too."""
    state = _Rows(c, plan)
    cols = [state.field(x).alias(k) for k, x in fields]
    return state.plan.df.select(*cols, *(F.col(f"`{h}`") for h in plan.hidden if carry))


def documents(df: DataFrame) -> DataFrame:
    """Rows of a fetch as JSON texts; what is missing is null."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("document"))


class _Rows:
    def __init__(self, c, plan: Plan):
        self.c, self.plan, self.n = c, plan, 0
        self.bags: dict[tuple[str, str], str] = {}

    def field(self, x):
        if isinstance(x, A.FetchObject):
            return F.struct(*(self.field(v).alias(k) for k, v in x.fields))
        if isinstance(x, A.FetchLabel):
            from knotwork.plans.infer import resolve

            return F.lit(resolve(self.c.catalog, x.label))
        if isinstance(x, A.FetchExpr):
            return self.expression(x.expr)
        if isinstance(x, A.FetchAttr):
            return self.attribute(x.var.name, x.attr, x.many)
        if isinstance(x, A.FetchAll):
            return self.everything(x.var.name)
        if isinstance(x, A.FetchCall):
            return self.call(x.call, x.many)
        if isinstance(x, A.FetchSub):
            return self.sub(x)
        raise QueryError(f"cannot fetch {x}")

    def expression(self, e):
        if isinstance(e, A.Call) and e.name in self.c.functions:
            return self.call(e, False)
        if isinstance(e, A.Var):
            i = self.plan.vars.get(e.name)
            if i is None:
                raise QueryError(f"${e.name} is not bound")
            if i.kind == "object":
                raise QueryError(f"${e.name} is no value and cannot be fetched")
            return F.col(f"`{e.name}`")
        if self.c._user_calls(e):
            lifted: list = []
            e = self.c._lift(e, lifted)
            for let in lifted:
                self.plan, _ = self.c._apply(let, self.plan, None, None)
        return E.compile(e, self.plan.value).col

    def _back(self, answers: DataFrame, keys: list[str], result: str):
        """Left join of (keys, result) to the rows; the new column."""
        self.n += 1
        name = f"#f{self.n}"
        right = answers.select(*(F.col(f"`{k}`").alias(f"#j{i}") for i, k in enumerate(keys)), F.col(f"`{result}`").alias(name))
        if not keys:
            df = self.plan.df.join(right, F.lit(True), "left")
        else:
            df = self.plan.df.join(right, fold(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`#j{i}`")) for i, k in enumerate(keys)]), "left")
        self.plan = self.plan.with_df(df.drop(*(f"#j{i}" for i in range(len(keys)))))
        return F.col(f"`{name}`")

    def _owned(self, v: str, attrs: list[str]) -> list[tuple[str, str, DataFrame]]:
        """(type, attribute type, edges as k and value) of all ownerships of v's types."""
        i = self.plan.vars[v]
        frames = []
        for t in sorted(i.types):
            for a in attrs:
                if a not in self.c._owned(t, None, None):
                    continue
                for s in self.c.store.sources(t):
                    if a in s.attrs:
                        key = F.col(s.key[0]) if len(s.key) == 1 else F.struct(*(F.col(k).alias(f"k{n}") for n, k in enumerate(s.key)))
                        frames.append((t, a, self.c.store.frame(s.table).select(key.alias("k"), F.col(s.attrs[a]).alias("value"))))
                if (e := self.c.store.has(t, a)) is not None:
                    frames.append((t, a, e.select(F.col("owner").alias("k"), "value")))
        return frames

    def attribute(self, v: str, label: A.Label, many: bool):
        i = self.plan.vars.get(v)
        if i is None or i.kind != "object":
            raise QueryError(f"${v} owns nothing")
        attrs = self.c.catalog.concrete(label.name)
        if not many:
            for t in i.types:
                high = self._high(t, label.name)
                if high is None or high > 1:
                    raise QueryError(f"${v}.{label} can have several values: fetch a list")
        frames = self._owned(v, attrs)
        if not frames:
            return F.array().cast("array<string>") if many else F.lit(None).cast("string")
        kind = V.together([self.c.catalog.value_type(a) for _, a, _ in frames]) or "string"
        df = fold(lambda a, b: a.unionByName(b), [f.where("value IS NOT NULL").select(F.col("k").alias(v), F.lit(t).alias(tag(v)), F.col("value").cast(V.spark_type(kind)).alias("#value")) for t, _, f in frames])
        keys = self.plan.columns(v)
        if many:
            df = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.sort_array(F.collect_list("#value")).alias("#value"))
            return F.coalesce(self._back(df, keys, "#value"), F.array().cast(f"array<{V.spark_type(kind)}>"))
        return self._back(df, keys, "#value")

    def _high(self, t: str, attr: str):
        owns = self.c.catalog.owns(t)
        for a in self.c.catalog.supers(attr):
            if a in owns:
                return self.c.catalog.card(owns[a], "owns")[1]
        below = [a for a in self.c.catalog.subs(attr) if a in owns]
        return 1 if len(below) <= 1 else None

    def everything(self, v: str):
        i = self.plan.vars.get(v)
        if i is None or i.kind != "object":
            raise QueryError(f"${v} owns nothing")
        attrs = sorted({a for t in i.types for a in self.c._owned(t, None, None)})
        out = []
        for a in attrs:
            many = any(self._high(t, a) != 1 for t in i.types if a in self.c._owned(t, None, None))
            out.append(self.attribute(v, A.Label(a), many).alias(a))
        return F.struct(*out) if out else F.lit(None).cast("string")

    def call(self, e: A.Call, many: bool):
        f = self.c.functions.get(e.name)
        if f is None:
            raise QueryError(f"no function {e.name}")
        used = sorted(E.variables(e) & set(self.plan.vars))
        seeds = self.plan.only(used)
        seeds = Plan(seeds.df.drop(*self.plan.hidden).distinct(), seeds.vars, [])
        outs = [(A.Var(f"_r{k}"), True) for k in range(len(f.returns))]
        got, _ = calls.call(self.c, seeds, f, e.args, outs)
        result = F.col("`_r0`") if len(outs) == 1 else F.struct(*(F.col(f"`_r{k}`") for k in range(len(outs))))
        return self._collect(got.df.withColumn("#v", result), seeds.columns(*used) if used else [], many)

    def _collect(self, df: DataFrame, keys: list[str], many: bool, order=None):
        groups = [F.col(f"`{k}`") for k in keys]
        if not many:
            one = df.groupBy(*groups).agg(F.first("#v").alias("#v")) if groups else df.agg(F.first("#v").alias("#v"))
            return self._back(one, keys, "#v")
        if order is not None:
            listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("#o"), F.col("#v")))), lambda x: x["#v"])
        else:
            listed = F.sort_array(F.collect_list("#v"))
        kind = dict(df.dtypes)["#v"]
        got = df.groupBy(*groups).agg(listed.alias("#v")) if groups else df.agg(listed.alias("#v"))
        return F.coalesce(self._back(got, keys, "#v"), F.array().cast(f"array<{kind}>"))

    def sub(self, x: A.FetchSub):
        used: set[str] = set()
        _outer_vars(x, used)
        outer = sorted(used & set(self.plan.vars))
        keys = self.plan.columns(*outer) if outer else []
        df = self.plan.df.select(*(F.col(f"`{k}`") for k in keys)).distinct() if keys else self.c.spark.range(1).select(F.lit(0).alias("#h"))
        hidden = []
        for k in keys:
            df = df.withColumn(f"#h{k}", F.col(f"`{k}`"))
            hidden.append(f"#h{k}")
        if not keys:
            hidden = ["#h"]
        inner = Plan(df, {v: self.plan.vars[v] for v in outer}, hidden, unique=True)
        body = [s for s in x.stages if not isinstance(s, A.Fetch)]
        tail = next((s for s in x.stages if isinstance(s, A.Fetch)), None)
        if tail is not None:
            plan = stages.run(self.c, inner, body)
            ordered = plan.order
            if ordered:
                plan = plan.with_df(plan.df.withColumn("#o", stages._ranked(plan)))
                plan.hidden = [*plan.hidden, "#o"]
            rows = fetch(self.c, plan, tail.fields, carry=True)
            rows = rows.withColumn("#v", F.struct(*(F.col(f"`{k}`") for k, _ in tail.fields)))
            rows = rows.select(*(F.col(f"`{h}`").alias(h[2:] or h) for h in hidden), "#v", *(["#o"] if ordered else []))
            return self._collect(rows, keys, True, order=ordered or None)
        ret = x.returns
        if ret is None:
            raise QueryError("a subquery needs return or fetch")
        if ret.mode == "stream" or ret.mode in ("first", "last"):
            plan = stages.run(self.c, inner, body)
            for v in ret.vars:
                plan.value(v.name)
            if ret.mode != "stream":
                order = plan.order if ret.mode == "first" else [(v, not d) for v, d in plan.order]
                plan = stages.limit(Plan(plan.df, plan.vars, plan.hidden, order), A.Limit(1))
            value = F.col(f"`{ret.vars[0].name}`") if len(ret.vars) == 1 else F.struct(*(F.col(f"`{v.name}`") for v in ret.vars))
            rows = plan.df.select(*(F.col(f"`{h}`").alias(h[2:] or h) for h in hidden), value.alias("#v"))
            return self._collect(rows, keys, x.many)
        plan = stages.run(self.c, inner, body)
        seeds = inner.df.select(*(F.col(f"`{h}`") for h in hidden))
        if ret.mode == "check":
            got = seeds.join(plan.df.select(*(F.col(f"`{h}`") for h in hidden)).distinct().withColumn("#v", F.lit(True)), hidden, "left").withColumn("#v", F.coalesce("#v", F.lit(False)))
        else:
            red = stages.reduce(plan, A.Reduce([(A.Var(f"_v{k}"), n, v) for k, (n, v) in enumerate(ret.reducers)], []))
            got = seeds.join(red.df, hidden, "left")
            parts = []
            for k, (n, _) in enumerate(ret.reducers):
                kind = red.vars[f"_v{k}"].value
                parts.append(F.coalesce(F.col(f"_v{k}"), F.lit(0).cast(V.spark_type(kind))) if n in ("count", "sum") else F.col(f"_v{k}"))
            got = got.withColumn("#v", parts[0] if len(parts) == 1 else F.struct(*parts))
        return self._collect(got.select(*(F.col(f"`{h}`").alias(h[2:] or h) for h in hidden), "#v"), keys, x.many)


def _outer_vars(x, out: set[str]) -> None:
    """Every variable that a subquery mentions."""
    if isinstance(x, A.Var):
        out.add(x.name)
    elif isinstance(x, (list, tuple)):
        for y in x:
            _outer_vars(y, out)
    elif hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            _outer_vars(getattr(x, f), out)
