"""Calls of functions written in the query language.

A call is a relation between arguments and results: it is computed once for the distinct arguments
of the caller's rows and joined back. Functions that call themselves are tabled: their calls and
answers grow in rounds until neither does, so cycles in the data end, and only arguments that
are asked for are worked on.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError, Unsupported
from knotwork.functions import expressions as E
from knotwork.functions import values as V
from knotwork.operators import stages
from knotwork.plans import ast as A
from knotwork.plans.plan import Info, Plan, tag
from knotwork.sources.scratch import counted, cut


def called(items) -> set[tuple[str, bool]]:
    """(function, under a negation) of every call in a pattern or in stages."""
    out: set[tuple[str, bool]] = set()

    def expr(e, neg):
        if isinstance(e, A.Call):
            out.add((e.name, neg))
            for a in e.args:
                expr(a, neg)
        elif isinstance(e, A.Bin):
            expr(e.left, neg), expr(e.right, neg)

    def walk(c, neg):
        if isinstance(c, (A.Match,)):
            walk(c.pattern, neg)
        elif isinstance(c, A.Pattern):
            for x in c.items:
                walk(x, neg)
        elif isinstance(c, A.Or):
            for b in c.branches:
                walk(b, neg)
        elif isinstance(c, A.Not):
            walk(c.pattern, True)
        elif isinstance(c, A.Try):
            walk(c.pattern, neg)
        elif isinstance(c, A.Let):
            expr(c.expr, neg)
        elif isinstance(c, A.Compare):
            expr(c.left, neg), expr(c.right, neg)

    for s in items:
        walk(s, False)
    return out


def graph(functions: dict[str, A.Function]) -> dict[str, set[str]]:
    return {n: {g for g, _ in called(f.stages) if g in functions} for n, f in functions.items()}


def cycle_of(name: str, functions: dict[str, A.Function]) -> set[str]:
    """The functions that call `name` and are called by it, itself included if it calls itself; empty if none."""
    edges = graph(functions)

    def reach(a: str) -> set[str]:
        out, todo = set(), list(edges.get(a, ()))
        while todo:
            b = todo.pop()
            if b not in out:
                out.add(b)
                todo += edges[b]
        return out

    mine = reach(name)
    return {g for g in mine if name in reach(g)} | ({name} if name in mine else set()) if name in mine else set()


def check(functions: dict[str, A.Function]) -> None:
    """Functions are well formed, and none depends on its own negation or aggregate."""
    for n, f in functions.items():
        for s in f.stages:
            if isinstance(s, (A.Write, A.Delete, A.Fetch)):
                raise QueryError(f"{n}: a function cannot write or fetch")
            if isinstance(s, A.Require):
                raise Unsupported(f"{n}: require in a function")
        from knotwork.plans.compiler import pattern_vars

        used = set().union(*(pattern_vars(s.pattern.items) for s in f.stages if isinstance(s, A.Match))) if f.stages else set()
        for v, _, _ in f.args:
            if v.name not in used:
                raise QueryError(f"{n}: argument ${v.name} is not used")
        given = len(f.ret.vars) if f.ret.mode in ("stream", "first", "last") else len(f.ret.reducers) if f.ret.mode == "reduce" else 1
        if given != len(f.returns):
            raise QueryError(f"{n}: returns {given} values and declares {len(f.returns)}")
        if f.stream != (f.ret.mode == "stream"):
            raise QueryError(f"{n}: a stream is declared or returned, but not both")
        ring = cycle_of(n, functions)
        if ring:
            for g in ring:
                if any(h in ring and neg for h, neg in called(functions[g].stages)):
                    raise QueryError(f"{g}: a negation in a cycle of functions")
                if functions[g].ret.mode in ("reduce", "check") or any(isinstance(s, (A.Reduce, A.Limit, A.Offset)) for s in functions[g].stages):
                    raise QueryError(f"{g}: an aggregate in a cycle of functions")


def _declared(c, label: str, optional: bool) -> Info:
    if label in V.SPARK_TYPE:
        return Info("value", value=label, optional=optional)
    if label not in c.catalog.types:
        raise QueryError(f"no type {label}")
    return c.info(frozenset(c.catalog.concrete(label)), optional=optional)


def call(c, plan: Plan, f: A.Function, args, outs) -> tuple[Plan, bool]:
    """plan joined with the answers of f; outs: (Var, optional) for each result."""
    if len(args) != len(f.args):
        raise QueryError(f"{f.name} has {len(f.args)} arguments")
    if len(outs) != len(f.returns):
        raise QueryError(f"{f.name} has {len(f.returns)} results")
    df, params, cols = plan.df, [], []
    for k, (a, (_, label, optional)) in enumerate(zip(args, f.args)):
        want = _declared(c, label, optional)
        if isinstance(a, A.Var) and plan.vars.get(a.name) and plan.vars[a.name].kind in ("object", "attr", "type"):
            have = plan.vars[a.name]
            if want.kind == "object" and have.kind == "object":
                both = have.types & want.types
                if not both:
                    raise QueryError(f"{f.name}: argument {k + 1} has another type")
                if both < have.types:
                    df = df.where(plan.label(a.name).isin(sorted(both)))
                info = Info("object", both, optional=optional)
            else:
                info = have if want.kind != "value" else Info("value", value=have.value)
            df = df.withColumn(f"#a{k}", F.col(f"`{a.name}`"))
            if info.tagged:
                df = df.withColumn(f"#a{k}#t", plan.label(a.name))
        else:
            value = E.compile(a, plan.value)
            if want.value and value.kind != want.value:
                value = V.cast(value, want.value)
            info = Info("value", value=value.kind)
            df = df.withColumn(f"#a{k}", value.col)
        params.append(info)
        cols += [f"#a{k}"] + ([f"#a{k}#t"] if info.tagged else [])
    seeds = df.select(*(F.col(f"`{x}`").alias(x.replace("#a", "#p")) for x in cols)).distinct() if cols else c.spark.range(1).select(F.lit(0).alias("#p"))
    answers, infos = answer(c, f, seeds, params)
    c.fresh += 1
    mine = f"#c{c.fresh}"  # the columns of this call, apart from those of a call around it
    answers = answers.toDF(*(mine + x for x in answers.columns))
    on = [F.col(f"`{x}`") == F.col(f"`{mine}{x.replace('#a', '#p')}`") for x in cols] or [F.lit(True)]
    df = df.join(answers, fold(lambda a, b: a & b, on)).drop(*cols)
    vars = dict(plan.vars)
    for k, ((v, optional), info) in enumerate(zip(outs, infos)):
        col = F.col(f"`{mine}#r{k}`")
        if v.name in vars:
            df = df.where(F.col(f"`{v.name}`") == col)
            if info.tagged or vars[v.name].tagged:
                df = df.where(Plan(df, vars).label(v.name) == (F.col(f"`{mine}#r{k}#t`") if info.tagged else F.lit(next(iter(info.types)))))
        else:
            df = df.withColumn(v.name, col)
            if info.tagged:
                df = df.withColumn(tag(v.name), F.col(f"`{mine}#r{k}#t`"))
            vars[v.name] = Info(info.kind, info.types, info.value, optional)
            if not optional:
                df = df.where(F.col(f"`{v.name}`").isNotNull())
    df = df.drop(*answers.columns)
    return Plan(df, vars, plan.hidden, plan.order), False


def _schema(c, f: A.Function) -> list[Info]:
    return [_declared(c, label, optional) for label, optional in f.returns]


def answer(c, f: A.Function, seeds: DataFrame, params: list[Info]) -> tuple[DataFrame, list[Info]]:
    """(arguments #p0.., results #r0..) of a call with the arguments in seeds."""
    tabled = getattr(c, "tabled", None)
    if tabled is not None and f.name in tabled.ring:
        return tabled.ask(f, seeds, params)
    ring = cycle_of(f.name, c.functions)
    if ring:
        return Tabling(c, ring).solve(f, seeds, params)
    infos = _schema(c, f)
    return body(c, f, seeds, params, infos), infos


def body(c, f: A.Function, seeds: DataFrame, params: list[Info], infos: list[Info], distinct: bool = True) -> DataFrame:
    """Answers of a function's body for the arguments in seeds; without distinct, streams may repeat answers."""
    hidden = list(seeds.columns)
    df, vars = seeds, {}
    for k, ((v, _, _), info) in enumerate(zip(f.args, params)):
        df = df.withColumn(v.name, F.col(f"`#p{k}`"))
        if info.tagged:
            df = df.withColumn(tag(v.name), F.col(f"`#p{k}#t`"))
        vars[v.name] = info
    plan = stages.run(c, Plan(df, vars, hidden, unique=True), f.stages)
    hid = [F.col(f"`{h}`") for h in hidden]
    ret = f.ret
    if ret.mode in ("stream", "first", "last"):
        for v in ret.vars:
            if v.name not in plan.vars:
                raise QueryError(f"{f.name}: ${v.name} is not bound")
        if ret.mode != "stream":
            keys = plan.order if ret.mode == "first" else [(v, not down) for v, down in plan.order]
            plan = stages.limit(Plan(plan.df, plan.vars, plan.hidden, keys), A.Limit(1))
        cols = []
        for k, (v, info) in enumerate(zip(ret.vars, infos)):
            have = plan.vars[v.name]
            if info.kind == "object" and not have.types <= info.types:
                plan = plan.with_df(plan.df.where(plan.label(v.name).isin(sorted(info.types))))
            col = F.col(f"`{v.name}`")
            if info.value and have.value != info.value:
                col = V.cast(V.Value(col, have.value), info.value).col
            cols.append(col.alias(f"#r{k}"))
            if info.tagged:
                cols.append(plan.label(v.name).alias(f"#r{k}#t"))
        out = plan.df.select(*hid, *cols)
        return out.distinct() if ret.mode == "stream" and distinct else out
    on = [F.col(f"s.`{h}`").eqNullSafe(F.col(f"a.`{h}`")) for h in hidden]
    if ret.mode == "check":
        found = plan.df.select(*hid).distinct().withColumn("#yes", F.lit(True))
        got = seeds.alias("s").join(found.alias("a"), fold(lambda a, b: a & b, on), "left")
        return got.select(*(F.col(f"s.`{h}`").alias(h) for h in hidden), F.coalesce("#yes", F.lit(False)).alias("#r0"))
    reduced = stages.reduce(plan, A.Reduce([(A.Var(f"#r{k}"), name, v) for k, (name, v) in enumerate(ret.reducers)], []))
    got = seeds.alias("s").join(reduced.df.alias("a"), fold(lambda a, b: a & b, on), "left")
    cols = []
    for k, (name, _) in enumerate(ret.reducers):
        kind = reduced.vars[f"#r{k}"].value
        col = F.col(f"`#r{k}`")
        cols.append((F.coalesce(col, F.lit(0).cast(V.spark_type(kind))) if name in ("count", "sum") else col).alias(f"#r{k}"))
    return got.select(*(F.col(f"s.`{h}`").alias(h) for h in hidden), *cols)


class Tabling:
    """Calls and answers of a cycle of functions, grown to a fixpoint.

    Each round works on what is new: bodies run for new calls against all answers, and for all
    calls against new answers. Where a body has one recursive call, every answer needs at most one
    answer of the cycle, so that is enough; other bodies see all answers in both.
    """

    MOST_ROUNDS = 10_000

    def __init__(self, c, ring: set[str]):
        self.c, self.ring = c, ring
        self.params: dict[str, list[Info]] = {}
        self.infos = {g: _schema(c, c.functions[g]) for g in ring}
        self.calls: dict[str, DataFrame | None] = {g: None for g in ring}
        self.answers: dict[str, DataFrame | None] = {g: None for g in ring}
        self.view: dict[str, DataFrame | None] = {}
        self.asked: dict[str, list[DataFrame]] = {}
        self.linear = all(sum(g in ring for g, _ in _calls_in(c.functions[f])) <= 1 for f in ring)

    def ask(self, f: A.Function, seeds: DataFrame, params: list[Info]):
        """Notes a call from inside the cycle and gives the answers that are there."""
        full = [_declared(self.c, label, optional) for _, label, optional in f.args]
        seeds, params = _widen(seeds, params, full)
        self.params.setdefault(f.name, params)
        self.asked.setdefault(f.name, []).append(seeds)
        have = self.view.get(f.name)
        if have is None:
            fields = [x for x in seeds.schema.fields]
            have = self.c.spark.createDataFrame([], ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in fields), *(f"`#r{k}` {_column_type(self.c, i)}" + (f", `#r{k}#t` string" if i.tagged else "") for k, i in enumerate(self.infos[f.name]))]))
        return have.join(seeds.select(*seeds.columns), list(seeds.columns), "left_semi"), self.infos[f.name]

    def solve(self, f: A.Function, seeds: DataFrame, params: list[Info]):
        full = [_declared(self.c, label, optional) for _, label, optional in f.args]
        wide, wide_params = _widen(seeds, params, full)
        self.params[f.name] = wide_params
        outer = getattr(self.c, "tabled", None)
        self.c.tabled = self
        fresh_calls = {f.name: cut(wide.distinct())}
        fresh_answers: dict[str, DataFrame] = {}
        try:
            for turn in range(self.MOST_ROUNDS):
                for g, new in fresh_calls.items():
                    self.calls[g] = new if self.calls[g] is None else self.calls[g].unionByName(new)
                self.asked = {}
                produced: dict[str, list[DataFrame]] = {}
                for g in sorted(self.ring):
                    fun = self.c.functions[g]
                    if g in fresh_calls:
                        self.view = dict(self.answers)
                        produced.setdefault(g, []).append(body(self.c, fun, fresh_calls[g], self.params[g], self.infos[g], False))
                    if fresh_answers and self.calls[g] is not None:
                        self.view = {**dict.fromkeys(self.ring), **fresh_answers} if self.linear else dict(self.answers)
                        produced.setdefault(g, []).append(body(self.c, fun, self.calls[g], self.params[g], self.infos[g], False))
                new_answers, new_calls = {}, {}
                for g, frames in produced.items():
                    df = fold(lambda a, b: a.unionByName(b), frames).distinct()
                    df, n = counted(df if self.answers[g] is None else _without(df, self.answers[g]))
                    if n:
                        new_answers[g] = df
                for g, frames in self.asked.items():
                    df = frames[0] if len(frames) == 1 else fold(lambda a, b: a.unionByName(b), frames).distinct()  # one call's arguments are distinct
                    df, n = counted(df if self.calls[g] is None else _without(df, self.calls[g]))
                    if n:
                        new_calls[g] = df
                if not new_answers and not new_calls:
                    break
                for g, new in new_answers.items():
                    self.answers[g] = new if self.answers[g] is None else self.answers[g].unionByName(new)
                if turn % 8 == 7:  # many small tables become one
                    for table in (self.answers, self.calls):
                        table.update({g: cut(df) for g, df in table.items() if df is not None})
                fresh_calls, fresh_answers = new_calls, new_answers
            else:
                raise QueryError(f"{f.name}: no end after {self.MOST_ROUNDS} rounds")
        finally:
            self.c.tabled = outer
        infos = self.infos[f.name]
        found = self.answers[f.name]
        if found is None:
            self.view = {}
            found, _ = self.ask(f, wide, wide_params)
        keys = seeds.columns
        narrow = [(k, p) for k, (p, w) in enumerate(zip(params, wide_params)) if w.tagged and not p.tagged and p.kind == "object"]
        for k, p in narrow:
            found = found.where(F.col(f"`#p{k}#t`") == next(iter(p.types))).drop(f"#p{k}#t")
        return found.join(seeds, list(keys), "left_semi"), infos


def _calls_in(f: A.Function):
    """Every call in a function's body, each as often as it stands there."""
    out = []

    def walk(x):
        if isinstance(x, A.Call):
            out.append((x.name, False))
        for y in (getattr(x, "__dict__", {}) or {}).values() if hasattr(x, "__dict__") else ():
            spread(y)

    def spread(y):
        if isinstance(y, (list, tuple)):
            for z in y:
                spread(z)
        elif hasattr(y, "__dataclass_fields__"):
            walk(y)

    spread(f.stages)
    return out


def _widen(seeds: DataFrame, params: list[Info], full: list[Info]) -> tuple[DataFrame, list[Info]]:
    """Calls from different places with one set of columns: the type of an argument is that which the function declares."""
    out, cols = [], []
    for k, (p, w) in enumerate(zip(params, full)):
        cols.append(F.col(f"`#p{k}`"))
        if p.kind == "object" and w.kind == "object" and w.tagged:
            cols.append(F.col(f"`#p{k}#t`") if p.tagged else F.lit(next(iter(p.types))).alias(f"#p{k}#t"))
            out.append(w)
        else:
            out.append(p if p.kind != "object" else w)
    return seeds.select(*cols) if cols else seeds, out


def _column_type(c, i: Info) -> str:
    if i.value:
        return V.spark_type(i.value)
    kinds = {c._iid_type(t) for t in i.types}
    return kinds.pop() if len(kinds) == 1 else "string"


def _without(df: DataFrame, known: DataFrame) -> DataFrame:
    on = fold(lambda a, b: a & b, [F.col(f"n.`{x}`").eqNullSafe(F.col(f"k.`{x}`")) for x in df.columns])
    return df.alias("n").join(known.alias("k"), on, "left_anti")
