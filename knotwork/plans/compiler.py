"""Patterns to DataFrames.

A pattern is typed first; each object variable then becomes one scan with its attributes and role
players as columns (a relation that lives in its player's row shares that scan), the scans are
joined on shared variables, and what is left are filters, columns, unions, semi, anti and left
joins. Catalyst does the rest. Rows are only made distinct where anonymous variables could have
multiplied them.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.errors import InferenceError, QueryError, Unsupported
from knotwork.functions import builtins as B
from knotwork.functions import expressions as E
from knotwork.functions import values as V
from knotwork.plans import ast as A
from knotwork.plans.infer import OBJECTS, Env, ends, infer, links_choices, resolve, thing_vars, type_pairs
from knotwork.plans.plan import Info, Plan, named, tag
from knotwork.schema import Catalog
from knotwork.sources.store import Source, Store

_AND = lambda a, b: a & b


def pattern_vars(items) -> set[str]:
    """Every variable that a pattern mentions, with those of nested patterns."""
    out: set[str] = set()
    for c in items:
        if isinstance(c, A.Isa):
            out |= {c.thing.name} | ({c.type.name} if isinstance(c.type, A.Var) else set())
        elif isinstance(c, A.Has):
            out |= {c.owner.name, c.attr.name} | ({c.type.name} if isinstance(c.type, A.Var) else set())
        elif isinstance(c, A.Links):
            out |= {c.rel.name} | {p.name for _, p in c.players} | {r.name for r, _ in c.players if isinstance(r, A.Var)}
        elif isinstance(c, A.Iid):
            out.add(c.thing.name)
        elif isinstance(c, A.Is):
            out |= {c.left.name, c.right.name}
        elif isinstance(c, A.Compare):
            out |= E.variables(c.left) | E.variables(c.right)
        elif isinstance(c, (A.Kind, A.LabelIs)):
            out.add(c.type.name)
        elif isinstance(c, A.ValueIs):
            out |= E.variables(c.type)
        elif isinstance(c, (A.Sub, A.Owns, A.Plays, A.Relates)):
            out |= {e.name for e in ends(c) if isinstance(e, A.Var)}
        elif isinstance(c, A.Let):
            out |= {v.name for v, _ in c.vars} | E.variables(c.expr)
        elif isinstance(c, A.Or):
            out |= set().union(*(pattern_vars(b.items) for b in c.branches))
        elif isinstance(c, (A.Not, A.Try)):
            out |= pattern_vars(c.pattern.items)
        elif isinstance(c, A.Pattern):
            out |= pattern_vars(c.items)
    return out


def _flatten(items) -> list:
    out = []
    for c in items:
        out += _flatten(c.items) if isinstance(c, A.Pattern) else [c]
    return out


class Part:
    """One relation of the join graph."""

    def __init__(self, df: DataFrame, vars: set[str], filters: int = 0):
        self.df, self.vars, self.filters = df, vars, filters


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, store: Store, functions: dict | None = None, dedup_branches: bool = False):
        self.spark, self.catalog, self.store = spark, catalog, store
        self.functions = {**catalog.functions, **(functions or {})}
        self.dedup_branches = dedup_branches  # whether equal answers of two branches count once
        self.labels = False  # whether results have the labels of variables of several types
        self.branches = 0
        self.fresh = 0

    # -------------------------------------------------------------- match

    def match(self, plan: Plan | None, pattern: A.Pattern) -> Plan:
        """The distinct answers of the pattern for each input row."""
        check_scopes(pattern.items, set(plan.vars) if plan else set())
        before = self.branches
        out, dirty = self.extend(plan, pattern)
        unique = plan is None or plan.unique or not plan.vars
        visible = [v for v in out.vars if named(v)]
        if dirty:
            if not unique:  # equal input rows are worked on once, and come back as often as they were there
                self.branches = before
                once = plan.df.groupBy(*(F.col(f"`{c}`") for c in [*plan.columns(), *plan.hidden])).agg(F.count(F.lit(1)).alias("#many"))
                out, _ = self.extend(Plan(once, plan.vars, [*plan.hidden, "#many"]), pattern)
            marks = [] if self.dedup_branches else [c for c in out.df.columns if c.startswith("#branch")]
            keep = [*(out.columns(*visible) if visible else []), *out.hidden, *marks]
            out.df = out.df.select(*(F.col(f"`{c}`") for c in keep)).distinct() if keep else out.df.limit(1)
            if not unique:
                out.df = out.df.withColumn("#k", F.explode(F.array_repeat(F.lit(0), F.col("#many").cast("int")))).drop("#k", "#many")
                out.hidden = list(plan.hidden)
            unique = unique and not marks
        out = out.only(visible)
        out.unique = unique and not any(c.startswith("#branch") for c in out.df.columns)
        return out

    def extend(self, plan: Plan | None, pattern: A.Pattern, deferred: list | None = None) -> tuple[Plan, bool]:
        """plan joined with a pattern, and whether rows may come more than once. Comparisons on variables that neither binds go to `deferred` where it is given."""
        items = _flatten(pattern.items)
        env = self._env(plan)
        env = infer(self.catalog, items, env)
        infos = self._infos(items, env, plan)
        narrowed = self._narrow(plan, env) if plan else None
        parts, fds, consumed = self._parts(items, env, infos, narrowed)
        rest = [c for c in items if id(c) not in consumed]
        nested = [c for c in rest if isinstance(c, (A.Or, A.Not, A.Try))]
        rest = [c for c in rest if not isinstance(c, (A.Or, A.Not, A.Try))]
        parts, filtered = self._early(parts, rest, infos)
        rest = [c for c in rest if id(c) not in filtered]
        used_later = pattern_vars(rest) | pattern_vars(nested)
        out, dirty = self._join(narrowed, parts, infos, used_later, fds)
        out, more = self._finish(out, rest, nested, env, infos, deferred)
        return out, dirty or more

    def _env(self, plan: Plan | None) -> Env:
        env = Env()
        for v, i in (plan.vars if plan else {}).items():
            if i.kind in ("object", "attr", "type") and i.types:
                env[v] = i.types
            if i.kind == "type":
                env.type_vars.add(v)
        return env

    def _infos(self, items, env: Env, plan: Plan | None) -> dict[str, Info]:
        out = dict(plan.vars) if plan else {}
        for v, types in env.items():
            old = out.get(v)
            out[v] = self.info(types, v in env.type_vars, old.optional if old else False)
            if old and old.value and out[v].value != old.value:
                out[v] = Info(out[v].kind, types, old.value, old.optional)
        return out

    def info(self, types: frozenset, is_type: bool = False, optional: bool = False) -> Info:
        if is_type:
            return Info("type", types, optional=optional)
        kinds = {self.catalog.types[t].kind for t in types}
        if kinds <= set(OBJECTS):
            return Info("object", types, optional=optional)
        if kinds != {"attribute"}:
            raise Unsupported("a variable of objects and attributes")
        values = [self.catalog.value_type(t) for t in types]
        return Info("attr", types, V.together(values) or "string", optional)

    def _narrow(self, plan: Plan, env: Env) -> Plan:
        vars, df = dict(plan.vars), plan.df
        for v, i in plan.vars.items():
            if i.types and v in env and env[v] < i.types:
                if i.tagged:
                    df = df.where(F.col(f"`{tag(v)}`").isin(sorted(env[v])))
                    if len(env[v]) == 1:
                        df = df.drop(tag(v))
                elif i.kind == "type":
                    df = df.where(F.col(f"`{v}`").isin(sorted(env[v])))
                vars[v] = Info(i.kind, env[v], i.value, i.optional)
        return Plan(df, vars, plan.hidden, plan.order)

    # -------------------------------------------------------------- scans

    def _parts(self, items, env: Env, infos, plan: Plan | None):
        """Join parts for the things of a pattern, functional dependencies between variables, and the constraints that are done with."""
        consumed: set[int] = set()
        hases = [c for c in items if isinstance(c, A.Has)]
        links = [c for c in items if isinstance(c, A.Links)]
        bound = set(plan.vars) if plan else set()
        owners = list(dict.fromkeys([c.rel.name for c in links] + [c.owner.name for c in hases]))
        played = {p.name for c in links for _, p in c.players}
        for c in items:
            if isinstance(c, (A.Isa, A.Iid)) and c.thing.name not in owners and c.thing.name not in played | bound and infos[c.thing.name].kind == "object":
                owners.append(c.thing.name)
        fused: dict[str, tuple[str, A.Links, int]] = {}
        fusing = set()
        for c in links:
            for k, (role, p) in enumerate(c.players):
                if p.name in owners and p.name not in fused and p.name not in fusing and c.rel.name not in fused and p.name != c.rel.name and not any(x.rel.name == p.name for x in links) and self._fuses(c, k, env):
                    fused[p.name] = (c.rel.name, c, k)
                    fusing.add(c.rel.name)
        parts, fds = [], []
        for x in owners:
            if x in fused:
                continue
            frames = []
            single: set[str] | None = None
            back: set[str] | None = None
            for t in sorted(env[x]):
                for s in self.store.sources(t):
                    got = self._scan(x, t, s, hases, links, fused, env, infos)
                    if got is None:
                        continue
                    df, fixed, keys = got
                    frames.append(df)
                    single = fixed if single is None else single & fixed
                    back = keys if back is None else set()
            if not frames:
                frames, single, back = [self._empty(x, hases, links, fused, infos)], set(), set()
            df = fold(lambda a, b: a.unionByName(b), frames)
            vars = {v for v in df.columns if not v.endswith("#t")}
            fds += [({x}, v) for v in single or ()] + [({v}, x) for v in back or ()]
            parts.append(Part(df, vars))
        for c in hases + links:
            consumed.add(id(c))
        attr_bound = {c.attr.name for c in hases} | bound
        for c in items:
            if isinstance(c, A.Isa):
                v = c.thing.name
                if infos[v].kind == "attr" and v not in attr_bound:
                    attr_bound.add(v)
                    parts.append(Part(self._attributes(v, infos), {v}))
                if isinstance(c.type, A.Label):
                    consumed.add(id(c))  # inference has done it
            elif isinstance(c, (A.Kind, A.LabelIs, A.ValueIs)):
                v = c.type
                if isinstance(v, A.Var):
                    consumed.add(id(c))
        have = set().union(*(p.vars for p in parts)) | bound if parts else bound
        derived = {c.type.name for c in items if isinstance(c, A.Isa) and isinstance(c.type, A.Var)} | {c.type.name for c in items if isinstance(c, A.Has) and isinstance(c.type, A.Var)}
        for v in env.type_vars:
            if v not in have and v in pattern_vars(items) and v not in derived:
                parts.append(Part(F.broadcast(self._labels(v, env[v])), {v}))
        return parts, fds, consumed

    def _labels(self, v: str, labels) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in sorted(labels)], f"`{v}` string")

    def _fuses(self, c: A.Links, k: int, env: Env) -> bool:
        """Whether the player of a slot lives in the row of its relation, in every table of the relation."""
        role, p = c.players[k]
        seen = False
        for t in env[c.rel.name]:
            for s in self.store.sources(t):
                for r, pt in links_choices(self.catalog, t, role, env[p.name]):
                    if r not in s.roles or s.roles[r][0] != pt:
                        continue
                    ps = self.store.sources(pt)
                    if len(ps) != 1 or ps[0].table != s.table or ps[0].key != s.roles[r][1]:
                        return False
                    seen = True
        return seen

    def _scan(self, x: str, t: str, s: Source, hases, links, fused, env: Env, infos):
        """Rows of one table for variable x of type t: its columns, the variables that x determines, and those that determine x. None where a constraint cannot hold."""
        frame = self.store.frame(s.table)
        own = [s] + [q for p, (r, c, k) in fused.items() if r == x for q in self._player_sources(c, k, t, s, env)]
        needed = dict.fromkeys([*s.key, *(col for q in own for col in [*q.attrs.values(), *(k for _, ks in q.roles.values() for k in ks)])])
        df = frame.select(*(F.col(f"`{c}`").alias(f"§{c}") for c in needed))
        raw = lambda cols: F.col(f"`§{cols[0]}`") if len(cols) == 1 else F.struct(*(F.col(f"`§{c}`").alias(f"k{n}") for n, c in enumerate(cols)))
        several = len(self.store.sources(t)) > 1
        iid = raw(s.key) if not several else F.struct(F.lit(s.table).alias("table"), raw(s.key).alias("key"))
        seen: set[str] = set()
        fixed: set[str] = set()
        keys: set[str] = set()

        def bind(df: DataFrame, v: str, col: Column, label: Column) -> DataFrame:
            i = infos[v]
            if i.kind == "attr":
                col = col.cast(V.spark_type(i.value))
            elif i.kind == "object":
                kinds = {self._iid_type(z) for z in i.types}
                col = col.cast("string" if len(kinds) > 1 else kinds.pop())
            if v in seen:
                df = df.where(F.col(f"`{v}`") == col)
                return df.where(F.col(f"`{tag(v)}`") == label) if i.tagged else df
            seen.add(v)
            df = df.withColumn(v, col)
            return df.withColumn(tag(v), label) if i.tagged else df

        df = bind(df, x, iid, F.lit(t))
        for c in links:
            if c.rel.name != x:
                continue
            slots = []
            for k, (role, p) in enumerate(c.players):
                roles = env.get(role.name) if isinstance(role, A.Var) else None
                choices = links_choices(self.catalog, t, role, env[p.name], roles)
                here = [(r, pt) for r, pt in choices if r in s.roles and s.roles[r][0] == pt]
                native = self.store.links(t)
                if native is not None:
                    ok = [(r, pt) for r, pt in choices]
                    if not ok:
                        return None
                    cond = fold(lambda a, b: a | b, [(F.col("role") == r) & (F.col("player_type") == pt) for r, pt in sorted(ok)])
                    e = native.where(cond).select(F.col("rel").alias(f"§rel{k}"), F.col("role").alias(f"§role{k}{p.name}"), F.col("player_type").alias(f"§pt{k}"), F.col("player").alias(f"§p{k}{p.name}"))
                    df = df.join(e, F.col(f"`{x}`") == F.col(f"§rel{k}")).drop(f"§rel{k}")
                    role_col, pt_col, p_col = F.col(f"`§role{k}{p.name}`"), F.col(f"§pt{k}"), F.col(f"`§p{k}{p.name}`")
                elif len(here) == 1:
                    r, pt = here[0]
                    p_col, role_col, pt_col = raw(s.roles[r][1]), F.lit(r), F.lit(pt)
                    df = df.where(fold(_AND, [F.col(f"`§{z}`").isNotNull() for z in s.roles[r][1]]))
                    fixed.add(p.name)
                    if s.roles[r][1] == s.key and not several:
                        keys.add(p.name)
                elif here:
                    options = [F.struct(F.lit(r).alias("r"), F.lit(pt).alias("t"), raw(s.roles[r][1]).alias("p")) for r, pt in here]
                    df = df.withColumn(f"§o{k}", F.explode(F.array(*options))).where(F.col(f"§o{k}.p").isNotNull())
                    role_col, pt_col, p_col = F.col(f"§o{k}.r"), F.col(f"§o{k}.t"), F.col(f"§o{k}.p")
                else:
                    return None
                df = bind(df, p.name, p_col, pt_col)
                if native is not None:
                    df = df.drop(f"§pt{k}", f"§p{k}{p.name}")
                if isinstance(role, A.Var):
                    if role.name in seen:
                        df = df.where(F.col(f"`{role.name}`") == role_col)
                    else:
                        seen.add(role.name)
                        df = df.withColumn(role.name, role_col)
                slots.append((p.name, role_col, {r for r, _ in choices}))
            for i, (p, role, roles) in enumerate(slots):  # no two slots with one player in one role
                for q, other, others in slots[i + 1 :]:
                    if roles & others and infos[p].types & infos[q].types:
                        same = F.col(f"`{p}`") == F.col(f"`{q}`")
                        if infos[p].tagged and infos[q].tagged:
                            same &= F.col(f"`{tag(p)}`") == F.col(f"`{tag(q)}`")
                        df = df.where(~((role == other) & same))
        todo = [(x, t, s, True)]
        for p, (r, c, k) in fused.items():
            if r == x:
                qs = self._player_sources(c, k, t, s, env)
                if len(qs) != 1:
                    return None
                todo.append((p, qs[0].type, qs[0], True))
        for v, vt, vs, _ in todo:
            for c in hases:
                if c.owner.name != v:
                    continue
                a = c.attr.name
                choices = sorted(set(env[a]) & self._owned(vt, c.type, env))
                columns = [(z, vs.attrs[z]) for z in choices if z in vs.attrs]
                edges = [(z, self.store.has(vt, z)) for z in choices if z not in vs.attrs]
                edges = [(z, e) for z, e in edges if e is not None]
                kind = V.spark_type(infos[a].value)
                type_var = c.type.name if isinstance(c.type, A.Var) else None
                if len(columns) == 1 and not edges:
                    z, col = columns[0]
                    df = bind(df.where(F.col(f"`§{col}`").isNotNull()), a, F.col(f"`§{col}`"), F.lit(z))
                    fixed.add(a)
                    label = F.lit(z)
                elif columns:
                    name = f"§h{a}"
                    options = [F.struct(F.lit(z).alias("t"), F.col(f"`§{col}`").cast(kind).alias("v")) for z, col in columns]
                    df = df.withColumn(name, F.explode(F.array(*options))).where(F.col(f"`{name}`.v").isNotNull())
                    label = F.col(f"`{name}`.t")
                    df = bind(df, a, F.col(f"`{name}`.v"), label)
                elif edges:
                    e = fold(lambda p, q: p.unionByName(q), [e.select(F.col("owner").alias("§owner"), F.col("value").cast(kind).alias(f"§v{a}"), F.lit(z).alias(f"§t{a}")) for z, e in edges])
                    df = df.join(e, F.col(f"`{v}`") == F.col("§owner")).drop("§owner")
                    label = F.col(f"`§t{a}`")
                    df = bind(df, a, F.col(f"`§v{a}`"), label)
                    if len(edges) == 1 and self.catalog.card(self.catalog.owns(vt).get(edges[0][0]) or self.catalog.owns(vt)[self._declared(vt, edges[0][0])], "owns")[1] == 1:
                        fixed.add(a)
                else:
                    return None
                if type_var and type_var not in seen and infos[type_var].kind == "type":
                    up = self.spark.createDataFrame([(z, u) for z in choices for u in self.catalog.supers(z) if u in env[type_var]], f"`§a{a}` string, `{type_var}` string")
                    df = df.withColumn(f"§l{a}", label).join(F.broadcast(up), F.col(f"`§l{a}`") == F.col(f"`§a{a}`"))
                    seen.add(type_var)
                if edges and not columns:
                    df = df.drop(f"§v{a}", f"§t{a}")
        cols = [c for v in seen for c in ([v, tag(v)] if infos[v].tagged else [v])]
        return df.select(*(F.col(f"`{c}`") for c in cols)), fixed, keys

    def _declared(self, t: str, attr: str) -> str:
        return next(a for a in self.catalog.supers(attr) if a in self.catalog.owns(t))

    def _owned(self, t: str, label, env: Env) -> set[str]:
        out = {c for a in self.catalog.owns(t) for c in self.catalog.concrete(a)}
        if isinstance(label, A.Label):
            out &= set(self.catalog.concrete(resolve(self.catalog, label)))
        elif isinstance(label, A.Var):
            out = {a for a in out if set(self.catalog.supers(a)) & env[label.name]}
        return out

    def _player_sources(self, c: A.Links, k: int, t: str, s: Source, env: Env) -> list[Source]:
        role, p = c.players[k]
        return [q for r, pt in links_choices(self.catalog, t, role, env[p.name]) if r in s.roles and s.roles[r][0] == pt for q in self.store.sources(pt)]

    def _iid_type(self, t: str) -> str:
        """Type of the column with an instance's key."""
        sources = self.store.sources(t)
        if not sources:
            return "bigint"
        kinds = dict(self.store.frame(sources[0].table).dtypes)
        each = ["bigint" if kinds[k] in ("int", "bigint", "smallint") else kinds[k] for k in sources[0].key]
        one = each[0] if len(each) == 1 else f"struct<{','.join(f'k{n}:{x}' for n, x in enumerate(each))}>"
        return one if len(sources) == 1 else f"struct<table:string,key:{one}>"

    def _empty(self, x: str, hases, links, fused, infos) -> DataFrame:
        vs = [x] + [p.name for c in links if c.rel.name == x for _, p in c.players] + [c.attr.name for c in hases if c.owner.name == x or fused.get(c.owner.name, ("",))[0] == x]
        fields = [f"`{v}` {V.spark_type(infos[v].value) if infos[v].kind == 'attr' else 'bigint'}" + (f", `{tag(v)}` string" if infos[v].tagged else "") for v in dict.fromkeys(vs)]
        return self.spark.createDataFrame([], ", ".join(fields))

    def _attributes(self, v: str, infos) -> DataFrame:
        """Instances of attribute types: the distinct values that something owns, and independent ones."""
        i, frames = infos[v], []
        for a in sorted(i.types):
            for t in self.catalog.of_kind(*OBJECTS):
                if self.catalog.types[t].abstract or a not in self._owned(t, None, Env()):
                    continue
                for s in self.store.sources(t):
                    if a in s.attrs:
                        frames.append(self.store.frame(s.table).select(F.col(f"`{s.attrs[a]}`").alias("value"), F.lit(a).alias("label")))
                e = self.store.has(t, a)
                if e is not None:
                    frames.append(e.select("value", F.lit(a).alias("label")))
            if (e := self.store.independent(a)) is not None:
                frames.append(e.select("value", F.lit(a).alias("label")))
        if not frames:
            return self.spark.createDataFrame([], f"`{v}` {V.spark_type(i.value)}" + (f", `{tag(v)}` string" if i.tagged else ""))
        df = fold(lambda p, q: p.unionByName(q), [f.where("value IS NOT NULL").select(F.col("value").cast(V.spark_type(i.value)).alias(v), F.col("label").alias(tag(v))) for f in frames])
        return (df if i.tagged else df.drop(tag(v))).distinct()

    # -------------------------------------------------------------- joins

    def _early(self, parts: list[Part], rest, infos) -> tuple[list[Part], set[int]]:
        """Comparisons with constants go into the part that binds their variable, so that parts with filters can be joined first."""
        done: set[int] = set()
        for c in rest:
            if isinstance(c, A.Compare) and len(vs := E.variables(c.left) | E.variables(c.right)) == 1 and not self._user_calls(c.left, c.right):
                (v,) = vs
                for p in parts:
                    if v in p.vars:
                        p.df = p.df.where(self.comparison(c, Plan(p.df, {v: infos[v]})))
                        p.filters += 1
                        done.add(id(c))
        return parts, done

    def _join(self, plan: Plan | None, parts: list[Part], infos, used_later: set[str], fds) -> tuple[Plan | None, bool]:
        todo = list(parts)
        hidden = plan.hidden if plan else []
        if plan is not None:
            df, have = plan.df, set(plan.vars)
        elif todo:
            # a part that only has to exist for the others comes later, as the right side of a semi join
            alone = lambda p: {v for v in p.vars if (named(v) or v in used_later) and not any(v in q.vars for q in todo if q is not p)}
            start = max(todo, key=lambda p: (bool(alone(p)), p.filters, sum(map(named, p.vars)), len(p.vars)))
            todo.remove(start)
            df, have = start.df, set(start.vars)
        else:
            return None, False
        gone: set[str] = set()
        while todo:
            linked = [p for p in todo if p.vars & have] or todo
            p = max(linked, key=lambda q: (len(q.vars & have), q.filters))
            todo.remove(p)
            shared, new = p.vars & have, p.vars - have
            later = used_later | set().union(*(q.vars for q in todo)) if todo else used_later
            on = [c for v in sorted(shared) for c in ([v, tag(v)] if infos[v].tagged else [v])]
            if on and new and all(not named(v) and v not in later for v in new):
                df = df.join(p.df, on, "left_semi")
                gone |= new
            elif on and not new:
                df = df.join(p.df, on, "left_semi")
            elif on:
                df = df.join(p.df, on)
            else:
                df = df.crossJoin(p.df)
            have |= new - gone
        vars = {v: infos[v] for v in have}
        known = {v for v in have if named(v)} | (set(plan.vars) if plan else set())
        grown = True
        while grown:
            grown = False
            for left, v in fds:
                if left <= known and v not in known:
                    known.add(v)
                    grown = True
        return Plan(df, vars, hidden, plan.order if plan else []), not have <= known

    # -------------------------------------------------------------- filters, assignments, nested patterns

    def comparison(self, c: A.Compare, plan: Plan) -> Column:
        left = E.compile(c.left, plan.value)
        if c.op == "like":
            if not isinstance(c.right, A.Lit):
                raise QueryError("like needs a literal")
            return V.like(left, c.right.value)
        return V.compare(c.op, left, E.compile(c.right, plan.value))

    def _user_calls(self, *exprs) -> list[A.Call]:
        out = []
        for e in exprs:
            if isinstance(e, A.Call):
                out += ([e] if e.name in self.functions or e.name in B.NAMES else []) + self._user_calls(*e.args)
            elif isinstance(e, A.Bin):
                out += self._user_calls(e.left, e.right)
            elif isinstance(e, A.ListOf):
                out += self._user_calls(*e.items)
        return out

    def _lift(self, e, lifted: list):
        """Replaces calls of functions inside an expression by variables."""
        if isinstance(e, A.Call) and (e.name in self.functions or e.name in B.NAMES):
            self.fresh += 1
            v = A.Var(f"_call{self.fresh}")
            lifted.append(A.Let([(v, False)], A.Call(e.name, tuple(self._lift(a, lifted) for a in e.args))))
            return v
        if isinstance(e, A.Call):
            return A.Call(e.name, tuple(self._lift(a, lifted) for a in e.args))
        if isinstance(e, A.Bin):
            return A.Bin(e.op, self._lift(e.left, lifted), self._lift(e.right, lifted))
        return e

    def _finish(self, plan: Plan | None, rest, nested, env: Env, infos, deferred) -> tuple[Plan, bool]:
        dirty = False
        todo = []
        for c in rest:
            if isinstance(c, A.Compare) and self._user_calls(c.left, c.right):
                lifted: list = []
                c = A.Compare(c.op, self._lift(c.left, lifted), self._lift(c.right, lifted))
                todo += lifted
            elif isinstance(c, A.Let) and self._user_calls(c.expr) and not (isinstance(c.expr, A.Call) and (c.expr.name in self.functions or c.expr.name in B.NAMES) and not self._user_calls(*c.expr.args)):
                lifted = []
                if isinstance(c.expr, A.Call) and (c.expr.name in self.functions or c.expr.name in B.NAMES):
                    c = A.Let(c.vars, A.Call(c.expr.name, tuple(self._lift(a, lifted) for a in c.expr.args)), c.stream)
                else:
                    c = A.Let(c.vars, self._lift(c.expr, lifted), c.stream)
                todo += lifted
            todo.append(c)
        if plan is None:
            plan = Plan(self.spark.range(1).select(), {})
        progress = True
        while todo and progress:
            progress = False
            for c in list(todo):
                got = self._apply(c, plan, env, infos)
                if got is not None:
                    plan, more = got
                    dirty |= more
                    todo.remove(c)
                    progress = True
        nested = list(nested)
        for kind in (A.Or, A.Try, A.Not):  # negations see what the others bind
            for c in [n for n in nested if isinstance(n, kind)]:
                plan, more = self._nested(c, plan, env)
                dirty |= more
                progress = True
                while todo and progress:
                    progress = False
                    for d in list(todo):
                        got = self._apply(d, plan, env, infos)
                        if got is not None:
                            plan, more = got
                            dirty |= more
                            todo.remove(d)
                            progress = True
        if todo:
            if deferred is None or any(not isinstance(c, A.Compare) for c in todo):
                missing = pattern_vars(todo) - set(plan.vars)
                raise QueryError("not bound: " + ", ".join(f"${v}" for v in sorted(missing)) if missing else "the assignments depend on each other")
            deferred += todo
        return plan, dirty

    def _apply(self, c, plan: Plan, env: Env, infos) -> tuple[Plan, bool] | None:
        """plan with a filter or an assignment, or None while it lacks variables."""
        have = set(plan.vars)
        if isinstance(c, A.Compare):
            if not E.variables(c.left) | E.variables(c.right) <= have:
                return None
            return plan.with_df(plan.df.where(self.comparison(c, plan))), False
        if isinstance(c, A.Is):
            a, b = c.left.name, c.right.name
            if a in have and b in have:
                same = F.col(f"`{a}`") == F.col(f"`{b}`")
                if plan.vars[a].kind == "attr" or plan.vars[a].kind == "object":
                    same &= plan.label(a) == plan.label(b)
                return plan.with_df(plan.df.where(same)), False
            if a in have or b in have:
                old, new = (a, b) if a in have else (b, a)
                df = plan.df.withColumn(new, F.col(f"`{old}`"))
                if plan.vars[old].tagged:
                    df = df.withColumn(tag(new), F.col(f"`{tag(old)}`"))
                return Plan(df, {**plan.vars, new: plan.vars[old]}, plan.hidden, plan.order), False
            return None
        if isinstance(c, A.Iid):
            if c.thing.name not in have:
                return None
            v = c.thing.name
            return plan.with_df(plan.df.where(B.with_iid(self, plan.vars[v].types, plan.label(v), F.col(f"`{v}`"), c.iid))), False
        if isinstance(c, A.Isa):  # with a type variable
            x, t = c.thing.name, c.type.name
            if x not in have:
                return None
            pairs = [(s, u) for s in sorted(plan.vars[x].types) for u in ([s] if c.exact else self.catalog.supers(s)) if u in env[t]]
            return self._type_join(plan, [(x, plan.label(x)), (t, F.col(f"`{t}`") if t in have else None)], pairs, {t: Info("type", env[t])})
        if isinstance(c, (A.Sub, A.Owns, A.Plays, A.Relates)):
            left, right = ends(c)
            names = [(e.name, plan.label(e.name) if e.name in have else None) if isinstance(e, A.Var) else (None, F.lit(resolve(self.catalog, e))) for e in (left, right)]
            if all(col is None for _, col in names):
                return None
            pairs = type_pairs(self.catalog, c)
            return self._type_join(plan, names, pairs, {n: Info("type", env[n]) for n, _ in names if n})
        if isinstance(c, A.ValueIs):
            ok = self.catalog.value_type(resolve(self.catalog, c.type)) == c.kind
            return plan.with_df(plan.df if ok else plan.df.where(F.lit(False))), False
        if isinstance(c, A.Kind):
            return plan, False
        if isinstance(c, A.Let):
            if not E.variables(c.expr) <= have:
                return None
            if isinstance(c.expr, A.Call) and c.expr.name in B.NAMES:
                return B.apply(self, plan, c.expr, [v.name for v, _ in c.vars])
            if isinstance(c.expr, A.Call) and c.expr.name in self.functions:
                from knotwork.operators.calls import call

                return call(self, plan, self.functions[c.expr.name], c.expr.args, c.vars)
            if len(c.vars) != 1:
                raise QueryError("an assignment of an expression has one variable")
            v = c.vars[0][0].name
            value = E.compile(c.expr, plan.value)
            if v in have:
                return plan.with_df(plan.df.where(V.compare("==", plan.value(v), value))), False
            kind = "list" if value.kind.startswith("list ") else "value"
            return Plan(plan.df.withColumn(v, value.col), {**plan.vars, v: Info(kind, value=value.kind)}, plan.hidden, plan.order), False
        raise Unsupported(type(c).__name__)

    def _type_join(self, plan: Plan, ends_, pairs, infos) -> tuple[Plan, bool]:
        """plan with a relation between two types, of which at least one is there."""
        (a, ca), (b, cb) = ends_
        table = F.broadcast(self.spark.createDataFrame(sorted(set(pairs)), "`#a` string, `#b` string"))  # as large as the schema
        cond = [col == F.col(f"`{n}`") for col, n in ((ca, "#a"), (cb, "#b")) if col is not None]
        df = plan.df.join(table, fold(_AND, cond))
        vars = dict(plan.vars)
        for name, col, n in ((a, ca, "#a"), (b, cb, "#b")):
            if col is None and name:
                df = df.withColumn(name, F.col(f"`{n}`"))
                vars[name] = infos[name]
        return Plan(df.drop("#a", "#b"), vars, plan.hidden, plan.order), False

    def _nested(self, c, plan: Plan, env: Env) -> tuple[Plan, bool]:
        if isinstance(c, A.Or):
            return self._or(c, plan)
        return self._left(c, plan)

    def _or(self, c: A.Or, plan: Plan) -> tuple[Plan, bool]:
        out, dirty = [], False
        self.branches += 1
        mark = f"#branch{self.branches}"
        alone = not plan.vars and not plan.hidden
        for b in c.branches:
            try:
                p, more = self.extend(None if alone else plan, b)
            except InferenceError:
                continue
            out.append(p)
            dirty |= more
        if not out:
            raise InferenceError("no branch can hold")
        shared = set.intersection(*(set(p.vars) for p in out))
        shared = {v for v in shared if named(v) or v in plan.vars}
        infos: dict[str, Info] = {}
        for v in shared:
            every = [p.vars[v] for p in out]
            if every[0].kind in ("object", "attr", "type"):
                types = frozenset().union(*(i.types for i in every))
                infos[v] = Info(every[0].kind, types, every[0].value if every[0].kind != "attr" else V.together([i.value for i in every]) or "string", any(i.optional for i in every))
            else:
                infos[v] = Info(every[0].kind, value=V.together([i.value for i in every]) or every[0].value, optional=any(i.optional for i in every))
        frames = []
        for k, p in enumerate(out):
            dirty |= any(v not in shared for v in p.vars)
            cols = []
            for v in sorted(shared):
                col = F.col(f"`{v}`")
                if infos[v].value and p.vars[v].value != infos[v].value:
                    col = col.cast(V.spark_type(infos[v].value))
                cols.append(col.alias(v))
                if infos[v].tagged:
                    cols.append(p.label(v).alias(tag(v)))
            cols += [F.col(f"`{h}`") for h in p.hidden]
            cols += [F.col(f"`{x}`") for x in p.df.columns if x.startswith("#branch") and x not in plan.df.columns and x in set.intersection(*(set(q.df.columns) for q in out))]
            cols += [F.col(f"`{x}`") for x in plan.df.columns if x.startswith("#branch")]
            frames.append(p.df.select(*cols, F.lit(k).alias(mark)))
        df = fold(lambda a, b: a.unionByName(b), frames)
        return Plan(df, infos, plan.hidden, plan.order), dirty or self.dedup_branches

    def _left(self, c, plan: Plan) -> tuple[Plan, bool]:
        """not: the rows without an answer. try: all answers, or one row with nothing."""
        is_not = isinstance(c, A.Not)
        if is_not and any(isinstance(x, A.Try) for x in c.pattern.items):
            raise QueryError("try cannot stand in not")
        inner_vars = pattern_vars(c.pattern.items)
        outer = [v for v in plan.vars if v in inner_vars]
        deferred: list = []
        sub = None
        items = _flatten(c.pattern.items)
        simple = all(isinstance(x, (A.Isa, A.Has, A.Links, A.Compare)) and not (isinstance(x, A.Compare) and self._user_calls(x.left, x.right)) for x in items)
        try:
            if simple and all(isinstance(x, A.Compare) for x in items) and is_not:
                cond = fold(_AND, [F.coalesce(self.comparison(x, plan), F.lit(False)) for x in items])
                return plan.with_df(plan.df.where(~cond)), False
            things = thing_vars(items)
            free = all(v in things for v in outer) or all(isinstance(x, A.Compare) or not (pattern_vars([x]) & set(outer) - things) for x in items)
            if simple and free:
                types = Plan(None, {v: i for v, i in plan.vars.items() if v in inner_vars})
                sub, dirty = self._alone(c.pattern, types, deferred)
            if sub is None:
                seeds = plan.only(outer) if outer or plan.hidden else None
                if seeds is not None:
                    seeds.df = seeds.df.distinct()
                sub, dirty = self.extend(seeds, c.pattern)
        except InferenceError:  # the inner pattern can never hold
            if is_not:
                return plan, False
            raise
        new = [v for v in sub.vars if v not in plan.vars and named(v)]
        keys = [v for v in sub.vars if v in plan.vars]
        held = {v for d in deferred for v in pattern_vars([d])}
        keep = keys + [v for v in sub.vars if v not in keys and (v in new and not is_not or v in held)]
        right = sub.only(keep)
        right.df = right.df.distinct() if (dirty or any(v not in keep for v in sub.vars)) and not is_not else right.df
        names = {}
        for v in keep:
            for col in right.columns(v):
                names[col] = f"#r{col}"
        right_df = right.df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()), *(F.col(f"`{h}`").alias(f"#r{h}") for h in right.hidden))
        cond = [F.col(f"`{h}`").eqNullSafe(F.col(f"`#r{h}`")) for h in right.hidden]
        for v in keys:
            cond.append(F.col(f"`{v}`") == F.col(f"`#r{v}`"))
            if plan.vars[v].tagged or right.vars[v].tagged:
                cond.append(plan.label(v) == (F.col(f"`#r{tag(v)}`") if right.vars[v].tagged else F.lit(next(iter(right.vars[v].types)))))

        def lookup(name: str):
            if name in plan.vars:
                return plan.value(name)
            return V.Value(F.col(f"`#r{name}`"), right.vars[name].value)

        for d in deferred:
            left = E.compile(d.left, lookup)
            cond.append(V.like(left, d.right.value) if d.op == "like" else V.compare(d.op, left, E.compile(d.right, lookup)))
        on = fold(_AND, cond) if cond else F.lit(True)
        if is_not:
            return plan.with_df(plan.df.join(right_df, on, "left_anti")), False
        df = plan.df.join(right_df, on, "left")
        vars = dict(plan.vars)
        for v in new:
            if v in right.vars:
                df = df.withColumn(v, F.col(f"`#r{v}`"))
                if right.vars[v].tagged:
                    df = df.withColumn(tag(v), F.col(f"`#r{tag(v)}`"))
                i = right.vars[v]
                vars[v] = Info(i.kind, i.types, i.value, True)
        return Plan(df.drop(*(x for x in df.columns if x.startswith("#r"))), vars, plan.hidden, plan.order), False

    def _alone(self, pattern: A.Pattern, outer: Plan, deferred: list) -> tuple[Plan | None, bool]:
        """A nested pattern by itself, typed by the variables around it."""
        items = _flatten(pattern.items)
        env = infer(self.catalog, items, self._env(outer))
        infos = self._infos(items, env, outer)
        parts, fds, consumed = self._parts(items, env, infos, None)
        if not parts:
            return None, False
        rest = [c for c in items if id(c) not in consumed]
        parts, filtered = self._early(parts, rest, infos)
        rest = [c for c in rest if id(c) not in filtered]
        out, dirty = self._join(None, parts, infos, pattern_vars(rest) | set(outer.vars), fds)
        out, more = self._finish(out, rest, [], env, infos, deferred)
        return out, dirty or more


def check_scopes(items, outer: set[str]) -> None:
    """Variables that are bound only inside a negation, or in one branch, cannot be used beside it."""
    here = set()
    for c in _flatten(items):
        if not isinstance(c, (A.Or, A.Not, A.Try)):
            here |= pattern_vars([c])
    inside = [pattern_vars(c.pattern.items) - here - outer for c in items if isinstance(c, A.Not)]
    for i, a in enumerate(inside):
        for b in inside[i + 1 :]:
            both = {v for v in a & b if named(v)}
            if both:
                raise QueryError("bound in two negations: " + ", ".join(f"${v}" for v in sorted(both)))
