"""insert, put, update and delete on edge tables, and the checks of a commit.

A stage first fixes its input rows in a table, so that new ids are the same whenever a row is
computed, then derives what it adds and takes away as DataFrames and makes new versions of the
tables that change. Nothing is edited in place.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.errors import QueryError, WriteError
from knotwork.functions import expressions as E
from knotwork.functions import values as V
from knotwork.plans import ast as A
from knotwork.plans.infer import OBJECTS, resolve
from knotwork.plans.plan import Info, Plan, named, tag
from knotwork.sources.scratch import counted, cut
from knotwork.sources.store import EdgeStore

_AND = lambda a, b: a & b


class _Edges:
    """What a stage adds to each table, as columns of its rows."""

    def __init__(self, fresh=()):
        self.rows: dict[str, list] = {}
        self.fresh = set(fresh)  # variables of new instances: edges at them cannot be there yet
        self.known: set[str] = set()  # tables that get edges at others too

    def add(self, table: str, row, where, at: str | None = None) -> None:
        self.rows.setdefault(table, []).append((row, where))
        if at not in self.fresh:
            self.known.add(table)


class Writer:
    def __init__(self, compiler, store: EdgeStore, next_id: int = 0):
        self.c, self.store, self.catalog = compiler, store, compiler.catalog
        self.next_id = next_id
        self.changed: set[str] = set()
        self.added: dict[str, list[DataFrame]] = {}  # of changed tables that have only got rows: these
        self.first: set[str] = set()  # tables that were not there: all their rows have come now

    def _put(self, table: str, df: DataFrame) -> None:
        """Another version of a whole table."""
        self.store.tables[table] = cut(df)
        self.changed.add(table)
        self.added.pop(table, None)

    def _add(self, table: str, df: DataFrame, distinct: bool = True, known: bool = True) -> None:
        """More rows of a table, which is not written anew. known: some of them may be there."""
        if table not in self.store.tables:
            self.first.add(table)
        old = self.store.frame(table)
        new = df.select(*(F.col(f.name).cast(f.dataType) for f in old.schema.fields))
        new = new.distinct() if distinct else new
        if distinct and known and table not in (self.first - self.changed):
            new = new.alias("n").join(old.alias("o"), fold(_AND, [F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in old.columns]), "left_anti")
        new = cut(new)
        self.store.tables[table] = old.unionByName(new) if table in self.changed or table not in self.first else new
        if table not in self.changed:
            self.added[table] = []
        if table in self.added:
            self.added[table].append(new)
        self.changed.add(table)

    def delta(self, table: str) -> DataFrame | None:
        """The rows that a table has got, if nothing else has happened to it; an empty one if nothing has."""
        if table not in self.changed:
            return self.store.frame(table).limit(0)
        return fold(lambda a, b: a.unionByName(b), self.added[table]) if table in self.added else None

    def _rows(self, plan: Plan | None, gaps: bool = False) -> Plan:
        """The input rows, each with a number, in a table that is written once. gaps: the numbers only tell rows apart."""
        plan = plan if plan is not None else Plan(self.c.spark.range(1).select(), {})
        if gaps:
            return Plan(cut(plan.df.withColumn("#n", F.monotonically_increasing_id())), plan.vars, ["#n"])
        df = cut(plan.df.withColumn("#m", F.monotonically_increasing_id()))
        # rows of a partition are numbered on from those of the partitions before it, so that numbers have no gaps
        part = F.shiftright("#m", 33)
        sizes = df.groupBy(part.alias("#part")).agg(F.count(F.lit(1)).alias("#size"))
        before = cut(sizes.select("#part", F.coalesce(F.sum("#size").over(Window.orderBy("#part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("#before")))
        df = df.join(F.broadcast(before), part == F.col("#part")).withColumn("#n", F.col("#before") + F.col("#m").bitwiseAND(F.lit((1 << 33) - 1))).drop("#m", "#part", "#before")
        return Plan(df, plan.vars, ["#n"])

    def _some(self, df: DataFrame, cond, message: str) -> None:
        if not df.where(cond).isEmpty():
            raise WriteError(message)

    # -------------------------------------------------------------- insert

    def insert(self, plan: Plan | None, pattern: A.Pattern) -> Plan:
        out = self._insert(self._rows(plan), pattern)
        return Plan(out.df.drop("#n"), {v: i for v, i in out.vars.items() if named(v)}).only([v for v in out.vars if named(v)])

    def _insert(self, rows: Plan, pattern: A.Pattern) -> Plan:
        tries = [x for x in pattern.items if isinstance(x, A.Try)]
        items = [x for x in pattern.items if not isinstance(x, A.Try)]
        out = self._insert_items(rows, items)
        for t in tries:  # only for rows in which all its variables are there
            if any(isinstance(x, (A.Try, A.Or, A.Not)) for x in t.pattern.items):
                raise QueryError("nested patterns cannot be written")
            from knotwork.plans.compiler import pattern_vars

            needed = [v for v in pattern_vars(t.pattern.items) if v in out.vars]
            some = out.with_df(out.df.where(fold(_AND, [F.col(f"`{v}`").isNotNull() for v in needed], F.lit(True))))
            self._insert_items(some, t.pattern.items)
        return out

    def _insert_items(self, rows: Plan, items, cleared=()) -> Plan:
        """cleared: variables, each instance in one row only, of which the edges to be written have been taken away."""
        for x in items:
            if isinstance(x, (A.Or, A.Not, A.Iid, A.Is, A.Let)):
                raise QueryError(f"{type(x).__name__.lower()} cannot be inserted")
        vars = dict(rows.vars)
        values = {x.left.name: x.right for x in items if isinstance(x, A.Compare) and isinstance(x.left, A.Var) and x.op == "=="}
        attr_types: dict[str, str] = {}
        for x in items:
            if isinstance(x, A.Isa) and isinstance(x.type, A.Label) and self.catalog.types.get(x.type.name) and self.catalog.types[x.type.name].kind == "attribute":
                attr_types[x.thing.name] = resolve(self.catalog, x.type)
            if isinstance(x, A.Has) and isinstance(x.type, A.Label):
                known = vars.get(x.attr.name)
                if known is None or known.kind == "value":
                    attr_types.setdefault(x.attr.name, resolve(self.catalog, x.type))
        new, checks = {}, []
        edges = _Edges(cleared)
        edges.fresh |= {x.thing.name for x in items if isinstance(x, A.Isa) and x.thing.name not in rows.vars and x.thing.name not in attr_types}
        for v, label in attr_types.items():
            t = self.catalog.type(label)
            if t.kind != "attribute":
                raise WriteError(f"{label} is no attribute")
            if t.abstract:
                raise WriteError(f"{label} is abstract")
            kind = self.catalog.value_type(label)
            if v in rows.vars:
                value = V.cast(rows.value(v), kind)
            elif v in values:
                e = values[v]
                if not isinstance(e, (A.Var, A.Lit)):
                    raise QueryError("expressions cannot be written")
                value = V.cast(E.compile(e, rows.value), kind)
            else:
                raise WriteError(f"${v} has no value")
            new[v] = value.col
            vars[v] = Info("attr", frozenset([label]), kind)
            checks += self._value_checks(v, label, self.catalog.value_notes(label))
            if any("independent" in self.catalog.types[n].notes.flags for n in self.catalog.supers(label)):
                edges.add(f"attr/{label}", F.struct(F.col(f"`{v}`").alias("value")), F.col(f"`{v}`").isNotNull())
        fresh = []
        for x in items:
            if not isinstance(x, A.Isa) or x.thing.name in attr_types:
                continue
            v = x.thing.name
            if v in vars:
                raise WriteError(f"${v} is there already")
            if isinstance(x.type, A.Var):
                raise QueryError("a type variable cannot be inserted")
            label = resolve(self.catalog, x.type)
            t = self.catalog.type(label)
            if t.kind not in OBJECTS or t.abstract:
                raise WriteError(f"{label} has no instances")
            fresh.append((v, label))
            vars[v] = Info("object", frozenset([label]))
        df = rows.df
        if fresh:
            top, base = df.agg(F.max("#n")).first()[0], self.next_id
            for k, (v, label) in enumerate(fresh):
                new[v] = F.lit(base + k) + F.col("`#n`") * len(fresh)
                edges.add(f"thing/{label}", F.struct(F.col(f"`{v}`").alias("iid")), F.lit(True))
            self.next_id = base + ((top or 0) + 1) * len(fresh)
        if new:
            df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in new), *(col.alias(v) for v, col in new.items()))
        plan = Plan(df, vars, rows.hidden)
        for x in items:
            if isinstance(x, A.Has):
                checks += self._has(plan, x, edges)
            elif isinstance(x, A.Links):
                self._links(plan, x, edges)
        self._pass(df, checks)
        for table, options in edges.rows.items():
            e = F.filter(F.array(*(F.when(ok, row) for row, ok in options)), lambda r: r.isNotNull())
            known = table in edges.known
            e = F.array_distinct(e) if len(options) > 1 and not known else e  # edges at new instances are the same in one row only
            self._add(table, df.select(F.explode(e).alias("e")).select("e.*"), distinct=known, known=known)
        return plan

    def _value_checks(self, v: str, label: str, notes) -> list:
        """(condition that must not hold, message) for the annotations of a value."""
        col, out = F.col(f"`{v}`"), []
        for n in notes:
            if n.regex is not None:
                out.append((~col.rlike(n.regex), f"a value of {label} does not match @regex"))
            if n.range:
                low, high = n.range
                bad = F.lit(False)
                if low is not None:
                    bad |= col < F.lit(low)
                if high is not None:
                    bad |= col > F.lit(high)
                out.append((bad, f"a value of {label} is outside @range"))
            if n.values:
                out.append((~col.isin(*n.values), f"a value of {label} is not in @values"))
        return out

    def _pass(self, df: DataFrame, checks) -> None:
        """All checks in one look at the rows."""
        if checks:
            found = df.agg(*(F.max(F.when(bad, 1)).alias(f"c{k}") for k, (bad, _) in enumerate(checks))).first()
            for hit, (_, message) in zip(found, checks):
                if hit:
                    raise WriteError(message)

    def _check_value(self, df: DataFrame, v: str, label: str, notes) -> None:
        self._pass(df, self._value_checks(v, label, notes))

    def _owner(self, plan: Plan, v: str) -> Info:
        i = plan.vars.get(v)
        if i is None:
            raise QueryError(f"${v} is not bound")
        if i.kind != "object":
            raise WriteError(f"${v} is no object")
        return i

    def _has(self, plan: Plan, x: A.Has, edges: _Edges) -> list:
        o, a = self._owner(plan, x.owner.name), plan.vars.get(x.attr.name)
        if a is None or a.kind != "attr":
            raise WriteError(f"${x.attr.name} is no attribute")
        checks = []
        for t in o.types:
            for label in a.types:
                edge = next((e for s in self.catalog.supers(label) if (e := self.catalog.owns(t).get(s))), None)
                if edge is None:
                    raise WriteError(f"{t} does not own {label}")
                checks += self._value_checks(x.attr.name, label, [edge.notes])
        owner, value = F.col(f"`{x.owner.name}`"), F.col(f"`{x.attr.name}`")
        for label in sorted(a.types):
            row = F.struct(plan.label(x.owner.name).alias("owner_type"), owner.alias("owner"), value.cast(V.spark_type(self.catalog.value_type(label))).alias("value"))
            edges.add(f"has/{label}", row, owner.isNotNull() & value.isNotNull() & (plan.label(x.attr.name) == label), x.owner.name)
        return checks

    def _role(self, rel: str, role) -> str:
        if role is None:
            roles = list(self.catalog.relates(rel))
            if len(roles) != 1:
                raise WriteError(f"which role of {rel}?")
            return roles[0]
        if isinstance(role, A.Var):
            raise QueryError("a role variable cannot be written")
        found = [r for r in self.catalog.relates(rel) if r.split(":")[1] == role.name]
        if not found:
            raise WriteError(f"{rel} relates no {role}")
        if self.catalog.role_abstract(found[0]):
            raise WriteError(f"{found[0]} is abstract")
        return found[0]

    def _links(self, plan: Plan, x: A.Links, edges: _Edges) -> None:
        r = self._owner(plan, x.rel.name)
        for label in sorted(r.types):
            if self.catalog.types[label].kind != "relation":
                raise WriteError(f"{label} is no relation")
            for role, p in x.players:
                name = self._role(label, role)
                for t in self._owner(plan, p.name).types:
                    if name not in self.catalog.plays(t):
                        raise WriteError(f"{t} does not play {name}")
                rel, player = F.col(f"`{x.rel.name}`"), F.col(f"`{p.name}`")
                row = F.struct(rel.alias("rel"), F.lit(name).alias("role"), plan.label(p.name).alias("player_type"), player.alias("player"))
                edges.add(f"links/{label}", row, rel.isNotNull() & player.isNotNull() & (plan.label(x.rel.name) == label), x.rel.name)

    # -------------------------------------------------------------- put, update, delete

    def put(self, plan: Plan | None, pattern: A.Pattern) -> Plan:
        """Answers of the pattern for each row; where there are none, the pattern is inserted. All rows are matched before any is inserted."""
        rows = self._rows(plan)
        marked = Plan(rows.df, rows.vars, ["#n"])
        found = self.c.match(marked, pattern)
        cols = [F.col(f"`{x}`") for x in [*found.columns(), "#n"]]
        hit = cut(found.df.select(*cols))
        missing = rows.with_df(rows.df.join(hit.select("#n"), "#n", "left_anti"))
        if missing.df.isEmpty():
            return Plan(hit.drop("#n"), found.vars, [])
        made = self._insert(missing, pattern)
        names = [v for v in found.vars if v in made.vars]
        if any(found.vars[v].tagged != made.vars[v].tagged for v in names):
            parts = []
            for p, df in ((found, hit), (made, made.df)):
                parts.append(df.select(*(F.col(f"`{v}`") for v in names), *(p.label(v).alias(tag(v)) for v in names if p.vars[v].kind in ("object", "attr"))))
            vars = {v: Info(found.vars[v].kind, found.vars[v].types | made.vars[v].types, found.vars[v].value) for v in names}
            df = parts[0].unionByName(parts[1])
            out = Plan(df, vars, [])
            return out.only(names)
        keep = [x for v in names for x in found.columns(v)]
        df = hit.select(*(F.col(f"`{x}`") for x in keep)).unionByName(made.df.select(*(F.col(f"`{x}`") for x in keep)))
        return Plan(df, {v: found.vars[v] for v in names}, [])

    def update(self, plan: Plan, pattern: A.Pattern) -> Plan:
        rows = self._rows(plan, gaps=True)
        for x in pattern.items:
            if isinstance(x, A.Has) and isinstance(x.type, A.Label):
                label = resolve(self.catalog, x.type)
                o = self._owner(rows, x.owner.name)
                for t in o.types:
                    edge = next((e for s in self.catalog.supers(label) if (e := self.catalog.owns(t).get(s))), None)
                    if edge is None:
                        raise WriteError(f"{t} does not own {label}")
                    if self.catalog.card(edge, "owns")[1] != 1:
                        raise WriteError(f"{t} can own several {label}: nothing to update")
                last = self._last(rows, [x.owner.name])
                gone = last.select(rows.label(x.owner.name).alias("owner_type"), F.col(f"`{x.owner.name}`").alias("owner")).where("owner IS NOT NULL").distinct()
                table = f"has/{label}"
                self._put(table, self.store.frame(table).join(gone, ["owner_type", "owner"], "left_anti"))
                values = [y for y in pattern.items if isinstance(y, A.Compare) and isinstance(y.left, A.Var) and y.left.name == x.attr.name]
                self._insert_items(rows.with_df(last), [x, *values], [x.owner.name])
            elif isinstance(x, A.Links):
                r = self._owner(rows, x.rel.name)
                last = self._last(rows, [x.rel.name])
                for label in r.types:
                    for role, _ in x.players:
                        name = self._role(label, role)
                        if self.catalog.card(self.catalog.relates(label)[name], "relates")[1] != 1:
                            raise WriteError(f"{name} can have several players: nothing to update")
                        gone = last.where(rows.label(x.rel.name) == label).select(F.col(f"`{x.rel.name}`").alias("rel"), F.lit(name).alias("role")).distinct()
                        table = f"links/{label}"
                        self._put(table, self.store.frame(table).join(gone, ["rel", "role"], "left_anti"))
                self._insert_items(rows.with_df(last), [x], [x.rel.name])
            elif not isinstance(x, A.Compare):
                raise QueryError(f"{type(x).__name__.lower()} cannot be updated")
        return Plan(rows.df.drop("#n"), rows.vars, [])

    def _last(self, rows: Plan, names) -> DataFrame:
        """Of rows with one owner the last, as later rows overwrite earlier ones."""
        cols = [F.col(f"`{x}`") for x in rows.columns(*names)]
        top = rows.df.groupBy(*cols).agg(F.max("#n").alias("#n"))
        return rows.df.join(top.select("#n"), "#n", "left_semi")

    def delete(self, plan: Plan, items) -> Plan:
        rows = self._rows(plan, gaps=True)
        gone = []
        flat = [(x, False) for x in items if x[0] != "try"] + [(y, True) for x in items if x[0] == "try" for y in x[1]]
        for x, optional in flat:
            if x[0] == "has":
                self._delete_has(rows, x[1].name, x[2].name)
            elif x[0] == "links":
                self._delete_links(rows, x[1].name, x[2])
        for x, optional in flat:
            if x[0] == "thing":
                i = rows.vars.get(x[1].name)
                if i is None:
                    raise QueryError(f"${x[1].name} is not bound")
                if i.optional and not optional:
                    raise QueryError(f"${x[1].name} is optional: delete it in try")
                gone.append(x[1].name)
                self._delete_thing(rows, x[1].name, i)
        out = Plan(rows.df.drop("#n"), rows.vars, [])
        return out.only([v for v in rows.vars if v not in gone])

    def _delete_has(self, rows: Plan, a: str, o: str) -> None:
        if rows.vars.get(a) is None or rows.vars.get(o) is None:
            raise QueryError("not bound")
        for label in rows.vars[a].types:
            df = rows.df.where(rows.label(a) == label).select(rows.label(o).alias("owner_type"), F.col(f"`{o}`").alias("owner"), F.col(f"`{a}`").cast(V.spark_type(self.catalog.value_type(label))).alias("value"))
            self._put(f"has/{label}", self.store.frame(f"has/{label}").join(df, ["owner_type", "owner", "value"], "left_anti"))

    def _delete_links(self, rows: Plan, r: str, players) -> None:
        for label in self._owner(rows, r).types:
            old = self.store.frame(f"links/{label}")
            for role, p in players:
                df = rows.df.where(rows.label(r) == label).select(F.col(f"`{r}`").alias("rel"), rows.label(p.name).alias("player_type"), F.col(f"`{p.name}`").alias("player"))
                on = ["rel", "player_type", "player"]
                if role is not None:
                    df = df.crossJoin(F.broadcast(self.c.spark.createDataFrame([(n,) for n in self.catalog.roles_called(label, role.name, role.scope)], "role string")))
                    on.append("role")
                old = old.join(df.distinct(), on, "left_anti").select("rel", "role", "player_type", "player")
            self._put(f"links/{label}", old)

    def _delete_thing(self, rows: Plan, v: str, i: Info) -> None:
        if i.kind == "attr":
            for label in i.types:
                df = rows.df.where(rows.label(v) == label).select(F.col(f"`{v}`").cast(V.spark_type(self.catalog.value_type(label))).alias("value")).distinct()
                for table in (f"has/{label}", f"attr/{label}"):
                    self._put(table, self.store.frame(table).join(df, "value", "left_anti").select(*self.store.frame(table).columns))
            return
        if i.kind != "object":
            raise WriteError(f"${v} cannot be deleted")
        gone = rows.df.select(rows.label(v).alias("t"), F.col(f"`{v}`").alias("k")).where("k IS NOT NULL").distinct()
        self._remove(cut(gone), i.types)

    def _remove(self, gone: DataFrame, types) -> None:
        """Takes away objects (t, k) and all edges at them."""
        for t in sorted(types):
            mine = gone.where(F.col("t") == t)
            old = self.store.frame(f"thing/{t}")
            self._put(f"thing/{t}", old.join(mine.select(F.col("k").alias("iid")), "iid", "left_anti"))
            for a in sorted(self.c._owned(t, None, None)):
                table = f"has/{a}"
                cols = self.store.frame(table).columns
                self._put(table, self.store.frame(table).join(mine.select(F.col("t").alias("owner_type"), F.col("k").alias("owner")), ["owner_type", "owner"], "left_anti").select(*cols))
            if self.catalog.types[t].kind == "relation":
                cols = self.store.frame(f"links/{t}").columns
                self._put(f"links/{t}", self.store.frame(f"links/{t}").join(mine.select(F.col("k").alias("rel")), "rel", "left_anti").select(*cols))
            for role in self.catalog.plays(t):
                for r in self.catalog.of_kind("relation"):
                    if role in self.catalog.relates(r) and f"links/{r}" in self.store.tables:
                        cols = self.store.frame(f"links/{r}").columns
                        self._put(f"links/{r}", self.store.frame(f"links/{r}").join(mine.select(F.col("t").alias("player_type"), F.col("k").alias("player")), ["player_type", "player"], "left_anti").select(*cols))

    # -------------------------------------------------------------- commit

    def clean(self) -> None:
        """Relations that lost all players go, until none is left. Attributes that nothing owns are not stored, but for independent ones."""
        again = any(t.startswith(("links/", "thing/")) for t in self.changed)
        while again:
            again = False
            for r in self.catalog.of_kind("relation"):
                if f"thing/{r}" not in self.store.tables:
                    continue
                empty = self.store.frame(f"thing/{r}").join(self.store.frame(f"links/{r}").select(F.col("rel").alias("iid")), "iid", "left_anti")
                empty, n = counted(empty.select(F.lit(r).alias("t"), F.col("iid").alias("k")))
                if n:
                    self._remove(empty, [r])
                    again |= bool(self.catalog.plays(r))  # others may have lost this one as a player

    def validate(self) -> None:
        """Cardinalities and uniqueness of what has changed: of the owners of new rows where tables have only got rows, of all where more has happened."""
        cat = self.catalog
        touched = {t.split("/", 1)[1] for t in self.changed}
        union = lambda frames: fold(lambda x, y: x.unionByName(y), frames) if frames else None
        for t in cat.of_kind(*OBJECTS):
            if cat.types[t].abstract:
                continue
            for a, e in cat.owns(t).items():
                labels = cat.concrete(a)
                if touched & {t, *labels}:
                    new = [self.delta(f"has/{z}") for z in labels]
                    grown = None if None in new or self.first.issuperset({f"thing/{t}", *(f"has/{z}" for z in labels)}) else union([d.where(F.col("owner_type") == t).select("owner") for d in new])
                    self._card(t, union([self.store.has(t, z).select("owner") for z in labels]), cat.card(e, "owns"), f"{t} owns {a}", grown)
                    if e.notes.flags & {"key", "unique"}:
                        self._unique(cat.owns_declared(t, a), a)
            for role, e in cat.plays(t).items():
                rels = [r for r in cat.of_kind("relation") if role in cat.relates(r)]
                if touched & {t, *rels}:
                    mine = lambda d: d.where((F.col("role") == role) & (F.col("player_type") == t)).select(F.col("player").alias("owner"))  # noqa: B023, E731
                    new = [self.delta(f"links/{r}") for r in rels]
                    self._card(t, union([mine(self.store.frame(f"links/{r}")) for r in rels]), cat.card(e, "plays"), f"{t} plays {role}", None if None in new or self.first.issuperset({f"thing/{t}", *(f"links/{r}" for r in rels)}) else union([mine(d) for d in new]))
            if cat.types[t].kind == "relation" and t in touched:
                for role, e in cat.relates(t).items():
                    mine = lambda d: d.where(F.col("role") == role).select(F.col("rel").alias("owner"))  # noqa: B023, E731
                    new = self.delta(f"links/{t}")
                    self._card(t, mine(self.store.frame(f"links/{t}")), cat.card(e, "relates"), f"{t} relates {role}", None if new is None or self.first.issuperset({f"thing/{t}", f"links/{t}"}) else mine(new))

    def _card(self, t: str, edges: DataFrame | None, card: tuple[int, int | None], what: str, grown: DataFrame | None) -> None:
        """grown: the owners of edges that have come, where none has gone."""
        low, high = card
        many, few = F.col("count") > high if high is not None else F.lit(False), F.coalesce("count", F.lit(0)) < low
        checks = [(many, f"{what} more than {high} times"), (few, f"{what} fewer than {low} times")]
        new = self.delta(f"thing/{t}")
        if edges is not None and (high is not None or low > 0 and grown is None):
            some = edges if grown is None else edges.join(grown.distinct(), "owner", "left_semi")
            counts = some.groupBy("owner").count()
            if low > 0 and grown is None:  # both in one look
                things = self.store.frame(f"thing/{t}").select(F.col("iid").alias("owner"), F.lit(True).alias("here"))
                have = counts.join(things, "owner", "full_outer")
                return self._pass(have, [checks[0], (few & F.col("here"), checks[1][1])])
            self._some(counts, *checks[0])
        if low > 0:
            things = (self.store.frame(f"thing/{t}") if grown is None or new is None else new).select(F.col("iid").alias("owner"))
            if edges is not None and grown is not None and new is not None:
                edges = edges.join(things, "owner", "left_semi")
            counts = edges.groupBy("owner").count() if edges is not None else None
            have = things.join(counts, "owner", "left") if counts is not None else things.withColumn("count", F.lit(None).cast("bigint"))
            self._some(have, *checks[1])

    def _unique(self, scope: str, attr: str) -> None:
        cat = self.catalog
        owners = cat.subs(scope)
        for label in cat.concrete(attr):
            mine = lambda d: d.where(F.col("owner_type").isin(owners))
            df, new = mine(self.store.frame(f"has/{label}")), self.delta(f"has/{label}")
            if new is not None and f"has/{label}" not in self.first:
                df = df.join(mine(new).select("value").distinct(), "value", "left_semi")
            owner = F.struct("owner_type", "owner")
            self._some(df.groupBy("value").agg(F.min(owner).alias("low"), F.max(owner).alias("high")), F.col("low") != F.col("high"), f"{attr} of {scope} is not unique")


STAGES = {"insert": Writer.insert, "put": Writer.put, "update": Writer.update}
