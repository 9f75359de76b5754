"""Databases, transactions and queries."""

from __future__ import annotations

import json
import uuid
from functools import lru_cache
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.errors import ConflictError, QueryError, SchemaError, WriteError
from knotwork.functions import values as V
from knotwork.operators import calls, stages
from knotwork.operators.fetch import fetch
from knotwork.operators.write import STAGES, Writer
from knotwork.plans import ast as A
from knotwork.plans.compiler import Compiler
from knotwork.plans.infer import OBJECTS
from knotwork.plans.parser import parse
from knotwork.plans.plan import Info, Plan, tag
from knotwork.schema import Catalog
from knotwork.sources.store import EdgeStore, Store


@lru_cache(maxsize=512)
def parsed(text: str):
    return parse(text)


def given_plan(compiler: Compiler, g: A.Given, rows: DataFrame | None) -> Plan:
    """Input rows as a plan: types and missing values are checked, instances must exist."""
    if rows is None:
        raise QueryError("given needs input rows")
    df, vars = rows, {}
    for v, label, optional in g.vars:
        if v.name not in df.columns:
            raise QueryError(f"given ${v.name} is missing")
        name = str(label)
        if not optional and not df.where(F.col(f"`{v.name}`").isNull()).isEmpty():
            raise QueryError(f"given ${v.name} has an empty value")
        if name in V.SPARK_TYPE:
            have = dict(df.dtypes)[v.name]
            whole = have in ("tinyint", "smallint", "int", "bigint")
            fits = {"integer": whole, "double": whole or have in ("float", "double"), "string": have == "string", "boolean": have == "boolean", "date": have == "date", "datetime": have in ("timestamp_ntz", "date"), "decimal": whole or have.startswith("decimal")}
            if not fits.get(name, True):
                raise QueryError(f"given ${v.name} is {have}, not {name}")
            df = df.withColumn(v.name, F.col(f"`{v.name}`").cast(V.spark_type(name)))
            vars[v.name] = Info("value", value=name, optional=optional)
            continue
        info = compiler.info(frozenset(compiler.catalog.concrete(name)), optional=optional)
        vars[v.name] = info
        if info.tagged and tag(v.name) not in df.columns:
            raise QueryError(f"given ${v.name} needs its type in column {tag(v.name)}")
        if info.kind == "object":
            kinds = {compiler._iid_type(t) for t in info.types}
            kind = "string" if len(kinds) > 1 else next(iter(kinds))
            if kind in ("bigint", "string"):
                df = df.withColumn(v.name, F.col(f"`{v.name}`").cast(kind))
            elif dict(df.dtypes)[v.name] != kind:
                raise QueryError(f"given ${v.name} is {dict(df.dtypes)[v.name]}, not {kind}")
            frames = []
            for t in sorted(info.types):
                sources = compiler.store.sources(t)
                for s in sources:
                    key = F.col(s.key[0]) if len(s.key) == 1 else F.struct(*(F.col(k).alias(f"k{n}") for n, k in enumerate(s.key)))
                    key = F.struct(F.lit(s.table).alias("table"), key.alias("key")) if len(sources) > 1 else key
                    frames.append(compiler.store.frame(s.table).select(key.cast(kind).alias("#k"), F.lit(t).alias("#kt")))
            label = F.col(f"`{tag(v.name)}`") if info.tagged else F.lit(next(iter(info.types)))
            some = df.where(F.col(f"`{v.name}`").isNotNull())
            if frames:
                known = fold(lambda a, b: a.unionByName(b), frames)
                some = some.join(known, (F.col(f"`{v.name}`") == F.col("#k")) & (label == F.col("#kt")), "left_anti")
            if not some.isEmpty():
                raise QueryError(f"given ${v.name} does not exist")
    keep = [c for v, i in vars.items() for c in ([v, tag(v)] if i.tagged else [v])]
    return Plan(df.select(*(F.col(f"`{c}`") for c in keep)), vars)


def run(compiler: Compiler, pipeline: A.Pipeline, given: DataFrame | None = None, writer: Writer | None = None) -> tuple[DataFrame, Plan | None]:
    """The rows (or documents) of a pipeline, and what their columns mean."""
    if len(pipeline.stages) > stages.MOST:
        raise QueryError(f"more than {stages.MOST} stages")
    plan: Plan | None = None
    for k, s in enumerate(pipeline.stages):
        if isinstance(s, A.Given):
            if k:
                raise QueryError("given must come first")
            plan = given_plan(compiler, s, given)
        elif isinstance(s, A.Fetch):
            if k != len(pipeline.stages) - 1:
                raise QueryError("fetch must come last")
            return fetch(compiler, plan if plan is not None else Plan(compiler.spark.range(1).select(), {}), s.fields), None
        elif isinstance(s, (A.Write, A.Delete)):
            if writer is None:
                raise QueryError("writes need a write transaction")
            if isinstance(s, A.Delete):
                plan = writer.delete(plan, s.items)
            else:
                plan = STAGES[s.kind](writer, plan, s.pattern)
        else:
            plan = stages.run(compiler, plan, [s])
    if plan is None:
        raise QueryError("an empty pipeline")
    return plan.df.select(*(F.col(f"`{c}`") for c in (plan.columns() if compiler.labels else plan.vars))) if plan.vars else plan.df, plan


def query(spark: SparkSession, catalog: Catalog, store: Store, text: str, given: DataFrame | None = None, labels: bool = False) -> DataFrame:
    """A read query over any store. labels: for variables of several types, their labels too, in columns named variable#t."""
    p = parsed(text)
    if isinstance(p, A.Schema):
        raise QueryError("schema queries need a schema transaction")
    functions = {f.name: f for f in p.functions}
    compiler = Compiler(spark, catalog, store, functions)
    compiler.labels = labels
    calls.check(compiler.functions)
    return run(compiler, p, given)[0]


def analyse(spark: SparkSession, catalog: Catalog, store: Store, text: str) -> dict:
    """Stages of a query and the inferred types of the variables after each, without running it."""
    p = parsed(text)
    compiler = Compiler(spark, catalog, store, {f.name: f for f in p.functions})
    plan, out = None, []
    for s in p.stages:
        if isinstance(s, (A.Given, A.Fetch, A.Write, A.Delete)):
            out.append({"stage": type(s).__name__.lower(), "variables": {}})
            continue
        plan = stages.run(compiler, plan, [s])
        out.append({"stage": type(s).__name__.lower(), "variables": {v: {"kind": i.kind, "types": sorted(i.types), "value": i.value, "optional": i.optional} for v, i in plan.vars.items()}})
    return {"functions": [f.name for f in p.functions], "stages": out}


# ------------------------------------------------------------------ stored databases


class _Files:
    """Small files through Hadoop's file systems, so that any shared store works."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A file that is not there yet, whole or not at all; false if it is there.

        The text is written under a name of its own, then moved. Hadoop's file systems move to a
        path that exists only by failing, and the stores of which that is not true create files
        whole, when they are closed.
        """
        fs, p = self._fs(path)
        if fs.exists(p):
            return False
        draft = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(draft, p, self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if "Exist" in str(e):
                return False
            raise
        return True

    def list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(("_", "."))) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


class Server:
    """Databases as folders below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark)

    def databases(self) -> list[str]:
        return self.files.list(self.folder)

    def create(self, name: str) -> Database:
        if name in self.databases():
            raise QueryError(f"database {name} is there already")
        db = Database(self.spark, f"{self.folder}/{name}")
        db.publish(0, {"schema": "", "tables": {}, "next_id": 0})
        return db

    def open(self, name: str) -> Database:
        if name not in self.databases():
            raise QueryError(f"no database {name}")
        return Database(self.spark, f"{self.folder}/{name}")

    def delete(self, name: str) -> None:
        self.open(name)
        self.files.delete(f"{self.folder}/{name}")


#: Parts of a table, one of each commit that has only added rows, from which the next commit writes it whole.
MOST_PARTS = 32


class Database:
    """Versions of a schema and of edge tables. A version is a manifest that names the parts of each table; a part is written once and never changed, so readers keep theirs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, _Files(spark)

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in self.files.list(f"{self.folder}/manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/manifests/{version:012d}.json"))

    def publish(self, version: int, manifest: dict) -> None:
        if not self.files.create(f"{self.folder}/manifests/{version:012d}.json", json.dumps(manifest)):
            raise ConflictError("another transaction was committed first")

    def transaction(self, kind: str = "read") -> Transaction:
        if kind not in ("read", "write", "schema"):
            raise QueryError(f"no transaction kind {kind}")
        return Transaction(self, kind)

    def schema(self, functions: bool = True) -> str:
        return Catalog.of(self.manifest(self.version())["schema"]).text(functions)

    def export(self, folder: str) -> None:
        """Schema text and all tables as Parquet."""
        tx = self.transaction()
        self.files.create(f"{folder}/schema.txt", tx.catalog.text())
        for name, df in tx.store.tables.items():
            df.write.parquet(f"{folder}/{name}")

    def load(self, folder: str) -> None:
        """Takes over an export into an empty database; the data is checked like a commit's."""
        tx = self.transaction("schema")
        if tx.catalog.types:
            raise QueryError("the database is not empty")
        tx.query(text) if (text := self.files.read(f"{folder}/schema.txt")) else None
        top = -1
        for kind in ("thing", "has", "links", "attr"):
            for label in self.files.list(f"{folder}/{kind}"):
                df = self.spark.read.parquet(f"{folder}/{kind}/{label}")
                tx.writer._put(f"{kind}/{label}", df)
                if kind == "thing":
                    top = max(top, df.agg(F.max("iid")).first()[0] or -1)
        tx.writer.next_id = top + 1
        tx.commit()


class Transaction:
    """One snapshot. Reads see it and what the transaction has written; commit publishes the next version or fails if there is one already."""

    def __init__(self, db: Database, kind: str):
        self.db, self.kind, self.spark = db, kind, db.spark
        self.base = db.version()
        m = db.manifest(self.base)
        self.catalog = Catalog.of(m["schema"])
        self.paths: dict[str, list[str]] = m["tables"]
        self.store = EdgeStore(self.spark, self.catalog, {n: self.spark.read.parquet(*(f"{db.folder}/tables/{x}" for x in p)) for n, p in self.paths.items()})
        self.writer = Writer(Compiler(self.spark, self.catalog, self.store), self.store, m["next_id"])
        self.open = True
        self.schema_changed = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        self.close()

    def query(self, text: str, given: DataFrame | None = None) -> DataFrame | None:
        self._alive()
        p = parsed(text)
        if isinstance(p, A.Schema):
            if self.kind != "schema":
                raise QueryError("schema queries need a schema transaction")
            before = self.catalog.copy()
            self.catalog.apply(p)
            tables, moved = dict(self.store.tables), before.copy()
            try:
                calls.check(self.catalog.functions)
                for r in p.items:
                    if isinstance(r, A.Rename):
                        moved.rename(r)
                        self._rename(r)
                self._fits(moved)
            except Exception:
                self.store.tables = tables
                self.catalog.types, self.catalog.functions, self.catalog.structs = before.types, before.functions, before.structs
                raise
            self.schema_changed = True
            self.writer.c = Compiler(self.spark, self.catalog, self.store)
            return None
        writes = any(isinstance(s, (A.Write, A.Delete)) for s in p.stages)
        if writes and self.kind == "read":
            raise QueryError("writes need a write transaction")
        compiler = Compiler(self.spark, self.catalog, self.store, {f.name: f for f in p.functions})
        calls.check(compiler.functions)
        if not writes:
            return run(compiler, p, given)[0]
        self.writer.c = compiler
        before, changed, added = dict(self.store.tables), set(self.writer.changed), {n: list(d) for n, d in self.writer.added.items()}
        try:
            return run(compiler, p, given, self.writer)[0]
        except Exception:
            self.store.tables, self.writer.changed, self.writer.added = before, changed, added
            raise

    def _rename(self, r: A.Rename) -> None:
        """Tables of a type or role that has another name."""
        old, new = (str(r.label), f"{r.label.scope}:{r.to}") if r.label.scope else (r.label.name, r.to)
        out = {}
        for name, df in self.store.tables.items():
            kind, label = name.split("/", 1)
            target = f"{kind}/{new}" if label == old else name
            fixed = df
            for c in ("owner_type", "player_type"):
                if c in df.columns and not r.label.scope:
                    fixed = fixed.withColumn(c, F.when(F.col(c) == old, new).otherwise(F.col(c)))
            if "role" in df.columns:
                role = F.when(F.col("role") == old, new).otherwise(F.col("role"))
                if not r.label.scope:
                    role = F.when(F.substring_index("role", ":", 1) == old, F.concat(F.lit(new + ":"), F.substring_index("role", ":", -1))).otherwise(F.col("role"))
                fixed = fixed.withColumn("role", role)
            out[target] = fixed
            if target != name or fixed is not df:
                self.writer.changed.add(target)
        self.store.tables = out
        self.paths = {n: p for n, p in self.paths.items() if n in out}

    def _fits(self, before: Catalog) -> None:
        """A changed schema holds for the data that is there."""
        for label, t in before.types.items():
            for table in (f"thing/{label}", f"links/{label}", f"has/{label}", f"attr/{label}"):
                if table in self.store.tables and (label not in self.catalog.types or self.catalog.types[label].abstract and table.startswith("thing")) and not self.store.tables[table].isEmpty():
                    raise SchemaError(f"{label} has instances")
            if label not in self.catalog.types or t.kind not in OBJECTS:
                continue
            for a in set(before.owns(label)) - set(self.catalog.owns(label)):
                for c in before.concrete(a):
                    table = self.store.tables.get(f"has/{c}")
                    if table is not None and not table.where(F.col("owner_type") == label).isEmpty():
                        raise SchemaError(f"{label} owns instances of {a}")
            for r in set(before.plays(label)) - set(self.catalog.plays(label)):
                table = self.store.tables.get(f"links/{r.split(':')[0]}")
                if table is not None and not table.where((F.col("player_type") == label) & (F.col("role") == r)).isEmpty():
                    raise SchemaError(f"{label} plays {r} in instances")
        if self.store.tables:
            w = Writer(Compiler(self.spark, self.catalog, self.store), self.store)
            w.changed = {n for n in self.store.tables if n.split("/", 1)[1] in self.catalog.types}
            try:
                w.validate()
                for a in self.catalog.of_kind("attribute"):
                    if f"has/{a}" in self.store.tables:
                        w._check_value(self.store.tables[f"has/{a}"], "value", a, self.catalog.value_notes(a))
            except WriteError as e:
                raise SchemaError(str(e)) from e

    def analyse(self, text: str) -> dict:
        self._alive()
        return analyse(self.spark, self.catalog, self.store, text)

    def _alive(self) -> None:
        if not self.open:
            raise QueryError("the transaction is closed")

    def commit(self) -> None:
        self._alive()
        if self.kind == "read":
            raise QueryError("a read transaction has nothing to commit")
        self.writer.clean()
        self.writer.validate()
        if self.schema_changed or self.writer.changed:
            written: dict[str, list[str]] = {}
            for name in sorted(self.writer.changed):
                if name.split("/", 1)[1] not in self.catalog.types:
                    continue
                path = f"{name.replace('/', '-')}-{uuid.uuid4().hex}"
                new, old = self.writer.delta(name), self.paths.get(name, [])
                whole = new is None or len(old) >= MOST_PARTS
                (self.store.tables[name] if whole else new).write.parquet(f"{self.db.folder}/tables/{path}")
                written[name] = [path] if whole else [*old, path]
            self._publish(written)
        self.open = False

    def _publish(self, written: dict[str, list[str]]) -> None:
        """The next version: this transaction's tables over those of the newest version. It fails if a transaction that was committed since the snapshot has changed the schema or one of these tables."""
        first, paths, top = self.db.manifest(self.base), self.paths, self.writer.next_id
        while True:
            latest = self.db.version()
            if latest != self.base:
                now = self.db.manifest(latest)
                theirs = {n for n in {*now["tables"], *first["tables"]} if now["tables"].get(n) != first["tables"].get(n)}
                if self.schema_changed or now["schema"] != first["schema"] or theirs & self.writer.changed:
                    raise ConflictError("another transaction has changed the same tables")
                paths, top = now["tables"], max(now["next_id"], self.writer.next_id)
            tables = {n: p for n, p in {**paths, **written}.items() if n.split("/", 1)[1] in self.catalog.types}
            try:
                return self.db.publish(latest + 1, {"schema": self.catalog.text(), "tables": tables, "next_id": top})
            except ConflictError:
                if self.db.version() == latest:
                    raise

    def rollback(self) -> None:
        """Back to the snapshot."""
        self._alive()
        self.__init__(self.db, self.kind)

    def close(self) -> None:
        self.open = False


def profile(df: DataFrame) -> list[dict]:
    """Runs a query's DataFrame and gives the nodes of its final plan with their metrics."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out: list[dict] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan(), depth)
            return
        if name.endswith("QueryStage"):
            walk(node.plan(), depth)
            return
        metrics, it = {}, node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            metrics[pair._1()] = pair._2().value()
        out.append({"node": name, "depth": depth, "metrics": metrics})
        children = node.children()
        for k in range(children.length()):
            walk(children.apply(k), depth + 1)

    walk(execution.executedPlan(), 0)
    return out
