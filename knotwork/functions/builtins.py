"""Functions on concepts: iids, labels and the documentation and metadata that the schema holds. All but iid are look-ups in tables as large as the schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.plans import ast as A
from knotwork.plans.infer import resolve
from knotwork.plans.plan import Info, Plan

_EDGES = ("owns", "plays", "relates", "sub")
NAMES = (
    {"iid", "label", "get_doc", "get_meta", "get_all_meta", "get_fun_doc", "get_fun_meta", "get_fun_all_meta"}
    | {f"get_{e}_{what}" for e in _EDGES for what in ("doc", "meta", "all_meta")}
)


def iid(c, types, label, key):
    """Column with the iid of instances of these types: a number for the type, then the key; of a key that is no whole number the hash of its text. c: the compiler."""
    out = F.lit(None).cast("string")
    for k, t in enumerate(c.catalog.types):
        if t in types:
            rest = F.lpad(F.lower(F.hex(key.cast("bigint"))), 16, "0") if c._iid_type(t) == "bigint" else F.md5(key.cast("string").cast("binary"))
            out = F.when(label == t, F.concat(F.lit(f"0x{k:04x}"), rest)).otherwise(out)
    return out


def with_iid(c, types, label, key, text: str):
    """Condition that an instance has this iid. A whole number is compared as such."""
    labels, digits = list(c.catalog.types), text[2:].lower()
    t = labels[int(digits[:4], 16)] if len(digits) > 4 and int(digits[:4], 16) < len(labels) else None
    if t not in types:
        return F.lit(False)
    if c._iid_type(t) != "bigint":
        return (label == t) & (iid(c, {t}, label, key) == "0x" + digits)
    if len(digits) != 20:
        return F.lit(False)
    n = int(digits[4:], 16)
    n -= (1 << 64) * (n >= 1 << 63)
    return (label == t) & (key == F.lit(n if {c._iid_type(x) for x in types} == {"bigint"} else str(n)))


def _edges(catalog, kind: str):
    """(left type, right type, notes) of all capabilities, inherited ones too."""
    for t, d in catalog.types.items():
        if kind == "sub":
            if d.sup:
                yield t, d.sup, d.sub_notes
        elif kind == "relates":
            if d.kind == "relation":
                for r, e in catalog.relates(t).items():
                    yield t, r, e.notes
        elif d.kind in ("entity", "relation"):
            for o, e in getattr(catalog, kind)(t).items():
                yield t, o, e.notes


def apply(c, plan: Plan, call: A.Call, outs: list[str]) -> tuple[Plan, bool]:
    """plan with the result of a call in `outs`; a result that is not there drops the row. c: the compiler."""
    name, args = call.name, list(call.args)
    if name == "iid":
        v = args[0].name
        return _bind(c, plan, outs, [iid(c, plan.vars[v].types, plan.label(v), F.col(f"`{v}`"))])
    if name == "label":
        return _bind(c, plan, outs, [plan.label(args[0].name) if isinstance(args[0], A.Var) else F.lit(resolve(c.catalog, args[0]))])
    stream = name.endswith("all_meta")
    keyed = name.endswith("_meta") and not stream
    key = args.pop(0) if keyed else None
    if key is not None and not isinstance(key, A.Lit):
        raise QueryError("a metadata key is a literal")
    if name.startswith("get_fun"):
        (f,) = args
        if not isinstance(f, A.Lit) or f.value not in c.functions:
            raise QueryError("no such function")
        notes = c.functions[f.value].annotations
        rows = [(str(n.args[0].value), str(n.args[1].value)) for n in notes if n.name == "meta"]
        if stream:
            return _rows(c, plan, outs, [], rows)
        text = dict(rows).get(key.value, "") if keyed else next((n.args[0].value for n in notes if n.name == "doc"), "")
        return _bind(c, plan, outs, [F.lit(text)])
    edge = next((e for e in _EDGES if name.startswith(f"get_{e}_")), None)
    known = list(_edges(c.catalog, edge)) if edge else [(t, d.notes) for t, d in c.catalog.types.items()]
    if not edge and not keyed and not stream or edge and not keyed and not stream:
        found = [(*row[:-1], row[-1].doc or "") for row in known]
    elif keyed:
        found = [(*row[:-1], row[-1].meta.get(key.value, "")) for row in known]
    else:
        found = [(*row[:-1], k, v) for row in known for k, v in sorted(row[-1].meta.items())]
    cols = [plan.label(a.name) if isinstance(a, A.Var) else F.lit(resolve(c.catalog, a)) for a in args]
    return _rows(c, plan, outs, cols, found)


def _rows(c, plan: Plan, outs: list[str], cols, found) -> tuple[Plan, bool]:
    n = len(cols)
    names = [f"#k{i}" for i in range(n)] + [f"#o{i}" for i in range(len(outs))]
    if any(len(row) != len(names) for row in found):
        raise QueryError("another number of results")
    table = F.broadcast(c.spark.createDataFrame(found, ", ".join(f"`{x}` string" for x in names)))
    df = plan.df.crossJoin(table) if not n else plan.df.join(table, [col == F.col(f"`#k{i}`") for i, col in enumerate(cols)])
    plan, _ = _bind(c, plan.with_df(df), outs, [F.col(f"`#o{i}`") for i in range(len(outs))])
    return plan.with_df(plan.df.drop(*names)), False


def _bind(c, plan: Plan, outs, cols) -> tuple[Plan, bool]:
    df, vars = plan.df, dict(plan.vars)
    for v, col in zip(outs, cols, strict=True):
        if v in vars:
            df = df.where(F.col(f"`{v}`") == col)
        else:
            df = df.withColumn(v, col)
            vars[v] = Info("value", value="string")
    return Plan(df, vars, plan.hidden, plan.order), False
