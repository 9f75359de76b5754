"""Rows of a pipeline: a DataFrame and what its columns mean."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.values import Value


@dataclass(frozen=True)
class Info:
    """A variable. kind: object, attr, value, type or list. types: labels it can have. value: its value type. A variable of several types has its label in a second column."""

    kind: str
    types: frozenset = frozenset()
    value: str | None = None
    optional: bool = False

    @property
    def tagged(self) -> bool:
        return self.kind in ("object", "attr") and len(self.types) > 1


def tag(v: str) -> str:
    return f"{v}#t"


def named(v: str) -> bool:
    return not v.startswith("_")


@dataclass
class Plan:
    df: DataFrame
    vars: dict[str, Info]
    hidden: list[str] = field(default_factory=list)  # columns that go along: the arguments of a function call
    order: list = field(default_factory=list)
    unique: bool = False  # whether no two rows are equal

    def columns(self, *names: str) -> list[str]:
        out = []
        for v in names or self.vars:
            out.append(v)
            if self.vars[v].tagged:
                out.append(tag(v))
        return out

    def only(self, names) -> Plan:
        vars = {v: i for v, i in self.vars.items() if v in names}
        out = Plan(self.df, vars, self.hidden, self.order)
        out.df = self.df.select(*(F.col(f"`{c}`") for c in [*out.columns(*vars), *self.hidden])) if vars or self.hidden else self.df.select()
        return out

    def with_df(self, df: DataFrame) -> Plan:
        return replace(self, df=df)

    def value(self, name: str) -> Value:
        if name not in self.vars:
            raise QueryError(f"${name} is not bound")
        i = self.vars[name]
        if i.kind == "object":
            raise QueryError(f"${name} has no value")
        return Value(F.col(f"`{name}`"), "string" if i.kind == "type" else i.value)

    def label(self, name: str):
        """Column with the type label of a variable."""
        i = self.vars[name]
        if i.kind == "type":
            return F.col(f"`{name}`")
        return F.col(f"`{tag(name)}`") if i.tagged else F.lit(next(iter(i.types)))
