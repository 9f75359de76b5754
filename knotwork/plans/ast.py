"""What the parser makes: terms, constraints, stages, functions and schema statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# ------------------------------------------------------------------ terms and expressions


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def anonymous(self) -> bool:
        return self.name.startswith("_")


@dataclass(frozen=True)
class Label:
    """A type label; a role has the label of its relation as scope, or none if it stands alone."""

    name: str
    scope: str | None = None

    def __str__(self) -> str:
        return f"{self.scope}:{self.name}" if self.scope else self.name


@dataclass(frozen=True)
class Lit:
    value: Any
    kind: str  # a value type


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    low: Any
    high: Any


# ------------------------------------------------------------------ constraints


@dataclass
class Isa:
    thing: Var
    type: Any  # Label or Var
    exact: bool = False


@dataclass
class Has:
    owner: Var
    type: Any  # Label, Var or None
    attr: Var


@dataclass
class Links:
    rel: Var
    players: list  # of (Label, Var or None; Var)


@dataclass
class Iid:
    thing: Var
    iid: str


@dataclass
class Is:
    left: Var
    right: Var


@dataclass
class Compare:
    op: str
    left: Any
    right: Any


@dataclass
class Kind:
    type: Var
    kind: str


@dataclass
class LabelIs:
    type: Var
    label: Label


@dataclass
class Sub:
    sub: Any
    sup: Any
    exact: bool = False


@dataclass
class Owns:
    owner: Any
    attr: Any


@dataclass
class Relates:
    rel: Any
    role: Any
    of: Any = None  # specialised role


@dataclass
class Plays:
    player: Any
    role: Any


@dataclass
class ValueIs:
    type: Any
    kind: str


@dataclass
class Let:
    vars: list  # of (Var, optional)
    expr: Any
    stream: bool = False


@dataclass
class Pattern:
    items: list = field(default_factory=list)


@dataclass
class Or:
    branches: list  # of Pattern


@dataclass
class Not:
    pattern: Pattern


@dataclass
class Try:
    pattern: Pattern


# ------------------------------------------------------------------ stages


@dataclass
class Given:
    vars: list  # of (Var, type, optional)


@dataclass
class Match:
    pattern: Pattern


@dataclass
class Write:
    kind: str  # insert, put, update
    pattern: Pattern


@dataclass
class Delete:
    items: list  # of ("thing", var), ("has", var, var), ("links", rel, players), ("try", items)


@dataclass
class Select:
    vars: list


@dataclass
class Sort:
    keys: list  # of (Var, descending)


@dataclass
class Offset:
    n: int


@dataclass
class Limit:
    n: int


@dataclass
class Require:
    vars: list


@dataclass
class Distinct:
    pass


@dataclass
class Reduce:
    assign: list  # of (Var, reducer, Var or None)
    by: list


@dataclass
class Fetch:
    fields: list  # of (key, FetchX)


@dataclass
class FetchExpr:
    expr: Any


@dataclass
class FetchAttr:
    var: Var
    attr: Label
    many: bool


@dataclass
class FetchAll:
    var: Var


@dataclass
class FetchObject:
    fields: list


@dataclass
class FetchSub:
    """A subquery: with `returns` one answer or a list of scalars, with a Fetch at its end a list of documents."""

    stages: list
    returns: Any
    many: bool


@dataclass
class FetchCall:
    call: Call
    many: bool


@dataclass
class FetchLabel:
    label: Label


@dataclass
class Return:
    mode: str  # stream, first, last, check, reduce
    vars: list = field(default_factory=list)
    reducers: list = field(default_factory=list)


@dataclass
class Function:
    name: str
    args: list  # of (Var, type label, optional)
    returns: list  # of (type label, optional)
    stream: bool
    stages: list
    ret: Return
    text: str = ""
    annotations: list = field(default_factory=list)


@dataclass
class Pipeline:
    functions: list
    stages: list


# ------------------------------------------------------------------ schema


@dataclass
class Annotation:
    name: str
    args: tuple = ()


@dataclass
class Capability:
    kind: str  # sub, value, owns, plays, relates, alias
    target: Any
    annotations: list = field(default_factory=list)
    of: str | None = None
    ordered: bool = False


@dataclass
class TypeStatement:
    kind: str | None
    label: Label
    capabilities: list
    annotations: list


@dataclass
class Struct:
    name: str
    fields: list  # of (name, value type, optional)


@dataclass
class Schema:
    verb: str  # define, redefine, undefine
    items: list  # TypeStatement, Struct, Function or Undefine


@dataclass
class Undefine:
    """capability or annotation taken from a type; with both empty the type, function or struct itself."""

    label: Label
    kind: str | None = None
    capability: Capability | None = None
    annotation: str | None = None


@dataclass
class Rename:
    """In redefine: a type or a role gets another name."""

    label: Label
    to: str
