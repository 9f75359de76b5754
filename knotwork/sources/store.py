"""Where instances come from: columns of existing tables, or edge tables that write stages make."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.values import spark_type
from knotwork.schema import Catalog


@dataclass
class Source:
    """Instances of one type as rows of a table.

    key: columns that identify an instance. attrs: attribute type -> column (null: not owned).
    roles: role -> (player type, columns with the player's key).
    """

    type: str
    table: str
    key: tuple[str, ...]
    attrs: dict[str, str] = field(default_factory=dict)
    roles: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)


class Store:
    """What the compiler reads."""

    def sources(self, label: str) -> list[Source]:
        raise NotImplementedError

    def frame(self, table: str) -> DataFrame:
        raise NotImplementedError

    def has(self, owner: str, attr: str) -> DataFrame | None:
        """Edge table (owner, value), where ownerships are no columns."""
        return None

    def links(self, rel: str) -> DataFrame | None:
        """Edge table (rel, role, player_type, player), where players are no columns."""
        return None

    def independent(self, attr: str) -> DataFrame | None:
        """Values (value) of an attribute type that need no owner."""
        return None


class MappedStore(Store):
    """Types over tables that are there: nothing is copied, filters and columns reach the scans."""

    def __init__(self, spark: SparkSession, folder: str, sources: list[Source], suffix: str = ".parquet"):
        self.spark, self.folder, self.suffix = spark, folder, suffix
        self.by_type: dict[str, list[Source]] = {}
        for s in sources:
            self.by_type.setdefault(s.type, []).append(s)
        self.frames: dict[str, DataFrame] = {}

    def sources(self, label: str) -> list[Source]:
        return self.by_type.get(label, [])

    def frame(self, table: str) -> DataFrame:
        if table not in self.frames:
            self.frames[table] = self.spark.read.parquet(f"{self.folder}/{table}{self.suffix}")
        return self.frames[table]


class EdgeStore(Store):
    """Instances, ownerships and role players as tables of edges: thing/T (iid), has/A (owner_type, owner, value), links/R (rel, role, player_type, player), attr/A (value)."""

    def __init__(self, spark: SparkSession, catalog: Catalog, tables: dict[str, DataFrame]):
        self.spark, self.catalog, self.tables = spark, catalog, tables

    def schema(self, table: str) -> str:
        kind, label = table.split("/")
        if kind == "thing":
            return "iid bigint"
        if kind == "links":
            return "rel bigint, role string, player_type string, player bigint"
        value = f"value {spark_type(self.catalog.value_type(label))}"
        return value if kind == "attr" else f"owner_type string, owner bigint, {value}"

    def frame(self, table: str) -> DataFrame:
        if table not in self.tables:
            self.tables[table] = self.spark.createDataFrame([], self.schema(table))
        return self.tables[table]

    def sources(self, label: str) -> list[Source]:
        return [Source(label, f"thing/{label}", ("iid",))]

    def has(self, owner: str, attr: str) -> DataFrame | None:
        return self.frame(f"has/{attr}").where(F.col("owner_type") == owner).select("owner", "value")

    def links(self, rel: str) -> DataFrame | None:
        return self.frame(f"links/{rel}")

    def independent(self, attr: str) -> DataFrame | None:
        return self.frame(f"attr/{attr}") if any("independent" in self.catalog.types[t].notes.flags for t in self.catalog.supers(attr)) else None
