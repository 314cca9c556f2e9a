"""Tables, edge tables, indexes and their versions, by namespace and database."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dml
from tessella.operators.relational import keyed
from tessella.plans.schema import FieldDef, Schema
from tessella.sources.snapshots import written

CUT = 16  # changes of a table between two snapshots


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    fields: tuple[str, ...]
    kind: str = "index"  # index, fulltext, vector
    unique: bool = False
    analyzer: str = "default"
    dimension: int = 0
    metric: str = "cosine"


@dataclass
class Stored:
    """A table's present version; a function that gives it is called when first asked."""

    made: DataFrame | Callable[[], DataFrame]
    version: int = 0
    since_cut: int = 0

    @property
    def df(self) -> DataFrame:
        if not isinstance(self.made, DataFrame):
            self.made = self.made()
        return self.made

    @df.setter
    def df(self, value: DataFrame) -> None:
        self.made = value


@dataclass
class Catalog:
    """What statements read and change. Names are case-sensitive."""

    spark: SparkSession
    namespace: str = "default"
    database: str = "default"
    tables: dict[str, Stored] = field(default_factory=dict)
    edges: dict[str, Stored] = field(default_factory=dict)
    indexes: dict[tuple[str, str], Index] = field(default_factory=dict)
    schemas: dict[str, Schema] = field(default_factory=dict)
    built: dict[tuple, Any] = field(default_factory=dict)

    def add_table(self, name: str, df: DataFrame | Callable[[], DataFrame], key: str | None = None, schema: Schema | None = None) -> None:
        """A typed table; key names the column that becomes the record id."""
        if key is not None and isinstance(df, DataFrame):
            df = keyed(df, key)
        self.tables[name] = Stored(df)
        if schema:
            self.schemas[name] = schema

    def add_edges(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        self.edges[name] = Stored(df)

    def table(self, name: str) -> DataFrame:
        s = self.tables.get(name)
        return s.df if s else dml.empty(self.spark)

    def edge_table(self, name: str) -> DataFrame:
        s = self.edges.get(name)
        return s.df if s else dml.empty_edges(self.spark)

    def version(self, name: str, edges: bool = False) -> int:
        s = (self.edges if edges else self.tables).get(name)
        return s.version if s else 0

    def change(self, name: str, df: DataFrame, edges: bool = False) -> None:
        """df as the table's next version; every CUT versions it is written out."""
        where = self.edges if edges else self.tables
        if not edges and df.schema["_id"].metadata:
            df = df.withColumn("_id", F.col("_id").alias("_id", metadata={}))  # new rows needn't have the key column
        s = where.setdefault(name, Stored(df))
        s.since_cut += 1
        if s.since_cut >= CUT:
            df, s.since_cut = written(df, name), 0
        s.df, s.version = df, s.version + 1

    def snapshot(self, name: str, edges: bool = False) -> DataFrame:
        """The table written out, so that reading and changing it no longer depend on how it came about."""
        s = (self.edges if edges else self.tables).get(name)
        if s is None:
            return self.edge_table(name) if edges else self.table(name)
        s.df, s.since_cut = written(s.df, name), 0
        return s.df

    def indexes_of(self, table: str, kind: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.table == table and i.kind == kind]

    # -- saving: a folder with a Parquet table for each table and a JSON file that names them

    def save(self, path: str) -> None:
        """Writes tables, edges and index definitions to a new version in a folder, then points the folder to it."""
        version = uuid.uuid4().hex
        names: dict[str, Any] = {"version": version, "namespace": self.namespace, "database": self.database, "tables": sorted(self.tables), "edges": sorted(self.edges), "indexes": [asdict(i) for i in self.indexes.values()], "schemas": [asdict(s) for s in self.schemas.values()]}
        for kind, stored in (("tables", self.tables), ("edges", self.edges)):
            for name, s in stored.items():
                s.df.write.parquet(f"{path}/{version}/{kind}/{name}")
        self.spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.mode("append").text(f"{path}/catalog")

    @staticmethod
    def saved(spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalog/_SUCCESS")
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """The catalog saved last; its tables are read when first asked for."""
        last = spark.read.text(f"{path}/catalog").select("value", F.col("_metadata.file_modification_time").alias("at")).orderBy(F.col("at").desc(), "value").first()
        d = json.loads(last.value)
        out = cls(spark, d["namespace"], d["database"])
        for kind, add in (("tables", out.add_table), ("edges", out.add_edges)):
            for name in d[kind]:
                add(name, lambda where=f"{path}/{d['version']}/{kind}/{name}": spark.read.parquet(where))
        for i in d["indexes"]:
            out.indexes[i["name"], i["table"]] = Index(**i | {"fields": tuple(i["fields"])})
        for s in d["schemas"]:
            out.schemas[s["name"]] = Schema(s["name"], tuple(FieldDef(**f) for f in s["fields"]), s["closed"])
        return out
