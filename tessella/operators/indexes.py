"""Indexes as objects: tables of tokens or vectors that are changed by record and searched as a whole.

Changes wait until ``commit``, which writes the index as a new version; searches see the last version. ``save`` and ``load``
move an index between sessions as a Parquet table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import QueryError
from tessella.operators import text, vector
from tessella.sources.snapshots import written


class _Index:
    def __init__(self, spark: SparkSession, table: DataFrame):
        self.spark, self.table = spark, table
        self.pending: dict[str, tuple | None] = {}

    def upsert_table(self, rows: DataFrame) -> None:
        """Rows (_id and content) in place of those with the same ids; visible at once."""
        self.commit()
        new = rows.select(*self.table.columns).dropDuplicates(["_id"])
        self.table = written(self.table.join(new.select("_id"), "_id", "left_anti").select(*self.table.columns).unionByName(new), "index")

    def remove(self, ids: Iterable[str]) -> None:
        for i in ids:
            self.pending[i] = None

    def commit(self) -> None:
        if not self.pending:
            return
        ids = self.spark.createDataFrame([(i,) for i in self.pending], "_id string")
        new = self.spark.createDataFrame([(i, *v) for i, v in self.pending.items() if v is not None], self.table.schema)
        self.table = written(self.table.join(ids, "_id", "left_anti").select(*self.table.columns).unionByName(new), "index")
        self.pending = {}

    def __len__(self) -> int:
        return self.table.count()

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)


class TextIndex(_Index):
    def __init__(self, spark: SparkSession, analyzer: str = "default", table: DataFrame | None = None):
        super().__init__(spark, table if table is not None else spark.createDataFrame([], "_id string, tokens array<string>"))
        self.analyzer = text.analyzer(analyzer)
        self.inverted: tuple[DataFrame, text.Postings] | None = None  # of which table

    def upsert(self, key: str, body: str) -> None:
        self.pending[key] = (text.tokens_of(body, self.analyzer),)

    def add(self, docs: DataFrame, field: str) -> None:
        """All texts of a table's field."""
        self.upsert_table(text.index(docs, field, self.analyzer))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        if self.inverted is None or self.inverted[0] is not self.table:
            self.inverted = self.table, text.postings(self.table)
        return text.search(self.inverted[1], query, limit, self.analyzer)

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: str = "default") -> TextIndex:
        return cls(spark, analyzer, spark.read.parquet(path))


class VectorIndex(_Index):
    def __init__(self, spark: SparkSession, dimension: int, metric: str = "cosine", table: DataFrame | None = None):
        super().__init__(spark, table if table is not None else spark.createDataFrame([], "_id string, v array<double>"))
        self.dimension, self.metric = dimension, vector.metric(metric)

    def _checked(self, v: Sequence[float]) -> list[float]:
        if len(v) != self.dimension:
            raise QueryError(f"dimension mismatch: expected {self.dimension}, got {len(v)}")
        return [float(x) for x in v]

    def upsert(self, key: str, v: Sequence[float]) -> None:
        self.pending[key] = (self._checked(v),)

    def add(self, docs: DataFrame, field: str) -> None:
        """All vectors of a table's field that have the dimension."""
        self.upsert_table(vector.index(docs, field, self.dimension))

    def search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        return vector.search(self.table, self._checked(query), k, self.metric)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dimension: int, metric: str = "cosine") -> VectorIndex:
        return cls(spark, dimension, metric, spark.read.parquet(path).where(F.size("v") == dimension))
