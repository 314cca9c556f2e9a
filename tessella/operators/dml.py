"""Changes of tables as DataFrame to DataFrame: every change gives the table after it.

Tables are keyed by ``_id``. Typed tables have a column for each field, dynamic ones a map of VALUE structs.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import QueryError, SchemaError
from tessella.lang import statements as st
from tessella.operators import relational
from tessella.operators.fields import VALUE, Typed, is_dynamic, kind_of, value_column, value_struct

Row = tuple[str, dict[str, Any]]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"_id string, fields map<string,{VALUE}>")


def rows(like: DataFrame, docs: Sequence[Row]) -> DataFrame:
    """Documents as rows of a table like that one; a typed table must know their fields and types."""
    spark = like.sparkSession
    if is_dynamic(like):
        return spark.createDataFrame([(i, {k: value_struct(v) for k, v in d.items()}) for i, d in docs], f"_id string, fields map<string,{VALUE}>")
    known = {f.name: f.dataType for f in like.schema.fields}
    for _, d in docs:
        for k, v in d.items():
            check(known, k, v)
    schema = T.StructType([T.StructField(n, t) for n, t in known.items()])
    return spark.createDataFrame([tuple(i if n == "_id" else d.get(n) for n in known) for i, d in docs], schema)


def check(known: dict[str, T.DataType], name: str, value: Any) -> None:
    if name not in known or name == "_id":
        raise SchemaError(f"unknown field: {name}")
    kind = Typed(None, known[name]).kind
    if value is not None and kind != kind_of(value):
        raise SchemaError(f"field {name}: expected {kind}, got {kind_of(value)}")


def duplicates(df: DataFrame, new: DataFrame) -> DataFrame:
    """The keys of new that df has."""
    return new.select("_id").join(df.select("_id"), "_id", "left_semi")


def create(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new)


def replace(df: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new in place of those with the same key, and beside the others."""
    return df.join(new.select("_id"), "_id", "left_anti").unionByName(new)


def upsert(df: DataFrame, new: DataFrame, set_on_conflict: st.Assigned | None = None) -> DataFrame:
    """new merged into df: its fields win where it has them. With set_on_conflict, rows that exist get that instead."""
    own = [c for c in df.columns if c != "_id"]
    other = new.select(F.col("_id").alias("_new"), *[F.col(f"`{c}`").alias(f"_new_{c}") for c in own])
    both = df.join(other, df["_id"] == F.col("_new"), "full_outer")
    is_new = df["_id"].isNull()
    out = [F.coalesce(df["_id"], F.col("_new")).alias("_id")]
    for c in own:
        old, add = df[c], F.col(f"`_new_{c}`")
        if set_on_conflict is not None:
            hit = F.col("_new").isNotNull() & ~is_new
            kept = F.when(hit, _assigned(old, c, df, dict(set_on_conflict))).otherwise(old)
            out.append(F.when(is_new, add).otherwise(kept).alias(c))
        elif is_dynamic(df):
            out.append(F.when(is_new, add).when(F.col("_new").isNull(), old).otherwise(_merged(old, add)).alias(c))
        else:
            out.append(F.coalesce(add, old).alias(c))
    return both.select(*out)


def _merged(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def _assigned(old: Column, column: str, df: DataFrame, fields: dict[str, Any]) -> Column:
    if is_dynamic(df):
        return _merged(old, F.map_from_entries(F.array(*[F.struct(F.lit(k), value_column(v)) for k, v in fields.items()]))) if column == "fields" and fields else old
    if column not in fields:
        return old
    v = fields[column]
    return (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(df.schema[column].dataType)


def update(df: DataFrame, fields: st.Assigned, hit: Column) -> DataFrame:
    """fields set in the rows where hit (never NULL) holds."""
    given = dict(fields)
    if not is_dynamic(df):
        known = {f.name: f.dataType for f in df.schema.fields}
        for k, v in given.items():
            check(known, k, v)
    return df.select("_id", *[F.when(hit, _assigned(F.col(f"`{c}`"), c, df, given)).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns if c != "_id"])


def delete(df: DataFrame, hit: Column) -> DataFrame:
    return df.where(~hit)


def hits(df: DataFrame, target: st.Target, where: st.Where = (), functions=None) -> Column:
    """The condition of a target, never NULL: a record, or the rows of a WHERE (all rows without one)."""
    if target.id is not None:
        return F.coalesce(relational.by_id(df, target.id), F.lit(False))
    c = relational.predicate(df, where, functions)
    return F.lit(True) if c is None else F.coalesce(c, F.lit(False))


def unique_violations(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Values of fields, all present, that more than one row has."""
    from tessella.operators.fields import field

    terms = [field(df, f) for f in fields]
    rows = df
    for t in terms:
        rows = rows.where(~t.is_none())
    return rows.groupBy(*[t.group().alias(f) for t, f in zip(terms, fields)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# -- edges


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"src string, dst string, fields map<string,{VALUE}>")


def edge_rows(like: DataFrame, edges: Sequence[tuple[str, str, dict[str, Any]]]) -> DataFrame:
    last = {(a, b): d for a, b, d in edges}
    spark = like.sparkSession
    if is_dynamic(like):
        return spark.createDataFrame([(a, b, {k: value_struct(v) for k, v in d.items()}) for (a, b), d in last.items()], f"src string, dst string, fields map<string,{VALUE}>")
    known = {f.name: f.dataType for f in like.schema.fields}
    for d in last.values():
        for k, v in d.items():
            check(known, k, v)
    return spark.createDataFrame([tuple({"src": a, "dst": b}.get(n, d.get(n)) for n in known) for (a, b), d in last.items()], like.schema)


def relate(df: DataFrame, new: DataFrame) -> DataFrame:
    """new in place of the edges with the same ends, and beside the others."""
    return df.join(new.select("src", "dst"), ["src", "dst"], "left_anti").select(*df.columns).unionByName(new)


def edge(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.where((F.col("src") == src) & (F.col("dst") == dst))


def unrelate(df: DataFrame, src: str, dst: str) -> DataFrame:
    """df without an edge."""
    return df.where(~F.coalesce((F.col("src") == src) & (F.col("dst") == dst), F.lit(False)))


def update_edge(df: DataFrame, src: str, dst: str, fields: st.Assigned) -> DataFrame:
    """df with properties of an edge set; QueryError if there is no such edge."""
    if edge(df, src, dst).isEmpty():
        raise QueryError(f"no edge from {src} to {dst}")
    hit = F.coalesce((F.col("src") == src) & (F.col("dst") == dst), F.lit(False))
    return df.select(*[F.when(hit, _assigned(F.col(f"`{c}`"), c, df, dict(fields))).otherwise(F.col(f"`{c}`")).alias(c) if c not in ("src", "dst") else F.col(c) for c in df.columns])
