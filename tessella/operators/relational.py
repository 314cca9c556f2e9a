"""Scans, filters, projections, order, limits and counts over tables with an ``_id`` key column."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.lang import statements as st
from tessella.operators.fields import Constant, Term, Typed, field, is_dynamic

Functions = dict[str, Callable[..., tuple[Column, str]]]


def term(df: DataFrame, item: st.Item, functions: Functions | None = None) -> Term:
    """What an item of a statement stands for in df. An unknown function, or one with the wrong arguments, is missing."""
    from tessella.operators.fields import Missing

    if isinstance(item, st.Constant):
        return Constant(item.value)
    if isinstance(item, st.Field):
        return field(df, item.name)
    f = (functions or {}).get(item.name)
    if f is None:
        return Missing()
    made = f(*(term(df, a, functions) for a in item.args))
    if made is None:
        return Missing()
    column, kind = made
    from pyspark.sql.types import _parse_datatype_string

    return Typed(column, _parse_datatype_string(kind))


def predicate(df: DataFrame, where: st.Where, functions: Functions | None = None) -> Column | None:
    """The condition of a WHERE clause, where NULL counts as false; None if there is none."""
    parts = []
    for w in where:
        if isinstance(w, st.IsNone):
            c = field(df, w.field).is_none()
            parts.append(~c if w.negated else c)
        else:
            parts.append(term(df, w.item, functions).compare(w.op, w.value))
    return reduce(lambda a, b: a & b, parts) if parts else None


def where(df: DataFrame, clause: st.Where, functions: Functions | None = None) -> DataFrame:
    c = predicate(df, clause, functions)
    return df if c is None else df.where(c)


def sort_columns(df: DataFrame, order: Sequence[st.SortKey]) -> list[Column]:
    """Missing values come last ascending and first descending; the key breaks ties."""
    return [c for k in order for c in field(df, k.field).sort(k.descending)] + [F.col("_id").asc()]


def ordered(df: DataFrame, order: Sequence[st.SortKey] = (), limit: int | None = None) -> DataFrame:
    """df in order; a limit alone takes the first rows by key."""
    if order or limit is not None:
        df = df.orderBy(*sort_columns(df, order))
    return df if limit is None else df.limit(limit)


def record_id(table: str) -> Column:
    return F.concat(F.lit(table + ":"), F.col("_id")).alias("id")


def project(df: DataFrame, table: str, items: Sequence[st.Item] | None = None, functions: Functions | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """The items (all fields if None), then ``extra`` columns of df, and the record id, which replaces a field called id."""
    if items is None:
        cols = [F.col(f"`{c}`") for c in df.columns if c not in ("_id", "id", *extra)]
    else:
        names = {}
        for i in items:
            if i.column not in ("id", *extra):
                names[i.column] = term(df, i, functions).output().alias(i.column)
        cols = list(names.values())
    return df.select(*cols, *[F.col(f"`{c}`") for c in extra], record_id(table))


def keyed(df: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """df with record ids made of a prefix and a key column, which by_id() then looks for in the files' statistics."""
    made = F.concat(F.lit(prefix), F.col(f"`{key}`").cast("string")) if prefix else F.col(f"`{key}`").cast("string")
    return df.select("*", made.alias("_id", metadata={"key": key, "prefix": prefix}))


def by_id(df: DataFrame, key: str) -> Column:
    """The condition for one record; of a keyed table it names the key column, too."""
    out, meta = F.col("_id") == key, df.schema["_id"].metadata
    if meta.get("key") not in df.columns:
        return out
    column, raw = Typed(F.col(f"`{meta['key']}`"), df.schema[meta["key"]].dataType), key.removeprefix(meta["prefix"])
    if column.kind == "int":
        return out & (column.column == int(raw)) if re.fullmatch(r"-?\d{1,18}", raw) else out
    return out & (column.column == raw) if column.kind == "string" else out


def select(df: DataFrame, s: st.Select, functions: Functions | None = None) -> DataFrame:
    """A SELECT other than a traversal."""
    if s.target.id is not None:
        df = df.where(by_id(df, s.target.id))
    return project(ordered(where(df, s.where, functions), s.order, s.limit), s.target.table, s.items, functions)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by hash of a key in four partitions a core: a small file is one or two tasks, however costly what follows is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def multi_get(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df for ids (pos, _id) in the order of pos; ids without a row are skipped."""
    return ids.join(df, "_id").orderBy("pos")


def count(df: DataFrame, clause: st.Where = (), functions: Functions | None = None) -> DataFrame:
    return where(df, clause, functions).agg(F.count(F.lit(1)).alias("count"))


def count_by(df: DataFrame, name: str, clause: st.Where = (), functions: Functions | None = None) -> DataFrame:
    """Rows (field, count), the largest count first, then by value; missing and none are one group, which comes last."""
    f = field(df, name)
    grouped = where(df, clause, functions).groupBy(f.group().alias(name)).agg(F.count(F.lit(1)).alias("count"))
    tail = field(grouped, name).sort(False) if not is_dynamic(df) else [F.col(f"`{name}`.t").asc_nulls_last(), F.col(f"`{name}`.i").asc(), F.col(f"`{name}`.f").asc(), F.col(f"`{name}`.s").asc(), F.col(f"`{name}`.b").asc()]
    return grouped.orderBy(F.col("count").desc(), *tail)
