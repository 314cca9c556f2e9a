"""Fields of tables and the rules by which they compare.

A *typed* table has one column for each field, where NULL means that the field is missing. A *dynamic* table has its
fields in a map column ``fields`` from name to VALUE, a struct that says its own type; a stored none is a value there.

Equality is strict: an integer never equals a float. Order compares numbers across types, strings by bytes, and nothing
else. A missing field satisfies no comparison, not even ``!=``: a comparison may be NULL, which counts as false, so that
filters reach the scan as they are.
"""

from __future__ import annotations

import json
import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = "struct<t:string,b:boolean,i:bigint,f:double,s:string,v:array<double>>"
_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def kind_of(value: Any) -> str:
    if value is None:
        return "none"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return "string" if isinstance(value, str) else "array"


def value_struct(value: Any) -> dict:
    """A literal as a VALUE row."""
    k = kind_of(value)
    out = {"t": k, "b": None, "i": None, "f": None, "s": None, "v": None}
    if k == "array":
        out["s"] = json.dumps(value)
        if value and all(kind_of(x) in ("int", "float") for x in value):
            out["v"] = [float(x) for x in value]
    elif k != "none":
        out[k[0]] = value
    return out


def value_of(row: Any) -> Any:
    """The literal of a VALUE row."""
    if row is None or row["t"] == "none":
        return None
    if row["t"] == "array":
        return json.loads(row["s"])
    return row[row["t"][0]]


def value_column(value: Any) -> Column:
    v = value_struct(value)
    return F.struct(
        F.lit(v["t"]).alias("t"), F.lit(v["b"]).cast("boolean").alias("b"), F.lit(v["i"]).cast("bigint").alias("i"), F.lit(v["f"]).cast("double").alias("f"), F.lit(v["s"]).cast("string").alias("s"),
        (F.array(*map(F.lit, v["v"])) if v["v"] is not None else F.lit(None)).cast("array<double>").alias("v"),
    )


def compare_literals(a: Any, op: str, b: Any) -> bool:
    ka, kb = kind_of(a), kind_of(b)
    if op in ("=", "!="):
        same = ka == kb and (a == b if ka != "array" else len(a) == len(b) and all(compare_literals(x, "=", y) for x, y in zip(a, b)))
        return same == (op == "=")
    if ka in ("int", "float") and kb in ("int", "float"):
        return _OPS[op](a, b)
    return ka == kb == "string" and _OPS[op](a.encode(), b.encode())


class Missing:
    """A field that the table doesn't have."""

    def compare(self, op: str, value: Any) -> Column:
        return F.lit(False)

    def is_none(self) -> Column:
        return F.lit(True)

    def sort(self, descending: bool) -> list[Column]:
        return []

    def output(self) -> Column:
        return F.lit(None).cast("string")

    group = output


class Constant:
    def __init__(self, value: Any):
        self.value = value

    def compare(self, op: str, value: Any) -> Column:
        return F.lit(compare_literals(self.value, op, value))

    def is_none(self) -> Column:
        return F.lit(self.value is None)

    def output(self) -> Column:
        v = self.value
        if isinstance(v, list):
            kinds = {kind_of(x) for x in v}
            return F.array(*map(F.lit, v)) if len(kinds) == 1 and not kinds & {"array", "none"} else F.lit(json.dumps(v))
        return F.lit(v) if v is not None else F.lit(None).cast("string")


class Typed:
    """A column whose SQL type is known; NULL is a missing field."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.type = column, kind
        self.kind = next((k for k, t in (("bool", T.BooleanType), ("int", T.IntegralType), ("float", T.FractionalType), ("string", T.StringType), ("array", T.ArrayType), ("time", T.TimestampType | T.DateType | T.TimestampNTZType)) if isinstance(kind, t)), "other")

    def compare(self, op: str, value: Any) -> Column:
        k = kind_of(value)
        if self.kind == "time" and k == "string":  # beyond the language's own types
            return _OPS[op](self.column, F.lit(value).cast(self.type))
        if op in ("=", "!="):
            if k != self.kind or k == "none":
                same = None
            elif k == "array":
                inner = Typed(self.column, self.type.elementType).kind
                same = self.column == F.array(*map(F.lit, value)).cast(self.type) if all(kind_of(x) == inner for x in value) else None
            else:
                same = self.column == F.lit(value)
            if same is None:
                return F.lit(False) if op == "=" else self.column.isNotNull()
            return same if op == "=" else self.column != F.lit(value) if k != "array" else ~same
        numbers = self.kind in ("int", "float") and k in ("int", "float")
        if not numbers and not self.kind == k == "string":
            return F.lit(False)
        out = _OPS[op](self.column, F.lit(value))
        if self.kind == "float":
            out = out & ~F.isnan(self.column) if op in (">", ">=") else out  # NaN sorts greatest here
        return out

    def is_none(self) -> Column:
        return self.column.isNull()

    def sort(self, descending: bool) -> list[Column]:
        if self.kind in ("array", "other"):
            return [self.column.isNull().desc() if descending else self.column.isNull().asc()]
        return [self.column.desc_nulls_first() if descending else self.column.asc_nulls_last()]

    def output(self) -> Column:
        return self.column

    group = output


class Dynamic:
    """A VALUE column; NULL is a missing field."""

    def __init__(self, column: Column):
        self.column = column

    def compare(self, op: str, value: Any) -> Column:
        c, k = self.column, kind_of(value)
        if op in ("=", "!="):
            same = c["t"] == k
            if k == "array":
                same = same & (c["s"] == json.dumps(value))
            elif k != "none":
                same = same & (c[k[0]] == F.lit(value))
            same = F.coalesce(same, F.lit(False))
            return same if op == "=" else c.isNotNull() & ~same
        if k in ("int", "float"):
            out = F.when(c["t"] == "int", _OPS[op](c["i"], F.lit(value))).when((c["t"] == "float") & ~F.isnan(c["f"]), _OPS[op](c["f"], F.lit(value)))
        elif k == "string":
            out = F.when(c["t"] == "string", _OPS[op](c["s"], F.lit(value)))
        else:
            return F.lit(False)
        return out

    def is_none(self) -> Column:
        return self.column.isNull() | (self.column["t"] == "none")

    def sort(self, descending: bool) -> list[Column]:
        c = self.column
        empty = F.coalesce(self.is_none(), F.lit(True))
        number = F.coalesce(c["f"], c["i"].cast("double"))
        rank = F.when(number.isNotNull(), 0).when(c["t"] == "string", 1).when(c["t"] == "bool", 2).otherwise(3)
        keys = [empty, F.when(~empty, rank), number, F.when(c["t"] == "string", c["s"]), c["b"]]
        return [k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys]

    def output(self) -> Column:
        return self.column

    def group(self) -> Column:
        c = self.column
        return F.when(~self.is_none(), c)


Term = Missing | Constant | Typed | Dynamic


def field(df: DataFrame, name: str) -> Term:
    """The field of that name in a typed or dynamic table."""
    if is_dynamic(df):
        return Dynamic(F.try_element_at(F.col("fields"), F.lit(name)))
    for f in df.schema.fields:
        if f.name == name and name != "_id":
            return Typed(F.col(f"`{name}`"), f.dataType)
    return Missing()


def is_dynamic(df: DataFrame) -> bool:
    f = next((f for f in df.schema.fields if f.name == "fields"), None)
    return f is not None and isinstance(f.dataType, T.MapType)
