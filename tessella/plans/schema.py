"""Schemas of tables whose fields are fixed, and their validation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from tessella.errors import SchemaError
from tessella.operators.fields import kind_of

TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "array": T.ArrayType(T.StringType()), "object": T.MapType(T.StringType(), T.StringType()), "record_id": T.StringType(), "vector": T.ArrayType(T.FloatType())}


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    required: bool = False
    dimension: int | None = None


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[FieldDef, ...]
    closed: bool = True  # unknown fields are errors

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("_id", T.StringType(), False), *[T.StructField(f.name, TYPES[f.type]) for f in self.fields]])

    def validate(self, doc: dict[str, Any]) -> None:
        """SchemaError if doc misses a required field, has an unknown one or a value of another type. None fits any type."""
        if not self.closed:
            return
        known = {f.name: f for f in self.fields}
        for f in self.fields:
            if f.required and doc.get(f.name) is None:
                raise SchemaError(f"missing required field: {f.name}")
        for k, v in doc.items():
            f = known.get(k)
            if f is None:
                raise SchemaError(f"unknown field: {k}")
            if v is None:
                continue
            kind = kind_of(v)
            if f.type == "vector":
                if kind != "array" or any(kind_of(x) not in ("int", "float") for x in v):
                    raise SchemaError(f"field {k}: expected a vector")
                if f.dimension is not None and len(v) != f.dimension:
                    raise SchemaError(f"field {k}: expected dimension {f.dimension}, got {len(v)}")
            elif f.type == "record_id":
                if kind != "string" or ":" not in v:
                    raise SchemaError(f"field {k}: expected a record id")
            elif kind != f.type and not (f.type == "bytes" and isinstance(v, bytes)) and not (f.type == "object" and isinstance(v, dict)):
                raise SchemaError(f"field {k}: expected {f.type}, got {kind}")
