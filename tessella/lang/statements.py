"""Statements as plain data. Literals are Python values: None, bool, int, float, str, list."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Literal = Any


def shown(value: Literal) -> str:
    """A literal as it names a column."""
    if value is None:
        return "NONE"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, float):
        return plain(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(shown, value)) + "]"
    return str(value)


def plain(x: float) -> str:
    """A float in full, without an exponent or a trailing .0."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    s = repr(float(x))
    if "e" in s:
        from decimal import Decimal

        s = format(Decimal(s), "f")
    return s[:-2] if s.endswith(".0") else s


@dataclass(frozen=True)
class Field:
    name: str

    @property
    def column(self) -> str:
        return self.name


@dataclass(frozen=True)
class Constant:
    value: Literal

    @property
    def column(self) -> str:
        return shown(self.value)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Item, ...]

    @property
    def column(self) -> str:
        return f"{self.name}({', '.join(a.column for a in self.args)})"


Item = Field | Constant | Call


@dataclass(frozen=True)
class Compare:
    item: Item
    op: str
    value: Literal


@dataclass(frozen=True)
class IsNone:
    field: str
    negated: bool


Where = tuple[Compare | IsNone, ...]  # all of them must hold


@dataclass(frozen=True)
class Hop:
    edge: str
    table: str
    outgoing: bool


@dataclass(frozen=True)
class Chain:
    hops: tuple[Hop, ...]
    field: str | None = None


@dataclass(frozen=True)
class Target:
    table: str
    id: str | None = None


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False


Assigned = tuple[tuple[str, Literal], ...]


@dataclass(frozen=True)
class Create:
    target: Target
    fields: Assigned
    on_conflict: bool = False
    conflict_fields: Assigned | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | Chain | None  # None: all fields
    target: Target
    where: Where = ()
    order: tuple[SortKey, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Update:
    target: Target
    fields: Assigned
    where: Where = ()


@dataclass(frozen=True)
class Delete:
    target: Target
    where: Where = ()


@dataclass(frozen=True)
class Relate:
    source: Target
    edge: str
    dest: Target
    fields: Assigned = ()


@dataclass(frozen=True)
class Count:
    table: str
    where: Where = ()
    group: str | None = None


@dataclass(frozen=True)
class GraphCommunities:
    edge: str
    algorithm: str = "louvain"
    max_iter: int = 10
    resolution: float = 1.0


@dataclass(frozen=True)
class GraphComponents:
    edge: str


@dataclass(frozen=True)
class GraphPageRank:
    edge: str
    damping: float = 0.85
    max_iter: int = 100
    limit: int | None = None


@dataclass(frozen=True)
class GraphCentrality:
    edge: str
    mode: str = "degree"
    limit: int | None = None


@dataclass(frozen=True)
class GraphPath:
    source: str
    dest: str
    edge: str
    max_depth: int | None = None


@dataclass(frozen=True)
class GraphEdges:
    edge: str
    where: Where = ()


@dataclass(frozen=True)
class DefineIndex:
    name: str
    table: str
    fields: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class DefineFulltext:
    name: str
    table: str
    field: str
    analyzer: str = "default"


@dataclass(frozen=True)
class DefineVector:
    name: str
    table: str
    field: str
    dimension: int
    metric: str = "cosine"


@dataclass(frozen=True)
class RemoveIndex:
    name: str
    table: str


@dataclass(frozen=True)
class Search:
    table: str
    field: str
    query: str
    where: Where = ()
    limit: int | None = None


@dataclass(frozen=True)
class VectorSearch:
    table: str
    field: str
    vector: tuple[float, ...]
    where: Where = ()
    k: int | None = None


@dataclass(frozen=True)
class HybridSearch:
    table: str
    text_field: str
    query: str
    vector_field: str
    vector: tuple[float, ...]
    alpha: float = 0.5
    where: Where = ()
    limit: int | None = None


@dataclass(frozen=True)
class Compact:
    pass


@dataclass(frozen=True)
class Query:
    statement: Any
    outcome: str = "JSON"
    options: dict = field(default_factory=dict)
