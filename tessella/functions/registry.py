"""The scalar functions of the query language: ast::*, as Arrow-batched pandas UDFs.

Each takes the terms of its arguments and gives (column, SQL type), or None if their number is wrong. Bad input gives NULL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import metaast as m
from tessella.operators.fields import Constant, Dynamic, Term, Typed


def _text(t: Term) -> Column:
    if isinstance(t, Constant):
        return F.lit(t.value if isinstance(t.value, str) else None).cast("string")
    if isinstance(t, Dynamic):
        return F.when(t.column["t"] == "string", t.column["s"])
    return t.column if isinstance(t, Typed) and t.kind == "string" else F.lit(None).cast("string")


def _number(t: Term, kind: str) -> Column:
    if isinstance(t, Constant):
        v = t.value
        return F.lit(v if isinstance(v, int | float) and not isinstance(v, bool) else None).cast(kind)
    if isinstance(t, Dynamic):
        return F.coalesce(t.column["i"].cast(kind), t.column["f"].cast(kind))
    return t.column.cast(kind) if isinstance(t, Typed) and t.kind in ("int", "float") else F.lit(None).cast(kind)


def _safe(f: Callable, *args):
    """None in, or anything that isn't a tree: None out."""
    if any(a is None or a != a for a in args):
        return None
    try:
        return f(*args)
    except (ValueError, RecursionError, TypeError, AttributeError):
        return None


def _udf(f: Callable, kind: str, n: int) -> Callable[..., Column]:
    if n == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return pd.Series([_safe(f, x) for x in a], dtype=object)

        return one

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_safe(f, x, y) for x, y in zip(a, b)], dtype=object)

    return two


@lru_cache(maxsize=2)  # a tree is often compared with itself; no function here changes it
def _read(text: str) -> m.Node:
    return m.read(text)


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _clones(text: str, threshold: float) -> str:
    return _json(m.clones([m.node(d) for d in json.loads(text)], threshold))


def registry() -> dict[str, Callable[..., tuple[Column, str] | None]]:
    complexity = _udf(lambda a: m.complexity(_read(a)), "bigint", 1)
    digest = _udf(lambda a: m.structural_hash(_read(a)), "bigint", 1)
    similarity = _udf(lambda a, b: m.similarity(_read(a), _read(b)), "double", 2)
    diff = _udf(lambda a, b: _json(m.diff(_read(a), _read(b))), "string", 2)
    scope = _udf(lambda a, n: _json([x.data() for x in m.scope(_read(a), int(n))]), "string", 2)
    clones = _udf(_clones, "string", 2)

    def made(n: int, build: Callable[..., Column], kind: str):
        return lambda *args: (build(*args), kind) if len(args) == n else None

    return {
        "ast::complexity": made(1, lambda a: complexity(_text(a)), "bigint"),
        "ast::hash": made(1, lambda a: digest(_text(a)), "bigint"),
        "ast::similarity": made(2, lambda a, b: similarity(_text(a), _text(b)), "double"),
        "ast::diff": made(2, lambda a, b: diff(_text(a), _text(b)), "string"),
        "ast::scope": made(2, lambda a, n: scope(_text(a), _number(n, "bigint")), "string"),
        "ast::clones": made(2, lambda a, t: clones(_text(a), F.coalesce(_number(t, "double"), F.lit(0.8))), "string"),
    }
