"""Tokens of source code: identifiers split at underscores and case changes, lower-cased, without noise words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE = frozenset(
    # declarations and modifiers
    "abstract class const def defmodule enum fn func function impl interface let module mut override private protected pub static struct super this self trait type var void "
    # flow
    "async await begin case catch do elif else elsif end finally for if match new raise rescue return then throw try when while with yield "
    # words and values
    "and as false from import in is nil none not null of or require true use".split()
)
_WORD = re.compile(r"[^\W_]+")
_CASE = re.compile(r"(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", re.ASCII)


def tokenize(text: str) -> list[str]:
    out = []
    for word in _WORD.findall(text):
        for part in _CASE.split(word):
            low = part.lower()
            if len(low.encode()) > 1 and low not in NOISE:
                out.append(low)
    return out


def code_tokens(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def tokens(col: pd.Series) -> pd.Series:
        return col.map(lambda t: tokenize(t) if t is not None else None)

    return tokens(text)
