"""Weighted fusion of text and vector ranking, and the rule for filtered searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERFETCH = 10


def fetched(limit: int, filtered: bool) -> int:
    """A filter applies after the ranking, to ten times the limit; fewer rows than the limit may remain."""
    return limit * OVERFETCH if filtered else limit


def _unit(score: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))


def _normalised(hits: DataFrame, score: str, name: str) -> DataFrame:
    """Scores of a list moved to [0, 1]; all equal gives 1."""
    ends = hits.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))  # one row
    return hits.crossJoin(F.broadcast(ends)).select("_id", _unit(F.col(score), F.col("lo"), F.col("hi")).alias(name))


def fuse(text: DataFrame, vector: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(_id, score, text_score, vector_score) of the union of two rankings (_id, score) and (_id, distance)."""
    a = min(1.0, max(0.0, alpha))
    t = _normalised(text, "score", "text_score")
    v = _normalised(vector.select("_id", (-F.col("distance")).alias("near")), "near", "vector_score")
    both = t.join(v, "_id", "full_outer").select("_id", F.coalesce("text_score", F.lit(0.0)).alias("text_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"))
    return both.select("_id", (a * F.col("text_score") + (1 - a) * F.col("vector_score")).alias("score"), "text_score", "vector_score")
