"""Clones among all trees of a table: equal shapes by their hash, similar ones by shared subtrees.

No pair of trees is compared for the sake of being in one table: shapes stand for their trees, and two shapes meet where
more than half of the smaller one's subtrees occur in the other. Spark guesses the size of trees from the compressed files
that they come from, so no join here leaves it to broadcast them: a join has a written table of ids on its right or is a merge.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import metaast as m
from tessella.sources.snapshots import written


def _each(trees: DataFrame, ddl: str, row: Callable[[str, list[int]], tuple]) -> DataFrame:
    """id and what row(text, fingerprint) has of trees (id, ast_serialized); what isn't a tree is skipped."""
    kind = trees.schema["id"].dataType.simpleString()
    names = ["id", *[c.split()[0] for c in ddl.split(", ")]]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf.id, pdf.ast_serialized):
                try:
                    prints = m.fingerprint(m.read(text))
                except (ValueError, TypeError, RecursionError):
                    continue
                out.append((i, *row(text, prints)))
            yield pd.DataFrame(out, columns=names)

    return trees.select("id", "ast_serialized").mapInPandas(part, f"id {kind}, {ddl}")


def shapes(trees: DataFrame) -> DataFrame:
    """id and shape (the structural hash of the tree) of trees (id, ast_serialized)."""
    return _each(trees, "shape long", lambda text, prints: (prints[0],))


def subtrees(trees: DataFrame) -> DataFrame:
    """id, shape, text, size and subtrees (hash, n) of trees (id, ast_serialized)."""
    return _each(trees, "shape long, text string, size int, subtrees array<struct<hash:long,n:int>>", lambda text, prints: (prints[0], text, len(prints), [{"hash": h, "n": n} for h, n in Counter(prints).items()]))


def classes(trees: DataFrame) -> DataFrame:
    """(id, class_id, links): the least id of the trees of equal shape, and how many others there are."""
    own = shapes(trees)
    sizes = written(own.groupBy("shape").agg(F.min("id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links")), "shapes")
    return own.join(sizes, "shape", "left").select("id", "class_id", "links")


def links(trees: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of the class_ids a < b whose trees, of different shape, are at least that similar."""
    first = written(shapes(trees).groupBy("shape").agg(F.min("id").alias("id")), "shapes")
    stand = subtrees(trees.join(first, "id", "left_semi")).join(first, ["shape", "id"], "left_semi")
    one = written(stand.dropDuplicates(["shape"]), "subtrees")
    sub = one.select("id", "size", F.explode("subtrees").alias("s")).select("id", "size", "s.hash", "s.n")
    # a subtree that nearly all have tells nothing by itself: pairs must share more than half, and each shape's rarest half is enough to find them
    often = sub.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    key = F.struct("often", "hash", "n")
    ranked = sub.join(often.where("often > 1").hint("merge"), "hash").groupBy("id", "size").agg(F.array_sort(F.collect_list(key)).alias("k"))
    alone = F.col("size") - F.aggregate("k", F.lit(0), lambda s, x: s + x["n"])  # what no other shape has, rarest of all
    before = F.transform("k", lambda x, i: F.struct(x["hash"].alias("hash"), (alone + F.aggregate(F.slice("k", 1, i), F.lit(0), lambda s, y: s + y["n"])).alias("before")))
    # of two shapes, the first subtree that both have stands among the first half of the smaller one
    prefix = ranked.select("id", "size", F.explode(before).alias("p")).select("id", "size", "p.hash", "p.before")
    a, b = prefix.withColumnsRenamed({"id": "a", "size": "na", "before": "ba"}), prefix.withColumnsRenamed({"id": "b", "size": "nb", "before": "bb"})
    met = a.join(b.hint("merge"), "hash").where((F.col("a") < F.col("b")) & F.when(F.col("na") <= F.col("nb"), 2 * F.col("ba") < F.col("na")).otherwise(2 * F.col("bb") < F.col("nb"))).select("a", "b").distinct()
    x, y = (one.select(F.col("id").alias(k), F.col("size").alias("n" + k), F.col("subtrees").alias("s" + k)).hint("merge") for k in "ab")
    both = met.join(x, "a").join(y, "b")
    common = F.aggregate(F.flatten(F.transform("sa", lambda p: F.transform(F.filter("sb", lambda q: q["hash"] == p["hash"]), lambda q: F.least(p["n"], q["n"])))), F.lit(0), lambda s, n: s + n)
    near = both.where(2 * common > F.least("na", "nb")).select("a", "b")
    ta, tb = (one.select(F.col("id").alias(k), F.col("text").alias("t" + k)).hint("merge") for k in "ab")
    texts = near.join(ta, "a").join(tb, "b")

    @F.pandas_udf("double")
    def similarity(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([m.similarity(m.read(s), m.read(t)) for s, t in zip(p, q)], dtype=float)

    return texts.select("a", "b", similarity("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold)
