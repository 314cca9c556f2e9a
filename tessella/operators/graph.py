"""Graph operators over edge tables (src, dst, weight and other properties), each edge once for a (src, dst).

Vertices are bare ids. Iterative operators write what one round hands to the next to the shared folder, so that
neither lineage nor a lost executor adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.lang import statements as st
from tessella.operators import relational
from tessella.operators.fields import Dynamic, Typed, field, is_dynamic
from tessella.sources.snapshots import written


def weight(edges: DataFrame) -> Column:
    """The weight property if it is a number, else 1.0."""
    w = field(edges, "weight")
    if isinstance(w, Dynamic):
        c = w.column
        return F.coalesce(c["f"], c["i"].cast("double"), F.lit(1.0))
    return F.coalesce(w.column.cast("double"), F.lit(1.0)) if isinstance(w, Typed) and w.kind in ("int", "float") else F.lit(1.0)


def weighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", weight(edges).alias("weight"))


def edge_rows(edges: DataFrame, edge_type: str, where: st.Where = ()) -> DataFrame:
    """Rows (src, dst, edge_type, weight, properties) that satisfy where, which may name any of them."""
    props = [F.col(f"`{c}`") for c in edges.columns if c not in ("src", "dst", "edge_type", "weight")]
    if is_dynamic(edges):
        rows = edges.select("src", "dst", F.lit(edge_type).alias("edge_type"), weight(edges).alias("weight"), "fields")
        known = {"src", "dst", "edge_type", "weight"}
        typed = rows.drop("fields")
        own = tuple(w for w in where if _name(w) in known)
        c = relational.predicate(typed, own)
        rest = relational.predicate(rows, tuple(w for w in where if _name(w) not in known))
        for x in (c, rest):
            rows = rows if x is None else rows.where(x)
        return rows.withColumn("fields", F.map_filter("fields", lambda k, v: ~k.isin(*known)))
    rows = edges.select("src", "dst", F.lit(edge_type).alias("edge_type"), weight(edges).alias("weight"), *props)
    return relational.where(rows, where)


def _name(w: st.Compare | st.IsNone) -> str | None:
    return w.field if isinstance(w, st.IsNone) else getattr(w.item, "name", None)


def outgoing(edges: DataFrame, vertex: str, keep: Column | None = None) -> DataFrame:
    rows = edges.where(F.col("src") == vertex)
    return rows if keep is None else rows.where(keep)


def incoming(edges: DataFrame, vertex: str, keep: Column | None = None) -> DataFrame:
    rows = edges.where(F.col("dst") == vertex)
    return rows if keep is None else rows.where(keep)


def neighbors(edges: DataFrame, vertex: str, out: bool = True) -> DataFrame:
    """Neighbour ids, not deduplicated."""
    return (outgoing(edges, vertex).select(F.col("dst").alias("_id"))) if out else incoming(edges, vertex).select(F.col("src").alias("_id"))


def walk(start: DataFrame, hops: Sequence[tuple[DataFrame, bool]]) -> DataFrame:
    """Every path from the ids of start along the hops (edges, outgoing), as an array; paths may come back."""
    paths = start.select(F.array("_id").alias("path"))
    for edges, out in hops:
        a, b = ("src", "dst") if out else ("dst", "src")
        step = edges.select(F.col(a).alias("_at"), F.col(b).alias("_to"))
        paths = paths.join(step, F.element_at("path", -1) == F.col("_at")).select(F.concat("path", F.array("_to")).alias("path"))
    return paths


def hop(frontier: DataFrame, edges: DataFrame, out: bool) -> DataFrame:
    """The distinct neighbours of frontier (_id)."""
    a, b = ("src", "dst") if out else ("dst", "src")
    return edges.join(frontier.select(F.col("_id").alias(a)), a, "left_semi").select(F.col(b).alias("_id")).distinct()


def traverse(start: DataFrame, hops: Sequence[tuple[DataFrame, bool]], dest: DataFrame, where: st.Where = (), limit: int | None = None, functions=None) -> DataFrame:
    """The rows of dest that the hops lead to from the ids of start. A limit takes the first in the order of discovery."""
    if limit is None:
        for edges, out in hops:
            start = hop(start, edges, out)
        return relational.where(dest.join(start, "_id", "left_semi"), where, functions)
    # vertices are discovered in the order of the least sequence of ids that leads to them; a sequence's place among those of a
    # round stands for it, since the least of numbers is kept by hash before rows move, while sequences would all be sorted
    found = start.select("_id", F.lit(0).alias("_before"))
    for edges, out in hops:
        a, b = ("src", "dst") if out else ("dst", "src")
        step = edges.select(F.col(a).alias("_id"), F.col(b).alias("_to"))
        placed = found.orderBy("_before", "_id").select("_id", F.monotonically_increasing_id().alias("_place"))
        # written, places don't change when a lost task runs again, and Spark knows the size of what it may broadcast
        found = written(placed, "places").join(step, "_id").groupBy("_to").agg(F.min("_place").alias("_before")).withColumnRenamed("_to", "_id")
    return relational.where(dest.join(found, "_id"), where, functions).orderBy("_before", "_id").limit(limit).drop("_before")


def centrality(edges: DataFrame, mode: str = "degree", limit: int | None = None) -> DataFrame:
    """(id, score): raw degrees of all endpoints, the highest first; a loop counts at both its ends."""
    out, into = {"degree": (1.0, 1.0), "outdegree": (1.0, 0.0), "indegree": (0.0, 1.0)}[mode]
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(out).alias("n")), F.struct(F.col("dst").alias("id"), F.lit(into).alias("n")))).alias("e"))
    ranked = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.n").alias("score")).orderBy(F.col("score").desc(), "id")
    return ranked if limit is None else ranked.limit(limit)


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, limit: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): weighted power iteration; weights of 0 or less carry nothing, dangling rank spreads evenly.

    Edges are shuffled by src once and kept that way, so a round moves ranks alone: one join on src and one aggregation
    on dst. Sources of more edges than a partition should hold, of which there can't be more than partitions, are salted: their
    edges are dealt out by dst and their rank goes to each share. A round is one job: it writes the ranks, and what
    convergence needs is observed meanwhile.
    """
    w = weighted(edges).withColumn("weight", F.greatest("weight", F.lit(0.0)))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    positive = w.where("weight > 0")
    out = written(positive.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("edges")), "sources")
    every = out.agg(F.sum("edges")).first()[0] or 0
    salts = F.when(F.col("edges") * parts > every, F.least(F.lit(parts), F.ceil(F.col("edges") * parts / F.lit(max(every, 1))))).otherwise(F.lit(1)).cast("int")
    ids = w.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    base = written(ids.join(out.select("id", salts.alias("salts")), "id", "left").select("id", F.coalesce("salts", F.lit(0)).alias("salts")), "vertices")
    n, lost = base.agg(F.count(F.lit(1)), F.coalesce(F.count_if(F.col("salts") == 0), F.lit(0))).first()
    if n == 0:
        return base.select("id", F.lit(0.0).alias("score"))
    share = positive.join(out.select(F.col("id").alias("src"), "total", salts.alias("salts")), "src")
    flow = share.select("src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst", (F.col("weight") / F.col("total")).alias("part"))
    flow = written(flow, "flow").repartition(parts, "src", "salt").persist()  # what an executor loses is read from the written table again
    rank, lost = base.select("id", "salts", F.lit(1.0 / n).alias("score")), lost / n
    for _ in range(max_iter):
        sent = rank.where("salts > 0").select(F.col("id").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        got = flow.join(sent, ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        new = rank.withColumnRenamed("score", "old").join(got, "id", "left").select("id", "salts", "old", ((1 - damping) / n + damping * lost / n + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        seen = Observation()
        change, dangling = F.sum(F.abs(F.col("score") - F.col("old"))), F.sum(F.when(F.col("salts") == 0, F.col("score")))
        rank = written(new.observe(seen, change.alias("change"), F.coalesce(dangling, F.lit(0.0)).alias("lost")).select("id", "salts", "score"), "rank")
        lost = seen.get["lost"]
        if seen.get["change"] < tolerance:
            break
    flow.unpersist()
    ranked = rank.select("id", "score").orderBy(F.col("score").desc(), "id")
    return ranked if limit is None else ranked.limit(limit)


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): undirected components, each named by its least id. Alternates large-star and small-star steps."""
    edges = written(edges.select("src", "dst"), "edges")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    e = edges.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    state = None
    while True:
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        # a vertex that very many lead to is aggregated before it is shuffled, and joined as AQE splits it
        large = both.where("v > u").join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
        small = low.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        e = written(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return ids.join(e.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """One row (component_count, largest, nodes)."""
    sizes = connected(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("component_count"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))


def component_members(edges: DataFrame) -> DataFrame:
    """(representative, members in order)."""
    return connected(edges).groupBy(F.col("component").alias("representative")).agg(F.array_sort(F.collect_list("id")).alias("members"))


def path(edges: DataFrame, source: str, dest: str, max_depth: int | None = None) -> DataFrame:
    """One row (found, length, path): of the shortest directed paths, the one that is least as a sequence of ids."""
    spark = edges.sparkSession
    ddl = "found boolean, length bigint, path array<string>"
    if source == dest:
        return spark.createDataFrame([(True, 0, [source])], ddl)
    step = edges.select("src", "dst")
    front = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    seen, depth = front.select("id"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = front.join(step, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")).withColumnRenamed("dst", "id")
        front = written(reached.join(seen, "id", "left_anti"), "front")
        hit = front.where(F.col("id") == dest).first()
        if hit:
            return spark.createDataFrame([(True, depth, hit.path)], ddl)
        if front.isEmpty():
            break
        seen = written(seen.union(front.select("id")), "seen")
    return spark.createDataFrame([(False, -1, [])], ddl)
