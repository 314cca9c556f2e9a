"""The registered queries: every operator over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import SchemaError
from tessella.functions import clones, codetokens, ingest, metaast, registry
from tessella.lang import statements as st
from tessella.operators import ann, communities, dml, graph, relational, text, vector
from tessella.operators.fields import Constant, Typed
from tessella.operators.relational import keyed
from tessella.plans.catalog import Catalog
from tessella.plans.engine import Engine
from tessella.plans.schema import FieldDef, Schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = {"customer": ("c_custkey", "c"), "orders": ("o_orderkey", "o"), "nation": ("n_nationkey", "n"), "region": ("r_regionkey", "r"), "supplier": ("s_suppkey", "s"), "part": ("p_partkey", "p"), "events": ("event_id", "e"), "documents": ("doc_id", "")}
EDGES_SQL = {
    "in_nation": "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 1.0::DOUBLE AS weight FROM customer",
    "in_region": "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 1.0::DOUBLE AS weight FROM nation",
    "placed": "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 1.0::DOUBLE AS weight FROM orders",
    "supplied_by": "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key, prefix = KEYS[name]
    return keyed(read(spark, sf_dir, name), key, prefix)


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def ends(df: DataFrame, a: str, pa: str, b: str, pb: str) -> DataFrame:
        return df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("src"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("dst"))

    if name == "in_nation":
        return ends(read(spark, sf_dir, "customer"), "c_custkey", "c", "c_nationkey", "n")
    if name == "in_region":
        return ends(read(spark, sf_dir, "nation"), "n_nationkey", "n", "n_regionkey", "r")
    if name == "placed":
        return ends(read(spark, sf_dir, "orders"), "o_custkey", "c", "o_orderkey", "o")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), "weight")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the test tables; nothing is read before a statement asks."""
    c = Catalog(spark)
    for name in KEYS:
        c.add_table(name, lambda name=name: table(spark, sf_dir, name))
    for name in EDGES_SQL:
        c.add_edges(name, lambda name=name: edges(spark, sf_dir, name))
    return Engine(spark, c)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def statement(name: str, q: str, sql: str) -> None:
    """A query that is one statement of the language."""
    query(name, sql)(lambda spark, sf_dir: engine(spark, sf_dir).plan(q))


# -- filter, projection, order

statement(
    "select_filter_order_limit",
    "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 9000.0 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC LIMIT 10",
    "SELECT c_name, c_acctbal, 'customer:c' || c_custkey AS id FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS FIRST, 'c' || c_custkey LIMIT 10",
)
statement("select_star", "SELECT * FROM nation", "SELECT *, 'nation:n' || n_nationkey AS id FROM nation")
statement("select_ne", "SELECT o_orderpriority FROM orders WHERE o_orderstatus != 'F'", "SELECT o_orderpriority, 'orders:o' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
statement(
    "select_range_and",
    "SELECT o_totalprice FROM orders WHERE o_totalprice >= 1000.0 AND o_totalprice < 50000.5 AND o_orderpriority <= '3'",
    "SELECT o_totalprice, 'orders:o' || o_orderkey AS id FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000.5 AND o_orderpriority <= '3'",
)
statement("select_order_multi", "SELECT p_brand, p_size FROM part ORDER BY p_brand, p_size DESC LIMIT 25", "SELECT p_brand, p_size, 'part:p' || p_partkey AS id FROM part ORDER BY p_brand ASC NULLS LAST, p_size DESC NULLS FIRST, 'p' || p_partkey LIMIT 25")
statement("select_limit_scan_order", "SELECT s_name FROM supplier LIMIT 7", "SELECT s_name, 'supplier:s' || s_suppkey AS id FROM supplier ORDER BY 's' || s_suppkey LIMIT 7")
statement("point_lookup", "SELECT * FROM customer:c42", "SELECT *, 'customer:c42' AS id FROM customer WHERE c_custkey = 42")
statement("is_none", "SELECT event_type FROM events WHERE value IS NONE", "SELECT event_type, 'events:e' || event_id AS id FROM events WHERE value IS NULL")
statement("is_not_none", "COUNT events WHERE props IS NOT NONE", "SELECT count(*) AS count FROM events WHERE props IS NOT NULL")
statement("missing_field", "SELECT r_name, nowhere FROM region WHERE nowhere IS NONE", "SELECT r_name, NULL::VARCHAR AS nowhere, 'region:r' || r_regionkey AS id FROM region")
statement("strict_type_eq", "SELECT o_totalprice FROM orders WHERE o_totalprice = 24", "SELECT o_totalprice, '' AS id FROM orders WHERE false")
statement("strict_type_ne", "COUNT orders WHERE o_totalprice != 24", "SELECT count(*) AS count FROM orders WHERE o_totalprice IS NOT NULL")
statement("cross_type_range", "COUNT part WHERE p_size > 24.5", "SELECT count(*) AS count FROM part WHERE p_size > 24.5")
statement("literal_projection", "SELECT 'x', 1, r_name FROM region", "SELECT 'x' AS \"'x'\", 1 AS \"1\", r_name, 'region:r' || r_regionkey AS id FROM region")


@query("multi_get", "WITH ids(pos, k) AS (VALUES (0, 30), (1, 7), (2, 100000000), (3, 11)) SELECT pos, s_name FROM ids JOIN supplier ON s_suppkey = k")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(i, f"s{k}") for i, k in enumerate((30, 7, 100000000, 11))], "pos int, _id string")
    return relational.multi_get(table(spark, sf_dir, "supplier"), ids).select("pos", "s_name")


@query("scan_ids", "SELECT 'o' || o_orderkey AS _id FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("_id")


# -- counts

statement("count_unknown_table", "COUNT nowhere", "SELECT 0::BIGINT AS count")
statement("count_events", "COUNT events", "SELECT count(*) AS count FROM events")
statement("count_where", "COUNT orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'O'", "SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
for _t, _f in (("events", "event_type"), ("documents", "lang"), ("orders", "o_orderpriority"), ("part", "p_size")):
    statement(f"count_group_by_{_f}", f"COUNT {_t} GROUP BY {_f}", f"SELECT {_f}, count(*) AS count FROM {_t} GROUP BY 1")
statement("count_where_group_by", "COUNT events WHERE value >= 50.0 GROUP BY event_type", "SELECT event_type, count(*) AS count FROM events WHERE value >= 50 GROUP BY 1")

# -- graph

statement("graph_edges", "GRAPH EDGES supplied_by", f"SELECT src, dst, 'supplied_by' AS edge_type, weight FROM ({EDGES_SQL['supplied_by']})")
statement("graph_edges_where", "GRAPH EDGES supplied_by WHERE weight > 1.0", f"SELECT src, dst, 'supplied_by' AS edge_type, weight FROM ({EDGES_SQL['supplied_by']}) WHERE weight > 1")
for _m, _parts in (("degree", "src AS id, 1.0::DOUBLE AS n FROM e UNION ALL SELECT dst, 1.0"), ("indegree", "src AS id, 0.0::DOUBLE AS n FROM e UNION ALL SELECT dst, 1.0"), ("outdegree", "src AS id, 1.0::DOUBLE AS n FROM e UNION ALL SELECT dst, 0.0")):
    statement(f"centrality_{_m}", f"GRAPH CENTRALITY supplied_by {_m.upper()}", f"WITH e AS ({EDGES_SQL['supplied_by']}) SELECT id, sum(n) AS score FROM (SELECT {_parts} FROM e) GROUP BY id")
statement("centrality_top", "GRAPH CENTRALITY placed OUTDEGREE LIMIT 20", f"WITH e AS ({EDGES_SQL['placed']}) SELECT id, sum(n) AS score FROM (SELECT src AS id, 1.0::DOUBLE AS n FROM e UNION ALL SELECT dst, 0.0 FROM e) GROUP BY id ORDER BY score DESC, id LIMIT 20")
statement("traverse_1hop", "SELECT ->in_nation->nation FROM customer", "SELECT n.*, 'nation:n' || n_nationkey AS id FROM nation n WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
statement("traverse_2hop", "SELECT ->in_nation->nation->in_region->region.r_name FROM customer:c1", "SELECT r_name, 'region:r' || r_regionkey AS id FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1")
statement("traverse_in", "SELECT <-in_nation<-customer FROM nation:n7", "SELECT c.*, 'customer:c' || c_custkey AS id FROM customer c WHERE c_nationkey = 7")
statement("traverse_mixed", "SELECT <-placed<-customer->in_nation->nation.n_name FROM orders", "SELECT DISTINCT n_name, 'nation:n' || n_nationkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
statement("traverse_where", "SELECT ->placed->orders.o_totalprice FROM customer WHERE o_totalprice > 200000.0", "SELECT o_totalprice, 'orders:o' || o_orderkey AS id FROM orders WHERE o_totalprice > 200000 AND o_custkey IN (SELECT c_custkey FROM customer)")
statement(
    "traverse_limit",
    "SELECT ->supplied_by->supplier.s_name FROM part LIMIT 9",
    f"WITH e AS ({EDGES_SQL['supplied_by']}), f AS (SELECT dst, min([src, dst]) AS path FROM e WHERE src IN (SELECT 'p' || p_partkey FROM part) GROUP BY dst) SELECT s_name, 'supplier:s' || s_suppkey AS id FROM f JOIN supplier ON dst = 's' || s_suppkey ORDER BY path LIMIT 9",
)


@query("walk_paths", "SELECT ['c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(table(spark, sf_dir, "customer").select("_id"), [(edges(spark, sf_dir, "in_nation"), True), (edges(spark, sf_dir, "in_region"), True)])


@query("neighbors_out", "SELECT 'o' || o_orderkey AS _id FROM orders WHERE o_custkey = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf_dir, "placed"), "c1")


@query("edges_incoming", f"SELECT src, dst, weight FROM ({EDGES_SQL['supplied_by']}) WHERE dst = 's1' AND weight >= 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incoming(edges(spark, sf_dir, "supplied_by"), "s1", F.col("weight") >= 2)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to nations to regions as one edge table."""
    return edges(spark, sf_dir, "in_nation").union(edges(spark, sf_dir, "in_region"))


_PLACES = f"({EDGES_SQL['in_nation']} UNION ALL {EDGES_SQL['in_region']})"
_PATH = """WITH RECURSIVE e AS {edges}, w(v, path) AS (SELECT '{a}', ['{a}'] UNION SELECT dst, list_append(path, dst) FROM w JOIN e ON src = w.v WHERE len(path) <= {most}),
hit AS (SELECT path FROM w WHERE w.v = '{b}' ORDER BY len(path), path LIMIT 1)
SELECT count(*) > 0 AS found, coalesce(max(len(path)) - 1, -1)::BIGINT AS length, coalesce(max(path), []::VARCHAR[]) AS path FROM hit"""
for _n, _a, _b, _d in (("found", "c1", "r0", None), ("unreachable", "r0", "c1", None), ("max_depth", "c1", "r0", 1), ("self", "c1", "c1", None)):
    _goal = "c1" if _n == "self" else _b
    query(f"graph_path_{_n}", "SELECT true AS found, 0::BIGINT AS length, ['c1'] AS path" if _n == "self" else _PATH.format(edges=_PLACES, a=_a, b=_b, most=_d or 5))(
        lambda spark, sf_dir, a=_a, b=_goal, d=_d: graph.path(_places(spark, sf_dir), a, b, d)
    )

_COMPONENTS = """WITH RECURSIVE e AS {edges}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), reach(id, b) AS (SELECT id, id FROM v UNION SELECT r.id, x.b FROM reach r JOIN (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) x ON r.b = x.a),
c AS (SELECT id, min(b) AS k FROM reach GROUP BY id), s AS (SELECT k, count(*) AS n FROM c GROUP BY k) SELECT count(*) AS component_count, max(n)::BIGINT AS largest, sum(n)::BIGINT AS nodes FROM s"""
query("graph_components", """WITH e AS (SELECT n_regionkey AS k, count(DISTINCT c_custkey) + count(DISTINCT n_nationkey) + 1 AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT count(*) AS component_count, max(n)::BIGINT AS largest, sum(n)::BIGINT AS nodes FROM e""")(lambda spark, sf_dir: graph.components(_places(spark, sf_dir)))
query("graph_components_regions", _COMPONENTS.format(edges=f"({EDGES_SQL['in_region']})"))(lambda spark, sf_dir: engine(spark, sf_dir).plan("GRAPH COMPONENTS in_region"))
query("component_members", "SELECT least(min('n' || n_nationkey), 'r' || n_regionkey) AS representative, list_sort(list_append(list('n' || n_nationkey), 'r' || n_regionkey)) AS members FROM nation GROUP BY n_regionkey")(
    lambda spark, sf_dir: graph.component_members(edges(spark, sf_dir, "in_region"))
)


def _pagerank_sql(edge_sql: str, rounds: int, d: float) -> str:
    out = [f"WITH e AS MATERIALIZED ({edge_sql})", "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "n AS (SELECT count(*)::DOUBLE AS n FROM v)", "f AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS part FROM e)", "r0 AS (SELECT id, 1 / n AS score FROM v, n)"]
    for i in range(rounds):
        out.append(f"d{i} AS (SELECT coalesce(sum(score), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM e))")
        out.append(f"g{i} AS (SELECT dst, sum(score * part) AS got FROM f JOIN r{i} ON id = src GROUP BY dst)")
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT id, (1 - {d}) / n + {d} * lost / n + {d} * coalesce(got, 0) AS score FROM v LEFT JOIN g{i} ON id = dst, n, d{i})")
    return ",\n".join(out) + f"\nSELECT id, round(score, 9) AS score FROM r{rounds}"


@query("graph_pagerank", _pagerank_sql(EDGES_SQL["supplied_by"], 10, 0.85))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).plan("GRAPH PAGERANK supplied_by DAMPING 0.85 MAX_ITER 10").select("id", F.round("score", 9).alias("score"))


# the edge tables are stars around a nation or region, which are their communities
_STAR = "SELECT {hub} AS id, count(*) + 1 AS size, list_sort(list_append(list({leaf}), {hub})) AS members FROM {table} GROUP BY {key}"
_NATIONS = _STAR.format(hub="'n' || c_nationkey", leaf="'c' || c_custkey", table="customer", key="c_nationkey")
query("graph_communities_louvain", _NATIONS)(lambda spark, sf_dir: engine(spark, sf_dir).plan("GRAPH COMMUNITIES in_nation ALGORITHM louvain"))
query("graph_communities_lp", _STAR.format(hub="'r' || n_regionkey", leaf="'n' || n_nationkey", table="nation", key="n_regionkey"))(lambda spark, sf_dir: engine(spark, sf_dir).plan("GRAPH COMMUNITIES in_region ALGORITHM lp"))
query("graph_communities_distributed")(lambda spark, sf_dir: communities.synchronous(edges(spark, sf_dir, "in_nation")))

# -- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    df = keyed(read(spark, sf_dir, "embeddings"), "vec_id")
    return df, [float(x) for x in df.where("vec_id = 0").first()["embedding"]]


_DISTANCE = {"cosine": "1 - list_cosine_similarity(v, q)", "euclidean": "list_distance(v, q)", "dot": "-list_inner_product(v, q)"}
_VEC = "WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM x WHERE vec_id = 0)"
for _m, _e in _DISTANCE.items():

    @query(f"vector_{_m}", f"{_VEC} SELECT vec_id, round({_e}, 6) + 0.0 AS distance FROM x, q ORDER BY {_e}, vec_id::VARCHAR LIMIT 10")
    def _(spark: SparkSession, sf_dir: str, m=_m) -> DataFrame:
        df, q = _vectors(spark, sf_dir)
        return vector.search(vector.index(df, "embedding", 64), q, 10, m).select(F.col("_id").cast("long").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


@query("vector_all_distances", f"{_VEC} SELECT vec_id, round({_DISTANCE['cosine']}, 6) + 0.0 AS distance FROM x, q")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _vectors(spark, sf_dir)
    return df.select("vec_id", (F.round(vector.distance(F.col("embedding").cast("array<double>"), q, "cosine"), 6) + 0.0).alias("distance"))


_KNN = f"""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT y.vec_id AS query_id, x.vec_id, {{distance}} AS d FROM x, (SELECT vec_id, v AS q FROM x WHERE vec_id % 50 = 0) y),
r AS (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id::VARCHAR) AS rank FROM p) SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 10"""
for _m, _e in _DISTANCE.items():

    @query(f"vector_nearest_{_m}", _KNN.format(distance=_e))
    def _(spark: SparkSession, sf_dir: str, m=_m) -> DataFrame:
        """Every row whose id 50 divides, against all rows."""
        idx = vector.index(keyed(read(spark, sf_dir, "embeddings"), "vec_id"), "embedding", 64)
        hits = vector.nearest(idx, idx.where("cast(_id as long) % 50 = 0"), 10, m)
        return hits.select(F.col("query").cast("long").alias("query_id"), F.col("_id").cast("long").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


@query("vector_approximate", "SELECT true AS recall_of_90_percent, count(*) AS queries FROM embeddings WHERE vec_id % 50 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the approximate index at 10 neighbours, over every row whose id 50 divides, against the exact search."""
    idx = vector.index(keyed(read(spark, sf_dir, "embeddings"), "vec_id"), "embedding", 64)
    asked = idx.where("cast(_id as long) % 50 = 0")
    right = vector.nearest(idx, asked, 10).select("query", "_id")
    found = ann.build(idx).nearest(asked, 10).select("query", "_id").withColumn("found", F.lit(1))
    return right.join(found, ["query", "_id"], "left").agg((F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_of_90_percent"), F.countDistinct("query").alias("queries"))


@query("vector_filtered", f"{_VEC}, top AS (SELECT vec_id, label, {_DISTANCE['euclidean']} AS d FROM x, q ORDER BY d, vec_id::VARCHAR LIMIT 50) SELECT vec_id, label, round(d, 6) + 0.0 AS distance FROM top WHERE label = 3 ORDER BY d LIMIT 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _vectors(spark, sf_dir)
    e = Engine(spark)
    e.catalog.add_table("embeddings", df)
    e.execute("DEFINE VECTOR INDEX v ON embeddings FIELDS embedding DIMENSION 64 METRIC l2")
    hits = e.plan(st.VectorSearch("embeddings", "embedding", tuple(q), (st.Compare(st.Field("label"), "=", 3),), 5))
    return hits.select("vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


# -- text

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _bm25_sql(terms: list[str], limit: int, keep: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (total - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return (
        f"WITH d AS (SELECT doc_id, {_TOKENS} AS toks FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, len(toks)::DOUBLE AS dl, {tf} FROM d), c AS (SELECT count(*)::DOUBLE AS total, avg(dl) AS avgdl, {df} FROM r), "
        f"top AS (SELECT doc_id, {score} AS score FROM r, c WHERE ({hit}) AND ({keep}) ORDER BY score DESC, doc_id::VARCHAR LIMIT {limit})"
    )


_TERMS = ["licensed", "apache", "version"]


def _search(spark: SparkSession, sf_dir: str, q: str, analyzer: str = "default") -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute(st.DefineFulltext("f", "documents", "text", analyzer))
    return e.plan(q).select("doc_id", F.round("score", 6).alias("score"))


query("bm25_search", _bm25_sql(_TERMS, 20) + " SELECT doc_id, round(score, 6) AS score FROM top")(lambda spark, sf_dir: _search(spark, sf_dir, f"SEARCH documents text '{' '.join(_TERMS)}' LIMIT 20"))
query("bm25_where", _bm25_sql(_TERMS, 100) + " SELECT doc_id, round(top.score, 6) AS score FROM top JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY top.score DESC, doc_id::VARCHAR LIMIT 10")(
    lambda spark, sf_dir: _search(spark, sf_dir, f"SEARCH documents text '{' '.join(_TERMS)}' WHERE lang = 'en'")
)
query("bm25_must", _bm25_sql(["licensed", "apache"], 15, "tf0 > 0 AND tf1 > 0") + " SELECT doc_id, round(score, 6) AS score FROM top")(lambda spark, sf_dir: _search(spark, sf_dir, "SEARCH documents text '+licensed +apache' LIMIT 15"))
query("bm25_not", _bm25_sql(["licensed"], 15, "NOT list_contains(toks, 'apache')").replace("r AS (SELECT doc_id,", "r AS (SELECT doc_id, toks,") + " SELECT doc_id, round(score, 6) AS score FROM top")(
    lambda spark, sf_dir: _search(spark, sf_dir, "SEARCH documents text 'licensed -apache' LIMIT 15")
)


def _bm25_tree_sql(terms: list[str], score: str, keep: str, limit: int) -> str:
    """score may name s0, s1, ..., the terms' own scores, and keep tf0, tf1, ..."""
    one = [f"ln(1 + (total - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s{i}" for i in range(len(terms))]
    base = _bm25_sql(terms, limit)
    return base[: base.index("top AS (")] + f"sc AS (SELECT *, {', '.join(one)} FROM r, c) SELECT doc_id, round({score}, 6) AS score FROM sc WHERE {keep} ORDER BY {score} DESC, doc_id::VARCHAR LIMIT {limit}"


for _n, _q, _score, _keep in (
    ("or_and", "licensed OR apache AND version", "s0 + CASE WHEN tf1 > 0 AND tf2 > 0 THEN s1 + s2 ELSE 0 END", "tf0 > 0 OR (tf1 > 0 AND tf2 > 0)"),
    ("group", "(licensed OR apache) AND version", "s0 + s1 + s2", "(tf0 > 0 OR tf1 > 0) AND tf2 > 0"),
    ("group_not", "licensed AND NOT (apache AND version)", "s0", "tf0 > 0 AND NOT (tf1 > 0 AND tf2 > 0)"),
    ("boost", "licensed^2 apache (version license)^0.5", "2 * s0 + s1 + 0.5 * (s2 + s3)", "tf0 > 0 OR tf1 > 0 OR tf2 > 0 OR tf3 > 0"),
):
    query(f"bm25_{_n}", _bm25_tree_sql([*_TERMS, "license"][: 4 if _n == "boost" else 3], _score, _keep, 15))(lambda spark, sf_dir, q=_q: _search(spark, sf_dir, f"SEARCH documents text '{q}' LIMIT 15"))

_PHRASE = ["apache", "license"]
_PHRASE_SQL = (
    _bm25_sql(_PHRASE, 10).replace("r AS (SELECT doc_id,", "r AS (SELECT doc_id, len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'apache' AND toks[i + 1] = 'license'))::DOUBLE AS ph,").split("top AS (")[0]
    + "sc AS (SELECT doc_id, (ln(1 + (total - df0 + 0.5) / (df0 + 0.5)) + ln(1 + (total - df1 + 0.5) / (df1 + 0.5))) * ph * 2.2 / (ph + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM r, c WHERE ph > 0) SELECT doc_id, round(s, 6) AS score FROM sc ORDER BY s DESC, doc_id::VARCHAR LIMIT 10"
)
query("bm25_phrase", _PHRASE_SQL)(lambda spark, sf_dir: _search(spark, sf_dir, "SEARCH documents text '\"apache license\"'"))
query("bm25_english")(lambda spark, sf_dir: _search(spark, sf_dir, "SEARCH documents text 'licensing versions'", "english"))
query("tokens_default", rf"SELECT doc_id, len({_TOKENS}) AS n, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")(
    lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(text.tokens(F.col("text")), " ")).alias("digest"))
)
query("tokens_simple", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS n FROM documents")(
    lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"), "simple")).cast("long").alias("n"))
)
query(
    "tokens_code",
    "SELECT p_partkey, list_concat(['get'], [x FOR x IN string_split(lower(p_name), ' ') IF len(x) > 1 AND x <> 'new'], ['http', 'id'], list_filter(string_split(lower(p_type), ' '), lambda x: len(x) > 1)) AS tokens FROM part",
)(lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", codetokens.code_tokens(F.concat(F.lit("def get_"), F.translate("p_name", " ", "_"), F.lit("HTTPId "), F.lower("p_type"))).alias("tokens")))


_HYBRID = (
    _bm25_sql(["the", "of"], 100).replace("FROM documents WHERE text IS NOT NULL", "FROM documents JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL")
    + f", x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id), q AS (SELECT v AS q FROM x WHERE vec_id = 0), near AS (SELECT vec_id, -({_DISTANCE['cosine']}) AS s FROM x, q ORDER BY {_DISTANCE['cosine']}, vec_id::VARCHAR LIMIT 100), "
    "t AS (SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS ts FROM top), "
    "u AS (SELECT vec_id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1 END AS vs FROM near), "
    "b AS (SELECT coalesce(doc_id, vec_id) AS doc_id, coalesce(ts, 0) AS ts, coalesce(vs, 0) AS vs FROM t FULL JOIN u ON doc_id = vec_id) "
    "SELECT doc_id, round(0.3 * ts + 0.7 * vs, 6) AS score, round(ts, 6) AS text_score, round(vs, 6) AS vector_score FROM b ORDER BY 0.3 * ts + 0.7 * vs DESC, doc_id::VARCHAR LIMIT 10"
)


@query("hybrid_search", _HYBRID)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    q = [float(x) for x in emb.where("vec_id = 0").first()["embedding"]]
    e = Engine(spark)
    e.catalog.add_table("d", keyed(read(spark, sf_dir, "documents").join(emb, F.col("doc_id") == F.col("vec_id")), "doc_id"))
    e.execute("DEFINE FULLTEXT INDEX f ON d FIELDS text")
    e.execute("DEFINE VECTOR INDEX v ON d FIELDS embedding DIMENSION 64")
    hits = e.plan(st.HybridSearch("d", "text", "the of", "embedding", tuple(q), 0.3))
    return hits.select("doc_id", *[F.round(c, 6).alias(c) for c in ("score", "text_score", "vector_score")])


# -- changes


@query("upsert_merge", "SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 1.5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    new = df.where("c_mktsegment = 'BUILDING'").select("_id", *[(F.lit(0.5) if c == "c_acctbal" else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns if c != "_id"])
    one = dml.rows(df, [("c-1", {"c_custkey": -1, "c_name": "new", "c_acctbal": 1.5})])
    return dml.upsert(df, new.unionByName(one)).select("c_custkey", "c_name", "c_acctbal")


@query("update_where", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("UPDATE orders SET o_orderstatus = 'Z' WHERE o_totalprice > 250000.0")
    return e.catalog.table("orders").select("o_orderkey", "o_orderstatus")


@query("delete_where", "SELECT event_id FROM events WHERE NOT (event_type = 'click') OR event_type IS NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("DELETE events WHERE event_type = 'click'")
    return e.catalog.table("events").select("event_id")


@query("create_and_batch", "SELECT r_name, 'region:r' || r_regionkey AS id FROM region UNION ALL VALUES ('NEW', 'region:r90'), ('NEWER', 'region:r91')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("CREATE region:r90 SET r_name = 'NEW'")
    e.run_lines(["BEGIN BATCH", "CREATE region:r91 SET r_name = 'NEWER'", "RELATE nation:n1->in_region->region:r91", "END BATCH"])
    return e.plan("SELECT r_name FROM region")


@query("relate_overwrites", f"SELECT src, dst, CASE WHEN src = 'p1' THEN 99.0 ELSE weight END AS weight FROM ({EDGES_SQL['supplied_by']})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = edges(spark, sf_dir, "supplied_by")
    return dml.relate(df, df.where("src = 'p1'").withColumn("weight", F.lit(99.0)))


@query("upsert_set", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS r_name FROM region UNION ALL SELECT 77, 'NEW'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ON CONFLICT UPDATE SET: the SET alone for a record that exists, the fields for a new one."""
    e = engine(spark, sf_dir)
    for i in (1, 77):
        e.execute(f"CREATE region:r{i} SET r_regionkey = 77, r_name = 'NEW' ON CONFLICT UPDATE SET r_name = 'ONE'")
    return e.catalog.table("region").select("r_regionkey", "r_name")


@query("upsert_set_table", "SELECT s_suppkey, CASE WHEN s_suppkey <= 5 THEN 0.25 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT -1, 9.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier")
    new = df.where("s_suppkey <= 5").withColumn("s_acctbal", F.lit(7.0)).unionByName(dml.rows(df, [("s-1", {"s_suppkey": -1, "s_acctbal": 9.0})]))
    return dml.upsert(df, new, (("s_acctbal", 0.25),)).select("s_suppkey", "s_acctbal")


@query("update_record", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'HERE' ELSE n_name END AS n_name FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("UPDATE nation:n3 SET n_name = 'HERE'")
    e.execute("UPDATE nation:n4 SET n_name = 'NOWHERE' WHERE n_regionkey > 90")
    return e.catalog.table("nation").select("n_nationkey", "n_name")


@query("delete_record", "SELECT n_nationkey FROM nation WHERE n_nationkey <> 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    for i in (3, 3000):
        e.execute(f"DELETE nation:n{i}")
    return e.catalog.table("nation").select("n_nationkey")


@query("replace_rows", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_name END AS n_name FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in place of those with the same key, fields that they lack included."""
    df = table(spark, sf_dir, "nation")
    return dml.replace(df, df.where("n_nationkey < 5").withColumn("n_name", F.lit(None).cast("string"))).select("n_nationkey", "n_name")


@query("edge_changes", f"SELECT src, dst, CASE WHEN src = 'n1' THEN 4.5 ELSE weight END AS weight FROM ({EDGES_SQL['in_region']}) WHERE src <> 'n2'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge read, deleted, and one's weight set."""
    df = edges(spark, sf_dir, "in_region").withColumn("weight", F.lit(1.0))
    ends = {r.src: r.dst for r in df.where("src in ('n1', 'n2')").collect()}
    df = dml.unrelate(df, "n2", ends["n2"])
    return dml.update_edge(df, "n1", ends["n1"], (("weight", 4.5),)).select("src", "dst", "weight")


@query("indexes_and_unique_checks", "SELECT * FROM (VALUES (1, 'ok'), (2, 'error'), (3, 'error'), (4, 'ok'), (5, 'created')) t(step, status)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique index, a value it refuses, one that the rows contradict, and what holds once it is removed."""
    e = engine(spark, sf_dir)
    steps = ["DEFINE INDEX u ON nation FIELDS n_name UNIQUE", "CREATE nation:n90 SET n_nationkey = 90, n_name = 'NATION_1'", "DEFINE INDEX w ON nation FIELDS n_regionkey UNIQUE", "REMOVE INDEX u ON nation", "CREATE nation:n90 SET n_nationkey = 90, n_name = 'NATION_1'"]
    name = e.catalog.table("nation").where("n_nationkey = 1").first()["n_name"]
    return spark.createDataFrame([(i, json.loads(e.run(q.replace("NATION_1", name)))["status"]) for i, q in enumerate(steps, 1)], "step int, status string")


@query("schema_validation", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false), (6, true)) t(step, valid)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a closed schema: whole, without a required field, with an unknown one, of another type, of another dimension, with a null."""
    s = Schema("u", (FieldDef("name", "string", True), FieldDef("age", "int"), FieldDef("v", "vector", dimension=3)))
    docs = [{"name": "a", "age": 1, "v": [1.0, 2, 3]}, {"age": 1}, {"name": "a", "x": 1}, {"name": "a", "age": 1.5}, {"name": "a", "v": [1.0]}, {"name": "a", "age": None}]

    def valid(d: dict) -> bool:
        try:
            s.validate(d)
        except SchemaError:
            return False
        return True

    return spark.createDataFrame([(i, valid(d)) for i, d in enumerate(docs, 1)], "step int, valid boolean")


@query("unique_violations", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.unique_violations(table(spark, sf_dir, "nation"), ["n_regionkey"])


# -- syntax trees, made from parts


def _trees(spark: SparkSession, sf_dir: str, **others: Column) -> DataFrame:
    """A module for each part, with a function whose body depends on the part's size; and ones for other sizes."""
    parts = relational.spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    sizes = {"ast_serialized": F.col("p_size")} | others
    return parts.select("p_partkey", "p_size", *[_tree(size).alias(name) for name, size in sizes.items()])


def _tree(size: Column) -> Column:
    leaf = lambda name: '{"node_type":"Variable","meta":[],"children":{"Value":{"String":"' + name + '"}}}'
    body = F.concat(
        F.lit('{"node_type":"BinaryOp","meta":[],"children":{"Nodes":[' + leaf("x") + "," + leaf("y") + "]}}"),
        F.when(size % 2 == 0, F.lit(',{"node_type":"Conditional","meta":[["line",{"Int":3}]],"children":{"Nodes":[' + leaf("x") + "]}}")).otherwise(F.lit("")),
        F.when(size % 3 == 0, F.lit(',{"node_type":"FunctionCall","meta":[["name",{"String":"helper"}]],"children":{"Nodes":[]}}')).otherwise(F.lit("")),
    )
    fn = F.concat(F.lit('{"node_type":"FunctionDef","meta":[["name",{"String":"f'), F.col("p_partkey").cast("string"), F.lit('"}],["arity",{"Int":2}],["line_start",{"Int":2}],["line_end",{"Int":9}]],"children":{"Nodes":['), body, F.lit("]}}"))
    return F.concat(F.lit('{"node_type":"Container","meta":[["name",{"String":"M"}],["line",{"Int":1}]],"children":{"Nodes":['), fn, F.lit("]}}"))


def _call(name: str, *args) -> F.Column:
    from pyspark.sql.types import StringType

    return registry.registry()[name](*[Typed(F.col(a), StringType()) if isinstance(a, str) else a for a in args])[0]


query("ast_complexity", "SELECT p_partkey, 1 + (p_size % 2 = 0)::BIGINT AS complexity FROM part")(lambda spark, sf_dir: _trees(spark, sf_dir).select("p_partkey", _call("ast::complexity", "ast_serialized").alias("complexity")))
query("ast_hash_classes", "SELECT (p_size % 2 = 0) AS even, (p_size % 3 = 0) AS third, 1::BIGINT AS hashes FROM part GROUP BY 1, 2")(
    lambda spark, sf_dir: _trees(spark, sf_dir).withColumn("h", _call("ast::hash", "ast_serialized")).groupBy((F.col("p_size") % 2 == 0).alias("even"), (F.col("p_size") % 3 == 0).alias("third")).agg(F.countDistinct("h").alias("hashes"))
)


_LEAF_SQL = """'{{"node_type":"Variable","meta":[],"children":{{"Value":{{"String":"{0}"}}}}}}'"""
_X, _Y = _LEAF_SQL.format("x"), _LEAF_SQL.format("y")
_COND_SQL = """'{"node_type":"Conditional","meta":[["line",{"Int":3}]],"children":{"Nodes":[' || """ + _X + """ || ']}}'"""


def _fn_sql(size: str) -> str:
    """The JSON of a part's function, whose body depends on size."""
    call = """'{"node_type":"FunctionCall","meta":[["name",{"String":"helper"}]],"children":{"Nodes":[]}}'"""
    head = """'{"node_type":"FunctionDef","meta":[["name",{"String":"f' || p_partkey || '"}],["arity",{"Int":2}],["line_start",{"Int":2}],["line_end",{"Int":9}]],"children":{"Nodes":['"""
    body = """'{"node_type":"BinaryOp","meta":[],"children":{"Nodes":[' || """ + _X + " || ',' || " + _Y + " || ']}}'"
    return f"{head} || {body} || CASE WHEN {size} % 2 = 0 THEN ',' || {_COND_SQL} ELSE '' END || CASE WHEN {size} % 3 = 0 THEN ',' || {call} ELSE '' END || ']}}}}'"


@query("ast_scope_similarity", f"""SELECT p_partkey, '[' || {_fn_sql('p_size')} || CASE WHEN p_size % 2 = 0 THEN ',' || {_COND_SQL} ELSE '' END || ']' AS scope, 1.0::DOUBLE AS similarity, '{{"changes":[],"added":0,"removed":0,"modified":0,"renamed":0}}' AS diff FROM part""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trees(spark, sf_dir)
    return t.select("p_partkey", _call("ast::scope", "ast_serialized", Constant(3)).alias("scope"), _call("ast::similarity", "ast_serialized", "ast_serialized").alias("similarity"), _call("ast::diff", "ast_serialized", "ast_serialized").alias("diff"))


@query(
    "ast_similarity_of_two",
    """WITH x AS (SELECT p_partkey, 2.0 * (p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT AS more FROM part), f AS (SELECT p_partkey, more, 2 / (8 + more) + (1 - 2 / (8 + more)) * 3 / (3 + more) AS fn FROM x)
SELECT p_partkey, round(2 / (10 + more) + (1 - 2 / (10 + more)) * fn, 9) AS similarity FROM f""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree against one whose function has neither condition nor call."""
    t = _trees(spark, sf_dir, other=F.lit(1))
    return t.select("p_partkey", F.round(_call("ast::similarity", "ast_serialized", "other"), 9).alias("similarity"))


@query(
    "ast_diff_of_two",
    """WITH x AS (SELECT p_partkey, 'fn::f' || p_partkey || '/2' AS f, CASE WHEN p_size % 5 = 0 THEN 'removed' WHEN p_size % 2 = 0 THEN 'renamed' ELSE 'modified' END AS what FROM part)
SELECT p_partkey, '{"changes":[{"kind":"' || CASE what WHEN 'removed' THEN 'Removed' WHEN 'renamed' THEN 'Renamed' ELSE 'Modified' END || '","node_type":"FunctionDef","name":"' || f || CASE WHEN what = 'renamed' THEN ' -> fn::g' || p_partkey || '/2' ELSE '' END || '","line":null}],"added":0,"removed":'
|| (what = 'removed')::INT || ',"modified":' || (what = 'modified')::INT || ',"renamed":' || (what = 'renamed')::INT || '}' AS diff FROM x""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree against one that lost its function, has it under another name or with another body."""
    t = _trees(spark, sf_dir, other=F.col("p_size") + 1)
    new = F.when(F.col("p_size") % 5 == 0, F.lit('{"node_type":"Container","meta":[],"children":{"Nodes":[]}}')).when(F.col("p_size") % 2 == 0, F.replace("ast_serialized", F.lit('"String":"f'), F.lit('"String":"g'))).otherwise(F.col("other"))
    return t.withColumn("new", new).select("p_partkey", _call("ast::diff", "ast_serialized", "new").alias("diff"))


@query(
    "ast_clones",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '[{"index_a":0,"index_b":2,"similarity":1.0},{"index_a":0,"index_b":3,"similarity":1.0},{"index_a":2,"index_b":3,"similarity":1.0}]' ELSE '[{"index_a":0,"index_b":3,"similarity":1.0}]' END AS clones FROM part""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four trees for each part, of which some have the same shape."""
    t = _trees(spark, sf_dir, **{f"t{k}": F.col("p_size") + k for k in (1, 2, 6)})
    trees = t.select("p_partkey", F.concat(F.lit("["), F.concat_ws(",", "ast_serialized", "t1", "t2", "t6"), F.lit("]")).alias("trees"))
    return trees.select("p_partkey", _call("ast::clones", "trees", Constant(0.95)).alias("clones"))


@query("ast_clone_classes", "SELECT p_partkey, min(p_partkey) OVER w AS class_id, count(*) OVER w - 1 AS links FROM part WINDOW w AS (PARTITION BY p_size % 2 = 0, p_size % 3 = 0)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trees of a table: equal shapes are a class."""
    return clones.classes(_trees(spark, sf_dir).select(F.col("p_partkey").alias("id"), "ast_serialized")).select(F.col("id").alias("p_partkey"), "class_id", "links")


query("ast_clone_links")(lambda spark, sf_dir: clones.links(_trees(spark, sf_dir).select(F.col("p_partkey").alias("id"), "ast_serialized"), 0.8))


@query(
    "ast_extracts",
    """SELECT p_partkey, 5 + 2 * (p_size % 2 = 0)::BIGINT + (p_size % 3 = 0)::BIGINT AS nodes, 4::BIGINT AS depth, 'f' || p_partkey || '/2 public' AS functions, 'x,y' AS variables, CASE WHEN p_size % 3 = 0 THEN 'helper' ELSE '' END AS calls, 2 + (p_size % 2 = 0)::BIGINT AS found_variables,
CASE WHEN p_size % 3 = 0 THEN 'Container,FunctionDef' ELSE '' END AS above_call, CASE WHEN p_size % 3 = 0 THEN 1 + (p_size % 2 = 0)::BIGINT ELSE 0 END AS beside_call FROM part""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the finding and extracting functions say of each tree."""
    ddl = "p_partkey long, nodes long, depth long, functions string, variables string, calls string, found_variables long, above_call string, beside_call long"

    def part(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, text_ in zip(pdf.p_partkey, pdf.ast_serialized):
                n = metaast.read(text_)
                call = next(iter(metaast.by_name(n, "helper")), None)
                fn = ",".join(f"{f['name']}/{f['arity']} {f['visibility']}" for f in metaast.functions(n))
                above = ",".join(x.type for x in metaast.ancestors(n, call)) if call else ""
                out.append((key, metaast.node_count(n), metaast.depth(n), fn, ",".join(sorted(metaast.variables(n))), ",".join(metaast.calls(n)), len(metaast.by_type(n, "Variable")), above, len(metaast.siblings(n, call)) if call else 0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    return _trees(spark, sf_dir).select("p_partkey", "ast_serialized").mapInPandas(part, ddl)


@query("select_function", "SELECT p_partkey, 1 + (p_size % 2 = 0)::BIGINT AS \"ast::complexity(ast_serialized)\", 'trees:p' || p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_partkey <= 50")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function in the projection and in the filter of a statement."""
    e = Engine(spark)
    e.catalog.add_table("trees", keyed(_trees(spark, sf_dir), "p_partkey", "p"))
    return e.plan("SELECT p_partkey, ast::complexity(ast_serialized) FROM trees WHERE ast::complexity(ast_serialized) > 1 AND p_partkey <= 50")


@query("ast_ingest_edges", "SELECT 'f' || p_partkey || '::container::M' AS src, 'contains' AS edge_type, 'f' || p_partkey || '::f' || p_partkey || '/2' AS dst FROM part UNION ALL SELECT 'f' || p_partkey || '::f' || p_partkey || '/2', 'calls', 'call_target::helper' FROM part WHERE p_size % 3 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _trees(spark, sf_dir).select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_path"), F.lit("x").alias("language"), "ast_serialized")
    return ingest.ingest(files)[1]


# -- results as text


def _rendered(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return spark.createDataFrame([(engine(spark, sf_dir).run(f"SELECT r_regionkey, r_name FROM region OUTCOME {form}"),)], "result string")


_ROWS = "(SELECT 'region:r' || r_regionkey AS id, r_name, r_regionkey FROM region)"
query("json_rows", f"""SELECT '{{"status":"rows","count":' || count(*) || ',"data":[' || string_agg('{{"id":{{"String":"' || id || '"}},"r_name":{{"String":"' || r_name || '"}},"r_regionkey":{{"Int":' || r_regionkey || '}}}}', ',' ORDER BY id) || ']}}' AS result FROM {_ROWS}""")(lambda spark, sf_dir: _rendered(spark, sf_dir, "JSON"))
query("toon_rows", f"""SELECT 'status = "rows"' || chr(10) || 'count = ' || count(*) || chr(10) || chr(10) || string_agg('[[data]]' || chr(10) || 'id = "' || id || '"' || chr(10) || 'r_name = "' || r_name || '"' || chr(10) || 'r_regionkey = ' || r_regionkey, chr(10) || chr(10) ORDER BY id) AS result FROM {_ROWS}""")(
    lambda spark, sf_dir: _rendered(spark, sf_dir, "TOON")
)
query("csv_rows", f"""SELECT 'id,r_name,r_regionkey' || chr(10) || string_agg(id || ',' || r_name || ',' || r_regionkey, chr(10) ORDER BY id) AS result FROM {_ROWS}""")(lambda spark, sf_dir: _rendered(spark, sf_dir, "CSV"))
query("outcome_of_errors", """SELECT 'status,message' || chr(10) || 'error,record exists: region:r0' AS result""")(lambda spark, sf_dir: spark.createDataFrame([(engine(spark, sf_dir).run("CREATE region:r0 SET r_name = 'X' OUTCOME CSV"),)], "result string"))
