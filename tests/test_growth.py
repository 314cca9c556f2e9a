"""What must not grow with the tables: broadcasts, Python's batches, idle cores."""

from __future__ import annotations

from tessella import queries as core
from tessella.functions import clones
from tessella.functions import metaast as m
from tessella.operators import communities, graph, vector

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_of_a_part_meet_without_a_join(spark):
    assert "Join" not in plan(core.QUERIES["ast_clones"](spark, SF))


def _tree(*kinds):
    return m.dump(m.Node("Container", [], [m.Node(k, [], [m.Node("Variable", [], None, {"String": "x"})]) for k in kinds]))


def test_clone_links_broadcast_no_trees(spark):
    """Each shape is its own id here, so that all trees stand for one."""
    kinds = ["BinaryOp", "UnaryOp", "Loop", "Lambda", "Block", "Map", "Pair", "Tuple"]
    rows = [(i, _tree(*kinds[: i % 7 + 2])) for i in range(30)] + [(99, "junk"), (3, _tree(*kinds[:5]))]
    df = clones.links(spark.createDataFrame(rows, "id long, ast_serialized string"), 0.8)
    assert "Broadcast" not in plan(df)
    # against all pairs of the classes' trees
    first = {}
    for i, text in rows:
        if text != "junk":
            h = m.structural_hash(m.read(text))
            first[h] = min(first.get(h, (i, text)), (i, text))
    reps = sorted(first.values())
    right = {(reps[p["index_a"]][0], reps[p["index_b"]][0]): p["similarity"] for p in m.clones([m.read(t) for _, t in reps], 0.8)}
    got = {(r.a, r.b): r.similarity for r in df.collect()}
    assert got == right and len(got) == 4


def test_clone_classes_broadcast_no_trees(spark):
    rows = [(i, _tree(*["Block"] * (i % 3))) for i in range(9)]
    df = clones.classes(spark.createDataFrame(rows, "id long, ast_serialized string"))
    assert "BuildLeft" not in plan(df)
    assert {(r.id, r.class_id, r.links) for r in df.collect()} == {(i, i % 3, 2) for i in range(9)}


def test_trees_are_spread_over_cores(spark):
    """The one file of parts is a single task, whatever a row's trees cost."""
    cores = spark.sparkContext.defaultParallelism
    for name in ("ast_scope_similarity", "ast_clones", "ast_clone_classes"):
        assert core.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 2 * cores or f", {4 * cores})" in plan(core.QUERIES[name](spark, SF))


def test_traversal_with_a_limit_sorts_no_paths(spark):
    """Against the least paths, over two hops and back; the first hop keeps the least by hash."""
    assert "SortAggregate" not in plan(core.QUERIES["traverse_limit"](spark, SF))
    one = [(f"a{i}", f"b{i * 7 % 11}") for i in range(30)]
    two = [(f"b{i % 11}", f"c{i * 5 % 17}") for i in range(40)]
    first = {}
    for a, b in one:
        for x, c in two:
            if x == b:
                first[c] = min(first.get(c, (a, b, c)), (a, b, c))
    right = sorted(first, key=first.get)
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    start = spark.createDataFrame([(f"a{i}",) for i in range(30)], "_id string").repartition(5)
    dest = spark.createDataFrame([(f"c{i}",) for i in range(17)], "_id string").repartition(3)
    for n in (1, 6, 50):
        got = graph.traverse(start, [(frame(one), True), (frame(two), True)], dest, limit=n)
        assert [r[0] for r in got.select("_id").collect()] == right[:n]
    back = graph.traverse(start, [(frame([(b, a) for a, b in one]), False), (frame(two), True)], dest, limit=50)
    assert [r[0] for r in back.select("_id").collect()] == right


def test_distances_are_in_memory_for_a_slice_of_queries(spark, monkeypatch):
    import numpy as np

    seen, plain = [], vector.distances
    monkeypatch.setattr(vector, "distances", lambda q, x, name: seen.append(len(q)) or plain(q, x, name))
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(str(i), rng.random(4).tolist()) for i in range(300)], "_id string, v array<double>")
    made = []
    monkeypatch.setattr(vector, "by_block", lambda queries, block, search, k: made.append(search))
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, part, ddl: part)
    vector.nearest(frame, frame, 3)
    part = made[0]([str(i) for i in range(300)], rng.random((300, 4)))
    import pyarrow as pa

    list(part(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0]])], ["_id", "v"])])))
    assert sum(seen) == 300 and max(seen) <= vector.SLICE


def test_communities_hold_arrays(spark):
    assert "FlatMapGroups" not in plan(communities.communities(spark.createDataFrame([("a", "b"), ("c", "c")], "src string, dst string")))
    got = {tuple(r.members) for r in communities.communities(spark.createDataFrame([("a", "b"), ("c", "c")], "src string, dst string")).collect()}
    assert got == {("a", "b"), ("c",)}


def test_stems_of_pieces():
    import pyarrow as pa

    from tessella.functions import stemming

    rows = [["running", "flies"], None, [], ["news", None, "hopping"], ["running"] * 5]
    for piece in (1, 3, 100):
        got = stemming.stem_lists(pa.array(rows, pa.list_(pa.string())), "en", piece).to_pylist()
        assert got == [["run", "fli"], None, [], ["news", None, "hop"], ["run"] * 5]
