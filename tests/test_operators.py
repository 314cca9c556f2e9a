from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest

from tessella.functions import codetokens, ingest, stemming
from tessella.functions import metaast as m
from tessella.operators import communities, graph, text, vector
from tessella.sources.tables import dynamic_from_json, to_json_lines


def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src string, dst string, weight double")


def random_graph(seed, n=14, k=24):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}"): rng.choice((-1, 0, 1, 2, 5)) for _ in range(k)}.items())


def test_components_and_pagerank_against_python(spark):
    for seed in (1, 2):
        es = [(a, b, w) for (a, b), w in random_graph(seed)]
        df = edge_frame(spark, es)
        own = {v: v for a, b, _ in es for v in (a, b)}
        for _ in own:
            for a, b, _ in es:
                own[a] = own[b] = min(own[a], own[b])
        assert {r.id: r.component for r in graph.connected(df).collect()} == own
        ids = sorted(own)
        rank = dict.fromkeys(ids, 1 / len(ids))
        out = defaultdict(float)
        for a, _, w in es:
            out[a] += max(w, 0)
        for _ in range(100):
            lost = sum(rank[v] for v in ids if out[v] == 0)
            new = {v: 0.15 / len(ids) + 0.85 * lost / len(ids) for v in ids}
            for a, b, w in es:
                if w > 0:
                    new[b] += 0.85 * rank[a] * w / out[a]
            change, rank = sum(abs(new[v] - rank[v]) for v in ids), new
            if change < 1e-6:
                break
        got = {r.id: r.score for r in graph.pagerank(df).collect()}
        assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[v] - rank[v]) < 1e-9 for v in ids)


def test_pagerank_stops_early_and_handles_nothing(spark):
    assert graph.pagerank(edge_frame(spark, [])).count() == 0
    got = {r.id: r.score for r in graph.pagerank(edge_frame(spark, [("a", "b", 9), ("a", "c", 1)])).collect()}
    assert got["b"] > got["c"]


def test_path_is_the_least_of_the_shortest(spark):
    df = edge_frame(spark, [("a", "c", 1), ("a", "b", 1), ("c", "d", 1), ("b", "d", 1), ("d", "a", 1)])
    assert graph.path(df, "a", "d").first().path == ["a", "b", "d"]
    assert graph.path(df, "a", "d", 1).first().found is False
    assert graph.path(df, "d", "b").first().length == 2 and graph.path(df, "b", "zz").first().path == []


def test_walk_keeps_all_paths(spark):
    df = edge_frame(spark, [("a", "b", 1), ("b", "a", 1), ("a", "c", 1)])
    start = spark.createDataFrame([("a",)], "_id string")
    assert sorted(r.path for r in graph.walk(start, [(df, True), (df, True)]).collect()) == [["a", "b", "a"]]
    assert sorted(r.path for r in graph.walk(start, [(df, True), (df, False)]).collect()) == [["a", "b", "a"], ["a", "c", "a"]]


def clusters():
    es = [(f"{c}{i}", f"{c}{j}", 3.0) for c in "ab" for i in range(1, 4) for j in range(1, 4) if i != j]
    return [*es, ("a1", "b1", 1.0)]


def test_communities(spark):
    df = edge_frame(spark, clusters())
    for algorithm in ("louvain", "label_propagation"):
        got = {frozenset(r.members) for r in communities.communities(df, algorithm).collect()}
        assert got == {frozenset(f"{c}{i}" for i in range(1, 4)) for c in "ab"}, algorithm
    assert communities.communities(df, resolution=50.0).count() == 6
    assert {frozenset(r.members) for r in communities.synchronous(df, 30).collect()} <= {frozenset(f"{c}{i}" for i in range(1, 4)) for c in "ab"} | {frozenset(f"{c}{i}" for c in "ab" for i in range(1, 4))}
    assert communities.communities(edge_frame(spark, [])).count() == 0


def test_vector_metrics(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [10.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0]), ("h", [None, 1.0])], "_id string, v array<double>")
    idx = vector.index(df, "v", 2)
    ids = lambda m_: [r["_id"] for r in vector.search(idx, [1.0, 0.0], 10, m_).collect()]
    assert ids("cosine") == ["a", "c", "b", "z"] and ids("l2")[0] == "a" and ids("dot")[0] == "c"
    assert vector.search(idx, [1.0, 0.0], 10).where("_id = 'z'").first().distance == 1.0
    with pytest.raises(Exception, match="metric"):
        vector.metric("hamming")


def test_analyzers(spark):
    df = spark.createDataFrame([("The runners' Café, RUNNING parseJSON_text",)], "t string")
    for name, want in (("default", ["the", "runners", "café", "running", "parsejson", "text"]), ("simple", ["The", "runners'", "Café,", "RUNNING", "parseJSON_text"]), ("english", ["the", "runner", "café", "run", "parsejson", "text"]), ("code", ["the", "runners", "café", "running", "parse", "json", "text"])):
        assert df.select(text.tokens(df.t, name)).first()[0] == want == text.tokens_of("The runners' Café, RUNNING parseJSON_text", name), name


@pytest.mark.parametrize(("language", "pairs"), [("en", "running run flies fli hopping hop generously generous relational relat knightly knight agreed agre news news"), ("de", "kategorischen kategor häuser haus kinder kind"), ("es", "torniquetes torniquet corriendo corr ciudades ciudad"), ("fr", "continuellement continuel chevaux cheval"), ("it", "abbandonata abbandon gatti gatt"), ("pt", "quilométricas quilométr boa boa"), ("ru", "важнейшими важн книги книг")])
def test_stemmers(language, pairs):
    w = pairs.split()
    assert [stemming.stem(x, language) for x in w[::2]] == w[1::2]


def test_code_tokens():
    assert codetokens.tokenize("def parseHTMLDoc(my_var, x): return HTTPServer") == ["parse", "html", "doc", "my", "http", "server"]


def var(name):
    return m.Node("Variable", [], None, {"String": name})


def fn(name, *body, line=None, arity=2):
    meta = [("name", {"String": name}), ("arity", {"Int": arity})] + ([("line", {"Int": line})] if line is not None else [])
    return m.Node("FunctionDef", meta, list(body))


def test_trees():
    add, sub = fn("add", m.Node("BinaryOp", [], [var("x"), var("y")])), fn("sub", m.Node("BinaryOp", [], [var("a"), var("b")]))
    loop = m.Node("Loop", [], [m.Node("Conditional", [], [var("x")])])
    assert m.complexity(loop) == 3 and m.complexity(add) == 1 and m.depth(add) == 3 and m.node_count(add) == 4
    assert m.structural_hash(add) == m.structural_hash(sub) != m.structural_hash(loop)
    assert m.similarity(add, sub) == 1.0 and m.similarity(add, loop) < 0.5
    assert [(p["index_a"], p["index_b"]) for p in m.clones([add, sub, loop], 0.9)] == [(0, 1)]
    assert m.read(m.dump(add)).data() == add.data()
    assert m.atom("FunctionDef") == "function_def" and m.FROM_ATOM["_"] == "Wildcard" and len(m.LAYER_OF) == 46
    with pytest.raises(ValueError):
        m.read('{"node_type":"Nope","meta":[],"children":{"Nodes":[]}}')


def test_tree_diff():
    old = m.Node("Container", [], [fn("a", var("x")), fn("b", var("y")), fn("gone", var("z"), var("q"))])
    new = m.Node("Container", [], [fn("a", var("x2")), fn("c", var("y")), fn("extra", var("k"), var("l"), line=4)])
    d = m.diff(old, new)
    assert [(c["kind"], c["name"]) for c in d["changes"]] == [("Modified", "fn::a/2"), ("Renamed", "fn::b/2 -> fn::c/2"), ("Removed", "fn::gone/2"), ("Added", "fn::extra/2")]
    assert (d["added"], d["removed"], d["modified"], d["renamed"]) == (1, 1, 1, 1) and m.removed_entities(d) == ["fn::gone/2"]


def module():
    call = m.Node("FunctionCall", [("name", {"String": "greet"})], [])
    other = m.Node("FunctionCall", [("name", {"String": "print"})], [])
    return m.Node("Container", [("name", {"String": "MyApp"}), ("container_type", {"String": "module"})], [m.Node("Import", [("source", {"String": "Logger"})], []), fn("add", call, other), fn("greet", arity=1)])


def test_finding_and_ingestion(spark):
    root = module()
    call = m.by_type(root, "FunctionCall")[0]
    assert m.parent(root, call).text("name") == "add" and m.containing(root, call, "Container") is root and len(m.siblings(root, call)) == 1
    files = spark.createDataFrame([("a.ex", "elixir", m.dump(root)), ("bad", "x", "{}"), ("null", None, None)], "file_path string, language string, ast_serialized string")
    docs, edges = ingest.ingest(files)
    assert {r._id: r.kind for r in docs.select("_id", "kind").collect()} == {"a.ex::module::MyApp": "module", "a.ex::add/2": "function_def", "a.ex::greet/1": "function_def"}
    assert sorted(tuple(r) for r in edges.collect()) == sorted([("a.ex::module::MyApp", "contains", "a.ex::add/2"), ("a.ex::module::MyApp", "contains", "a.ex::greet/1"), ("a.ex::module::MyApp", "imports", "import::Logger"), ("a.ex::add/2", "calls", "a.ex::greet/1"), ("a.ex::add/2", "calls", "call_target::print")])
    from tessella.lang.parser import parse

    for s in ingest.statements(*ingest.merged([ingest.prepare(root, "a.ex", "elixir")])):
        parse(s)


def test_functions_in_statements(spark):
    from tessella.plans.engine import Engine

    e = Engine(spark)
    tree = m.dump(fn("f", m.Node("Conditional", [("line", {"Int": 3})], [var("x")])))
    e.catalog.add_table("n", spark.createDataFrame([("a", tree), ("b", "junk"), ("c", None)], "k string, ast_serialized string"), "k")
    got = {r["id"]: r for r in e.execute("SELECT ast::complexity(ast_serialized), ast::hash(ast_serialized), ast::similarity(ast_serialized, ast_serialized), ast::scope(ast_serialized, 3), ast::diff(ast_serialized, ast_serialized), ast::complexity() FROM n").rows}
    assert got["n:a"]["ast::complexity(ast_serialized)"] == 2 and got["n:a"]["ast::similarity(ast_serialized, ast_serialized)"] == 1.0
    assert json.loads(got["n:a"]["ast::scope(ast_serialized, 3)"])[0]["node_type"] == "Conditional"
    assert got["n:b"] == {"id": "n:b"} and got["n:c"] == {"id": "n:c"}
    assert [r["id"] for r in e.execute("SELECT k FROM n WHERE ast::complexity(ast_serialized) > 1").rows] == ["n:a"]


def test_json_tables(spark):
    lines = spark.createDataFrame([('{"_id":"a","n":1,"f":1.5,"s":"x","b":true,"z":null,"v":[1,2.5],"o":{"k":1}}',), ('{"_id":"b"}',)], "value string")
    df = dynamic_from_json(lines)
    f = {r._id: r.fields for r in df.collect()}
    assert {k: v["t"] for k, v in f["a"].items()} == {"n": "int", "f": "float", "s": "string", "b": "bool", "z": "none", "v": "array", "o": "object"}
    assert f["a"]["v"]["v"] == [1.0, 2.5] and f["b"] == {}
    assert json.loads(to_json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first().value) == {"a": 1}


def test_pagerank_of_a_hub(spark):
    """A source of most edges, which is salted, against plain power iteration."""
    e = [("h", f"v{i}", 1.0 + i % 3) for i in range(60)] + [(f"v{i}", f"v{(i * 7) % 60}", 2.0) for i in range(0, 60, 2)] + [("v1", "h", 1.0)]
    ids = sorted({x for a, b, _ in e for x in (a, b)})
    total = {a: sum(w for x, _, w in e if x == a) for a, _, _ in e}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(15):
        lost = sum(rank[v] for v in ids if v not in total)
        rank = {v: 0.15 / len(ids) + 0.85 * lost / len(ids) + 0.85 * sum(rank[a] * w / total[a] for a, b, w in e if b == v) for v in ids}
    got = {r.id: r.score for r in graph.pagerank(spark.createDataFrame(e, "src string, dst string, weight double"), max_iter=15, tolerance=0.0).collect()}
    assert set(got) == set(ids) and all(abs(got[v] - rank[v]) < 1e-12 for v in ids)


def test_components_of_stars_and_chains(spark):
    e = [("a", f"x{i}") for i in range(200)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("z", "z")]
    got = {r.id: r.component for r in graph.connected(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert all(got[f"x{i}"] == "a" for i in range(200)) and {got[f"c{i}"] for i in range(41)} == {"c0"} and got["z"] == "z"
