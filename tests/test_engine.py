from __future__ import annotations

import json

import pytest

from tessella.errors import QueryError, SchemaError
from tessella.plans.cache import ResultCache
from tessella.plans.engine import Engine
from tessella.plans.schema import FieldDef, Schema


@pytest.fixture()
def engine(spark):
    return Engine(spark)


def fill(e, *statements):
    for s in statements:
        r = json.loads(e.run(s))
        assert r["status"] != "error", r


def rows(e, q):
    r = e.execute(q)
    return r.rows


def test_create_select_and_wire_format(engine):
    fill(engine, "CREATE user:alice SET name = 'Alice', age = 30", "CREATE user:bob SET name = 'Bob', age = 25.5, tags = [1, 'x'], note = NONE")
    assert rows(engine, "SELECT * FROM user") == [{"name": "Alice", "age": 30, "id": "user:alice"}, {"name": "Bob", "age": 25.5, "tags": [1, "x"], "note": None, "id": "user:bob"}]
    assert json.loads(engine.run("SELECT name, age FROM user:alice")) == {"status": "rows", "count": 1, "data": [{"age": {"Int": 30}, "id": {"String": "user:alice"}, "name": {"String": "Alice"}}]}
    assert engine.run("SELECT tags FROM user OUTCOME CSV") == "id,tags\nuser:alice,\nuser:bob,[1;x]"
    assert engine.run("SELECT age FROM user:bob OUTCOME TOON") == 'status = "rows"\ncount = 1\n\n[[data]]\nage = 25.5\nid = "user:bob"'
    assert engine.run("SELECT * FROM nobody OUTCOME CSV") == "status,count\nrows,0"
    assert json.loads(engine.run("CREATE user:alice SET age = 1"))["status"] == "error"
    assert json.loads(engine.run("SELEC"))["status"] == "error"


def test_comparison_rules(engine):
    fill(engine, "CREATE t:a SET x = 30", "CREATE t:b SET x = 30.0", "CREATE t:c SET x = 'm'", "CREATE t:d SET x = NONE", "CREATE t:e SET y = TRUE", "CREATE t:f SET x = [1, 2]")
    ids = lambda w: [r["id"][2:] for r in rows(engine, f"SELECT y FROM t WHERE {w}")]
    assert ids("x = 30") == ["a"] and ids("x = 30.0") == ["b"]
    assert ids("x >= 29.5") == ["a", "b"] and ids("x < 'n'") == ["c"] and ids("y > FALSE") == []
    assert ids("x != 30") == ["b", "c", "d", "f"]
    assert ids("x = NONE") == ["d"] and ids("x IS NONE") == ["d", "e"] and ids("x IS NOT NONE") == ["a", "b", "c", "f"]
    assert ids("x = [1, 2]") == ["f"] and ids("id = 't:a'") == [] and ids("1 = 1") == list("abcdef")
    assert ids("nothing::known(x) = 1") == []


def test_order_limit_and_groups(engine):
    fill(engine, "CREATE s:a SET v = 10", "CREATE s:b SET v = 30", "CREATE s:c SET v = 20", "CREATE s:d SET w = 1", "CREATE s:e SET v = 20.0")
    ids = lambda q: [r["id"][2:] for r in rows(engine, q)]
    assert ids("SELECT v FROM s ORDER BY v") == ["a", "c", "e", "b", "d"]
    assert ids("SELECT v FROM s ORDER BY v DESC LIMIT 3") == ["d", "b", "c"]
    assert ids("SELECT v FROM s LIMIT 2") == ["a", "b"]
    got = rows(engine, "COUNT s GROUP BY v")
    assert [(r.get("v"), r["count"]) for r in got][-1] == (None, 1) and len(got) == 5
    assert engine.execute("COUNT s WHERE v > 15").scalars == {"count": 3}


def test_changes(engine):
    fill(engine, "CREATE u:a SET n = 1, m = 'x'", "CREATE u:b SET n = 2")
    assert json.loads(engine.run("CREATE u:a SET n = 5 ON CONFLICT UPDATE"))["status"] == "updated"
    assert rows(engine, "SELECT * FROM u:a") == [{"n": 5, "m": "x", "id": "u:a"}]
    fill(engine, "CREATE u:a SET n = 9 ON CONFLICT UPDATE SET m = 'y'")
    assert rows(engine, "SELECT * FROM u:a") == [{"n": 5, "m": "y", "id": "u:a"}]
    assert engine.execute("UPDATE u SET z = 1 WHERE n > 3").scalars == {"matched": 1}
    assert engine.execute("UPDATE u:nobody SET z = 1").scalars == {"matched": 0}
    assert engine.execute("DELETE u:a").scalars == {"existed": True} and engine.execute("DELETE u:a").scalars == {"existed": False}
    assert engine.execute("DELETE u").scalars == {"count": 1} and engine.execute("COUNT u").scalars == {"count": 0}
    with pytest.raises(QueryError):
        engine.execute("CREATE u SET n = 1 ON CONFLICT UPDATE")
    assert len(engine.execute("CREATE u SET n = 1").scalars["id"]) > 30


def test_many_changes_keep_a_short_lineage(engine):
    for i in range(20):
        engine.execute(f"CREATE k:r{i} SET n = {i}")
    assert engine.execute("COUNT k WHERE n >= 10").scalars == {"count": 10}
    assert engine.catalog.version("k") == 20
    assert "parquet" in engine.catalog.table("k")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_unique_and_indexable(engine):
    fill(engine, "CREATE m:a SET e = 'x', t = 1", "DEFINE INDEX i ON m FIELDS e, t UNIQUE", "CREATE m:b SET e = 'x', t = 2", "CREATE m:c SET e = 'x'", "CREATE m:d SET e = 'x'")
    with pytest.raises(SchemaError):
        engine.execute("CREATE m:e SET e = 'x', t = 1")
    with pytest.raises(SchemaError):
        engine.execute("CREATE m:f SET e = [1]")
    with pytest.raises(SchemaError):
        engine.execute("DEFINE INDEX j ON m FIELDS e UNIQUE")
    fill(engine, "REMOVE INDEX i ON m", "CREATE m:e SET e = 'x', t = 1", "REMOVE INDEX unknown ON m", "COMPACT")


def test_batch(engine):
    fill(engine, "CREATE b:old SET n = 1")
    out = engine.run_lines(["BEGIN BATCH", "CREATE b:x SET n = 1", "CREATE b:x SET n = 2", "CREATE b:old SET m = 3 ON CONFLICT UPDATE", "RELATE b:x->e->b:old SET weight = 2.5", "END BATCH", "COUNT b"])
    assert json.loads(out[0]) == {"status": "batch", "count": 4, "created": 3, "updated": 1}
    assert json.loads(out[1])["count"] == 2
    assert rows(engine, "SELECT * FROM b:old") == [{"n": 1, "m": 3, "id": "b:old"}]
    bad = engine.run_lines(["BEGIN BATCH", "CREATE b:y SET n = 1", "SELECT * FROM b", "END BATCH"])
    assert json.loads(bad[0])["status"] == "error" and engine.execute("COUNT b").scalars == {"count": 2}


def graph_of(engine):
    fill(
        engine, "CREATE user:a SET name = 'A'", "CREATE user:b SET name = 'B', age = 3", "CREATE user:c SET name = 'C', age = 9", "CREATE item:i SET name = 'I'",
        "RELATE user:a->knows->user:b SET weight = 2.5, since = 2001", "RELATE user:b->knows->user:c", "RELATE user:a->knows->user:c SET weight = 'heavy'", "RELATE user:c->likes->item:i", "RELATE user:a->knows->user:gone",
    )


def test_traversal_and_graph_verbs(engine):
    graph_of(engine)
    ids = lambda q: sorted(r["id"] for r in rows(engine, q))
    assert ids("SELECT ->knows->user FROM user:a") == ["user:b", "user:c"]
    assert ids("SELECT <-knows<-user FROM user:c") == ["user:a", "user:b"]
    assert rows(engine, "SELECT ->knows->user->likes->item.name FROM user") == [{"name": "I", "id": "item:i"}]
    assert ids("SELECT ->knows->user FROM user WHERE age > 5") == ["user:c"]
    assert [r["id"] for r in rows(engine, "SELECT ->knows->user FROM user LIMIT 1")] == ["user:b"]
    assert ids("SELECT ->likes->item FROM user:b") == []
    e = {(r["src"], r["dst"]): r for r in rows(engine, "GRAPH EDGES knows")}
    assert e["a", "b"] == {"src": "a", "dst": "b", "edge_type": "knows", "weight": 2.5, "since": 2001} and e["a", "c"]["weight"] == 1.0
    assert [r["dst"] for r in rows(engine, "GRAPH EDGES knows WHERE weight > 1.0 AND since = 2001")] == ["b"]
    assert rows(engine, "GRAPH CENTRALITY knows INDEGREE LIMIT 1") == [{"id": "c", "score": 2.0}]
    assert rows(engine, "GRAPH PATH a -> c ON knows") == [{"found": True, "length": 1, "path": ["a", "c"]}]
    assert rows(engine, "GRAPH PATH c -> a ON knows") == [{"found": False, "length": -1, "path": []}]
    assert rows(engine, "GRAPH PATH zz -> zz ON knows") == [{"found": True, "length": 0, "path": ["zz"]}]
    assert engine.execute("GRAPH COMPONENTS knows").scalars == {"component_count": 1, "largest": 4, "nodes": 4}
    assert engine.execute("GRAPH COMPONENTS nothing").scalars == {"component_count": 0, "largest": 0, "nodes": 0}


def test_cache_follows_versions(engine):
    graph_of(engine)
    engine.execute("GRAPH CENTRALITY knows")
    engine.execute("GRAPH CENTRALITY knows")
    assert (engine.cache.hits, engine.cache.misses) == (1, 1)
    engine.execute("RELATE user:x->likes->item:i")
    engine.execute("GRAPH CENTRALITY knows")
    assert engine.cache.hits == 2
    engine.execute("RELATE user:x->knows->user:a")
    assert {r["id"] for r in rows(engine, "GRAPH CENTRALITY knows")} >= {"x"} and engine.cache.misses == 2
    c = ResultCache(capacity=2, most_bytes=10)
    for i in range(3):
        c.put(i, 0, i, 4)
    assert c.get(0, 0) is None and c.get(2, 0) == 2 and c.get(2, 1) is None and c.bytes == 4
    c.put(9, 0, 9, 99)
    assert c.get(9, 0) is None


def test_search_lifecycle(engine):
    fill(engine, "CREATE d:a SET body = 'the quick brown fox', p = 'x'", "CREATE d:b SET body = 'lazy dog sleeps'", "CREATE d:c SET body = 'quick quick quick fox', p = 'y'", "CREATE d:n SET body = 5")
    with pytest.raises(QueryError):
        engine.execute("SEARCH d body 'quick'")
    fill(engine, "DEFINE FULLTEXT INDEX f ON d FIELDS body")
    got = rows(engine, "SEARCH d body 'quick'")
    assert [r["id"] for r in got] == ["d:c", "d:a"] and got[0]["score"] > got[1]["score"]
    assert [r["id"] for r in rows(engine, "SEARCH d body 'quick' WHERE p = 'x'")] == ["d:a"]
    assert [r["id"] for r in rows(engine, "SEARCH d body '\"brown fox\"'")] == ["d:a"]
    assert [r["id"] for r in rows(engine, "SEARCH d body 'quick -brown'")] == ["d:c"] and [r["id"] for r in rows(engine, "SEARCH d body '+fox +brown'")] == ["d:a"]
    fill(engine, "UPDATE d:b SET body = 'now quick'", "DELETE d:c")
    assert {r["id"] for r in rows(engine, "SEARCH d body 'quick'")} == {"d:a", "d:b"}
    assert rows(engine, "SEARCH d body '...'") == []


def test_vector_and_hybrid_search(engine):
    fill(engine, "CREATE v:a SET body = 'quick brown fox', emb = [1, 0], p = 'p1'", "CREATE v:b SET body = 'lazy dog', emb = [0, 1.0], p = 'p2'", "CREATE v:c SET emb = [1, 2, 3]", "CREATE v:d SET emb = ['x', 1]")
    fill(engine, "DEFINE VECTOR INDEX w ON v FIELDS emb DIMENSION 2 METRIC l2", "DEFINE FULLTEXT INDEX f ON v FIELDS body")
    got = rows(engine, "VECTOR SEARCH v emb [1, 0]")
    assert [(r["id"], round(r["distance"], 6)) for r in got] == [("v:a", 0.0), ("v:b", 1.414214)]
    assert [r["id"] for r in rows(engine, "VECTOR SEARCH v emb [1, 0] WHERE p = 'p2' K 1")] == ["v:b"]
    with pytest.raises(QueryError):
        engine.execute("VECTOR SEARCH v emb [1, 0, 0]")
    h = lambda a: rows(engine, f"HYBRID SEARCH v TEXT body 'quick' VECTOR emb [0, 1] ALPHA {a}")
    assert h(1)[0]["id"] == "v:a" and h(0)[0]["id"] == "v:b"
    assert set(h(0.5)[0]) >= {"score", "text_score", "vector_score"}


def test_schema(engine):
    engine.catalog.schemas["s"] = Schema("s", (FieldDef("name", "string", True), FieldDef("age", "int"), FieldDef("emb", "vector", dimension=3)))
    fill(engine, "CREATE s:a SET name = 'x', age = 3, emb = [1, 2, 3]", "CREATE s:b SET name = 'x', age = NONE")
    for bad in ("age = 3", "name = 'x', other = 1", "name = 'x', age = 3.0", "name = 'x', emb = [1]", "name = 5"):
        with pytest.raises(SchemaError):
            engine.execute(f"CREATE s SET {bad}")


def test_typed_tables(engine, spark):
    engine.catalog.add_table("p", spark.createDataFrame([("a", 1, 2.0), ("b", None, float("nan"))], "k string, n long, f double"), "k")
    assert [r["id"] for r in rows(engine, "SELECT * FROM p WHERE n != 5")] == ["p:a"]
    assert rows(engine, "SELECT n FROM p WHERE f = 2") == [] and rows(engine, "SELECT n FROM p WHERE f > 1") == [{"n": 1, "id": "p:a"}]
    fill(engine, "UPDATE p SET n = 7 WHERE n IS NONE")
    assert engine.execute("COUNT p WHERE n = 7").scalars == {"count": 1}
    for bad in ("CREATE p:c SET n = 1.5", "CREATE p:c SET x = 1", "UPDATE p SET f = 'x'"):
        assert json.loads(engine.run(bad))["status"] == "error"


def test_catalog_is_saved_and_loaded(engine, spark, tmp_path):
    graph_of(engine)
    fill(engine, "DEFINE FULLTEXT INDEX f ON user FIELDS name", "CREATE user:d SET name = 'D', tags = [1, 'x']")
    engine.catalog.schemas["s"] = Schema("s", (FieldDef("emb", "vector", dimension=3),))
    engine.catalog.save(str(tmp_path))
    engine.execute("DELETE user:d")
    engine.catalog.save(str(tmp_path))
    again = Engine(spark, type(engine.catalog).load(spark, str(tmp_path)))
    assert rows(again, "SELECT * FROM user") == rows(engine, "SELECT * FROM user")
    assert [r["id"] for r in rows(again, "SEARCH user name 'b'")] == ["user:b"] and again.catalog.schemas == engine.catalog.schemas
    assert sorted(r["id"] for r in rows(again, "SELECT ->knows->user FROM user:a")) == ["user:b", "user:c"]


def test_edges_one_by_one(engine):
    from tessella.operators import dml

    graph_of(engine)
    df = engine.catalog.edge_table("knows")
    assert dml.edge(df, "a", "b").count() == 1 and dml.unrelate(df, "a", "b").count() == df.count() - 1
    new = dml.update_edge(df, "a", "b", (("weight", 7),))
    assert {(r.src, r.dst): r.weight for r in __import__("tessella.operators.graph", fromlist=["x"]).weighted(new).collect()}["a", "b"] == 7.0
    with pytest.raises(QueryError):
        dml.update_edge(df, "a", "zz", ())


def test_prompt(spark, monkeypatch, capsys):
    import io
    import sys

    from tessella.__main__ import main

    monkeypatch.setattr(sys, "stdin", io.StringIO("CREATE u:a SET x = 1;\n\nBEGIN BATCH\nCREATE u:b SET x = 2\nEND BATCH\nCOUNT u OUTCOME CSV\nquit\nCOUNT u\n"))
    main(["--table", "region=/root/testdata/sf0.001/region.parquet:r_regionkey"])
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[0])["id"] == "u:a" and json.loads(out[1])["created"] == 1 and out[2:] == ["status,count", "count,2"]


def test_pieces_are_the_result(engine):
    fill(engine, "CREATE p:a SET v = 1", "CREATE p:b SET v = 'x, y'", "CREATE p:c SET w = [1]")
    for q in ("SELECT * FROM p", "SELECT v FROM p ORDER BY v DESC LIMIT 2", "SELECT v FROM nobody", "COUNT p", "SELECT v FROM p OUTCOME CSV"):
        got = list(engine.pieces(q))
        assert "".join(got) == engine.run(q)
    assert len(list(engine.pieces("SELECT * FROM p"))) == 5
