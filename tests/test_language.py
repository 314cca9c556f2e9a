from __future__ import annotations

import pytest

from tessella.errors import QueryError
from tessella.lang import statements as st
from tessella.lang.parser import parse
from tessella.lang.tokens import tokenize


def one(text):
    return parse(text).statement


def test_tokens():
    assert [t.kind for t in tokenize("a->b<-c <= -5 1.5e3 'x' \"y\" :: -- note\n;")] == ["word", "out", "word", "back", "word", "op", "int", "float", "string", "string", "path", "mark"]
    assert [t.text for t in tokenize("x -- y -> z")] == ["x"]
    for bad in ("a @ b", "'open", "x + 1", "$p", "--> x"):
        with pytest.raises(QueryError):
            tokenize(bad)


def test_select_forms():
    s = one("SELECT name, ast::complexity(x) FROM user WHERE age > 25 AND y IS NOT NONE ORDER BY age DESC, n LIMIT 3;")
    assert s.items[1].column == "ast::complexity(x)" and s.limit == 3
    assert s.where == (st.Compare(st.Field("age"), ">", 25), st.IsNone("y", True))
    assert s.order == (st.SortKey("age", True), st.SortKey("n", False))
    assert one("SELECT * FROM t:9").target == st.Target("t", "9")
    c = one("SELECT ->knows->user<-likes<-item.name FROM user:a").items
    assert [h.outgoing for h in c.hops] == [True, False] and c.field == "name"
    assert [i.column for i in one("SELECT 'x', 1, NONE, TRUE, 2.0, [1, 'a'] FROM t").items] == ["'x'", "1", "NONE", "true", "2", "[1, 'a']"]


def test_other_statements():
    assert one("CREATE u:a SET x = 1 ON CONFLICT UPDATE SET y = NULL").conflict_fields == (("y", None),)
    assert one("UPDATE t SET a = [1, 2.5] WHERE b = 'x'").fields == (("a", [1, 2.5]),)
    assert one("DELETE t:a") == st.Delete(st.Target("t", "a"))
    assert one("RELATE a:x->e->b:y SET w = 2").dest == st.Target("b", "y")
    assert one("COUNT t WHERE k = 'f' GROUP BY lang").group == "lang"
    assert one("GRAPH COMMUNITIES e ALGORITHM label_propagation MAX_ITER 3 RESOLUTION 0.5") == st.GraphCommunities("e", "label_propagation", 3, 0.5)
    assert one("GRAPH PAGERANK e MAX_ITER 5 DAMPING 0.9 LIMIT 2") == st.GraphPageRank("e", 0.9, 5, 2)
    assert one("GRAPH CENTRALITY e").mode == "degree"
    assert one("GRAPH PATH a -> b ON e MAX_DEPTH 4") == st.GraphPath("a", "b", "e", 4)
    assert one("DEFINE INDEX i ON TABLE t FIELDS a, b UNIQUE") == st.DefineIndex("i", "t", ("a", "b"), True)
    assert one("DEFINE FULLTEXT INDEX f ON t FIELDS body ANALYZER english").analyzer == "english"
    assert one("DEFINE VECTOR INDEX v ON t FIELDS e DIMENSION 3").metric == "cosine"
    assert one("REMOVE INDEX i ON t") == st.RemoveIndex("i", "t")
    assert one("VECTOR SEARCH t e [1, 0.5] WHERE p = 'x' K 3").k == 3
    assert one("HYBRID SEARCH t TEXT b 'q' VECTOR e [1] ALPHA 0.2").alpha == 0.2
    assert one("COMPACT") == st.Compact()
    assert parse("SELECT * FROM t OUTCOME TOON").outcome == "TOON"


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT * FROM t LIMIT 0", "SELECT * FROM t LIMIT -1", "SELECT * FROM t x", "COUNT count", "SELECT a FROM t WHERE a", "SELECT a FROM t WHERE 1 IS NONE", "GRAPH COMMUNITIES e ALGORITHM x", "DEFINE VECTOR INDEX v ON t FIELDS a, b DIMENSION 3", "VECTOR SEARCH t e ['a']", "SELECT * FROM t OUTCOME XML", "SELECT a::b FROM t", "CREATE t", "RELATE a->e->b:y"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)
