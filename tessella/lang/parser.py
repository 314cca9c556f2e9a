"""Recursive-descent parser: text to a Query.

Beyond the words of the language, record ids after ``:`` may be numbers or quoted strings.
"""

from __future__ import annotations

from tessella.errors import QueryError
from tessella.lang import statements as st
from tessella.lang.tokens import RESERVED, Token, tokenize


def parse(text: str) -> st.Query:
    p = Parser(tokenize(text))
    out = p.query()
    p.end()
    return out


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0

    # -- cursor

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else None

    def fail(self, wanted: str) -> QueryError:
        t = self.peek()
        return QueryError(f"expected {wanted}, found {t.text!r} at position {t.at}" if t else f"expected {wanted}, found the end")

    def take(self, kind: str, text: str | None = None) -> Token | None:
        t = self.peek()
        if t and t.kind == kind and (text is None or t.text == text):
            self.i += 1
            return t
        return None

    def need(self, kind: str, text: str | None = None) -> Token:
        if t := self.take(kind, text):
            return t
        raise self.fail(repr(text) if text else kind)

    def word(self, *keywords: str) -> str | None:
        t = self.peek()
        if t and t.keyword in keywords:
            self.i += 1
            return t.keyword
        return None

    def words(self, *keywords: str) -> None:
        for k in keywords:
            if not self.word(k):
                raise self.fail(k)

    def name(self) -> str:
        t = self.peek()
        if t and t.kind == "word" and t.keyword not in RESERVED:
            self.i += 1
            return t.text
        raise self.fail("a name")

    def record_id(self) -> str:
        return t.text if (t := self.take("int") or self.take("string")) else self.name()

    def positive(self) -> int:
        n = int(self.need("int").text)
        if n < 1:
            raise QueryError(f"expected a positive number, found {n}")
        return n

    def number(self) -> float:
        if t := self.take("float") or self.take("int"):
            return float(t.text)
        raise self.fail("a number")

    def end(self) -> None:
        if t := self.peek():
            raise QueryError(f"unexpected {t.text!r} at position {t.at}")

    # -- statements

    def query(self) -> st.Query:
        s = self.statement()
        outcome = "JSON"
        if self.word("OUTCOME"):
            outcome = self.word("JSON", "TOON", "CSV")
            if not outcome:
                raise self.fail("JSON, TOON or CSV")
        self.take("mark", ";")
        return st.Query(s, outcome)

    def statement(self):
        verb = self.word("CREATE", "SELECT", "UPDATE", "DELETE", "RELATE", "COUNT", "GRAPH", "DEFINE", "REMOVE", "SEARCH", "VECTOR", "HYBRID", "COMPACT")
        if not verb:
            raise self.fail("a statement")
        return getattr(self, "_" + verb.lower())()

    def target(self) -> st.Target:
        return st.Target(self.name(), self.record_id() if self.take("mark", ":") else None)

    def record(self) -> st.Target:
        table = self.name()
        self.need("mark", ":")
        return st.Target(table, self.record_id())

    def assigned(self) -> st.Assigned:
        out = []
        while True:
            field = self.name()
            self.need("op", "=")
            out.append((field, self.literal()))
            if not self.take("mark", ","):
                return tuple(out)

    def literal(self) -> st.Literal:
        if t := self.take("string"):
            return t.text
        if t := self.take("int"):
            n = int(t.text)
            if not -(2**63) <= n < 2**63:
                raise QueryError(f"number out of range: {t.text}")
            return n
        if t := self.take("float"):
            return float(t.text)
        if k := self.word("TRUE", "FALSE", "NONE", "NULL"):
            return {"TRUE": True, "FALSE": False}.get(k)
        if self.take("mark", "["):
            out = []
            while not self.take("mark", "]"):
                out.append(self.literal())
                if not self.take("mark", ","):
                    self.need("mark", "]")
                    break
            return out
        raise self.fail("a literal")

    def vector(self) -> tuple[float, ...]:
        v = self.literal()
        if not isinstance(v, list) or any(isinstance(x, bool) or not isinstance(x, int | float) for x in v):
            raise QueryError("expected a list of numbers")
        return tuple(float(x) for x in v)

    def item(self) -> st.Item:
        t = self.peek()
        if t and (t.kind in ("string", "int", "float") or t.text == "[" or t.keyword in ("TRUE", "FALSE", "NONE", "NULL")):
            return st.Constant(self.literal())
        name = self.name()
        while self.take("path"):
            name += "::" + self.name()
        if self.take("mark", "("):
            args = []
            while not self.take("mark", ")"):
                args.append(self.item())
                if not self.take("mark", ","):
                    self.need("mark", ")")
                    break
            return st.Call(name, tuple(args))
        if "::" in name:
            raise self.fail("'('")
        return st.Field(name)

    def where(self) -> st.Where:
        if not self.word("WHERE"):
            return ()
        out = []
        while True:
            item = self.item()
            if self.word("IS"):
                negated = bool(self.word("NOT"))
                if not self.word("NONE", "NULL"):
                    raise self.fail("NONE")
                if not isinstance(item, st.Field):
                    raise QueryError("IS NONE applies to fields alone")
                out.append(st.IsNone(item.name, negated))
            else:
                op = self.need("op").text
                out.append(st.Compare(item, op, self.literal()))
            if not self.word("AND"):
                return tuple(out)

    def limit(self, word: str = "LIMIT") -> int | None:
        return self.positive() if self.word(word) else None

    def _create(self) -> st.Create:
        target = self.target()
        self.words("SET")
        fields = self.assigned()
        if not self.word("ON"):
            return st.Create(target, fields)
        self.words("CONFLICT", "UPDATE")
        return st.Create(target, fields, True, self.assigned() if self.word("SET") else None)

    def _select(self) -> st.Select:
        t = self.peek()
        if self.take("mark", "*"):
            items = None
        elif t and t.kind in ("out", "back"):
            items = self._chain()
        else:
            got = [self.item()]
            while self.take("mark", ","):
                got.append(self.item())
            items = tuple(got)
        self.words("FROM")
        target, where, order = self.target(), self.where(), []
        if self.word("ORDER"):
            self.words("BY")
            while True:
                field = self.name()
                order.append(st.SortKey(field, self.word("ASC", "DESC") == "DESC"))
                if not self.take("mark", ","):
                    break
        return st.Select(items, target, where, tuple(order), self.limit())

    def _chain(self) -> st.Chain:
        hops = []
        while (t := self.peek()) and t.kind in ("out", "back"):
            self.i += 1
            edge = self.name()
            self.need(t.kind)
            hops.append(st.Hop(edge, self.name(), t.kind == "out"))
        return st.Chain(tuple(hops), self.name() if self.take("mark", ".") else None)

    def _update(self) -> st.Update:
        target = self.target()
        self.words("SET")
        return st.Update(target, self.assigned(), self.where())

    def _delete(self) -> st.Delete:
        target = self.target()
        return st.Delete(target, () if target.id is not None else self.where())

    def _relate(self) -> st.Relate:
        source = self.record()
        self.need("out")
        edge = self.name()
        self.need("out")
        return st.Relate(source, edge, self.record(), self.assigned() if self.word("SET") else ())

    def _count(self) -> st.Count:
        table, where = self.name(), self.where()
        group = None
        if self.word("GROUP"):
            self.words("BY")
            group = self.name()
        return st.Count(table, where, group)

    def _graph(self):
        verb = self.word("COMMUNITIES", "COMPONENTS", "PAGERANK", "CENTRALITY", "PATH", "EDGES")
        if not verb:
            raise self.fail("a graph verb")
        if verb == "PATH":
            a = self.record_id()
            self.need("out")
            b = self.record_id()
            self.words("ON")
            return st.GraphPath(a, b, self.name(), self.limit("MAX_DEPTH"))
        edge = self.name()
        if verb == "COMPONENTS":
            return st.GraphComponents(edge)
        if verb == "EDGES":
            return st.GraphEdges(edge, self.where())
        if verb == "CENTRALITY":
            mode = self.word("DEGREE", "INDEGREE", "OUTDEGREE") or "DEGREE"
            return st.GraphCentrality(edge, mode.lower(), self.limit())
        given = {}
        if verb == "PAGERANK":
            while k := self.word("DAMPING", "MAX_ITER"):
                given[k.lower()] = self.number() if k == "DAMPING" else self.positive()
            return st.GraphPageRank(edge, limit=self.limit(), **given)
        while k := self.word("ALGORITHM", "MAX_ITER", "RESOLUTION"):
            if k == "ALGORITHM":
                a = self.name().lower().replace("_", "")
                if a not in ("louvain", "lp", "labelpropagation"):
                    raise QueryError(f"unknown community algorithm: {a}")
                given["algorithm"] = "louvain" if a == "louvain" else "label_propagation"
            else:
                given[k.lower()] = self.positive() if k == "MAX_ITER" else self.number()
        return st.GraphCommunities(edge, **given)

    def _on_table(self) -> str:
        self.words("ON")
        t = self.peek(1)
        if self.peek() and self.peek().keyword == "TABLE" and t and t.kind == "word" and t.keyword != "FIELDS":
            self.i += 1
        return self.name()

    def _define(self):
        kind = self.word("FULLTEXT", "VECTOR")
        self.words("INDEX")
        name, table = self.name(), self._on_table()
        self.words("FIELDS")
        fields = [self.name()]
        while self.take("mark", ","):
            fields.append(self.name())
        if kind and len(fields) > 1:
            raise QueryError(f"a {kind.lower()} index has one field")
        if kind == "FULLTEXT":
            return st.DefineFulltext(name, table, fields[0], self.name().lower() if self.word("ANALYZER") else "default")
        if kind == "VECTOR":
            self.words("DIMENSION")
            n = self.positive()
            return st.DefineVector(name, table, fields[0], n, self.name().lower() if self.word("METRIC") else "cosine")
        return st.DefineIndex(name, table, tuple(fields), bool(self.word("UNIQUE")))

    def _remove(self) -> st.RemoveIndex:
        self.words("INDEX")
        return st.RemoveIndex(self.name(), self._on_table())

    def _search(self) -> st.Search:
        return st.Search(self.name(), self.name(), self.need("string").text, self.where(), self.limit())

    def _vector(self) -> st.VectorSearch:
        self.words("SEARCH")
        return st.VectorSearch(self.name(), self.name(), self.vector(), self.where(), self.limit("K"))

    def _hybrid(self) -> st.HybridSearch:
        self.words("SEARCH")
        table = self.name()
        self.words("TEXT")
        text, query = self.name(), self.need("string").text
        self.words("VECTOR")
        field, vector = self.name(), self.vector()
        alpha = self.number() if self.word("ALPHA") else 0.5
        return st.HybridSearch(table, text, query, field, vector, alpha, self.where(), self.limit())

    def _compact(self) -> st.Compact:
        return st.Compact()
