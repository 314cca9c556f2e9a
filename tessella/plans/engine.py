"""Statements to lazy DataFrames, and text to results.

``plan`` gives the DataFrame of a reading statement without running it; ``execute`` also changes tables; ``run`` takes text
and gives text. A change is visible to the statements that follow; DataFrames planned before keep the version they saw.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Row as SparkRow
from pyspark.sql import functions as F

from tessella.errors import QueryError, SchemaError, TessellaError
from tessella.functions.registry import registry
from tessella.lang import statements as st
from tessella.lang.parser import parse
from tessella.operators import communities, dml, graph, hybrid, relational, text, vector
from tessella.operators.fields import is_dynamic, kind_of, value_of
from tessella.plans.cache import ResultCache
from tessella.plans.catalog import Catalog, Index
from tessella.sources.render import Result, error, json_row, json_rows, render
from tessella.sources.snapshots import written

DEFAULT_LIMIT = 10


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, cache: ResultCache | None = None):
        self.spark, self.catalog = spark, catalog or Catalog(spark)
        self.cache = cache or ResultCache()
        self.functions = registry()

    # -- text

    def run(self, query: str) -> str:
        """The result of one statement as text; an error is text, too."""
        try:
            q = parse(query)
        except TessellaError as e:
            return error(str(e))
        try:
            return render(self.execute(q.statement), q.outcome)
        except TessellaError as e:
            return error(str(e), q.outcome)

    def pieces(self, query: str) -> Iterator[str]:
        """run()'s JSON in pieces, a row at a time, so that a large result is never whole on the driver."""
        q = parse(query)
        s = q.statement
        if q.outcome != "JSON" or not isinstance(s, st.Select | st.GraphEdges | st.Search | st.VectorSearch | st.HybridSearch):
            yield self.run(query)
            return
        df = self._ordered(s)
        head = json_rows([])[: -len("]}")]
        yield head.replace('"count":0', f'"count":{df.count()}')
        for i, r in enumerate(df.toLocalIterator(prefetchPartitions=True)):
            yield ("," if i else "") + json_row(self._row(r))
        yield "]}"

    def run_lines(self, lines: Sequence[str]) -> list[str]:
        """The line protocol: a statement a line; between BEGIN BATCH and END BATCH they form one change."""
        out, batch = [], None
        for line in lines:
            s = line.strip().rstrip(";").strip()
            if not s:
                continue
            if s.upper() == "BEGIN BATCH":
                batch = []
            elif s.upper() == "END BATCH" and batch is not None:
                try:
                    out.append(render(self.batch([parse(x).statement for x in batch])))
                except TessellaError as e:
                    out.append(error(str(e)))
                batch = None
            elif batch is not None:
                batch.append(s)
            else:
                out.append(self.run(s))
        return out

    # -- reading

    def plan(self, statement: Any) -> DataFrame:
        """The lazy DataFrame of a SELECT, COUNT, GRAPH or search statement."""
        s = parse(statement).statement if isinstance(statement, str) else statement
        f = getattr(self, "_plan_" + type(s).__name__, None)
        if f is None:
            raise QueryError(f"{type(s).__name__} doesn't read rows")
        return f(s)

    def _plan_Select(self, s: st.Select) -> DataFrame:
        if not isinstance(s.items, st.Chain):
            return relational.select(self.catalog.table(s.target.table), s, self.functions)
        chain = s.items
        start = self.spark.createDataFrame([(s.target.id,)], "_id string") if s.target.id is not None else self.catalog.table(s.target.table).select("_id")
        last = chain.hops[-1].table
        found = graph.traverse(start, [(self.catalog.edge_table(h.edge), h.outgoing) for h in chain.hops], self.catalog.table(last), s.where, s.limit, self.functions)
        return relational.project(found, last, [st.Field(chain.field)] if chain.field else None)

    def _plan_Count(self, s: st.Count) -> DataFrame:
        df = self.catalog.table(s.table)
        return relational.count_by(df, s.group, s.where, self.functions) if s.group else relational.count(df, s.where, self.functions)

    def _plan_GraphEdges(self, s: st.GraphEdges) -> DataFrame:
        return graph.edge_rows(self.catalog.edge_table(s.edge), s.edge, s.where)

    def _plan_GraphCentrality(self, s: st.GraphCentrality) -> DataFrame:
        return graph.centrality(self.catalog.edge_table(s.edge), s.mode, s.limit)

    def _plan_GraphPageRank(self, s: st.GraphPageRank) -> DataFrame:
        return graph.pagerank(self.catalog.edge_table(s.edge), s.damping, s.max_iter, s.limit)

    def _plan_GraphComponents(self, s: st.GraphComponents) -> DataFrame:
        return graph.components(self.catalog.edge_table(s.edge))

    def _plan_GraphCommunities(self, s: st.GraphCommunities) -> DataFrame:
        return communities.communities(self.catalog.edge_table(s.edge), s.algorithm, s.max_iter, s.resolution)

    def _plan_GraphPath(self, s: st.GraphPath) -> DataFrame:
        return graph.path(self.catalog.edge_table(s.edge), s.source, s.dest, s.max_depth)

    def _index(self, table: str, field: str, kind: str) -> Index:
        for i in self.catalog.indexes_of(table, kind):
            if i.fields == (field,):
                return i
        raise QueryError(f"no {'full-text' if kind == 'fulltext' else 'vector'} index defined on {table}.{field}")

    def _built(self, i: Index) -> Any:
        """The index for the present version of its table, written when first asked for."""
        key = (i.name, i.table)
        version = self.catalog.version(i.table)
        found = self.catalog.built.get(key)
        if found is None or found[0] != version:
            df = self.catalog.table(i.table)
            if i.kind == "fulltext":
                made = text.postings(text.index(df, i.fields[0], i.analyzer))
            else:
                made = written(vector.index(df, i.fields[0], i.dimension), "index")
            found = self.catalog.built[key] = (version, made)
        return found[1]

    def _resolved(self, hits: DataFrame, scores: Sequence[str], table: str, where: st.Where, order: Sequence, limit: int) -> DataFrame:
        """The records of ranked hits; where filters them after the ranking."""
        df = self.catalog.table(table)
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in scores])
        got = relational.where(df.join(hits, "_id"), where, self.functions).orderBy(*order, "_id").limit(limit)
        return relational.project(got, table, None, extra=scores)

    def _plan_Search(self, s: st.Search) -> DataFrame:
        i, limit = self._index(s.table, s.field, "fulltext"), s.limit or DEFAULT_LIMIT
        hits = text.search(self._built(i), s.query, hybrid.fetched(limit, bool(s.where)), i.analyzer)
        return self._resolved(hits, ["score"], s.table, s.where, [F.col("score").desc()], limit)

    def _nearest(self, table: str, field: str, query: Sequence[float], k: int) -> DataFrame:
        i = self._index(table, field, "vector")
        if len(query) != i.dimension:
            raise QueryError(f"dimension mismatch: expected {i.dimension}, got {len(query)}")
        return vector.search(self._built(i), query, k, i.metric)

    def _plan_VectorSearch(self, s: st.VectorSearch) -> DataFrame:
        k = s.k or DEFAULT_LIMIT
        hits = self._nearest(s.table, s.field, s.vector, hybrid.fetched(k, bool(s.where)))
        return self._resolved(hits, ["distance"], s.table, s.where, [F.col("distance")], k)

    def _plan_HybridSearch(self, s: st.HybridSearch) -> DataFrame:
        limit = s.limit or DEFAULT_LIMIT
        i = self._index(s.table, s.text_field, "fulltext")
        pool = limit * hybrid.OVERFETCH
        fused = hybrid.fuse(text.search(self._built(i), s.query, pool, i.analyzer), self._nearest(s.table, s.vector_field, s.vector, pool), s.alpha)
        return self._resolved(fused, ["score", "text_score", "vector_score"], s.table, s.where, [F.col("score").desc()], limit)

    # -- running

    def execute(self, statement: Any) -> Result:
        s = parse(statement).statement if isinstance(statement, str) else statement
        name = type(s).__name__
        if name in ("GraphComponents", "GraphPageRank", "GraphCentrality", "GraphCommunities"):
            version, key = self.catalog.version(s.edge, edges=True), (self.catalog.namespace, self.catalog.database, s)
            found = self.cache.get(key, version)
            if found is None:
                found = self._read(s)
                self.cache.put(key, version, found, len(repr(found)))
            return found
        return getattr(self, "_do_" + name)(s) if hasattr(self, "_do_" + name) else self._read(s)

    def _ordered(self, s: Any) -> DataFrame:
        df = self.plan(s)
        if isinstance(s, st.Select) and s.limit is None and not s.order and not isinstance(s.items, st.Chain):
            df = df.orderBy("id")
        return df

    def _read(self, s: Any) -> Result:
        df = self._ordered(s)
        rows = [self._row(r) for r in df.collect()]
        if isinstance(s, st.Count) and not s.group:
            return Result("count", count=rows[0]["count"])
        if isinstance(s, st.GraphComponents):
            return Result("components", **rows[0])
        if isinstance(s, st.GraphCommunities):
            return Result("communities", rows, algorithm=s.algorithm, community_count=len(rows))
        return Result("rows", rows)

    @staticmethod
    def _row(r: SparkRow) -> dict[str, Any]:
        """A row as its fields: of dynamic tables the stored ones, of typed ones those that aren't NULL."""
        out: dict[str, Any] = {}
        for k, v in r.asDict().items():
            if k == "fields" and isinstance(v, dict):
                out = {n: value_of(x) for n, x in v.items()} | out
            elif isinstance(v, SparkRow) and "t" in v:
                out[k] = value_of(v)
            elif v is not None:
                out[k] = v
        return out

    def _do_Compact(self, s: st.Compact) -> Result:
        return Result("ok")

    # -- changes

    def _fields(self, table: str, fields: st.Assigned) -> dict[str, Any]:
        doc = dict(fields)
        if (schema := self.catalog.schemas.get(table)) is not None:
            schema.validate(doc)
        return doc

    def _indexable(self, table: str, doc: dict[str, Any]) -> None:
        for i in self.catalog.indexes_of(table, "index"):
            for f in i.fields:
                if f in doc and kind_of(doc[f]) == "array":
                    raise SchemaError(f"type not indexable: {table}.{f}")

    def _do_Create(self, s: st.Create) -> Result:
        table, df = s.target.table, self.catalog.table(s.target.table)
        doc = self._fields(table, s.fields)
        self._indexable(table, doc)
        if s.on_conflict and s.target.id is None:
            raise QueryError("ON CONFLICT UPDATE needs a record id")
        key = s.target.id or str(uuid.uuid4())
        new = dml.rows(df, [(key, doc)])
        exists = s.target.id is not None and not df.where(F.col("_id") == key).isEmpty()
        if exists and not s.on_conflict:
            raise QueryError(f"record exists: {table}:{key}")
        if exists:
            if s.conflict_fields is not None:
                self._indexable(table, dict(s.conflict_fields))
            self.catalog.change(table, dml.update(df, s.fields if s.conflict_fields is None else s.conflict_fields, dml.hits(df, s.target)))
            return Result("updated", id=f"{table}:{key}")
        for i in self.catalog.indexes_of(table, "index"):
            if i.unique and all(doc.get(f) is not None for f in i.fields):
                same = relational.where(df, tuple(st.Compare(st.Field(f), "=", doc[f]) for f in i.fields))
                if not same.isEmpty():
                    raise SchemaError(f"unique index {i.name}: value exists")
        self.catalog.change(table, dml.create(df, new))
        return Result("created", id=f"{table}:{key}")

    def _do_Update(self, s: st.Update) -> Result:
        """The WHERE of an UPDATE counts for a record target, too."""
        table, df = s.target.table, self.catalog.table(s.target.table)
        self._indexable(table, dict(s.fields))
        hit = dml.hits(df, s.target)
        more = relational.predicate(df, s.where, self.functions)
        if more is not None:
            hit = hit & F.coalesce(more, F.lit(False))
        matched = df.where(hit).count()
        if matched:
            self.catalog.change(table, dml.update(df, s.fields, hit))
        return Result("update", matched=matched)

    def _do_Delete(self, s: st.Delete) -> Result:
        table, df = s.target.table, self.catalog.table(s.target.table)
        hit = dml.hits(df, s.target, s.where, self.functions)
        n = df.where(hit).count()
        if n:
            self.catalog.change(table, dml.delete(df, hit))
        return Result("deleted", existed=n > 0) if s.target.id is not None else Result("deleted_many", count=n)

    def _do_Relate(self, s: st.Relate) -> Result:
        df = self.catalog.edge_table(s.edge)
        self.catalog.change(s.edge, dml.relate(df, dml.edge_rows(df, [(s.source.id, s.dest.id, dict(s.fields))])), edges=True)
        return Result("ok")

    def batch(self, statements: Sequence[Any]) -> Result:
        """CREATE and RELATE as one change of each table. Upserts see the tables as before; of equal ids the last wins."""
        docs: dict[str, dict[str, tuple[dict, bool, Any]]] = {}
        edges: dict[str, list] = {}
        created = updated = 0
        known: dict[str, set[str]] = {}
        for s in statements:
            if not isinstance(s, st.Create | st.Relate):
                raise QueryError("a batch holds CREATE and RELATE alone")
            if isinstance(s, st.Create) and s.on_conflict:
                if s.target.id is None:
                    raise QueryError("ON CONFLICT UPDATE needs a record id")
                known.setdefault(s.target.table, set()).add(s.target.id)
        exist = {t: {r[0] for r in self.catalog.table(t).where(F.col("_id").isin(sorted(ids))).select("_id").collect()} for t, ids in known.items()}
        for s in statements:
            if isinstance(s, st.Relate):
                edges.setdefault(s.edge, []).append((s.source.id, s.dest.id, dict(s.fields)))
                created += 1
                continue
            doc = self._fields(s.target.table, s.fields)
            self._indexable(s.target.table, doc)
            key = s.target.id or str(uuid.uuid4())
            merge = s.on_conflict and key in exist[s.target.table]
            created, updated = created + (not merge), updated + merge
            if merge and s.conflict_fields is not None:
                doc = dict(s.conflict_fields)
            docs.setdefault(s.target.table, {})[key] = (doc, merge, s)
        for t, rows in docs.items():
            df = self.catalog.table(t)
            plain = [(k, d) for k, (d, merge, _) in rows.items() if not merge]
            merges = [(k, d) for k, (d, merge, _) in rows.items() if merge]
            if plain:
                df = dml.replace(df, dml.rows(df, plain))
            if merges:
                df = dml.upsert(df, dml.rows(df, merges))
            self.catalog.change(t, df)
        for e, rows in edges.items():
            df = self.catalog.edge_table(e)
            self.catalog.change(e, dml.relate(df, dml.edge_rows(df, rows)), edges=True)
        return Result("batch", count=len(statements), created=created, updated=updated)

    # -- indexes

    def _do_DefineIndex(self, s: st.DefineIndex) -> Result:
        df = self.catalog.table(s.table)
        for f in s.fields:
            arrays = df.where(F.try_element_at(F.col("fields"), F.lit(f))["t"] == "array").isEmpty() if is_dynamic(df) else f not in df.columns or not df.schema[f].dataType.simpleString().startswith(("array", "map", "struct", "binary"))
            if not arrays:
                raise SchemaError(f"type not indexable: {s.table}.{f}")
        if s.unique and not dml.unique_violations(df, s.fields).isEmpty():
            raise SchemaError(f"unique index {s.name}: rows share values")
        self.catalog.indexes[s.name, s.table] = Index(s.name, s.table, s.fields, unique=s.unique)
        return Result("ok")

    def _do_DefineFulltext(self, s: st.DefineFulltext) -> Result:
        self.catalog.indexes[s.name, s.table] = Index(s.name, s.table, (s.field,), "fulltext", analyzer=text.analyzer(s.analyzer))
        self.catalog.built.pop((s.name, s.table), None)
        return Result("ok")

    def _do_DefineVector(self, s: st.DefineVector) -> Result:
        self.catalog.indexes[s.name, s.table] = Index(s.name, s.table, (s.field,), "vector", dimension=s.dimension, metric=vector.metric(s.metric))
        self.catalog.built.pop((s.name, s.table), None)
        return Result("ok")

    def _do_RemoveIndex(self, s: st.RemoveIndex) -> Result:
        self.catalog.indexes.pop((s.name, s.table), None)
        self.catalog.built.pop((s.name, s.table), None)
        return Result("ok")


def to_json(doc: dict[str, Any]) -> str:
    return json.dumps(doc, ensure_ascii=False, sort_keys=True)


def from_json(text_: str) -> dict[str, Any]:
    return json.loads(text_)
