"""Syntax trees of files to documents and edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessella.functions import metaast as m
from tessella.plans.schema import FieldDef, Schema

EDGE_TYPES = ("calls", "contains", "returns", "imports", "overrides", "exemplifies")
DOCUMENT_KINDS = ("function_def", "container", "lambda", "property", "type_annotation")
DOCUMENT_DDL = "_id string, name string, kind string, language string, file_path string, line_start long, line_end long, source_text string, signature string, docstring string, ast_serialized string"
_COLUMNS = [c.split()[0] for c in DOCUMENT_DDL.split(", ")]


def ast_node_schema() -> Schema:
    required = [FieldDef(n, "string", True) for n in ("name", "kind", "language")]
    texts = [FieldDef(n, "string") for n in ("file_path", "source_text", "signature", "docstring", "ast_serialized")]
    lines = [FieldDef(n, "int") for n in ("line_start", "line_end")]
    vectors = [FieldDef(f"{n}_embedding", "vector", dimension=d) for n, d in (("source", 768), ("structure", 384), ("docstring", 768))]
    return Schema("ast_node", (*required, *texts, *lines, *vectors))


def _function_id(path: str, name: str, arity: int) -> str:
    return f"{path}::{name}/{arity}"


def _function_rows(within: m.Node, path: str, language: str) -> Iterator[dict]:
    """A document for each function at or below a node; of equal functions the last gives source and tree."""
    by_key = {(x.text("name"), x.int("arity") or 0): x for x in m.by_type(within, "FunctionDef")}
    for f in m.functions(within):
        own = by_key.get((f["name"], f["arity"]))
        yield {
            "_id": _function_id(path, f["name"], f["arity"]), "name": f["name"], "kind": "function_def", "language": language, "file_path": path, "line_start": f["line"], "line_end": None,
            "source_text": own and own.text("source"), "signature": f"{f['name']}({', '.join(f['params'])}) [{f['visibility']}]", "docstring": own and own.text("doc"), "ast_serialized": own and m.dump(own),
        }


def prepare(root: m.Node, path: str, language: str) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """(documents, edges (from, type, to)) of one file. Calls of names that the file defines lead to its functions."""
    local = {x.text("name"): x.int("arity") or 0 for x in m.by_type(root, "FunctionDef") if x.text("name") is not None}
    docs: list[dict] = []
    edges: list[tuple[str, str, str]] = []

    def call_edges(caller: str, body: m.Node) -> None:
        for name in m.calls(body):
            edges.append((caller, "calls", _function_id(path, name, local[name]) if name in local else f"call_target::{name}"))

    for c in m.by_type(root, "Container"):
        name, kind = c.text("name") or "anonymous", c.text("container_type") or "container"
        cid = f"{path}::{kind}::{name}"
        docs.append({"_id": cid, "name": name, "kind": kind, "language": language, "file_path": path, "line_start": c.int("line"), "line_end": None, "source_text": c.text("source"), "signature": None, "docstring": c.text("doc"), "ast_serialized": m.dump(c)})
        inner = list(_function_rows(c, path, language))
        docs += inner
        edges += [(cid, "contains", d["_id"]) for d in inner]
        edges += [(cid, "imports", f"import::{i['source']}") for i in m.imports(c)]
        for f in m.functions(c):
            for x in m.by_type(c, "FunctionDef"):
                if x.text("name") == f["name"] and (x.int("arity") or 0) == f["arity"]:
                    call_edges(_function_id(path, f["name"], f["arity"]), x)
    if root.type == "FunctionDef":
        for d in _function_rows(root, path, language):
            docs.append(d)
            call_edges(d["_id"], root)
    return docs, edges


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and edges (src, edge_type, dst) of files (file_path, language, ast_serialized); what isn't a tree is skipped."""

    def trees(pdf: pd.DataFrame) -> Iterator[tuple[list, list]]:
        for path, language, text in zip(pdf.file_path, pdf.language, pdf.ast_serialized):
            try:
                root = m.read(text)
            except (ValueError, TypeError):
                continue
            yield prepare(root, path, language)

    def documents(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [d for docs, _ in trees(pdf) for d in docs]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"line_start": "Int64", "line_end": "Int64"})

    def edges(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([e for _, es in trees(pdf) for e in es], columns=["src", "edge_type", "dst"])

    own = files.select("file_path", "language", "ast_serialized")
    return own.mapInPandas(documents, DOCUMENT_DDL), own.mapInPandas(edges, "src string, edge_type string, dst string")


def merged(batches: list[tuple[list[dict], list[tuple[str, str, str]]]]) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """Several files' documents and edges, each id and each edge once."""
    docs = {d["_id"]: d for ds, _ in batches for d in ds}
    return list(docs.values()), list(dict.fromkeys(e for _, es in batches for e in es))


def statements(docs: list[dict], edges: list[tuple[str, str, str]], table: str = "ast_node") -> list[str]:
    """CREATE and RELATE statements that load a batch; a value with both kinds of quotes is left out, for strings have no escapes."""

    def quoted(v: str) -> str | None:
        return f"'{v}'" if "'" not in v else f'"{v}"' if '"' not in v else None

    out = []
    for d in docs:
        sets = [f"{k} = {v if isinstance(v, int) else quoted(v)}" for k, v in d.items() if k != "_id" and v is not None and (isinstance(v, int) or quoted(v))]
        out.append(f"CREATE {table}:{quoted(d['_id'])} SET {', '.join(sets)} ON CONFLICT UPDATE")
    return out + [f"RELATE {table}:{quoted(a)}->{t}->{table}:{quoted(b)}" for a, t, b in edges]
