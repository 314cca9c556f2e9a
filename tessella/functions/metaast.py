"""Syntax trees as JSON: reading them, and structural functions over them, in plain Python.

A node is ``{"node_type": T, "meta": [[key, value]...], "children": {"Nodes": [...]} or {"Value": value}}`` and values
are tagged: ``{"String": s}``, ``{"Int": i}``, ``{"Float": f}``, ``{"Bool": b}``, ``{"Atom": s}``, ``{"List": [...]}``, ``{"Node": n}``, ``"Null"``.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from typing import Any

LAYERS = {
    "core": "Literal Variable BinaryOp UnaryOp FunctionCall Conditional EarlyReturn Throw Block List Map Pair Tuple Assignment InlineMatch Range StringInterpolation BinSegment Comment",
    "extended": "Loop Lambda CollectionOp PatternMatch MatchArm ExceptionHandling AsyncOperation Yield Comprehension Generator Filter Pipe Pin AssertType",
    "structural": "Container FunctionDef Param AttributeAccess AugmentedAssignment Property Import TypeAnnotation Decorator RecordUpdate ChildSpec",
    "native": "LanguageSpecific",
    "special": "Wildcard",
}
LAYER_OF = {t: layer for layer, types in LAYERS.items() for t in types.split()}
BRANCHES = frozenset("Conditional Loop PatternMatch MatchArm ExceptionHandling".split())


def atom(node_type: str) -> str:
    """FunctionDef to function_def; the wildcard is _."""
    if node_type == "Wildcard":
        return "_"
    return "".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(node_type))


FROM_ATOM = {atom(t): t for t in LAYER_OF}


@dataclass
class Node:
    type: str
    meta: list[tuple[str, Any]] = field(default_factory=list)
    nodes: list[Node] | None = None  # None: a leaf
    value: Any = None

    def get(self, key: str) -> Any:
        for k, v in self.meta:
            if k == key:
                return v
        return None

    def text(self, key: str) -> str | None:
        v = self.get(key)
        if isinstance(v, dict):
            return v.get("String", v.get("Atom"))
        return None

    def int(self, key: str) -> int | None:
        v = self.get(key)
        return v.get("Int") if isinstance(v, dict) else None

    @property
    def children(self) -> list[Node]:
        return self.nodes or []

    def data(self) -> dict:
        inner = {"Value": self.value} if self.nodes is None else {"Nodes": [n.data() for n in self.nodes]}
        return {"node_type": self.type, "meta": [[k, v] for k, v in self.meta], "children": inner}


def node(data: dict) -> Node:
    """A Node from its JSON data; ValueError if it isn't one."""
    try:
        kind, meta, inner = data["node_type"], [(k, v) for k, v in data["meta"]], data["children"]
        if kind not in LAYER_OF or len(inner) != 1:
            raise ValueError(f"no such node: {kind}")
        if "Nodes" in inner:
            return Node(kind, meta, [node(n) for n in inner["Nodes"]])
        return Node(kind, meta, None, inner["Value"])
    except (KeyError, TypeError) as e:
        raise ValueError(f"not a syntax tree: {e}") from e


def read(text: str) -> Node:
    return node(json.loads(text))


def dump(n: Node) -> str:
    return json.dumps(n.data(), ensure_ascii=False, separators=(",", ":"))


def walk(n: Node) -> Iterator[Node]:
    """Pre-order."""
    stack = [n]
    while stack:
        n = stack.pop()
        yield n
        if n.nodes:
            stack.extend(reversed(n.nodes))


def node_count(n: Node) -> int:
    return sum(1 for _ in walk(n))


def depth(n: Node) -> int:
    out, level = 0, [n]
    while level:
        out, level = out + 1, [c for x in level for c in x.children]
    return out


def complexity(n: Node) -> int:
    return 1 + sum(x.type in BRANCHES for x in walk(n))


# -- finding


def by_type(n: Node, kind: str) -> list[Node]:
    return [x for x in walk(n) if x.type == kind]


def by_name(n: Node, name: str) -> list[Node]:
    return [x for x in walk(n) if x.text("name") == name]


def ancestors(root: Node, target: Node) -> list[Node]:
    """From the root to the parent of target; empty for the root and for strangers."""
    stack = [(root, [])]
    while stack:
        n, above = stack.pop()
        if n is target:
            return above
        stack.extend((c, [*above, n]) for c in reversed(n.children))
    return []


def parent(root: Node, target: Node) -> Node | None:
    up = ancestors(root, target)
    return up[-1] if up else None


def siblings(root: Node, target: Node) -> list[Node]:
    p = parent(root, target)
    return [c for c in p.children if c is not target] if p else []


def containing(root: Node, target: Node, kind: str) -> Node | None:
    """The nearest ancestor of that type (FunctionDef, Container)."""
    return next((a for a in reversed(ancestors(root, target)) if a.type == kind), None)


def scope(root: Node, line: int) -> list[Node]:
    """The nodes whose lines hold that line, outer ones first."""
    out = []
    for n in walk(root):
        if not n.meta:
            continue
        a, b, one = n.int("line_start"), n.int("line_end"), n.int("line")
        if (a <= line <= b) if a is not None and b is not None else one == line and one is not None:
            out.append(n)
    return out


# -- extraction


def functions(n: Node) -> list[dict]:
    out = []
    for x in by_type(n, "FunctionDef"):
        params = x.get("params")
        listed = params.get("List", []) if isinstance(params, dict) else []
        out.append({"name": x.text("name") or "", "arity": x.int("arity") or 0, "params": [p["String"] for p in listed if isinstance(p, dict) and "String" in p], "visibility": x.text("visibility") or "public", "line": x.int("line")})
    return out


def imports(n: Node) -> list[dict]:
    return [{"source": x.text("source") or "", "import_type": x.text("import_type") or "import", "language": x.text("language")} for x in by_type(n, "Import")]


def variables(n: Node) -> set[str]:
    return {x.value["String"] for x in by_type(n, "Variable") if isinstance(x.value, dict) and "String" in x.value}


def calls(n: Node) -> list[str]:
    return [x.text("name") for x in by_type(n, "FunctionCall") if x.text("name") is not None]


# -- similarity


@lru_cache(maxsize=10_000)
def _few(kind: str, inner: tuple[int, ...]) -> int:
    return _digest(kind, inner)


def _digest(kind: str, inner: Sequence[int]) -> int:
    h = blake2b(f"{kind}/{len(inner)}".encode(), digest_size=8)
    for x in inner:
        h.update(x.to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little", signed=True)


def fingerprint(n: Node) -> list[int]:
    """The structural hashes of all subtrees, in pre-order: types and shapes count, names and values don't."""
    order = list(walk(n))
    done: dict[int, int] = {}
    for x in reversed(order):
        inner = tuple(done[id(c)] for c in x.children)
        done[id(x)] = (_few if len(inner) <= 8 else _digest)(x.type, inner)
    return [done[id(x)] for x in order]


def structural_hash(n: Node) -> int:
    return fingerprint(n)[0]


def similarity(a: Node, b: Node) -> float:
    return _similar(a, b, _sizes((a, b)))


def _sizes(roots: Sequence[Node]) -> dict[int, int]:
    sizes: dict[int, int] = {}
    for root in roots:
        for x in reversed(list(walk(root))):
            sizes[id(x)] = 1 + (sum([sizes[id(c)] for c in x.nodes]) if x.nodes else 0)
    return sizes


def _similar(a: Node, b: Node, sizes: dict[int, int]) -> float:
    same = a.type == b.type
    leaves = (a.nodes is None) + (b.nodes is None)
    if leaves == 1:
        return 0.3 if same else 0.0
    if leaves == 2 or not (a.nodes or b.nodes):
        return float(same)
    root = 2.0 / (sizes[id(a)] + sizes[id(b)])
    inner = _children(a.children, b.children, sizes)
    return root + (1 - root) * inner if same else (1 - root) * inner * 0.5


def _children(a: list[Node], b: list[Node], sizes: dict[int, int]) -> float:
    if not a or not b:
        return 0.0
    if len(a) == len(b) == 1:
        s = _similar(a[0], b[0], sizes)
        w = (sizes[id(a[0])] + sizes[id(b[0])]) / 2
        return w * s / w
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    free = list(range(len(many)))
    won = total = 0.0
    for x in few:
        best, at = 0.0, None
        for j in free:
            s = _similar(x, many[j], sizes)
            if s > best:
                best, at = s, j
                if s == 1.0:  # none is more similar
                    break
        w = (sizes[id(x)] + (sizes[id(many[at])] if at is not None else 0)) / 2
        won += w * best
        total += w
        if at is not None:
            free.remove(at)
    total += sum(sizes[id(many[j])] for j in free)
    return won / total if total else 0.0


def clones(trees: list[Node], threshold: float = 0.8) -> list[dict]:
    """The pairs of trees at least that similar, the most similar first, among those whose fingerprints overlap by half."""
    prints = [fingerprint(t) for t in trees]
    bags = [Counter(p) for p in prints]
    sizes = _sizes(trees)
    out = []
    for i in range(len(trees)):
        for j in range(i + 1, len(trees)):
            if prints[i][0] == prints[j][0] or sum((bags[i] & bags[j]).values()) / min(len(prints[i]), len(prints[j])) > 0.5:
                s = _similar(trees[i], trees[j], sizes)
                if s >= threshold:
                    out.append({"index_a": i, "index_b": j, "similarity": s})
    return sorted(out, key=lambda p: -p["similarity"])


# -- diff


def _entity(n: Node) -> str | None:
    if n.type == "FunctionDef" and n.text("name") is not None:
        return f"fn::{n.text('name')}/{n.int('arity') or 0}"
    if n.type == "Import" and n.text("source") is not None:
        return f"import::{n.text('source')}"
    return None


def _entities(n: Node) -> dict[str, Node]:
    out: dict[str, Node] = {}
    for x in walk(n):
        if (k := _entity(x)) is not None:
            out.setdefault(k, x)
    return out


def _bare(n: Node) -> Any:
    """A node without metadata."""
    return (n.type, n.value) if n.nodes is None else (n.type, [_bare(c) for c in n.nodes])


def diff(old: Node, new: Node) -> dict:
    before, after = _entities(old), _entities(new)
    changes, renamed = [], set()

    def change(kind: str, n: Node, name: str, line: int | None) -> None:
        changes.append({"kind": kind, "node_type": n.type, "name": name, "line": line})

    for k, n in before.items():
        if k in after:
            if after[k].data() != n.data():
                change("Modified", after[k], k, after[k].int("line"))
            continue
        to = None
        if n.type == "FunctionDef":
            to = next((j for j, m in after.items() if j not in before and j not in renamed and m.type == n.type and _bare(m) == _bare(n)), None)
        if to is None:
            change("Removed", n, k, n.int("line"))
        else:
            renamed.add(to)
            change("Renamed", n, f"{k} -> {to}", None)
    for k, n in after.items():
        if k not in before and k not in renamed:
            change("Added", n, k, n.int("line"))
    count = Counter(c["kind"] for c in changes)
    return {"changes": changes, **{k.lower(): count[k] for k in ("Added", "Removed", "Modified", "Renamed")}}


def stale_entities(d: dict) -> list[str]:
    """The names whose stored records are out of date after a diff."""
    return [c["name"].split(" -> ")[0] for c in d["changes"] if c["kind"] in ("Modified", "Removed", "Renamed")]


def removed_entities(d: dict) -> list[str]:
    return [c["name"] for c in d["changes"] if c["kind"] == "Removed"]
