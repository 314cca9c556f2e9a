"""Ranked full-text search (BM25) over an inverted index.

The index has a row for each occurrence of a term: (term, _id, dl, pos), sorted by term in every file, so that a search reads the
row groups of its own terms alone. It takes one shuffle,
by term and a salt, so a frequent term is spread over tasks. A search gathers its terms' rows by document and keeps the top rows.

Query strings hold terms (any of them matches), ``+must`` and ``-mustn't`` terms, "phrases", (groups), and ``AND``, ``OR``, ``NOT``
between them: NOT binds tightest, then AND, then OR. ``^2`` behind a term, phrase or group boosts it. A phrase weighs as much as
its words' rarities together. What excludes alone finds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import QueryError
from tessella.functions import codetokens, stemming
from tessella.sources.snapshots import written

K1, B = 1.2, 0.75
SALT = 16  # the tasks that share a term
LANGUAGES = {"english": "en", "spanish": "es", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt", "russian": "ru"}
_WORDS = r"[^\p{L}\p{N}]+"


def analyzer(name: str) -> str:
    n = name.lower()
    n = {v: k for k, v in LANGUAGES.items()}.get(n, n)
    if n not in ("default", "simple", "code", *LANGUAGES):
        raise QueryError(f"unknown analyzer: {name}")
    return n


def tokens(text: Column, name: str = "default") -> Column:
    """The array of a text's tokens."""
    name = analyzer(name)
    if name == "simple":
        return F.filter(F.split(text, r"\s+"), lambda x: x != "")
    if name == "code":
        return codetokens.code_tokens(text)
    words = F.filter(F.split(F.lower(text), _WORDS), lambda x: x != "")
    return words if name == "default" else stemming.stemmed(words, LANGUAGES[name])


def tokens_of(text: str, name: str = "default") -> list[str]:
    """tokens() of a text on the driver."""
    import regex

    name = analyzer(name)
    if name == "simple":
        return text.split()
    if name == "code":
        return codetokens.tokenize(text)
    words = [w for w in regex.split(_WORDS, text.lower()) if w]
    return words if name == "default" else [stemming.stem(w, LANGUAGES[name]) for w in words]


@dataclass(frozen=True)
class Leaf:
    terms: tuple[str, ...]  # more than one: a phrase
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    parts: tuple[tuple[str, Leaf | Group], ...]  # "should", "must" or "not", and what
    boost: float = 1.0


_LEXEME = re.compile(r'\s*(?:(?P<sign>[+-])(?=[^\s)])|(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|\^(?P<boost>\d+(?:\.\d+)?)|(?P<word>[^\s()"^]+)|(?P<bad>\S))')


def parse_query(query: str, name: str = "default") -> Group:
    found = [(m.lastgroup, m.group(m.lastgroup)) for m in _LEXEME.finditer(query) if m.lastgroup]
    at = 0

    def peek() -> tuple[str, str]:
        return found[at] if at < len(found) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return found[at - 1]

    def either() -> Group:
        """What stands side by side or between ORs."""
        parts: list[tuple[str, Leaf | Group]] = []
        while peek()[0] not in ("end", "close"):
            if peek() == ("word", "OR"):
                take()
                continue
            both = [one()]
            while peek() == ("word", "AND"):
                take()
                if peek()[0] in ("end", "close"):
                    raise QueryError("a search ends with AND")
                both.append(one())
            both = [(need, x) for need, x in both if x is not None]
            if len(both) > 1:
                parts.append(("should", Group(tuple(("not" if need == "not" else "must", x) for need, x in both))))
            else:
                parts += both
        return Group(tuple(parts))

    def one() -> tuple[str, Leaf | Group | None]:
        need = "should"
        while True:
            if peek() == ("word", "NOT"):
                take()
                need = "should" if need == "not" else "not"
            elif peek()[0] == "sign":
                need = "must" if take()[1] == "+" else "not"
            else:
                break
        kind, value = take() if peek()[0] != "end" else ("end", "")
        out: Leaf | Group | None
        if kind == "open":
            out = either()
            if peek()[0] != "close":
                raise QueryError("a search has an open parenthesis")
            take()
            if not out.parts:
                out = None
        elif kind in ("word", "phrase"):
            got = tuple(tokens_of(value, name))
            out = Leaf(got) if got else None
        else:
            raise QueryError(f"a search has {value!r} where a term is due" if value else "a search ends where a term is due")
        if peek()[0] == "boost":
            by = float(take()[1])
            out = out and replace(out, boost=by)
        return need, out

    out = either()
    if at < len(found):
        raise QueryError("a search has a parenthesis that closes nothing")
    return out


def _leaves(node: Leaf | Group) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for _, part in node.parts for x in _leaves(part)]


def index(docs: DataFrame, field: str, name: str = "default") -> DataFrame:
    """(_id, tokens) of the documents whose field is a text."""
    kind = docs.schema[field].dataType.simpleString() if field in docs.columns else None
    if kind == "string":
        rows = docs.where(F.col(f"`{field}`").isNotNull()).select("_id", F.col(f"`{field}`").alias("_text"))
    elif "fields" in docs.columns:
        v = F.try_element_at(F.col("fields"), F.lit(field))
        rows = docs.where(v["t"] == "string").select("_id", v["s"].alias("_text"))
    else:
        rows = docs.where(F.lit(False)).select("_id", F.lit("").alias("_text"))
    return rows.select("_id", tokens(F.col("_text"), name).alias("tokens"))


@dataclass(frozen=True)
class Postings:
    rows: DataFrame  # term, _id, dl, pos
    documents: int
    words: int


def postings(idx: DataFrame) -> Postings:
    """The inverted index of (_id, tokens), written."""
    each = idx.select("_id", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term")).select("term", "_id", "dl", "pos")
    parts = int(idx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(each.repartition(parts, "term", F.pmod(F.xxhash64("_id"), F.lit(SALT))).sortWithinPartitions("term", "_id"), "postings")
    return Postings(table, idx.select("_id").count(), table.count())


def search(idx: DataFrame | Postings, query: str, limit: int, name: str = "default") -> DataFrame:
    """(_id, score) of the best documents of an index, the highest score first, then by id."""
    tree = parse_query(query, name)
    leaves = _leaves(tree)
    if isinstance(idx, DataFrame):
        idx = postings(idx)
    terms = {t: f"t{i}" for i, t in enumerate(sorted({t for x in leaves for t in x.terms}))}
    inside = {t for x in leaves if len(x.terms) > 1 for t in x.terms}
    if not terms or not idx.words:
        return idx.rows.where(F.lit(False)).select("_id", F.lit(0.0).alias("score"))
    here = {t: F.col("term") == t for t in terms}
    counts = [F.count_if(here[t]).alias(c) for t, c in terms.items()]
    places = [F.collect_list(F.when(here[t], F.col("pos"))).alias(terms[t] + "p") for t in sorted(inside)]
    docs = idx.rows.where(F.col("term").isin(list(terms))).groupBy("_id").agg(F.first("dl").alias("dl"), *counts, *places)
    corpus = docs.agg(*[F.count_if(F.col(c) > 0).alias(c + "n") for c in terms.values()])  # one row
    rarity = {t: F.log1p((idx.documents - F.col(c + "n") + 0.5) / (F.col(c + "n") + 0.5)) for t, c in terms.items()}

    def judge(node: Leaf | Group) -> tuple[Column, Column]:
        """Whether it matches, and its score where it does."""
        if isinstance(node, Leaf):
            at = [F.col(terms[t] + "p") for t in node.terms] if len(node.terms) > 1 else []
            tf = F.size(F.filter(at[0], lambda p: reduce(and_, [F.array_contains(x, (p + k).cast("int")) for k, x in enumerate(at) if k]))) if at else F.col(terms[node.terms[0]])
            idf = reduce(add, [rarity[t] for t in node.terms])
            return tf > 0, node.boost * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(idx.words / idx.documents)))
        got = [(need, *judge(x)) for need, x in node.parts]
        must, should, never = ([m for need, m, _ in got if need == k] for k in ("must", "should", "not"))
        hit = reduce(and_, must) if must else reduce(or_, should) if should else F.lit(False)
        hit = reduce(lambda a, m: a & ~m, never, hit)
        return hit, node.boost * reduce(add, [F.when(m, s).otherwise(0.0) for need, m, s in got if need != "not"], F.lit(0.0))

    hit, score = judge(tree)
    return docs.crossJoin(F.broadcast(corpus)).where(hit).select("_id", score.alias("score")).orderBy(F.col("score").desc(), "_id").limit(limit)
