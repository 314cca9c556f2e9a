"""Main-content extraction from HTML by tag-path ratios.

Every text node has a path, the open tags from the root to it. For each path of a page,
    text ratio   = characters of its nodes / number of its nodes
    punct ratio  = punctuation marks of its nodes / number of its nodes
and the two are fused with the spread of both over the path's nodes: text ratio x punct ratio x (1 + deviation of the
lengths) ** 0.5 x (1 + deviation of the marks) ** 0.5, on a log scale. Over the nodes in page order these are smoothed
with a Gaussian of RADIUS nodes, weighted by how much of their paths two nodes share; a path's value is the mean of its
nodes' smoothed ones. Paths that reach THRESHOLD of the way from the page's lowest to its highest value are content. The
texts of their nodes, in page order, are the result.

Comments, declarations, scripts, styles and the like hold no text. Tags close what HTML lets them close (a new
paragraph ends the one that is open, an end tag ends what it left open inside); an end tag without a start is ignored.
What opens and never closes again: a comment, a script and the like, up to the end of the page; a tag, which is text; a
quoted attribute, after which quotes have no meaning in that page. Time and memory are linear in the page, however deep it
is nested: paths are numbers of (path above, tag).

Defined results: a null page is null, one without text is empty; text without any tag is all content (its path is
the root), as are all paths of a page where they tie; a very long page is treated whole; repeated pages are each extracted;
a null page_id stays null; extra columns, of whatever name, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

RADIUS = 2
SIGMA = 1.0
THRESHOLD = 0.6
POWER = 4
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_NEXT = re.compile(r"[>\"']")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "title")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_PUNCT = re.compile(r"[.,;:!?。，？！…¿¡]")
_WHITE = re.compile(r"\s+")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def plain(text: str) -> str:
    """text with its character references resolved and its white space single."""
    if "&" in text:
        text = entities.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)))
    return _WHITE.sub(" ", text)


def tokens(page: str) -> Iterator[tuple[str | None, str]]:
    """(None, text) and (tag, "open", "close" or "void") in page order; in linear time."""
    at = start = 0
    last, quoted = page.rfind(">"), True
    while True:
        i = page.find("<", at)
        if i < 0:
            break
        mark, name = page[i + 1 : i + 2], None
        if page.startswith("<!--", i):
            k = page.find("-->", i + 4)
            end = len(page) if k < 0 else k + 3
        elif page.startswith("<![CDATA[", i):
            k = page.find("]]>", i)
            end = len(page) if k < 0 else k + 3
        elif i > last:  # no tag ends any more
            break
        elif mark in ("!", "?"):
            end = page.index(">", i) + 1
        elif name := _NAME.match(page, i + 1):
            end = name.end()
            while quoted:
                m = _NEXT.search(page, end)
                if m is None:
                    end = len(page)
                    break
                end = m.end()
                if m.group() == ">":
                    break
                k = page.find(m.group(), end)
                if k < 0:
                    quoted = False
                end = k + 1
            if not quoted:
                end = page.index(">", i) + 1
            elif page[end - 1] != ">":  # it ends within what seemed to be quoted
                quoted, end = False, page.index(">", i) + 1
        else:
            at = i + 1
            continue
        if i > start:
            yield None, page[start:i]
        if name:
            tag = name.group().lower()
            if tag[0] == "/":
                yield tag[1:], "close"
            elif tag in _RAW:
                m = _RAW[tag].search(page, end)
                end = m.end() if m else len(page)
            else:
                yield tag, "void" if tag in _VOID or page[end - 2] == "/" else "open"
        at = start = end
    if start < len(page):
        yield None, page[start:]


class Paths:
    """Paths by number: the one above, the depth. 0 is the root."""

    def __init__(self):
        self.above, self.depth, self.number = [0], [0], {}

    def below(self, path: int, tag: str) -> int:
        k = self.number.get((path, tag))
        if k is None:
            k = self.number[path, tag] = len(self.above)
            self.above.append(path)
            self.depth.append(self.depth[path] + 1)
        return k

    def shared(self, a: int, b: int) -> float:
        """The share of the longer path that both have, to the power of POWER."""
        long = max(self.depth[a], self.depth[b])
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.above[a]
            else:
                b = self.above[b]
        return (self.depth[a] / long) ** POWER if long else 1.0


def nodes(page: str) -> tuple[list[str], list[int], Paths]:
    """The text nodes of a page, without surrounding white space, and their paths."""
    texts, at, paths = [], [], Paths()
    stack, path, where = [], [0], {}  # open tags, the path down to each, the places of each tag in the stack
    blocks = []

    def cut(k: int) -> None:
        while len(stack) > k:
            t = stack.pop()
            path.pop()
            where[t].pop()
            if t in _BLOCK:
                blocks.pop()

    for tag, what in tokens(page):
        if tag is None:
            text = what.strip()
            if text:
                texts.append(text)
                at.append(path[-1])
            continue
        own = where.setdefault(tag, [])
        if what == "close":
            if own:
                cut(own[-1])
            continue
        if tag in _BLOCK and where.get("p"):
            if blocks[-1] == where["p"][-1]:  # no block since that paragraph
                cut(blocks[-1])
        elif tag in _SAME and own:
            if not any(where.get(t) and where[t][-1] > own[-1] for t in _SAME[tag]):
                cut(own[-1])
        if what == "open":
            own.append(len(stack))
            if tag in _BLOCK:
                blocks.append(len(stack))
            path.append(paths.below(path[-1], tag))
            stack.append(tag)
    return texts, at, paths


def content(page: str) -> str:
    texts, at, paths = nodes(page)
    if not texts:
        return ""
    texts = [plain(t) for t in texts]
    own, at = np.unique(np.array(at), return_inverse=True)
    size = np.array([len(t) for t in texts], float)
    marks = np.array([len(_PUNCT.findall(t)) for t in texts], float)
    n = np.bincount(at)
    mean = lambda x: np.bincount(at, x) / n
    text, punct = mean(size), mean(marks)
    spread = lambda x, m: np.sqrt(np.maximum(mean(x * x) - m * m, 0))
    fused = np.log1p(text * punct * np.sqrt((1 + spread(size, text)) * (1 + spread(marks, punct))))
    if len(own) == 1:
        return "\n".join(texts)
    value, weight, alike = np.zeros(len(texts)), np.zeros(len(texts)), {}
    ids, raw = own[at].tolist(), fused[at]

    def shared(a: int, b: int) -> float:
        if (w := alike.get((a, b))) is None:
            w = alike[a, b] = paths.shared(a, b)
        return w

    for d in range(RADIUS + 1):
        if d >= len(ids):
            break
        w = np.exp(-d * d / (2 * SIGMA**2)) * np.array([shared(a, b) for a, b in zip(ids, ids[d:])])
        value[d:] += w * raw[: len(ids) - d]
        weight[d:] += w
        if d:
            value[: len(ids) - d] += w * raw[d:]
            weight[: len(ids) - d] += w
    value = mean(value / weight)
    keep = (value >= value.min() + THRESHOLD * (value.max() - value.min()) - 1e-12)[at]
    return "\n".join(t for t, k in zip(texts, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id and the content of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tv.pieces(batch, "html"):
                yield tv.batch_of(schema, piece.column(0), [None if x is None else content(x) for x in piece.column(1).to_pylist()])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(part, "page_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
