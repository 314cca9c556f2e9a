from __future__ import annotations

import math
import random
import statistics
import time

from helpers import sentence, vocabulary

from tessella.llm import htmlx as hx

DDL = "page_id long, url string, html string"


def page(rng: random.Random, voc: list[str]) -> tuple[str, str]:
    body = [" ".join(sentence(rng, rng.randint(8, 25), voc) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(2, 6))]
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(voc, 6))
    html = f"<!DOCTYPE html><html><head><title>{voc[0]}</title><style>p{{margin:0}}</style><script>var t='<p>no, not. this!</p>';</script></head><body><nav><ul>{nav}</ul></nav><!-- <p>hidden, text.</p> --><article>{''.join(f'<p>{b}<br>' for b in body)}</article><footer>&copy; {voc[1]}</footer></body></html>"
    return html, "\n".join(body)


def spelt(page: str) -> tuple[list[str], list[tuple[str, ...]]]:
    """nodes(), with paths as tuples of tags."""
    texts, at, paths = hx.nodes(page)
    tags = {k: (above, tag) for (above, tag), k in paths.number.items()}

    def path(k: int) -> tuple[str, ...]:
        return path(tags[k][0]) + (tags[k][1],) if k else ()

    return texts, [path(k) for k in at]


def brute(page: str) -> str:
    """Ratios, fusion, smoothing and threshold written out node by node."""
    texts, paths = spelt(page)
    texts = [hx.plain(t) for t in texts]
    if len(set(paths)) < 2:
        return "\n".join(texts)
    fused = {}
    for p in set(paths):
        size = [len(t) for t, q in zip(texts, paths) if q == p]
        marks = [len(hx._PUNCT.findall(t)) for t, q in zip(texts, paths) if q == p]
        fused[p] = math.log1p(statistics.mean(size) * statistics.mean(marks) * ((1 + statistics.pstdev(size)) * (1 + statistics.pstdev(marks))) ** 0.5)
    smooth = {p: [] for p in fused}
    for i, p in enumerate(paths):
        top = low = 0.0
        for j in range(max(0, i - hx.RADIUS), min(len(paths), i + hx.RADIUS + 1)):
            same = 0
            for x, y in zip(p, paths[j]):
                if x != y:
                    break
                same += 1
            long = max(len(p), len(paths[j]))
            w = math.exp(-((i - j) ** 2) / (2 * hx.SIGMA**2)) * ((same / long) ** hx.POWER if long else 1.0)
            top, low = top + w * fused[paths[j]], low + w
        smooth[p].append(top / low)
    value = {p: statistics.mean(v) for p, v in smooth.items()}
    least = min(value.values()) + hx.THRESHOLD * (max(value.values()) - min(value.values()))
    return "\n".join(t for t, p in zip(texts, paths) if value[p] >= least - 1e-9)


def test_against_brute_force():
    rng = random.Random(12)
    voc = vocabulary(rng, "abcdefghijkl", 200)
    for _ in range(30):
        html = page(rng, voc)[0]
        assert hx.content(html) == brute(html)
    tags = ["div", "p", "ul", "li", "b", "section", "td", "tr", "table", "x"]
    for _ in range(150):
        html = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", sentence(rng, rng.randint(1, 6), voc), "<br/>", "<"]) for _ in range(rng.randint(1, 60)))
        assert hx.content(html) == brute(html)


def test_long_pages_take_linear_time():
    for part in ("<div>x, y.", '<a b="', '<a ">"', "</b><p>x", "<ul><li>x", "<p>a<div>b", "<!", "<script", "&#0", "<b/>x", "<!-- ", "</", "<a\n"):
        began = time.process_time()
        hx.content(part * 100_000)
        hx.content(part * 100_000 + "'>")
        assert time.process_time() - began < 20


def test_what_never_closes():
    assert hx.content("&#" + "9" * 6000 + "; a &#0000065; &#x42;") == "\ufffd a A B"
    assert hx.content("a < b and c") == "a < b and c"
    assert spelt('<p class="x>one</p><p>two')[0] == ["one", "two"]
    assert spelt("one<p two")[0] == ["one<p two"] and spelt("one<p><!-- two")[0] == ["one"] and spelt("<script>x<p>y")[0] == []


def test_content_of_generated_pages():
    rng = random.Random(11)
    voc = vocabulary(rng, "abcdefghijkl", 200)
    right = wrong = missed = 0
    for _ in range(60):
        html, body = page(rng, voc)
        got, want = hx.content(html).split(), body.split()
        same = sum((w in set(want)) for w in got)
        right, wrong, missed = right + same, wrong + len(got) - same, missed + max(0, len(want) - len(got))
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.95


def test_paths_follow_html_rules():
    texts, paths = spelt("<div><p>a<p>b<b>c</p>d</div>e</x><li>f<li>g<img src='>'>h")
    assert texts == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert paths == [("div", "p"), ("div", "p"), ("div", "p", "b"), ("div",), (), ("li",), ("li",), ("li",)]


def test_entities_and_hidden_text():
    assert hx.content("plain &amp; simple &lt;b&gt;") == "plain & simple <b>"
    assert hx.content("<p>a, b.</p><script>x</script><style>y</style><!-- z -->") == "a, b."
    assert hx.content("") == "" and hx.content("<p></p>") == "" and hx.content("<") == "<"


def test_awkward_rows(spark):
    deep = "<div>" * 3000 + "deep, text." + "</div>" * 3000
    data = [(1, "u", None), (2, "u", ""), (3, None, "no tags, at all."), (None, "u", "<p>x, y.</p>"), (4, "u", deep), (4, "u", deep), (5, "u", "<p>unclosed <b attr='"), (6, "u", "<!-- never closed <p>x"), (7, "u", "a<p>" * 20_000)]
    df = spark.createDataFrame(data, DDL).withColumnRenamed("url", "text")
    out = hx.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(data) and got[1] is None and got[2] == "" and got[3] == "no tags, at all." and got[4] == "deep, text." and got[6] == ""
    assert hx.extract(spark.createDataFrame([], DDL)).count() == 0
