import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import html_extract as H


def _texts(node):
    return [k.text for k in _all(node) if k.tag == "#text"]


def _all(node):
    yield node
    for k in node.kids:
        yield from _all(k)


def test_parse_repairs_markup():
    t = H.parse('<html><head><title>T</title><style>p{}</style></head><body><ul><li>a<li>b</ul><p><b>one<br>two<p>three</b></p><!-- c --><script>var t="</p>";</script><div class="x">four</div></body></html>')
    assert _texts(t) == ["a", "b", "one", "two", "three", "four"]
    assert [k.sig for k in t.kids] == ["ul", "p", "p", "div.x"]
    assert _texts(H.parse("no tags & <3")) == ["no tags & ", "<", "3"]
    for odd in ("", "<", "<p", "<p class='x", "<!-- open", "<script>x", "</p></p>", "<a href=\"x>y\">z"):
        H.parse(odd)
    deep = H.parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert len(list(H._walk(deep, 1))) == 5002


PAGE = "<html><body><nav><a>Home</a><a>News</a></nav><article><h1>{t}</h1>{ps}</article><footer>All rights reserved</footer></body></html>"


def _pages(n):
    return [(i, f"http://h{i % 2}.example/{i}", PAGE.format(t=f"Title {i}", ps="".join(f"<p>Unique text {i} {j}.</p>" for j in range(1 + i % 4))), "x", 1) for i in range(n)]


SCHEMA = "page_id long, url string, html string, site string, k int"


def brute(rows):
    """The site style tree by recursion, host by host."""
    out = {}
    for h in {r[1].split("/")[2] for r in rows}:
        own = [r for r in rows if r[1].split("/")[2] == h]
        noise = set()

        def grow(nodes, pages, path):
            # nodes: the same place on several pages; returns (importance, largest below) by is-leaf
            res = {}
            for leaf in (True, False):
                group = [x for x in nodes if (not x.kids) == leaf]
                if not group:
                    continue
                m = len(group)
                if leaf:
                    c = Counter(" ".join(x.text.split()) for x in group)
                    comp = 1 - sum(math.log(v) for v in c.values()) / len(c) / math.log(pages + H.PSEUDO)
                    most, inner = comp, []
                else:
                    styles = defaultdict(list)
                    for x in group:
                        styles[tuple(k.sig for k in x.kids)].append(x)
                    l = len(styles)  # noqa: E741
                    shape = 1.0 if m == 1 else -sum(len(s) / m * math.log(len(s) / m) for s in styles.values()) / math.log(m)
                    mean, most, inner = 0.0, 0.0, []
                    for sig, s in styles.items():
                        kids = []
                        for i in range(len(sig)):
                            kids += list(grow([x.kids[i] for x in s], pages, (*path, sig, i)).values())
                        mean += len(s) / m * sum(a for a, _ in kids) / len(kids)
                        most = max([most, *(b for _, b in kids)])
                    g = H.DECAY**l
                    comp = (1 - g) * shape + g * mean
                    most = max(comp, most)
                if most < H.LEAST:
                    noise.add((path, leaf))
                res[leaf] = (comp, most)
            return res

        grow([H.parse(r[2]) for r in own], len(own), ())

        def text(node, path):
            if (path, not node.kids) in noise:
                return []
            if not node.kids:
                return [" ".join(node.text.split())] if node.tag == "#text" else []
            sig = tuple(k.sig for k in node.kids)
            return [t for i, k in enumerate(node.kids) for t in text(k, (*path, sig, i))]

        out |= {r[0]: text(H.parse(r[2]), ()) for r in own}
    return out


@pytest.mark.parametrize("n", [3, 60])
def test_against_brute_force(spark, n):
    rows = _pages(n)
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert {i: [x for x in t.split("\n") if x] for i, t in got.items()} == {i: _joined(t) for i, t in want.items()}
    if n == 60:
        assert all("Home" not in t and "rights" not in t and f"Title {i}" in t and f"Unique text {i} 0." in t for i, t in got.items())


def _joined(texts):
    out = []
    for t in texts:  # links of one line stand together
        if out and out[-1] == "Home" and t == "News":
            out[-1] = "HomeNews"
        else:
            out.append(t)
    return out


def test_edges(spark):
    rows = [(1, None, "<p>a</p>", "x", 1), (2, "nonsense", "<p>b</p>", "x", 1), (3, "http://a.example/", None, "x", 1), (4, "http://a.example/", "", "x", 1), (None, "http://a.example/x", "<p>c &amp; d</p>", "x", 1), (5, "http://b.example/", "<p>" + "long " * 200_000 + "</p>", "x", 1), (6, "http://a.example/1", "<p>twin</p>", "x", 1), (6, "http://a.example/1", "<p>twin</p>", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.extract_text(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 8 and by[1] == "a" and by[2] == "b" and by[3] is None and by[4] == "" and by[None] == "c & d" and len(by[5]) > 900_000 and by[6] == "twin"
    assert H.extract_text(df.limit(0)).count() == 0
    assert H.extract_text(df.filter("html is null")).count() == 1


def test_shuffled_noise_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(_pages(60), SCHEMA)
    a = {r.page_id: r.text for r in H.extract_text(df).collect()}
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert {r.page_id: r.text for r in H.extract_text(df).collect()} == a




def test_hosts(spark):
    urls = ["http://A.example:80/x", "https://u:p@b.example/?q", "ftp://c.example#f", "nothing", None, ""]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(H.host(F.col("u")).alias("h")).collect()]
    assert got == ["a.example", "b.example", "c.example", "", "", ""]


@pytest.mark.parametrize("n", [4, 60, 320])
def test_copies_are_no_template(spark, n):
    page = "<html><head><link rel='canonical' href='{u}'></head><body><nav><a>Home</a><a>News</a></nav><article>{b}</article><footer>All rights reserved</footer></body></html>"
    rows = [(i, f"http://h{c}.example/{i}", page.format(u=i, b=f"<h1>Title {i}</h1><p>Unique {i}.</p>"), "x", 1) for c in (3, 9, 100) for i in range(n)]
    rows += [(1000 + k, f"http://h{c}.example/copy{k}", page.format(u=f"copy{k}", b="<h1>Copied</h1><p>one</p><ul><li>two</li></ul><p>three</p>"), "x", 1) for c in (3, 9, 100) for k in range(c)]
    got = [(r.page_id, r.text) for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    for i, t in got:
        assert (t.split("\n")[-4:] if n > 4 else [x for x in t.split("\n") if x in ("Copied", "one", "two", "three")]) == ["Copied", "one", "two", "three"] if i >= 1000 else f"Unique {i}." in t
        assert n == 4 or "Home" not in t and "rights" not in t


def test_head_without_end_tag(spark):
    for source, want in {
        "<html><head><title>T</title><p>text<p>more": ["text", "more"],
        "<head><meta charset=x><link rel=y><script>s</script>bare <b>text</b>": ["bare ", "text"],
        "<head><style>p{}</style><!-- c -->\n<div>in</div></head><body><p>body</p>": ["in", "body"],
        "<head><title>T</title></head><body>x": ["x"],
        "<head><noframes>no</noframes><title>T</title></head><body>x": ["x"],
        "<head><title>T</title><noscript><img></noscript>\n</head>\n<body><p>x": ["x"],
    }.items():
        assert _texts(H.parse(source)) == want
    got = H.extract_text(spark.createDataFrame([(1, "http://a.example/", "<html><head><title>T</title><p>text<p>more", "x", 1)], SCHEMA)).first()
    assert got.text == "text\nmore"


@pytest.mark.parametrize("unit", ["<b>", "<a x=", "<a x='", '<a "', "<p><b>", "</i>", "<b></i>", "<b><p></p>", "<", "<!", "<li>", "<td>", "<b '>", "<a x='y'>\"", "<script>", "<div><b>", "x", "<tr><td>"])
def test_parse_is_linear(unit):
    """Broken markup of a megabyte is parsed in time in proportion to its length."""
    import time

    def took(n):
        source = "<b>" * (n // 50) + unit * (n // len(unit))
        began = time.process_time()
        H._content(H.parse(source))
        return time.process_time() - began

    took(1000)
    small, large = took(50_000), took(1_000_000)
    assert large < 0.5 + 60 * small and large < 20


def test_parse_of_broken_tags():
    assert _texts(H.parse("<p>a<a x=")) == ["a", "<", "a x="]
    assert _texts(H.parse("<p>a<a href='x>b<b>c</b>'")) == ["a", "b", "c", "'"]  # the quote is closed, no '>' follows: tags end at the first
    assert _texts(H.parse("<p class=\"x>a</p><p>b 'c' <i title='>'>d")) == ["a", "b 'c' ", "'>d"]
    assert [k.sig for k in H.parse("<table><tr><td>a<td>b<tr><td>c</table>").kids[0].kids] == ["tr", "tr"]
    assert _texts(H.parse("</b><b>x</i></b>y")) == ["x", "y"]


def test_a_deep_page_among_others(spark, monkeypatch):
    """Rounds follow the logarithm of the depth that pages share; the result is brute force's."""
    import sys

    sys.setrecursionlimit(100_000)
    deep = "<html><body>" + "<b>" * 5000 + "deep text" + "<i>x" * 20
    rows = [*_pages(20), (100, "http://h0.example/d", deep, "x", 1)]
    rounds = []
    whole = H.importance
    monkeypatch.setattr(H, "importance", lambda tree: (lambda r: rounds.append(len(r[1])) or r)(whole(tree)))
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert {i: [x for x in t.split("\n") if x] for i, t in got.items() if i < 100} == {i: _joined(t) for i, t in want.items() if i < 100}
    assert got[100] == "deep text" + "x" * 20 and rounds[0] <= 3
    shared = [(i, "http://s.example/", "<html><body>" + "<div><b>Menu</b>" * 60 + f"<p>Only {i}.</p>", "x", 1) for i in range(30)]
    rounds.clear()
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(shared, SCHEMA)).collect()}
    assert {i: [x for x in t.split("\n") if x] for i, t in got.items()} == brute(shared) and rounds[0] <= 7
    assert all(t == f"Only {i}." for i, t in got.items())
