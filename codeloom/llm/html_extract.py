"""HTML extraction by a site style tree: noise of a site is what its pages share.

The pages of a host are merged into one tree. An element node stands for one place of the layout; its
style nodes are the child sequences (tags with classes) seen there, each with the number of pages;
the children of a style node are element nodes again. Leaves hold content: their features are the
texts (or image sources) seen there. Pages are counted by content: copies, whose trees are equal in
tags, classes and texts, are one page, so no number of them makes an article a template.

Importance, from the leaves up, with m pages through a node and M pages of the site:
  leaf            1 - mean over features of log(pages with the feature) / log(M + ``PSEUDO``)
  style node      mean over its children
  element node    (1 - g^l) * entropy base m of its l styles + g^l * mean of its styles by pages
The logarithm's base at leaves is the site's size, not the node's: a text on three copies of one
page is no template, though it is on all pages that reach that node. The pseudo-pages keep a site of
two equal pages from losing its content.
A node is noisy if it and everything below it stay under ``LEAST``. The topmost noisy nodes are the
branches removed from every page; the text of what stays is returned.

Plan: pages are parsed where they are read into rows of 64-bit node keys, which combine on the map
side, so a template costs one row a task however many pages use it (a first pass moves a hash a page
to find the copies). What only one page has is of importance 1 all the way down, so only places that
two pages or more reach are folded, however deep a single page is. An element's importance is its own
part plus a weighted sum of its children's, so the fold is done by pointer doubling: each round adds
to every node the sums of the nodes twice as far below, and d levels take log2(d) rounds of sums
(no list of pages, no group in one task, so a hot host is no skew). The keys of the noisy branches, a
few for each template, are broadcast as sorted columns; the pages are shuffled only where those
outgrow the broadcast limit.

Parsing is one scan: a '<' that no '>' follows is text; once a quote in a tag is never closed, tags end
at the first '>' from there on; open elements are found by their tag, not by going through them.

Defined results: null html gives null text, empty html an empty text; a null or unparsable url
belongs to the host ''; every row gives a text, repeated ones too; broken markup is repaired as
far as open tags allow, to any depth. Comments, scripts, styles and the head are never text. Extra columns are not
read and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import BROADCAST_BYTES, cut, join_checked, ref

LEAST = 0.75
PSEUDO = 20
DECAY = 0.9
_TOKEN, _LOOSE, _LAST = (
    re.compile(rf"<!--.*?(?:-->|\Z)|{tag}<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
    for tag in (r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|", r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|", "()()()(?!)|")
)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SRC = re.compile(r"(?:^|\s)(?:src|data|value)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SKIP = {"br", "wbr", "hr", "meta", "link", "base", "area", "col", "param", "source", "track"}
#: What may stand in the head; anything else, or text, ends it.
_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "script", "style", "noscript", "template", "noframes"}
_LEAF = {"img", "input", "embed"}
_RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "svg"}
_BLOCK = set("address article aside blockquote div dl dd dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tbody thead tfoot tr td th ul body html".split())
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = _BLOCK - {"p"}


class Node:
    __slots__ = ("tag", "sig", "kids", "text")

    def __init__(self, tag: str, sig: str, text: str = ""):
        self.tag, self.sig, self.text, self.kids = tag, sig, text, []


def parse(source: str) -> Node:
    """The tree of the body: elements, and leaves '#text' and images."""
    root = Node("body", "body")
    stack, at, n, head = [root], 0, len(source), False
    opens: dict[str, list[int]] = {}
    scopes: list[int] = []
    match, last = _TOKEN.match, source.rfind(">")

    def deepest(*tags: str) -> int:
        return max((opens[t][-1] for t in tags if opens.get(t)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            opens[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    while at < n:
        if at > last:
            match = _LAST.match
        m = match(source, at)
        if m.end() == at + 1 and at < last and match == _TOKEN.match and (source[at + 1].isalpha() or source[at + 1] == "/"):
            if loose := _LOOSE.match(source, at):
                m = loose
                if m.end() > at + 1:  # a quote that is never closed
                    match = _LOOSE.match
        at = m.end()
        tag = m.group(2)
        if not tag:
            text = m.group()
            if text[0] != "<" or text == "<":
                if not text.isspace():
                    head = False
                    stack[-1].kids.append(Node("#text", "#text", text))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "head":
                head = False
            elif tag not in ("body", "html") and opens.get(tag):
                close(opens[tag][-1])
            continue
        if tag not in _HEAD and tag not in ("head", "html"):
            head = False
        if tag in _RAW or head and tag == "noframes":
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
            continue
        if tag == "head":
            head = True
            continue
        if tag in ("body", "html"):
            continue
        if tag in _SKIP or head:
            continue
        if tag in _BLOCK and (k := deepest("p")) > (scopes[-1] if scopes else 0):
            close(k)  # a block ends an open paragraph
        if tag in _CLOSED_BY:
            ends, bounds = _CLOSED_BY[tag]
            while (k := deepest(*ends)) > deepest(*bounds):
                close(k)
        c = _CLASS.search(m.group(3)) if m.group(3) else None
        node = Node(tag, f"{tag}.{c.group(1).strip(chr(34) + chr(39))}" if c else tag)
        stack[-1].kids.append(node)
        if tag in _LEAF:
            s = _SRC.search(m.group(3))
            node.text = s.group(1) if s else ""
        elif not m.group(3).endswith("/"):
            opens.setdefault(tag, []).append(len(stack))
            if tag in _SCOPE:
                scopes.append(len(stack))
            stack.append(node)
    return root


def _key(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _walk(root: Node, site: int):
    """(element key, style or feature key, parent's style key or 0, is leaf, node), parents first."""
    todo = [(root, _key(site), 0)]
    while todo:
        node, element, above = todo.pop()
        if not node.kids:
            yield element, _key("f", " ".join(node.text.split())), above, True, node
            continue
        style = _key(element, *(k.sig for k in node.kids))
        yield element, style, above, False, node
        todo.extend((k, _key(style, i), style) for i, k in enumerate(node.kids))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_NODES = "site long, element long, style long, above long, leaf boolean"


def _content(root: Node) -> int:
    """Key of a page's tree: what is the same for pages that differ only in what is never text."""
    parts: list = []
    todo = [root]
    while todo:
        node = todo.pop()
        parts += (node.sig, len(node.kids), " ".join(node.text.split()))
        todo.extend(reversed(node.kids))
    return _key(*parts)


def copies(pages: DataFrame) -> DataFrame:
    """(site, h, n) of the pages of ``pages(site, html, h)`` whose content stands on n > 1 pages of their site."""

    def run(batches):
        for batch in batches:
            site, source, h = batch.columns
            yield pa.RecordBatch.from_arrays([site, pa.array([_content(parse(x.as_py())) for x in source], pa.int64()), h], names=["site", "content", "h"])

    rows = pages.select("site", "html", "h").mapInArrow(run, "site long, content long, h long")
    same = rows.groupBy("site", "content").agg(F.count(F.lit(1)).alias("n"), F.collect_set("h").alias("hs")).filter("n > 1")
    # equal html has equal content, so each h occurs once a site
    return same.select("site", F.explode("hs").alias("h"), "n")


def site_nodes(pages: DataFrame) -> DataFrame:
    """Counted rows of the site style trees of ``pages(site, html)``; c is the number of distinct pages."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for site, source, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for element, style, above, leaf, _ in _walk(parse(source.as_py()), site):
                    for c, x in zip(cols, (site, element, style, above, leaf, 1 / n), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["site", "element", "style", "above", "leaf", "w"])

    pages = pages.filter(F.col("html").isNotNull()).select("site", "html", F.xxhash64("html").alias("h"))
    counted = join_checked(pages, cut(copies(pages)), ["site", "h"], "left", BROADCAST_BYTES).select("site", "html", F.coalesce("n", F.lit(1)).alias("n"))
    rows = counted.mapInArrow(run, f"{_NODES}, w double")
    # the n copies of a page weigh 1/n each; their sum is a whole number but for the last digits
    return rows.groupBy("site", "element", "style", "above", "leaf").agg(F.round(F.sum("w")).cast("long").alias("c"))


def shared_tree(nodes: DataFrame, decay: float = DECAY) -> DataFrame:
    """(site, element, leaf, up, w, v) of the places that two pages or more reach.

    ``v`` is a place's own part of its importance, that of children on one page only included; ``w`` is
    its weight in its parent ``up``, an inner element. A place with one page has importance 1.
    """
    styles = cut(nodes.filter("c > 1 and not leaf").select(F.col("style").alias("above"), F.col("element").alias("up"), F.col("c").alias("sc")))
    roots = nodes.filter("above = 0").withColumn("up", F.lit(None).cast("long")).withColumn("sc", F.lit(None).cast("long"))
    met = join_checked(nodes, styles, "above", "inner").unionByName(roots)
    log = F.log(F.col("c").cast("double"))
    sums = (F.sum("c").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(log).alias("a"), F.sum(F.col("c") * log).alias("b"), F.sum((F.col("c") == 1).cast("long")).alias("ones"))
    places = cut(met.groupBy("site", "element", "above", "leaf", "up", "sc").agg(*sums))
    m, ln = F.col("m").cast("double"), F.log(F.col("m").cast("double"))
    g = F.pow(F.lit(decay), F.col("l"))
    shape = F.when(F.col("m") > 1, (ln - F.col("b") / m) / ln).otherwise(1.0)
    sites = places.filter("above = 0").groupBy("site").agg(F.sum("m").alias("pages"))
    # a place that is a leaf on some pages and not on others is two nodes, by the leaf column
    kids = places.filter("above <> 0").groupBy("above").agg(F.count(F.lit(1)).alias("kids"))
    inner = places.filter("not leaf").select(F.col("element").alias("up"), g.alias("pg"), F.col("m").alias("pm"))
    content = 1 - F.col("a") / F.col("l") / F.log((F.col("pages") + PSEUDO).cast("double"))
    own = F.when(F.col("leaf"), content).otherwise((1 - g) * shape + g * F.col("ones") / m)
    placed = places.join(sites, "site").join(kids, "above", "left").join(inner, "up", "left")
    placed = cut(placed.select("site", "element", "leaf", "up", "m", (F.col("pg") * F.col("sc") / F.col("pm") / F.col("kids")).alias("w"), own.alias("v")))
    lone = placed.filter("m = 1 and up is not null").groupBy(F.col("up").alias("element")).agg(F.sum("w").alias("more")).withColumn("leaf", F.lit(False))
    return cut(placed.filter("m > 1").join(lone, ["element", "leaf"], "left").select("site", "element", "leaf", "up", "w", (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v")))


def importance(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(element, leaf, v) with the importance v of every place, and for k = 0, 1, ... (element, leaf, up) with its ancestor 2^k levels above."""
    jumps, now = [], tree.select("element", "leaf", "up", "w", "v")
    while not now.filter("up is not null").isEmpty():
        jumps.append(now.select("element", "leaf", "up").filter("up is not null"))
        more = now.filter("up is not null").groupBy(F.col("up").alias("element")).agg(F.sum(F.col("w") * F.col("v")).alias("more")).withColumn("leaf", F.lit(False))
        above = now.filter("not leaf and up is not null").select(F.col("element").alias("up"), F.col("up").alias("up2"), F.col("w").alias("w2"))
        far = now.join(above, "up", "left").join(more, ["element", "leaf"], "left")
        now = cut(far.select("element", "leaf", F.col("up2").alias("up"), (F.col("w") * F.col("w2")).alias("w"), (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v")))
    return now.select("element", "leaf", F.round("v", 9).alias("v")), jumps


def noisy_branches(pages: DataFrame, least: float = LEAST, decay: float = DECAY) -> DataFrame:
    """(site, element, leaf) of the topmost noisy nodes."""
    tree = shared_tree(cut(site_nodes(pages)), decay)
    comp, jumps = importance(tree)
    kept = comp.filter(F.col("v") >= least).select("element", "leaf")
    for jump in jumps:  # what is above a place that is kept is kept
        kept = cut(kept.unionByName(kept.join(jump, ["element", "leaf"]).select(F.col("up").alias("element"), F.lit(False).alias("leaf"))).distinct())
    noisy = cut(tree.join(kept, ["element", "leaf"], "left_anti").select("site", "element", "leaf", "up"))
    return noisy.join(noisy.filter("not leaf").select(F.col("element").alias("up")), "up", "left_anti").select("site", "element", "leaf")


def page_text(source: str, site: int, noise: set) -> str:
    """Text of a page without the branches in ``noise`` (pairs of element key and is-leaf)."""
    out: list[str] = []

    def add(node: Node, element: int) -> None:
        todo = [(node, element, False)]
        while todo:
            node, element, closing = todo.pop()
            if closing:
                out.append("\n")
                continue
            if (element, not node.kids) in noise:
                continue
            if node.tag in _BLOCK:
                out.append("\n")
                todo.append((node, 0, True))
            if not node.kids:
                if node.tag == "#text":
                    out.append(node.text)
                continue
            style = _key(element, *(k.sig for k in node.kids))
            todo.extend((k, _key(style, i), False) for i, k in reversed(list(enumerate(node.kids))))

    add(parse(source), _key(site))
    lines = (" ".join(x.split()) for x in _html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, least: float = LEAST, decay: float = DECAY, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, text) of every page."""
    kind = pages.schema[key].dataType
    narrow = pages.select(ref(key).alias("k"), F.xxhash64(host(ref(url))).alias("site"), ref(html).alias("html"))
    noise = cut(noisy_branches(narrow, least, decay))
    out = T.StructType([T.StructField("k", kind), T.StructField("text", T.StringType())])
    texts = lambda sources, sites, of: pa.array([None if (s := x.as_py()) is None else page_text(s, site, of(i, site)) for i, (x, site) in enumerate(zip(sources, sites.to_pylist(), strict=True))], pa.string())
    if noise.count() * 17 <= BROADCAST_BYTES:
        found = noise.toArrow().sort_by("site")
        sent = pages.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("site", "element", "leaf")))

        def run(batches):
            at, elements, leaves = sent.value
            seen: dict[int, set] = {}

            def of(_, site):
                if site not in seen:
                    if len(seen) > 256:
                        seen.clear()
                    a, b = np.searchsorted(at, site), np.searchsorted(at, site, side="right")
                    seen[site] = set(zip(elements[a:b].tolist(), leaves[a:b].tolist(), strict=True))
                return seen[site]

            for batch in batches:
                k, sites, sources = batch.columns
                yield pa.RecordBatch.from_arrays([k, texts(sources, sites, of)], names=["k", "text"])

        return narrow.select("k", "site", "html").mapInArrow(run, out).withColumnRenamed("k", key)
    by_site = noise.groupBy("site").agg(F.collect_list(F.when(~F.col("leaf"), F.col("element"))).alias("inner"), F.collect_list(F.when(F.col("leaf"), F.col("element"))).alias("leaves"))
    joined = narrow.join(by_site.hint("merge"), "site", "left").select("k", "site", "html", "inner", "leaves")

    def run_joined(batches):
        for batch in batches:
            k, sites, sources, inner, leaves = batch.columns
            of = lambda i, _: {(e, False) for e in inner[i].as_py() or ()} | {(e, True) for e in leaves[i].as_py() or ()}  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([k, texts(sources, sites, of)], names=["k", "text"])

    return joined.mapInArrow(run_joined, out).withColumnRenamed("k", key)
