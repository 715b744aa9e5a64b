"""Main text of web pages by wrapper induction.

Pages of one host are made by one program. Each page becomes a small tree of its block elements, in which runs of
paragraphs, items or cells are one node; the trees of a host are aligned by simple tree matching and merged into its wrapper, which knows
for each node on how many pages it stands and whether its text is ever another one. Constant nodes are template, the
varying part that holds the article is content.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import pieces, unused, written

# Elements of HTML by what they mean here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("audio button canvas datalist embed footer form head iframe input label map menu nav noscript object script select style svg template textarea title video aside dialog".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table ul dd dt tr td th tbody thead tfoot".split())
CONTAINERS = frozenset("html body div section main center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote".split())
RUNS = frozenset("p li tr td th dt dd option hr".split())  # successive ones are one node; others are told apart by their place
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
# Words of classes, ids and roles that mark what is no article
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies dialog disqus footer gdpr masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices pager pagination popup promo promotion related respond search share sharing sidebar social sponsor sponsored subscribe toolbar".split()
)
KNOWN = VOID | INLINE | NO_TEXT | CLOSES_P | CONTAINERS | SCOPES | frozenset("a caption colgroup legend picture slot svg math optgroup option".split())
HEADERS = frozenset(("header", "siteheader", "pageheader"))

PLAIN, OUT, ARTICLE, MAIN = range(4)
DEEP, WIDE = 40, 24  # what lies deeper counts as text of its ancestor; more runs under a node are joined by signature
LEAST = 8  # pages, at least, on which a text must be the same to be template within the article
SHARE = 0.9  # and of the host's pages
FAN = 32  # wrappers merged by one task
BROADCAST = 32 << 20  # bytes of all wrappers up to which they are sent to the pages
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# A start tag whose values hold no angle brackets, and its attributes; nothing is tried twice, so broken tags cost no more
TAG = re.compile(r"""<([A-Za-z][^\s/<>]*+)((?:[\s/]++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'=<>`]++))?+)*+)[\s/]*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?+""")
NAME = re.compile(r"[A-Za-z][^\s/>]*+")
GAP, PART, BARE = re.compile(r"[\s/]*+"), re.compile(r"[^\s/>=][^\s/>=]*+"), re.compile(r"[^\s>]*+")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed")}


def inline(tag: str) -> bool:
    """Whether an element stands within a line; unknown ones do."""
    return tag in INLINE or tag not in KNOWN


class Page:
    """A page as collapsed nodes and the blocks of text in them.

    nodes: [signature, kind, children's numbers] each, the root first; blocks: (node, text, characters within links)
    in page order. Text of what is no article (NO_TEXT, MARKS, hidden elements) is left out.
    """

    def __init__(self, html: str) -> None:
        self.nodes: list[list] = [["", PLAIN, []]]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack = [("", 0, False)]  # tag, node, whether its text is left out
        self.open: dict[str, int] = {}  # elements of each tag on the stack
        self.cursors = [-1]  # of each open element: the place of its latest child among the node's children
        self.text: list[str] = []
        self.linked = self.links = 0
        self.read(html)
        self.flush()

    def read(self, html: str) -> None:
        """Goes through the tags and the text between, once, however broken they are. What has no end (a comment, a tag, a
        script) takes the rest of the page, as browsers have it; a title without one is left open."""
        at, n = 0, len(html)
        while at < n:
            to = html.find("<", at)
            if to < 0:
                self.data(html[at:])
                return
            if to > at:
                self.data(html[at:to])
            mark = html[to + 1 : to + 2]
            if mark.isascii() and mark.isalpha():
                tag, given, at = self.start(html, to)
                if at < 0:
                    return
                self.handle_starttag(tag, given)
                if tag in RAW:
                    end = RAW[tag].search(html, at)
                    if end is None and tag != "title":
                        return
                    at = at if end is None else end.start()
            elif mark == "/" and html[to + 2 : to + 3].isascii() and html[to + 2 : to + 3].isalpha():
                at = html.find(">", to) + 1
                if not at:
                    return
                self.handle_endtag(NAME.match(html, to + 2)[0].lower())
            elif mark in ("!", "?", "/"):
                close = "-->" if html.startswith("<!--", to) else ">"
                at = html.find(close, to + 2) + len(close)  # <!--> is a whole comment
                if at < len(close):
                    return
            else:
                self.data("<")
                at = to + 1

    @staticmethod
    def start(html: str, at: int) -> tuple[str, dict[str, str], int]:
        """The tag's name and attributes, and where it ends; -1 if it does not."""
        given: dict[str, str] = {}
        if found := TAG.match(html, at):
            for name, *values in ATTRIBUTE.findall(found[2]) if found[2] else ():
                given.setdefault(name.lower(), "".join(values))
            return found[1].lower(), given, found.end()
        tag = NAME.match(html, at + 1)[0]
        at += 1 + len(tag)
        while True:
            at = GAP.match(html, at).end()
            if at >= len(html):
                return tag, given, -1
            if html[at] == ">":
                return tag.lower(), given, at + 1
            part = PART.match(html, at)
            at = part.end() if part else at + 1
            after = GAP.match(html, at).end() if html[at : at + 1].isspace() else at
            if part is None or html[after : after + 1] != "=":
                if part:
                    given.setdefault(part[0].lower(), "")
                continue
            at = after + 1
            while html[at : at + 1].isspace():
                at += 1
            quote = html[at : at + 1]
            if quote in ('"', "'"):
                end = html.find(quote, at + 1)
                if end < 0:
                    return tag, given, -1
                value, at = html[at + 1 : end], end + 1
            else:
                value = BARE.match(html, at)[0]
                at += len(value)
            given.setdefault(part[0].lower(), value)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split()) if self.text else ""
        if text:
            self.blocks.append((self.stack[-1][1], text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def child(self, node: int, tag: str, mark: str, kind: int) -> int:
        """The collapsed node of a new child element: one of the same signature from the latest child's place on (after it,
        if the tag makes no runs), or a new one."""
        children, nodes = self.nodes[node][2], self.nodes
        at = max(self.cursors[-1], 0) if tag in RUNS else self.cursors[-1] + 1
        many = len(children) >= WIDE
        for k in [*range(at, len(children)), *(range(at) if many else ())]:
            if nodes[children[k]][0] == mark and nodes[children[k]][1] == kind:
                self.cursors[-1] = k
                return children[k]
        if many:  # by tag alone
            for k, c in enumerate(children):
                if nodes[c][0].partition(".")[0] == tag and nodes[c][1] == kind:
                    return c
        nodes.append([mark, kind, []])
        self.cursors[-1] += 1
        children.insert(self.cursors[-1], len(nodes) - 1)
        return len(nodes) - 1

    def handle_starttag(self, tag: str, given: dict[str, str]) -> None:
        if tag in CLOSES_P and self.open.get("p"):
            self.shut({"p"}, SCOPES)
        if tag in SAME_CLOSES and any(self.open.get(t) for t in SAME_CLOSES[tag]):
            self.shut(SAME_CLOSES[tag], SCOPES - SAME_CLOSES[tag])
        _, node, out = self.stack[-1]
        if not out:
            words = [w.lower() for k in ("class", "id", "role") for w in WORD.findall(given.get(k, ""))] if given else []
            structural = tag in ("html", "body", "article", "main")
            inside = bool(self.open.get("article") or self.open.get("main"))
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
            out = tag in NO_TEXT or hidden or (not structural and not MARKS.isdisjoint(words)) or (not inside and (tag == "header" or (not structural and not HEADERS.isdisjoint(words))))
            if tag == "article" and not MARKS.isdisjoint(words) and inside:
                out = True  # a comment or teaser within the article
        else:
            words = []
        if not inline(tag) or (out and not self.stack[-1][2]):
            if not inline(tag) and not out:
                self.flush()
            if len(self.stack) <= DEEP and not self.stack[-1][2]:
                role = given.get("role", "")
                tag_ = tag if tag in KNOWN else "x"
                kind = OUT if out else ARTICLE if tag == "article" or role == "article" else MAIN if tag == "main" or role == "main" else PLAIN
                node = self.child(node, tag_, ".".join((tag_, *sorted(set(words)))), kind)
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr") and self.text and not out and tag != "wbr":
                self.text.append(" ")
            return
        if tag == "a":
            self.links += 1
        self.stack.append((tag, node, out))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.cursors.append(-1)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            while self.pop() != tag:
                pass
        elif tag in ("br", "p") and self.text and not self.stack[-1][2]:
            self.text.append(" ")

    def pop(self) -> str:
        tag, _, out = self.stack[-1]
        if not inline(tag) and not out:
            self.flush()
        self.stack.pop()
        self.cursors.pop()
        self.open[tag] -= 1
        self.links -= tag == "a"
        return tag

    def shut(self, tags: set[str], until: frozenset[str] | set[str]) -> None:
        """Closes the nearest open element of these tags and all in it, unless an element of `until` lies between."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in until:
                return

    def data(self, data: str) -> None:
        if not self.stack[-1][2]:
            if "&" in data:
                data = unescape(data)
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def summary(page: Page) -> tuple[str, list[list[int]]]:
    """The page's tree as JSON of [signature, kind, children], and for each node in preorder [pages, least and greatest
    hash of its own text, the same of its subtree's, characters, characters in links]."""
    own: dict[int, list[str]] = {}
    links: dict[int, int] = {}
    for node, text, linked in page.blocks:
        own.setdefault(node, []).append(text)
        links[node] = links.get(node, 0) + linked
    stats: list[list[int]] = []

    def visit(node: int) -> tuple[list, str]:
        row: list[int] = []
        stats.append(row)
        mark, kind, children = page.nodes[node]
        text = "\n".join(own.get(node, ()))
        seen = [visit(c) for c in children]
        whole = "\x1f".join((text, *(t for _, t in seen))) if seen else text
        a, b = zlib.crc32(text.encode("utf-8", "replace")), zlib.crc32(whole.encode("utf-8", "replace"))
        row += [1, a, a, b, b, len(text), links.get(node, 0)]
        return [mark, kind, [t for t, _ in seen]], whole

    return json.dumps(visit(0)[0], separators=(",", ":")), stats


class Node:
    """A node of a wrapper, with what summary() says of it, added up over pages."""

    __slots__ = ("children", "kind", "mark", "number", "stats")

    def __init__(self, mark: str, kind: int, stats: list[int], children: list[Node]) -> None:
        self.mark, self.kind, self.stats, self.children = mark, kind, stats, children

    def same(self) -> bool:
        return self.stats[3] == self.stats[4]


def tree(shape: list, stats: Iterator[list[int]]) -> Node:
    row = list(next(stats))
    return Node(shape[0], shape[1], row, [tree(c, stats) for c in shape[2]])


def flat(node: Node) -> tuple[list, list[list[int]]]:
    below = [flat(c) for c in node.children]
    return [node.mark, node.kind, [s for s, _ in below]], [node.stats, *(r for _, rows in below for r in rows)]


def add_stats(a: list[int], b: list[int]) -> None:
    a[:] = a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), a[5] + b[5], a[6] + b[6]


def matching(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes of two trees of like roots that can be paired, keeping parents and order, and
    the children that are paired in such a matching."""
    m, n = len(a.children), len(b.children)
    weight = [[matching(x, y)[0] if x.mark == y.mark and x.kind == y.kind else 0 for y in b.children] for x in a.children]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs[::-1]


def joined_by(children: list[Node], key) -> list[Node]:
    """Children of one key merged into the first of them."""
    first: dict = {}
    for c in children:
        if key(c) in first:
            merge(first[key(c)], c)
        else:
            first[key(c)] = c
    return list(first.values())


def merge(a: Node, b: Node) -> None:
    """Adds tree b to a: paired nodes are added up, others inserted at their place."""
    add_stats(a.stats, b.stats)
    out, i, j = [], 0, 0
    for x, y in [*matching(a, b)[1], (len(a.children), len(b.children))]:
        out += a.children[i:x] + b.children[j:y]
        if x < len(a.children):
            merge(a.children[x], b.children[y])
            out.append(a.children[x])
        i, j = x + 1, y + 1
    if len(out) > WIDE:
        out = joined_by(out, lambda c: (c.mark, c.kind))
    if len(out) > WIDE:
        out = joined_by(out, lambda c: (c.mark.partition(".")[0], c.kind))
    a.children = out


def numbered(root: Node) -> list[Node]:
    """All nodes in preorder, each with its number."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo += node.children[::-1]
    return out


def pack(host_trees: dict[str, list]) -> Node:
    """One tree from {shape: stats} of a host, the most frequent shape first."""
    shapes = sorted(host_trees.items(), key=lambda x: (-x[1][0][0], x[0]))
    root = tree(json.loads(shapes[0][0]), iter(shapes[0][1]))
    for shape, stats in shapes[1:]:
        merge(root, tree(json.loads(shape), iter(stats)))
    return root


def content_nodes(root: Node, known: bool) -> set[int]:
    """Numbers of the nodes whose text is content: those of the article's region but for constant ones.

    The region is the article element (or else the main one) with the most text; without either it is found from the
    root, going into a container as long as one holds 70 % of the text that varies and is not mostly links, and no
    heading that varies stands beside it. known:
    whether the tree stands for pages that differ, so that what is constant is template.
    """
    nodes = numbered(root)
    mass, chars = [0.0] * len(nodes), [0] * len(nodes)
    for x in reversed(nodes):
        own, links = x.stats[5], x.stats[6]
        varies = not known or x.stats[1] != x.stats[2]
        mass[x.number] = (own if varies and 2 * links <= own and x.kind != OUT else 0) + sum(mass[c.number] for c in x.children)
        chars[x.number] = (own if x.kind != OUT else 0) + sum(chars[c.number] for c in x.children)
    region, loose = None, False
    for kind in (ARTICLE, MAIN):
        # elements within an element of the same kind are part of it
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.kind == kind:
                found.append(x)
            elif x.kind != OUT:
                todo += x.children
        if found:
            best = max(found, key=lambda x: (mass[x.number], chars[x.number], -x.number))
            if chars[best.number]:
                region = best
                break
    if region is None:
        region, loose = root, True
        while True:
            inner = [c for c in region.children if c.kind != OUT and (c.mark.partition(".")[0] in CONTAINERS) and mass[c.number] >= 0.7 * mass[region.number] > 0]
            if not inner or any(c.kind != OUT and c.mark.partition(".")[0] in HEADINGS and mass[c.number] for c in region.children):
                break
            region = max(inner, key=lambda c: mass[c.number])
    template = known and not region.same()
    out, todo = set(), [region]
    while todo:
        x = todo.pop()
        tag = x.mark.partition(".")[0]
        if x.kind == OUT or (loose and x is not region and tag not in PARAGRAPHS and 2 * x.stats[6] > x.stats[5] > 0):
            continue
        if template and x is not region and x.same() and chars[x.number] and x.stats[0] >= max(LEAST, SHARE * root.stats[0]):
            continue
        out.add(x.number)
        todo += x.children
    return out


class Extractor:
    """Main texts of pages by the wrappers of their hosts; what a host and a shape of page lead to is worked out once."""

    def __init__(self) -> None:
        self.wrappers: dict[str, tuple[Node, set[int]]] = {}
        self.kept: dict[tuple[str, str], set[int]] = {}

    def wrapper(self, packed: str) -> tuple[Node, set[int]]:
        if packed not in self.wrappers:
            if len(self.wrappers) >= 2000:
                self.wrappers.clear()
            shape, stats = json.loads(packed)
            root = tree(shape, iter(stats))
            self.wrappers[packed] = root, content_nodes(root, root.stats[0] > 1 and not root.same())
        return self.wrappers[packed]

    def keep(self, packed: str | None, shape: str, stats: list[list[int]]) -> set[int]:
        """Numbers, in preorder, of the page's nodes that are content."""
        mine = tree(json.loads(shape), iter(stats))
        alone = lambda: content_nodes(mine, False)
        if packed is None:
            return alone()
        root, content = self.wrapper(packed)
        numbered(mine)
        out, todo = set(), [(root, mine)]
        while todo:
            a, b = todo.pop()
            if a.number in content:
                out.add(b.number)
            todo += [(a.children[i], b.children[j]) for i, j in matching(a, b)[1]]
        return out or alone()

    def text(self, html: str | None, packed: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        shape, stats = summary(page)
        if packed is None:
            kept = self.keep(None, shape, stats)
        else:
            key = packed, shape
            if key not in self.kept:
                if len(self.kept) >= 20000:
                    self.kept.clear()
                self.kept[key] = self.keep(packed, shape, stats)
            kept = self.kept[key]
        number, todo = {}, [0]
        while todo:
            node = todo.pop()
            number[node] = len(number)
            todo += page.nodes[node][2][::-1]
        return "\n".join(text for node, text, _ in page.blocks if number[node] in kept)


def with_host(df: DataFrame, url_col: str, name: str) -> DataFrame:
    """df with the host of the URL in lower case, without user and port; null if there is none."""
    host = F.regexp_extract(F.col(url_col).cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return df.withColumn(name, F.nullif(F.lower(host), F.lit("")))


def induce(df: DataFrame, url_col: str = "url", html_col: str = "html", most: int = 8 << 20) -> DataFrame:
    """(host, wrapper, pages): the wrapper of every host, from all its pages.

    A task merges what it reads of a host into one tree; then rounds of merging FAN trees of a host at a time leave one.
    A tree does not grow with the pages, so neither does a task.
    """
    plain = with_host(df.select(F.col(url_col).alias("url"), F.col(html_col).alias("text")), "url", "host").where("host is not null and text is not null").select("host", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, list]] = {}
        count = 0

        def out() -> pa.RecordBatch:
            packed = [(h, json.dumps(flat(root), separators=(",", ":")), root.stats[0]) for h, root in ((h, pack(x)) for h, x in held.items())]
            return pa.record_batch([pa.array([x[k] for x in packed], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "wrapper", "pages"])

        for b in pieces(batches, "text", most):
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shape, stats = summary(Page(html))
                shapes = held.setdefault(host, {})
                if shape in shapes:
                    for x, y in zip(shapes[shape], stats, strict=True):
                        add_stats(x, y)
                else:
                    shapes[shape] = stats
                    count += len(stats)
            if count > 200_000:  # nodes held
                yield out()
                held.clear()
                count = 0
        yield out()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        shapes: dict[str, list] = {}
        for packed in sorted(rows["wrapper"]):
            shape, stats = json.loads(packed)
            key = json.dumps(shape, separators=(",", ":"))
            if key in shapes:
                for x, y in zip(shapes[key], stats, strict=True):
                    add_stats(x, y)
            else:
                shapes[key] = stats
        root = pack(shapes)
        return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(flat(root), separators=(",", ":"))], "pages": [root.stats[0]]})

    schema = "host string, wrapper string, pages long"
    parts = written(plain.mapInArrow(run, schema))
    while True:
        n = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        if n == 1:
            return parts
        bucket = F.pmod(F.xxhash64("wrapper", "pages"), F.lit(-(-n // FAN)))
        parts = written(parts.groupBy("host", bucket.alias("bucket")).applyInPandas(fold, schema))


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", most: int = 8 << 20) -> DataFrame:
    """df without the HTML, with `text`, the main text, and `n_chars`, its code points.

    Blocks (what lies between block elements) are joined by line feeds; in a block white space is one space and character
    references are decoded. Head, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden
    elements and comments are left out, and so is what the host's pages have in common within the article. A null or
    empty page has an empty text; pages without a host, or alone on it, go by their own tree. Every row gives a row;
    columns named text or n_chars are replaced.

    Wrappers are broadcast if all together have at most BROADCAST bytes. If not, those of hosts with more than one in a
    thousand of the pages are (a thousand at most), and other pages are joined by host.
    """
    wrappers = induce(df, url_col, html_col, most)
    bytes_, pages = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    host, packed = unused(df, "host"), unused(df, "wrapper")
    named = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(packed), "pages")
    given = with_host(df.drop(*[c for c in ("text", "n_chars") if c != html_col]), url_col, host)
    if bytes_ <= BROADCAST:
        both = given.join(F.broadcast(named.drop("pages")), host, "left")
    else:
        hot = F.col("pages") > max(1000, pages // 1000)
        first = given.join(F.broadcast(named.where(hot).select(host, F.col(packed).alias(f"{packed}_hot"))), host, "left")
        key = F.when(F.col(host).isNull() | F.col(f"{packed}_hot").isNotNull(), F.concat(F.lit("?"), F.xxhash64(html_col, url_col).cast("string"))).otherwise(F.col(host))
        rest = named.where(~hot).select(F.col(host).alias(f"{host}_key"), packed)
        both = first.withColumn(f"{host}_key", key).join(rest, f"{host}_key", "left").withColumn(packed, F.coalesce(packed, f"{packed}_hot")).drop(f"{packed}_hot", f"{host}_key")
    rest = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    ready = both.select(*rest, F.col(packed).alias("__wrapper"), F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor()
        for b in pieces(batches, "__html", most):
            texts = [extractor.text(h, w) for h, w in zip(b.column(len(rest) + 1).to_pylist(), b.column(len(rest)).to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns[: len(rest)], pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[: len(rest)])
    return ready.mapInArrow(run, f"{fields}, text string, n_chars long")
