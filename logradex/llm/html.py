"""Main-text extraction with consensus paths per host.

Three steps:

1. Every page is parsed into blocks of text, each with its chain of containers.  What is no
   article by its tag, role, class or id (menus, headers, footers, sidebars, notices,
   adverts, forms, reader comments, ...) is left out.  Containers are scored by the text in
   them, and the page votes for the paths of its best containers: tags and classes from the
   root, digits generalised.
2. Votes are counted by host and path in Spark (pre-aggregated, so a host that holds most
   pages is no burden).  A path that at least ``MIN_SHARE`` of a host's pages vote for wins.
3. Every page is read again: the first winning path of its host that has text in it, and article
   and main elements that hold half of its text, give the article; a page with none of them falls
   back on its own best containers.

Best containers are the outermost article and main elements, if they hold half of the text;
else the lowest container that leaves nothing behind but boxes which are small (together a
tenth of the page) and named like nothing that an article has.

Words in a class or id tell of boilerplate outside an article.  Inside (an article or main
element, or a winning path) they do so only if they are plain (adverts, comments, sharing, ...)
or make up the whole name: ``related-posts`` goes, ``related-work`` stays.  Outside, a list or
bare container of nothing but links is a menu.

Inside a block, character references are decoded and white space becomes one space; blocks
are joined in page order by two line feeds.  One pass over the tags, with an index of the open
ones, so deep nesting and stray tags cost no more than others.

The winning paths are broadcast if their bytes are counted and few, and joined by a shuffle on
the host otherwise.

Edge cases: null or empty html, or a page without text, gives the empty string; a null url
belongs to the host of the empty name; unclosed tags, comments and references are read as
a browser does, but an unclosed svg, video, select or the like holds nothing; html that ends
within a tag loses that tag; very long pages are read whole; repeated rows, repeated and null
ids give a row each; an empty table gives an empty result; columns of other names, ``host`` and
``paths`` among them, play no part; paths with as many votes rank by their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .urls import split_url

MIN_SHARE = 0.1
MAX_PATH = 400
LEFT_BEHIND = 0.1

# no alternative of a repetition can match what another does, and repetitions are possessive: no text backtracks
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)"
    r"(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+\Z",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_READ = frozenset("class id role hidden aria-hidden style".split())

_CLOSES_P = frozenset(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul xmp""".split()
)
_BLOCK = _CLOSES_P | frozenset("body html tbody td tfoot th thead tr caption head legend".split())
_VOID = frozenset("area base col embed img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = _HEADINGS | frozenset("p li dd dt pre blockquote figcaption td th tr caption summary".split())
#: What they hold isn't shown; without an end tag, they and buttons and labels hold nothing.
_UNSEEN = frozenset("noscript svg template object select canvas audio video annotation datalist".split())
_LATER = _UNSEEN | {"button", "label"}
_DROP_TAGS = frozenset("nav footer aside form button dialog menu head fieldset label".split())
_DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Words that tell of boilerplate wherever they are ...
_PLAIN_WORDS = frozenset(
    """nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars ad ads adv advert adverts
    advertisement advertising adsense adslot sponsored cookie cookies gdpr newsletter subscribe subscription signup
    share sharing social comment comments commentlist respond disqus pagination pager skiplink outbrain taboola""".split()
)
#: ... and those that do so outside an article, or as the whole name of a container.
_DROP_WORDS = _PLAIN_WORDS | frozenset(
    """header masthead topbar footer colophon bottombar aside rail widget widgets sponsor sponsors promo promos promotion
    banner consent notice notices notification alert popup modal overlay login form search replies reply discussion
    related recommended recommendations toc skip hidden toolbar disclaimer paywall teaser""".split()
)
_INSIDE_WORDS = _DROP_WORDS - {"header", "discussion", "reply", "toc", "form", "aside", "disclaimer"}
_NEUTRAL = frozenset(
    """post posts article articles story stories link links box block list section container wrapper wrap area item
    items bar panel inner outer top bottom left right more site page row col column module group stuff reading news
    a an the and to for you also your""".split()
)
#: Words of what belongs to an article though it stands beside its largest part.
_KEEP_WORDS = frozenset(
    """intro introduction lead lede standfirst summary abstract body content text article post story entry main title
    headline subtitle section chapter part paragraph copy prose conclusion page column""".split()
)
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_WITH = re.compile(r"(?:has|with|without|no|not|is)[-_A-Z]")  # has-sidebar tells of something else
_DIGITS = re.compile(r"\d+")
_CELLS = ("td", "th", "caption", "table", "button")
_IMPLIED = {  # an opening tag closes what is open of these, up to the nearest of those
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
}


@dataclass(slots=True)
class Node:
    """An open or closed container; ``block`` is the one that its text counts for, itself unless it is inline."""

    tag: str
    path: str
    parent: int
    dropped: bool
    article: bool
    block: int
    kept_name: bool = True


@dataclass
class Page:
    """Blocks of text (text, container, share of it in links), in page order, and their containers."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[str, int, float]] = field(default_factory=list)


def _words(value: str) -> set[str]:
    return {w.lower() for w in _SPLIT.findall(value)}


def _attributes(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in _READ:
            out.setdefault(name, entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _is_hidden(attrs: dict[str, str]) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _is_dropped(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in _DROP_TAGS or tag in _UNSEEN or (tag == "header" and not inside_article):
        return True
    if not attrs:
        return False
    if _is_hidden(attrs) or attrs.get("role", "").lower() in _DROP_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    names = [_words(x) for k in ("class", "id") for x in attrs.get(k, "").split() if not _WITH.match(x)]
    if tag == "article":  # classes of an article tell what it has, unless it is a comment
        return any(x & {"comment", "comments", "reply", "ad", "advert", "sponsored"} for x in names)
    if not inside_article:
        return any(x & _DROP_WORDS for x in names)
    if any(x & _PLAIN_WORDS for x in names):
        return True
    return tag not in _LEAVES and any(x & _INSIDE_WORDS and x <= _INSIDE_WORDS | _NEUTRAL for x in names)


def parse(source: str, paths: Iterable[str] = ()) -> Page:
    """Blocks and containers; a page that is all in one form is read as if it weren't.

    A container on one of ``paths`` is taken for an article.
    """
    found = frozenset(paths)
    page = _Parser(source, found, True).page
    if not page.blocks and any(n.tag == "form" for n in page.nodes):
        return _Parser(source, found, False).page
    return page


class _Parser:
    def __init__(self, source: str, paths: frozenset[str], drop_forms: bool) -> None:
        self.paths, self.drop_forms = paths, drop_forms
        self.page = Page()
        self.nodes = self.page.nodes
        self.nodes.append(Node("", "", -1, False, False, 0))
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # tag -> depths in the stack
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.ends = {t: m.start() for m in re.finditer(r"</([a-z]+)", source, re.IGNORECASE) if (t := m[1].lower()) in _LATER}
        at = 0
        for m in _TOKEN.finditer(source):
            self._add(source[at : m.start()])
            at = m.end()
            if m["tag"] is not None:
                self._tag(m["tag"].lower(), bool(m["end"]), m["attrs"], at)
            elif m["raw"] is not None and m["raw"].lower() == "xmp":
                self._flush()
                self._add(m["inner"].replace("&", "&amp;"))
                self._flush()
        self._add(source[at:])
        self._flush()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            node = self.nodes[self.stack[-1]].block
            if text and not self.nodes[node].dropped:
                size = len(text) - text.count(" ")
                self.page.blocks.append((text, node, min(1.0, self.linked / size)))
            self.parts.clear()
        self.linked = 0

    def _add(self, text: str) -> None:
        if text and not self.nodes[self.stack[-1]].dropped:
            if "&" in text:
                text = entities.unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def _push(self, tag: str, node: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def _cut(self, depth: int) -> None:
        """Close the containers from ``depth`` on."""
        while len(self.stack) > depth:
            self.open[self.nodes[self.stack.pop()].tag].pop()

    def _top(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open container of these tags, or 0."""
        return max((d[-1] for t in tags if (d := self.open.get(t))), default=0)

    def _tag(self, tag: str, end: bool, raw: str, after: int) -> None:
        if end:
            return self._end(tag)
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in _VOID:
            pass
        elif tag in _BLOCK or "-" in tag:
            self._block(tag, raw)
        elif tag in _LATER:
            if self.ends.get(tag, -1) >= after and not (tag == "svg" and raw.endswith("/")):
                self._push(tag, self._node(tag, {}, True, inline=True))
        else:
            attrs = _attributes(raw) if raw else {}
            gone = bool(attrs) and (_is_dropped(tag, attrs, True) if tag == "span" else _is_hidden(attrs))
            if gone or self.open.get(tag):  # within a dropped one, others of its name count
                self._push(tag, self._node(tag, attrs, gone, inline=True))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        if tag == "br" or tag == "p" and not self.open.get("p"):
            self.parts.append(" ")
        depths = self.open.get(tag)
        if not depths:
            return
        node = self.nodes[self.stack[depths[-1]]]
        if node.block == self.stack[depths[-1]]:  # a block
            self._flush()
            self.links = 0
        elif self.nodes[self.stack[-1]].block != node.block:
            return  # an inline element doesn't end the block in it
        self._cut(depths[-1])

    def _block(self, tag: str, raw: str) -> None:
        self._flush()
        self.links = 0
        if tag in _CLOSES_P and (depths := self.open.get("p")) and depths[-1] > self._top(_CELLS):
            self._cut(depths[-1])
        if tag in _IMPLIED:
            close, within = _IMPLIED[tag]
            limit = self._top(within)
            lowest = [d[k] for t in close if (d := self.open.get(t)) and (k := bisect_right(d, limit)) < len(d)]
            if lowest:
                self._cut(min(lowest))
        elif tag in _HEADINGS and self.nodes[self.stack[-1]].tag in _HEADINGS:
            self._cut(len(self.stack) - 1)
        if tag == "hr":
            return
        attrs = _attributes(raw) if raw else {}
        if not raw.endswith("/") or tag in _BLOCK:
            self._push(tag, self._node(tag, attrs, None if self.drop_forms or tag != "form" else False))

    def _node(self, tag: str, attrs: dict[str, str], dropped: bool | None, inline: bool = False) -> int:
        nodes = self.nodes
        parent = nodes[self.stack[-1]]
        inside = parent.article
        gone = parent.dropped or (_is_dropped(tag, attrs, inside) if dropped is None else dropped)
        me = len(nodes)
        if inline:
            nodes.append(Node(tag, "", self.stack[-1], gone, inside, parent.block))
            return me
        names = attrs.get("class", "").split()
        path = f"{parent.path}>{tag}" + "".join("." + _DIGITS.sub("#", c) for c in sorted(names))
        if len(path) > MAX_PATH:  # very deep or many classes: a digest stands for it
            path = "#" + xxhash.xxh3_128_hexdigest(path)
        kept_name = not (names or "id" in attrs) or any(_words(x) & _KEEP_WORDS for x in [*names, attrs.get("id", "")])
        article = inside or tag in ("article", "main") or path in self.paths and tag not in ("html", "body")
        nodes.append(Node(tag, path, self.stack[-1], gone, article, me, kept_name))
        return me


def _weight(page: Page) -> list[float]:
    """Score of each container: the text in it that is not in links."""
    score = [0.0] * len(page.nodes)
    for text, node, linked in page.blocks:
        if linked <= 0.5:
            score[node] += len(text) * (1 - linked)
    for i in range(len(score) - 1, 0, -1):  # a container comes after the one it is in
        score[page.nodes[i].parent] += score[i]
    return score


def _outermost(page: Page, chosen: set[int]) -> set[int]:
    inside = [False] * len(page.nodes)
    out = set()
    for i, n in enumerate(page.nodes):
        inside[i] = n.parent >= 0 and (inside[n.parent] or n.parent in chosen)
        if i in chosen and not inside[i]:
            out.add(i)
    return out


def _named(page: Page, score: list[float]) -> set[int]:
    """The outermost article and main elements with text, if they hold half of the page's."""
    named = _outermost(page, {i for i, n in enumerate(page.nodes) if n.tag in ("article", "main") and not n.dropped and score[i]})
    return named if sum(score[i] for i in named) >= 0.5 * score[0] else set()


def best(page: Page) -> set[int]:
    """The containers that hold the article, none inside another; empty if there is no text."""
    score = _weight(page)
    total = score[0]
    if not total:
        return {0} if page.blocks else set()
    if named := _named(page, score):
        return named
    children: dict[int, list[int]] = {}
    for i, n in enumerate(page.nodes):
        if i and score[i]:
            children.setdefault(n.parent, []).append(i)
    direct = {node for _, node, linked in page.blocks if linked <= 0.5}
    at, left = 0, 0.0
    while True:
        inner = children.get(at, [])
        heavy = max((i for i in inner if page.nodes[i].tag not in _LEAVES), key=lambda i: score[i], default=None)
        if heavy is None or at in direct:
            return {at}
        rest = [i for i in inner if i != heavy]
        left += sum(score[i] for i in rest)
        if left > LEFT_BEHIND * total or any(page.nodes[i].tag in _LEAVES or page.nodes[i].kept_name for i in rest):
            return {at}
        at = heavy


def text_of(page: Page, roots: set[int]) -> str:
    """The blocks below the roots, without menus."""
    score = _weight(page)
    inside = [i in roots for i in range(len(page.nodes))]
    for i, n in enumerate(page.nodes):
        if n.parent >= 0 and inside[n.parent]:
            inside[i] = True
    return "\n\n".join(t for t, i, linked in page.blocks if inside[i] and not (linked >= 0.99 and _menu(page, i, score)))


def _menu(page: Page, node: int, score: list[float]) -> bool:
    """Whether links alone are a menu: an entry of a list, or a bare container, that has no other text."""
    n = page.nodes[node]
    if n.article or n.tag in _HEADINGS or n.tag in ("", "p", "td", "th", "blockquote", "pre", "body", "html"):
        return False
    return not score[n.parent if n.tag in ("li", "dd", "dt") else node]


def main_text(source: str | None, paths: list[str]) -> str:
    """The article by the winning paths and the page's own article elements, else by its best containers."""
    if not source:
        return ""
    page = parse(source, paths)
    score = _weight(page)
    on_path: dict[str, set[int]] = {}
    for i, n in enumerate(page.nodes):
        if n.block == i and not n.dropped and score[i]:
            on_path.setdefault(n.path, set()).add(i)
    for path in paths:
        if path in on_path and (text := text_of(page, _outermost(page, on_path[path] | _named(page, score)))):
            return text
    return text_of(page, best(page))


def votes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Host and best paths of each page that has text; ``first`` marks one row of a page."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        host, path, first = [], [], []
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = parse(source) if source else Page()
            name = split_url(url)[0]
            for k, p in enumerate(sorted({page.nodes[i].path for i in best(page)}) if page.blocks else ()):
                host.append(name)
                path.append(p)
                first.append(k == 0)
        cols = [pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(first, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, ["host", "path", "first"])

    return common.map_batches(pages, [url_col, html_col], rows, "host string, path string, first boolean")


def winners(votes: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Per host its winning paths, the most voted first.

    Of the paths of whole pages (the html or body element) none wins beside others: they hold what the others leave.
    """
    # used twice: without the checkpoint, pages would be parsed for each use
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if("first").alias("pages")).checkpoint()
    total = counts.groupBy("host").agg(F.sum("pages").alias("total"))
    top = counts.join(total, "host").where(F.col("n") >= min_share * F.col("total"))
    whole = F.col("path").rlike(r"^(>html[^>]*)?(>body[^>]*)?$")
    top = top.withColumn("whole", whole)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path", "whole")))
    some = F.filter(ranked, lambda x: ~x["whole"])
    won = F.when(F.size(some) > 0, some).otherwise(ranked)
    # pages with several containers vote more than once, but each for paths of their own
    return top.groupBy("host").agg(F.transform(won, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars."""
    common.prepare(pages.sparkSession)
    won = winners(votes(pages, url_col, html_col)).checkpoint()
    size = F.octet_length("host") + F.octet_length(F.array_join("paths", ","))
    schema = {f.name: f.dataType.simpleString() for f in pages.schema}
    some = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")
    )
    host = common.ascii_lower(F.regexp_extract("url", "(?s)^.*?://([^/?#]*)", 1))
    some = some.withColumn("host", F.coalesce(host, F.lit("")))
    joined = some.join(common.broadcast_if_small(won, size), "host", "left")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, p or []) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [id_col, url_col, "text", "n_chars"],
        )

    fields = f"`{id_col}` {schema[id_col]}, `{url_col}` {schema[url_col]}, text string, n_chars bigint"
    return common.map_batches(joined, ["id", "url", "html", "paths"], rows, fields)


def op1(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
