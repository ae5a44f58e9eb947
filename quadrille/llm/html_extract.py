"""Main-text extraction with consensus paths per host.

Every page is parsed into a light tree and its containers are scored by the
text that paragraphs below them hold, less what stands in links. A container
goes by its generalised path: tag names with class names, digits stripped.
Spark counts each page's best path per host; the path with most votes, if it
has at least ``MIN_SHARE`` of them, is the host's winner, and every page of the
host is extracted again from the elements on that path. A page without such an
element, or without a host, uses its own best one.

Outside an article every element named like a menu or an advert goes. Inside
one, position tells more than a word: there an element goes only if one of its
names consists of such words alone (``related-posts``, not ``related-work``).
Memory and time are linear in a page, however deep it is nested.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise

# Choices of this library: element and class names with a meaning here.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "math", "object", "canvas", "audio", "video", "head", "fieldset", "label", "input", "option", "datalist"} | RAW
BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "header", "hgroup", "address", "details", "summary", "body", "html", "center", "hr"} | SKIPPED
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote", "table"}
CLOSES_P = BLOCKS - {"html", "body", "head", "script", "style", "title", "template", "noscript", "iframe", "option", "button", "label", "input", "select", "svg", "math", "object", "canvas", "audio", "video", "textarea", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "foot", "masthead", "topbar", "toolbar", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "respond", "disqus", "reply", "replies", "widget", "pagination", "pager", "skip", "login", "search", "tags", "copyright", "disclaimer"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
GOOD = {"article", "content", "post", "entry", "story", "main", "text", "body", "page"}
PLAIN = {"a", "area", "articles", "bar", "block", "box", "button", "buttons", "center", "column", "container", "content", "group", "heading", "icon", "icons", "info", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "more", "outer", "page", "panel", "post", "posts", "region", "right", "row", "section", "site", "slot", "stories", "the", "title", "top", "bottom", "unit", "wrap", "wrapper"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
DECAY, REACH = 0.7, 40  # a block counts for that many containers around it; beyond, its share is under a millionth
MIN_SHARE = 0.25


class Node:
    __slots__ = ("tag", "own", "noise", "parent", "kids", "depth", "good", "inside")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.noise, self.good, self.own = tag in SKIPPED, False, tag
        self.depth = parent.depth + 1 if parent else 0
        within = parent is not None and parent.inside
        if attributes and "=" in attributes:
            got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
            names = f"{got.get('class', '')} {got.get('id', '')}".lower().split()
            self.own += "".join(f".{c}" for c in sorted({re.sub(r"\d+", "", c) for c in got.get("class", "").lower().split()} - {""}))
            split = [[x for x in re.split(r"[^a-z]+", name) if x] for name in names]
            self.good = any(x in GOOD for parts in split for x in parts)
            if within:
                strong = any(parts and any(x in NOISE for x in parts) and all(x in NOISE or x in PLAIN for x in parts) for parts in split)
            else:
                strong = any(x in NOISE for parts in split for x in parts)
            strong = strong and not (self.good and tag in ("article", "main", "body"))
            self.noise |= (strong and tag not in ("html", "body")) or got.get("role", "").lower() in NOISE_ROLES or got.get("aria-hidden", "").lower() == "true"
        if attributes and "hidden" in attributes and tag not in ("html", "body") and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
            self.noise = True
        self.inside = within or (not self.noise and (tag in ("article", "main") or (self.good and tag in ("div", "section"))))

    @property
    def path(self) -> str:
        """Generalised path from the root; built when asked for, as few nodes ever are."""
        names, node = [], self
        while node:
            names.append(node.own)
            node = node.parent
        return ">".join(reversed(names))


def parse(page: str) -> Node:
    """The tree of a page; text is kept as strings among a node's kids. Broken markup never fails."""
    root = Node("#root", "", None)
    top, at, n = root, 0, len(page)
    open_tags: dict[str, int] = {}  # how many elements of a tag are open, so that no climb is in vain

    def climb(node: Node) -> Node:
        """Close everything from the open element down to, and with, ``node``."""
        up = top
        while up is not node:
            open_tags[up.tag] -= 1
            up = up.parent
        open_tags[node.tag] -= 1
        return node.parent

    while at < n:
        m = TAG.search(page, at)
        if not m:
            top.kids.append(page[at:])
            break
        if m.start() > at:
            top.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if at == n and page[-1] != ">":
            break  # a tag that the page's end cuts off
        if m[1]:
            node = top if open_tags.get(tag) else root
            while node.parent and node.tag != tag:
                if node.tag in ("article", "main", "body", "td", "table") and tag not in ("html", "body", "article", "main", "table", "tr", "td", "section", "div"):
                    node = root
                    break
                node = node.parent
            if node.parent:
                top = climb(node)
            elif tag == "br":
                top.kids.append(Node("br", "", top))
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            node = top
            while node.parent and node.tag != "p" and node.tag not in CONTAINERS and node.tag not in ("li", "dd", "th"):
                node = node.parent
            if node.tag == "p":
                top = climb(node)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, (tag,))
            stop = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ("select",))
            node = top if any(open_tags.get(x) for x in same) else root
            while node.parent and node.tag not in same and node.tag not in stop:
                node = node.parent
            if node.tag in same:
                top = climb(node)
        node = Node(tag, m[3] or "", top)
        top.kids.append(node)
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        top = node
    return root


def blocks_of(node: Node, inside: bool = True) -> list[tuple[str, Node, int]]:
    """(text, block element, characters in links) of every block below a node, in page order."""
    out: list[tuple[str, Node, int]] = []
    buffer: list[str] = []
    links = 0
    work: list[tuple[object, Node, bool]] = [(node, node, False)]

    def flush(owner: Node) -> None:
        nonlocal links
        text = SPACE.sub(" ", html.unescape("".join(buffer))).strip() if buffer else ""
        if text:
            out.append((text, owner, links))
        buffer.clear()
        links = 0

    # An explicit stack: nesting is as deep as the page makes it.
    while work:
        item, owner, linked = work.pop()
        if isinstance(item, str):
            buffer.append(item)
            links += len(item.strip()) if linked else 0
        elif isinstance(item, tuple):
            flush(item[0])
        elif item is not node and (item.noise or (item.tag == "header" and not _heading_in(item))):
            if item.tag in BLOCKS:
                flush(owner)
        elif item.tag == "br":
            buffer.append(" ")
        else:
            block = item.tag in BLOCKS
            if block and item is not node:
                flush(owner)
            mine = item if block else owner
            if block:
                work.append(((mine,), mine, linked))
            work.extend((k, mine, linked or item.tag == "a") for k in reversed(item.kids))
    flush(node)
    return out


def _heading_in(node: Node) -> bool:
    """A header within an article that holds its heading belongs to the text."""
    return node.inside and any(isinstance(k, Node) and (k.tag in ("h1", "h2", "hgroup") or any(isinstance(g, Node) and g.tag in ("h1", "h2") for g in k.kids)) for k in node.kids)


def best_container(root: Node) -> Node | None:
    """The container with the largest score; of equals the outer one."""
    scores: dict[int, float] = {}
    held: dict[int, Node] = {}
    for text, owner, links in blocks_of(root):
        worth = max(0.0, len(text) - 2.0 * links)
        node, steps = owner, 0
        while node and node.parent and worth and steps < REACH:
            if node.tag in CONTAINERS:
                scores[id(node)] = scores.get(id(node), 0.0) + worth * DECAY**steps
                held[id(node)] = node
                steps += 1
            node = node.parent
    for k, node in held.items():
        scores[k] *= (1.5 if node.tag in ("article", "main") else 1.0) * (1.25 if node.good else 1.0)
    return held[max(scores, key=lambda k: (round(scores[k], 6), -held[k].depth))] if scores else None


def on_path(root: Node, path: str) -> list[Node]:
    """The outermost elements with a generalised path, in page order, none of them noise or in noise."""
    steps, out, work = path.split(">"), [], [root]
    while work:
        node = work.pop()
        if node.own != steps[node.depth]:
            continue
        if node.depth == len(steps) - 1:
            out.append(node)
            continue
        work.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.noise)
    return out


def extract(page: str | None, path: str | None) -> str:
    """Blocks of the elements on the path, or of the page's own best container."""
    root = parse(page or "")
    found = [text for x in (on_path(root, path) if path else []) for text, _, _ in blocks_of(x)]
    if not found:
        found = [text for text, _, _ in blocks_of(best_container(root) or root)]
    return "\n\n".join(found)


def votes_of(pages: pd.Series) -> pd.Series:
    return pd.Series([best.path if (best := best_container(parse(p or ""))) else None for p in pages], dtype=object)


def texts_of(pages: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([extract(p, q) for p, q in zip(pages, paths, strict=True)], dtype=object)


def extract_pages(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``carry`` columns, ``host``, ``path`` (the host's winner), ``text``, ``n_chars``, a row per page.

    Null or empty html gives empty text. A null url or one without a host has
    the host "", where no votes are cast. Votes go by pages, ties to the smaller
    path; repeated rows stay, other columns are not read, an empty table gives
    no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1))
    ballots = pages.select(host.alias("_host"), F.col(html_col).alias("_html")).where("_host <> ''")
    votes = ballots.select("_host", F.pandas_udf(votes_of, "string")("_html").alias("_path")).where("_path IS NOT NULL").groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("_host").agg(F.min(F.struct((-F.col("n")).alias("n"), "_path")).alias("best"), F.sum("n").alias("all"))
    winners = materialise(best.where(-F.col("best.n") >= F.col("all") * F.lit(MIN_SHARE)).select("_host", F.col("best._path").alias("_path")))
    rows = pages.select(F.struct(*carry).alias("row"), F.col(html_col).alias("_html"), host.alias("_host"))
    out = rows.join(winners, "_host", "left").select("row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.coalesce(F.pandas_udf(texts_of, "string")("_html", "_path"), F.lit("")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
