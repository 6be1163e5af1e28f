"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of styles: a node is a path of block elements with their classes and ids. Over the
pages that have a node, the entropy of its contents and of its presentations (the sequence of styles below it) is taken:
what reads or looks alike on all pages of a site tells nothing and has importance 0, what differs from page to page
approaches 1. Branches whose importance is low are cut from every page of the host. Menus and adverts may differ from page
to page and yet belong to no article, so the importance of an element whose tag, role, class or id
names such a part is 0 as well. Pages of a host with the same article are copies and count as one page, and an article or
main element and what lies around it is never cut, whatever its importance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from prospecta.llm.urlrules import url_parts
from prospecta.session import materialise

#: A branch is cut below this importance, if so many different pages of the host at least have it.
LEAST_IMPORTANCE, LEAST_PAGES = 0.1, 8
#: Weight of what lies below a node against its own presentations, by number of styles (the attenuating factor).
GAMMA = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split())
#: What a start tag ends, if it is open and no block of the second kind was opened since.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
        "tbody": "thead tbody tr td th", "thead": "tbody tr td th", "tfoot": "tbody tr td th"}
SCOPES = frozenset("ul ol dl table div section article main body aside nav footer header form blockquote".split())

#: Elements that are never part of an article's text.
NO_TEXT = frozenset(
    "aside button canvas datalist dialog embed footer form frame frameset head iframe input label math menu nav noframes "
    "noscript object script select style svg template textarea title video audio".split())
NO_TEXT_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
#: Words in a class or id that name a part outside of the article.
NO_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies copyright disqus dropdown feedback footer gdpr login masthead "
    "menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination popup "
    "promo promos promotion promoted recommended related replies reply respond search share sharing sidebar sidebars signin "
    "signup skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser toolbar topbar widget widgets".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "style", "parent", "children", "named", "main")

    def __init__(self, tag: str, style: str, parent: Node | None, named: bool):
        self.tag, self.style, self.parent, self.named = tag, style, parent, named
        self.children: list[Node | str] = []
        self.main = False


class Tree(HTMLParser):
    """The elements of a page. Tags that are not closed end with the block around them; inline tags only hold text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None, False)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img"):
                self.at.children.append(Node(tag, "", self.at, False))
            return
        if tag in BLOCKS:
            self._end({*ENDS.get(tag, "").split(), "p"} - (set() if tag != "body" else {"p"}))
        known = dict(attrs)
        labels = f"{known.get('class') or ''} {known.get('id') or ''}"
        words = {word.lower() for word in WORD.findall(labels)} if labels != " " else set()
        named = bool(words & NO_TEXT_WORDS) or (known.get("role") or "").lower() in NO_TEXT_ROLES
        style = tag + "." + " ".join(sorted(words)) if words else tag
        node = Node(tag, style, self.at, named)
        self.at.children.append(node)
        if tag in ("article", "main"):
            above = node
            while above and not above.main:
                above.main = True
                above = above.parent
        self.at = node

    def _end(self, tags: set[str]) -> None:
        node, found = self.at, None
        while node and node.tag not in SCOPES:
            if node.tag in tags:
                found = node
            node = node.parent
        if found:
            self.at = found.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node and node.tag != tag:
            if node.tag in SCOPES and tag not in BLOCKS:
                return  # an inline end tag ends nothing outside of its block
            if node.tag in SCOPES and tag == "p":
                return
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def is_part(node: Node) -> bool:
    """Whether a node's presentation says that it is no part of an article."""
    if node.tag in NO_TEXT:
        return True
    inside = node.parent
    while inside and inside.tag not in ("article", "main"):
        inside = inside.parent
    if node.tag == "header" and not inside and not node.main:
        return True
    if not node.named or node.tag in ("html", "body"):
        return False
    # A frame around the article may be called after what else it holds; an article may not hold another.
    return not node.main or node.tag == "article"


def style_paths(root: Node) -> Iterator[tuple[Node, str]]:
    """The block elements of a page that may be of an article, in page order, each with its path of styles."""
    todo: list[tuple[Node, str]] = [(root, "")]
    while todo:
        node, path = todo.pop()
        if node.tag in BLOCKS:
            path = f"{path}/{node.style}"
            yield node, path
        todo.extend(
            (child, path) for child in reversed(node.children) if isinstance(child, Node) and not is_part(child))


def blocks(roots: list[Node]) -> list[str]:
    """The text below the nodes by block, blanks reduced; what is no part of an article left out."""
    out: list[str] = []
    run: list[str] = []

    def finish() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [*reversed(roots)]
    while todo:
        node = todo.pop()
        if node is None:
            finish()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag in ("br", "img", "wbr"):
            run.append("" if node.tag == "wbr" else " ")
        elif not is_part(node):
            if node.tag in BLOCKS:
                finish()
                todo.append(None)
            todo.extend(reversed(node.children))
    finish()
    return out


def page_statistics(html: str) -> tuple[int, int, list[int], list[int], list[int]]:
    """Hashes of a page's article and of its html; of its nodes, the paths, contents and presentations, one for each path."""
    root = Tree(html).root
    found: dict[str, list[Node]] = {}
    for node, path in style_paths(root):
        found.setdefault(path, []).append(node)
    paths, contents, presentations = [], [], []
    for path, nodes in found.items():
        content = "\n".join(blocks(nodes))
        looks = "|".join(
            ",".join(child.style for child in node.children if isinstance(child, Node) and child.tag in BLOCKS)
            for node in nodes)
        paths.append(_hash(path))
        contents.append(_hash(content))
        presentations.append(_hash(looks))
    return _hash(article(root, frozenset())), _hash(html), paths, contents, presentations


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >= 1 << 63 else value


def main_text(html: str, cut: frozenset[int]) -> str:
    """The article of a page: its blocks without the branches to cut, joined by an empty line."""
    return article(Tree(html).root, cut)


def article(root: Node, cut: frozenset[int]) -> str:
    """The same, of a page's elements. An article or main element and what lies around it is not cut."""
    articles, mains = [], []
    if cut or root.main:
        for node, path in list(style_paths(root)):
            if cut and not node.main and _hash(path) in cut:
                node.named, node.tag = True, "nav"  # a branch of no importance counts as no part of the article
            elif node.tag == "article":
                articles.append(node)
            elif node.tag == "main":
                mains.append(node)
    roots = articles or mains
    chosen = set(map(id, roots))

    def below(node: Node) -> bool:
        node = node.parent
        while node and id(node) not in chosen:
            node = node.parent
        return bool(node)

    return "\n\n".join(blocks([node for node in roots if not below(node)] or [root]))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, cut): per host, the paths whose importance is low. Pages need host and html.

    Pages of a host with the same article are copies, whatever stands around it, and count as one: the one whose html has the
    smallest hash, so the result does not depend on how rows are dealt. Copies are folded before the shuffle.

    With m pages at a path, c(x) of them with content x, the entropy of contents to the base m is
    (log m - sum c log c / m) / log m; likewise for presentations. Sums of that form are folded before the shuffle, so a
    hot host costs its number of different contents, and no task holds a host.
    """
    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, *page_statistics(html)) for host, html in zip(batch["host"], batch["html"], strict=True)]
            yield pd.DataFrame(rows, columns=schema.names)

    schema = StructType().add("host", StringType()).add("article", LongType()).add("page", LongType())
    for name in ("path", "content", "looks"):
        schema = schema.add(name, ArrayType(LongType()))
    read = pages.select("host", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(statistics, schema)
    different = read.groupBy("host", "article").agg(
        F.min_by(F.arrays_zip("path", "content", "looks"), "page").alias("nodes"))
    nodes = different.select("host", F.explode("nodes").alias("node")).select("host", "node.*")
    seen = nodes.select("host", "path", F.explode(F.array(
        F.struct(F.lit("content").alias("kind"), F.col("content").alias("value")),
        F.struct(F.lit("looks").alias("kind"), F.col("looks").alias("value")))).alias("v"))
    counts = seen.groupBy("host", "path", "v.kind", "v.value").agg(F.count("*").alias("c"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    nodes = counts.groupBy("host", "path", "kind").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count("*").alias("styles"))

    def of(kind: str, value):
        return F.max(F.when(F.col("kind") == kind, value))

    weighed = nodes.groupBy("host", "path").agg(
        F.max("m").alias("m"), of("content", entropy).alias("content"), of("looks", entropy).alias("looks"),
        of("looks", F.col("styles")).alias("styles"))
    below = F.pow(F.lit(GAMMA), F.col("styles"))
    importance = (1 - below) * F.col("looks") + below * F.col("content")
    return (
        weighed.filter((F.col("m") >= LEAST_PAGES) & (importance < LEAST_IMPORTANCE))
        .groupBy("host").agg(F.collect_set("path").alias("cut"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (its code points).

    The article element's blocks (of main or the whole body where there is none), with character references decoded, blanks
    reduced, without the host's branches of low importance (copies of a page count once) and without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments. A null or empty html, or a page without text, gives an empty text; a null
    url, or one without a host, belongs to the site of the empty host. Equal rows stay. Pages are read whole, whatever
    their length or nesting; truncated or badly nested markup ends with the block around it. An empty table gives an empty
    result; extra columns are left out.
    """
    hosted = url_parts(pages.select("page_id", "url", "html"))
    low = materialise(low_branches(hosted)).withColumnRenamed("host", "__host")

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(html, frozenset(cut) if cut is not None else frozenset())
                     for html, cut in zip(batch["html"], batch["cut"], strict=True)]
            batch = batch[["page_id", "url"]].copy()
            batch["text"] = texts
            batch["n_chars"] = [len(text) for text in texts]
            yield batch

    joined = hosted.join(low, F.col("host") == F.col("__host"), "left").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "cut")
    schema = joined.select("page_id", "url").schema.add("text", StringType()).add("n_chars", LongType())
    return joined.mapInPandas(extracted, schema)
