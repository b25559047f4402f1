"""Article pages to rows: a small tolerant tree from the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes an open element of the same kind (forgotten end tags).
IMPLIED = {"p": {"p"}, "li": {"li"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "div": {"p"}, "article": {"p"}, "ul": {"p"}}


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def walk(self):
        for x in self.parts:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def strings(self, without=()):
        for x in self.parts:
            if isinstance(x, Node):
                if x.tag not in without:
                    yield from x.strings(without)
            else:
                yield x

    def text(self, separator="", without=()):
        return separator.join(s for s in (t.strip() for t in self.strings(without)) if s)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in IMPLIED.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str) -> Node:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


BODY_CLASS = re.compile(r"article[-_]?(body|content|text)", re.I)
NOISE = ("script", "style", "nav", "aside", "figure")


def meta(nodes: list[Node], *names: str) -> str:
    """First non-empty content, ``property`` before ``name``, in the order of names."""
    for n in names:
        for kind in ("property", "name"):
            for x in nodes:
                if x.tag == "meta" and x.attrs.get(kind) == n and x.attrs.get("content", "").strip():
                    return x.attrs["content"].strip()
    return ""


def article(url: str, html: str, path: str = "/articles/", site: str = "", least: int = 80) -> dict | None:
    """The fields of an article page, or None if it is none.  ``path`` must be part of its
    final address ("" for any)."""
    nodes = list(tree(html).walk())
    try:
        return _fields(nodes, url, path, site, least)
    finally:
        for x in nodes:  # no cycles: a page's tree goes at once, not when garbage is next collected
            x.parent = None


def _fields(nodes: list[Node], url: str, path: str, site: str, least: int) -> dict | None:
    final = meta(nodes, "og:url") or url or ""
    if path and path not in final:
        return None
    first = lambda cond: next((x for x in nodes if cond(x)), None)
    h1 = first(lambda x: x.tag == "h1")
    title = meta(nodes, "og:title", "twitter:title") or (h1.text() if h1 else "")
    if not title or (site and len(title) < 10 and site in title):
        return None
    box = (
        first(lambda x: x.tag == "div" and BODY_CLASS.search(x.attrs.get("class", "")))
        or first(lambda x: x.tag == "div" and x.attrs.get("itemprop") == "articleBody")
        or first(lambda x: x.tag == "article")
    )
    if box is not None:
        blocks, shortest = [x for x in box.walk() if x.tag in ("p", "h2", "h3", "li") and not _inside(x, box)], 10
    else:
        blocks, shortest = [x for x in nodes if x.tag == "p"], 20
    body = " ".join(x.text(" ", NOISE if box else ()) for x in blocks if len(x.text("", NOISE if box else ())) > shortest).strip()
    if body.startswith(title):
        body = body[len(title) :].lstrip()
    if len(body) < least:
        return None
    tags = [x.attrs["content"].strip() for x in nodes if x.tag == "meta" and x.attrs.get("property") == "article:tag" and x.attrs.get("content")]
    return {
        "title": title, "body": body, "section": meta(nodes, "article:section"),
        "tags": tags or [t.strip() for t in meta(nodes, "keywords").split(",") if t.strip()],
        "pub_date": meta(nodes, "article:published_time", "og:article:published_time", "datePublished", "publishedTime"),
        "image": meta(nodes, "og:image", "twitter:image"), "source_url": final,
    }


def _inside(node: Node, box: Node) -> bool:
    while node is not box:
        if node.tag in NOISE:
            return True
        node = node.parent
    return False


ROW = "page_id long, title string, body string, section string, tags array<string>, pub_date string, image string, source_url string"
KIND = pa.schema(
    [("page_id", pa.int64()), *[(n, pa.string()) for n in ("title", "body", "section")], ("tags", pa.list_(pa.string())), *[(n, pa.string()) for n in ("pub_date", "image", "source_url")]]
)


#: Pages of one Arrow batch (as in qanat.llm.common), and characters of results that are given at once: what a Python worker holds does not grow with the table.
PAGES, GIVEN = 2000, 1 << 20


def parse_pages(pages: DataFrame, path: str = "/articles/", site: str = "") -> DataFrame:
    """Article rows of pages (page_id, url, html); pages that are no article give none."""
    conf = pages.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > PAGES:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES))

    def task(batches):
        for rb in batches:
            rows, held = [], 0
            for i in range(rb.num_rows):
                key, url, html = (c[i].as_py() for c in rb.columns)
                found = article(url, html, path, site)
                if found:
                    rows.append({"page_id": key} | found)
                    held += len(found["body"])
                if rows and (held >= GIVEN or i + 1 == rb.num_rows):
                    yield pa.RecordBatch.from_pylist(rows, schema=KIND)
                    rows, held = [], 0

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(task, ROW)


def link_ids(html, pattern: str = r'href="[^"]*/articles/(\d{4,})'):
    """Distinct article ids among the links of a page, greatest first."""
    ids = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x.cast("long"))
    return F.sort_array(F.array_distinct(ids), asc=False)
