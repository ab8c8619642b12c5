"""HTML pages to documents: a small tree over the standard parser, then blocks, links, dates and metadata.

The one step that needs Python; it is an Arrow function from (id, html, url) to one struct a page, and everything after
it is relational. A page that cannot be parsed becomes a row with an error, never a failed task.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpage.sources import ship_package

# Elements without end tag, elements dropped with their content, marks of page furniture in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe svg form nav footer aside button select".split())
MARKS = "nav navbar menu footer sidebar breadcrumb breadcrumbs cookie cookies consent banner advert ad ads promo popup modal newsletter social share sharing comment comments".split()
FURNITURE = re.compile(r"(?:^|[\s_-])(?:" + "|".join(MARKS) + r")(?:$|[\s_-])", re.I)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 p li table blockquote dd dt".split())
MAX_LINKS, MAX_ROWS, MAX_CHARS, MAX_DATE, MAX_HEADING = 300, 40, 200_000, 32, 300
FEW_WORDS, VERY_FEW = 100, 80  # below which the body is read in place of the content, and the bare text in place of blocks


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def text(self, between: str = " ") -> str:
        """The text below, its pieces parted by `between`, white space made single blanks."""
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return " ".join(between.join(out).split())

    def walk(self):
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def first(self, *tags: str) -> Node | None:
        return next((x for x in self.walk() if x.tag in tags), None)

    def above(self, *tags: str) -> Node | None:
        """The nearest of such elements around this one."""
        x = self.parent
        while x is not None and x.tag not in tags:
            x = x.parent
        return x

    def below(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if x is not self and x.tag in tags]


class _Tree(HTMLParser):
    """Void elements, implied ends of p, li, dt, dd and table parts; comments are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _close(self, tags: set[str], stop: tuple[str, ...]) -> None:
        x = self.at
        while x.parent is not None and x.tag not in stop:
            if x.tag in tags:
                self.at = x.parent
                return
            x = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS_END_P:
            self._close({"p"}, ("td", "th", "li", "blockquote", "#root"))
        if tag in CLOSES:
            stop = ("ul", "ol", "dl") if tag in ("li", "dt", "dd") else ("table",)
            self._close(CLOSES[tag], stop)
            if tag == "tr":
                self._close({"tr"}, stop)
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None:
            if x.tag == tag:
                self.at = x.parent
                return
            x = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _words(s: str) -> int:
    return len(s.split())


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower().removeprefix("www.")
    except ValueError:
        return ""


def json_ld(root: Node) -> tuple[list[dict], list[str]]:
    """Nodes of every readable block and their types, each once. A container stands before the members of its @graph; members of lists and graphs come
    last to first, each with all that is below it."""

    def expand(x):
        if isinstance(x, dict):
            yield x
            x = x.get("@graph")
        if isinstance(x, list):
            for y in reversed(x):
                yield from expand(y)

    nodes: list[dict] = []
    for s in root.walk():
        if s.tag == "script" and "ld+json" in s.attrs.get("type", "").lower():
            try:
                nodes += expand(json.loads("".join(c for c in s.children if isinstance(c, str))))
            except (ValueError, RecursionError):
                continue
    kinds = (k for n in nodes for k in (n["@type"] if isinstance(n.get("@type"), list) else [n.get("@type")]))
    return nodes, list(dict.fromkeys(k for k in kinds if isinstance(k, str)))


def _meta(root: Node) -> dict[tuple[str, str], str]:
    """(attribute, its value) -> content, by the first tag that has it."""
    found: dict[tuple[str, str], str] = {}
    for m in root.walk():
        if m.tag == "meta":
            for a in ("property", "itemprop", "name"):
                if a in m.attrs:
                    found.setdefault((a, m.attrs[a]), " ".join(m.attrs.get("content", "").split()))
    return found


def _table_text(table: Node) -> str:
    """A sentence for each row after the first, whose cells name the columns; a table of one row has no names."""
    rows = [[c.text() for c in r.below("td", "th")] for r in table.below("tr")[:MAX_ROWS]]
    rows = [r for r in rows if any(r)]
    names, body = (rows[0], rows[1:]) if len(rows) > 1 else ([], rows)
    told = [[f"{names[i]}: {c}" if i < len(names) and names[i] else c for i, c in enumerate(r) if c] for r in body]
    return " ".join("; ".join(x) + "." for x in told if x)


def read_blocks(root: Node, page_host: str) -> list[dict]:
    """Blocks in page order: headings, paragraphs of three words and more, lists at their first item, tables; a heading or paragraph that repeats the one before is
    skipped. An item is of the nearest list around it."""
    out: list[dict] = []
    listed: set[int] = set()
    total, last = 0, None

    def links(n: Node) -> int:
        return sum(1 for a in n.below("a") if a.attrs.get("href", "").startswith("http") and _host(a.attrs["href"]) != page_host)

    def block(kind: str, text: str, level: int | None = None, items: list[str] | None = None, of: Node | None = None) -> dict:
        return {"type": kind, "level": level, "text": text, "items": items, "ext_links": links(of) if of else 0}

    for x in root.walk():
        if total > MAX_CHARS:
            break
        made = None
        if x.tag == "table":
            made = block("table", t, of=x) if x.above("table") is None and (t := _table_text(x)) else None
        elif x.tag == "li":
            box = x.above("ul", "ol")
            if box is not None and x.above("table") is None and not x.below("li") and id(box) not in listed:
                listed.add(id(box))
                items = [t for c in box.below("li") if not c.below("li") and (t := c.text())]
                made = block("list", " ; ".join(items), items=items, of=box) if items else None
        elif x.tag in LEAVES:
            heading = x.tag[0] == "h" and x.tag[1:].isdigit()
            if heading or not (x.above("li", "table") or (x.tag == "p" and x.above("blockquote"))):
                t = x.text()
                if t and t != last and (len(t) <= MAX_HEADING if heading else _words(t) >= 3):
                    made, last = block("heading", t, level=int(x.tag[1])) if heading else block("p", t, of=x), t
        if made:
            out.append(made)
            total += len(made["text"])
    return out


def _drop(root: Node, gone) -> None:
    for x in list(root.walk()):
        if x.parent is not None and x is not root and gone(x):
            x.parent.children = [c for c in x.parent.children if c is not x]


def _content(root: Node) -> tuple[Node, Node]:
    """(body, content): the page without furniture elements, and the element that holds its content, without what is marked as furniture by class or id and holds
    less than half of the content's text."""
    _drop(root, lambda x: x.tag in DROPPED or (x.tag == "header" and x.first("h1", "h2") is None))
    body = root.first("body") or root
    main = root.first("main") or root.first("article") or next((x for x in root.walk() if x.attrs.get("role") == "main"), None) or body
    size = len(main.text()) or 1
    label = lambda x: f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}"
    _drop(main, lambda x: x.tag not in ("html", "body", "main", "article") and FURNITURE.search(label(x)) and len(x.text()) < 0.5 * size)
    return body, main


def parse_page(html: str, url: str) -> dict:
    """One page as a document: title, dates, metadata, JSON-LD, blocks, links, text, and notes on how it was read."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    meta = _meta(root)
    nodes, types = json_ld(root)
    title_node, page = root.first("title"), root.first("html")
    title = title_node.text("") if title_node else ""
    of = lambda a, *names: next((v for n in names if (v := meta.get((a, n)))), "")
    ld = lambda k: next((str(n[k]) for n in nodes if n.get(k)), "")
    times = [x.attrs["datetime"] for x in root.walk() if x.tag == "time" and "datetime" in x.attrs]
    published = of("property", "article:published_time") or of("itemprop", "datePublished") or of("name", "date") or ld("datePublished") or (times[0] if times else "")
    modified = of("property", "article:modified_time") or of("itemprop", "dateModified") or ld("dateModified")
    canonical = next((x.attrs.get("href", "") for x in root.walk() if x.tag == "link" and "canonical" in x.attrs.get("rel", "").split()), "")
    body, main = _content(root)
    host = _host(url or "")
    blocks, read, notes = read_blocks(main, host), main, []
    words_of = lambda bs: sum(_words(b["text"]) for b in bs)
    if words_of(blocks) < FEW_WORDS and main is not body:
        blocks, read = read_blocks(body, host), body
    if words_of(blocks) < VERY_FEW and _words(bare := body.text()) > 1.5 * words_of(blocks):  # a third of the page stands in no block
        blocks, notes = [{"type": "p", "level": None, "text": bare[:MAX_CHARS], "items": None, "ext_links": 0}], ["few blocks were found, so the bare text of the page is taken"]
    links = []
    for a in read.below("a"):
        href = a.attrs.get("href", "").strip()
        if href and not href.startswith(("mailto:", "tel:", "javascript:", "#")):
            links.append({"href": href, "text": a.text()[:120], "external": href.startswith("http") and _host(href) not in ("", host)})
    text = "\n".join(b["text"] if b["text"][-1] in ".?!:" else b["text"] + "." for b in blocks)
    words = len(re.findall(r"[A-Za-z0-9][A-Za-z0-9'’\-]*", text))
    title = title or next((b["text"] for b in blocks if b["type"] == "heading"), "")
    return {
        "ok": words >= 30, "error": "" if words >= 30 else "too little readable text", "title": title, "text": text, "word_count": words, "description": of("name", "description"), "og_title": of("property", "og:title"),
        "og_description": of("property", "og:description"), "og_image": of("property", "og:image"), "robots": of("name", "robots"), "canonical": canonical, "lang": page.attrs.get("lang", "") if page else "",
        "jsonld": [json.dumps(n, ensure_ascii=False) for n in nodes], "schema_types": types, "published": published[:MAX_DATE], "modified": modified[:MAX_DATE], "blocks": blocks, "links": links[:MAX_LINKS], "notes": notes,
    }


def document_views(docs: DataFrame) -> DataFrame:
    """docs with headings (level, text, block), paragraphs, para_links and lists, the views of their blocks."""
    at = F.transform("blocks", lambda b, i: F.struct(b["type"].alias("type"), b["level"].alias("level"), b["text"].alias("text"), i.alias("block")))
    heads = F.transform(F.filter(at, lambda b: b["type"] == "heading"), lambda b: F.struct(b["level"].alias("level"), b["text"].alias("text"), b["block"].alias("block")))
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    return docs.withColumns({"headings": heads, "paragraphs": F.transform(of("p"), lambda b: b["text"]), "para_links": F.transform(of("p"), lambda b: b["ext_links"]), "lists": F.transform(of("list"), lambda b: b["items"])})


FIELDS = [
    ("ok", pa.bool_(), "boolean"), ("error", pa.string(), "string"), ("title", pa.string(), "string"), ("text", pa.string(), "string"), ("word_count", pa.int32(), "int"), ("description", pa.string(), "string"), ("og_title", pa.string(), "string"),
    ("og_description", pa.string(), "string"), ("og_image", pa.string(), "string"), ("robots", pa.string(), "string"), ("canonical", pa.string(), "string"), ("lang", pa.string(), "string"), ("jsonld", pa.list_(pa.string()), "array<string>"), ("schema_types", pa.list_(pa.string()), "array<string>"), ("published", pa.string(), "string"), ("modified", pa.string(), "string"),
    ("blocks", pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("ext_links", pa.int32())])), "array<struct<type:string,level:int,text:string,items:array<string>,ext_links:int>>"),
    ("notes", pa.list_(pa.string()), "array<string>"),
    ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("external", pa.bool_())])), "array<struct<href:string,text:string,external:boolean>>"),
]


def extract_documents(df: DataFrame, rec_id: str, html: str, url: str) -> DataFrame:
    """(rec_id, ok, error, title, text, ..., blocks, links) of every page. NULL and empty pages give a row with an error."""
    ship_package(df.sparkSession)
    kind = df.schema[rec_id].dataType.simpleString()

    def parse(batches):
        empty = {"ok": False, "blocks": [], "links": [], "jsonld": [], "schema_types": [], "notes": [], "word_count": 0}
        for b in batches:
            rows = []
            for h, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    rows.append(parse_page(h, u or "") if h else empty | {"error": "no content"})
                except Exception as e:
                    rows.append(empty | {"error": f"{type(e).__name__}: {e}"[:200]})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.get(n, "") for r in rows], t) for n, t, _ in FIELDS)], ["rec", *(n for n, _, _ in FIELDS)])

    cols = df.select(F.col(rec_id).alias("rec"), F.col(html).alias("h"), F.col(url).alias("u"))
    return cols.mapInArrow(parse, f"rec {kind}, " + ", ".join(f"{n} {s}" for n, _, s in FIELDS)).withColumnRenamed("rec", rec_id)
