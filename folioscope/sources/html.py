"""HTML parsing: one Arrow function turns markup into a struct of everything that later operators read.

The tree follows the HTML standard where the result shows it: implied html, head and body; void
and raw-text elements (noscript included, as with scripting on); paragraphs, headings, list items
and links that the next one closes; unclosed comments and tags.  Not followed: foster parenting in
tables and the adoption agency for misnested formatting.  It never fails; null is the empty text.
"""

from __future__ import annotations

import html as _entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen bgsound basefont frame".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
RCDATA = frozenset("title textarea".split())
HEAD_ONLY = frozenset("title meta link script style base noscript template basefont bgsound noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
SKIPPED = frozenset("script style noscript template svg iframe object embed nav footer aside".split())
CHROME = frozenset("nav footer aside".split())
FOREIGN = frozenset("svg math".split())
#: Elements that are sought among the open ones at each tag.
_SOUGHT = FOREIGN | frozenset("p li dd dt a button option td th tr".split())

_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WHITE}]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|["']|[^\s>"'][^\s>]*)?)?""")
_BARE_ENTITY = re.compile(r"&(#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[a-zA-Z][a-zA-Z0-9]*;|[a-zA-Z][a-zA-Z0-9]*(?![a-zA-Z0-9=]))")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "within")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        #: Which of the sought elements are this one or around it.
        self.within: frozenset[str] = parent.within if parent is not None else frozenset()
        if tag in _SOUGHT and tag not in self.within:
            self.within |= {tag}
        if parent is not None:
            parent.children.append(self)

    def walk(self) -> Iterator[Node]:
        """The node and its descendants in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)


def words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def _attribute_text(text: str) -> str:
    return _BARE_ENTITY.sub(lambda m: _entities.unescape(m[0]), text) if "&" in text else text


def _tag(markup: str, at: int) -> tuple[str, dict[str, str], bool, int] | None:
    """(name, attributes, self-closing, end) of a tag whose name begins at ``at``; None if it never ends."""
    name = _NAME.match(markup, at)
    at, attrs = name.end(), {}
    while True:
        while at < len(markup) and markup[at] in " \t\n\f\r/":
            at += 1
        if at >= len(markup):
            return None
        if markup[at] == ">":
            return name[0].lower(), attrs, markup[at - 1] == "/", at + 1
        found = _ATTRIBUTE.match(markup, at)
        if not found:
            # A value or an equals sign without a name.
            at += 1
            continue
        value = found[2] or ""
        if value in ('"', "'"):
            return None
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        attrs.setdefault(found[1].lower(), _attribute_text(value))
        at = found.end()


class Tree:
    """Builds the tree; ``root`` is the html element."""

    def __init__(self, markup: str):
        self.root = Node("html", {}, None)
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack = [self.root]
        self._parse(markup.replace("\r\n", "\n").replace("\r", "\n"))
        if self.head is None:
            self.head = Node("head", {}, None)
            self.head.parent = self.root
            self.root.children.insert(0, self.head)
        if self.body is None:
            self.body = Node("body", {}, self.root)

    def _open_head(self) -> None:
        if self.head is None:
            self.head = Node("head", {}, self.root)

    def _open_body(self) -> None:
        if self.body is None:
            self._open_head()
            self.body = Node("body", {}, self.root)
            self.stack = [self.root, self.body]

    def _text(self, text: str) -> None:
        if not text:
            return
        if self.body is None and len(self.stack) == 1:
            text = text.lstrip(" \t\n\f\r")
            if not text:
                return
            self._open_body()
        self.stack[-1].children.append(text)

    def _parse(self, markup: str) -> None:
        at, size = 0, len(markup)
        while at < size:
            lt = markup.find("<", at)
            if lt < 0 or lt + 1 >= size:
                self._text(_entities.unescape(markup[at:]))
                return
            if lt > at:
                self._text(_entities.unescape(markup[at:lt]))
            following = markup[lt + 1]
            if markup.startswith("<!--", lt):
                end = re.compile(r"--!?>").search(markup, lt + 4) if markup[lt + 4 : lt + 5] != ">" else None
                at = lt + 5 if markup[lt + 4 : lt + 5] == ">" else end.end() if end else size
            elif following in "!?" or (following == "/" and not _NAME.match(markup, lt + 2)):
                end = markup.find(">", lt)
                at = end + 1 if end >= 0 else size
            elif following == "/":
                tag = _tag(markup, lt + 2)
                if tag is None:
                    return
                self._end(tag[0])
                at = tag[3]
            elif _NAME.match(markup, lt + 1):
                tag = _tag(markup, lt + 1)
                if tag is None:
                    return
                at = self._start(*tag, markup)
            else:
                self._text("<")
                at = lt + 1

    def _start(self, name: str, attrs: dict[str, str], closed: bool, at: int, markup: str) -> int:
        name = "img" if name == "image" else name
        if name in ("html", "body", "head"):
            if name == "head":
                if self.head is None and self.body is None:
                    self.head = Node("head", attrs, self.root)
                    self.stack = [self.root, self.head]
                return at
            if name == "body":
                self._open_body()
            node = self.root if name == "html" else self.body
            for k, v in attrs.items():
                node.attrs.setdefault(k, v)
            return at
        if self.body is None:
            inside = len(self.stack) > 1 and self.stack[1] is self.head
            if name in HEAD_ONLY:
                if not inside:
                    self._open_head()
                    self.stack = [self.root, self.head]
            elif len(self.stack) < 3:
                self._open_body()
        foreign = not FOREIGN.isdisjoint(self.stack[-1].within)
        if not foreign:
            if name in CLOSES_P:
                self._close("p", SCOPE | {"button"})
            if name in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
            if name == "li":
                self._close("li", SCOPE | {"ol", "ul"})
            elif name in ("dd", "dt"):
                self._close("dd", SCOPE | {"dl"})
                self._close("dt", SCOPE | {"dl"})
            elif name in ("a", "button", "option"):
                self._close(name, SCOPE)
            elif name in ("tr", "td", "th"):
                for cell in ("td", "th") + (("tr",) if name == "tr" else ()):
                    self._close(cell, frozenset({"table", "html", "template"}))
        node = Node(name, attrs, self.stack[-1])
        if (name in VOID and not foreign) or (closed and (foreign or name in FOREIGN)):
            return at
        if (name in RAW or name in RCDATA) and not foreign:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(markup, at)
            stop = end.start() if end else len(markup)
            text = markup[at:stop]
            if name == "textarea":
                text = text.removeprefix("\n")
            if text:
                node.children.append(_entities.unescape(text) if name in RCDATA else text)
            after = markup.find(">", stop) if end else -1
            return after + 1 if after >= 0 else len(markup)
        self.stack.append(node)
        return at

    def _close(self, name: str, until: frozenset[str]) -> None:
        """Pop up to and with the nearest ``name``, one of ``_SOUGHT``, unless an element of ``until`` comes first."""
        if name not in self.stack[-1].within:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag == name:
                del self.stack[k:]
                return
            if tag in until:
                return

    def _end(self, name: str) -> None:
        if name == "head":
            if len(self.stack) > 1 and self.stack[1] is self.head:
                self.stack = [self.root]
            return
        if name in ("body", "html"):
            return
        if name in HEADINGS:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in HEADINGS:
                    del self.stack[k:]
                    return
                if self.stack[k].tag in SCOPE:
                    return
            return
        if name == "p" and "p" not in self.stack[-1].within:
            self._open_body()
            Node("p", {}, self.stack[-1])
            return
        low = 2 if len(self.stack) > 1 and self.stack[1] in (self.head, self.body) else 1
        for k in range(len(self.stack) - 1, low - 1, -1):
            tag = self.stack[k].tag
            if tag == name:
                del self.stack[k:]
                return
            if name in FORMATTING and tag not in FORMATTING:
                return


def schema_types(blocks: list[str]) -> list[str]:
    """Every ``@type`` at any depth of JSON-LD blocks, sorted; blocks that are no JSON are skipped."""
    found: set[str] = set()

    def reject(name: str):
        raise ValueError(name)

    for block in blocks:
        try:
            stack = [json.loads(block, parse_constant=reject)]
        except (ValueError, RecursionError):
            continue
        while stack:
            value = stack.pop()
            if isinstance(value, dict):
                kind = value.get("@type")
                found.update(k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str))
                stack += value.values()
            elif isinstance(value, list):
                stack += value
    return sorted(found, key=lambda s: s.encode("utf-8", "surrogatepass"))


_META = pa.struct([("name", pa.string()), ("property", pa.string()), ("content", pa.string())])
_LINK = pa.struct([("rel", pa.string()), ("href", pa.string()), ("as", pa.string()), ("media", pa.string()), ("hreflang", pa.string()), ("disabled", pa.bool_()), ("in_head", pa.bool_())])
_HEADING = pa.struct([("level", pa.int8()), ("text", pa.string())])
_IMAGE = pa.struct([("src", pa.string()), ("alt", pa.string()), ("loading", pa.string()), ("width", pa.string()), ("height", pa.string())])
_SCRIPT = pa.struct([("src", pa.string()), ("type", pa.string()), ("async", pa.bool_()), ("defer", pa.bool_()), ("in_head", pa.bool_()), ("bytes", pa.int64())])
_ANCHOR = pa.struct([("href", pa.string()), ("rel", pa.string()), ("text", pa.string())])
#: What ``parse`` returns, for each document.
PARSED = pa.struct(
    [
        ("title", pa.string()),
        ("html_lang", pa.string()),
        ("body_text", pa.string()),
        ("metas", pa.list_(_META)),
        ("links", pa.list_(_LINK)),
        ("headings", pa.list_(_HEADING)),
        ("images", pa.list_(_IMAGE)),
        ("scripts", pa.list_(_SCRIPT)),
        ("anchors", pa.list_(_ANCHOR)),
        ("noscripts", pa.list_(pa.string())),
        ("picture_sources", pa.list_(pa.string())),
        ("schema_types", pa.list_(pa.string())),
        ("table_count", pa.int32()),
        ("style_bytes", pa.int64()),
    ]
)
PARSED_DDL = (
    "struct<title:string,html_lang:string,body_text:string,metas:array<struct<name:string,property:string,content:string>>,"
    "links:array<struct<rel:string,href:string,as:string,media:string,hreflang:string,disabled:boolean,in_head:boolean>>,"
    "headings:array<struct<level:tinyint,text:string>>,images:array<struct<src:string,alt:string,loading:string,width:string,height:string>>,"
    "scripts:array<struct<src:string,type:string,async:boolean,defer:boolean,in_head:boolean,bytes:bigint>>,"
    "anchors:array<struct<href:string,rel:string,text:string>>,noscripts:array<string>,picture_sources:array<string>,"
    "schema_types:array<string>,table_count:int,style_bytes:bigint>"
)


def parse(markup: str | None) -> dict:
    """The fields of ``PARSED`` of one document."""
    tree = Tree(markup or "")
    nodes = list(tree.root.walk())
    # Parents come before children, so one pass each way settles what lies within what.
    around_nav: set[int] = set()
    for n in reversed(nodes):
        if n.tag == "nav" or id(n) in around_nav:
            around_nav.add(id(n.parent))
    banners = {id(n) for n in nodes if n.tag == "header" and id(n) in around_nav}
    in_chrome: dict[int, bool] = {}
    in_head: dict[int, bool] = {}
    for n in nodes:
        p = n.parent
        in_chrome[id(n)] = p is not None and (in_chrome[id(p)] or p.tag in CHROME or id(p) in banners)
        in_head[id(n)] = p is not None and (in_head[id(p)] or p.tag == "head")
    out: dict = {k: [] for k in ("metas", "links", "headings", "images", "scripts", "anchors", "noscripts", "picture_sources")}
    out |= {"title": None, "table_count": 0, "style_bytes": 0}
    blocks = []
    for n in nodes:
        a, tag = n.attrs, n.tag
        if tag == "title" and out["title"] is None:
            out["title"] = n.text().strip(_WHITE)
        elif tag == "meta":
            out["metas"].append({"name": a.get("name"), "property": a.get("property"), "content": a.get("content")})
        elif tag == "link":
            out["links"].append({k: a.get(k) for k in ("rel", "href", "as", "media", "hreflang")} | {"disabled": "disabled" in a, "in_head": in_head[id(n)]})
        elif tag in HEADINGS:
            text = " ".join(words(n.text()))
            if text and not in_chrome[id(n)]:
                out["headings"].append({"level": int(tag[1]), "text": text})
        elif tag == "img":
            out["images"].append({k: a.get(k) for k in ("src", "alt", "loading", "width", "height")})
        elif tag == "script":
            text = n.text()
            out["scripts"].append({"src": a.get("src"), "type": a.get("type"), "async": "async" in a, "defer": "defer" in a, "in_head": in_head[id(n)], "bytes": len(text.encode("utf-8", "surrogatepass"))})
            if (a.get("type") or "").lower() == "application/ld+json":
                blocks.append(text)
        elif tag == "a":
            if "href" in a and not in_chrome[id(n)]:
                out["anchors"].append({"href": a["href"], "rel": a.get("rel"), "text": " ".join(words(n.text()))})
        elif tag == "noscript":
            out["noscripts"].append(n.text())
        elif tag == "source":
            if n.parent.tag == "picture" and "type" in a:
                out["picture_sources"].append(a["type"])
        elif tag == "table":
            out["table_count"] += not in_chrome[id(n)]
        elif tag == "style":
            out["style_bytes"] += len(n.text().encode("utf-8", "surrogatepass"))
    root = next((n for n in nodes if n.tag == "main"), tree.body)
    pieces, stack = [], list(reversed(root.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            pieces.append(n)
        elif n.tag not in SKIPPED and id(n) not in banners:
            stack += reversed(n.children)
    out["body_text"] = " ".join(words(" ".join(pieces)))
    out["html_lang"] = tree.root.attrs.get("lang")
    out["schema_types"] = schema_types(blocks)
    return out


def parsed(docs: DataFrame, html_col: str = "html_like") -> DataFrame:
    """``docs`` with the column ``parsed``; the markup crosses to Python once, in Arrow batches."""
    names = docs.columns
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small steps keep the trees of one step only in memory.
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                trees = pa.array([parse(m) for m in rows.column(at).to_pylist()], PARSED)
                yield pa.RecordBatch.from_arrays([*rows.columns, trees], [*names, "parsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, parsed {PARSED_DDL}").select("*", F.col("parsed.body_text").alias("body_text"))
