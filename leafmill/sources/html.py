"""HTML pages to trees, with the recovery that malformed pages need."""

from __future__ import annotations

from html.parser import HTMLParser

from ..model import Document, Node, Warning_

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head template noscript".split())
#: Tags whose element maps to a node kind (fixed values).
BLOCKS = {
    "p": "paragraph", "pre": "code_block", "blockquote": "blockquote", "ul": "list", "ol": "list", "li": "list_item",
    "dl": "definition_list", "dt": "definition_term", "dd": "definition_desc", "table": "table", "thead": "table_head",
    "tbody": "table_body", "tfoot": "table_foot", "tr": "table_row", "td": "table_cell", "th": "table_header",
    "caption": "caption", "figure": "figure", "figcaption": "caption", "hr": "horizontal_rule", "div": "div",
    "section": "div", "article": "div", "main": "div", "aside": "div", "nav": "div", "header": "div", "footer": "div",
    "address": "div", "details": "div", "summary": "div",
}
INLINES = {
    "em": "emphasis", "i": "emphasis", "strong": "strong", "b": "strong", "s": "strikeout", "strike": "strikeout",
    "del": "strikeout", "u": "underline", "ins": "underline", "sub": "subscript", "sup": "superscript", "code": "code",
    "a": "link", "img": "image", "br": "line_break", "span": "span", "q": "quoted", "small": "span", "abbr": "span",
    "mark": "span", "kbd": "span", "var": "span", "samp": "span", "cite": "span",
}
#: An opening tag closes these open elements first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
CLOSE_P = frozenset(BLOCKS) - {"td", "th", "tr", "caption", "dt", "dd", "thead", "tbody", "tfoot", "figcaption"} | frozenset(
    ["h1", "h2", "h3", "h4", "h5", "h6", "form", "fieldset"]
)
FORMATTING = frozenset("a b code em i s small strike strong u".split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("document")
        self.open: list[tuple[str, Node, dict]] = [("body", self.root, {})]
        self.again: list[tuple[str, dict]] = []
        self.skip: list[str] = []
        self.meta: dict = {}
        self.warnings: list[Warning_] = []
        self.title: list[str] | None = None
        self.table_depth = 0

    # -- tree ----------------------------------------------------------
    def _node(self, tag: str, attrs: dict) -> Node:
        props: dict = {}
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            kind, props["level"] = "heading", int(tag[1])
        elif tag in BLOCKS:
            kind = BLOCKS[tag]
            if tag in ("ul", "ol"):
                props["ordered"] = tag == "ol"
                if tag == "ol" and (attrs.get("start") or "").lstrip("-").isdigit():
                    props["start"] = int(attrs["start"])
            if BLOCKS[tag] == "div" and tag != "div":
                props["html:tag"] = tag
        elif tag in INLINES:
            kind = INLINES[tag]
            if tag == "a":
                props["url"] = attrs.get("href") or ""
            elif tag == "img":
                props["url"] = attrs.get("src") or ""
                props["alt"] = attrs.get("alt") or ""
            elif kind == "span" and tag != "span":
                props["html:tag"] = tag
        else:
            kind = "div"
            props["html:tag"] = tag
            self.warnings.append(Warning_("minor", "UnsupportedNode", tag, f"unknown element {tag}"))
        for name, key in (("id", "id"), ("class", "classes"), ("title", "title"), ("colspan", "colspan"), ("rowspan", "rowspan")):
            v = attrs.get(name)
            if v:
                props[key] = int(v) if "span" in name and v.isdigit() else v
        return Node(kind, props)

    def _reopen(self) -> None:
        again, self.again = self.again, []
        for tag, attrs in again:
            self._push(tag, attrs)

    def _push(self, tag: str, attrs: dict) -> None:
        node = self._node(tag, attrs)
        self.open[-1][1].children.append(node)
        if tag not in VOID:
            self.open.append((tag, node, attrs))

    def _close(self, tag: str, fences: set[str] = frozenset()) -> bool:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag not in FORMATTING:
                    # Formatting left open inside goes on after the element.
                    self.again = [(t, a) for t, _, a in self.open[k + 1 :] if t in FORMATTING]
                else:
                    self.again = [(t, a) for t, _, a in self.open[k + 1 :] if t in FORMATTING and t != tag]
                del self.open[k:]
                return True
            if self.open[k][0] in fences:
                return False
        return False

    # -- events --------------------------------------------------------
    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v for k, v in reversed(attrs)}
        if tag == "html":
            if a.get("lang"):
                self.meta["language"] = a["lang"]
            return
        if tag == "meta":
            if a.get("charset"):
                self.meta["charset"] = a["charset"]
            name = a.get("name") or a.get("property") or ""
            if name and a.get("content") is not None:
                self.meta[name.removeprefix("og:")] = a["content"]
            return
        if tag == "title" and self.title is None:
            self.title = []
            return
        if tag in ("body", "link", "base"):
            return
        if tag == "head":
            return
        if tag in DROPPED:
            self.skip.append(tag)
            return
        if self.skip:
            return
        if tag in CLOSE_P:
            self._close("p", {"table", "button"})
        for t in CLOSES.get(tag, ()):
            self._close(t, FENCES.get(tag, {"table"}))
        if tag in INLINES and tag not in FORMATTING:
            self._reopen()
        elif tag in FORMATTING:
            self._reopen()
            if tag == "a":
                self._close("a")
                self.again = []
        self._push(tag, a)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in self.skip:
            self.skip.remove(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and isinstance(self.title, list):
            self.meta["title"] = "".join(self.title).strip()
            self.title = None
            return
        if self.skip:
            if self.skip[-1] == tag:
                self.skip.pop()
            return
        if tag == "p" and not any(t == "p" for t, _, _ in self.open):
            self._push("p", {})
        self._close(tag, {"table"} if tag not in ("table", "body", "html") else set())

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
            return
        if self.skip:
            return
        pre = any(t == "pre" for t, _, _ in self.open)
        if not pre and not data.strip():
            return
        self._reopen()
        children = self.open[-1][1].children
        if children and children[-1].kind == "text":
            children[-1].props["content"] += data
        else:
            children.append(Node("text", {"content": data}))


def _settle_code(root: Node) -> None:
    """Code keeps its text as a property instead of children."""
    for n in root.walk():
        if n.kind in ("code", "code_block") and n.children:
            n.props["content"] = n.text()
            n.children = []


def parse(source: str) -> Document:
    b = _Builder()
    b.feed(source)
    b.close()
    _settle_code(b.root)
    return Document(b.root, b.meta, b.warnings)
