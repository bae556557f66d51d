"""XML document formats by a map from element names to node kinds."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

from ..model import Document, Node, Warning_, text

# What an element becomes: a kind, or "" for its children only, or None to drop it.
COMMON = {"table": "table", "thead": "table_head", "tbody": "table_body", "tfoot": "table_foot", "tr": "table_row", "td": "table_cell", "th": "table_header"}
MAPS: dict[str, dict[str, str | None]] = {
    "docbook": COMMON | {
        "para": "paragraph", "simpara": "paragraph", "formalpara": "div", "blockquote": "blockquote", "itemizedlist": "list", "orderedlist": "list:ordered", "procedure": "list:ordered",
        "listitem": "list_item", "step": "list_item", "variablelist": "definition_list", "varlistentry": "", "term": "definition_term", "programlisting": "code_block", "screen": "code_block",
        "literallayout": "code_block", "synopsis": "code_block", "literal": "code", "code": "code", "command": "code", "filename": "code", "option": "code", "userinput": "code", "computeroutput": "code",
        "emphasis": "emphasis", "subscript": "subscript", "superscript": "superscript", "link": "link", "ulink": "link", "xref": "link", "figure": "figure", "informalfigure": "figure", "imagedata": "image",
        "graphic": "image", "caption": "caption", "informaltable": "table", "tgroup": "", "row": "table_row", "entry": "table_cell", "footnote": "footnote_def", "footnoteref": "footnote_ref", "note": "div", "tip": "div",
        "warning": "div", "caution": "div", "important": "div", "quote": "quoted", "title": "title", "subtitle": "title", "section": "section", "sect1": "section", "sect2": "section", "sect3": "section",
        "sect4": "section", "sect5": "section", "chapter": "section", "part": "section", "appendix": "section", "article": "", "book": "", "info": None, "bookinfo": None, "articleinfo": None,
        "mediaobject": "", "inlinemediaobject": "", "imageobject": "", "textobject": None, "colspec": None, "equation": "math_display", "inlineequation": "math_inline", "mathphrase": "",
    },
    "jats": COMMON | {
        "p": "paragraph", "sec": "section", "title": "title", "list": "list", "list-item": "list_item", "def-list": "definition_list", "def-item": "", "term": "definition_term", "def": "definition_desc", "code": "code_block",
        "preformat": "code_block", "monospace": "code", "disp-quote": "blockquote", "italic": "emphasis", "bold": "strong", "underline": "underline", "strike": "strikeout", "sub": "subscript", "sup": "superscript",
        "sc": "small_caps", "ext-link": "link", "uri": "link", "xref": "link", "fig": "figure", "caption": "caption", "graphic": "image", "inline-graphic": "image", "table-wrap": "figure", "disp-formula": "math_display",
        "inline-formula": "math_inline", "tex-math": "", "fn": "footnote_def", "fn-group": "", "article": "", "front": "", "article-meta": "", "title-group": "", "article-title": "heading:1", "journal-meta": None, "body": "", "back": "",
        "abstract": "div", "ref-list": "bibliography", "ref": "bibliography_entry", "mixed-citation": "", "element-citation": "", "break": "line_break", "label": None,
    },
    "tei": COMMON | {
        "p": "paragraph", "ab": "paragraph", "head": "title", "div": "section", "div1": "section", "div2": "section", "div3": "section", "list": "list", "item": "list_item", "label": "definition_term", "code": "code", "eg": "code_block",
        "quote": "blockquote", "q": "quoted", "hi": "emphasis", "emph": "emphasis", "foreign": "emphasis", "title": "emphasis", "ref": "link", "ptr": "link", "figure": "figure", "figDesc": "caption", "graphic": "image", "row": "table_row",
        "cell": "table_cell", "note": "footnote_def", "formula": "math_inline", "lb": "line_break", "pb": "horizontal_rule", "lg": "div", "l": "paragraph", "listBibl": "bibliography", "bibl": "bibliography_entry", "biblStruct": "bibliography_entry",
        "TEI": "", "text": "", "body": "", "front": "", "back": "", "teiHeader": None, "del": "strikeout", "gap": None, "speaker": "strong", "stage": "emphasis", "sp": "div",
    },
    "fb2": COMMON | {
        "p": "paragraph", "v": "paragraph", "section": "section", "title": "title", "subtitle": "heading:3", "strong": "strong", "emphasis": "emphasis", "strikethrough": "strikeout", "sub": "subscript", "sup": "superscript",
        "code": "code", "a": "link", "image": "image", "cite": "blockquote", "epigraph": "blockquote", "poem": "div", "stanza": "div", "empty-line": "line_break", "text-author": "paragraph", "annotation": "div", "FictionBook": "", "body": "",
        "description": None, "binary": None, "stylesheet": None,
    },
    "opml": {"opml": "", "head": None, "body": "list", "outline": "outline"},
}

META = {
    "docbook": {"title": "title", "author": "author", "date": "date"}, "jats": {"article-title": "title"}, "tei": {"title": "title", "author": "author", "language": "language"},
    "fb2": {"book-title": "title", "lang": "language", "genre": "genre"}, "opml": {"title": "title", "dateCreated": "date", "ownerName": "author"},
}


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def load(source) -> ET.Element:
    """The root; character references that XML does not declare are resolved by the standard names."""
    if isinstance(source, (bytes, bytearray)):
        source = bytes(source).decode("utf-8", "replace")
    own = dict(re.findall(r'<!ENTITY\s+(\w+)\s+"([^"]*)"', source))

    def known(m):
        name = m[1]
        if name in ("amp", "lt", "gt", "quot", "apos"):
            return m[0]
        if name in own:
            return own[name]
        found = html.unescape(m[0])
        return m[0].replace("&", "&amp;") if found == m[0] else found

    clean = re.sub(r"<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>", "", source, flags=re.S)
    clean = re.sub(r"^﻿?\s*<\?xml[^>]*\?>", "", clean)
    return ET.fromstring(re.sub(r"&(\w+);", known, clean))


def parse(fmt: str, source) -> Document:
    root, d = load(source), Document(Node("document"))
    names, meta = MAPS[fmt], META[fmt]
    for e in root.iter():
        key = meta.get(_local(e.tag))
        if key and key not in d.metadata:
            value = " ".join("".join(e.itertext()).split())
            if value:
                d.metadata[key] = value
    d.root.add(*_children(root, names, d, 1) if _local(root.tag) in names and names[_local(root.tag)] == "" else _convert(root, names, d, 1))
    return d


def _children(e: ET.Element, names, d: Document, level: int) -> list[Node]:
    out: list[Node] = []

    def put(s: str | None) -> None:
        if s and s.strip():
            s = re.sub(r"\s+", " ", s)
            if out and out[-1].kind == "text":
                out[-1].props["content"] += s
            else:
                out.append(text(s))

    put(e.text)
    for c in e:
        out.extend(_convert(c, names, d, level))
        put(c.tail)
    return out


def _convert(e: ET.Element, names, d: Document, level: int) -> list[Node]:
    tag = _local(e.tag)
    if tag not in names:
        if tag:
            d.warnings.append(Warning_("minor", "UnsupportedNode", tag))
        return _children(e, names, d, level)
    kind = names[tag]
    if kind is None:
        return []
    if kind == "":
        return _children(e, names, d, level)
    attrs = {_local(k): v for k, v in e.attrib.items()}
    if kind == "section":
        return _children(e, names, d, level + 1)
    if kind == "title":
        inner = [c for n in _children(e, names, d, level) for c in (n.children if n.kind == "paragraph" else [n])]
        return [Node("heading", {"level": max(1, min(6, level - 1 if level > 1 else 1))}).add(*inner)]
    if kind.startswith("heading:"):
        return [Node("heading", {"level": int(kind[-1])}).add(*_children(e, names, d, level))]
    if kind == "outline":
        item = Node("list_item").add(Node("paragraph").add(*([text(attrs["text"])] if attrs.get("text") else [])))
        if any(_local(c.tag) == "outline" for c in e):
            item.add(Node("list", {"ordered": False}).add(*_children(e, names, d, level)))
        return [item]
    props: dict = {}
    if kind.startswith("list"):
        if kind != "list_item":
            ordered = kind.endswith(":ordered") or attrs.get("list-type") == "order" or attrs.get("rend") in ("numbered", "ordered") or attrs.get("type") == "ordered"
            kind, props = "list", {"ordered": ordered}
    if kind in ("code", "code_block"):
        props["content"] = "".join(e.itertext())
        if attrs.get("language"):
            props["language"] = attrs["language"]
        return [Node(kind, props)]
    if kind.startswith("math"):
        return [Node(kind, {"math:source": "".join(e.itertext()).strip()})]
    if kind == "emphasis" and (attrs.get("role") in ("bold", "strong") or attrs.get("rend") in ("bold", "strong")):
        kind = "strong"
    if kind in ("link", "image"):
        props["url"] = next((attrs[k] for k in ("href", "url", "fileref", "target", "linkend", "rid") if k in attrs), "".join(e.itertext()) if kind == "link" else "")
    if attrs.get("id"):
        props["id"] = attrs["id"]
    for k in ("colspan", "rowspan"):
        if attrs.get(k, "").isdigit():
            props[k] = int(attrs[k])
    return [Node(kind, props).add(*_children(e, names, d, level))]
