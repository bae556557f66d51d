"""JSON forms of a tree: the engine's own, Pandoc's, and notebooks."""

from __future__ import annotations

import json

from ..model import Document, Node
from .styles import STYLES, Emitter


def _native(doc: Document) -> str:
    return json.dumps(doc.to_json(), ensure_ascii=False, indent=2) + "\n"


NAMES = {
    "paragraph": "Para", "blockquote": "BlockQuote", "emphasis": "Emph", "strong": "Strong", "strikeout": "Strikeout", "underline": "Underline", "superscript": "Superscript", "subscript": "Subscript", "small_caps": "SmallCaps",
}


def _pandoc_list(nodes: list[Node]) -> list[dict]:
    return [x for n in nodes for x in _pandoc(n)]


def _pandoc(n: Node) -> list[dict]:
    k, p = n.kind, n.props
    attr = [str(p.get("id", "")), str(p.get("classes", "")).split(), []]
    body = lambda: _pandoc_list(n.children)
    if k == "text":
        out: list[dict] = []
        for i, w in enumerate(str(p.get("content", "")).split(" ")):
            if i:
                out.append({"t": "Space"})
            if w:
                out.append({"t": "Str", "c": w})
        return out
    if k in NAMES:
        return [{"t": NAMES[k], "c": body()}]
    if k == "heading":
        return [{"t": "Header", "c": [p.get("level", 1), attr, body()]}]
    if k == "code_block":
        return [{"t": "CodeBlock", "c": [["", [p["language"]] if p.get("language") else [], []], p.get("content", "")]}]
    if k == "code":
        return [{"t": "Code", "c": [["", [], []], p.get("content", "")]}]
    if k == "list":
        items = [_pandoc_list(i.children) for i in n.children]
        if p.get("ordered"):
            return [{"t": "OrderedList", "c": [[p.get("start", 1), {"t": "Decimal"}, {"t": "Period"}], items]}]
        return [{"t": "BulletList", "c": items}]
    if k in ("link", "image"):
        inner = body() if k == "link" else _pandoc(Node("text", {"content": p.get("alt", "")}))
        return [{"t": k.title(), "c": [["", [], []], inner, [p.get("url", ""), p.get("title", "")]]}]
    if k in ("line_break", "soft_break"):
        return [{"t": "LineBreak" if k == "line_break" else "SoftBreak"}]
    if k == "horizontal_rule":
        return [{"t": "HorizontalRule"}]
    if k in ("math_inline", "math_display"):
        return [{"t": "Math", "c": [{"t": "DisplayMath" if k == "math_display" else "InlineMath"}, p.get("math:source", "")]}]
    if k in ("raw_block", "raw_inline"):
        return [{"t": "RawBlock" if k == "raw_block" else "RawInline", "c": [p.get("format", ""), p.get("content", "")]}]
    if k == "footnote_def":
        return [{"t": "Note", "c": body()}]
    if k == "quoted":
        return [{"t": "Quoted", "c": [{"t": "SingleQuote" if p.get("quote_type") == "single" else "DoubleQuote"}, body()]}]
    if k == "table":
        cell = lambda c: [["", [], []], {"t": "AlignDefault"}, 1, 1, [{"t": "Plain", "c": _pandoc_list(c.children)}]]
        rows = [r for r in n.walk() if r.kind == "table_row"]
        made = lambda r: [["", [], []], [cell(c) for c in r.children]]
        is_head = lambda r: bool(r.children) and all(c.kind == "table_header" for c in r.children)
        width = max((len(r.children) for r in rows), default=0)
        return [{"t": "Table", "c": [["", [], []], [None, []], [[{"t": "AlignDefault"}, {"t": "ColWidthDefault"}]] * width, [["", [], []], [made(r) for r in rows if is_head(r)]], [[["", [], []], 0, [], [made(r) for r in rows if not is_head(r)]]], [["", [], []], []]]}]
    if k in ("div", "span"):
        return [{"t": k.title(), "c": [attr, body()]}]
    return body()


def _pandoc_json(doc: Document) -> str:
    meta = {k: {"t": "MetaString", "c": str(v)} for k, v in doc.metadata.items()}
    return json.dumps({"pandoc-api-version": [1, 23], "meta": meta, "blocks": _pandoc_list(doc.root.children)}, ensure_ascii=False) + "\n"


def _ipynb(doc: Document) -> str:
    cells, held, e = [], [], Emitter(STYLES["markdown"])

    def flush() -> None:
        if held:
            cells.append({"cell_type": "markdown", "metadata": {}, "source": "\n\n".join(e.blocks(held))})
            held.clear()

    for n in doc.root.children:
        if n.kind == "code_block":
            flush()
            cells.append({"cell_type": "code", "metadata": {}, "execution_count": None, "outputs": [], "source": n.props.get("content", "")})
        else:
            held.append(n)
    flush()
    return json.dumps({"cells": cells, "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False, indent=1) + "\n"


WRITERS = {"native": _native, "pandoc-json": _pandoc_json, "ipynb": _ipynb}
