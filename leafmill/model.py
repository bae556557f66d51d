"""The document model: trees in parsers, flat ``nodes`` rows in Spark.

A document is one row of ``docs`` and many rows of ``nodes``.  Trees are kept
by pre-order number and the number of the last descendant, so "is an ancestor
of" is an interval test and children in order are ``ORDER BY ordinal``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

NODES = (
    "doc_id long, node_id int, parent_id int, ordinal int, depth int, last_desc int, "
    "kind string, content string, level int, props string"
)
DOCS = "doc_id long, format string, parse_ok boolean, error_category string, error_message string, metadata string"
WARNINGS = "doc_id long, stage string, severity string, severity_rank int, kind string, detail string, message string"
RESOURCES = "doc_id long, resource_id string, name string, mime_type string, data binary"

#: Fidelity severities in rising order (fixed values).
SEVERITIES = ("info", "minor", "major", "error")


@dataclass
class Node:
    """One element of a document tree; ``kind`` is open, unknown kinds pass through."""

    kind: str
    props: dict[str, Any] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    span: tuple[int, int] | None = None

    def add(self, *nodes: Node) -> Node:
        self.children.extend(nodes)
        return self

    def walk(self) -> Iterator[Node]:
        """Pre-order, without recursion, so deep trees are safe."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(n.props.get("content", "") for n in self.walk() if isinstance(n.props.get("content", ""), str))


@dataclass
class Warning_:
    severity: str
    kind: str
    detail: str
    message: str = ""


@dataclass
class Document:
    root: Node
    metadata: dict[str, Any] = field(default_factory=dict)
    warnings: list[Warning_] = field(default_factory=list)
    resources: list[tuple[str, str, bytes]] = field(default_factory=list)
    source: str | None = None

    def to_json(self) -> dict:
        """The document as the query language sees it."""
        return {
            "content": _plain(self.root),
            "metadata": {k: _value(v) for k, v in self.metadata.items()},
            "resources": {f"res_{i}": {"name": n, "mime_type": m} for i, (n, m, _) in enumerate(self.resources)},
            "source": self.source,
        }


def _value(v: Any) -> Any:
    """Floats that JSON lacks become strings; all else stays."""
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_value(x) for x in v]
    return v


def _plain(root: Node) -> dict:
    def shell(n: Node) -> dict:
        out: dict[str, Any] = {"kind": n.kind, "props": _value(n.props), "children": []}
        if n.span:
            out["span"] = {"start": n.span[0], "end": n.span[1]}
        return out

    top = shell(root)
    stack = [(root, top)]
    while stack:
        node, out = stack.pop()
        for c in node.children:
            inner = shell(c)
            out["children"].append(inner)
            stack.append((c, inner))
    return top


def from_json(data: dict) -> Node:
    root = Node(data.get("kind", "document"), dict(data.get("props") or {}))
    stack = [(data, root)]
    while stack:
        d, n = stack.pop()
        for c in d.get("children") or []:
            inner = Node(c.get("kind", "div"), dict(c.get("props") or {}))
            n.children.append(inner)
            stack.append((c, inner))
    return root


_ENCODE = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


def flatten(doc_id: int, root: Node, props: bool = True) -> list[tuple]:
    """Rows of ``nodes`` in pre-order; without ``props`` those are null."""
    rows: list[list] = []
    # (node, parent, ordinal, depth); the second visit of a node closes its interval.
    stack: list[tuple] = [(root, None, 0, 0)]
    while stack:
        node, parent, ordinal, depth = stack.pop()
        if node is None:
            rows[parent][5] = len(rows) - 1
            continue
        me = len(rows)
        level, content = node.props.get("level"), node.props.get("content")
        rows.append(
            [
                doc_id,
                me,
                parent,
                ordinal,
                depth,
                me,
                node.kind,
                content if isinstance(content, str) else None,
                level if isinstance(level, int) and not isinstance(level, bool) else None,
                (_ENCODE(_value(node.props)) if node.props else "{}") if props else None,
            ]
        )
        stack.append((None, me, 0, 0))
        stack.extend((c, me, i, depth + 1) for i, c in reversed(list(enumerate(node.children))))
    return [tuple(r) for r in rows]


def rebuild(rows) -> Node:
    """The tree of one document's ``nodes`` rows; rows may come in any order."""
    made: dict[int, Node] = {}
    root = Node("document")
    for r in sorted(rows, key=lambda r: r["node_id"]):
        node = Node(r["kind"], json.loads(r["props"] or "{}"))
        made[r["node_id"]] = node
        if r["parent_id"] is None or r["parent_id"] != r["parent_id"]:
            root = node
        else:
            made[int(r["parent_id"])].children.append(node)
    return root


# -- builder ---------------------------------------------------------------


def text(content: str) -> Node:
    return Node("text", {"content": content})


def _inline(items) -> list[Node]:
    return [text(x) if isinstance(x, str) else x for x in items]


def doc(*blocks: Node) -> Node:
    return Node("document", children=list(blocks))


def para(*items) -> Node:
    return Node("paragraph", children=_inline(items))


def heading(level: int, *items) -> Node:
    return Node("heading", {"level": level}, _inline(items))


def code_block(content: str, language: str | None = None) -> Node:
    return Node("code_block", {"content": content} | ({"language": language} if language else {}))


def blockquote(*blocks: Node) -> Node:
    return Node("blockquote", children=list(blocks))


def list_item(*blocks) -> Node:
    return Node("list_item", children=_inline(blocks))


def bullet_list(*items: Node) -> Node:
    return Node("list", {"ordered": False}, list(items))


def ordered_list(*items: Node, start: int = 1) -> Node:
    return Node("list", {"ordered": True} | ({"start": start} if start != 1 else {}), list(items))


def table(header: list[str] | None, *rows: list[str]) -> Node:
    out = Node("table")
    if header is not None:
        out.add(Node("table_row", children=[Node("table_header", children=_inline([c])) for c in header]))
    for r in rows:
        out.add(Node("table_row", children=[Node("table_cell", children=_inline([c])) for c in r]))
    return out


def wrap(kind: str, *items, **props) -> Node:
    return Node(kind, props, _inline(items))


def link(url: str, *items, title: str | None = None) -> Node:
    return Node("link", {"url": url} | ({"title": title} if title else {}), _inline(items))


def image(url: str, alt: str = "", title: str | None = None) -> Node:
    return Node("image", {"url": url} | ({"alt": alt} if alt else {}) | ({"title": title} if title else {}))
